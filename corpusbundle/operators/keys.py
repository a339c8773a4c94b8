"""Which keys of a table occur again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbundle.operators.durable import durable_table


def slot_bitmap(keys: Column, rows: DataFrame, least: int = 1, bits: int = 24) -> DataFrame:
    """A bitmap (word, mask) of the slots that ``least`` or more rows fall into.

    It has 2**bits slots at every input size, so it may be broadcast. Two keys can
    share a slot: it tells which rows can be left out, not which are equal.
    """
    slot = F.pmod(keys, F.lit(1 << bits)).alias("_slot")
    met = rows.select(slot).groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).filter(f"_n >= {least}")
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    return met.groupBy(F.expr("_slot div 64").alias("_word")).agg(F.bit_or(bit).alias("_mask"))


def flagged(rows: DataFrame, keys: Column, bitmap: DataFrame, name: str, bits: int = 24) -> DataFrame:
    """Add the boolean column ``name``: whether the key's slot is set in the bitmap.

    A null key is not set.
    """
    slot, word, mask = f"{name}_slot", f"{name}_word", f"{name}_mask"
    held = F.broadcast(bitmap.select(F.col("_word").alias(word), F.col("_mask").alias(mask)))
    marked = rows.withColumn(slot, F.pmod(keys, F.lit(1 << bits)))
    joined = marked.join(held, F.expr(f"{slot} div 64") == F.col(word), "left")
    is_set = F.expr(f"coalesce((shiftright({mask}, cast({slot} % 64 as int)) & 1L) = 1L, false)")
    return joined.withColumn(name, is_set).drop(slot, word, mask)


#: Repeated keys that are broadcast as they are, eight bytes each.
EXACT_KEYS = 1 << 20

#: Slots of the largest bitmap that is broadcast (16 MiB of bits), and slots for each key in it.
MOST_BITS = 27
SLOTS_PER_KEY = 16


def with_members(
    rows: DataFrame, keys: Column, members: DataFrame, name: str, exact: int = EXACT_KEYS, most_bits: int = MOST_BITS
) -> DataFrame | None:
    """Add the boolean column ``name``: whether the (64-bit) key may be one of ``members``.

    ``members`` is a written table with distinct keys in the column ``_key``. What is
    broadcast is sized to it: the keys themselves, or a bitmap with sixteen slots for each,
    in which one other row in sixteen is taken for a member. A null key is no member. None
    if there are too many members for that. The members are counted when this is called.
    """
    n = members.count()
    if n <= exact:
        held = F.broadcast(members.select(F.col("_key").alias(f"{name}_key"), F.lit(True).alias(f"{name}_hit")))
        joined = rows.join(held, keys == F.col(f"{name}_key"), "left")
        return joined.withColumn(name, F.col(f"{name}_hit").isNotNull()).drop(f"{name}_key", f"{name}_hit")
    bits = (SLOTS_PER_KEY * n - 1).bit_length()
    if bits > most_bits:
        return None
    return flagged(rows, keys, durable_table(slot_bitmap(F.col("_key"), members, bits=bits)), name, bits)


def with_repeated(
    rows: DataFrame, keys: Column, name: str, exact: int = EXACT_KEYS, most_bits: int = MOST_BITS
) -> DataFrame | None:
    """Add the boolean column ``name``: whether another row may have the same (64-bit) key.

    The keys alone are counted first, and what is broadcast is sized to those that occur
    again (see ``with_members``). How many distinct keys there are does not matter. None if
    too many keys occur again for that: rows then have to be shuffled by their key. The
    keys are counted when this is called.
    """
    counts = rows.select(keys.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    again = durable_table(counts.filter("_n > 1 and _key is not null").select("_key"))
    return with_members(rows, keys, again, name, exact, most_bits)
