"""Chat formatting: a dialogue rendered once for each participant, with that one as the assistant.

A dialogue is rendered as parts of bounded size, so one that holds a third of all
turns is spread over tasks like any other rows. Only column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbundle.llm.common import durable_table, spread_join, text_of
from corpusbundle.operators.ordering import with_positions

#: The name of a speaker that is null or empty.
UNNAMED = "unknown"

#: What a turn counts beside its text, so that empty turns fill a part as well.
_TURN_BYTES = 32


def _open(speaker: Column, perspective: Column) -> Column:
    """The header of a turn: it names the speaker unless that is the assistant or the system."""
    return (
        F.when(speaker == perspective, F.lit("<|assistant|>\n"))
        .when(speaker == "system", F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user|> "), speaker, F.lit("\n")))
    )


_END = "<|end|>\n"


def rotate_perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_bytes: int = 1 << 16,
) -> DataFrame:
    """One row per dialogue, participant and part: conv, perspective, part_no, n_turns, text, mask.

    Every speaker but ``system`` is a participant. In its perspective its own turns are
    the assistant's, all others are users called by their names, and system turns stay.
    ``mask`` lists the stretches (start, length), in characters of ``text``, on which loss
    is taken: what the assistant says, with the end mark. A dialogue's parts, in order,
    make up the whole rendering; a part holds about ``part_bytes`` of text, and at least
    one turn. Turns are ordered by ``turn``, then speaker, a hash of the text, and place; so
    ties and repeated rows keep a fixed order, and each is rendered. Texts and names are
    written as they are: a mark such as ``<|end|>`` inside one is not escaped, so clean them
    first where users may forge turns; ``mask`` holds in any case. A null turn comes first, a null
    or empty speaker is ``unknown``, a null text is empty, and null dialogue ids form one
    dialogue. A dialogue of system turns alone has no perspective. Other columns are not
    read.
    """
    source = durable_table(
        turns.select(
            F.to_json(F.struct(F.col(conv_col).alias("c"))).alias("_conv"),
            F.col(conv_col).alias("_id"),
            F.col(turn_col).alias("_turn"),
            F.coalesce(F.when(F.col(role_col) != "", F.col(role_col)), F.lit(UNNAMED)).alias("_speaker"),
            text_of(text_col).alias("_text"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    narrow = source.select(
        "_conv", "_turn", "_speaker", F.xxhash64("_text").alias("_tie"), "_row",
        (F.octet_length("_text") + _TURN_BYTES).cast("long").alias("_bytes"),
    )
    placed = with_positions(narrow, ["_conv"], ["_turn", "_speaker", "_tie", "_row"], nbytes="_bytes")
    placed = placed.select("_row", "ordinal", F.expr(f"byte_offset div {part_bytes}").alias("_part"))
    parts = (
        source.join(placed, "_row")
        .groupBy("_conv", "_part")
        .agg(
            F.first("_id").alias("_id"),
            F.array_sort(F.collect_list(F.struct("ordinal", "_speaker", "_text"))).alias("_turns"),
        )
    )
    cast = durable_table(
        narrow.groupBy("_conv", "_speaker")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("_conv")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_speaker") != "system", F.col("_speaker")))).alias("_cast"),
            F.sum("_n").alias("_n"),
        )
        .filter("size(_cast) > 0")
    )
    seen = spread_join(durable_table(parts), cast, "_conv", "_n").select(
        "_id", "_part", "_turns", F.explode("_cast").alias("perspective")
    )

    # First the rendered turns, then their running ends, then the stretches of the assistant's words.
    rendered = seen.withColumn(
        "_said",
        F.transform(
            "_turns",
            lambda t: F.struct(
                _open(t["_speaker"], F.col("perspective")).alias("head"),
                F.concat(t["_text"], F.lit(_END)).alias("body"),
                (t["_speaker"] == F.col("perspective")).alias("own"),
            ),
        ),
    )
    none = F.array().cast("array<struct<start:int,length:int>>")
    step = F.aggregate(
        "_said",
        F.struct(F.lit(0).alias("at"), none.alias("mask")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("at"),
            F.when(
                t["own"],
                F.concat(
                    acc["mask"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(t["head"])).alias("start"),
                            F.length(t["body"]).alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )
    return rendered.select(
        F.col("_id").alias(conv_col),
        "perspective",
        F.col("_part").alias("part_no"),
        F.size("_turns").alias("n_turns"),
        F.concat_ws("", F.flatten(F.transform("_said", lambda t: F.array(t["head"], t["body"])))).alias("text"),
        step["mask"].alias("mask"),
    )
