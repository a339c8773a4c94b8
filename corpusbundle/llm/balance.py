"""Mixing sources to target weights by entropy balancing.

Of all document rates whose words add up to the target of every source, entropy balancing
takes those nearest to one in relative entropy. They are exponential in the dual variables
of the targets: a document of x times its source's mean size has the rate exp(lambda x), and no
more than the most copies allowed. The dual is convex; Newton steps, kept inside a bracket,
solve it for all sources at once, each step one aggregation over the histogram
(source, size, documents). All sums are decimals, so their order does not matter and reruns agree.

Rates become whole copies size by size, from the greatest size down; what rounding leaves over
in words goes to the next smaller size. So a source misses its target by about the words of
its smallest documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbundle.llm.common import durable_table, text_of
from corpusbundle.operators.lookups import lookup_join
from corpusbundle.operators.ordering import with_positions

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)

#: Copies of a document, at most.
MOST = 3

#: Share of a target by which the rates may miss it before they are rounded.
TOLERANCE = 1e-9

#: Newton steps, at most; a step that leaves its bracket halves it, so this many always suffice.
STEPS = 100

_KEY = "_source"


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks and 0x09 to 0x0D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets_of(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to rows (_source, _words, _docs, _squares), one for each source.

    The sources share all words by weight. A share above ``most`` times the source's words stops
    there, and the excess goes to the others by weight, until none is above.
    """
    ranked = with_positions(sources.withColumn("_null", F.col(_KEY).isNull()), [], ["_null", _KEY]).drop("_null")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    current = durable_table(ranked.withColumns({"_weight": weight.cast("long"), "_full": F.lit(False)}))
    total = current.agg(F.sum("_words")).first()[0] or 0
    while True:
        full, open_weight, n_full = current.agg(
            F.sum(F.when(F.col("_full"), F.col("_words")).otherwise(0)),
            F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))),
            F.count(F.when(F.col("_full"), 1)),
        ).first()
        left, open_weight = total - most * (full or 0), open_weight or 1
        wide = lambda value: F.lit(str(value)).cast("decimal(20,0)")
        above = F.col("_weight").cast("decimal(10,0)") * wide(left) > (
            (F.col("_words") * most).cast("decimal(20,0)") * wide(open_weight).cast("decimal(15,0)")
        )
        following = durable_table(current.withColumn("_full", F.col("_full") | above))
        if following.filter("_full").count() == n_full:
            share = F.col("_weight").cast("double") * F.lit(float(left)) / F.lit(float(open_weight))
            cap = (F.col("_words") * most).cast("double")
            return current.select(_KEY, "_words", "_docs", "_squares", F.when(F.col("_full"), cap).otherwise(share).alias("target"))
        current = following


def _rate(dual: str, x: Column, most: int) -> Column:
    # The exponent is bounded, so the exponential is too.
    return F.least(F.lit(float(most)), F.exp(F.least(F.col(dual) * x, F.lit(700.0))))


def solve(histogram: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(_source, _mean, _dual): the dual variable of each source whose target lies between 0 and all copies.

    ``histogram`` has rows (_source, _size, _n) with sizes above 0, ``sources`` (_source, _words,
    _docs, _squares, target). The words at rate exp(dual x), x the size by the mean, grow with the
    dual; where every document is at the most copies or a target is 0 there is nothing to solve.
    The first value would be right if all words were in documents of their mean size.
    """
    mean = F.col("_words") / F.col("_docs")
    state = durable_table(
        sources.filter((F.col("target") > 0) & (F.col("target") < F.col("_words") * most)).select(
            _KEY, "target",
            mean.alias("_mean"),
            (F.log(F.col("target") / F.col("_words")) * F.col("_words") * mean / F.col("_squares")).alias("_dual"),
            F.lit(None).cast("double").alias("_low"),
            F.lit(None).cast("double").alias("_high"),
            F.lit(False).alias("_done"),
        )
    )
    for _ in range(STEPS):
        open_ = state.filter(~F.col("_done"))
        if open_.isEmpty():
            break
        met = histogram.join(open_.select(_KEY, "_mean", "_dual"), _KEY)
        x = F.col("_size") / F.col("_mean")
        rate = _rate("_dual", x, most)
        words = F.col("_n") * F.col("_size")
        slope = F.when(rate < most, words * x * rate).otherwise(0.0)
        exact = "decimal(38,9)"
        sums = met.groupBy(_KEY).agg(
            F.sum((words * rate).cast(exact)).cast("double").alias("_f"),
            F.sum(slope.cast(exact)).cast("double").alias("_g"),
        )
        miss = F.col("_f") - F.col("target")
        low = F.when(miss < 0, F.col("_dual")).otherwise(F.col("_low"))
        high = F.when(miss >= 0, F.col("_dual")).otherwise(F.col("_high"))
        newton = F.col("_dual") - miss / F.col("_g")
        inside = (F.col("_g") > 0) & (F.col("_l").isNull() | (newton > F.col("_l"))) & (F.col("_h").isNull() | (newton < F.col("_h")))
        # Without both ends of a bracket the step grows until it has them.
        apart = F.greatest(F.abs("_dual"), F.lit(1.0))
        halved = F.when(F.col("_l").isNull(), F.col("_h") - apart).when(F.col("_h").isNull(), F.col("_l") + apart)
        halved = halved.otherwise((F.col("_l") + F.col("_h")) / 2)
        done = (F.abs(miss) <= F.col("target") * TOLERANCE) | (
            F.col("_h") - F.col("_l") <= F.lit(1e-15) * F.greatest(F.abs("_l"), F.abs("_h"))
        )
        stepped = (
            open_.join(sums, _KEY, "left")
            .withColumns({"_l": low, "_h": high})
            .withColumn("_stop", F.coalesce(done, F.lit(False)))
            .withColumn("_next", F.when(F.col("_stop"), F.col("_dual")).when(inside, newton).otherwise(halved))
            .select(
                _KEY, "target", "_mean", F.col("_next").alias("_dual"), F.col("_l").alias("_low"),
                F.col("_h").alias("_high"), F.col("_stop").alias("_done"),
            )
        )
        state = durable_table(stepped.unionByName(state.filter("_done")))
    return state.select(_KEY, "_mean", "_dual")


def _copies(histogram: DataFrame, sources: DataFrame, duals: DataFrame, most: int) -> DataFrame:
    """(_source, _size, _copies, _n): copies of all documents of one size together.

    A source's sizes are taken from the greatest down, as they pass. A source of W words has at
    most sqrt(2 W) of them, whatever number of documents it has, and a task holds one.
    """
    rated = histogram.join(sources.select(_KEY, "_words", "target"), _KEY).join(duals, _KEY, "left")
    fixed = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)
    solved = _rate("_dual", F.col("_size") / F.col("_mean"), most)
    rate = F.when(F.col("_dual").isNull(), fixed).otherwise(solved)
    kind = histogram.schema[_KEY].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, 0.0
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in range(4)]
            for source, size, n, rate in zip(*columns):
                if source != now:
                    now, left = source, 0.0
                wanted = n * rate + left / size
                copies = min(max(math.floor(wanted + 0.5), 0), most * n)
                left = (wanted - copies) * size
                found.append(copies)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.int64()), batch.column(3)], [_KEY, "_size", "_n", "_copies", "rate"]
            )

    ready = rated.select(_KEY, "_size", "_n", rate.alias("_rate")).repartition(_KEY).sortWithinPartitions(_KEY, F.desc("_size"))
    return durable_table(ready.mapInArrow(task, f"{_KEY} {kind}, _size long, _n long, _copies long, rate double"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, rate, copies, taken.

    ``size`` counts words, ``source_size`` those of the row's source and ``target`` the words the
    mix is to take from it; ``rate`` is the entropy-balanced number of copies before rounding and
    ``taken`` is copies times size. Documents of one source and size have one rate; which of
    them get the copy that is left over is settled by a hash of the id. The sources are in
    order of their names (code points), null as one more source at the end.

    A null text has no words. Documents without words take none and have the rate 1. Repeated
    rows have a row each; other columns are not read. An empty table gives no rows.
    """
    given = docs.select(
        F.col(id_col).alias("_id"),
        # Null is a source too: a name is marked, so that no name is empty.
        F.concat(F.lit("="), F.col(source_col).cast("string")).alias("_name"),
        word_count(text_of(text_col)).alias("_size"),
    )
    rows = durable_table(
        given.select("_id", F.coalesce("_name", F.lit("")).alias("_key"), "_size", F.monotonically_increasing_id().alias("_row"))
    )
    cells = rows.groupBy("_key", "_size").agg(F.count(F.lit(1)).alias("_n"))
    cells = durable_table(cells.withColumn(_KEY, F.col("_key")).drop("_key"))
    # The order of sources has null last; everywhere else it is a key like others.
    size = F.col("_size")
    sums = cells.groupBy(F.nullif(F.col(_KEY), F.lit("")).alias(_KEY)).agg(
        F.sum(F.col("_n") * size).alias("_words"),
        F.sum(F.when(size > 0, F.col("_n")).otherwise(0)).alias("_docs"),
        F.sum((F.col("_n") * size).cast("decimal(19,0)") * size).cast("double").alias("_squares"),
    )
    sources = durable_table(targets_of(sums, weights, most).withColumn(_KEY, F.coalesce(_KEY, F.lit(""))))
    histogram = cells.filter("_size > 0")
    duals = solve(histogram, sources, most)
    copies = _copies(histogram, sources, duals, most)

    # Where copies do not divide evenly, documents are numbered in the order of a hash.
    even = copies.withColumns({"_each": F.expr("_copies div _n"), "_over": F.expr("_copies % _n")})
    rules = even.drop("_n", "_copies").join(sources.select(_KEY, "_words", "target"), _KEY, "right")
    empty = sources.select(_KEY, F.lit(0).cast("long").alias("_size"), "_words", "target")
    cell_rules = rules.filter("_size is not null").unionByName(empty, allowMissingColumns=True)
    found = durable_table(lookup_join(rows.withColumnRenamed("_key", _KEY), cell_rules, [_KEY, "_size"], ["_row"]))
    over = found.filter("_over > 0").withColumn("_hash", F.xxhash64("_id"))
    placed = with_positions(over, [_KEY, "_size"], ["_hash", "_id", "_row"])
    extra = (F.col("ordinal") < F.col("_over")).cast("long")
    all_rows = placed.withColumn("_extra", extra).drop("ordinal", "_hash").unionByName(
        found.filter("_over is null or _over = 0").withColumn("_extra", F.lit(0).cast("long"))
    )
    # A document without words is taken once, which takes no words.
    copies_of = F.coalesce(F.col("_each") + F.col("_extra"), F.lit(1).cast("long"))
    return all_rows.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        "target",
        F.coalesce("rate", F.lit(1.0)).alias("rate"),
        copies_of.alias("copies"),
        (copies_of * F.col("_size")).alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with their columns and ``copy_no`` from 0.

    Ids must tell the rows apart; a row with a null id is left out.
    """
    copies = mix(docs, id_col=id_col, **options).select(F.col(id_col).alias("_mix_id"), F.col("copies").cast("int").alias("_mix_n"))
    met = docs.join(copies.filter("_mix_n > 0"), docs[id_col] == F.col("_mix_id"))
    numbered = met.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)))
    return numbered.select(*(docs[c] for c in docs.columns), "copy_no")
