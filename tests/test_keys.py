"""What moves when copies of keys are merged."""

import pytest
from pyspark.sql import functions as F

from corpusbundle.operators.dedupe import keep_last, keep_last_wide
from corpusbundle.operators.keys import with_members, with_repeated

DISTINCT, COPIED = 30_000, 40


def rows(spark):
    """Many distinct keys, forty that occur five times each, and null keys."""
    once = spark.range(DISTINCT).select(F.concat(F.lit("u"), "id").alias("k"), F.col("id").alias("o"))
    copies = spark.range(COPIED * 5).select(F.concat(F.lit("c"), F.col("id") % COPIED).alias("k"), F.col("id").alias("o"))
    return once.unionByName(copies)


@pytest.mark.parametrize("bounds, most", [({}, 0), ({"exact": 0}, DISTINCT // 10), ({"exact": 0, "most_bits": 12}, DISTINCT // 10)])
def test_rows_of_unrepeated_keys_are_not_shuffled(spark, bounds, most):
    """The filter has 640 slots for the repeated keys, while there are 30,000 distinct ones."""
    marked = with_repeated(rows(spark), F.xxhash64("k"), "_again", **bounds)
    found = marked.groupBy(F.col("k").startswith("c").alias("copy"), "_again").count().collect()
    count = {(r.copy, r._again): r["count"] for r in found}
    assert count[True, True] == COPIED * 5 and (True, False) not in count
    assert count.get((False, True), 0) <= most
    assert count[False, False] >= DISTINCT - most


@pytest.mark.parametrize("bounds", [{}, {"exact": 0}, {"exact": 0, "most_bits": 2}])
def test_every_way_keeps_the_same_rows(spark, bounds):
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "k string, o long")
    table = rows(spark).unionByName(nulls).withColumn("w", F.repeat(F.lit("x"), 10))
    got = keep_last_wide(table, ["k"], ["o"], **bounds)
    want = keep_last(table, ["k"], ["o"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_beyond_the_bounds_there_is_no_filter(spark):
    assert with_repeated(rows(spark), F.xxhash64("k"), "_again", exact=0, most_bits=9) is None


def test_nothing_repeated_moves_nothing(spark):
    table = spark.range(1000).withColumnRenamed("id", "k")
    assert with_repeated(table, F.xxhash64("k"), "_again").filter("_again").count() == 0
    assert with_repeated(table.limit(0), F.xxhash64("k"), "_again").count() == 0


@pytest.mark.parametrize("bounds, most", [({}, 0), ({"exact": 0}, DISTINCT // 10)])
def test_members_are_found_among_many_other_keys(spark, bounds, most):
    members = spark.range(COPIED).select(F.xxhash64(F.concat(F.lit("c"), "id")).alias("_key"))
    marked = with_members(rows(spark), F.xxhash64("k"), members, "_in", **bounds)
    count = {(r.copy, r._in): r["count"] for r in marked.groupBy(F.col("k").startswith("c").alias("copy"), "_in").count().collect()}
    assert count[True, True] == COPIED * 5 and (True, False) not in count
    assert count.get((False, True), 0) <= most
    assert with_members(rows(spark), F.xxhash64("k"), members, "_in", exact=0, most_bits=9) is None
    nulls = spark.createDataFrame([(None,)], "k string").withColumn("h", F.lit(None).cast("long"))
    assert with_members(nulls, F.col("h"), members, "_in", **bounds).filter("_in").count() == 0
