"""Token counts through a digest cache.

The cache is a table (digest, version, n_tokens): SHA-256 of the normalised text,
and of the tokenizer's file and library version. A run looks its digests up, encodes
one row of each digest that is missing, and appends what it found. Appending twice,
as after a failed run, does no harm: readers take one row per digest. A text that has
no copy and is not stored is encoded where it is read; only others are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusbundle.llm.common import bounded_batches, durable_table, spread_join, text_of
from corpusbundle.llm.vocabulary import Vocabulary, version_of
from corpusbundle.operators.keys import EXACT_KEYS, MOST_BITS, with_members

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def read_cache(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version; empty if nothing is stored yet."""
    spark = docs.sparkSession
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    same = stored.filter(F.col("version") == version)
    return same.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens.

    A null text counts as empty. ``normalise`` is the text that is digested and encoded;
    by default it is the text itself, since any change could change its tokens. n_bytes
    is of the text as given. Rows with one text share one encoding, repeated rows and
    null ids have a row each, other columns are not read. An empty table gives no rows
    and appends none. Special strings inside a text are read as the library reads them.
    """
    bounded_batches(docs)
    version = version_of(tokenizer)
    given = text_of(text_col)
    text = given if normalise is None else text_of(normalise)
    source = docs.select(
        F.col(id_col).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        F.octet_length(given).cast("long").alias("n_bytes"),
        text.alias("_text"),
    ).withColumn("digest", F.unhex(F.sha2("_text", 256)))
    rows = durable_table(source.select("_id", "_row", "n_bytes", "digest"))
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_rows"))
    stored = read_cache(docs, cache, version).withColumnRenamed("n_tokens", "_stored")
    groups = durable_table(groups.join(stored, "digest", "left"))
    found = _encoded(docs.select(text.alias("_text")), groups, tokenizer, version)
    found.write.mode("append").parquet(cache)
    counted = durable_table(groups.drop("_stored").join(read_cache(docs, cache, version), "digest"))
    return spread_join(rows, counted, "digest", "_rows").select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens"
    )


def _keys(digests: DataFrame) -> DataFrame:
    return durable_table(digests.select(F.xxhash64("digest").alias("_key")).distinct())


def _encoded(
    texts: DataFrame,
    groups: DataFrame,
    tokenizer: str,
    version: str,
    exact: int = EXACT_KEYS,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """(digest, version, n_tokens) of the digests that are not stored, each encoded once.

    ``groups`` has (digest, _rows, _stored) of all texts. Texts outside a filter of all
    repeated or stored digests are encoded in place. Of the others those that are missing
    meet by digest; the partial aggregate keeps one text of each digest in a task, so
    copies meet as one row per task at most. A filter too large for its bounds passes all.
    """
    vocabulary = Vocabulary(tokenizer)
    key = F.xxhash64("digest")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            n = encoder.counts(batch.column(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["digest", "n_tokens"])

    digested = texts.withColumn("digest", F.unhex(F.sha2("_text", 256)))
    apart = _keys(groups.filter("_rows > 1 or _stored is not null"))
    marked = with_members(digested, key, apart, "_apart", exact, most_bits)
    if marked is None:
        marked = digested.withColumn("_apart", F.lit(True))
    # What has to move: texts with copies, and single ones that the filter takes for such.
    missing = groups.filter("_stored is null")
    lone = with_members(missing, key, apart, "_apart", exact, most_bits)
    missing = missing if lone is None else lone.filter("_apart")
    missing = durable_table(missing.select("digest"))
    moved = marked.filter("_apart")
    wanted = with_members(moved, key, _keys(missing), "_wanted", exact, most_bits)
    moved = moved if wanted is None else wanted.filter("_wanted")
    one = moved.groupBy("digest").agg(F.first("_text").alias("_text")).join(missing, "digest", "left_semi")
    needed = marked.filter("not _apart").select("digest", "_text").unionByName(one.select("digest", "_text"))
    counted = needed.select("digest", F.col("_text").cast("binary")).mapInArrow(
        count, "digest binary, n_tokens long"
    )
    return counted.select("digest", F.lit(version).alias("version"), "n_tokens")
