"""File trees as tables: listing first, contents only for the files that are kept."""

from __future__ import annotations

import codecs
import itertools
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusbundle.functions.globs import _any_of, _each, glob_regex
from corpusbundle.operators.durable import durable
from corpusbundle.schemas import LISTING_SCHEMA

LISTING_BATCH = 10_000
# Larger files are read as several rows.
CHUNK_BYTES = 32 * 1024 * 1024

# Entries of a directory that one task looks at; the names of a larger one are dealt out in runs of as many.
RANGE_ENTRIES = 10_000
# Subtrees that the planner makes for each task, so that a lopsided tree is spread too.
SUBTREES = 8


@dataclass
class Subtree(InputPartition):
    """Directories below ``rel_dir`` whose first name has the hash ``share`` of ``shares``; or only itself."""

    rel_dir: str
    descend: bool
    share: int = 0
    shares: int = 1


def _hash(name: str) -> int:
    return zlib.crc32(os.fsencode(name))


class DirectoryReader(DataSourceReader):
    """Walks subtrees; only names are read, nothing is held but the directories still to enter."""

    def __init__(self, options):
        self.root = options["path"]
        self.prune_hidden = options["prunehidden"] == "true"
        self.covered = options["covered"]
        self.wanted = int(options["wanted"])

    def _entered(self, rel_dir: str):
        """(number of entries, directories to enter) of one directory, links not followed."""
        covered = re.compile(self.covered)
        n, inside = 0, []
        with os.scandir(os.path.join(self.root, rel_dir)) as found:
            for entry in found:
                n += 1
                if not entry.is_dir(follow_symlinks=False) or (self.prune_hidden and entry.name.startswith(".")):
                    continue
                rel = f"{rel_dir}/{entry.name}" if rel_dir else entry.name
                # A covered directory is one below which any name at all would be ignored.
                if not covered.match(rel + "/"):
                    inside.append(rel)
        return n, inside

    def partitions(self):
        """Directories near the root one by one, until there are enough subtrees for all tasks.

        The planner never goes through a whole tree: it lists level by level, and a
        directory that may hold very many others is dealt out by name.
        """
        plan, level = [], [""]
        while level and len(level) < self.wanted:
            deeper = []
            for at, rel_dir in enumerate(level):
                if len(deeper) >= self.wanted:
                    plan.extend(Subtree(d, True) for d in level[at:])
                    break
                few = self._few(rel_dir)
                if few is None:
                    plan.extend(Subtree(rel_dir, True, k, self.wanted) for k in range(self.wanted))
                else:
                    plan.append(Subtree(rel_dir, False))
                    deeper.extend(few)
            level = deeper
        return plan + [Subtree(d, True) for d in level]

    def _few(self, rel_dir: str) -> list[str] | None:
        """The directories to enter, or None if there are too many entries to plan with."""
        with os.scandir(os.path.join(self.root, rel_dir)) as found:
            if sum(1 for _ in itertools.islice(found, RANGE_ENTRIES + 1)) > RANGE_ENTRIES:
                return None
        return self._entered(rel_dir)[1]

    def read(self, partition: Subtree):
        n, inside = self._entered(partition.rel_dir)
        if partition.share == 0:
            yield partition.rel_dir, n
        if not partition.descend:
            return
        left = [d for d in inside if _hash(os.path.basename(d)) % partition.shares == partition.share]
        while left:
            rel_dir = left.pop()
            n, inside = self._entered(rel_dir)
            left.extend(inside)
            yield rel_dir, n


class DirectorySource(DataSource):
    """The directories of a tree as rows (rel_dir, n_entries): ``spark.read.format("tree_directories")``."""

    @classmethod
    def name(cls) -> str:
        return "tree_directories"

    def schema(self) -> str:
        return "rel_dir string, n_entries long"

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options)


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Rows (rel_path, size, mtime in microseconds) as frames of bounded length."""
    rows = iter(rows)
    while held := list(itertools.islice(rows, LISTING_BATCH)):
        out = pd.DataFrame(held, columns=["rel_path", "size", "mtime"])
        out["mtime"] = pd.to_datetime(out["mtime"], unit="us", utc=True)
        yield out


def _row(rel_dir: str, name: str, info: os.stat_result) -> tuple:
    return f"{rel_dir}/{name}" if rel_dir else name, info.st_size, info.st_mtime_ns // 1000


def _list_entries(root: str):
    """(rel_path, size, mtime) of the entries of directories that are no directories."""

    def entries(rel_dir: str) -> Iterator[tuple]:
        with os.scandir(os.path.join(root, rel_dir)) as found:
            for entry in found:
                if not entry.is_dir(follow_symlinks=False):
                    yield _row(rel_dir, entry.name, entry.stat(follow_symlinks=False))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(row for batch in batches for d in batch["rel_dir"] for row in entries(d))

    return run


def _list_names(root: str, range_entries: int):
    """(rel_dir, share, names) of directories: the names of what is no directory, in runs, each directory read once."""

    def shares(rel_dir: str) -> Iterator[tuple]:
        with os.scandir(os.path.join(root, rel_dir)) as found:
            names = (os.fsencode(e.name) for e in found if not e.is_dir(follow_symlinks=False))
            for share in itertools.count():
                if not (run := list(itertools.islice(names, range_entries))):
                    return
                yield rel_dir, share, run

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for d in batch["rel_dir"] for row in shares(d))
        while held := list(itertools.islice(rows, max(1, LISTING_BATCH // range_entries))):
            yield pd.DataFrame(held, columns=["rel_dir", "share", "names"])

    return run


def _look_at(root: str):
    """(rel_path, size, mtime) of names; one that is gone meanwhile is left out."""

    def entries(rel_dir: str, names: Iterable[bytes]) -> Iterator[tuple]:
        for name in map(os.fsdecode, names):
            try:
                info = os.lstat(os.path.join(root, rel_dir, name))
            except FileNotFoundError:
                continue
            yield _row(rel_dir, name, info)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(row for batch in batches for x in zip(batch["rel_dir"], batch["names"]) for row in entries(*x))

    return run


def scan_directories(
    spark: SparkSession, root: str, prune_hidden: bool = True, skip_under: Iterable[str] = (), tasks: int | None = None
) -> DataFrame:
    """(rel_dir, n_entries) of ``root`` and of every directory below it that is entered (see ``scan_tree``)."""
    covered = _any_of(_each([p for p in skip_under if p.endswith("/**")], glob_regex))
    spark.dataSource.register(DirectorySource)
    return spark.read.format("tree_directories").options(
        prunehidden=str(prune_hidden).lower(),
        covered=covered.replace(r"\z", r"\Z"),
        wanted=str(SUBTREES * (tasks or spark.sparkContext.defaultParallelism)),
    ).load(os.path.abspath(root))


def scan_tree(
    spark: SparkSession,
    root: str,
    prune_hidden: bool = True,
    skip_under: Iterable[str] = (),
    tasks: int | None = None,
    range_entries: int = RANGE_ENTRIES,
) -> DataFrame:
    """Every file below ``root`` as (rel_path, size, mtime).

    Directories are found first, by names alone: a data source whose partitions are subtrees,
    or shares of a directory that holds very many. They are checkpointed, then dealt evenly
    to all tasks, which ask for size and time; of a directory of more than ``range_entries``
    names one task reads the names once more, and runs of that many names are dealt evenly. So
    neither a lopsided tree nor one flat directory is left to one task, and no directory is
    read more often the more names it has. Dot and underscore names, which Spark's own file sources drop,
    are listed; with ``prune_hidden`` directories whose name starts with a dot are not
    entered (not even the root). ``skip_under`` takes ignore patterns ending in ``/**``,
    whose directories need not be entered. A directory that cannot be listed fails the
    scan. ``root`` must be visible to the driver and to every executor.
    """
    root = os.path.abspath(root)
    if prune_hidden and os.path.basename(root).startswith("."):
        return spark.createDataFrame([], LISTING_SCHEMA)
    found = durable(scan_directories(spark, root, prune_hidden, skip_under, tasks)).filter("n_entries > 0")
    tasks = tasks or spark.sparkContext.defaultParallelism
    wide = F.col("n_entries") > range_entries
    few = found.filter(~wide).select("rel_dir").repartition(tasks, "rel_dir")
    many = found.filter(wide).select("rel_dir").repartition(tasks, "rel_dir")
    names = many.mapInPandas(_list_names(root, range_entries), "rel_dir string, share long, names array<binary>")
    looked = names.repartition(tasks, "rel_dir", "share").mapInPandas(_look_at(root), LISTING_SCHEMA)
    return durable(few.mapInPandas(_list_entries(root), LISTING_SCHEMA).unionByName(looked))


def scan_binary_tree(spark: SparkSession, root: str) -> DataFrame:
    """Listing through Spark's ``binaryFile`` source, for any file system Spark reads.

    Faster, but names that start with a dot or an underscore are left out by Spark, and
    a file must fit into one value. ``content`` is read only if a later step selects it;
    bytes that are not UTF-8 are replaced, as by ``read_content``.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(conf).makeQualified(path).toUri().getPath().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Scheme and authority are written in more than one way, the path below them is not.
    own = F.regexp_replace(F.col("path"), r"\A[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
    outside = F.raise_error(F.concat(F.lit("not below the root: "), "path"))
    rel = F.when(own.startswith(base), F.substring(own, len(base) + 1, 1 << 30)).otherwise(outside)
    return found.select(
        rel.alias("rel_path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        _replaced_utf8(F.col("content")).alias("content"),
    )


@F.pandas_udf(T.StringType())
def _replaced_utf8(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")


def _chunks(path: str, chunk_bytes: int, whole_lines: bool) -> Iterator[tuple]:
    """(chunk_no, is_last, text, error); a character cut in two goes to the later chunk."""

    def read(f) -> bytes:
        data = f.read(chunk_bytes)
        return data + f.readline() if whole_lines and data else data

    try:
        f = open(path, "rb")
    except OSError as e:
        yield 0, True, None, _reason(e)
        return
    with f:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        number, data = 0, read(f)
        while True:
            following = read(f)
            yield number, not following, decoder.decode(data, final=not following), None
            if not following:
                return
            number, data = number + 1, following


def _reason(e: OSError) -> str:
    return f"{type(e).__name__}: {e.strerror}"


def _read_files(root: str, columns: list[str], chunk_bytes: int, whole_lines: bool):
    names = ["chunk_no", "is_last", "content", "read_error"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple] = []
            held = 0

            def out() -> pd.DataFrame:
                frame = batch.iloc[rows].reset_index(drop=True)[columns]
                return pd.concat([frame, pd.DataFrame(found, columns=names)], axis=1)

            for i, rel_path in enumerate(batch["rel_path"]):
                for chunk in _chunks(os.path.join(root, rel_path), chunk_bytes, whole_lines):
                    rows.append(i)
                    found.append(chunk)
                    held += len(chunk[2] or "")
                    if held >= chunk_bytes:
                        yield out()
                        rows, found, held = [], [], 0
            if rows:
                yield out()

    return run


def read_content(
    listing: DataFrame, root: str, chunk_bytes: int = CHUNK_BYTES, whole_lines: bool = False
) -> DataFrame:
    """Add ``chunk_no``, ``is_last``, ``content`` and ``read_error`` to an already filtered listing.

    A file of up to ``chunk_bytes`` is one row, a larger one as many rows as it takes, one
    after the other; with ``whole_lines`` a chunk goes on to the end of its line. A file
    that cannot be opened keeps one row with a null content. Row order within a partition
    is kept, and no content crosses a shuffle.
    """
    added = [
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("is_last", T.BooleanType()),
        T.StructField("content", T.StringType()),
        T.StructField("read_error", T.StringType()),
    ]
    schema = T.StructType([*listing.schema.fields, *added])
    job = _read_files(os.path.abspath(root), listing.columns, chunk_bytes, whole_lines)
    return listing.mapInPandas(job, schema)


def unreadable(listing: DataFrame, root: str) -> DataFrame:
    """(rel_path, read_error) of the listed files that cannot be opened."""
    base = os.path.abspath(root)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for rel_path in batch["rel_path"]:
                try:
                    open(os.path.join(base, rel_path), "rb").close()
                except OSError as e:
                    found.append((rel_path, _reason(e)))
            yield pd.DataFrame(found, columns=["rel_path", "read_error"], dtype=object)

    return listing.select("rel_path").mapInPandas(run, "rel_path string, read_error string")


# Reading by ranges.

#: Bytes of a character before and after which a cut between two ranges may move.
_REACH = 3


def _unit(data: bytes) -> int:
    """Length of the character, or of the broken piece of one, that begins the data."""
    lead = data[0]
    n = 1 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF5 else 1
    try:
        data[:n].decode("utf-8")
    except UnicodeDecodeError as e:
        return e.end - e.start
    return n


def _cut(around: bytes, at: int) -> int:
    """Where the first character begins that is not begun before ``at``; both count in ``around``.

    Only the last byte before the cut that is no continuation can have begun a character there.
    """
    for j in range(at - 1, max(at - _REACH, 0) - 1, -1):
        if around[j] & 0xC0 != 0x80:
            return max(at, j + _unit(around[j : j + 4]))
    return at


def _read_range(path: str, start: int, end: int) -> str:
    """The characters that begin in bytes start to end - 1, those a whole reading would give."""
    with open(path, "rb") as f:
        before = min(start, _REACH)
        f.seek(start - before)
        data = f.read(before + end - start + _REACH)
    first, last = _cut(data, before), _cut(data, min(before + end - start, len(data)))
    return data[first:last].decode("utf-8", "replace")


def _read_ranges(root: str, columns: list[str]):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple] = []
            held = 0

            def out() -> pd.DataFrame:
                frame = batch.iloc[rows].reset_index(drop=True)[columns]
                return pd.concat([frame, pd.DataFrame(found, columns=["content", "read_error"], dtype=object)], axis=1)

            for i, (rel_path, start, end) in enumerate(zip(batch["rel_path"], batch["_start"], batch["_end"])):
                try:
                    found.append((_read_range(os.path.join(root, rel_path), start, end), None))
                except OSError as e:
                    found.append((None, _reason(e)))
                rows.append(i)
                held += end - start
                if held >= CHUNK_BYTES:
                    yield out()
                    rows, found, held = [], [], 0
            if rows:
                yield out()

    return run


def split_ranges(listing: DataFrame, range_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each range of a listed file: adds ``range_no`` and ``is_last``, ``size`` becomes the range's.

    An empty file has one empty range.
    """
    last = F.expr(f"greatest(size - 1, 0) div {int(range_bytes)}")
    each = listing.withColumn("_last", last).withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    start = F.col("range_no") * range_bytes
    return each.select(
        *(c for c in listing.columns if c != "size"),
        F.least(F.col("size") - start, F.lit(int(range_bytes)).cast("long")).alias("size"),
        "range_no",
        start.alias("_start"),
        (F.col("range_no") == F.col("_last")).alias("is_last"),
    )


def read_ranges(ranges: DataFrame, root: str) -> DataFrame:
    """Add ``content`` and ``read_error`` to rows of ``split_ranges``, wherever each row is.

    A range owns the characters that begin in it, so a task reads no more than the range and
    three bytes on each side, and the ranges of a file in order are its text, broken
    UTF-8 replaced as in one reading. The size that was listed decides the ranges: what is
    added to a file later is not read. An error of opening or reading is the row's own.
    """
    source = ranges.withColumn("_end", F.col("_start") + F.col("size"))
    kept = [c for c in ranges.columns if c != "_start"]
    added = [T.StructField("content", T.StringType()), T.StructField("read_error", T.StringType())]
    schema = T.StructType([*(ranges.schema[c] for c in kept), *added])
    return source.mapInPandas(_read_ranges(os.path.abspath(root), kept), schema)
