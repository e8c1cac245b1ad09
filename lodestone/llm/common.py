"""What several operators share: sizes, checkpoints, connected groups and byte hashing."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text whose A-Z were lowered: runs of what is neither ASCII punctuation, space nor control.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that goes to Python. Texts are long: ten thousand of them would take tens of megabytes a task on each side.
ARROW_ROWS = 1024


def short_batches(df: DataFrame) -> DataFrame:
    """df, after the session's limit of rows in a batch for Python has been lowered to ARROW_ROWS if it was above."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else. Texts that are all ASCII take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    found = F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.array_remove(found, "")


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes that df reads, by the optimizer's estimate; counted where there is none."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate > 1 << 55:
        estimate = int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)
    return estimate


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, shared by the cluster. Where it is unset, as in tests, a local master gets one of its own; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Spark's setting under which the shuffle files of a query go when it has ended, on all executors.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: the lineage is cut, and a reader takes only the columns that it needs.
    Shuffle files of the writing go at once, as nothing reads them again. The table goes when the driver ends, or with released()."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    for made in _within()[-1:]:
        made.append(out)
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables of stored() that no plan still to run reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_local = threading.local()


def _within() -> list[list[DataFrame]]:
    """For each settled() that runs in this thread the tables that stored() has made since."""
    if not hasattr(_local, "within"):
        _local.within = []
    return _local.within


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, as a table of stored(). The other tables that were stored for it go."""
    within = _within()
    within.append([])
    try:
        out = stored(make())
    finally:
        made = within.pop()
    released(*(x for x in made if x is not out))
    for outer in within[-1:]:
        outer.append(out)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """Connected groups of an undirected graph by alternating large-star and small-star steps.

    edges: columns a and b of one orderable type. Returns node and component (its smallest node), for
    nodes with an edge. Each round is a few shuffles of the remaining edges, and the number of rounds grows
    with the logarithm of the longest path. A node with very many edges isn't gathered: its smallest
    neighbour comes from a partial aggregate and the join is one that the adaptive planner can split.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        last, e = e, stored(star.where("u <> v").distinct())
        released(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(now)


def merged(groups: DataFrame, more: DataFrame) -> DataFrame:
    """Groups (node, component) after more edges (a, b) between nodes that may lie in them."""
    if more.isEmpty():
        return groups
    of = groups.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    ends = more.join(of, "a", "left").join(of.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    joined = connected(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    alone = joined.select(F.col("node"), F.col("node").alias("component")).join(groups, "node", "left_anti")
    far = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    # A component is named by its smallest node, which has a row of its own in groups or stands alone.
    return groups.unionByName(alone).join(far, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


#: Rows up to which small() broadcasts.
BROADCAST = 500_000


def small(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """df cut off from its lineage, and broadcast if a count finds at most so many rows; otherwise joins shuffle it."""
    return few(stored(df), rows)


def few(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """A table of stored(), broadcast if a count finds at most so many rows; otherwise joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# Hashing of bytes, vectorised.
_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if _powers["n"] < n:
        size = max(n, 2 * _powers["n"], 1 << 16)
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: bytes | memoryview) -> np.ndarray:
    """Prefix sums h with h[j] - h[i], times the inverse power i, hashing bytes i to j."""
    b = np.frombuffer(data, np.uint8)
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * powers(len(b))[0], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to each end."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start])


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_hashes(text: str | None, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order, as words() splits it but for capitals beyond A-Z, which are lowered too.

    For each number in prefixes the hashes of the first so many bytes of every longer word follow.
    """
    data = (text or "").lower().encode("utf-8", "replace")
    if not data:
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end, h = edges[::2], edges[1::2], prefix_hash(data)
    parts = [span_hash(h, start, end)]
    for n in prefixes:
        longer = start[end - start > n]
        parts.append(span_hash(h, longer, longer + n))
    return np.concatenate(parts) if prefixes else parts[0]
