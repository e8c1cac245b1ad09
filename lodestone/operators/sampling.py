"""Samples and splits that keep the shares of classes exactly, and give the same rows whatever the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task is to rank at once.
BUCKET_ROWS = 1 << 16


def chance(key: str, seed: int = 0) -> Column:
    """The order of rows by chance: the md5 of key and seed, which other engines have too."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def drawn(df: DataFrame, key: str, strata: Sequence[str], seed: int = 0) -> DataFrame:
    """df with _rank, from 1, of each row in its stratum by chance (the key breaks ties), and _rows, the rows of the stratum.

    Null is a stratum like others. Ranks are counts of ranges of the hash plus ranks within a range, so that no task orders a whole class.
    """
    buckets = max(1, df.count() // BUCKET_ROWS)
    head = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double")
    rows = df.withColumn("_h", chance(key, seed)).withColumns({"_s": F.struct(*(F.col(c) for c in strata)) if strata else F.struct(F.lit(0)), "_b": F.floor(head * buckets / 2.0**32)})
    sizes = rows.groupBy("_s", "_b").agg(F.count("*").alias("_k"))
    w = Window.partitionBy("_s")
    before = sizes.select("_s", "_b", (F.sum("_k").over(w.orderBy("_b")) - F.col("_k")).alias("_before"), F.sum("_k").over(w).alias("_rows"))
    inside = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key))
    return rows.join(before, ["_s", "_b"]).withColumn("_rank", F.col("_before") + inside).drop("_s", "_b", "_h", "_before")


def stratified_sample(df: DataFrame, key: str, label: str, fraction: float, seed: int = 0) -> DataFrame:
    """ceil(rows * fraction) rows of each class, at least one."""
    take = F.greatest(F.lit(1), F.ceil(F.round(F.col("_rows") * fraction, 9)))
    return drawn(df, key, [label], seed).where(F.col("_rank") <= take).drop("_rank", "_rows")


def limit_rows(df: DataFrame, key: str, most: int, label: str | None = None, seed: int = 0) -> DataFrame:
    """At most `most` rows; with a label its classes keep their shares, by largest remainders (the smaller label first in ties)."""
    if label is None:
        return drawn(df, key, [], seed).where(F.col("_rank") <= most).drop("_rank", "_rows")
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(sizes.values())
    if n <= most:
        return df
    quota = {c: k * most // n for c, k in sizes.items()}
    rest = sorted(sizes, key=lambda c: (-(sizes[c] * most % n), str(c)))
    for c in rest[: most - sum(quota.values())]:
        quota[c] += 1
    take = F.lit(0)
    for c, k in quota.items():
        take = F.when(F.col(label).eqNullSafe(F.lit(c)), k).otherwise(take)
    return drawn(df, key, [label], seed).where(F.col("_rank") <= take).drop("_rank", "_rows")


def split(df: DataFrame, key: str, strata: Sequence[str], test: float = 0.3, seed: int = 7) -> DataFrame:
    """df with split, 'test' for round(rows * test) rows of each stratum, else 'train'."""
    cut = F.floor(F.round(F.col("_rows") * test, 9) + 0.5)
    return drawn(df, key, strata, seed).withColumn("split", F.when(F.col("_rank") <= cut, "test").otherwise("train")).drop("_rank", "_rows")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """df with fold (test) and validation (the next one), by a hash of the key: no shuffle."""
    f = (F.conv(F.substring(chance(key, seed), 1, 8), 16, 10).cast("long") % k).cast("int")
    return df.withColumn("fold", f).withColumn("validation", (f + 1) % k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in that order, by partial aggregation and not by ranking; equal in order: the smallest row."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(first.alias("_f")).select(*keys, *(F.col(f"_f._row.{c}").alias(c) for c in rest)).select(*df.columns)


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys that both sides hold, which a split must not have."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("shared"))
