"""Labelled frames derived from the tables, the inputs of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SCORE = "l_quantity + 200 * l_discount + 100 * l_tax"
#: SQL that both engines read, for the frame of each name.
FRAMES = {
    "score_hi": f"SELECT l_quantity, l_discount, l_tax, CAST({SCORE} > 40 AS INT) AS label FROM lineitem",
    "score_cat": f"SELECT l_quantity, l_discount, l_returnflag, CAST({SCORE} > 40 AS INT) AS label FROM lineitem",
    "xor2": "SELECT l_quantity, l_discount, l_tax, CAST((l_quantity > 25) <> (l_discount > 0.05) AS INT) AS label FROM lineitem",
    "missing": f"SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_discount, l_tax, CAST({SCORE} > 40 AS INT) AS label FROM lineitem",
    "multi3": f"SELECT l_quantity, l_discount, l_tax, CASE WHEN {SCORE} <= 30 THEN 0 WHEN {SCORE} <= 50 THEN 1 ELSE 2 END AS label FROM lineitem",
    "null_signal": "SELECT l_quantity, l_discount, l_tax, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem",
    # a fixed logistic score, rounded so that both engines bin it alike
    "scored": f"SELECT l_orderkey, l_returnflag, l_linestatus, CAST({SCORE} > 40 AS INT) AS y, ROUND(1 / (1 + EXP(-(l_quantity - 25) / 9 - (l_discount - 0.05) * 15)), 6) AS p FROM lineitem",
    "treat": """SELECT o_orderkey, o_totalprice, o_orderstatus, c_acctbal, c_mktsegment, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS t,
                CAST(o_totalprice > 100000 + 20000 * CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS INT) AS y FROM orders JOIN customer ON o_custkey = c_custkey""",
    "quality": "SELECT d.doc_id, lang, source, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FRAMES[name]
    for t in ("lineitem", "orders", "customer", "documents", "labels"):
        if t in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def split_by_order(df: DataFrame, order: list[str], share: float = 0.7, buckets: int = 2000) -> DataFrame:
    """df with part: 'reference' for the first floor(n * share) rows in that order, else 'current'.

    The cut is found by counting: rows are counted by buckets of the first column, and only the bucket that holds the cut is ordered.
    So no task sorts all rows, whatever their number.
    """
    first = F.col(order[0])
    first = (first.cast("timestamp") if dict(df.dtypes)[order[0]].startswith("timestamp") else first).cast("double")
    r = df.agg(F.count("*"), F.min(first), F.max(first)).first()
    n, low, high = int(r[0]), r[1], r[2]
    cut = max(1, min(n - 1, int(n * share))) if n >= 20 else n
    width = ((high - low) / buckets) or 1.0 if n else 1.0
    bucket = F.floor((first - F.lit(low)) / F.lit(width))
    seen, at, before = 0, None, 0
    for b, k in sorted((row[0], row[1]) for row in df.groupBy(bucket.alias("b")).count().collect()):
        if seen + k >= cut:
            at, before = b, seen
            break
        seen += k
    edge = df.where(bucket == F.lit(at)).orderBy(*order).limit(cut - before).orderBy(*(F.col(c).desc() for c in order)).limit(1).first() if at is not None else None
    if edge is None:
        return df.withColumn("part", F.lit("reference"))
    inside = F.lit(True)
    for c in reversed(order):
        at = F.lit(edge[c]).cast(dict(df.dtypes)[c])
        inside = (F.col(c) < at) | ((F.col(c) == at) & inside)
    return df.withColumn("part", F.when(inside, "reference").otherwise("current"))
