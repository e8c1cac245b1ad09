"""Ranked text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def search(docs: DataFrame, query: str, top: int = 10, phrase: float = 2.5) -> DataFrame:
    """doc_id and score of the best documents by BM25: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), times how often a
    term is asked for (3 at most), and a bonus for the phrase. Terms are counted inside each document, so only matching (term, document) pairs are shuffled.
    """
    asked: dict[str, int] = {}
    for t in query.lower().split():
        asked[t] = min(3, asked.get(t, 0) + 1)
    tokens = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    d = docs.select("doc_id", tokens.alias("w"), (F.locate(query.lower(), F.lower("text")) > 0).alias("has"))
    n, mean = d.agg(F.count("*"), F.avg(F.size("w"))).first()
    hits = d.select("doc_id", "has", F.size("w").alias("len"), F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(q).alias("qf"), F.size(F.array_remove("w", t)).alias("left")) for t, q in asked.items()))).alias("x"))
    tf = hits.select("doc_id", "has", "len", "x.term", "x.qf", (F.col("len") - F.col("x.left")).alias("tf")).where("tf > 0")
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (mean or 1.0))) * F.col("qf")
    scores = tf.join(F.broadcast(idf), "term").groupBy("doc_id").agg((F.sum(part) + F.max(F.when(F.col("has"), phrase).otherwise(0.0))).alias("score"))  # idf: a row for each term of the query
    return scores.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top)
