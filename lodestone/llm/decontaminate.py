"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations alone.

1. Every window of `size` consecutive words of a test item (or the whole of a shorter item) is a phrase to find.
2. The corpus is counted for the terms of the phrases, which gives each phrase its two rarest terms. A phrase with a term that
   the corpus lacks can't occur and is left out.
3. The positional index: postings (term, document, position) of those rarest terms. A posting less the term's place in the item
   is the alignment of an item with a document; where the lists of both rarest terms of a phrase hold the same
   alignment, it is a candidate. That is the intersection of offset-adjusted lists, from the rarest terms on.
4. The words of a candidate document and of the item are laid side by side at the alignment; a run of equal words as long as a
   window, or as a short item, is a hit. Hits of a document are united.

What is shuffled are counts of test terms, postings of rare test terms, candidates, and once the texts to meet the
candidates. Test sets are small beside the corpus: their terms are broadcast only if a count finds
them few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, small, table, words

SIZE = 13
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def phrases(items: DataFrame, size: int) -> DataFrame:
    """item_id, item (all words), start and terms of each phrase; a text given several times under one item_id counts once."""
    split = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    last = F.greatest(F.size("item") - size, F.lit(0))
    return split.select("item_id", "item", F.explode(F.sequence(F.lit(0), last)).alias("start")).withColumn("terms", F.slice("item", F.col("start") + 1, size))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given terms (column term): term, doc_id and position."""
    tokens = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return tokens.join(terms, "term").select("term", "doc_id", "position")


def rarest(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The phrases all of whose terms occur, with the places q1 and q2 of their two rarest terms in the item."""
    each = found.select("item_id", "item", "start", F.posexplode("terms").alias("at", "term"))
    ranked = each.join(counts, "term", "left").groupBy("item_id", "item", "start").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", (F.col("start") + F.col("at")).alias("q")))).alias("r")
    )
    second = F.when(F.size("r") > 1, F.col("r")[1]).otherwise(F.col("r")[0])
    first = F.col("r")[0]
    return ranked.where(first["n"] > 0).select("item_id", "item", "start", first["term"].alias("t1"), first["q"].alias("q1"), second["term"].alias("t2"), second["q"].alias("q2"))


def alignments(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates: doc_id, item_id, item, shift (document position of the item's first word), without repeats."""
    terms = small(found.select(F.explode("terms").alias("term")).distinct())
    counts = small(docs.select(F.explode(words(F.col("text"))).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n")))
    chosen = small(rarest(found, counts))
    places = chosen.select(F.explode(F.array(F.struct(F.col("t1").alias("term"), "item_id", "item", F.col("q1").alias("q")), F.struct(F.col("t2").alias("term"), "item_id", "item", F.col("q2").alias("q")))).alias("x")).select("x.*").distinct()
    listed = small(places.groupBy("term").agg(F.collect_set(F.struct("item_id", F.xxhash64("item").alias("version"), "q")).alias("places")))
    hits = index(docs, listed.select("term")).join(listed, "term").select("doc_id", "position", F.explode("places").alias("p"))
    lists = hits.select("doc_id", "p.item_id", "p.version", (F.col("position") - F.col("p.q")).alias("shift"), "p.q").groupBy("doc_id", "item_id", "version", "shift").agg(F.collect_set("q").alias("qs"))
    wanted = small(chosen.groupBy("item_id", F.xxhash64("item").alias("version")).agg(F.first("item").alias("item"), F.collect_set(F.struct("q1", "q2")).alias("pairs")))
    both = F.exists("pairs", lambda w: F.array_contains("qs", w["q1"]) & F.array_contains("qs", w["q2"]))
    return lists.join(wanted, ["item_id", "version"]).where(both).select("doc_id", "item_id", "item", "shift")


def runs(equal: Column, least: Column) -> Column:
    """From an array of booleans the (start, end) of each run of true at least `least` long."""
    n = F.size(equal)
    cut = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | ~F.get(equal, i.cast("int")))
    bounds = F.transform(F.sequence(F.lit(1), F.size(cut) - 1), lambda k: F.struct((F.get(cut, k - 1) + F.when(F.coalesce(F.get(equal, F.get(cut, k - 1)), F.lit(False)), 0).otherwise(1)).alias("start"), F.get(cut, k).alias("end")))
    return F.filter(bounds, lambda x: x["end"] - x["start"] >= least)


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Exact phrase matches: doc_id, item_id, and start and end (in words) of each maximal run of equal words that holds a phrase."""
    found = checkpoint(phrases(items, size))
    cands = alignments(docs.select("doc_id", "text"), found)
    grouped = cands.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "shift")).alias("cands"))
    met = docs.select("doc_id", "text").join(grouped, "doc_id").select("doc_id", words(F.col("text")).alias("w"), "cands")
    side = met.select("doc_id", "w", F.explode("cands").alias("c")).select("doc_id", "c.item_id", "c.shift", "c.item", F.greatest(F.col("c.shift"), F.lit(0)).alias("from"), F.least(F.size("w"), F.col("c.shift") + F.size("c.item")).alias("to"), "w")
    equal = F.zip_with(F.slice("w", F.col("from") + 1, F.col("to") - F.col("from")), F.slice("item", F.col("from") - F.col("shift") + 1, F.col("to") - F.col("from")), lambda a, b: a == b)
    least = F.least(F.size("item"), F.lit(size))
    flags = side.select("doc_id", "item_id", "from", least.alias("least"), equal.alias("equal")).where(F.size("equal") >= F.col("least"))
    return flags.select("doc_id", "item_id", "from", F.explode(runs(F.col("equal"), F.col("least"))).alias("r")).select("doc_id", "item_id", (F.col("from") + F.col("r.start")).alias("start"), (F.col("from") + F.col("r.end")).alias("end"))


def proximity_matches(docs: DataFrame, items: DataFrame, size: int = SIZE, slack: int = 10) -> DataFrame:
    """Phrases whose two rarest terms stand in a document as far apart as in the item, give or take slack words, in the
    same order: doc_id, item_id, start (of the phrase in the item), position (of the rarest term). From the same postings, without reading texts again.
    """
    found = checkpoint(phrases(items, size))
    terms = small(found.select(F.explode("terms").alias("term")).distinct())
    counts = small(docs.select(F.explode(words(F.col("text"))).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n")))
    chosen = small(rarest(found, counts).drop("item"))
    postings = index(docs, small(chosen.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()))
    first = postings.join(chosen, F.col("term") == F.col("t1")).select("doc_id", "item_id", "start", "t2", "q1", "q2", F.col("position"))
    second = postings.select("doc_id", F.col("term").alias("t2"), F.col("position").alias("other"))
    gap = F.col("q2") - F.col("q1")
    apart = F.col("other") - F.col("position")
    return first.join(second, ["doc_id", "t2"]).where((F.abs(apart - gap) <= slack) & ((apart >= 0) == (gap >= 0))).select("doc_id", "item_id", "start", "position").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """What of each document benchmark items cover.

    docs: doc_id and text; items: item_id and text; other columns are left out. Returns a row for each row of docs: doc_id,
    n_words, n_hit (words inside an occurrence of a window), items (ids with occurring windows, as strings, sorted),
    contaminated (n_hit > 0 and 20 * n_hit >= n_words). A null text has no words; an item without words or
    with a null id is left out; rows with the same doc_id have to have the same text, and each gets the
    answer; a null doc_id is never hit. Without items, or with an empty docs, the result is of the same form.
    """
    hits = checkpoint(phrase_matches(docs, items, size))
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("doc_id", "start", "end").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    covered = spans.groupBy("doc_id").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0))).alias("hit"))
    of = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("found"))
    out = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("n_words"))
    out = out.join(covered, "doc_id", "left").join(of, "doc_id", "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("found", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
