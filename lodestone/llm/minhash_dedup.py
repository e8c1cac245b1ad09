"""Near-duplicate documents with ProbMinHash.

A document is the bag of its shingles (runs of five words; a shorter text is one shingle), each weighted by how often it
occurs. The similarity is the probability Jaccard of two bags:

    J(a, b) = sum over shared d of 1 / sum over d' of max(a[d'] / a[d], b[d'] / b[d])

which is the plain Jaccard similarity where no shingle occurs twice. For a signature, each shingle is a Poisson process
whose rate is its weight: its arrivals have exponential gaps and each picks one register at random; a register keeps the
shingle that arrives first. Two registers agree with probability J. A shingle stops as soon as its next arrival is
later than the latest register, so that the cost is about the number of shingles plus m log m. Bands of registers find candidates,
and every candidate is verified with the exact J.

Scale: texts whose bags are equal become one class before anything else, so exact copies, however many, are one row. A
bucket of a band isn't expanded into pairs: each member is compared with the bucket's hub, the document that shares most with others, which
gives as many candidates as members. Where that leaves a bucket in several groups, all its members of different groups are compared as well, however large it is, each pair in
the first bucket that it shares. Buckets of more than BLOCK documents are dealt in blocks, and each two blocks are a group of rows of their own, so that no task holds a bucket. This compares signatures of WIDE
registers, 4 bits of each, and so do the hubs with fewer: a pair with more differing ones than a similarity at the threshold gives but once in 100,000 cases isn't verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import connected, merged, mix, released, short_batches, small, stored, table, word_hashes

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
#: Documents of a block of a large bucket; registers of the signatures for what is left in the open; pairs of them that are looked at together.
BLOCK, WIDE, TOGETHER = 256, 1024, 1 << 14


def bag(text: str | None, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text as sorted 64-bit hashes, and how often each occurs."""
    w = word_hashes(text)
    if not len(w):
        return w, np.zeros(0, np.int64)
    n = max(1, len(w) - k + 1)
    s = np.zeros(n, np.uint64)
    for i in range(min(k, len(w))):
        s = mix(s + w[i : i + n] + np.uint64(i + 1))
    return np.unique(s, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """A row of m registers for each bag: in each the shingle that arrived first; 0 for an empty bag."""
    first, out = np.full(len(bags) * m, np.inf), np.zeros(len(bags) * m, np.uint64)
    item = np.concatenate([x for x, _ in bags] or [np.zeros(0, np.uint64)])
    rate = np.concatenate([y for _, y in bags] or [np.zeros(0, np.int64)]).astype(float)
    doc = np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])
    t, step = np.zeros(len(item)), 0
    while len(item):
        # A few shingles that are left draw many arrivals at once.
        width = int(np.clip(2048 // len(item), 1, 256))
        draw = mix(item[:, None] + mix(np.arange(step + 1, step + width + 1, dtype=np.uint64))[None, :])
        gap = -np.log1p(-((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate[:, None]
        arrival = t[:, None] + np.cumsum(gap, axis=1)
        register = doc[:, None] * m + (mix(draw) % np.uint64(m)).astype(np.int64)
        better = arrival < first[register]
        r, x, who = register[better], arrival[better], np.broadcast_to(item[:, None], better.shape)[better]
        np.minimum.at(first, r, x)
        won = x == first[r]
        out[r[won]] = who[won]
        t, step = arrival[:, -1], step + width
        alive = t < first.reshape(-1, m).max(axis=1)[doc]
        item, rate, doc, t = item[alive], rate[alive], doc[alive], t[alive]
    return out.reshape(len(bags), m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J of two bags. Sorted by a[d] / b[d], the sum below a shared d is of b[d'] and the rest of a[d']."""
    (x, wx), (y, wy) = a, b
    if not len(x) or not len(y):
        return 0.0
    shared, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    p, q = wx[i].astype(float), wy[j].astype(float)
    if (p == 1).all() and (q == 1).all() and (wx == 1).all() and (wy == 1).all():
        return len(shared) / (len(x) + len(y) - len(shared))
    only_x, only_y = wx.sum() - p.sum(), wy.sum() - q.sum()
    ratio = p / q
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    after = p.sum() - np.cumsum(p)
    before = np.cumsum(q)
    return float(np.sum(1.0 / ((after + only_x) / p + (before + only_y) / q)))


def nibbles(signature: np.ndarray) -> np.ndarray:
    """The low 4 bits of each register, 16 to a long number."""
    padded = np.zeros((len(signature), -(-signature.shape[1] // 16) * 16), np.uint64)
    padded[:, : signature.shape[1]] = mix(signature) & np.uint64(15)
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    return np.bitwise_or.reduce(padded.reshape(len(padded), -1, 16) << shifts, axis=2).astype(np.int64)


def differing(a: str, b: str, count: int) -> Column:
    """How many of the registers differ in their low 4 bits, for columns of long numbers from nibbles()."""
    out = F.lit(0)
    for k in range(count):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        out = out + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def most_differing(m: int, similarity: float) -> int:
    """The number of differing registers that a pair at the threshold exceeds about once in 100,000 cases."""
    p = (1 - similarity) * 15 / 16
    return math.ceil(m * p + 4.3 * math.sqrt(m * p * (1 - p)))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents that chains of links join, a link being a probability Jaccard of at least similarity.

    docs: doc_id (integer) and text; other columns are left out. Returns a row for each row: doc_id,
    component_id (the smallest doc_id of the group), kept (doc_id = component_id, and for a row given several times, true on
    each), copies (rows with the same bag). A null text or one without words is linked with nothing and is its
    own component. A null doc_id makes a row that is linked by its text but never the smallest if another is there.
    An empty table gives an empty table. With 25 bands of 5 registers a pair of similarity 0.8 is missed with
    probability 5e-5, one of 0.9 with 1e-9.
    """
    m = bands * rows
    width, most = -(-m // 16), most_differing(m, similarity)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [bag(x, shingle) for x in part["text"].to_pylist()]
                signature = signatures(found, m)
                s = signature.reshape(len(found), bands, rows)
                key = np.zeros((len(found), bands), np.uint64)
                for i in range(rows):
                    key = mix(key + s[:, :, i] + np.uint64(i + 1))
                sums = [((mix(x + np.uint64(1)) * y.astype(np.uint64)).sum(), (mix(x ^ np.uint64(0x5851F42D4C957F2D)) * y.astype(np.uint64)).sum()) for x, y in found]
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array([len(x) for x, _ in found], pa.int64()),
                    *(pa.array(np.array([s[i] for s in sums], np.uint64).astype(np.int64)) for i in (0, 1)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(found) + 1, bands), pa.int32()), pa.array(key.astype(np.int64).ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(found) + 1, width), pa.int32()), pa.array(nibbles(signature).ravel())),
                ], ["doc_id", "n", "k1", "k2", "bands", "sig"])

    def widely_signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-WIDE // 16)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sig = nibbles(signatures([bag(x, shingle) for x in part["text"].to_pylist()], WIDE))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(sig) + 1, width), pa.int32()), pa.array(sig.ravel()))], ["doc_id", "sig"])

    data = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = stored(data.mapInArrow(signed, "doc_id long, n long, k1 long, k2 long, bands array<long>, sig array<long>"))
    classes = s.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = s.where("n > 0 and doc_id is not null").join(classes.where("copies > 1"), ["k1", "k2"], "left").where("rep is null or rep = doc_id").dropDuplicates(["doc_id"])
    members = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stored(members.join(shared, ["band", "key"]).select("band", "key", "doc_id", "size"))
    sig = stored(reps.select("doc_id", "sig").join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"))

    ties = buckets.join(buckets.groupBy("doc_id").agg(F.sum("size").alias("ties")), "doc_id")
    hubs = ties.groupBy("band", "key").agg(F.max(F.struct("ties", (-F.col("doc_id")).alias("minus"))).alias("x")).select("band", "key", (-F.col("x.minus")).alias("hub"))
    star = buckets.join(hubs, ["band", "key"]).where("doc_id <> hub").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    of = lambda k: sig.select(F.col("doc_id").alias(k), F.col("sig").alias(f"s_{k}"))
    star = stored(star.join(of("a"), "a").join(of("b"), "b").where(differing("s_a", "s_b", width) <= most).select("a", "b"))
    links = verified(data, star, similarity, shingle)
    groups = stored(connected(links))
    placed = buckets.join(groups, buckets["doc_id"] == groups["node"], "left").select("band", "key", "doc_id", "size", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "key")
    left = stored(placed.join(mixed, ["band", "key"], "left_semi"))
    # Signatures with so many registers that few pairs below the threshold look like ones above it, for what is left in the open.
    wide = stored(read_again(data, left.select("doc_id").distinct()).mapInArrow(widely_signed, "doc_id long, sig array<long>"))
    cross = stored(in_buckets(left, wide, reps.select("doc_id", F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands")), similarity).join(star, ["a", "b"], "left_anti"))
    groups = merged(groups, verified(data, cross, similarity, shingle))

    named = classes.where("copies > 1").select("k1", "k2", "copies", F.col("rep").alias("class_rep"))
    out = s.join(named, ["k1", "k2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("class_rep", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(groups, out["rep"] == groups["node"], "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(F.col("n") > 0, F.coalesce("copies", F.lit(1))).otherwise(1).cast("long").alias("copies"))


def in_buckets(left: DataFrame, wide: DataFrame, bands: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of members (band, key, doc_id, size, component) of one bucket, but of different components, whose wide signatures look similar, each once.

    bands: for each doc_id the keys of its bands, of 31 bits; equal ones by chance hide a pair once in 10**8 cases.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = left.join(wide, "doc_id").join(bands, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    # A document meets the others of its block, and each other block in a group of rows that both go to.
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(F.xxhash64("band", "key", lo, hi).alias("g"), "band", (lo == hi).alias("own"), (F.col("block") == lo).alias("low"), "doc_id", "component", "bands", "sig")
    most = most_differing(WIDE, similarity)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, band, own, low, doc, component, keys, sig in gathered(batches):
            row = np.arange(len(g))
            ends = np.searchsorted(g, g, "right")
            count = ends - row - 1
            upto, start = np.cumsum(count), 0
            while start < len(g):
                end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + TOGETHER, "right")))
                n = count[start:end]
                i = np.repeat(row[start:end], n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                start = end
                yes = (component[i] != component[j]) & (band[i] == band[j]) & (own[i] | (low[i] != low[j]))
                i, j = i[yes], j[yes]
                yes = (keys[i] == keys[j]).argmax(axis=1) == band[i]
                i, j = i[yes], j[yes]
                x = sig[i] ^ sig[j]
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                yes = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64) <= most
                a, b = doc[i[yes]], doc[j[yes]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(compared, "a long, b long")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first, as arrays that hold groups of that column in full; lists of one length become rows of a matrix."""

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for c in batch.columns:
            if pa.types.is_list(c.type):
                v = c.flatten().to_numpy(zero_copy_only=False)
                out.append((v.view(np.uint64) if v.dtype == np.int64 else v).reshape(len(c), -1))
            else:
                out.append(c.to_numpy(zero_copy_only=False))
        return out

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = arrays(batch)
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))  # the last group may go on
        if cut or (held and held[-1][0][-1] != now[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now], strict=True)]
            held = [[x[cut:] for x in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def shortened(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag by the upper halves of its hashes; what they have in common counts together."""
    half = (items >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.r_[True, half[1:] != half[:-1]]) if len(half) else np.zeros(0, np.int64)
    return half[first], np.add.reduceat(counts, first) if len(first) else counts


def read_again(data: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of data with those doc_ids, one of each. The ids are broadcast if few, and then no other text is shuffled."""
    return data.join(small(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def verified(data: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts' bags have at least that similarity, as a stored table. Texts are read again for what occurs
    in a pair only, and travel as bags of 32-bit hashes, sorted as the full ones are."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shortened(*bag(x, shingle)) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([y.astype(np.uint32).tobytes() if (y != 1).any() else b"" for _, y in found], pa.binary())], ["id", "items", "counts"])

    def read(items: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(items, np.uint32)
        return x, np.frombuffer(counts, np.uint32) if counts else np.ones(len(x), np.uint32)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[read(x.as_py(), y.as_py()) for x, y in zip(batch[f"{k}_items"], batch[f"{k}_counts"], strict=True)] for k in "ab"]
            yes = pa.array([probability_jaccard(x, y) >= similarity for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(yes), batch["b"].filter(yes)], ["a", "b"])

    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = stored(read_again(data, involved).mapInArrow(bags, "id long, items binary, counts binary"))
    side = lambda k: held.select(F.col("id").alias(k), F.col("items").alias(f"{k}_items"), F.col("counts").alias(f"{k}_counts"))
    out = stored(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(judged, "a long, b long"))
    released(held)
    return out


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
