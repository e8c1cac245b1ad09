"""Removal of repeated passages with a distributed difference-cover suffix method.

The classic algorithm sorts the suffixes at positions 1 and 2 modulo 3 by their first three bytes, names the
triples, recurses on the names and merges the rest. Here the cover has period v = q*q + q + 1 instead of 3:
with a perfect difference set D modulo v, any two positions i and j have a shift d < v such that both
i + d and j + d are sampled, while only q + 1 of v positions are. A repeat of min_bytes bytes therefore holds a
repeat of min_bytes - v + 1 bytes between two sampled positions.

1. Sampled tuples: each sampled position is named by the fingerprint of the min_bytes - v + 1 bytes that follow.
   The names of a bucket are sorted; a name that stands beside no equal is unique and its suffix discarded,
   as suffix sorters with discarding do.
2. Recursion on names: the sampled suffixes that are left fix the only places where a longer repeat can start.
3. Merge: all suffixes, sampled or not, that reach a repeated sampled one within a shift of less than v are named
   by their first min_bytes bytes; names are sorted again and adjacent ones compared. Equal neighbours are repeats.

Documents are dealt out once, by a hash of doc_id, into batches of bounded size; what is shuffled besides is
4 bytes for each sampled name (the bucket tells as much again) and 8 for each merged one, packed by (batch, bucket), with the names that a batch
holds several times sent once. The answer is one bit for each name. So a passage that a third of all documents
hold costs no more than any other. The number of batches and buckets grows with the input.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import input_bytes, prefix_hash, short_batches, span_hash, table

BATCH_BYTES = 6 << 20


def difference_set(q: int) -> tuple[int, list[int]]:
    """For a prime q, v = q*q + q + 1 and q + 1 numbers whose differences are all residues modulo v: the powers of a
    generator of the field with q**3 elements that lie in a plane (Singer)."""
    v = q * q + q + 1
    for a, b, c in itertools.product(range(q), range(q), range(1, q)):
        x, plane, k = (0, 1, 0), [], 1
        while k <= v:
            if x[2] == 0:
                plane.append(k % v)
                if x[1] == 0:
                    break
            x, k = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q), k + 1
        if k == v and len({(i - j) % v for i in plane for j in plane}) == v:
            return v, sorted(plane)
    raise ValueError(f"no difference set for {q}")


def cover(min_bytes: int) -> tuple[int, list[int]]:
    """The period and residues for a length: the largest period that leaves at least half of it for the names."""
    best = (1, [0])
    for q in (2, 3, 5, 7, 11, 13, 17, 19, 23):
        if q * q + q + 1 <= max(1, min_bytes // 2):
            best = difference_set(q)
    return best


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the shuffle is to carry them."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at = batch.schema.get_field_index("data")
        yield batch.set_column(at, "data", pa.array([pack(x or b"") for x in batch.column(at).to_pylist()], pa.binary()))


class _Batch:
    """The documents of a batch in a fixed order, and the steps on them, each a function of texts and answers only."""

    def __init__(self, docs: pa.Table, min_bytes: int, v: int, residues: list[int], buckets: int):
        ids = docs["doc_id"].to_pylist()
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(x) for x in docs["data"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.min_bytes, self.v, self.buckets = min_bytes, v, buckets
        self.sampled = np.zeros(v, bool)
        self.sampled[residues] = True
        self.name_bytes = min_bytes - v + 1

    def sampled_names(self) -> tuple[list[np.ndarray], np.ndarray]:
        at, names = [], [np.zeros(0, np.uint64)]
        for s in self.texts:
            if len(s) < self.min_bytes:
                at.append(np.zeros(0, np.int64))
                continue
            n = len(s) - self.name_bytes + 1
            p = np.flatnonzero(np.resize(self.sampled, n))
            at.append(p)
            names.append(span_hash(prefix_hash(s), p, p + self.name_bytes))
        return at, np.concatenate(names)

    def merged_names(self, at: list[np.ndarray], repeated: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        starts, names, k = [], [np.zeros(0, np.uint64)], 0
        for s, p in zip(self.texts, at, strict=True):
            p, k = p[repeated[k : k + len(p)]], k + len(p)
            if not len(p):
                starts.append(p)
                continue
            n = len(s) - self.min_bytes + 1
            near = np.zeros(n + 1, np.int32)
            np.add.at(near, np.maximum(p - self.v + 1, 0), 1)
            np.add.at(near, np.minimum(p + 1, n), -1)
            i = np.flatnonzero(np.cumsum(near[:n]) > 0)
            starts.append(i)
            names.append(span_hash(prefix_hash(s), i, i + self.min_bytes))
        return starts, np.concatenate(names)

    def grouped(self, names: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names by bucket, then value; their buckets; whether each occurs twice here; where each given name stands."""
        bucket = (names >> np.uint64(32)) % np.uint64(self.buckets)
        key = names if wide else (names & np.uint64(0xFFFFFFFF)) | (bucket << np.uint64(32))
        u, back, count = np.unique(key, return_inverse=True, return_counts=True)
        b = ((u >> np.uint64(32)) % np.uint64(self.buckets) if wide else u >> np.uint64(32)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        return u[order], b[order], count[order] > 1, place[back], np.searchsorted(b[order], np.arange(self.buckets + 1))

    def packed(self, names: np.ndarray, batch: int, wide: bool) -> pa.Table:
        u, _, twice, _, bounds = self.grouped(names, wide)
        data = u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if wide else 4]
        rows = [k for k in range(self.buckets) if bounds[k] < bounds[k + 1]]
        return pa.table({
            "batch": pa.array([batch] * len(rows), pa.int64()), "bucket": pa.array(rows, pa.int64()),
            "names": pa.array([data[bounds[k] : bounds[k + 1]].tobytes() for k in rows], pa.binary()),
            "twice": pa.array([np.packbits(twice[bounds[k] : bounds[k + 1]]).tobytes() for k in rows], pa.binary()),
        })

    def answered(self, names: np.ndarray, wide: bool, bits: dict[int, bytes]) -> np.ndarray:
        """Which of the names are repeated, by the answers of the buckets."""
        u, _, _, place, bounds = self.grouped(names, wide)
        found = np.zeros(len(u), bool)
        for k, x in bits.items():
            n = bounds[k + 1] - bounds[k]
            found[bounds[k] : bounds[k + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
        return found[place]


def _compare(bucket: pa.Table, width: int) -> pa.Table:
    """Sort the names of a bucket, of width bytes each, and compare neighbours; answer each batch with a bit for each of its names."""
    parts = [x.as_py() for x in bucket["names"]]
    sizes = [len(x) // width for x in parts]
    wide = np.zeros((sum(sizes), 8 if width > 4 else 4), np.uint8)
    wide[:, :width] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    names = wide.view(np.uint64 if width > 4 else np.uint32).ravel()
    found = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(bucket["twice"], sizes, strict=True)]).astype(bool)
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    out, k = [], 0
    for n in sizes:
        out.append(np.packbits(found[k : k + n]).tobytes() if found[k : k + n].any() else None)
        k += n
    keep = pa.array([i for i, x in enumerate(out) if x is not None], pa.int64())
    return pa.table({"batch": bucket["batch"].take(keep), "bucket": bucket["bucket"].take(keep), "bits": pa.array([x for x in out if x is not None], pa.binary())})


def suffix_dedup(docs: DataFrame, min_bytes: int = 400, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Remove every byte that a string of min_bytes bytes covers which also starts anywhere else in the input.

    docs: doc_id (integer, may be null) and text (string, taken as UTF-8; null is empty); other columns are left
    out. Returns a row for each row: doc_id, n_bytes, spans (maximal removed runs as start and end byte), kept (the
    remaining bytes). Matches never cross documents. A row given twice is a copy, so both lose their text from
    min_bytes on. Shorter and empty texts stay as they are; an empty table gives an empty table. Every decision is
    made on the input, whatever else is removed.

    Equality is that of 64-bit fingerprints of the min_bytes bytes: with n merged suffixes the chance that any
    two different ones agree is about n*n / 2**65.
    """
    v, residues = cover(min_bytes)
    count = max(4, -(-2 * input_bytes(docs) // batch_bytes))
    args = (min_bytes, v, residues, count)
    data = short_batches(docs).select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).mapInArrow(_compressed, "batch long, doc_id long, data binary")

    def first(key: tuple, t: pa.Table) -> pa.Table:
        b = _Batch(t, *args)
        return b.packed(b.sampled_names()[1], key[0].as_py(), False)

    def bits(t: pa.Table, level: int) -> dict[int, bytes]:
        return {k: x for k, x, n in zip(t["bucket"].to_pylist(), t["bits"].to_pylist(), t["level"].to_pylist(), strict=True) if n == level}

    def second(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Batch(t, *args)
        at, names = b.sampled_names()
        return b.packed(b.merged_names(at, b.answered(names, False, bits(answers, 0)))[1], key[0].as_py(), True)

    def third(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Batch(t, *args)
        at, names = b.sampled_names()
        starts, names = b.merged_names(at, b.answered(names, False, bits(answers, 0)))
        repeated, k, spans, kept = b.answered(names, True, bits(answers, 1)), 0, [], []
        for s, i in zip(b.texts, starts, strict=True):
            i, k = i[repeated[k : k + len(i)]], k + len(i)
            runs = []
            if len(i):
                cut = np.flatnonzero(np.diff(i) > min_bytes)
                runs = list(zip(i[np.r_[0, cut + 1]].tolist(), (i[np.r_[cut, len(i) - 1]] + min_bytes).tolist(), strict=True))
            spans.append([{"start": x, "end": y} for x, y in runs])
            kept.append(b"".join(s[x:y] for x, y in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), len(s)], strict=True)))
        return pa.table({
            "doc_id": pa.array(b.ids, pa.int64()), "n_bytes": pa.array([len(s) for s in b.texts], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
        })

    packed = "batch long, bucket long, names binary, twice binary"
    answer = "batch long, bucket long, bits binary"
    by_batch = data.groupBy("batch")
    sampled = by_batch.applyInArrow(first, packed).groupBy("bucket").applyInArrow(lambda t: _compare(t, 4), answer).withColumn("level", F.lit(0))
    merged = by_batch.cogroup(sampled.groupBy("batch")).applyInArrow(second, packed).groupBy("bucket").applyInArrow(lambda t: _compare(t, 8), answer).withColumn("level", F.lit(1))
    return by_batch.cogroup(sampled.unionByName(merged).groupBy("batch")).applyInArrow(third, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("removed"))
