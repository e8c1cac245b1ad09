"""Passages, packing, decontamination and lines against plain versions."""

import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, decontaminate, line_dedup, packing, suffix_dedup
from tests.llm.conftest import text


def removed(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                m[i] += 1
                m[i + size] -= 1
        out.append(np.cumsum(m)[: len(t)] > 0)
    return out


@pytest.mark.parametrize("size", [1, 8, 40, 100])
def test_passages_as_by_counting_all_strings(spark, size):
    rng = random.Random(size)
    base = [text(rng, rng.randrange(1, 120)) for _ in range(40)]
    texts = base + [base[0]] + [x[: len(x) // 2] + rng.choice(base)[10:] for x in base[:20]] + ["aaaa" * 60, "é" * 90, "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df, size, batch_bytes=2000).collect()}
    data = [t.encode() for t in texts]
    for k, gone in enumerate(removed(data, size)):
        kept = bytes(np.frombuffer(data[k], np.uint8)[~gone])
        assert bytes(got[k].kept) == kept
        assert sum(s.end - s.start for s in got[k].spans) == gone.sum()
        assert len(got[k].spans) == (np.diff(np.r_[0, gone.astype(int)]) == 1).sum()


def test_passages_of_the_real_length(spark):
    """400 bytes, so with the cover of period 183: copies that are just long enough or one byte short, at every kind of place."""
    rng = random.Random(400)
    shared = [text(rng, 250)[:n] for n in (399, 400, 401, 582, 583, 800)]
    texts = [text(rng, rng.randrange(0, 200)) + " " + rng.choice(shared) + text(rng, rng.randrange(0, 200)) for _ in range(60)] + [shared[1], shared[0], "ab" * 500, "é" * 300]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), batch_bytes=20_000).collect()}
    data = [t.encode() for t in texts]
    for k, gone in enumerate(removed(data, 400)):
        assert bytes(got[k].kept) == bytes(np.frombuffer(data[k], np.uint8)[~gone]), k


@pytest.mark.parametrize("q", [2, 3, 5, 7, 13])
def test_every_difference_occurs(q):
    v, d = suffix_dedup.difference_set(q)
    assert len(d) == q + 1 and {(a - b) % v for a in d for b in d} == set(range(v))


def test_passages_of_odd_input(odd, empty):
    rows = suffix_dedup.suffix_dedup(odd, 50).collect()
    assert len(rows) == odd.count()
    assert [len(r.kept) for r in rows if r.doc_id == 5] == [0, 0]
    assert [r.n_bytes for r in rows if r.doc_id == 1] == [0]
    assert suffix_dedup.suffix_dedup(empty, 50).count() == 0


def test_pieces_are_powers_of_two_without_gaps(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        p = packing.pieces(n)
        assert sum(k for _, k in p) == n and all(k & (k - 1) == 0 for _, k in p)
        assert [a for a, _ in p] == list(np.cumsum([0, *(k for _, k in p)])[:-1])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(odd).mapInArrow(packing.checksum, packing.DIGEST).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for doc in (1, 2, 4, 7, 8):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.offset == 0 for r in own)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(empty).count() == 0


def test_buckets_hold_sequences_of_one_length(spark, odd, tmp_path):
    packing.write_buckets(packing.pack(odd), f"file://{tmp_path}/buckets")
    for folder in (tmp_path / "buckets").glob("length=*"):
        n = int(folder.name.split("=")[1])
        assert n & (n - 1) == 0 and {len(r.ids) for r in spark.read.parquet(f"file://{folder}").collect()} == {n}
    assert spark.read.parquet(f"file://{tmp_path}/buckets").count() == packing.pack(odd).count()


@pytest.mark.parametrize("t", ["I'm don't ''s '' 's we'll x_y __a 12a ½ é'tis 'd\"s <|endoftext|> a", "", "  \n\t", "İstanbul ﬁ 漢字", "tab\tx\r\ny 'S 'Ll a'b", "co-op ##$% ª º ß µ \xadx", "!'s it's5's 'a a'"])
def test_ids_are_those_of_the_library(t):
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.fast is not None
    assert list(e.ids(t)) == e.tokenizer.encode(t, add_special_tokens=False).ids


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contamination_as_by_comparing_all_windows(spark):
    rng = random.Random(9)
    items = [(k, text(rng, rng.choice([3, 8, 13, 20, 40]))) for k in range(25)] + [(90, None), (91, "  "), (92, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for k in range(60):
        w = text(rng, rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            piece = (rng.choice(items[:25])[1]).split()
            a = rng.randrange(len(piece))
            w[5:5] = piece[a : a + 25]
        docs.append((k, ". ".join(w).title()))
    docs += [(100, None), (101, ""), (102, "W1 " * 40), (103, items[3][1])]
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for item, s in items:
            v = words(s)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        assert (got[k].n_words, got[k].n_hit, list(got[k]["items"])) == (len(w), len(hit), sorted(found)), k
        assert got[k].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_contamination_of_odd_input(spark, odd, empty):
    items = spark.createDataFrame([(1, "twelve words or so in it", "x"), (None, "x", "y")], "item_id long, text string, position string")
    assert decontaminate.contamination(odd, items).count() == odd.count()
    assert decontaminate.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one rare filler words here uncommon end"), (2, "uncommon then rare"), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "rare words uncommon")], "item_id long, text string")
    got = decontaminate.proximity_matches(docs, items, slack=4).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7)}


def norm(line):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[0-9]+", "0", line.lower())) if w]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_as_by_comparing_all_pairs(spark):
    rng = random.Random(5)
    base = [text(rng, rng.randrange(1, 40)) for _ in range(30)] + [text(rng, 90), text(rng, 200)]
    docs = []
    for k in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(["w1", "zz", "9"])
            lines.append(rng.choice([" ".join(w), " ".join(w).upper() + "!", ""]))
        docs.append((k, "\n".join(lines)))
    places = [(k, n, " ".join(norm(x))) for k, t in docs for n, x in enumerate(t.split("\n"))]
    distinct = sorted({x for *_, x in places if x})
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if edit(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                parent[root(a)] = root(b)
    stays = {}
    for k, n, x in places:
        if x:
            stays.setdefault(root(x), (k, n))
    expected = {(k, n) for k, n, x in places if x and stays[root(x)] != (k, n)}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, t in docs:
        assert got[k].text == "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in expected), k
        assert got[k].n_dropped == sum(d == k for d, _ in expected)


def test_a_bucket_of_very_many_lines_is_split(spark, monkeypatch):
    rng = random.Random(12)
    base = ["".join(rng.choice("aeiouklmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    lines = []
    for _ in range(300):
        w = [rng.choice(base) for _ in range(20)]
        lines += [" ".join(["extraordinarily", "commonplaceword", *v, "unquestionably", "everywherefound"]) for v in (w, [*w[:9], "zz", *w[10:]])]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    assert line_dedup.dedup_lines(df).where("n_dropped = 1").count() == 300
    monkeypatch.setattr(line_dedup, "LEAST", 1)
    monkeypatch.setattr(line_dedup, "SAMPLED", 4)
    assert line_dedup.dedup_lines(df).where("n_dropped = 1").count() == 300


@pytest.mark.parametrize("block", [256, 8])
def test_lines_whose_only_common_anchor_many_others_have(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BUCKET", block if block < 256 else line_dedup.BUCKET)
    rng = random.Random(14)
    lines = []
    for _ in range(40):
        w = ["".join(rng.choice("aeiouklmnrst") for _ in range(5)) for _ in range(7)]
        lines += [" ".join(["unquestioned", "commonplaces", *v]) for v in (w, [x if k % 2 else x[:2] + "q" + x[3:] for k, x in enumerate(w)])]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    # One anchor alone is shared by the lines of a pair, and 80 lines have it.
    anchors = {r.doc_id: set(r.anchors) for r in line_dedup.occurrences(rows).collect()}
    assert {len(anchors[k] & anchors[k + 1]) for k in range(0, 80, 2)} == {1} and len(set.intersection(*anchors.values())) == 1
    similar = {(a, b) for b in range(80) for a in range(b) if edit(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b])) + 1e-9}
    assert similar == {(k, k + 1) for k in range(0, 80, 2)}
    assert {r.doc_id for r in line_dedup.dedup_lines(rows).where("n_dropped = 1").collect()} == set(range(1, 80, 2))


def test_chance_pairs_of_a_bucket_are_told_off_where_they_are_made(spark, monkeypatch):
    """long lines with an anchor and no more in common made rows with the square of their number, as did short ones."""
    rng, taken = random.Random(16), []
    base = ["".join(rng.choice("aeiouklmnrst") for _ in range(rng.randrange(2, 7))) for _ in range(600)]
    lines = [" ".join(["unquestionably", "commonplaces", *(rng.choice(base) for _ in range(n))]) for n in [150] * 120 + [2] * 120]

    def counted(df, store=line_dedup.stored):
        out = store(df)
        taken.extend([out.count()] * (out.columns == ["a", "b"]))
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    assert line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_dropped > 0").count() < 120
    similar = sum(edit(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for i, b in enumerate(lines[120:]) for a in lines[120 : 120 + i])
    assert max(taken) <= 2 * similar + 240


def test_pairs_of_a_bucket_that_share_a_passage_are_verified_where_they_meet(spark, monkeypatch):
    """lines of which a common passage is the greater part made rows with the square of their number, though few are similar."""
    rng, taken = random.Random(19), []
    word = lambda: "".join(rng.choice("aeiouklmnrst") for _ in range(rng.randrange(2, 9)))
    passage, lines = [word() for _ in range(14)], []
    for k in range(30):
        own = [word() for _ in range(8)]
        lines.append(" ".join([*own, *passage]))
        if k % 3 == 0:  # one of another length, so that others stand between
            lines.append(" ".join([*own, "yy", "zzzz", *passage]))
    similar = {(a, b) for b in range(len(lines)) for a in range(b) if edit(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b])) + 1e-9}
    assert 10 <= len(similar) < 100

    def counted(df, store=line_dedup.stored):
        out = store(df)
        taken.extend([out.count()] * (out.columns == ["a", "b"]))
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_dropped > 0")
    groups = list(range(len(lines)))
    for a, b in sorted(similar):
        groups = [min(groups[a], groups[b]) if g in (groups[a], groups[b]) else g for g in groups]
    assert {r.doc_id for r in got.collect()} == {k for k, g in enumerate(groups) if k != g}
    assert max(taken) <= 4 * len(lines)


def test_anchors_of_very_many_lines_are_not_counted_again(spark, monkeypatch):
    """All entries were made once more for it."""
    calls = []
    monkeypatch.setattr(line_dedup, "small", lambda df, real=line_dedup.small: (calls.append(1), real(df))[1])
    monkeypatch.setattr(line_dedup, "LEAST", 1)
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    lines = spark.createDataFrame([(k, [7, 100 + k], 9 + k) for k in range(40)], "h long, anchors array<int>, len int")
    assert line_dedup.buckets(lines).where("key = 7").count() == 40 and len(calls) == 1


def test_no_similar_pair_is_told_off_before_its_texts_are_read(spark):
    rng = random.Random(17)
    base = ["".join(rng.choice("aeiouäéklmnrst漢") for _ in range(rng.randrange(1, 8))) for _ in range(2000)]
    lines = ["e" * 40_000, "e" * 39_000, "q " * 36_000, "q " * 35_990 + "x"]
    for n in [1, 2, 3, 5, 6, 8, 15, 29, 31, 59, 61, 62, 90] * 12:
        w = [rng.choice(base) for _ in range(n)]
        v = " ".join(w)
        for _ in range(rng.randrange(1, max(2, len(v) // 6))):
            k = rng.randrange(len(v))
            v = v[:k] + rng.choice(["", " ", "q", v[k] * 2, "e"]) + v[k + rng.randrange(2) :]
        lines += [" ".join(w), " ".join(norm(v)) or "q"]
    pairs = [(k, k + 1) for k in range(0, len(lines), 2)]
    words = [x.split() for x in lines]
    share = lambda x, y: len(x & y) / max(1, len(x), len(y))
    two = lambda w: set(zip(w, w[1:], strict=False))
    asked = {(a, b) for a, b in pairs if max(len(words[a]), len(words[b])) <= 5 or (share(set(words[a]), set(words[b])) >= 1 / 3 and share(two(words[a]), two(words[b])) >= 0.1)}
    similar = {(a, b) for a, b in asked if a < 4 or edit(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b])) + 1e-9}
    found = line_dedup.occurrences(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    side = lambda k: found.select(F.struct("*").alias(k))
    met = side("x").join(side("y"), F.expr("x.doc_id + 1 = y.doc_id and x.doc_id % 2 = 0")).where(line_dedup.in_common("x", "y", 0.8))
    left = {tuple(r) for r in met.select("x.doc_id", "y.doc_id").collect()}
    assert similar <= left and len(similar) > 80 and {(0, 1), (2, 3)} <= similar


def test_pairs_of_lines_are_verified_in_turns(spark, monkeypatch):
    """Many more pairs than lines, as in large buckets: no table of pairs or join has them all at once, and none is lost."""
    rng, taken = random.Random(15), []
    base = [text(rng, 1) for _ in range(24)]
    texts = [" ".join([*base[: k % 12], "zz", *base[k % 12 + 1 :], str("q" * (k // 12 + 1))]) for k in range(36)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_dedup.stored(line_dedup.occurrences(docs).select("h", F.struct("doc_id", "line_no").alias("first"), "words", "distinct", "bits"))
    of = {r.h: texts[r.first.doc_id] for r in lines.collect()}
    pairs = line_dedup.stored(lines.select(F.col("h").alias("a")).join(lines.select(F.col("h").alias("b")), F.col("a") < F.col("b")))

    def counted(df, store=line_dedup.stored):
        out = store(df)
        taken.extend([out.count()] * (out.columns == ["a", "b"]))
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    got = {(r.a, r.b) for r in line_dedup.verified(docs, lines, pairs, 0.8).collect()}
    assert got == {(r.a, r.b) for r in pairs.collect() if edit(of[r.a], of[r.b]) <= 0.2 * max(len(of[r.a]), len(of[r.b])) + 1e-9}
    assert len(got) > 400 and max(taken) <= 2 * len(texts)


def test_lines_of_far_lengths_do_not_meet(spark):
    """A bucket of lines of all lengths: only similar lengths come into a group, each such pair once."""
    at = spark.createDataFrame([(7, k, k, k) for k in range(1, 200)], "key int, h long, len int, component long")
    lines = spark.createDataFrame([(k, [7], 9, 9, [0] * 8) for k in range(1, 200)], "h long, anchors array<int>, words int, distinct int, bits array<long>")
    for similarity in (0.8, 0.95, 0.5):
        groups = {}
        for r in line_dedup.dealt(at, lines, similarity).collect():
            groups.setdefault(r.g, []).append(r)
        met = Counter((x.h, y.h) for g in groups.values() for x in g for y in g if x.h < y.h and not (x.longer and y.longer) and (x.own or x.low != y.low))
        assert set(met.values()) == {1} and {(a, b) for b in range(1, 200) for a in range(1, b) if b - a <= (1 - similarity) * b + 1e-9} <= set(met)
        assert all(a >= similarity * similarity * b - 1 for a, b in met)


def test_shuffle_files_and_released_tables_go(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for d in disk.localDirs() for f in Path(str(d)).rglob("shuffle_*.data")}
    before = files()
    out = common.stored(spark.range(5000).select(F.col("id") % 977, "id").repartition(5, "id").groupBy("(id % 977)").count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and out.count() == 977
    folder = Path(out.inputFiles()[0].removeprefix("file://")).parent
    assert folder.is_dir()
    common.released(out)
    assert not folder.exists()


def test_a_stage_leaves_only_what_its_result_reads(spark):
    """Tables of line_dedup and minhash_dedup stayed on disk through all later stages of the pipeline."""
    rng = random.Random(18)
    base = [text(rng, 20) for _ in range(12)]
    docs = common.stored(spark.createDataFrame([(k, "\n".join([base[k % 12], text(rng, 30), base[k % 7] + " zz"])) for k in range(40)] + [(k, base[3]) for k in (40, 41)], "doc_id long, text string"))
    shared = Path(common.shared_folder(spark).removeprefix("file://"))
    tables = lambda: {x.name for x in shared.iterdir() if len(x.name) == 32}
    for stage, column in ((corpus_pipeline.lines, "text"), (corpus_pipeline.near_copies, "doc_id")):
        before = tables()
        out = stage(spark, docs, "")
        assert len(tables() - before) == 1
        assert out.select(column).distinct().count() > 30


def test_similar_lines_as_by_edit_similarity_alone(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("aeiouklmnrst") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    lines = []
    for n in [4, 6, 8, 12, 15, 20, 30, 45, 60, 100] * 8:
        w = [rng.choice(base) for _ in range(n)]
        v = list(w)
        k = rng.randrange(n)
        v[k] = rng.choice([rng.choice(base), v[k][:1] + "q" + v[k][2:]])
        lines += [" ".join(w), " ".join(v)]
    similar = [(a, b) for a, b in zip(lines[::2], lines[1::2], strict=True) if a != b and edit(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9]
    # By plain edit similarity, the second line of each such pair goes.
    gone = {b for _, b in similar}
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    dropped = {lines[r.doc_id] for r in got if r.n_dropped}
    assert dropped <= gone and len(dropped) >= 0.97 * len(gone) and len(gone) > 60


def test_numbers_are_words_of_a_line(spark):
    docs = [(1, "12 34 56\nsee page 7 now"), (2, "12 34 56\nsee page now"), (3, "12 34 56 78\nsee page 19 now"), (4, "...\n12 34 56")]
    words = spark.createDataFrame([("12 34 56",), ("a1b, 22",), ("...",)], "line string").select(line_dedup.normalised(F.col("line")).alias("w")).collect()
    assert [r.w for r in words] == [["0", "0", "0"], ["a0b", "0"], [""]]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 0.95).collect()}
    assert got == {1: docs[0][1], 2: "see page now", 3: "12 34 56 78", 4: "..."}


def test_lines_of_odd_input(odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {"doc_id", "text", "key", "n_lines", "n_dropped"}
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "one line here", "a", 5, "x"), (2, "one line here\nother", "b", 6, "y"), (None, "one line here", "c", 7, "z")], "doc_id long, text string, _gone string, _id long, id string")
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(df.withColumn("n_lines", F.lit("old"))).collect()}
    assert [(rows[k].text, rows[k]["_gone"], rows[k]["_id"], rows[k]["id"], rows[k].n_lines) for k in (1, 2, None)] == [("one line here", "a", 5, "x", 1), ("other", "b", 6, "y", 2), ("one line here", "c", 7, "z", 1)]
