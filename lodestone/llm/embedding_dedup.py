"""Near-duplicate vectors with product quantisation.

Vectors are scaled to length 1 in double precision, so that cosine c and squared distance d are one: d = 2 - 2c. Coarse
centroids, fitted on a bounded sample, give inverted lists of about LIST vectors. In its list a vector is held as the code of its residual: the number of the nearest codeword in
each subspace. A query looks up the distance of its own residual to every codeword once and adds up table entries for
each code of a probed list (asymmetric distance). What is near by that estimate is ranked again by the exact cosine.

Probes: a vector y with cosine c to x is c x + s z, where z is at right angles to x. It lies in list k rather than in the list of x if that brings it nearer to
centroid k than to the own one, and s z makes a difference of about s |k - own| / sqrt(dimensions - 1). List k is probed if SPREAD times that would do. This is
a matter of chance, so some links are missed; the README has the share found. The estimate is trusted up to the error of the code, which is held beside it, so
within the probed lists nothing is missed.

Each pair is looked at once: x and y meet in the list of y if x probes that, and in the list of x if y probes that; where both hold, the list with the smaller
number decides. A found pair counts for both sides.

Scale: equal vectors are one class first. The number of lists grows with the vectors, and a query probes those near to it, so what is shipped and compared grows with the vectors too. A list is cut into blocks of bounded size, and blocks of queries meet blocks of codes, so a
list that holds a third of all vectors is many tasks. A block sends back link counts and, of its
links, a spanning forest: at most as many edges as it has vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import connected, stored, table

COSINE = 0.9
#: Vectors of the sample that centroids and codewords are fitted on (at least; 16 for each list beyond), vectors for each list, the most lists of a length,
#: vectors in a block, codewords in a subspace.
SAMPLE, LIST, LISTS, BLOCK, WORDS = 8192, 2048, 4096, 4096, 64
#: Standard deviations within which a link's other end is looked for.
SPREAD = 2.0


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[k : k + 1024], c).argmin(axis=1) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centroids and codewords of the residual's subspaces."""

    def __init__(self, x: np.ndarray, lists: int, cosine: float, parts: int):
        self.coarse = kmeans(x, lists)
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.bounds = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        self.words = [kmeans(rest[:, a:b], WORDS, seed=11) for a, b in zip(self.bounds, self.bounds[1:], strict=False)]
        self.radius, self.cosine = np.sqrt(max(0.0, 2 - 2 * cosine)), cosine
        self.apart = np.sqrt(squared(self.coarse, self.coarse))

    def encode(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([nearest(rest[:, a:b], w) for a, b, w in zip(self.bounds, self.bounds[1:], self.words, strict=False)], axis=1).astype(np.uint8)

    def errors(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The distance of each residual to what its code stands for."""
        return np.sqrt(sum(((rest[:, a:b] - w[codes[:, k]]) ** 2).sum(axis=1) for k, (a, b, w) in enumerate(zip(self.bounds, self.bounds[1:], self.words, strict=False))))

    def reach(self, errors: np.ndarray) -> np.ndarray:
        """|x - y| <= r gives |x - code(y)| <= r + |y - code(y)|, so no larger estimate can belong to a link with y. Estimates are added up in single precision, hence the 1e-4."""
        return (self.radius + errors + 1e-4) ** 2

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The own list of each vector, and which lists it probes, its own among them."""
        half = (self.coarse * self.coarse).sum(axis=1) / 2
        dots = x @ self.coarse.T
        own = (dots - half).argmax(axis=1)
        # How much nearer than the own one a vector at the threshold is to each centroid, and by how much chance may change that.
        gain = self.cosine * dots - half
        gain -= np.take_along_axis(gain, own[:, None], axis=1)
        chance = np.sqrt(max(0.0, 1 - self.cosine**2)) * self.apart[own] / np.sqrt(max(1, x.shape[1] - 1))
        # A vector nearer to x than the threshold allows may still lie beyond the border between two lists.
        nearer = dots - half
        nearer -= np.take_along_axis(nearer, own[:, None], axis=1)
        return own, np.maximum(gain, nearer) + SPREAD * chance >= 0

    def estimates(self, query_rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of codes (rows) to queries' residuals (columns), by table lookup and addition."""
        out = np.zeros((len(codes), len(query_rest)), np.float32)
        part = np.empty_like(out)
        for k, (a, b, w) in enumerate(zip(self.bounds, self.bounds[1:], self.words, strict=False)):
            np.take(squared(w, query_rest[:, a:b]).astype(np.float32), codes[:, k], axis=0, out=part, mode="clip")
            out += part
        return out


def directions(values: list) -> list[bytes | None]:
    """Each vector scaled to length 1, as bytes; None for what links with nothing. Vectors of one direction give equal bytes as far as rounding to 1e-12 allows."""
    out = []
    for v in values:
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        if x is None or not len(x) or not np.isfinite(x).all() or not np.abs(x).max() > 0:
            out.append(None)
            continue
        x = x / np.abs(x).max()
        out.append((x / np.sqrt((x * x).sum())).tobytes())
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, parts: int = 16) -> DataFrame:
    """Links and groups of vectors by cosine.

    vectors: vec_id (integer) and embedding (array of numbers); other columns are left out. Returns a row for each row: vec_id,
    n_links (other vectors with a cosine of at least `cosine`), component_id (the smallest vec_id in reach), kept (vec_id =
    component_id). Null, empty and zero vectors and ones with null or non-finite components link with nothing, nor do vectors of different lengths; a row
    with a null vec_id takes no part and gets 0 links. Rows with equal vectors link with each other. A vec_id ought to be unique: rows that share one are each
    linked by their own vector. An empty table gives an empty table.
    """
    data = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def scale(batches):
        for batch in batches:
            unit = directions(batch["embedding"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(unit, pa.binary())], ["vec_id", "unit"])

    scaled = stored(data.mapInArrow(scale, "vec_id long, unit binary"))
    valid = scaled.where("unit is not null and vec_id is not null")
    # Equal vectors meet by their bytes' hash; the smallest vec_id stands for them.
    classes = stored(valid.groupBy(F.sha2("unit", 256).alias("key")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    node = F.xxhash64("key")  # of a class, so that rows that share a vec_id are not mixed up
    # Vectors link with those of their own length only, so each length has a quantiser, fitted on its share of the sample, or on a few vectors if that has none.
    lengths = {r["size"] // 8: r["n"] for r in classes.groupBy(F.octet_length("unit").alias("size")).agg(F.count("*").alias("n")).collect()}
    lists = {k: max(1, min(LISTS, n // LIST)) for k, n in lengths.items()}
    share = min(1.0, max(SAMPLE, 16 * sum(lists.values())) / max(1, sum(lengths.values())))
    samples = {}
    for r in sorted(classes.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) < share * float(1 << 30)).select("key", "unit").collect()):
        samples.setdefault(len(r[1]) // 8, []).append(r[1])
    missing = [8 * k for k in lengths if k not in samples]
    if missing:
        for r in classes.where(F.octet_length("unit").isin(missing)).groupBy(F.octet_length("unit").alias("size")).agg(F.min("unit").alias("unit")).collect():
            samples[r["size"] // 8] = [r["unit"]]
    quantisers = {k: Quantiser(np.array([np.frombuffer(u, np.float64) for u in samples[k]]), lists[k], cosine, parts) for k in lengths}

    def dealt(batches):
        """A row for each list that a vector probes: in its own list it is held, with its code, and asks; elsewhere it asks."""
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                unit, size = part["unit"], pc.binary_length(part["unit"]).to_numpy(zero_copy_only=False)
                for width in np.unique(size).tolist():
                    q, good = quantisers[width // 8], np.flatnonzero(size == width)
                    x = np.frombuffer(b"".join(unit.take(pa.array(good)).to_pylist()), np.float64).reshape(len(good), -1)
                    own, probes = q.probed(x)
                    rest = x - q.coarse[own]
                    codes = q.encode(rest)
                    errors = q.errors(rest, codes)
                    row, at = np.nonzero(probes)
                    # What a vector probes travels as bits, so that the other side can tell which of two lists decides.
                    bits = np.packbits(probes, axis=1)
                    held = own[row] == at
                    of = pa.array(good[row])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(row), width // 8)), pa.array(at), pa.array(held), part["rep"].take(of), part["copies"].take(of), unit.take(of),
                        pa.array([errors[i].tobytes() + codes[i].tobytes() if h else None for i, h in zip(row.tolist(), held.tolist(), strict=True)], pa.binary()),
                        pa.array(own[row]), pa.array([bits[i].tobytes() for i in row.tolist()], pa.binary()),
                    ], ["width", "list", "held", "rep", "copies", "unit", "code", "own", "probes"])

    def search(key, t):
        return _search(quantisers[t["width"][0].as_py()], cosine, key[1].as_py(), t)

    if not quantisers:
        found = scaled.sparkSession.createDataFrame([], "a long, b long, n long")
    else:
        rows = classes.select(node.alias("rep"), "copies", "unit").mapInArrow(dealt, "width long, list long, held boolean, rep long, copies long, unit binary, code binary, own long, probes binary")
        if max(lengths.values()) > BLOCK:
            rows = stored(rows)
            sizes = rows.groupBy("width", "list").agg(F.ceil(F.sum(F.col("held").cast("int")) / BLOCK).alias("cb"), F.ceil(F.count("*") / BLOCK).alias("qb"))
            cut = rows.join(F.broadcast(sizes.where("cb > 0")), ["width", "list"])  # a row for each list: at most LISTS of a length
        else:
            cut = rows.withColumn("cb", F.lit(1).cast("long")).withColumn("qb", F.lit(1).cast("long"))
        # A held vector's codes go to every block of queries in its list, and it asks, as visitors do, in every block of codes. Blocks q of queries and c of codes meet once.
        number = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks))
        every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
        asks = cut.select("width", "list", number("qb").alias("q"), every("cb").alias("c"), "held", "rep", "copies", "unit", F.lit(None).cast("binary").alias("code"), "own", "probes")
        codes = cut.where("held").select("width", "list", every("qb").alias("q"), number("cb").alias("c"), "held", "rep", "copies", "unit", "code", "own", "probes")
        found = stored(asks.unionByName(codes).groupBy("width", "list", "q", "c").applyInArrow(search, "a long, b long, n long"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    groups = stored(connected(found.where("b is not null").select("a", "b")))
    named = classes.select("key", "rep", "copies", node.alias("node"))
    smallest = groups.join(named, "node").groupBy("component").agg(F.min("rep").alias("smallest"))
    reps = named.join(counts, "node", "left").join(groups.join(smallest, "component").select("node", "smallest"), "node", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "rep").alias("component_id"))
    keyed = scaled.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.sha2("unit", 256)))
    out = keyed.join(reps, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, fewer than n, that join the same of n nodes as the edges (u, v) do: each node that isn't the smallest of its group with that one."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    other = np.flatnonzero(label != np.arange(n))
    return other, label[other]


def _search(q: Quantiser, cosine: float, number: int, t: pa.Table) -> pa.Table:
    """The links between the rows that ask and those with a code, in the list of that number, as counts (a, n) and as edges of a forest (a, b)."""
    has_code = ~np.array(pc.is_null(t["code"]))
    asking, held = np.flatnonzero(~has_code), np.flatnonzero(has_code)
    if not len(asking) or not len(held):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    rep, copies, own = (t[c].to_numpy() for c in ("rep", "copies", "own"))
    x = np.frombuffer(b"".join(t["unit"].to_pylist()), np.float64).reshape(len(t), -1)
    probes = np.unpackbits(np.frombuffer(b"".join(t["probes"].to_pylist()), np.uint8).reshape(len(t), -1), axis=1).astype(bool)
    packed = t["code"].take(pa.array(held)).to_pylist()
    codes = np.frombuffer(b"".join(c[8:] for c in packed), np.uint8).reshape(len(held), -1)
    reach = q.reach(np.frombuffer(b"".join(c[:8] for c in packed), np.float64))
    count, edges = np.zeros(len(t), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for home in np.unique(own[asking]).tolist():
        # A visitor's pair is looked at here, unless the visitor's own list is probed by the held one and has a smaller number.
        here = np.arange(len(held)) if home >= number else np.flatnonzero(~probes[held, home])
        of = asking[own[asking] == home]
        for k in range(0, len(of) if len(here) else 0, 256):
            i = of[k : k + 256]
            col, row = np.nonzero(q.estimates(x[i] - q.coarse[number], codes[here]) <= reach[here, None])
            u, v = i[row], held[here[col]]
            if home == number:  # a pair within the list is taken in one order
                u, v = u[rep[u] < rep[v]], v[rep[u] < rep[v]]
            exact = np.concatenate([np.zeros(0), *((x[u[j : j + 65536]] * x[v[j : j + 65536]]).sum(axis=1) for j in range(0, len(u), 65536))])
            u, v = u[exact >= cosine], v[exact >= cosine]
            np.add.at(count, u, copies[v])
            np.add.at(count, v, copies[u])
            edges.append(forest(len(t), u, v))
    s, e = forest(len(t), *(np.concatenate(c) for c in zip(*edges, strict=True)))
    some = np.flatnonzero(count)
    a, b, n = np.r_[rep[some], rep[s]], np.r_[np.zeros(len(some), np.int64), rep[e]], np.r_[count[some], np.zeros(len(s), np.int64)]
    edge = np.arange(len(a)) >= len(some)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=~edge), "n": pa.array(n, pa.int64(), mask=edge)})


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
