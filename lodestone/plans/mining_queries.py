"""Queries on discretisation and mining, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import binning, mining
from lodestone.sources.frames import FRAMES, frame

THREE = ("l_quantity", "l_discount", "l_tax")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def long_sql(name: str, columns: Sequence[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS col, {k} AS pos, CAST({c} AS DOUBLE) AS x, label FROM f" for k, c in enumerate(columns))
    return f"f AS ({FRAMES[name]}), wide AS ({rows})"


def items_sql(name: str, columns: Sequence[str], bins: int) -> str:
    """Common tables up to i: id, col, pos, code, pattern, iu, support, riu, ig."""
    q = ", ".join(str(k / bins) for k in range(bins + 1))
    return f"""{long_sql(name, columns)},
s AS (SELECT col, min(x) AS lo, max(x) - min(x) AS span FROM wide GROUP BY col),
z AS (SELECT col, pos, (x - lo) / span AS x, label FROM wide JOIN s USING (col)),
e AS (SELECT col, list_sort(list_distinct(quantile_cont(x, [{q}]))) AS e FROM z GROUP BY col),
c AS (SELECT col, pos, label, CASE WHEN x IS NULL THEN NULL ELSE len(list_filter(e[2:len(e) - 1], lambda v: x >= v)) END AS code FROM z JOIN e USING (col)),
r AS (SELECT col, coalesce(corr(code, label), 0) AS r FROM c WHERE code IS NOT NULL GROUP BY col),
t AS (SELECT label, count(*) AS n FROM f GROUP BY label),
h AS (SELECT col, pos, code, label, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY ALL),
k AS (SELECT DISTINCT col, pos, code FROM h),
g AS (SELECT k.col, k.pos, k.code, t.label, coalesce(h.n, 0) AS a, t.n - coalesce(h.n, 0) AS b, t.n AS n FROM k CROSS JOIN t LEFT JOIN h ON h.col = k.col AND h.code = k.code AND h.label = t.label),
m AS (SELECT col, pos, code, sum(a) AS support, CASE WHEN sum(b) = 0 THEN NULL ELSE
        -sum(n * ln(n / nn)) / nn + sum(CASE WHEN a > 0 THEN a * ln(a / sa) ELSE 0 END) / nn + sum(CASE WHEN b > 0 THEN b * ln(b / sb) ELSE 0 END) / nn END AS ig
      FROM (SELECT *, sum(a) OVER w AS sa, sum(b) OVER w AS sb, sum(n) OVER w AS nn FROM g WINDOW w AS (PARTITION BY col, code)) GROUP BY col, pos, code, nn),
u AS (SELECT m.*, abs(r) * CASE WHEN r < 0 THEN e[len(e) - code] ELSE e[code + 2] END / e[len(e)] AS eiu,
        m.col || '=[' || printf('%.4g', lo + span * e[code + 1]) || ',' || printf('%.4g', lo + span * e[code + 2]) || ')' AS pattern
      FROM m JOIN r USING (col) JOIN e USING (col) JOIN s USING (col)),
i AS (SELECT row_number() OVER (ORDER BY pos, code) AS id, col, pos, code, pattern, round(eiu / max(eiu) OVER (), 6) AS iu, support,
        round(support * round(eiu / max(eiu) OVER (), 6), 9) AS riu, ig FROM u WHERE eiu > 0)"""


def l1_sql(name: str, columns: Sequence[str], bins: int, top: int, least: float) -> str:
    return f"""WITH {items_sql(name, columns, bins)},
cut AS (SELECT min(riu) AS floor FROM (SELECT riu FROM i ORDER BY riu DESC LIMIT {top}))
SELECT pattern, CAST(1 AS INT) AS length, CAST(support AS BIGINT) AS support, round(riu, 6) AS utility, round(ig, 6) AS ig
FROM i, cut WHERE riu >= floor AND riu > 0 AND ig > {least} ORDER BY riu DESC, id DESC LIMIT {top}"""


def l2_sql(name: str, columns: Sequence[str], bins: int, top: int, least: float) -> str:
    edges = ", ".join(f"(SELECT e FROM e WHERE col = '{c}') AS e_{c}, (SELECT lo FROM s WHERE col = '{c}') AS lo_{c}, (SELECT span FROM s WHERE col = '{c}') AS span_{c}" for c in columns)
    code = lambda c: f"CASE WHEN {c} IS NULL THEN NULL ELSE len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda v: (CAST({c} AS DOUBLE) - lo_{c}) / span_{c} >= v)) END"
    codes = ", ".join(f"{code(c)} AS c{k}" for k, c in enumerate(columns))
    held = " UNION ALL ".join(f"SELECT tid, label, n, {k} AS pos, c{k} AS code FROM tx" for k in range(len(columns)))
    names = ", ".join(f"c{k}" for k in range(len(columns)))
    return f"""WITH {items_sql(name, columns, bins)},
ed AS (SELECT {edges}),
tx AS (SELECT row_number() OVER (ORDER BY {names}, label) AS tid, * FROM (SELECT {names}, label, count(*) AS n FROM (SELECT {codes}, label FROM f, ed) GROUP BY ALL)),
occ AS (SELECT tid, label, n, i.* EXCLUDE (code, pos) FROM ({held}) AS o JOIN i ON i.pos = o.pos AND i.code = o.code),
tw AS (SELECT id, round(sum(n * tu), 6) AS twu FROM (SELECT *, sum(iu) OVER (PARTITION BY tid) AS tu FROM occ) GROUP BY id),
cut AS (SELECT min(riu) AS floor FROM (SELECT riu FROM i ORDER BY riu DESC LIMIT {top})),
ok AS (SELECT occ.*, twu FROM occ JOIN tw USING (id), cut WHERE ig > {least} AND twu >= floor),
p AS (SELECT x.id AS a, y.id AS b, x.label, x.tid, x.n, x.iu + y.iu AS w, x.pattern || ' & ' || y.pattern AS pattern, x.twu AS ta, y.twu AS tb
      FROM ok x JOIN ok y ON x.tid = y.tid AND x.col <> y.col AND (x.twu < y.twu OR x.twu = y.twu AND x.id < y.id)),
pc AS (SELECT a, b, pattern, ta, tb, any_value(w) AS w, sum(n) AS support, md5(string_agg(tid, ',' ORDER BY tid)) AS cover FROM p GROUP BY a, b, pattern, ta, tb),
pg AS (SELECT pc.a, pc.b, t.label, coalesce(sum(p.n), 0) AS k, t.n - coalesce(sum(p.n), 0) AS o, t.n FROM pc CROSS JOIN t LEFT JOIN p ON p.a = pc.a AND p.b = pc.b AND p.label = t.label GROUP BY pc.a, pc.b, t.label, t.n),
pi AS (SELECT a, b, CASE WHEN sum(o) = 0 THEN NULL ELSE -sum(n * ln(n / nn)) / nn + sum(CASE WHEN k > 0 THEN k * ln(k / sk) ELSE 0 END) / nn + sum(CASE WHEN o > 0 THEN o * ln(o / so) ELSE 0 END) / nn END AS ig
       FROM (SELECT *, sum(k) OVER w AS sk, sum(o) OVER w AS so, sum(n) OVER w AS nn FROM pg WINDOW w AS (PARTITION BY a, b)) GROUP BY a, b, nn),
pairs AS (SELECT * FROM (SELECT pc.*, pi.ig, row_number() OVER (PARTITION BY a, support, cover ORDER BY tb, b) AS nth FROM pc JOIN pi USING (a, b) WHERE pi.ig > {least}) WHERE nth = 1),
ones AS (SELECT id, md5(string_agg(tid, ',' ORDER BY tid)) AS cover FROM occ GROUP BY id),
found AS (SELECT pattern, 1 AS length, support, riu AS utility, ig, twu AS t1, i.id AS a, 0 AS b, cover FROM i JOIN tw USING (id) JOIN ones USING (id), cut WHERE riu >= floor AND riu > 0 AND ig > {least}
          UNION ALL SELECT pattern, 2, support, round(support * w, 9), ig, ta, a, b, cover FROM pairs, cut WHERE round(support * w, 9) >= floor),
best AS (SELECT * FROM found ORDER BY utility DESC, t1 DESC, a DESC, b DESC LIMIT {top}),
one AS (SELECT *, row_number() OVER (PARTITION BY cover ORDER BY round(ig, 9) DESC, utility DESC, a, b) AS nth FROM best)
SELECT pattern, CAST(length AS INT) AS length, CAST(support AS BIGINT) AS support, round(utility, 6) AS utility, round(ig, 6) AS ig FROM one WHERE nth = 1"""


def mined(name: str, columns: Sequence[str] = THREE, bins: int = 5, top: int = 10, length: int = 1, least: float = 1e-3, relaxed: Sequence[str] = (), adaptive: bool = False) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = frame(spark, sf_dir, name)
        made = binning.fit_adaptive(df, columns) if adaptive else binning.fit_fixed(df, columns, bins)
        return mining.table_of(spark, mining.mine(mining.prepare(df, made), top, length, least, relaxed))

    return query


for _name, _frame in (("mine_l1_fixed", "score_hi"), ("mine_l1_multiclass", "multi3"), ("mine_l1_missing", "missing"), ("mine_l1_no_signal", "null_signal")):
    QUERIES[_name], SQL[_name] = mined(_frame), l1_sql(_frame, THREE, 5, 10, 1e-3)
for _name, _frame in (("mine_l2_fixed", "score_hi"), ("mine_l2_interaction", "xor2"), ("mine_l2_multiclass", "multi3")):
    QUERIES[_name], SQL[_name] = mined(_frame, bins=3, top=15, length=2), l2_sql(_frame, THREE, 3, 15, 1e-3)
QUERIES["mine_l1_adaptive"] = mined("score_hi", adaptive=True)
QUERIES["mine_l3_fixed"] = mined("score_hi", bins=3, top=30, length=3)
QUERIES["mine_any_length"] = mined("score_cat", ("l_quantity", "l_discount", "l_returnflag"), bins=3, top=40, length=0, least=1e-6)
QUERIES["mine_l2_relaxed"] = mined("xor2", bins=4, top=10, length=2, relaxed=("l_quantity", "l_discount"))


def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "score_hi")
    rows = [(b.name, k, round(b.low + b.span * e, 6)) for b in binning.fit_fixed(df, THREE, 5) for k, e in enumerate(b.edges)]
    return spark.createDataFrame(rows, "col string, k int, edge double")


QUERIES["quantile_edges"] = quantile_edges
SQL["quantile_edges"] = f"""WITH {long_sql("score_hi", THREE)},
e AS (SELECT col, list_sort(list_distinct(quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM wide GROUP BY col)
SELECT col, CAST(k - 1 AS INT) AS k, round(e[k], 6) AS edge FROM (SELECT col, e, unnest(range(1, len(e) + 1)) AS k FROM e)"""


def adaptive_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains, _ = binning.gains_by_bins(frame(spark, sf_dir, "score_hi"), THREE)
    return spark.createDataFrame([(c, b, round(g, 6)) for c, by in gains.items() for b, g in by.items()], "col string, bins int, gain double")


QUERIES["adaptive_gains"] = adaptive_gains
SQL["adaptive_gains"] = f"""WITH {long_sql("score_hi", THREE)},
ranked AS (SELECT col, x, label, row_number() OVER (PARTITION BY col ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY col) AS n FROM wide WHERE x IS NOT NULL),
cand AS (SELECT unnest([2, 3, 5, 7, 10, 15]) AS b),
places AS (SELECT col, b, round_even(i / b * (n - 1), 0) AS r FROM (SELECT DISTINCT col, n FROM ranked), (SELECT b, unnest(range(0, b + 1)) AS i FROM cand)),
edges AS (SELECT col, b, list_sort(list_distinct(list(x))) AS e FROM places JOIN ranked USING (col, r) GROUP BY col, b),
h AS (SELECT col, b, code, label, sum(k) AS n FROM (SELECT col, b, len(list_filter(e[2:len(e) - 1], lambda v: x >= v)) AS code, label, k FROM (SELECT col, x, label, count(*) AS k FROM ranked GROUP BY ALL) JOIN edges USING (col)) GROUP BY ALL),
g AS (SELECT col, b, code, n, sum(n) OVER (PARTITION BY col, b, code) AS s, sum(n) OVER (PARTITION BY col, b) AS t FROM h),
inner_h AS (SELECT col, b, sum(-n / t * log2(n / s + 1e-12)) AS hin FROM g GROUP BY col, b),
outer_h AS (SELECT col, sum(-n / t * log2(n / t + 1e-12)) AS hout FROM (SELECT col, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY col) AS t FROM ranked GROUP BY col, label) GROUP BY col)
SELECT col, b AS bins, round(hout - hin, 6) AS gain FROM inner_h JOIN outer_h USING (col)"""


def bin_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of label 1 in each bin of each column."""
    df = frame(spark, sf_dir, "score_hi")
    bins = binning.fit_fixed(df, THREE, 5)
    coded = binning.apply_bins(df, bins)
    cells = F.array(*(F.struct(F.lit(b.name).alias("col"), F.col(f"code_{b.name}").alias("code")) for b in bins))
    return coded.select("label", F.explode(cells).alias("c")).groupBy("c.col", "c.code").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("share"))


QUERIES["bin_profile"] = bin_profile
SQL["bin_profile"] = f"WITH {items_sql('score_hi', THREE, 5)} SELECT col, CAST(code AS INT) AS code, count(*) AS n, round(avg(label), 6) AS share FROM c GROUP BY col, code"


def pattern_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each mined pattern covers, by the pattern matrix."""
    df = frame(spark, sf_dir, "score_hi")
    fit = mining.prepare(df, binning.fit_fixed(df, THREE, 3))
    found = mining.mine(fit, 15, 2, 1e-3)
    sums = mining.pattern_columns(df, fit).agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(len(found))))
    parts = F.array(*(F.struct(F.lit(p.name).alias("pattern"), F.col(f"p{k}").cast("long").alias("support")) for k, p in enumerate(found)))
    return sums.select(F.explode(parts).alias("x")).select("x.*")


QUERIES["pattern_support"] = pattern_support
SQL["pattern_support"] = f"SELECT pattern, support FROM ({l2_sql('score_hi', THREE, 3, 15, 1e-3)})"
