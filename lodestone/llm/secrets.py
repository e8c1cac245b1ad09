"""Secret scanning with a random forest against false positives, in DataFrame operations alone.

Candidates are long runs of key characters with a digit, and values assigned to a name that tells a secret. The forest sees their
length, changes of character class, coverage by a dictionary, the path and the neighbouring words. It is trained from labelled findings and then
compiled into one SQL expression, so that scoring is a projection: no shuffle, and nothing leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

_NAME = "(?:secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?"
_ASSIGNED = rf"(?i:\b[\w.-]{{0,24}}{_NAME}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)[^\s\"',;<>(){{}}]{{6,}}"
_RUN = r"(?<![\w+/=-])(?=[\w+/=-]*[0-9])[A-Za-z0-9_+/=-]{16,}"
CANDIDATE = f"{_RUN}|{_ASSIGNED}"
#: Characters of the text on either side that neighbouring words are looked for in.
NEAR = 48
DICTIONARY = (
    "account address admin api app auth build button cache change class client cloud code common config content control count create "
    "current data database date debug default delete demo dev device digest doc down dummy email enter error event example fake field file fix folder "
    "form function get group hash header hello here home http id image index info input insert item key lang level line link list local log login main "
    "manage map master me message meta method mode model module my name new node null number object open option order page param parent pass path "
    "placeholder point post private process product profile project public put query read release remote replace report request response result root row "
    "sample save secret secure select sequence server service session set setting some start state status string style system table tag target task temp template "
    "test text the this time title token tool total tree type update upload url use user value variable version view web word work world write xxx year your"
).split()
_WORDS = "|".join(sorted(DICTIONARY, key=len, reverse=True))

FEATURES = {
    "length": "least(char_length(v), 200)",
    "digits": "regexp_count(v, '[0-9]') / char_length(v)",
    "upper": "regexp_count(v, '[A-Z]') / char_length(v)",
    "lower": "regexp_count(v, '[a-z]') / char_length(v)",
    "changes": "char_length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[a-z]+', 'a'), '[A-Z]+', 'B'), '[0-9]+', '1'), '[^aB1]+', '_')) / char_length(v)",
    "distinct": "size(array_distinct(split(v, ''))) / least(char_length(v), 64)",
    "hex": r"cast(v rlike '^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$' as int)",
    "uuid": r"cast(v rlike '^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$' as int)",
    "repeats": r"cast(v rlike '(.)\\1{4,}' as int)",
    "runs": "cast(lower(v) rlike '01234|12345|abcdef|qwerty' as int)",
    "dictionary": f"1 - char_length(regexp_replace(lower(v), '{_WORDS}', '')) / char_length(v)",
    "assigned": r"""cast(before rlike '[:=]\\s*["\\\']?$' as int)""",
    "named": f"cast(lower(before) rlike '{_NAME}|bearer|auth' as int)",
    "digest": r"cast(lower(concat(before, ' ', after)) rlike '\\b(?:sha-?\\d*|md5|commit|checksum|digest|uuid|guid|revision|etag|build|hash)\\b' as int)",
    "sample": "cast(lower(concat(before, ' ', after)) rlike 'example|sample|dummy|placeholder|changeme|fake|redacted' as int)",
    "test_path": "cast(lower(path) rlike 'test|spec|example|fixture|mock|docs?/' as int)",
    "config_path": r"cast(lower(path) rlike '\\.(?:env|cfg|conf|ini|pem|key|ya?ml|json|properties|tf)$' as int)",
}


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start (in characters), v, before, after and path for each candidate; path is the name of a column of docs, if any."""
    text, key = F.col("text"), F.lit(CANDIDATE)
    found = docs.select("doc_id", text, (F.col(path) if path else F.lit("")).alias("path")).withColumn("m", F.regexp_extract_all("text", key, F.lit(0))).where(F.size("m") > 0)
    cut = found.withColumn("gaps", F.split("text", CANDIDATE, -1)).select("doc_id", "path", "gaps", F.posexplode("m").alias("k", "m0"), "m")
    before = F.aggregate(F.slice("gaps", 1, F.col("k") + 1), F.lit(0), lambda n, x: n + F.char_length(x)) + F.aggregate(F.slice("m", 1, F.col("k")), F.lit(0), lambda n, x: n + F.char_length(x))
    assigned = F.regexp_extract("m0", f"^{_ASSIGNED[: _ASSIGNED.index('[^')]}({_ASSIGNED[_ASSIGNED.index('[^') :]})$", 1)
    v = F.when(assigned != "", assigned).otherwise(F.col("m0"))
    head = F.expr("substring(m0, 1, char_length(m0) - char_length(v))")
    out = cut.withColumn("v", v).withColumn("head", head)
    return out.select("doc_id", (before + F.char_length("head")).cast("long").alias("start"), "v", F.concat(F.expr(f"right(get(gaps, k), {NEAR})"), "head").alias("before"), F.expr(f"left(get(gaps, k + 1), {NEAR})").alias("after"), F.coalesce("path", F.lit("")).alias("path"))


def featured(found: DataFrame) -> DataFrame:
    return found.select("*", *(F.expr(x).cast("double").alias(f"f_{k}") for k, x in FEATURES.items()))


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """A labelled set made from rules: v, before, after, path and label (1 for a secret). For one's own, give the same columns."""
    i = "cast(id as string)"
    hexes = [f"md5({i})", f"sha1({i})", f"sha2({i}, 256)", f"upper(sha1({i}))"]
    keys = [f"substring(base64(unhex(sha2({i}, 256))), 1, {n})" for n in (20, 28, 36, 43)] + [f"concat('sk_live_', substring(base64(unhex(sha1({i}))), 1, 24))", f"concat('AKIA', upper(substring(sha1({i}), 1, 16)))", f"concat(substring(md5({i}), 1, 6), '!', upper(substring(sha1({i}), 3, 5)))"]
    fakes = ["concat('your_api_key_here_', id % 97)", "concat(repeat('x', 16 + id % 20), '0')", "repeat('0', 16 + id % 24)", "concat('changeme', 12345 + id % 7)", "concat('EXAMPLE_TOKEN_VALUE_', id % 89)", "concat('test_user_password_', id % 50)", "concat('abcdefghijklmnop', 1234 + id % 9)", "concat('<insert-secret-', id % 9, '>')"]
    plain = ["concat('user_profile_settings_', id % 999)", "cast(20200101000000000 + id * 7919 as string)", "concat('image_upload_', id, '_version_2')", f"concat_ws('-', substring(md5({i}), 1, 8), substring(md5({i}), 9, 4), substring(md5({i}), 13, 4), substring(md5({i}), 17, 4), substring(md5({i}), 21, 12))", "concat('/home/data/file_', id, '/index')"]
    named = ["token = \"", "password: ", "API_KEY=", "secret_key = '", "access_key: \"", "passwd=", "Authorization: Bearer "]
    digest = ["commit ", "sha256: ", "md5 ", "checksum = ", "etag: \"", "revision ", "build hash "]
    other = ["see ", "open ", "id ", "the ", "", "name = \""]
    quote = lambda xs: "element_at(array(" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in xs) + f"), cast(pmod(xxhash64(id, {len(xs)}), {len(xs)}) + 1 as int))"
    pick = lambda xs, salt: f"element_at(array({', '.join(xs)}), cast(pmod(xxhash64(id, {salt}), {len(xs)}) + 1 as int))"
    kinds = [(pick(hexes + keys, 11), quote(named), 1), (pick(keys[4:6], 12), quote(other), 1), (pick(hexes, 13), quote(digest), 0), (pick(fakes, 14), quote(named), 0), (pick(plain, 15), quote(other), 0), (pick(plain, 16), quote(digest), 0)]
    case = lambda n: "case id % 6 " + " ".join(f"when {k} then {x[n]}" for k, x in enumerate(kinds)) + " end"
    paths = ["src/app/main.py", "config/prod.env", "deploy/values.yaml", "web", "", "lib/util.go"]
    path = f"case when id % 6 in (2, 3, 4) and id % 5 = 0 then 'tests/fixtures/data.json' else {quote(paths)} end"
    return spark.range(rows).selectExpr(f"{case(0)} as v", f"concat('word then ', {case(1)}) as before", "'\" and so on' as after", f"{path} as path", f"{case(2)} as label")


class Forest:
    """A random forest as a SQL expression: the share of trees that vote for a secret."""

    def __init__(self, findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        names = [f"f_{k}" for k in FEATURES]
        data = VectorAssembler(inputCols=names, outputCol="features").transform(featured(findings)).select("features", F.col("label").cast("double").alias("label"))
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(data)
        self.sql = "(" + " + ".join(_as_sql(t.toDebugString.splitlines()[1:], names) for t in model.trees) + f") / {len(model.trees)}.0D"

    def score(self) -> Column:
        return F.expr(self.sql)


def _as_sql(lines: list[str], names: list[str]) -> str:
    """A tree's printed form as nested conditions."""
    line = lines.pop(0).strip()
    if m := re.match(r"Predict: ([\d.]+)", line):
        return f"{float(m[1])}D"
    feature, threshold = re.match(r"If \(feature (\d+) <= (.+)\)", line).groups()
    yes = _as_sql(lines, names)
    lines.pop(0)
    return f"if({names[int(feature)]} <= {float(threshold)!r}D, {yes}, {_as_sql(lines, names)})"


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Candidates with their scores: doc_id, start, v (the text of the candidate), before, after, score, secret (score >= threshold).

    docs: doc_id and text, and a column with the path if its name is given; other columns are left out. findings: labelled
    findings to train from, by default the ones made from rules. A null or empty text has no candidates; a document has a row for each,
    in no order, and a row given twice gives them twice. Texts are read whole; an empty table gives an empty table.
    """
    forest = Forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    out = featured(candidates(docs, path)).withColumn("score", forest.score())
    return out.select("doc_id", "start", "v", "before", "after", "score", (F.col("score") >= threshold).alias("secret"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), path="source")
    return out.select("doc_id", "start", F.char_length("v").cast("long").alias("length"), F.sha2(F.col("v").cast("binary"), 256).alias("v_sha256"), F.round("score", 6).alias("score"), "secret")
