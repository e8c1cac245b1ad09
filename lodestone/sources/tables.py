"""Reading and writing tables and fitted patterns."""

from __future__ import annotations

import dataclasses
import hashlib
import hmac
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.binning import ColumnBins
from lodestone.operators.mining import Fit, Item, Pattern

VERSION = 1


def read_table(spark: SparkSession, path: str, sep: str | None = None, limit: int | None = None) -> DataFrame:
    """CSV, TSV or text with tabs (header, types inferred), JSON lines, ORC or Parquet, by the ending of the path."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending in ("csv", "tsv", "txt"):
        df = spark.read.csv(path, header=True, inferSchema=True, sep=sep or ("," if ending == "csv" else "\t"))
        check_header(df.columns)
    elif ending in ("json", "jsonl"):
        df = spark.read.json(path)
    elif ending == "orc":
        df = spark.read.orc(path)
    elif ending in ("xls", "xlsx"):
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path))
    else:
        df = spark.read.parquet(path)
    return df if limit is None else df.limit(limit)


def check_header(names: Sequence[str]) -> None:
    blank = [n for n in names if not n.strip() or n.startswith("_c")]
    twice = sorted({n for n in names if sum(m.lower() == n.lower() for m in names) > 1})
    if blank or twice:
        raise ValueError(f"blank column names: {len(blank)}; repeated: {twice}")


def model_frame(df: DataFrame, target: str, drop: Sequence[str] = (), positive: str | None = None) -> DataFrame:
    """Rows with a target, without the dropped columns, and label: the target if it is 0 and 1, else 1 for the positive value (the last in order
    unless given) of two, else the rank of the value."""
    rows = df.where(F.col(target).isNotNull()).drop(*drop)
    values = sorted((str(r[0]) for r in rows.select(target).distinct().collect()))
    if len(values) < 2:
        raise ValueError(f"{target} has fewer than two classes")
    text = F.col(target).cast("string")
    if len(values) == 2 and set(values) != {"0", "1"}:
        label = (text == (positive or values[-1])).cast("int")
    else:
        order = sorted(values, key=lambda v: (0, float(v)) if v.lstrip("-").replace(".", "", 1).isdigit() else (1, v))
        label = F.lit(None).cast("int")
        for k, v in enumerate(order):
            label = F.when(text == v, k).otherwise(label)
    return rows.withColumn("label", label).drop(target)


def check_schema(df: DataFrame, columns: Sequence[str]) -> None:
    """The fitted columns have to be there, in that order."""
    found = [c for c in df.columns if c in columns]
    if found != list(columns):
        raise ValueError(f"expected the columns {list(columns)}, found {found}")


def save_fit(spark: SparkSession, fit: Fit, path: str, key: bytes | None = None) -> None:
    """A fit as one row of Parquet: its JSON, and the HMAC of that if a key is given."""
    items = {i.id: dataclasses.asdict(i) for i in fit.items}
    body = {"version": VERSION, "bins": [dataclasses.asdict(b) for b in fit.bins], "totals": fit.totals, "classes": fit.classes, "items": items,
            "patterns": [{"items": [i.id for i in p.items], "support": p.support, "utility": p.utility, "ig": p.ig, "relaxed": p.relaxed} for p in fit.patterns]}
    save_body(spark, body, path, key)


def save_body(spark: SparkSession, body: dict, path: str, key: bytes | None = None) -> None:
    """What JSON can hold as one row of Parquet, with its HMAC if a key is given."""
    text = json.dumps(body, sort_keys=True)
    mark = hmac.new(key, text.encode(), hashlib.sha256).hexdigest() if key else None
    spark.createDataFrame([(text, mark)], "model string, hmac string").coalesce(1).write.mode("overwrite").parquet(path)


def load_body(spark: SparkSession, path: str, key: bytes | None = None, most: int = 1 << 26) -> dict:
    """What save_body wrote. Its size is asked for before it is fetched, and its HMAC checked before it is read."""
    saved = spark.read.parquet(path)
    if saved.agg(F.max(F.octet_length("model"))).first()[0] > most:
        raise ValueError("the model is larger than allowed")
    r = saved.first()
    if key and not hmac.compare_digest(r["hmac"] or "", hmac.new(key, r["model"].encode(), hashlib.sha256).hexdigest()):
        raise ValueError("the model's signature doesn't match")
    return json.loads(r["model"])


def save_model(spark: SparkSession, model, path: str, key: bytes | None = None) -> None:
    """A fitted PatternClassifier with its weights."""
    save_body(spark, {"version": VERSION, "classifier": model.body()}, path, key)


def load_model(spark: SparkSession, path: str, key: bytes | None = None):
    from lodestone.operators.classifier import PatternClassifier

    body = load_body(spark, path, key)
    if body.get("version") != VERSION or "classifier" not in body:
        raise ValueError(f"not a model of version {VERSION}")
    return PatternClassifier.from_body(body["classifier"])


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV with a header, JSON lines or Parquet, by the ending of the path; written by the tasks."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending in ("csv", "tsv"):
        df.write.mode(mode).csv(path, header=True, sep="," if ending == "csv" else "\t")
    elif ending in ("json", "jsonl"):
        df.write.mode(mode).json(path)
    else:
        df.write.mode(mode).parquet(path)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet or ORC folder from its footers; of text formats by a scan without columns."""
    return read_table(spark, path).count()


def load_fit(spark: SparkSession, path: str, key: bytes | None = None, most: int = 1 << 26) -> Fit:
    body = load_body(spark, path, key, most)
    if body["version"] != VERSION:
        raise ValueError(f"version {body['version']}; this library reads {VERSION}")
    items = {int(k): Item(**v) for k, v in body["items"].items()}
    patterns = [Pattern(tuple(items[k] for k in p["items"]), p["support"], p["utility"], p["ig"], (), p["relaxed"]) for p in body["patterns"]]
    return Fit(None, [ColumnBins(**b) for b in body["bins"]], list(items.values()), body["totals"], body["classes"], patterns)
