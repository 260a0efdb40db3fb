"""JSON in and out: results of judgments, prompts, explanations, and a CSV of timings."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_KEYS = frozenset({"name", "if_any", "if_all"})


def texts(spark: SparkSession, path: str) -> list[str]:
    """Whole files of a path that only Spark need be able to read. For files of results, which are small."""
    return [r["value"] for r in spark.read.text(path, wholetext=True).collect()]


def session_results(spark: SparkSession, path: str) -> DataFrame:
    """One row (result: JSON text of an object) for each session result, of files that hold a list or an object of them.
    Entries that are no object or have no seq_key are left out; text that is no JSON has none."""
    rows = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", "array<string>")
    as_map = F.map_values(F.from_json("value", "map<string,string>"))
    listed = F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_map)
    return rows.select(F.explode(F.coalesce(listed, F.array().cast("array<string>"))).alias("result")).where(F.get_json_object("result", "$.seq_key").isNotNull())


def rules_in(node) -> Iterator[dict]:
    """Rule objects of a judged cluster, in any shape: lists, objects by cluster, ``rules`` holders, or bare rules."""
    if isinstance(node, list):
        for item in node:
            yield from rules_in(item)
    elif isinstance(node, dict) and isinstance(node.get("rules"), list):
        yield from (r for r in node["rules"] if isinstance(r, dict))
    elif isinstance(node, dict):
        for item in node.values():
            yield from rules_in(item)
        if RULE_KEYS & node.keys() and "rules" not in node:
            yield node


def cluster_rules(spark: SparkSession, path: str) -> list[dict]:
    out: list[dict] = []
    for text in texts(spark, path):
        try:
            out += rules_in(json.loads(text))
        except ValueError:
            continue
    return out


def responses(rows: list[dict]) -> list[dict]:
    """Rules of (cached) cluster responses, each an object or one with its object under ``response``."""
    return [r for row in rows for r in rules_in(row.get("response", row) if isinstance(row, dict) else row)]


def by_cluster(rows) -> dict[str, dict]:
    """cluster_id to response, of a list of rows with ``cluster_id`` or an object keyed by it."""
    if isinstance(rows, dict):
        return {str(k): v for k, v in rows.items() if isinstance(v, dict)}
    return {str(r["cluster_id"]): r.get("response", r) for r in rows if isinstance(r, dict) and "cluster_id" in r}


def write_jsons(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """One JSON object a line, and what the run was beside it under ``_meta``."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    if meta is not None:
        df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}_meta")


def append_timing(spark: SparkSession, path: str, row: dict[str, float | str]) -> None:
    """A row of timings; each append is a file of its own with a header, so rows of older columns stay readable."""
    values = [f"{v:.6f}" if isinstance(v, float) else str(v) for v in row.values()]
    spark.createDataFrame([tuple(values)], ", ".join(f"`{k}` string" for k in row)).coalesce(1).write.mode("append").option("header", True).csv(path)


def timings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All rows, with null for columns that a file lacks."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = None
    for name in sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")):
        one = spark.read.option("header", True).csv(name)
        one = one.select(*[(F.col(f"`{c}`") if c in one.columns else F.lit(None).cast("string")).alias(c) for c in columns])
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
