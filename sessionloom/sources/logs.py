"""Log sources: the driver's ``events`` table, and readers for structured HDFS, BGL and Liberty CSV logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import scalars as S


def events(spark: SparkSession, sf_dir: str, bucket: int = 604_800) -> DataFrame:
    """log_lines of the events table: line_id, host, ts_sec, eid, anom, sk."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = e.select(F.col("event_id").alias("line_id"), F.col("user_id").cast("string").alias("host"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_sec"), F.concat_ws("_", "event_type", F.least(F.floor(F.col("value") / 50), F.lit(5)).cast("string")).alias("eid"), (F.col("value") > 200).cast("int").alias("anom"))
    return lines.withColumn("sk", S.bucket_key(F.col("host"), F.col("ts_sec"), bucket))


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; an empty field is '' and not null."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    schema = StructType([StructField(c, StringType()) for c in df.columns])
    df = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns]).withColumn("line_id", F.monotonically_increasing_id())  # grows with the place in the file


def _whole(column: str) -> Column:
    """A number in a text, without its fraction; null if it is none."""
    return F.expr(f"try_cast(try_cast(trim(`{column}`) as double) as bigint)")


def hdfs(spark: SparkSession, path: str, labels: str) -> DataFrame:
    raw = _csv(spark, path, ["Content", "EventId", "EventTemplate"])
    y = _csv(spark, labels, ["BlockId", "Label"]).select(F.col("BlockId").alias("sk"), (F.col("Label") == "Anomaly").cast("int").alias("y")).dropDuplicates(["sk"])
    lines = raw.withColumn("sk", S.block_id(F.col("Content"))).where("sk <> ''").join(y, "sk", "left")
    return lines.select("line_id", F.lit(0).cast("long").alias("ts_sec"), "sk", F.col("EventId").alias("eid"), F.col("EventTemplate").alias("template"), F.coalesce("y", F.lit(0)).alias("anom"))


def bgl(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, ["EventId", "EventTemplate"])
    key = next((c for c in ("Node", "NodeRepeat") if c in raw.columns), None)
    if key is None:
        raise ValueError(f"{path} has neither Node nor NodeRepeat")
    anom: Column = (F.col("Label") != "-") if "Label" in raw.columns else F.col("Level").rlike("(?i)ERROR|SEVERE|FATAL") if "Level" in raw.columns else F.lit(False)
    ts = _whole("Timestamp") if "Timestamp" in raw.columns else F.lit(None).cast("long")
    return raw.select("line_id", ts.alias("ts_sec"), F.col(key).alias("sk"), F.col("EventId").alias("eid"), F.col("EventTemplate").alias("template"), anom.cast("int").alias("anom"))


def liberty(spark: SparkSession, path: str, bucket: int = 600, ids: str = "log") -> DataFrame:
    """Sessions of a host in ``bucket`` seconds. ``ids``: the line, or ``label_token``, whose dictionary is that of
    ``sequences.templates(..., by_name=True)``."""
    raw = _csv(spark, path, ["ts", "Label", "log", "LabelToken"])
    ts = F.coalesce(_whole("ts"), F.lit(0)).cast("long")
    eid = F.col("log") if ids == "log" else F.col("LabelToken")
    return raw.select("line_id", ts.alias("ts_sec"), S.bucket_key(S.host(F.col("log")), ts, bucket).alias("sk"), eid.alias("eid"), eid.alias("template"), F.col("log").alias("raw"), F.coalesce(_whole("Label") == 1, F.lit(False)).cast("int").alias("anom"))


READERS: dict[str, Callable[..., DataFrame]] = {"HDFS": hdfs, "BGL": bgl, "LIBERTY": liberty, "THUNDERBIRD": bgl, "TBD": bgl, "TBIRD": bgl, "SPIRIT": bgl, "EVENTS": events}


def load(spark: SparkSession, dataset: str, *args, **more) -> DataFrame:
    if dataset.upper() not in READERS:
        raise ValueError(f"unknown dataset {dataset}; known: {sorted(READERS)}")
    return READERS[dataset.upper()](spark, *args, **more)
