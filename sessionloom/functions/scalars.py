"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_id(content: Column) -> Column:
    return F.regexp_extract(content, r"(blk_-?\d+)", 1)


def host(log: Column) -> Column:
    """The second of the white-space separated tokens, else GLOBAL."""
    return F.coalesce(F.nullif(F.try_element_at(F.split(F.trim(log), r"\s+", 4), F.lit(2)), F.lit("")), F.lit("GLOBAL"))


def bucket_key(host_col: Column, ts_sec: Column, seconds: int) -> Column:
    return F.concat_ws("::", host_col, F.floor(ts_sec / seconds).cast("string"))


def lift(ca: Column, cn: Column) -> Column:
    return (ca + 1.0) / (cn + 1.0)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
