"""Optional extension: rules over bucketed sessions of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(host, ts, line_id, row_id) to sequences of tumbling windows, closed by the watermark."""
    per = stream.withWatermark("ts", late).groupBy("host", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "line_id", "row_id"))).alias("q"))
    return per.select(F.concat_ws("::", "host", F.unix_seconds("w.start").cast("string")).alias("session_id"), F.transform("q", lambda x: x["row_id"]).alias("event_seq"))
