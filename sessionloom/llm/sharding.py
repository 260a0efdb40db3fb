"""Sharding by longest processing time: groups of equal texts, sorted by size, go to the least-loaded shard by a heap.

The driver's heap sees a size histogram, not the groups: sizes up to 65,536 bytes are exact cells and larger ones fall
in cells 1/1024 wide, so there are at most about 100,000 cells however many groups there are. Equal items of one cell
are dealt in bulk, as the heap would deal them one by one.

Defined results: a null text has size 16, checksum 0, and forms one group with the other nulls (an empty text is a
group of its own); repeated rows are rows of one group; a group larger than a fair share keeps a shard almost to itself,
since groups stay together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SHARDS, OVERHEAD = 40, 16


def _cell(total: Column) -> Column:
    """Exact below 2**16; above, the leading 11 bits."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(total.cast("double"))).cast("int") - 10)
    return F.when(total <= 65536, total).otherwise(F.shiftleft(F.expr("cast(1 as bigint)"), 40) * shift + F.floor(total / F.pow(F.lit(2.0), shift)).cast("long"))


def deal(cells: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Cells (cell, groups, bytes) to segments (cell, from rank, to rank, shard), largest groups first."""
    loads, out = [(0.0, s) for s in range(shards)], []
    heapq.heapify(loads)
    for cell, n, total in sorted(cells, key=lambda c: (-c[2] / c[1], c[0])):
        size, given = total / n, dict.fromkeys(range(shards), 0)
        left = n
        if n > 2 * shards:
            top = max(x for x, _ in loads)
            room = {s: int((top - x) // size) for x, s in loads}
            if sum(room.values()) <= left:
                left -= sum(room.values())
                each, left = divmod(left, shards)
                given = {s: room[s] + each for s in given}
                loads = [(x + given[s] * size, s) for x, s in loads]
                heapq.heapify(loads)
        for _ in range(left):
            x, s = loads[0]
            heapq.heapreplace(loads, (x + size, s))
            given[s] += 1
        at = 0
        for s, k in given.items():
            if k:
                out.append((cell, at, at + k, s))
                at += k
    return out


def numbered(df: DataFrame, by: str, order: list[str], name: str, salt: Column) -> DataFrame:
    """Gapless numbers from 0 within ``by``, in order of (salt, order): each salt is numbered alone and shifted by
    the counts of the salts before it, so no task holds a whole ``by``."""
    df = df.withColumn("_salt", salt)
    per = df.groupBy(by, "_salt").count().withColumn("_shift", F.sum("count").over(Window.partitionBy(by).orderBy("_salt")) - F.col("count")).drop("count")
    local = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order)) - 1
    return df.withColumn("_local", local).join(per, [by, "_salt"]).withColumn(name, (F.col("_local") + F.col("_shift")).cast("long")).drop("_local", "_shift", "_salt")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, salts: int = 64) -> DataFrame:
    """One row for each row: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col(text_col).cast("string")
    # a text is known by two 64-bit hashes, a checksum and its length; the text itself is never shuffled
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"), F.xxhash64(text, F.lit(1)).alias("k1"), F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")), text.isNull()).alias("k2"))
    rows = durable(rows)
    groups = rows.groupBy("k1", "k2", "crc", "size").agg(F.count("*").alias("copies")).withColumn("total", F.col("copies") * F.col("size")).withColumn("cell", _cell(F.col("total")))
    groups = durable(numbered(groups, "cell", ["k1", "k2", "crc", "size"], "rank", F.pmod("k2", F.lit(16))).select("k1", "k2", "crc", "size", "cell", "rank", "total"))
    cells = [(r["cell"], r["n"], r["b"]) for r in groups.groupBy("cell").agg(F.count("*").alias("n"), F.sum("total").alias("b")).collect()]
    spark = docs.sparkSession
    segments = spark.createDataFrame(deal(cells, shards), "cell long, lo long, hi long, shard int")
    segments = segments.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("parts"))  # at most one a shard
    placed = groups.join(segments, "cell").select("k1", "k2", "crc", "size", F.filter("parts", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0]["shard"].alias("shard"))
    out = numbered(rows.join(placed, ["k1", "k2", "crc", "size"]), "shard", ["id", "k1", "k2"], "slot", F.pmod(F.xxhash64("id"), F.lit(salts)))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
