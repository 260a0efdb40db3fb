"""Scores, metrics, fusion of legs, knowledge-base and judgment operators, explanations, similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio


def to_session(w: DataFrame, policy: str = "mean", th: float = 0.5, k: int = 1) -> DataFrame:
    """Window scores (session_id, label, p1) to session predictions."""
    score = {"max": F.max("p1") >= th, "kofn": F.sum((F.col("p1") >= th).cast("int")) >= k}.get(policy, F.avg("p1") >= th)
    return w.groupBy("session_id").agg(F.max("label").alias("label"), score.cast("int").alias("pred"))


def prf1(df: DataFrame, pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    p, y = F.col(pred), F.col("label")
    c = df.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(((p == a) & (y == b)).cast("long")), F.lit(0)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))])
    prec, rec = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", safe_ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def threshold_grid(s: DataFrame, score: str = "score") -> DataFrame:
    """F1 at .05 to .95; the grid is a constant array of 19 numbers."""
    grid = s.select("label", score, F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: i / 20.0)).alias("th"))
    return prf1(grid.withColumn("pred", (F.col(score) >= F.col("th")).cast("int")), by=["th"])


def fire_rates(df: DataFrame, pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Shares of all sessions and of normal ones that fire; where there is no normal one, of all."""
    p = F.col(pred).cast("double")
    return df.groupBy(*(by or [])).agg(F.avg(p).alias("fire_rate"), F.coalesce(F.avg(F.when(F.col("label") == 0, p)), F.avg(p)).alias("normal_fire_rate"))


def fuse(legs: list[Column], strategy: str = "or") -> Column:
    votes = sum((F.coalesce(x, F.lit(0)) for x in legs), F.lit(0))
    need = {"or": 1, "and": len(legs)}.get(strategy) or min(max(int(strategy.removeprefix("vote")), 1), len(legs))
    return (votes >= need).cast("int")


def gate(llm: Column, rule: Column, kb: Column) -> Column:
    """The judgment leg counts only where a symbolic leg fires."""
    return F.least(llm, F.greatest(rule, kb))


def vote(risk: Column, confidence: Column, least: float, low_max: float | None = None) -> Column:
    """A missing judgment never fires."""
    c = F.when(risk.isNotNull(), F.coalesce(confidence, F.lit(0.5)))
    fire = (risk == 1) & (c >= least)
    if low_max is not None:
        fire = fire | ((risk == 0) & (c < low_max))
    return F.coalesce(fire.cast("int"), F.lit(0))


def promoted(risk: Column, confidence: Column, count: Column, least: float = 0.85, times: int = 2) -> Column:
    return F.when((risk == 0) & (confidence >= least) & (count >= times), 1).otherwise(risk)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(newest))
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cache_pick(cache: DataFrame, run_tag: str, dataset: str) -> DataFrame:
    """Best cached row of a key: same run, then same dataset, then none named, then the newest."""
    order = [F.when(F.col("run_tag") == run_tag, 0).otherwise(1), F.when(F.col("dataset") == dataset, 0).when(F.col("dataset").isNull(), 1).otherwise(2), F.desc("updated_at")]
    return cache.withColumn("_n", F.row_number().over(Window.partitionBy("seq_key").orderBy(*order))).where("_n = 1").drop("_n")


def tfidf(rows: DataFrame) -> DataFrame:
    """(session_id, term) occurrences to L2-normalised tf * (ln((1 + N) / (1 + df)) + 1)."""
    tf = rows.groupBy("session_id", "term").agg(F.count("*").alias("tf"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = tf.agg(F.countDistinct("session_id").alias("n"))  # one row
    raw = tf.join(df_, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((F.lit(1.0) + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.withColumn("tfidf", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("session_id")))).select("session_id", "term", "tfidf")


def _nearest(ids: np.ndarray, q: np.ndarray, k: int):
    """The k rows nearest to each query among each slice of rows; sums run over the dimensions in order, so equal vectors tie."""
    q = q / np.sqrt((q * q).sum(1))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vec = part.column(0).to_numpy()
                e = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vec), -1)
                norm, s = np.zeros(len(vec)), np.zeros((len(q), len(vec)))
                for j in range(e.shape[1]):
                    norm += e[:, j] * e[:, j]
                e = e / np.sqrt(norm)[:, None]
                for j in range(e.shape[1]):
                    s += q[:, j, None] * e[None, :, j]
                s[ids[:, None] == vec[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(vec, s.shape), -s))[:, :k]
                row = np.repeat(np.arange(len(q)), order.shape[1])
                col = order.ravel()
                real = np.isfinite(s[row, col])
                row, col = row[real], col[real]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(vec[col]), pa.array(s[row, col])], ["query_id", "vec_id", "similarity"])

    return run


def knn_cosine_blocks(queries: DataFrame, table: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """query_id, vec_id, similarity, rank of the k rows (vec_id, embedding) most like each query (query_id, q) by cosine,
    for a query set that grows with the table: about ``block`` queries at a time against all rows.
    Null vectors, and those with nulls, NaN or of length zero, take no part."""

    def whole(df: DataFrame, c: str) -> DataFrame:
        v = F.col(c).cast("array<double>")
        return df.withColumn(c, v).where(F.exists(c, lambda x: x != 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)))

    queries, rows = whole(queries, "q"), whole(table, "embedding").select(F.col("vec_id").cast("long"), "embedding")
    blocks, found = max(1, -(-queries.count() // block)), []
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select(F.col("query_id").cast("long"), "q").collect()
        if got:
            near = _nearest(np.array([r["query_id"] for r in got]), np.array([r["q"] for r in got]), k)
            found.append(rows.mapInArrow(near, "query_id long, vec_id long, similarity double"))
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def leg_stats(df: DataFrame, legs: dict[str, Column]) -> DataFrame:
    """leg, idx, tp, fp, fn of every 0/1 leg against ``label``: one pass, whatever the number of legs."""
    each = df.select("label", F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("leg"), c.cast("int").alias("v")) for i, (n, c) in enumerate(legs.items())])).alias("x"))
    v, y = F.col("x.v"), F.col("label")
    return each.groupBy("x.leg", "x.idx").agg(F.sum(v * y).alias("tp"), F.sum(v * (1 - y)).alias("fp"), F.sum((1 - v) * y).alias("fn"))


def best_strategy(df: DataFrame, legs: list[Column]) -> DataFrame:
    """The fusion with the best F1 on validation sessions, of or, and, vote2..; the first of equals."""
    ways = ["or", "and", *(f"vote{k}" for k in range(2, len(legs)))]
    stats = leg_stats(df, {w: fuse(legs, w) for w in ways})
    double = 2.0 * F.col("tp")
    f1 = F.when(F.col("tp") > 0, double / (double + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return stats.withColumn("f1", f1).orderBy(F.desc("f1"), "idx").limit(1).select(F.col("leg").alias("strategy"), "f1")


def coverage(items: DataFrame, judged: DataFrame, key: str, by: str) -> DataFrame:
    """n and the share of items that have a judgment, by group."""
    has = judged.select(key).distinct().withColumn("_has", F.lit(1))
    return items.select(key, by).join(has, key, "left").groupBy(by).agg(F.count("*").alias("n"), F.avg(F.coalesce("_has", F.lit(0))).alias("coverage"))
