"""N-gram counts by label and the miners that make rules of them: one pass, conditional counts, no join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lift


def ngram_counts(lines: DataFrame, longest: int = 3) -> DataFrame:
    """n, gram, ca, cn: overlapping n-grams of eids, counted in anomalous and in normal sessions."""
    if longest == 1:  # no order is needed: a count for each session and event, then for each event
        per = lines.groupBy("sk", "eid").agg(F.count("*").alias("c"))
        y = lines.groupBy("sk").agg(F.max("anom").alias("label"))
        return per.join(y, "sk").groupBy(F.lit(1).alias("n"), F.col("eid").alias("gram")).agg(F.sum(F.when(F.col("label") == 1, F.col("c")).otherwise(0)).alias("ca"), F.sum(F.when(F.col("label") == 0, F.col("c")).otherwise(0)).alias("cn"))
    w = Window.partitionBy("sk").orderBy("ts_sec", "line_id")
    rows = lines.withColumn("label", F.max("anom").over(Window.partitionBy("sk")))
    rows = rows.select("label", "eid", *[F.lead("eid", j).over(w).alias(f"e{j}") for j in range(1, longest)])
    words = ["eid", *(f"e{j}" for j in range(1, longest))]
    grams = [F.when(F.col(words[n - 1]).isNotNull(), F.concat_ws(" ", *words[:n])) for n in range(1, longest + 1)]
    rows = rows.select("label", F.posexplode(F.array(*grams)).alias("n", "gram")).where("gram is not null")
    return rows.groupBy((F.col("n") + 1).alias("n"), "gram").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("ca"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("cn"))


def discriminative(counts: DataFrame, least: int = 10, most_normal: int = 1, top: int = 200) -> DataFrame:
    return counts.where((F.col("n") == 1) & (F.col("ca") >= least) & (F.col("cn") <= most_normal)).orderBy(F.desc("ca"), "cn", "gram").limit(top)


def by_lift(counts: DataFrame, n: tuple[int, ...], least: int = 2, least_lift: float = 1.3, top: int = 20) -> DataFrame:
    out = counts.where(F.col("n").isin(*n) & (F.col("ca") >= least)).withColumn("lift", lift(F.col("ca"), F.col("cn"))).where(F.col("lift") >= least_lift)
    return out.orderBy(F.desc("lift"), F.desc("ca"), "n", "gram").limit(top)


def frequent(counts: DataFrame, supports: dict[int, int]) -> DataFrame:
    keep = F.lit(False)
    for n, least in supports.items():
        keep = keep | ((F.col("n") == n) & (F.col("ca") + F.col("cn") >= least))
    return counts.where(keep).select("n", "gram", (F.col("ca") + F.col("cn")).alias("support"))


def phrase_hits(texts: DataFrame, phrases: list[str], least: int = 3, most_normal: int = 0) -> DataFrame:
    """Sessions (session_id, text, label) that hold each phrase, by label."""
    each = texts.select("label", F.explode(F.array(*[F.when(F.contains(F.lower("text"), F.lit(p.lower())), F.lit(p)) for p in phrases])).alias("phrase")).where("phrase is not null")
    out = each.groupBy("phrase").agg(F.sum("label").alias("anom_sessions"), F.sum(1 - F.col("label")).alias("norm_sessions"))
    return out.where((F.col("anom_sessions") >= least) & (F.col("norm_sessions") <= most_normal)).withColumn("confidence", F.when(F.col("norm_sessions") == 0, 0.9).otherwise(0.75))


def seq_ngrams(s: DataFrame, keep: list[str], sizes: tuple[int, ...] = (2, 3), place: str | None = None) -> DataFrame:
    """keep, n, gram (and its place, if named): each contiguous n-gram of ``event_seq``, by a projection, without a shuffle."""
    q = F.col("event_seq")

    def of(n: int):
        each = F.transform(F.sequence(F.lit(1), F.size(q) - n + 1), lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.array_join(F.slice(q, i, n).cast("array<string>"), " ").alias("gram")))
        return F.when(F.size(q) >= n, each)

    grams = [of(n) for n in sizes]
    return s.select(*keep, F.explode(F.flatten(F.array_compact(F.array(*grams)))).alias("g")).select(*keep, "g.n", "g.gram", *([F.col("g.at").alias(place)] if place else []))


def representative_grams(s: DataFrame, cluster: str, tops: dict[int, int]) -> DataFrame:
    """The ``tops[n]`` most common n-grams of each cluster; one that several clusters share stays with the first."""
    counts = seq_ngrams(s, [cluster], tuple(tops)).groupBy(cluster, "n", "gram").agg(F.count("*").alias("support"))
    rank = F.row_number().over(Window.partitionBy(cluster, "n").orderBy(F.desc("support"), "gram"))
    most = F.coalesce(*[F.when(F.col("n") == n, F.lit(k)) for n, k in tops.items()])
    best = counts.withColumn("_rank", rank).where(F.col("_rank") <= most)
    first = F.row_number().over(Window.partitionBy("n", "gram").orderBy(cluster))
    return best.withColumn("_first", first).where("_first = 1").select(cluster, "n", "gram", "support")


def rare_grams(s: DataFrame, supports: dict[int, int]) -> DataFrame:
    """session_id, hits: occurrences of n-grams whose support over all sessions is below ``supports[n]``."""
    grams = seq_ngrams(s, ["session_id"], tuple(supports))
    per = grams.groupBy("session_id", "n", "gram").agg(F.count("*").alias("c"))
    least = F.coalesce(*[F.when(F.col("n") == n, F.lit(k)) for n, k in supports.items()])
    often = per.groupBy("n", "gram").agg(F.sum("c").alias("support")).where(F.col("support") >= least)
    hits = per.join(often, ["n", "gram"], "left_anti").groupBy("session_id").agg(F.sum("c").alias("hits"))
    return s.select("session_id").join(hits, "session_id", "left").select("session_id", F.coalesce("hits", F.lit(0)).alias("hits"))
