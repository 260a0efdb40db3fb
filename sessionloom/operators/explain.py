"""Why a session was told anomalous: rules that fired, their n-grams, the cluster, scores and a preview of its events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import stripped
from .rules import Rule

ARROW, SEPARATOR, PREVIEW = "→", " [SEP] ", 40


def _grams(r: Rule, names: dict[int, str]) -> list[str]:
    """Of all clauses of a rule, whether they hold or not; ordered subsets of two events or more."""
    some = [c.rids for c in (*r.if_any, *r.if_all) if (c.kind == "contains_ngram" and c.rids) or (c.kind == "ordered_subset" and len(c.rids) >= 2)]
    return [ARROW.join(names.get(i, f"E{i}") for i in rids) for rids in some]


def _told(fired: Column, values: dict[str, list[str]]) -> Column:
    """The values of the fired rules in turn, each once."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v)).alias("v")) for k, v in values.items() if v]) if any(values.values()) else None
    if table is None:
        return F.array().cast("array<string>")
    of = F.map_from_entries(table)
    return F.array_distinct(F.flatten(F.transform(fired, lambda n: F.coalesce(F.try_element_at(of, n), F.array().cast("array<string>")))))


def explained(fired: DataFrame, rules: list[Rule], names: dict[int, str], clusters: dict[str, str] | None = None) -> DataFrame:
    """session_id, label, triggered_rules (one for each pattern), triggered_ngrams, cluster_reference (of the first rule
    that has one). ``fired`` as ``rules.fires`` gives it, in the order of ``rules``; ``names`` row ids to event ids."""
    patterns: dict[str, str] = {}
    for r in rules:
        patterns.setdefault(r.name, stripped(r.name))
    out = fired.withColumn("_p", _told(F.col("fired"), {n: [p] for n, p in patterns.items()}))
    same = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("k"), F.lit(p).alias("v")) for n, p in patterns.items()])) if patterns else None
    first = F.transform("_p", lambda p: F.get(F.filter("fired", lambda n: F.try_element_at(same, n) == p), F.lit(0))) if patterns else F.array().cast("array<string>")
    cluster = _told(first, {n: [c] for n, c in (clusters or {}).items()})
    return out.select("session_id", "label", first.alias("triggered_rules"), _told(F.col("fired"), {r.name: _grams(r, names) for r in rules}).alias("triggered_ngrams"), F.get(cluster, F.lit(0)).alias("cluster_reference"))


def enriched(explanations: DataFrame, sessions: DataFrame, dictionary: DataFrame, verdicts: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """Explanations with the verdict (``verdicts``: session_id, detected), event ids and a preview of the templates.
    ``dictionary``: row_id, event_id, and event_template if there is one."""
    text = "event_template" if "event_template" in dictionary.columns else "event_id"
    words = sessions.select("session_id", F.posexplode("event_seq").alias("pos", "row_id")).join(dictionary.select("row_id", "event_id", F.col(text).alias("text")), "row_id", "left")
    named = words.select("session_id", "pos", F.coalesce("event_id", F.concat(F.lit("E"), F.col("row_id").cast("string"))).alias("event_id"), F.coalesce("text", F.concat(F.lit("[T"), F.col("row_id").cast("string"), F.lit("]"))).alias("text"))
    per = named.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id", "text"))).alias("q"))
    per = per.select("session_id", F.transform("q", lambda x: x["event_id"]).alias("event_ids"), F.array_join(F.transform(F.slice("q", 1, preview), lambda x: x["text"]), SEPARATOR).alias("preview"))
    out = explanations.join(verdicts.select("session_id", "detected"), "session_id", "left").join(per, "session_id", "left")
    return out.withColumn("detected", F.coalesce("detected", F.lit(0))).withColumnRenamed("label", "true_label")


def timed(run: Callable[[], int]) -> dict[str, float]:
    """Seconds of an action over so many sessions, and of each."""
    began = time.perf_counter()
    n = run()
    took = time.perf_counter() - began
    return {"sessions": n, "seconds": took, "seconds_each": took / n if n else 0.0}
