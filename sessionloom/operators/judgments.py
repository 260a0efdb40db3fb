"""Judgments of sessions and clusters: keyword scorers, prompts, answers from a cache before any call, and what is read
from the answers."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..providers import judged
from .verdicts import cache_pick, promoted, vote  # noqa: F401  the vote is part of this module's surface

# Phrases and words of the risk scorer.
PHRASES = (r"received exception", r"threw exception", r"writeblock .* exception", r"connection (reset|refused|timed out)", r"(disk|block) (corrupt|corruption|lost|failure)", r"(checksum) (mismatch|failed)")
WORDS = ("error", "exception", "fail", "failed", "failure", "panic", "fatal", "critical", "timeout", "timed", "denied", "refused", "corrupt", "corruption", "abort", "aborted", "retry", "retries", "lost", "mismatch", "hang", "stuck", "backoff", "recover", "recovery")
STRONG = ("exception", "error")
NEGATIVE = ("error", "exception", "fail")


def risk(text: Column, phrases: tuple[str, ...] = PHRASES, words: tuple[str, ...] = WORDS, strong: tuple[str, ...] = STRONG) -> dict[str, Column]:
    """is_high_risk, count and rationale of a text: phrases that occur, and words as often as they do."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(F.split(low, "[^a-z]+"), lambda w: w.isin(*words))
    n_phrases = sum((F.when(low.rlike(p), 1).otherwise(0) for p in phrases), F.lit(0))
    n_words = F.size(found)
    alone = F.exists(found, lambda w: w.isin(*strong))
    hits = n_phrases + n_words
    why = F.concat_ws(", ", F.when(n_phrases > 0, F.concat(n_phrases.cast("string"), F.lit(" phrase hit(s)"))), F.when(n_words > 0, F.concat(n_words.cast("string"), F.lit(" keyword hit(s)"))), F.when(alone & (hits < 2), F.lit("strong singleton (exception/error)")))
    return {"is_high_risk": ((hits >= 2) | alone).cast("int"), "count": hits, "rationale": F.concat(F.lit("Heuristic: "), F.when(why == "", "no failure terms").otherwise(why))}


def rare_and_negative(hits: Column, text: Column, least: int = 2) -> Column:
    """Of a session: at least so many rare n-grams, and a word of failure."""
    return ((hits >= least) & F.lower(text).rlike("|".join(NEGATIVE))).cast("int")


def sentiment(lines: DataFrame, negative: DataFrame, least: int = 2, often: int = 50) -> DataFrame:
    """session_id, count, is_high_risk: lines (session_id, label, template) whose template is negative and not frequent
    (``often`` times or more) among normal lines. ``negative`` (template) is what a model, or a lexicon, told of the
    distinct templates. Sessions without such lines have 0."""
    frequent = lines.where("label = 0").groupBy("template").agg(F.count("*").alias("c")).where(F.col("c") >= often)
    bad = negative.select("template").distinct().join(frequent, "template", "left_anti").withColumn("bad", F.lit(1))
    per = lines.join(bad, "template", "left").groupBy("session_id").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("count"))
    return per.withColumn("is_high_risk", (F.col("count") >= least).cast("int"))


def lexicon_negative(templates: DataFrame, words: tuple[str, ...] = WORDS) -> DataFrame:
    """Distinct templates with a word of failure: the offline stand-in of a sentiment model."""
    return templates.select("template").distinct().where(F.exists(F.split(F.lower("template"), "[^a-z]+"), lambda w: w.isin(*words)))


# ---------------------------------------------------------------- prompts

ASK = """You are assessing whether the following {dataset} log *sequence* indicates a HIGH-RISK anomaly.
Return STRICT JSON with the keys seq_key, expected_behavior, observed_behavior, deviations (list), summary, core_events
(list of exact events or phrases), is_high_risk (0 or 1), count (evidence hits, >= 0), rationale, confidence (0 to 1).
Cleanup or deletion alone is a weak signal. No other keys, no prose outside the JSON.

seq_key={seq_key}
SNIPPET:
{snippet}
"""


def snippet(parts: Column, k: int, raw: bool = False) -> Column:
    """The first k templates of a session, joined by ' | '; or k raw lines, a line each."""
    joined = F.array_join(F.slice(parts, 1, k), "\n" if raw else " | ")
    return F.when(F.coalesce(F.size(parts), F.lit(0)) < 1, F.lit("(no logs)" if raw else "(empty)")).otherwise(joined)


def prompt(dataset: str, seq_key: Column, text: Column, template: str = ASK) -> Column:
    """The template with its {dataset}, {seq_key} and {snippet} filled in."""
    parts, rest = [], template.replace("{dataset}", dataset)
    while rest:
        at = {n: rest.find("{" + n + "}") for n in ("seq_key", "snippet")}
        some = {n: i for n, i in at.items() if i >= 0}
        if not some:
            parts.append(F.lit(rest))
            break
        n = min(some, key=some.get)
        parts += [F.lit(rest[: some[n]]), seq_key if n == "seq_key" else text]
        rest = rest[some[n] + len(n) + 2 :]
    return F.concat(*parts)


def prompt_items(sessions: DataFrame, dataset: str, k: int = 20, raw: bool = False, template: str = ASK) -> DataFrame:
    """seq_key, snippet, prompt of sessions (seq_key, parts: array of templates or lines)."""
    out = sessions.select(F.col("seq_key").cast("string"), snippet(F.col("parts"), k, raw).alias("snippet"))
    return out.withColumn("prompt", prompt(dataset, F.col("seq_key"), F.col("snippet"), template))


def cluster_summary(cluster: dict, most: int = 6) -> str:
    tops = [str(name) for name, _ in (cluster.get("top_templates") or cluster.get("top_events") or [])[:most]]
    parts = [f"Cluster size: {cluster['size']}"] if cluster.get("size") is not None else []
    parts += ["Frequent events: " + ", ".join(tops)] if tops else []
    return " | ".join(parts) or "Cluster summary unavailable"


def cluster_prompt(cluster_id: str, bundle: dict, dataset: str) -> str:
    """The request for rules of one cluster of a bundle (``clusters.bundle``)."""
    cluster = bundle.get("clusters", {}).get(str(cluster_id)) or {}
    about = {"meta": bundle.get("meta", {}), "cluster_id": cluster_id, "cluster_size": cluster.get("size"), "summary": cluster.get("summary") or cluster_summary(cluster), "template_map_sample": (bundle.get("template_map") or [])[:50]}
    return f"""Log templates and a cluster of anomalous sequences of {dataset} follow. Give 3 to 10 boolean rules that tell sequences like these.
STRICT JSON only: {{"rules": [{{"name": str, "if_any": [...], "if_all": [...], "explanation": str, "confidence": number}}]}}
Clauses: contains_ngram or ordered_subset (lists of row_ids), min_count {{"event_id", "count"}}, absent_within {{"event_id", "window"}}.

{json.dumps(about, indent=2)}"""


# ---------------------------------------------------------------- answers

RESULT = "seq_key string, snippet string, count string, is_high_risk string, rationale string, summary string, core_events string, expected_behavior string, observed_behavior string, deviations string, confidence string"


def _list_text(c: Column) -> Column:
    """JSON text of a list; anything else as a list of one."""
    return F.when(F.ltrim(c).startswith("["), c).when(c.isNull(), F.lit("[]")).otherwise(F.to_json(F.array(c)))


def ingested(results: DataFrame, dataset: str, run_tag: str, promote: bool | None = None, least: float = 0.85, times: int = 2) -> DataFrame:
    """Rows of ``dynamic_patterns`` of result texts (column ``result``, JSON objects). Numbers may come as texts; a result
    without seq_key, or with a count, risk or confidence that is no number, is left out. Missing ones are 0. Of a key, the
    last in order of its columns counts when it is stored."""
    x = F.from_json("result", RESULT)
    r = results.select(x.alias("x")).select("x.*").where("seq_key is not null")
    number = lambda c, kind: F.when(F.col(c).isNull(), F.lit(0).cast(kind)).otherwise(F.expr(f"try_cast(try_cast({c} as double) as {kind})"))
    r = r.withColumn("count", number("count", "int")).withColumn("is_high_risk", number("is_high_risk", "int")).withColumn("confidence", number("confidence", "double"))
    r = r.where("count is not null and is_high_risk is not null and confidence is not null")
    promote = dataset.strip().upper() != "LIBERTY" if promote is None else promote
    high = F.when(F.col("is_high_risk") == 1, 1).otherwise(promoted(F.lit(0), F.col("confidence"), F.col("count"), least, times) if promote else F.lit(0))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("snippet", "rationale", "summary", "expected_behavior", "observed_behavior")]
    return r.select("seq_key", F.lit(dataset).alias("dataset"), F.lit(run_tag).alias("run_tag"), "count", high.cast("int").alias("is_high_risk"), *text, _list_text(F.col("core_events")).alias("core_events"), _list_text(F.col("deviations")).alias("deviations"), "confidence")


def valid(cache: DataFrame, answer: str = "rationale") -> DataFrame:
    """Cached rows that hold an answer."""
    return cache.where(F.length(F.trim(F.coalesce(F.col(answer), F.lit("")))) > 0)


@dataclass
class Asked:
    """What a run over a cache did: ``rows`` are the answers of this run, ready to be stored."""

    rows: DataFrame
    counts: dict[str, int]


def split_by_cache(items: DataFrame, cache: DataFrame, run_tag: str, dataset: str, key: str = "seq_key", answer: str = "rationale", newest: str = "updated_at", cross_run: bool = True) -> DataFrame:
    """``items`` with the best cached row (``found``) and a ``state``: hit (of this run), copy (of another run), miss."""
    some = valid(cache, answer)
    some = some if cross_run else some.where(F.col("run_tag") == run_tag)
    best = cache_pick(some.withColumnRenamed(key, "seq_key").withColumnRenamed(newest, "updated_at"), run_tag, dataset)
    best = best.select(F.col("seq_key").alias(key), F.struct(*[F.col(c) for c in best.columns]).alias("found"))
    out = items.join(best, key, "left")
    same = (F.col("found.run_tag") == run_tag) & F.col("found.dataset").eqNullSafe(F.lit(dataset))
    return out.withColumn("state", F.when(F.col("found").isNull(), "miss").when(same, "hit").otherwise("copy"))


def ask_sessions(items: DataFrame, cache: DataFrame, judge: Callable[[str], dict], run_tag: str, dataset: str, most: int | None = None, cross_run: bool = True, durable: Callable[[DataFrame], DataFrame] = lambda df: df) -> Asked:
    """Cache-first judging of prompts (seq_key, snippet, prompt): rows of this run stay, rows of other runs are copied,
    the rest is asked. ``most`` takes the first so many keys only. ``durable`` should keep the answers, so that no
    prompt is asked twice."""
    items = items.orderBy("seq_key").limit(most) if most is not None else items
    parted = split_by_cache(items, cache.withColumn("updated_at", F.col("confidence")) if "updated_at" not in cache.columns else cache, run_tag, dataset, cross_run=cross_run)
    answers = durable(judged(parted.where("state = 'miss'"), judge))
    fresh = ingested(answers.where("response is not null").select(F.col("response").alias("result")), dataset, run_tag)
    names = [c for c in cache.columns if c in fresh.columns]
    copies = parted.where("state = 'copy'").select(*[F.lit({"dataset": dataset, "run_tag": run_tag}[c]).alias(c) if c in ("dataset", "run_tag") else F.col("seq_key") if c == "seq_key" else F.col(f"found.{c}").alias(c) for c in names])
    n = {r["state"]: r["c"] for r in parted.groupBy("state").agg(F.count("*").alias("c")).collect()}
    failed = answers.where("response is null").count()
    counts = {"hits": n.get("hit", 0), "copies": n.get("copy", 0), "calls": n.get("miss", 0) - failed, "failures": failed}
    return Asked(copies.unionByName(fresh.select(*names)), counts)


def ask_clusters(prompts: DataFrame, cache: DataFrame, judge: Callable[[str], dict], run_tag: str, dataset: str, now: float = 0.0, durable: Callable[[DataFrame], DataFrame] = lambda df: df) -> Asked:
    """The same for clusters (cluster_id, prompt); rows of ``cluster_llm_results``."""
    parted = split_by_cache(prompts, cache, run_tag, dataset, "cluster_id", "response_json")
    answers = durable(judged(parted.where("state = 'miss'"), judge, "cluster_id"))
    row = lambda text: [F.col("cluster_id"), F.lit(dataset).alias("dataset"), F.lit(run_tag).alias("run_tag"), text.alias("response_json"), F.lit(float(now)).alias("updated_at")]
    rows = parted.where("state = 'copy'").select(*row(F.col("found.response_json"))).unionByName(answers.where("response is not null").select(*row(F.col("response"))))
    n = {r["state"]: r["c"] for r in parted.groupBy("state").agg(F.count("*").alias("c")).collect()}
    failed = answers.where("response is null").count()
    return Asked(rows, {"hits": n.get("hit", 0), "copies": n.get("copy", 0), "calls": n.get("miss", 0) - failed, "failures": failed})


def labels(judgments: DataFrame, dataset: str, run_tag: str, least: float = 0.0) -> DataFrame:
    """seq_key, is_high_risk, confidence of a run's judgments of enough confidence (none counts as 0)."""
    c = F.coalesce("confidence", F.lit(0.0))
    return judgments.where((F.col("dataset") == dataset) & (F.col("run_tag") == run_tag) & (c >= least)).select(F.trim("seq_key").alias("seq_key"), "is_high_risk", c.alias("confidence"))


def rate(judgments: DataFrame) -> DataFrame:
    return judgments.groupBy("dataset", "run_tag").agg(F.coalesce(F.sum("is_high_risk"), F.lit(0)).alias("high"), F.count("*").alias("n"))


def with_memo(patterns: DataFrame, memo: DataFrame, status: Column, explanation: Column, now: float = 0.0) -> DataFrame:
    """pattern_key, pattern_type, status, explanation, cached, updated_at: remembered judgments, and for the rest what
    ``status`` and ``explanation`` give."""
    keys = ["pattern_key", "pattern_type"]
    known = memo.select(*keys, F.col("status").alias("_s"), F.col("explanation").alias("_e"), F.col("updated_at").alias("_u"), F.lit(True).alias("_k"))
    out = patterns.join(known, keys, "left")
    has = F.coalesce("_k", F.lit(False))
    return out.select(*keys, F.when(has, F.col("_s")).otherwise(status.cast("int")).alias("status"), F.when(has, F.col("_e")).otherwise(explanation).alias("explanation"), has.alias("cached"), F.when(has, F.col("_u")).otherwise(F.lit(float(now))).alias("updated_at"))
