"""The rule language: clauses as Columns, rules as any/all of them, table-driven evaluation, selection on validation data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import as_text


@dataclass(frozen=True)
class Clause:
    """One of min_count(rid, count), contains_ngram(rids), ordered_subset(rids), absent_within(rid), template_contains(phrase)."""

    kind: str
    rids: tuple[int, ...] = ()
    row_id: int | None = None
    count: int = 1
    phrase: str = ""
    event_id: str | None = None

    def column(self, seq: Column, texts: Column | None = None) -> Column:
        if self.kind == "template_contains":
            return F.exists(texts, lambda t: F.contains(F.lower(t), F.lit(self.phrase.lower()))) if texts is not None else F.lit(False)
        if self.kind == "contains_ngram":
            return F.contains(as_text(seq), F.lit(f" {' '.join(map(str, self.rids))} ")) if self.rids else F.lit(False)
        if self.kind == "ordered_subset":
            want = F.array(*[F.lit(r) for r in self.rids]).cast("array<int>")
            return F.aggregate(seq, F.lit(0), lambda i, x: F.when(x.eqNullSafe(F.get(want, i)), i + 1).otherwise(i)) == len(self.rids) if self.rids else F.lit(True)
        if self.kind == "min_count":
            return F.size(F.filter(seq, lambda x: x == self.row_id)) >= self.count if self.row_id is not None else F.lit(False)
        if self.kind == "absent_within":
            return ~F.array_contains(seq, self.row_id) if self.row_id is not None else F.lit(False)
        return F.lit(False)


@dataclass(frozen=True)
class Rule:
    name: str
    if_any: tuple[Clause, ...] = ()
    if_all: tuple[Clause, ...] = ()
    confidence: float = 0.8
    cluster_id: str | None = None
    any_only: bool = False
    explanation: str = ""

    def column(self, seq: Column, texts: Column | None = None) -> Column:
        some = F.lit(False)
        for c in self.if_any:
            some = some | c.column(seq, texts)
        every = F.lit(True)
        for c in self.if_all:
            every = every & c.column(seq, texts)
        if self.any_only:
            return some if self.if_any else F.lit(False)
        return (some if self.if_any else F.lit(True)) & every


def _ids(v) -> tuple[int, ...] | None:
    return tuple(v) if isinstance(v, list) and v and all(isinstance(i, int) and not isinstance(i, bool) for i in v) else None


def _number(v, kind, other):
    try:
        return kind(v)
    except (TypeError, ValueError, OverflowError):
        return other


def clause_of(c, ids: dict[str, int]) -> Clause | None:
    """A clause of untrusted JSON; the first of its known keys counts. Row ids win over event ids."""
    if not isinstance(c, dict):
        return None
    for kind in ("min_count", "ordered_subset", "contains_ngram", "absent_within"):
        v = c.get(kind)
        if kind in ("ordered_subset", "contains_ngram") and _ids(v):
            return Clause(kind, rids=_ids(v))
        if kind in ("min_count", "absent_within") and isinstance(v, dict):
            row, event = v.get("row_id"), v.get("event_id")
            row = row if isinstance(row, int) and not isinstance(row, bool) else ids.get(str(event))
            if row is not None or event is not None:
                return Clause(kind, row_id=row, count=_number(v.get("count", 1), int, 1), event_id=None if event is None else str(event))
    return None


def normalised(raw, ids: dict[str, int]) -> Rule | None:
    """A rule of untrusted JSON: known clauses only, event ids to row ids; None if no clause is left."""
    if not isinstance(raw, dict):
        return None
    parts = [tuple(x for c in (raw.get(k) if isinstance(raw.get(k), list) else ()) if (x := clause_of(c, ids))) for k in ("if_any", "if_all")]
    if not any(parts):
        return None
    cluster = raw.get("cluster_id")
    return Rule(str(raw.get("name", "rule")), *parts, confidence=_number(raw.get("confidence", 0.0), float, 0.0), cluster_id=None if cluster is None else str(cluster), any_only=bool(raw.get("cluster_score_if_any_only", False)), explanation=str(raw.get("explanation", "")))


def fires(s: DataFrame, rules: list[Rule], texts: str | None = None) -> DataFrame:
    """session_id, label, and the names of the rules that fire: one projection, whatever the number of rules."""
    t = F.col(texts) if texts else None
    named = F.array_compact(F.array(*[F.when(r.column(F.col("event_seq"), t), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return s.select("session_id", "label", named.alias("fired"))


def fires_by_event(lines: DataFrame, rule_events: DataFrame) -> DataFrame:
    """Table-driven evaluation of min-count-1 rules (eid): an equi-join on events, one row a session."""
    return lines.join(rule_events.select("eid").distinct(), "eid").groupBy("sk").agg(F.lit(1).alias("fired")).select(F.col("sk").alias("session_id"), "fired")


def greedy(bitmap: list[tuple[str, list[bool]]], labels: list[int], max_fire: float = 0.25, max_normal: float = 0.25, min_f1: float = 0.0) -> list[str]:
    """Greedy union on a validation bitmap (bounded: rules checked by validation sessions): precision, then F1, then order."""

    def score(v: list[bool]) -> tuple[float, float]:
        tp = sum(f and y for f, y in zip(v, labels, strict=True))
        p = tp / sum(v) if any(v) else 0.0
        r = tp / sum(labels) if any(labels) else 0.0
        return p, 2 * p * r / (p + r) if p + r else 0.0

    live = sorted(((n, v) for n, v in bitmap if any(v)), key=lambda x: tuple(-s for s in score(x[1])))
    chosen, union, best, normal = [], [False] * len(labels), 0.0, max(1, labels.count(0))
    for n, v in live:
        both = [a or b for a, b in zip(union, v, strict=True)]
        f1 = score(both)[1]
        if sum(both) <= max_fire * len(both) and sum(f and not y for f, y in zip(both, labels, strict=True)) <= max_normal * normal and f1 > best + 1e-9:
            chosen, union, best = [*chosen, n], both, f1
    return chosen if best >= min_f1 and chosen else [n for n, _ in live[:1]]
