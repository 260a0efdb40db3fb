"""Selection of rules on validation sessions.

Spark reduces the sessions to their distinct patterns of fired rules, with counts by label; every metric of every union
of rules is a sum over these patterns. The choice itself is sequential and runs on them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """The thresholds of the validation filter."""

    max_fire: float = 0.25
    min_f1: float = 0.80
    min_precision: float = 0.85
    single_fire: float = 0.08
    max_check: int = 150
    max_normal: float | None = None
    enabled: bool = True
    #: Of cluster rules only: the F1 they must reach together, and how many the last resort keeps.
    target_f1: float = 0.25
    keep: int = 120


RULES = Limits()
BY_DATASET = {"BGL": {"max_fire": 0.70, "min_f1": 0.90, "min_precision": 0.92, "single_fire": 0.15, "max_check": 600, "max_normal": 0.04}, "HDFS": {"max_fire": 0.25, "min_precision": 0.85}}
CLUSTER_RULES = Limits(0.35, 0.30, 0.35, 0.15, 600, 0.12, True, 0.25)
CLUSTER_LIBERTY = Limits(0.50, 0.05, 0.10, 0.25, 600, 0.25, True, 0.05)


def limits(dataset: str = "", base: Limits = RULES, **own) -> Limits:
    """The limits of a dataset; ``own`` overrides them."""
    return replace(base, **{**BY_DATASET.get(dataset.strip().upper(), {}), **own})


def cluster_limits(dataset: str = "", **own) -> Limits:
    return replace(CLUSTER_LIBERTY if dataset.strip().upper() == "LIBERTY" else CLUSTER_RULES, **own)


@dataclass(frozen=True)
class Stats:
    tp: int
    fp: int
    anomalies: int
    normals: int

    @property
    def hits(self) -> int:
        return self.tp + self.fp

    @property
    def precision(self) -> float:
        return self.tp / self.hits if self.hits else 0.0

    @property
    def f1(self) -> float:
        p, r = self.precision, self.tp / self.anomalies if self.anomalies else 0.0
        return 2 * p * r / (p + r) if p + r else 0.0

    @property
    def fire(self) -> float:
        n = self.anomalies + self.normals
        return self.hits / n if n else 0.0

    @property
    def normal_fire(self) -> float:
        return self.fp / self.normals if self.normals else self.fire


class Validation:
    """Distinct (fired rules, label) patterns of validation sessions and their counts."""

    #: Patterns that may come to the driver (a bit for each rule and a count).
    MOST = 2_000_000

    def __init__(self, fired: DataFrame, names: list[str]):
        """``fired``: session_id, label, fired (rule names), as ``rules.fires`` gives it."""
        patterns = fired.groupBy("label", F.array_sort(F.array_distinct("fired")).alias("fired")).agg(F.count("*").alias("c"))
        got = patterns.limit(self.MOST + 1).collect()
        if len(got) > self.MOST:
            raise ValueError(f"more than {self.MOST} patterns of fired rules: check fewer rules at a time")
        self.names = list(dict.fromkeys(names))
        at = {n: i for i, n in enumerate(self.names)}
        self.bits = np.zeros((len(self.names), len(got)), bool)
        for j, r in enumerate(got):
            self.bits[[at[n] for n in r["fired"] if n in at], j] = True
        self.at, self.c = at, np.array([r["c"] for r in got], np.int64)
        self.y = np.array([r["label"] == 1 for r in got], bool)

    def __len__(self) -> int:
        return int(self.c.sum())

    def stats_of(self, mask: np.ndarray) -> Stats:
        pos, neg = self.c * self.y, self.c * ~self.y
        return Stats(int(pos[mask].sum()), int(neg[mask].sum()), int(pos.sum()), int(neg.sum()))

    def mask(self, rules: list[str]) -> np.ndarray:
        return self.bits[[self.at[r] for r in rules]].any(0) if rules else np.zeros(len(self.c), bool)

    def stats(self, rules: list[str]) -> Stats:
        return self.stats_of(self.mask(rules))


def greedy(v: Validation, rules: list[str], max_fire: float, min_f1: float, max_check: int, max_normal: float | None = None, min_precision: float = 0.0) -> list[str]:
    """Union of rules by precision, then F1, then order, under caps of fire rates; the best single rule if that falls short."""
    live = []
    for name in rules[:max_check]:
        s = v.stats([name])
        if s.hits and (s.precision >= min_precision or s.tp):
            live.append((s, name))
    live.sort(key=lambda x: (-x[0].precision, -x[0].f1))
    chosen: list[str] = []
    union, best = np.zeros(len(v.c), bool), -1.0
    for _, name in live:
        both = union | v.mask([name])
        s = v.stats_of(both)
        if s.fire > max_fire or (max_normal is not None and s.normals and s.normal_fire > max_normal):
            continue
        if s.f1 > best + 1e-9 or (not chosen and s.f1 >= min_f1 * 0.5):
            union, best = both, s.f1
            chosen.append(name)
    if chosen and best >= min_f1:
        return chosen
    return [live[0][1]] if live else []


def filter_rules(v: Validation, rules: list[str], cfg: Limits, dataset: str = "") -> list[str]:
    """All rules if together they are good enough; else the good single ones; else a greedy choice."""
    if not cfg.enabled:
        return list(rules)
    if not rules or not len(v):
        return []
    if dataset.strip().upper() == "BGL" and (found := greedy(v, rules, cfg.max_fire, cfg.min_f1, cfg.max_check, cfg.max_normal, cfg.min_precision)):
        return found

    def fits(some: list[str]) -> bool:
        s = v.stats(some)
        return s.fire <= cfg.max_fire and s.f1 >= cfg.min_f1 and s.precision >= cfg.min_precision

    if fits(rules):
        return list(rules)
    good = [n for n in rules[: cfg.max_check] if (s := v.stats([n])).hits and s.fire <= cfg.single_fire and (s.precision >= 0.9 or (s.f1 >= 0.5 and s.precision >= 0.5))]
    if good and fits(good):
        return good
    return greedy(v, rules, cfg.max_fire, cfg.min_f1, cfg.max_check, cfg.max_normal, cfg.min_precision * 0.5)


def by_hits(v: Validation, rules: list[str], keep: int) -> list[str]:
    """Rules that hit anomalies, by hits, F1, precision and order."""
    some = [(s, n) for n in rules if (s := v.stats([n])).tp]
    some.sort(key=lambda x: (-x[0].tp, -x[0].f1, -x[0].precision))
    return [n for _, n in some[:keep]]


def guarded(v: Validation, rules: list[str], cfg: Limits, dataset: str = "") -> list[str]:
    """``rules`` if they are within the limits of cluster rules, else a greedy choice with half of them, else none."""
    if not rules or not len(v):
        return list(rules)
    s = v.stats(rules)
    if s.f1 >= cfg.target_f1 and s.precision >= cfg.min_precision and s.normal_fire <= cfg.max_normal:
        return list(rules)
    found = greedy(v, rules, cfg.max_fire, cfg.target_f1, len(rules), cfg.max_normal, cfg.min_precision)
    if found:
        s = v.stats(found)
        if s.f1 >= cfg.target_f1 * 0.5 and s.precision >= cfg.min_precision * 0.5 and s.normal_fire <= cfg.max_normal * 1.5:
            return found
    return by_hits(v, rules, cfg.keep) if dataset.strip().upper() == "LIBERTY" else []


def filter_cluster_rules(v: Validation, rules: list[str], dataset: str = "", cfg: Limits | None = None) -> list[str]:
    """The validation filter of cluster rules. The dataset's own limits are applied over those of cluster rules, as for
    all rules; where nothing is left, the rules that hit most anomalies are tried."""
    cfg = cfg or cluster_limits(dataset)
    if not rules or not len(v):
        return list(rules)
    kept = filter_rules(v, rules, limits(dataset, cfg), dataset)
    f1 = lambda some: v.stats(some).f1 if some else -1.0
    if kept and f1(kept) >= cfg.target_f1:
        return guarded(v, kept, cfg, dataset)
    found = greedy(v, rules, cfg.max_fire, cfg.target_f1 * 0.5, cfg.max_check, cfg.max_normal, cfg.min_precision * 0.5)
    if found and f1(found) >= f1(kept):
        return guarded(v, found, cfg, dataset)
    return guarded(v, kept or by_hits(v, rules[: cfg.max_check], cfg.keep), cfg, dataset)
