"""Fusion of a base leg, mined rules, cluster rules and judgments into one verdict, tuned on validation sessions.

A session counts in tuning only by its profile: label, the 0/1 legs, and the judgment's vote at each confidence tried.
One aggregate yields the counts of all profiles (a few hundred at most, whatever the number of sessions); every strategy
at every confidence is a sum over them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verdicts import fuse, gate, vote

#: The confidences tried, and those of the two-sided vote.
CONFIDENCES = (0.5, 0.6, 0.7, 0.8, 0.9)
HIGH, LOW = (0.0, 0.5, 0.7), (0.74, 0.76, 0.78, 0.79, 0.80, 0.81, 0.82, 0.83)
MAX_LEG_FIRE = 0.35


def first_best(scored: DataFrame, score: str, order: str) -> DataFrame:
    """The row of the highest score; of equals the first in ``order``."""
    return scored.orderBy(F.desc(score), order).limit(1)


def f1_of(tp: float, fp: float, fn: float) -> float:
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


@dataclass
class Profiles:
    """Counts of validation sessions by label and legs; ``llm[c]`` is the vote at confidence c."""

    c: np.ndarray
    y: np.ndarray
    base: np.ndarray
    ngram: np.ndarray
    kb: np.ndarray | None
    llm: dict[float, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, legs: DataFrame, confidences: tuple[float, ...] = CONFIDENCES, low: float | None = None) -> Profiles:
        """``legs``: label, base, ngram, kb (may lack), risk, conf. Missing legs count as 0."""
        has = "kb" in legs.columns
        names = ["base", "ngram"] + ["kb"] * has
        cols = [F.coalesce(F.col(n).cast("int"), F.lit(0)).alias(n) for n in names]
        votes = [vote(F.col("risk"), F.col("conf"), x, low).alias(f"v{i}") for i, x in enumerate(confidences)]
        got = legs.select("label", *cols, *votes).groupBy("label", *names, *(f"v{i}" for i in range(len(confidences)))).agg(F.count("*").alias("c")).toPandas()
        bit = lambda n: got[n].to_numpy().astype(int)
        return cls(bit("c"), bit("label"), bit("base"), bit("ngram"), bit("kb") if has else None, {x: bit(f"v{i}") for i, x in enumerate(confidences)})

    def f1(self, pred: np.ndarray) -> float:
        at = lambda p, y: float(self.c[(pred == p) & (self.y == y)].sum())
        return f1_of(at(1, 1), at(1, 0), at(0, 1))

    def normal_fire(self, leg: np.ndarray) -> float:
        some = self.y == 0 if (self.y == 0).any() else np.ones(len(self.y), bool)
        return float((leg * self.c)[some].sum() / self.c[some].sum()) if self.c[some].sum() else 0.0

    def legs(self, conf: float, llm: bool = True, ngram: bool = True, cluster: bool = True, symbolic: bool = True, max_fire: float | None = MAX_LEG_FIRE) -> dict[str, np.ndarray]:
        """The legs that take part: the base always; others unless they fire on too many normal sessions. The judgment
        counts only beside a symbolic leg, if all three are in."""
        zero = np.zeros(len(self.c), int)
        kb = self.kb if cluster else None
        rules = self.ngram if ngram else zero
        judged = self.llm[conf] if llm else zero
        if symbolic and llm and ngram and cluster and kb is not None:
            judged = np.minimum(judged, np.maximum(rules, kb))
        out = {"base": self.base, "llm": judged, "ngram": rules} | ({"kb": kb} if kb is not None else {})
        return {k: v for k, v in out.items() if k == "base" or max_fire is None or self.normal_fire(v) <= max_fire}


def strategies(legs: int) -> list[str]:
    return ["or", "and", *(f"vote{k}" for k in range(2, legs + 1))]


def voted(legs: list[np.ndarray], strategy: str) -> np.ndarray:
    need = {"or": 1, "and": len(legs)}.get(strategy) or min(max(int(strategy.removeprefix("vote")), 1), len(legs))
    return (sum(legs) >= need).astype(int)


def parsed(name: str) -> str:
    """A known strategy name, or ``or``."""
    known = ("base+ngram_or", "base+kb_or", "base+ngram+kb_or", "base_only", "ngram_only", "base+residual_ngram", "or", "and")
    return "or" if name == "4-way_or" or not (name in known or re.fullmatch(r"vote\d+", name)) else "or" if name == "base+residual_ngram" else name


def tie_key(name: str) -> tuple[int, int]:
    """Of equal strategies: votes first, by their number, then the named ones."""
    if m := re.fullmatch(r"vote(\d+)", name):
        return 0, int(m[1])
    return 1, {"or": 1, "and": 2, "base+ngram_or": 3, "base+kb_or": 4, "base+ngram+kb_or": 5}.get(name, 9)


def tune(p: Profiles, fixed: float | None = None, fallback: bool = True, **which) -> tuple[float, str, float]:
    """(confidence, strategy, F1): the best of all strategies at all confidences; of equals the higher confidence, then
    the tie key. The base alone, at 0.5, if it is better."""
    best_f1, best_conf, best = -1.0, 0.5, "or"
    for conf in (fixed,) if fixed is not None else tuple(p.llm):
        legs = list(p.legs(conf, **which).values())
        f1, name = -1.0, "or"
        for s in strategies(len(legs)):
            if (x := p.f1(voted(legs, s))) > f1:
                f1, name = x, s
        if which.get("ngram", True) and (p.ngram * p.c).sum() and (x := p.f1(np.maximum(p.base, p.ngram))) > f1:
            f1, name = x, "base+ngram_or"
        tie = abs(f1 - best_f1) <= 1e-9 and (conf > best_conf or (conf == best_conf and tie_key(name) < tie_key(best)))
        if f1 > best_f1 + 1e-9 or tie:
            best_f1, best_conf, best = f1, conf, name
    base = p.f1(p.base)
    return (0.5, "base_only", base) if fallback and best_f1 < base - 1e-9 else (best_conf, best, best_f1)


def ablated_votes(k: int, full: int, legs: int) -> int:
    """A vote of k of ``full`` legs, where only ``legs`` are left: one that asked for nearly all asks for that many less."""
    gone = max(0, full - legs)
    return max(1, min(legs, k - gone)) if gone and k >= full - 1 else max(1, min(k, legs))


def applied(p: Profiles, conf: float, name: str, full: int | None = None, **which) -> np.ndarray:
    """The verdicts of a fixed strategy, with legs left out as ``which`` says."""
    how, legs = parsed(name), p.legs(conf, **which)
    ngram = p.ngram if which.get("ngram", True) else np.zeros(len(p.c), int)
    kb = p.kb if which.get("cluster", True) and p.kb is not None else np.zeros(len(p.c), int)
    named = {"base_only": [p.base], "ngram_only": [ngram], "base+ngram_or": [p.base, ngram], "base+kb_or": [p.base, kb], "base+ngram+kb_or": [p.base, ngram, kb]}
    if how in named:
        return np.maximum.reduce(named[how])
    some = list(legs.values())
    if how.startswith("vote") and full is not None:
        how = f"vote{ablated_votes(int(how[4:]), full, len(some))}"
    return voted(some, how)


def pick(p: Profiles, default: float = 0.5, tuned: bool = True, fixed: float | None = None) -> tuple[str, float, float]:
    """(strategy, confidence, F1 on validation): simple unions first, then ``tune`` if strictly better; the F1 is that of
    the strategy as it will be applied."""
    best, f1, conf = "base_only", p.f1(p.base), default
    tries = [("base+ngram_or", np.maximum(p.base, p.ngram))]
    if p.kb is not None:
        tries += [("base+kb_or", np.maximum(p.base, p.kb)), ("base+ngram+kb_or", np.maximum.reduce([p.base, p.ngram, p.kb]))]
    for name, pred in [*tries, ("base+residual_ngram", np.maximum(p.base, p.ngram))]:
        if (x := p.f1(pred)) > f1 + 1e-9:
            best, f1 = name, x
    if tuned and p.c.sum():
        c, name, x = tune(p, fixed)
        if x > f1 + 1e-9:
            best, conf = name, c
    conf = conf if conf in p.llm else next(iter(p.llm))
    return best, conf, p.f1(applied(p, conf, best, len(p.legs(conf))))


def ablations(p: Profiles, conf: float, name: str) -> list[tuple[str, float]]:
    """F1 of the full fusion, and of those without one of the legs; a vote shrinks with the legs."""
    full = len(p.legs(conf))
    runs = [("full", {})] + [(f"no_{n}", {k: False}) for n, k in (("llm", "llm"), ("ngram", "ngram"), ("cluster", "cluster")) if n != "cluster" or p.kb is not None]
    return [(n, p.f1(applied(p, conf, name, full, **which))) for n, which in runs]


def tune_two_sided(legs: DataFrame, high: tuple[float, ...] = HIGH, low: tuple[float, ...] = LOW) -> DataFrame:
    """(hi, low, f1) of the vote alone, for each pair of the grid, with its place ``idx`` in it: one aggregate."""
    grid = [(i * len(low) + j, h, x) for i, h in enumerate(high) for j, x in enumerate(low)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(h).alias("hi"), F.lit(x).alias("low"), vote(F.col("risk"), F.col("conf"), h, x).alias("v")) for i, h, x in grid]))
    rows = legs.select("label", each.alias("x")).select("label", "x.*")
    v, y = F.col("v"), F.col("label")
    out = rows.groupBy("idx", "hi", "low").agg(F.sum(v * y).alias("tp"), F.sum(v * (1 - y)).alias("fp"), F.sum((1 - v) * y).alias("fn"))
    double = 2.0 * F.col("tp")
    return out.withColumn("f1", F.when(F.col("tp") > 0, double / (double + F.col("fp") + F.col("fn"))).otherwise(0.0))


def judged(risk: Column, conf: Column, least: float, rules: Column, kb: Column | None, low: float | None = None, symbolic: bool = True) -> Column:
    v = vote(risk, conf, least, low)
    return gate(v, rules, kb) if symbolic and kb is not None else v


def verdict(name: str, base: Column, llm: Column, ngram: Column, kb: Column | None = None, kept: tuple[str, ...] = ("base", "llm", "ngram", "kb")) -> Column:
    """A strategy as a column; ``kept`` names the legs that the leg filter left."""
    zero = lambda c: F.coalesce(c, F.lit(0)) if c is not None else F.lit(0)
    how = parsed(name)
    named = {"base_only": [base], "ngram_only": [ngram], "base+ngram_or": [base, ngram], "base+kb_or": [base, kb], "base+ngram+kb_or": [base, ngram, kb]}
    if how in named:
        cols = [zero(c) for c in named[how]]
        return F.greatest(*cols) if len(cols) > 1 else cols[0]
    legs = {"base": base, "llm": llm, "ngram": ngram, "kb": kb}
    return fuse([c for n, c in legs.items() if c is not None and n in kept], how)


def confident(prob: Column, base: Column, fused: Column, lo: float = 0.05, hi: float = 0.95) -> Column:
    """The base verdict where its probability leaves no doubt, else the fused one."""
    return F.when((prob <= lo) | (prob >= hi), base).otherwise(fused)


def shortcut(base: Column, ngram: Column, way: str | None = None) -> Column | None:
    """The rules alone, or with the base, in place of the whole fusion; None unless asked for."""
    return {"ngram_only": ngram, "base+ngram": F.greatest(base, ngram)}.get(way or "")
