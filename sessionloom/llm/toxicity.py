"""Toxicity by cumulative-link ordinal regression.

P(grade > j) = logistic(w.x - t_j): one weight vector shared by all ordered thresholds t_1 < t_2 < ..., over sparse
binary word features. The output is the expected grade. Words are runs of letters, digits and non-ASCII bytes,
lower-cased; a bounded number of the most telling word hashes is kept.

Grades: 0 is not toxic. Labelled toxic rows are graded 1 to ``GRADES`` - 1 by the share of their words that are telling,
cut at the quantiles of that share. The fit reads a bounded sample: at most about ``per_class`` rows of each label.

Defined results: a null, empty or wordless text has no features and gets the base rate's severity; without both labels
nothing can be learned, and every severity is 0 and no row is flagged; rows with null label are not learned from;
repeated rows and null ids are scored like any others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import slices, utf8, word_hashes

#: Features are words whose log odds are this many deviations from even, and eight at least.
GRADES, FEATURES, TELLING = 3, 2048, 3.0

_BREAK = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[_a:_b] = False


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each text, with offsets."""
    data, off = utf8(column)
    clean = np.where(_BREAK[data], np.uint8(32), data) if len(data) else data
    starts, ends, doc = common.word_spans(clean, off)
    with np.errstate(over="ignore"):
        h = word_hashes(clean, starts, ends)
    first = np.searchsorted(doc, np.arange(len(off)))
    got = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return (np.concatenate(got) if got else h[:0]), np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int64)


class OrdinalModel:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.keys, self.weights, self.cuts = keys, weights, cuts

    def above(self, values: np.ndarray, off: np.ndarray) -> np.ndarray:
        """P(grade > j) of each text, for each j."""
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        part = np.where(self.keys[at] == values, self.weights[at], 0.0)
        sums = np.concatenate(([0.0], np.cumsum(part)))
        z = (sums[off[1:]] - sums[off[:-1]])[:, None] - self.cuts[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(values: np.ndarray, off: np.ndarray, toxic: np.ndarray) -> OrdinalModel | None:
    if not (toxic.any() and (~toxic).any()):
        return None
    owner = np.repeat(np.arange(len(toxic)), np.diff(off))
    keys, code = np.unique(values, return_inverse=True)
    bad = np.bincount(code, toxic[owner], len(keys))
    good = np.bincount(code, ~toxic[owner], len(keys))
    nb, ng = toxic.sum(), (~toxic).sum()
    odds = np.log((bad + 0.5) / (nb + 1)) - np.log((good + 0.5) / (ng + 1))
    telling = odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    chosen = np.argsort(-np.abs(telling), kind="stable")[:FEATURES]
    chosen = np.sort(chosen[(np.abs(telling[chosen]) > TELLING) | (np.arange(len(chosen)) < 8)])
    place = np.full(len(keys), -1)
    place[chosen] = np.arange(len(chosen))
    col, keep = place[code], place[code] >= 0
    col, row = col[keep], owner[keep]
    # severity of the toxic rows: the share of their words that speak for toxicity
    marked = np.bincount(owner, (telling[code] > 4.0), len(toxic)) / np.maximum(np.diff(off), 1)
    edges = np.quantile(marked[toxic], np.arange(1, GRADES - 1) / (GRADES - 1)) if GRADES > 2 else np.zeros(0)
    grade = np.where(toxic, 1 + np.searchsorted(edges, marked, "left"), 0)
    w, cuts = np.zeros(len(chosen)), np.linspace(0.0, 2.0, GRADES - 1)
    gaps = np.log(np.diff(cuts)) if GRADES > 2 else np.zeros(0)
    params = [w, cuts[:1].copy(), gaps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, 401):
        t_j = params[1][0] + np.concatenate(([0.0], np.cumsum(np.exp(params[2]))))
        z = np.bincount(row, params[0][col], len(toxic))[:, None] - t_j[None, :]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        # likelihood of a grade: difference of neighbouring cumulative probabilities
        hi = np.concatenate((np.ones((len(z), 1)), s), axis=1)[np.arange(len(z)), grade]
        lo = np.concatenate((s, np.zeros((len(z), 1))), axis=1)[np.arange(len(z)), grade]
        p = np.maximum(hi - lo, 1e-9)
        slope = s * (1 - s)
        g = np.zeros_like(z)
        has = grade > 0
        g[np.flatnonzero(has), grade[has] - 1] -= slope[np.flatnonzero(has), grade[has] - 1] / p[has]
        not_top = grade < GRADES - 1
        g[np.flatnonzero(not_top), grade[not_top]] += slope[np.flatnonzero(not_top), grade[not_top]] / p[not_top]
        g /= len(z)
        total = g.sum(axis=1)
        grads = [np.bincount(col, total[row], len(w)) + 1e-4 * params[0], np.array([-g.sum()]), np.array([-(g[:, j + 1 :].sum()) * np.exp(params[2][j]) for j in range(len(gaps))])]
        for j, (q, d) in enumerate(zip(params, grads, strict=True)):
            m[j] += 0.1 * (d - m[j])
            v[j] += 0.01 * (d * d - v[j])
            q -= 0.05 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
    cuts = params[1][0] + np.concatenate(([0.0], np.cumsum(np.exp(params[2]))))
    return OrdinalModel(keys[chosen], params[0], cuts)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values, off = word_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))], ["toxic", "words"])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> OrdinalModel | None:
    """Fit on at most about ``per_class`` labelled rows of each label; only their word hashes come to the driver."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    share = F.when(F.col("toxic"), min(1.0, per_class / counts[True])).otherwise(min(1.0, per_class / counts[False]))
    chosen = known.where(hashed < share).orderBy(F.xxhash64("doc_id", F.lit(43)), "doc_id").limit(4 * per_class)
    # at most 4 * per_class pairs of a number and a flag: safe to broadcast
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic").mapInArrow(_features, "toxic boolean, words array<long>").toArrow()
    words = got.column("words").combine_chunks()
    toxic = got.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
    sizes = np.array([len(x) for x in words], np.int64) if got.num_rows else np.zeros(0, np.int64)
    return fit(words.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(sizes))), toxic) if got.num_rows else None


def _score(model: OrdinalModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                above = np.zeros((part.num_rows, GRADES - 1)) if model is None else model.above(*word_sets(part.column("text")))
                chance = np.concatenate((np.ones((part.num_rows, 1)), above), axis=1) - np.concatenate((above, np.zeros((part.num_rows, 1))), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(above.sum(axis=1)), pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], ["id", "severity", "grade", "p_toxic", "toxic"])

    return run


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade), grade (likeliest), p_toxic = P(grade > 0), toxic, of every row of ``docs``."""
    model = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "id long, severity double, grade int, p_toxic double, toxic boolean").withColumnRenamed("id", "doc_id")
