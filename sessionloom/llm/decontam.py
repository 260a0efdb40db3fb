"""Benchmark decontamination: n-gram seeds join training passages to test items, then Smith-Waterman alignment scores
paraphrased or edited copies.

Seeds are the items' word n-grams. One pass of an Aho-Corasick automaton over each normalised text finds them all and
cuts out the passages around them. No seed is dropped for being frequent: each passage with at least one seed of an item
is aligned word by word with it, unless they have too few words in common to reach ``LEAST``.

The items are read in blocks of bounded size (``BLOCK_CHARS``), one pass over the corpus each, so nothing that is
broadcast grows with the benchmark.

Defined results: null or wordless texts and items take part in nothing; repeated items are scored under each item_id;
an item of fewer than ``SEED`` words is one seed; null ids are ignored; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning

SEED, LEAST, BLOCK_CHARS = 4, 0.5, 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_FANCY = re.compile("[\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u3003\uff01-\uff0f]")


def normalised(text: str) -> str:
    """Lower-cased words without punctuation, joined by single spaces, with one at either end."""
    text = text.lower()
    if not text.isascii() and _FANCY.search(text):
        text = _FANCY.sub(" ", text)
    return f" {b' '.join(text.encode('utf-8', 'replace').translate(_BREAKS).split()).decode()} "


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Smith-Waterman score of two word sequences, a row at a time; gaps within a row come from a running maximum."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    row, best = np.zeros(n + 1, np.int64), 0
    for w in item:
        up = np.empty(n + 1, np.int64)
        up[0] = 0
        np.maximum(row[:-1] + np.where(passage == w, MATCH, MISMATCH), row[1:] + GAP, out=up[1:])
        np.maximum(up, 0, out=up)
        row = np.maximum.accumulate(up + ramp) - ramp
        best = max(best, int(row.max()))
    return best


class Seeds:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, normalised(t).split()) for i, t in items]
        self.of: dict[str, list[int]] = {}  # seed -> places in items
        for at, (_, words) in enumerate(self.items):
            n = min(SEED, len(words))
            for g in {" ".join(words[j : j + n]) for j in range(len(words) - n + 1)} if words else ():
                self.of.setdefault(f" {g} ", []).append(at)
        self.names = sorted(self.of)
        self.longest = max((len(w) for _, w in self.items), default=0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, g in enumerate(self.names):
            a.add_word(g, k)
        a.make_automaton()
        return a


def _passages(seeds: Seeds):
    """(id, seeds met in the passage, its words) for each passage around seeds, of whole texts."""
    widest = max((sum(len(w) + 1 for w in words) for _, words in seeds.items), default=0)
    margin = widest + widest // 4 + 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = seeds.automaton()
        for batch in batches:
            ids, met, words = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = x.as_py()
                if not raw:
                    continue
                text = normalised(raw)
                hits: list[list] = []  # from, to, seeds
                for end, k in found.iter(text):
                    a, b = max(0, end - margin), min(len(text), end + margin)
                    # seeds less than an item apart share a passage, of at most about four items' length
                    if hits and a < hits[-1][1] - margin and b - hits[-1][0] <= 4 * margin:
                        hits[-1][1] = b
                        hits[-1][2].add(k)
                    else:
                        hits.append([a, b, {k}])
                for a, b, some in hits:
                    ids.append(i)
                    met.append(sorted(some))
                    words.append(text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(met, pa.list_(pa.int32())), pa.array(words, pa.string())], ["id", "seeds", "words"])

    return run


def _aligned(seeds: Seeds):
    """Aligns each passage with every item of which it holds a seed. A score is at most ``MATCH`` for each word that both
    have, so a pair with too few words in common is known to fall short of ``LEAST`` and is not aligned."""
    joins = [seeds.of[g] for g in seeds.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = [Counter(words) for _, words in seeds.items]
        for batch in batches:
            doc, item, score = [], [], []
            for i, some, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bag = Counter(text.split())
                passage = None
                for at in sorted({at for k in some for at in joins[k]}):
                    name, words = seeds.items[at]
                    if sum(min(n, bag[w]) for w, n in bags[at].items() if w in bag) < LEAST * len(words):
                        continue
                    if passage is None:
                        codes = {w: k for k, w in enumerate(bag)}
                        passage = np.array([codes[w] for w in text.split()])
                    got = align(np.array([codes.get(w, -1) for w in words]), passage) / (MATCH * len(words))
                    if got >= LEAST:
                        doc.append(i)
                        item.append(name)
                        score.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "item_id", "score"])

    return run


def _met(seeds: Seeds):
    """Passages and their alignment in one worker: two maps in a row would hold two for each task, and the seeds twice."""
    passages, aligned = _passages(seeds), _aligned(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return aligned(passages(batches))

    return returning(run)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1) -> DataFrame:
    """(doc_id, item_id, score) of every document and item that a passage aligns with, at a score of ``LEAST`` or more;
    the score is 1 for a whole verbatim copy. Items of fewer than ``least_words`` words take no part: a text that holds
    one or two everyday words is no copy of anything."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    found = []
    for b in range(blocks):
        seeds = Seeds([(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect() if len(normalised(r["text"]).split()) >= least_words])
        if not seeds.names:
            continue
        found.append(rows.mapInArrow(_met(seeds), "doc_id long, item_id long, score double"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
