"""Language identification by a byte convolutional network.

A text's bytes fall into fixed-length windows. Filters of several widths slide over each window (a filter is a table
of weights for each offset and byte, that is, a convolution of one-hot bytes), the maximum over the window is kept,
and a softmax layer gives language probabilities. A text's prediction is the mean over all its windows, weighted by
their bytes. Everything is trained here in numpy, on a bounded sample.

Bounds (documented parameters): about ``per_lang`` labelled rows of each language and ``chars`` characters from a
hashed place in each are fitted on. Prediction reads whole texts.

Defined results: ``und`` with score 0 for a null text, a text without any letter, or when nothing could be learned
(an empty or unlabelled table); null ids and repeated rows are predicted like any others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import returning, slices, utf8

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 128
UNKNOWN = "und"


class ByteConvNet:
    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.taps = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def _maps(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width, the responses (filters, windows, places)."""
        n = x.shape[1]
        return [sum(t[k].T[:, x[:, k : n - w + 1 + k]] for k in range(w)) for w, t in zip(WIDTHS, self.taps, strict=True)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02) -> None:
        """Adam on the cross-entropy; the gradient of a maximum goes to the place that reached it."""
        rng = np.random.default_rng(5)
        params = [*self.taps, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb, yb = x[rows], y[rows]
                maps = self._maps(xb)
                best = [a.argmax(axis=2) for a in maps]  # filters, windows
                top = [np.take_along_axis(a, b[:, :, None], 2)[:, :, 0].T for a, b in zip(maps, best, strict=True)]
                hidden = np.maximum(np.concatenate(top, axis=1), 0)
                p = _softmax(hidden @ self.out + self.bias)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.taps[i])
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        seen = np.take_along_axis(xb, best[i].T + k, 1)
                        np.add.at(g[k], (seen, np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [hidden.T @ p, p.sum(0)]
                t += 1
                for j, (q, g) in enumerate(zip(params, grads, strict=True)):
                    m[j] += 0.1 * (g - m[j])
                    v[j] += 0.001 * (g * g - v[j])
                    q -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-7)

    def compile(self) -> ByteConvNet:
        """Tables over byte pairs, so that a filter costs a lookup for every two bytes."""
        self.tables = []
        for w, t in zip(WIDTHS, self.taps, strict=True):
            two = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            self.tables.append((two, t[w - 1] if w % 2 else None))
        return self

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window (rows of bytes)."""
        n = x.shape[1]
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        top = []
        for w, (two, last) in zip(WIDTHS, self.tables, strict=True):
            end = n - w + 1
            r = two[0].take(pair[:, :end], axis=0)
            for j, table in enumerate(two[1:], 1):
                r += table.take(pair[:, 2 * j : 2 * j + end], axis=0)
            if last is not None:
                r += last.take(x[:, w - 1 : w - 1 + end], axis=0)
            top.append(r.max(axis=1))
        return _softmax(np.maximum(np.concatenate(top, axis=1), 0) @ self.out + self.bias)

    def texts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text; rows of empty texts are zero."""
        x, owner, weight = cut_windows(data, off)
        out = np.zeros((len(off) - 1, len(self.langs)))
        for at in range(0, len(x), 256):
            p = self.windows(x[at : at + 256]) * weight[at : at + 256, None]
            np.add.at(out, owner[at : at + 256], p)
        return out / np.maximum(np.diff(off), 1)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (the last of each padded with zero bytes), the text of each, and its number of bytes."""
    size = np.diff(off)
    per = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), per)
    first = np.concatenate(([0], np.cumsum(per)))
    room = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    room[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - off[:-1], size)] = data
    weight = np.minimum(WINDOW, size[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
    return room.reshape(-1, WINDOW), owner, weight.astype(np.float64)


def learn(labelled: DataFrame, per_lang: int = 300, chars: int = 1024, most: int = 60_000) -> ByteConvNet | None:
    """Fit on about ``per_lang`` rows (id, text, lang) of each language; with so many languages that these would be more
    than ``most`` rows, on as many fewer of each. Every language that has a text is learned."""
    labelled = labelled.where("lang is not null and text is not null and length(text) > 0")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not counts:
        return None
    per_lang = max(1, min(per_lang, most // len(counts)))
    # a hashed share of each language, about per_lang rows of it
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_lang / r["count"]))) for r in counts], F.lit(0.0))
    hashed = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    start = F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    got = labelled.where(hashed < share).select("lang", F.substring("text", start, F.lit(chars)).alias("text")).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(max(2 * per_lang, 16) * len(counts)).toArrow()
    langs = sorted({x for x in got.column(0).to_pylist()})
    if not langs:
        return None
    data, off = utf8(got.column(1))
    x, owner, weight = cut_windows(data, off)
    y = np.array([langs.index(v) for v in got.column(0).to_pylist()])[owner]
    net = ByteConvNet(langs)
    keep = weight >= 16
    if not keep.any():
        keep = weight > 0
    net.fit(x[keep], y[keep])
    return net


_LETTER = r"\p{L}"


def predicted(text: Column, net: ByteConvNet | None) -> Column:
    """A struct (lang_pred, score) of a text: of a row, only the text leaves the JVM."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for out in _predict(net)(pa.RecordBatch.from_arrays([c.cast(pa.string())], ["text"]) for c in columns):
            yield out.select(["lang_pred", "score"]).to_struct_array()

    # else the optimizer would compute it once for a filter and once more for its columns
    return F.arrow_udf(run, "struct<lang_pred:string,score:double>").asNondeterministic()(text)


def _predict(net: ByteConvNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if net is not None:
            net.compile()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                letters = pc.fill_null(pc.match_substring_regex(part.column("text"), _LETTER), False).to_numpy(zero_copy_only=False)
                lang, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if net is not None:
                    p = net.texts(*utf8(part.column("text")))
                    best = p.argmax(axis=1)
                    lang = np.where(letters, np.array(net.langs, object)[best], UNKNOWN)
                    score = np.where(letters, np.minimum(p[np.arange(len(best)), best], 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return returning(run)


def predict(rows: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """``rows`` (with a column text) and their lang_pred and score; the model is a few hundred kilobytes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    return rows.mapInArrow(_predict(net), schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang), learned from the rows not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    net = learn(rows.where(~held_out(F.col("id"))))
    # only the text reaches the prediction; lang and source do not
    out = predict(rows.select("id", "text"), net)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
