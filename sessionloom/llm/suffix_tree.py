"""Language-model scoring by a probabilistic suffix tree.

Symbols are the bytes of a text's words (lower-cased A-Z, words joined by one space, then an end symbol). The counts of
all windows of ``DEPTH`` + 1 symbols over all training texts are summed in Spark. A context of up to ``DEPTH`` symbols
stays in the tree if it occurs at least ``FEWEST`` times, whatever the corpus size, and its next-symbol distribution
diverges from its parent's (the context without its oldest symbol) by more than the description length of its counts.
Next-symbol distributions are smoothed towards their parent's. A text is scored by the longest suffix state at each symbol.

The tree is a table of the windows of all texts and their probabilities, made in groups of contexts that end in the same
two symbols; only the contexts of up to one symbol (65,536 pairs at most) come to the driver. ``SuffixTree`` is the same
model in one process, for counts that fit there; the tests hold the table against it.

Beside it stands the base score: each token's add-one unigram probability. Neither the counts of all words nor the tree
are ever gathered or broadcast: each block of texts asks for its own words and windows.

Defined results: a null or empty text is the end token alone; with no training texts N is 0, every count is 0 and the
model is uniform; a null id is never held out; repeated rows are scored (and learned from) once each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, durable, slices, utf8, word_hashes, word_spans

DEPTH, FEWEST, END = 5, 2, 10
BLOCK_BYTES = 16 << 20


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def stream(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols: each begins with DEPTH end symbols (its empty past), then words joined by single spaces,
    then the end; and the offsets of the texts in it."""
    starts, ends, doc = word_spans(data, off)
    texts = len(off) - 1
    size = ends - starts + 1  # each word and the space or end after it
    words = np.bincount(doc, minlength=texts)
    length = np.bincount(doc, size, texts).astype(np.int64)
    length[words == 0] = 1
    at = np.concatenate(([0], np.cumsum(length + DEPTH)))
    out = np.full(int(at[-1]), END, np.uint8)
    if len(starts):
        before = np.concatenate(([0], np.cumsum(size)))[:-1]
        first = np.concatenate(([0], np.cumsum(words)))[:-1]
        base = np.where(words > 0, before[np.minimum(first, len(before) - 1)], 0)
        place = at[doc] + DEPTH + before - base[doc]
        n = ends - starts
        total = int(n.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(place, n) + inner] = LOWER[data[np.repeat(starts, n) + inner]]
        last = np.zeros(len(starts), bool)
        last[np.cumsum(words)[words > 0] - 1] = True
        out[(place + n)[~last]] = 32
    return out, at


def _windows(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The window of DEPTH + 1 symbols that ends at each symbol of the texts of a stream, as one number."""
    key = np.zeros(max(0, len(s) - DEPTH), np.int64)
    for j in range(DEPTH + 1):
        key = key << 8 | s[j : len(key) + j]
    real = np.ones(len(s), bool)
    for j in range(DEPTH):
        real[at[:-1] + j] = False
    return key[real[DEPTH:]]


def _distinct(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and their counts: a plain sort is several times as fast as np.unique."""
    k = np.sort(k)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[first], np.diff(np.append(first, len(k)))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of a task's texts and their counts in training texts: a partial aggregate."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], ["gram", "c"])

    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            s, at = stream(*utf8(part.column("text")))
            train = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            key, learned = _windows(s, at), np.repeat(train, np.diff(at) - DEPTH)
            held.append(_distinct(key[learned]))
            other = _distinct(key[~learned])[0]
            held.append((other, np.zeros(len(other), np.int64)))
            if sum(len(x[0]) for x in held) > 1_500_000:
                held[:] = [_summed(held)]
                if len(held[0][0]) > 1_000_000:
                    yield out(*held.pop())
    if held:
        yield out(*_summed(held))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram) for each distinct window of each block; a task holds whole blocks."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            s, at = stream(*utf8(part.column("text")))
            k, block = _windows(s, at), np.repeat(part.column("block").to_numpy(), np.diff(at) - DEPTH)
            for b in np.unique(block):
                mine = held.setdefault(int(b), [])
                mine.append(_distinct(k[block == b])[0])
                if len(mine) > 8:
                    mine[:] = [_distinct(np.concatenate(mine))[0]]
    for b in list(held):
        k = _distinct(np.concatenate(held.pop(b)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), b, np.int32)), pa.array(k)], ["block", "gram"])


def refined(g: np.ndarray, c: np.ndarray, p: np.ndarray, d: int) -> np.ndarray:
    """From the probability of each window's last symbol after d - 1 symbols, that after d symbols. All windows of a
    context of d symbols are in ``g``."""
    if not len(g):
        return p
    u, some, code = np.unique(g & ((1 << 8 * (d + 1)) - 1), return_index=True, return_inverse=True)
    n_s, up = np.bincount(code, c, len(u)), p[some]
    first = np.flatnonzero(np.concatenate(([True], u[1:] >> 8 != u[:-1] >> 8)))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
    n, seen = np.add.reduceat(n_s, first), np.add.reduceat((n_s > 0).astype(float), first)
    gains = np.zeros(len(u))
    had = n_s > 0
    gains[had] = n_s[had] * np.log(n_s[had] / n[of][had] / up[had])
    keep = (n >= FEWEST) & (np.add.reduceat(gains, first) > 0.5 * seen * np.log(n + 1))
    own = (n_s + seen[of] * up) / np.maximum(n + seen, 1)[of]
    return np.where(keep[of], own, up)[code]


def _logs(short: np.ndarray):
    """log10 probabilities of the windows of one group; ``short`` has them after one symbol, by the last two symbols."""

    def run(rows: pa.Table) -> pa.Table:
        g, c = rows.column("gram").to_numpy(), rows.column("c").to_numpy()
        p = short[g & 0xFFFF]
        for d in range(2, DEPTH + 1):
            p = refined(g, c, p, d)
        return pa.table([pa.array(g), pa.array(np.log10(p).astype(np.float32))], ["gram", "log"])

    return run


def learn(rows: DataFrame) -> DataFrame:
    """(gram, log) of every window of ``rows`` (text, held_out), by the tree of the rows that are not held out."""
    grams = durable(rows.select("text", "held_out").mapInArrow(_grams, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")))
    # at most one row for each pair of bytes
    got = grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("g")).agg(F.sum("c").alias("c")).toArrow()
    g, c = got.column("g").to_numpy(), got.column("c").to_numpy()
    one = np.bincount(g & 255, c, 256)
    short = np.full(1 << 16, 1 / 256)
    short[g] = refined(g, c, ((one + 1 / 256) / (one.sum() + 1))[g & 255], 1)
    ending = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    return grams.groupBy(ending.alias("ending")).applyInArrow(_logs(short), "gram long, log float")


#: Transitions and distributions of the tree that this process used last, by its key.
_opened: dict[str, tuple[np.ndarray, np.ndarray]] = {}


class SuffixTree:
    """Automaton over all frequent contexts; a context that the divergence test drops scores as its longest kept suffix."""

    def __init__(self, levels: Iterable[dict[int, dict[int, int]]]):
        """Of each level in turn, contexts of d symbols -> next symbol -> count. Only one level is held at a time, and
        only the distributions that are kept; the transitions are made where texts are scored, not on the driver."""
        ids, rows, table = {0: 0}, [0], []
        self.depth, self.ctx, self.kept = [0], [0], 0
        up = {0: np.full(256, 1 / 256)}
        for d, level in enumerate(levels):
            if d == 0:
                c = np.zeros(256)
                for s, n in level.get(0, {}).items():
                    c[s] = n
                up[0] = (c + 1 / 256) / (c.sum() + 1)
                table.append(np.log10(up[0]).astype(np.float32))
                continue
            mask, deeper, probs = (1 << 8 * (d - 1)) - 1, {}, {}
            for ctx in sorted(level):
                parent = ids.get(ctx & mask)
                if parent is None:
                    continue
                follow, row = level[ctx], rows[parent]
                c = np.zeros(256)
                c[list(follow)] = list(follow.values())
                n, seen = c.sum(), c > 0
                gain = float((c[seen] * np.log(c[seen] / n / up[row][seen])).sum())
                deeper[ctx] = len(rows)
                if gain > 0.5 * seen.sum() * np.log(n + 1):
                    strength = float(seen.sum())
                    probs[len(table)] = (c + strength * up[row]) / (n + strength)
                    rows.append(len(table))
                    table.append(np.log10(probs[len(table)]).astype(np.float32))
                    self.kept += 1
                else:
                    probs[row] = up[row]
                    rows.append(row)
                self.depth.append(d)
                self.ctx.append(ctx)
            ids, up = deeper, probs
        if not table:
            table.append(np.log10(up[0]).astype(np.float32))
        self.rows, self.table = np.array(rows, np.int32), np.array(table)
        self.depth, self.ctx, self.key = np.array(self.depth), np.array(self.ctx, np.int64), uuid.uuid4().hex

    def _open(self) -> None:
        """Transitions between states, and the distribution of each."""
        step = np.zeros((len(self.rows), 256), np.int32)
        symbols = np.arange(256, dtype=np.int64)
        for d in range(1, int(self.depth.max()) + 1):  # deeper matches overwrite shallower ones
            which = np.flatnonzero(self.depth == d)
            which = which[np.argsort(self.ctx[which])]
            keys = self.ctx[which]
            for rows in np.array_split(at := np.flatnonzero(self.depth >= d - 1), 1 + len(at) // 4096):
                want = (self.ctx[rows][:, None] << 8 | symbols[None, :]) & ((1 << 8 * d) - 1)
                place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                step[rows] = np.where(keys[place] == want, which[place], step[rows])
        self.step, self.log = step.ravel(), self.table[self.rows].ravel()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("step", "log")}

    def score(self, s: np.ndarray, at: np.ndarray, lane: int = 512) -> np.ndarray:
        """log10 probability of each text of a stream. A state depends on the last DEPTH symbols alone, so lanes of
        the stream run side by side after that many symbols of warm-up."""
        if not hasattr(self, "step"):
            if self.key not in _opened:  # a worker process serves many tasks
                _opened.clear()
                self._open()
                _opened[self.key] = self.step, self.log
            self.step, self.log = _opened[self.key]
        lanes = -(-len(s) // lane)
        padded = np.full(DEPTH + lanes * lane, END, np.uint8)
        padded[DEPTH : DEPTH + len(s)] = s
        view = np.lib.stride_tricks.as_strided(padded, (lanes, lane + DEPTH), (lane, 1)).T.astype(np.int32)
        state, out = np.zeros(lanes, np.int32), np.empty((lane, lanes), np.float32)
        for t in range(lane + DEPTH):
            cell = state * 256 + view[t]
            if t >= DEPTH:
                np.take(self.log, cell, out=out[t - DEPTH])
            state = self.step.take(cell)
        flat = out.T.ravel()[: len(s)].astype(np.float64)
        for j in range(DEPTH):
            flat[at[:-1] + j] = 0.0
        return np.add.reduceat(flat, at[:-1]) if len(at) > 1 else flat[:0]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word) for each distinct word of each block; a task holds whole blocks."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            doc, h = _words(part.column("text"))
            block = part.column("block").to_numpy()[doc]
            for b in np.unique(block):
                k = np.unique(h[block == b])
                mine = held.setdefault(int(b), [])
                mine.append((k, np.ones(len(k))))
                if len(mine) > 16:
                    mine[:] = [_summed(mine)]
    for b, parts in held.items():
        k, _ = _summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), b, np.int32)), pa.array(k.view(np.int64))], ["block", "word"])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(column)
    starts, ends, doc = word_spans(data, off)
    with np.errstate(over="ignore"):
        return doc, word_hashes(data, starts, ends)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task's training texts: a partial aggregate, given out whenever it grows large."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            held.append(np.unique(_words(part.column("text"))[1], return_counts=True))
            if len(held) > 16:
                held[:] = [_summed(held)]
            if len(held[0][0]) > 1_000_000:
                k, c = _summed(held)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "c"])
    if held:
        k, c = _summed(held)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "c"])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, code = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return k, np.bincount(code, np.concatenate([p[1] for p in parts]), len(k))


def _score(n_all: int, v: int, ends_c: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, c, log = (right.column(x).to_numpy() for x in ("key", "c", "log"))
        keys, counts, grams, logs10 = key[c >= 0].view(np.uint64), c[c >= 0], key[c < 0], log[c < 0]
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        order = np.argsort(grams)
        grams, logs10 = grams[order], logs10[order]
        out = []
        for batch in left.select(["id", "text", "held_out"]).combine_chunks().to_batches():
            for part in slices(batch, "text", 1 << 20):
                data, off = utf8(part.column("text"))
                starts, ends, doc = word_spans(data, off)
                with np.errstate(over="ignore"):
                    h = word_hashes(data, starts, ends)
                c = np.zeros(len(h), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    c = np.where(keys[at] == h, counts[at], 0)
                texts = part.num_rows
                words = np.bincount(doc, minlength=texts)
                logs = np.log10((c + 1) / (n_all + v + 1))
                base = np.bincount(doc, logs, texts) + np.log10((ends_c + 1) / (n_all + v + 1))
                known = np.bincount(doc, c > 0, texts).astype(np.int64) + (ends_c > 0)
                s, at = stream(data, off)
                windows = _windows(s, at)
                order = np.argsort(windows)  # a search in ascending order stays in the cache
                each = np.empty(len(windows))
                each[order] = logs10[np.searchsorted(grams, windows[order])]
                score = np.add.reduceat(each, at[:-1] - DEPTH * np.arange(texts))
                out.append(pa.table([part.column("id"), part.column("held_out"), pa.array(words + 1), pa.array(known), pa.array(np.full(texts, n_all)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("id")))
    logs = learn(rows)
    total, ends_c = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held_out"), 1))).first()
    blocks = max(1, -(-(total or 0) // BLOCK_BYTES))
    per_word = durable(rows.where("not held_out").select("text").mapInArrow(counted, "word long, c long").groupBy("word").agg(F.sum("c").alias("n")))
    # one exchange of the texts by block serves all uses
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.xxhash64("text"))), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    known = dealt.mapInArrow(_vocabulary, "block int, word long").join(per_word, "word").select("block", F.col("word").alias("key"), F.col("n").alias("c"), F.lit(0.0).cast("float").alias("log"))
    known = known.unionByName(dealt.mapInArrow(_asked, "block int, gram long").join(logs, "gram").select("block", F.col("gram").alias("key"), F.lit(-1).cast("long").alias("c"), "log"))
    distinct, sums = per_word.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_all, v = sums + ends_c, distinct + (1 if ends_c else 0)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score(int(n_all), int(v), int(ends_c)), schema)
