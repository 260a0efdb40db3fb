"""Byte-level BPE encoding and decoding in linear time.

Bytes map to Latin-1 characters so that an Aho-Corasick automaton over all tokens finds the longest match that starts
at a place. Encoding backtracks from longest matches: a token may follow another only if the merges of the two, undone
in reverse, never offer an earlier merge across their border (memoised for each pair). Places shown to be dead ends
are never tried again, so the work is linear in the piece. Pieces are cut by the pattern first; recurring short
pieces are looked up in a bounded cache.

Defined results: a null text is empty (no ids); an empty text gives no ids and the hash of nothing; special-token
strings are ordinary text; repeated rows and null ids are encoded like any others; very long pieces are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning

CACHE, SHORT = 500_000, 48


class BytePairCodec:
    """Encoder and decoder for a rank file (base64 token, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        full = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.cut_any = regex.compile(full).findall
        for name in (r"\p{L}", r"\p{N}", r"\p{White_Space}", r"\P{White_Space}"):
            members = "".join(re.escape(c) if c.isascii() else c for c in map(chr, range(256)) if regex.match(name, c))
            full = full.replace(f"[{name}]", f"[{members}]").replace(name, f"\ue000{members}\ue000")
        # inside a class the members stand as they are, outside they make a class
        parts, inside, out = full.split("\ue000"), False, []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part if inside else f"[{part}]")
            else:
                out.append(part)
                plain = re.sub(r"\\.", "", part)
                inside = plain.rfind("[") > plain.rfind("]") if "[" in plain or "]" in plain else inside
        self.cut_latin = re.compile("".join(out)).findall
        self.token = {i: t for t, i in ranks.items()}
        self.whole = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.pairs: dict[int, int] = {}  # left << 32 | right: the token that the two merge to
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        # tokens in the order of merging; a token that no two earlier ones make is met only as a whole piece
        known = ahocorasick.Automaton()  # of the reversed tokens
        single = set()
        for t, i in ranks.items():
            if len(t) == 1:
                self.parts[i] = (i, i)
                single.add(i)
        for i in sorted(self.token):
            t = self.token[i]
            if len(t) > 1:
                for at in range(len(t) - 1, 0, -1):
                    a, b = ranks.get(t[:at]), ranks.get(t[at:])
                    if a is not None and b is not None and a in self.parts and b in self.parts and (a < i or a in single) and (b < i or b in single) and self._may_follow(a, b, i):
                        self.parts[i] = (a, b)
                        self.pairs[a << 32 | b] = i
                        break
        self.fits.clear()
        for i in self.parts:
            known.add_word(self.token[i].decode("latin-1")[::-1], i)
        known.make_automaton()
        self.known = known
        # the longest token that is a proper prefix of a token
        self.shorter: dict[int, int] = {}
        for i in self.parts:
            t = self.token[i]
            for n in range(len(t) - 1, 0, -1):
                j = ranks.get(t[:n])
                if j is not None and j in self.parts:
                    self.shorter[i] = j
                    break
        self.names: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def _may_follow(self, left: int, right: int, ceiling: int | None = None) -> bool:
        """Whether merging leaves ``left`` and ``right`` beside each other: unwinds their merges, latest first, and
        looks at each stage for a merge across the border that would have come earlier. ``ceiling``: while the
        vocabulary is built, only merges below it exist."""
        at = left << 32 | right
        if ceiling is None and (seen := self.fits.get(at)) is not None:
            return seen
        bound, a, b, fine = 1 << 62 if ceiling is None else ceiling, left, right, True
        while True:
            joint = self.pairs.get(a << 32 | b)
            if joint is not None and joint < bound:
                fine = False
                break
            pa_, pb_ = self.parts[a], self.parts[b]
            open_a, open_b = pa_[0] != a or pa_[1] != a, pb_[0] != b or pb_[1] != b
            if not (open_a or open_b):
                break
            # of the two, the later merge is undone; on a tie the left one was merged first, so the right one goes
            if open_a and (not open_b or a > b):
                bound, a = a, pa_[1]
            else:
                bound, b = b + 1, pb_[0]
        if ceiling is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[at] = fine
        return fine

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        text = raw.decode("latin-1")
        if (one := self.whole.get(text)) is not None:
            return [one]
        n, token, shorter, fits = len(text), self.token, self.shorter, self._may_follow
        longest, last = [0] * n, -1  # of the tokens that start at each place
        for end, i in self.known.iter(text[::-1]):  # read backwards: all that start at a place, longest first
            if end != last:
                longest[n - 1 - end] = i
                last = end
        out: list[int] = []
        dead = bytearray(n + 1)
        at, i = 0, longest[0] if n else -1
        while at < n:
            while True:
                to = at + len(token[i])
                if not dead[to] and (not out or fits(out[-1], i)):
                    out.append(i)
                    at = to
                    i = longest[at] if at < n else -1
                    break
                if (s := shorter.get(i)) is not None:
                    i = s
                    continue
                dead[at] = 1
                i = out.pop()
                at -= len(token[i])
        return out

    def cut(self, text: str) -> list[str]:
        """The pattern's matches; a text of Latin-1 characters only takes the same pattern with its classes spelled out."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.cut_any(text)
        return self.cut_latin(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.cut(text):
            out += self.piece(p.encode())
        return out

    def _names(self, pieces: list[str]) -> list[str]:
        """The ids of each piece, joined by commas."""
        got = list(map(self.names.get, pieces))
        if None in got:
            for k, name in enumerate(got):
                if name is None and (name := self.names.get(p := pieces[k])) is None:
                    name = ",".join(map(str, self.piece(p.encode())))
                    if len(p) <= SHORT:
                        if len(self.names) >= CACHE:
                            self.names.clear()
                        self.names[p] = name
                got[k] = name
        return got

    def _raw(self, names: list[str]) -> list[bytes]:
        """What each run of ids decodes to."""
        got = list(map(self.raw.get, names))
        if None in got:
            for k, raw in enumerate(got):
                if raw is None:
                    raw = self.decode(map(int, names[k].split(",")))
                    if len(raw) <= SHORT:
                        if len(self.raw) >= CACHE:
                            self.raw.clear()
                        self.raw[names[k]] = raw
                got[k] = raw
        return got

    def forget(self) -> None:
        """Empties the caches; a task fills them again in its first texts."""
        self.names, self.raw, self.fits = {}, {}, {}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, hash of the ids, hash of the bytes they decode to; a long text is hashed part by part."""
        ids_hash, back, n = hashlib.sha256(), hashlib.sha256(), 0
        pieces = self.cut(text)
        for at in range(0, len(pieces), 8192):
            names = self._names(pieces[at : at + 8192])
            joined = ",".join(names)
            ids_hash.update(((("," if at else "") + joined)).encode())
            back.update(b"".join(self._raw(names)))
            n += joined.count(",") + 1
        return n, ids_hash.hexdigest(), back.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each worker process."""
    return BytePairCodec(path, pattern)


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [c.digest(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["id", "n", "a", "b"])
        c.forget()

    return returning(run)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_tokens, ids_sha256, decoded_sha256. A narrow, stateless map over whole texts."""
    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_encode(path, pattern), "id long, n long, a string, b string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [c.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"])
        c.forget()

    return returning(run)


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves and the bytes they decode to."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_ids(path, pattern), "id long, ids array<int>, decoded binary").toDF(id_col, "token_ids", "decoded")
