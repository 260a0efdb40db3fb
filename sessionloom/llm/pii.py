"""Personal data with offset-preserving deobfuscation.

Base detection finds e-mail addresses, IP addresses, card and phone numbers in the text as it stands. Transducers then
rewrite disguises: homoglyphs and full-width forms to ASCII, invisible characters to nothing, runs of spelled digits to
digits, and (at)/(dot) forms to @ and full stops. Each keeps, for every character it puts out, the source span it came
from; identifiers found in the normalised text are mapped back through all transducers. A mapped span is added if it
holds a rewritten character and overlaps no base span; base spans always stay.

Defined results: a null or empty text has no spans (the hash of nothing, an empty list); offsets count code points, ends
are exclusive; repeated rows and null ids are handled like any others; whole texts are read, however long.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the contract's pattern, begun at the first digit of a run only and without giving digits back: the same matches, as a
# beginning that fails does so for the whole run, and no run of digits is read twice
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of [A-Za-z0-9._%+-]+@ and a domain, found from their @ signs: before an @ the match begins
    at the first character of the run, and if the domain fails, it fails for every beginning in that run."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind: leftmost, non-overlapping; failing matches are dropped without another try."""
    found = {"email": emails(text)}
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
    found["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


class Transduced:
    """A text and, for each of its characters, the span of the source it stands for."""

    def __init__(self, text: str, start: list[int] | range, end: list[int] | range, changed: bytearray):
        self.text, self.start, self.end, self.changed = text, start, end, changed

    @classmethod
    def of(cls, text: str) -> Transduced:
        return cls(text, range(len(text)), range(1, len(text) + 1), bytearray(len(text)))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Transduced:
        """Replace spans (ascending, disjoint); each new character stands for the whole span that it replaces."""
        if not edits:
            return self
        text, start, end, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            text.append(new)
            start += [self.start[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            changed += b"\1" * len(new)
            at = b
        text.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        changed += self.changed[at:]
        return Transduced("".join(text), start, end, changed)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


# Letters of other scripts that look like ASCII ones.
_LOOKALIKE = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ABESIJKMHOPCTYXaeijopcyxsdqwhABEZHIKMNOPTYXoavi01234567890123456789", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
_MAYBE = re.compile("[" + "".join(_LOOKALIKE) + _INVISIBLE + "！-～․‧①-⑳Ⓐ-⓪⁰-₉℀-⅏\U0001d400-\U0001d7ff‐-―  -  　]")


def _plain(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if "‐" <= c <= "―":
        return "-"
    if c in "․‧":
        return "."
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() else c


def homoglyphs(t: Transduced) -> Transduced:
    return t.rewrite([(m.start(), m.end(), new) for m in _MAYBE.finditer(t.text) if (new := _plain(m.group())) != m.group()])


# Number words.
_NUMBER = {w: str(d) for words in ("zero one two three four five six seven eight nine", "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(words.split())} | {"oh": "0", "plus": "+", "más": "+", "dash": "-", "hyphen": "-"}
_WORD = "|".join(sorted(map(re.escape, _NUMBER), key=len, reverse=True))
_BETWEEN = r"(?:\x20(?:dot|point|punkt|punto)\x20|[\x20.,()-]{1,3})"
#: On lower-cased text: two number words, or one and a digit in either order, side by side.
_HINT = re.compile(rf"(?:{_WORD}){_BETWEEN}(?:{_WORD}|[0-9])|[0-9]{_BETWEEN}(?:{_WORD})")
_POINT = re.compile(r"(?i)\x20+(?:dot|point|punkt|punto)\x20+")
#: A number by itself: a number word, or digits. Tokens are told first and runs of them found in plain code, so no text is
#: split in more than one way.
_TOKEN = re.compile(rf"(?i)(?<![^\W_])(?:(?P<word>{_WORD})|[0-9]++)(?![^\W_])")
_SEPARATOR = re.compile(r"(?i)\x20(?:dot|point|punkt|punto)\x20|[\x20.,()-]{0,3}")


def _runs(text: str) -> Iterator[list[re.Match]]:
    """The tokens of each run: numbers with nothing but separators between them."""
    run: list[re.Match] = []
    for m in _TOKEN.finditer(text):
        if run and not _SEPARATOR.fullmatch(text, run[-1].end(), min(m.start(), run[-1].end() + 16)):
            yield run
            run = []
        run.append(m)
    if run:
        yield run


def spelled(t: Transduced) -> Transduced:
    """Number words in runs of at least five digits (a word is one), be it one word among digits, become digits; single
    spaces between the words go."""
    if not _HINT.search(t.text.lower()):
        return t
    edits = []
    for run in _runs(t.text):
        words = [m for m in run if m["word"]]
        if not words or sum(1 if m["word"] else m.end() - m.start() for m in run) < 5:
            continue
        last = -1
        for m in words:
            a = m.start()
            if last >= 0 and t.text[last:a] == " ":
                a = last  # the space before goes with the word
            new, last = _NUMBER[m.group().lower()], m.end()
            while new == "+" and t.text[last : last + 1] == " " and m is not run[-1]:
                last += 1  # and those after a plus
            edits.append((a, last, new))
        edits += [(m.start(), m.end(), ".") for m in _POINT.finditer(t.text, run[0].start(), run[-1].end())]
    edits.sort()
    clean, free = [], 0
    for a, b, new in edits:
        if a >= free:
            clean.append((a, b, new))
            free = b
    return t.rewrite(clean)


_AT = r"(?:\x20*[\[({<]\x20*(?:at|@|arobase|arroba|ät)\x20*[\])}>]\x20*|\x20*_at_\x20*)"
_AT_WORD = r"(?:\x20+(?:at|arobase|arroba|ät)\x20+)"
_DOT = r"(?:\x20*[\[({<]\x20*(?:dot|\.|point|punkt|punto)\x20*[\])}>]\x20*|\x20+(?:dot|point|punkt|punto)\x20+|\x20*_dot_\x20*)"
_SPACED = re.compile(r"(?<=[A-Za-z0-9])\x20+@\x20*(?=[A-Za-z0-9-]+\x20*\.)|(?<=[A-Za-z0-9])@\x20+(?=[A-Za-z0-9-]+\x20*\.)")
_LABEL = r"[A-Za-z0-9-]+"
# a bracketed "at" or a true @ may stand before true full stops; a bare word "at" needs a disguised one after it
# the part before the "at" is read in one way only: _dot_ and _at_ are no part of a name
_NAME = r"(?:(?!_dot_|_at_)[a-z0-9_%+-])++"
_MAIL = re.compile(rf"(?i){_NAME}(?:(?:\.|{_DOT}){_NAME})*(?:{_AT}{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*(?:\.|{_DOT})[a-z]{{2,12}}|@{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*{_DOT}[a-z]{{2,12}}|{_AT_WORD}{_LABEL}(?:(?:\.|{_DOT}){_LABEL})*{_DOT}[a-z]{{2,12}})(?![A-Za-z0-9])")
_MAIL_HINT = re.compile(r"(?i)[\[({<]\x20*(?:at|@|arobase|arroba|ät|dot|point|punkt|punto|\.)\x20*[\])}>]|\x20(?:dot|point|punkt|punto)\x20|_at_|_dot_")
_IP_WORDS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_AT_ANY, _DOT_ANY = re.compile(rf"(?i){_AT}|{_AT_WORD}"), re.compile(rf"(?i){_DOT}")


def disguised(t: Transduced) -> Transduced:
    """at and dot in the shape of an address become @ and full stops."""
    if not _MAIL_HINT.search(t.text):
        return t
    edits, free = [], 0
    for hint in _MAIL_HINT.finditer(t.text):
        if hint.start() < free:
            continue
        a = max(free, hint.start() - 300)  # an address part is shorter than this
        for shape, is_mail in ((_MAIL, True), (_IP_WORDS, False)):
            m = next((m for m in shape.finditer(t.text, a, hint.end() + 300) if m.end() > hint.start()), None)
            if m is None or m.start() > hint.start():
                continue
            if is_mail and (at := _AT_ANY.search(t.text, m.start(), m.end())) and "@" not in t.text[m.start() : at.start()]:
                edits.append((at.start(), at.end(), "@"))
                edits += [(d.start(), d.end(), ".") for part in ((m.start(), at.start()), (at.end(), m.end())) for d in _DOT_ANY.finditer(t.text, *part)]
            else:
                edits += [(d.start(), d.end(), ".") for d in _DOT_ANY.finditer(t.text, m.start(), m.end())]
            free = m.end()
            break
    return t.rewrite(sorted(edits))


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and spans that only deobfuscation shows, by kind."""
    base = detect(text)
    t = Transduced.of(text)
    if not text.isascii():
        t = homoglyphs(t)
    t = disguised(spelled(t))
    t = t.rewrite([(m.start(), m.end(), "@") for m in _SPACED.finditer(t.text)]) if " @" in t.text or "@ " in t.text else t
    more: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if any(t.changed) or len(t.text) != len(text):
        every = [s for spans in base.values() for s in spans]
        for kind, spans in detect(t.text).items():
            for a, b in spans:
                x, y = t.source(a, b)
                # a change inside the span: a rewritten character or one that is gone
                if (any(t.changed[a:b]) or y - x != b - a) and not any(p < y and x < q for p, q in every):
                    more[kind].append((x, y))
                    every.append((x, y))
    return base, more


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts, hashes, spans, added = [], [], [], []
            for x in part.column(1):
                base, more = find(x.as_py() or "")
                counts.append([len(base[k]) for k in KINDS])
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined({k: base[k] + more[k] for k in KINDS}))
                added.append(sum(map(len, more.values())))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([c[j] for c in counts], pa.int64()) for j in range(4)), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["id", "a", "b", "c", "d", "h", "s", "m"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, base counts by kind, base_sha256, spans (all), n_added. A narrow map over whole texts."""
    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_scan, "id long, a long, b long, c long, d long, h string, s string, m long")
    return out.toDF(id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")
