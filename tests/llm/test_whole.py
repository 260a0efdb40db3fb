"""Whole jobs: what an earlier cut left out."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import decontam, lines, pii, suffix_tree
from sessionloom.llm.queries import op7_line_dedup

RNG = np.random.default_rng(5)
VOCAB = [f"v{i}" for i in range(2000)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


@pytest.mark.parametrize("copies", [5, 1000])
def test_edited_copies_are_found_however_many(spark, copies):
    item = [f"q{i}" for i in range(20)]
    edited = " ".join(f"other{i}" if i % 5 == 4 else w for i, w in enumerate(item))
    d = spark.createDataFrame([(i, f"{prose(12)} {edited} {prose(12)}") for i in range(copies)] + [(5000, prose(60))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = decontam.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 7) for i in range(copies)}
    assert all(0.5 <= r.score < 1 for r in got)


def test_shared_words_bound_drops_no_pair(spark):
    items = {k: prose(20).split() for k in range(12)}
    rows = [(100 * k + cut, " ".join([*prose(9).split(), *w[:cut], *prose(20 - cut).split()])) for k, w in items.items() for cut in (4, 8, 10, 11, 14)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    want = set()
    for i, t in rows:
        for k, w in items.items():
            codes = {x: n for n, x in enumerate(t.split())}
            if decontam.align(np.array([codes.get(x, -1) for x in w]), np.array([codes[x] for x in t.split()])) / 40 >= 0.5:
                want.add((i, k))
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} == want and len(want) >= 36


def test_line_dedup_takes_short_lines(spark, tmp_path):
    long = prose(12)
    texts = [f"All rights reserved.\n{long}\nok", f"all  rights\treserved.\n{prose(9)}\n\n \nOK", "ok\nok then\nthen ok", f"{long} more\nall rights\nall rights reserved. 2024", "a b c d\na b c d e\na b c d e\n\n", "d c b a\nA B C D", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def tokens(line):
        w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    seen, gone = [], {}
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            a = tokens(line)
            if any(100 * len(a & b) >= 80 * len(a | b) for b in seen if a):
                gone.setdefault(i, []).append(n)
            seen.append(a)
    assert gone == {1: [0, 4], 2: [0], 3: [0], 4: [2], 5: [1]}
    assert {r.doc_id: r.n_removed for r in op7_line_dedup(spark, str(tmp_path)).collect()} == {i: len(gone.get(i, ())) for i in range(len(texts))}
    got = lines.removed_lines(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), short=True).collect()
    assert {(r.id, r.line) for r in got} == {(i, n) for i, q in gone.items() for n in q}


@pytest.mark.parametrize(
    ("text", "kind", "held"),
    [("call +one 415 555 2671 now", "phone", "+one 415 555 2671"), ("card 4539 1488 0343 646 seven.", "card", "4539 1488 0343 646 seven"), ("card four 539 1488 0343 6467.", "card", "four 539 1488 0343 6467"), ("+1 415 five 55 2671", "phone", "+1 415 five 55 2671")],
)
def test_pii_with_one_spelled_digit(text, kind, held):
    own, more = pii.find(text)
    spans = [text[a:b] for a, b in own[kind] + more[kind]]
    assert spans == [held]


def test_pii_with_one_number_word_leaves_prose_alone():
    for t in ("pages 1 2 3 4 5 and one more", "in 2019 2020 2021 one of 12 345 678 fell", "4539 1488 0343 646 eight", "room 12, 14, 16, 18 or six"):
        assert not any(v for d in pii.find(t) for v in d.values()), t


def test_suffix_tree_keeps_contexts_of_a_small_count(spark):
    # "qzxjk" stands 10 times among over 1.5 million symbols: under 1e-5 of them, and its next symbol is always the same
    texts = [prose(400) for _ in range(1000)] + ["qzxjkw"] * 10 + [prose(8), "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s, at = suffix_tree.stream(np.frombuffer(body := "".join(t or "" for t in texts).encode(), np.uint8), np.cumsum([0] + [len((t or "").encode()) for t in texts]))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    grams, counts = suffix_tree._windows(s, at), Counter()
    for g, out in zip(grams.tolist(), np.repeat(held, np.diff(at) - suffix_tree.DEPTH), strict=True):
        counts[g] += not out
    levels = [{} for _ in range(suffix_tree.DEPTH + 1)]
    for g, c in counts.items():
        for k, level in enumerate(levels):
            x = g & ((1 << 8 * (k + 1)) - 1)
            if c:
                level.setdefault(x >> 8, Counter())[x & 255] += c
    levels = [{ctx: q for ctx, q in level.items() if not k or sum(q.values()) >= 2} for k, level in enumerate(levels)]
    want = suffix_tree.SuffixTree(levels).score(s, at)
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(d).collect()}
    assert len(body) > 1_500_000 and np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-4, atol=1e-4)
