"""Small fixtures against brute force: nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import bpe, decontam, langid, lines, minhash, neighbours, pii, sharding, suffix_tree, toxicity
from sessionloom.llm.common import components
from sessionloom.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(3)
VOCAB = [f"w{i}{'ab' * (i % 3)}" for i in range(200)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


BASE = prose(80)
EDITED = " ".join(w if i != 40 else "other" for i, w in enumerate(BASE.split()))
TEXTS = [BASE, BASE, EDITED, prose(60), prose(60), "", None, "one", "ONE", "a b", "A\tb", "\x0b", f"{prose(30)}\n{BASE}", prose(3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, 1, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, BASE, None, None, 2, 8)], "doc_id long, text string, lang string, source string, n long, label int")


def empty(docs):
    return docs.limit(0)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (5, 5)], "u long, v long")
    assert {r.node: r.label for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert components(e.limit(0)).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    def shingles(t):
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    top = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                a = len(sets[i] & sets[j])
                if a and 100 * a >= 80 * (len(sets[i]) + len(sets[j]) - a):
                    top[i] = top[j] = min(top[i], top[j])
    got = minhash.near_duplicates(docs, k=k).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top[r.doc_id], top[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_lines(spark, docs):
    got = {r.doc_id: r for r in lines.dedup_lines(docs).where("doc_id is not null").collect()}
    assert [got[i].n_removed for i in range(len(TEXTS))] == [0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0]
    assert got[6].kept_text is None and got[12].kept_text == TEXTS[12].split("\n")[0] and got[1].kept_text == ""
    assert lines.dedup_lines(empty(docs)).count() == 0


def test_sharding(docs):
    got = sharding.shard(docs, shards=4).toPandas()
    assert len(got) == len(TEXTS) + 2
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.groupby(["text_crc32", "size"]).shard.nunique().max() == 1
    assert (got.loc[got.doc_id == 6, ["size", "text_crc32"]].to_numpy() == [16, 0]).all()
    assert (got.loc[got.doc_id == 0, "text_crc32"] == zlib.crc32(BASE.encode())).all()
    assert sharding.shard(empty(docs)).count() == 0


def test_deal_is_longest_first():
    cells = [(100, 1, 100), (60, 2, 120), (10, 50, 500), (3, 7, 21)]
    loads = Counter()
    for cell, lo, hi, s in sharding.deal(cells, 3):
        loads[s] += cell * (hi - lo)
    assert sum(loads.values()) == 741 and max(loads.values()) - min(loads.values()) <= 10


def test_suffix_tree(docs):
    low = {i: WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for i, t in enumerate(TEXTS)}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows = [*range(len(TEXTS)), 3, None]
    words = lambda i: low[0] if i is None else low[i]
    c = Counter(w for i in rows if not held(i) for w in words(i))
    ends = sum(not held(i) for i in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    for r in suffix_tree.score_documents(docs).collect():
        w = words(r.doc_id)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    assert suffix_tree.score_documents(empty(docs)).count() == 0


def test_suffix_tree_automaton():
    s, at = suffix_tree.stream(np.frombuffer(b"Abra  cadabraabra", np.uint8), np.array([0, 6, 6, 17]))
    past = b"\n" * suffix_tree.DEPTH
    assert s.tobytes() == past + b"abra\n" + past + b"\n" + past + b"cadabraabra\n"
    counts = [{} for _ in range(3)]
    body = s.tobytes()
    for d in range(3):
        for t in range(5, len(body)):
            ctx = int.from_bytes(body[t - d : t], "big")
            counts[d].setdefault(ctx, Counter())[body[t]] += 1
    tree = suffix_tree.SuffixTree(counts)
    lanes, one = tree.score(s, at, lane=4), tree.score(s, at, lane=1024)
    assert np.allclose(lanes, one)


def test_bpe(docs):
    import tiktoken

    path, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(path, pattern)
    chars = [chr(c) for c in (*range(256), 0x3B1, 0x4E2D, 0x1F600, 0x2028, 0x200B)]
    for _ in range(200):
        t = "".join(RNG.choice(chars, 80)) + "the " + "".join(RNG.choice(list("etaoin "), 80))
        assert codec.encode(t) == want.encode_ordinary(t) and codec.decode(codec.encode(t)) == t.encode()
    for r in bpe.encode_documents(docs, path, pattern).where("doc_id is not null").collect():
        ids = want.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


@pytest.mark.parametrize(
    ("text", "kind", "base"),
    [("write a.b@c.de now", "email", True), ("at 10.0.255.1", "ip", True), ("4539 1488 0343 6467", "card", True), ("+1 (736) 555-2678", "phone", True), ("john at example dot com", "email", False), ("john[at]mail.example.com", "email", False), ("jоhn@exаmple.com", "email", False), ("４539 1488 0343 6467", "card", False), ("plus one two three six five five five one two one two", "phone", False), ("jo​hn@exa​mple.com", "email", False)],
)
def test_pii(text, kind, base):
    own, more = pii.find(text)
    found = own if base else more
    assert len(found[kind]) == 1 and not any(own.values()) == (not base)
    a, b = found[kind][0]
    assert 0 <= a < b <= len(text) and text[a] not in " ," and text[b - 1] not in " ,"


def test_pii_leaves_prose_alone():
    for t in (BASE, "meet me at noon, one of five", "256.1.1.1 is none", "4539 1488 0343 6468", ""):
        assert not any(v for d in pii.find(t) for v in d.values())


def test_pii_emails_are_the_pattern():
    shape = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(300):
        t = "".join(RNG.choice(list("ab.@- "), 40))
        assert pii.emails(t) == [m.span() for m in shape.finditer(t)]


def test_neighbours(spark):
    v = RNG.normal(size=(600, 16)).astype(np.float32)
    v[50:90] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(900, None), (1000, [0.0] * 16), (1100, [float("nan")] * 16), (1200, [None] * 16)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(t).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 400, 500}
    hit, m = 0, v.astype(float)
    for q, found in got.items():
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hit += len(set(want) & {i for i, _ in found})
        assert all(abs(s - d[i]) < 1e-12 for i, s in found)
    assert [i for i, _ in got[0]] == list(range(50, 60)) and hit >= 54
    assert neighbours.nearest(t.limit(0)).count() == 0


def test_decontamination(spark, docs):
    item = prose(40)
    cut = " ".join(w for i, w in enumerate(item.upper().split()) if i % 9)
    d = spark.createDataFrame([(1, prose(50) + ", " + item + ". " + prose(50)), (2, prose(30) + " " + cut), (3, prose(200)), (4, None), (5, "")], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(d, b).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == 1.0
    assert decontam.contaminated(d, b.limit(0)).count() == decontam.contaminated(d.limit(0), b).count() == 0


def test_alignment():
    assert decontam.align(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 5, 3, 4, 9])) == 7


def test_language(spark):
    words = {"xx": "the of and to in is was".split(), "yy": "der die und das nicht ist".split()}
    rows = [(i, " ".join(RNG.choice(words[l], 40)), l) for i in range(200) for l in [("xx", "yy")[i % 2]]] + [(900, None, "xx"), (901, "12 34 !", "xx"), (902, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert sum(got[i].lang_pred == l for i, _, l in rows[:200]) >= 195
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[5].held_out == (zlib.crc32(b"5") % 3 == 1) and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(d.limit(0)).count() == 0


def test_toxicity(spark):
    bad = ["vile", "scum", "trash"]
    rows = [(i, prose(30) + (" " + " ".join(RNG.choice(bad, 1 + i % 5)) if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.severity(d, y).collect()}
    assert sum(got[i].toxic == (i % 4 == 0) for i in range(200, 400)) >= 195
    assert not got[900].toxic and not got[901].toxic and len(got) == 402
    assert all(not r.toxic for r in toxicity.severity(d, y.limit(0)).collect())
