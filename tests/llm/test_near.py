"""Near duplicates against all pairs: both ways of settling open buckets, ids that several texts share."""

import re

import duckdb
import numpy as np
import pytest

from sessionloom.llm import minhash, neighbours
from sessionloom.llm.common import components
from sessionloom.llm.queries import ORACLES, QUERIES

RNG = np.random.default_rng(23)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def by_pairs(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    top = {i: i for i, _ in rows if i is not None}
    links = []
    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j, both = rows[b][0], len(sets[a] & sets[b])
            if None not in (i, j) and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((i, j))
    for _ in top:
        for i, j in links:
            top[i] = top[j] = min(top[i], top[j])
    return top


def family(words, edits):
    w = words.copy()
    for at in RNG.choice(len(w), edits, replace=False):
        w[at] = f"x{RNG.integers(1 << 30)}"
    return w


@pytest.mark.parametrize("most", [minhash.OPEN_BYTES, 0])
def test_chains_and_families(spark, most):
    rows = []
    for _ in range(6):
        base = [f"w{x}" for x in RNG.integers(0, 5000, 120)]
        rows += [" ".join(family(base, e)) for e in (0, 1, 2, 3, 5, 8, 11)]
        for _ in range(5):  # a chain: each a little farther from the first
            base = family(base, 5)
            rows.append(" ".join(base))
    rows = list(enumerate(rows)) + [(500, None), (501, ""), (None, rows[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_pairs(rows, 2)
    got = {r.doc_id: r for r in minhash.near_duplicates(d, k=2, most=most).collect() if r.doc_id is not None}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert len(set(want.values())) < len(rows) - 30


def test_rows_that_share_an_id_lose_no_link(spark):
    a, b = ([f"{c}{x}" for x in range(100)] for c in "ab")
    near = lambda w: " ".join([*w[:-1], "other"])
    for ids in ((5, 5, 1, 2), (5, 6, 1, 2), (3, 5, 5, 9)):
        rows = list(zip(ids, (" ".join(a), " ".join(b), near(a), near(b)), strict=True))
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == by_pairs(rows, 5)
    rows = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, " ".join(b))]
    assert {r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {3}


def test_columns_of_any_name_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g", 1, 2, "k"), (1, "a b c d e f g", 1, 2, "k"), (2, "a b c d e f g", 3, 4, "l")]
    d = spark.createDataFrame(rows, "doc_id long, text string, id int, n int, key string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.label for r in components(e).collect()} == {0}


def test_neighbours_over_many_shards(spark):
    m = np.concatenate([RNG.normal(size=(500, 16)), RNG.normal(size=(300, 16)) * 0.01 + 3]).astype(np.float32)
    rows = [(i, [float(x) for x in v], 5, 0) for i, v in enumerate(m)]
    t = spark.createDataFrame([*rows, rows[10], (None, rows[1][1], 1, 1)], "vec_id long, embedding array<float>, shard int, part int")
    hit, wide, n = 0, m.astype(float), 0
    for r in neighbours.nearest(t, every=20, shard_points=60).toPandas().groupby("query_id"):
        d = np.sqrt(((wide - wide[r[0]]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(d)), d)) if i != r[0]][:10]
        got = r[1].sort_values("rank")
        assert np.allclose(got["score"], d[got["vec_id"]], atol=1e-12) and (np.diff(got["score"]) >= 0).all() and list(got["rank"]) == list(range(1, 11))
        hit, n = hit + len(set(want) & set(got["vec_id"])), n + 10
    assert n == 400 and hit >= 0.9 * n


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_are_their_sql(spark, name):
    d, c = "/root/testdata/sf0.001", duckdb.connect()
    c.sql(f"create view documents as select * from '{d}/documents.parquet'")
    got = QUERIES[name](spark, d).toPandas()
    want = c.sql(ORACLES[name]).df()[got.columns]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
