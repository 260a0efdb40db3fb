"""The stages and the whole pipeline against plain Python, on rows with nulls, empty texts, repeated rows and odd columns."""

import base64
import re
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

RNG = np.random.default_rng(31)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score int, kept_text string, n_lines int, _gone int, id int, key string"
WORDS = {"xx": [f"{a}{b}a" for a in "bcdfg" for b in "aeiou"] + ["lamo", "tira"], "yy": [f"st{a}{b}" for a in "rwk" for b in "zqx"] + ["wrz", "kxt"]}


def prose(lang, n):
    return " ".join(RNG.choice(WORDS[lang], n)) + " " + " ".join(f"{lang[0] * 3}{x}" for x in RNG.integers(0, 10_000, n // 2))


ITEM = " ".join(f"item{i} {w}" for i, w in enumerate(RNG.choice(WORDS["xx"], 12)))


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(("xx", "yy")[i % 2], 30), ("xx", "yy")[i % 2] if i % 5 else None) for i in range(120)]
    out += [(200, None, "xx"), (201, "", "xx"), (202, "12 34 !", None), (203, out[3][1], "yy"), (204, out[4][1] + "\n" + out[5][1], "xx"), (205, prose("xx", 20) + " " + ITEM + " " + prose("xx", 20), "xx"), (206, out[6][1] + " tail", "xx"), (206, out[6][1] + " tail", "xx"), (None, prose("xx", 20), "xx"), (207, "the " + prose("xx", 20), None)]
    return [(i, t, lang, "s", None if t is None else len(t), "own", 7, "k", 1, 2, 3, "z") for i, t, lang in out]


@pytest.fixture(scope="module")
def place(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "the"), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def tokens(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def alike(a, b):
    return bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)


def plain_lines(rows):
    """(row, kept text) of what line dedup keeps, in any order."""
    seen, gone = [], set()
    for r in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for n, line in enumerate(r[1].split("\n")):
            t = tokens(line)
            if t and any(alike(t, x) for x, where in seen if where != (r[0], n)):
                gone.add((r[0], n))
            seen.append((t, (r[0], n)))
    out = []
    for r in rows:
        kept = None if r[1] is None else "\n".join(x for n, x in enumerate(r[1].split("\n")) if (r[0], n) not in gone)
        lost = r[1] is not None and kept != r[1]
        if not lost or kept.strip():
            out.append((*r[:1], kept, *r[2:4], len(kept) if lost else r[4], *r[5:]))
    return out


def plain_near(rows):
    top = {r[0]: r[0] for r in rows if r[0] is not None}
    sets = [(r[0], tokens(r[1] or "")) for r in rows if r[0] is not None]
    for _ in top:
        for a, x in sets:
            for b, y in sets:
                if alike(x, y):
                    top[a] = top[b] = min(top[a], top[b])
    return [r for r in rows if r[0] is None or top[r[0]] == r[0]]


def same(df, want):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter(tuple(r) for r in df.collect()) == Counter(map(tuple, want))


def test_stages(spark, rows, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    got = [tuple(r) for r in corpus_pipeline.language(spark, docs, place).collect()]
    clean = [r for r in rows if r[0] not in (200, 201, 202)]
    assert Counter((r[0], r[1], *r[3:]) for r in got) == Counter((r[0], r[1], *r[3:]) for r in clean)
    told = {r[0]: r[2] for r in got}
    assert all(told[i] == ("xx", "yy")[i % 2] for i in range(120))
    same(corpus_pipeline.line_dedup(spark, docs, place), plain_lines(rows))
    same(corpus_pipeline.near_duplicates(spark, docs, place), plain_near(rows))
    same(corpus_pipeline.decontamination(spark, docs, place), [r for r in rows if r[0] != 205])


def test_empty_tables(spark, rows, place):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, place).count() == 0


def test_run(spark, rows, place):
    import tiktoken

    from sessionloom.llm.queries import vocabulary

    kept = plain_near(plain_lines([r for r in rows if r[0] not in (200, 201, 202)]))
    kept = [r for r in kept if r[0] != 205]
    path, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, place).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len(coder.encode_ordinary(r[1] or ""))) for r in kept)
