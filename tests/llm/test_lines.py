"""Line dedup against brute force, with every line crowded, some and none; and how many pairs its joins make."""

import re

import numpy as np
import pytest

from sessionloom.llm import lines

RNG = np.random.default_rng(11)
PASSAGES = [" ".join(f"p{k}x{i}" for i in range(10)) for k in range(12)]


def mixed(n):
    """n lines of six passages of a dozen: every shingle is common, and few lines are alike."""
    return [" ".join(PASSAGES[k] + f" m{RNG.integers(1 << 40)}" for k in RNG.permutation(12)[:6]) for _ in range(n)]


def joined(spark, since):
    """The most rows that an inner sort-merge or hash join has made since."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in range(since, runs.size()):
        at = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and ", Inner," in node.desc() and m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    most = max(most, int(re.sub(r"\D", "", v.get())))
    return most


@pytest.mark.parametrize("crowd", [0, 2, 5, 1024])
def test_crowded_lines_meet_by_rarity(spark, crowd):
    base = mixed(40)
    words = [b.split() for b in base]
    edited = [" ".join(x if i != 30 else "other" for i, x in enumerate(w)) for w in words[:20]] + [" ".join(w[: 50 + j]) for j, w in enumerate(words[20:30])]
    all_ = [*base, *edited, *[f"{words[0][0]} {base[0]} tail{j}" for j in range(12)], "a b c", "A b c", "b c", "", " \t"]
    order = RNG.permutation(len(all_))
    texts = ["\n".join(all_[j] for j in order[i : i + 4]) for i in range(0, len(all_), 4)]

    def tokens(line):
        w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    seen, gone = [], set()
    for i, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            a = tokens(line)
            if a and any(100 * len(a & b) >= 80 * len(a | b) for b in seen):
                gone.add((i, n))
            seen.append(a)
    got = lines.removed_lines(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), short=True, crowd=crowd).collect()
    assert {(r.id, r.line) for r in got} == gone and len(gone) > 30


def test_lines_of_common_passages_make_few_pairs(spark):
    rows = [(i, " ".join(PASSAGES[k] for k in RNG.permutation(12)[:6])) for i in range(600)]  # no shingle is a line's own
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    lines.removed_lines(spark.createDataFrame(rows, "id long, text string"), short=True).count()
    assert joined(spark, since) < 10 * len(rows)


def test_crowded_and_other_lines_are_verified_in_the_same_passes(spark, tmp_path):
    base = mixed(30)
    rows = [(i, b) for i, b in enumerate([*base, *[f"{b} tail" for b in base[:10]]])]
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    store = spark._jsparkSession.sharedState().statusStore()
    since, passes = store.executionsList().size(), 0
    gone = lines.removed_lines(spark.read.parquet(str(tmp_path / "docs")), short=True, crowd=2).collect()
    assert {r.id for r in gone} == set(range(30, 40))
    runs = store.executionsList()
    for k in range(since, runs.size()):
        nodes = store.planGraph(runs.apply(k).executionId()).allNodes()
        passes += sum(str(tmp_path) in nodes.apply(i).desc() for i in range(nodes.size()) if "Scan parquet" in nodes.apply(i).name())
    assert 4 <= passes <= 5  # keys, tokens, crowded lines, and two of the lines of pairs
