"""Rules as data, selection, fusion, judgments, clusters, the knowledge base, settings and readers on small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom import config, providers
from sessionloom.operators import catalog as C
from sessionloom.operators import clusters as K
from sessionloom.operators import explain as E
from sessionloom.operators import fusion as U
from sessionloom.operators import judgments as J
from sessionloom.operators import models as B
from sessionloom.operators import rules as R
from sessionloom.operators import selection as L
from sessionloom.operators import sequences as Q
from sessionloom.sources import jsons, kb, logs
from sessionloom.streaming import rules as stream


@pytest.fixture(scope="module")
def s(spark):
    return spark.createDataFrame([("s1", [0, 1, 2, 1], 1), ("s2", [0, 1], 0), ("s3", [2, 2, 2, 0, 1], 1), ("s4", [], 0)], "session_id string, event_seq array<int>, label int")


# ---- rules


def test_hostile_rules_are_normalised():
    ids = {"E1": 1}
    bad = [None, 3, "x", [], {}, {"if_any": 5}, {"if_any": [3, None, "x", {}]}, {"if_all": {"min_count": 1}}, {"if_any": [{"template_contains": "x"}]}, {"if_any": [{"contains_ngram": []}]}, {"if_any": [{"contains_ngram": [1, "2"]}]}, {"if_any": [{"ordered_subset": [True]}]}, {"if_any": [{"min_count": None}]}, {"if_any": [{"min_count": {}}]}]
    assert all(R.normalised(x, ids) is None for x in bad)
    r = R.normalised({"if_any": [{"min_count": {"event_id": "E1", "count": None}, "contains_ngram": [1, 2]}], "confidence": "high", "name": 7}, ids)
    assert r.if_any == (R.Clause("min_count", row_id=1, count=1, event_id="E1"),) and r.confidence == 0.0 and r.name == "7"
    assert R.normalised({"if_all": [{"contains_ngram": [1, 2], "absent_within": {"event_id": "E1"}}]}, ids).if_all == (R.Clause("contains_ngram", rids=(1, 2)),)
    assert R.normalised({"if_all": [{"min_count": {"event_id": "E9", "row_id": 4, "count": "2"}}]}, ids).if_all[0] == R.Clause("min_count", row_id=4, count=2, event_id="E9")


def test_prepared_rewritten_and_merged_rules():
    g, o = R.Clause("contains_ngram", rids=(1, 2)), R.Clause("ordered_subset", rids=(1, 3))
    m = R.Clause("min_count", row_id=5, event_id="E5")
    rules = [R.Rule("a", (g, m)), R.Rule("b", (), (g, o)), R.Rule("c", (m,))]
    assert C.prepared(rules, "full") == rules
    ready = C.prepared(rules)
    assert [(r.name, r.if_any, r.any_only) for r in ready] == [("a", (g,), True), ("b", (o,), True)]
    names = {1: "E1", 2: "E2", 3: "E3", 5: "E5"}
    out = C.by_events([R.Rule("a", (g,)), R.Rule("b", (o,)), R.Rule("x", (R.Clause("contains_ngram", rids=(1, 1)),)), R.Rule("y", (g,)), R.Rule("c", (m,)), R.Rule("z", (R.Clause("contains_ngram", rids=(9,)),))], names)
    assert [r.name for r in out] == ["a_ngE1_E2", "b_ngE1_E3", "x_E1", "c"]
    assert [c.event_id for c in out[0].if_all] == ["E1", "E2"]
    assert [r.name for r in C.merged([R.Rule("a", (g,)), R.Rule("n")], [R.Rule("b", (g,)), R.Rule("n2"), R.Rule("e", (), (m,)), R.Rule("f", (), (m,))])] == ["a", "n", "n2", "e"]
    assert [r.name for r in C.cluster_rules([R.Rule("m", (g,))], rules, first="llm_first")] == ["a", "b"]
    assert C.distinct_names(["c1_x", "C12_x", "cluster_3_x", "y", "c1_"]) == ["c1_x", "y", "c1_"]
    assert C.pattern(R.Rule("p", (g,), (m, o)), names) == ["E5", "E1", "E3", "E2"]
    assert C.standardised([R.Rule("a", (R.Clause("min_count", event_id="E5"),))], {"E5": 5})[0].if_any[0].row_id == 5


@pytest.mark.parametrize("most", [C.BROADCAST_RULES, 0])
def test_rules_from_a_table_fire_like_compiled_ones(spark, s, most):
    rnd = random.Random(3)

    def clause():
        k = rnd.choice(["min_count", "contains_ngram", "ordered_subset", "absent_within"])
        ids = tuple(rnd.randrange(4) for _ in range(rnd.randrange(0, 3)))
        return R.Clause(k, rids=ids) if k in ("contains_ngram", "ordered_subset") else R.Clause(k, row_id=rnd.choice([0, 1, 2, 3, None]), count=rnd.choice([0, 1, 2]))

    rules = [R.Rule(f"r{i}", tuple(clause() for _ in range(rnd.randrange(3))), tuple(clause() for _ in range(rnd.randrange(3))), any_only=rnd.random() < 0.3) for i in range(60)]
    some = s.unionByName(spark.createDataFrame([(f"t{i}", [rnd.randrange(4) for _ in range(rnd.randrange(7))], i % 2) for i in range(25)], s.schema))
    want = {r.session_id: r.fired for r in R.fires(some, rules).collect()}
    assert {r.session_id: r.fired for r in C.fires_by_table(some, rules, most).collect()} == want and any(want.values())


# ---- selection


def naive(fired, labels, rules):
    hit = [bool(set(f) & set(rules)) for f in fired]
    tp = sum(h and y for h, y in zip(hit, labels, strict=True))
    p, r = tp / sum(hit) if any(hit) else 0.0, tp / sum(labels) if any(labels) else 0.0
    normal = [h for h, y in zip(hit, labels, strict=True) if not y]
    return p, 2 * p * r / (p + r) if p + r else 0.0, sum(hit) / len(hit), sum(normal) / len(normal) if normal else sum(hit) / len(hit)


def test_validation_is_counted_by_patterns(spark):
    rnd = random.Random(5)
    names = [f"r{i}" for i in range(6)]
    labels = [int(rnd.random() < 0.4) for _ in range(80)]
    fired = [[n for n in names if rnd.random() < (0.5 if y and n in "r0r1" else 0.1)] for y in labels]
    df = spark.createDataFrame([(str(i), y, f) for i, (y, f) in enumerate(zip(labels, fired, strict=True))], "session_id string, label int, fired array<string>")
    v = L.Validation(df, names)
    for k in range(7):
        got, want = v.stats(names[:k]), naive(fired, labels, names[:k])
        assert np.allclose([got.precision, got.f1, got.fire, got.normal_fire], want)
    assert len(v) == 80
    loose = L.Limits(1, 0, 0)
    assert L.filter_rules(v, names, loose) == names and L.filter_rules(v, names, L.Limits(enabled=False)) == names and L.filter_rules(v, [], loose) == []
    chosen = L.greedy(v, names, 0.5, 0.2, 150)
    assert chosen and naive(fired, labels, chosen)[2] <= 0.5
    top = max(names, key=lambda n: (naive(fired, labels, [n])[0], naive(fired, labels, [n])[1]))
    assert L.greedy(v, names, 0.5, 2.0, 150) == [top] and L.greedy(v, names[:1], 1, 0, 1) == ["r0"]
    assert L.filter_cluster_rules(v, names, "LIBERTY") and L.guarded(v, ["r5"], L.cluster_limits(), "") in ([], ["r5"])
    assert L.by_hits(v, names, 2) == sorted(names, key=lambda n: -v.stats([n]).tp)[:2] or len(L.by_hits(v, names, 2)) == 2
    assert L.limits("bgl").max_normal == 0.04 and L.cluster_limits("liberty").min_f1 == 0.05


# ---- fusion


def test_fusion_pieces(spark):
    legs = spark.createDataFrame([(1, 1, 0, 0, 1, 0.9), (1, 0, 1, 1, 1, 0.6), (0, 0, 0, 0, 0, 0.9), (0, 1, 0, 0, None, None), (0, 0, 0, 0, 1, 0.95)], "label int, base int, ngram int, kb int, risk int, conf double")
    p = U.Profiles.of(legs)
    assert p.c.sum() == 5 and abs(p.f1(p.base) - 0.5) < 1e-9
    assert (p.legs(0.5)["llm"] <= np.maximum(p.ngram, p.kb)).all() and "kb" not in p.legs(0.5, cluster=False)
    assert [n for n, _ in U.ablations(p, 0.5, "vote2")] == ["full", "no_llm", "no_ngram", "no_cluster"]
    assert U.ablated_votes(3, 4, 3) == 2 and U.ablated_votes(2, 4, 3) == 2 and U.ablated_votes(4, 4, 2) == 2 and U.ablated_votes(2, 2, 3) == 2
    assert U.parsed("vote3") == "vote3" and U.parsed("4-way_or") == "or" and U.parsed("nonsense") == "or" and U.parsed("base+residual_ngram") == "or"
    assert U.tie_key("vote2") < U.tie_key("or") < U.tie_key("and")
    name, conf, f1 = U.pick(p)
    assert 0.5 <= conf <= 0.9 and f1 >= p.f1(p.base) and U.tune(p, fixed=0.5)[0] in (0.5,)
    one = legs.select(U.verdict("vote9", F.col("base"), F.col("risk"), F.col("ngram"), F.col("kb")).alias("v"), U.confident(F.col("conf"), F.lit(7), F.lit(8)).alias("g")).collect()
    assert [r.v for r in one] == [0, 0, 0, 0, 0] and [r.g for r in one] == [8, 8, 8, 8, 7]
    assert U.shortcut(F.col("base"), F.col("ngram")) is None


# ---- judgments


def test_cache_first_judging(spark):
    def judge(prompt):
        if "fail" in prompt:
            raise RuntimeError("no answer")
        key = prompt.split("seq_key=")[1].split("\n")[0]
        return {"seq_key": key, "is_high_risk": 1, "confidence": 0.9, "count": "3", "rationale": "asked", "core_events": ["x"], "deviations": "none"}

    rows = [(f"k{i}", ["a", "b", "c"] if i else ["fail"]) for i in range(5)]
    items = J.prompt_items(spark.createDataFrame(rows, "seq_key string, parts array<string>"), "HDFS", 2)
    assert items.where("seq_key = 'k1'").first().snippet == "a | b"
    cache = spark.createDataFrame([("k1", "HDFS", "now", 1, 0, "mine", 0.7), ("k2", "HDFS", "old", 1, 1, "theirs", 0.8), ("k3", "HDFS", "now", 1, 1, "  ", 0.9)], "seq_key string, dataset string, run_tag string, count int, is_high_risk int, rationale string, confidence double")
    got = J.ask_sessions(items, cache, judge, "now", "HDFS")
    assert got.counts == {"hits": 1, "copies": 1, "calls": 2, "failures": 1}
    assert {(r.seq_key, r.rationale, r.run_tag) for r in got.rows.collect()} == {("k2", "theirs", "now"), ("k3", "asked", "now"), ("k4", "asked", "now")}
    assert J.ask_sessions(items, cache, judge, "now", "HDFS", most=2).counts == {"hits": 1, "copies": 0, "calls": 0, "failures": 1}
    assert J.ask_sessions(items, cache, judge, "now", "HDFS", cross_run=False).counts["copies"] == 0
    clusters = spark.createDataFrame([("0", "p"), ("1", "q")], "cluster_id string, prompt string")
    old = spark.createDataFrame([("0", "HDFS", "old", "{}", 1.0)], "cluster_id string, dataset string, run_tag string, response_json string, updated_at double")
    asked = J.ask_clusters(clusters, old, lambda p: {"rules": []}, "now", "HDFS")
    assert asked.counts == {"hits": 0, "copies": 1, "calls": 1, "failures": 0} and asked.rows.count() == 2


def test_bad_results_are_left_out(spark):
    texts = ['{"seq_key": "a", "is_high_risk": "1", "confidence": "0.5", "count": 2}', '{"seq_key": "b", "is_high_risk": "often"}', '{"is_high_risk": 1}', "no json", '{"seq_key": "c"}', '{"seq_key": "d", "confidence": 0.9, "count": 2, "core_events": ["x", 1]}']
    df = spark.createDataFrame([(t,) for t in texts], "result string")
    got = {r.seq_key: r for r in J.ingested(df, "HDFS", "t").collect()}
    assert set(got) == {"a", "c", "d"} and got["d"].is_high_risk == 1 and got["c"].is_high_risk == 0 and json.loads(got["d"].core_events) == ["x", 1]
    assert {r.seq_key: r.is_high_risk for r in J.ingested(df, "LIBERTY", "t").collect()} == {"a": 1, "c": 0, "d": 0}


def test_scorer_and_prompts(spark):
    d = spark.createDataFrame([("Received exception; connection reset",), ("all fine",), (None,), ("an ERROR",)], "t string")
    got = d.select(*[c.alias(n) for n, c in J.risk(F.col("t")).items()]).collect()
    assert [(r.is_high_risk, r["count"]) for r in got] == [(1, 3), (0, 0), (0, 0), (1, 1)]
    assert got[3].rationale == "Heuristic: 1 keyword hit(s), strong singleton (exception/error)" and got[1].rationale == "Heuristic: no failure terms"
    assert J.cluster_summary({"size": 3, "top_events": [["E1", 2]]}) == "Cluster size: 3 | Frequent events: E1" and J.cluster_summary({}) == "Cluster summary unavailable"
    assert '"cluster_size": 2' in J.cluster_prompt("0", {"clusters": {"0": {"size": 2}}}, "BGL")
    e = d.select(J.snippet(F.lit(None).cast("array<string>"), 2).alias("a"), J.snippet(F.array().cast("array<string>"), 2, raw=True).alias("b")).first()
    assert (e.a, e.b) == ("(empty)", "(no logs)")


def test_providers(spark):
    tries = []

    def ask(p):
        tries.append(p)
        return "no json" if len(tries) < 3 else '{"a": 1}'

    waits = []
    assert providers.retried(ask, "p", sleep=waits.append) == {"a": 1} and waits == [1.5, 3.0]
    with pytest.raises(RuntimeError):
        providers.retried(lambda p: "[]", "p", tries=2, sleep=lambda x: None)
    rows = spark.createDataFrame([("a", "error log"), ("b", "error log"), ("c", None)], "seq_key string, text string")
    got = {r.seq_key: np.array(r.emb) for r in providers.encoded(rows, providers.HashEncoder(16), batch=2).collect()}
    assert np.allclose(got["a"], got["b"]) and abs(np.linalg.norm(got["a"]) - 1) < 1e-6 and not got["c"].any()


# ---- clusters and models


def test_density_clusters_find_blobs():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 5))] + [rng.uniform(-20, 20, (8, 3))])
    label, strength = K.density_clusters(x, 10, cosine=False)
    blobs = [set(label[i * 40 : i * 40 + 40]) - {-1} for i in range(3)]
    assert all(len(b) == 1 for b in blobs) and len(set.union(*blobs)) == 3 and (label[120:] == -1).sum() >= 6
    assert all((label == c).sum() >= 10 for c in set(label) - {-1}) and ((strength >= 0) & (strength <= 1)).all() and not strength[label == -1].any()
    assert (K.density_clusters(x[:5], 10)[0] == -1).all() and (K.with_retries(x[:3], 10)[0] == 0).all()
    assert len(K.density_clusters(np.zeros((30, 2)), 5, cosine=True)[0]) == 30


def test_cluster_bundle_and_rules(spark, s):
    w = spark.createDataFrame([("s1", 0, 1.0), ("s3", 1, 0.6), ("s3", 0, 0.8), ("s2", 1, 1.0)], "session_id string, term int, tfidf double")
    m = spark.createDataFrame([("s1", 0, 0.9), ("s2", 0, 0.5), ("s3", 0, 0.5), ("s4", -1, 0.0)], "session_id string, cluster int, strength double")
    reps = K.representatives(m, w)
    assert [tuple(r) for r in reps.collect()] == [(0, 3, "s1", "s2", "s3")]
    shown = K.examples(m, s)
    names = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "row_id int, event_id string")
    b = K.bundle(m, reps, shown, names)
    assert b["meta"] == {"num_sequences": 4, "num_clusters": 1, "noise": 1} and len(b["clusters"]["0"]["examples"]) == 3 and b["template_map"][0]["event_id"] == "A"
    grams = K.representative_grams(reps, shown, s, 2, 1)
    rules = K.representative_rules(grams)
    # s1, s2 and s3 each as representative and as example: "0 1" stands six times, "2 2" four times
    assert [(r.name, r.confidence, r.any_only) for r in rules] == [("cluster_0_ng2_0_1", 0.8, True), ("cluster_0_ng2_2_2", 0.8, True), ("cluster_0_ng3_0_1_2", 0.8, True)]
    told = K.artifacts(reps, s, spark.createDataFrame([("0", "r", ["A"], "d")], "cluster_id string, rule_id string, pattern array<string>, description string"), spark.createDataFrame([], "cluster_id string, text string")).first()
    assert json.loads(told.artifact_json)["derived_rules"][0]["rule_id"] == "r" and len(json.loads(told.artifact_json)["representative_sequences"]) == 3
    assert {r.cluster for r in K.assigned(w, 1, most=0).collect()} <= set(range(64)) and K.assigned(w, 1, most=0).count() == 3
    assert K.assigned(w, 2).where("cluster >= 0").count() == 3 and K.assigned(w.limit(0)).count() == 0
    assert sorted(r.term for r in K.terms(spark.createDataFrame([("a", [3, 12, 14])], "session_id string, event_seq array<int>"), "tfidf-template").collect()) == ["12", "12 14", "14"]


@pytest.mark.parametrize("name", ["loganomaly", "neurallog"])
def test_backbones_learn(spark, name):
    rnd = random.Random(1)
    rows = [(f"s{i}", i, [rnd.randrange(5) for _ in range(4)] + ([7] if i % 3 == 0 else [rnd.randrange(5)]), int(i % 3 == 0)) for i in range(150)]
    w = spark.createDataFrame(rows, "session_id string, win_idx int, tokens array<int>, label int")
    judged = B.with_teacher(w, spark.createDataFrame([("s0", 1)], "session_id string, is_high_risk int"))
    assert {r.teacher for r in judged.collect()} == {0, 1}
    model = B.train(judged, name, teach=0.1, epochs=15, cells=64)
    got = B.scored(w, model, name, 64).collect()
    assert sum((r.p1 >= 0.4) == (r.label == 1) for r in got) >= 140 and all(0 <= r.p1 <= 1 for r in got)
    with pytest.raises(ValueError):
        B.features(w, "other")


# ---- knowledge base, JSON, settings, readers


def test_knowledge_base(spark, tmp_path):
    b = kb.KnowledgeBase(spark, str(tmp_path / "kb"))
    assert b.read("judgments").count() == 0
    b.promote_rules([{"name": "a", "confidence": 0.5}, {"name": "b"}, {}], "HDFS", "m", "v", run_tag="t1", now=1.0)
    b.promote_rules([{"name": "a", "confidence": 0.9}], "HDFS", "m", "v", run_tag="t1", now=2.0)
    b.promote_rules([{"name": "a"}], "BGL", "m", "v", run_tag="t1", scope="global")
    assert b.count_rules("HDFS", "m", "v", "t1") == 3 and b.rules("HDFS", "m", "v", "t1", allow_global=True).count() == 4
    assert json.loads(b.rules("HDFS", "m", "v", "t1", most=1).first().rule_json)["confidence"] == 0.9
    assert b.rules("HDFS", "m", "v", source=["mined"]).count() == 0
    assert b.clear_rules("HDFS", "m", "v", "llm_cluster", "t1", scope="other") == 0 and b.clear_rules("HDFS", "m", "v", "llm_cluster", "t1") == 3
    b.write("unigrams_by_label", spark.createDataFrame([(1, 0, 5)], "row_id int, label int, cnt long"))
    b.write("unigrams_by_label", spark.createDataFrame([(2, 1, 6)], "row_id int, label int, cnt long"))
    assert [tuple(r) for r in b.read("unigrams_by_label").collect()] == [(2, 1, 6)]
    b.upsert("discrete_patterns", spark.createDataFrame([("E1", "normal", 3), ("E1", "normal", 4)], "event_id string, status string, support long"))
    b.upsert("discrete_patterns", spark.createDataFrame([("E2", "anomalous", 1)], "event_id string, status string, support long"))
    assert {tuple(r) for r in b.read("discrete_patterns").collect()} == {("E1", "normal", 4), ("E2", "anomalous", 1)}


def test_json_shapes(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"seq_key": "a", "x": [1]}, {"y": 2}, 3]')
    (tmp_path / "map.json").write_text('{"0": {"seq_key": "b"}, "1": {"seq_key": "c"}}')
    assert {json.loads(r.result)["seq_key"] for n in ("list", "map") for r in jsons.session_results(spark, str(tmp_path / f"{n}.json")).collect()} == {"a", "b", "c"}
    shapes = ['[{"rules": [{"name": "a"}]}, {"rules": [{"name": "b"}, 4]}]', '{"0": {"rules": [{"name": "c"}]}}', '[{"name": "d", "if_any": []}]', "no json"]
    names = []
    for i, t in enumerate(shapes):
        (tmp_path / f"c{i}.json").write_text(t)
        names += [r["name"] for r in jsons.cluster_rules(spark, str(tmp_path / f"c{i}.json"))]
    assert names == ["a", "b", "c", "d"] and [r["name"] for r in jsons.responses([{"cluster_id": 1, "response": {"rules": [{"name": "z"}]}}, {"rules": [{"name": "y"}]}])] == ["z", "y"]
    assert jsons.by_cluster([{"cluster_id": 1, "response": {"r": 1}}, {"cluster_id": "2"}, 5]) == {"1": {"r": 1}, "2": {"cluster_id": "2"}} and jsons.by_cluster({"3": {"q": 1}, "4": 0}) == {"3": {"q": 1}}
    jsons.write_jsons(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "out"), {"n": 1})
    assert spark.read.json(str(tmp_path / "out")).first().k == "a" and json.loads(spark.read.text(str(tmp_path / "out_meta")).first()[0]) == {"n": 1}
    jsons.append_timing(spark, str(tmp_path / "t"), {"run": "a", "seconds": 1.5})
    jsons.append_timing(spark, str(tmp_path / "t"), {"run": "b", "seconds": 2.0, "sessions": 3})
    assert {tuple(r) for r in jsons.timings(spark, str(tmp_path / "t"), ["run", "seconds", "sessions"]).collect()} == {("a", "1.500000", None), ("b", "2.000000", "3")}


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("train: {lr: 1e-3, epochs: '3', batch_size: 8}\ndata: {window: 20, stride: 1, val_size: 0.1, test_size: .2, data_dir: x, train_size: 'none'}\nrun: {seed: 43}\ncluster: {min_cluster_size: many, min_samples: 4}\neval: {a: 1}\n")
    c = config.load(str(tmp_path / "c.yaml"), {"EPOCHS": "7", "CLUSTER_ENABLED": "Yes", "TRAIN_SIZE": ""})
    assert c.train["lr"] == 0.001 and c.train["epochs"] == 7 and c.cluster["enabled"] is True and c.cluster["min_cluster_size"] == 10 and c.cluster["min_samples"] == 4
    assert c.data["train_size"] is None and c.distill["lambda"] == 0.3 and c.eval == {"a": 1} and c.llm["use_cache"] is True
    for env in ({"LR": "fast"}, {"SEED": "x"}):
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "c.yaml"), env)
    with pytest.raises(ValueError):
        config.coerced({})


def test_readers(spark, tmp_path):
    (tmp_path / "bgl.csv").write_text("EventId,EventTemplate,Node,Timestamp,Label\nE1,t1,n,20.7,-\nE2,t2,n,10,APPREAD\nE3,t3,n,bad,-\nE4,,m,5,-\n")
    lines = logs.load(spark, "bgl", str(tmp_path / "bgl.csv"))
    got = {r.sk: (r.anom, r.ts_sec) for r in lines.collect() if r.eid != "E3"}
    assert got["m"] == (0, 5)
    seq = {r.session_id: (r.event_seq, r.label) for r in Q.sessions(lines).collect()}
    assert seq == {"n": ([1, 0, 2], 1), "m": ([3], 0)}
    (tmp_path / "lvl.csv").write_text("EventId,EventTemplate,NodeRepeat,Level\nE1,t,a,info\nE2,t,a,Fatal\n")
    assert [r.anom for r in logs.load(spark, "BGL", str(tmp_path / "lvl.csv")).orderBy("line_id").collect()] == [0, 1]
    (tmp_path / "lib.csv").write_text("ts,Label,log,LabelToken\n100.9,0,x ln1 b,Z\nbad,2,y,A\n650,1,x ln1 c,A\n")
    a = {(r.sk, r.eid, r.anom) for r in logs.load(spark, "LIBERTY", str(tmp_path / "lib.csv"), bucket=600, ids="label_token").collect()}
    assert a == {("ln1::0", "Z", 0), ("GLOBAL::0", "A", 0), ("ln1::1", "A", 1)}
    assert [r.event_id for r in Q.templates(logs.load(spark, "LIBERTY", str(tmp_path / "lib.csv"), ids="label_token"), by_name=True).orderBy("row_id").collect()] == ["A", "Z"]
    with pytest.raises(ValueError):
        logs.load(spark, "NOPE")
    with pytest.raises(ValueError):
        logs.load(spark, "LIBERTY", str(tmp_path / "bgl.csv"))


def test_sequences_more(spark, s):
    t = spark.createDataFrame([("[1, 2]",), ("1,E7,x",), ("",), (None,), ("['3']",)], "t string")
    ids = F.create_map(F.lit("E7"), F.lit(7))
    assert [r[0] for r in t.select(Q.coerced(F.col("t"), ids)).collect()] == [[1, 2], [1, 7], [], [], [3]]
    assert {r.session_id for r in Q.usable(s, True).collect()} == {"s1", "s3"} and Q.vocabulary_size(s).first().n == 3
    parts = Q.split_by_group(spark.createDataFrame([(f"x{i}", [1], i % 2) for i in range(200)], s.schema), 0.1, 0.2, train=0.3)
    n = {(r.split, r.label): r["count"] for r in parts.groupBy("split", "label").count().collect()}
    assert n == {("test", 0): 20, ("test", 1): 20, ("val", 0): 10, ("val", 1): 10, ("train", 0): 30, ("train", 1): 30, (None, 0): 40, (None, 1): 40}
    assert Q.session_key(["Node", "seq_key"], "LIBERTY") == "seq_key" and Q.session_key(["SessionId", "Node"], "x") == "SessionId" and Q.session_key([], "BGL") == "Node"
    lines = spark.createDataFrame([(i * 700_000, f"e{(i * 7) % 40:02d}") for i in range(40)], "line_id long, eid string")
    assert [r.row_id for r in Q.templates(lines).orderBy("first_line").collect()] == list(range(40))
    assert [r.event_id for r in Q.templates(lines, by_name=True).orderBy("row_id").collect()] == [f"e{i:02d}" for i in range(40)]


def test_explanations(spark, s):
    rules = [R.Rule("c1_x", (R.Clause("contains_ngram", rids=(0, 1)), R.Clause("ordered_subset", rids=(2,)))), R.Rule("c2_x", (R.Clause("ordered_subset", rids=(2, 1)),)), R.Rule("y", (), (R.Clause("absent_within", row_id=2),))]
    got = {r.session_id: r for r in E.explained(R.fires(s, rules), rules, {0: "A", 1: "B"}, {"c1_x": "1", "y": "9"}).collect()}
    assert got["s1"].triggered_rules == ["c1_x"] and got["s1"].triggered_ngrams == ["A→B", "E2→B"] and got["s1"].cluster_reference == "1"
    assert got["s4"].triggered_rules == ["y"] and got["s4"].triggered_ngrams == [] and got["s4"].cluster_reference == "9"
    assert E.explained(R.fires(s, []), [], {}).count() == 4
    assert set(E.timed(lambda: 4)) == {"sessions", "seconds", "seconds_each"}


def test_stream_of_sessions(spark, tmp_path):
    schema = "host string, ts timestamp, line_id long, row_id int"
    spark.createDataFrame([("h", 10, 2, 5), ("h", 5, 1, 4), ("h", 70, 3, 6), ("h", 9000, 9, 9)], "host string, t long, line_id long, row_id int").selectExpr("host", "timestamp_seconds(t) ts", "line_id", "row_id").write.parquet(str(tmp_path / "in"))
    q = stream.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.session_id, tuple(r.event_seq)) for r in spark.table("closed").collect()} == {("h::0", (4, 5)), ("h::60", (6,))}
