"""The literal micro-fixture: sessions s1 [0,1,2,1] y=1, s2 [0,1] y=0, s3 [2,2,2,0,1] y=1, s4 [] y=0."""

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import scalars as S
from sessionloom.operators import rules as R
from sessionloom.operators import sequences as Q
from sessionloom.operators import verdicts as V
from sessionloom.sources import logs


@pytest.fixture(scope="module")
def s(spark):
    return spark.createDataFrame([("s1", [0, 1, 2, 1], 1), ("s2", [0, 1], 0), ("s3", [2, 2, 2, 0, 1], 1), ("s4", [], 0)], "session_id string, event_seq array<int>, label int")


def test_windows(s):
    got = sorted((r.session_id, r.win_idx, tuple(r.tokens)) for r in Q.windows(s, 3).collect())
    assert got == [("s1", 0, (0, 1, 2)), ("s1", 1, (1, 2, 1)), ("s3", 0, (2, 2, 2)), ("s3", 1, (2, 2, 0)), ("s3", 2, (2, 0, 1))]
    assert Q.windows(s, 3, stride=2).count() == 3
    padded = {(r.session_id, tuple(r.tokens)) for r in Q.windows(s, 3, pad=True).collect()}
    assert len(padded) == 7 and ("s2", (0, 1, 1)) in padded and ("s4", (0, 0, 0)) in padded


@pytest.mark.parametrize(
    ("clause", "want"),
    [
        (R.Clause("contains_ngram", rids=(1, 2)), {"s1"}),
        (R.Clause("contains_ngram"), set()),
        (R.Clause("ordered_subset", rids=(0, 1)), {"s1", "s2", "s3"}),
        (R.Clause("ordered_subset", rids=(2, 1)), {"s1", "s3"}),
        (R.Clause("ordered_subset"), {"s1", "s2", "s3", "s4"}),
        (R.Clause("min_count", row_id=1, count=2), {"s1"}),
        (R.Clause("absent_within", row_id=2), {"s2", "s4"}),
        (R.Clause("absent_within"), set()),
    ],
)
def test_clauses(s, clause, want):
    assert {r[0] for r in s.where(clause.column(F.col("event_seq"))).select("session_id").collect()} == want


def test_empty_rule_fires_unless_any_only(s):
    assert s.where(R.Rule("x").column(F.col("event_seq"))).count() == 4
    assert s.where(R.Rule("x", any_only=True).column(F.col("event_seq"))).count() == 0


def test_metrics_and_weights(spark, s):
    got = V.prf1(s.withColumn("pred", R.Clause("contains_ngram", rids=(1, 2)).column(F.col("event_seq")).cast("int"))).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (1, 0, 1, 2) and got.precision == 1 and got.recall == 0.5 and abs(got.f1 - 2 / 3) < 1e-9
    w = spark.createDataFrame([(0,)] + [(1,)] * 5, "label int")
    assert {r.label: round(r.weight, 6) for r in Q.class_weights(w).collect()} == {0: 1.666667, 1: 0.333333}


def test_votes_and_parsers(spark):
    rows = spark.createDataFrame([(1, 0.70), (1, 0.60), (0, 0.70), (0, 0.90), (None, None)], "risk int, conf double")
    assert [r[0] for r in rows.select(V.vote(F.col("risk"), F.col("conf"), 0.65, 0.8)).collect()] == [1, 0, 1, 0, 0]
    logs_ = spark.createDataFrame([("2005.09.02 ln215 Sep 2",), ("x",)], "log string")
    assert [r[0] for r in logs_.select(S.host(F.col("log"))).collect()] == ["ln215", "GLOBAL"]
    assert spark.createDataFrame([("a blk_-12 blk_3",)], "c string").select(S.block_id(F.col("c"))).first()[0] == "blk_-12"


def test_hdfs_reader(spark, tmp_path):
    (tmp_path / "log.csv").write_text("LineId,Content,EventId,EventTemplate\n1,x blk_1,E1,t\n2,none,E2,\n3,y blk_2,E1,t\n")
    (tmp_path / "y.csv").write_text("BlockId,Label\nblk_1,Anomaly\n")
    got = logs.load(spark, "hdfs", str(tmp_path / "log.csv"), str(tmp_path / "y.csv")).orderBy("line_id").collect()
    assert [(r.sk, r.eid, r.anom) for r in got] == [("blk_1", "E1", 1), ("blk_2", "E1", 0)]


def test_greedy_union():
    assert R.greedy([("a", [True, True, False, False]), ("b", [False, False, True, False]), ("never", [False] * 4)], [1, 1, 1, 0], max_fire=0.9) == ["a", "b"]
