"""Whole jobs: what an earlier cut left out."""

import duckdb
import numpy as np

from __spark_entry__ import entry
from sessionloom.operators import verdicts as V
from sessionloom.queries import ORACLES, QUERIES


def test_knn_blocks_are_brute_force(spark):
    m = np.random.default_rng(2).normal(size=(300, 8))
    m[7] = m[150]
    rows = [(i + 5, [float(x) for x in v]) for i, v in enumerate(m)] + [(1000, None), (1050, [0.0] * 8), (1100, [None] * 8)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = t.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "embedding q")
    got = {}
    for r in V.knn_cosine_blocks(q, t, 5, block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = m / np.sqrt((m * m).sum(1))[:, None]
    want = {}
    for i in range(50, 305, 50):
        s = u @ u[i - 5]
        want[i] = [int(j) + 5 for j in np.lexsort((np.arange(300), -s.round(12))) if j != i - 5][:5]
    assert got == want
    assert V.knn_cosine_blocks(q.limit(0), t, 5).count() == V.knn_cosine_blocks(q, t.limit(0), 5).count() == 0


def test_disc_patterns_is_its_sql_on_the_smallest_table(spark):
    d, c = "/root/testdata/sf0.001", duckdb.connect()
    c.sql(f"create view events as select * from '{d}/events.parquet'")
    assert {tuple(r) for r in QUERIES["disc_patterns"](spark, d).collect()} == set(c.sql(ORACLES["disc_patterns"]).fetchall())
    least = ORACLES["disc_patterns"].replace("ca >= 10", "ca >= 2")
    assert {tuple(r) for r in entry(spark).collect()} == set(c.sql(least).fetchall())
