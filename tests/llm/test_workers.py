"""What Python workers hold once a task has ended: Spark keeps them idle beside the JVM, and counts all of it as the executor's."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_codec_caches_end_with_the_task(spark):
    rows = [(i, " ".join(f"w{x}" for x in np.random.default_rng(i).integers(0, 1 << 40, 200)), None, None, 0) for i in range(64)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert corpus_pipeline.tokens(spark, docs, "").count() == 64
    assert len({r.ids_sha256 for r in corpus_pipeline.tokens(spark, docs, "").collect()}) == 64

    def cached(batches):
        """Of each codec in this worker, the number of cached pieces."""
        import gc

        list(batches)
        found = [o for o in gc.get_objects() if type(o).__name__ == "BytePairCodec"]
        yield pa.RecordBatch.from_arrays([pa.array([len(c.names) + len(c.raw) + len(c.fits) for c in found], pa.int64())], ["n"])

    left = [r.n for r in spark.range(64).repartition(16).mapInArrow(cached, "n long").collect()]
    assert left and max(left) == 0


def test_one_worker_a_task_for_passages(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y", None, None, 0), (2, "other", None, None, 0)], SCHEMA)
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [r.doc_id for r in out.collect()] == [2]


MEASURE = """
import re, sys
import numpy as np, pyarrow as pa
from sessionloom.llm import langid, minhash
def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
def batch():
    words = np.random.default_rng(3).integers(0, 1 << 40, (2000, 150))
    return pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([" ".join(map(str, w)) for w in words])], ["id", "text"])
def work():
    yield batch()
for run in (minhash._sketch(5), langid._predict(langid.ByteConvNet(["xx", "yy"]))):
    sum(x.num_rows for x in run(iter([batch().slice(0, 2)])))
    before = held()
    assert sum(x.num_rows for x in run(work())) == 2000
    print(held() - before)
"""


def test_memory_goes_back(tmp_path):
    """A map over 4 MB of text holds tables, and freed memory that allocators keep (before: 76 MB after the sketch)."""
    got = subprocess.run([sys.executable, "-c", MEASURE], capture_output=True, text=True, check=True, timeout=120, cwd=corpus_pipeline.__file__.rpartition("/")[0])
    assert max(map(float, got.stdout.split())) < 30, got.stdout
