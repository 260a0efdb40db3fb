"""From raw documents to token digests: five stages, each written as Parquet and read again by the next.

Every stage works on all that the one before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, decontam, langid, lines, minhash
from sessionloom.llm.common import durable
from sessionloom.llm.queries import vocabulary

#: A text is rejected if it has no letter or no language reaches this mean probability.
LEAST_LANGUAGE = 0.3
#: Test items of fewer words tell nothing of a document that holds them.
LEAST_ITEM = 8


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``ids`` (doc_id); rows with a null id stay."""
    name = f"gone_{uuid.uuid4().hex}"  # no column of the documents
    gone = ids.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that are in a language; the predicted one replaces a missing ``lang``. Null texts, and those
    without a letter, go; an empty table stays one; other columns, whatever their names, pass unchanged."""
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    net = langid.learn(known.where(~langid.held_out(F.col("id"))))
    rows = docs.select(F.struct("*").alias("row"), langid.predicted(F.col("text").cast("string"), net).alias("p"))
    kept = rows.where((F.col("p.lang_pred") != langid.UNKNOWN) & (F.col("p.score") >= LEAST_LANGUAGE))
    return kept.select(*[F.coalesce("row.lang", "p.lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out later matches of lines; a text of which nothing but white space is left goes, if it had lost a line.
    ``n_chars`` follows the text. Null texts and rows with a null id stay as they are; other columns pass unchanged."""
    out = lines.dedup_lines(docs.select(F.struct("*").alias("row"), "doc_id", "text"), short=True)
    out = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("kept_text"), "n_chars": n_chars}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8. Rows that share an id are
    one document; null and wordless texts are like nothing and stay."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80)
    return without(docs, found.where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, of items of ``LEAST_ITEM`` words or more."""
    return without(docs, decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=LEAST_ITEM))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left; a null text is an empty one."""
    return bpe.encode_documents(docs, *vocabulary())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
