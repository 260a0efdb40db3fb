"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, lines, minhash, neighbours, pii, sharding, suffix_tree, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern; LOOM_TOKENIZERS may name another folder for the file."""
    import public_tokenizers

    folder = os.environ.get("LOOM_TOKENIZERS")
    return (os.path.join(folder, VOCABULARY) if folder else public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), *vocabulary())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_personal_data, op3_neighbours, op4_byte_bpe, op5_decontamination, op6_near_duplicates, op7_line_dedup, op8_suffix_tree, op9_toxicity, op10_sharding, pipeline)}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "'[^\\x20\\x09-\\x0D]+'"
#: SQL of what it can express; the other results are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op6_near_duplicates": f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), {_WORDS}) w from documents),
 g as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end q from w),
 s as (select doc_id, len(q) n, unnest(q) t from g),
 o as (select a.doc_id u, b.doc_id v, any_value(a.n) nu, any_value(b.n) nv, count(*) o from s a join s b on a.t = b.t and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
 l as (select u, v from o where 100 * o >= 80 * (nu + nv - o)), e as (select u, v from l union all select v, u from l),
 r(a, b) as (select u, v from e union select r.a, e.v from r join e on r.b = e.u),
 c as (select a, min(b) m from r group by a)
 select g.doc_id doc_id, cast(len(q) as bigint) n_shingles, least(g.doc_id, coalesce(m, g.doc_id)) component_id, least(g.doc_id, coalesce(m, g.doc_id)) = g.doc_id kept from g left join c on c.a = g.doc_id""",
    "op7_line_dedup": f"""with d as (select doc_id, text, string_split(text, chr(10)) parts from documents),
 li as (select doc_id, unnest(parts) raw, unnest(range(0, len(parts))) line from d),
 w as (select doc_id, line, regexp_extract_all(lower(raw), {_WORDS}) w from li),
 g as (select doc_id, line, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) else [array_to_string(w, ' ')] end q from w where len(w) > 0),
 s as (select doc_id, line, len(q) n, unnest(q) t from g),
 o as (select a.doc_id ad, a.line al, b.doc_id bd, b.line bl, any_value(a.n) na, any_value(b.n) nb, count(*) o from s a join s b on a.t = b.t and (a.doc_id < b.doc_id or (a.doc_id = b.doc_id and a.line < b.line)) and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
 gone as (select distinct bd, bl from o where 100 * o >= 80 * (na + nb - o)),
 k as (select doc_id, count(*) n, count(bd) r, coalesce(string_agg(raw, chr(10) order by line) filter (bd is null), '') kept from li left join gone on bd = doc_id and bl = line group by doc_id)
 select d.doc_id doc_id, cast(coalesce(n, 0) as int) n_lines, cast(coalesce(r, 0) as int) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k on d.doc_id = k.doc_id""",
}
