"""The knowledge base: tables of fixed schema under one folder, each a Parquet directory.

A change writes a new version beside the old one and then moves a small pointer (the folder's highest number wins), so
readers see whole versions only and a lost executor leaves the last one untouched. Keys make an upsert: of equal keys
the newest row stays. Rules are told by name *and* dataset, model, vocabulary and run, so equal names of other runs stay.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The tables, their columns and keys.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "discrete_patterns": ("event_id string, status string, support long", ("event_id",)),
    "ngram_patterns": ("ngram string, n int, status string, support long", ("ngram",)),
    "semantic_index": ("seq_key string, label int, emb array<float>", ("seq_key",)),
    "dynamic_patterns": ("seq_key string, dataset string, run_tag string, snippet string, count int, is_high_risk int, rationale string, summary string, core_events string, expected_behavior string, observed_behavior string, deviations string, confidence double", ("seq_key", "dataset", "run_tag")),
    "judgments": ("pattern_key string, pattern_type string, status int, explanation string, updated_at double", ("pattern_key", "pattern_type")),
    "kb_rules": ("rule_id string, source string, dataset string, model string, vocab_from string, scope string, rule_json string, created_at double, is_active int, run_tag string", ("rule_id", "dataset", "model", "vocab_from", "run_tag")),
    "cluster_artifacts": ("run_tag string, dataset string, cluster_id string, artifact_json string, created_at double", ("run_tag", "dataset", "cluster_id")),
    "rule_to_cluster": ("rule_id string, run_tag string, cluster_id string, dataset string", ("rule_id", "run_tag")),
    "seq_cluster": ("seq_key string, run_tag string, cluster_id string, dataset string", ("seq_key", "run_tag")),
    "cluster_llm_results": ("cluster_id string, dataset string, run_tag string, response_json string, updated_at double", ("cluster_id", "dataset", "run_tag")),
    "templates": ("row_id int, event_id string", ("row_id",)),
    "unigrams_by_label": ("row_id int, label int, cnt long", ()),
    "ngrams_by_label": ("n int, grams string, label int, cnt long", ()),
}


def newest(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row of each key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class KnowledgeBase:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        where, fs = self._fs(f"{self.folder}/{table}")
        if not fs.exists(where):
            return []
        done = [s.getPath() for s in fs.listStatus(where) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def read(self, table: str) -> DataFrame:
        """The last whole version; a table that was never written is empty. A column that an older version lacks is null."""
        schema, _ = TABLES[table]
        some = self._versions(table)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/{some[-1]}") if some else self.spark.createDataFrame([], schema)

    def write(self, table: str, rows: DataFrame) -> None:
        """Replaces the whole table. Only the version before stays, for readers that have opened it."""
        some = self._versions(table)
        typed = self.spark.createDataFrame([], TABLES[table][0]).schema
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in typed]).write.mode("overwrite").parquet(f"{self.folder}/{table}/{(some[-1] if some else 0) + 1}")
        for old in some[:-1]:
            where, fs = self._fs(f"{self.folder}/{table}/{old}")
            fs.delete(where, True)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Insert or replace by the table's key; within ``rows`` the last of a key in its order of columns wins."""
        keys = TABLES[table][1]
        old = self.read(table)
        if not keys:
            return self.write(table, old.unionByName(rows, allowMissingColumns=True))
        names = [c for c in old.columns if c in rows.columns]
        new = newest(rows, keys, [F.desc(c) for c in names if c not in keys] or [F.lit(1)])
        kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
        return self.write(table, kept.unionByName(new, allowMissingColumns=True))

    def delete(self, table: str, where: Column) -> int:
        """Removes the rows for which ``where`` is true; how many."""
        rows = self.read(table)
        gone = F.coalesce(where, F.lit(False))
        n = rows.where(gone).count()
        if n:
            self.write(table, rows.where(~gone))
        return n

    # ---- rules

    @staticmethod
    def _run(dataset: str, model: str, vocab: str) -> Column:
        return (F.col("dataset") == dataset) & (F.col("model") == model) & (F.col("vocab_from") == vocab)

    def clear_rules(self, dataset: str, model: str, vocab: str, source: str, run_tag: str = "", scope: str | None = None) -> int:
        where = self._run(dataset, model, vocab) & (F.col("source") == source) & (F.col("run_tag") == run_tag)
        return self.delete("kb_rules", where & (F.col("scope") == scope) if scope is not None else where)

    def promote_rules(self, rules: list[dict], dataset: str, model: str, vocab: str, source: str = "llm_cluster", scope: str = "dataset", run_tag: str = "", now: float = 0.0, clear: bool = False) -> int:
        """Stores rules (JSON objects) as active ones of a run; a rule without a name is named by its place."""
        if clear:
            self.clear_rules(dataset, model, vocab, source, run_tag, scope)
        rows = {r.get("name") or f"{source}_{i}": json.dumps(r) for i, r in enumerate(rules)}
        if rows:
            self.upsert("kb_rules", self.spark.createDataFrame([(n, source, dataset, model, vocab, scope, j, float(now), 1, run_tag) for n, j in rows.items()], TABLES["kb_rules"][0]))
        return len(rules)

    def rules(self, dataset: str, model: str, vocab: str, run_tag: str = "", source: str | list[str] | None = None, allow_global: bool = False, most: int | None = None) -> DataFrame:
        return active_rules(self.read("kb_rules"), dataset, model, vocab, run_tag, source, allow_global, most)

    def count_rules(self, dataset: str, model: str, vocab: str, run_tag: str = "", source: str | list[str] | None = None) -> int:
        rows = active_rules(self.read("kb_rules"), dataset, model, vocab, None, source, False, None)
        return rows.where(F.col("run_tag") == run_tag).count()


def active_rules(rows: DataFrame, dataset: str, model: str, vocab: str, run_tag: str | None = None, source: str | list[str] | None = None, allow_global: bool = False, most: int | None = None) -> DataFrame:
    """Active rules of a run (of all, without a tag), and global ones if allowed; the newest ``most``, of equals by name."""
    own = KnowledgeBase._run(dataset, model, vocab)
    where = (F.col("is_active") == 1) & ((own | (F.col("scope") == "global")) if allow_global else own)
    if run_tag:
        where = where & (F.col("run_tag") == run_tag)
    some = [source] if isinstance(source, str) else list(source or ())
    if some:
        where = where & F.col("source").isin(*some)
    out = rows.where(where)
    return out.orderBy(F.desc("created_at"), "rule_id").limit(most) if most and most > 0 else out


def discrete_view(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """event_id, status, support, cnt_anom, cnt_norm: patterns with the counts of their event by label, 0 if there are none.
    ``counts``: event_id, label, cnt."""
    per = counts.groupBy("event_id").agg(F.sum(F.when(F.col("label") == 1, F.col("cnt"))).alias("cnt_anom"), F.sum(F.when(F.col("label") == 0, F.col("cnt"))).alias("cnt_norm"))
    out = patterns.join(per, "event_id", "left")
    return out.select("event_id", "status", "support", F.coalesce("cnt_anom", F.lit(0)).alias("cnt_anom"), F.coalesce("cnt_norm", F.lit(0)).alias("cnt_norm"))
