"""Queries over the driver's tables and their SQL oracles, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import mining as M
from .operators import rules as R
from .operators import sequences as Q
from .operators import verdicts as V
from .sources.logs import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINES = """lines as (select event_id line_id, cast(user_id as varchar) host, cast(floor(epoch(ts)) as bigint) ts_sec,
 event_type || '_' || cast(cast(least(floor(value / 50), 5) as bigint) as varchar) eid, cast(value > 200 as int) anom,
 cast(user_id as varchar) || '::' || cast(cast(floor(floor(epoch(ts)) / 604800) as bigint) as varchar) sk from events)"""
DICT = LINES + """, dict as (select eid event_id, cast(row_number() over (order by min(line_id), eid) - 1 as int) row_id, min(line_id) first_line from lines group by eid)"""
SESS = DICT + """, sess as (select sk session_id, list(row_id order by ts_sec, line_id) event_seq, max(anom) label, ' ' || string_agg(cast(row_id as varchar), ' ' order by ts_sec, line_id) || ' ' txt,
 string_agg(eid, ' ' order by ts_sec, line_id) etxt from lines join dict on eid = event_id group by sk)"""
GRAMS = LINES + """, lab as (select *, max(anom) over (partition by sk) label, lead(eid, 1) over w e1, lead(eid, 2) over w e2 from lines window w as (partition by sk order by ts_sec, line_id)),
 g as (select 1 n, eid gram, label from lab union all select 2, eid || ' ' || e1, label from lab where e1 is not null union all select 3, eid || ' ' || e1 || ' ' || e2, label from lab where e2 is not null),
 counts as (select n, gram, cast(sum(label) as bigint) ca, cast(sum(1 - label) as bigint) cn from g group by n, gram)"""
WINDOWS = SESS + """, win as (select session_id, label, cast(i as int) win_idx, list_slice(event_seq, i + 1, i + 5) tokens from sess, unnest(range(0, len(event_seq) - 4)) t(i) where len(event_seq) >= 5),
 seen as (select distinct unnest(event_seq) rid from sess where label = 0),
 scored as (select session_id, label, win_idx, len(list_filter(tokens, lambda x: x not in (select rid from seen))) from win)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "with " + sql if sql.startswith("lines as") else sql
        return f

    return add


def _text(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), " ")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return Q.sessions(events(spark, d))


def _counts(spark: SparkSession, d: str, longest: int = 3) -> DataFrame:
    return M.ngram_counts(events(spark, d), longest)


@query(GRAMS + " select gram eid, ca, cn from counts where n = 1 and ca >= 10 and cn <= 1 order by ca desc, cn, gram limit 200")
def disc_patterns(spark, d, least=10):
    return M.discriminative(_counts(spark, d, 1), least).select(F.col("gram").alias("eid"), "ca", "cn")


@query(LINES + " select line_id, host, ts_sec, eid, anom, sk from lines")
def log_lines(spark, d):
    return events(spark, d).select("line_id", "host", "ts_sec", "eid", "anom", "sk")


@query(DICT + " select event_id, row_id, first_line from dict")
def template_dict(spark, d):
    return Q.templates(events(spark, d))


@query(SESS + " select session_id, trim(txt) seq, label from sess")
def session_seq(spark, d):
    return _sessions(spark, d).select("session_id", _text("event_seq").alias("seq"), "label")


@query(LINES + " select sk session_id, max(anom) label, count(*) n_lines from lines group by sk")
def session_labels(spark, d):
    return events(spark, d).groupBy(F.col("sk").alias("session_id")).agg(F.max("anom").alias("label"), F.count("*").alias("n_lines"))


@query("select event_id, regexp_extract('a blk_-' || cast(event_id as varchar) || ' blk_3', '(blk_-?\\d+)', 1) block from events")
def block_id_extract(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.block_id(F.concat(F.lit("a blk_-"), F.col("event_id").cast("string"), F.lit(" blk_3"))).alias("block"))


@query(LINES + " select host, cast(floor(ts_sec / 86400) as bigint) bucket, count(*) n from lines group by all")
def host_bucket(spark, d):
    return events(spark, d).groupBy("host", F.floor(F.col("ts_sec") / 86400).alias("bucket")).agg(F.count("*").alias("n"))


@query(WINDOWS.split(",\n seen")[0] + " select session_id, win_idx, array_to_string(tokens, ' ') tokens, label from win")
def sliding_windows(spark, d):
    return Q.windows(_sessions(spark, d), 5).withColumn("tokens", _text("tokens"))


@query(SESS + """, pad as (select session_id, label, case when len(event_seq) < 5 then list_concat(event_seq, list_transform(range(0, 5 - len(event_seq)), lambda x: event_seq[-1])) else event_seq end q from sess)
 select session_id, cast(i as int) win_idx, array_to_string(list_slice(q, i + 1, i + 5), ' ') tokens, label from pad, unnest(range(0, len(q) - 4)) t(i)""")
def padded_windows(spark, d):
    return Q.windows(_sessions(spark, d), 5, pad=True).withColumn("tokens", _text("tokens"))


@query(SESS + """, r as (select *, row_number() over (partition by label order by md5(session_id || '#43'), session_id) / count(*) over (partition by label) share from sess)
 select case when share <= 0.2 then 'test' when share <= 0.2 + 0.1 then 'val' else 'train' end split, count(*) sessions, cast(sum(label) as bigint) anomalies, cast(sum(len(event_seq)) as bigint) n_lines from r group by 1""")
def split_stats(spark, d):
    return Q.split_by_group(_sessions(spark, d), 0.1, 0.2, 43).groupBy("split").agg(F.count("*").alias("sessions"), F.sum("label").alias("anomalies"), F.sum(F.size("event_seq")).alias("n_lines"))


@query(SESS + """, c as (select label, count(*) n from sess group by label), i as (select label, (select sum(n) from c) / n inv from c) select label, round(inv / (select sum(inv) from i) * (select count(*) from i), 9) weight from i""")
def class_weights(spark, d):
    return Q.class_weights(_sessions(spark, d)).withColumn("weight", F.round("weight", 9))


@query(WINDOWS.split(",\n seen")[0] + ", x as (select session_id, win_idx, unnest(tokens) row_id from win) select session_id, win_idx, row_id, count(*) cnt from x group by all")
def count_vectors(spark, d):
    return Q.count_vectors(Q.windows(_sessions(spark, d), 5))


@query(GRAMS + " select n, gram, ca, cn from counts")
def ngram_counts(spark, d):
    return _counts(spark, d)


@query(GRAMS + " select gram, ca, cn, round((ca + 1.0::double) / (cn + 1.0::double), 9) lift from counts where n = 1 and ca >= 2 and (ca + 1.0::double) / (cn + 1.0::double) >= 1.3 order by (ca + 1.0::double) / (cn + 1.0::double) desc, ca desc, n, gram limit 20")
def unigram_lift(spark, d):
    return M.by_lift(_counts(spark, d, 1), (1,)).select("gram", "ca", "cn", F.round("lift", 9).alias("lift"))


@query(GRAMS + " select n, gram, ca, cn, round((ca + 1.0::double) / (cn + 1.0::double), 9) lift from counts where n in (2, 3) and ca >= 2 and (ca + 1.0::double) / (cn + 1.0::double) >= 1.3 order by (ca + 1.0::double) / (cn + 1.0::double) desc, ca desc, n, gram limit 500")
def ngram_lift(spark, d):
    return M.by_lift(_counts(spark, d), (2, 3), top=500).select("n", "gram", "ca", "cn", F.round("lift", 9).alias("lift"))


@query(GRAMS + " select n, gram, ca + cn support from counts where n = 2 and ca + cn >= 20 or n = 3 and ca + cn >= 15")
def frequent_ngrams(spark, d):
    return M.frequent(_counts(spark, d), {2: 20, 3: 15})


@query(GRAMS + " select gram eid, ca support from counts where n = 1 and ca > 0 and cn = 0")
def anomalous_only(spark, d):
    return _counts(spark, d, 1).where("n = 1 and ca > 0 and cn = 0").select(F.col("gram").alias("eid"), F.col("ca").alias("support"))


PHRASES = ["error_4", "error_5", "purchase_5", "click_5", "view_0 view_0", "signup_4"]


@query(SESS + ", p as (select unnest(['" + "', '".join(PHRASES) + "']) phrase) select phrase, cast(sum(label) as bigint) anom_sessions, cast(sum(1 - label) as bigint) norm_sessions, case when sum(1 - label) = 0 then 0.9::double else 0.75::double end confidence from p, sess where contains(etxt, phrase) group by phrase having sum(label) >= 3 and sum(1 - label) <= 0")
def keyword_rules(spark, d):
    text = events(spark, d).groupBy("sk").agg(F.array_sort(F.collect_list(F.struct("ts_sec", "line_id", "eid"))).alias("q"), F.max("anom").alias("label"))
    return M.phrase_hits(text.select(F.col("sk").alias("session_id"), F.array_join(F.transform("q", lambda x: x["eid"]), " ").alias("text"), "label"), PHRASES)


def _rule_query(name: str, clause: R.Clause, sql: str) -> None:
    def run(spark, d):
        return _sessions(spark, d).select("session_id", clause.column(F.col("event_seq")).cast("int").alias("fires"))

    run.__name__ = name
    query(SESS + f" select session_id, cast({sql} as int) fires from sess")(run)


_rule_query("rule_min_count", R.Clause("min_count", row_id=1, count=2), "len(list_filter(event_seq, lambda x: x = 1)) >= 2")
_rule_query("rule_contains_ngram", R.Clause("contains_ngram", rids=(0, 1)), "contains(txt, ' 0 1 ')")
_rule_query("rule_ordered_subset", R.Clause("ordered_subset", rids=(0, 1, 2)), "regexp_matches(txt, ' 0 (.* )?1 (.* )?2 ')")
_rule_query("rule_absent", R.Clause("absent_within", row_id=3), "not list_contains(event_seq, 3)")


@query(SESS + " select session_id, cast(contains(etxt, 'error_') as int) fires from sess")
def rule_template_contains(spark, d):
    per = events(spark, d).groupBy("sk").agg(F.collect_list("eid").alias("texts"))
    return per.select(F.col("sk").alias("session_id"), R.Clause("template_contains", phrase="ERROR_").column(F.col("texts"), F.col("texts")).cast("int").alias("fires"))


RULES = [R.Rule("r0", (R.Clause("contains_ngram", rids=(0, 1)),)), R.Rule("r1", (), (R.Clause("ordered_subset", rids=(1, 2)), R.Clause("min_count", row_id=0, count=1))), R.Rule("r2", (R.Clause("min_count", row_id=5, count=2), R.Clause("contains_ngram", rids=(2, 2))))]
FIRED = SESS + """, f as (select session_id, label, contains(txt, ' 0 1 ') r0, regexp_matches(txt, ' 1 (.* )?2 ') and list_contains(event_seq, 0) r1,
 len(list_filter(event_seq, lambda x: x = 5)) >= 2 or contains(txt, ' 2 2 ') r2 from sess)"""


@query(FIRED + " select session_id, label, concat_ws(',', case when r0 then 'r0' end, case when r1 then 'r1' end, case when r2 then 'r2' end) fired from f")
def rule_set_fire(spark, d):
    return R.fires(_sessions(spark, d), RULES).withColumn("fired", F.array_join("fired", ","))


def _legs(spark, d):
    f = R.fires(_sessions(spark, d), RULES)
    return f.select("session_id", "label", *[F.array_contains("fired", f"r{i}").cast("int").alias(f"r{i}") for i in range(3)])


for _name, _sql in (("or", "r0 or r1 or r2"), ("and", "r0 and r1 and r2"), ("vote2", "r0::int + r1::int + r2::int >= 2")):

    def _fuse(spark, d, how=_name):
        return _legs(spark, d).select("session_id", V.fuse([F.col(f"r{i}") for i in range(3)], how).alias("pred"))

    _fuse.__name__ = f"fuse_{_name}"
    query(FIRED + f" select session_id, cast({_sql} as int) pred from f")(_fuse)


@query(FIRED + " select session_id, least(r0::int, greatest(r1::int, r2::int)) gated from f")
def gate_llm(spark, d):
    return _legs(spark, d).select("session_id", V.gate(F.col("r0"), F.col("r1"), F.col("r2")).alias("gated"))


@query(FIRED + ", l as (select unnest([struct_pack(leg := 'r0', v := r0::int), struct_pack(leg := 'r1', v := r1::int), struct_pack(leg := 'r2', v := r2::int)]) x, label from f) select x.leg leg, round(avg(x.v), 9) fire_rate, round(avg(x.v) filter (label = 0), 9) normal_fire_rate, avg(x.v) filter (label = 0) <= 0.35 kept from l group by 1")
def leg_filter(spark, d):
    legs = _legs(spark, d).select("label", F.explode(F.array(*[F.struct(F.lit(f"r{i}").alias("leg"), F.col(f"r{i}").alias("pred")) for i in range(3)])).alias("x")).select("label", "x.*")
    rates = V.fire_rates(legs, by=["leg"])
    return rates.select("leg", F.round("fire_rate", 9).alias("fire_rate"), F.round("normal_fire_rate", 9).alias("normal_fire_rate"), (F.col("normal_fire_rate") <= 0.35).alias("kept"))


@query(FIRED + ", c as (select count(*) filter ((r0 or r1) and label = 1) tp, count(*) filter ((r0 or r1) and label = 0) fp, count(*) filter (not (r0 or r1) and label = 1) fn, count(*) filter (not (r0 or r1) and label = 0) tn from f) select tp, fp, fn, tn, round(tp / (tp + fp), 9) \"precision\", round(tp / (tp + fn), 9) recall, round(2.0::double * tp / (2 * tp + fp + fn), 9) f1 from c")
def prf1(spark, d):
    out = V.prf1(_legs(spark, d).withColumn("pred", V.fuse([F.col("r0"), F.col("r1")], "or")))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


SCORES = WINDOWS.split(",\n seen")[0] + """, sc as (select session_id, label, win_idx, len(list_filter(tokens, lambda x: x >= 20)) / 5 p1 from win)"""


def _scores(spark, d):
    """A surrogate scorer: the share of a window's tokens that are late in the dictionary."""
    w = Q.windows(_sessions(spark, d), 5)
    return w.select("session_id", "label", "win_idx", (F.size(F.filter("tokens", lambda x: x >= 20)) / 5.0).alias("p1"))


for _name, _agg in (("mean", "avg(p1) >= 0.3"), ("max", "max(p1) >= 0.3"), ("kofn", "count(*) filter (p1 >= 0.3) >= 3")):

    def _agg_query(spark, d, how=_name):
        return V.to_session(_scores(spark, d), how, 0.3, 3)

    _agg_query.__name__ = f"session_agg_{_name}"
    query(SCORES + f" select session_id, max(label) label, cast({_agg} as int) pred from sc group by session_id")(_agg_query)


@query(SCORES + ", s as (select session_id, max(label) label, max(p1) score from sc group by 1), g as (select i / 20 th, label, score >= i / 20 pred from s, unnest(range(1, 20)) t(i)) select th, count(*) filter (pred and label = 1) tp, count(*) filter (pred and label = 0) fp, count(*) filter (not pred and label = 1) fn from g group by th")
def threshold_grid(spark, d):
    s = _scores(spark, d).groupBy("session_id").agg(F.max("label").alias("label"), F.max("p1").alias("score"))
    return V.threshold_grid(s).select("th", "tp", "fp", "fn")


@query(SESS + ", r as (select session_id term_of, unnest(event_seq) term from sess), tf as (select term_of, term, count(*) tf from r group by all), df as (select term, count(*) df from tf group by 1), w as (select term_of, tf.term term, tf * (ln((1 + (select count(*) from sess)) / (1 + df)) + 1) w from tf join df using (term)) select term_of session_id, term, round(w / sqrt(sum(w * w) over (partition by term_of)), 6) tfidf from w")
def tfidf(spark, d):
    rows = _sessions(spark, d).select("session_id", F.explode("event_seq").alias("term"))
    return V.tfidf(rows).withColumn("tfidf", F.round("tfidf", 6))


@query("with q as (select vec_id query_id, embedding e from embeddings where vec_id % 50 = 0), n as (select query_id, vec_id, list_cosine_similarity(e::double[], embedding::double[]) s from q, embeddings where vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by s desc, vec_id) rank from n) select query_id, vec_id, cast(rank as int) rank, round(s, 6) similarity from r where rank <= 5")
def knn_cosine(spark, d):
    """Every id divisible by 50 against all rows."""
    t = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return V.knn_cosine_blocks(t.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), t, 5).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), F.round("similarity", 6).alias("similarity"))


JUDGED = "with j as (select doc_id, toxic risk, case when doc_id % 3 = 0 then null else (doc_id % 10) / 10 end conf, quality + 1 cnt from labels)"


@query(JUDGED + " select doc_id, cast(case when risk = 1 then coalesce(conf, 0.5) >= 0.65 else coalesce(conf, 0.5) < 0.3 end as int) fires, case when risk = 0 and conf >= 0.85 and cnt >= 2 then 1 else risk end promoted from j")
def llm_votes(spark, d):
    j = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("toxic").alias("risk"), F.when(F.col("doc_id") % 3 == 0, None).otherwise((F.col("doc_id") % 10) / 10.0).alias("conf"), (F.col("quality") + 1).alias("cnt"))
    return j.select("doc_id", V.vote(F.col("risk"), F.col("conf"), 0.65, 0.3).alias("fires"), V.promoted(F.col("risk"), F.col("conf"), F.col("cnt")).alias("promoted"))


@query("with c as (select conv_id seq_key, turn updated_at, role run_tag, case when turn % 2 = 0 then 'A' end dataset, text from conversations) select seq_key, updated_at, run_tag, text from (select *, row_number() over (partition by seq_key order by case when run_tag = 'assistant' then 0 else 1 end, case when dataset = 'A' then 0 when dataset is null then 1 else 2 end, updated_at desc) n from c) where n = 1")
def cache_pick(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("seq_key"), F.col("turn").alias("updated_at"), F.col("role").alias("run_tag"), F.when(F.col("turn") % 2 == 0, "A").alias("dataset"), "text")
    return V.cache_pick(c, "assistant", "A").select("seq_key", "updated_at", "run_tag", "text")


@query("select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations) where n = 1")
def kb_upsert(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    return V.upsert(c.where("turn % 2 = 0"), c.where("turn % 2 <> 0"), ["conv_id"], "turn")


@query("select conv_id, string_agg(text, ' | ' order by turn) snippet from (select *, row_number() over (partition by conv_id order by turn) n from conversations) where n <= 3 group by conv_id")
def prompt_snippet(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    per = c.groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", "text"))), 1, 3).alias("q"))
    return per.select("conv_id", F.array_join(F.transform("q", lambda x: x["text"]), " | ").alias("snippet"))


@query(FIRED + " select session_id, label, cast(r0 or r1 or r2 as int) detected, concat_ws(',', case when r0 then 'r0' end, case when r1 then 'r1' end, case when r2 then 'r2' end) rules, concat_ws(',', case when r0 then '0>1' end, case when r1 then '1>2' end, case when r2 then '2>2' end) ngrams from f where r0 or r1 or r2")
def explain_sessions(spark, d):
    """The rules that fired and all n-grams of their clauses."""
    grams = {r.name: [">".join(map(str, c.rids)) for c in (*r.if_any, *r.if_all) if c.rids] for r in RULES}
    f = R.fires(_sessions(spark, d), RULES).where(F.size("fired") > 0)
    shown = F.array_join(F.array_compact(F.array(*[F.when(F.array_contains("fired", n), F.lit(",".join(g))) for n, g in grams.items() if g])), ",")
    return f.select("session_id", "label", F.lit(1).alias("detected"), F.array_join("fired", ",").alias("rules"), shown.alias("ngrams"))


@query(FIRED + ", l as (select unnest([struct_pack(leg := 'r0', v := r0::int), struct_pack(leg := 'r1', v := r1::int), struct_pack(leg := 'r2', v := r2::int)]) x, label from f) select x.leg leg, cast(sum(x.v * label) as bigint) tp, cast(sum(x.v * (1 - label)) as bigint) fp, cast(sum((1 - x.v) * label) as bigint) fn from l group by 1")
def rule_val_stats(spark, d):
    return V.leg_stats(_legs(spark, d), {f"r{i}": F.col(f"r{i}") for i in range(3)}).select("leg", "tp", "fp", "fn")


@query(FIRED + """, l as (select unnest([struct_pack(i := 0, w := 'or', v := (r0 or r1 or r2)::int), struct_pack(i := 1, w := 'and', v := (r0 and r1 and r2)::int), struct_pack(i := 2, w := 'vote2', v := (r0::int + r1::int + r2::int >= 2)::int)]) x, label from f),
 m as (select x.i i, x.w w, sum(x.v * label) tp, sum(x.v * (1 - label)) fp, sum((1 - x.v) * label) fn from l group by 1, 2), b as (select i, w, case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end f1 from m) select w strategy, round(f1, 9) f1 from b order by b.f1 desc, i limit 1""")
def fusion_tuning(spark, d):
    return V.best_strategy(_legs(spark, d), [F.col(f"r{i}") for i in range(3)]).withColumn("f1", F.round("f1", 9))


SEQ_GRAMS = SESS + """, q as (select session_id, label, event_seq[1] cid, list_transform(event_seq, lambda x: cast(x as varchar)) q from sess), g as (select session_id, label, cid, 2 n, q[i] || ' ' || q[i + 1] gram from q, unnest(range(1, len(q))) t(i)
 union all select session_id, label, cid, 3, q[i] || ' ' || q[i + 1] || ' ' || q[i + 2] from q, unnest(range(1, len(q) - 1)) t(i))"""


@query(SEQ_GRAMS + """, c as (select cid, n, gram, count(*) support from g where label = 1 group by cid, n, gram), r as (select *, row_number() over (partition by cid, n order by support desc, gram) k from c)
 select cid, n, gram, support from (select *, row_number() over (partition by n, gram order by cid) u from r where k <= case n when 2 then 8 else 5 end) where u = 1""")
def cluster_ngrams(spark, d):
    """Anomalous sessions, grouped by their first event as a surrogate for clusters."""
    return M.representative_grams(_sessions(spark, d).where("label = 1").withColumn("cid", F.get("event_seq", F.lit(0))), "cid", {2: 8, 3: 5})


@query(SEQ_GRAMS + """, o as (select n, gram from g group by n, gram having count(*) >= case n when 2 then 20 else 15 end), h as (select session_id, count(*) hits from g anti join o using (n, gram) group by session_id)
 select sess.session_id session_id, coalesce(hits, 0) hits, cast(coalesce(hits, 0) >= 2 and contains(etxt, 'error') as int) high from sess left join h on sess.session_id = h.session_id""")
def rare_gram_risk(spark, d):
    words = events(spark, d).groupBy(F.col("sk").alias("session_id")).agg(F.max(F.contains(F.col("eid"), F.lit("error"))).alias("bad"))
    return M.rare_grams(_sessions(spark, d), {2: 20, 3: 15}).join(words, "session_id").select("session_id", "hits", ((F.col("hits") >= 2) & F.col("bad")).cast("int").alias("high"))


@query("select lang, count(*) n, round(avg(case when l.doc_id is null then 0 else 1 end), 9) coverage from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id group by lang")
def judgment_coverage(spark, d):
    return V.coverage(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "lang").withColumn("coverage", F.round("coverage", 9))


def _driver_query(name: str, sql: str) -> None:
    """Plain relational shapes over the star schema: the same text runs on both engines."""

    def run(spark, d):
        for t in ("lineitem", "orders", "customer", "nation"):
            spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"loom_{t}")
        return spark.sql(sql.replace("{", "loom_").replace("}", ""))

    run.__name__ = name
    query(sql.replace("{", "").replace("}", ""))(run)


_driver_query("order_sequences", "select l_orderkey session_id, count(*) n_events, max(case when l_returnflag = 'R' then 1 else 0 end) returned from {lineitem} group by l_orderkey")
_driver_query("order_bigrams", "select gram, count(*) support from (select concat(l_returnflag, l_linestatus, ' ', lead(concat(l_returnflag, l_linestatus)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)) gram, lead(l_linenumber) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) more from {lineitem}) x where more is not null group by gram")


from . import knowledge_queries as _more  # noqa: E402, F401  registers its own beside these
