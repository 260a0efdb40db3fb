"""Queries of rules as data, their selection, fusion, judgments, clusters and explanations, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import catalog as C
from .operators import clusters as K
from .operators import explain as E
from .operators import fusion as U
from .operators import judgments as J
from .operators import models as B
from .operators import rules as R
from .operators import selection as L
from .operators import sequences as Q
from .operators import verdicts as V
from .queries import FIRED, GRAMS, LINES, RULES, SCORES, SESS, WINDOWS, _counts, _legs, _scores, _sessions, _text, knn_cosine, query
from .sources import kb as KB
from .sources.logs import events

WIN = WINDOWS.split(",\n seen")[0]


def _rows(spark, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- sequences


@query(LINES + " select eid event_id, cast(row_number() over (order by eid) - 1 as int) row_id from lines group by eid")
def sorted_dict(spark, d):
    return Q.templates(events(spark, d), by_name=True).select("event_id", "row_id")


@query(SESS + " select count(distinct x) n from (select unnest(event_seq) x from sess)")
def vocabulary_size(spark, d):
    return Q.vocabulary_size(_sessions(spark, d))


@query(SESS + ", m as (select session_id, label, event_seq, list_filter(event_seq, lambda x: x <> 1) q from sess where len(event_seq) >= 5) select session_id, cast(i as int) win_idx, array_to_string(list_slice(q, i + 1, i + 5), ' ') tokens, label from m, unnest(range(0, len(q) - 4)) t(i) where len(q) >= 5")
def masked_windows(spark, d):
    """Lengths are tested on the whole sequence, tokens come from the masked one."""
    return Q.windows(Q.masked(_sessions(spark, d), 1), 5, content_col="event_seq_masked").withColumn("tokens", _text("tokens"))


@query(WIN + """, r as (select *, row_number() over (partition by label order by md5(session_id || '#' || cast(win_idx as varchar) || '#43'), session_id, win_idx) / count(*) over (partition by label) share from win)
 select case when share <= 0.2 then 'test' when share <= 0.2 + 0.1 then 'val' else 'train' end split, label, count(*) n from r group by all""")
def window_split(spark, d):
    return Q.split_by_window(Q.windows(_sessions(spark, d), 5)).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(SESS + """, r as (select *, row_number() over (partition by label order by md5(session_id || '#43'), session_id) / count(*) over (partition by label) share from sess),
 s as (select *, case when share <= 0.2 then 'test' when share <= 0.2 + 0.1 then 'val' when share <= 0.2 + 0.1 + 0.5 then 'train' else 'dropped' end split from r)
 select split, count(*) sessions, cast(sum(label) as bigint) anomalies, cast(sum(len(event_seq)) as bigint) n_lines, round(100.0::double * sum(label) / count(*), 6) percent from s group by split""")
def split_shares(spark, d):
    return Q.split_stats(Q.split_by_group(_sessions(spark, d), train=0.5)).withColumn("percent", F.round("percent", 6))


@query(SESS + ", r as (select *, row_number() over (partition by label order by md5(session_id || '#43'), session_id) / count(*) over (partition by label) share from sess) select session_id, len(event_seq) n from r where share <= 0.2 and label = 1 and len(event_seq) > 0")
def test_anomalies(spark, d):
    s = _sessions(spark, d)
    return Q.usable(Q.in_split(s, Q.split_by_group(s), "test"), anomalies=True).select("session_id", F.size("event_seq").cast("long").alias("n"))


@query(SESS + ", t as (select session_id, unnest(list_append(event_seq, 99)) t, unnest(range(0, len(event_seq) + 1)) pos from sess) select session_id, cast(pos as int) pos, coalesce('<' || event_id || '>', '[T' || cast(t as varchar) || ']') as text from t left join dict on t = row_id")
def token_texts(spark, d):
    dictionary = Q.templates(events(spark, d)).withColumn("event_template", F.concat(F.lit("<"), "event_id", F.lit(">")))
    return Q.as_templates(_sessions(spark, d).withColumn("event_seq", F.array_append("event_seq", F.lit(99))), dictionary)


@query(SESS + " select session_id, trim(txt) seq from sess")
def coerced_sequences(spark, d):
    text = F.concat(F.lit("["), F.array_join(F.col("event_seq").cast("array<string>"), ", "), F.lit(', "none", 1.5]'))
    return _sessions(spark, d).select("session_id", F.array_join(Q.coerced(text).cast("array<string>"), " ").alias("seq"))


# ---------------------------------------------------------------- rules as data

MINED = GRAMS + """, dict as (select eid event_id, cast(row_number() over (order by min(line_id), eid) - 1 as int) row_id from lines group by eid),
 lifted as (select n, gram, ca, (ca + 1.0::double) / (cn + 1.0::double) lift from counts where ca >= 2 and (ca + 1.0::double) / (cn + 1.0::double) >= 1.3),
 picked as (select * from (select 'disc' source, 1 n, gram, ca, 0.95::double confidence from counts where n = 1 and ca >= 10 and cn <= 1 order by ca desc, cn, gram limit 200)
  union all select * from (select 'uni', n, gram, ca, 0.8::double from lifted where n = 1 order by lift desc, ca desc, gram limit 20)
  union all select * from (select 'gram', n, gram, ca, 0.8::double from lifted where n > 1 order by lift desc, ca desc, n, gram limit 500)),
 word as (select source, n, gram, confidence, unnest(string_split(gram, ' ')) eid, unnest(range(0, n)) pos from picked),
 rules as (select source, n, gram, confidence, string_agg(cast(row_id as varchar), ' ' order by pos) rids from word join dict on eid = event_id group by all),
 named as (select case source when 'disc' then 'disc_anom_' when 'uni' then 'uni_lift_' else 'ng' || cast(n as varchar) || '_lift_' end || replace(rids, ' ', '_') as name, case when source = 'gram' then 'ordered_subset' else 'min_count' end kind, rids, confidence from rules)"""


def _mined(spark, d):
    return C.mined(_counts(spark, d), Q.templates(events(spark, d)))


@query(MINED + " select name, kind, rids, confidence from named")
def mined_rules(spark, d):
    return _mined(spark, d).select("name", "kind", _text("rids").alias("rids"), "confidence")


@query(MINED + ", tx as (select sk session_id, max(anom) label, ' ' || string_agg(cast(row_id as varchar), ' ' order by ts_sec, line_id) || ' ' txt from lines join dict on eid = event_id group by sk) select session_id, label, count(name) n_fired, coalesce(string_agg(name, ',' order by name), '') fired from tx left join named on regexp_matches(txt, ' ' || replace(rids, ' ', ' (.* )?') || ' ') group by all")
def mined_rules_fire(spark, d):
    """All mined rules against all sessions, from the rule table."""
    out = C.fires_by_table(_sessions(spark, d), C.collected(_mined(spark, d)))
    return out.select("session_id", "label", F.size("fired").cast("long").alias("n_fired"), F.array_join(F.array_sort("fired"), ",").alias("fired"))


@query(FIRED + " select sess.session_id, cast(coalesce(r0 or r1 or r2, false) as int) pred from (select session_id from sess union all select 'nowhere') sess left join f on f.session_id = sess.session_id")
def rule_set_or(spark, d):
    s = _sessions(spark, d)
    keys = s.select("session_id").unionByName(_rows(spark, [("nowhere",)], "session_id string"))
    return C.any_fires(C.fires_by_table(s, RULES), keys)


# ---------------------------------------------------------------- selection

#: Validation rules of the queries: the presence of one event each.
SEEN = (3, 9, 14, 18, 22, 27)
MASKS = SESS + ", bits as (select label, " + " + ".join(f"{1 << i} * list_contains(event_seq, {r})::int" for i, r in enumerate(SEEN)) + """ b from sess),
 pat as (select label, b, count(*) c from bits group by all), mask as (select cast(unnest(range(0, 64)) as int) m),
 st as (select m, coalesce(sum(c) filter ((b & m) <> 0 and label = 1), 0) tp, coalesce(sum(c) filter ((b & m) <> 0 and label = 0), 0) fp, sum(c) filter (label = 1) n1, sum(c) filter (label = 0) n0 from mask, pat group by m),
 met as (select m, tp, tp + fp hits, case when tp + fp > 0 then tp / (tp + fp) else 0 end p, case when tp > 0 then 2.0::double * tp / (tp + fp + n1) else 0 end f1, (tp + fp) / (n1 + n0) fire, fp / n0 nfire from st),
 one as (select met.*, i from met, (select cast(unnest(range(0, 6)) as int) i) where m = 1 << i)"""


def _greedy_sql(name: str, among: str, cfg: L.Limits, min_f1: float, min_p: float, capped: bool) -> str:
    """CTEs that end in ``name`` (m): the greedy choice among the rules of a mask."""
    cap = f"met.nfire <= {cfg.max_normal}" if capped else "true"
    ok = f"met.fire <= {cfg.max_fire} and {cap} and (met.f1 > best + 1e-9 or (cnt = 0 and met.f1 >= {min_f1 * 0.5!r}))"
    return f""", {name}_r as (select *, row_number() over (order by p desc, f1 desc, i) k from one where (m & (select {among})) <> 0 and hits > 0 and (p >= {min_p!r} or tp > 0)),
 {name}_g(k, cur, best, cnt) as (select cast(0 as bigint), cast(0 as int), cast(-1 as double), cast(0 as int) union all
  select g.k + 1, case when {ok} then met.m else cur end, case when {ok} then met.f1 else best end, case when {ok} then cnt + 1 else cnt end from {name}_g g join {name}_r r on r.k = g.k + 1 join met on met.m = (g.cur | r.m)),
 {name} as (select case when cnt > 0 and best >= {min_f1!r} then cur else coalesce((select m from {name}_r where k = 1), 0) end m from {name}_g order by k desc limit 1)"""


def _filter_sql(name: str, cfg: L.Limits) -> str:
    fits = f"fire <= {cfg.max_fire} and f1 >= {cfg.min_f1} and p >= {cfg.min_precision}"
    capped = cfg.max_normal is not None
    return f""", {name}_good as (select coalesce(cast(sum(m) as int), 0) m from one where hits > 0 and fire <= {cfg.single_fire} and (p >= 0.9 or (f1 >= 0.5 and p >= 0.5)))""" + _greedy_sql(f"{name}_greedy", "63", cfg, cfg.min_f1, cfg.min_precision * 0.5, capped) + f""",
 {name} as (select case when (select {fits} from met where m = 63) then 63 when (select m from {name}_good) > 0 and (select {fits} from met where m = (select m from {name}_good)) then (select m from {name}_good) else (select m from {name}_greedy) end m)"""


def _validation(spark, d) -> tuple[L.Validation, list[str]]:
    rules = [R.Rule(f"seen_{r}", (R.Clause("min_count", row_id=r),)) for r in SEEN]
    names = [r.name for r in rules]
    return L.Validation(R.fires(_sessions(spark, d), rules), names), names


STRICT, LOOSE = L.limits(min_f1=0.6, min_precision=0.6, single_fire=0.2, max_fire=0.4), L.cluster_limits(single_fire=0.2)
KEPT = ", names as (select unnest([" + ", ".join(f"'seen_{r}'" for r in SEEN) + "]) rule, cast(unnest(range(0, 6)) as int) i) select rule from names where ((select m from kept) & (1 << i)) <> 0"


@query("with recursive " + MASKS + _filter_sql("kept", STRICT) + KEPT)
def rule_val_filter(spark, d):
    v, names = _validation(spark, d)
    return _rows(spark, [(n,) for n in L.filter_rules(v, names, STRICT)], "rule string")


_F1 = "coalesce((select f1 from met where met.m = x.m and x.m > 0), -1)"
CLUSTER_KEPT = (
    "with recursive " + MASKS + _filter_sql("v1", LOOSE) + _greedy_sql("half", "63", LOOSE, LOOSE.target_f1 * 0.5, LOOSE.min_precision * 0.5, True)
    + f""", hits as (select coalesce(cast(sum(m) as int), 0) m from one where tp > 0), a as (select m, {_F1} f1 from v1 x), h as (select m, {_F1} f1 from half x),
 picked as (select case when a.m > 0 and a.f1 >= {LOOSE.target_f1} then a.m when h.m > 0 and h.f1 >= a.f1 then h.m when a.m > 0 then a.m else (select m from hits) end m from a, h)"""
    + _greedy_sql("again", "m from picked", LOOSE, LOOSE.target_f1, LOOSE.min_precision, True)
    + f""", kept as (select case when met.f1 >= {LOOSE.target_f1} and met.p >= {LOOSE.min_precision} and met.nfire <= {LOOSE.max_normal} then met.m
  when x.m > 0 and (select f1 >= {LOOSE.target_f1 * 0.5} and p >= {LOOSE.min_precision * 0.5} and nfire <= {LOOSE.max_normal * 1.5} from met q where q.m = x.m) then x.m else 0 end m from picked join met on met.m = picked.m, again x)"""
    + KEPT
)


@query(CLUSTER_KEPT)
def cluster_rule_filter(spark, d):
    v, names = _validation(spark, d)
    return _rows(spark, [(n,) for n in L.filter_cluster_rules(v, names, cfg=LOOSE)], "rule string")


@query(FIRED + " select round(avg((r0 or r1)::int), 9) fire_rate, round(coalesce(avg((r0 or r1)::int) filter (label = 0), avg((r0 or r1)::int)), 9) normal_fire_rate from f")
def fire_rates(spark, d):
    out = V.fire_rates(_legs(spark, d).withColumn("pred", F.greatest("r0", "r1")))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


# ---------------------------------------------------------------- fusion

HYBRID = SCORES + """, b as (select session_id, max(p1) score from sc group by 1),
 legs as (select s.session_id session_id, label, coalesce(score, 0) score, cast(coalesce(score, 0) >= 0.3 as int) base, contains(txt, ' 0 1 ')::int ngram, contains(txt, ' 2 2 ')::int kb, cast(len(event_seq) % 3 = 0 as int) risk, case when len(event_seq) % 7 = 0 then null else (len(event_seq) % 11) / 10 end conf from sess s left join b on s.session_id = b.session_id)"""


def _hybrid(spark, d):
    s = _sessions(spark, d)
    per = _scores(spark, d).groupBy("session_id").agg(F.max("p1").alias("score"))
    q, n = F.col("event_seq"), F.size("event_seq")
    rows = s.join(per, "session_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    legs = [R.Clause("contains_ngram", rids=r).column(q).cast("int").alias(k) for k, r in (("ngram", (0, 1)), ("kb", (2, 2)))]
    return rows.select("session_id", "label", "score", (F.col("score") >= 0.3).cast("int").alias("base"), *legs, (n % 3 == 0).cast("int").alias("risk"), F.when(n % 7 != 0, (n % 11) / 10.0).alias("conf"))


@query(SCORES + ", s as (select session_id, max(label) label, max(p1) score from sc group by 1), g as (select i / 20 th, label, score >= i / 20 pred from s, unnest(range(1, 20)) t(i)), c as (select th, count(*) filter (pred and label = 1) tp, count(*) filter (pred and label = 0) fp, count(*) filter (not pred and label = 1) fn from g group by th) select th, round(case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 9) f1 from c order by case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end desc, th limit 1")
def threshold_pick(spark, d):
    s = _scores(spark, d).groupBy("session_id").agg(F.max("label").alias("label"), F.max("p1").alias("score"))
    return U.first_best(V.threshold_grid(s), "f1", "th").select("th", F.round("f1", 9).alias("f1"))


_GRID = ", ".join(f"struct_pack(i := {i * len(U.LOW) + j}, hi := {h}::double, lo := {x}::double)" for i, h in enumerate(U.HIGH) for j, x in enumerate(U.LOW))


@query(HYBRID + f", g as (select unnest([{_GRID}]) x), v as (select x.i i, x.hi hi, x.lo lo, label, (risk = 1 and coalesce(conf, 0.5) >= x.hi) or (risk = 0 and coalesce(conf, 0.5) < x.lo) v from legs, g), m as (select i, hi, lo, count(*) filter (v and label = 1) tp, count(*) filter (v and label = 0) fp, count(*) filter (not v and label = 1) fn from v group by all), f as (select *, case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end f1 from m) select hi, lo low, round(f1, 9) f1 from f order by f.f1 desc, i limit 1")
def vote_tuning(spark, d):
    return U.first_best(U.tune_two_sided(_hybrid(spark, d)), "f1", "idx").select("hi", "low", F.round("f1", 9).alias("f1"))


TUNED = HYBRID + """, vo as (select l.*, c, case when risk = 1 and coalesce(conf, 0.5) >= c then 1 else 0 end v from legs l, (select unnest([0.5, 0.6, 0.7, 0.8, 0.9]::double[]) c)),
 g as (select *, least(v, greatest(ngram, kb)) llm from vo), k as (select c, (avg(llm) filter (label = 0) <= 0.35)::int k1, (avg(ngram) filter (label = 0) <= 0.35)::int k2, (avg(kb) filter (label = 0) <= 0.35)::int k3 from g group by c),
 s as (select g.c c, label, base, ngram, kb, base + k1 * llm + k2 * ngram + k3 * kb s, 1 + k1 + k2 + k3 n from g join k on g.c = k.c),
 st as (select c, label, unnest([struct_pack(i := 0, w := 'or', ok := true, p := s >= 1), struct_pack(i := 1, w := 'and', ok := true, p := s >= n), struct_pack(i := 2, w := 'vote2', ok := n >= 2, p := s >= 2), struct_pack(i := 3, w := 'vote3', ok := n >= 3, p := s >= 3), struct_pack(i := 4, w := 'vote4', ok := n >= 4, p := s >= 4), struct_pack(i := 5, w := 'base+ngram_or', ok := true, p := base + ngram >= 1)]) x from s),
 m as (select c, x.i i, x.w w, count(*) filter (x.p and label = 1) tp, count(*) filter (x.p and label = 0) fp, count(*) filter (not x.p and label = 1) fn from st where x.ok group by all),
 f as (select *, case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end f1 from m), best as (select *, row_number() over (partition by c order by f1 desc, i) r from f),
 top as (select c, w, f1 from best where r = 1 order by f1 desc, c desc limit 1),
 pl as (select label, unnest([struct_pack(i := 0, w := 'base_only', p := base = 1), struct_pack(i := 1, w := 'base+ngram_or', p := base + ngram >= 1), struct_pack(i := 2, w := 'base+kb_or', p := base + kb >= 1), struct_pack(i := 3, w := 'base+ngram+kb_or', p := base + ngram + kb >= 1)]) x from legs),
 pm as (select x.i i, x.w w, count(*) filter (x.p and label = 1) tp, count(*) filter (x.p and label = 0) fp, count(*) filter (not x.p and label = 1) fn from pl group by all),
 pf as (select i, w, case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end f1 from pm)"""


@query(TUNED + " select case when top.f1 < pf.f1 - 1e-9 then 0.5 else c end conf, case when top.f1 < pf.f1 - 1e-9 then 'base_only' else top.w end strategy, round(case when top.f1 < pf.f1 - 1e-9 then pf.f1 else top.f1 end, 9) f1 from top, pf where i = 0")
def hybrid_tuning(spark, d):
    conf, name, f1 = U.tune(U.Profiles.of(_hybrid(spark, d)))
    return _rows(spark, [(conf, name, round(f1, 9))], "conf double, strategy string, f1 double")


@query(TUNED + ", tries as (select i, w, f1, 0.5::double c from pf union all select 9, w, f1, c from top) select w strategy, c conf, round(f1, 9) f1 from tries order by tries.f1 desc, i limit 1")
def final_pick(spark, d):
    name, conf, f1 = U.pick(U.Profiles.of(_hybrid(spark, d)))
    return _rows(spark, [(name, conf, round(f1, 9))], "strategy string, conf double, f1 double")


def _ablation_sql() -> str:
    runs = {"full": (1, 1, 1), "no_llm": (0, 1, 1), "no_ngram": (1, 0, 1), "no_cluster": (1, 1, 0)}
    parts = []
    for name, (llm, ngram, kb) in runs.items():
        judged = "0" if not llm else "least(v, greatest(ngram, kb))" if ngram and kb else "v"
        parts.append(f"select '{name}' run, label, base, {judged} l, {'ngram' if ngram else '0'} r, {'kb' if kb else '0'} q, {kb} has from v6")
    return HYBRID + f""", v6 as (select *, case when risk = 1 and coalesce(conf, 0.5) >= 0.6 then 1 else 0 end v from legs), x as ({' union all '.join(parts)}),
 k as (select run, (avg(l) filter (label = 0) <= 0.35)::int k1, (avg(r) filter (label = 0) <= 0.35)::int k2, (avg(q) filter (label = 0) <= 0.35)::int * any_value(has) k3 from x group by run),
 n as (select *, 1 + k1 + k2 + k3 n, (select 1 + k1 + k2 + k3 from k where run = 'full') nf from k), t as (select *, case when nf - n > 0 and 2 >= nf - 1 then greatest(1, least(n, 2 - (nf - n))) else greatest(1, least(2, n)) end need from n),
 m as (select x.run run, count(*) filter (p and label = 1) tp, count(*) filter (p and label = 0) fp, count(*) filter (not p and label = 1) fn from (select x.run, label, base + k1 * l + k2 * r + k3 * q >= need p from x join t on x.run = t.run) x group by x.run)
 select run, round(case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 9) f1 from m"""


@query(_ablation_sql())
def ablations(spark, d):
    rows = U.ablations(U.Profiles.of(_hybrid(spark, d)), 0.6, "vote2")
    return _rows(spark, [(n, round(x, 9)) for n, x in rows], "run string, f1 double")


@query(HYBRID + " select session_id, greatest(base, ngram) simple, cast(base + least(case when risk = 1 and coalesce(conf, 0.5) >= 0.5 then 1 else 0 end, greatest(ngram, kb)) + ngram + kb >= 2 as int) votes, case when score <= 0.05 or score >= 0.95 then base else greatest(base, ngram, kb) end gated, ngram alone from legs")
def named_fusions(spark, d):
    h = _hybrid(spark, d)
    base, ngram, kb = F.col("base"), F.col("ngram"), F.col("kb")
    llm = U.judged(F.col("risk"), F.col("conf"), 0.5, ngram, kb)
    gated = U.confident(F.col("score"), base, U.verdict("base+ngram+kb_or", base, llm, ngram, kb))
    return h.select("session_id", U.verdict("base+ngram_or", base, llm, ngram, kb).alias("simple"), U.verdict("vote2", base, llm, ngram, kb).alias("votes"), gated.alias("gated"), U.shortcut(base, ngram, "ngram_only").alias("alone"))


# ---------------------------------------------------------------- judgments

_WORDS = "[" + ", ".join(f"'{w}'" for w in J.WORDS) + "]"
SCORER = f"low as (select *, lower(coalesce(text, '')) low from {{}}), sco as (select *, {' + '.join(f'regexp_matches(low, {p!r})::int' for p in J.PHRASES)} np, list_filter(regexp_split_to_array(low, '[^a-z]+'), lambda x: list_contains({_WORDS}, x)) found from low), sc2 as (select *, len(found) nw, list_contains(found, 'error') or list_contains(found, 'exception') alone from sco)"


@query("with " + SCORER.format("(select conv_id, turn, text || case when conv_id % 3 = 0 then ' Connection timed out, retry failed' when conv_id % 3 = 1 then ' Exception' else '' end as text from conversations)") + " select conv_id, turn, cast(np + nw >= 2 or alone as int) is_high_risk, np + nw count, 'Heuristic: ' || coalesce(nullif(concat_ws(', ', case when np > 0 then np || ' phrase hit(s)' end, case when nw > 0 then nw || ' keyword hit(s)' end, case when alone and np + nw < 2 then 'strong singleton (exception/error)' end), ''), 'no failure terms') rationale from sc2")
def risk_scorer(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    more = F.when(F.col("conv_id") % 3 == 0, " Connection timed out, retry failed").when(F.col("conv_id") % 3 == 1, " Exception").otherwise("")
    return c.select("conv_id", "turn", *[x.alias(n) for n, x in J.risk(F.concat("text", more)).items()]).withColumn("count", F.col("count").cast("long"))


@query(LINES + ", fr as (select eid from lines where anom = 0 group by eid having count(*) >= 50), h as (select sk, cast(sum(case when eid like 'error%' and eid not in (select eid from fr) then 1 else 0 end) as bigint) n from lines group by sk) select sk session_id, n count, cast(n >= 2 as int) is_high_risk from h")
def sentiment_miner(spark, d):
    lines = events(spark, d).select(F.col("sk").alias("session_id"), F.col("anom").alias("label"), F.col("eid").alias("template"))
    return J.sentiment(lines, J.lexicon_negative(lines)).withColumn("count", F.col("count").cast("long"))


_ASK = J.ASK.replace("{dataset}", "HDFS").replace("'", "''")


@query("with s as (select cast(conv_id as varchar) seq_key, string_agg(text, ' | ' order by turn) snippet from (select *, row_number() over (partition by conv_id order by turn) n from conversations) where n <= 2 group by conv_id union all select 'none', '(empty)') select seq_key, snippet, md5(replace(replace('" + _ASK + "', '{seq_key}', seq_key), '{snippet}', snippet)) prompt_md5 from s")
def session_prompts(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    per = c.groupBy(F.col("conv_id").cast("string").alias("seq_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    items = J.prompt_items(per.unionByName(_rows(spark, [("none", [])], "seq_key string, parts array<string>")), "HDFS", 2)
    return items.select("seq_key", "snippet", F.md5("prompt").alias("prompt_md5"))


_CACHE = "cache as (select cast(conv_id as varchar) seq_key, case when turn % 2 = 0 then 'now' else 'old' end run_tag, 'A' dataset, case when conv_id % 5 = 0 then ' ' else text end rationale, cast(turn as double) updated_at from conversations where conv_id % 3 > 0 and turn < conv_id % 4)"


def _cache(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("conv_id % 3 > 0 and turn < conv_id % 4")
    return c.select(F.col("conv_id").cast("string").alias("seq_key"), F.when(F.col("turn") % 2 == 0, "now").otherwise("old").alias("run_tag"), F.lit("A").alias("dataset"), F.when(F.col("conv_id") % 5 == 0, " ").otherwise(F.col("text")).alias("rationale"), F.col("turn").cast("double").alias("updated_at"))


@query("with i as (select distinct cast(conv_id as varchar) seq_key from conversations), " + _CACHE + ", b as (select * from (select *, row_number() over (partition by seq_key order by case when run_tag = 'now' then 0 else 1 end, updated_at desc) n from cache where trim(rationale) <> '') where n = 1) select i.seq_key seq_key, case when b.seq_key is null then 'miss' when run_tag = 'now' then 'hit' else 'copy' end state, updated_at from i left join b on i.seq_key = b.seq_key")
def judge_cache(spark, d):
    items = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("seq_key")).distinct()
    return J.split_by_cache(items, _cache(spark, d), "now", "A").select("seq_key", "state", "found.updated_at")


@query("with l as (select cast(doc_id as varchar) seq_key, case when doc_id % 9 = 0 then null else toxic end risk, quality + 1 cnt, (doc_id % 10) / 10 conf from labels where doc_id % 7 <> 0) select seq_key, case when coalesce(risk, 0) = 1 then 1 when conf >= 0.85 and cnt >= 2 then 1 else 0 end is_high_risk, cnt count, conf confidence, '[\"a\"]' core_events from l where seq_key not like '%3'")
def judgments_ingest(spark, d):
    l = spark.read.parquet(f"{d}/labels.parquet").where("doc_id % 7 <> 0")  # noqa: E741
    key = F.col("doc_id").cast("string")
    body = F.struct(key.alias("seq_key"), F.when(F.col("doc_id") % 9 != 0, F.col("toxic").cast("string")).alias("is_high_risk"), F.when(key.endswith("3"), F.lit("many")).otherwise((F.col("quality") + 1).cast("string")).alias("count"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"), F.lit("a").alias("core_events"))
    return J.ingested(l.select(F.to_json(body).alias("result")), "HDFS", "now").select("seq_key", "is_high_risk", "count", "confidence", "core_events")


def _rule_rows(spark, d):
    x = F.col("doc_id")
    return spark.read.parquet(f"{d}/labels.parquet").select(F.concat(F.lit("r"), x.cast("string")).alias("rule_id"), F.when(x % 2 == 0, "llm_cluster").otherwise("mined").alias("source"), F.when(x % 3 == 0, "A").otherwise("B").alias("dataset"), F.lit("m").alias("model"), F.lit("v").alias("vocab_from"), F.when(x % 11 == 0, "global").otherwise("dataset").alias("scope"), (x % 13).cast("double").alias("created_at"), (x % 5 > 0).cast("int").alias("is_active"), F.when(x % 4 == 0, "old").otherwise("now").alias("run_tag"))


@query("select 'r' || cast(doc_id as varchar) rule_id, cast(doc_id % 13 as double) created_at from labels where doc_id % 5 > 0 and doc_id % 4 <> 0 and doc_id % 2 = 0 and (doc_id % 3 = 0 or doc_id % 11 = 0) order by created_at desc, rule_id limit 20")
def kb_active_rules(spark, d):
    return KB.active_rules(_rule_rows(spark, d), "A", "m", "v", "now", ["llm_cluster"], True, 20).select("rule_id", "created_at")


@query("select cast(doc_id as varchar) pattern_key, case when doc_id % 2 = 0 then toxic else quality end status, doc_id % 2 = 0 cached from labels")
def judgment_memo(spark, d):
    l = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("pattern_key"), F.lit("ngram").alias("pattern_type"), "quality", "toxic", "doc_id")  # noqa: E741
    memo = l.where("doc_id % 2 = 0").select("pattern_key", "pattern_type", F.col("toxic").alias("status"), F.lit("known").alias("explanation"), F.lit(1.0).alias("updated_at"))
    return J.with_memo(l, memo, F.col("quality"), F.lit("asked")).select("pattern_key", "status", "cached")


@query("with l as (select case when doc_id % 3 = 0 then 'A' else 'B' end dataset, toxic from labels) select dataset, 'now' run_tag, cast(sum(toxic) as bigint) high, count(*) n from l group by dataset")
def judgment_rate(spark, d):
    l = spark.read.parquet(f"{d}/labels.parquet")  # noqa: E741
    return J.rate(l.select(F.when(F.col("doc_id") % 3 == 0, "A").otherwise("B").alias("dataset"), F.lit("now").alias("run_tag"), F.col("toxic").alias("is_high_risk")))


@query("select cast(doc_id as varchar) seq_key, toxic is_high_risk, case when doc_id % 6 = 0 then 0 else (doc_id % 10) / 10 end confidence from labels where doc_id % 4 <> 0 and case when doc_id % 6 = 0 then 0 else (doc_id % 10) / 10 end >= 0.4")
def judgment_labels(spark, d):
    x = F.col("doc_id")
    j = spark.read.parquet(f"{d}/labels.parquet").select(F.concat(F.lit(" "), x.cast("string")).alias("seq_key"), F.lit("A").alias("dataset"), F.when(x % 4 == 0, "old").otherwise("now").alias("run_tag"), F.col("toxic").alias("is_high_risk"), F.when(x % 6 != 0, (x % 10) / 10.0).alias("confidence"))
    return J.labels(j, "A", "now", 0.4)


@query(GRAMS + ", u as (select gram event_id, ca, cn from counts where n = 1) select event_id, 'anomalous' status, ca support, ca cnt_anom, cn cnt_norm from u where ca > 0 and cn <= 1 union all select 'never', 'anomalous', 1, 0, 0")
def discrete_patterns(spark, d):
    u = _counts(spark, d, 1).select(F.col("gram").alias("event_id"), "ca", "cn")
    found = u.where("ca > 0 and cn <= 1").select("event_id", F.lit("anomalous").alias("status"), F.col("ca").alias("support"))
    long = u.select("event_id", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("ca").alias("cnt")), F.struct(F.lit(0).alias("label"), F.col("cn").alias("cnt")))).alias("x")).select("event_id", "x.*")
    return KB.discrete_view(found.unionByName(_rows(spark, [("never", "anomalous", 1)], "event_id string, status string, support long")), long)


# ---------------------------------------------------------------- clusters

NEAR = "q as (select vec_id query_id, embedding e from embeddings where vec_id % 50 = 0), nn as (select query_id, vec_id, list_cosine_similarity(e::double[], embedding::double[]) s from q, embeddings where vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by s desc, vec_id) rank from nn)"


@query("with " + NEAR + ", v as (select query_id, 'rule_' || cast(label % 4 as varchar) rule, count(*) votes from r join embeddings e on e.vec_id = r.vec_id where rank <= 5 group by all), t as (select *, row_number() over (partition by query_id order by votes desc, rule) n from v) select query_id, rule, votes, cast(n as int) rank from t where n <= 3")
def neighbor_vote(spark, d):
    rules = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.concat(F.lit("rule_"), (F.col("label") % 4).cast("string")).alias("rule"))
    return K.neighbour_rules(knn_cosine(spark, d).select("query_id", F.col("vec_id").alias("key")), rules)


MEMBERS = SESS + """, mem as (select session_id, event_seq[1] % 3 cluster, len(event_seq) / 100 strength from sess where label = 1),
 o as (select session_id, unnest(event_seq) term from sess where label = 1), tf as (select session_id, term, count(*) tf from o group by all), df as (select term, count(*) df from tf group by 1),
 w0 as (select session_id, tf.term term, tf * (ln((1 + (select count(distinct session_id) from tf)) / (1 + df)) + 1) w from tf join df on tf.term = df.term), w as (select session_id, term, w / sqrt(sum(w * w) over (partition by session_id)) v from w0),
 cen as (select cluster, session_id center from (select *, row_number() over (partition by cluster order by strength desc, session_id) n from mem) where n = 1),
 dots as (select m.cluster cluster, m.session_id session_id, sum(a.v * b.v) dot from mem m join cen c on m.cluster = c.cluster join w a on a.session_id = m.session_id join w b on b.session_id = c.center and b.term = a.term group by all),
 far as (select m.cluster cluster, m.session_id session_id, center, row_number() over (partition by m.cluster order by round(1 - coalesce(dot, 0), 9) desc, m.session_id) n, count(*) over (partition by m.cluster) size from mem m join cen c on m.cluster = c.cluster left join dots d on d.cluster = m.cluster and d.session_id = m.session_id),
 reps as (select cluster, any_value(size) size, any_value(center) center, coalesce(max(case when n = 1 and size > 1 then session_id end), any_value(center)) end_a, coalesce(max(case when n = 2 then session_id end), any_value(center)) end_b from far group by cluster),
 ex as (select cluster, pos, m.session_id session_id, label, list_slice(event_seq, 1, 20) event_seq from (select *, row_number() over (partition by cluster order by session_id) pos from mem) m join sess s on s.session_id = m.session_id where pos <= 50)"""


def _members(spark, d):
    s = _sessions(spark, d).where("label = 1")
    members = s.select("session_id", (F.get("event_seq", F.lit(0)) % 3).alias("cluster"), (F.size("event_seq") / 100.0).alias("strength"))
    return s, members, V.tfidf(s.select("session_id", F.explode("event_seq").alias("term")))


@query(MEMBERS + " select cluster, size, center, end_a, end_b from reps")
def cluster_representatives(spark, d):
    _, members, weights = _members(spark, d)
    return K.representatives(members, weights)


@query(MEMBERS + " select cluster, cast(pos as int) pos, session_id, label, array_to_string(event_seq, ' ') seq from ex")
def cluster_examples(spark, d):
    s, members, _ = _members(spark, d)
    return K.examples(members, s).select("cluster", "pos", "session_id", "label", _text("event_seq").alias("seq"))


@query(MEMBERS + """, seqs as (select cluster, cast(a as bigint) pl, event_seq q from (select cluster, unnest([center, end_a, end_b]) session_id, unnest([0, 1, 2]) a from reps) r join sess s on s.session_id = r.session_id union all select cluster, pos + 2, event_seq from ex where pos <= 15),
 g as (select cluster, 2 n, pl, i place, cast(q[i] as varchar) || ' ' || cast(q[i + 1] as varchar) gram from seqs, unnest(range(1, len(q))) t(i) union all select cluster, 3, pl, i, cast(q[i] as varchar) || ' ' || cast(q[i + 1] as varchar) || ' ' || cast(q[i + 2] as varchar) from seqs, unnest(range(1, len(q) - 1)) t(i)),
 c as (select cluster, n, gram, count(*) support, min(pl * 1000000 + place) seen from g group by all), k as (select *, row_number() over (partition by cluster, n order by support desc, seen) rank from c)
 select cluster, n, gram, support, cast(rank as int) rank from (select *, row_number() over (partition by n, gram order by cluster) u from k where rank <= case n when 2 then 8 else 5 end) where u = 1""")
def cluster_repr_ngrams(spark, d):
    s, members, weights = _members(spark, d)
    return K.representative_grams(K.representatives(members, weights), K.examples(members, s), s)


@query()
def density_clusters(spark, d):
    """Density clusters of the anomalous sessions of the training split; no SQL expresses them."""
    s = _sessions(spark, d)
    some = Q.usable(Q.in_split(s, Q.split_by_group(s), "train"), anomalies=True)
    return K.assigned(V.tfidf(K.terms(some)), size=5)


@query()
def backbone_scores(spark, d):
    """Window scores of a trained classifier; no SQL expresses them."""
    w = Q.windows(_sessions(spark, d), 5)
    return B.scored(w, B.train(w, "loganomaly", epochs=10), "loganomaly")


# ---------------------------------------------------------------- explanations

_NAME = lambda i: f"(select event_id from dict where row_id = {i})"
_TOLD = FIRED + f""", t as (select session_id, label, list_filter([case when r0 then 'r0' end, case when r1 then 'r1' end, case when r2 then 'r2' end], lambda x: x is not null) rules,
 list_filter([case when r0 then {_NAME(0)} || '→' || {_NAME(1)} end, case when r1 then {_NAME(1)} || '→' || {_NAME(2)} end, case when r2 then {_NAME(2)} || '→' || {_NAME(2)} end], lambda x: x is not null) ngrams, case when r1 then '7' when r2 then '8' end cluster_reference from f)"""


def _names(spark, d) -> dict[int, str]:
    """Names of the events that the rules speak of."""
    want = sorted({i for r in RULES for c in (*r.if_any, *r.if_all) for i in c.rids})
    return {r["row_id"]: r["event_id"] for r in Q.templates(events(spark, d)).where(F.col("row_id").isin(want)).collect()}


def _explained(spark, d):
    return E.explained(R.fires(_sessions(spark, d), RULES), RULES, _names(spark, d), {"r1": "7", "r2": "8"})


@query(_TOLD + " select session_id, label, array_to_string(rules, ',') rules, array_to_string(ngrams, ',') ngrams, cluster_reference from t")
def session_explanations(spark, d):
    return _explained(spark, d).select("session_id", "label", F.array_join("triggered_rules", ",").alias("rules"), F.array_join("triggered_ngrams", ",").alias("ngrams"), "cluster_reference")


@query(_TOLD + ", e as (select sk, string_agg(eid, ' ' order by ts_sec, line_id) event_ids, string_agg(eid, ' [SEP] ' order by ts_sec, line_id) filter (n <= 40) preview from (select *, row_number() over (partition by sk order by ts_sec, line_id) n from lines) group by sk) select session_id, label true_label, cast(len(rules) > 0 as int) detected, event_ids, preview, array_to_string(rules, ',') rules from t join e on sk = session_id")
def explained_batch(spark, d):
    s = _sessions(spark, d)
    found = R.fires(s, RULES)
    out = E.enriched(_explained(spark, d), s, Q.templates(events(spark, d)), found.select("session_id", (F.size("fired") > 0).cast("int").alias("detected")))
    return out.select("session_id", "true_label", "detected", F.array_join("event_ids", " ").alias("event_ids"), "preview", F.array_join("triggered_rules", ",").alias("rules"))

