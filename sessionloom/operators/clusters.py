"""Clusters of anomalous sessions: vectors, density clustering, representatives, bundles, and the rules they give.

Density clustering compares all pairs of vectors, so it runs on distinct vectors of the anomalous training sessions, up
to ``MOST`` of them (a matrix of that size is what it holds); beyond, bisecting k-means in Spark takes its place.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mining import seq_ngrams
from .rules import Clause, Rule

MOST, EXAMPLES, SHOWN = 4096, 50, 20


def terms(s: DataFrame, way: str = "tfidf-eid") -> DataFrame:
    """(session_id, term) occurrences: row ids as they are; or ``tfidf-template``: row ids of two characters or more and
    their bigrams, as the words of a text are read."""
    q = F.col("event_seq").cast("array<string>")
    if way != "tfidf-template":
        return s.select("session_id", F.explode(q).alias("term"))
    words = F.filter(q, lambda x: F.length(x) >= 2)
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    return s.select("session_id", F.explode(F.concat(words, F.filter(pairs, lambda p: F.contains(p, F.lit(" "))))).alias("term"))


def top_terms(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """Occurrences of the most frequent terms only; of equals the first in order."""
    keep = rows.groupBy("term").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "term").limit(most).select("term")
    return rows.join(keep, "term", "left_semi")


def dense(weights: DataFrame, value: str = "tfidf") -> tuple[list[str], np.ndarray]:
    """Session ids in order and their vectors, of (session_id, term, value)."""
    got = weights.select("session_id", "term", value).toPandas()
    ids, terms_ = sorted(got["session_id"].unique()), sorted(got["term"].unique())
    row, col = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(terms_)}
    out = np.zeros((len(ids), len(terms_)))
    out[got["session_id"].map(row).to_numpy(int), got["term"].map(col).to_numpy(int)] = got[value].to_numpy(float)
    return ids, out


# ---------------------------------------------------------------- density clustering


def _distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)
    return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))


def _tree(reach: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of a minimum spanning tree by ascending weight (Prim's algorithm)."""
    n = len(reach)
    best, src, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    at, out = 0, np.zeros((max(0, n - 1), 3))
    for k in range(n - 1):
        done[at] = True
        closer = ~done & (reach[at] < best)
        best[closer], src[closer] = reach[at][closer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        out[k] = src[at], at, best[at]
    return out[np.argsort(out[:, 2], kind="stable")]


def density_clusters(x: np.ndarray, size: int = 30, samples: int | None = None, cosine: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(label, strength) of each row: hierarchical density clusters of at least ``size`` rows chosen by excess of mass,
    -1 for noise. ``samples`` is the number of neighbours (itself included) that a row's density is taken from."""
    n = len(x)
    none = np.full(n, -1), np.zeros(n)
    if n < max(2, size):
        return none
    x = np.asarray(x, float)
    if cosine:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    d = _distances(x)
    k = min(n, max(1, samples or size))
    core = np.partition(d, k - 1, axis=1)[:, k - 1]
    tree = _tree(np.maximum(np.maximum(core[:, None], core[None, :]), d))
    # single linkage: node n + i joins two nodes at distance w
    up, members, left, right, height = list(range(n)), [1] * n, [], [], []
    node = list(range(n))

    def root(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b, w in tree:
        a, b = root(int(a)), root(int(b))
        left.append(node[a])
        right.append(node[b])
        height.append(w)
        members.append(members[node[a]] + members[node[b]])
        up[b] = a
        node[a] = n + len(left) - 1
    # condensed tree: a split counts if both sides have ``size`` rows, else the small side falls out of its cluster
    birth, parent, falls = [0.0], [-1], [[]]  # of clusters: lambda of birth, parent, (row, lambda) that fall out
    stack = [(2 * n - 2, 0)]
    while stack:
        at, c = stack.pop()
        if at < n:
            falls[c].append((at, np.inf))
            continue
        lam = 1 / height[at - n] if height[at - n] > 0 else np.inf
        sides = [left[at - n], right[at - n]]
        big = [s for s in sides if members[s] >= size]
        if len(big) == 2:
            for s in sides:
                birth.append(lam)
                parent.append(c)
                falls.append([])
                stack.append((s, len(birth) - 1))
            continue
        for s in sides:
            if s in big:
                stack.append((s, c))
            else:
                todo = [s]
                while todo:
                    t = todo.pop()
                    if t < n:
                        falls[c].append((t, lam))
                    else:
                        todo += [left[t - n], right[t - n]]
    m = len(birth)
    cap = 1e12
    clipped = lambda v: min(v, cap)
    rows_below = [len(f) for f in falls]
    for c in range(m - 1, 0, -1):
        rows_below[parent[c]] += rows_below[c]
    stable = np.array([sum(clipped(lam) - clipped(birth[c]) for _, lam in falls[c]) for c in range(m)])
    for c in range(1, m):
        stable[parent[c]] += rows_below[c] * (clipped(birth[c]) - clipped(birth[parent[c]]))
    children: list[list[int]] = [[] for _ in range(m)]
    for c in range(1, m):
        children[parent[c]].append(c)
    chosen, value = np.zeros(m, bool), stable.copy()
    for c in range(m - 1, 0, -1):
        below = sum(value[k] for k in children[c])
        if children[c] and below > stable[c]:
            value[c] = below
        else:
            chosen[c] = True
    label, strength = none
    names = 0
    for c in range(1, m):
        above = parent[c]
        while above > 0 and not chosen[above]:
            above = parent[above]
        if not chosen[c] or above > 0:
            continue
        todo, rows = [c], []
        while todo:
            t = todo.pop()
            rows += falls[t]
            todo += children[t]
        most = max((lam for _, lam in rows if np.isfinite(lam)), default=0.0)
        for r, lam in rows:
            label[r], strength[r] = names, 1.0 if not np.isfinite(lam) or most == 0 else lam / most
        names += 1
    return label, strength


def with_retries(x: np.ndarray, size: int = 10, samples: int | None = None, cosine: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Density clusters; if there are none, again with smaller sizes, at last one cluster of all."""
    for s in (size, *(k for k in (5, 3, 2) if k < size)):
        label, strength = density_clusters(x, s, samples, cosine)
        if (label >= 0).any():
            return label, strength
    return np.zeros(len(x), int), np.ones(len(x))


def assigned(weights: DataFrame, size: int = 10, samples: int | None = None, most: int = MOST) -> DataFrame:
    """session_id, cluster, strength of sessions by their vectors (session_id, term, tfidf)."""
    spark: SparkSession = weights.sparkSession
    ids = weights.select("session_id").distinct()
    n = ids.count()
    if n == 0:
        return spark.createDataFrame([], "session_id string, cluster int, strength double")
    if n <= most:
        names, x = dense(weights)
        label, strength = with_retries(x, size, samples)
        return spark.createDataFrame(list(zip(names, label.tolist(), strength.tolist(), strict=True)), "session_id string, cluster int, strength double")
    # weights summed in 256 hash cells of the terms
    per = weights.groupBy("session_id", F.pmod(F.xxhash64("term"), F.lit(256)).alias("cell")).agg(F.sum("tfidf").alias("v"))
    named = per.groupBy("session_id").pivot("cell", list(range(256))).agg(F.first("v")).na.fill(0.0)
    rows = VectorAssembler(inputCols=[str(i) for i in range(256)], outputCol="features").transform(named).select("session_id", "features")
    k = max(2, min(64, n // max(size, 1)))
    model = BisectingKMeans(k=k, minDivisibleClusterSize=float(size), seed=43).fit(rows)
    return model.transform(rows).select("session_id", F.col("prediction").alias("cluster"), F.lit(1.0).alias("strength"))


def representatives(members: DataFrame, weights: DataFrame) -> DataFrame:
    """cluster, size, center, end_a, end_b: the member of most strength, and the two farthest from it by cosine distance
    (of equals the first by id; a lone member is all three). ``members``: session_id, cluster, strength; ``weights`` are
    of length one."""
    m = members.where("cluster >= 0")
    top = Window.partitionBy("cluster").orderBy(F.desc("strength"), "session_id")
    center = m.withColumn("_n", F.row_number().over(top)).where("_n = 1").select("cluster", F.col("session_id").alias("center"))
    w = weights.select("session_id", "term", F.col("tfidf").alias("v"))
    mine = m.select("session_id", "cluster").join(center, "cluster")
    of_center = center.join(w, F.col("center") == F.col("session_id")).select("cluster", "term", F.col("v").alias("cv"))
    dots = mine.join(w, "session_id").join(of_center, ["cluster", "term"]).groupBy("cluster", "session_id").agg(F.sum(F.col("v") * F.col("cv")).alias("dot"))
    far = mine.join(dots, ["cluster", "session_id"], "left").withColumn("distance", F.round(1 - F.coalesce("dot", F.lit(0.0)), 9))
    order = Window.partitionBy("cluster").orderBy(F.desc("distance"), "session_id")
    two = far.withColumn("_n", F.row_number().over(order)).groupBy("cluster", "center").agg(F.count("*").alias("size"), F.max(F.when(F.col("_n") == 1, F.col("session_id"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.col("session_id"))).alias("b"))
    lone = F.col("size") < 2
    return two.select("cluster", "size", "center", F.when(lone, F.col("center")).otherwise(F.col("a")).alias("end_a"), F.when(lone, F.col("center")).otherwise(F.col("b")).alias("end_b"))


def examples(members: DataFrame, sessions: DataFrame, most: int = EXAMPLES, shown: int = SHOWN) -> DataFrame:
    """cluster, pos, session_id, label, event_seq (its first events) of the first members of each cluster by id."""
    order = Window.partitionBy("cluster").orderBy("session_id")
    first = members.where("cluster >= 0").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most)
    return first.join(sessions, "session_id").select("cluster", "pos", "session_id", "label", F.slice("event_seq", 1, shown).alias("event_seq"))


def bundle(members: DataFrame, reps: DataFrame, shown: DataFrame, dictionary: DataFrame) -> dict:
    """The nested form for prompts: meta, template_map, clusters with size, representatives and examples. Bounded by the
    number of clusters and of templates."""
    about = members.agg(F.count("*").alias("n"), F.sum((F.col("cluster") < 0).cast("int")).alias("noise")).first()
    text = "event_template" if "event_template" in dictionary.columns else "event_id"
    clusters = {str(r["cluster"]): {"size": r["size"], "representatives": {k: {"seq_key": r[k]} for k in ("center", "end_a", "end_b")}, "examples": []} for r in reps.orderBy("cluster").collect()}
    for r in shown.orderBy("cluster", "pos").collect():
        clusters[str(r["cluster"])]["examples"].append({"seq_key": r["session_id"], "label": r["label"], "event_ids": list(r["event_seq"])})
    names = [{"row_id": r["row_id"], "event_id": r["event_id"], "event_template": r[text]} for r in dictionary.orderBy("row_id").collect()]
    return {"meta": {"num_sequences": about["n"], "num_clusters": len(clusters), "noise": about["noise"] or 0}, "template_map": names, "clusters": clusters}


def representative_grams(reps: DataFrame, shown: DataFrame, sessions: DataFrame, bigrams: int = 8, trigrams: int = 5, least: int = 1, most_examples: int = 15) -> DataFrame:
    """cluster, n, gram, support, rank: the most common n-grams of each cluster's representatives (whole sequences) and
    first examples (as shown; what is both counts twice); of equals the one seen first. An n-gram that several clusters
    have stays with the first."""
    whole = reps.select("cluster", F.posexplode(F.array("center", "end_a", "end_b")).alias("at", "session_id")).join(sessions.select("session_id", "event_seq"), "session_id").select("cluster", "at", "event_seq")
    short = shown.where(F.col("pos") <= most_examples).select("cluster", (F.col("pos") + 2).alias("at"), "event_seq")
    grams = seq_ngrams(whole.unionByName(short), ["cluster", "at"], (2, 3), place="place")
    counts = grams.groupBy("cluster", "n", "gram").agg(F.count("*").alias("support"), F.min(F.struct("at", "place")).alias("seen"))
    order = Window.partitionBy("cluster", "n").orderBy(F.desc("support"), "seen")
    best = counts.where(F.col("support") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.when(F.col("n") == 2, bigrams).otherwise(trigrams))
    first = Window.partitionBy("n", "gram").orderBy("cluster")
    return best.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("cluster", "n", "gram", "support", "rank")


def representative_rules(grams: DataFrame) -> list[Rule]:
    """Rules of ``representative_grams``: 13 of each cluster at most."""
    rows = grams.orderBy("cluster", "n", "rank").collect()
    return [Rule(f"cluster_{r['cluster']}_ng{r['n']}_{r['gram'].replace(' ', '_')}", (Clause("contains_ngram", rids=tuple(map(int, r["gram"].split()))),), (), 0.8, str(r["cluster"]), True, f"Cluster {r['cluster']} representative {r['n']}-gram (support={r['support']}).") for r in rows]


def neighbour_rules(neighbours: DataFrame, rules_of: DataFrame, top: int = 3) -> DataFrame:
    """query_id, rule, votes, rank: the rules most of a query's neighbours have. ``neighbours``: query_id, key;
    ``rules_of``: key, rule. Of equals the first by name."""
    votes = neighbours.join(rules_of, "key").groupBy("query_id", "rule").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "rule")
    return votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def artifacts(reps: DataFrame, sessions: DataFrame, rules: DataFrame, explanations: DataFrame) -> DataFrame:
    """cluster_id, artifact_json: representative sequences, the judged explanation and the rules of each cluster.
    ``rules``: cluster_id, rule_id, pattern (array), description; ``explanations``: cluster_id, text."""
    each = reps.select(F.col("cluster").cast("string").alias("cluster_id"), F.posexplode(F.array("center", "end_a", "end_b")).alias("at", "session_id")).join(sessions.select("session_id", "event_seq"), "session_id")
    seqs = each.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_seq"))).alias("q"))
    per = rules.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "pattern", "description"))).alias("derived_rules"))
    none = F.array().cast("array<struct<rule_id:string,pattern:array<string>,description:string>>")
    out = seqs.join(explanations, "cluster_id", "left").join(per, "cluster_id", "left")
    body = F.struct("cluster_id", F.transform("q", lambda x: x["event_seq"]).alias("representative_sequences"), F.coalesce("text", F.lit("")).alias("llm_explanation"), F.coalesce("derived_rules", none).alias("derived_rules"))
    return out.select("cluster_id", F.to_json(body).alias("artifact_json"))
