"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected to ``M`` dimensions by Gaussian (2-stable) directions, so the squared projected distance over the
squared true distance follows a chi-square law of M degrees. A small top-level kd-tree over projected space, fitted on
a bounded sample, deals all vectors to shards; each shard has its own kd-tree. A query visits projected neighbours in
order of projected distance and verifies true distances, until the next projected distance squared reaches
chi2_M^-1(``CONFIDENCE``) times the k-th best true distance squared: a nearer neighbour not yet seen would then lie this
far out with probability below 1 - ``CONFIDENCE``. First each query searches its home shard; with the k-th distance
found there, it visits the other shards whose boxes do not pass the same test.

Equal vectors are one indexed point that carries its k + 1 smallest ids (a windowed top-k with a partial limit before
the shuffle): no other of its copies can be in any answer, so results stay whole whatever the size of a group.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of
another length than the commonest (ties to the shorter), nor null ids; rows that repeat id and vector are one candidate;
with fewer than k candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

M, CONFIDENCE, LEAF = 8, 0.98, 128
SHARD_POINTS, SAMPLE, QUERY_BLOCK = 16384, 65536, 4096


def chi2_quantile(p: float, m: int = M) -> float:
    """For even m, by bisection on the closed form."""

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(1234).normal(0, 1, (dim, M))


def split(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray]:
    """kd-tree leaves (row numbers) by halving the widest side, and their boxes (leaves, 2, M)."""
    leaves, boxes, todo = [], [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        part = points[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        axis = int((high - low).argmax())
        if len(rows) <= leaf or low[axis] == high[axis]:
            leaves.append(rows)
            boxes.append((low, high))
            continue
        order = np.argpartition(part[:, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves, np.array(boxes).reshape(-1, 2, points.shape[1])


def box_distance(q: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    d = np.maximum(boxes[:, 0] - q, 0) + np.maximum(q - boxes[:, 1], 0)
    return (d * d).sum(axis=1)


class Cells:
    """The top-level kd-tree: plane splits down to ``shards`` cells that cover all of projected space."""

    def __init__(self, sample: np.ndarray, shards: int):
        whole = np.array([np.full(M, -np.inf), np.full(M, np.inf)])
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, plane, below, above; a cell is ~number
        boxes: list[np.ndarray] = []

        def grow(rows: np.ndarray, box: np.ndarray, parts: int) -> int:
            spread = sample[rows].max(axis=0) - sample[rows].min(axis=0) if len(rows) else np.zeros(M)
            axis = int(spread.argmax())
            plane = float(np.median(sample[rows, axis])) if len(rows) else 0.0
            if parts < 2 or spread[axis] == 0:
                boxes.append(box)
                return ~(len(boxes) - 1)
            self.nodes.append((axis, plane, 0, 0))
            at = len(self.nodes) - 1
            left, right = box.copy(), box.copy()
            left[1, axis] = right[0, axis] = plane
            below = sample[rows, axis] < plane
            if not below.any() or below.all():
                self.nodes.pop()
                boxes.append(box)
                return ~(len(boxes) - 1)
            a = grow(rows[below], left, parts // 2)
            b = grow(rows[~below], right, parts - parts // 2)
            self.nodes[at] = (axis, plane, a, b)
            return at

        self.root = grow(np.arange(len(sample)), whole, shards)
        self.boxes = np.array(boxes)

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            else:
                axis, plane, a, b = self.nodes[node]
                below = points[rows, axis] < plane
                todo += [(a, rows[below]), (b, rows[~below])]
        return out


class ShardIndex:
    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], turn: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.points = vectors @ turn
        self.leaves, self.boxes = split(self.points, LEAF)

    def search(self, q: np.ndarray, p: np.ndarray, k: int, bound: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and true distances of the k nearest found; ``bound``: a k-th squared distance known from elsewhere."""
        far = box_distance(p, self.boxes)
        rows, dist = np.zeros(0, np.int64), np.zeros(0)
        for leaf in np.argsort(far, kind="stable"):
            if far[leaf] >= stop * bound and np.isfinite(bound):
                break  # the chi-square test holds for all that is left
            at = self.leaves[leaf]
            if np.isfinite(bound):
                gap = self.points[at] - p
                at = at[(gap * gap).sum(axis=1) < stop * bound]
            gap = self.vectors[at] - q
            true = (gap * gap).sum(axis=1)
            rows, dist = np.concatenate((rows, at)), np.concatenate((dist, true))
            if len(rows) >= k:
                # ties at the k-th distance all stay: ids decide among them later
                kth = np.partition(dist, k - 1)[k - 1]
                keep = dist <= kth
                rows, dist, bound = rows[keep], dist[keep], min(bound, kth)
        return rows, dist


def _search(dim: int, k: int):
    turn, stop = directions(dim), chi2_quantile(CONFIDENCE)

    def run(index: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, ShardIndex] | None = None
        for frame in index:
            for row in frame.itertuples(index=False):
                if held is None or held[0] != (row.shard, row.part):
                    vectors = np.frombuffer(row.vectors, np.float64).reshape(-1, dim)
                    held = ((row.shard, row.part), ShardIndex(vectors, [np.asarray(x) for x in row.ids], turn))
                at = held[1]
                queries = np.array([q["vector"] for q in row.queries])
                out_q, out_v, out_s = [], [], []
                for item, q, p in zip(row.queries, queries, queries @ turn, strict=True):
                    rows, dist = at.search(q, p, k + 1, item["bound"], stop)
                    got = sorted((d, int(i)) for r, d in zip(rows, dist, strict=True) for i in at.ids[r])[: k + 1]
                    out_q += [item["id"]] * len(got)
                    out_v += [i for _, i in got]
                    out_s += [d for d, _ in got]
                yield pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "d2": np.array(out_s, np.float64)})

    return run


def nearest(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", shard_points: int = SHARD_POINTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose id is divisible by ``every``."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & fine)
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return table.sparkSession.createDataFrame([], schema)
    dim = lengths["dim"]
    # -0.0 and 0.0 are one value
    rows = rows.where(F.size("vector") == dim).select("id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))
    order = Window.partitionBy("vector").orderBy("id")
    top = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    points = durable(top.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    total = points.count()
    shards = max(1, -(-total // shard_points))
    turn = directions(dim)
    sample = points.where(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < F.lit(min(1.0, SAMPLE / max(total, 1)) * 1_000_000)).select("vector").limit(2 * SAMPLE)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array((b.column(0).flatten().to_numpy().reshape(-1, dim) @ turn).ravel()), M).cast(pa.list_(pa.float64()))], ["p"])

    drawn = np.array(sample.mapInArrow(project, "p array<double>").toArrow().column(0).to_pylist()).reshape(-1, M)
    cells = Cells(drawn, shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(b.schema.get_field_index("vector")).flatten().to_numpy().reshape(-1, dim) @ turn
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.home(p).astype(np.int32))], [*b.schema.names, "shard"])

    # a shard is one row: its vectors as bytes. One that outgrew the sample's estimate becomes several, by its counted
    # size, and a query meets each of them
    placed = points.mapInArrow(place, "vector array<double>, ids array<long>, shard int")
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / (2 * shard_points)).alias("parts"))
    placed = placed.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")).select("vector", "ids", "shard", "part")

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        flat = part.column("vector").combine_chunks().flatten().to_numpy()
        ids = part.column("ids").combine_chunks()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "vectors": pa.array([flat.tobytes()], pa.binary()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64())))})

    index = durable(placed.groupBy("shard", "part").applyInArrow(pack, "shard int, part int, vectors binary, ids array<array<long>>"))
    queries = rows.where(F.col("id") % every == 0).distinct()
    queries = durable(queries.select("vector", F.array("id").alias("ids")).mapInArrow(place, "vector array<double>, ids array<long>, shard int"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def ask(asked: DataFrame) -> DataFrame:
        """asked: id, vector, shard, bound. Blocks of queries meet their shard's index row."""
        packed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("shard", "block").agg(F.collect_list(F.struct("id", "vector", "bound")).alias("queries"))
        return packed.join(index, "shard").select("shard", "part", "vectors", "ids", "queries").mapInPandas(_search(dim, k), "query_id long, vec_id long, d2 double")

    asked = queries.select(F.col("ids")[0].alias("id"), "vector", "shard")
    home = durable(ask(asked.withColumn("bound", F.lit(float("inf")))))
    # the (k + 1)-th of all found at home: the query itself may be among them
    ranked = home.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id")))
    bounds = ranked.groupBy("query_id").agg(F.max(F.when(F.col("n") == k + 1, F.col("d2"))).alias("kth"))
    stop = chi2_quantile(CONFIDENCE)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(1).flatten().to_numpy().reshape(-1, dim) @ turn
            kth = b.column(3).to_numpy(zero_copy_only=False)
            to, which = [], []
            for i, (q, bound, own) in enumerate(zip(p, kth, b.column(2).to_pylist(), strict=True)):
                near = np.flatnonzero(box_distance(q, cells.boxes) < stop * bound) if np.isfinite(bound) else np.arange(len(cells.boxes))
                near = near[near != own]
                to.append(near)
                which.append(np.full(len(near), i))
            rows_ = pa.array(np.concatenate(which)) if which else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows_), b.column(1).take(rows_), pa.array((np.concatenate(to) if to else np.zeros(0)).astype(np.int32)), b.column(3).take(rows_)], ["id", "vector", "shard", "bound"])

    rest = asked.join(bounds, F.col("id") == F.col("query_id"), "left").select("id", "vector", "shard", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
    away = ask(rest.mapInArrow(route, "id long, vector array<double>, shard int, bound double"))
    found = home.unionByName(away).where("query_id <> vec_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d2").alias("score"))
