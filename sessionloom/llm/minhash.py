"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact confirmation,
connected components by alternating large-star and small-star.

Defined results: a null or wordless text has no shingles and links with nothing; equal shingle sets are one class
whose smallest id stands for it, so copies are never paired with each other; repeated rows give repeated rows; rows
with a null id come back unlinked (component null, kept). Rows that share an id are one node. Other columns of the
input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, durable, mix, returning, shingle_sets, slices, utf8

#: 64 bands of 8 minima: a pair of similarity 0.8 meets in no band with probability (1 - 0.8**8)**64 < 1e-5, one of
#: similarity 0.1 in some band with probability below 1e-6.
BANDS, ROWS = 64, 8
#: The sets of texts that the first round leaves open are broadcast up to this size; beyond it, pairs are joined.
OPEN_BYTES, PART = 96 << 20, 256
#: One bit of each of the 512 minima estimates a similarity of 0.8 with a deviation of 0.027; pairs below
#: 0.8 less five deviations are not confirmed.
SLACK = 5 * 0.027


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    a = rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def minima(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The minimum of each function a * x + b mod 2**32 over each set; rows of empty sets are undefined."""
    a, b = _family()
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(off) - 1, len(a)), np.uint32)
    room = np.empty((64, 2048), np.uint32)
    for d in range(len(off) - 1):
        for at in range(off[d], off[d + 1], 2048):
            part = x[at : min(at + 2048, off[d + 1])]
            for f in range(0, len(a), 64):
                r = room[:, : len(part)]
                np.multiply(a[f : f + 64, None], part[None, :], out=r)
                r += b[f : f + 64, None]
                low = r.min(axis=1)
                out[d, f : f + 64] = low if at == off[d] else np.minimum(out[d, f : f + 64], low)
    return out


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                with np.errstate(over="ignore"):
                    values, off = shingle_sets(part.column(1), k)
                    n = np.diff(off)
                    keys = _keys(values, off)
                    low = minima(values, off)
                    bands = np.zeros((len(n), BANDS), np.uint64)
                    for r in range(ROWS):
                        bands = mix(bands * np.uint64(31) + low[:, r::ROWS][:, :BANDS].astype(np.uint64) + np.uint64(r + 1))
                    bands = mix(bands + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    bits = np.packbits((mix(low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), lists(bands), lists(bits)], ["id", "n", "s1", "s2", "bands", "bits"])

    return returning(run)


def _keys(values: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Two sums of mixed shingles: equal sets have equal keys."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(seed)), dtype=np.uint64))) for seed in (0x51A3, 0xC0FFEE11)]
    return [(s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums]


def _confirm(k: int, percent: int):
    """Of the texts of one centre (``left``) and some of its partners (``right``), the true links on full sets. A node
    has several texts where rows share an id; one that is alike will do."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tops, u, v = [], [], []
        with np.errstate(over="ignore"):
            for batch in left.combine_chunks().to_batches():
                for part in slices(batch, "text", 1 << 20):
                    values, off = shingle_sets(part.column("text"), k)
                    tops += [values[off[i] : off[i + 1]] for i in range(part.num_rows)]
            for batch in right.combine_chunks().to_batches():
                for part in slices(batch, "text", 1 << 20):
                    values, off = shingle_sets(part.column("text"), k)
                    ids, centers = part.column("id").to_numpy(), part.column("c").to_numpy()
                    for i in range(part.num_rows):
                        if _any_alike([values[off[i] : off[i + 1]]], tops, percent):
                            u.append(min(ids[i], centers[i]))
                            v.append(max(ids[i], centers[i]))
        return pa.table({"u": pa.array(np.array(u, np.int64)), "v": pa.array(np.array(v, np.int64))})

    return run


def _any_alike(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> bool:
    for x in a:
        for y in b:
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                return True
    return False


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, off = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))], ["id", "set"])

    return returning(run)


def _links(sets, percent: int, least: float):
    """Of one part of a bucket, the links between its strays and all its members of other components."""

    def run(group: pa.Table) -> pa.Table:
        of, (ids, off, values) = {}, sets.value
        stray = group.column("stray").to_numpy(zero_copy_only=False).astype(bool)
        me, label, n = (group.column(c).to_numpy() for c in ("id", "label", "n"))
        mode, center = group.column("mode")[0].as_py(), group.column("c")[0].as_py()
        bits = group.column("bits").combine_chunks().flatten().to_numpy().reshape(len(me), -1)
        every, u, v = np.flatnonzero(~stray), [], []

        def get(x: int) -> list[np.ndarray]:
            if x not in of:
                of[x] = [values[off[i] : off[i + 1]] for i in range(*np.searchsorted(ids, [x, x + 1]))]
            return of[x]

        for a in np.flatnonzero(stray):
            if me[a] == center:
                continue
            far = np.bitwise_count(bits[every] ^ bits[a]).sum(axis=1)
            ok = (label[every] != label[a]) & (me[every] != center) & ((label[every] == mode) | (me[a] < me[every])) & (1 - 2 * far / (BANDS * ROWS) >= least)
            ok &= 100 * np.minimum(n[every], n[a]) >= percent * np.maximum(n[every], n[a])
            for b in every[ok]:
                if _any_alike(get(int(me[a])), get(int(me[b])), percent):
                    u.append(min(me[a], me[b]))
                    v.append(max(me[a], me[b]))
        return pa.table({"u": pa.array(np.array(u, np.int64)), "v": pa.array(np.array(v, np.int64))})

    return run


def _alike(least: float, percent: int):
    """Signatures close enough, and sizes that allow the similarity."""
    same = sum((64 - F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(BANDS * ROWS // 64)), F.lit(0))
    return (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (2.0 * same / (BANDS * ROWS) - 1.0 >= least)


def _across(left: DataFrame, percent: int, least: float) -> DataFrame:
    """Candidate pairs (c, id) of a bucket's strays with its members of other components."""
    a = left.where("label <> mode").select("key", F.col("id").alias("u"), F.col("label").alias("lu"), F.col("n").alias("nx"), F.col("bits").alias("x"))
    b = left.select("key", F.col("id").alias("v"), F.col("label").alias("lv"), "mode", "c", F.col("n").alias("ny"), F.col("bits").alias("y"))
    across = a.join(b, (a["key"] == b["key"]) & (F.col("lu") != F.col("lv")) & ((F.col("lv") == F.col("mode")) | (F.col("u") < F.col("v"))) & (F.col("u") != F.col("c")) & (F.col("v") != F.col("c")) & _alike(least, percent))
    return across.select(F.col("u").alias("c"), F.col("v").alias("id")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, most: int = OPEN_BYTES) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept. Links have 100 * intersection >= percent * union.
    ``most`` bounds what is broadcast; results don't depend on it."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = docs.where("id is not null")
    least = percent / 100 - SLACK
    whole = durable(docs.mapInArrow(_sketch(k), "id long, n long, s1 long, s2 long, bands array<long>, bits array<long>"))
    # only equal sets become one class; its smallest id stands for it. A partial aggregate, whatever the size of the class
    of_class = whole.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.min_by(F.struct("bits", "bands"), "id").alias("x"))
    reps = durable(of_class.select("id", "s1", "s2", "n", "x.bits", "x.bands"))
    sketch = durable(whole.select("id", "n", "s1", "s2"))
    discard(whole)
    bits = durable(reps.drop("bands"))
    # one exchange of the band keys; a text has one key in each band, so no key holds more than 1 / BANDS of the rows
    spread = reps.select("id", F.explode("bands").alias("key"))
    met = durable(spread.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"))
    discard(reps)
    # a bucket's centre is its best met member: the text from which a group of near copies was made meets them all,
    # while two copies of it may be too far from each other
    degree = met.groupBy("id").agg(F.sum("size").alias("degree"))
    best = met.join(degree, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("c"))
    met, old = durable(met.join(best, "key")), met
    discard(old)

    def few(ids: DataFrame) -> DataFrame:
        """The texts of some ids (id): these are broadcast up to ``most`` bytes, so that the other texts stay where they are."""
        ids = durable(ids.distinct())
        out = durable(named.join(F.broadcast(ids) if 16 * ids.count() <= most else ids, "id", "left_semi"))
        discard(ids)
        return out

    def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Of distinct candidate pairs (c, id), the true links. A centre's text travels once for each ``PART`` of its
        partners, theirs once for each centre."""
        pairs = durable(pairs)
        sizes = pairs.groupBy("c").agg(F.ceil(F.count("*") / PART).alias("parts"))
        dealt = pairs.join(sizes, "c").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        mine = dealt.join(texts, "id").select("c", "part", "id", "text")
        tops = sizes.select(F.col("c").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(texts, "id").select(F.col("id").alias("c"), "part", "text")
        tops = tops.select(*[F.col(x).alias(x) for x in tops.columns])  # both sides come from the same table
        mine = mine.select(*[F.col(x).alias(x) for x in mine.columns])
        out = durable(tops.groupBy("c", "part").cogroup(mine.groupBy("c", "part")).applyInArrow(_confirm(k, percent), "u long, v long").where("u <> v").distinct())
        discard(pairs)
        return out

    def side(c: str, n: str, x: str) -> DataFrame:
        return bits.select(F.col("id").alias(c), F.col("n").alias(n), F.col("bits").alias(x))

    # each member against its buckets' centres; one pair a text first, with the centre it meets most
    stars = met.where("id <> c").groupBy("c", "id").agg(F.count("*").alias("shared")).join(side("c", "nx", "x"), "c").join(side("id", "ny", "y"), "id")
    stars = durable(stars.where(_alike(least, percent)).groupBy("c", "id").agg(F.max("shared").alias("shared")))
    texts = few(stars.select(F.explode(F.array("c", "id")).alias("id")))
    first = stars.groupBy("id").agg(F.max_by("c", F.struct("shared", -F.col("c"))).alias("c")).select("c", "id")
    # rows that share an id are one node, so an id of several texts links their classes
    several = sketch.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("s1", "s2", "n")).alias("a"), F.max(F.struct("s1", "s2", "n")).alias("b")).where("a <> b").select("id")
    several = sketch.where("n > 0").join(several, "id", "left_semi").distinct()
    same = several.join(bits.select(F.col("id").alias("rep"), "s1", "s2", "n"), ["s1", "s2", "n"]).select(F.least("id", "rep").alias("u"), F.greatest("id", "rep").alias("v")).where("u <> v").distinct()
    links = durable(confirmed(first, texts).unionByName(same).distinct())
    labels = durable(components(links))

    def label(rows: DataFrame, c: str, name: str) -> DataFrame:
        return rows.join(labels.select(F.col("node").alias(f"_{name}"), F.col("label").alias(name)), F.col(c) == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(name, c)).drop(f"_{name}")

    # then those that still cross components
    found = confirmed(label(label(stars, "c", "lc"), "id", "li").where("lc <> li").select("c", "id"), texts)
    if found.head(1):
        links = durable(links.unionByName(found))
        labels = durable(components(links))
    discard(stars, texts)
    # then the rest: in buckets that still hold several components, every pair across components, so no link is lost.
    # Members of a bucket's largest component are paired with the others only, never with each other.
    left = label(met.where("size > 2").select("key", "id", "c"), "id", "label")
    per = left.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("n", "label")).alias("mode")).where("parts > 1").drop("parts")
    left = durable(left.join(per, "key").join(bits.select("id", "n", "bits"), "id").select("key", "id", "c", "label", "mode", "n", "bits"))
    discard(met)
    texts = few(left.select("id"))
    if (left.select("id", "n").distinct().agg(F.sum("n")).first()[0] or 0) * 8 <= most:
        got = texts.mapInArrow(_sets(k), "id long, set array<long>").toArrow()
        order = np.argsort(got.column("id").to_numpy(), kind="stable")
        lists = got.column("set").combine_chunks().take(pa.array(order))
        sets = docs.sparkSession.sparkContext.broadcast((got.column("id").to_numpy()[order], lists.offsets.to_numpy(), lists.flatten().to_numpy().view(np.uint64)))
        # a bucket's strays in parts of bounded size, each with all members of the bucket
        parts = left.groupBy("key").agg((F.floor(F.sum((F.col("label") != F.col("mode")).cast("int")) / PART) + 1).alias("parts"))
        dealt = left.join(parts, "key")
        strays = dealt.where("label <> mode").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("stray", F.lit(True))
        alls = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("stray", F.lit(False))
        every = strays.select(*(cols := ["key", "part", "stray", "id", "label", "mode", "c", "n", "bits"])).unionByName(alls.select(*cols))
        more = durable(every.groupBy("key", "part").applyInArrow(_links(sets, percent, least), "u long, v long").where("u <> v").distinct())
    else:
        more = confirmed(_across(left, percent, least), texts)
    if more.head(1):
        labels = durable(components(links.unionByName(more)))
    discard(left, texts)
    of = label(bits.drop("bits"), "id", "top").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("n").alias("m"), "top")
    out = sketch.join(of, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n") == F.col("m")) & F.col("id").isNotNull(), "left")
    top = F.coalesce("top", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), top.alias("component_id"), F.coalesce(top == F.col("id"), F.lit(True)).alias("kept"))
