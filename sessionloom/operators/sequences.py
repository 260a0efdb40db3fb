"""Dictionary encoding, sessions, windows, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str], part: Column, name: str) -> DataFrame:
    """``rows`` with consecutive numbers from 0 in a total order, without a task that holds them all: rows are numbered
    within each ``part``, which must not decrease in that order, and moved by the sizes of the parts before."""
    rows = rows.withColumn("_part", part)
    sizes = rows.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row a part
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = rows.withColumn("_k", own).join(before, F.col("_part") == F.col("_p"))
    return out.withColumn(name, (F.col("_before") + F.col("_k") - 1).cast("int")).drop("_part", "_p", "_k", "_before")


def templates(lines: DataFrame, by_name: bool = False) -> DataFrame:
    """event_id and row_id by first appearance, or ``by_name`` in the order of the names."""
    first = lines.groupBy("eid").agg(F.min("line_id").alias("first_line"))
    ready = numbered(first, ["eid"], F.substring("eid", 1, 4), "row_id") if by_name else numbered(first, ["first_line", "eid"], F.shiftright("first_line", 20), "row_id")
    return ready.select(F.col("eid").alias("event_id"), "row_id", "first_line")


def encoded(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    return lines.join(dictionary.select(F.col("event_id").alias("eid"), "row_id"), "eid")


def sessions(lines: DataFrame) -> DataFrame:
    """session_id, event_seq (row ids by time, then line), label (any)."""
    dictionary = templates(lines)
    rows = encoded(lines, dictionary)
    late = F.coalesce(F.col("ts_sec"), F.lit((1 << 63) - 1))  # lines without a time come last, in their order
    out = rows.groupBy("sk").agg(F.array_sort(F.collect_list(F.struct(late.alias("ts_sec"), "line_id", "row_id"))).alias("q"), F.max("anom").alias("label"))
    return out.select(F.col("sk").alias("session_id"), F.transform("q", lambda x: x["row_id"]).alias("event_seq"), "label")


def windows(s: DataFrame, size: int, stride: int = 1, pad: bool = False, length_col: str = "event_seq", content_col: str = "event_seq") -> DataFrame:
    """session_id, win_idx, tokens, label. With ``pad`` short sequences repeat their last token (0 if empty) up to one window."""
    c = F.col(content_col)
    if pad:
        short = F.greatest(F.lit(size) - F.size(c), F.lit(0))
        c = F.concat(c, F.array_repeat(F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0)), short))
    else:
        s = s.where(F.size(length_col) >= size)
    s = s.withColumn("_c", c).where(F.size("_c") >= size)
    cut = F.transform(F.sequence(F.lit(0), F.size("_c") - size, F.lit(stride)), lambda i: F.slice("_c", i + 1, F.lit(size)))
    return s.select("session_id", "label", F.posexplode(cut).alias("win_idx", "tokens")).select("session_id", "win_idx", "tokens", "label")


def masked(s: DataFrame, row_id: int) -> DataFrame:
    return s.withColumn("event_seq_masked", F.array_remove("event_seq", row_id))


def _ranked(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """``rows`` with share: the rank of a seeded hash within the label, over its number of rows. Ranks are taken in 256
    parts of the hash and moved by the sizes of the parts before, so no task holds a whole label."""
    text = F.concat_ws("#", *[F.col(k).cast("string") for k in key], F.lit(seed))
    rows = rows.withColumn("_h", F.md5(text)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = rows.groupBy("label", "_b").agg(F.count("*").alias("_n"))  # 256 rows a label
    by = Window.partitionBy("label").orderBy("_b")
    sizes = sizes.select(F.col("label").alias("_l"), F.col("_b").alias("_p"), (F.sum("_n").over(by) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("label")).alias("_all"))
    own = F.row_number().over(Window.partitionBy("label", "_b").orderBy("_h", *key))
    out = rows.withColumn("_k", own).join(F.broadcast(sizes), F.col("label").eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_p")))
    return out.withColumn("share", (F.col("_before") + F.col("_k")) / F.col("_all")).drop("_h", "_b", "_l", "_p", "_k", "_before", "_all")


def _cut(val: float, test: float, train: float | None) -> Column:
    named = F.when(F.col("share") <= test, "test").when(F.col("share") <= test + val, "val")
    return named.otherwise("train") if train is None else named.when(F.col("share") <= test + val + train, "train")


def split_by_group(s: DataFrame, val: float = 0.1, test: float = 0.2, seed: int = 43, train: float | None = None) -> DataFrame:
    """Stratified by label, by rank of a seeded hash; whole sessions only. With ``train``, the rest has no split."""
    return _ranked(s, ["session_id"], seed).withColumn("split", _cut(val, test, train)).drop("share")


def split_by_window(w: DataFrame, val: float = 0.1, test: float = 0.2, seed: int = 43, train: float | None = None) -> DataFrame:
    """The same for single windows, whatever their session."""
    return _ranked(w, ["session_id", "win_idx"], seed).withColumn("split", _cut(val, test, train)).drop("share")


def split_stats(s: DataFrame) -> DataFrame:
    """split, sessions, anomalies, their percentage, and lines of sessions (split, label, event_seq); what is in no split
    is named dropped."""
    out = s.groupBy(F.coalesce("split", F.lit("dropped")).alias("split")).agg(F.count("*").alias("sessions"), F.sum("label").alias("anomalies"), F.sum(F.size("event_seq")).alias("n_lines"))
    return out.withColumn("percent", 100.0 * F.col("anomalies") / F.col("sessions"))


def in_split(s: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """The sessions of one split."""
    return s.join(split.where(F.col("split") == name).select("session_id"), "session_id", "left_semi")


def usable(s: DataFrame, anomalies: bool = False) -> DataFrame:
    """Sessions with events; on wish anomalous ones only."""
    return s.where((F.size("event_seq") > 0) & ((F.col("label") == 1) if anomalies else F.lit(True)))


def class_weights(s: DataFrame, label: str = "label") -> DataFrame:
    per = s.groupBy(label).count()
    every = Window.partitionBy()
    inverse = F.sum("count").over(every) / F.col("count")
    out = per.select(label, inverse.alias("inv"), F.count("*").over(every).alias("k"), F.sum("count").over(every).alias("total"), "count")
    norm = F.sum("inv").over(every)
    return out.where("k > 1").select(label, (F.col("inv") / norm * F.col("k")).alias("weight"))


def count_vectors(w: DataFrame) -> DataFrame:
    """session_id, win_idx, row_id, cnt: the histogram of each window, made within its row."""
    each = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("row_id"), F.size(F.filter("tokens", lambda x: x == t)).cast("long").alias("cnt")))
    return w.select("session_id", "win_idx", F.explode(each).alias("x")).select("session_id", "win_idx", "x.row_id", "x.cnt")


def vocabulary_size(s: DataFrame) -> DataFrame:
    """How many different events the sequences hold."""
    return s.select(F.explode("event_seq").alias("x")).agg(F.countDistinct("x").alias("n"))


def coerced(text: Column, ids: Column | None = None) -> Column:
    """A sequence that came as text (a JSON list, or parts between commas) as row ids; event ids through the map ``ids``;
    what is neither is dropped."""
    plain = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\[|\]\s*$", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    whole = lambda x: F.when(x.rlike(r"^[+-]?[0-9]{1,9}$"), x.try_cast("int"))
    return F.array_compact(F.transform(plain, lambda x: F.coalesce(whole(x), F.try_element_at(ids, x)) if ids is not None else whole(x)))


def as_templates(s: DataFrame, dictionary: DataFrame, token: str = "event_seq") -> DataFrame:
    """session_id, pos, text: the template of each token (an event id, else a row id), or [T<token>]."""
    names = dictionary.select(F.col("event_id").alias("k"), F.col("event_template").alias("by_event")).dropDuplicates(["k"])
    rows = dictionary.select(F.col("row_id").cast("string").alias("k2"), F.col("event_template").alias("by_row"))
    t = s.select("session_id", F.posexplode(F.col(token).cast("array<string>")).alias("pos", "t"))
    out = t.join(names, F.col("t") == F.col("k"), "left").join(rows, F.col("t") == F.col("k2"), "left")
    return out.select("session_id", "pos", F.coalesce("by_event", "by_row", F.concat(F.lit("[T"), F.coalesce("t", F.lit("")), F.lit("]"))).alias("text"))


#: Where the key of a session may stand, in order of preference.
SESSION_KEYS = {
    "HDFS": ("BlockId", "SessionId", "seq_key"),
    "BGL": ("Node", "SessionId", "BlockId", "seq_key"),
    "THUNDERBIRD": ("seq_key", "BlockId", "SessionId", "Node", "Location"),
    "SPIRIT": ("seq_key", "BlockId", "SessionId", "Node"),
    "LIBERTY": ("seq_key", "BlockId", "SessionId", "Node"),
}
ANY_KEYS = ("SessionId", "BlockId", "Node", "seq_key")


def session_key(columns: list[str], dataset: str) -> str:
    """The session key's column of a dataset, or the first one it could be."""
    some = SESSION_KEYS.get(dataset.strip().upper(), ANY_KEYS)
    return next((c for c in (*some, "seq_key") if c in columns), some[0])


def as_text(seq: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(seq.cast("array<string>"), " "), F.lit(" "))
