"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line's tokens are its distinct word shingles (``K`` words, lower-cased; a shorter line has its whole word sequence as
its one token), as 64-bit hashes. Two sets of Jaccard similarity ``PERCENT``/100 or more share a token in their prefixes
of n - ceil(n * PERCENT / 100) + 1 tokens, in any one order. Lines first meet in the order of the hashes. Only a line with
a token that over ``CROWD`` lines have in their prefixes meets the others of that kind once more, by rarity: their tokens
are counted in ``CELLS`` hash cells, and a token whose cell is fuller than most comes later, the fuller the later. (Of two
similar lines, one without such a token has met the other: their first common token is in its prefix.) The join itself
makes only pairs that pass the positional filter and a bound on the difference of their sets, told by 64 bits: which of
64 classes of tokens a line has an odd number of. These are verified on the full sets, made anew from the text. A line
similar to an earlier one (by id and line number) is removed.

Skew: equal lines are one class, found by a partial aggregate; only its first occurrence gets tokens, so a line that
stands in a third of all rows is one row of each list. Each class first meets one other only: of the earliest lines of its
lists, the one it shares most with (a very common token's list is dealt to several tasks, by the token's level). What this
doesn't settle then meets all earlier ones, so the answer is exact and a group of near copies costs one pair a line, not
all pairs.

Defined results: lines without words take no part and stay, and with ``short`` false so do those of fewer than ``K``
words; null texts have no lines; an exact copy of a line at the same id and number (a repeated row) is the same
occurrence, and stays; documents that share an id are one for this purpose: a line number that goes, goes from each;
rows with a null id take no part; an empty table gives an empty result; an input column named like one that
``dedup_lines`` adds is replaced by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable

K, PERCENT, CELLS, BROADCAST_ROWS = 5, 80, 65_536, 500_000
#: A cell is common from this multiple of the mean on; four levels are a factor of two.
COMMON, LEVELS = 1.25, 127
#: Lists of tokens in cells of more lines than this are dealt to several tasks.
LIST_ROWS = 1 << 17
#: Lists of more lines than this, by hash alone, are settled by rarity.
CROWD = 1024

# Arrays are opened by the outer forms, though none is empty: for the others the optimizer infers a filter on the size of
# the array, and makes the array twice.

#: White space other than the blank, which the word rule knows too.
_OTHER_SPACE = "\t\x0b\x0c\r"


#: K words; possessive, so a long line is read once.
ENOUGH = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (K - 1)


def _words(raw: Column) -> Column:
    """The words of a line; splitting at one blank needs no regular expression."""
    other = F.lit(False)
    for c in _OTHER_SPACE:
        other = other | F.contains(raw, F.lit(c))
    plain = F.when(other, F.translate(raw, _OTHER_SPACE, " " * len(_OTHER_SPACE))).otherwise(raw)
    return F.array_remove(F.split(plain, " "), "")


def _lines(docs: DataFrame, short: bool) -> DataFrame:
    """id, line, raw of every line that has words, or with ``short`` false K words at least."""
    each = docs.select("id", F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("line", "raw"))
    return each.where(F.btrim("raw", F.lit(" " + _OTHER_SPACE)) != "" if short else F.col("raw").rlike(ENOUGH))


def _hashed(lines: DataFrame) -> DataFrame:
    """id, line, hashes (of the line's words in turn)."""
    return lines.select("id", "line", F.transform(_words(F.col("raw")), lambda w: F.xxhash64(w)).alias("hashes"))


def _begins() -> Column:
    """The places in ``hashes`` at which shingles begin."""
    return F.sequence(F.lit(0), F.greatest(F.size("hashes") - K, F.lit(0)))


def _shingle(i: Column) -> Column:
    """The hash of the K words from place i on; a place past a short line's end is null and adds nothing."""
    return F.xxhash64(*[F.get("hashes", i + j if j else i) for j in range(K)])


def _levels(lines: DataFrame) -> tuple[np.ndarray, float]:
    """The level of each cell (0 up to ``COMMON`` times the mean count), and that mean: ``CELLS`` small numbers, whatever
    the corpus."""
    cell = _shingle(F.col("i")).bitwiseAND(F.lit(CELLS - 1)).cast("int")
    counts = lines.select("hashes", F.explode_outer(_begins()).alias("i")).groupBy(cell.alias("cell")).agg(F.count("*").alias("c"))
    out, count = np.zeros(CELLS, np.int16), np.zeros(CELLS)
    for r in counts.collect():
        count[r["cell"]] = r["c"]
    mean = float(count.mean())
    common = count > COMMON * mean
    out[common] = np.minimum(1 + np.floor(4 * np.log2(count[common] / (COMMON * mean))), LEVELS)
    return out, mean


def _tokens(levels: np.ndarray) -> Column:
    """The distinct shingles in the order of their hashes or, with ``levels``, of rarity: 7 bits of level, then 56 of the
    hash."""
    table = F.split(F.lit(",".join(map(str, levels.tolist()))), ",").cast("array<int>")  # folded to one constant

    def token(h: Column) -> Column:
        level = F.get(table, h.bitwiseAND(F.lit(CELLS - 1)).cast("int")).cast("long")
        return F.shiftleft(level, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    every = F.transform(_begins(), _shingle)
    return F.sort_array(F.array_distinct(F.transform(every, token) if levels.any() else every))


def _prefix(n: Column) -> Column:
    """How many tokens of a set of n make its prefix."""
    return n - F.ceil(n * PERCENT / F.lit(100)).cast("int") + 1


def _need(a: Column, b: Column) -> Column:
    """Least overlap of sets of these sizes: 100 * o >= PERCENT * (a + b - o)."""
    return F.ceil((a + b) * PERCENT / F.lit(100.0 + PERCENT) - F.lit(1e-9))


def _listed(lines: DataFrame, levels: np.ndarray, mean: float) -> DataFrame:
    """Of lines (id, line, hashes), the rows of the lists that have company: token, dealt (to several tasks), size (of
    the list or part), x (the line: at, n, pos, odd) and top (the earliest of the list or part)."""
    sets = lines.select("id", "line", _tokens(levels).alias("tokens"))
    n = F.size("tokens")
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    odd = F.aggregate("tokens", F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(bit(t)))
    sets = sets.select("id", "line", n.alias("n"), F.slice("tokens", F.lit(1), _prefix(n)).alias("prefix"), odd.alias("odd"))
    rows = sets.select("id", "line", "n", "odd", F.posexplode_outer("prefix").alias("pos", "token"))
    rows = rows.select("token", "id", "line", "n", "pos", "odd")
    key, parts = ["token"], F.lit(1).cast("long")
    if levels.any():
        fullest = F.lit(COMMON * mean) * F.pow(F.lit(2.0), F.shiftright("token", 56) / 4.0)
        parts = F.when(F.shiftright("token", 56) > 0, F.ceil(fullest / LIST_ROWS)).otherwise(parts)
        key, rows = ["token", "part"], rows.withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("id", "line"), parts)).otherwise(F.lit(0).cast("long")))
    # one exchange; a line has each token once, so a list holds at most one row of each class. Most lists hold one row: they
    # are counted and left out before anything is compared (a sort by one long needs no comparisons either)
    of, x = Window.partitionBy(*key), F.struct(F.struct("id", "line").alias("at"), "n", "pos", "odd")
    listed = rows.withColumn("size", F.count("*").over(of)).where((F.col("size") > 1) | (parts > 1)).withColumn("top", F.min(x).over(of))
    return listed.select("token", (parts > 1).alias("dealt"), "size", x.alias("x"), "top")


def _may(x: Column, y: Column) -> Column:
    """Whether lines that share a token may be similar, x before y, and that token the first they share: in each, as many
    tokens as they need follow it; and no more bits of odd count differ than tokens may."""
    need = _need(x["n"], y["n"])
    first = (x["pos"] + need <= x["n"]) & (y["pos"] + need <= y["n"])
    return (x["at"] < y["at"]) & first & (F.bit_count(x["odd"].bitwiseXOR(y["odd"])) + 2 * need <= x["n"] + y["n"])


def _by_id(spots: DataFrame) -> DataFrame:
    """id, at (its line numbers, ascending). The line numbers of one text are bounded by it."""
    return durable(spots.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("at")))


def _bounded(by_id: DataFrame, most: int) -> DataFrame:
    """Broadcast up to ``most`` ids of five line numbers each on average; beyond that, a shuffle join."""
    n, m = by_id.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    return F.broadcast(by_id) if n <= most and m <= 5 * most else by_id


def removed_lines(docs: DataFrame, short: bool = False, most: int = BROADCAST_ROWS, crowd: int = CROWD) -> DataFrame:
    """(id, line) of every line of ``docs`` (id, text) that goes. ``most`` bounds what is broadcast, and lines with a token
    of a list of over ``crowd`` meet by rarity; results depend on neither."""
    docs = docs.where("id is not null and text is not null").select("id", "text")
    # two keys of 64 bits tell a class: among 10^12 different lines two share both with a probability below 10^-14
    spots = durable(_lines(docs, short).select("id", "line", F.xxhash64("raw").alias("k1"), F.xxhash64(F.lit(1), "raw").alias("k2")))
    spot = F.struct("id", "line")
    classes = durable(spots.groupBy("k1", "k2").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").drop("last"))
    copies = durable(spots.join(classes, ["k1", "k2"]).where(spot != F.col("first")).select("id", "line"))
    discard(spots, classes)
    skipped = _by_id(copies)
    # only the first line of each class gets tokens
    others = docs.join(_bounded(skipped, most), "id", "left")
    each = others.select("id", "at", F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("line", "raw")).where(F.col("at").isNull() | ~F.array_contains("at", F.col("line")))
    lines = _hashed(each.where(F.btrim("raw", F.lit(" " + _OTHER_SPACE)) != "" if short else F.col("raw").rlike(ENOUGH)))
    multi = durable(_listed(lines, np.zeros(CELLS, np.int16), 0.0))

    def met(pairs: DataFrame) -> DataFrame:
        """Of rows (x, y) that share a token, the pairs (x_at, y_at) that may be similar, the earlier line first, and by
        how many tokens they met."""
        return pairs.where(_may(F.col("x"), F.col("y"))).groupBy(F.col("x.at").alias("x_at"), F.col("y.at").alias("y_at")).agg(F.count("*").alias("common"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs, the later line (at) of those that are similar, on full sets made anew from the text."""
        pairs = durable(pairs)
        wanted = _by_id(pairs.select(F.explode_outer(F.array("x_at", "y_at")).alias("at")).select("at.id", "at.line"))
        found = docs.join(_bounded(wanted, most), "id").select("id", "at", F.split(F.lower("text"), "\n").alias("all"))
        found = found.select("id", F.explode_outer(F.transform("at", lambda i: F.struct(i.alias("line"), F.get("all", i).alias("raw")))).alias("x")).select("id", "x.*").where("raw is not null")
        full = durable(_hashed(found).select(spot.alias("at"), F.array_distinct(F.transform(_begins(), _shingle)).alias("tokens")).dropDuplicates())
        side = lambda s: full.select(F.col("at").alias(f"{s}_at"), F.col("tokens").alias(f"{s}_tokens"))
        a, b = F.size("x_tokens"), F.size("y_tokens")
        both = pairs.join(side("x"), "x_at").join(side("y"), "y_at")
        o = F.size(F.array_intersect("x_tokens", "y_tokens"))
        out = durable(both.where(100 * o >= PERCENT * (a + b - o)).select(F.col("y_at").alias("at")).distinct())
        discard(pairs, wanted, full)
        return out

    def later(multi: DataFrame) -> DataFrame:
        """The lines (at) that are similar to an earlier one of their lists."""
        # of the earliest lines of its lists, a line meets the one it shares most tokens with: one pair a line
        tops = met(multi.select(F.col("top").alias("x"), F.col("x").alias("y")))
        late = verified(tops.groupBy("y_at").agg(F.max_by("x_at", "common").alias("x_at")))
        # what that did not settle meets all that come before it in any of its lists
        open_ = multi.where("x.at > top.at or dealt").select("token", F.col("x").alias("y")).join(late, F.col("y.at") == F.col("at"), "left_anti")
        return late.unionByName(verified(met(open_.join(multi.select("token", "x"), "token")).select("x_at", "y_at")))

    # of two similar lines that meet in no shorter list, each has a token of a longer one
    crowded = _by_id(multi.where(F.col("size") > crowd).select("x.at.id", "x.at.line").distinct())
    lists, own = multi, []
    if not crowded.isEmpty():
        some = docs.join(_bounded(crowded, most), "id").select("id", "at", F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("line", "raw")).where(F.array_contains("at", F.col("line")))
        some = durable(_hashed(some).dropDuplicates())
        rare = durable(_listed(some, *_levels(some)))
        # settled together, so the texts are read for both at once; a token of one kind that equals one of the other only
        # adds pairs to verify
        lists, own = multi.where(F.col("size") <= crowd).unionByName(rare), [some, rare]
    late = later(lists)
    gone = durable(late.select("at.id", "at.line").unionByName(copies).distinct())
    discard(multi, copies, skipped, crowded, *own)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with all its columns, and ``kept_text`` (without the removed lines), ``n_lines``, ``n_removed``.

    A null text stays null; a text whose every line goes becomes empty. With ``short``, lines of fewer than ``K`` words
    take part too.
    """
    own = ("kept_text", "n_lines", "n_removed")
    key, text = F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    gone = _by_id(removed_lines(docs.select(key, text), short, most))
    rows = docs.select(F.struct(*[c for c in docs.columns if c.lower() not in own]).alias("row"), key, text)
    out = rows.join(_bounded(gone, most), "id", "left")
    out = out.withColumn("parts", F.split("text", "\n"))  # made once a row
    kept = F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(F.filter("parts", lambda x, i: ~F.array_contains("at", i)), "\n"))
    removed = F.when(F.col("at").isNull(), 0).otherwise(F.size(F.filter("at", lambda i: i < F.size("parts"))))
    return out.select("row.*", kept.alias("kept_text"), F.coalesce(F.when(F.col("text").isNotNull(), F.size("parts")), F.lit(0)).alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(removed).alias("n_removed"))
