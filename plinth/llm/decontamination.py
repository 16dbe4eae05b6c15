"""Benchmark decontamination by winnowing, in native column expressions throughout.

Fingerprints. Every 5-word run is hashed; of each nine consecutive runs (13 words) the smallest hash is
selected, with its place. Any 13 words that a document and a benchmark item share select the same value in
both, so joining selected values misses no shared window. Items of fewer than 13 words give one value, of
all their words; documents then give every run of those lengths that occur among the items.

Hits are extended on words. A fingerprint of an item carries the at most 21 words around its run, all that its
windows can reach, so the index is linear in the benchmark's words; equal surroundings of one item are one row.
Of the windows that a joined place aligns, those equal in both count; a document's hit words are their union.

The benchmark's fingerprints are broadcast only while their counted words are under ``broadcast_bytes``; then
documents are read once and nothing but hits is shuffled. Beyond that the fingerprints are joined by shuffle,
without texts, and a row's hits are gathered before they meet its words, by id and a hash of the words; so rows
that share an id are judged apart there too, and rows alike in both are judged alike.

Cases: null text has no words (0 hit, clean); an item without words or id is no item; an empty benchmark
leaves all clean; repeated rows give a row each, repeated items count once; very long texts are whole (a
place is kept modulo 2**24 and every congruent place is tried).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, opened
from .words import let, words

WINDOW, RUN = 13, 5
_SPAN = WINDOW - RUN + 1
_PLACE = 24
_MASK = (1 << _PLACE) - 1
_NONE = "array<bigint>"


def _tagged(value: Column, place: Column) -> Column:
    return F.shiftleft(value, _PLACE).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_MASK).cast("long")))


def _joined(left: Column, right: Column, count: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` over the first ``count`` elements of both arrays."""
    count = F.greatest(count, F.lit(0))
    return F.zip_with(F.slice(left, 1, count), F.slice(right, 1, count), use)


def _sliding(values: Column, count: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` over every ``_SPAN`` (nine) neighbours of ``count`` values, by doubling."""
    if _SPAN != 9:
        raise ValueError("windows of nine runs")

    def wider(width: int, by: int) -> Callable[[Column], Column]:
        return lambda v: _joined(v, F.slice(v, by + 1, F.greatest(count, F.lit(0))), count - width + 1, use)

    return let(let(let(values, wider(2, 1)), wider(4, 2)), lambda v: let(wider(8, 4)(v), wider(9, 1)))


def _selected(w: Column) -> Column:
    """Tagged hashes of 5-word runs; of each nine consecutive ones the smallest; without 13 words none."""
    count = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), count - RUN), lambda i: _tagged(F.xxhash64(*[F.get(w, i + j) for j in range(RUN)]), i))
    picked = _sliding(runs, count - RUN + 1, lambda a, b: F.least(a, b))
    return F.when(count >= WINDOW, F.array_distinct(picked)).otherwise(F.array().cast(_NONE))


def _short(w: Column, length: int) -> Column:
    count = F.size(w)
    every = F.transform(F.sequence(F.lit(0), count - length), lambda i: _tagged(F.xxhash64(F.concat_ws(" ", F.slice(w, i + 1, length)), F.lit(length)), i))
    return F.when(count >= length, every).otherwise(F.array().cast(_NONE))


def _items(benchmark: DataFrame) -> DataFrame:
    """One row for each distinct item: ``item_id, w, m``."""
    rows = opened(benchmark, ("item_id", "text")).where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    return rows.withColumn("m", F.size("w")).where("m > 0").distinct()


def _low(value: Column) -> Column:
    """What is left of a hash once a place has been tagged to it."""
    return F.shiftright(F.shiftleft(value, _PLACE), _PLACE)


def _index(items: DataFrame) -> DataFrame:
    """``value, item_id, width, near, off``: the words around a fingerprint, and its place among them."""
    long = items.where(F.col("m") >= WINDOW)
    w, m = F.col("w"), F.col("m")
    runs = F.transform(F.sequence(F.lit(0), m - RUN), lambda i: F.struct(_low(F.xxhash64(*[F.get(w, i + j) for j in range(RUN)])).alias("value"), i.alias("place")))
    long = long.select("item_id", "w", "m", F.explode(F.array_distinct(_sliding(runs, m - RUN + 1, lambda a, b: F.least(a, b)))).alias("e"))
    lo, hi = F.greatest(F.col("e.place") - (_SPAN - 1), F.lit(0)), F.least(F.col("e.place") + WINDOW, m)
    long = long.select(F.col("e.value").alias("value"), "item_id", F.lit(WINDOW).alias("width"), F.slice(w, lo + 1, hi - lo).alias("near"), (F.col("e.place") - lo).alias("off"))
    short = items.where(m < WINDOW).select(_low(F.xxhash64(F.concat_ws(" ", "w"), "m")).alias("value"), "item_id", m.alias("width"), w.alias("near"), F.lit(0).alias("off"))
    return long.unionByName(short).distinct()


def _starts() -> Column:
    """Starts of the windows that a joined place aligns and that are equal on words."""
    w, near, width, off = F.col("w"), F.col("near"), F.col("width"), F.col("off")
    places = F.sequence(F.col("place"), F.greatest(F.col("place"), F.size(w)), F.lit(1 << _PLACE))

    def aligned(p: Column) -> Column:
        lo, hi = F.greatest(p - off, F.lit(0)), F.least(p - off + F.size(near), F.size(w)) - width
        equal = F.filter(F.sequence(lo, hi), lambda s: F.slice(w, s + 1, width) == F.slice(near, s - p + off + 1, width))
        return F.when(lo <= hi, equal).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(places, aligned))


def _verdict(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Group verified hits ``(keys, n_words, item_id, width, starts)`` to one row of results."""
    spans = F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("width")).alias("e")))
    grouped = rows.groupBy(*keys).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("starts") > 0, spans))))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.size("starts") > 0, F.col("item_id")))).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("hit")))
    return grouped.select(*keys, "n_words", covered["hit"].alias("n_hit"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = 32 << 20, percent: int = 5) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, contaminated)`` for every row of ``docs``; see the module.

    A document is contaminated when hit words are at least ``percent`` of its words, and at least one.
    """
    scratch = Scratch(docs.sparkSession, "bench")
    items = scratch.keep(_items(benchmark), "items")
    index = scratch.keep(_index(items), "index")
    lengths = sorted(items.agg(F.collect_set(F.when(F.col("m") < WINDOW, F.col("m")))).first()[0])  # at most twelve numbers
    small = (index.agg(F.sum(F.octet_length(F.concat_ws(" ", "near")))).first()[0] or 0) <= broadcast_bytes

    rows = opened(docs).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    traced = rows.withColumn("marks", let(F.col("w"), lambda w: F.concat(_selected(w), *[_short(w, n) for n in lengths])))
    value, place = F.shiftright("e", _PLACE).alias("value"), F.col("e").bitwiseAND(F.lit(_MASK).cast("long")).cast("int").alias("place")
    if small:
        # One mark of its own brings every document through the join once, hit or not.
        own = -(1 << 63)
        present = docs.sparkSession.range(1).select(F.lit(own >> _PLACE).cast("long").alias("value"), F.lit(None).cast("string").alias("item_id"), F.lit(1).alias("width"), F.array().cast("array<string>").alias("near"), F.lit(0).alias("off"))
        table = index.where(F.col("value") != F.lit(own >> _PLACE)).unionByName(present)
        marked = traced.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "n_words", "w", F.explode(F.concat("marks", F.array(F.lit(own).cast("long")))).alias("e"))
        hits = marked.select("doc_id", "row", "n_words", "w", value, place).join(F.broadcast(table), "value")
        checked = hits.select("doc_id", "row", "n_words", "item_id", "width", _starts().alias("starts"))
        out = _verdict(checked, ["doc_id", "row"]).drop("row")
    else:
        row = F.xxhash64("w").alias("row")
        found = traced.select("doc_id", row, F.explode("marks").alias("e")).select("doc_id", "row", value, place).join(index, "value")
        hit = F.struct("item_id", "width", "near", "off", "place")
        found = scratch.keep(found.groupBy("doc_id", "row").agg(F.collect_set(hit).alias("hits")), "hits")
        rows = rows.select("doc_id", row, "n_words", "w")
        mine = rows.dropDuplicates(["doc_id", "row"]).join(found, ["doc_id", "row"]).select("doc_id", "row", "n_words", "w", F.explode("hits").alias("h")).select("doc_id", "row", "n_words", "w", "h.*")
        checked = mine.select("doc_id", "row", "n_words", "item_id", "width", _starts().alias("starts"))
        out = rows.select("doc_id", "row", "n_words").join(_verdict(checked, ["doc_id", "row"]).drop("n_words"), ["doc_id", "row"], "left")
        out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))
