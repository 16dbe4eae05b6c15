"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Sketch. ``BANDS * ROWS`` coordinates. In round ``i`` every shingle is thrown into one hashed bin with a
hashed value, and a bin keeps the smallest ``(round, value)``; from round ``t`` on, round ``i`` throws
all shingles into bin ``i - t``, so after ``2 t`` rounds no bin is empty. Rounds stop as soon as a
document has no empty bin, which for n shingles takes about ``t ln t / n`` rounds. Two documents agree in
a coordinate with probability equal to their Jaccard similarity, with Chernoff-type concentration.

Banding. ``BANDS`` bands of ``ROWS`` coordinates. At similarity 0.8 a pair shares no band with probability
``(1 - 0.8**4)**32 < 5e-8``. Documents with one and the same shingle set are one class first (128-bit set
digest), so copies never reach the bands.

Candidates. A bucket never emits all its pairs. Each bucket's hub is the member whose bands hold the most
documents in all (the text that the others were made from shares the most bands); members are verified
against it. Documents that are then still outside the largest component of a bucket are joined exactly, by
prefixes: shingles are ordered rare
first, and two sets with a link share a shingle among the first fifth of either, at places that leave room
for an intersection of ``p / (1 + p) * (n1 + n2)``. Shingles that no other document in question holds (a
compressed exchange finds them, never one too many) match nothing, so private edits use the prefix up.
No bucket, partner or prefix is capped.

Links are confirmed on full sets. Results per case: null or empty text and text without words: empty
set, linked with nothing, a component of its own; fewer words than a shingle: the whole sequence is one
shingle; very long text: whole; repeated rows: one class like any copies; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, LOWER, RunHash, Scratch, SpanHash, buffers, components, keyed_texts, list_array, mix64, picked, signed, steps, task_number, word_spans
from .exchange import shared_values

BANDS, ROWS = 32, 4
T = BANDS * ROWS
#: Shingles of one chunk of full sets, on average.
CHUNK = 1 << 19
#: Documents, shingles and pairs to compare that make one file of a scratch table worth writing; the first table follows the scan.
FILE_DOCS, FILE_SHINGLES, FILE_PAIRS = 1 << 12, 1 << 20, 1 << 12

_word, _run = SpanHash(11), RunHash(12)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text on end, and the offset of each text's set."""
    data, offsets = buffers(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = _word(data, starts, ends)
    grams = _run(words, k)
    sets, edges = [], np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            one = np.unique(grams[a : b - k + 1])
        elif b > a:
            one = _run(words[a:b], int(b - a))
        else:
            one = words[:0]
        sets.append(one)
        edges[i + 1] = edges[i] + len(one)
    return (np.concatenate(sets) if sets else words[:0]), edges


def sketches(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One row of ``T`` coordinates for each set; rows of empty sets hold no values of use."""
    n = len(edges) - 1
    out = np.full((n, T), ~_U(0))
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(edges))
    for turn in range(2 * T):
        drawn = mix64(values, 1000 + turn)
        bins = (drawn >> _U(57)).astype(np.int64) if turn < T else np.full(len(values), turn - T)
        np.minimum.at(flat, owner * T + bins, (_U(turn) << _U(56)) | (drawn & _U((1 << 56) - 1)))
        open_rows = (out == ~_U(0)).any(axis=1)
        going = open_rows[owner]
        if not going.any():
            break
        values, owner = values[going], owner[going]
    return out


def _digest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in steps(batches):
        values, edges = shingle_sets(texts, k)
        n = len(ids)
        size = np.diff(edges)
        pad = np.append(values, _U(0))
        sums = [np.where(size > 0, np.add.reduceat(mix64(pad, seed), edges[:-1]), _U(0)) for seed in (21, 22)] if n else []
        sketch = sketches(values, edges)
        bands = np.zeros((n, BANDS), _U)
        for r in range(ROWS):
            bands = mix64(bands ^ sketch[:, r::ROWS], 31 + r)
        rows = list_array(signed(bands).reshape(-1), np.arange(n + 1) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(size), pa.array(signed(sums[0])), pa.array(signed(sums[1])), rows],
            ["doc_id", "n_shingles", "f1", "f2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    chunk, held = task_number() << 20, 0
    for ids, texts in steps(batches):
        values, edges = shingle_sets(texts, k)
        if held and held + len(values) > CHUNK:
            chunk, held = chunk + 1, 0
        held += len(values)
        body = [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(body, pa.binary()), pa.array(np.full(len(ids), chunk))], ["doc_id", "body", "chunk"])


def _shared(table: pa.Table, flags: np.ndarray, percent: int) -> pa.Table:
    """The sets' sizes and those of their shingles that may be elsewhere too, where these can make a link."""
    bodies = table["body"].to_pylist()
    sizes = np.array([len(x) // 8 for x in bodies], np.int64)
    ends = np.cumsum(sizes)
    held = np.append(0, np.cumsum(flags))
    fit = np.flatnonzero((held[ends] - held[ends - sizes]) * 100 >= sizes * percent)
    values = np.frombuffer(b"".join(bodies), _U)
    parts = [values[ends[i] - sizes[i] : ends[i]][flags[ends[i] - sizes[i] : ends[i]]] for i in fit]
    edges = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)
    return pa.table({"doc_id": table["doc_id"].to_numpy()[fit], "n": sizes[fit], "tokens": list_array(signed(np.concatenate([*parts, values[:0]])), edges)})


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of ``(u, v, a, b)`` with both full sets, the pairs with 100 |A n B| >= percent |A u B|."""
    for batch in batches:
        kept = []
        for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                kept.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))], ["u", "v"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``; see the module."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = keyed_texts(docs)
    every = scratch.keep(texts.mapInArrow(lambda it: _digest(it, shingle), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "digests")
    documents, grams = every.agg(F.count("*"), F.sum("n_shingles")).first()
    scratch.files = 1 + max(documents // FILE_DOCS, (grams or 0) // FILE_SHINGLES)

    # One class for each distinct set; its bands come from any of its equal members.
    classes = scratch.keep(every.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held")), "classes")
    owner = every.where("n_shingles > 0").select("doc_id", "f1", "f2", "n_shingles")
    # Sets of more than a thousandth of all rows are fewer than a thousand: their members learn the class without a shuffle.
    hot = F.col("held") * 1000 > (classes.agg(F.sum("held")).first()[0] or 0)
    crowd = F.broadcast(classes.where(hot & (F.col("held") > 1)).select("f1", "f2", F.col("rep").alias("crowd")))
    others = classes.where(~hot & (F.col("held") > 1)).select("f1", "f2", "rep")
    owner = owner.join(crowd, ["f1", "f2"], "left")
    mates = owner.where("crowd is null").join(others, ["f1", "f2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n_shingles")
    member = mates.unionByName(owner.where("crowd is not null").select("doc_id", F.col("crowd").alias("rep"), "n_shingles"))
    member = scratch.keep(member.distinct(), "members")
    reps = every.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"]).select("doc_id", "n_shingles", "bands").dropDuplicates(["doc_id"])

    banded = reps.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "value"))
    banded = banded.select("doc_id", "n", F.xxhash64("band", "value").alias("bucket"))
    crowds = banded.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    banded = scratch.keep(banded.join(crowds, "bucket"), "banded")
    weight = banded.groupBy("doc_id").agg(F.sum("crowd").alias("weight"))
    # Members with the weight that makes a hub; only documents that share a band are left here.
    banded = scratch.keep(banded.drop("crowd").join(weight, "doc_id"), "buckets")
    scratch.drop("banded")
    suspects = scratch.keep(banded.select("doc_id").distinct(), "suspects")
    bodies = scratch.keep(picked(texts, suspects).mapInArrow(lambda it: _sets(it, shingle), "doc_id long, body binary, chunk long").dropDuplicates(["doc_id"]), "sets")

    def verify(pairs: DataFrame, most: int, name: str) -> DataFrame:
        """The links among ``pairs``, of which there are at most ``most``."""
        left = bodies.select(F.col("doc_id").alias("u"), F.col("body").alias("a"))
        right = bodies.select(F.col("doc_id").alias("v"), F.col("body").alias("b"))
        full = pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b")
        return scratch.keep(full.mapInArrow(lambda it: _verified(it, percent), "u long, v long"), name, max(scratch.files, 1 + most // FILE_PAIRS))

    fits = (F.col("n") * 100 >= F.col("hub.n") * percent) & (F.col("hub.n") * 100 >= F.col("n") * percent)

    def star(rows: DataFrame) -> DataFrame:
        hub = rows.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "n", "part"), F.struct("weight", -F.col("doc_id"))).alias("hub"))
        return rows.join(hub, "bucket").where(fits & (F.col("part") != F.col("hub.part"))).select(F.col("hub.doc_id").alias("u"), F.col("doc_id").alias("v")).distinct()

    first = verify(star(banded.withColumn("part", F.col("doc_id"))), banded.count(), "star1")
    labels = components(first, scratch, "c1")

    def labelled(found: DataFrame) -> DataFrame:
        return banded.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")

    def split(rows: DataFrame) -> DataFrame:
        torn = rows.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")
        return rows.join(torn, "bucket")

    # Whatever is still apart in a bucket: an exact prefix join of what stands outside its largest component.
    torn = scratch.keep(split(labelled(labels)), "torn")
    asked = bodies.join(torn.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = scratch.keep(asked, "asked")
    amount = asked.agg(F.sum(F.octet_length("body") / 8).cast("long")).first()[0] or 0
    bits = min(60, max(12, amount.bit_length() + 8))
    shift = _U(64 - bits)

    def shingles(table: pa.Table) -> list[np.ndarray]:
        return [(np.frombuffer(b"".join(table["body"].to_pylist()), _U) >> shift).astype(np.int64)]

    held = shared_values(asked, shingles, bits, max(4, (amount >> 20).bit_length()), lambda t, f: _shared(t, f, percent), "doc_id long, n long, tokens array<long>")
    held = scratch.keep(held, "held")
    each = held.select("doc_id", "n", F.explode("tokens").alias("t"))
    rarity = each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    ordered = each.join(rarity, "t").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    # Place of the i-th shared shingle: all unshared ones stand before it. A link needs a shared one by n - percent of n.
    ordered = ordered.withColumn("skip", F.col("n") - F.size("o")).withColumn("reach", F.floor(F.size("o") - F.col("n") * percent / 100).cast("int") + 1).where("reach > 0")
    prefix = ordered.select("doc_id", "n", "skip", F.posexplode(F.slice("o", F.lit(1), F.col("reach"))).alias("i", "e")).select("doc_id", "n", (F.col("n") - F.col("skip") - F.col("i")).alias("left"), F.col("e.t").alias("t"))
    prefix = prefix.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    prefix = scratch.keep(prefix, "prefix")
    parts = torn.groupBy("bucket", "part").agg(F.count("*").alias("m"))
    main = parts.groupBy("bucket").agg(F.max_by("part", F.struct("m", -F.col("part"))).alias("main"))
    outside = torn.join(main, "bucket").where("part <> main").select("doc_id").distinct()
    ours = prefix.join(outside, "doc_id", "left_semi").withColumnsRenamed({"doc_id": "x", "n": "m", "left": "rest", "part": "other"})
    near = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent) & (F.least("left", "rest") * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
    pairs = prefix.join(ours, "t").where(near & (F.col("part") != F.col("other"))).select(F.least("doc_id", "x").alias("u"), F.greatest("doc_id", "x").alias("v")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    third = verify(pairs, pairs.count(), "rest")
    labels = components(first.unionByName(third), scratch, "c2") if not third.isEmpty() else labels

    final = member.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component"))
    final = final.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = every.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"))
    return out.coalesce(scratch.files)
