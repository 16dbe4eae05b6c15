"""Byte-balanced shards by Karmarkar-Karp differencing over indivisible groups of equal texts.

Equal texts form one group with the sum of their sizes. Groups are dealt to buckets by digest, each of
bounded size, and differenced there: a partial partition is a vector of ``shards`` sums; the two with the
largest spread (largest less smallest sum) are combined oppositely ordered - largest onto smallest - until
one is left. A bucket then is one partial partition, and the same rule combines the buckets' vectors, whose
number a parameter bounds; that last step sees ``buckets * shards`` numbers on the driver, never a row.

A document's slot is its place in its shard: chunk offsets (prefix sums over chunks of bounded size) plus
its place in the chunk. The law is ``bytes``: sizes near equal, groups whole, so a group that outweighs the
mean shard makes that shard the largest, by necessity.

Cases: null text counts as empty (size 1); texts that are empty are one group; fewer groups than shards
leave shards empty; repeated rows are rows of one group, each with a slot; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, opened

#: Groups that one bucket holds on average, and the most buckets there are.
BUCKET = 20_000
MOST_BUCKETS = 8_192
#: Rows of one slot-numbering chunk, on average.
CHUNK = 20_000


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine rows of ``(n, k)`` sums to one; gives the sums, and where each row's parts went, ``(n, k)``."""
    n, k = vectors.shape
    sums = [tuple(v) for v in vectors.tolist()]
    kids: list[tuple[int, int, list[int], list[int]] | None] = [None] * n
    heap = [(min(v) - max(v), i) for i, v in enumerate(sums)]
    heapq.heapify(heap)
    places = range(k)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        down = sorted(places, key=x.__getitem__, reverse=True)
        up = sorted(places, key=y.__getitem__)
        both = tuple([x[i] + y[j] for i, j in zip(down, up, strict=True)])
        sums.append(both)
        kids.append((a, b, down, up))
        heapq.heappush(heap, (min(both) - max(both), len(sums) - 1))
    went: list[list[int] | None] = [None] * len(sums)
    went[-1] = list(places)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, down, up = kids[node]
        to = went[node]
        at, other = [0] * k, [0] * k
        for place in places:
            at[down[place]] = to[place]
            other[up[place]] = to[place]
        went[a], went[b], went[node] = at, other, None
    return np.array(sums[-1], np.int64), np.array(went[:n], np.int64)


def _bucket(table: pa.Table, shards: int) -> pa.Table:
    weights = table["weight"].to_numpy()
    vectors = np.zeros((len(weights), shards), np.int64)
    vectors[:, 0] = weights
    sums, went = difference(vectors)
    return table.append_column("part", pa.array(went[:, 0])).append_column("load", pa.array(sums[went[:, 0]]))


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = opened(docs).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = scratch.keep(rows, "rows")

    groups = rows.groupBy("sha").agg(F.sum("size").alias("weight"))
    groups = scratch.keep(groups, "groups")
    buckets = min(MOST_BUCKETS, max(1, -(-groups.count() // BUCKET)))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(buckets)).cast("int"))
    placed = scratch.keep(groups.groupBy("bucket").applyInArrow(lambda t: _bucket(t, shards), "sha binary, weight long, bucket int, part long, load long"), "placed")

    # At most MOST_BUCKETS vectors of ``shards`` sums.
    loads = placed.groupBy("bucket", "part").agg(F.max("load").alias("load")).toPandas()
    vectors = np.zeros((buckets, shards), np.int64)
    vectors[loads["bucket"], loads["part"]] = loads["load"]
    _, went = difference(vectors)
    plan = spark.createDataFrame([(b, p, int(went[b, p])) for b in range(buckets) for p in range(shards)], "bucket int, part long, shard int")
    where = placed.join(F.broadcast(plan), ["bucket", "part"]).select("sha", "shard")

    # Slots: chunks by id, so that a hot group is spread over all chunks.
    chunks = max(16, -(-rows.count() // CHUNK))
    dealt = rows.join(where, "sha").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    dealt = scratch.keep(dealt.drop("sha"), "dealt")
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32")
    out = dealt.withColumn("place", F.row_number().over(inside)).join(counts, ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
