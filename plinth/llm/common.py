"""What the corpus operators share: scratch tables, Arrow text access and vectorised hashing.

Conventions that hold for every operator of this subpackage:

* Input is a DataFrame with an integer ``doc_id`` and a string ``text``; every other column is
  ignored, whatever its name. Rows whose ``doc_id`` is null cannot be addressed and are left out.
* A null text counts as empty unless an operator says otherwise.
* Repeated rows (one ``doc_id`` several times) give one result row each; nothing is multiplied.
* Intermediate tables are Parquet in the folder that ``spark.checkpoint.dir`` names, which driver and
  executors share, so a lost executor never takes the only copy of anything.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Text bytes that one vectorised step handles at once; a longer document is one step of its own.
STEP_BYTES = 1 << 20

#: Ids up to which a counted id table is broadcast to filter texts (16 MB of ids); more are joined by shuffle.
BROADCAST_IDS = 1 << 21


def picked(rows: DataFrame, ids: DataFrame, how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows whose ``doc_id`` is among ``ids`` (or, by ``left_anti``, is not), without moving texts where ids are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= limit else ids, "doc_id", how)


def opened(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The same rows with every column but ``keep`` renamed by position, so that no name can clash."""
    return docs.toDF(*[c if c in keep else f"x{i}" for i, c in enumerate(docs.columns)])


def keyed_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, text)`` of the rows that have an id; no other column is read."""
    rows = opened(docs, (key, "text"))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))


def with_columns_of(docs: DataFrame, result: DataFrame) -> DataFrame:
    """``result`` (columns as ``opened`` names them) under the column names of ``docs``, in their order."""
    return result.select(opened(docs).columns).toDF(*docs.columns)


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Ids and texts (nulls filled) in runs of whole documents of about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + 1 + len(texts)]
        at, base, ends = 0, edges[0], edges[1:]
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield ids[at:to], texts.slice(at, to - at)
            base, at = ends[to - 1], to


def settle() -> None:
    """Give freed memory back to the system at a task's end; Python workers outlive their stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and the offset of each text in them (one more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


# --- hashing -----------------------------------------------------------------------------------

_U = np.uint64


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser: three xor-shifts and two odd multipliers, after adding a seed."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


#: Spans above so many bytes are hashed one by one.
_LONG = 512
_MULTIPLIER = _U(0x9E6C63D0876A9A47)


class SpanHash:
    """64-bit hashes of byte spans: the length, then eight bytes a turn, through a non-linear mixer.

    Every turn mixes, so unlike a polynomial's terms the bytes of a structured text cannot cancel out.
    """

    def __init__(self, seed: int):
        self.seed = seed
        self.key = seed.to_bytes(8, "little")

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mix64(size.astype(_U), self.seed + 1)
        body = np.append(data, np.zeros(8, np.uint8))
        eight = np.ndarray((len(data) + 1,), "<u8", body, strides=(1,))
        live = np.flatnonzero((size > 0) & (size <= _LONG))
        at, left, h = starts[live], size[live], out[live]
        while len(live):
            block = eight[at] & _HEADS[np.minimum(left, 8)]
            h = mix64(h ^ block, self.seed)
            done = left <= 8
            out[live[done]] = h[done]
            going = ~done
            live, at, left, h = live[going], at[going] + 8, left[going] - 8, h[going]
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=self.key).digest(), "little")
        return out


#: Masks of the first 0 to 8 bytes of a little-endian block.
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


class RunHash:
    """Hashes of every run of ``k`` consecutive values: runs double in width, each doubling mixes."""

    def __init__(self, seed: int):
        self.seed = seed

    def __call__(self, values: np.ndarray, k: int) -> np.ndarray:
        n = len(values) - k + 1
        if n <= 0:
            return np.empty(0, _U)
        run, width, done, covered = values, 1, None, 0
        while width <= k:
            if k & width:
                part = run[covered : covered + n]
                done = part if done is None else mix64(done * _MULTIPLIER + part, self.seed)
                covered += width
            if 2 * width <= k:
                run = mix64(run[:-width] * _MULTIPLIER + run[width:], self.seed)
            width *= 2
        return mix64(done, self.seed ^ k)


def digests(body: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests of byte spans, as rows of two integers; no two texts with one digest are known."""
    found = [hashlib.blake2b(body[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), _U).reshape(-1, 2)


#: The bytes 0x20 and 0x09-0x0D, which part words and frame lines.
BLANK = b" \t\n\x0b\x0c\r"
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANK)] = True
#: A-Z to a-z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every text, and the first word of each text (one more than texts)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = np.empty(n + 1, bool)
    gap[1:] = blank[data]
    gap[0] = True
    solid = ~gap[1:]
    head = gap[:-1].copy()
    inner = offsets[(offsets > 0) & (offsets < n)]
    head[inner] = True
    tail = np.empty(n, bool)
    tail[:-1] = gap[2:]
    tail[-1] = True
    tail[inner - 1] = True
    starts = np.flatnonzero(solid & head)
    ends = np.flatnonzero(solid & tail) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def task_number() -> int:
    """The number of the running partition, 0 outside a task."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and the offsets of its rows."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


#: Edges up to which one task unites them (16 MB of ids); more go through distributed rounds.
ONE_TASK_EDGES = 1 << 20


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of the task; the root of a set is its smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in list(up) if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, component)`` of an undirected edge list ``(u, v)``: the smallest node reachable, where it is another.

    A counted edge list of at most ``one_task`` edges is united in one task. Beyond that, large-star and
    small-star rewiring alternate: each round is two grouped minima and two joins over the edges, so a hub is
    pre-aggregated and its join can be split; no adjacency is ever collected. The edge table of each round is
    written, and the loop ends when its digest stops changing. Both ways give the same rows.
    """
    edges = scratch.keep(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), f"{name}0")
    if edges.count() <= one_task:
        return scratch.keep(edges.coalesce(1).mapInArrow(_united, "node long, component long"), f"{name}u")
    before = None
    turn = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("lo"), F.col("u"), F.col("v"))
        next_edges = small.select(F.explode(F.array(F.struct("lo", F.col("v").alias("hi")), F.struct("lo", F.col("u").alias("hi")))).alias("e")).select(F.col("e.lo").alias("u"), F.col("e.hi").alias("v")).where("u <> v").distinct()
        turn += 1
        edges = scratch.keep(next_edges, f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))


def bodies_of(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text."""
    data, offsets = buffers(texts)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
