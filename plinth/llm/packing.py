"""Best-fit packing of token sequences by a linear grouping scheme over the histogram of lengths.

Every length is at most the capacity, so the lengths of any corpus are a histogram of at most ``capacity``
counts: planning is bounded whatever the corpus, and only numbering is distributed.

1. Pieces are tokenised, cut and numbered within (chunk, length); prefix sums give each its rank among all
   pieces of its length.
2. Plan, on the histogram. Large lengths are split into groups of equal cardinality and rounded up to
   their group's largest; a configuration program (column generation, knapsack pricing) finds how often
   to use each configuration of the few rounded sizes; its floor is used. Actual lengths replace the
   rounded ones, which leaves runs of equal bins; what is left over and all small lengths go best-fit,
   longest first, a run of bins at a time. The number of groups with the fewest bins is taken.
3. The plan is a table of segments: ranks [r, r + n) of a length go to sequences [s, s + n) at one offset.
   Its size depends on the capacity only; pieces look theirs up.

Cases: null and empty texts are one end token; longer than the capacity is cut, all but the last piece
full; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bodies_of, keyed_texts, steps, task_number
from .tokens import encoder, vocabulary

CHUNK = 1 << 16
#: Lengths above capacity / SMALL are large.
SMALL = 8
GROUPS = (8, 16, 32, 64)


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    words = encoder(vocabulary(path))
    encode = words.encode
    close = np.array([end], "<u4").tobytes()
    chunk, held, seen = task_number() << 20, 0, np.zeros(capacity + 1, np.int64)
    try:
        for ids, texts in steps(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, body in zip(ids.tolist(), encode(bodies_of(texts)), strict=True):
                whole = memoryview(body + close)
                for piece, begin in enumerate(range(0, len(whole) // 4, capacity)):
                    part = whole[4 * begin : 4 * (begin + capacity)]
                    rows.append((doc, piece, begin, len(part) // 4, zlib.crc32(part)))
            table = np.array(rows, np.int64).reshape(-1, 5)
            lengths = table[:, 3]
            if held and held + len(rows) > CHUNK:
                chunk, held = chunk + 1, 0
                seen[:] = 0
            held += len(rows)
            order = np.argsort(lengths, kind="stable")
            run = lengths[order]
            nth = np.empty(len(run), np.int64)
            nth[order] = np.arange(len(run)) - np.searchsorted(run, run) + seen[run]
            seen += np.bincount(lengths, minlength=capacity + 1)
            columns = [pa.array(table[:, i]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.int32()), *columns[2:], pa.array(np.full(len(rows), chunk)), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"])
    finally:
        words.rest()


def configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of few sizes and how often to use each whole: the floor of the program's optimum."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    amount = demand / np.diag(basis)
    for _ in range(40 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        best = np.zeros(capacity + 1)
        choices = []
        for _layer in range(capacity // min(sizes)):
            value, choice = best.copy(), np.full(capacity + 1, -1)
            for i, s in enumerate(sizes):
                with_it = best[:-s] + prices[i]
                better = with_it > value[s:] + 1e-12
                value[s:][better] = with_it[better]
                choice[s:][better] = i
            if (choice < 0).all():
                break
            best = value
            choices.append(choice)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for choice in reversed(choices):
            if (i := choice[room]) >= 0:
                column[i] += 1
                room -= sizes[i]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = amount - step * ratio[out]
        amount[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, j].astype(int), int(amount[j] + 1e-9)) for j in range(k) if amount[j] >= 1]


class Plan:
    """Runs of equal bins and the segments that fill them."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        self.capacity, self.left, self.rank = capacity, histogram.copy(), np.zeros(len(histogram), np.int64)
        self.bins = 0
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def put(self, length: int, count: int, first: int, used: int) -> None:
        self.segments.append((length, int(self.rank[length]), count, first, used))
        self.rank[length] += count
        self.left[length] -= count

    def release(self, first: int, count: int, used: int) -> None:
        room = self.capacity - used
        if room and count:
            self.open.setdefault(room, []).append((first, count))

    def configured(self, groups: int) -> None:
        lengths = np.arange(len(self.left))
        large = lengths[(lengths > self.capacity // SMALL) & (lengths < self.capacity) & (self.left > 0)][::-1]
        total = int(self.left[large].sum())
        groups = min(groups, len(large))
        if not groups or total < 4 * groups:
            return
        # Runs (length, count) of each group, longest first, groups of equal cardinality.
        members: list[list[list[int]]] = [[] for _ in range(groups)]
        edges = [total * (g + 1) // groups for g in range(groups)]
        done = g = 0
        for length in large.tolist():
            count = int(self.left[length])
            while count:
                take = min(count, edges[g] - done)
                if take:
                    members[g].append([length, take])
                count, done = count - take, done + take
                if done == edges[g] and g < groups - 1:
                    g += 1
        members = [m for m in members if m]
        sizes = [m[0][0] for m in members]
        demand = np.array([sum(c for _, c in m) for m in members], float)
        for column, times in configurations(sizes, demand, self.capacity):
            slots = [i for i, c in enumerate(column) for _ in range(int(c))]
            taken = []
            for i in slots:
                run, need = [], times
                while need and members[i]:
                    length, have = members[i][0]
                    use = min(have, need)
                    run.append((length, use))
                    need -= use
                    members[i][0][1] -= use
                    if not members[i][0][1]:
                        members[i].pop(0)
                taken.append(run)
            # Bins of the configuration, cut where any slot's actual length changes.
            cuts = sorted({0, times, *(int(c) for run in taken for c in np.cumsum([n for _, n in run]))})
            where = [0] * len(taken)
            spent = [0] * len(taken)
            for a, b in zip(cuts, cuts[1:], strict=False):
                used = 0
                for s, run in enumerate(taken):
                    if where[s] < len(run):
                        length, have = run[where[s]]
                        self.put(length, b - a, self.bins + a, used)
                        used += length
                        spent[s] += b - a
                        if spent[s] == have:
                            where[s], spent[s] = where[s] + 1, 0
                self.release(self.bins + a, b - a, used)
            self.bins += times

    def best_fit(self) -> None:
        """All that is left, longest first, into the fullest bins that hold it."""
        rooms = sorted(self.open)
        for length in range(len(self.left) - 1, 0, -1):
            while self.left[length]:
                i = bisect.bisect_left(rooms, length)
                need = int(self.left[length])
                if i == len(rooms):
                    each = self.capacity // length
                    full, rest = divmod(need, each)
                    for count, copies in ((full, each), (1 if rest else 0, rest)):
                        if count:
                            for c in range(copies):
                                self.put(length, count, self.bins, c * length)
                            self._shelve(rooms, self.bins, count, copies * length)
                            self.bins += count
                    break
                room = rooms[i]
                first, count = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                    rooms.pop(i)
                use = min(count, need)
                used = self.capacity - room
                self.put(length, use, first, used)
                self._shelve(rooms, first, use, used + length)
                if use < count:
                    self._shelve(rooms, first + use, count - use, used)

    def _shelve(self, rooms: list[int], first: int, count: int, used: int) -> None:
        room = self.capacity - used
        if room:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(rooms, room)
            self.open[room].append((first, count))


def plan(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Segments ``(length, rank, count, sequence, offset)``, ordered by length and rank."""
    best = None
    for groups in GROUPS:
        one = Plan(histogram, capacity)
        one.configured(groups)
        one.best_fit()
        if best is None or one.bins < best.bins:
            best = one
    out = np.array(best.segments, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _placed(batches: Iterator[pa.RecordBatch], segments: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (segments[:, 0] << 48) + segments[:, 1]
    for batch in batches:
        lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        at = np.searchsorted(keys, (lengths << 48) + ranks, "right") - 1
        found = segments[at]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found[:, 3] + ranks - found[:, 1]), pa.array(found[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def packed_sequences(docs: DataFrame, capacity: int = 4096, end: int = 1, vocabulary_path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece; see the module."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = keyed_texts(docs).mapInArrow(lambda it: _pieces(it, vocabulary_path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long")
    pieces = scratch.keep(pieces, "pieces")
    counts = scratch.keep(pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))  # bounded by the capacity
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(lambda it: _placed(it, shared.value), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
