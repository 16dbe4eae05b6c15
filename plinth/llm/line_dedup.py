"""Repeated lines: a sharded minimal perfect hash over the distinct line hashes, probed by documents.

1. Documents give the 128-bit digests of their line keys (BLAKE2b; no two keys with one digest are known), in
   chunks of bounded size. A chunk sends each shard its distinct keys with their smallest and largest document.
2. A shard is a minimal perfect hash (levels of bit arrays: a key sits in the first level where it is alone; its
   slot is the rank of its bit) over all its distinct keys, which indexes three flat arrays: fingerprint, count
   (of documents, saturating at two) and smallest document.
3. Chunks probe the shards with the packed keys they hold; each shard is read once and answers a chunk with those
   of its keys whose count is two. A line that fills a third of all rows is one key in a chunk's probe and one in
   its answer, so no group grows with it; lines themselves are never grouped or joined.
4. A chunk's documents lose the answered keys that belong to a smaller document; only then are texts cut.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; it counts from
``least`` code points on. Cases: null or empty text is one empty line; a text may become empty; very long
texts are whole; repeated rows of one ``doc_id`` are one document for counting and each gets its row; an
empty table gives an empty result; other columns pass through ``without_repeated_lines`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BLANK, _U, LOWER, Scratch, bodies_of, buffers, digests, keyed_texts, list_array, mix64, opened, signed, steps, task_number

#: Keys of one shard, and line keys of one chunk, on average.
SHARD, CHUNK = 1 << 18, 1 << 18


def line_keys(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line of each text (one more than texts), which lines are long enough, and the digests of those."""
    data, offsets = buffers(texts)
    data = LOWER[data]
    stops = np.flatnonzero(data == 10)
    # The end of a text ends a line too; ends are sorted, and a text's own end comes after its newlines.
    ends = np.concatenate([stops, offsets[1:]])
    text_of = np.concatenate([np.searchsorted(offsets, stops, "right") - 1, np.arange(len(texts))])
    order = np.lexsort((np.arange(len(ends)), text_of))
    ends, text_of = ends[order], text_of[order]
    first = np.searchsorted(text_of, np.arange(len(texts) + 1))
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[first[:-1]] = offsets[:-1]
    solid = np.flatnonzero(~_BLANK[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    filled = b > a
    pad = np.append(solid, len(data))
    lo = np.where(filled, pad[a], starts)
    hi = np.where(filled, pad[np.maximum(b, 1) - 1] + 1, starts)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[hi] - points[lo] >= least
    return first, long, digests(data.tobytes(), lo[long], hi[long])


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Each document's distinct line keys, as pairs on end, and its chunk."""
    chunk, held = task_number() << 32, 0
    for ids, texts in steps(batches):
        first, long, keys = line_keys(texts, least)
        owner = np.repeat(np.arange(len(ids)), np.diff(first))[long]
        order = np.lexsort((keys[:, 1], keys[:, 0], owner))
        owner, keys = owner[order], keys[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)
        owner, keys = owner[new], keys[new]
        edges = np.searchsorted(owner, np.arange(len(ids) + 1))
        if held and held + len(keys) > CHUNK:
            chunk, held = chunk + 1, 0
        held += len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(ids), list_array(signed(keys).reshape(-1), 2 * edges), pa.array(np.full(len(ids), chunk))], ["doc_id", "keys", "chunk"])


def _pairs(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all rows of a list column, and how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().view(_U).reshape(-1, 2), np.diff(column.offsets.to_numpy()) // 2


def _sorted(keys: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys in order with whatever goes along, and where each distinct key begins."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    heads = np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]).any(axis=1)))
    return keys, *(x[order] for x in rest), heads


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 1] % _U(shards)).astype(np.int64)


def _messages(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """For each chunk and shard the chunk's distinct keys with their smallest and largest documents."""

    def message(chunk: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, ids, heads = _sorted(keys, ids)
        low, high, keys = np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads), keys[heads]
        shard = _shard_of(keys, shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        used = np.flatnonzero(np.diff(edges))
        cut = [[x[order[edges[s] : edges[s + 1]]].tobytes() for s in used] for x in (keys, low, high)]
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), chunk)), *(pa.array(x, pa.binary()) for x in cut)], ["shard", "chunk", "keys", "low", "high"])

    now, held = None, []
    for batch in batches:
        for chunk in np.unique(batch.column(2).to_numpy()).tolist():
            part = batch.filter(pa.compute.equal(batch.column(2), chunk))
            keys, counts = _pairs(part.column(1))
            if now != chunk and held:
                yield message(now, held)
                held = []
            now = chunk
            if len(keys):
                held.append((np.repeat(part.column(0).to_numpy(), counts), keys))
    if held:
        yield message(now, held)


def _slot_in(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys[:, 0] ^ mix64(keys[:, 1], 900 + level), 500 + level) % _U(size)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all levels' bits on end, and the slot of each key; keys are distinct."""
    sizes, levels = [], []
    slots, left, base = np.full(len(keys), -1), np.arange(len(keys)), 0
    while len(left):
        size = max(8, 3 * len(left) // 2)
        at = _slot_in(keys[left], len(sizes), size)
        count = np.bincount(at, minlength=size)
        alone = count[at] == 1
        bits = count == 1
        rank = np.cumsum(bits) - 1
        slots[left[alone]] = base + rank[at[alone]]
        base += int(bits.sum())
        sizes.append(size)
        levels.append(bits)
        left = left[~alone]
    return sizes, (np.concatenate(levels) if levels else np.zeros(0, bool)), slots


def find_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level holds it."""
    rank = np.cumsum(bits) - 1
    found, left, begin = np.full(len(keys), -1), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = begin + _slot_in(keys[left], level, size)
        hit = bits[at]
        found[left[hit]] = rank[at[hit]]
        left, begin = left[~hit], begin + size
    return found


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, list[int]]:
    bodies = column.to_pylist()
    return np.frombuffer(b"".join(bodies), kind), [len(x) for x in bodies]


def _shard(table: pa.Table) -> pa.Table:
    keys = _flat(table["keys"], _U)[0].reshape(-1, 2)
    keys, low, high, heads = _sorted(keys, _flat(table["low"], np.int64)[0], _flat(table["high"], np.int64)[0])
    low, high, keys = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), keys[heads]
    sizes, bits, slots = build_index(keys)
    prints, counts, owners = np.zeros(len(keys), _U), np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.int64)
    prints[slots], counts[slots], owners[slots] = keys[:, 0], np.where(low < high, 2, 1), low
    return pa.table({
        "shard": table["shard"][:1], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        "prints": pa.array([prints.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "owners": pa.array([owners.tobytes()], pa.binary()),
    })


def _probed(probes: pa.Table, index: pa.Table) -> pa.Table:
    """For each chunk its keys whose count is two, and the smallest document of each."""
    row = {c: index[c][0].as_py() for c in index.column_names}
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
    prints, counts, owners = np.frombuffer(row["prints"], _U), np.frombuffer(row["counts"], np.uint8), np.frombuffer(row["owners"], np.int64)
    keys, sizes = _flat(probes["keys"], _U)
    keys = keys.reshape(-1, 2)
    slot = find_slots(keys, row["sizes"], bits)
    hit = (slot >= 0) & (prints[slot] == keys[:, 0]) & (counts[slot] > 1)
    edges = np.append(0, np.cumsum(sizes)) // 16
    held = np.append(0, np.cumsum(hit))[edges]
    some = np.flatnonzero(np.diff(held))
    found, owner = keys[hit], owners[slot[hit]]
    cut = [[x[held[i] : held[i + 1]].tobytes() for i in some] for x in (found, owner)]
    return pa.table({"chunk": probes["chunk"].to_numpy()[some], "keys": pa.array(cut[0], pa.binary()), "owners": pa.array(cut[1], pa.binary())})


def _lost(lines: pa.Table, answers: pa.Table) -> pa.Table:
    """The first halves of the keys that each document of a chunk loses."""
    keys, counts = _pairs(lines["keys"])
    known = _flat(answers["keys"], _U)[0].reshape(-1, 2)
    known, owners, _ = _sorted(known, _flat(answers["owners"], np.int64)[0])
    row = np.repeat(np.arange(len(counts)), counts)
    ids = lines["doc_id"].to_numpy()
    if not len(known):
        return pa.table({"doc_id": ids[:0], "gone": list_array(np.empty(0, np.int64), np.zeros(1, np.int64))})
    # A chunk's answers are of distinct keys; equal first halves stand together, and all of them are tried.
    at = np.searchsorted(known[:, 0], keys[:, 0])
    owner = np.full(len(keys), -1)
    found = np.zeros(len(keys), bool)
    going = np.flatnonzero(at < len(known))
    while len(going):
        same = known[at[going], 0] == keys[going, 0]
        going = going[same]
        hit = going[known[at[going], 1] == keys[going, 1]]
        owner[hit], found[hit] = owners[at[hit]], True
        at[going] += 1
        going = going[~found[going] & (at[going] < len(known))]
    gone = found & (owner != ids[row])
    some, begin = np.unique(row[gone], return_index=True)
    return pa.table({"doc_id": ids[some], "gone": list_array(signed(keys[gone, 0]), np.append(begin, gone.sum()))})


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of ``(doc_id, text, gone, ...)``: the text without its lost lines, and how many lines it had and lost."""
    for batch in batches:
        at = 0
        for ids, texts in steps(iter([batch])):
            part = batch.slice(at, len(ids))
            at += len(ids)
            gone = part.column(2)
            bodies = bodies_of(texts)
            n_lines = np.array([x.count(b"\n") + 1 for x in bodies])
            n_dropped = np.zeros(len(ids), np.int64)
            hit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                first, long, keys = line_keys(texts.take(pa.array(hit)), least)
                half = np.zeros(len(long), np.int64)
                half[long] = signed(keys[:, 0])
                for j, i in enumerate(hit):
                    lines = bodies[i].split(b"\n")
                    lost = long[first[j] : first[j + 1]] & np.isin(half[first[j] : first[j + 1]], gone[int(i)].values.to_numpy())
                    bodies[i] = b"\n".join(x for x, dead in zip(lines, lost.tolist(), strict=True) if not dead)
                    n_dropped[i] = lost.sum()
            text = pa.array(bodies, pa.binary()).cast(pa.string())
            if part.column(1).null_count:
                text = pa.compute.if_else(part.column(1).is_valid(), text, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), text, *part.columns[3:], pa.array(n_lines), pa.array(n_dropped)], ["doc_id", "text", *part.schema.names[3:], "n_lines", "n_dropped"])


def lost_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``(doc_id, gone)``: the key hashes that each document loses; documents that lose none are not in it."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(keyed_texts(docs).mapInArrow(lambda it: _lines(it, least), "doc_id long, keys array<long>, chunk long"), "lines")
    total = lines.agg(F.sum(F.size("keys"))).first()[0] or 0
    shards = max(1, -(-total // (2 * SHARD)))
    messages = lines.where(F.size("keys") > 0).mapInArrow(lambda it: _messages(it, shards), "shard long, chunk long, keys binary, low binary, high binary")
    messages = scratch.keep(messages, "messages")
    index = messages.drop("chunk").groupBy("shard").applyInArrow(_shard, "shard long, sizes array<long>, bits binary, prints binary, counts binary, owners binary")
    index = scratch.keep(index, "index")
    probes = messages.select("shard", "chunk", "keys")
    answers = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probed, "chunk long, keys binary, owners binary")
    answers = scratch.keep(answers, "answers")
    gone = lines.where(F.size("keys") > 0).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_lost, "doc_id long, gone array<long>")
    # Repeated rows of one document, with unlike texts perhaps, lose what any of them loses.
    return scratch.keep(gone.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "gone")


def without_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """Every row of ``docs`` (columns as ``opened`` names them) with the kept lines, ``n_lines`` and ``n_dropped``."""
    gone = lost_lines(docs, least)
    rows = opened(docs).where(F.col("doc_id").isNotNull())
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    wide = rows.join(gone, "doc_id", "left").select("doc_id", "text", "gone", *rest)
    kinds = dict(rows.dtypes)
    schema = ", ".join(["doc_id long", "text string", *(f"`{c}` {kinds[c]}" for c in rest), "n_lines long", "n_dropped long"])
    return wide.mapInArrow(lambda it: _cut(it, least), schema)
