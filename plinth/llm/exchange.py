"""Which values do two senders share? A compressed exchange between chunks (senders) and value ranges (owners).

Every sender gives each owner one sorted, distinct, Golomb-coded list; owners answer with one bitmap per
list: the values that another sender gave too. A value that a sender holds several times is known to it.
Traffic is a few bits a value each way, and a value that fills a chunk is sent once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import golomb

#: Gives, for one chunk, an array of values in [0, 2**bits) for each of one or more rows of values.
Extract = Callable[[pa.Table], list[np.ndarray]]


def _edges(values: np.ndarray, bits: int, owner_bits: int) -> np.ndarray:
    return np.searchsorted(values >> (bits - owner_bits), np.arange((1 << owner_bits) + 1))


def _messages(table: pa.Table, extract: Extract, bits: int, owner_bits: int) -> pa.Table:
    owners, codes = [], []
    mask = (1 << (bits - owner_bits)) - 1
    for row, found in enumerate(extract(table)):
        values = np.unique(found)
        edges = _edges(values, bits, owner_bits)
        for o in np.flatnonzero(np.diff(edges)).tolist():
            owners.append((row << owner_bits) + o)
            codes.append(golomb.encode(values[edges[o] : edges[o + 1]] & mask))
    chunk = table["chunk"][0].as_py() if table.num_rows else 0
    return pa.table({"chunk": pa.array([chunk] * len(owners), pa.int64()), "owner": pa.array(owners, pa.int64()), "code": pa.array(codes, pa.binary())})


def _answers(table: pa.Table) -> pa.Table:
    sent = [golomb.decode(x) for x in table["code"].to_pylist()]
    every = np.sort(np.concatenate(sent))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    bitmaps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in sent]
    return pa.table({"chunk": table["chunk"], "owner": table["owner"], "bitmap": pa.array(bitmaps, pa.binary())})


def _flags(table: pa.Table, answers: pa.Table, extract: Extract, bits: int, owner_bits: int) -> np.ndarray:
    """For each value, whether every one of its rows was given twice."""
    by_owner = dict(zip(answers["owner"].to_pylist(), answers["bitmap"].to_pylist(), strict=True))
    out = None
    for row, found in enumerate(extract(table)):
        distinct, place, count = np.unique(found, return_inverse=True, return_counts=True)
        flags = count > 1
        edges = _edges(distinct, bits, owner_bits)
        for o in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[o], edges[o + 1]
            flags[a:b] |= np.unpackbits(np.frombuffer(by_owner[(row << owner_bits) + o], np.uint8), count=int(b - a)).astype(bool)
        out = flags[place] if out is None else out & flags[place]
    return out if out is not None else np.empty(0, bool)


def shared_values(rows: DataFrame, extract: Extract, bits: int, owner_bits: int, emit: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``emit(chunk rows, flags)`` of every chunk; ``rows`` is a written table with a ``chunk`` column."""
    messages = rows.groupBy("chunk").applyInArrow(lambda t: _messages(t, extract, bits, owner_bits), "chunk long, owner long, code binary")
    answers = messages.groupBy("owner").applyInArrow(_answers, "chunk long, owner long, bitmap binary")

    def close(table: pa.Table, given: pa.Table) -> pa.Table:
        return emit(table, _flags(table, given, extract, bits, owner_bits))

    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(close, schema)
