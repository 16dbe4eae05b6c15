"""Exact duplicates by a Golomb-coded fingerprint exchange.

1. Every document gets the SHA-256 of its normalised text; a written table holds ids and digests in
   chunks of bounded size (the senders).
2. Each sender truncates its fingerprints to ``log2(N) + 8`` bits, splits them by owner (top bits) and
   sends each owner one sorted, distinct, Golomb-coded list. Values that a sender holds twice are marked
   at the sender, so a text that fills a third of all rows is one value per sender.
3. Owners find the values that two senders sent and answer each message with a bitmap.
4. Suspects (about 1/256 of the unique documents, and every duplicate) alone have their texts shuffled,
   and are grouped by digest *and text*, which verifies equality byte by byte with map-side combining.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space. Of equal texts
the smallest ``doc_id`` stays. Cases: null counts as empty; empty texts are equal to one another; very
long texts are whole; repeated rows count in ``group_size`` and each gets its row; no rows, no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, Scratch, bodies_of, keyed_texts, steps, task_number
from .exchange import shared_values

CHUNK = 1 << 16
OWNER = 1 << 20


def normalised(body: bytes) -> bytes:
    words = body.split()
    if not words:
        return b" " if body else b""
    return (b" " if body[0] in BLANK else b"") + b" ".join(words) + (b" " if body[-1] in BLANK else b"")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, held = task_number() << 20, 0
    for ids, texts in steps(batches):
        digests = [hashlib.sha256(normalised(x)).digest() for x in bodies_of(texts)]
        if held + len(ids) > CHUNK and held:
            chunk, held = chunk + 1, 0
        held += len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(digests, pa.binary()), pa.array(np.full(len(ids), chunk))], ["doc_id", "sha", "chunk"])


def _values(shas: pa.ChunkedArray, bits: int) -> np.ndarray:
    body = b"".join(x[:8] for x in shas.to_pylist())
    return (np.frombuffer(body, ">u8").astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _suspects(table: pa.Table, flags: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": table["doc_id"].to_numpy()[flags]})


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``; see the module."""
    scratch = Scratch(docs.sparkSession, "exact")
    texts = keyed_texts(docs)
    prints = scratch.keep(texts.mapInArrow(_fingerprints, "doc_id long, sha binary, chunk long"), "prints")
    total = prints.count()
    bits = min(60, max(1, total).bit_length() + 8)
    owner_bits = max(4, (total // OWNER).bit_length())

    suspects = shared_values(prints, lambda t: [_values(t["sha"], bits)], bits, owner_bits, _suspects, "doc_id long")
    suspects = scratch.keep(suspects.distinct(), "suspects")

    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\u000B\f\r]+", " ")
    shuffled = texts.join(suspects, "doc_id", "left_semi").select("doc_id", plain.alias("plain"))
    groups = shuffled.groupBy("plain").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size")).where("size > 1")
    groups = scratch.keep(groups.select(F.unhex(F.sha2("plain", 256)).alias("sha"), "keep_id", "size"), "groups")

    out = prints.join(groups, "sha", "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), (keep_id == F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
