"""Repeated passages: a count-min prefilter, then exact grouping of the windows estimated repeated.

A window is 20 consecutive words. Of its eleven 10-word runs, the one with the smallest hash is its anchor;
equal windows have equal anchors at one relative place, so a window repeats only if its anchor does.

1. One pass keeps each text's anchors (about one for six words), in chunks of bounded size. Texts of equal
   word sequences are one: all but the smallest ``doc_id`` repeat wholly.
2. Each chunk's count-min sketch (two rows; width four to eight cells an anchor of the whole corpus, so that
   the filter is as sharp at any size) travels sparsely, as sorted Golomb-coded cells, to the owners of cell
   ranges, who merge the sketches and answer which cells count two or more. The estimate is never too low,
   so no repeated window is lost; a window passes wrongly in a few cases of a hundred.
3. The words of windows that pass are digested to 128 bits (BLAKE2b; no two texts with one digest are known).
   Every task puts its windows in order and marks what repeats within it; only the first of each goes on to
   its anchor's owner, so a passage in a third of all rows is one row a task. There, in order of document and
   start, each window after its first is removed.
4. Words covered by removed windows go; windows are judged on the input, never on what is left.

Cases: null, empty, or fewer than 20 words: nothing is removed; very long texts are whole; repeated rows of
one ``doc_id`` give a row each, and one place of a document never repeats itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BLANK, _U, RunHash, Scratch, SpanHash, bodies_of, buffers, digests, keyed_texts, list_array, mix64, signed, steps, task_number, word_spans
from .exchange import shared_values

#: Anchors of one chunk, and cells that one owner merges, on average.
CHUNK, OWNER = 1 << 19, 1 << 20

_word, _runs = SpanHash(61), RunHash(63)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every run of ``width`` values, by doubling."""
    span, out = 1, x
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = pick(out[: len(x) - width + 1], out[width - span :][: len(x) - width + 1])
    return out


class Windows:
    """The windows of a step's texts: where they may start, their anchors, and the anchors' places."""

    def __init__(self, texts: pa.Array, window: int):
        self.window, self.k = window, (window + 1) // 2
        self.data, offsets = buffers(texts)
        self.starts, self.ends, self.first = word_spans(self.data, offsets)
        n = len(self.starts)
        self.anchor = self.valid = None
        if n < window:
            self.text_of = np.empty(0, np.int64)
            return
        counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(counts)), counts)
        m = n - window + 1
        self.valid = self.text_of[:m] == self.text_of[window - 1 :]
        self.grams = _runs(_word(self.data, self.starts, self.ends), self.k)
        self.anchor = _sliding(self.grams, window - self.k + 1, np.minimum)

    def digested(self, picked: np.ndarray) -> np.ndarray:
        """128-bit digests of the words, parted by one space, of the windows that start at these words."""
        size = self.ends - self.starts
        body = np.full(int(size.sum()) + len(size), 32, np.uint8)
        solid = np.flatnonzero(~_BLANK[self.data])
        body[np.arange(len(solid)) + np.repeat(np.arange(len(size)), size)] = self.data[solid]
        begin = np.cumsum(size + 1) - size - 1
        last = picked + self.window - 1
        return digests(body.tobytes(), begin[picked], begin[last] + size[last])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor values in place order, and the text of each."""
        if self.anchor is None or not self.valid.any():
            return np.empty(0, _U), np.empty(0, np.int64)
        reach = self.window - self.k
        low = np.where(self.valid, self.anchor, _U(0))
        pad = np.concatenate([np.zeros(reach, _U), low, np.zeros(reach, _U)])
        best = _sliding(pad, reach + 1, np.maximum)
        at = np.flatnonzero((best == self.grams) & (best > 0))
        return self.grams[at], self.text_of[at]


def _scan(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    chunk, held = task_number() << 20, 0
    for ids, texts in steps(batches):
        found = Windows(texts, window)
        values, owner = found.anchors()
        edges = np.searchsorted(owner, np.arange(len(ids) + 1))
        if held and held + len(values) > CHUNK:
            chunk, held = chunk + 1, 0
        held += len(values)
        digests = [hashlib.sha256(b" ".join(x.split())).digest() for x in bodies_of(texts)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(found.first)), pa.array(digests, pa.binary()), list_array(signed(values), edges), pa.array(np.full(len(ids), chunk))], ["doc_id", "n_words", "sha", "anchors", "chunk"])


def _cells(table: pa.Table, bits: int) -> list[np.ndarray]:
    values = table["anchors"].combine_chunks().flatten().to_numpy().view(_U)
    return [(mix64(values, seed) >> _U(64 - bits)).astype(np.int64) for seed in (71, 72)]


def _flagged(table: pa.Table, flags: np.ndarray) -> pa.Table:
    column = table["anchors"].combine_chunks()
    counts = np.diff(column.offsets.to_numpy())
    at = np.repeat(np.arange(len(counts)), counts)[flags]
    values = column.flatten().to_numpy()[flags]
    some, begin = np.unique(at, return_index=True)
    return pa.table({"doc_id": table["doc_id"].to_numpy()[some], "flagged": list_array(values, np.append(begin, len(at))), "row": table["row"].to_numpy()[some]})


def _later(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which rows ``(h1, h2, doc, start)`` have their hashes in an earlier row of ``order`` at another place."""
    one = rows[order]
    head = np.ones(len(one), bool)
    head[1:] = (one[1:, :2] != one[:-1, :2]).any(axis=1)
    leader = one[np.maximum.accumulate(np.where(head, np.arange(len(one)), 0))]
    lost = np.zeros(len(one), bool)
    lost[order] = (one[:, 2:] != leader[:, 2:]).any(axis=1)
    return lost


_RUN = ["anchor", "doc_id", "start", "n", "hashes", "row"]


def _runs_of(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, row: np.ndarray, pairs: np.ndarray, lost: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    """Rows of neighbouring windows with one anchor and one fate (``new`` marks where one begins); lost ones carry no digests."""
    new[1:] |= lost[1:] != lost[:-1]
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(new)))
    flat = np.ascontiguousarray(pairs).tobytes()
    body = [b"" if gone else flat[16 * a : 16 * (a + c)] for a, c, gone in zip(heads.tolist(), counts.tolist(), lost[heads].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(signed(anchor[heads])), pa.array(doc[heads]), pa.array(start[heads]), pa.array(counts), pa.array(body, pa.binary()), pa.array(row[heads])], _RUN)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of ``(doc_id, text, flagged, row)``: runs of windows with one anchor, each window once in a step."""
    for batch in batches:
        at = 0
        for ids, texts in steps(iter([batch])):
            flagged, row = batch.column(2).slice(at, len(ids)), batch.column(3).slice(at, len(ids)).to_numpy()
            at += len(ids)
            found = Windows(texts, window)
            if found.anchor is None:
                continue
            # A value flagged in one text of the step may pass in another too: more windows, never fewer.
            picked = np.flatnonzero(found.valid & np.isin(signed(found.anchor), flagged.flatten().to_numpy()))
            if not len(picked):
                continue
            pairs = found.digested(picked)
            text = found.text_of[picked]
            doc, start = ids[text], picked - found.first[text]
            order = np.lexsort((start, doc, pairs[:, 1], pairs[:, 0]))
            lost = _later(np.column_stack([pairs, doc.astype(_U), start.astype(_U)]), order)
            anchor = found.anchor[picked]
            new = np.ones(len(picked), bool)
            new[1:] = (np.diff(picked) != 1) | (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
            yield _runs_of(anchor, doc, start, row[text], pairs, lost, new)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor, document, start: the same windows, those that came before as lost."""
    carried = np.empty((0, 4), _U)
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchors, docs, starts, counts = (batch.column(i).to_numpy() for i in range(4))
        bodies = batch.column(4).to_pylist()
        known = np.array([not x for x in bodies])
        if known.any():
            yield batch.filter(pa.array(known))
        lengths = np.where(known, 0, counts)
        row = np.repeat(np.arange(len(counts)), lengths)
        start = starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        pairs = np.frombuffer(b"".join(bodies), _U).reshape(-1, 2)
        if last is not None and anchors[0] != last:
            carried = carried[:0]
        every = np.concatenate([carried, np.column_stack([pairs, docs[row].astype(_U), start.astype(_U)])])
        order = np.lexsort((signed(every[:, 3]), signed(every[:, 2]), every[:, 1], every[:, 0]))
        lost = _later(every, order)[len(carried) :]
        if len(row):
            yield _runs_of(anchors[row].view(_U), docs[row], start, batch.column(5).to_numpy()[row], pairs, lost, np.append(True, row[1:] != row[:-1]))
        # What the next batch must know: windows of the anchor that this one ends with.
        same = every[len(carried) :][anchors[row] == anchors[-1]]
        if anchors[0] == anchors[-1]:
            same = np.concatenate([carried, same])
        _, heads = np.unique(same[:, :2], axis=0, return_index=True)
        carried = same[heads]
        last = anchors[-1]


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, removed, kept = [], [], [], []
        for row in range(batch.num_rows):
            words = (batch.column(1)[row].as_py() or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            lo, hi = (batch.column(i)[row].values.to_numpy() for i in (2, 3))
            np.add.at(gone, np.minimum(lo, len(words)), 1)
            np.add.at(gone, np.minimum(hi + window - 1, len(words)), -1)
            stays = np.cumsum(gone)[:-1] == 0
            ids.append(batch.column(0)[row].as_py())
            counts.append(len(words))
            removed.append(int(len(words) - stays.sum()))
            kept.append(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _rowed(texts: DataFrame) -> DataFrame:
    """Texts with ``row``, a hash of their words, which tells rows of one id apart."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\u000B\f\r]+", " "))
    return texts.withColumn("row", F.xxhash64(F.unhex(F.sha2(plain, 256))))


def _ranges(docs: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (with ``copy``: an equal word sequence has a smaller id), and removed starts by document."""
    texts = keyed_texts(docs)
    scan = scratch.keep(texts.mapInArrow(lambda it: _scan(it, window), "doc_id long, n_words long, sha binary, anchors array<long>, chunk long"), "scan")
    owner = scratch.keep(scan.groupBy("sha").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    marked = scan.join(owner, "sha", "left").withColumn("row", F.xxhash64("sha")).withColumn("copy", F.coalesce(F.col("low") < F.col("doc_id"), F.lit(False)))
    own = marked.where(~F.col("copy") & (F.size("anchors") > 0)).select("doc_id", "anchors", "chunk", "row").dropDuplicates(["doc_id", "row"])
    total = scan.agg(F.sum(F.size("anchors"))).first()[0] or 0
    bits = max(10, total.bit_length() + 2)
    owner_bits = max(4, (2 * total // OWNER).bit_length() - 1)
    flagged = shared_values(own, lambda t: _cells(t, bits), bits, owner_bits, _flagged, "doc_id long, flagged array<long>, row long")
    flagged = scratch.keep(flagged, "flagged")

    schema = "anchor long, doc_id long, start long, n long, hashes binary, row long"
    rows = _rowed(texts).join(flagged, ["doc_id", "row"]).select("doc_id", "text", "flagged", "row")
    runs = rows.mapInArrow(lambda it: _windows(it, window), schema).sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(_merged, schema)
    runs = scratch.keep(runs, "runs")
    # First ones of a task meet those of other tasks at their anchor, a row for each task and run at most.
    parts = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    firsts = runs.where(F.octet_length("hashes") > 0).repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "start")
    lost = runs.unionByName(firsts.mapInArrow(_merged, schema)).where(F.octet_length("hashes") == 0)
    lost = lost.groupBy("doc_id", "row").agg(F.collect_list("start").alias("lo"), F.collect_list(F.col("start") + F.col("n")).alias("hi"))
    return marked, scratch.keep(lost, "removed")


def without_repeated_passages(docs: DataFrame, window: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` and ``kept`` where words were removed; see the module."""
    scratch = Scratch(docs.sparkSession, "passages")
    marked, removed = _ranges(docs, window, scratch)
    cut = _rowed(keyed_texts(docs)).join(removed, ["doc_id", "row"]).select("doc_id", "text", "lo", "hi").mapInArrow(lambda it: _cut(it, window), "doc_id long, n_words long, n_removed long, kept string")
    gone = F.col("copy") & (F.col("n_words") >= window)
    whole = marked.join(removed.select("doc_id", "row", F.lit(True).alias("hit")), ["doc_id", "row"], "left").where(F.col("hit").isNull())
    whole = whole.select("doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"), F.when(gone, F.lit("")).alias("kept"))
    return whole.unionByName(cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "kept"))
