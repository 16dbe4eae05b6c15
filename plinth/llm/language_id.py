"""Language identification by rank-order profiles of character n-grams.

A profile is the ``PROFILE`` most frequent 1- to 3-grams of a language's texts, in rank order; words are
letters only, lower-cased, framed by boundary marks. A document's own ``PROFILE`` most frequent n-grams are
compared with each profile by out-of-place distance: the rank differences summed, ``PROFILE`` for an n-gram
that the profile lacks. The nearest profile wins (ties: first in order of name); the score is one less the
distance as a share of the largest possible.

Profiles are counted over at most about ``per_language`` texts of each language, picked by a hash of the id;
that bound is the parameter, and smaller languages are counted whole. Every document is scored on its whole
text, counted window by window. Cases: null, empty or letterless text: ``und`` with score 0; without any labelled text every document
is ``und``; rows without ``lang`` teach nothing; repeated rows give a row each; no rows, no result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, keyed_texts, opened, picked, steps

PROFILE = 400
_BITS = 12
_DIRECT = 0x600
#: Text bytes of one step, and characters counted at once: a long text is counted window by window.
_STEP, _POINTS = 1 << 18, 1 << 17


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """The letter class of every code point: 0 for no letter, lower case folded, letters beyond the first scripts hashed."""
    table = np.zeros(0x110000, np.int16)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            own = ord(low) if len(low) == 1 else point
            table[point] = own if own < _DIRECT else _DIRECT + own % ((1 << _BITS) - _DIRECT)
    return table


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def ranked_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the n-grams in order of count (then of code): text number, code, count.

    A place gives its letter, the pair that ends there (a letter in it) and the triple around its letter; what is
    no letter is one boundary mark. Windows of places are counted apart and summed, so a text's length does not
    decide the memory, only its distinct n-grams do.
    """
    whole = "\n" + "\n".join(texts) + "\n\n"
    begin = np.cumsum([1, *(len(x) + 1 for x in texts)])
    tag = 3 * _BITS
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    waiting = 0
    for a in range(1, len(whole) - 1, _POINTS):
        b = min(a + _POINTS, len(whole) - 1)
        code = _letters()[np.frombuffer(whole[a - 1 : b + 1].encode("utf-32-le"), "<u4")]
        solid = code > 0
        one, two = np.flatnonzero(solid[1:-1]), np.flatnonzero(solid[1:-1] | solid[:-2])
        x, y, z = (code[i : len(code) - 2 + i].astype(np.int64) for i in range(3))
        owner = (np.searchsorted(begin, np.arange(a, b), "right") - 1) << (tag + 2)
        found = [owner[one] | (1 << tag) | y[one], owner[two] | (2 << tag) | (x << _BITS | y)[two], owner[one] | (3 << tag) | (x << 2 * _BITS | y << _BITS | z)[one]]
        found = np.sort(np.concatenate(found))
        heads = np.flatnonzero(np.append(np.ones(min(1, len(found)), bool), found[1:] != found[:-1]))
        keys.append(found[heads])
        counts.append(np.diff(np.append(heads, len(found))))
        waiting += len(heads)
        if waiting > 8 * _POINTS:
            done = _summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, waiting = [done[0]], [done[1]], 0
    every, number = _summed(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 2 else (keys[-1], counts[-1])
    text, code = every >> (tag + 2), every & ((1 << (tag + 2)) - 1)
    order = np.lexsort((-number, text))
    return text[order], code[order], number[order]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(doc_id, text, lang)``: n-gram counts by language, of each step."""
    for batch in batches:
        at = 0
        for ids, texts in steps(iter([batch]), _STEP):
            langs = np.array(batch.column(2).slice(at, len(ids)).to_pylist(), object)
            at += len(ids)
            text, code, count = ranked_grams(texts.to_pylist())
            names, number = np.unique(langs.astype(str), return_inverse=True)
            for i, name in enumerate(names):
                mine = number[text] == i
                codes, place = np.unique(code[mine], return_inverse=True)
                sums = np.bincount(place, count[mine], len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(codes), pa.string()), pa.array(codes), pa.array(sums)], ["lang", "code", "n"])


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]]):
        self.names = sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for lang, code, rank in rows:
            self.ranks[np.searchsorted(self.codes, code), self.names.index(lang)] = rank

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        text, code, _ = ranked_grams(texts)
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        rank = np.arange(len(text)) - first[text]
        top = rank < PROFILE
        text, code, rank = text[top], code[top], rank[top]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.names or not len(text):
            return names, scores
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ranks = self.ranks[np.where(self.codes[at] == code, at, len(self.codes))]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - rank[:, None]))
        used, begin = np.unique(text, return_index=True)
        total = np.add.reduceat(away, begin, axis=0)
        best = np.argmin(total, axis=1)
        share = total[np.arange(len(used)), best] / (PROFILE * np.diff(np.append(begin, len(text))))
        for t, b in zip(used.tolist(), best.tolist(), strict=True):
            names[t] = self.names[b]
        scores[used] = 1 - share
        return names, scores


def _judged(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in steps(iter([batch]), _STEP):
            names, scores = profiles.judge(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether the id, as text, falls in the held-out fold by its CRC-32."""
    return F.crc32(F.encode(key.cast("string"), "utf-8")) % folds == fold


def learn(docs: DataFrame, teaching: Column | None = None, per_language: int = 2000) -> Profiles:
    """Profiles from ``doc_id, text, lang``; ``teaching`` says which rows may teach (over the opened columns)."""
    scratch = Scratch(docs.sparkSession, "lang")
    rows = opened(docs, ("doc_id", "text", "lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if teaching is not None:
        rows = rows.where(teaching)
    counts = scratch.keep(rows.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    # Ids are chosen without texts; only the chosen texts are read on, by a size-checked semi-join.
    narrow = rows.select("doc_id", "lang").join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "lang")
    chosen = narrow.where(F.pmod(F.xxhash64("doc_id"), F.col("n")) < per_language).select("doc_id").distinct()
    taught = picked(rows.select("doc_id", "text", "lang"), scratch.keep(chosen, "chosen"))
    grams = taught.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).mapInArrow(_counted, "lang string, code long, n long")
    grams = grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = grams.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE)
    return Profiles([(r["lang"], r["code"], r["rank"]) for r in ranked.select("lang", "code", "rank").collect()])  # PROFILE rows a language


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return keyed_texts(docs).mapInArrow(lambda it: _judged(it, shared.value), "doc_id long, lang_pred string, score double")


def _lettered(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    out[ranked_grams(texts)[0]] = True
    return out


def accepted(docs: DataFrame, profiles: Profiles, least: float = 0.1) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has letters and comes as near to a profile as ``least``.

    Rejected are letterless texts and scores below ``least`` (hardly an n-gram in common with any profile). Without
    any profile nothing can be compared, and only letterless texts are rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lettered: boolean, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        lettered, scores = [np.empty(0, bool)], [np.empty(0)]
        for _, part in steps(iter([pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()).fill_null(0), texts], ["i", "t"])]), _STEP):
            names, score = shared.value.judge(part.to_pylist())
            lettered.append(np.array(names) != "und" if shared.value.names else _lettered(part.to_pylist()))
            scores.append(score if shared.value.names else np.ones(len(part)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(lettered)), pa.array(np.concatenate(scores))], ["lettered", "score"])

    rows = opened(docs)
    verdict = rows.withColumn("verdict", judge(F.col("text").cast("string")))
    kept = verdict.where(F.col("verdict.lettered") & (F.col("verdict.score") >= least)).drop("verdict")
    return kept.toDF(*docs.columns)
