"""Licence scan by a positional rare-token index, in native column expressions throughout.

Templates are short word sequences with a label; some are base phrases, which must match whole. Words of
templates have an IDF over the whole corpus (one grouped count). The index posts each template under the
highest-IDF word of its mandatory key phrase, with the relative position of every template word. A file looks
up those of its words that are posted and each posting proposes a start; the template's words are then
intersected with the file's words by relative position. A proposal stands when it starts in the file, the
share of words in place reaches the template's threshold and the key phrase is in place whole. So any place
that stands holds its posted word: none is missed, whichever other words differ, and no count is capped.

Results by case: null or empty text: no words, no labels, score 0; overlapping and repeated places all count;
very long texts are whole; repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, opened
from .words import words


class Template(NamedTuple):
    label: str
    text: str
    #: Words that must stand in place whole; all of the text where empty.
    key: str = ""
    #: Least share of words in place.
    share: float = 1.0
    base: bool = False


#: Base phrases and their labels.
BASE = (Template("mit", "under the mit license", base=True), Template("apache-2", "apache license version 2", base=True), Template("cc-by-nc", "cc by nc", base=True))

#: Further labels, from the opening words of public licences and their usual notices.
MORE = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy", 0.8),
    Template("gpl", "gnu general public license"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", 0.8),
)


def _rows(docs: DataFrame) -> DataFrame:
    return opened(docs).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))


def licence_scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + MORE) -> DataFrame:
    """``(doc_id, n_words, base (array of starts), base_labels, labels, score, places)`` for every row of ``docs``.

    ``places`` holds ``(label, start, share)`` of everything that stands; ``score`` is the largest share times
    the IDF of the template's rarest word relative to the largest IDF, so that it is in [0, 1].
    """
    spark = docs.sparkSession
    Scratch(spark, "licence")
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    present = _rows(docs).select(F.explode(F.array_distinct(F.filter("w", lambda x: x.isin(vocabulary)))).alias("word"))
    counted = {r["word"]: r["n"] for r in present.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    total = max([1, *counted.values()])
    idf = {w: math.log((1 + total) / (1 + counted.get(w, 0))) + 1 for w in vocabulary}
    top = max(idf.values())

    posted = []
    for number, t in enumerate(templates):
        parts = t.text.split()
        key = t.key.split() or parts
        offset = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        # Only key words are sure to stand; any other word may be the one that differs.
        at = max(range(offset, offset + len(key)), key=lambda i: (idf[parts[i]], parts[i], -i))
        posted.append((number, parts[at], t.label, parts, at, offset, key, float(t.share), t.base, max(idf[w] for w in parts) / top))
    index = spark.createDataFrame(posted, "template int, word string, label string, parts array<string>, at int, offset int, key array<string>, least double, base boolean, weight double")
    rare = sorted({p[1] for p in posted})

    rows = _rows(docs).withColumn("row", F.monotonically_increasing_id())
    found = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda s: s["word"].isin(rare))
    probes = rows.select("doc_id", "row", "w", F.explode_outer(found).alias("p")).select("doc_id", "row", "w", F.col("p.word").alias("word"), F.col("p.i").alias("i"))
    joined = probes.join(F.broadcast(index), "word", "left")  # the templates: a fixed, small list
    start = F.col("i") - F.col("at")
    part = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("parts"))
    in_place = F.size(F.filter(F.zip_with(part, "parts", lambda a, b: a == b), lambda x: x)) / F.size("parts")
    key_stands = F.slice(part, F.col("offset") + 1, F.size("key")) == F.col("key")
    stands = F.col("template").isNotNull() & (start >= 0) & key_stands & (in_place >= F.col("least"))
    judged = joined.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), "label", "base", "weight", start.cast("long").alias("start"), in_place.alias("share"), F.coalesce(stands, F.lit(False)).alias("stands"))
    hit, base = F.col("stands"), F.col("stands") & F.col("base")
    out = judged.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(base, F.col("start")))).alias("base"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(base, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(hit, F.col("label"))))).alias("labels"),
        F.coalesce(F.max(F.when(hit, F.col("share") * F.col("weight"))), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(hit, F.struct("label", "start", "share"))).alias("places"),
    )
    return out.drop("row")
