"""Five corpus stages, each on all that the one before it kept, written as Parquet in between.

Cases, for every stage: columns of any other name pass through as they are, also where a stage uses that name inside;
a null text counts as empty (the language stage rejects both); repeated rows are decided alike and stay repeated; very
long texts are whole; an empty table gives an empty one; ties of near duplicates go to the smallest id.

``STAGES`` lists ``(name, function)``; every function takes ``(spark, docs, sf_dir)``. All but the last return
the columns of ``docs``, and keep rows without an id but where their text alone rejects them; packing, which
names documents by id, leaves those rows out. ``run`` applies them to the ``documents`` table. The result (packed sequences of what
is left) is nothing that SQL can say, so ``ORACLE_SQL`` is None and the tests hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import language_id
from plinth.llm.common import Scratch, opened, picked, with_columns_of
from plinth.llm.decontamination import contamination
from plinth.llm.line_dedup import without_repeated_lines
from plinth.llm.near_dedup import near_duplicates
from plinth.llm.packing import packed_sequences

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or near to no language's profile, go; without any labelled text, only the former."""
    return language_id.accepted(docs, language_id.learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but for their first document; ``n_chars`` follows the text. Rows without an id stay as they are."""
    out = with_columns_of(docs, without_repeated_lines(docs))
    out = out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out
    rest = opened(docs).where("doc_id is null")
    return out.union(rest.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).toDF(*docs.columns))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the given ids; rows without an id stay."""
    return picked(opened(docs), ids, "left_anti").select(opened(docs).columns).toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (five-word shingles, 0.8)."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return _without(docs, Scratch(spark, "near-gone").keep(gone, "ids"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    judged = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = judged.where("contaminated").select("doc_id").distinct()
    return _without(docs, Scratch(spark, "bench-gone").keep(gone, "ids"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token sequences of at most 4096."""
    return packed_sequences(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("decontaminated", decontaminated), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
