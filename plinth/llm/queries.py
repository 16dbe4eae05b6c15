"""The ten corpus queries: thin digests of the operators over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality
from .decontamination import contamination
from .exact_dedup import exact_duplicates
from .licenses import licence_scan
from .line_dedup import without_repeated_lines
from .near_dedup import near_duplicates
from .packing import packed_sequences
from .sharding import balanced_shards
from .substring_dedup import without_repeated_passages


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licence_scan(_documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").alias("first_word"), F.array_max("base").alias("last_word"), "base_labels", "labels", "score"
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(_documents(spark, sf_dir), shards=8)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = language_id.held_out(F.col("doc_id"), 5, 0)
    return language_id.identify(docs, language_id.learn(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    scored = quality.score(docs, quality.learn(docs, labels, ~out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_passages(_documents(spark, sf_dir)).drop("kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_balanced_sharding": op6_balanced_sharding,
    "op7_language_id": op7_language_id,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"
_PLAIN_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: DuckDB twins. A blank is 0x20 or 0x09-0x0D; a missing text is empty.
ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH plain AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
          FROM documents WHERE doc_id IS NOT NULL)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               min(doc_id) OVER same = doc_id AS kept, sha256(body) AS text_sha256
        FROM plain WINDOW same AS (PARTITION BY body)
    """,
    "op5_line_dedup": r"""
        WITH split AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
          FROM documents WHERE doc_id IS NOT NULL),
        keyed AS (
          SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM split),
        judged AS (
          SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS lost FROM keyed)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_BLANK_WORDS}) AS w FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
        reach AS (SELECT u, v FROM (SELECT u, v FROM link UNION SELECT v, u FROM link) UNION SELECT r.u, l.v FROM reach r JOIN (SELECT u, v FROM link UNION SELECT v, u FROM link) l ON r.v = l.u),
        low AS (SELECT u AS doc_id, min(v) AS low FROM reach GROUP BY u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, least(d.doc_id, coalesce(low, d.doc_id)) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
    """,
    "op9_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK_WORDS}) AS w FROM documents WHERE doc_id IS NOT NULL),
        win AS (SELECT doc_id, i AS start, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
        lost AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS r FROM win) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM lost),
        word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS body FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_PLAIN_WORDS}) AS w FROM documents WHERE doc_id IS NOT NULL),
        b AS (SELECT item_id, regexp_extract_all({_LOWERED}, {_PLAIN_WORDS}) AS w FROM benchmark WHERE item_id IS NOT NULL),
        k AS (SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS k
              FROM (SELECT item_id, w, least(13, len(w)) AS width, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        p AS (SELECT doc_id, start, width, array_to_string(w[start:start + width - 1], ' ') AS k
              FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS start FROM d, (SELECT DISTINCT width FROM k) WHERE len(w) >= width)),
        hit AS (SELECT doc_id, start, width, item_id FROM p JOIN k USING (k, width)),
        covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(start, start + width)) AS place FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}
