"""Record, evaluation and scalar queries over the shared tables, each with its DuckDB twin.

Records come from ``documents`` joined to ``labels``: the text, the quality label, a risk from the length, a
language and a category by fixed rules; both engines build them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import records as R
from .registry import register

#: Tokens in DuckDB's dialect.
_TOKENS = r"len(regexp_extract_all(d.text, '[A-Za-z0-9_]+|[^\p{L}\p{N}_\s]'))"
RECORDS = f"""records AS (
  SELECT d.doc_id, d.text AS input_dsl, l.quality AS label, (d.n_chars % 1000) / 1000.0::DOUBLE AS risk, l.toxic AS toxic,
         CASE d.lang WHEN 'de' THEN 'python' WHEN 'en' THEN 'typescript' WHEN 'fr' THEN 'go' ELSE 'rust' END AS language,
         CASE d.doc_id % 6 WHEN 0 THEN 'security_surface' WHEN 1 THEN 'logic_drift' WHEN 2 THEN 'arity_breaking'
           WHEN 3 THEN 'resource_leak' WHEN 4 THEN 'real_revert' ELSE 'circular_imports' END AS category,
         {_TOKENS} AS tokens
  FROM documents d JOIN labels l USING (doc_id))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    language = F.when(F.col("lang") == "de", "python").when(F.col("lang") == "en", "typescript").when(F.col("lang") == "fr", "go").otherwise("rust")
    names = ["security_surface", "logic_drift", "arity_breaking", "resource_leak", "real_revert", "circular_imports"]
    category = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.join(labels, "doc_id").select("doc_id", F.col("text").alias("input_dsl"), F.col("quality").cast("int").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("risk"), "toxic", language.alias("language"), category.alias("category"))


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumnRenamed("risk", "risk_score")
    return R.normalised(rows.withColumns({"taxonomy_labels": F.lit(None).cast("map<string,double>"), "symbolic_gate_passed": F.col("toxic") == 0, "source_type": F.lit("mined")}))


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


@register("t1_token_count", f"SELECT d.doc_id, {_TOKENS} AS tokens FROM documents d")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", S.token_count(F.col("text")).alias("tokens"))


@register("t2_content_hash", "SELECT doc_id, sha256(text) AS sha FROM documents")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha"))


@register("t3_last_segment", "SELECT page_id, string_split(string_split(url, '.')[-1], '::')[-1] AS segment FROM pages")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.last_segment(F.col("url")).alias("segment"))


@register("t4_snake_case", "SELECT p_partkey, lower(regexp_replace(replace(p_type, ' ', ''), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", S.snake_case(F.replace("p_type", F.lit(" "), F.lit(""))).alias("snake"))


@register(
    "t6_line_set",
    """WITH lines AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS xs FROM lineitem GROUP BY l_orderkey)
       SELECT l_orderkey, CASE WHEN len(xs) <= 6 THEN '[' || list_aggregate(xs, 'string_agg', ', ') || ']'
         ELSE '[' || xs[1] || '..' || xs[-1] || '] (' || len(xs) || ' lines)' END AS lines FROM lines""",
)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("xs"))
    return items.select("l_orderkey", S.line_set(F.col("xs")).alias("lines"))


_EDGE, _WORD = r"(^|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]*"


def _context_case(name: str) -> str:
    body = S.CONTEXT_WORDS[name].replace(r"\w*", _WORD)
    return f"regexp_matches(t, '{_EDGE}({body})($|[^\\p{{L}}\\p{{N}}_])') AS {name.lower()}"


@register("t10_context_classes", "WITH x AS (SELECT conv_id, turn, regexp_replace(lower(text), '[_-]', ' ', 'g') AS t FROM conversations) SELECT conv_id, turn, " + ", ".join(_context_case(c) for c in S.RISK_CLASSES) + " FROM x")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.regexp_replace(F.lower("text"), "[_-]", " ")
    return rows.select("conv_id", "turn", *[text.rlike("(?U)" + S._context_pattern(S.CONTEXT_WORDS[c])).alias(c.lower()) for c in S.RISK_CLASSES])


_CLASS_SQL = """CASE
  WHEN category LIKE '%security%' THEN 'SecuritySurface' WHEN category = 'logic_drift' THEN 'SilentLogicDrift'
  WHEN category = 'arity_breaking' THEN 'BreakingPublicAPI' WHEN category = 'resource_leak' THEN 'PerformanceRegression'
  WHEN category = 'real_revert' THEN 'SilentLogicDrift' ELSE 'circular' END"""


@register(
    "t10_category_scores",
    f"""WITH {RECORDS}, s AS (SELECT *, {_CLASS_SQL} AS k, least(greatest(risk, 0.65), 1.0) AS score FROM records)
        SELECT doc_id, CASE WHEN label = 1 THEN 0.0 WHEN k = 'BreakingPublicAPI' THEN score WHEN k = 'circular' THEN round(score * 0.7, 4) ELSE 0.0 END AS api,
          CASE WHEN label = 1 THEN 0.0 WHEN k = 'SecuritySurface' THEN score ELSE 0.0 END AS security,
          CASE WHEN label = 1 THEN 0.0 WHEN k = 'PerformanceRegression' THEN score ELSE 0.0 END AS perf,
          CASE WHEN label = 1 THEN 0.0 WHEN k = 'SilentLogicDrift' THEN score WHEN k = 'circular' THEN round(score * 0.8, 4) ELSE 0.0 END AS logic
        FROM s""",
)
def t10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("m", S.risk_map(F.col("category"), F.col("label"), F.col("risk")))
    pick = {"api": "BreakingPublicAPI", "security": "SecuritySurface", "perf": "PerformanceRegression", "logic": "SilentLogicDrift"}
    return rows.select("doc_id", *[F.element_at("m", F.lit(v)).alias(k) for k, v in pick.items()])


@register("m_risk_arithmetic", f"WITH {RECORDS}, z AS (SELECT doc_id, ln(least(greatest(risk, 1e-6), 1 - 1e-6) / (1 - least(greatest(risk, 1e-6), 1 - 1e-6))) AS z, risk FROM records) SELECT doc_id, round(z, 6) AS logit, round(1 / (1 + exp(-z / 1.9)), 6) AS tempered, round(1 - least(greatest(sqrt(exp(least(greatest(z, -6), 6))), 0), 1), 6) AS confidence FROM z")
def m_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = S.logit(F.col("risk"))
    return records(spark, sf_dir).select("doc_id", F.round(z, 6).alias("logit"), F.round(S.tempered(F.col("risk"), 1.9), 6).alias("tempered"), F.round(S.confidence(z), 6).alias("confidence"))


@register(
    "e3_quality_gate",
    f"""WITH {RECORDS} SELECT doc_id, tokens <= 0 OR tokens > 400 AS tokens_bad, toxic <> 0 AS gate_bad,
          label = 1 AND NOT (risk BETWEEN 0 AND 0.25) AS pass_bad, label = 0 AND NOT (risk BETWEEN 0.65 AND 1) AS reject_bad,
          label = 0 AND category = 'none' AS class_bad FROM records""",
)
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _full(spark, sf_dir).withColumn("r", R.gate_reasons())
    has = lambda x: F.array_contains("r", x)
    return rows.select("doc_id", has("tokens").alias("tokens_bad"), has("gate").alias("gate_bad"), has("pass_risk").alias("pass_bad"), has("reject_risk").alias("reject_bad"), has("reject_class").alias("class_bad"))


@register(
    "e4_inspection",
    f"""WITH {RECORDS} SELECT count(*) AS total, count(*) FILTER (label = 1) AS passes, count(*) FILTER (label = 0) AS rejects, min(tokens) AS min_tokens,
          max(tokens) AS max_tokens, round(avg(tokens), 1) AS mean_tokens, median(tokens) AS median_tokens,
          abs(count(*) FILTER (label = 1) - count(*) FILTER (label = 0)) > greatest(2.0, count(*) * 0.05) AS imbalanced FROM records""",
)
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.inspected(records(spark, sf_dir))


@register(
    "e4_violations",
    f"""WITH {RECORDS}, v AS (SELECT unnest(list_filter([CASE WHEN label = 1 AND risk > 0.25 THEN 'risk_high_for_pass' END,
          CASE WHEN label = 0 AND risk < 0.75 THEN 'risk_low_for_reject' END, CASE WHEN tokens > 400 THEN 'tokens' END,
          CASE WHEN trim(input_dsl) = '' THEN 'empty' END], lambda x: x IS NOT NULL)) AS rule FROM records)
        SELECT rule, count(*) AS n FROM v GROUP BY rule""",
)
def e4v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.violations(records(spark, sf_dir).withColumnRenamed("risk", "risk_score")).groupBy("rule").agg(F.count("*").alias("n"))


@register(
    "e5_stratified_split",
    f"""WITH {RECORDS}, r AS (SELECT doc_id, language, label, row_number() OVER (PARTITION BY language, label ORDER BY doc_id) AS place FROM records)
        SELECT doc_id, language, label, CASE WHEN place <= 2 THEN 'train' ELSE 'val' END AS split FROM r WHERE place <= 3""",
)
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified(records(spark, sf_dir), 24, 0.4, order=F.col("doc_id")).select("doc_id", "language", "label", "split")


@register(
    "e6_parity",
    f"""WITH {RECORDS}, c AS (SELECT language, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0), 20) AS cap FROM records GROUP BY language),
        r AS (SELECT doc_id, language, label, row_number() OVER (PARTITION BY language, label ORDER BY doc_id) AS place FROM records)
        SELECT doc_id, language, label FROM r JOIN c USING (language) WHERE place <= cap""",
)
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parity(records(spark, sf_dir), 40, order=F.col("doc_id")).select("doc_id", "language", "label")


@register(
    "e7_export_split",
    f"""WITH {RECORDS}, n AS (SELECT least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS n FROM records),
        r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS place FROM records)
        SELECT doc_id, label, CASE WHEN place <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM r, n WHERE place <= n""",
)
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.export_split(records(spark, sf_dir), 0.2, order=F.col("doc_id")).select("doc_id", "label", "split")


@register("e8_language_targets", "SELECT * FROM (VALUES (4900, 1000, 1100, 1000, 1800), (4500, 1000, 1100, 600, 1800), (40, 10, 10, 10, 10), (60, 14, 16, 14, 16), (1001, 204, 224, 204, 370)) t(total, python, typescript, go, rust)")
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, *(R.language_targets(t)[g] for g in S.LANGUAGES)) for t in (4900, 4500, 40, 60, 1001)]
    return spark.createDataFrame(rows, "total int, python int, typescript int, go int, rust int")


_THRESHOLDS = [0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]
_OUTCOME = "CASE WHEN risk < {t} THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN label = 0 THEN 'TN' ELSE 'FN' END END"
_COUNTS = ", ".join(f"count(*) FILTER (o = '{o}') AS {o.lower()}" for o in ("TP", "FP", "TN", "FN"))
_METRICS = """round(CASE WHEN total > 0 THEN (tp + tn) / total ELSE 0 END, 4) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 4) AS f1,
  round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 4) AS specificity"""


def _sweep_sql(keys: str) -> str:
    values = ", ".join(f"({t}::DOUBLE)" for t in _THRESHOLDS)
    return f"""WITH {RECORDS}, t AS (SELECT * FROM (VALUES {values}) v(threshold)), o AS (SELECT *, {_OUTCOME.format(t="threshold")} AS o FROM records, t),
      c AS (SELECT threshold{keys}, count(*) AS total, {_COUNTS} FROM o GROUP BY threshold{keys}) SELECT *, {_METRICS} FROM c"""


@register("e12_threshold_sweep", _sweep_sql(", language"))
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sweep(records(spark, sf_dir), _THRESHOLDS, "language")


@register("e12_threshold_sweep_all", _sweep_sql(""))
def e12_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sweep(records(spark, sf_dir), _THRESHOLDS)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumn("outcome", E.outcome(F.col("label"), F.col("risk"), 0.5))


_O = f"{RECORDS}, o AS (SELECT *, {_OUTCOME.format(t='0.5')} AS o FROM records)"


@register("e9_outcomes", f"WITH {_O} SELECT doc_id, o AS outcome FROM o")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", "outcome")


@register("e10_metrics", f"WITH {_O}, c AS (SELECT count(*) AS total, {_COUNTS} FROM o) SELECT *, {_METRICS} FROM c")
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_judged(spark, sf_dir))


@register("e11_breakdown", f"WITH {_O} SELECT language, category, count(*) AS total, {_COUNTS} FROM o GROUP BY GROUPING SETS ((language), (category), ())")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.breakdown(_judged(spark, sf_dir))


@register(
    "e13_calibration_error",
    f"""WITH {RECORDS}, p AS (SELECT least(greatest(risk, 1e-6), 1 - 1e-6) AS p, 1 - label AS y FROM records),
        b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM p GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 4) AS ece FROM b""",
)
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_error(records(spark, sf_dir))


_GRID = [0.5, 1.0, 1.5, 2.0, 3.0, 5.0]


@register(
    "e14_temperature_grid",
    f"""WITH {RECORDS}, z AS (SELECT ln(least(greatest(risk, 1e-6), 1 - 1e-6) / (1 - least(greatest(risk, 1e-6), 1 - 1e-6))) AS z, 1 - label AS y FROM records),
        t AS (SELECT unnest({_GRID}::DOUBLE[]) AS temperature), p AS (SELECT temperature, y, 1 / (1 + exp(-z / temperature)) AS p FROM z, t)
        SELECT temperature, round(avg(-y * ln(p) - (1 - y) * ln(1 - p)), 6) AS loss FROM p GROUP BY temperature""",
)
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.temperature_grid(records(spark, sf_dir), _GRID)


@register("e15_uncertainty", f"WITH {_O} SELECT o AS outcome, count(*) AS n, round(avg((doc_id % 100) / 100.0), 4) AS mean_uncertainty FROM o GROUP BY o")
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.uncertainty_by_outcome(_judged(spark, sf_dir).withColumn("uncertainty", (F.col("doc_id") % 100) / 100.0))


_MISS = """CASE WHEN category = 'real_revert' THEN 'missed/revert' WHEN category LIKE '%security%' THEN 'missed/security/' || language
  WHEN category LIKE '%logic%' OR category LIKE '%drift%' THEN 'missed/logic/' || language WHEN category LIKE '%breaking%' OR category LIKE '%api%' THEN 'missed/api/' || language
  ELSE 'missed/other/' || language END"""


@register("t14_root_causes", f"WITH {_O} SELECT CASE o WHEN 'FP' THEN {_MISS} WHEN 'FN' THEN CASE WHEN risk > 0.7 THEN 'alarm/high_risk' ELSE 'alarm/borderline' END ELSE 'correct' END AS cause, count(*) AS n FROM o GROUP BY 1")
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    cause = E.root_cause(F.col("outcome"), F.col("category"), F.col("language"), F.col("risk"), F.lit(0), F.lit(""))
    return rows.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


_LOSSES = f"""WITH {RECORDS}, e AS (SELECT risk, 1 - label AS y, abs(risk - (1 - label)) AS e, least(greatest(risk, 1e-6), 1 - 1e-6) AS p, least(greatest(risk * 4 - 2, -6), 6) AS s FROM records),
        l AS (SELECT avg(CASE WHEN e <= 0.1 THEN 0.5 * e * e ELSE 0.1 * (e - 0.05) END * (CASE WHEN y >= 0.5 THEN @WEIGHT@ ELSE 1.0 END)) AS huber, avg(-y * ln(p) - (1 - y) * ln(1 - p)) AS bce, avg(0.5 * exp(-s) * e * e + 0.5 * s) AS nll FROM e)"""


def _scored_losses(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    return E.losses(records(spark, sf_dir).select("risk", (1 - F.col("label")).alias("target"), (F.col("risk") * 4 - 2).alias("log_variance")), **how)


@register("r8_losses", _LOSSES.replace("@WEIGHT@", "1.0") + " SELECT *, huber + bce + nll AS total FROM l")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_losses(spark, sf_dir)


@register("r8_weighted_losses", _LOSSES.replace("@WEIGHT@", "3.0") + " SELECT *, 0.5 / 0.25 * huber + 0.5 / 1.0 * bce + 0.5 / 4.0 * nll + ln(abs(0.5 * 1.0 * 2.0) + 1e-8) AS total FROM l")
def r8_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_losses(spark, sf_dir, risk_weight=3.0, noise=(0.5, 1.0, 2.0))


@register("e21_label_conflicts", "SELECT sha256(text) AS text_sha, count(*) AS records, count(DISTINCT doc_id % 2) AS labels FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id % 2) > 1")
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies carry one quality each in the shared tables, so the label is the id's parity here."""
    return R.label_conflicts(_docs(spark, sf_dir, F.col("text").alias("input_dsl"), (F.col("doc_id") % 2).alias("label")).where("input_dsl is not null"))


@register(
    "e22_split_leakage",
    r"""WITH k AS (SELECT doc_id, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS k, doc_id % 5 = 0 AS held FROM documents)
        SELECT doc_id FROM k WHERE held AND k IN (SELECT k FROM k WHERE NOT held)""",
)
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "doc_id", F.col("text").alias("input_dsl"))
    return R.split_leakage(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0")).select("doc_id")


@register(
    "t7_text_summary",
    """WITH x AS (SELECT r_name, '[DIFF_TARGET] ' || r_name || chr(10) || string_agg('N' || n_nationkey || ': ' || n_name || ' [x]', chr(10) ORDER BY n_nationkey) AS t, count(*) AS n,
                 list('N' || n_nationkey || ': ' || n_name || ' [x]' ORDER BY n_nationkey) AS xs FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
       SELECT r_name AS target, array_to_string(xs[1:3], '; ') || CASE WHEN n > 3 THEN ' ... (+' || (n - 3) || ' more)' ELSE '' END AS nodes FROM x""",
)
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    line = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(": "), "n_name", F.lit(" [x]"))
    rows = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # a fixed list of regions
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"])
    texts = rows.groupBy("r_name").agg(F.concat(F.lit("[DIFF_TARGET] "), F.col("r_name"), F.lit("\n"), F.array_join(lines, "\n")).alias("t"))
    return texts.select(S.dsl_target(F.col("t")).alias("target"), S.dsl_nodes(F.col("t")).alias("nodes"))


@register(
    "t15_miss_notes",
    f"""WITH {_O} SELECT doc_id, 'The change ' || CASE WHEN category = 'real_revert' THEN '{S.MISS_NOTES["revert"]}' WHEN category LIKE '%security%' THEN '{S.MISS_NOTES["security"]}'
          WHEN category LIKE '%logic%' THEN '{S.MISS_NOTES["logic"]}' WHEN category LIKE '%breaking%' THEN '{S.MISS_NOTES["api"]}' ELSE 'keeps every contract that is checked' END || '; it was scored ' || printf('%.4f', risk) || '.' AS note FROM o WHERE o = 'FP'""",
)
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).where("outcome = 'FP'")
    cause = E.root_cause(F.col("outcome"), F.col("category"), F.col("language"), F.col("risk"), F.lit(0), F.lit(""))
    return rows.select("doc_id", S.miss_note(cause, F.col("risk")).alias("note"))


@register("r_decision_ladder", f"WITH {RECORDS} SELECT doc_id, CASE WHEN toxic = 1 THEN 'REJECTED' ELSE 'APPROVED' END AS status, CASE WHEN toxic = 1 THEN 1.0 ELSE 0.98 END AS confidence, CASE WHEN toxic = 1 THEN 0.95 ELSE 0.05 END AS risk_score, CASE WHEN toxic = 1 THEN 'BreakingPublicAPI,SilentLogicDrift' ELSE '' END AS active FROM records")
def r_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.verify import heuristic

    said = F.when(F.col("toxic") == 1, F.array(F.lit("ARITY_MISMATCH: x"))).otherwise(F.array().cast("array<string>"))
    rows = records(spark, sf_dir).withColumn("violations", said).withColumn("d", heuristic(F.lit("APPROVED"), F.col("violations"), F.array().cast("array<array<string>>")))
    return rows.select("doc_id", "d.status", "d.confidence", "d.risk_score", F.array_join(S.active_classes(F.col("d.risk_taxonomy")), ",").alias("active"))


@register(
    "r7_scored_decisions",
    f"""WITH {RECORDS}, m AS (SELECT *, least(greatest(risk, 1e-6), 1 - 1e-6) AS p, least(greatest((doc_id % 9) - 4, -6), 6) AS v FROM records),
        s AS (SELECT *, 1 / (1 + exp(-ln(p / (1 - p)) / 1.5)) AS r, least(greatest(sqrt(exp(v)), 0), 1) AS doubt, toxic = 1 AS veto, doc_id % 5 = 0 AS alone FROM m)
        SELECT doc_id AS patch_id, CASE WHEN veto THEN 'REJECTED' WHEN alone OR r < 0.4 THEN 'APPROVED' ELSE 'REJECTED' END AS status,
               CASE WHEN veto THEN 0.95 WHEN alone THEN 0.05 ELSE round(r, 4) END AS risk_score, CASE WHEN veto THEN 0.01 WHEN alone THEN 0.02 ELSE round(doubt, 4) END AS epistemic_uncertainty FROM s""",
)
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with the gate's veto on toxic rows, decided by scores that every fifth row lacks."""
    from ..operators.verify import heuristic, scored

    said = F.when(F.col("toxic") == 1, F.array(F.lit("ARITY_MISMATCH: x"))).otherwise(F.array().cast("array<string>"))
    rows = records(spark, sf_dir).withColumn("violations", said).withColumn("d", heuristic(F.lit("APPROVED"), F.col("violations"), F.array().cast("array<array<string>>")))
    reports = rows.select(F.col("doc_id").alias("patch_id"), "violations", "d.status", "d.confidence", "d.risk_score", "d.epistemic_uncertainty")
    scores = rows.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("patch_id"), F.col("risk").alias("risk_score"), ((F.col("doc_id") % 9) - 4).cast("double").alias("log_variance"))
    return scored(reports, scores, 0.4, 1.5).select("patch_id", "status", "risk_score", "epistemic_uncertainty")


_POOLS = f"""WITH {RECORDS}, c AS (SELECT language, label, count(*) FILTER (doc_id % 3 = 0) AS own, count(*) AS n FROM records GROUP BY ALL)"""


@register("e20_topped_up", f"{_POOLS} SELECT language, label, least(n, CASE language WHEN 'python' THEN 20 WHEN 'go' THEN 10 ELSE 0 END) AS records, least(own, CASE language WHEN 'python' THEN 20 WHEN 'go' THEN 10 ELSE 0 END) AS from_first FROM c WHERE language IN ('python', 'go')")
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.mining import topped_up

    rows = _full(spark, sf_dir)
    found = topped_up(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0"), {"python": 40, "go": 20})
    return found.groupBy("language", "label").agg(F.count("*").alias("records"), F.count_if(F.col("doc_id") % 3 == 0).alias("from_first"))


@register(
    "e20_expanded",
    f"""WITH {RECORDS}, n AS (SELECT language, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS n FROM records WHERE toxic = 0 AND doc_id % 2 = 1 GROUP BY language),
        v AS (SELECT *, greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS held FROM n WHERE n > 0), l AS (SELECT unnest([0, 1]) AS label)
        SELECT 'train' AS split, language, label, n - held AS records FROM v, l WHERE n > held UNION ALL SELECT 'val', language, label, held FROM v, l""",
)
def e20_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.mining import expanded

    fresh = _full(spark, sf_dir).where("doc_id % 2 = 1")
    train, val = expanded(fresh.limit(0), fresh.limit(0), fresh)
    both = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    return both.groupBy("split", "language", "label").agg(F.count("*").alias("records"))


@register(
    "e20_held_out",
    f"""WITH {RECORDS}, k AS (SELECT *, regexp_replace(lower(trim(input_dsl)), '\\s+', ' ', 'g') AS k FROM records), left_ AS (SELECT * FROM k WHERE doc_id % 4 = 0 AND k NOT IN (SELECT k FROM k WHERE doc_id % 4 <> 0)),
        n AS (SELECT language, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0), 10) AS n FROM left_ GROUP BY language)
        SELECT language, label, n AS records FROM n, (SELECT unnest([0, 1]) AS label) WHERE n > 0""",
)
def e20_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.mining import held_out

    rows = _full(spark, sf_dir)
    return held_out(rows.where("doc_id % 4 = 0"), rows.where("doc_id % 4 <> 0"), 20).groupBy("language", "label").agg(F.count("*").alias("records"))


@register("t11_normal_paths", r"""SELECT page_id, regexp_replace(regexp_replace(replace(replace(url, '/', '\') || '//x', '\', '/'), '/+', '/', 'g'), '^https:/', '') AS path,
    CASE WHEN suffix(url, 'l') THEN url[:-2] ELSE url END AS cut FROM pages""")
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    odd = F.concat(F.replace("url", F.lit("/"), F.lit("\\")), F.lit("//x"))
    return rows.select("page_id", S.normal_path(odd, "https:").alias("path"), S.without_suffix(F.col("url"), "l").alias("cut"))
