"""Labelled records: normalising, quality gate, inspection, balancing, splits, conflicts, leakage.

A record has ``input_dsl, label (1 pass, 0 reject), risk_score, category, language, taxonomy_labels,
symbolic_gate_passed, source_type``. Row order where a choice is made is a hash of a seed and the text, so
results are the same on any cluster; counts, parity and disjointness are what is promised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LANGUAGES, RISK_CLASSES, risk_map, token_count

SCHEMA = "input_dsl string, label int, risk_score double, category string, language string, taxonomy_labels map<string,double>, symbolic_gate_passed boolean, source_type string"

#: Categories that a record may have.
CATEGORIES = (
    "clean_pass", "arity_breaking", "keyword_changes", "circular_imports", "deleted_symbol", "breaking_public_api", "security_surface", "concurrency_hazard", "performance_regression",
    "silent_logic_drift", "logic_drift", "type_drift", "resource_leak", "concurrency_leak", "side_effect", "real_revert", "real_hotfix", "clean_commit", "surviving_mutant",
    "truthiness_inversion", "mutable_defaults", "floating_promises", "optional_chaining_drift", "unhandled_channel_read", "unclosed_resource",
)


def normalised(records: DataFrame) -> DataFrame:
    """Fill in what a record may leave out; class scores that are missing are 0, a missing map follows the category."""
    zero = F.create_map(*[x for c in RISK_CLASSES for x in (F.lit(c), F.lit(0.0))])
    given = F.map_zip_with(zero, F.col("taxonomy_labels"), lambda _, a, b: F.coalesce(b, a))
    scores = F.when(F.col("taxonomy_labels").isNull(), risk_map(F.col("category"), F.col("label"), F.col("risk_score"))).otherwise(given)
    return records.withColumn("taxonomy_labels", scores).withColumn("symbolic_gate_passed", F.coalesce("symbolic_gate_passed", F.lit(True))).withColumn("source_type", F.coalesce("source_type", F.lit("mutation_subtle")))


def pooled(*pools: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pools)


def gate_reasons(max_tokens: int = 400, reject_floor: float = 0.65) -> Column:
    """Why a record fails the gate, as an array; empty passes."""
    tokens, risk, scores = token_count(F.col("input_dsl")), F.col("risk_score"), F.col("taxonomy_labels")
    values = F.transform(F.array(*[F.lit(c) for c in RISK_CLASSES]), lambda c: F.element_at(scores, c))
    faults = {
        "gate": ~F.coalesce(F.col("symbolic_gate_passed"), F.lit(False)),
        "tokens": (tokens <= 0) | (tokens > max_tokens),
        "label": ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)),
        "language": ~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)),
        "taxonomy": scores.isNull() | F.exists(values, lambda v: v.isNull() | (v < 0) | (v > 1)),
        "pass_risk": (F.col("label") == 1) & ~F.coalesce(risk.between(0, 0.25), F.lit(False)),
        "reject_risk": (F.col("label") == 0) & ~F.coalesce(risk.between(reject_floor, 1), F.lit(False)),
        "reject_class": (F.col("label") == 0) & (F.coalesce(F.array_max(values), F.lit(0.0)) < 0.5),
    }
    return F.filter(F.array(*[F.when(v, k) for k, v in faults.items()]), lambda x: x.isNotNull())


def gated(records: DataFrame, max_tokens: int = 400) -> DataFrame:
    return records.withColumn("qc_reason", gate_reasons(max_tokens)).where(F.size("qc_reason") == 0).drop("qc_reason")


def violations(records: DataFrame, max_tokens: int = 400) -> DataFrame:
    """One row for each rule that a record breaks: ``input_dsl, rule``. Rejects need a risk of 0.75 here."""
    risk = F.col("risk_score")
    rules = {
        "label": ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)),
        "risk_range": ~F.coalesce(risk.between(0, 1), F.lit(False)),
        "risk_high_for_pass": F.coalesce(risk.between(0, 1), F.lit(False)) & (F.col("label") == 1) & (risk > 0.25),
        "risk_low_for_reject": F.coalesce(risk.between(0, 1), F.lit(False)) & (F.col("label") == 0) & (risk < 0.75),
        "category": ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)),
        "language": ~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)),
        "empty": F.trim(F.coalesce("input_dsl", F.lit(""))) == "",
        "tokens": token_count(F.col("input_dsl")) > max_tokens,
    }
    found = F.filter(F.array(*[F.when(v, k) for k, v in rules.items()]), lambda x: x.isNotNull())
    return records.select("input_dsl", F.explode(found).alias("rule"))


def inspected(records: DataFrame) -> DataFrame:
    """One row: counts, balance and token figures (exact median, mean to one place)."""
    tokens = token_count(F.col("input_dsl"))
    rows = records.select("label", tokens.alias("t"))
    out = rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("passes"), F.count_if(F.col("label") == 0).alias("rejects"),
        F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens"), F.round(F.avg("t"), 1).alias("mean_tokens"), F.median("t").alias("median_tokens"),
    )
    return out.withColumn("imbalanced", (F.col("total") > 0) & (F.abs(F.col("passes") - F.col("rejects")) > F.greatest(F.lit(2.0), F.col("total") * 0.05)))


def seeded_order(seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), F.col("input_dsl"), F.col("category"))


def numbered(rows: DataFrame, keys: tuple[str, ...], order: Column | None = None, bits: int = 12) -> DataFrame:
    """``rows`` with ``place``, their number from 1 within ``keys``, in the seeded order or a given one.

    In the seeded order rows are numbered within buckets of its leading bits and each bucket begins after those before
    it, so few keys with many rows are still many tasks; the places are those of one sort. A given order is one
    window a key.
    """
    if order is not None:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    rows = rows.withColumn("_order", seeded_order()).withColumn("_bucket", F.shiftright("_order", 64 - bits))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))  # at most 2**bits rows a key
    counts = counts.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_order", "input_dsl", "category"))
    on = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    out = rows.withColumn("_in", inside).join(counts, on).withColumn("place", F.col("_base") + F.col("_in"))
    return out.drop("_order", "_bucket", "_in", "_b", "_base", *[f"_{i}" for i in range(len(keys))])


def stratified(records: DataFrame, target: int, val_ratio: float = 0.2, order: Column | None = None, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Records of a balanced dataset with ``split``: every language has as many rows, half of either label in each split.

    Raises ValueError where a language has too few rows of a label.
    """
    each = target // len(languages)
    val = int(round(each * val_ratio / 2) * 2)
    need, held = each // 2, val // 2
    counts = {(r["language"], r["label"]): r["count"] for r in records.groupBy("language", "label").count().collect()}
    short = [f"{g}/{n}" for g in languages for n in (0, 1) if counts.get((g, n), 0) < need]
    if short:
        raise ValueError(f"too few records for {need} each: {', '.join(short)}")
    rows = numbered(records.where(F.col("language").isin(*languages)), ("language", "label"), order).where(F.col("place") <= need)
    return rows.withColumn("split", F.when(F.col("place") <= need - held, "train").otherwise("val")).drop("place")


def parity(records: DataFrame, per_language: int, order: Column | None = None, keys: tuple[str, ...] = ("language",)) -> DataFrame:
    """Per language as many passes as rejects: at most half of the target each, then the lesser of the two."""
    counts = records.groupBy(*keys).agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), F.lit(per_language // 2)).alias("cap"))
    return numbered(records, (*keys, "label"), order).join(counts, list(keys)).where((F.col("place") <= F.col("cap")) & (F.col("place") <= per_language // 2)).drop("place", "cap")


def export_split(records: DataFrame, val_ratio: float = 0.2, order: Column | None = None) -> DataFrame:
    """Global parity, then the first share of either label is validation (one row at least)."""
    size = records.agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("n"))
    rows = numbered(records, ("label",), order).crossJoin(F.broadcast(size)).where(F.col("place") <= F.col("n"))  # one row
    held = F.greatest(F.lit(1), F.floor(F.col("n") * val_ratio))
    return rows.withColumn("split", F.when(F.col("place") <= held, "val").otherwise("train")).drop("place", "n")


def language_targets(total: int) -> dict[str, int]:
    """How many records each language gets; the weights favour languages with more failure modes."""
    total += total % 2
    fixed = {4900: (1000, 1100, 1000, 1800), 4500: (1000, 1100, 600, 1800)}
    if total in fixed:
        return dict(zip(LANGUAGES, fixed[total], strict=True))
    if total < 100 and total % 4 == 0:
        q, odd = total // 4, total // 4 % 2
        return {"python": q - odd, "typescript": q + odd, "go": q - odd, "rust": q + odd}
    share = [max(2, int(round(w * total / 4900 / 2) * 2)) for w in (1000, 1100, 1000)]
    return dict(zip(LANGUAGES, [*share, max(2, total - sum(share))], strict=True))


def label_conflicts(records: DataFrame) -> DataFrame:
    """Texts with more than one label: ``text_sha, records, labels``."""
    groups = records.groupBy(F.sha2("input_dsl", 256).alias("text_sha")).agg(F.count("*").alias("records"), F.count_distinct("label").alias("labels"))
    return groups.where("labels > 1")


def split_leakage(train: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of ``held`` whose text, case and space folded, is in ``train``."""
    fold = F.sha2(F.regexp_replace(F.lower(F.trim("input_dsl")), r"\s+", " "), 256)
    return held.withColumn("k", fold).join(train.select(fold.alias("k")).distinct(), "k", "left_semi").drop("k")
