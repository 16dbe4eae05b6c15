"""Evaluation of predictions: a pass is predicted below the risk threshold, and pass is the positive class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import logit, sigmoid


def outcome(label: Column, risk: Column, threshold: Column | float) -> Column:
    """TP: safe and approved; FP: missed bug; TN: caught bug; FN: false alarm."""
    passed = risk < threshold
    return F.when(passed, F.when(label == 1, "TP").otherwise("FP")).otherwise(F.when(label == 0, "TN").otherwise("FN"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and metrics (four places) of ``label, risk`` rows that have an ``outcome``, by ``keys``."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "TN", "FN")])
    return with_metrics(counts)


def with_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(
        "*", F.round(_ratio(tp + tn, F.col("total")), 4).alias("accuracy"), F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(_ratio(2 * precision * recall, precision + recall), 4).alias("f1"), F.round(_ratio(tn, tn + fp), 4).alias("specificity"),
    )


def sweep(rows: DataFrame, thresholds: list[float], *keys: str) -> DataFrame:
    """Metrics at each threshold. One pass: every row is counted once for each of the few thresholds."""
    ladder = F.array(*[F.lit(t) for t in thresholds])
    wide = rows.select(*keys, "label", "risk", F.explode(ladder).alias("threshold"))
    return confusion(wide.withColumn("outcome", outcome(F.col("label"), F.col("risk"), F.col("threshold"))), "threshold", *keys)


def breakdown(rows: DataFrame) -> DataFrame:
    """Outcome counts by language, by category and in all, in one grouping."""
    sets = rows.groupingSets([["language"], ["category"], []], "language", "category")
    return sets.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "TN", "FN")])


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of ``label, risk``; the target of a risk is a reject."""
    p = F.least(F.greatest("risk", F.lit(1e-6)), F.lit(1 - 1e-6))
    binned = rows.select(F.least(F.lit(bins - 1), F.floor(p * bins)).alias("bin"), p.alias("p"), (1 - F.col("label")).alias("y"))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("y") - F.avg("p")).alias("gap"))
    return per.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 4).alias("ece"))


def fitted_temperature(rows: DataFrame, low: float = 0.1, high: float = 10.0, rounds: int = 5) -> float:
    """The temperature with the least cross-entropy. Each round is one pass over the rows with 16 candidates."""
    z, y = logit(F.col("risk")), 1 - F.col("label")
    for _ in range(rounds):
        grid = [low * (high / low) ** (i / 15) for i in range(16)]
        loss = lambda t: F.avg(-y * F.log(sigmoid(z / t)) - (1 - y) * F.log(1 - sigmoid(z / t)))
        found = rows.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(grid)]).first()
        if found[0] is None:
            return 1.0
        best = min(range(16), key=lambda i: found[i])
        low, high = grid[max(0, best - 1)], grid[min(15, best + 1)]
    return round((low * high) ** 0.5, 4)


def temperature_grid(rows: DataFrame, grid: list[float]) -> DataFrame:
    """Cross-entropy at each temperature of a grid."""
    z, y = logit(F.col("risk")), 1 - F.col("label")
    wide = rows.select(z.alias("z"), y.alias("y"), F.explode(F.array(*[F.lit(t) for t in grid])).alias("temperature"))
    p = sigmoid(F.col("z") / F.col("temperature"))
    return wide.groupBy("temperature").agg(F.round(F.avg(-F.col("y") * F.log(p) - (1 - F.col("y")) * F.log(1 - p)), 6).alias("loss"))


def losses(rows: DataFrame, delta: float = 0.1, risk_weight: float = 1.0, noise: tuple[float, float, float] | None = None) -> DataFrame:
    """Multi-task losses of ``risk, target, log_variance``: Huber, cross-entropy, heteroscedastic likelihood, and their total.

    ``risk_weight`` above 1 counts the Huber loss of risky targets (from 0.5) so many times; ``noise`` weighs the
    three by their homoscedastic uncertainty, else they add up.
    """
    e = F.abs(F.col("risk") - F.col("target"))
    huber = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)) * F.when(F.col("target") >= 0.5, float(max(1.0, risk_weight))).otherwise(1.0)
    p = F.least(F.greatest("risk", F.lit(1e-6)), F.lit(1 - 1e-6))
    bce = -F.col("target") * F.log(p) - (1 - F.col("target")) * F.log(1 - p)
    s = F.least(F.greatest("log_variance", F.lit(-6.0)), F.lit(6.0))
    out = rows.agg(F.avg(huber).alias("huber"), F.avg(bce).alias("bce"), F.avg(0.5 * F.exp(-s) * e * e + 0.5 * s).alias("nll"))
    if noise is None:
        return out.withColumn("total", F.col("huber") + F.col("bce") + F.col("nll"))
    weighed = [0.5 / a**2 * F.col(c) for a, c in zip(noise, ("huber", "bce", "nll"), strict=True)]
    return out.withColumn("total", weighed[0] + weighed[1] + weighed[2] + F.log(F.lit(abs(noise[0] * noise[1] * noise[2]) + 1e-8)))


def uncertainty_by_outcome(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("uncertainty"), 4).alias("mean_uncertainty"))


#: Which kind of miss a category names, and its words; the first that fits.
_MISSES = (("security", ("security",)), ("logic", ("logic", "drift")), ("api", ("breaking", "api")), ("concurrency", ("concurrency", "hazard")), ("performance", ("performance",)))


def root_cause(outcome_: Column, category: Column, language: Column, risk: Column, nodes: Column, target: Column) -> Column:
    """A label for why a prediction is wrong: for missed bugs by category and language, for false alarms by shape."""
    low = F.lower(category)
    kind = F.when(low == "real_revert", "revert")
    for name, words in _MISSES:
        test = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            test = test | F.contains(low, F.lit(w))
        kind = kind.when(test, name)
    missed = F.concat_ws("/", F.lit("missed"), F.coalesce(kind, F.lit("other")), F.when(F.coalesce(kind, F.lit("")) != "revert", F.lower(language)))
    harness = F.lower(target).rlike("test|mock")
    alarm = F.when(nodes > 10, "alarm/many_nodes").when(harness, "alarm/test_harness").when(risk > 0.7, "alarm/high_risk").otherwise("alarm/borderline")
    return F.when(outcome_ == "FP", missed).when(outcome_ == "FN", alarm).otherwise("correct")


def parity_gap(rows: DataFrame) -> DataFrame:
    """Largest and mean absolute difference of two runs' scores ``a, b``."""
    return rows.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs"))


def report_markdown(rows: DataFrame, thresholds: list[float], title: str = "Error analysis") -> str:
    """Metrics, breakdown, threshold sweep and calibration of ``label, risk, language, category`` rows, as Markdown."""
    from .reports import markdown

    judged = rows.withColumn("outcome", outcome(F.col("label"), F.col("risk"), 0.5))
    parts = [("Metrics", confusion(judged)), ("By language and category", breakdown(judged)), ("Thresholds", sweep(rows, thresholds).orderBy("threshold")), ("Calibration", calibration_error(rows))]
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{markdown(found)}" for name, found in parts) + "\n"


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
