"""Performance lint as a table: diagnostics of the extraction pass, less what comments suppress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patches

#: The comment that silences a line (after any tool name and a colon), with an optional list of rules.
MARK = r"[\w-]+:\s*ignore-perf(?:\[([A-Za-z0-9_,\s]*)\])?"


def suppressions(files: DataFrame, mark: str = MARK) -> DataFrame:
    """``(file_path, line, rules)``: silenced lines; a comment that is alone on its line silences the next one.

    No rules listed: all of them. A mark on a loop's head silences rules 1 and 2 in the loop (see ``diagnostics``).
    """
    lines = files.select("file_path", F.posexplode(F.split("content", "\n")).alias("n", "text")).where(F.col("text").rlike(mark))
    listed = F.regexp_extract("text", mark, 1)
    rules = F.when(listed == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(listed, ","), lambda r: F.upper(F.trim(r))))
    alone = F.trim("text").rlike(r"^(#|//|/\*)")
    return lines.select("file_path", F.explode(F.when(alone, F.array(F.col("n") + 1, F.col("n") + 2)).otherwise(F.array(F.col("n") + 1))).alias("line"), rules.alias("rules"))


def diagnostics(facts: DataFrame, files: DataFrame, severity: str | None = None, mark: str = MARK) -> DataFrame:
    """Findings of the files, in no order; ``severity='error'`` keeps errors only."""
    found = facts.select("file_path", F.explode("lint").alias("d")).select("file_path", "d.*").distinct()
    if severity == "error":
        found = found.where("severity = 'error'")
    quiet = suppressions(files, mark).withColumnRenamed("file_path", "f")
    in_loop = F.col("rule_id").isin("PERF001", "PERF002") & F.array_contains("loop_lines", F.col("line"))
    covers = (F.col("f") == F.col("file_path")) & ((F.col("line") == F.col("lineno")) | in_loop) & ((F.size("rules") == 0) | F.array_contains("rules", F.col("rule_id")))
    kept = found.join(quiet, covers, "left_anti")
    text = files.select("file_path", F.split("content", "\n").alias("text"))
    return kept.join(text, "file_path").withColumn("context_line", F.trim(F.get("text", F.col("lineno") - 1))).drop("text")


def patch_diagnostics(changes: DataFrame, files: DataFrame, severity: str | None = None) -> DataFrame:
    """Findings of patched texts, each change applied to its own file and nothing written: ``patch_id`` and the columns of ``diagnostics``."""
    located = patches.locate(changes, files)
    keyed = located.withColumn("file_path", F.to_json(F.struct("patch_id", "file_path")))
    found = diagnostics(keyed, keyed.select("file_path", F.col("patched").alias("content")), severity)
    key = F.from_json("file_path", "patch_id string, file_path string")
    return found.select(key["patch_id"].alias("patch_id"), key["file_path"].alias("file_path"), *[c for c in found.columns if c != "file_path"])


def report_text(found: DataFrame, most: int = 1000) -> str:
    """Findings as lines of text in order of file and place; a report, so it is limited."""
    rows = found.orderBy("file_path", "lineno", "col", "rule_id").limit(most).collect()
    lines = [f"{r.file_path}:{r.lineno}:{r.col}: {r.severity} {r.rule_id} {r.message}\n    {r.context_line}" for r in rows]
    return "\n".join([*lines, f"{len(rows)} findings"])


def totals(found: DataFrame) -> DataFrame:
    count: list[Column] = [F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn")]
    return found.agg(F.count("*").alias("findings"), *count, F.count_distinct("file_path").alias("files"))
