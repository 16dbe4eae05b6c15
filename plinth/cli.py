"""Command line: index, slice, clean, verify, dead-code, perf-lint, mine, dataset, export, hook, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dead_code, graph, lint, mining, mutate, records, reports
from .operators.verify import call_graph, scored, settings, verify
from .sources import code, records_io, snapshot


def session() -> SparkSession:
    made = SparkSession.builder.appName("plinth").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def workspace(spark: SparkSession, root: str) -> DataFrame:
    return code.scan(spark, os.path.abspath(root))


def _index_root(root: str) -> str:
    return f"file://{os.path.abspath(root)}/.plinth-index"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def verify_code_patch(spark: SparkSession, root: str, file_path: str, patch: str, replacement: bool = False, threshold: float | None = None, temperature: float | None = None, scores: str | None = None) -> dict:
    """One report; threshold and temperature also come of the environment or of ``.plinth-model.json`` in the workspace."""
    limit, warmth = settings(threshold, temperature, os.path.join(root, ".plinth-model.json"))
    change = spark.createDataFrame([("patch", file_path, patch, replacement)], "patch_id string, file_path string, patch string, is_replacement boolean")
    found = verify(workspace(spark, root), change, threshold=limit)
    if scores:
        found = scored(found, spark.read.json(scores), limit, warmth)
    return _rows(found)[0]


def detect_dead_code(spark: SparkSession, root: str, min_lines: int = 1, paths: list[str] | None = None, exported: bool = True) -> list[dict]:
    files = workspace(spark, root)
    found = dead_code.triaged(dead_code.dead_symbols(code.extract(files), files, min_lines, paths, exported))
    return _rows(found.orderBy("file_path", "lineno").select("symbol_id", "kind", "lineno", "lines", "dead_kind", "cluster_root", "reason", "classification", "suppressed").limit(reports.MOST))


def lint_performance_patterns(spark: SparkSession, root: str, severity: str | None = None, file_path: str | None = None, patch: str | None = None) -> list[dict]:
    """Findings of the workspace, or of one file as a patch would leave it."""
    files = workspace(spark, root)
    if file_path and patch:
        change = spark.createDataFrame([("patch", file_path, patch, False)], "patch_id string, file_path string, patch string, is_replacement boolean")
        found = lint.patch_diagnostics(change, files, severity)
    else:
        found = lint.diagnostics(code.extract(files), files, severity)
    return _rows(found.orderBy("file_path", "lineno", "col", "rule_id").limit(reports.MOST))


def _told(spark: SparkSession, rows: list[dict], form: str) -> str:
    if form == "json" or not rows:
        return json.dumps(rows, indent=2)
    flat = [{k: v if isinstance(v, str | int | float) else json.dumps(v) for k, v in r.items()} for r in rows]
    return reports.FORMS[form](spark.createDataFrame(flat).select(list(flat[0])))


TOOLS = {f.__name__: f for f in (verify_code_patch, detect_dead_code, lint_performance_patterns)}


def serve(spark: SparkSession) -> int:
    """One JSON request ``{"tool", "arguments"}`` a line on standard input, one JSON answer a line on standard output."""
    for line in sys.stdin:
        try:
            asked = json.loads(line)
            answer = {"result": TOOLS[asked["tool"]](spark, **asked.get("arguments", {}))}
        except Exception as error:  # noqa: BLE001  a bad request must not end the server
            answer = {"error": str(error)[:500]}
        print(json.dumps(answer, default=str), flush=True)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plinth", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *more: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--root", default=".")
        for flag in more:
            p.add_argument(flag, action="store_true")
        return p

    add("index", "--force")
    add("clean")
    add("serve")
    p = add("verify", "--replacement")
    p.add_argument("file")
    p.add_argument("--patch-file")
    p.add_argument("--threshold", type=float)
    p.add_argument("--temperature", type=float)
    p.add_argument("--scores", help="JSON lines of patch_id, risk_score and log_variance from a model")
    p = add("slice")
    p.add_argument("symbol")
    p.add_argument("--hops", type=int, default=1)
    p = add("dead-code", "--internal-only")
    p.add_argument("--min-lines", type=int, default=1)
    p.add_argument("--path", action="append")
    p.add_argument("--form", choices=sorted(reports.FORMS), default="json")
    p = add("perf-lint")
    p.add_argument("--form", choices=sorted(reports.FORMS), default="json")
    p.add_argument("--fail-on", choices=["error", "warn", "never"], default="error")
    p = add("dataset")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--target", type=int, default=400)
    p = add("export")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--val-ratio", type=float, default=0.2)
    p = add("mine", "--structural", "--mutants", "--history")
    p.add_argument("output")
    p = add("hook")
    p.add_argument("action", choices=["install", "uninstall", "on", "off", "block", "warn", "status", "run"])
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "hook":
        from . import hook

        if args.action == "run":
            return hook.run(args.root)
        if args.action in ("install", "uninstall"):
            print(getattr(hook, args.action)(args.root))
        else:
            change = {"on": {"enabled": True}, "off": {"enabled": False}, "block": {"mode": "block"}, "warn": {"mode": "warn"}, "status": {}}[args.action]
            print(json.dumps(hook.config(args.root, **change)))
        return 0
    spark = session()
    if args.command == "index":
        print(json.dumps(snapshot.refresh(spark, workspace(spark, args.root).drop("sha"), _index_root(args.root), args.force)))
        return 0
    if args.command == "clean":
        snapshot.clean(spark, _index_root(args.root))
        return 0
    if args.command == "serve":
        return serve(spark)
    if args.command == "verify":
        patch = open(args.patch_file).read() if args.patch_file else sys.stdin.read()
        if not patch.strip():
            return 2
        report = verify_code_patch(spark, args.root, args.file, patch, args.replacement, args.threshold, args.temperature, args.scores)
        print(json.dumps(report, default=str, indent=2))
        return int(report["status"] != "APPROVED")
    if args.command == "slice":
        files = workspace(spark, args.root)
        edges = call_graph(code.extract(files), files)
        known = code.symbols(code.extract(files)).where((F.col("symbol_id") == args.symbol) | (F.col("qualname") == args.symbol) | (F.col("name") == args.symbol))
        first = known.orderBy("file_path", "sym_ord").limit(1).select(F.lit("slice").alias("patch_id"), F.col("symbol_id").alias("node"))
        nodes, inside = graph.neighbourhood(edges, first, args.hops)
        print(json.dumps({"nodes": _rows(nodes), "edges": _rows(inside)}, indent=2))
        return 0
    if args.command == "dead-code":
        found = detect_dead_code(spark, args.root, args.min_lines, args.path, not args.internal_only)
        print(_told(spark, found, args.form))
        return int(bool(found))
    if args.command == "perf-lint":
        found = lint_performance_patterns(spark, args.root)
        print(_told(spark, found, args.form))
        worst = {d["severity"] for d in found}
        return int(args.fail_on != "never" and ("error" in worst or args.fail_on == "warn" and bool(worst)))
    if args.command == "mine":
        files = workspace(spark, args.root)
        if args.history:
            found = mining.history_records(files, mining.mined_history(*records_io.history(spark, args.root)))
        else:
            found = mutate.surviving(files) if args.mutants else mining.mined(files, args.structural)
        found.write.mode("overwrite").json(args.output)
        return 0
    if args.command == "export":
        print(json.dumps(_rows(records_io.write_splits(records.export_split(records_io.read_records(spark, args.input), args.val_ratio), args.output))))
        return 0
    out = records.stratified(records_io.read_records(spark, args.input), args.target)
    print(json.dumps(_rows(records_io.write_splits(out, args.output))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
