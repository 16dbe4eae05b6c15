"""Verification of patches in batch: locate, gate, slice, text, decision."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import RISK_CLASSES, active_classes, confidence, tempered
from ..session import Scratch
from ..sources import code
from . import gate as symbolic
from . import graph, index, patches


def count_tokens(text: str) -> int:
    return len(re.findall(r"[A-Za-z0-9_]+|[^\w\s]", text))


def _lines(values: list[int]) -> str:
    return str(values) if len(values) <= 6 else f"[{values[0]}..{values[-1]}] ({len(values)} lines)"


def linearise(row: dict[str, Any], max_tokens: int = 400) -> str:
    """A change, its neighbourhood and its verdict as text of at most ``max_tokens``.

    Too long a text loses nodes from the end, then seeds, then lines, then words.
    """
    for names, what in ((row["affected"], "MODIFIED"), (row["deleted"], "DELETED"), (row["added"], "ADDED")):
        if names:
            break
    target = f"[DIFF_TARGET] {row['file_path']}::{', '.join(names) if names else '<module>'} ({what if names else 'MODIFIED'})"
    nodes, edges, faults = row["nodes"] or [], row["edges"] or [], row["violations"] or []
    facts = f"[METADATA] File: {row['file_path']} | OldLines: {_lines(row['old_lines'])} | NewLines: {_lines(row['new_lines'])} | Nodes: {len(nodes)} | Edges: {len(edges)}"
    shown = "VIOLATIONS: NONE" if not faults else "VIOLATIONS:" + "".join(f"\n  - {v}" for v in faults[:3]) + (f"\n  - ... ({len(faults) - 3} more)" if len(faults) > 3 else "")
    verdict = f"[GATE]\nSTATUS: {row['status']} (conf: {round(row['confidence'], 2)})\nCYCLES: {len(row['cycles'] or [])}\n{shown}"
    nodes = sorted(nodes, key=lambda n: (not n["seed"], n["place"]))
    number = {n["node"]: f"N{i}" for i, n in enumerate(nodes)}

    def text(kept: list[dict[str, Any]], note: str = "") -> str:
        ids = {n["node"] for n in kept}
        flags = lambda n: ", ".join(w for w, f in (("SEED", n["seed"]), ("MODIFIED", n["seed"]), ("TRUNCATED", n["truncated"])) if f)
        body = "\n".join(f"{number[n['node']]}: {n['node'].split('::')[0]}::{n['name']} [{n['signature']}]" + (f" ({flags(n)})" if flags(n) else "") for n in kept) or "(none)"
        links = "\n".join(f"{number[e['src']]} -> {number[e['dst']]} ({e['relation']})" for e in edges if e["src"] in ids and e["dst"] in ids) or "(none)"
        return f"{target}\n{facts}\n[NODES]\n{body}\n[EDGES]\n{links}\n{verdict}{note}"

    out, kept = text(nodes), list(nodes)
    seeds = sum(n["seed"] for n in nodes)
    while count_tokens(out) > max_tokens and len(kept) > min(1, seeds):
        kept.pop()
        out = text(kept, f"\n[TRUNCATED: {len(nodes) - len(kept)} nodes pruned]")
    for sep in ("\n", " "):
        parts = out.split(sep)
        while len(parts) > (2 if sep == "\n" else 0) and count_tokens(sep.join(parts)) > max_tokens:
            parts.pop()
        out = sep.join(parts)
    return out


def _texts(batches: Iterator[pa.RecordBatch], max_tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([linearise(r, max_tokens) for r in rows], pa.string())], ["patch_id", "file_path", "input_dsl"])


def call_graph(facts: DataFrame, files: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """``(src, dst, relation, ord)``: resolved calls and inheritance between symbols."""
    symbols, calls = code.symbols(facts), code.calls(facts)
    resolved = resolved if resolved is not None else index.resolve_imports(code.imports(facts), files)
    edges = index.resolve_calls(calls, symbols, resolved).where("target_id is not null").groupBy(F.col("caller_id").alias("src"), F.col("target_id").alias("dst")).agg(F.min("call_ord").alias("ord"))
    names = index.name_index(symbols.where(F.col("kind").isin("class", "struct", "interface")))
    bases = symbols.select("symbol_id", F.posexplode("bases").alias("ord", "key")).join(names.withColumnRenamed("symbol_id", "dst"), "key")
    return edges.select("src", "dst", F.lit("CALLS").alias("relation"), "ord").unionByName(bases.select(F.col("symbol_id").alias("src"), "dst", F.lit("INHERITS").alias("relation"), "ord"))


def heuristic(status: Column, violations: Column, cycles: Column, threshold: float = 0.5) -> Column:
    """Decision without a model: a struct of status, confidence, risk, uncertainty and class scores.

    Any violation vetoes: risk 0.95, class scores by what the violations say. A clean change has risk 0.05.
    """
    veto = (status == "REJECTED") | (F.size(violations) > 0)
    said = lambda *words: F.exists(violations, lambda v: F.lower(v).rlike("|".join(words)))
    cyclic = F.size(cycles) > 0
    api = F.when(said("arity", "keyword", "broken", "duplicate", "signature") | ~cyclic, 0.95).otherwise(0.4)
    scores = {"BreakingPublicAPI": (api, 0.02), "SecuritySurface": (F.when(said("security", "auth", "inject"), 0.9).otherwise(0.05), 0.01), "ConcurrencyHazard": (F.when(cyclic, 0.95).otherwise(0.05), 0.01), "PerformanceRegression": (F.when(said("perf", "leak", "slow"), 0.9).otherwise(0.05), 0.01), "SilentLogicDrift": (F.lit(0.85), 0.02)}
    chart = F.create_map(*[x for c in RISK_CLASSES for x in (F.lit(c), F.when(veto, scores[c][0]).otherwise(scores[c][1]))])
    risk = F.when(veto, 0.95).otherwise(0.05)
    return F.struct(F.when(risk < threshold, "APPROVED").otherwise("REJECTED").alias("status"), F.when(veto, 1.0).otherwise(0.98).alias("confidence"), risk.alias("risk_score"), F.when(veto, 0.01).otherwise(0.02).alias("epistemic_uncertainty"), chart.alias("risk_taxonomy"))


def settings(threshold: float | None = None, temperature: float | None = None, config: str | None = None) -> tuple[float, float]:
    """Threshold and temperature: as given, else of the environment, else of a JSON file, else 0.5 and 1."""
    found = {}
    if config and os.path.exists(config):
        with open(config) as f:
            found = json.load(f)
    out = []
    for given, name, key, default in ((threshold, "PLINTH_RISK_THRESHOLD", "default_decision_threshold", 0.5), (temperature, "PLINTH_TEMPERATURE", "calibrated_temperature", 1.0)):
        try:
            out.append(float(given if given is not None else os.environ.get(name, found.get(key, default))))
        except ValueError:
            out.append(default)
    return out[0], out[1]


def scored(reports: DataFrame, scores: DataFrame, threshold: float = 0.5, temperature: float = 1.0) -> DataFrame:
    """``reports`` with the decision of a model that scored them elsewhere: ``scores(patch_id, risk_score[, log_variance])``.

    The gate's veto stays; a change that it lets by takes the model's risk, tempered, and is approved below the
    threshold. Without a score the heuristic decision stands.
    """
    spread = "log_variance" if "log_variance" in scores.columns else F.lit(-6.0)
    given = scores.select("patch_id", tempered(F.col("risk_score"), temperature).alias("model_risk"), (F.lit(1.0) - confidence(F.col(spread) if isinstance(spread, str) else spread)).alias("model_doubt"))
    rows = reports.join(given, "patch_id", "left")
    free = (F.size("violations") == 0) & F.col("model_risk").isNotNull() & (F.col("risk_score") < 0.95)
    risk = F.when(free, F.round("model_risk", 4)).otherwise(F.col("risk_score"))
    status = F.when(free, F.when(F.col("model_risk") < threshold, "APPROVED").otherwise("REJECTED")).otherwise(F.col("status"))
    doubt = F.when(free, F.round("model_doubt", 4)).otherwise(F.col("epistemic_uncertainty"))
    sure = F.when(free, F.round(1 - F.col("model_doubt"), 4)).otherwise(F.col("confidence"))
    return rows.withColumns({"status": status, "risk_score": risk, "epistemic_uncertainty": doubt, "confidence": sure}).drop("model_risk", "model_doubt")


def verify(files: DataFrame, changes: DataFrame, hops: int = 1, max_fanout: int = 20, max_nodes: int = 50, threshold: float = 0.5, max_tokens: int = 400, overlays: DataFrame | None = None) -> DataFrame:
    """One report for each ``patch_id`` and file of ``changes(patch_id, file_path, patch, is_replacement)``.

    Columns: ``patch_id, file_path, status, confidence, risk_score, epistemic_uncertainty, risk_taxonomy,
    active_categories, violations, cycles, affected, input_dsl``. Files that share a patch id are judged together.
    ``overlays(file_path, content)`` stand for the workspace's own files, as what is staged does for a dirty copy.
    """
    if overlays is not None:
        files = index.overlay(files.select("file_path", "content"), overlays.select("file_path", "content"))
    scratch = Scratch(files.sparkSession, "verify")
    located = scratch.keep(patches.locate(changes, files), "located")
    facts = scratch.keep(code.extract(files), "facts")
    resolved = scratch.keep(index.resolve_imports(code.imports(facts), files), "imports")
    edges = scratch.keep(call_graph(facts, files, resolved), "edges")
    verdicts = scratch.keep(symbolic.gate(located, facts, files, hops, resolved, edges.where("relation = 'CALLS'")), "verdicts")
    seeds = located.select("patch_id", "file_path", F.explode(F.array_distinct(F.concat("affected", "added", "deleted"))).alias("q")).select("patch_id", F.concat_ws("::", "file_path", "q").alias("node"))
    nodes, inside = graph.neighbourhood(edges, seeds, hops, max_fanout, max_nodes)
    known = code.symbols(facts).select(F.col("symbol_id").alias("node"), "name", "signature").dropDuplicates(["node"])
    short = F.element_at(F.split("node", "::"), -1)
    shown = nodes.join(known, "node", "left").withColumn("item", F.struct("node", F.coalesce("name", short).alias("name"), F.coalesce("signature", F.concat(F.lit("def "), short, F.lit("(...)"))).alias("signature"), (F.col("hop") == 0).alias("seed"), "place", "truncated"))
    rows = located.join(verdicts.drop("unparsed"), "patch_id").join(shown.groupBy("patch_id").agg(F.collect_list("item").alias("nodes")), "patch_id", "left").join(inside.groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "relation"))).alias("edges")), "patch_id", "left")
    rows = scratch.keep(rows, "rows")
    wanted = rows.select("patch_id", "file_path", "affected", "added", "deleted", "old_lines", "new_lines", "nodes", "edges", "status", "confidence", "violations", "cycles")
    texts = wanted.mapInArrow(lambda it: _texts(it, max_tokens), "patch_id string, file_path string, input_dsl string")
    judged = rows.withColumn("d", heuristic(F.col("status"), F.col("violations"), F.col("cycles"), threshold)).drop("status", "confidence")
    unparsed = F.col("syntax_error").isNotNull()
    out = judged.join(texts, ["patch_id", "file_path"])
    return out.select(
        "patch_id", "file_path", F.col("d.status").alias("status"), F.col("d.confidence").alias("confidence"), F.when(unparsed, 1.0).otherwise(F.col("d.risk_score")).alias("risk_score"), F.col("d.epistemic_uncertainty").alias("epistemic_uncertainty"),
        F.col("d.risk_taxonomy").alias("risk_taxonomy"), active_classes(F.col("d.risk_taxonomy"), threshold).alias("active_categories"), "violations", "cycles", "affected", "input_dsl",
    )
