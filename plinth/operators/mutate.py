"""Mutation operators: small faults planted in sources, kept where the gate lets them by, and paired with clean changes.

Operators work on lines; a cap is looked at after each line, so one line may pass it by what it adds. Nothing
is ever executed: a mutant is kept or dropped by syntax and by the gate alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import RISK_CLASSES, language_of, risk_map
from ..session import Scratch, ship
from ..sources import code
from . import verify as V
from .dead_code import in_test_file

#: A pattern, what takes its place, and a note.
Rule = tuple[str, str | Callable[[re.Match], str], str]


class Mutator(NamedTuple):
    """A named fault: its category and class of risk, its cap a file, other classes it touches, and its rules by language.

    Rules come in groups: of each group the first rule that changes a line makes a mutant.
    """

    name: str
    category: str
    risk_class: str
    most: int
    rules: dict[str, tuple[tuple[Rule, ...], ...]]
    #: Shares of the first score that other classes get.
    beside: dict[str, float] = {}


def _turned(a: str, b: str) -> tuple[Rule, ...]:
    """Either way, the first place of a line."""
    return ((re.escape(a), b, f"{a.strip()} to {b.strip()}"), (re.escape(b), a, f"{b.strip()} to {a.strip()}"))


_LOOKUP: tuple[Rule, ...] = ((r"\.get\((\s*[\"'][^\"']+[\"'])\s*(?:,[^()]*)?\)", r"[\1]", "lookup without default"),)
_CLOSE: tuple[Rule, ...] = ((r"^(\s*)[\w.]+\.(close|destroy|end)\(\);?\s*$", r"\1;", "close dropped"),)
MUTATORS = (
    Mutator("truthiness_inversion", "silent_logic_drift", "SilentLogicDrift", 5, {
        "python": (
            ((r"^(\s*(?:if|elif)\s+)not\s+(?=[\w().'\" ]+:)", r"\1", "negation dropped"), (r"^(\s*(?:if|elif)\s+)([\w.]+):", r"\1not (\2):", "negation added")),
            _turned(" == ", " != "), ((r" is None", " is not None", "none test turned"), (r" is not None", " is None", "none test turned")),
        ),
        "typescript": ((*_turned(" === ", " !== "), (r"\bif\s*\(!\s*([\w.]+)\)", r"if (\1)", "negation dropped"), (r"\bif\s*\(([\w.]+)\)", r"if (!\1)", "negation added")),),
        "go": ((*_turned("err != nil", "err == nil"), (" == ", " != ", "== to !=")),),
        "rust": (_turned(" == ", " != "),),
    }),
    Mutator("mutable_defaults", "silent_logic_drift", "SilentLogicDrift", 3, {"python": (((r"(def\s+\w+\([^)]*?\w+(?:\s*:\s*[\w\[\], |]+)?\s*=\s*)None\b", r"\1[]", "shared default"),),)}),
    Mutator("floating_promises", "concurrency_hazard", "ConcurrencyHazard", 4, {"typescript": (((r"\bawait\s+(?=[\w.]+\()", "", "await dropped"),),)}, {"SilentLogicDrift": 0.75}),
    Mutator("optional_chaining_drift", "silent_logic_drift", "SilentLogicDrift", 4, {
        "python": (_LOOKUP,), "typescript": (((r"\?\.(?=\w)", ".", "optional chain dropped"),), ((r"\s\?\?\s[^;,)]+", "", "fallback dropped"),), _LOOKUP),
    }, {"BreakingPublicAPI": 0.65}),
    Mutator("unhandled_channel_read", "concurrency_hazard", "ConcurrencyHazard", 3, {
        "go": (((r"(\w+)\s*,\s*ok\s*:=\s*<-\s*(\w+)", r"\1 := <-\2", "closed channel not told"),),),
        "python": (((r"\.get\(\s*timeout\s*=\s*[^)]+\)", ".get()", "wait without end"),), ((r"\.get_nowait\(\)", ".get()", "wait without end"),)),
    }, {"SilentLogicDrift": 0.8}),
    Mutator("unclosed_resource", "resource_leak", "PerformanceRegression", 3, {
        "python": (((r"^(\s*)with\s+(.+?)\s+as\s+(\w+)\s*:\s*$", r"\1\3 = \2\n\1if True:", "scope dropped"),), ((r"^(\s*)[\w.]+\.close\(\)\s*$", r"\1pass", "close dropped"),)),
        "typescript": (_CLOSE,), "go": (((r"^\s*defer\s+[\w.]+\.Close\(\)\s*$", "", "close dropped"),), _CLOSE),
        "rust": (((r"^(\s*)drop\((\w+)\);\s*$", r"\1std::mem::forget(\2);", "value leaked"),),),
    }),
)


def mutants(source: str, language: str, mutators: tuple[Mutator, ...] = MUTATORS) -> list[tuple[str, str, str, str]]:
    """``(mutator, category, note, mutated source)``; each mutant changes one place and still parses."""
    lines, out = source.split("\n"), []
    for m in mutators:
        made = 0
        for n, line in enumerate(lines):
            if not line.strip() or line.lstrip().startswith(("#", "//", "/*", "*")):
                continue
            for group in m.rules.get(language, ()):
                for pattern, to, note in group:
                    changed = re.sub(pattern, to, line, count=1)
                    if changed != line:
                        text = "\n".join([*lines[:n], changed, *lines[n + 1 :]])
                        if code.facts_of(text, language)["syntax_error"] is None:
                            out.append((m.name, m.category, f"line {n + 1}: {note}", text))
                            made += 1
                        break
            if made >= m.most:
                break
    return out


def _harvested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(path, i, *m) for path, source, g in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, m in enumerate(mutants(source or "", g))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 1 else pa.string()) for i in range(6)], ["file_path", "place", "mutator", "category", "note", "patch"])


def harvest(files: DataFrame) -> DataFrame:
    """Mutants that parse, in the mutators' order: changes ready for ``verify``; test files give none.

    ``patch_id, file_path, patch, is_replacement, mutator, category, note, place``.
    """
    ship(files.sparkSession)
    rows = files.where(~in_test_file()).select("file_path", "content", language_of(F.col("file_path")).alias("language"))
    made = rows.mapInArrow(_harvested, "file_path string, place int, mutator string, category string, note string, patch string")
    return made.withColumn("patch_id", F.sha2(F.concat_ws("|", "file_path", "mutator", "place", "note"), 256)).withColumn("is_replacement", F.lit(True))


def remarked(files: DataFrame, text: str = "reviewed, nothing changes here") -> DataFrame:
    """One clean change of each file: a remark above its first line."""
    mark = F.when(language_of(F.col("file_path")) == "python", F.lit(f"# {text}")).otherwise(F.lit(f"// {text}"))
    patch = F.concat(F.lit("@@ -0,0 +1 @@\n+"), mark, F.lit("\n"))
    return files.select(F.concat(F.lit("clean/"), "file_path").alias("patch_id"), "file_path", patch.alias("patch"), F.lit(False).alias("is_replacement"), F.lit("clean_pass").alias("category"), F.lit(1).alias("label"))


def surviving(files: DataFrame, per_file: int = 6, mutators: tuple[Mutator, ...] = MUTATORS) -> DataFrame:
    """Pairs of records: of each file the first ``per_file`` mutants that the gate lets by, and as many clean changes.

    One batch verifies all mutants and one clean change of each file. ``pair`` tells which records belong together.
    """
    scratch = Scratch(files.sparkSession, "mutants")
    made = scratch.keep(harvest(files), "made")
    clean = scratch.keep(remarked(files.join(made.select("file_path").distinct(), "file_path", "left_semi")), "clean")
    changes = made.select("patch_id", "file_path", "patch", "is_replacement").unionByName(clean.select("patch_id", "file_path", "patch", "is_replacement"))
    reports = scratch.keep(V.verify(files, changes).select("patch_id", "file_path", "status", "input_dsl"), "reports").where("status = 'APPROVED'").drop("file_path", "status")
    kept = made.drop("patch").join(reports, "patch_id").withColumn("pair", F.row_number().over(Window.partitionBy("file_path").orderBy("place"))).where(F.col("pair") <= per_file)
    score = risk_between(0.88, 0.95, "patch_id")
    scores = F.create_map(*[x for c in RISK_CLASSES for x in (F.lit(c), reduce_when([(m.name, score if m.risk_class == c else F.round(score * m.beside[c], 4)) for m in mutators if c == m.risk_class or c in m.beside]))])
    faults = kept.select("file_path", "pair", "input_dsl", F.lit(0).alias("label"), score.alias("risk_score"), "category", scores.alias("taxonomy_labels"), F.lit("surviving_mutant").alias("source_type"))
    none = F.create_map(*[x for c in RISK_CLASSES for x in (F.lit(c), F.lit(0.0))])
    bases = clean.select("patch_id", "file_path").join(reports, "patch_id").join(kept.select("file_path", "pair"), "file_path")
    bases = bases.select("file_path", "pair", "input_dsl", F.lit(1).alias("label"), risk_between(0.02, 0.12, "patch_id", "pair").alias("risk_score"), F.lit("clean_pass").alias("category"), none.alias("taxonomy_labels"), F.lit("surviving_mutant_base").alias("source_type"))
    return faults.unionByName(bases).withColumn("language", language_of(F.col("file_path"))).withColumn("symbolic_gate_passed", F.lit(True))


def reduce_when(cases: list[tuple[str, Column]]) -> Column:
    """The value of the first case whose name is the row's ``mutator``, else 0."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in cases:
        out = out.when(F.col("mutator") == name, value)
    return out.otherwise(0.0)


def risk_between(low: float, high: float, *keys: str) -> Column:
    """A number in a range, fixed by a hash of the keys."""
    return F.round(low + (high - low) * F.pmod(F.xxhash64(*keys), F.lit(10_000)) / 10_000, 4)
