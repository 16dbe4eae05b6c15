"""Patches: unified diffs parsed and applied, changed lines, changed, added and deleted symbols."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import language_of
from ..session import ship
from ..sources import code

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def hunks(diff: str) -> list[dict[str, Any]]:
    """Hunks with their start lines, counts and body lines; file headers end a hunk, an empty line is context."""
    out: list[dict[str, Any]] = []
    here = None
    for line in diff.splitlines():
        if m := _HUNK.match(line):
            a, b, c, d = m.groups()
            here = {"old_start": int(a), "old_count": int(b or 1), "new_start": int(c), "new_count": int(d or 1), "lines": []}
            out.append(here)
        elif line.startswith(("diff --git", "index ", "--- ", "+++ ")):
            here = None
        elif here is not None and (not line or line[0] in " +-\\"):
            if not line.startswith("\\"):
                here["lines"].append(line or " ")
    return out


def apply(original: str, patch: str, replacement: bool = False) -> tuple[str, set[int], set[int]]:
    """The patched text, and the changed lines of the old and the new text.

    A patch without hunks, or a ``replacement``, is the whole new text. Context lines are not checked.
    """
    old = original.splitlines()
    parts = [] if replacement else hunks(patch)
    gone, fresh = set(), set()
    if not parts:
        new = patch.splitlines()
        if not old:
            return patch, set(), set(range(1, len(new) + 1))
        for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
            if tag != "equal":
                gone.update(range(a + 1, b + 1))
                fresh.update(range(c + 1, d + 1))
        return patch, gone, fresh
    out: list[str] = []
    at = 0
    for h in parts:
        begin = max(0, h["old_start"] - 1) if h["old_count"] else h["old_start"]
        out += old[at:begin]
        at = max(at, begin)
        for line in h["lines"]:
            if line[0] == "+":
                out.append(line[1:])
                fresh.add(len(out))
            elif line[0] == "-":
                at += 1
                gone.add(at)
            else:
                out.append(old[at] if at < len(old) else line[1:])
                at += 1
    out += old[at:]
    return "\n".join(out) + ("\n" if original.endswith("\n") or not original else ""), gone, fresh


def roles(old: list[dict], new: list[dict], gone: set[int], fresh: set[int]) -> tuple[list[str], list[str], list[str]]:
    """Qualified names that are affected, added and deleted; a change outside every symbol affects ``<module>``."""
    before, after = {s["qualname"]: s for s in old}, {s["qualname"]: s for s in new}
    real = lambda rows: [s for s in rows if s["kind"] != "module"]
    touched = lambda s, lines: any(s["lineno"] <= x <= s["end_lineno"] for x in lines)
    affected = [s["qualname"] for s in real(new) if touched(s, fresh)]
    affected += [s["qualname"] for s in real(old) if s["qualname"] in after and s["qualname"] not in affected and touched(s, gone)]
    added = [q for q in after if q not in before and q != "<module>"]
    deleted = [q for q in before if q not in after and q != "<module>"]
    loose = any(not any(s["lineno"] <= x <= s["end_lineno"] for s in real(rows)) for rows, lines in ((new, fresh), (old, gone)) for x in lines)
    if loose or not affected:
        affected.append("<module>")
    return affected, added, deleted


_EXTRA = "patched string, old_lines array<int>, new_lines array<int>, affected array<string>, added array<string>, deleted array<string>, old_names array<string>"


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for patch, path, text, whole, original, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            patched, gone, fresh = apply(original or "", text or "", bool(whole))
            old, new = code.facts_of(original, language), code.facts_of(patched, language)
            affected, added, deleted = ([], [], []) if new["syntax_error"] else roles(old["symbols"], new["symbols"], gone, fresh)
            rows.append(new | {"patch_id": patch, "file_path": path, "language": language, "patched": patched, "old_lines": sorted(gone), "new_lines": sorted(fresh), "affected": affected, "added": added, "deleted": deleted, "old_names": [s["qualname"] for s in old["symbols"]]})
        ints, texts = pa.list_(pa.int32()), pa.list_(pa.string())
        schema = pa.schema([("patch_id", pa.string()), ("file_path", pa.string()), ("language", pa.string()), *code.FACTS, ("patched", pa.string()), ("old_lines", ints), ("new_lines", ints), *[(n, texts) for n in ("affected", "added", "deleted", "old_names")]])
        yield pa.RecordBatch.from_pylist(rows, schema)


def locate(patches: DataFrame, files: DataFrame) -> DataFrame:
    """``patches(patch_id, file_path, patch, is_replacement)`` applied to ``files(file_path, content)``.

    One row for each patch and file: the patched file's facts, changed lines, and symbol names by role. Patches
    that share an id are one change of several files. A patch may bring its own ``original`` text, which then
    stands for the file's.
    """
    ship(patches.sparkSession)
    own = F.col("original").cast("string") if "original" in patches.columns else F.lit(None).cast("string")
    rows = patches.withColumn("brought", own).drop("original").join(files.select("file_path", "content"), "file_path", "left")
    rows = rows.withColumn("original", F.coalesce("brought", "content"))
    rows = rows.select(F.col("patch_id").cast("string"), "file_path", "patch", "is_replacement", "original", language_of(F.col("file_path")).alias("language"))
    return rows.mapInArrow(_located, f"patch_id string, file_path string, language string, {code.FACTS_SQL}, {_EXTRA}")
