"""Labelled changes: planted in repositories, instantiated from templates, or taken from history and advisories.

Every way makes a table of changes ``(patch_id, file_path, patch, is_replacement, original, category, label,
expect, ord)`` and leaves the verdict to one batch of ``verify``; what is judged as expected becomes a record.
Changes are small diffs, so a file's text is read once however many of its symbols are changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import RISK_CLASSES, commit_kind, language_of, reverted_commit, risk_map
from ..session import Scratch, ship
from ..sources import code
from . import index
from . import verify as V
from .mutate import risk_between
from .records import parity, split_leakage

#: How risky a record of a category is (lowest, highest), and its scores by class.
PLANTED = {
    "clean_pass": ((0.01, 0.15), {}),
    "arity_breaking": ((0.85, 0.98), {"BreakingPublicAPI": 0.95}),
    "keyword_changes": ((0.82, 0.96), {"BreakingPublicAPI": 0.90}),
    "circular_imports": ((0.88, 0.99), {"BreakingPublicAPI": 0.65, "SilentLogicDrift": 0.75}),
    "deleted_symbol": ((0.85, 0.98), {"BreakingPublicAPI": 0.95}),
    "silent_logic_drift": ((0.82, 0.95), {"SilentLogicDrift": 0.90}),
    "security_surface": ((0.85, 0.96), {"SecuritySurface": 0.92}),
    "concurrency_hazard": ((0.82, 0.95), {"ConcurrencyHazard": 0.88}),
    "performance_regression": ((0.80, 0.94), {"PerformanceRegression": 0.86}),
    "breaking_public_api": ((0.82, 0.95), {"BreakingPublicAPI": 0.89}),
}
#: Categories that the gate must reject.
STRUCTURAL = ("arity_breaking", "keyword_changes", "circular_imports", "deleted_symbol")

#: Statements that a body can take anywhere without changing a call or a signature, by category and language.
STATEMENTS = {
    "silent_logic_drift": {"python": "_even = bool(0)", "typescript": "const _even = Boolean(0);", "go": "_ = 2 > 3", "rust": "let _even = 2 > 3;"},
    "security_surface": {
        "python": "_line = \"DELETE FROM t WHERE k = '\" + str(0) + \"'\"", "typescript": "const _line = \"DELETE FROM t WHERE k = '\" + String(0) + \"'\";",
        "go": "_ = \"DELETE FROM t WHERE k = '\" + \"0\" + \"'\"", "rust": "let _line = String::from(\"DELETE FROM t WHERE k = '0'\");",
    },
    "concurrency_hazard": {"python": "globals()['_turn'] = globals().get('_turn', 0) + 1", "typescript": "setTimeout(() => { (globalThis as any)._turn = Date.now(); }, 0);", "go": "go func() { recover() }()", "rust": "std::thread::spawn(|| {});"},
    "performance_regression": {"python": "_all = [(_a, _b) for _a in range(300) for _b in range(300)]", "typescript": "for (const _a of Array(300)) { for (const _b of Array(300)) {} }", "go": "for a := 0; a < 300; a++ { for b := 0; b < 300; b++ { } }", "rust": "for _a in 0..300 { for _b in 0..300 {} }"},
    "breaking_public_api": {"python": "_contract = 'the signature is about to change'", "typescript": "console.warn('the signature is about to change');", "go": "println(\"the signature is about to change\")", "rust": "eprintln!(\"the signature is about to change\");"},
}
REMARKS = ("reviewed, nothing changes here", "kept as it was")
_ADDED = {"python": "added: int", "typescript": "added: number", "go": "added int", "rust": "added: i32"}
_CALLERS = 3


def _hunk(at: int, old: list[str], new: list[str]) -> str:
    """A diff that puts ``new`` for the lines ``old``, which begin at line ``at``; without ``old``, after line ``at``."""
    return f"@@ -{at},{len(old)} +{at + (not old)},{len(new)} @@\n" + "".join(f"-{x}\n" for x in old) + "".join(f"+{x}\n" for x in new)


def _opened_body(lines: list[str], first: int, last: int, language: str) -> tuple[int, int] | None:
    """Line and column (from 1 and 0) right after a body's opening, None where a body has no room of its own."""
    depth = 0
    for n in range(first, min(last, first + 10) + 1):
        line = lines[n - 1]
        for col, char in enumerate(line):
            if char in "([":
                depth += 1
            elif char in ")]":
                depth -= 1
            elif not depth and char == "{" and language != "python":
                return n, col + 1
            elif not depth and char == ":" and language == "python":
                rest = line[col + 1 :].split("#")[0].strip()
                return (n, col + 1) if not rest and n < last else None
            elif char == "#" and language == "python":
                break
    return None


def _inserted(lines: list[str], place: tuple[int, int], statement: str, language: str) -> str:
    """A diff with a statement at a body's beginning."""
    n, col = place
    if language == "python":
        body = next((x for x in lines[n:] if x.strip()), "    ")
        return _hunk(n, [], [body[: len(body) - len(body.lstrip())] + statement])
    line = lines[n - 1]
    if not line[col:].strip():
        return _hunk(n, [], ["    " + statement])
    return _hunk(n, [line], [f"{line[:col]} {statement} {line[col:].lstrip()}"])


_RECEIVER = re.compile(r"\s*(&?\s*(?:mut\s+)?self|cls)\s*(,|(?=\)))\s*")


def _with_parameter(line: str, name: str, parameter: str) -> str | None:
    """A definition's line with one more required parameter, after a receiver."""
    found = re.search(rf"\b{re.escape(name)}\s*\(", line)
    if not found:
        return None
    head, rest = line[: found.end()], line[found.end() :]
    if receiver := _RECEIVER.match(rest):
        head, rest = f"{head}{receiver.group(1)}, ", rest[receiver.end() :]
    return head + parameter + ("" if rest.lstrip().startswith(")") else ", ") + rest


def edits(path: str, language: str, content: str, symbols: list[dict[str, Any]], sites: list[dict[str, Any]], structural: bool) -> Iterator[tuple[str, str, str]]:
    """``(symbol, category, diff)`` for the called functions of one file, and for calls that stand in it."""
    lines = content.split("\n")
    for s in symbols:
        first, last, name = s["lineno"], min(s["end_lineno"], len(lines)), s["name"]
        place = _opened_body(lines, first, last, language) if first <= last else None
        mark = "# " if language == "python" else "// "
        if place:
            # A remark stands on a line of its own, so it needs a body that begins on a new line.
            if language == "python" or not lines[place[0] - 1][place[1] :].strip():
                for text in REMARKS:
                    yield s["symbol_id"], "clean_pass", _inserted(lines, place, mark + text, language)
            for category, by_language in STATEMENTS.items():
                yield s["symbol_id"], category, _inserted(lines, place, by_language[language], language)
        if not structural or first > last:
            continue
        line = lines[first - 1]
        if (wider := _with_parameter(line, name, _ADDED[language])) is not None:
            yield s["symbol_id"], "arity_breaking", _hunk(first, [line], [wider])
        if language == "python" and "*" not in line and (wider := _with_parameter(line, name, "*, added_key: int")) is not None:
            yield s["symbol_id"], "keyword_changes", _hunk(first, [line], [wider])
        for caller in s["callers"] or []:
            short = caller["caller_id"].split("::")[-1].split(".")[-1]
            if place and short.isidentifier() and short != name:
                yield s["symbol_id"], "circular_imports", _inserted(lines, place, f"{short}()" + ("" if language in ("python", "go") else ";"), language)
            other = caller["caller_id"].split("::")[0]
            if other != path and (back := _import_of(path, other, language)):
                yield s["symbol_id"], "circular_imports", _hunk(0, [], [back])
        yield s["symbol_id"], "deleted_symbol", _hunk(first, lines[first - 1 : last], [])
    for site in sites if structural else []:
        if 0 < site["lineno"] <= len(lines):
            line = lines[site["lineno"] - 1]
            bare = language == "python" and f"{site['name']}()" in line
            surplus = "surplus_key=True" if bare else "90001, 90002, 90003, 90004, 90005, 90006"
            wider = re.sub(rf"\b{re.escape(site['name'])}\((\s*\))?", lambda m, s=surplus, n=site["name"]: f"{n}({s}" + (m.group(1) or ", "), line, count=1)
            own = re.search(rf"\b(def|func|fn|function)\s+(\([^)]*\)\s*)?{re.escape(site['name'])}\b", line)
            if wider != line and not own:
                yield site["symbol_id"], "keyword_changes", _hunk(site["lineno"], [line], [wider])


def _import_of(path: str, other: str, language: str) -> str | None:
    """A statement at the head of ``path`` that imports the file ``other``."""
    stem = other.rsplit(".", 1)[0]
    if language == "python" and other.endswith(".py"):
        return "import " + re.sub(r"^src\.|\.__init__$", "", stem.replace("/", "."))
    if language == "typescript" and other.endswith((".ts", ".tsx", ".js")):
        up = "../" * path.count("/") or "./"
        return f"import * as _back from '{up}{stem}';"
    return None


def _edited(batches: Iterator[pa.RecordBatch], structural: bool) -> Iterator[pa.RecordBatch]:
    names = ["symbol_id", "category", "patch", "file_path", "ord"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            made = edits(r["file_path"], r["language"], r["content"] or "", sorted(r["symbols"] or [], key=lambda s: s["lineno"]), r["sites"] or [], structural)
            rows += [(*e, r["file_path"], n) for n, e in enumerate(made)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 4 else pa.string()) for i in range(5)], names)


def planted(files: DataFrame, structural: bool = False) -> DataFrame:
    """Changes of every function or method that something calls: two remarks, five subtle statements and, where
    ``structural``, what the gate must stop - one more parameter, a keyword, a surplus argument at a caller, a cycle
    through one of its first callers, its deletion."""
    ship(files.sparkSession)
    scratch = Scratch(files.sparkSession, "planted")
    facts = scratch.keep(code.extract(files), "facts")
    symbols = code.symbols(facts).where(F.col("kind").isin("function", "async_function", "method")).select("symbol_id", "file_path", "language", "name", "qualname", "lineno", "end_lineno")
    named = symbols.select("symbol_id", "name", F.explode(F.array_distinct(F.array("qualname", "name"))).alias("key"))
    calls = index.caller_index(code.calls(facts)).where("caller <> '<module>'").select("caller_id", "file_path", "lineno", "key").distinct()
    by_call = named.join(calls, "key").where("caller_id <> symbol_id").select("symbol_id", "name", "caller_id", F.col("file_path").alias("at"), F.col("lineno").alias("line")).distinct()
    # Only the first callers are kept, by place: a partial aggregate, never a list of all callers of a common name.
    rank = F.row_number().over(Window.partitionBy("symbol_id").orderBy("at", "line", "caller_id"))
    first = scratch.keep(by_call.withColumn("nth", rank).where(F.col("nth") <= _CALLERS), "callers")
    callers = first.groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("nth", "caller_id"))).alias("callers"))
    per_file = symbols.join(callers, "symbol_id").groupBy("file_path").agg(F.collect_list(F.struct("symbol_id", "name", "lineno", "end_lineno", "callers")).alias("symbols"))
    sites = first.where("nth = 1").groupBy(F.col("at").alias("file_path")).agg(F.array_sort(F.collect_list(F.struct(F.col("line").alias("lineno"), "name", "symbol_id"))).alias("sites"))
    rows = files.select("file_path", "content", language_of(F.col("file_path")).alias("language")).join(per_file, "file_path", "left").join(sites, "file_path", "left").where("symbols is not null or sites is not null")
    made = rows.mapInArrow(lambda it: _edited(it, structural), "symbol_id string, category string, patch string, file_path string, ord int")
    made = made.withColumn("patch_id", F.concat_ws("/", "symbol_id", "category", F.concat("file_path", F.lit("#"), "ord")))
    label = (F.col("category") == "clean_pass").cast("int")
    expect = F.when(F.col("category").isin(*STRUCTURAL), "REJECTED").otherwise("APPROVED")
    return made.withColumns({"label": label, "expect": expect, "is_replacement": F.lit(False), "original": F.lit(None).cast("string")})


def as_expected(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` with ``status, violations, input_dsl``, those alone that the gate judged as ``expect`` says.

    A change that does not parse is no example of its category; a cycle must have been found where one was meant.
    """
    scratch = Scratch(files.sparkSession, "judged")
    changes = scratch.keep(changes, "changes")
    reports = scratch.keep(V.verify(files, changes).select("patch_id", "status", "risk_score", "violations", F.size("cycles").alias("cycles"), "input_dsl"), "reports")
    rows = changes.join(reports, "patch_id").where("status = expect and risk_score < 1.0")
    return rows.where("category <> 'circular_imports' or cycles > 0").drop("risk_score", "cycles")


def records(rows: DataFrame, ranges: dict[str, tuple[tuple[float, float], dict[str, float]]] = PLANTED) -> DataFrame:
    """Labelled records of judged changes, with a risk and class scores by category."""
    risk, none = F.lit(None).cast("double"), F.lit(0.0)
    scores = {c: none for c in RISK_CLASSES}
    for category, ((low, high), own) in ranges.items():
        mine = F.col("category") == category
        risk = F.when(mine, risk_between(low, high, "patch_id")).otherwise(risk)
        scores = {c: F.when(mine, F.lit(own.get(c, 0.0))).otherwise(v) for c, v in scores.items()}
    chart = F.create_map(*[x for c in RISK_CLASSES for x in (F.lit(c), scores[c])])
    source = F.when(F.col("category") == "clean_pass", "clean_commit").when(F.col("expect") == "REJECTED", "synthetic").otherwise("mutation_subtle")
    return rows.select("patch_id", "input_dsl", "label", risk.alias("risk_score"), "category", language_of(F.col("file_path")).alias("language"), chart.alias("taxonomy_labels"), (F.col("status") == "APPROVED").alias("symbolic_gate_passed"), source.alias("source_type"))


def mined(files: DataFrame, structural: bool = False) -> DataFrame:
    """Records of everything that can be planted in a repository and is judged as expected."""
    return records(as_expected(files, planted(files, structural)))


# --- templates -----------------------------------------------------------------------------------

#: A small service and its user in each language; every braced number tells instances apart.
SEEDS = {
    "python": {"lib{0}/store{0}.py": "def weigh{0}(item, factor):\n    return item * factor\n", "lib{0}/use{0}.py": "from .store{0} import weigh{0}\n\n\ndef bill{0}(items):\n    return [weigh{0}(x, 2) for x in items]\n"},
    "typescript": {"lib{0}/store{0}.ts": "export function weigh{0}(item: number, factor: number): number {{\n    return item * factor;\n}}\n", "lib{0}/use{0}.ts": "import {{ weigh{0} }} from './store{0}';\nexport function bill{0}(item: number) {{\n    return weigh{0}(item, 2);\n}}\n"},
    "go": {"lib{0}/store{0}.go": "package lib{0}\n\nfunc Weigh{0}(item int, factor int) int {{\n\treturn item * factor\n}}\n", "lib{0}/use{0}.go": "package lib{0}\n\nfunc Bill{0}(item int) int {{\n\treturn Weigh{0}(item, 2)\n}}\n"},
    "rust": {"lib{0}/src/store{0}.rs": "pub fn weigh{0}(item: i32, factor: i32) -> i32 {{\n    item * factor\n}}\n", "lib{0}/src/use{0}.rs": "use crate::store{0}::weigh{0};\npub fn bill{0}(item: i32) -> i32 {{\n    weigh{0}(item, 2)\n}}\n"},
}


def seeded(spark: SparkSession, each: int, languages: tuple[str, ...] = tuple(SEEDS)) -> DataFrame:
    """``files`` of ``each`` instances of every language's template."""
    numbers = spark.range(each).select(F.col("id").cast("string").alias("n"))
    texts = [(g, path, text) for g in languages for path, text in SEEDS[g].items()]
    rows = numbers.withColumn("t", F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(p).alias("p"), F.lit(x).alias("x")) for g, p, x in texts])))
    told = F.concat(F.substring("t.g", 1, 1), "n")
    fill = lambda c: F.replace(F.replace(F.replace(c, F.lit("{0}"), told), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    return rows.select(fill(F.col("t.p")).alias("file_path"), fill(F.col("t.x")).alias("content"))


def generated(spark: SparkSession, each: int, structural: bool = True, languages: tuple[str, ...] = tuple(SEEDS)) -> DataFrame:
    """Records of template instances: clean, structural and subtle changes, those that are judged as expected."""
    files = Scratch(spark, "seeds").keep(seeded(spark, each, languages), "files")
    return mined(files, structural)


def from_templates(templates: DataFrame, variants: int = 1) -> DataFrame:
    """Changes of ``templates(name, target_file, patches map<kind, content>, category)``: one for each patch kind.

    The kind ``pass`` is a clean change; any other is a fault. Variants differ in a leading comment only, so keep
    them apart by ``label_conflicts`` and ``split_leakage`` before a split.
    """
    kinds = templates.select("name", "target_file", "category", F.explode("patches").alias("kind", "patch"), F.sequence(F.lit(1), F.lit(variants)).alias("n"))
    rows = kinds.withColumn("n", F.explode("n"))
    mark = F.when(F.col("target_file").endswith(".py"), "# variant ").otherwise("// variant ")
    clean = F.col("kind") == "pass"
    category = F.when(clean, "clean_pass").otherwise(F.col("category"))
    return rows.select(
        F.concat_ws("/", "name", "kind", F.col("n").cast("string")).alias("patch_id"), F.col("target_file").alias("file_path"), F.when(F.col("n") > 1, F.concat(mark, F.col("n").cast("string"), F.lit("\n"), "patch")).otherwise(F.col("patch")).alias("patch"),
        F.lit(True).alias("is_replacement"), F.lit(None).cast("string").alias("original"), category.alias("category"), clean.cast("int").alias("label"), F.when(category.isin(*STRUCTURAL), "REJECTED").otherwise("APPROVED").alias("expect"), "n",
    ).withColumnRenamed("n", "ord")


# --- history ---------------------------------------------------------------------------------------

_CHANGE = ["patch_id", "file_path", "patch", "is_replacement", "original", "category", "label", "expect", "what", "ord", "context"]


def _change(rows: DataFrame, new: str, old: str, label: int, category: Column | str, what: str) -> DataFrame:
    """The change of each file from ``old`` to ``new`` text, as one of ``label``."""
    category = F.lit(category) if isinstance(category, str) else category
    key = F.concat_ws("/", "hash", "file_path", F.lit(f"{what}-{'fault' if label == 0 else 'clean'}"))
    known = rows.where(F.lower(F.col("file_path")).rlike(r"\.(py|tsx?|jsx?|mjs|cjs|go|rs)$"))
    return known.select(key.alias("patch_id"), "file_path", F.coalesce(new, F.lit("")).alias("patch"), F.lit(True).alias("is_replacement"), F.coalesce(old, F.lit("")).alias("original"), category.alias("category"), F.lit(label).alias("label"), F.lit("APPROVED").alias("expect"), F.lit(what).alias("what"), "ord", "context")


def _with_order(commits: DataFrame) -> DataFrame:
    return commits if "ord" in commits.columns else commits.withColumn("ord", F.xxhash64("hash"))


def _context(*texts: str) -> Column:
    return F.concat_ws("\n", *texts)


def reverts(commits: DataFrame, commit_files: DataFrame, category: str = "real_revert") -> tuple[DataFrame, DataFrame]:
    """Faults and clean changes of reverts: the reverted commit's own change where the history has it, else the
    revert's reverse; and what the revert itself did. ``commits(hash, subject, body[, ord])``, newest first by ``ord``."""
    commits = _with_order(commits)
    back = commits.where(commit_kind(F.col("subject")) == "revert").withColumn("named", reverted_commit(F.col("body")))
    bugs = commits.select(F.col("hash").alias("bug"), F.concat_ws("\n", "subject", "body").alias("said"), F.substring("hash", 1, 7).alias("short"))
    found = back.withColumn("short", F.substring("named", 1, 7)).join(bugs, "short", "left")
    found = found.withColumn("bug", F.when(F.startswith("bug", F.col("named")), F.col("bug")))
    found = found.groupBy("hash").agg(F.min("bug").alias("bug"), F.min(F.when(F.col("bug").isNotNull(), F.col("said"))).alias("said"))
    back = back.join(found, "hash").withColumn("context", _context("subject", "body", "said"))
    own = back.where("bug is not null").select(F.col("bug").alias("hash"), "ord", "context").dropDuplicates(["hash"]).join(commit_files, "hash")
    # A reverted commit without files in the history is as good as unknown.
    known = own.select(F.col("hash").alias("bug")).distinct()
    alone = back.join(known, "bug", "left_anti").join(commit_files, "hash")
    faults = _change(own, "after", "before", 0, category, "revert").unionByName(_change(alone, "before", "after", 0, category, "revert"))
    return faults, _change(back.join(commit_files, "hash"), "after", "before", 1, "clean_commit", "revert")


def mined_history(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Changes of a history: reverts are faults; a fix is clean and its reverse a fault; other commits are clean."""
    commits = _with_order(commits)
    faults, _ = reverts(commits, commit_files)
    rows = commits.withColumn("kind", commit_kind(F.col("subject"))).withColumn("context", _context("subject", "body")).join(commit_files, "hash")
    fixes, clean = rows.where("kind = 'fix'"), rows.where("kind = 'clean'")
    return reduce(DataFrame.unionByName, [faults, _change(fixes, "after", "before", 1, "real_hotfix", "fix"), _change(fixes, "before", "after", 0, "real_revert", "fix"), _change(clean, "after", "before", 1, "clean_pass", "clean")])


#: Words of a commit or an advisory that make it one of security, and of concurrency.
SECURITY = r"(?i)\b(cve-\d{4}-\d+|ghsa-[a-z0-9-]+|vulnerability|vuln|security)\b"
CONCURRENCY = r"(?i)\b(race|deadlock|mutex|channel|goroutine|thread|concurr\w*)\b"


def mined_advisories(commits: DataFrame, commit_files: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Changes of security fixes, told by ``advisories(id, summary, commit)`` or by the commit's own words.

    A fix is clean; its reverse is a fault, of concurrency where the words say so, else of the security surface.
    A commit that several advisories name counts once.
    """
    commits = _with_order(commits).withColumn("said", F.concat_ws("\n", "subject", "body"))
    own = commits.where(F.col("said").rlike(SECURITY)).select("hash", "ord", F.col("said").alias("context"), F.lit(1).alias("rank"))
    if advisories is not None:
        told = advisories.where("commit is not null").select(F.col("commit").alias("named"), F.substring("commit", 1, 7).alias("short"), F.concat_ws(" ", "id", "summary").alias("context"))
        hits = commits.withColumn("short", F.substring("hash", 1, 7)).join(told, "short").where(F.startswith("hash", F.col("named")))
        own = own.unionByName(hits.select("hash", "ord", "context", F.lit(0).alias("rank")))
    fixes = own.groupBy("hash", "ord").agg(F.min_by("context", F.struct("rank", "context")).alias("context")).join(commit_files, "hash")
    category = F.when(F.col("context").rlike(CONCURRENCY), "concurrency_hazard").otherwise("security_surface")
    return _change(fixes, "before", "after", 0, category, "advisory").unionByName(_change(fixes, "after", "before", 1, "real_hotfix", "advisory"))


#: How risky a record from history is, by where it comes from and its label.
HISTORY_RISK = {("revert", 0): (0.85, 0.95), ("revert", 1): (0.02, 0.12), ("fix", 0): (0.85, 0.95), ("fix", 1): (0.02, 0.15), ("clean", 1): (0.01, 0.10), ("advisory", 0): (0.88, 0.96), ("advisory", 1): (0.02, 0.12)}
SOURCE = {("revert", 0): "real_revert", ("revert", 1): "real_revert_fix", ("fix", 0): "real_hotfix", ("fix", 1): "real_hotfix", ("clean", 1): "clean_commit", ("advisory", 0): "cve_ghsa", ("advisory", 1): "cve_ghsa_fix"}
#: Fixed value: the risk that class scores of a fault start from, by origin.
_BASE = {"revert": 0.88, "fix": 0.88, "advisory": 0.92}


def history_records(files: DataFrame, changes: DataFrame, limit: int | None = None) -> DataFrame:
    """Records of changes from history that the gate lets by, each judged against its own commit's text.

    With ``limit``, reverts give a third of it at most, fixes what is then left to two thirds, clean commits the rest.
    """
    judged = as_expected(files, changes)
    risk, source, base = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(0.88)
    for (what, label), (low, high) in HISTORY_RISK.items():
        mine = (F.col("what") == what) & (F.col("label") == label)
        risk, source = F.when(mine, risk_between(low, high, "patch_id")).otherwise(risk), F.when(mine, SOURCE[what, label]).otherwise(source)
    for what, value in _BASE.items():
        base = F.when(F.col("what") == what, F.lit(value)).otherwise(base)
    scores = risk_map(F.col("category"), F.col("label"), base, F.col("context"), F.col("violations"))
    # An advisory's fault is one of security at least, and of concurrency where it says so.
    floor = lambda name: F.when(F.col("category") == "security_surface", 0.90 if name == "SecuritySurface" else 0.0).otherwise({"ConcurrencyHazard": 0.90, "SecuritySurface": 0.85}.get(name, 0.0))
    fault = (F.col("what") == "advisory") & (F.col("label") == 0)
    scores = F.transform_values(scores, lambda k, v: F.when(fault, F.greatest(v, reduce(lambda a, c: F.when(k == c, floor(c)).otherwise(a), RISK_CLASSES, F.lit(0.0)))).otherwise(v))
    if limit is not None:
        judged = Scratch(files.sparkSession, "history").keep(judged, "judged")
        counts = {r["what"]: r["count"] for r in judged.groupBy("what").count().collect()}  # four kinds
        room, quota = 0, {}
        for what, share in (("revert", max(1, limit // 3)), ("fix", max(2, limit * 2 // 3)), ("clean", limit), ("advisory", limit)):
            quota[what] = max(0, min(counts.get(what, 0), share - room))
            room += quota[what]
        nth = F.row_number().over(Window.partitionBy("what").orderBy("ord", "patch_id"))
        cap = reduce(lambda a, w: F.when(F.col("what") == w, quota[w]).otherwise(a), quota, F.lit(0))
        judged = judged.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")
    return judged.select("patch_id", "input_dsl", "label", risk.alias("risk_score"), "category", language_of(F.col("file_path")).alias("language"), scores.alias("taxonomy_labels"), F.lit(True).alias("symbolic_gate_passed"), source.alias("source_type"))


# --- composition -------------------------------------------------------------------------------------


def topped_up(primary: DataFrame, fallback: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Of each language half its target of either label: first what ``primary`` has, then what ``fallback`` has."""
    pool = primary.withColumn("later", F.lit(0)).unionByName(fallback.withColumn("later", F.lit(1)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy("language", "label").orderBy("later", F.xxhash64(F.lit(42), "input_dsl", "category")))
    half = reduce(lambda a, g: F.when(F.col("language") == g, targets[g] // 2).otherwise(a), targets, F.lit(0))
    return pool.withColumn("nth", nth).where(F.col("nth") <= half).drop("nth", "later")


def expanded(train: DataFrame, val: DataFrame, fresh: DataFrame, val_ratio: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Both splits with ``fresh`` records added: of each language as many passes as rejects, its first share to validation."""
    fresh = fresh.where("symbolic_gate_passed")
    nth = F.row_number().over(Window.partitionBy("language", "label").orderBy(F.xxhash64(F.lit(42), "input_dsl", "category")))
    size = fresh.groupBy("language").agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("n"))
    rows = fresh.withColumn("nth", nth).join(F.broadcast(size), "language").where("nth <= n")  # a row a language
    held = F.greatest(F.lit(1), F.floor(F.col("n") * val_ratio))
    rows = Scratch(fresh.sparkSession, "fresh").keep(rows.withColumn("to_val", F.col("nth") <= held).drop("nth", "n"), "rows")
    return train.unionByName(rows.where("not to_val").drop("to_val"), allowMissingColumns=True), val.unionByName(rows.where("to_val").drop("to_val"), allowMissingColumns=True)


def held_out(pool: DataFrame, train: DataFrame, per_language: int) -> DataFrame:
    """An evaluation set at label parity in each language, without any text of ``train``."""
    leaked = split_leakage(train, pool).select("input_dsl").distinct()
    return parity(pool.join(leaked, "input_dsl", "left_anti"), per_language)

