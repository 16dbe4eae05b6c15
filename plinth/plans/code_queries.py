"""Queries over source code: the shared tables hold none, so they read the sample workspace.

Their SQL twins start from the workspace's facts as written out by hand (``sample_facts``) and work out the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dead_code, index, lint, patches, verify
from ..sources import code
from .registry import register
from .sample_facts import CALLS, DEAD, FINDINGS, IMPORTS, RESOLVED, SYMBOLS
from .sample_workspace import FILES, PATCHES

_GRAPH = f"WITH RECURSIVE {SYMBOLS}, {CALLS}, {IMPORTS}, {RESOLVED}, {DEAD}"


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(FILES.items()), "file_path string, content string")


def changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATCHES, "patch_id string, file_path string, patch string, is_replacement boolean")


def _facts(spark: SparkSession) -> DataFrame:
    return code.extract(files(spark))


@register("x_symbols", f"WITH {SYMBOLS} SELECT id AS symbol_id, kind, lineno, end_lineno, signature, min_args, max_args, visibility, is_method FROM named")
def x_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(_facts(spark)).select("symbol_id", "kind", "lineno", "end_lineno", "signature", "min_args", "max_args", "visibility", "is_method")


@register("x_calls", f"WITH {CALLS} SELECT caller_id, callee, args_count, lineno FROM called")
def x_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.calls(_facts(spark)).select("caller_id", "callee", "args_count", "lineno")


@register("x6_imports", f"WITH {IMPORTS} SELECT file AS file_path, module, name, asname, level FROM imports")
def x_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.imports(_facts(spark)).select("file_path", "module", "name", "asname", "level")


@register("b7_import_targets", f"WITH {IMPORTS} SELECT file AS file_path, module, name, target FROM aimed")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.resolve_imports(code.imports(_facts(spark)), files(spark)).select("file_path", "module", "name", "target")


@register("b8_resolved_calls", f"WITH {SYMBOLS}, {CALLS}, {IMPORTS}, {RESOLVED} SELECT caller_id, callee, lineno, target_id FROM resolved")
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark)
    resolved = index.resolve_imports(code.imports(facts), files(spark))
    return index.resolve_calls(code.calls(facts), code.symbols(facts), resolved).select("caller_id", "callee", "lineno", "target_id")


@register("b10_definitions", f"WITH {SYMBOLS} SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY file, ord) AS INTEGER) AS place, id AS symbol_id FROM (SELECT DISTINCT unnest([name, qual]) AS key, id, file, ord FROM named)")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.definitions(code.symbols(_facts(spark)))


@register("b11_callers", f"WITH {CALLS} SELECT caller_id, callee, lineno FROM called WHERE callee = 'total' OR last = 'total'")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.callers_of(code.calls(_facts(spark)), spark.createDataFrame([("total",)], "key string")).select("caller_id", "callee", "lineno")


@register("b12_importers", f"WITH {IMPORTS} SELECT file AS file_path, name FROM imports WHERE name = 'total' OR module || '.' || name = 'cart.Basket'")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("total",), ("cart.Basket",)], "key string")
    return index.importers_of(code.imports(_facts(spark)), wanted).select("file_path", "name")


@register("b13_subclasses", f"WITH {SYMBOLS} SELECT unnest(bases) AS base, id AS symbol_id FROM named")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.subclasses(code.symbols(_facts(spark))).select("base", "symbol_id")


@register(
    "b14_constructors",
    f"""WITH RECURSIVE {SYMBOLS}, own AS (SELECT regexp_replace(id, '\\.[^.]+$', '') AS class_id, id AS ctor_id FROM named WHERE name IN ('__init__', 'constructor', 'new')),
        way(class_id, here, n) AS (SELECT id, id, 0 FROM named WHERE kind IN ('class', 'struct') UNION ALL
          SELECT w.class_id, b.id, n + 1 FROM way w JOIN named c ON c.id = w.here JOIN named b ON b.kind = 'class' AND b.qual = c.bases[1] WHERE n < 9 AND w.here NOT IN (SELECT class_id FROM own))
        SELECT class_id, arg_min(ctor_id, n) AS ctor_id FROM (SELECT w.class_id, n, o.ctor_id FROM way w JOIN own o ON o.class_id = w.here) GROUP BY class_id""",
)
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.constructors(code.symbols(_facts(spark)))


@register("b15_symbols_of_file", f"WITH {SYMBOLS} SELECT id AS symbol_id, lineno FROM named WHERE file = 'shop/prices.py'")
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.symbols_of(code.symbols(_facts(spark)), "/work/.\\\\shop//prices.py", "/work").select("symbol_id", "lineno")


#: patch, old and new lines changed, symbols affected, added and deleted, whether it parses; from reading the patches.
_ROLES = """SELECT * FROM (VALUES
  ('call-cycle', 'shop/prices.py', '12', '12', 'lookup', '', '', true), ('constructor', 'shop/cart.py', '13', '13', 'Basket,Basket.__init__', '', '', true),
  ('deleted-function', 'shop/prices.py', '7', '7', 'price', 'price', 'price_of', true), ('diff', 'shop/prices.py', '', '8', 'price_of', '', '', true),
  ('import-cycle', 'shop/prices.py', '', '1', '<module>', '', '', true), ('lost-name', 'shop/report.py', '1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18', '1', '<module>', '', 'main,render', true),
  ('optional-parameter', 'shop/prices.py', '7', '7', 'price_of', '', '', true), ('required-parameter', 'shop/prices.py', '7', '7', 'price_of', '', '', true),
  ('syntax', 'shop/prices.py', '1,2,3,4,5,6,7,8,9,10,11,12,13', '1', '', '', '', false), ('typescript', 'web/store.ts', '1', '1', 'load', '', '', true)
) v(patch_id, file_path, old_lines, new_lines, affected, added, deleted, parses)"""


@register("v1_located_patches", _ROLES)
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda c: F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",").alias(c)
    numbers = lambda c: F.array_join(c, ",").alias(c)
    return patches.locate(changes(spark), files(spark)).select("patch_id", "file_path", numbers("old_lines"), numbers("new_lines"), told("affected"), told("added"), told("deleted"), F.col("syntax_error").isNull().alias("parses"))


#: Verdicts, risks and kinds of violation, from reading the patches against the workspace.
_VERDICTS = """SELECT * FROM (VALUES
  ('call-cycle', 'REJECTED', 0.95, 'CYCLE', 1), ('constructor', 'REJECTED', 0.95, 'ARITY_MISMATCH', 0), ('deleted-function', 'REJECTED', 0.95, 'BROKEN_REFERENCE', 0), ('diff', 'APPROVED', 0.05, '', 0),
  ('import-cycle', 'REJECTED', 0.95, 'CYCLE', 1), ('lost-name', 'REJECTED', 0.95, 'BROKEN_IMPORT', 0), ('optional-parameter', 'APPROVED', 0.05, '', 0),
  ('required-parameter', 'REJECTED', 0.95, 'ARITY_MISMATCH', 0), ('syntax', 'REJECTED', 1.0, 'SYNTAX', 0), ('typescript', 'REJECTED', 0.95, 'ARITY_MISMATCH', 0)
) v(patch_id, status, risk_score, kinds, cycles)"""


@register("v17_verified_patches", _VERDICTS)
def v17(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda v: F.when(F.contains(v, F.lit("SyntaxError")), "SYNTAX").otherwise(F.element_at(F.split(v, ":"), 1))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("violations", kind))), ",")
    return verify.verify(files(spark), changes(spark)).select("patch_id", "status", "risk_score", kinds.alias("kinds"), F.size("cycles").alias("cycles"))


@register("d_dead_symbols", f"{_GRAPH} SELECT id AS symbol_id, kind, CAST(lines AS INTEGER) AS lines, dead_kind, cluster_root FROM judged")
def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_code.dead_symbols(_facts(spark), files(spark)).select("symbol_id", "kind", "lines", "dead_kind", "cluster_root")


@register(
    "d_references",
    f"{_GRAPH} SELECT DISTINCT src, dst FROM links WHERE src <> dst",
)
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between symbols that the edges through names stand for."""
    facts = _facts(spark)
    edges = dead_code.references(code.symbols(facts), code.calls(facts), index.resolve_imports(code.imports(facts), files(spark)))
    return dead_code.between_symbols(edges)


@register("d9_dead_report", f"{_GRAPH} SELECT (SELECT count(*) FROM named) AS symbols, count(*) AS dead, CAST(sum(lines) AS BIGINT) AS dead_lines, count(*) FILTER (dead_kind = 'orphan') AS orphans, count(*) FILTER (dead_kind = 'transitive') AS transitive, count(DISTINCT cluster_root) AS roots, count(DISTINCT file) AS files FROM judged")
def dead_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark)
    return dead_code.report(dead_code.dead_symbols(facts, files(spark)), facts)


@register(
    "d11_triage",
    f"""WITH {SYMBOLS} SELECT id AS symbol_id, CASE WHEN shown THEN 'PUBLIC_API_SURFACE' WHEN leftover THEN 'GENUINE_CRUFT' ELSE 'INTERNAL_ORPHAN' END AS classification, shown AS suppressed,
        CASE WHEN shown THEN 0.05 WHEN leftover THEN 0.95 WHEN visibility = 'public' THEN 0.10 ELSE 0.70 END AS cruft_confidence
        FROM (SELECT *, regexp_matches(lower(name), 'old_|_old|unused') AS leftover, NOT regexp_matches(lower(name), 'old_|_old|unused') AND (CASE WHEN file LIKE '%.go' THEN name ~ '^[A-Z].*' WHEN file LIKE '%.py' THEN doc IS NOT NULL
              ELSE visibility = 'public' END) AS shown FROM named)""",
)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol as if it were dead."""
    return dead_code.triaged(code.symbols(_facts(spark))).select("symbol_id", "classification", "suppressed", "cruft_confidence")


@register("d14_symbol_text", f"WITH {SYMBOLS} SELECT id AS symbol_id, '[SYM] ' || signature || coalesce(' [DOC] ' || doc, '') AS text FROM named")
def symbol_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(_facts(spark)).select("symbol_id", dead_code.symbol_text().alias("text"))


@register("p_diagnostics", f"WITH {FINDINGS} SELECT * FROM findings")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.diagnostics(_facts(spark), files(spark)).select("file_path", "lineno", "col", "rule_id", "severity", "message")


@register("p9_lint_totals", f"WITH {FINDINGS} SELECT count(*) AS findings, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn, count(DISTINCT file_path) AS files FROM findings")
def lint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.totals(lint.diagnostics(_facts(spark), files(spark)))


@register("p8_patch_findings", "SELECT * FROM (VALUES ('deep', 'a.py', 3, 'PERF001', 'warn'), ('io', 'a.py', 3, 'PERF002', 'warn')) v(patch_id, file_path, lineno, rule_id, severity)")
def patch_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.createDataFrame([("a.py", "def f(db, rows):\n    for row in rows:\n        row.go()\n    return 1\n")], "file_path string, content string")
    rows = [("deep", "a.py", "@@ -3,1 +3,2 @@\n-        row.go()\n+        for x in row:\n+            x.go()\n", False), ("io", "a.py", "@@ -3,1 +3,1 @@\n-        row.go()\n+        db.query(row)\n", False), ("none", "a.py", "def f():\n    return 2\n", True)]
    made = spark.createDataFrame(rows, "patch_id string, file_path string, patch string, is_replacement boolean")
    return lint.patch_diagnostics(made, base).select("patch_id", "file_path", "lineno", "rule_id", "severity")


_SUBJECTS = ("Revert \"add cache\"", "fix: null deref", "Update test fixtures", "hotfix for prefix bug", "Add docs", "reverting the change", "patch prefix handling", "a bug", "Fixes nothing")


@register(
    "t8_commit_kinds",
    """WITH s AS (SELECT text || CASE turn % 4 WHEN 0 THEN ' fix' WHEN 1 THEN ' Revert it' WHEN 2 THEN ' fixture fix' ELSE '' END AS subject FROM conversations
         UNION ALL SELECT unnest(['Revert "add cache"', 'fix: null deref', 'Update test fixtures', 'hotfix for prefix bug', 'Add docs', 'reverting the change', 'patch prefix handling', 'a bug', 'Fixes nothing'])),
       k AS (SELECT subject, regexp_matches(subject, '(?i)(^|[^a-z0-9_])(revert|reverted|reverting)([^a-z0-9_]|$)') AS back, regexp_matches(subject, '(?i)(^|[^a-z0-9_])(fix|hotfix|bugfix|patch)([^a-z0-9_]|$)') AS fix,
         regexp_matches(subject, '(?i)(^|[^a-z0-9_])(fixtures?|prefix|postfix|suffix)([^a-z0-9_]|$)') AND NOT regexp_matches(subject, '(?i)(^|[^a-z0-9_])(bug|hotfix)([^a-z0-9_]|$)') AS alike,
         regexp_matches(subject, '(?i)(^|[^a-z0-9_])(revert|bug)([^a-z0-9_]|$)') AS other FROM s)
       SELECT sha256(subject) AS subject, CASE WHEN back THEN 'revert' WHEN fix AND NOT alike THEN 'fix' WHEN NOT fix AND NOT other THEN 'clean' END AS kind FROM k""",
)
def commit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import commit_kind

    end = F.element_at(F.array(F.lit(" fix"), F.lit(" Revert it"), F.lit(" fixture fix"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat("text", end).alias("subject"))
    rows = said.unionByName(spark.createDataFrame([(s,) for s in _SUBJECTS], "subject string"))
    return rows.select(F.sha2("subject", 256).alias("subject"), commit_kind(F.col("subject")).alias("kind"))
