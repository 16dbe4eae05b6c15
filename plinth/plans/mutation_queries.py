"""Mutants, planted changes, generated and mined records over small workspaces and histories, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mining, mutate
from .code_queries import files
from .registry import register
from .sample_facts import CALLS, SYMBOLS
from .sample_workspace import SNIPPETS


def snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SNIPPETS.items()), "file_path string, content string")


#: What each mutator makes of the snippets, from reading them.
_MUTANTS = """mutants(file_path, mutator, category, note) AS (VALUES
  ('m/truth.py', 'truthiness_inversion', 'silent_logic_drift', 'line 2: negation dropped'), ('m/truth.py', 'truthiness_inversion', 'silent_logic_drift', 'line 4: == to !='),
  ('m/truth.py', 'truthiness_inversion', 'silent_logic_drift', 'line 6: none test turned'), ('m/truth.py', 'truthiness_inversion', 'silent_logic_drift', 'line 8: negation added'),
  ('m/more.py', 'mutable_defaults', 'silent_logic_drift', 'line 1: shared default'), ('m/more.py', 'optional_chaining_drift', 'silent_logic_drift', 'line 3: lookup without default'),
  ('m/more.py', 'unhandled_channel_read', 'concurrency_hazard', 'line 2: wait without end'), ('m/more.py', 'unclosed_resource', 'resource_leak', 'line 4: scope dropped'), ('m/more.py', 'unclosed_resource', 'resource_leak', 'line 6: close dropped'),
  ('m/a.ts', 'truthiness_inversion', 'silent_logic_drift', 'line 2: === to !=='), ('m/a.ts', 'truthiness_inversion', 'silent_logic_drift', 'line 3: negation dropped'), ('m/a.ts', 'floating_promises', 'concurrency_hazard', 'line 4: await dropped'),
  ('m/a.ts', 'optional_chaining_drift', 'silent_logic_drift', 'line 5: optional chain dropped'), ('m/a.ts', 'optional_chaining_drift', 'silent_logic_drift', 'line 5: fallback dropped'),
  ('m/a.go', 'truthiness_inversion', 'silent_logic_drift', 'line 4: err != nil to err == nil'), ('m/a.go', 'unhandled_channel_read', 'concurrency_hazard', 'line 7: closed channel not told'), ('m/a.go', 'unclosed_resource', 'resource_leak', 'line 8: close dropped'),
  ('m/a.rs', 'truthiness_inversion', 'silent_logic_drift', 'line 3: == to !='), ('m/a.rs', 'unclosed_resource', 'resource_leak', 'line 2: value leaked'))"""


@register("h_mutants", f"WITH {_MUTANTS} SELECT * FROM mutants")
def h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.harvest(snippets(spark)).select("file_path", "mutator", "category", "note")


@register(
    "h7_surviving_pairs",
    f"""WITH {_MUTANTS}, n AS (SELECT file_path, count(*) AS n FROM mutants GROUP BY file_path)
        SELECT file_path, label, least(n, 4) AS records, CASE label WHEN 1 THEN 'surviving_mutant_base' ELSE 'surviving_mutant' END AS source_type, true AS in_range FROM n, (SELECT unnest([0, 1]) AS label)""",
)
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mutants parse and break no contract, so the gate lets all by; the cap a file is four here."""
    found = mutate.surviving(snippets(spark), 4)
    top = F.array_max(F.map_values("taxonomy_labels"))
    good = F.when(F.col("label") == 1, F.col("risk_score").between(0.02, 0.12) & (top == 0)).otherwise(F.col("risk_score").between(0.88, 0.95) & (top == F.col("risk_score")))
    return found.groupBy("file_path", "label").agg(F.count("*").alias("records"), F.min("source_type").alias("source_type"), F.bool_and(good).alias("in_range"))


#: hash, subject, body, order; and the files' texts before and after.
_COMMITS = [
    ("a1a1a1a1", "fix: off by one", "", 0), ("b2b2b2b2", 'Revert "cache"', "This reverts commit c3c3c3c3.", 1), ("c3c3c3c3", "Add cache", "", 2), ("d4d4d4d4", "Add docs", "", 3),
    ("e5e5e5e5", "Revert something", "", 4), ("f6f6f6f6", "Bump parser", "CVE-2024-1234 in the parser", 5), ("a7a7a7a7", "hotfix for a race", "security: deadlock", 6), ("b8b8b8b8", "Revert the other", "Reverts commit 9999999.", 7),
]
_TEXTS = [
    ("a1a1a1a1", "m.py", "x = 1\n", "x = 2\n"), ("b2b2b2b2", "m.py", "x = 3\n", "x = 1\n"), ("c3c3c3c3", "m.py", "x = 1\n", "x = 3\n"), ("c3c3c3c3", "n.go", "package n\n", "package n\n\nvar a = 1\n"),
    ("d4d4d4d4", "n.py", "", "y = 1\n"), ("d4d4d4d4", "README.md", "a", "b"), ("e5e5e5e5", "m.py", "x = 5\n", "x = 6\n"), ("f6f6f6f6", "p.rs", "fn p() {}\n", "pub fn p() {}\n"),
    ("a7a7a7a7", "q.ts", "let a = 1;\n", "let a = 2;\n"), ("b8b8b8b8", "m.py", "x = 7\n", "x = 8\n"),
]
_ADVISORIES = [("ADV-1", "overflow in p", "d4d4d4d4"), ("ADV-2", "unknown", "0000000"), ("ADV-3", "again", "d4d4d4d4"), ("ADV-4", "no link", None)]


def _history(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(_COMMITS, "hash string, subject string, body string, ord int"), spark.createDataFrame(_TEXTS, "hash string, file_path string, before string, after string")


def _values(rows: list[tuple]) -> str:
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


_PAST = f"""commits(hash, subject, body, ord) AS ({_values(_COMMITS)}), texts(hash, file_path, before, after) AS ({_values(_TEXTS)}),
  known AS (SELECT * FROM texts WHERE regexp_matches(file_path, '\\.(py|tsx?|jsx?|mjs|cjs|go|rs)$')),
  kinds AS (SELECT *, CASE WHEN subject ~* '.*\\brevert\\b.*' THEN 'revert' WHEN subject ~* '.*\\b(fix|hotfix)\\b.*' THEN 'fix' ELSE 'clean' END AS kind, regexp_extract(lower(body), 'reverts commit ([0-9a-f]{{7,40}})', 1) AS named FROM commits),
  bug AS (SELECT k.hash, b.hash AS bug FROM kinds k LEFT JOIN commits b ON k.named <> '' AND starts_with(b.hash, k.named) AND b.hash IN (SELECT hash FROM texts) WHERE k.kind = 'revert'),
  faults AS (SELECT t.hash, file_path, t.after AS new, t.before AS old FROM bug JOIN known t ON t.hash = bug.bug UNION ALL SELECT t.hash, file_path, t.before, t.after FROM bug JOIN known t ON t.hash = bug.hash WHERE bug.bug IS NULL)"""


@register(
    "e16_mined_history",
    f"""WITH {_PAST} SELECT hash || '/' || file_path || '/revert-fault' AS patch_id, 'real_revert' AS category, 0 AS label, new AS patch, old AS original FROM faults
        UNION ALL SELECT hash || '/' || file_path || '/fix-clean', 'real_hotfix', 1, after, before FROM kinds JOIN known USING (hash) WHERE kind = 'fix'
        UNION ALL SELECT hash || '/' || file_path || '/fix-fault', 'real_revert', 0, before, after FROM kinds JOIN known USING (hash) WHERE kind = 'fix'
        UNION ALL SELECT hash || '/' || file_path || '/clean-clean', 'clean_pass', 1, after, before FROM kinds JOIN known USING (hash) WHERE kind = 'clean'""",
)
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mined_history(*_history(spark)).select("patch_id", "category", "label", "patch", "original")


@register(
    "e17_mined_reverts",
    f"""WITH {_PAST} SELECT hash || '/' || file_path || '/revert-fault' AS patch_id, 'real_revert' AS category, 0 AS label FROM faults
        UNION ALL SELECT hash || '/' || file_path || '/revert-clean', 'clean_commit', 1 FROM bug JOIN known USING (hash)""",
)
def e17_reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults, clean = mining.reverts(*_history(spark))
    return faults.unionByName(clean).select("patch_id", "category", "label")


@register(
    "e17_mined_advisories",
    f"""WITH {_PAST}, adv(id, summary, commit) AS ({_values(_ADVISORIES)}), fixes AS (SELECT DISTINCT hash FROM commits WHERE body ~* '.*(cve-[0-9]{{4}}-[0-9]+|security).*' OR hash IN (SELECT commit FROM adv)),
        hot AS (SELECT hash, bool_or(body ~* '.*(deadlock|race).*') AS hot FROM fixes JOIN commits USING (hash) GROUP BY hash)
        SELECT hash || '/' || file_path || '/advisory-fault' AS patch_id, CASE WHEN hot THEN 'concurrency_hazard' ELSE 'security_surface' END AS category, 0 AS label FROM hot JOIN known USING (hash)
        UNION ALL SELECT hash || '/' || file_path || '/advisory-clean', 'real_hotfix', 1 FROM hot JOIN known USING (hash)""",
)
def e17_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.createDataFrame(_ADVISORIES, "id string, summary string, commit string")
    return mining.mined_advisories(*_history(spark), told).select("patch_id", "category", "label")


@register(
    "e17_history_records",
    f"""WITH {_PAST}, r AS (SELECT 'real_revert' AS source_type, 0 AS label FROM faults UNION ALL SELECT 'real_hotfix', unnest([0, 1]) FROM kinds JOIN known USING (hash) WHERE kind = 'fix' UNION ALL SELECT 'clean_commit', 1 FROM kinds JOIN known USING (hash) WHERE kind = 'clean')
        SELECT source_type, label, count(*) AS records, true AS in_range FROM r GROUP BY ALL""",
)
def e17_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of these texts parse and break nothing, so every change gives a record."""
    empty = spark.createDataFrame([], "file_path string, content string")
    found = mining.history_records(empty, mining.mined_history(*_history(spark)))
    top = F.array_max(F.map_values("taxonomy_labels"))
    good = F.when(F.col("label") == 1, (F.col("risk_score") <= 0.15) & (top == 0)).otherwise(F.col("risk_score").between(0.85, 0.95) & (top >= 0.65))
    return found.groupBy("source_type", "label").agg(F.count("*").alias("records"), F.bool_and(good).alias("in_range"))


_PLANTED = f"""WITH {SYMBOLS}, {CALLS}, keyed AS (SELECT caller_id, file AS here, lineno AS line, unnest([callee, last, CASE WHEN callee ~ '(self|cls|this)[.][^.]+' AND up <> '' THEN up || '.' || last END]) AS key FROM called),
  used AS (SELECT DISTINCT n.id, n.file, n.name, n.lineno, n.end_lineno, n.signature, n.max_args, caller_id, here, line FROM named n JOIN keyed k ON k.key IN (n.name, n.qual) AND k.caller_id <> n.id WHERE kind IN ('function', 'async_function', 'method')),
  first_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY here, line, caller_id) AS nth FROM used QUALIFY nth <= 3), each_ AS (SELECT DISTINCT id, file, lineno, end_lineno, signature, max_args FROM first_),
  made AS (
    SELECT id, 'clean_pass' AS category, 2 AS n FROM each_ WHERE file LIKE '%.py' OR end_lineno > lineno
    UNION ALL SELECT id, unnest(['silent_logic_drift', 'security_surface', 'concurrency_hazard', 'performance_regression', 'breaking_public_api', 'arity_breaking', 'deleted_symbol', 'keyword_changes']), 1 FROM each_
    UNION ALL SELECT id, 'keyword_changes', 1 FROM each_ WHERE file LIKE '%.py' AND len(string_split(signature, ',')) <= max_args
    UNION ALL SELECT id, 'circular_imports', 1 FROM first_ WHERE string_split(string_split(caller_id, '::')[-1], '.')[-1] <> name
    UNION ALL SELECT id, 'circular_imports', 1 FROM first_ WHERE here <> file AND (file LIKE '%.py' AND here LIKE '%.py' OR file LIKE '%.ts' AND here LIKE '%.ts'))"""


@register(
    "e18_planted_changes",
    _PLANTED + """ SELECT id AS symbol, category, CASE category WHEN 'clean_pass' THEN 1 ELSE 0 END AS label,
        CASE WHEN category IN ('arity_breaking', 'keyword_changes', 'circular_imports', 'deleted_symbol') THEN 'REJECTED' ELSE 'APPROVED' END AS expect, CAST(sum(n) AS BIGINT) AS changes FROM made GROUP BY ALL""",
)
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mining.planted(files(spark), structural=True)
    return rows.groupBy(F.col("symbol_id").alias("symbol"), "category", "label", "expect").agg(F.count("*").alias("changes"))


#: What the gate makes of the planted changes: of nine called Python functions ``ping`` and ``pong`` are in a cycle and
#: ``render`` calls ``basket.add``, which goes by name to the Rust ``add`` of two arguments; that call also stops changes
#: of ``add`` itself. A variadic ``Step`` and ``load`` take a further argument; names that stand elsewhere too may go.
_MINED = """SELECT language, unnest(['silent_logic_drift', 'security_surface', 'concurrency_hazard', 'performance_regression', 'breaking_public_api']) AS category, 0 AS label, n AS records FROM (VALUES ('python', 6), ('go', 2), ('typescript', 1)) v(language, n)
   UNION ALL SELECT * FROM (VALUES ('python', 'clean_pass', 1, 12), ('go', 'clean_pass', 1, 2),
     ('python', 'arity_breaking', 0, 9), ('go', 'arity_breaking', 0, 1), ('rust', 'arity_breaking', 0, 1), ('typescript', 'arity_breaking', 0, 1),
     ('python', 'circular_imports', 0, 15), ('go', 'circular_imports', 0, 2), ('rust', 'circular_imports', 0, 2), ('typescript', 'circular_imports', 0, 4),
     ('python', 'deleted_symbol', 0, 8), ('go', 'deleted_symbol', 0, 2), ('rust', 'deleted_symbol', 0, 1), ('typescript', 'deleted_symbol', 0, 1),
     ('python', 'keyword_changes', 0, 16), ('go', 'keyword_changes', 0, 1), ('rust', 'keyword_changes', 0, 2)) w"""


@register("e18_mined_records", _MINED)
def e18_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mined(files(spark), structural=True).groupBy("language", "category", "label").agg(F.count("*").alias("records"))


@register(
    "e19_generated_records",
    """WITH g AS (SELECT unnest(['python', 'typescript', 'go', 'rust']) AS language), c AS (SELECT * FROM (VALUES ('clean_pass', 1, true, 2), ('silent_logic_drift', 0, true, 1), ('security_surface', 0, true, 1),
         ('concurrency_hazard', 0, true, 1), ('performance_regression', 0, true, 1), ('breaking_public_api', 0, true, 1), ('arity_breaking', 0, false, 1), ('keyword_changes', 0, false, 1), ('circular_imports', 0, false, 1), ('deleted_symbol', 0, false, 1)) v(category, label, symbolic_gate_passed, n))
       SELECT language, category, label, symbolic_gate_passed, CAST(2 * (n + CASE WHEN category = 'keyword_changes' AND language = 'python' OR category = 'circular_imports' AND language IN ('python', 'typescript') THEN 1 ELSE 0 END) AS BIGINT) AS records FROM g, c""",
)
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.generated(spark, 2).groupBy("language", "category", "label", "symbolic_gate_passed").agg(F.count("*").alias("records"))


@register(
    "e19_template_changes",
    """SELECT * FROM (VALUES ('t/pass/1', 'm.py', 'clean_pass', 1, 'APPROVED', 'def f(a):'), ('t/pass/2', 'm.py', 'clean_pass', 1, 'APPROVED', '# variant 2'),
         ('t/flip/1', 'm.py', 'logic_drift', 0, 'APPROVED', 'def f(a):'), ('t/flip/2', 'm.py', 'logic_drift', 0, 'APPROVED', '# variant 2')) v(patch_id, file_path, category, label, expect, head)""",
)
def e19_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("t", "m.py", "logic_drift", {"pass": "def f(a):\n    return a\n", "flip": "def f(a):\n    return not a\n"})]
    templates = spark.createDataFrame(rows, "name string, target_file string, category string, patches map<string,string>")
    return mining.from_templates(templates, 2).select("patch_id", "file_path", "category", "label", "expect", F.element_at(F.split("patch", "\n"), 1).alias("head"))
