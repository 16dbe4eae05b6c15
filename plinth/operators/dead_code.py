"""Dead code: entrypoints, reference edges, reachability, orphan and transitive symbols, triage."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import last_segment, path_parts
from ..session import Scratch
from ..sources import code
from . import graph, index

#: Decorators that make a route, a command or a test.
ROUTE = r"(?i)@\s*([\w.]+\.)?(app|router|bp|api|server|web)\s*\.\s*(get|post|put|delete|patch|options|head|route|websocket)\b|@(Get|Post|Put|Delete|Patch|Controller|Route)\b|#\[(get|post|put|delete|patch|route)\("
COMMAND = r"(?i)@\s*([\w.]+\.)?(click|typer|app|cli|main)\s*\.\s*(command|group|option|argument)\b"
TEST = r"(?i)@\s*(pytest\s*\.\s*fixture|fixture)\b|#\[(tokio::test|test|actix_web::|rocket::)"
#: Files whose symbols are a package's face.
FACES = ("__init__.py", "index.ts", "index.tsx", "index.js", "index.jsx", "main.ts", "main.tsx", "mod.rs", "lib.rs", "main.rs", "main.go")
#: Files of commands, names of entry points, and what names, calls and folders tell commands, routes and tests.
COMMAND_FILES = ("cli.py", "main.py", "__main__.py", "main.go", "main.rs", "commands.py", "cmd.py")
COMMAND_NAMES, RUN_NAMES, RUN_PATTERN = ("main", "cli", "run_cli", "app"), ("run", "execute", "start"), "^(cmd_|do_)|(_command|_cmd)$"
COMMAND_CALL = r"(click\.(command|group)|(app|cli|typer)\.command)"
ROUTE_CALL = r"(?i)((app|router)\.(get|post|put|delete|patch)|app\.route|bp\.(route|get|post))"
GO_TESTS = "^(Test|Benchmark|Fuzz|Example)"
TEST_FOLDERS, TEST_FILES = ("tests", "test", "__tests__", "spec"), r"^test_|_test\.(py|go|rs)$|\.(spec|test)\.[jt]sx?$"


def _file() -> Column:
    return F.element_at(path_parts(F.col("file_path")), -1)


def in_test_file() -> Column:
    folder = F.exists(path_parts(F.col("file_path")), lambda p: p.isin(*TEST_FOLDERS))
    return folder | _file().rlike(TEST_FILES)


#: What a symbol calls that makes it a root: a fixture, a command, a route.
ENTRY_CALLS = rf"(fixture$)|{COMMAND_CALL}|(?i:{ROUTE_CALL.removeprefix('(?i)')})"


def entrypoint() -> Column:
    """Whether a symbol row (with ``enters``: one of its calls is of ``ENTRY_CALLS``) is a root by itself."""
    name, kind = F.col("name"), F.col("kind")
    decorated = lambda pattern: F.exists("decorators", lambda d: d.rlike(pattern))
    go = F.col("file_path").endswith(".go")
    test = in_test_file() | name.startswith("test_") | (name.startswith("Test") & kind.isin("class", "function")) | (go & name.rlike(GO_TESTS)) | decorated(TEST)
    command = name.isin(*COMMAND_NAMES) | (go & (name == "init")) | (_file().isin(*COMMAND_FILES) & (name.isin(*RUN_NAMES) | name.rlike(RUN_PATTERN)))
    command = command | (name.startswith("cmd_") & kind.isin("function", "async_function")) | decorated(COMMAND)
    route = F.col("enters") | decorated(ROUTE)
    face = _file().isin(*FACES)
    top_go = go & ~F.col("file_path").rlike("^(?!\\./).*/|^\\./.*/.*/") & name.rlike("^[A-Z]")
    magic = name.rlike("^__.*__$") | (name == "constructor")
    return (kind == "module") | (name == "<module>") | test | command | route | face | top_go | magic


def exported() -> Column:
    nested = F.col("qualname").contains(".") & ~F.col("is_method")
    fallback = F.when(F.col("language") == "python", ~F.col("name").startswith("_")).when(F.col("language") == "go", F.col("name").rlike("^[A-Z]")).otherwise(F.col("signature").rlike("^(pub|export) "))
    return ~nested & (F.col("is_exported") | (F.col("visibility") == "public") | fallback)


def references(symbols: DataFrame, calls: DataFrame, resolved_imports: DataFrame) -> DataFrame:
    """``(src, dst)``: resolved calls, methods of the last name of dotted calls, class to constructor and to base,
    and every symbol that a call's text names. It over-reaches by name, so what it calls dead is dead.

    What goes by name goes through a node of that name (see ``graph``), so callers and definitions of a common
    name add up and do not multiply.
    """
    # A call resolves to a symbol of its own last name, which the name's node reaches, or through an import's other name.
    aliased = resolved_imports.where(F.col("target").isNotNull() & (F.col("asname").isNotNull() | (F.col("name") == "default")))
    aliased = aliased.select("file_path", F.coalesce("asname", "name").alias("alias"), F.explode(F.array(F.concat_ws("::", "target", "name"), F.concat_ws("::", "target", F.lit("default")))).alias("dst"))
    hits = calls.select("file_path", F.col("caller_id").alias("src"), F.col("callee").alias("alias")).join(aliased, ["file_path", "alias"]).join(symbols.select(F.col("symbol_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    any_name, method_name = (lambda c, tag=tag: F.concat(F.lit(graph.NAME + tag), c) for tag in ("n ", "m "))
    named = symbols.select(F.explode(F.array_distinct(F.array("name", "qualname"))).alias("key"), "symbol_id").select(any_name(F.col("key")).alias("src"), F.col("symbol_id").alias("dst"))
    texts = index.caller_index(calls).select(F.col("caller_id").alias("src"), any_name(F.col("key")).alias("dst"))
    methods = symbols.where(F.col("kind").isin("function", "async_function", "method")).select(method_name(F.col("name")).alias("src"), F.col("symbol_id").alias("dst"))
    dotted = calls.where(F.col("callee").rlike(r"\.|::")).select(F.col("caller_id").alias("src"), method_name(last_segment(F.col("callee"))).alias("dst"))
    ctors = symbols.where(F.col("name").isin("__init__", "constructor")).select(F.regexp_replace("symbol_id", r"\.[^.]+$", "").alias("src"), F.col("symbol_id").alias("dst"))
    bases = symbols.select(F.col("symbol_id").alias("src"), F.explode("bases").alias("b")).select("src", any_name(last_segment(F.col("b"))).alias("dst"))
    every = hits
    for more in (named, texts, methods, dotted, ctors, bases):
        every = every.unionByName(more)
    return every.where("src <> dst")


def between_symbols(edges: DataFrame) -> DataFrame:
    """The pairs ``(src, dst)`` of symbols behind edges through names; for small graphs, as pairs multiply."""
    named = lambda c: F.col(c).startswith(graph.NAME)
    pairs = edges.where(named("dst")).select("src", F.col("dst").alias("by")).join(edges.where(named("src")).select(F.col("src").alias("by"), "dst"), "by").select("src", "dst")
    return edges.where(~named("src") & ~named("dst")).select("src", "dst").unionByName(pairs).where("src <> dst").distinct()


#: Flags of a node row: a symbol, a root, a module, one that lives with its owner.
_SYMBOL, _ROOT, _MODULE, _KEPT = 1, 2, 4, 8


def _unreached(rows: Iterator[tuple[Any, ...]]) -> list[tuple[Any, ...]]:
    """Of edges (flag 0) and nodes with their owners: the dead symbols, their kinds and roots."""
    pairs, ahead, roots, symbols = [], {}, {}, {}
    for a, b, what in rows:
        if not what:
            pairs.append((a, b))
            ahead.setdefault(a, []).append(b)
        if what & _ROOT:
            roots[a] = True
        if what & _SYMBOL:
            symbols[a] = (b, what)
    live = graph.walk(roots, ahead)
    dead = {n for n, (owner, what) in symbols.items() if n not in live and not what & _MODULE and not (what & _KEPT and owner in live)}
    return graph.clusters_of(dead, pairs)


def _unreached_at_scale(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by distributed rounds."""
    flag = lambda bit: F.col("what").bitwiseAND(bit) > 0
    live = graph.reachable(edges, nodes.where(flag(_ROOT)).select(F.col("src").alias("node")), one_task=-1).select("node")
    rest = nodes.where(flag(_SYMBOL) & ~flag(_MODULE)).join(live.withColumnRenamed("node", "src"), "src", "left_anti")
    owner = live.select(F.col("node").alias("dst"), F.lit(True).alias("owned"))
    dead = scratch.keep(rest.join(owner, "dst", "left").where(~(F.coalesce("owned", F.lit(False)) & flag(_KEPT))).select(F.col("src").alias("node")), "unreached")
    return graph.dead_clusters(edges, dead, -1).toDF("symbol_id", "dead_kind", "cluster_root")


def dead_symbols(facts: DataFrame, files: DataFrame, min_lines: int = 1, paths: list[str] | None = None, include_exported: bool = True, one_task: int = graph.ONE_TASK_EDGES) -> DataFrame:
    """Unreachable symbols: ``symbol_id, name, kind, file_path, lineno, end_lineno, lines, dead_kind, cluster_root, reason``."""
    scratch = Scratch(facts.sparkSession, "dead")
    facts = scratch.keep(facts, "facts")
    symbols, calls = code.symbols(facts), code.calls(facts)
    resolved = scratch.keep(index.resolve_imports(code.imports(facts), files), "imports")
    edges = scratch.keep(references(symbols, calls, resolved), "edges")
    enters = calls.where(F.col("callee").rlike(ENTRY_CALLS)).select(F.col("caller_id").alias("symbol_id"), F.lit(True).alias("enters")).distinct()
    rich = symbols.join(enters, "symbol_id", "left").withColumn("enters", F.coalesce("enters", F.lit(False)))
    # Properties, overloads and special methods of a live class live with it.
    kept = F.col("is_method") & (F.exists("decorators", lambda d: F.lower(d).rlike(r"@property|@cached_property|\.setter|\.deleter|@abstractmethod|@overload")) | F.col("name").rlike("^__.*__$"))
    flags = F.when(entrypoint(), _ROOT).otherwise(0) + F.when(F.col("kind") == "module", _MODULE).otherwise(0) + F.when(kept, _KEPT).otherwise(0)
    nodes = rich.select(F.col("symbol_id").alias("src"), F.regexp_replace("symbol_id", r"\.[^.]+$", "").alias("dst"), (_SYMBOL + flags).cast("int").alias("what"))
    # What a package's face imports is a root; a star brings the whole file.
    face = resolved.where(F.element_at(path_parts(F.col("file_path")), -1).isin(*FACES) & F.col("target").isNotNull())
    brought = symbols.join(face.select(F.col("target").alias("file_path"), F.col("name").alias("wanted")).distinct(), "file_path").where((F.col("wanted") == "*") | (F.col("wanted") == F.col("name")))
    nodes = nodes.unionByName(brought.select(F.col("symbol_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(_ROOT).alias("what")))
    if edges.count() <= one_task:
        found = graph.whole(edges.withColumn("what", F.lit(0)).unionByName(nodes), _unreached, "symbol_id string, dead_kind string, cluster_root string")
    else:
        found = _unreached_at_scale(edges, scratch.keep(nodes, "nodes"), scratch)
    dead = symbols.where("kind <> 'module'")
    lines = F.greatest(F.lit(1), F.col("end_lineno") - F.col("lineno") + 1)
    out = dead.join(found, "symbol_id").withColumn("lines", lines).where(F.col("lines") >= min_lines)
    if not include_exported:
        out = out.where(~exported())
    if paths:
        out = out.where(F.exists(F.array(*[F.lit(p.rstrip("/")) for p in paths]), lambda p: (F.col("file_path") == p) | F.col("file_path").startswith(F.concat(p, F.lit("/")))))
    reason = F.when(F.col("dead_kind") == "orphan", "no live or dead caller").when(F.col("cluster_root") == F.col("symbol_id"), "Dead cycle: only reached from itself").otherwise(F.concat(F.lit("only reached from dead "), "cluster_root"))
    return out.withColumn("reason", reason)


def report(dead: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: symbols scanned, dead, lines, orphans, transitive, cluster roots, files."""
    total = facts.agg(F.sum(F.size("symbols")).alias("symbols"))
    counts = dead.agg(F.count("*").alias("dead"), F.coalesce(F.sum("lines"), F.lit(0)).alias("dead_lines"), F.count_if(F.col("dead_kind") == "orphan").alias("orphans"), F.count_if(F.col("dead_kind") == "transitive").alias("transitive"), F.count_distinct("cluster_root").alias("roots"), F.count_distinct("file_path").alias("files"))
    return counts.crossJoin(total)  # one row each


#: Words in a name or a documentation that mark leftovers.
CRUFT = ("deprecated", "legacy", "todo", "unused", "obsolete", "temp", "tmp", "old_", "_old", "abandoned", "delete_me")
#: Bases whose subclasses a framework calls, and parts of a path that mark a library's face.
CONTRACTS = ("BaseModel", "BaseSettings", "APIKey", "HTTPBase", "BaseRoute", "APIRoute", "HTTPException", "Exception", "Enum", "IntEnum", "StrEnum", "Protocol")
PUBLIC_PATHS = ("models.py", "schemas.py", "handlers.py", "exception_handlers.py", "interfaces.py", "constants.py", "types.py", "openapi", "binding", "adapter", "__init__.py", "index.ts", "lib.rs", "mod.rs", "api", "routes.py", "endpoints.py", "protocols.py")
#: Folders that are never a library's face, beside those of tests.
INNER_FOLDERS = ("internal", "private")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def public_surface() -> Column:
    """Whether a symbol is meant for others, by its language's own rule; tests, inner folders and leftovers never are."""
    path, name = F.lower(F.regexp_replace("file_path", r"\\", "/")), F.col("name")
    inner = in_test_file() | F.exists(path_parts(F.col("file_path")), lambda p: p.isin(*INNER_FOLDERS))
    cruft = _any(F.lower(name), CRUFT) | _any(F.lower(F.coalesce("docstring", F.lit(""))), CRUFT)
    signature = F.trim("signature")
    go = name.rlike("^[A-Z]") & ~(path.endswith("main.go") & (name == "main"))
    contract = F.exists("bases", lambda b: last_segment(b).isin(*CONTRACTS))
    python = F.col("is_exported") & (contract | _any(path, PUBLIC_PATHS) | (F.coalesce("docstring", F.lit("")) != ""))
    by_language = F.when(F.col("language") == "go", go).when(F.col("language") == "typescript", F.col("is_exported") | signature.startswith("export "))
    by_language = by_language.when(F.col("language") == "rust", F.col("is_exported") | signature.startswith("pub ")).otherwise(python)
    return ~inner & ~cruft & F.coalesce(by_language, F.lit(False))


def triaged(dead: DataFrame) -> DataFrame:
    """``classification``, its three probabilities and ``cruft_confidence``: stage one keeps a library's public surface
    back, stage two tells leftovers by their words from what is merely unused inside."""
    public, cruft = public_surface(), _any(F.lower("name"), CRUFT) | _any(F.lower(F.coalesce("docstring", F.lit(""))), CRUFT) | _any(F.lower("file_path"), CRUFT)
    kind = F.when(public, "PUBLIC_API_SURFACE").when(cruft, "GENUINE_CRUFT").otherwise("INTERNAL_ORPHAN")
    sure = F.when(public, 0.05).when(cruft, 0.95).when(exported(), 0.10).otherwise(0.70)
    chart = lambda a, b, c: F.create_map(F.lit("PUBLIC_API_SURFACE"), F.lit(a), F.lit("INTERNAL_ORPHAN"), F.lit(b), F.lit("GENUINE_CRUFT"), F.lit(c))
    odds = F.when(public, chart(0.95, 0.04, 0.01)).when(cruft, chart(0.01, 0.04, 0.95)).when(exported(), chart(0.80, 0.10, 0.10)).otherwise(chart(0.10, 0.20, 0.70))
    return dead.withColumns({"classification": kind, "cruft_confidence": sure, "semantic_probabilities": odds}).withColumn("suppressed", F.col("classification") == "PUBLIC_API_SURFACE")


def symbol_text() -> Column:
    """A symbol's signature and the first line of its documentation, 80 characters of it."""
    return F.concat(F.lit("[SYM] "), F.col("signature"), F.when(F.col("docstring").isNotNull(), F.concat(F.lit(" [DOC] "), F.substring(F.trim(F.element_at(F.split(F.trim("docstring"), "\n"), 1)), 1, 80))).otherwise(F.lit("")))
