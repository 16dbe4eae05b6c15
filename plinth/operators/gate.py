"""The symbolic gate over many patches at once: contracts, references, imports, cycles, verdicts.

The workspace's facts are read once; a patch replaces its own files only (rows keyed by ``patch_id`` against
shared base rows), so no patch copies the workspace. Patches whose files do not parse leave before any join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import last_segment
from ..session import Scratch
from ..sources import code
from . import graph, index

#: Fixed value: kinds whose signatures are contracts.
CALLABLE = ("function", "async_function", "method")
#: Fixed value: names of what a call of a class calls.
CONSTRUCTORS = ("__init__", "constructor")


def check_call(call: dict[str, Any], name: str, params: list[dict[str, Any]], is_method: bool) -> list[str]:
    """Messages of what a call breaks in a signature; unpacked arguments leave open what they may supply."""
    formal = params[1:] if is_method else params
    ordered = [p for p in formal if not (p["is_kwonly"] or p["is_vararg"] or p["is_kwarg"])]
    named = [p for p in formal if p["is_kwonly"]]
    takes_rest, takes_names = any(p["is_vararg"] for p in formal), any(p["is_kwarg"] for p in formal)
    given, words = call["args_count"], call["kwargs"] or []
    at = f"'{call['caller_id']}' line {call['lineno']} -> '{name}'"
    out = []
    if given > len(ordered) and not takes_rest and not call["has_vararg"]:
        out.append(f"ARITY_MISMATCH: {at}: {given} positional arguments, at most {len(ordered)} accepted")
    out += [f"DUPLICATE_ARGUMENT: {at}: '{w}' by position and by name" for w in words if w in {p["name"] for p in ordered[:given]}]
    only = {p["name"] for p in ordered if p["is_posonly"]}
    out += [f"KEYWORD_MISMATCH: {at}: positional-only '{w}' by name" for w in words if w in only]
    if not takes_names:
        known = {p["name"] for p in [*ordered, *named]}
        out += [f"KEYWORD_MISMATCH: {at}: unexpected keyword '{w}'" for w in words if w not in known]
    if not call["has_vararg"]:
        for p in ordered[given:]:
            if not p["has_default"] and p["name"] not in words and (p["is_posonly"] or not call["has_kwarg"]):
                out.append(f"ARITY_MISMATCH: {at}: required '{p['name']}' is missing")
    if not call["has_kwarg"]:
        out += [f"KEYWORD_MISMATCH: {at}: required keyword '{p['name']}' is missing" for p in named if not p["has_default"] and p["name"] not in words]
    return out


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(r["patch_id"], m) for r in batch.to_pylist() for m in check_call(r, r["name"], r["params"] or [], r["is_method"])]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["patch_id", "violation"])


_CALL = ["patch_id", "caller_id", "lineno", "callee", "args_count", "kwargs", "has_vararg", "has_kwarg"]


def _contracts(pairs: DataFrame) -> DataFrame:
    """Violations of ``pairs``: call columns with ``name, params, is_method`` of the callee."""
    once = pairs.select(*_CALL, "name", "params", "is_method").dropDuplicates([*_CALL, "name"])
    return once.mapInArrow(_checked, "patch_id string, violation string")


def _entered(wanted: DataFrame, old_symbols: DataFrame, new_symbols: DataFrame, outside: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """``(patch_id, class_id, name, params, is_method)``: the constructors of the ``wanted`` classes, in each patch's own workspace.

    Only the classes that bases lead to by name are gathered, not the workspace of each patch.
    """

    def named(keys: DataFrame) -> DataFrame:
        return outside(old_symbols.join(keys, "name")).unionByName(new_symbols.join(keys, ["patch_id", "name"]), allowMissingColumns=True)

    names = scratch.keep(wanted.select("patch_id", "name").distinct(), "ctor_names0")
    if names.isEmpty():
        kinds = dict(old_symbols.dtypes)
        return old_symbols.sparkSession.createDataFrame([], f"patch_id string, class_id string, name string, params {kinds['params']}, is_method boolean")
    asked, family, step = names, wanted, 0
    while not names.isEmpty():
        step += 1
        more = scratch.keep(named(names).where("kind = 'class'"), f"ctor_classes{step}")
        family = more if step == 1 else family.unionByName(more)
        names = more.select("patch_id", F.explode("bases").alias("base")).select("patch_id", last_segment(F.col("base")).alias("name")).distinct()
        names = scratch.keep(names.join(asked, ["patch_id", "name"], "left_anti"), f"ctor_names{step}")
        asked = asked.unionByName(names)
    homes = family.select("patch_id", F.col("symbol_id").alias("home")).distinct()
    own_of = lambda rows: rows.where(F.col("name").isin(*CONSTRUCTORS)).withColumn("home", F.regexp_replace("symbol_id", r"\.[^.]+$", ""))
    own = outside(own_of(old_symbols).join(homes, "home")).unionByName(own_of(new_symbols).join(homes, ["patch_id", "home"]), allowMissingColumns=True)
    own = scratch.keep(own.drop("home"), "ctor_own")
    found = index.constructors(family.unionByName(own, allowMissingColumns=True), "patch_id", names=CONSTRUCTORS)
    # Of repeated definitions the last one holds.
    last = own.groupBy("patch_id", F.col("symbol_id").alias("ctor_id")).agg(F.max_by(F.struct(F.col("qualname").alias("name"), "params", "is_method"), "sym_ord").alias("s"))
    return found.join(last, ["patch_id", "ctor_id"]).select("patch_id", "class_id", "s.*")


def _rings(rows: Iterator[tuple[Any, ...]]) -> list[tuple[Any, ...]]:
    """``(patch, cycle)`` of import edges ``(patch, src, dst)`` - no patch: the base's, no ``dst``: a file that the patch has."""
    base: dict[str, list[str]] = {}
    own: dict[str, dict[str, list[str]]] = {}
    for patch, a, b in rows:
        if patch is None:
            base.setdefault(a, []).append(b)
        else:
            mine = own.setdefault(patch, {}).setdefault(a, [])
            if b is not None:
                mine.append(b)
    out = []
    for patch, mine in own.items():
        ahead = _Over(base, mine)
        reach = graph.walk(dict.fromkeys(mine), ahead)
        out += [(patch, c) for c in graph.tarjan({n: ahead.get(n, []) for n in reach}) if any(n in mine for n in c)]
    return out


class _Over(dict):
    """An adjacency with some nodes' edges replaced."""

    def __init__(self, base: dict[str, list[str]], own: dict[str, list[str]]):
        super().__init__(own)
        self.base = base

    def get(self, node: str, default: Any = None) -> Any:
        return self[node] if node in self else self.base.get(node, default)


def _rings_at_scale(stays: DataFrame, fresh: DataFrame, touched: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by rounds: backwards from each patched file, then components among what leads back to it."""
    frontier = seen = scratch.keep(touched.select("patch_id", F.col("touched").alias("home"), F.col("touched").alias("node")), "back0")
    hop = 0
    while True:
        hop += 1
        back = frontier.join(stays, F.col("dst") == F.col("node")).select("patch_id", "home", F.col("src").alias("node"))
        back = back.join(touched.withColumnRenamed("touched", "node"), ["patch_id", "node"], "left_anti")
        back = back.unionByName(frontier.join(fresh.withColumnRenamed("dst", "node"), ["patch_id", "node"]).select("patch_id", "home", F.col("src").alias("node")))
        frontier = scratch.keep(back.distinct().join(seen, ["patch_id", "home", "node"], "left_anti"), f"back{hop}")
        if frontier.isEmpty():
            break
        seen = scratch.keep(seen.unionByName(frontier), f"seen{hop}")
    # A patched file is in a cycle where it imports what leads back to it; the component is found among what leads back.
    closing = fresh.join(seen, (fresh["patch_id"] == seen["patch_id"]) & (fresh["src"] == seen["home"]) & (fresh["dst"] == seen["node"])).select(fresh["patch_id"], F.col("src").alias("home")).distinct()
    around = scratch.keep(seen.join(closing, ["patch_id", "home"]), "around")
    tail, head = around.withColumnRenamed("node", "src"), around.withColumnRenamed("node", "dst")
    kept = tail.join(touched.withColumnRenamed("touched", "src"), ["patch_id", "src"], "left_anti").join(stays, "src").join(head, ["patch_id", "home", "dst"], "left_semi")
    made = tail.join(fresh, ["patch_id", "src"]).join(head, ["patch_id", "home", "dst"], "left_semi")
    ring = kept.select("patch_id", "home", "src", "dst").unionByName(made.select("patch_id", "home", "src", "dst"))
    ring = graph.cycles_by_key(ring.withColumn("key", F.to_json(F.struct("patch_id", "home"))), "key")
    ring = ring.withColumn("k", F.from_json("key", "patch_id string, home string")).where(F.array_contains("cycle", F.col("k.home")))
    return ring.select(F.col("k.patch_id").alias("patch_id"), "cycle").distinct()


def import_rings(stays: DataFrame, fresh: DataFrame, touched: DataFrame, scratch: Scratch, one_task: int = graph.ONE_TASK_EDGES) -> DataFrame:
    """``(patch_id, cycle)``: the strong components of each patch's import graph that hold one of its files.

    ``stays(src, dst)`` are the base's edges, ``fresh(patch_id, src, dst)`` those of patched files, which replace the
    base's. One task walks them while edges times patches are few; beyond that, rounds of joins.
    """
    rows = stays.select(F.lit(None).cast("string").alias("patch_id"), "src", "dst").unionByName(fresh.select("patch_id", "src", "dst"))
    rows = scratch.keep(rows.unionByName(touched.select("patch_id", F.col("touched").alias("src"), F.lit(None).cast("string").alias("dst"))), "imports")
    size = rows.agg(F.count("*"), F.count_distinct("patch_id")).first()
    if size[0] * max(1, size[1]) <= one_task:
        return graph.whole(rows, _rings, "patch_id string, cycle array<string>")
    return _rings_at_scale(stays, fresh, touched, scratch)


def gate(located: DataFrame, base_facts: DataFrame, files: DataFrame, hops: int = 1, resolved_imports: DataFrame | None = None, calls_between: DataFrame | None = None) -> DataFrame:
    """``(patch_id, status, confidence, violations, cycles)`` for every patch of ``located`` (see ``patches.locate``).

    Call cycles are those of the slice ``hops`` calls around the changed symbols; import cycles are the strong
    components of the patch's own workspace that hold a patched file. ``located`` and ``base_facts`` are read often,
    so they should be written tables; the base's resolved imports and call edges are worked out where not given.
    """
    scratch = Scratch(located.sparkSession, "gate")
    base = base_facts
    broken = located.where("syntax_error is not null").select("patch_id", F.concat_ws(": ", "file_path", "syntax_error").alias("violation"))
    fine = scratch.keep(located.join(broken.select("patch_id").distinct(), "patch_id", "left_anti"), "fine")
    touched = fine.select("patch_id", F.col("file_path").alias("touched"))

    new_symbols, new_calls, new_imports = (f(fine, "patch_id") for f in (code.symbols, code.calls, code.imports))
    old_symbols, old_calls, old_imports = (f(base) for f in (code.symbols, code.calls, code.imports))
    changed = fine.select("patch_id", "file_path", F.explode(F.array_distinct(F.concat("affected", "added"))).alias("qualname"))
    mine = new_symbols.join(changed, ["patch_id", "file_path", "qualname"], "left_semi")

    def outside(rows: DataFrame) -> DataFrame:
        """Of rows with a patch id and a base file, those whose file the patch leaves alone."""
        return rows.join(touched.withColumnRenamed("touched", "file_path"), ["patch_id", "file_path"], "left_anti")

    # Callers, by name, of what changed; a constructor is called by its class's name.
    contract = mine.where(F.col("kind").isin(*CALLABLE)).select("patch_id", F.col("qualname").alias("target"), "params", "is_method", F.col("file_path").alias("home"), F.col("name").alias("short"))
    ctor = F.col("short").isin("__init__", "constructor")
    owner = F.regexp_extract("target", r"([^.]+)\.[^.]+$", 1)
    keys = contract.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.when(ctor, F.array(owner)).otherwise(F.array("target", "short"))))))
    indexed_old, indexed_new = index.caller_index(old_calls), index.caller_index(new_calls)
    far = outside(keys.join(indexed_old, "key").withColumn("name", F.col("target")))
    near = keys.join(indexed_new, ["patch_id", "key"]).withColumn("name", F.col("target"))
    violations = _contracts(far.select(*_CALL, "name", "params", "is_method").unionByName(near.select(*_CALL, "name", "params", "is_method")))

    # Calls that changed symbols make, against what they resolve to.
    resolved_new = index.resolve_imports(new_imports, files.select("file_path").union(fine.select("file_path")).distinct(), "patch_id")
    resolved_new = scratch.keep(resolved_new, "resolved_new")
    wanted = new_calls.select("patch_id", last_segment(F.col("callee")).alias("name")).distinct()
    lookup = outside(old_symbols.join(wanted, "name")).unionByName(new_symbols, allowMissingColumns=True)
    lookup = scratch.keep(lookup, "lookup")
    aimed = scratch.keep(index.resolve_calls(new_calls, lookup, resolved_new, "patch_id").where("target_id is not null"), "aimed")
    made = aimed.join(changed.select("patch_id", "file_path", F.col("qualname").alias("caller")), ["patch_id", "file_path", "caller"], "left_semi")
    callee = lookup.where(F.col("kind").isin(*CALLABLE)).select("patch_id", F.col("symbol_id").alias("target_id"), F.col("qualname").alias("name"), "params", "is_method")
    violations = violations.unionByName(_contracts(made.join(callee, ["patch_id", "target_id"])))

    # A class is called by its constructor, own or of a base; one without takes no arguments.
    made_classes = lookup.where("kind = 'class'").join(made.select("patch_id", F.col("target_id").alias("symbol_id")).distinct(), ["patch_id", "symbol_id"], "left_semi")
    entered = _entered(made_classes, old_symbols, new_symbols, outside, scratch)
    taken = made_classes.select("patch_id", F.col("symbol_id").alias("target_id"), "qualname").distinct().join(entered.withColumnRenamed("class_id", "target_id"), ["patch_id", "target_id"], "left")
    taken = taken.select("patch_id", "target_id", F.coalesce("name", "qualname").alias("name"), "params", F.coalesce("is_method", F.lit(False)).alias("is_method"))
    violations = violations.unionByName(_contracts(made.join(taken, ["patch_id", "target_id"])))

    # Deleted symbols that are still called or imported elsewhere.
    gone = fine.select("patch_id", "file_path", F.explode("deleted").alias("qualname")).withColumn("short", last_segment(F.col("qualname"))).withColumnRenamed("file_path", "home")
    gone_keys = gone.withColumn("key", F.explode(F.array_distinct(F.array("qualname", "short"))))
    still = outside(gone_keys.join(indexed_old, "key")).select("patch_id", "qualname", "home", "caller_id", "lineno").unionByName(gone_keys.join(indexed_new, ["patch_id", "key"]).select("patch_id", "qualname", "home", "caller_id", "lineno"))
    other = new_symbols.select("patch_id", "name").unionByName(outside(old_symbols.join(gone.select("patch_id", F.col("short").alias("name")).distinct(), "name")).select("patch_id", "name")).distinct()
    still = still.withColumn("name", last_segment(F.col("qualname"))).join(other, ["patch_id", "name"], "left_anti")
    imported = outside(old_imports.join(gone.select("patch_id", F.col("short").alias("name"), "qualname", "home"), "name"))
    resolved_old = resolved_imports if resolved_imports is not None else scratch.keep(index.resolve_imports(old_imports, files), "resolved_old")
    aim = resolved_old.select("file_path", "imp_ord", "target")
    imported = imported.join(aim, ["file_path", "imp_ord"]).where("target = home").select("patch_id", "qualname", "home", F.col("file_path").alias("caller_id"), "lineno")
    message = F.format_string("BROKEN_REFERENCE: '%s::%s' is gone but '%s' line %d still uses it", "home", "qualname", "caller_id", "lineno")
    violations = violations.unionByName(still.select("patch_id", "qualname", "home", "caller_id", "lineno").unionByName(imported).select("patch_id", message.alias("violation")))

    # Imports of the patched files that lead nowhere, or to a name that is not there.
    relative = (F.col("level") > 0) | F.col("module").startswith(".")
    lost = resolved_new.where(relative & F.col("target").isNull()).select("patch_id", F.format_string("BROKEN_IMPORT: '%s' line %d: '%s' is no file of the workspace", "file_path", "lineno", F.coalesce("module", F.lit("."))).alias("violation"))
    defined = base.select("file_path", F.concat(F.transform("symbols", lambda s: s["name"]), F.transform("imports", lambda i: F.coalesce(i["asname"], i["name"])), "assigned").alias("names"))
    own = fine.select("patch_id", "file_path", F.concat(F.transform("symbols", lambda s: s["name"]), F.transform("imports", lambda i: F.coalesce(i["asname"], i["name"])), "assigned").alias("own_names"))
    named = resolved_new.where(F.col("target").isNotNull() & F.col("module").isNotNull() & ~F.col("name").isin("*", "default") & F.col("language").isin("python", "typescript"))
    named = named.join(defined.withColumnRenamed("file_path", "target"), "target", "left").join(own.withColumnRenamed("file_path", "target"), ["patch_id", "target"], "left")
    known = F.coalesce("own_names", "names", F.array().cast("array<string>"))
    whole = F.element_at(F.split(F.regexp_replace("target", r"(/__init__)?\.[a-z]+$", ""), "/"), -1) == F.col("name")
    missing = named.where(~F.array_contains(known, F.col("name")) & ~F.array_contains(known, F.lit("*")) & ~whole)
    lost = lost.unionByName(missing.select("patch_id", F.format_string("BROKEN_IMPORT: '%s' line %d: '%s' has no '%s'", "file_path", "lineno", "target", "name").alias("violation")))
    violations = violations.unionByName(lost)

    # Call cycles: among the changed symbols, what they call, and what lies up to ``hops`` calls around them.
    if calls_between is None:
        calls_between = scratch.keep(index.resolve_calls(old_calls, old_symbols, resolved_old).where("target_id is not null").select(F.col("caller_id").alias("src"), F.col("target_id").alias("dst")).distinct(), "base_edges")
    base_edges = calls_between.select("src", "dst", F.element_at(F.split("src", "::"), 1).alias("file_path"))
    own_edges = aimed.select("patch_id", F.col("caller_id").alias("src"), F.col("target_id").alias("dst")).where("src <> dst").distinct()
    seeds = changed.select("patch_id", F.concat_ws("::", "file_path", "qualname").alias("node")).distinct()
    near_by = seeds

    def beside(nodes: DataFrame, here: str, there: str) -> DataFrame:
        known = nodes.withColumnRenamed("node", here)
        step = outside(known.join(base_edges, here)).select("patch_id", F.col(there).alias("node"))
        return step.unionByName(known.join(own_edges, ["patch_id", here]).select("patch_id", F.col(there).alias("node")))

    for hop in range(hops):
        near_by = scratch.keep(near_by.unionByName(beside(near_by, "src", "dst")).unionByName(beside(near_by, "dst", "src")).distinct(), f"near{hop}")
    tail, head = near_by.withColumnRenamed("node", "src"), near_by.withColumnRenamed("node", "dst")
    inner = outside(tail.join(base_edges, "src")).select("patch_id", "src", "dst").unionByName(own_edges.join(tail, ["patch_id", "src"], "left_semi"))
    edges = inner.join(head, ["patch_id", "dst"], "left_semi").select("patch_id", "src", "dst").unionByName(own_edges.join(seeds.withColumnRenamed("node", "src"), ["patch_id", "src"], "left_semi").select("patch_id", "src", "dst"))
    call_cycles = graph.cycles_by_key(edges.where("src <> dst"))

    import_cycles = import_rings(index.import_edges(resolved_old), index.import_edges(resolved_new, "patch_id"), touched, scratch)

    cycles = call_cycles.withColumn("what", F.lit("call")).unionByName(import_cycles.withColumn("what", F.lit("import")))
    cycles = scratch.keep(cycles, "cycles")
    said = cycles.select("patch_id", F.concat(F.lit("CYCLE: Detected "), "what", F.lit(" cycle: "), F.array_join(F.concat("cycle", F.slice("cycle", 1, 1)), " -> ")).alias("violation"))
    every = scratch.keep(violations.unionByName(said).unionByName(broken).distinct(), "violations")
    by_patch = every.groupBy("patch_id").agg(F.array_sort(F.collect_list("violation")).alias("violations"))
    in_cycle = cycles.groupBy("patch_id").agg(F.array_sort(F.collect_list("cycle")).alias("cycles"))
    out = located.groupBy("patch_id").agg(F.max(F.col("syntax_error").isNotNull()).alias("unparsed")).join(by_patch, "patch_id", "left").join(in_cycle, "patch_id", "left")
    bad = F.size(F.coalesce("violations", F.array())) > 0
    return out.select(
        "patch_id", F.when(bad, "REJECTED").otherwise("APPROVED").alias("status"), F.when(F.col("unparsed"), 1.0).when(bad, 0.95).otherwise(0.98).alias("confidence"),
        F.coalesce("violations", F.array().cast("array<string>")).alias("violations"), F.coalesce("cycles", F.array().cast("array<array<string>>")).alias("cycles"), "unparsed",
    )
