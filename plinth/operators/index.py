"""Index and resolution: callers, importers, subclasses, import targets, callees, constructors.

Every index is a view; an overlay of changed files is a union that leaves the base alone.
"""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import last_segment, normal_path
from ..session import Scratch, ship

_RELATIVE = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs")
#: First path parts of the Go standard library's packages.
_GO_STD = frozenset({"archive", "bufio", "bytes", "cmp", "compress", "container", "context", "crypto", "database", "debug", "embed", "encoding", "errors", "expvar", "flag", "fmt", "go", "hash", "html", "image", "index", "io", "iter", "log", "maps", "math", "mime", "net", "os", "path", "plugin", "reflect", "regexp", "runtime", "slices", "sort", "strconv", "strings", "structs", "sync", "syscall", "testing", "text", "time", "unicode", "unique", "unsafe"})


def import_candidates(language: str, file_path: str, module: str | None, name: str, level: int) -> list[str]:
    """Files that an import may mean, best first; a Go package is ``dir:`` and its path."""
    here = posixpath.dirname(file_path)
    join = lambda *p: posixpath.normpath(posixpath.join(*p)) if any(p) else ""
    out: list[str] = []
    if language == "typescript":
        if module and module.startswith("."):
            base = join(here, module)
            stem = posixpath.splitext(base)[0] if base.endswith((".js", ".jsx", ".mjs", ".cjs")) else base
            out = [base] if base.endswith(_RELATIVE) else []
            out += [stem + e for e in _RELATIVE] + [f"{base}/index{e}" for e in _RELATIVE]
    elif language == "go":
        if name.split("/")[0] not in _GO_STD:
            out = [f"dir:{join(here, name) if name.startswith('.') else name}"]
    elif language == "rust":
        path = [p for p in (module or "").split("::") if p]
        if path[:1] and path[0] in ("std", "core", "alloc"):
            return []
        own = here if posixpath.basename(file_path) in ("mod.rs", "lib.rs", "main.rs") else posixpath.splitext(file_path)[0]
        root = file_path.split("/src/")[0] + "/src" if "/src/" in file_path else "src" if file_path.startswith("src/") else here
        while path[:1] == ["self"]:
            path.pop(0)
        base = own
        if path[:1] == ["crate"]:
            base, path = root, path[1:]
        while path[:1] == ["super"]:
            base, path = posixpath.dirname(base), path[1:]
        for parts in ([*path, name], path):
            out += [join(base, *parts) + e for e in (".rs", "/mod.rs")] if parts else []
            out += [join(root, *parts) + e for e in (".rs", "/mod.rs")] if parts else []
    else:
        if level:
            base = here
            for _ in range(level - 1):
                base = posixpath.dirname(base)
            stems = [join(base, *(module or "").split("."), name), join(base, *(module or "").split("."))] if module else [join(base, name), base]
        else:
            dotted = (module or name).split(".")
            stems = [join(*dotted, name), join(*dotted)] if module else [join(*dotted)]
            stems += [join("src", s) for s in stems]
        for s in stems:
            out += [f"{s}.py", f"{s}/__init__.py"] if s else ["__init__.py"]
    return list(dict.fromkeys(c for c in out if c != file_path))


def resolve_imports(imports: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """``imports`` with ``target``: the first candidate that is a file of the workspace, or null."""
    ship(imports.sparkSession)

    @F.arrow_udf("array<string>")
    def candidates(language: pa.Array, path: pa.Array, module: pa.Array, name: pa.Array, level: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (language, path, module, name, level)), strict=True)
        return pa.array([import_candidates(g, p, m, n, v or 0) for g, p, m, n, v in rows], pa.list_(pa.string()))

    at = [*keys, "file_path", "imp_ord"]
    tried = imports.select(*at, F.posexplode(candidates("language", "file_path", "module", "name", "level")).alias("rank", "candidate"))
    known = files.select(F.col("file_path").alias("candidate"), F.col("file_path").alias("target")).distinct()
    # Go: a package is the folder whose path ends the import's path; its first file stands for it.
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    homes = files.where(F.col("file_path").endswith(".go")).groupBy(folder.alias("folder")).agg(F.min("file_path").alias("target"))
    homes = homes.withColumn("last", F.element_at(F.split("folder", "/"), -1))
    direct = tried.where(~F.col("candidate").startswith("dir:")).join(known, "candidate").select(*at, "rank", "target")
    package = tried.where(F.col("candidate").startswith("dir:")).withColumn("want", F.substring("candidate", 5, 10_000)).withColumn("last", F.element_at(F.split("want", "/"), -1))
    package = package.join(homes, "last").where((F.col("folder") == F.col("want")) | F.col("want").endswith(F.concat(F.lit("/"), F.col("folder"))) | F.col("folder").endswith(F.concat(F.lit("/"), F.col("want"))))
    package = package.where(folder != F.col("folder")).select(*at, "rank", "target")
    best = direct.unionByName(package).groupBy(*at).agg(F.min_by("target", F.struct("rank", "target")).alias("target"))
    return imports.join(best, at, "left")


def import_edges(resolved: DataFrame, *keys: str) -> DataFrame:
    """``(src, dst)`` files, each pair once, no file to itself."""
    return resolved.where(F.col("target").isNotNull() & (F.col("target") != F.col("file_path"))).select(*keys, F.col("file_path").alias("src"), F.col("target").alias("dst")).distinct()


def _own_attr() -> Column:
    """``Class.attr`` for a call through self, cls or this."""
    owner = F.regexp_extract("caller", r"^(.*)\.[^.]+$", 1)
    return F.when(F.col("callee").rlike(r"^(self|cls|this)\.[^.]+$") & (owner != ""), F.concat_ws(".", owner, F.regexp_extract("callee", r"\.([^.]+)$", 1)))


def caller_index(calls: DataFrame) -> DataFrame:
    """One row for each call and each name it may be looked up by, ``key``; by name only, so it over-reaches."""
    own = _own_attr()
    keys = F.array_distinct(F.array_compact(F.array(F.col("callee"), last_segment(F.col("callee")), own, F.concat_ws("::", F.when(own.isNotNull(), F.col("file_path")), own))))
    return calls.withColumn("key", F.explode(F.filter(keys, lambda k: k != "")))


def callers_of(calls: DataFrame, names: DataFrame) -> DataFrame:
    """Calls whose keys meet ``names(key)``, each (caller, line, callee, arguments) once."""
    hits = caller_index(calls).join(names.select("key").distinct(), "key", "left_semi").drop("key")
    return hits.dropDuplicates(["caller_id", "lineno", "callee", "args_count", "kwargs"])


def importers_of(imports: DataFrame, names: DataFrame) -> DataFrame:
    keys = F.array_distinct(F.array_compact(F.array(F.col("name"), F.when(F.col("module").isNotNull(), F.concat_ws(".", "module", "name")))))
    hits = imports.withColumn("key", F.explode(keys)).join(names.select("key").distinct(), "key", "left_semi").drop("key")
    return hits.dropDuplicates(["file_path", "lineno", "name", "module"])


def subclasses(symbols: DataFrame) -> DataFrame:
    """``(base, symbol_id)`` by the text of a base and by its last segment."""
    rows = symbols.select("symbol_id", F.explode("bases").alias("b"))
    return rows.select("symbol_id", F.explode(F.array_distinct(F.array("b", last_segment(F.col("b"))))).alias("base"))


def name_index(symbols: DataFrame, *keys: str) -> DataFrame:
    """The first symbol, by path and place, of each name and qualified name: ``(key, symbol_id)``."""
    rows = symbols.select(*keys, F.explode(F.array_distinct(F.array("name", "qualname"))).alias("key"), "symbol_id", "file_path", "sym_ord")
    return rows.groupBy(*keys, "key").agg(F.min_by("symbol_id", F.struct("file_path", "sym_ord")).alias("symbol_id"))


def definitions(symbols: DataFrame, *keys: str) -> DataFrame:
    """Every symbol of each name and qualified name, best first: ``(key, place, symbol_id)``; ``place`` 1 is ``name_index``."""
    rows = symbols.select(*keys, F.explode(F.array_distinct(F.array("name", "qualname"))).alias("key"), "symbol_id", "file_path", "sym_ord").distinct()
    place = F.row_number().over(Window.partitionBy(*keys, "key").orderBy("file_path", "sym_ord"))
    return rows.select(*keys, "key", place.alias("place"), "symbol_id")


def symbols_of(symbols: DataFrame, path: str, root: str = "") -> DataFrame:
    """The symbols of one file in order of place; its path may be absolute, dotted or with backward slashes."""
    return symbols.where(F.col("file_path") == normal_path(F.lit(path), root)).orderBy("sym_ord")


def overlay(base: DataFrame, changed: DataFrame) -> DataFrame:
    """Facts with some files replaced; the base is untouched, so there is nothing to roll back."""
    return base.join(changed.select("file_path").distinct(), "file_path", "left_anti").unionByName(changed, allowMissingColumns=True)


def resolve_calls(calls: DataFrame, symbols: DataFrame, resolved_imports: DataFrame, *keys: str) -> DataFrame:
    """``calls`` with ``target_id``: the first candidate, in the order of the callee's own tier, that exists.

    Tiers by the callee's text: an exact id; through self, cls or this; dotted; plain. A tier never falls to
    another. Ids and first-by-name symbols are looked up by two equi-joins over exploded candidates.
    """
    at = [*keys, "file_path", "call_ord"]
    names = resolved_imports.withColumn("alias", F.coalesce("asname", F.element_at(F.split("name", "/"), -1)))
    names = names.groupBy(*keys, "file_path", "alias").agg(F.min_by(F.struct("target", "name"), "imp_ord").alias("i"))
    head = F.regexp_extract("callee", r"^([^.:(\[]+)", 1)
    rows = calls.withColumn("alias", head).join(names, [*keys, "file_path", "alias"], "left")
    text, last, file = F.col("callee"), last_segment(F.col("callee")), F.col("file_path")
    own, up = _own_attr(), F.regexp_extract("caller", r"^(.*)\.[^.]+$", 1)
    rest = F.regexp_replace(text, r"^[^.:(\[]+(\.|::)", "")
    key = lambda by, k: F.struct(F.lit(by).alias("by"), k.alias("key"))
    in_file = lambda f, n: F.concat_ws("::", f, n)
    when = lambda c, x: F.when(c, x)
    brought = F.col("i.target").isNotNull()
    mine = text.rlike(r"^(self|cls|this)\.")
    dotted = text.rlike(r"\.|::")
    through = F.array(when(own.isNotNull(), key("id", in_file(file, own))), when(own.isNotNull(), key("name", own)), key("id", in_file(file, last)), key("name", last))
    far = F.array(when(brought, key("id", in_file(F.col("i.target"), rest))), when(brought, key("id", in_file(F.col("i.target"), F.concat_ws(".", "i.name", F.regexp_replace(rest, "::", "."))))), key("name", F.regexp_replace(text, "::", ".")), key("id", in_file(file, last)), key("name", last))
    plain = F.array(
        key("id", in_file(file, F.concat_ws(".", "caller", text))), when(up != "", key("id", in_file(file, F.concat_ws(".", up, text)))),
        when(last_segment(F.col("caller")) == text, key("id", in_file(file, F.col("caller")))), key("id", in_file(file, text)),
        when(brought, key("id", in_file(F.col("i.target"), F.coalesce(F.when(F.col("i.name") != "default", F.col("i.name")), text)))), when(brought, key("id", in_file(F.col("i.target"), F.lit("default")))), key("name", text),
    )
    tier = F.when(mine, through).when(dotted, F.concat(F.array(key("id", text)), far)).otherwise(plain)
    tried = rows.select(*at, F.posexplode(tier).alias("rank", "c")).where("c is not null").select(*at, "rank", "c.by", "c.key")
    ids = symbols.select(*keys, F.col("symbol_id").alias("key"), F.lit("id").alias("by"), "symbol_id").distinct()
    index = ids.unionByName(name_index(symbols, *keys).withColumn("by", F.lit("name")))
    best = tried.join(index, [*keys, "by", "key"]).groupBy(*at).agg(F.min_by("symbol_id", "rank").alias("target_id"))
    return calls.join(best, at, "left")


def constructors(symbols: DataFrame, *keys: str, names: tuple[str, ...] = ("__init__", "constructor", "new")) -> DataFrame:
    """``(class_id, ctor_id)``: a class's own constructor, else that of the first base, in order, that leads to one.

    Each base is followed to its end before the next counts: of a class's ways up, the smallest list of base
    places wins. A way enters no class twice, so cycles end; a class without any constructor has no row.
    """
    scratch = Scratch(symbols.sparkSession, "ctor")
    classes = symbols.where(F.col("kind").isin("class", "struct"))
    own = symbols.where(F.col("name").isin(*names)).select(*keys, F.regexp_replace("symbol_id", r"\.[^.]+$", "").alias("at"), F.col("symbol_id").alias("ctor_id"), F.array_position(F.array(*map(F.lit, names)), F.col("name")).alias("rank"))
    own = scratch.keep(own.groupBy(*keys, "at").agg(F.min_by("ctor_id", F.struct("rank", "ctor_id")).alias("ctor_id")), "own")
    by_name = name_index(classes, *keys).withColumnRenamed("symbol_id", "base_id")
    up = classes.select(*keys, F.col("symbol_id").alias("at"), F.posexplode("bases").alias("n", "base")).withColumn("key", last_segment(F.col("base"))).join(by_name, [*keys, "key"]).select(*keys, "at", "n", "base_id").distinct()
    up = scratch.keep(up.join(own, [*keys, "at"], "left_anti"), "up")
    ways = classes.select(*keys, F.col("symbol_id").alias("class_id"), F.col("symbol_id").alias("at"), F.array().cast("array<int>").alias("way"), F.array("symbol_id").alias("seen")).distinct()
    ways = scratch.keep(ways, "ways0")
    found, step = ways.join(own, [*keys, "at"]).select(*keys, "class_id", "way", "ctor_id"), 0
    while not ways.isEmpty():
        step += 1
        more = ways.join(up, [*keys, "at"]).where(~F.array_contains("seen", F.col("base_id")))
        more = more.select(*keys, "class_id", F.col("base_id").alias("at"), F.array_append("way", F.col("n")).alias("way"), F.array_append("seen", F.col("base_id")).alias("seen"))
        # Ways of one length to one class go on alike, so the smallest stands for all.
        more = more.groupBy(*keys, "class_id", "at").agg(F.min_by(F.struct("way", "seen"), F.struct("way", "seen")).alias("best")).select(*keys, "class_id", "at", "best.way", "best.seen")
        ways = scratch.keep(more, f"ways{step}")
        found = found.unionByName(ways.join(own, [*keys, "at"]).select(*keys, "class_id", "way", "ctor_id"))
    return found.groupBy(*keys, "class_id").agg(F.min_by("ctor_id", "way").alias("ctor_id"))
