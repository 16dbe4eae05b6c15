"""Code as tables: a workspace scan, one extraction pass, and the views over it.

``extract`` reads each file once and gives one row with nested facts; symbols, calls, imports, diagnostics and
assigned names are explodes of it. Order is by path, then by place in the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import EXTENSIONS, language_of
from ..session import ship
from . import brace_facts, python_facts

#: Folders that hold no sources of one's own.
SKIPPED = ("node_modules", "__pycache__", "venv", "env", "dist", "build", "target", "vendor", "site-packages")

_PARAM = pa.struct([("name", pa.string()), ("annotation", pa.string()), ("default", pa.string()), *[(n, pa.bool_()) for n in ("has_default", "is_vararg", "is_kwarg", "is_kwonly", "is_posonly")]])
_TEXTS = pa.list_(pa.string())
_SYMBOL = pa.struct([
    ("name", pa.string()), ("qualname", pa.string()), ("kind", pa.string()), ("lineno", pa.int32()), ("end_lineno", pa.int32()), ("signature", pa.string()), ("params", pa.list_(_PARAM)),
    ("min_args", pa.int32()), ("max_args", pa.int32()), ("accepted_kwargs", _TEXTS), ("required_kwargs", _TEXTS), ("return_type", pa.string()), ("is_method", pa.bool_()), ("is_static", pa.bool_()),
    ("bases", _TEXTS), ("docstring", pa.string()), ("is_exported", pa.bool_()), ("visibility", pa.string()), ("decorators", _TEXTS),
])
_CALL = pa.struct([("caller", pa.string()), ("callee", pa.string()), ("args_count", pa.int32()), ("kwargs", _TEXTS), ("lineno", pa.int32()), ("has_vararg", pa.bool_()), ("has_kwarg", pa.bool_())])
_IMPORT = pa.struct([("module", pa.string()), ("name", pa.string()), ("asname", pa.string()), ("lineno", pa.int32()), ("level", pa.int32())])
_LINT = pa.struct([("rule_id", pa.string()), ("severity", pa.string()), ("lineno", pa.int32()), ("col", pa.int32()), ("message", pa.string()), ("loop_lines", pa.list_(pa.int32()))])
FACTS = pa.schema([("symbols", pa.list_(_SYMBOL)), ("calls", pa.list_(_CALL)), ("imports", pa.list_(_IMPORT)), ("assigned", _TEXTS), ("syntax_error", pa.string()), ("lint", pa.list_(_LINT))])

_PARAM_SQL = "array<struct<name:string,annotation:string,default:string,has_default:boolean,is_vararg:boolean,is_kwarg:boolean,is_kwonly:boolean,is_posonly:boolean>>"
FACTS_SQL = (
    f"symbols array<struct<name:string,qualname:string,kind:string,lineno:int,end_lineno:int,signature:string,params:{_PARAM_SQL},min_args:int,max_args:int,accepted_kwargs:array<string>,"
    "required_kwargs:array<string>,return_type:string,is_method:boolean,is_static:boolean,bases:array<string>,docstring:string,is_exported:boolean,visibility:string,decorators:array<string>>>, "
    "calls array<struct<caller:string,callee:string,args_count:int,kwargs:array<string>,lineno:int,has_vararg:boolean,has_kwarg:boolean>>, "
    "imports array<struct<module:string,name:string,asname:string,lineno:int,level:int>>, assigned array<string>, syntax_error string, "
    "lint array<struct<rule_id:string,severity:string,lineno:int,col:int,message:string,loop_lines:array<int>>>"
)


def facts_of(source: str | None, language: str) -> python_facts.Row:
    """Facts of one file; a language without an extractor is read as Python, blank brace files are valid."""
    text = source or ""
    if language in ("typescript", "go", "rust"):
        return brace_facts.facts(text, language)
    return python_facts.facts(text)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(file_path, content, mtime, sha)`` of the sources under a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + base.replace(".", r"\.") + "/", "")
    rows = files.select(path.alias("file_path"), F.col("modificationTime").alias("mtime"), "content")
    folders = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    rows = rows.where(F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).isin(*EXTENSIONS) & ~hidden)
    return rows.select("file_path", F.decode("content", "utf-8").alias("content"), "mtime", F.sha2("content", 256).alias("sha"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [facts_of(s, g) for s, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        columns = [pa.array([m[f.name] for m in made], f.type) for f in FACTS]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["file_path", "language", *FACTS.names])


def extract(files: DataFrame) -> DataFrame:
    """One row for each of ``files(file_path, content)`` with its nested facts."""
    ship(files.sparkSession)
    rows = files.select("file_path", "content", language_of(F.col("file_path")).alias("language"))
    return rows.mapInArrow(_rows, f"file_path string, language string, {FACTS_SQL}")


def symbol_id(path: str = "file_path", name: str = "qualname") -> Column:
    return F.concat_ws("::", path, name)


def symbols(facts: DataFrame, *keys: str) -> DataFrame:
    rows = facts.select(*keys, "file_path", "language", F.posexplode("symbols").alias("sym_ord", "s")).select(*keys, "file_path", "language", "sym_ord", "s.*")
    return rows.withColumn("symbol_id", symbol_id())


def calls(facts: DataFrame, *keys: str) -> DataFrame:
    rows = facts.select(*keys, "file_path", "language", F.posexplode("calls").alias("call_ord", "c")).select(*keys, "file_path", "language", "call_ord", "c.*")
    return rows.withColumn("caller_id", symbol_id("file_path", "caller"))


def imports(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.select(*keys, "file_path", "language", F.posexplode("imports").alias("imp_ord", "i")).select(*keys, "file_path", "language", "imp_ord", "i.*")
