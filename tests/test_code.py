"""Extraction, resolution, verification, dead code and lint on small workspaces of this repository."""

import pytest
from pyspark.sql import functions as F

from plinth.operators import dead_code, graph, index, lint, patches, verify
from plinth.operators.gate import check_call
from plinth.plans import code_queries as Q
from plinth.sources import brace_facts, code, python_facts, snapshot


def workspace(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in files.items()], "file_path string, content string")


def names(facts):
    return {s["qualname"]: s for s in facts["symbols"]}


def test_python_symbols():
    found = python_facts.facts("__all__ = ['f']\nclass A(B):\n    def m(self, a, /, b=1, *c, k, **d) -> int:\n        def inner(): return g()\n        return inner()\n    @staticmethod\n    def s(x): pass\nasync def f(): pass\nf()\n")
    got = names(found)
    assert got["A"]["bases"] == ["B"] and not got["A"]["is_exported"] and got["f"]["is_exported"] and got["f"]["kind"] == "async_function"
    m = got["A.m"]
    assert (m["min_args"], m["max_args"], m["accepted_kwargs"], m["required_kwargs"], m["is_method"]) == (2, None, None, ["k"], True)
    assert m["signature"] == "def m(self, a, b = 1, k, *c, **d) -> int"
    assert got["A.s"]["is_static"] and not got["A.s"]["is_method"] and got["A.m.inner"]["visibility"] == "private"
    owners = {c["caller"] for c in found["calls"] if c["callee"] == "g"}
    assert owners == {"A", "A.m", "A.m.inner"} and "<module>" in got


def test_python_syntax_error():
    assert python_facts.facts("def f(:\n")["syntax_error"].startswith("SyntaxError at line 1:")
    assert python_facts.facts("")["syntax_error"] is None


def test_go():
    got = names(brace_facts.facts('package p\nimport u "x/y"\ntype S struct {\n\tBase\n\tn int\n}\nfunc (s *S) Run(a, b int, rest ...string) (int, error) { return u.Go(a, rest...), nil }\nfunc helper() {}\n', "go"))
    assert got["S"]["kind"] == "struct" and got["S"]["bases"] == ["Base"]
    run = got["S.Run"]
    assert [p["name"] for p in run["params"]] == ["s", "a", "b", "rest"] and run["max_args"] is None and run["is_method"]
    assert got["helper"]["visibility"] == "internal" and run["visibility"] == "public"


def test_rust():
    facts = brace_facts.facts("use a::{b, c as d};\npub trait T { fn go(&self); }\nimpl T for S { fn go(&self) { help(1, 'x'); } }\nimpl S { pub fn new() -> S { S } }\npub(crate) fn help(a: i32, c: char) {}\n", "rust")
    got = names(facts)
    assert got["S.go"]["bases"] == ["T"] and got["S.go"]["is_method"] and got["S.new"]["is_static"] and got["help"]["visibility"] == "internal"
    assert [(i["module"], i["name"], i["asname"]) for i in facts["imports"]] == [("a", "b", None), ("a", "c", "d")]


def test_typescript():
    facts = brace_facts.facts("import d, { a as b } from './m';\nexport class C extends D implements I {\n  constructor(x: number, o = {}) { super(); }\n  go = async (e: E) => { await b(e); };\n}\nexport const f = (a: string, b?: number): void => { g(a); };\nfunction g(x) { return `t${x}`; }\nexport default function () { f('(', 1); }\nconst re = /[/(]/;\n", "typescript")
    got = names(facts)
    assert got["C"]["bases"] == ["D", "I"] and got["f"]["min_args"] == 1 and got["f"]["max_args"] == 2 and got["default"]["is_exported"]
    assert [p["name"] for p in got["C.constructor"]["params"]] == ["this", "x", "o"] and not got["g"]["is_exported"]
    assert {(i["module"], i["name"], i["asname"]) for i in facts["imports"]} == {("./m", "default", "d"), ("./m", "a", "b")}
    assert brace_facts.facts("function f( {", "typescript")["syntax_error"]


def test_call_checks():
    row = {"name": "a", "has_default": False, "is_vararg": False, "is_kwarg": False, "is_kwonly": False, "is_posonly": False}
    params = [row | {"name": "self"}, row, row | {"name": "b", "has_default": True}, row | {"name": "k", "is_kwonly": True}]
    call = {"caller_id": "f::g", "lineno": 3, "args_count": 1, "kwargs": ["k"], "has_vararg": False, "has_kwarg": False}
    kinds = lambda **c: [m.split(":")[0] for m in check_call(call | c, "m", params, True)]
    assert kinds() == []
    assert kinds(args_count=3) == ["ARITY_MISMATCH"] and kinds(args_count=0) == ["ARITY_MISMATCH"]
    assert kinds(kwargs=["a", "k"]) == ["DUPLICATE_ARGUMENT"] and kinds(kwargs=["k", "z"]) == ["KEYWORD_MISMATCH"] and kinds(kwargs=[]) == ["KEYWORD_MISMATCH"]
    assert kinds(args_count=0, has_vararg=True) == [] and kinds(args_count=0, kwargs=[], has_kwarg=True) == []


@pytest.mark.parametrize(
    ("language", "path", "module", "name", "level", "want"),
    [
        ("python", "a/b/c.py", "d", "e", 1, "a/b/d/e.py"), ("python", "a/b/c.py", None, "d", 2, "a/d.py"), ("python", "x.py", "a.b", "c", 0, "a/b.py"),
        ("typescript", "a/b.ts", "../c", "x", 0, "c/index.ts"), ("typescript", "a/b.ts", "./c.js", "x", 0, "a/c.ts"), ("rust", "core/src/lib.rs", "crate::m", "f", 0, "core/src/m.rs"), ("rust", "src/a/b.rs", "super::c", "f", 0, "src/a/c.rs"),
    ],
)
def test_import_candidates(language, path, module, name, level, want):
    assert want in index.import_candidates(language, path, module, name, level)


def test_no_candidates_for_standard_libraries():
    assert index.import_candidates("go", "a/b.go", None, "net/http", 0) == [] and index.import_candidates("rust", "src/a.rs", "std::io", "Read", 0) == []


def test_resolution(spark):
    got = {(r.caller_id, r.callee): r.target_id for r in Q.b8(spark, "").collect()}
    assert got["shop/cart.py::total", "price_of"] == "shop/prices.py::price_of" and got["shop/cart.py::Basket.add", "self.check"] == "shop/cart.py::Basket.check"
    assert got["web/api.ts::Api.fetchAll", "load"] == "web/store.ts::load" and got["svc/main.go::run", "util.Step"] == "svc/util/step.go::Step" and got["core/src/lib.rs::Counter.bump", "add"] == "core/src/math.rs::add"
    assert got["shop/report.py::render", "db.query"] is None


def test_constructors_through_bases_and_cycles(spark):
    files = workspace(spark, a="class A:\n    def __init__(self, x): pass\nclass B(A): pass\nclass C(B): pass\nclass P(Q): pass\nclass Q(P): pass\n")
    assert {(r.class_id, r.ctor_id) for r in index.constructors(code.symbols(code.extract(files))).collect()} == {("a::A", "a::A.__init__"), ("a::B", "a::A.__init__"), ("a::C", "a::A.__init__")}


def test_constructors_try_every_base_in_order(spark):
    deep = "".join(f"class D{i}(D{i - 1}): pass\n" for i in range(1, 21))
    files = workspace(spark, a="class A: pass\nclass B:\n    def __init__(self, x): pass\nclass X:\n    def __init__(self): pass\nclass AX(X): pass\nclass C(A, B): pass\nclass E(AX, B): pass\nclass F(A): pass\nclass D0(B): pass\nclass P(Q, X): pass\nclass Q(P): pass\n" + deep)
    got = {r.class_id[3:]: r.ctor_id[3:] for r in index.constructors(code.symbols(code.extract(files))).collect()}
    want = {"B": "B.__init__", "X": "X.__init__", "AX": "X.__init__", "C": "B.__init__", "E": "X.__init__", "P": "X.__init__", "Q": "X.__init__"}
    assert got == want | {f"D{i}": "B.__init__" for i in range(21)}


def test_patches():
    old = "a\nb\nc\nd\n"
    diff = "--- x\n+++ x\n@@ -2,2 +2,3 @@\n-b\n+B\n+B2\n c\n"
    assert patches.apply(old, diff) == ("a\nB\nB2\nc\nd\n", {2}, {2, 3})
    assert patches.apply(old, "a\nb\nX\nd\n", True) == ("a\nb\nX\nd\n", {3}, {3})
    assert patches.apply("", "n\n") == ("n\n", set(), {1})
    assert [h["new_start"] for h in patches.hunks(diff + "@@ -9 +10 @@\n-q\n+r\n")] == [2, 10]


def test_verify(spark):
    got = {r.patch_id: r for r in verify.verify(Q.files(spark), Q.changes(spark)).collect()}
    said = {k: " ".join(r.violations) for k, r in got.items()}
    assert {k for k, r in got.items() if r.status == "APPROVED"} == {"optional-parameter", "diff"}
    assert "required 'day'" in said["required-parameter"] and "BROKEN_REFERENCE" in said["deleted-function"] and "import cycle" in said["import-cycle"]
    assert "call cycle" in said["call-cycle"] and "SyntaxError" in said["syntax"] and "Basket.__init__" in said["constructor"] and "BROKEN_IMPORT" in said["lost-name"] and "ARITY" in said["typescript"]
    assert got["syntax"].risk_score == 1.0 and got["diff"].risk_score == 0.05 and all(verify.count_tokens(r.input_dsl) <= 400 for r in got.values())
    assert "N0: shop/prices.py::price_of" in got["diff"].input_dsl and got["required-parameter"].active_categories[0] == "BreakingPublicAPI"


def test_verify_calls_of_classes(spark):
    files = workspace(spark, **{
        "base.py": "class Base:\n    def __init__(self, x, *, unit='m'): pass\n", "lib.py": "from base import Base\n\nclass Plain:\n    pass\n\nclass Child(Plain, Base):\n    pass\n",
        "use.py": "from lib import Child, Plain\n\ndef make():\n    return 1\n", "box.ts": "export class Box {\n  constructor(size: number) {}\n}\n", "ship.ts": "import { Box } from './box';\nexport function pack() {\n  return 1;\n}\n",
    })
    use, ship = "from lib import Child, Plain\n\ndef make():\n    return {}\n", "import {{ Box }} from './box';\nexport function pack() {{\n  return {};\n}}\n"
    calls = {"right": "Child(1, unit='k')", "bare": "Plain()", "open": "Child(*rest)", "missing": "Child()", "extra": "Child(1, 2)", "unknown": "Child(1, size=2)", "plain": "Plain(1)", "plain-name": "Plain(x=1)"}
    rows = [(k, "use.py", use.format(v), False) for k, v in calls.items()] + [("ts", "ship.ts", ship.format("new Box(1)"), False), ("ts-extra", "ship.ts", ship.format("new Box(1, 2)"), False)]
    # The patch's own constructor counts, not the one it replaces.
    rows += [("both", "use.py", use.format("Child(1, 2)"), False), ("both", "base.py", "class Base:\n    def __init__(self, x, y): pass\n", False)]
    changes = spark.createDataFrame(rows, Q.changes(spark).schema)
    got = {r.patch_id: r for r in verify.verify(files, changes).collect()}
    assert {k for k, r in got.items() if r.status == "APPROVED"} == {"right", "bare", "open", "ts", "both"}
    said = {k: " ".join(r.violations) for k, r in got.items()}
    assert "Base.__init__': required 'x'" in said["missing"] and "2 positional arguments, at most 1" in said["extra"] and "unexpected keyword 'size'" in said["unknown"]
    assert "'Plain': 1 positional arguments, at most 0" in said["plain"] and "unexpected keyword 'x'" in said["plain-name"] and "ARITY" in said["ts-extra"]


def test_linearise_keeps_its_budget():
    node = {"node": "f::n", "name": "n" * 5, "signature": "def n(a, b, c)", "truncated": False}
    row = {"file_path": "f", "affected": ["n0"], "added": [], "deleted": [], "old_lines": [], "new_lines": list(range(1, 9)), "status": "REJECTED", "confidence": 0.95, "cycles": [], "violations": ["x y z"] * 5, "edges": []}
    text = verify.linearise(row | {"nodes": [node | {"node": f"f::n{i}", "seed": i < 2, "place": i} for i in range(80)]})
    assert verify.count_tokens(text) <= 400 and "(2 more)" in text and "[1..8] (8 lines)" in text and "pruned" in text


def test_dead_code(spark):
    files = workspace(spark, **{"m.py": "def main():\n    live()\ndef live(): pass\ndef a(): b()\ndef b(): c()\ndef c(): pass\ndef x(): y()\ndef y(): x()\ndef selfish(): selfish()\nclass K:\n    @property\n    def p(self): return 1\n    def __len__(self): return 0\nmain()\nK()\n", "tests/t.py": "def helper(): pass\n", "api.py": "@app.get('/x')\ndef route(): pass\n"})
    got, far = ({r.symbol_id: (r.dead_kind, r.cluster_root) for r in dead_code.dead_symbols(code.extract(files), files, one_task=limit).collect()} for limit in (1 << 20, -1))
    assert got == far
    assert got == {"m.py::a": ("orphan", None), "m.py::b": ("transitive", "m.py::a"), "m.py::c": ("transitive", "m.py::a"), "m.py::x": ("transitive", "m.py::x"), "m.py::y": ("transitive", "m.py::x"), "m.py::selfish": ("orphan", None)}


def test_lint(spark):
    text = "import time\nasync def f(db, rows):\n    for a in rows:\n        for b in rows:\n            for c in rows:\n                db.query(c)\n    time.sleep(1)\n    h = open('x')\n    with open('y') as g: pass\n    return open('z')\nasync def g2(rows):\n    for a in rows:  # any: ignore-perf\n        db.query(a)\n    # any: ignore-perf[PERF004]\n    time.sleep(2)\n    await sleep(1)\n"
    files = workspace(spark, m=text)
    got = [(r.rule_id, r.lineno, r.severity) for r in lint.diagnostics(code.extract(files), files).orderBy("lineno", "col").collect()]
    assert got == [("PERF001", 4, "warn"), ("PERF001", 5, "error"), ("PERF002", 6, "warn"), ("PERF004", 7, "error"), ("PERF003", 8, "error"), ("PERF004", 8, "error"), ("PERF004", 9, "error"), ("PERF004", 10, "error")]
    assert lint.diagnostics(code.extract(files), files, "error").where("severity = 'warn'").count() == 0


def test_tarjan():
    assert graph.tarjan({"a": ["b"], "b": ["c"], "c": []}) == []
    assert [sorted(c) for c in graph.tarjan({"b": ["a"], "a": ["b"], "c": ["a"], "d": ["d"]})] == [["a", "b"]]
    assert graph.tarjan({"d": ["d"]}, include_self_loops=True) == [["d"]]
    chain = {str(i): [str(i + 1)] for i in range(5000)} | {"5000": ["0"]}
    assert len(graph.tarjan(chain)[0]) == 5001


def test_fanout_and_node_caps(spark):
    edges = spark.createDataFrame([("hub", f"n{i:02}", "CALLS", i) for i in range(30)], "src string, dst string, relation string, ord int")
    nodes, inside = graph.neighbourhood(edges, spark.createDataFrame([("p", "hub")], "patch_id string, node string"))
    assert inside.count() == 20 and nodes.where("truncated").count() == 1
    many = spark.createDataFrame([("p", f"s{i:02}") for i in range(70)], "patch_id string, node string")
    assert graph.neighbourhood(edges, many)[0].count() == 50


def test_overlay_and_scan(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/a.py").write_text("def a(): pass\n")
    (tmp_path / "node_modules/b.js").write_text("function b() {}\n")
    (tmp_path / "c.txt").write_text("no")
    files = code.scan(spark, str(tmp_path))
    assert [r.file_path for r in files.collect()] == ["pkg/a.py"]
    base = code.extract(files)
    after = index.overlay(base, code.extract(workspace(spark, **{"pkg/a.py": "def z(): pass\n"})))
    assert [r.name for r in code.symbols(after).collect()] == ["z"] and [r.name for r in code.symbols(base).collect()] == ["a"]


def test_snapshot(spark, tmp_path):
    src, root = tmp_path / "src", f"file://{tmp_path}/index"
    src.mkdir()
    (src / "a.py").write_text("def a(): pass\n")
    (src / "b.py").write_text("def b(): pass\n")
    first = snapshot.refresh(spark, code.scan(spark, str(src)), root)
    assert first == {"scanned": 2, "reindexed": 2, "symbols_indexed": 2}
    assert snapshot.refresh(spark, code.scan(spark, str(src)), root)["reindexed"] == 0
    (src / "a.py").write_text("def a(): pass\ndef a2(): pass\n")
    (src / "b.py").unlink()
    assert snapshot.refresh(spark, code.scan(spark, str(src)), root) == {"scanned": 1, "reindexed": 1, "symbols_indexed": 2}
    (tmp_path / "index/CURRENT.txt").write_text("nowhere")
    assert snapshot.refresh(spark, code.scan(spark, str(src)), root)["reindexed"] == 1


def test_callers_need_no_resolution(spark):
    files = workspace(spark, m="class A:\n    def go(self): self.stop()\n    def stop(self): pass\ndef f(x): x.stop()\n")
    wanted = spark.createDataFrame([("stop",)], "key string")
    assert {r.caller_id for r in index.callers_of(code.calls(code.extract(files)), wanted).collect()} == {"m::A", "m::A.go", "m::f"}
    assert index.caller_index(code.calls(code.extract(files))).where(F.col("key") == "A.stop").count() == 1


def _changes(spark, rows):
    return spark.createDataFrame(rows, Q.changes(spark).schema)


def test_import_cycles_list_every_member(spark):
    files = workspace(spark, **{"a.py": "from b import f\n", "b.py": "from c import f\n", "c.py": "def f(): pass\n", "d.py": "import a\n"})
    rows = [("close", "c.py", "import a\ndef f(): pass\n", True), ("open", "c.py", "import d2\ndef f(): pass\n", True), ("through", "c.py", "import d\ndef f(): pass\n", True)]
    got = {r.patch_id: r for r in verify.verify(files, _changes(spark, rows)).collect()}
    ring = [sorted(c) for c in got["close"].cycles]
    assert ring == [["a.py", "b.py", "c.py"]] and got["close"].cycles[0][0] == "a.py" and got["open"].cycles == []
    assert [sorted(c) for c in got["through"].cycles] == [["a.py", "b.py", "c.py", "d.py"]]
    assert any("import cycle: a.py -> b.py -> c.py -> a.py" in v for v in got["close"].violations)


def test_call_cycles_reach_as_far_as_the_slice(spark):
    chain = "def a(): pass\n" + "".join(f"def {x}(): {y}()\n" for x, y in zip("bcdef", "abcde", strict=True))
    files, rows = workspace(spark, **{"m.py": chain, "n.py": "from m import f\ndef top(): f()\n"}), [("p", "n.py", "from m import f\ndef top(): f()\ndef own(): own2()\ndef own2(): own()\n", True)]
    got = verify.verify(files, _changes(spark, rows)).collect()[0]
    assert [sorted(c) for c in got.cycles] == [["n.py::own", "n.py::own2"]]
    far = workspace(spark, **{"a.py": "from b import g\ndef f(): g()\n", "b.py": "from c import h\ndef g(): h()\n", "c.py": "from d import k\ndef h(): k()\n", "d.py": "def k(): pass\n"})
    rows = [("p", "d.py", "from a import f\ndef k(): f()\n", True)]
    near, wide = (verify.verify(far, _changes(spark, rows), hops=n).collect()[0].cycles for n in (0, 3))
    assert not [c for c in near if "::" in c[0]] and [sorted(c) for c in wide if "::" in c[0]] == [["a.py::f", "b.py::g", "c.py::h", "d.py::k"]]


def test_overlays_stand_for_the_workspace(spark):
    files = workspace(spark, **{"lib.py": "def f(x): pass\n", "use.py": "from lib import f\ndef g(): f(1)\n"})
    patch = _changes(spark, [("p", "use.py", "from lib import f\ndef g(): f(1, 2)\n", True)])
    assert verify.verify(files, patch).first().status == "REJECTED"
    staged = workspace(spark, **{"lib.py": "def f(x, y): pass\n"})
    assert verify.verify(files, patch, overlays=staged).first().status == "APPROVED"


def test_settings_by_precedence(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text('{"default_decision_threshold": 0.3, "calibrated_temperature": 2}')
    assert verify.settings(config=str(path)) == (0.3, 2.0) and verify.settings() == (0.5, 1.0)
    monkeypatch.setenv("PLINTH_RISK_THRESHOLD", "0.7")
    monkeypatch.setenv("PLINTH_TEMPERATURE", "warm")
    assert verify.settings(config=str(path)) == (0.7, 1.0) and verify.settings(0.2, 3, str(path)) == (0.2, 3.0)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_graph_walks_agree(spark, limit):
    """One task and distributed rounds give the same reach, components and clusters."""
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "d"), ("e", graph.NAME + "n k"), (graph.NAME + "n k", "f"), (graph.NAME + "n k", "e"), ("g", graph.NAME + "n h"), (graph.NAME + "n h", "g"), ("x", "y"), ("y", "x"), ("z", "y"), ("l", "a")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    dead = spark.createDataFrame([(n,) for n in "abcdefgxyz"], "node string")
    got = {r.node: (r.kind, r.root) for r in graph.dead_clusters(edges, dead, limit).collect()}
    assert got == {"a": ("orphan", None), "b": ("transitive", "a"), "c": ("transitive", "a"), "d": ("orphan", None), "e": ("orphan", None), "f": ("transitive", "e"), "g": ("orphan", None), "x": ("transitive", "z"), "y": ("transitive", "z"), "z": ("orphan", None)}
    reach = {r.node: r.depth for r in graph.reachable(edges, spark.createDataFrame([("l",), ("none",), (None,)], "node string"), one_task=limit).collect()}
    assert reach == {"l": 0, "none": 0, "a": 1, "b": 2, "c": 3}
    assert {r.node for r in graph.reachable(edges, spark.createDataFrame([("l",)], "node string"), 1, limit).collect()} == {"l", "a"}
    parts = {r.node: r.component for r in graph.strong_components(edges.where("src not like '\\0%' and dst not like '\\0%'"), limit).collect()}
    assert parts["b"] == parts["c"] == "b" and parts["x"] == parts["y"] == "x" and parts["a"] == "a" and parts["z"] == "z"


def test_generated_workspace(spark):
    from plinth.plans.sample_workspace import generated_workspace

    files = spark.createDataFrame(sorted(generated_workspace(6).items()), "file_path string, content string")
    facts = code.extract(files)
    dead = {r.symbol_id: r.cluster_root for r in dead_code.dead_symbols(facts, files).collect()}
    assert {k.split("_")[-1] for k in dead} <= {"4", "5", "2", "3"} and facts.where("syntax_error is not null").count() == 0


def test_patch_lint_and_reports(spark):
    from plinth.operators import reports

    found = Q.patch_findings(spark, "").orderBy("patch_id")
    assert reports.table(found).splitlines()[0].split() == ["patch_id", "file_path", "lineno", "rule_id", "severity"]
    assert reports.markdown(found).splitlines()[2] == "| deep | a.py | 3 | PERF001 | warn |" and '"patch_id": "io"' in reports.as_json(found)
    assert "2 findings" in lint.report_text(lint.diagnostics(code.extract(workspace(spark, **{"a.py": "def f(r):\n    for a in r:\n        for b in a:\n            q.query(b)\n"})), workspace(spark, **{"a.py": "def f(r):\n    for a in r:\n        for b in a:\n            q.query(b)\n"})))


def test_body_places():
    from plinth.operators.mining import _hunk, _inserted, _opened_body, _with_parameter

    assert _opened_body(["def f(a,", "      b={1: 2}):  # x", "    pass"], 1, 3, "python") == (2, 16)
    assert _opened_body(["def f(): pass"], 1, 1, "python") is None and _opened_body(["fn f() { 1 }"], 1, 1, "rust") == (1, 8)
    assert _with_parameter("    def f(self, a):", "f", "z") == "    def f(self, z, a):" and _with_parameter("def f():", "f", "z") == "def f(z):" and _with_parameter("fn f(&mut self) {", "f", "z: i32") == "fn f(&mut self, z: i32) {"
    text = "def f():\n    return 1\n"
    for diff, want in ((_inserted(text.split("\n"), (1, 8), "x = 1", "python"), "def f():\n    x = 1\n    return 1\n"), (_hunk(0, [], ["import a"]), "import a\n" + text), (_hunk(1, ["def f():", "    return 1"], []), "")):
        assert patches.apply(text, diff)[0].strip() == want.strip()


def test_import_rings_both_ways(spark):
    from plinth.operators.gate import import_rings
    from plinth.session import Scratch

    stays = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "a")], "src string, dst string")
    fresh = spark.createDataFrame([("p", "c", "a"), ("q", "b", "x"), ("r", "d", "e")], "patch_id string, src string, dst string")
    touched = spark.createDataFrame([("p", "c"), ("q", "b"), ("r", "d"), ("s", "a")], "patch_id string, touched string")
    one, many = ({(r.patch_id, tuple(sorted(r.cycle))) for r in import_rings(stays, fresh, touched, Scratch(spark, "rings"), limit).collect()} for limit in (1 << 20, 0))
    assert one == many == {("p", ("a", "b", "c")), ("q", ("a", "b", "x"))}
