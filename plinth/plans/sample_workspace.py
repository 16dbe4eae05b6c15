"""A small workspace in four languages, for the queries whose input is source code."""

FILES = {
    "shop/__init__.py": "from .cart import total\n",
    "shop/cart.py": '''from .prices import price_of, Unit


def total(items, *, discount=0):
    """Sum of prices."""
    out = 0
    for item in items:
        out += price_of(item, "eur")
    return out - discount


class Basket(Unit):
    def __init__(self, owner, limit=10):
        self.owner = owner
        self.lines = []

    def add(self, item, count=1):
        self.lines.append((item, count))
        return self.check()

    def check(self):
        return total(self.lines)


def old_total(items):
    return helper_sum(items)


def helper_sum(items):
    return sum(items)


def ping(n):
    return pong(n - 1)


def pong(n):
    return ping(n - 1)
''',
    "shop/prices.py": '''class Unit:
    @property
    def label(self):
        return "unit"


def price_of(item, currency):
    return lookup(item)[currency]


def lookup(item):
    handle = open(item)
    return {"eur": 1, "all": handle}
''',
    "shop/report.py": '''import time

from .cart import Basket, total


async def render(db, rows):
    basket = Basket("me")
    for row in rows:
        for cell in row:
            db.query(cell)
    time.sleep(1)
    for row in rows:
        db.query(row)  # any: ignore-perf[PERF002]
    return total(rows), basket.add(1)


def main():
    return render(None, [])
''',
    "web/api.ts": """import { load } from './store';
export class Api {
  constructor(private store: Store, opts = {}) { this.store = store; }
  async fetchAll(ids: string[]): Promise<void> {
    for (const id of ids) { await this.store.query(id); }
    return load(ids, 1);
  }
}
function unusedHelper(a: number) { return a + 1; }
""",
    "web/store.ts": "export function load(ids: string[], depth: number, ...rest: any[]) { return ids; }\n",
    "svc/main.go": """package main

import "shop/svc/util"

func main() { run(2) }

func run(n int) {
\tfor i := 0; i < n; i++ {
\t\tfor j := 0; j < n; j++ {
\t\t\tfor k := 0; k < n; k++ { util.Step(i, j, k) }
\t\t}
\t}
}
""",
    "svc/util/step.go": "package util\n\nfunc Step(parts ...int) int { return len(parts) }\n\nfunc forgotten() int { return 1 }\n",
    "core/src/lib.rs": """mod math;
use crate::math::{add, Total as Sum};
pub struct Counter { n: i32 }
impl Counter {
    pub fn new() -> Self { Counter { n: 0 } }
    pub fn bump(&mut self, by: i32) -> i32 { self.n = add(self.n, by); self.n }
}
""",
    "core/src/math.rs": "pub fn add(a: i32, b: i32) -> i32 { a + b }\npub struct Total { v: i32 }\nfn spare() -> i32 { 1 }\n",
}

_CART, _PRICES = FILES["shop/cart.py"], FILES["shop/prices.py"]

#: (patch_id, file_path, patch, is_replacement)
PATCHES = [
    ("optional-parameter", "shop/prices.py", _PRICES.replace("def price_of(item, currency)", "def price_of(item, currency, day=None)"), True),
    ("required-parameter", "shop/prices.py", _PRICES.replace("def price_of(item, currency)", "def price_of(item, currency, day)"), True),
    ("deleted-function", "shop/prices.py", _PRICES.replace("def price_of(item, currency)", "def price(item, currency)"), True),
    ("import-cycle", "shop/prices.py", "from .cart import total\n" + _PRICES, True),
    ("call-cycle", "shop/prices.py", _PRICES.replace('    handle = open(item)', '    handle = price_of(item, "eur")'), True),
    ("syntax", "shop/prices.py", "def price_of(item:\n", True),
    ("constructor", "shop/cart.py", _CART.replace("def __init__(self, owner, limit=10)", "def __init__(self, owner, limit)"), True),
    ("lost-name", "shop/report.py", "from .cart import nothing_there\n", True),
    ("diff", "shop/prices.py", "--- a/shop/prices.py\n+++ b/shop/prices.py\n@@ -7,2 +7,3 @@\n def price_of(item, currency):\n+    item = str(item)\n     return lookup(item)[currency]\n", False),
    ("typescript", "web/store.ts", "export function load(ids: string[], depth: number, wide: boolean) { return ids; }\n", True),
]

#: Sources with places for every mutator.
SNIPPETS = {
    "m/truth.py": "def f(a, b, c):\n    if not a:\n        return 1\n    elif b == c:\n        return 2\n    if a is None:\n        return 3\n    if b:\n        return 4\n    return c\n",
    "m/more.py": "def g(q, d, items=None):\n    x = q.get(timeout=3)\n    y = d.get(\"k\", 0)\n    with open(\"p\") as h:\n        z = h.read()\n    h.close()\n    return x, y, z, items\n",
    "m/a.ts": "export async function f(a: any, b: any) {\n  if (a === b) { return 1; }\n  if (!a) { return 2; }\n  const c = await b.go();\n  const d = a?.e ?? 3;\n  return d;\n}\n",
    "m/a.go": "package m\n\nfunc f(ch chan int, err error) int {\n\tif err != nil {\n\t\treturn 1\n\t}\n\tv, ok := <-ch\n\tdefer ch.Close()\n\treturn v\n}\n",
    "m/a.rs": "fn f(a: i32, b: i32) -> bool {\n    drop(a);\n    a == b\n}\n",
    "m/test_skipped.py": "def test_f(a):\n    if a:\n        return 1\n",
}


def generated_workspace(files: int, functions: int = 6, calls: int = 30) -> dict[str, str]:
    """A workspace by rule: every function has a name of its own and calls functions of its own and of the next module.

    About ``files * calls`` call sites; the last two functions of a module are called by nothing but each other.
    """
    made = {}
    for n in range(files):
        other = (n + 1) % files
        parts = [f"from .m{other:04} import f{other:04}_0, f{other:04}_1\n\n"]
        each = calls // functions
        for k in range(functions):
            mine = [f"f{other:04}_{c % 2}" if c % 3 == 0 else f"f{n:04}_{(k + c) % (functions - 2)}" for c in range(each)]
            if k == functions - 2:
                mine[0] = f"f{n:04}_{functions - 1}"
            body = "".join(f"    {'x = ' if c else ''}{name}(x)\n" for c, name in enumerate(mine))
            parts.append(f"\ndef f{n:04}_{k}(x, y=None):\n    for row in x:\n        y = row\n{body}    return y\n")
        made[f"pkg/m{n:04}.py"] = "\n".join(parts)
    made["pkg/main.py"] = "from .m0000 import f0000_0\n\n\ndef main():\n    return f0000_0([])\n"
    return made
