"""What the sample workspace holds, written out by hand: the facts that the SQL twins start from.

``WITH`` clauses in DuckDB's dialect. Extraction is held against these rows themselves; everything that is
worked out of facts (resolution, constructors, reach, clusters, totals) is worked out again in SQL.
"""

#: file, place in it, qualified name, kind, first and last line, signature, least and most arguments, visibility, method, bases, decorators, exported, documentation
SYMBOLS = """symbols(file, ord, qual, kind, lineno, end_lineno, signature, min_args, max_args, visibility, is_method, bases, decorators, doc) AS (VALUES
  ('core/src/lib.rs', 0, 'Counter', 'struct', 3, 3, 'pub struct Counter { n: i32 }', 0, NULL, 'public', false, [], [], NULL),
  ('core/src/lib.rs', 1, 'Counter.new', 'method', 5, 5, 'pub fn new() -> Self', 0, 0, 'public', false, [], [], NULL),
  ('core/src/lib.rs', 2, 'Counter.bump', 'method', 6, 6, 'pub fn bump(&mut self, by: i32) -> i32', 2, 2, 'public', true, [], [], NULL),
  ('core/src/math.rs', 0, 'add', 'function', 1, 1, 'pub fn add(a: i32, b: i32) -> i32', 2, 2, 'public', false, [], [], NULL),
  ('core/src/math.rs', 1, 'Total', 'struct', 2, 2, 'pub struct Total { v: i32 }', 0, NULL, 'public', false, [], [], NULL),
  ('core/src/math.rs', 2, 'spare', 'function', 3, 3, 'fn spare() -> i32', 0, 0, 'private', false, [], [], NULL),
  ('shop/cart.py', 0, 'total', 'function', 4, 9, 'def total(items, discount = 0)', 1, 1, 'public', false, [], [], 'Sum of prices.'),
  ('shop/cart.py', 1, 'Basket', 'class', 12, 22, 'class Basket(Unit)', 0, NULL, 'public', false, ['Unit'], [], NULL),
  ('shop/cart.py', 2, 'Basket.__init__', 'method', 13, 15, 'def __init__(self, owner, limit = 10)', 2, 3, 'internal', true, [], [], NULL),
  ('shop/cart.py', 3, 'Basket.add', 'method', 17, 19, 'def add(self, item, count = 1)', 2, 3, 'public', true, [], [], NULL),
  ('shop/cart.py', 4, 'Basket.check', 'method', 21, 22, 'def check(self)', 1, 1, 'public', true, [], [], NULL),
  ('shop/cart.py', 5, 'old_total', 'function', 25, 26, 'def old_total(items)', 1, 1, 'public', false, [], [], NULL),
  ('shop/cart.py', 6, 'helper_sum', 'function', 29, 30, 'def helper_sum(items)', 1, 1, 'public', false, [], [], NULL),
  ('shop/cart.py', 7, 'ping', 'function', 33, 34, 'def ping(n)', 1, 1, 'public', false, [], [], NULL),
  ('shop/cart.py', 8, 'pong', 'function', 37, 38, 'def pong(n)', 1, 1, 'public', false, [], [], NULL),
  ('shop/prices.py', 0, 'Unit', 'class', 1, 4, 'class Unit', 0, NULL, 'public', false, [], [], NULL),
  ('shop/prices.py', 1, 'Unit.label', 'method', 3, 4, 'def label(self)', 1, 1, 'public', true, [], ['@property'], NULL),
  ('shop/prices.py', 2, 'price_of', 'function', 7, 8, 'def price_of(item, currency)', 2, 2, 'public', false, [], [], NULL),
  ('shop/prices.py', 3, 'lookup', 'function', 11, 13, 'def lookup(item)', 1, 1, 'public', false, [], [], NULL),
  ('shop/report.py', 0, 'render', 'async_function', 6, 14, 'async def render(db, rows)', 2, 2, 'public', false, [], [], NULL),
  ('shop/report.py', 1, 'main', 'function', 17, 18, 'def main()', 0, 0, 'public', false, [], [], NULL),
  ('svc/main.go', 0, 'main', 'function', 5, 5, 'func main()', 0, 0, 'internal', false, [], [], NULL),
  ('svc/main.go', 1, 'run', 'function', 7, 13, 'func run(n int)', 1, 1, 'internal', false, [], [], NULL),
  ('svc/util/step.go', 0, 'Step', 'function', 3, 3, 'func Step(parts ...int) int', 0, NULL, 'public', false, [], [], NULL),
  ('svc/util/step.go', 1, 'forgotten', 'function', 5, 5, 'func forgotten() int', 0, 0, 'internal', false, [], [], NULL),
  ('web/api.ts', 0, 'Api', 'class', 2, 8, 'export class Api', 0, NULL, 'public', false, [], [], NULL),
  ('web/api.ts', 1, 'Api.constructor', 'method', 3, 3, 'constructor(private store: Store, opts = {})', 2, 3, 'public', true, [], [], NULL),
  ('web/api.ts', 2, 'Api.fetchAll', 'method', 4, 7, 'async fetchAll(ids: string[]): Promise<void>', 2, 2, 'public', true, [], [], NULL),
  ('web/api.ts', 3, 'unusedHelper', 'function', 9, 9, 'function unusedHelper(a: number)', 1, 1, 'internal', false, [], [], NULL),
  ('web/store.ts', 0, 'load', 'function', 1, 1, 'export function load(ids: string[], depth: number, ...rest: any[])', 2, NULL, 'public', false, [], [], NULL)),
named AS (SELECT *, file || '::' || qual AS id, string_split(qual, '.')[-1] AS name FROM symbols)"""

#: file, place, caller, callee's text, arguments, line
CALLS = """calls(file, ord, caller, callee, args_count, lineno) AS (VALUES
  ('core/src/lib.rs', 0, 'Counter.bump', 'add', 2, 6),
  ('shop/cart.py', 0, 'total', 'price_of', 2, 8), ('shop/cart.py', 1, 'Basket', 'self.lines.append', 1, 18), ('shop/cart.py', 2, 'Basket', 'self.check', 0, 19),
  ('shop/cart.py', 3, 'Basket', 'total', 1, 22), ('shop/cart.py', 4, 'Basket.add', 'self.lines.append', 1, 18), ('shop/cart.py', 5, 'Basket.add', 'self.check', 0, 19),
  ('shop/cart.py', 6, 'Basket.check', 'total', 1, 22), ('shop/cart.py', 7, 'old_total', 'helper_sum', 1, 26), ('shop/cart.py', 8, 'helper_sum', 'sum', 1, 30),
  ('shop/cart.py', 9, 'ping', 'pong', 1, 34), ('shop/cart.py', 10, 'pong', 'ping', 1, 38),
  ('shop/prices.py', 0, 'price_of', 'lookup', 1, 8), ('shop/prices.py', 1, 'lookup', 'open', 1, 12),
  ('shop/report.py', 0, 'render', 'Basket', 1, 7), ('shop/report.py', 1, 'render', 'time.sleep', 1, 11), ('shop/report.py', 2, 'render', 'db.query', 1, 13),
  ('shop/report.py', 3, 'render', 'total', 1, 14), ('shop/report.py', 4, 'render', 'basket.add', 1, 14), ('shop/report.py', 5, 'render', 'db.query', 1, 10), ('shop/report.py', 6, 'main', 'render', 2, 18),
  ('svc/main.go', 0, 'main', 'run', 1, 5), ('svc/main.go', 1, 'run', 'util.Step', 3, 10), ('svc/util/step.go', 0, 'Step', 'len', 1, 3),
  ('web/api.ts', 0, 'Api', 'this.store.query', 1, 5), ('web/api.ts', 1, 'Api.fetchAll', 'this.store.query', 1, 5), ('web/api.ts', 2, 'Api', 'load', 2, 6), ('web/api.ts', 3, 'Api.fetchAll', 'load', 2, 6)),
called AS (SELECT *, file || '::' || caller AS caller_id, string_split(string_split(callee, '.')[-1], '::')[-1] AS last, regexp_extract(caller, '^(.*)\\.[^.]+$', 1) AS up FROM calls)"""

#: file, place, module, name, alias, level; and the files there are
IMPORTS = """imports(file, ord, module, name, asname, level) AS (VALUES
  ('core/src/lib.rs', 0, NULL, 'math', NULL, 0), ('core/src/lib.rs', 1, 'crate::math', 'add', NULL, 0), ('core/src/lib.rs', 2, 'crate::math', 'Total', 'Sum', 0),
  ('shop/__init__.py', 0, 'cart', 'total', NULL, 1), ('shop/cart.py', 0, 'prices', 'price_of', NULL, 1), ('shop/cart.py', 1, 'prices', 'Unit', NULL, 1),
  ('shop/report.py', 0, NULL, 'time', NULL, 0), ('shop/report.py', 1, 'cart', 'Basket', NULL, 1), ('shop/report.py', 2, 'cart', 'total', NULL, 1),
  ('svc/main.go', 0, NULL, 'shop/svc/util', NULL, 0), ('web/api.ts', 0, './store', 'load', NULL, 0)),
files(file) AS (VALUES ('shop/__init__.py'), ('shop/cart.py'), ('shop/prices.py'), ('shop/report.py'), ('web/api.ts'), ('web/store.ts'), ('svc/main.go'), ('svc/util/step.go'), ('core/src/lib.rs'), ('core/src/math.rs')),
placed AS (SELECT *, regexp_replace(file, '/?[^/]*$', '') AS dir FROM imports),
tried AS (SELECT *, CASE
    WHEN file LIKE '%.py' AND level > 0 THEN [dir || '/' || module || '/' || name || '.py', dir || '/' || module || '.py']
    WHEN file LIKE '%.py' THEN [name || '.py', 'src/' || name || '.py']
    WHEN file LIKE '%.ts' THEN [dir || '/' || replace(module, './', '') || '.ts']
    WHEN file LIKE '%.rs' AND module IS NULL THEN [dir || '/' || name || '.rs']
    WHEN file LIKE '%.rs' THEN [dir || '/' || replace(replace(module, 'crate::', ''), '::', '/') || '/' || name || '.rs', dir || '/' || replace(replace(module, 'crate::', ''), '::', '/') || '.rs']
    ELSE (SELECT list(f.file ORDER BY f.file) FROM files f WHERE f.file LIKE '%.go' AND placed.name LIKE '%/' || regexp_replace(f.file, '/[^/]*$', '')) END AS candidates FROM placed),
found AS (SELECT t.file, t.ord, arg_min(f.file, t.rank) AS target FROM (SELECT file, ord, unnest(candidates) AS c, generate_subscripts(candidates, 1) AS rank FROM tried) t JOIN files f ON f.file = t.c GROUP BY ALL),
aimed AS (SELECT p.*, found.target FROM placed p LEFT JOIN found USING (file, ord))"""

#: The findings of the linter, without the one that a comment silences.
FINDINGS = """findings(file_path, lineno, col, rule_id, severity, message) AS (VALUES
  ('shop/report.py', 9, 8, 'PERF001', 'warn', 'Loop nested 2 deep: O(N^2)'), ('shop/report.py', 10, 12, 'PERF002', 'warn', 'I/O call ''db.query'' inside a loop'),
  ('shop/report.py', 11, 4, 'PERF004', 'error', 'Blocking call ''time.sleep'' in an async function'), ('svc/main.go', 9, 2, 'PERF001', 'warn', 'Loop nested 2 deep: O(N^2)'),
  ('svc/main.go', 10, 3, 'PERF001', 'error', 'Loop nested 3 deep: O(N^3)'), ('web/api.ts', 5, 34, 'PERF002', 'warn', 'I/O call ''this.store.query'' inside a loop'))"""

#: Callee resolution: candidates by the tier of the callee's text, the first that exists.
RESOLVED = """ids AS (SELECT id, id AS key FROM named), firsts AS (SELECT key, arg_min(id, (file, ord)) AS id FROM (SELECT unnest([name, qual]) AS key, id, file, ord FROM named) GROUP BY key),
brought AS (SELECT file, coalesce(asname, string_split(name, '/')[-1]) AS alias, arg_min(target, ord) AS target, arg_min(name, ord) AS name FROM aimed GROUP BY ALL),
ladder AS (SELECT c.file, c.ord, CASE
    WHEN callee ~ '^(self|cls|this)\\.' THEN [CASE WHEN callee ~ '^(self|cls|this)\\.[^.]+$' AND up <> '' THEN c.file || '::' || up || '.' || last END, CASE WHEN callee ~ '^(self|cls|this)\\.[^.]+$' AND up <> '' THEN '=' || up || '.' || last END, c.file || '::' || last, '=' || last]
    WHEN callee LIKE '%.%' OR callee LIKE '%::%' THEN [callee, b.target || '::' || regexp_replace(callee, '^[^.:]+(\\.|::)', ''), '=' || replace(callee, '::', '.'), c.file || '::' || last, '=' || last]
    ELSE [c.file || '::' || c.caller || '.' || callee, CASE WHEN up <> '' THEN c.file || '::' || up || '.' || callee END, CASE WHEN string_split(c.caller, '.')[-1] = callee THEN c.caller_id END, c.file || '::' || callee, b.target || '::' || b.name, '=' || callee] END AS tries
  FROM called c LEFT JOIN brought b ON b.file = c.file AND b.alias = regexp_extract(c.callee, '^([^.:(]+)', 1)),
each_ AS (SELECT file, ord, unnest(tries) AS t, generate_subscripts(tries, 1) AS rank FROM ladder),
hit AS (SELECT e.file, e.ord, arg_min(coalesce(i.id, f.id), rank) AS target_id FROM each_ e LEFT JOIN ids i ON i.key = e.t LEFT JOIN firsts f ON '=' || f.key = e.t WHERE coalesce(i.id, f.id) IS NOT NULL GROUP BY ALL),
resolved AS (SELECT c.*, hit.target_id FROM called c LEFT JOIN hit USING (file, ord))"""

#: Dead code: what calls and bases lead to by id or by name, from the entrypoints on.
DEAD = """keyed AS (SELECT caller_id, unnest([callee, last, CASE WHEN callee ~ '^(self|cls|this)\\.[^.]+$' AND up <> '' THEN up || '.' || last END]) AS key, callee, last FROM called),
links AS (
  SELECT caller_id AS src, target_id AS dst FROM resolved WHERE target_id IS NOT NULL
  UNION SELECT caller_id, id FROM keyed JOIN named ON key IN (name, qual)
  UNION SELECT caller_id, id FROM keyed JOIN named ON keyed.last = name AND kind IN ('function', 'async_function', 'method') WHERE callee LIKE '%.%' OR callee LIKE '%::%'
  UNION SELECT regexp_replace(id, '\\.[^.]+$', ''), id FROM named WHERE name IN ('__init__', 'constructor')
  UNION SELECT c.id, b.id FROM (SELECT id, unnest(bases) AS base FROM named) c JOIN named b ON c.base IN (b.name, b.qual)),
roots AS (
  SELECT id FROM named WHERE name IN ('main', 'cli', 'run_cli', 'app', 'constructor') OR name LIKE '\\_\\_%' ESCAPE '\\' OR name LIKE 'test\\_%' ESCAPE '\\'
    OR string_split(file, '/')[-1] IN ('__init__.py', 'main.go', 'lib.rs', 'main.rs', 'mod.rs')
  UNION SELECT n.id FROM aimed a JOIN named n ON n.file = a.target AND n.name = a.name WHERE string_split(a.file, '/')[-1] IN ('__init__.py', 'lib.rs', 'main.go')),
live(id) AS (SELECT id FROM roots UNION SELECT dst FROM live JOIN links ON src = live.id),
dead AS (SELECT n.* FROM named n WHERE n.id NOT IN (SELECT id FROM live) AND NOT (list_contains(n.decorators, '@property') AND regexp_replace(n.id, '\\.[^.]+$', '') IN (SELECT id FROM live))),
inner_ AS (SELECT DISTINCT src, dst FROM links WHERE src <> dst AND src IN (SELECT id FROM dead) AND dst IN (SELECT id FROM dead)),
above(src, dst) AS (SELECT src, dst FROM inner_ UNION SELECT a.src, i.dst FROM above a JOIN inner_ i ON a.dst = i.src),
free AS (SELECT id FROM dead WHERE id NOT IN (SELECT dst FROM inner_)),
judged AS (SELECT d.*, greatest(1, end_lineno - lineno + 1) AS lines, CASE WHEN id IN (SELECT id FROM free) THEN 'orphan' ELSE 'transitive' END AS dead_kind,
    CASE WHEN id NOT IN (SELECT id FROM free) THEN coalesce((SELECT min(src) FROM above WHERE dst = d.id AND src IN (SELECT id FROM free)), (SELECT least(min(src), d.id) FROM above WHERE dst = d.id)) END AS cluster_root FROM dead d)"""
