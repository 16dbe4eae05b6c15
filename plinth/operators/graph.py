"""Graph operators over edge tables ``(src, dst)``: reach, closure, strong components, bounded neighbourhoods.

Loops advance a frontier by one join a step, anti-join what is known, and write each step's result to the
shared checkpoint folder, so plans stay short and a lost executor costs one step. A counted graph of at most
``ONE_TASK_EDGES`` edges is walked in one task instead, with the same results; small graphs that belong to a key
(one patch each) go through one grouped Tarjan.

A node may stand for a name that many symbols share: edges run from callers to the name and from the name to its
symbols, so their number is linear where pairs would be a product. Such nodes are texts that begin with ``NAME``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Edges up to which one task walks a graph (some hundred MB); more go through distributed rounds.
ONE_TASK_EDGES = 1 << 20
NAME = "\0"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def whole(rows: DataFrame, run: Callable[[Iterator[tuple[Any, ...]]], list[tuple[Any, ...]]], schema: str) -> DataFrame:
    """``run`` over all rows in one task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = run(_rows(batches))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(kinds)], kinds.names)

    return rows.coalesce(1).mapInArrow(once, schema)


def walk(starts: dict[Any, Any], ahead: dict[Any, list[Any]], most: int | None = None) -> dict[Any, int]:
    """Depth of every node that ``starts`` reach."""
    depth = dict.fromkeys(starts, 0)
    waiting = deque(depth)
    while waiting:
        node = waiting.popleft()
        if most is not None and depth[node] >= most:
            continue
        for other in ahead.get(node, ()):
            if other not in depth:
                depth[other] = depth[node] + 1
                waiting.append(other)
    return depth


def reachable(edges: DataFrame, roots: DataFrame, max_steps: int | None = None, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, depth)`` of all that ``roots(node)`` reach, themselves at depth 0."""
    scratch = Scratch(edges.sparkSession, "reach")
    kind = dict(edges.dtypes)["src"]
    roots = roots.select(F.col("node").cast(kind)).where("node is not null").distinct()
    both = scratch.keep(edges.select("src", "dst").where("src is not null and dst is not null").distinct().unionByName(roots.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"))), "edges")
    if both.count() <= one_task:

        def run(rows: Iterator[tuple[Any, ...]]) -> list[tuple[Any, ...]]:
            ahead, starts = {}, {}
            for a, b in rows:
                if b is None:
                    starts[a] = True
                else:
                    ahead.setdefault(a, []).append(b)
            return list(walk(starts, ahead, max_steps).items())

        return scratch.keep(whole(both, run, f"node {kind}, depth int"), "walked")
    edges, roots = both.where("dst is not null"), both.where("dst is null").select(F.col("src").alias("node"))
    seen = frontier = scratch.keep(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "step0")
    step = 0
    while max_steps is None or step < max_steps:
        step += 1
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = scratch.keep(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)), f"step{step}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, max_steps: int | None = None) -> DataFrame:
    """``(src, dst)`` pairs with a path of one edge or more; the pair table doubles its reach each step."""
    scratch = Scratch(edges.sparkSession, "closure")
    pairs = scratch.keep(edges.select("src", "dst").distinct(), "pairs0")
    size, step = pairs.count(), 0
    while max_steps is None or step < max_steps:
        step += 1
        longer = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        pairs = scratch.keep(pairs.unionByName(longer).distinct(), f"pairs{step}")
        if (now := pairs.count()) == size:
            break
        size = now
    return pairs


def _spread(colours: DataFrame, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """The smallest colour of ``(node, colour)``, null for none, that reaches each node over ``edges``, its own included."""
    colours = scratch.keep(colours.select("node", "colour"), f"{tag}-0")
    step = 0
    while True:
        step += 1
        pushed = edges.join(colours, edges["src"] == colours["node"]).groupBy("dst").agg(F.min("colour").alias("push"))
        joined = colours.join(pushed, colours["node"] == pushed["dst"], "left")
        moved = F.col("push").isNotNull() & (F.col("colour").isNull() | (F.col("push") < F.col("colour")))
        after = joined.select("node", F.least("colour", "push").alias("colour"), moved.alias("moved"))
        after = scratch.keep(after, f"{tag}-{step}")
        colours = after.select("node", "colour")
        if after.where("moved").isEmpty():
            return colours


def strong_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, component)``: the smallest node of each strongly connected component.

    Colouring: the smallest node that reaches a node colours it; a colour's own node, walked backwards within
    its colour, finds one whole component; those leave, and the rest is coloured again.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    edges = scratch.keep(edges.select("src", "dst").where("src <> dst").distinct(), "edges0")
    if edges.count() <= one_task:
        kind = dict(edges.dtypes)["src"]

        def run(rows: Iterator[tuple[Any, ...]]) -> list[tuple[Any, ...]]:
            ahead: dict[Any, list[Any]] = {}
            for a, b in rows:
                ahead.setdefault(a, []).append(b)
                ahead.setdefault(b, [])
            home = {n: part[0] for part in tarjan(ahead) for n in part}
            return [(n, home.get(n, n)) for n in ahead]

        return scratch.keep(whole(edges, run, f"node {kind}, component {kind}"), "found")
    nodes = scratch.keep(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes0")
    done = None
    turn = 0
    while not nodes.isEmpty():
        turn += 1
        colours = _spread(nodes.withColumn("colour", F.col("node")), edges, scratch, f"colour{turn}")
        a, b = colours.withColumnsRenamed({"node": "src", "colour": "c"}), colours.withColumnsRenamed({"node": "dst", "colour": "d"})
        inside = scratch.keep(edges.join(a, "src").join(b, "dst").where("c = d").select("src", "dst", F.col("c").alias("colour")), f"inside{turn}")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = reachable(back, colours.where("node = colour").select("node"), one_task=one_task).select("node").join(colours, "node").withColumnRenamed("colour", "component")
        found = scratch.keep(found, f"found{turn}")
        done = found if done is None else done.unionByName(found)
        nodes = scratch.keep(nodes.join(found, "node", "left_anti"), f"nodes{turn}")
        kept = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
        edges = scratch.keep(kept, f"edges{turn}")
    return done if done is not None else edges.sparkSession.createDataFrame([], "node string, component string")


def tarjan(graph: dict[str, list[str]], include_self_loops: bool = False) -> list[list[str]]:
    """Strong components of two nodes or more, smallest node first, ordered by it. Iterative, so no depth limit."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held, on, out = [], set(), []
    for top in sorted(graph):
        if top in index:
            continue
        work = [(top, iter(graph.get(top, ())))]
        index[top] = low[top] = len(index)
        held.append(top)
        on.add(top)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    held.append(other)
                    on.add(other)
                    work.append((other, iter(graph.get(other, ()))))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    at = held.index(node)
                    part = held[at:]
                    del held[at:]
                    on.difference_update(part)
                    if len(part) > 1 or include_self_loops and node in graph.get(node, ()):
                        first = part.index(min(part))
                        out.append(part[first:] + part[:first])
    return sorted(out)


def cycles_by_key(edges: DataFrame, key: str = "patch_id", include_self_loops: bool = False) -> DataFrame:
    """``(key, cycle)`` for the small graph of each key; a cycle is an array of nodes, smallest first."""
    kind = dict(edges.dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        graph: dict[str, list[str]] = {}
        for a, b in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True):
            graph.setdefault(a, []).append(b)
        found = tarjan(graph, include_self_loops)
        keys = pa.array([table[key][0].as_py()] * len(found), table.schema.field(key).type)
        return pa.table({key: keys, "cycle": pa.array(found, pa.list_(pa.string()))})

    Scratch(edges.sparkSession, "cycles")
    return edges.select(key, "src", "dst").distinct().groupBy(key).applyInArrow(run, f"{key} {kind}, cycle array<string>")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 1, max_fanout: int = 20, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """Bounded slices around seeds, one for each ``patch_id``: nodes and induced edges.

    ``edges(src, dst, relation, ord)`` is walked both ways; ``seeds(patch_id, node)``. A node hands on at most
    ``max_fanout`` new edges a hop, callees before bases before callers before subclasses; a slice admits at most
    ``max_nodes`` nodes, seeds first, then by hop and order. Nodes are ``(patch_id, node, hop, place,
    truncated)``; edges are those between admitted nodes. Within the caps this is every node in reach.
    """
    scratch = Scratch(edges.sparkSession, "slice")
    both = edges.select("src", "dst", "relation", "ord", F.lit(0).alias("back"), F.col("src").alias("at"), F.col("dst").alias("to"))
    both = both.unionByName(edges.select("src", "dst", "relation", "ord", F.lit(1).alias("back"), F.col("dst").alias("at"), F.col("src").alias("to")))
    section = F.when(F.col("back") == 0, F.when(F.col("relation") == "INHERITS", 1).otherwise(0)).otherwise(F.when(F.col("relation") == "INHERITS", 3).otherwise(2))
    both = scratch.keep(both.withColumn("section", section), "both")
    first = F.row_number().over(Window.partitionBy("patch_id").orderBy("node"))
    nodes = seeds.select("patch_id", "node").distinct().withColumn("place", first).where(F.col("place") <= max_nodes).withColumn("hop", F.lit(0)).withColumn("truncated", F.lit(False))
    nodes = scratch.keep(nodes, "nodes0")
    for hop in range(1, hops + 1):
        frontier = nodes.where(F.col("hop") == hop - 1).select("patch_id", F.col("node").alias("at"))
        steps = frontier.join(both, "at")
        fan = F.row_number().over(Window.partitionBy("patch_id", "at").orderBy("section", "ord", "to"))
        steps = steps.withColumn("fan", fan)
        cut = steps.where(F.col("fan") > max_fanout).select("patch_id", F.col("at").alias("node"), F.lit(True).alias("cut")).distinct()
        reached = steps.where(F.col("fan") <= max_fanout).groupBy("patch_id", F.col("to").alias("node")).agg(F.min(F.struct("section", "ord", "at")).alias("o"))
        fresh = reached.join(nodes, ["patch_id", "node"], "left_anti")
        size = nodes.groupBy("patch_id").agg(F.max("place").alias("size"))
        rank = F.row_number().over(Window.partitionBy("patch_id").orderBy("o", "node"))
        fresh = fresh.join(size, "patch_id").withColumn("place", F.col("size") + rank)
        full = fresh.where(F.col("place") > max_nodes).select("patch_id").distinct().withColumn("full", F.lit(True))
        fresh = fresh.where(F.col("place") <= max_nodes).select("patch_id", "node", F.col("place").cast("int"), F.lit(hop).alias("hop"), F.lit(False).alias("truncated"))
        marked = nodes.join(cut, ["patch_id", "node"], "left").join(full, "patch_id", "left")
        last = F.col("full") & (F.col("hop") == hop - 1)
        nodes = marked.select("patch_id", "node", "place", "hop", (F.col("truncated") | F.coalesce("cut", last, F.lit(False))).alias("truncated"))
        nodes = scratch.keep(nodes.unionByName(fresh), f"nodes{hop}")
    ends = nodes.select("patch_id", "node")
    inside = ends.withColumnRenamed("node", "src").join(edges.select("src", "dst", "relation").distinct(), "src").join(ends.withColumnRenamed("node", "dst"), ["patch_id", "dst"], "left_semi")
    return nodes, inside.select("patch_id", "src", "dst", "relation")


def _named(node: Column | str) -> Column:
    return F.col(node).cast("string").startswith(NAME) if isinstance(node, str) else node.cast("string").startswith(NAME)


def clusters_of(dead: set[Any], pairs: list[tuple[Any, Any]]) -> list[tuple[Any, ...]]:
    """``dead_clusters`` in one task: ``(node, kind, root)`` of the dead nodes, by all edges."""
    through = lambda n: isinstance(n, str) and n.startswith(NAME)
    ahead: dict[Any, list[Any]] = {}
    callers: dict[Any, set[Any]] = {}
    for a, b in pairs:
        if (a in dead or through(a)) and (b in dead or through(b)) and a != b:
            ahead.setdefault(a, []).append(b)
            if through(b) and len(callers.setdefault(b, set())) < 2:
                callers[b].add(a)
    called = {b for a, bs in ahead.items() for b in bs if not through(b) and (not through(a) or callers.get(a, set()) - {b})}

    def smallest(sources: set[Any]) -> dict[Any, Any]:
        """The smallest source that reaches a node: sources in order, each walks what no smaller one has."""
        label: dict[Any, Any] = {}
        for source in sorted(sources):
            waiting = [source]
            while waiting:
                node = waiting.pop()
                if node not in label:
                    label[node] = source
                    waiting += ahead.get(node, ())
        return label

    free, lowest = smallest(dead - called), smallest(dead)
    return [(n, "transitive", free.get(n, lowest[n])) if n in called else (n, "orphan", None) for n in dead]


def _clusters(rows: Iterator[tuple[Any, ...]]) -> list[tuple[Any, ...]]:
    dead, pairs = set(), []
    for a, b in rows:
        if b is None:
            dead.add(a)
        else:
            pairs.append((a, b))
    return clusters_of(dead, pairs)


def dead_clusters(edges: DataFrame, dead: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, kind, root)`` of dead nodes: ``orphan`` without dead callers (self calls aside), else ``transitive``.

    The root of a transitive node is its smallest dead ancestor without dead callers, or, where there is none
    (a cycle), the smallest node among its ancestors and itself. Names (see the module) hand calls on.
    """
    scratch = Scratch(edges.sparkSession, "clusters")
    kind = dict(edges.dtypes)["src"]
    dead = dead.select(F.col("node").cast(kind).alias("node")).distinct()
    both = scratch.keep(edges.select("src", "dst").distinct().unionByName(dead.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"))), "all")
    if both.count() <= one_task:
        return scratch.keep(whole(both, _clusters, f"node {kind}, kind string, root {kind}"), "found")
    dead = both.where("dst is null").select(F.col("src").alias("node"))
    inner = both.where("src <> dst")
    for end in ("src", "dst"):
        known = dead.select(F.col("node").alias(end), F.lit(True).alias("known"))
        inner = inner.join(known, end, "left").where(F.coalesce("known", F.lit(False)) | _named(end)).drop("known")
    inner = scratch.keep(inner.select("src", "dst"), "inner")
    one, many = ~_named("src") & ~_named("dst"), _named("src") & ~_named("dst")
    users = inner.where(_named("dst")).groupBy(F.col("dst").alias("src")).agg(F.min("src").alias("lo"), F.max("src").alias("hi"))
    by_name = inner.where(many).join(users, "src").where((F.col("lo") != F.col("dst")) | (F.col("hi") != F.col("dst")))
    called = scratch.keep(inner.where(one).select(F.col("dst").alias("node")).union(by_name.select("dst")).distinct(), "called")
    orphans = scratch.keep(dead.join(called, "node", "left_anti"), "orphans")
    names = inner.select(F.explode(F.array("src", "dst")).alias("node")).where(_named("node")).distinct().withColumn("colour", F.lit(None).cast(kind))
    any_ = _spread(dead.withColumn("colour", F.col("node")).unionByName(names), inner, scratch, "any")
    start = dead.join(orphans.withColumn("colour", F.col("node")), "node", "left").unionByName(names)
    free = _spread(start, inner, scratch, "free")
    roots = called.join(any_.withColumnRenamed("colour", "any"), "node").join(free.withColumnRenamed("colour", "free"), "node")
    transitive = roots.select("node", F.lit("transitive").alias("kind"), F.coalesce("free", "any").alias("root"))
    return orphans.select("node", F.lit("orphan").alias("kind"), F.lit(None).cast(kind).alias("root")).unionByName(transitive)
