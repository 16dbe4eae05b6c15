"""Graph, join and window queries over the star schema, each with its DuckDB twin.

The graph: nations, with an edge from a customer's nation to a supplier's for every pair that trades at least
as often as four fifths of the pairs do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import register

TRADE = """trade AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
edges AS (SELECT src, dst FROM trade WHERE w >= (SELECT quantile_disc(w, 0.8) FROM trade))"""
PAIRS = f"WITH RECURSIVE {TRADE}, pairs AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM pairs p JOIN edges e ON p.dst = e.src)"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    trade = items.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("w"))
    least = trade.agg(F.expr("percentile_disc(0.8) within group (order by w)").alias("least"))
    return trade.crossJoin(F.broadcast(least)).where("w >= least").select("src", "dst")  # one row


@register("v8_neighbourhood", f"WITH {TRADE}, n AS (SELECT 3 AS node, 0 AS hop UNION SELECT dst, 1 FROM edges WHERE src = 3 UNION SELECT src, 1 FROM edges WHERE dst = 3), m AS (SELECT node, min(hop) AS hop FROM n GROUP BY node) SELECT e.src, e.dst FROM edges e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)")
def v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade_edges(spark, sf_dir).withColumns({"relation": F.lit("CALLS"), "ord": F.lit(0)})
    _, inside = G.neighbourhood(edges, spark.createDataFrame([(1, 3)], "patch_id int, node int"), 1, 1000, 1000)
    return inside.select("src", "dst")


@register("d4_reachable", f"{PAIRS} SELECT DISTINCT dst AS node FROM pairs WHERE src = 3 UNION SELECT 3")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reachable(trade_edges(spark, sf_dir), spark.createDataFrame([(3,)], "node int")).select("node")


@register("d8_closure", f"{PAIRS} SELECT DISTINCT src, dst FROM pairs")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(trade_edges(spark, sf_dir))


@register(
    "v10_strong_components",
    f"""{PAIRS}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
        SELECT node, least(node, coalesce((SELECT min(p.dst) FROM pairs p JOIN pairs q ON p.dst = q.src AND q.dst = p.src WHERE p.src = node), node)) AS component FROM nodes""",
)
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strong_components(trade_edges(spark, sf_dir))


@register(
    "d8_clusters",
    f"""{PAIRS}, dead AS (SELECT node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node NOT IN (SELECT dst FROM pairs WHERE src = 3) AND node <> 3),
        inner_ AS (SELECT * FROM edges WHERE src IN (FROM dead) AND dst IN (FROM dead)), up AS (SELECT src, dst FROM inner_ UNION SELECT u.src, e.dst FROM up u JOIN inner_ e ON u.dst = e.src),
        free AS (SELECT node FROM dead WHERE node NOT IN (SELECT dst FROM inner_))
        SELECT node, CASE WHEN node IN (FROM free) THEN 'orphan' ELSE 'transitive' END AS kind,
          CASE WHEN node NOT IN (FROM free) THEN coalesce((SELECT min(src) FROM up WHERE dst = node AND src IN (FROM free)), (SELECT least(min(src), node) FROM up WHERE dst = node)) END AS root FROM dead""",
)
def d8c(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade_edges(spark, sf_dir)
    live = G.reachable(edges, spark.createDataFrame([(3,)], "node int"))
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return G.dead_clusters(edges, every.join(live, "node", "left_anti"))


@register(
    "v9_capped_slice",
    f"""WITH {TRADE}, both_ AS (SELECT src AS here, dst AS node, 0 AS section FROM edges UNION ALL SELECT dst, src, 2 FROM edges),
        seeds AS (SELECT * FROM (VALUES (1, 3), (1, 8), (2, 12)) v(patch_id, node)),
        steps AS (SELECT patch_id, here, b.node, section, row_number() OVER (PARTITION BY patch_id, here ORDER BY section, b.node) AS fan FROM seeds s JOIN both_ b ON b.here = s.node),
        reached AS (SELECT patch_id, node, min((section, 0, here)) AS o FROM steps WHERE fan <= 4 AND (patch_id, node) NOT IN (SELECT patch_id, node FROM seeds) GROUP BY ALL),
        size AS (SELECT patch_id, count(*) AS n FROM seeds GROUP BY ALL),
        placed AS (SELECT r.*, n + row_number() OVER (PARTITION BY r.patch_id ORDER BY o, node) AS place FROM reached r JOIN size USING (patch_id)),
        fulls AS (SELECT DISTINCT patch_id FROM placed WHERE place > 6), cut AS (SELECT DISTINCT patch_id, here FROM steps WHERE fan > 4)
        SELECT patch_id, node, CAST(place AS INTEGER) AS place, 1 AS hop, false AS truncated FROM placed WHERE place <= 6
        UNION ALL SELECT s.patch_id, s.node, CAST(row_number() OVER (PARTITION BY s.patch_id ORDER BY s.node) AS INTEGER), 0,
          (s.patch_id, s.node) IN (SELECT patch_id, here FROM cut) OR s.patch_id IN (SELECT patch_id FROM fulls) FROM seeds s""",
)
def v9(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade_edges(spark, sf_dir).withColumns({"relation": F.lit("CALLS"), "ord": F.lit(0)})
    nodes, _ = G.neighbourhood(edges, spark.createDataFrame([(1, 3), (1, 8), (2, 12)], "patch_id int, node int"), 1, 4, 6)
    return nodes.select("patch_id", "node", "place", "hop", "truncated")


@register("x_event_windows", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in the reference: tumbling windows, in the form that the streaming module also runs."""
    from ..streaming.incremental import event_windows

    return event_windows(_t(spark, sf_dir, "events"), "1 hour", None).select("event_type", F.col("window.start").alias("start"), "n", "total")
