"""Topology graphs."""

from pyspark.sql import functions as F

from cidrloom.operators import topology as G
from workload import inputs
from workload.q_traces import GW_CTES
from workload.registry import query
from workload.shapes import ip4, oracle

LABEL = "coalesce(CASE WHEN ptr <> '*' THEN ptr END, ip, '*')"
_SIMPLE = " UNION ALL ".join(
    f"SELECT '{g}' AS granularity, range, hop * 2 AS pos, coalesce({e}, label) AS name FROM routes"
    for g, e in (("asn", "'AS' || asn"), ("facility", "facility"), ("device_role", "device_role"), ("device", "device"), ("ptr", "label"), ("interface", "device"))
)
PATHS = {
    **GW_CTES,
    "routes": f"SELECT range, hop, ptr, device, device_role, facility, interface, asn, {LABEL} AS label FROM (SELECT q.range, q.hop, q.ptr, q.device, q.device_role, q.facility, q.interface, x.asn, {ip4('q.ip')} AS ip FROM parsed q JOIN best b ON b.range = q.range AND (b.gw IS NULL OR q.hop <= b.gw) LEFT JOIN z_dns x ON x.ip = q.ip) t",
    "labels": f"{_SIMPLE} UNION ALL SELECT 'interface', range, hop * 2 + 1, device || '/' || interface FROM routes WHERE device IS NOT NULL AND interface IS NOT NULL",
    "steps": "SELECT granularity, range, pos, name FROM labels UNION ALL SELECT DISTINCT granularity, range, 0, 'Internet' FROM labels UNION ALL SELECT DISTINCT granularity, range, 1000000, range FROM labels",
    "pairs": "SELECT granularity, range, source, target FROM (SELECT granularity, range, name AS source, lead(name) OVER (PARTITION BY granularity, range ORDER BY pos) AS target FROM steps) t WHERE target IS NOT NULL",
    "links": "SELECT granularity, source, target, CAST(count(*) AS BIGINT) AS value FROM pairs WHERE source <> target GROUP BY granularity, source, target",
}
# No shortest path is longer than the longest route, 7 hops with two labels each.
DEPTHS = {
    **PATHS,
    "walk": "SELECT DISTINCT granularity, 'Internet' AS name, 0 AS depth FROM links UNION SELECT l.granularity, l.target, w.depth + 1 FROM walk w JOIN links l ON l.granularity = w.granularity AND l.source = w.name WHERE w.depth < 20",
    "depths": "SELECT granularity, name, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY granularity, name",
    "forward": "SELECT l.granularity, l.source, l.target, l.value FROM links l JOIN depths a ON a.granularity = l.granularity AND a.name = l.source JOIN depths b ON b.granularity = l.granularity AND b.name = l.target WHERE b.depth > a.depth",
    "nodes": "SELECT DISTINCT granularity, name FROM steps",
}


def paths(spark, d):
    return inputs.once(spark, d, "paths", lambda: G.label_paths(inputs.gateways(spark, d)))


def links(spark, d):
    return inputs.once(spark, d, "links", lambda: G.weighted_links(paths(spark, d)))


def depth(spark, d):
    return inputs.once(spark, d, "depth", lambda: G.depths(links(spark, d)))


def graph(spark, d):
    """(nodes, forward links) of all graphs."""
    nodes = inputs.once(spark, d, "nodes", lambda: G.graph_nodes(paths(spark, d)))
    return nodes, inputs.once(spark, d, "forward", lambda: G.forward_links(links(spark, d), depth(spark, d)))


def _both(nodes, edges):
    """Nodes and links in one table."""
    flat = nodes.select("granularity", F.col("name").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("bigint").alias("value"))
    return flat.unionByName(edges.select("granularity", "source", "target", "value"))


@query("g1_hop_label", oracle("SELECT range, hop, label FROM routes", **PATHS))
def hop_label(spark, d):
    hops = inputs.gateways(spark, d).select("range", F.explode("routes").alias("h"))
    return hops.select("range", F.col("h.hop").cast("bigint").alias("hop"), G.hop_label(F.col("h")).alias("label"))


@query("g2_hop_nodes", oracle("SELECT granularity, range, name, CAST(row_number() OVER (PARTITION BY granularity, range ORDER BY pos) - 1 AS BIGINT) AS place FROM steps", **PATHS))
def hop_nodes(spark, d):
    rows = paths(spark, d).select("granularity", F.element_at("path", -1).alias("range"), F.posexplode("path").alias("place", "name"))
    return rows.withColumn("place", F.col("place").cast("bigint"))


@query("w4_consecutive_pairs", oracle("SELECT granularity, range, source, target FROM pairs", **PATHS))
def consecutive_pairs(spark, d):
    rows = paths(spark, d).select("granularity", F.element_at("path", -1).alias("range"), F.explode(G.consecutive_pairs(F.col("path"))).alias("p"))
    return rows.select("granularity", "range", F.col("p")["source"].alias("source"), F.col("p")["target"].alias("target"))


@query("a9_link_weight", oracle("SELECT * FROM links", **PATHS))
def link_weight(spark, d):
    return G.weighted_links(paths(spark, d))


@query("f6_self_links", oracle("SELECT granularity, CAST(count(*) AS BIGINT) AS links, CAST(sum(value) AS BIGINT) AS weight FROM links GROUP BY granularity", **PATHS))
def self_links(spark, d):
    return G.weighted_links(paths(spark, d)).groupBy("granularity").agg(F.count("*").alias("links"), F.sum("value").alias("weight"))


@query("g4_depths", oracle("SELECT * FROM depths", **DEPTHS))
def depths(spark, d):
    return G.depths(links(spark, d)).withColumn("depth", F.col("depth").cast("bigint"))


@query("f7_forward_links", oracle("SELECT * FROM forward", **DEPTHS))
def forward_links(spark, d):
    return G.forward_links(links(spark, d), depth(spark, d))


BOTH = "SELECT granularity, name AS source, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BIGINT) AS value FROM {n} {w} UNION ALL SELECT granularity, source, target, value FROM {l} {w}"


@query("g3_build_graph", oracle(BOTH.format(n="nodes", l="forward", w="WHERE granularity = 'device'"), **DEPTHS))
def build_graph(spark, d):
    return _both(*G.build_graph(inputs.gateways(spark, d), ("device",)))


@query("g5_all_graphs", oracle(BOTH.format(n="nodes", l="forward", w=""), **DEPTHS))
def all_graphs(spark, d):
    return _both(*G.build_graph(inputs.gateways(spark, d)))


@query("f8_without_host_routes", oracle("""
    SELECT granularity, name AS source, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BIGINT) AS value FROM nodes WHERE NOT ends_with(name, '/32')
    UNION ALL SELECT granularity, source, target, value FROM forward WHERE NOT ends_with(source, '/32') AND NOT ends_with(target, '/32')""", **DEPTHS))
def without_host_routes(spark, d):
    return _both(*G.without_host_routes(*graph(spark, d)))


@query("g6_keyword_subgraph", oracle(BOTH.format(n="(SELECT * FROM up UNION SELECT * FROM down) u", l="inner_links", w=""), **DEPTHS,
    seeds="SELECT granularity, name FROM nodes WHERE contains(lower(name), 'edge')",
    up="SELECT * FROM seeds UNION SELECT l.granularity, l.source FROM up u JOIN forward l ON l.granularity = u.granularity AND l.target = u.name",
    down="SELECT * FROM seeds UNION SELECT l.granularity, l.target FROM down u JOIN forward l ON l.granularity = u.granularity AND l.source = u.name",
    inner_links="SELECT l.* FROM forward l WHERE EXISTS (SELECT 1 FROM (SELECT * FROM up UNION SELECT * FROM down) u WHERE u.granularity = l.granularity AND u.name = l.source) AND EXISTS (SELECT 1 FROM (SELECT * FROM up UNION SELECT * FROM down) u WHERE u.granularity = l.granularity AND u.name = l.target)"))
def keyword_subgraph(spark, d):
    return _both(*G.keyword_subgraph(*graph(spark, d), "EDGE"))


@query("g7_column_profile", oracle("""
    SELECT granularity, d AS depth, n AS nodes, max(n) OVER (PARTITION BY granularity) AS widest, max(n) OVER (PARTITION BY granularity) > 500 AS too_wide FROM (SELECT granularity, depth AS d, CAST(count(*) AS BIGINT) AS n FROM depths GROUP BY 1, 2) t""", **DEPTHS))
def column_profile(spark, d):
    counts, widest = G.column_profile(depth(spark, d).withColumn("depth", F.col("depth").cast("bigint")))
    return counts.join(widest, "granularity")


@query("j9_topology_report", oracle("""
    SELECT granularity, CAST(count(*) FILTER (WHERE target IS NULL) AS BIGINT) AS nodes, CAST(count(*) FILTER (WHERE target IS NOT NULL) AS BIGINT) AS links, CAST(sum(value) AS BIGINT) AS weight FROM b GROUP BY granularity""",
    **DEPTHS, b=BOTH.format(n="nodes", l="forward", w="")))
def topology_report(spark, d):
    rows = _both(*graph(spark, d))
    return rows.groupBy("granularity").agg(F.count_if(F.col("target").isNull()).alias("nodes"), F.count("target").alias("links"), F.sum("value").alias("weight"))
