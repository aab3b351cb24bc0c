"""Topology graphs from gateway records, at six granularities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import is_host_route
from cidrloom.operators.skew import join_to_unique
from cidrloom.session import cut_lineage

# Graph names and the root label.
GRANULARITIES = ("asn", "facility", "device_role", "device", "interface", "ptr")
ROOT = "Internet"
WIDE_COLUMN = 500

KEY = ["granularity", "name"]


def hop_label(hop: Column) -> Column:
    """Hostname unless it is `*`, else address, else `*`."""
    return F.coalesce(F.when(hop["ptr"] != "*", hop["ptr"]), hop["ip"], F.lit("*"))


def hop_nodes(hop: Column, granularity: str) -> Column:
    """Labels of a hop: one, or device and `device/interface`."""
    device = hop["device"]
    if granularity == "ptr":
        return F.array(hop_label(hop))
    if granularity == "asn":
        return F.array(F.coalesce(F.concat(F.lit("AS"), hop["asn"].cast("string")), hop_label(hop)))
    if granularity == "interface":
        named = device["device"]
        port = F.concat(named, F.lit("/"), device["interface"])
        return F.when(port.isNotNull(), F.array(named, port)).otherwise(F.array(F.coalesce(named, hop_label(hop))))
    return F.array(F.coalesce(device[granularity], hop_label(hop)))


def label_paths(gateways: DataFrame, granularities: tuple[str, ...] = GRANULARITIES) -> DataFrame:
    """One row per record and granularity: the labels from the root to the range."""
    some = gateways.filter(F.size("routes") > 0)

    def path(granularity: str) -> Column:
        labels = F.flatten(F.transform("routes", lambda hop: hop_nodes(hop, granularity)))
        return F.struct(F.lit(granularity).alias("granularity"), F.concat(F.array(F.lit(ROOT)), labels, F.array("range")).alias("path"))

    graphs = F.array(*[path(g) for g in granularities])
    return some.select(F.explode(graphs).alias("_g")).select("_g.*")


def consecutive_pairs(path: Column) -> Column:
    """Neighbouring labels of a path."""
    return F.arrays_zip(
        F.slice(path, F.lit(1), F.size(path) - 1).alias("source"), F.slice(path, F.lit(2), F.size(path) - 1).alias("target")
    )


def weighted_links(paths: DataFrame) -> DataFrame:
    """Links with their record count, links to the same label dropped."""
    pairs = paths.select("granularity", F.explode(consecutive_pairs(F.col("path"))).alias("_p"))
    pairs = pairs.select("granularity", F.col("_p")["source"].alias("source"), F.col("_p")["target"].alias("target"))
    return pairs.filter(F.col("source") != F.col("target")).groupBy("granularity", "source", "target").agg(F.count("*").alias("value"))


def graph_nodes(paths: DataFrame, granularities: tuple[str, ...] = GRANULARITIES) -> DataFrame:
    """Labels per graph; the root is always there."""
    roots = paths.sparkSession.createDataFrame([(g, ROOT) for g in granularities], "granularity string, name string")
    return paths.select("granularity", F.explode("path").alias("name")).unionByName(roots).distinct()


class Adjacency:
    """Directed edges ready for repeated frontier joins.

    Edges of every node with more than EDGES_PER_SALT neighbours are spread over salts.  There are at
    most edges / EDGES_PER_SALT such nodes; Spark broadcasts their stored list if it is small.
    """

    EDGES_PER_SALT = 1_000_000

    def __init__(self, links: DataFrame, reverse: bool = False, edges_per_salt: int | None = None):
        per_salt = edges_per_salt or self.EDGES_PER_SALT
        a, b = ("target", "source") if reverse else ("source", "target")
        edges = links.select("granularity", F.col(a).alias("name"), F.col(b).alias("next"))
        degrees = edges.groupBy(*KEY).count().filter(F.col("count") > per_salt)
        self.hubs = cut_lineage(degrees.select(*KEY, F.ceil(F.col("count") / per_salt).cast("int").alias("salts")))
        salted = edges.join(self.hubs, KEY, "left")
        salt = F.pmod(F.xxhash64("next"), F.coalesce("salts", F.lit(1)))
        self.edges = cut_lineage(salted.select(*KEY, salt.cast("int").alias("salt"), "next"))

    def step(self, frontier: DataFrame) -> DataFrame:
        """Distinct nodes one edge away."""
        spread = frontier.select(*KEY).join(self.hubs, KEY, "left")
        spread = spread.select(*KEY, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        return self.edges.join(spread, [*KEY, "salt"]).select("granularity", F.col("next").alias("name")).distinct()


def reach(adjacency: Adjacency, start: DataFrame) -> DataFrame:
    """Nodes reachable from `start` with their distance: `granularity, name, depth`.

    One join per level; every level is written to the checkpoint folder, so plans stay short and the
    loop ends when a level is empty.
    """
    level = cut_lineage(start.select(*KEY).distinct().withColumn("depth", F.lit(0)))
    seen, depth = level, 0
    while True:
        depth += 1
        fresh = adjacency.step(level).join(seen, KEY, "left_anti")
        level = cut_lineage(fresh.withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


def depths(links: DataFrame) -> DataFrame:
    """Shortest distance from the root; unreachable nodes have no row."""
    roots = links.select("granularity", F.lit(ROOT).alias("name")).distinct()
    return reach(Adjacency(links), roots)


def forward_links(links: DataFrame, depth: DataFrame) -> DataFrame:
    """Links that lead away from the root; both ends must be reachable."""
    source = depth.select("granularity", F.col("name").alias("source"), F.col("depth").alias("_ds"))
    target = depth.select("granularity", F.col("name").alias("target"), F.col("depth").alias("_dt"))
    with_source = join_to_unique(links, source, ["granularity", "source"])
    both = join_to_unique(with_source, target, ["granularity", "target"])
    return both.filter(F.col("_dt") > F.col("_ds")).drop("_ds", "_dt")


def build_graph(gateways: DataFrame, granularities: tuple[str, ...] = GRANULARITIES) -> tuple[DataFrame, DataFrame]:
    """(nodes, forward links) of all graphs in one pass."""
    paths = label_paths(gateways, granularities)
    links = cut_lineage(weighted_links(paths))
    return graph_nodes(paths, granularities), forward_links(links, depths(links))


def without_host_routes(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop host-route nodes and the links that touch them."""
    kept = ~is_host_route(F.col("source")) & ~is_host_route(F.col("target"))
    return nodes.filter(~is_host_route(F.col("name"))), links.filter(kept)


def keyword_subgraph(nodes: DataFrame, links: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes that contain the text in any case, all their ancestors and descendants, and links inside."""
    seeds = cut_lineage(nodes.filter(F.lower("name").contains(text.lower())).select(*KEY))
    up, down = reach(Adjacency(links, reverse=True), seeds), reach(Adjacency(links), seeds)
    inside = cut_lineage(up.select(*KEY).unionByName(down.select(*KEY)).distinct())
    marked = links
    for end in ("source", "target"):
        known = inside.select("granularity", F.col("name").alias(end), F.lit(True).alias(f"_{end}"))
        marked = join_to_unique(marked, known, ["granularity", end]).filter(f"_{end}").drop(f"_{end}")
    return inside, marked


def column_profile(depth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes per depth, widest depth per graph with a warning above WIDE_COLUMN)."""
    counts = depth.groupBy("granularity", "depth").agg(F.count("*").alias("nodes"))
    widest = counts.groupBy("granularity").agg(F.max("nodes").alias("widest"))
    return counts, widest.withColumn("too_wide", F.col("widest") > WIDE_COLUMN)
