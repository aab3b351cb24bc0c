"""Prefix joins as hash joins.

A probe is expanded to the distinct prefix lengths of the net side and joined on the masked network,
so containment is an equality.  Lengths up to SHORT_PLEN have at most 2**(SHORT_PLEN+1) networks per
family: those go through a broadcast of proven size, because a /0 or /8 would be one hot key.  Longer
ones join by hash, where one key meets at most 2**(32-SHORT_PLEN) distinct IPv4 probes; an IPv6 net has
no such bound, so its probes are spread over V6_SPREAD salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_struct, masked
from cidrloom.operators.skew import join_to_unique
from cidrloom.session import cut_lineage

SHORT_PLEN = 12
V6_SPREAD = 32


def prefix_lengths(nets: DataFrame, net: str) -> Column:
    """Distinct (family, plen) of a net column as one lazily computed array; at most 162 entries."""
    pairs = nets.select(F.col(net)["family"].alias("family"), F.col(net)["plen"].alias("plen"))
    return pairs.select(F.collect_set(F.struct("family", "plen"))).scalar()


def _spread(probes: DataFrame, probe: str, lengths: Column, shorter_only: bool = False) -> DataFrame:
    p, x = F.col(probe), F.col("_at")
    fits = (x["plen"] < p["plen"]) if shorter_only else (x["plen"] <= p["plen"])
    spread = probes.select(*probes.columns, F.explode(lengths).alias("_at")).filter((x["family"] == p["family"]) & fits)
    return spread.select(*probes.columns, x["plen"].alias("_len"), masked(p, x["plen"]).alias("_net"))


def containing(probes: DataFrame, probe: str, nets: DataFrame, net: str) -> DataFrame:
    """Inner join of distinct probes to every net that covers them.

    `nets` holds one row per masked net; its other columns come along.
    """
    spread = _spread(probes, probe, prefix_lengths(nets, net))
    keyed = nets.withColumnRenamed(net, "_net")
    short, long = F.col("_net")["plen"] <= SHORT_PLEN, F.col("_net")["plen"] > SHORT_PLEN
    near = spread.filter(F.col("_len") <= SHORT_PLEN).join(F.broadcast(keyed.filter(short)), "_net")
    v6 = F.col("_net")["family"] == 6
    salt = F.when(v6, F.pmod(F.xxhash64(probe), F.lit(V6_SPREAD)).cast("int")).otherwise(0)
    salts = F.when(v6, F.sequence(F.lit(0), F.lit(V6_SPREAD - 1))).otherwise(F.array(F.lit(0)))
    dealt = spread.filter(F.col("_len") > SHORT_PLEN).withColumn("_salt", salt)
    far = dealt.join(keyed.filter(long).withColumn("_salt", F.explode(salts)), ["_net", "_salt"]).drop("_salt")
    return near.unionByName(far).drop("_len").withColumnRenamed("_net", net)


def _distinct(probes: DataFrame, probe: str) -> DataFrame:
    return probes.select(probe).filter(F.col(probe).isNotNull()).distinct()


def _net_keys(nets: DataFrame, net: str) -> DataFrame:
    """Distinct networks `_m`, written once because every containment join reads them three times."""
    return cut_lineage(nets.filter(F.col(net).isNotNull()).select(masked(F.col(net)).alias("_m")).distinct())


def longest_match(probes: DataFrame, probe: str, nets: DataFrame, net: str) -> DataFrame:
    """`probe, net` for every distinct probe that some net covers, with the longest such net (masked)."""
    found = containing(_distinct(probes, probe), probe, _net_keys(nets, net), "_m")
    best = found.groupBy(probe).agg(F.max(F.col("_m")["plen"]).alias("_len"))
    return best.select(probe, masked(F.col(probe), F.col("_len")).alias("match"))


def one_per_net(table: DataFrame, net: str, order: list[Column] | None = None) -> DataFrame:
    """One row per masked network: the first by `order`, smallest address by default; adds `match`."""
    keyed = table.filter(F.col(net).isNotNull()).withColumn("match", masked(F.col(net)))
    rank = F.struct(*(order or [F.col(net)["hi"], F.col(net)["lo"]]))
    row = F.struct(*[F.col(c) for c in table.columns])
    return keyed.groupBy("match").agg(F.min_by(row, rank).alias("_row")).select("match", "_row.*")


def longest_prefix_join(
    left: DataFrame, probe: str, table: DataFrame, net: str, order: list[Column] | None = None
) -> DataFrame:
    """Left outer join of `left` to the row of `table` whose net is the longest that covers `probe`.

    Each distinct probe is resolved once; the rows then join back by probe with hot probes split off.
    """
    return join_unique_nets(left, probe, cut_lineage(one_per_net(table, net, order)))


def join_unique_nets(left: DataFrame, probe: str, unique: DataFrame) -> DataFrame:
    """`longest_prefix_join` to a table that `one_per_net` has made and that is stored."""
    matches = longest_match(left, probe, unique, "match")
    resolved = cut_lineage(matches.join(unique, "match").drop("match"))
    return join_to_unique(left, resolved, [probe])


def in_any_net(probes: DataFrame, probe: str, nets: DataFrame, net: str) -> DataFrame:
    """Distinct probes covered by at least one net."""
    return containing(_distinct(probes, probe), probe, _net_keys(nets, net), "_m").select(probe).distinct()


def first_related(ranges: DataFrame, range_col: str, nets: DataFrame, net: str, order: str) -> DataFrame:
    """Per distinct range, the first net by `order` that covers it or lies inside it, with the match count.

    Nets are summed up per network before they meet the ranges: once as they are (nets above or equal),
    once under every shorter range length (nets inside), so no network is a hot key.
    """
    keys = ranges.select(range_col).filter(F.col(range_col).isNotNull()).distinct()
    keyed = cut_lineage(keys.withColumn("_range_net", masked(F.col(range_col))))
    masked_nets = nets.filter(F.col(net).isNotNull()).withColumn("_m", masked(F.col(net)))
    per_net = cut_lineage(masked_nets.groupBy("_m").agg(F.min(order).alias("first"), F.count("*").alias("matches")))
    above = containing(keyed, "_range_net", per_net, "_m").select(range_col, "first", "matches")
    inside = _spread(per_net, "_m", prefix_lengths(keyed, "_range_net"), shorter_only=True)
    inside = inside.groupBy(F.col("_net").alias("_range_net")).agg(F.min("first").alias("first"), F.sum("matches").alias("matches"))
    below = keyed.join(inside, "_range_net").select(range_col, "first", "matches")
    return above.unionByName(below).groupBy(range_col).agg(F.min("first").alias("first"), F.sum("matches").alias("matches"))


BLOCK = 65536


def disjoint_intervals(table: DataFrame, net: str) -> DataFrame:
    """IPv4 nets as disjoint ranges `lo, hi, match`, each with its longest covering net.

    Cut points are net starts, the addresses after net ends, and every /16 start, so that the next
    cut point is found inside one /16 (at most 65,536 points) and no range crosses a /16.
    """
    spark = table.sparkSession
    nets = _net_keys(table.filter(F.col(net)["family"] == 4), net)
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - F.col("_m")["plen"])
    cuts = nets.select(F.explode(F.array(F.col("_m")["lo"], F.col("_m")["lo"] + size)).alias("lo"))
    blocks = spark.range(BLOCK).select((F.col("id") * BLOCK).alias("lo"))
    points = cut_lineage(cuts.filter(F.col("lo") < 2**32).union(blocks).distinct())
    probe = points.select("lo", cidr_struct(F.lit(4), F.lit(32), F.lit(0), F.col("lo")).alias("_probe"))
    found = longest_match(probe, "_probe", nets, "_m").select(F.col("_probe")["lo"].alias("lo"), "match")
    spans = points.withColumn("_block", F.shiftright("lo", 16)).withColumn("hi", F.expr(
        f"coalesce(lead(lo) OVER (PARTITION BY _block ORDER BY lo), (_block + 1) * {BLOCK}) - 1"
    ))
    return spans.drop("_block").join(found, "lo").select("lo", "hi", "match")
