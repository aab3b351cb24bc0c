"""Traces to per-range gateways.

Traces are rows `trace_id, range, version, measured_at, source, destination, stop_reason, hops`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_text, masked, parse_cidr, parse_ip, sample_targets
from cidrloom.functions.patterns import PtrPattern, parse_ptr
from cidrloom.operators.prefix import in_any_net
from cidrloom.operators.skew import join_to_unique
from cidrloom.session import cut_lineage

HOP_FIELDS = ("hop", "ip", "rtt_avg", "rtt_best", "rtt_worst", "icmp_type", "asn", "ptr")


def ordered_union(first: DataFrame, second: DataFrame, net: str, order: str) -> DataFrame:
    """Distinct prefixes of two tables; `first` comes before `second`: `net, ord`."""
    both = first.select(net, F.struct(F.lit(0).alias("part"), F.col(order).alias("pos")).alias("ord")).unionByName(
        second.select(net, F.struct(F.lit(1).alias("part"), F.col(order).alias("pos")).alias("ord"))
    )
    return both.groupBy(net).agg(F.min("ord").alias("ord"))


def expand_targets(nets: DataFrame, net: str, full: bool = False, block: int = 65536) -> DataFrame:
    """IPv4 probe targets `net, ip`: a sample per prefix, or every usable host when `full`.

    Full expansion explodes blocks first and spreads them, so one wide prefix is not one task's work.
    """
    v4 = nets.filter(F.col(net)["family"] == 4).select(net)
    if not full:
        return v4.select(net, F.explode(sample_targets(F.col(net))).alias("ip"))
    edge = F.when(F.col(net)["plen"] >= 31, 0).otherwise(1)
    low = masked(F.col(net))["lo"]
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - F.col(net)["plen"])
    bounds = v4.select(net, (low + edge).alias("_a"), (low + size - 1 - edge).alias("_z"))
    starts = bounds.select(net, "_z", F.explode(F.sequence("_a", "_z", F.lit(block).cast("bigint"))).alias("_s"))
    spread = starts.repartition(F.col("_s"))
    return spread.select(net, F.explode(F.sequence("_s", F.least(F.col("_s") + block - 1, "_z"))).alias("ip"))


def remaining_targets(targets: DataFrame, net: str, ip: str, traces: DataFrame) -> DataFrame:
    """Targets whose (range, destination) pair has no trace yet; a new range for a known address counts as new."""
    done = traces.select(parse_cidr(F.col("range")).alias(net), parse_ip(F.col("destination"))["lo"].alias(ip))
    done = done.filter(F.col(net).isNotNull() & F.col(ip).isNotNull()).distinct()
    return targets.join(done, [net, ip], "left_anti")


def planned_parents(targets: DataFrame, ip: str, net: str) -> DataFrame:
    """`ip, parent`: the longest net each address was planned under; equal lengths fall to the smallest net."""
    rank = F.struct((-F.col(net)["plen"]).alias("l"), F.col(net)["hi"].alias("h"), F.col(net)["lo"].alias("a"))
    return targets.groupBy(ip).agg(F.min_by(net, rank).alias("parent"))


def parent_prefix(destinations: DataFrame, ip: str, targets: DataFrame, net: str) -> DataFrame:
    """Longest target prefix an address was planned under, unmatched addresses dropped.

    `targets` are planned (net, ip) pairs; equal lengths fall to the smallest net.
    """
    best = planned_parents(targets, ip, net)
    return join_to_unique(destinations, best, [ip]).filter(F.col("parent").isNotNull())


def current_traces(traces: DataFrame, nets: DataFrame, net: str) -> DataFrame:
    """Traces whose range is, exactly, one of the current prefixes.

    Each spelling of a range is parsed once, not once per trace.
    """
    traces = traces.filter(F.col("range").isNotNull())
    spelled = cut_lineage(traces.select("range").distinct()).withColumn("_net", parse_cidr(F.col("range")))
    current = spelled.join(nets.select(F.col(net).alias("_net")).distinct(), "_net")
    current = cut_lineage(current.select("range", F.lit(True).alias("_current")))
    return join_to_unique(traces, current, ["range"]).filter("_current").drop("_current")


def prune_counts(traces: DataFrame, current: DataFrame) -> DataFrame:
    """`kept, pruned`: traces that `current_traces` has kept and dropped."""
    both = traces.select(F.lit(0).alias("k")).unionByName(current.select(F.lit(1).alias("k")))
    return both.agg(F.count_if(F.col("k") == 1).alias("kept"), (F.count_if(F.col("k") == 0) - F.count_if(F.col("k") == 1)).alias("pruned"))


def explode_hops(traces: DataFrame) -> DataFrame:
    """One row per hop with its array position."""
    keep = ("trace_id", "range", "measured_at", "destination")
    hops = traces.select(*keep, F.posexplode("hops").alias("pos", "_h"))
    return hops.select(*keep, "pos", *[F.col(f"_h.{f}").alias(f) for f in HOP_FIELDS])


def distinct_hop_ips(traces: DataFrame) -> DataFrame:
    """Addresses to resolve."""
    return traces.select(F.explode("hops.ip").alias("ip")).filter(F.col("ip").isNotNull()).distinct()


def hops_in_nets(hops: DataFrame, nets: DataFrame, net: str, dns: DataFrame | None = None) -> DataFrame:
    """Hops whose address lies in a target prefix, renumbered 1..n within their trace.

    Addresses are tested once each, not once per hop; `dns` answers (`ip, asn, ptr`) ride on the same
    join.  Renumbering needs the kept hops of one trace together, a bounded list.
    """
    ips = cut_lineage(hops.select("ip").filter(F.col("ip").isNotNull()).distinct().withColumn("_a", parse_ip(F.col("ip"))))
    inside = in_any_net(ips, "_a", nets, net).join(ips, "_a").select("ip")
    info = inside.withColumn("_inside", F.lit(True))
    if dns is not None:
        hops = hops.drop("asn", "ptr")
        info = info.join(dns.select("ip", "asn", "ptr"), "ip", "left")
    info = cut_lineage(info)
    kept = join_to_unique(hops.filter(F.col("ip").isNotNull()), info, ["ip"]).filter("_inside").drop("_inside")
    packed = kept.groupBy("trace_id", "range", "measured_at", "destination").agg(
        F.array_sort(F.collect_list(F.struct("pos", *[f for f in HOP_FIELDS if f != "hop"]))).alias("_hops")
    )
    out = packed.select("trace_id", "range", "measured_at", "destination", F.posexplode("_hops").alias("_i", "_h"))
    fields = [F.col(f"_h.{f}").alias(f) for f in HOP_FIELDS if f != "hop"]
    return out.select("trace_id", "range", "measured_at", "destination", (F.col("_i") + 1).alias("hop"), *fields)


def filter_renumber(hops: Column, keep) -> Column:
    """Array form of filtering and renumbering: `keep(hop)` decides."""
    kept = F.filter(hops, keep)
    return F.transform(kept, lambda h, i: h.withField("hop", i + 1))


def vote_hops(hops: DataFrame) -> DataFrame:
    """Per (range, hop) the address seen in most traces: `range, hop, ip, votes, rep`.

    Votes are counted per address first, with partial aggregation, so a hot hop is never gathered.
    Ties go to the smallest address text; `rep` is the hop of the earliest (measured_at, destination).
    """
    rep = F.struct("measured_at", "destination", "trace_id", *[f for f in HOP_FIELDS if f not in ("hop", "ip")])
    seen = hops.filter(F.col("ip").isNotNull()).groupBy("range", "hop", "ip").agg(F.count("*").alias("votes"), F.min(rep).alias("rep"))
    best = F.min(F.struct((-F.col("votes")).alias("n"), "ip", "rep"))
    winners = seen.groupBy("range", "hop").agg(best.alias("w"))
    return winners.select("range", "hop", F.col("w.ip").alias("ip"), (-F.col("w.n")).alias("votes"), F.col("w.rep").alias("rep"))


def choose_gateways(winners: DataFrame, totals: DataFrame, patterns: list[PtrPattern]) -> DataFrame:
    """Per range the last hop whose hostname parses: `range, gateway, routes, measured_at`.

    Routes stop at the gateway; without one they stay whole and the status says why.
    """
    parsed = winners.withColumn("device", parse_ptr(F.col("rep.ptr"), patterns))
    hop = F.struct("hop", "ip", *[F.col(f"rep.{f}").alias(f) for f in HOP_FIELDS if f not in ("hop", "ip")], "device", "votes")
    # One winner per hop number, so the list is as long as the longest trace.
    lists = parsed.groupBy("range").agg(
        F.array_sort(F.collect_list(hop), lambda a, b: a["hop"] - b["hop"]).alias("_hops"), F.max(F.when(F.col("device").isNotNull(), F.col("hop"))).alias("_gw")
    )
    rows = totals.join(lists, "range", "left")
    gw = F.get(F.filter("_hops", lambda h: h["hop"] == F.col("_gw")), 0)
    status = F.when(F.col("_hops").isNull(), "no_hops").when(F.col("_gw").isNull(), "no_ptr_match").otherwise("inservice")
    gateway = F.struct(
        gw["ip"].alias("ip"),
        gw["ptr"].alias("ptr"),
        F.coalesce(gw["votes"], F.lit(0).cast("bigint")).alias("votes"),
        F.col("total"),
        status.alias("status"),
        gw["device"].alias("device"),
    )
    routes = F.filter("_hops", lambda h: F.col("_gw").isNull() | (h["hop"] <= F.col("_gw")))
    routes = F.coalesce(F.transform(routes, lambda h: h.dropFields("votes")), F.array())
    return rows.select("range", gateway.alias("gateway"), routes.alias("routes"), "measured_at")


def range_totals(traces: DataFrame) -> DataFrame:
    """Trace count and earliest measurement per range."""
    return traces.groupBy("range").agg(F.count("*").alias("total"), F.min("measured_at").alias("measured_at"))
