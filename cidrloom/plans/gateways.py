"""Traces to the gateway table.  Tables that several joins read are written once in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import parse_cidr
from cidrloom.functions.patterns import Normalizer, PtrPattern
from cidrloom.operators.match import attach_matches
from cidrloom.operators.prefix import longest_prefix_join
from cidrloom.operators.traces import choose_gateways, current_traces, explode_hops, hops_in_nets, range_totals, vote_hops
from cidrloom.session import cut_lineage

WHOIS_COLUMNS = {
    "netname": "netname",
    "descr": "descr",
    "as_num": "as_num",
    "as_name": "as_name",
    "as_descr": "as_descr",
    "inetnum": "inetnum",
    "country": "country",
    "whois_source": "source",
    "whois_last_modified": "last_modified",
}


def vote_gateways(traces: DataFrame, nets: DataFrame, dns: DataFrame | None, patterns: list[PtrPattern]) -> DataFrame:
    """`range, gateway, routes, measured_at` from traces; `nets` holds the target prefixes in `net`."""
    current = cut_lineage(current_traces(traces, nets, "net"))
    hops = hops_in_nets(explode_hops(current), nets, "net", dns)
    return choose_gateways(vote_hops(hops), range_totals(current), patterns)


def attach_whois(gateways: DataFrame, whois: DataFrame) -> DataFrame:
    """Most specific registry record whose network covers the range."""
    keyed = gateways.withColumn("_range", parse_cidr(F.col("range")))
    found = longest_prefix_join(keyed, "_range", whois.select("net", "whois"), "net").drop("_range", "net")
    return found.select("*", *[F.col(f"whois.{f}").alias(c) for c, f in WHOIS_COLUMNS.items()]).drop("whois")


def build_gateways(
    traces: DataFrame, nets: DataFrame, dns: DataFrame | None, patterns: list[PtrPattern], whois: DataFrame,
    sheet_rows: DataFrame | None = None, ptr_columns: dict[str, str] | None = None,
    normalizers: dict[str, Normalizer] | None = None,
) -> DataFrame:
    """Gateway records of all ranges that still exist."""
    records = attach_whois(cut_lineage(vote_gateways(traces, nets, dns, patterns)), whois)
    if sheet_rows is not None:
        records = attach_matches(records, sheet_rows, ptr_columns or {}, normalizers or {})
    else:
        records = records.withColumn("xlsx", F.lit(None).cast("map<string,variant>")).withColumn(
            "xlsx_matched", F.struct(F.lit(False).alias("backbone"), F.lit(False).alias("hosting"))
        )
    return records.withColumn("gateway_found", F.col("gateway.status") == "inservice")


def match_summary(records: DataFrame) -> DataFrame:
    """Ranges with at least one sheet match, and all ranges."""
    return records.agg(F.count_if(F.col("xlsx").isNotNull()).alias("matched"), F.count("*").alias("total"))
