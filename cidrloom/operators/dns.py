"""Landed DNS and registry answers joined to addresses and prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import parse_cidr, parse_ip
from cidrloom.functions.text import parse_asn
from cidrloom.operators.prefix import longest_prefix_join
from cidrloom.operators.skew import join_to_unique


def attach_answers(hops: DataFrame, answers: DataFrame) -> DataFrame:
    """Hop to its DNS answer (`ip, asn, ptr`, one row per ip)."""
    return join_to_unique(hops.drop("asn", "ptr"), answers.select("ip", "asn", "ptr"), ["ip"])


def merge_answers(origins: DataFrame, ptrs: DataFrame) -> DataFrame:
    """Addresses with an origin answer, a PTR answer, or both."""
    return origins.join(ptrs, "ip", "full")


def origin_table(origins: DataFrame) -> DataFrame:
    """One answer per announced prefix; an unreadable prefix stands for the asked address alone."""
    host = parse_ip(F.col("ip"))
    keyed = origins.withColumn("net", F.coalesce(parse_cidr(F.col("prefix")), host))
    first = keyed.groupBy("net").agg(F.min(F.struct("asn", "prefix", "country", "registry", "allocated")).alias("o"))
    return first.select("net", "o.*")


def attach_origin(ips: DataFrame, ip: str, table: DataFrame) -> DataFrame:
    """Address to the answer of the longest known prefix that covers it."""
    probed = ips.withColumn("_probe", parse_ip(F.col(ip)))
    return longest_prefix_join(probed, "_probe", table, "net").drop("_probe", "net")


def attach_as_name(origins: DataFrame, names: DataFrame) -> DataFrame:
    """One name per AS number."""
    unique = names.filter(F.col("as_name").isNotNull()).groupBy("asn").agg(F.min("as_name").alias("as_name"))
    return join_to_unique(origins, unique, ["asn"])


def attach_aut_num(whois: DataFrame, asn: str, aut_nums: DataFrame) -> DataFrame:
    """Copy AS number, name and description into the whois struct by AS number."""
    numbered = aut_nums.withColumn("_asn", parse_asn(F.col("aut_num"))).filter(F.col("_asn").isNotNull())
    one = numbered.groupBy("_asn").agg(F.min(F.struct("aut_num", "as_name", "descr")).alias("_a"))
    rows = join_to_unique(whois.withColumn("_asn", F.col(asn)), one, ["_asn"])
    found = F.col("_a").isNotNull()
    filled = F.col("whois").withField("as_num", F.when(found, F.col("_a.aut_num")).otherwise(F.col("whois.as_num")))
    filled = filled.withField("as_name", F.when(found, F.col("_a.as_name")).otherwise(F.col("whois.as_name")))
    filled = filled.withField("as_descr", F.when(found, F.col("_a.descr")).otherwise(F.col("whois.as_descr")))
    return rows.withColumn("whois", filled).drop("_asn", "_a")


def attach_server(ips: DataFrame, probe: str, delegations: DataFrame, default: str) -> DataFrame:
    """Registry server of the delegation block that covers the address, else the default."""
    found = longest_prefix_join(ips, probe, delegations.select("block", "refer"), "block", [F.col("refer")])
    return found.withColumn("server", F.coalesce("refer", F.lit(default))).drop("block", "refer")
