"""Registry responses to the whois table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_text, inetnum_to_net, parse_cidr
from cidrloom.operators.dns import attach_aut_num
from cidrloom.operators.skew import join_to_unique
from cidrloom.session import cut_lineage
from cidrloom.sources.registry import origin_asn, parse_rpsl, registry_records


def _named(records: DataFrame, queried: str) -> DataFrame:
    """Network of a record: its inetnum when that is one prefix, else the prefix that was asked for."""
    return records.withColumn("net", F.coalesce(inetnum_to_net(F.col("whois.inetnum")), parse_cidr(F.col(queried))))


def whois_from_json(bodies: DataFrame, origins: DataFrame, aut_nums: DataFrame) -> DataFrame:
    """Path by prefix: record bodies (`resource, body`), origin bodies (`resource, body`), AS objects."""
    asn = origin_asn(origins, "body").groupBy("resource").agg(F.min("asn").alias("asn"))
    records = cut_lineage(join_to_unique(registry_records(bodies, "body"), asn, ["resource"]))
    named = _named(attach_aut_num(records, "asn", aut_nums), "resource")
    return named.select(cidr_text(F.col("net")).alias("network"), "net", "whois")


def whois_from_text(responses: DataFrame, aut_nums: DataFrame) -> DataFrame:
    """Path by AS number: object text (`query, asn, response`) of every announced prefix."""
    records = attach_aut_num(cut_lineage(parse_rpsl(responses, "response")), "asn", aut_nums)
    named = _named(records, "query")
    return named.select(cidr_text(F.col("net")).alias("network"), "net", "whois")


def build_whois(by_prefix: DataFrame, by_asn: DataFrame) -> DataFrame:
    """Both paths appended; repeats stay."""
    return by_prefix.unionByName(by_asn)


def parse_summary(responses: DataFrame, key: str, parsed: DataFrame) -> DataFrame:
    """Responses that gave at least one record, and those that gave none."""
    good = parsed.select(key).distinct().withColumn("_ok", F.lit(True))
    rows = join_to_unique(responses.select(key), good, [key])
    return rows.agg(F.count_if(F.col("_ok")).alias("parsed"), F.count_if(F.col("_ok").isNull()).alias("failed"))
