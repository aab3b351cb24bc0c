"""Gateway table to lookup records and to the table form of the lookup tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import parse_cidr
from cidrloom.functions.text import continent_of, parse_asn
from cidrloom.operators.prefix import disjoint_intervals, one_per_net

GATEWAY_DEVICE_FIELDS = ("device", "device_role", "facility", "interface", "facing")


def operational(row: Column) -> Column:
    """Sheet row as `struct<filename, sheetname, fields VARIANT>` without its source; null when it is no object."""
    # `_source` is one of the top-level keys; the rest is rebuilt from the others.
    entries = F.from_json(F.to_json(row), "map<string,variant>")
    fields = F.parse_json(F.to_json(F.map_filter(entries, lambda k, _: k != "_source")))

    def text(key: str) -> Column:
        v = F.try_variant_get(row, f"$._source.{key}", "variant")
        return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(row, f"$._source.{key}", "string")), F.lit(""))

    value = F.struct(text("file").alias("filename"), text("sheet").alias("sheetname"), fields.alias("fields"))
    return F.when(F.schema_of_variant(row).startswith("OBJECT"), value)


def build_lookup(gateways: DataFrame) -> DataFrame:
    """One lookup record per gateway record: a single projection."""
    g = F.col("gateway")
    has_whois = F.coalesce("inetnum", "netname", "descr", "whois_source", "whois_last_modified").isNotNull()
    whois = F.struct("inetnum", "netname", "descr", F.col("whois_source").alias("source"), F.col("whois_last_modified").alias("last_modified"))
    has_gateway = g["ip"].isNotNull() | g["ptr"].isNotNull() | g["device"].isNotNull()
    gateway = F.struct(g["ip"].alias("ip"), g["ptr"].alias("ptr"), *[g["device"][f].alias(f) for f in GATEWAY_DEVICE_FIELDS])
    sheets = F.map_filter(F.transform_values("xlsx", lambda _, row: operational(row)), lambda _, v: v.isNotNull())
    keys = F.coalesce(F.map_keys("xlsx"), F.array().cast("array<string>"))
    continent = continent_of(F.col("country"))
    return gateways.select(
        "range",
        F.when(continent.isNotNull(), F.struct(continent.alias("code"))).alias("continent"),
        F.when(F.col("country").isNotNull(), F.struct(F.col("country").alias("iso_code"))).alias("country"),
        parse_asn(F.col("as_num")).alias("autonomous_system_number"),
        F.col("as_name").alias("autonomous_system_organization"),
        F.when(has_whois, whois).alias("whois"),
        F.when(has_gateway, gateway).alias("gateway"),
        F.when(F.size(sheets) > 0, sheets).alias("xlsx"),
        F.struct(F.array_contains(keys, "backbone").alias("backbone"), F.array_contains(keys, "hosting").alias("hosting")).alias("xlsx_matched"),
        (g["status"] == "inservice").alias("gateway_found"),
    )


def build_statistics(gateways: DataFrame) -> DataFrame:
    """Counts from the stored flags."""
    matched = F.col("xlsx_matched.backbone") | F.col("xlsx_matched.hosting")
    return gateways.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("gateway_found")).alias("inservice"),
        F.count_if(matched).alias("xlsx_matched"),
        F.count_if(~matched).alias("no_xlsx"),
    )


def lookup_nets(lookup: DataFrame) -> DataFrame:
    """IPv4 lookup records with their prefix in `net`; one per network."""
    keyed = lookup.withColumn("net", parse_cidr(F.col("range"))).filter(F.col("net.family") == 4)
    return one_per_net(keyed, "net").drop("match")


def lookup_intervals(lookup: DataFrame) -> DataFrame:
    """Disjoint address ranges `lo, hi, range`, written sorted by `lo` for repeated use."""
    nets = lookup_nets(lookup)
    spans = disjoint_intervals(nets, "net")
    keyed = one_per_net(nets.select("net", "range"), "net").select("match", "range")
    return spans.join(keyed, "match").select("lo", "hi", "range")
