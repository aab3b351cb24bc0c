"""Log records and address lists joined to lookup records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.fields import ProjectedField, display_text, flatten_fields, json_path, project_record, text_of
from cidrloom.functions.ip import ip4_number, parse_ip
from cidrloom.functions.jsontext import canonical, nodes, set_member
from cidrloom.operators.asof import interval_join, record_intervals
from cidrloom.operators.prefix import longest_prefix_join
from cidrloom.plans.lookup import lookup_nets
from cidrloom.session import cut_lineage

# Fixed value: key of the lookup record inside an enriched log record.
RECORD_KEY = "mmdb"


def lookup_join(left: DataFrame, ip: str, lookup: DataFrame) -> DataFrame:
    """Left outer join of an IPv4 number column to the lookup record that covers it, as `record STRUCT`."""
    return prepared_lookup(lookup)(left, ip)


def prepared_lookup(lookup: DataFrame, shuffle: bool = False) -> Callable[[DataFrame, str], DataFrame]:
    """The join of `lookup_join` to one lookup table, cut into intervals and stored once for any number of left tables."""
    intervals = cut_lineage(record_intervals(lookup_nets(lookup), "net"))
    return lambda left, ip: interval_join(left, ip, intervals, shuffle)


def record_ip(record: Column, field: str) -> Column:
    """IPv4 number of a top-level text field, null when missing, no text, no address or IPv6."""
    return ip4_number(F.get_json_object(record, json_path(field, whole=True)))


def merge_record(record: Column, found: Column) -> Column:
    """Set the lookup record (or null) under its key; values that are no object stay as they are. All are JSON text."""
    return set_member(record, RECORD_KEY, F.coalesce(found, F.lit("null")))


def lookup_text(lookup: DataFrame) -> DataFrame:
    """Lookup records as `range, text`, canonical JSON without the range, which is not part of the exported record."""
    inner = F.struct(*[F.col(c) for c in lookup.columns if c != "range"])
    return lookup.select("range", canonical(F.to_json(inner, {"ignoreNullFields": "true"})).alias("text"))


def enrich_logs(logs: DataFrame, ip_field: str, lookup: DataFrame, shuffle: bool = False) -> DataFrame:
    """`log_id, record` with the lookup record merged in.  Records keep their type, JSON text or VARIANT.

    With `shuffle`, logs and found records are dealt by address, also where the planner would broadcast the records.
    """
    return enrich_with(logs, ip_field, prepared_lookup(lookup_text(lookup), shuffle))


def enrich_with(logs: DataFrame, ip_field: str, join: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`enrich_logs` with a lookup of `lookup_text` that `prepared_lookup` has made."""
    is_variant = logs.schema["record"].dataType.simpleString() == "variant"
    logs = logs.select("log_id", text_of(logs, "record").alias("_log")).withColumn("_ip", record_ip(F.col("_log"), ip_field))
    merged = merge_record(F.col("_log"), F.col("record.text"))
    return join(logs, "_ip").select("log_id", (F.parse_json(merged) if is_variant else merged).alias("record"))


def project_logs(enriched: DataFrame, fields: list[ProjectedField], array_sep: str = ", ") -> DataFrame:
    """Flat projected records as JSON text; a record without any listed field gives `{}`."""
    return project_record(enriched, "record", "log_id", fields, array_sep)


def query_ips(ips: DataFrame, ip: str, lookup: DataFrame) -> DataFrame:
    """Addresses to `ip, status, key, text`: leaves of the record, `(not found)` or `invalid`."""
    table = lookup_nets(lookup).select("net", "range")
    table = table.join(lookup_text(lookup), "range").select("net", F.col("text").alias("record"))
    probed = ips.select(ip).distinct().withColumn("_probe", parse_ip(F.col(ip)))
    joined = longest_prefix_join(probed, "_probe", table, "net")
    leaves = F.filter(nodes(F.col("record")), lambda n: n["type_tag"] != "object")
    found = F.transform(leaves, lambda n: F.struct(n["path"].alias("key"), display_text(n["type_tag"], n["value"]).alias("text")))
    note = F.struct(F.lit(None).cast("string").alias("key"), F.when(F.col("_probe").isNotNull(), "(not found)").alias("text"))
    status = F.when(F.col("record").isNotNull(), "found").when(F.col("_probe").isNull(), "invalid").otherwise("missing")
    rows = joined.select(ip, status.alias("status"), F.explode(F.when(F.col("record").isNotNull(), found).otherwise(F.array(note))).alias("leaf"))
    return rows.select(ip, "status", "leaf.key", "leaf.text")


def field_union(records: DataFrame, record: str, order: str) -> DataFrame:
    """Distinct paths with the type tag of their first sighting: `path, type_tag, first_seen`."""
    nodes = flatten_fields(records, record, [order])
    seen = F.struct(F.col(order).alias("record"), F.col("ord").alias("node"))
    return nodes.groupBy("path").agg(F.min(F.struct(seen.alias("at"), "type_tag")).alias("f")).select(
        "path", F.col("f.type_tag").alias("type_tag"), F.col("f.at").alias("first_seen")
    )


def schema_union(log_fields: DataFrame, lookup_fields: DataFrame) -> DataFrame:
    """Log fields first, then lookup fields under their key that logs do not have: `path, type_tag, part`."""
    nested = lookup_fields.withColumn("path", F.concat(F.lit(RECORD_KEY + "."), "path"))
    both = log_fields.withColumn("part", F.lit(0)).unionByName(nested.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("path").agg(F.min(F.struct("part", "type_tag")).alias("f")).select("path", "f.type_tag", "f.part")


def discover_fields(enriched: DataFrame, lookup_records: DataFrame) -> DataFrame:
    """All fields of enriched logs (`log_id, record`) and lookup records (`record_id, record`)."""
    return schema_union(
        field_union(enriched, "record", "log_id").select("path", "type_tag"),
        field_union(lookup_records, "record", "record_id").select("path", "type_tag"),
    )
