"""Raw trace documents to traces.  A document is one row, and all replies of a batch of rows are summed up at once (`probes`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.text import epoch_to_iso
from cidrloom.sources import schemas
from cidrloom.sources.probes import hops_column


def aggregate_probes(probes: Column) -> Column:
    """Replies `addr, probe_ttl, rtt, icmp_type` of one trace to hops 1..max TTL.

    Per TTL: most frequent address (ties by smallest text), average, best and worst round trip, first
    ICMP type.  A TTL without replies gives a hop of nulls.
    """
    # Not taken for deterministic, or filters on the hops would be moved below the parsing and repeat all of it.
    return F.arrow_udf(hops_column, f"array<{schemas.HOP}>").asNondeterministic()(probes)


def parse_trace_docs(df: DataFrame, doc: str) -> DataFrame:
    """Documents to `kind, trace`: a trace struct for valid traces, else only the kind of the document.

    Empty and invalid documents give no row; a document without type is `unknown`.
    """
    keep = [c for c in df.columns if c != doc]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = df.withColumn("_v", F.try_parse_json(F.trim(doc)))
    kind = F.try_variant_get("_v", "$.type", "variant")
    kind = F.when(F.schema_of_variant(kind) == "STRING", F.try_variant_get("_v", "$.type", "string"))
    rows = rows.withColumn("kind", F.coalesce(kind, F.lit("unknown")))
    rows = rows.withColumn("_d", F.when(F.col("kind") == "trace", F.from_json(doc, schemas.TRACE_DOC + ", _corrupt string", options)))
    d = F.col("_d")
    probes = F.coalesce(d["hops"], F.array().cast(f"array<{schemas.PROBE}>"))
    # Value ranges of the source: seconds are not negative, a TTL is one byte of a header, and so is an ICMP type.
    in_range = (d["start"]["sec"] >= 0) & ~F.exists(probes, lambda h: ~h["probe_ttl"].between(0, 255) | ~F.coalesce(h["icmp_type"].between(0, 255), F.lit(True)))
    complete = (
        d["_corrupt"].isNull()
        & d["src"].isNotNull()
        & d["dst"].isNotNull()
        & d["stop_reason"].isNotNull()
        & d["start"]["sec"].isNotNull()
        & ~F.exists(probes, lambda h: h["probe_ttl"].isNull())
        & F.coalesce(in_range, F.lit(False))
    )
    route = F.struct(
        F.coalesce(d["version"], F.lit("unknown")).alias("version"),
        epoch_to_iso(d["start"]["sec"]).alias("measured_at"),
        d["src"].alias("source"),
        d["dst"].alias("destination"),
        d["stop_reason"].alias("stop_reason"),
        aggregate_probes(F.when(in_range, probes)).alias("hops"),
    )
    # Documents that are no JSON go last: a filter in front would parse every document twice.
    return rows.select(*keep, "kind", F.when(complete, route).alias("trace"), F.col("_v").isNotNull().alias("_json")).filter("_json").drop("_json")
