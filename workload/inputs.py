"""Tables in the library's own layouts, built from the shapes once per session."""

from pyspark.sql import functions as F

from cidrloom.functions.ip import parse_cidr
from cidrloom.functions.patterns import INTERFACE_NORMALIZER, Normalizer
from cidrloom.plans.gateways import build_gateways, vote_gateways
from cidrloom.plans.lookup import build_lookup
from cidrloom.session import staging_path
from cidrloom.sources.readers import parse_sheet_lines
from cidrloom.sources.traces import parse_trace_docs
from workload.q_text import PATTERNS
from workload.shapes import ip4, run, shape, staged

PTR_COLUMNS = {"host": "device", "port": "interface"}
NORMALIZERS = {"device": Normalizer(), "interface": INTERFACE_NORMALIZER}

_BUILT: dict[tuple[str, str, str], str] = {}


def once(spark, d, name, make):
    """Write `make()` as Parquet the first time, then read it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        path = staging_path(spark, name)
        make().write.parquet(path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def probe_docs(spark, d):
    """`trace_id, range, doc`: one valid JSON document per order with its replies as probes."""
    addr = F.when(F.col("ip").isNotNull(), F.expr(ip4("ip").replace("//", "div")))
    probe = F.struct("ttl", "l_partkey", "l_suppkey", "rtt", "icmp_type", addr.alias("addr"))
    hops = shape(spark, d, "z_replies").groupBy("trace_id").agg(F.array_sort(F.collect_list(probe)).alias("r"))
    rows = shape(spark, d, "z_traces").join(hops, "trace_id", "left")
    probes = F.transform(F.coalesce("r", F.array()), lambda p: F.struct(p["addr"].alias("addr"), p["ttl"].alias("probe_ttl"), p["rtt"].alias("rtt"), p["icmp_type"].alias("icmp_type")))
    doc = F.struct(F.lit("trace").alias("type"), F.col("source").alias("src"), F.col("destination").alias("dst"), "stop_reason",
                   F.struct(F.unix_timestamp("measured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sec")).alias("start"), probes.alias("hops"))
    return rows.select("trace_id", "range", F.to_json(doc).alias("doc"))


def traces(spark, d):
    return once(spark, d, "traces", lambda: parse_trace_docs(probe_docs(spark, d), "doc").select("trace_id", "range", "trace.*"))


def targets(spark, d):
    return once(spark, d, "targets", lambda: run(spark, d, "SELECT network FROM z_targets").select("network", parse_cidr(F.col("network")).alias("net")))


def dns(spark, d):
    return staged(spark, d, "z_dns").select(F.col("ip_text").alias("ip"), F.col("asn").cast("bigint").alias("asn"), "ptr")


def whois(spark, d):
    struct = F.struct(F.col("network").alias("inetnum"), "netname", "descr", "country", F.lit("TEST").alias("source"), F.lit(None).cast("string").alias("last_modified"),
                      "as_num", "as_name", F.lit(None).cast("string").alias("as_descr"))
    return once(spark, d, "whois", lambda: shape(spark, d, "z_whois").select("network", parse_cidr(F.col("network")).alias("net"), struct.alias("whois")))


def sheet_rows(spark, d):
    """Sheet rows in (file, sheet, row) order."""
    lines = staged(spark, d, "z_sheet_lines").select(F.col("line").alias("value"), F.lit(0).alias("line_ord"))
    return parse_sheet_lines(lines)


def voted(spark, d):
    return once(spark, d, "voted", lambda: vote_gateways(traces(spark, d), targets(spark, d), dns(spark, d), PATTERNS))


def gateways(spark, d):
    return once(spark, d, "gateways", lambda: build_gateways(
        traces(spark, d), targets(spark, d), dns(spark, d), PATTERNS, whois(spark, d), sheet_rows(spark, d), PTR_COLUMNS, NORMALIZERS))


def lookup(spark, d):
    return once(spark, d, "lookup", lambda: build_lookup(gateways(spark, d)))
