"""Trace aggregation: filters, votes, gateways, targets."""

from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_text, parse_cidr, parse_ip
from cidrloom.operators import traces as T
from cidrloom.operators.dns import attach_answers

from cidrloom.plans.lookup import build_statistics
from cidrloom.plans.registry import parse_summary
from cidrloom.sources.registry import parse_rpsl
from cidrloom.sources.traces import parse_trace_docs
from workload import inputs
from workload.q_text import PATTERNS, duck_ptr
from workload.registry import query
from workload.shapes import ip4, oracle, shape


@query("a1_aggregate_probes", oracle(f"""
    SELECT x.trace_id, x.ttl AS hop, {ip4('h.ip')} AS ip_or_dots, r.rtt_avg, r.rtt_best, r.rtt_worst, r.icmp_type
    FROM (SELECT t.trace_id, CAST(unnest(range(1, 1 + t.deepest)) AS BIGINT) AS ttl FROM (SELECT trace_id, max(ttl) AS deepest FROM z_replies GROUP BY 1) t) x
    LEFT JOIN z_hops h ON h.trace_id = x.trace_id AND h.ttl = x.ttl
    LEFT JOIN (SELECT trace_id, ttl, avg(rtt) AS rtt_avg, min(rtt) AS rtt_best, max(rtt) AS rtt_worst,
                      CAST(first(icmp_type ORDER BY l_partkey, l_suppkey, rtt NULLS FIRST) FILTER (WHERE icmp_type IS NOT NULL) AS BIGINT) AS icmp_type FROM z_replies GROUP BY 1, 2) r
           ON r.trace_id = x.trace_id AND r.ttl = x.ttl"""))
def aggregate_probes(spark, d):
    hops = parse_trace_docs(inputs.probe_docs(spark, d), "doc").select("trace_id", F.explode("trace.hops").alias("h"))
    return hops.select("trace_id", F.col("h.hop").cast("bigint").alias("hop"), F.coalesce("h.ip", F.lit("...")).alias("ip_or_dots"), "h.rtt_avg", "h.rtt_best", "h.rtt_worst", F.col("h.icmp_type").cast("bigint").alias("icmp_type"))


@query("f1_current_traces", oracle("SELECT trace_id, range FROM z_traces WHERE plen <= 28"))
def current_traces(spark, d):
    # The registry no longer lists the prefixes longer than /28.
    nets = inputs.targets(spark, d).filter(F.col("net.plen") <= 28)
    return T.current_traces(inputs.traces(spark, d), nets, "net").select("trace_id", "range")


@query("f2_hops_in_nets", oracle(f"SELECT trace_id, ttl, {ip4('h.ip')} AS ip FROM z_hops h JOIN z_inside i ON i.ip = h.ip"))
def hops_in_nets(spark, d):
    hops = T.explode_hops(inputs.traces(spark, d)).withColumn("rtt_avg", F.col("hop").cast("double"))
    kept = T.hops_in_nets(hops, inputs.targets(spark, d), "net")
    return kept.select("trace_id", F.col("rtt_avg").cast("bigint").alias("ttl"), "ip")


@query("w1_renumber_hops", oracle(f"SELECT trace_id, hop, {ip4('ip')} AS ip FROM z_kept"))
def renumber_hops(spark, d):
    kept = T.hops_in_nets(T.explode_hops(inputs.traces(spark, d)), inputs.targets(spark, d), "net")
    return kept.select("trace_id", F.col("hop").cast("bigint").alias("hop"), "ip")


@query("w1_renumber_array", oracle(f"""
    SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY ttl) AS BIGINT) AS hop, {ip4('ip')} AS ip FROM z_hops"""))
def renumber_array(spark, d):
    rows = inputs.traces(spark, d).select("trace_id", F.explode(T.filter_renumber(F.col("hops"), lambda h: h["ip"].isNotNull())).alias("h"))
    return rows.select("trace_id", F.col("h.hop").cast("bigint").alias("hop"), "h.ip")


def kept_hops(spark, d):
    return inputs.once(spark, d, "kept", lambda: T.hops_in_nets(T.explode_hops(inputs.traces(spark, d)), inputs.targets(spark, d), "net", inputs.dns(spark, d)))


@query("a2_vote_hops", oracle(f"""
    SELECT v.range, v.hop, {ip4('v.ip')} AS ip, v.votes, min(k.measured_at) AS first_seen FROM z_votes v JOIN z_kept k ON k.range = v.range AND k.hop = v.hop AND k.ip = v.ip GROUP BY ALL"""))
def vote_hops(spark, d):
    rows = T.vote_hops(kept_hops(spark, d))
    return rows.select("range", F.col("hop").cast("bigint").alias("hop"), "ip", "votes", F.col("rep.measured_at").alias("first_seen"))


_G = duck_ptr("ptr")
GW_CTES = {
    "parsed": f"SELECT v.range, v.hop, v.ip, v.votes, x.ptr, {', '.join(f'{_G[c]} AS {c}' for c in ('interface', 'device', 'device_role', 'facility', 'facing', 'customer_asn', 'matched'))} FROM z_votes v LEFT JOIN z_dns x ON x.ip = v.ip",
    "best": "SELECT range, max(hop) FILTER (WHERE matched) AS gw, CAST(count(*) AS BIGINT) AS hops FROM parsed GROUP BY range",
    "totals": "SELECT range, any_value(net) AS net, any_value(plen) AS plen, any_value(size) AS size, count(*) AS total, min(measured_at) AS measured_at FROM z_traces GROUP BY range",
    "gws": f"""SELECT t.range, t.net, t.plen, t.size, CASE WHEN b.gw IS NOT NULL THEN {ip4('p.ip')} END AS ip, p.ptr, coalesce(p.votes, 0) AS votes, t.total, t.measured_at,
               CASE WHEN b.range IS NULL THEN 'no_hops' WHEN b.gw IS NULL THEN 'no_ptr_match' ELSE 'inservice' END AS status,
               p.interface, p.device, p.device_role, p.facility, p.facing, p.customer_asn,
               coalesce((SELECT count(*) FROM parsed q WHERE q.range = t.range AND (b.gw IS NULL OR q.hop <= b.gw)), 0) AS routes
               FROM totals t LEFT JOIN best b ON b.range = t.range LEFT JOIN parsed p ON p.range = b.range AND p.hop = b.gw""",
}
GW_COLUMNS = "range, ip, ptr, votes, total, status, interface, device, device_role, facility, facing, customer_asn, routes, measured_at"


def flat_gateways(records):
    g = F.col("gateway")
    return records.select("range", g["ip"].alias("ip"), g["ptr"].alias("ptr"), g["votes"].alias("votes"), g["total"].alias("total"), g["status"].alias("status"),
                          *[g["device"][c].alias(c) for c in ("interface", "device", "device_role", "facility", "facing", "customer_asn")],
                          F.size("routes").cast("bigint").alias("routes"), "measured_at")


@query("a3_choose_gateways", oracle(f"SELECT {GW_COLUMNS} FROM gws", **GW_CTES))
def choose_gateways(spark, d):
    return flat_gateways(T.choose_gateways(T.vote_hops(kept_hops(spark, d)), T.range_totals(inputs.traces(spark, d)), PATTERNS))


@query("a4_range_totals", oracle("SELECT range, CAST(count(*) AS BIGINT) AS total, min(measured_at) AS measured_at FROM z_traces GROUP BY range"))
def range_totals(spark, d):
    return T.range_totals(inputs.traces(spark, d))


@query("a5_distinct_hop_ips", oracle(f"SELECT DISTINCT {ip4('ip')} AS ip FROM z_hops"))
def distinct_hop_ips(spark, d):
    return T.distinct_hop_ips(inputs.traces(spark, d))


@query("a7_build_statistics", oracle("""
    SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE trace_id % 3 = 0) AS BIGINT) AS inservice, CAST(count(*) FILTER (WHERE trace_id % 2 = 0) AS BIGINT) AS xlsx_matched,
           CAST(count(*) FILTER (WHERE trace_id % 2 <> 0) AS BIGINT) AS no_xlsx FROM z_traces"""))
def build_stats(spark, d):
    rows = shape(spark, d, "z_traces").select((F.col("trace_id") % 3 == 0).alias("gateway_found"), F.struct((F.col("trace_id") % 4 == 0).alias("backbone"), (F.col("trace_id") % 4 == 2).alias("hosting")).alias("xlsx_matched"))
    return build_statistics(rows)


@query("a14_parse_summary", oracle("SELECT CAST(count(*) FILTER (WHERE k % 3 <> 0) AS BIGINT) AS parsed, CAST(count(*) FILTER (WHERE k % 3 = 0) AS BIGINT) AS failed FROM z_rpsl"))
def parse_counts(spark, d):
    responses = shape(spark, d, "z_rpsl").select("k", F.when(F.col("k") % 3 == 0, "% none").otherwise(F.col("response")).alias("response"))
    return parse_summary(responses, "k", parse_rpsl(responses, "response"))


@query("u1_ordered_union", oracle("""
    SELECT network, CAST(part AS BIGINT) AS part, pos FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY part, pos) AS rn
        FROM (SELECT network, 0 AS part, k AS pos FROM z_whois_all UNION ALL SELECT network, 1, row_index FROM z_sheet) t) u WHERE rn = 1"""))
def ordered_union(spark, d):
    first = shape(spark, d, "z_whois_all").select(parse_cidr(F.col("network")).alias("net"), F.col("k").alias("ord"))
    second = shape(spark, d, "z_sheet").select(parse_cidr(F.col("network")).alias("net"), F.col("row_index").alias("ord"))
    out = T.ordered_union(first, second, "net", "ord")
    return out.select(cidr_text(F.col("net")).alias("network"), F.col("ord.part").cast("bigint").alias("part"), F.col("ord.pos").alias("pos"))


TARGET_SQL = """SELECT network, net, plen, size, unnest(CASE WHEN plen = 32 THEN [net] WHEN plen = 31 THEN [net, net + 1] WHEN plen >= 29 THEN range(net + 1, net + size - 1)
                ELSE [net + 1, net + 2, net + 3, net + 4, net + size - 4, net + size - 3, net + size - 2] END) AS ip FROM z_targets"""


@query("j_done_remaining_targets", oracle("SELECT network, ip FROM tg WHERE NOT EXISTS (SELECT 1 FROM z_traces t WHERE t.range = tg.network AND t.dest = tg.ip)", tg=TARGET_SQL))
def remaining_targets(spark, d):
    planned = T.expand_targets(inputs.targets(spark, d), "net")
    return T.remaining_targets(planned, "net", "ip", inputs.traces(spark, d)).select(cidr_text(F.col("net")).alias("network"), "ip")


@query("u3_except_traced", oracle("SELECT DISTINCT ip FROM tg WHERE ip NOT IN (SELECT dest FROM z_traces)", tg=TARGET_SQL))
def except_traced(spark, d):
    planned = T.expand_targets(inputs.targets(spark, d), "net").select("ip").distinct()
    done = inputs.traces(spark, d).select(parse_ip(F.col("destination"))["lo"].alias("ip"))
    return planned.join(done, "ip", "left_anti")


@query("j_parent_prefix", oracle("""
    SELECT t.trace_id, p.network AS parent FROM z_traces t JOIN (SELECT ip, network, row_number() OVER (PARTITION BY ip ORDER BY plen DESC, net) AS rn FROM tg) p ON p.ip = t.dest AND p.rn = 1""", tg=TARGET_SQL))
def parent_prefix(spark, d):
    planned = T.expand_targets(inputs.targets(spark, d), "net")
    dests = inputs.traces(spark, d).select("trace_id", parse_ip(F.col("destination"))["lo"].alias("ip"))
    return T.parent_prefix(dests, "ip", planned, "net").select("trace_id", cidr_text(F.col("parent")).alias("parent"))


@query("j_dns_attach", oracle("""
    SELECT h.trace_id, h.ttl, CAST(x.asn AS BIGINT) AS asn, x.ptr FROM z_hops h LEFT JOIN z_dns x ON x.ip = h.ip"""))
def dns_attach(spark, d):
    hops = T.explode_hops(inputs.traces(spark, d)).filter(F.col("ip").isNotNull())
    return attach_answers(hops, inputs.dns(spark, d)).select("trace_id", F.col("hop").cast("bigint").alias("ttl"), "asn", "ptr")


@query("w5_sort_by_cidr", oracle("SELECT range, CAST(count(*) AS BIGINT) AS total, any_value(net) AS net, any_value(plen) AS plen FROM z_traces GROUP BY range"))
def sort_by_cidr(spark, d):
    from cidrloom.functions.ip import cidr_order

    totals = inputs.traces(spark, d).groupBy("range").agg(F.count("*").alias("total")).orderBy(*cidr_order(F.col("range")))
    c = parse_cidr(F.col("range"))
    return totals.withColumn("c", c).select("range", "total", F.col("c.lo").alias("net"), F.col("c.plen").cast("bigint").alias("plen"))
