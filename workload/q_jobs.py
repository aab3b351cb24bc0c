"""End-to-end jobs."""

from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_text, parse_cidr
from cidrloom.functions.jsontext import canonical
from cidrloom.plans import enrich as E
from cidrloom.plans.gateways import build_gateways
from cidrloom.plans.lookup import build_lookup, lookup_intervals
from cidrloom.plans.registry import build_whois, whois_from_json, whois_from_text
from cidrloom.plans.reports import duplicate_report, hostname_coverage, onboarding_report
from cidrloom.plans.sheets import build_sheet_table
from cidrloom.plans.targets import plan_targets
from cidrloom.operators.conflicts import group_table
from cidrloom.session import staging_path
from cidrloom.sources.registry import aut_num_from_json
from cidrloom.streaming.flows import enrich_stream
from workload import inputs
from workload.q_graph import PATHS
from workload.q_joins import ATTACHED, DUP_SELECT, DUPLICATES, GROUPS, RANGE_WHOIS, UNMATCHED
from workload.q_sources import AUT_JSON, CONFIG, ORIGIN_JSON, RECORD_JSON, TYPED
from workload.q_text import CONTINENTS, NAMES, PATTERNS
from workload.q_traces import GW_COLUMNS
from workload.registry import query
from workload.shapes import ip4, oracle, run, shape, staged

AUTS = "SELECT n, concat('AS', 64496 + n) AS as_num, concat('NET-', n_name) AS as_name FROM z_nation WHERE n % 6 <> 0"


@query("j1_whois_from_json", oracle("""
    SELECT r.network, r.netname, a.as_num, a.as_name FROM (
        SELECT k, network, c_name AS netname, c_nationkey FROM z_nets UNION ALL SELECT k, '2001:db8::/32', 'V6', c_nationkey FROM z_nets WHERE k % 2 = 0) r
    LEFT JOIN a ON a.n = r.c_nationkey % 16 AND r.k % 5 <> 0""", a=AUTS))
def j1_json(spark, d):
    bodies = run(spark, d, f"SELECT CAST(k AS STRING) AS resource, body FROM ({RECORD_JSON}) t")
    origins = run(spark, d, f"SELECT CAST(k AS STRING) AS resource, body FROM ({ORIGIN_JSON}) t")
    out = whois_from_json(bodies, origins, aut_num_from_json(run(spark, d, AUT_JSON), "body"))
    return out.select("network", "whois.netname", "whois.as_num", "whois.as_name")


@query("j1_whois_from_text", oracle("""
    SELECT r.network, r.netname, a.as_num, a.as_name FROM (
        SELECT network, c_name AS netname, c_nationkey FROM z_nets WHERE k % 11 <> 0
        UNION ALL SELECT CASE WHEN k % 1000 = 0 THEN '2001:db8::/48' ELSE concat('2001:db8:', k % 1000, '::/48') END, concat('V6-', k), c_nationkey FROM z_nets) r
    LEFT JOIN a ON a.n = r.c_nationkey % 16""", a=AUTS))
def j1_text(spark, d):
    responses = run(spark, d, "SELECT network AS query, CAST(asn AS BIGINT) AS asn, response FROM z_rpsl")
    out = whois_from_text(responses, aut_num_from_json(run(spark, d, AUT_JSON), "body"))
    return out.select("network", "whois.netname", "whois.as_num", "whois.as_name")


@query("u2_union_of_paths", oracle("""
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT network) AS BIGINT) AS networks FROM (
        SELECT network FROM z_nets UNION ALL SELECT '2001:db8::/32' FROM z_nets WHERE k % 2 = 0 UNION ALL SELECT network FROM z_nets WHERE k % 11 <> 0
        UNION ALL SELECT CASE WHEN k % 1000 = 0 THEN '2001:db8::/48' ELSE concat('2001:db8:', k % 1000, '::/48') END FROM z_nets) t"""))
def union_of_paths(spark, d):
    auts = aut_num_from_json(run(spark, d, AUT_JSON), "body")
    bodies = run(spark, d, f"SELECT CAST(k AS STRING) AS resource, body FROM ({RECORD_JSON}) t")
    origins = run(spark, d, f"SELECT CAST(k AS STRING) AS resource, body FROM ({ORIGIN_JSON}) t")
    responses = run(spark, d, "SELECT network AS query, CAST(asn AS BIGINT) AS asn, response FROM z_rpsl")
    both = build_whois(whois_from_json(bodies, origins, auts), whois_from_text(responses, auts))
    return both.groupBy("network").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("networks"))


@query("j2_sheet_table", oracle("""
    SELECT 'backbone' AS sheettype, CAST(count(DISTINCT (file, sheet)) AS BIGINT) AS sheets, CAST(count(*) AS BIGINT) AS rows FROM t
    WHERE NOT skipped AND EXISTS (SELECT 1 FROM z_targets n WHERE n.plen >= 24 AND ((n.net <= t.x AND t.x < n.net + n.size) OR (n.net <= t.y AND t.y < n.net + n.size)))""",
    t=TYPED.replace("p_partkey,\n", "p_partkey, 3325256704 + (p_partkey * 7919) % 65536 AS x, 3325256704 + (p_partkey * 104729) % 65536 AS y,\n")))
def j2_sheets(spark, d):
    nets = inputs.targets(spark, d).filter(F.col("net.plen") >= 24)
    return build_sheet_table(staged(spark, d, "z_cells"), CONFIG, GROUPS, nets).statistics


@query("j3_plan_targets", oracle("""
    SELECT network, ip FROM (SELECT network, net, plen, size, unnest(CASE WHEN plen = 32 THEN [net] WHEN plen = 31 THEN [net, net + 1] WHEN plen >= 29 THEN range(net + 1, net + size - 1)
           ELSE [net + 1, net + 2, net + 3, net + 4, net + size - 4, net + size - 3, net + size - 2] END) AS ip FROM u) tg
    WHERE NOT EXISTS (SELECT 1 FROM z_traces t WHERE t.range = tg.network AND t.dest = tg.ip)""",
    u="SELECT network, net, CAST(plen AS BIGINT) AS plen, size FROM z_whois UNION SELECT network, net, plen, CAST(pow(2, 32 - plen) AS BIGINT) FROM z_sheet"))
def j3_targets(spark, d):
    whois = shape(spark, d, "z_whois").select(parse_cidr(F.col("network")).alias("net"), F.col("k").alias("ord"))
    sheet = shape(spark, d, "z_sheet").select(parse_cidr(F.col("network")).alias("net"), F.col("row_index").alias("ord"))
    return plan_targets(whois, sheet, inputs.traces(spark, d)).select(cidr_text(F.col("net")).alias("network"), "ip")


FULL = {**ATTACHED, "rw": RANGE_WHOIS}


@query("j4_gateway_table", oracle(f"""
    SELECT {', '.join('g.' + c for c in GW_COLUMNS.split(', '))}, w.netname, w.country, w.as_num, w.as_name, w.wnet AS inetnum, a.bsheet AS backbone_sheet, a.brow AS backbone_row, a.hrow AS hosting_row,
           a.brow IS NOT NULL AS backbone, a.hrow IS NOT NULL AS hosting, g.status = 'inservice' AS gateway_found
    FROM gws g LEFT JOIN rw w ON w.network = g.range JOIN attached a ON a.range = g.range""", **FULL))
def j4_gateways(spark, d):
    rows = build_gateways(inputs.traces(spark, d), inputs.targets(spark, d), inputs.dns(spark, d), PATTERNS, inputs.whois(spark, d), inputs.sheet_rows(spark, d), inputs.PTR_COLUMNS, inputs.NORMALIZERS)
    def get(kind, p, t):
        return F.variant_get(F.try_element_at("xlsx", F.lit(kind)), f"$._source.{p}", t)
    flat = rows.withColumns({"backbone_sheet": get("backbone", "sheet", "string"), "backbone_row": get("backbone", "row_index", "bigint"), "hosting_row": get("hosting", "row_index", "bigint"),
                             "backbone": F.col("xlsx_matched.backbone"), "hosting": F.col("xlsx_matched.hosting")})
    extra = ["netname", "country", "as_num", "as_name", "inetnum", "backbone_sheet", "backbone_row", "hosting_row", "backbone", "hosting", "gateway_found"]
    g = F.col("gateway")
    return flat.select("range", g["ip"].alias("ip"), g["ptr"].alias("ptr"), g["votes"].alias("votes"), g["total"].alias("total"), g["status"].alias("status"),
                       *[g["device"][c].alias(c) for c in ("interface", "device", "device_role", "facility", "facing", "customer_asn")], F.size("routes").cast("bigint").alias("routes"), "measured_at", *extra)


@query("j5_lookup_records", oracle("""
    SELECT g.range, c.continent, w.country, CAST(substr(w.as_num, 3) AS BIGINT) AS asn, w.as_name AS org, w.netname, g.ip, g.device, s.site, a.brow IS NOT NULL AS backbone, a.hrow IS NOT NULL AS hosting, g.status = 'inservice' AS gateway_found
    FROM gws g LEFT JOIN rw w ON w.network = g.range LEFT JOIN conts c ON c.cc = w.country JOIN attached a ON a.range = g.range
    LEFT JOIN z_sheet s ON s.sheettype = 'backbone' AND s.file = a.bfile AND s.sheet = a.bsheet AND s.row_index = a.brow""", **FULL, conts=CONTINENTS))
def j5_lookup(spark, d):
    rows = build_lookup(inputs.gateways(spark, d))
    site = F.variant_get(F.try_element_at("xlsx", F.lit("backbone"))["fields"], "$.site", "string")
    return rows.select("range", F.col("continent.code").alias("continent"), F.col("country.iso_code").alias("country"), F.col("autonomous_system_number").alias("asn"), F.col("autonomous_system_organization").alias("org"),
                       "whois.netname", "gateway.ip", "gateway.device", site.alias("site"), F.col("xlsx_matched.backbone").alias("backbone"), F.col("xlsx_matched.hosting").alias("hosting"), "gateway_found")


IP_RANGE = {
    **FULL,
    "ips": "SELECT event_id, ip FROM z_log_ips WHERE event_id % 17 <> 0 AND event_id % 19 <> 0",
    "hit": "SELECT ip, range FROM (SELECT i.ip, g.range, row_number() OVER (PARTITION BY i.ip ORDER BY g.plen DESC) AS rn FROM (SELECT DISTINCT ip FROM z_log_ips) i JOIN gws g ON g.net <= i.ip AND i.ip < g.net + g.size) t WHERE rn = 1",
}
ENRICHED_SQL = oracle("""
    SELECT e.event_id AS log_id, e.event_type AS type, h.range IS NOT NULL AS found, w.netname, w.country, g.status = 'inservice' AS gateway_found, g.ip AS gateway_ip
    FROM z_log_ips e LEFT JOIN ips i ON i.event_id = e.event_id LEFT JOIN hit h ON h.ip = i.ip LEFT JOIN gws g ON g.range = h.range LEFT JOIN rw w ON w.network = h.range""", **IP_RANGE)


def log_records(spark, d):
    return shape(spark, d, "z_logs").select(F.col("event_id").alias("log_id"), canonical(F.col("line")).alias("record"))


def _enriched(rows):
    rows = rows.withColumn("record", F.parse_json("record"))
    get = lambda p, t: F.try_variant_get("record", p, t)
    found = F.schema_of_variant(get("$.mmdb", "variant")) != "VOID"
    return rows.select("log_id", get("$.type", "string").alias("type"), found.alias("found"), get("$.mmdb.whois.netname", "string").alias("netname"), get("$.mmdb.country.iso_code", "string").alias("country"),
                       get("$.mmdb.gateway_found", "boolean").alias("gateway_found"), get("$.mmdb.gateway.ip", "string").alias("gateway_ip"))


@query("j6_enrich_logs", ENRICHED_SQL)
def j6_enrich(spark, d):
    return _enriched(E.enrich_logs(log_records(spark, d), "ip", inputs.lookup(spark, d)))


@query("j6_enrich_logs_shuffle", ENRICHED_SQL)
def j6_enrich_shuffle(spark, d):
    return _enriched(E.enrich_logs(log_records(spark, d), "ip", inputs.lookup(spark, d), shuffle=True))


@query("j6_enrich_stream", ENRICHED_SQL)
def j6_stream(spark, d):
    source, sink = staging_path(spark, "log-source"), staging_path(spark, "log-sink")
    run(spark, d, "SELECT event_id AS log_id, line FROM z_logs").write.parquet(source)
    logs = spark.readStream.schema("log_id bigint, line string").parquet(source).select("log_id", canonical(F.col("line")).alias("record"))
    enrich_stream(logs, "ip", inputs.lookup(spark, d), sink, staging_path(spark, "log-checkpoint"), every=None).awaitTermination()
    return _enriched(spark.read.parquet(sink))


@query("j7_lookup_intervals", oracle("""
    SELECT range, CAST(count(*) AS BIGINT) AS addresses, min(ip) AS lowest, max(ip) AS highest, CAST(sum(ip % 65521) AS BIGINT) AS mixed FROM (
        SELECT a.ip, g.range, row_number() OVER (PARTITION BY a.ip ORDER BY g.plen DESC) AS rn
        FROM (SELECT ip, CAST(unnest(range(20, 33)) AS BIGINT) AS plen FROM (SELECT CAST(unnest(range(3325256704 - 4096, 3325256704 + 65536 + 4096)) AS BIGINT) AS ip) x) a
        JOIN gws g ON g.plen = a.plen AND g.net = a.ip // CAST(pow(2, 32 - a.plen) AS BIGINT) * CAST(pow(2, 32 - a.plen) AS BIGINT)) t WHERE rn = 1 GROUP BY range""", **FULL))
def j7_intervals(spark, d):
    spans = lookup_intervals(inputs.lookup(spark, d))
    size = F.col("hi") - F.col("lo") + 1
    # The sum of remainders over all addresses tells intervals apart that only have the same size and ends.
    mixed = F.aggregate(F.sequence("lo", "hi"), F.lit(0).cast("bigint"), lambda t, x: t + x % 65521)
    return spans.groupBy("range").agg(F.sum(size).alias("addresses"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"), F.sum(mixed).alias("mixed"))


@query("j8_query_ips", oracle(f"""
    SELECT q.text AS ip, CASE WHEN q.bad THEN 'invalid' WHEN h.range IS NULL THEN 'missing' ELSE 'found' END AS status, CASE WHEN h.range IS NOT NULL AND NOT q.bad THEN g.status = 'inservice' END AS gateway_found,
           CASE WHEN NOT q.bad AND h.range IS NULL THEN '(not found)' END AS note, CASE WHEN NOT q.bad THEN w.netname END AS netname
    FROM (SELECT DISTINCT CASE WHEN ip % 50 = 0 THEN concat('x', ip) ELSE {ip4('ip')} END AS text, ip % 50 = 0 AS bad, ip FROM z_log_ips) q LEFT JOIN hit h ON h.ip = q.ip LEFT JOIN gws g ON g.range = h.range LEFT JOIN rw w ON w.network = h.range""", **IP_RANGE))
def j8_query(spark, d):
    ips = run(spark, d, f"SELECT CASE WHEN ip % 50 = 0 THEN concat('x', ip) ELSE {ip4('ip')} END AS ip FROM z_log_ips")
    rows = E.query_ips(ips, "ip", inputs.lookup(spark, d))
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("text")))
    return rows.groupBy("ip", "status").agg(pick("gateway_found").cast("boolean").alias("gateway_found"), F.max(F.when(F.col("status") == "missing", F.col("text"))).alias("note"), pick("whois.netname").alias("netname"))


@query("j10_hostname_coverage", oracle(f"SELECT DISTINCT n AS ptr FROM (SELECT ptr AS n FROM routes WHERE ptr IS NOT NULL UNION SELECT name FROM nm) t WHERE {UNMATCHED}", **PATHS, nm=NAMES))
def j10_coverage(spark, d):
    # The gateways of the tables all have names that the patterns explain; these have others too.
    found = inputs.gateways(spark, d).select(F.struct("gateway.ptr").alias("gateway"), F.transform("routes", lambda r: F.struct(r["ptr"].alias("ptr"))).alias("routes"))
    named = F.struct(F.col("name").alias("ptr"))
    other = run(spark, d, NAMES).select(named.alias("gateway"), F.array(named).alias("routes"))
    return hostname_coverage(found.unionByName(other), PATTERNS)


@query("j11_duplicate_report", oracle(f"SELECT 'conflict' AS part, CAST(count(*) AS BIGINT) AS n FROM ({DUP_SELECT}) c UNION ALL SELECT 'sheets', CAST(count(DISTINCT (file, sheet, sheettype)) AS BIGINT) FROM z_sheet UNION ALL SELECT 'unknown', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT file, sheet FROM gr g ANTI JOIN z_sheet s ON s.file = g.file AND s.sheet = g.sheet) u", **DUPLICATES))
def j11_duplicates(spark, d):
    conflicts, sheets, unknown = duplicate_report(inputs.sheet_rows(spark, d), group_table(spark, GROUPS))
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count(conflicts, "conflict").unionByName(count(sheets, "sheets")).unionByName(count(unknown, "unknown"))


LOG_PATHS = """SELECT unnest(['cents', 'deep', 'deep.x', 'deep.x.y', 'deep.z', 'flag', 'id', 'ip', 'num', 'props', 'props.k', 'ratio', 'tags', 'type']) AS path,
    unnest(['number', 'object', 'object', 'number', 'string', CASE WHEN first % 3 = 1 THEN 'bool' ELSE 'string' END, 'number', CASE WHEN first % 17 = 0 THEN 'null' ELSE 'string' END, CASE WHEN first % 4 = 1 THEN 'number' ELSE 'string' END, 'object', 'number', 'number', 'list', 'string']) AS type_tag
    FROM (SELECT min(event_id) AS first FROM z_log_ips) t"""


@query("a10_field_union", oracle("SELECT path, type_tag FROM p", p=LOG_PATHS))
def a10_field_union(spark, d):
    return E.field_union(log_records(spark, d), "record", "log_id").select("path", "type_tag")


@query("u4_schema_union", oracle("SELECT path, type_tag, CAST(0 AS BIGINT) AS part FROM p UNION ALL SELECT unnest(['mmdb.network', 'mmdb.netname', 'mmdb.plen']), unnest(['string', 'string', 'number']), 1", p=LOG_PATHS))
def u4_schema_union(spark, d):
    logs = E.field_union(log_records(spark, d), "record", "log_id").select("path", "type_tag")
    records = shape(spark, d, "z_whois").select("k", F.parse_json(F.to_json(F.struct("network", "netname", "plen"))).alias("record"))
    out = E.schema_union(logs, E.field_union(records, "record", "k").select("path", "type_tag"))
    return out.withColumn("part", F.col("part").cast("bigint"))


# Path, type and presence of every field of the lookup records, by hand.
def _sheet_fields(kind, found, host="NULL", port="NULL"):
    top = f"xlsx.{kind}"
    parts = [(top, "object", found), (f"{top}.filename", "string", found), (f"{top}.sheetname", "string", found), (f"{top}.fields", "object", found), (f"{top}.fields.site", "string", found),
             (f"{top}.fields.notes", "list", found), (f"{top}.fields.network", "list", found), (f"{top}.fields.host", "string", f"{host} IS NOT NULL"), (f"{top}.fields.port", "string", f"{port} IS NOT NULL")]
    return parts


_DEVICE = ["ip", "ptr", "device", "device_role", "facility", "interface", "facing"]
_LOOKUP_FIELDS = [
    ("continent", "object", "c.continent IS NOT NULL"), ("continent.code", "string", "c.continent IS NOT NULL"), ("country", "object", "w.country IS NOT NULL"), ("country.iso_code", "string", "w.country IS NOT NULL"),
    ("autonomous_system_number", "number", "w.as_num IS NOT NULL"), ("autonomous_system_organization", "string", "w.as_name IS NOT NULL"),
    ("whois", "object", "w.wnet IS NOT NULL"), ("whois.inetnum", "string", "w.wnet IS NOT NULL"), ("whois.netname", "string", "w.netname IS NOT NULL"), ("whois.descr", "string", "d.descr IS NOT NULL"), ("whois.source", "string", "w.wnet IS NOT NULL"),
    ("gateway", "object", "g.ip IS NOT NULL OR g.ptr IS NOT NULL OR g.device IS NOT NULL"), *[(f"gateway.{x}", "string", f"g.{x} IS NOT NULL") for x in _DEVICE],
    ("xlsx", "object", "a.brow IS NOT NULL OR a.hrow IS NOT NULL"), *_sheet_fields("backbone", "a.brow IS NOT NULL", "s.host", "s.port"), *_sheet_fields("hosting", "a.hrow IS NOT NULL"),
    ("xlsx_matched", "object", "true"), ("xlsx_matched.backbone", "bool", "true"), ("xlsx_matched.hosting", "bool", "true"), ("gateway_found", "bool", "true"),
]


@query("j12_discover_fields", oracle(f"""
    SELECT path, type_tag, 0 AS part FROM p
    UNION ALL SELECT 'mmdb', CASE WHEN (SELECT count(*) FROM z_log_ips e JOIN hit h ON h.ip = e.ip JOIN ips i ON i.event_id = e.event_id WHERE e.event_id = (SELECT min(event_id) FROM z_log_ips)) > 0 THEN 'object' ELSE 'null' END, 0
    UNION ALL SELECT concat('mmdb.', f.path), any_value(f.tag), min(CASE WHEN EXISTS (SELECT 1 FROM hit h JOIN ips i ON i.ip = h.ip WHERE h.range = l.range) THEN 0 ELSE 1 END)
    FROM (SELECT range, unnest(fields) AS f FROM lk) l WHERE f.found GROUP BY f.path""", **IP_RANGE, conts=CONTINENTS, p=LOG_PATHS, lk=f"""
    SELECT g.range, [{', '.join(f"struct_pack(path := '{path}', tag := '{tag}', found := ({found}))" for path, tag, found in _LOOKUP_FIELDS)}] AS fields
    FROM gws g LEFT JOIN rw w ON w.network = g.range LEFT JOIN z_whois d ON d.network = w.wnet LEFT JOIN conts c ON c.cc = w.country JOIN attached a ON a.range = g.range
    LEFT JOIN z_sheet s ON s.sheettype = 'backbone' AND s.file = a.bfile AND s.sheet = a.bsheet AND s.row_index = a.brow"""))
def j12_fields(spark, d):
    table = inputs.lookup(spark, d)
    records = E.lookup_text(table).select(F.col("range").alias("record_id"), F.col("text").alias("record"))
    enriched = inputs.once(spark, d, "enriched", lambda: E.enrich_logs(log_records(spark, d), "ip", table))
    return E.discover_fields(enriched, records)


@query("j13_onboarding_report", oracle(r"""
    SELECT 'header' AS part, file, count(DISTINCT trim(s)) AS n FROM z_cells WHERE row = 3 GROUP BY file UNION ALL SELECT 'preview', file, count(DISTINCT (sheet, row)) FROM z_cells WHERE row BETWEEN 3 AND 5 GROUP BY file"""))
def j13_onboarding(spark, d):
    headers, preview = onboarding_report(staged(spark, d, "z_cells"), 3)
    count = lambda df, part: df.groupBy("file").agg(F.count("*").alias("n")).withColumn("part", F.lit(part))
    return count(headers, "header").unionByName(count(preview, "preview"))
