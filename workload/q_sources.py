"""Readers, response parsers and sinks.  Files are staged from the tables in the shared folder first."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cidrloom.functions.fields import ProjectedField
from cidrloom.functions.ip import cidr_text, parse_cidr
from cidrloom.functions.jsontext import canonical
from cidrloom.plans.enrich import project_logs
from cidrloom.session import cut_lineage, staging_path
from cidrloom.sources import readers, registry, sheets, sinks
from cidrloom.sources.sheets import ColumnMapping, SheetConfig
from cidrloom.sources.traces import parse_trace_docs
from cidrloom.streaming.flows import append_traces
from workload.registry import query
from workload.shapes import BASE, COUNTRIES, ip4, oracle, run, shape, staged


def stage(spark, lines, name):
    path = staging_path(spark, name)
    sinks.write_text_lines(lines, path)
    return path


TRACE_LINES = """
    SELECT trace_id, CASE WHEN trace_id % 50 = 0 THEN '{"range":"' ELSE concat('{"range":"', range, '","routes":{"version":"0.1","measured_at":"', measured_at, '","source":"', source,
           CASE WHEN trace_id % 50 = 1 THEN '' ELSE concat('","destination":"', destination) END, '","stop_reason":"', stop_reason, '","hops":[{"hop":', CASE WHEN trace_id % 50 = 2 THEN '"x"' ELSE '1' END,
           ',"ip":"192.0.2.1","rtt_avg":1.5},{"hop":2,"ip":null}', CASE WHEN trace_id % 50 = 3 THEN ',{"ip":"192.0.2.9"}' ELSE '' END, ']}}') END AS value FROM z_traces"""


@query("s1_read_traces", oracle("""
    SELECT range, measured_at, destination, stop_reason, CAST(2 AS BIGINT) AS hops, '192.0.2.1' AS first_ip, 1.5::DOUBLE AS rtt FROM z_traces WHERE trace_id % 50 > 3"""))
def read_traces(spark, d):
    traces = readers.read_traces(spark, stage(spark, run(spark, d, TRACE_LINES), "traces"))
    return traces.select("range", "measured_at", "destination", "stop_reason", F.size("hops").cast("bigint").alias("hops"), F.col("hops")[0]["ip"].alias("first_ip"), F.col("hops")[0]["rtt_avg"].alias("rtt"))


@query("s1_bad_trace_lines", oracle("SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE trace_id % 50 <= 3) AS BIGINT) AS bad_lines FROM z_traces"))
def bad_trace_lines(spark, d):
    return readers.bad_line_count(readers.parse_trace_lines(run(spark, d, TRACE_LINES)))


WHOIS_LINES = """
    SELECT k, CASE WHEN k % 40 = 7 THEN concat('not json ', k) ELSE concat('{"network":"', CASE WHEN k % 40 = 8 THEN 'bad/net' ELSE network END, '","whois":{"inetnum":"', network, '"',
           CASE WHEN k % 40 = 9 THEN '' ELSE concat(',"netname":"', netname, '"') END, CASE WHEN country IS NULL THEN '' ELSE concat(',"country":"', country, '"') END, '}}') END AS value FROM z_whois_all"""


@query("s2_read_whois_lenient", oracle("""
    SELECT network, netname, country FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY k DESC) AS rn FROM z_whois_all WHERE k % 40 NOT IN (7, 8, 9)) t WHERE rn = 1"""))
def read_whois_lenient(spark, d):
    path = stage(spark, run(spark, d, WHOIS_LINES).orderBy("k"), "whois")
    return readers.read_whois(spark, path).select("network", "whois.netname", "whois.country")


@query("s2_read_whois_strict", oracle("SELECT network, netname, country FROM z_whois_all WHERE k % 40 NOT IN (7, 8, 9)"))
def read_whois_strict(spark, d):
    path = stage(spark, run(spark, d, f"SELECT value FROM ({WHOIS_LINES}) t WHERE k % 40 NOT IN (7, 8, 9)"), "whois")
    return readers.read_whois(spark, path, strict=True).select("network", "whois.netname", "whois.country")


SHEET_LINES = "SELECT CASE WHEN id % 23 = 3 THEN '[1,2]' WHEN id % 23 = 4 THEN '{bad' ELSE line END AS value FROM z_sheet_lines"


@query("s3_read_sheet_rows", oracle("SELECT file, sheet, row_index, sheettype, site FROM z_sheet WHERE id % 23 NOT IN (3, 4)"))
def read_sheet_rows(spark, d):
    rows = readers.read_sheet_rows(spark, stage(spark, run(spark, d, SHEET_LINES), "sheet"))
    return rows.select("source.file", "source.sheet", "source.row_index", "source.sheettype", F.variant_get("fields", "$.site", "string").alias("site"))


@query("s4_read_logs", oracle("SELECT e.event_id AS id, event_type AS type, cents, ratio FROM z_log_ips e JOIN z_log_texts t ON t.event_id = e.event_id WHERE e.event_id % 29 > 1"))
def read_logs(spark, d):
    lines = run(spark, d, "SELECT CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 29 = 1 THEN '{\"id\":' ELSE line END AS value FROM z_logs")
    path = staging_path(spark, "logs") + ".jsonl"
    sinks.write_text_lines(lines, path)
    record = readers.read_logs(spark, path).select("record")
    get = lambda p, t: F.get_json_object("record", p).cast(t)
    return record.select(get("$.id", "bigint").alias("id"), get("$.type", "string").alias("type"), get("$.cents", "bigint").alias("cents"), get("$.ratio", "string").alias("ratio"))


GATEWAY_LINES = """
    SELECT concat('{"range":"', range, '","netname":"n', k, '","gateway":{"ip":"', destination, '","ptr":null,"votes":', trace_id % 5, ',"total":9,"status":"', CASE WHEN trace_id % 3 = 0 THEN 'inservice' ELSE 'no_hops' END,
           '","device":null},"routes":[],"xlsx":{"backbone":{"site":"s', trace_id % 4, '"}},"xlsx_matched":{"backbone":true,"hosting":', CASE WHEN trace_id % 2 = 0 THEN 'true' ELSE 'false' END, '},"gateway_found":', CASE WHEN trace_id % 3 = 0 THEN 'true' ELSE 'false' END, '}') AS value FROM z_traces"""


@query("s5_read_gateways", oracle("""
    SELECT range, destination AS ip, trace_id % 5 AS votes, CASE WHEN trace_id % 3 = 0 THEN 'inservice' ELSE 'no_hops' END AS status, concat('s', trace_id % 4) AS site, trace_id % 2 = 0 AS hosting FROM z_traces"""))
def read_gateways(spark, d):
    rows = readers.read_gateways(spark, stage(spark, run(spark, d, GATEWAY_LINES), "gateways"))
    return rows.select("range", "gateway.ip", "gateway.votes", "gateway.status", F.variant_get(F.col("xlsx")["backbone"], "$.site", "string").alias("site"), F.col("xlsx_matched.hosting").alias("hosting"))


def sheet_rows(spark, d):
    """Sheet rows straight from the shape, in (file, sheet, row) order."""
    lines = shape(spark, d, "z_sheet_lines").select(F.col("line").alias("value"), F.lit(0).alias("line_ord"))
    return readers.parse_sheet_lines(lines)


@query("s6_sheet_row_cidrs", oracle("SELECT file, sheet, row_index, sheettype, network FROM z_sheet"))
def sheet_row_cidrs(spark, d):
    return readers.sheet_row_cidrs(sheet_rows(spark, d)).select("source.file", "source.sheet", "source.row_index", "source.sheettype", "network")


def trace_docs(spark, d):
    """One JSON document per order: its replies as probes, some documents of other kinds, some broken."""
    probe = F.struct("ttl", "l_partkey", "l_suppkey", "rtt", "icmp_type", F.when(F.col("ip").isNotNull(), F.expr(ip4("ip").replace("//", "div"))).alias("addr"))
    hops = shape(spark, d, "z_replies").groupBy("trace_id").agg(F.array_sort(F.collect_list(probe)).alias("r"))
    rows = shape(spark, d, "z_traces").join(hops, "trace_id", "left")
    probes = F.transform(F.coalesce("r", F.array()), lambda p: F.struct(p["addr"].alias("addr"), p["ttl"].alias("probe_ttl"), p["rtt"].alias("rtt"), p["icmp_type"].alias("icmp_type")))
    doc = F.to_json(F.struct(
        F.lit("0.2").alias("version"), F.when(F.col("stop_reason") == "GAPLIMIT", "cycle-start").when(F.col("trace_id") % 101 != 5, "trace").alias("type"),
        F.col("source").alias("src"), F.when(F.col("trace_id") % 103 != 7, F.col("destination")).alias("dst"), "stop_reason",
        F.struct((820454400 + F.col("trace_id")).alias("sec"), F.lit(5).alias("usec")).alias("start"), probes.alias("hops")))
    return rows.select("trace_id", F.when(F.col("trace_id") % 97 == 0, "{").when(F.col("trace_id") % 97 == 1, " ").otherwise(doc).alias("doc"))


DOC_KINDS = """SELECT *, CASE WHEN stop_reason = 'GAPLIMIT' THEN 'cycle-start' WHEN trace_id % 101 <> 5 THEN 'trace' ELSE 'unknown' END AS kind FROM z_traces WHERE trace_id % 97 > 1"""


@query("s7_parse_trace_docs", oracle("""
    SELECT d.trace_id, kind, (kind = 'trace' AND d.trace_id % 103 <> 7) AS is_trace, CASE WHEN kind = 'trace' AND d.trace_id % 103 <> 7 THEN strftime(to_timestamp(820454400 + d.trace_id), '%Y-%m-%dT%H:%M:%SZ') END AS measured_at,
           CASE WHEN kind = 'trace' AND d.trace_id % 103 <> 7 THEN coalesce(m.deepest, 0) END AS hops
    FROM docs d LEFT JOIN (SELECT trace_id, max(ttl) AS deepest FROM z_replies GROUP BY 1) m ON m.trace_id = d.trace_id""", docs=DOC_KINDS))
def trace_documents(spark, d):
    out = parse_trace_docs(trace_docs(spark, d), "doc")
    return out.select("trace_id", "kind", F.col("trace").isNotNull().alias("is_trace"), F.col("trace.measured_at").alias("measured_at"), F.when(F.col("trace").isNotNull(), F.size("trace.hops")).cast("bigint").alias("hops"))


RPSL_OUT = f"""
    SELECT k, concat({ip4('net')}, ' - ', {ip4('net + size - 1 - CASE WHEN k % 9 = 0 AND size > 2 THEN 1 ELSE 0 END')}) AS inetnum, c_name AS netname, concat(c_mktsegment, ' second line ', k) AS descr,
           split_part('{COUNTRIES}', ' ', CAST(c_nationkey + 1 AS INT)) AS country, 'TEST' AS source, CAST(NULL AS VARCHAR) AS last_modified FROM z_nets WHERE k % 11 <> 0
    UNION ALL SELECT k, concat('2001:db8:', k % 1000, '::/48'), concat('V6-', k), NULL, NULL, NULL, '2020-01-01T00:00:00Z' FROM z_nets"""


@query("s8_parse_rpsl", oracle(RPSL_OUT))
def parse_rpsl(spark, d):
    out = registry.parse_rpsl(shape(spark, d, "z_rpsl").select("k", "response"), "response")
    return out.select("k", *[F.col(f"whois.{c}").alias(c) for c in ("inetnum", "netname", "descr", "country", "source", "last_modified")])


AUT_TEXT = """SELECT n, concat('% c', chr(10), 'as-block: x', chr(10), 'as-name: WRONG', chr(10), chr(10), 'aut-num:   AS', 64496 + n, chr(10), CASE WHEN n % 6 = 0 THEN '' ELSE concat('as-name: NET-', n_name, chr(10)) END,
              CASE WHEN n % 2 = 0 THEN concat('descr: ', n_name, ' networks', chr(10), 'descr: more', chr(10)) ELSE '' END, chr(10), 'aut-num: AS1', chr(10), 'as-name: SECOND', chr(10)) AS body FROM z_nation"""


@query("s9_parse_aut_num", oracle("""
    SELECT n, concat('AS', 64496 + n) AS aut_num, concat('NET-', n_name) AS as_name, CASE WHEN n % 2 = 0 THEN concat(n_name, ' networks') END AS descr FROM z_nation WHERE n % 6 <> 0"""))
def parse_aut_num(spark, d):
    return registry.parse_aut_num(run(spark, d, AUT_TEXT), "body")


DELEGATIONS = f"""SELECT k, net, plen, concat('% text', chr(10), 'refer:   ', CASE WHEN k % 4 = 0 THEN '' ELSE concat('whois', k % 5, '.example.net') END, chr(10), 'inetnum: ', CASE WHEN k % 3 = 0 THEN 'odd' ELSE concat({ip4('net')}, ' - ', {ip4('net + size - 1')}) END, chr(10),
                   CASE WHEN k % 6 = 0 THEN concat('inetnum: ', network, chr(10)) ELSE '' END) AS response FROM z_nets"""


@query("s10_parse_delegation", oracle(f"""
    SELECT k, CASE WHEN k % 4 <> 0 AND (k % 3 <> 0 OR k % 6 = 0) THEN concat({ip4('net')}, '/', plen) END AS block, CASE WHEN k % 4 <> 0 THEN concat('whois', k % 5, '.example.net') END AS refer FROM z_nets"""))
def parse_delegation(spark, d):
    out = registry.parse_delegation(run(spark, d, DELEGATIONS).select("k", "response"), "response")
    return out.select("k", cidr_text(F.col("block")).alias("block"), "refer")


RECORD_JSON = f"""
    SELECT k, network, concat('{{"data":{{"records":[[{{"key":"inetnum","value":"', {ip4('net')}, ' - ', {ip4('net + size - 1')}, '"}},{{"key":"netname","value":"', c_name, '"}},{{"key":"netname","value":"LATER"}},{{"key":"country","value":"JP"}}],[{{"key":"route","value":"x"}}]',
           CASE WHEN k % 2 = 0 THEN concat(',[{{"key":"descr","value":"d', k, '"}},{{"key":"inet6num","value":"2001:db8::/32"}},{{"key":"netname","value":"V6"}}]') ELSE '' END, ']}}}}') AS body FROM z_nets"""


@query("s11_registry_records", oracle(f"""
    SELECT k, concat({ip4('net')}, ' - ', {ip4('net + size - 1')}) AS inetnum, c_name AS netname, CAST(NULL AS VARCHAR) AS descr, 'JP' AS country FROM z_nets
    UNION ALL SELECT k, '2001:db8::/32', 'V6', concat('d', k), NULL FROM z_nets WHERE k % 2 = 0"""))
def registry_records(spark, d):
    out = registry.registry_records(run(spark, d, RECORD_JSON).select("k", "body"), "body")
    return out.select("k", "whois.inetnum", "whois.netname", "whois.descr", "whois.country")


@query("s12_announced_prefixes", oracle("""
    SELECT 64496 + c_nationkey % 16 AS asn, k, network FROM z_nets"""))
def announced_prefixes(spark, d):
    body = """SELECT 64496 + c_nationkey % 16 AS asn, k, concat('{"data":{"prefixes":[{"prefix":"', network, '"},{"prefix":"bad', k, '"},{"prefix":"192.0.2.1"}]}}') AS body FROM z_nets"""
    return registry.announced_prefixes(run(spark, d, body), "body").select("asn", "k", cidr_text(F.col("net")).alias("network"))


ORIGIN_JSON = """SELECT k, network, concat('{"data":{"asns":[', CASE WHEN k % 5 = 0 THEN '' ELSE concat(64496 + c_nationkey % 16, ',1') END, ']}}') AS body FROM z_nets"""


@query("s13_origin_asn", oracle("SELECT k, CASE WHEN k % 5 <> 0 THEN CAST(64496 + c_nationkey % 16 AS BIGINT) END AS asn FROM z_nets"))
def origin_asn(spark, d):
    return registry.origin_asn(run(spark, d, ORIGIN_JSON).select("k", "body"), "body")


AUT_JSON = """SELECT n, concat('{"data":{"records":[[{"key":"aut-num","value":"AS', 64496 + n, '"},', CASE WHEN n % 6 = 0 THEN '' ELSE concat('{"key":"as-name","value":"NET-', n_name, '"},') END, '{"key":"descr","value":"', n_name, '"}],[{"key":"aut-num","value":"AS1"},{"key":"as-name","value":"SECOND"}]]}}') AS body FROM z_nation"""


@query("s14_aut_num_from_json", oracle("SELECT n, concat('AS', 64496 + n) AS aut_num, concat('NET-', n_name) AS as_name, n_name AS descr FROM z_nation WHERE n % 6 <> 0"))
def aut_num_from_json(spark, d):
    return registry.aut_num_from_json(run(spark, d, AUT_JSON), "body")


CONFIG = SheetConfig(
    columns=(
        ColumnMapping("host", "Host Name", ptr_field="device"),
        ColumnMapping("vlan", "VLAN-ID", type="integer"),
        ColumnMapping("in_use", "In Use?", type="bool"),
        ColumnMapping("network", sheet_names=("Address", "Address 2"), type="addresses"),
        ColumnMapping("second", "Address 2", type="addresses"),
        ColumnMapping("price", "Price"),
        ColumnMapping("nothing", "No Such Header", type="integer"),
    ),
    header_row=3,
    excludes_sheets=("Brand#12",),
)
VLAN = "CASE WHEN p_partkey % 7 = 0 THEN p_partkey WHEN p_partkey % 7 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 4000 END WHEN p_partkey % 7 = 2 THEN CAST(p_partkey % 2 = 0 AS BIGINT) WHEN p_partkey % 31 = 5 THEN NULL ELSE p_partkey END"
TYPED = f"""
    SELECT concat('book', p_partkey % 3, '.xlsx') AS file, p_brand AS sheet, p_partkey AS row_index, concat('rtr', lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0')) AS host,
           CASE WHEN p_brand = 'Brand#11' THEN '""' ELSE CAST({VLAN} AS VARCHAR) END AS vlan,
           CASE WHEN p_partkey % 5 IN (0, 1) THEN p_partkey % 2 = 0 ELSE p_partkey % 3 <> 0 END AS in_use,
           concat({ip4(f'{BASE} + (p_partkey * 7919) % 65536')}, '/32') AS a, concat({ip4(f'{BASE} + (p_partkey * 104729) % 65536')}, '/32') AS b,
           CASE WHEN p_partkey % 6 <> 0 THEN concat({ip4(f'{BASE} + (p_partkey * 7919) % 65536')}, '/32') END AS second, CAST(p_size * 100 AS VARCHAR) AS price, p_partkey,
           p_brand <> 'Brand#11' AND ({VLAN}) IS NULL AS skipped
    FROM part WHERE p_brand <> 'Brand#12'"""


def typed_rows(spark, d):
    return sheets.type_rows(staged(spark, d, "z_cells"), CONFIG)


@query("s15_type_rows", oracle("""
    SELECT file, sheet, row_index, host, vlan, in_use, CASE WHEN a = b THEN a ELSE concat(a, ';', b) END AS network, second, price, '""' AS nothing FROM t WHERE NOT skipped""", t=TYPED))
def type_rows(spark, d):
    rows = sheets.kept_rows(typed_rows(spark, d))
    text = lambda c: F.variant_get(c, "$", "string").alias(c)
    nets = lambda c: F.array_join(F.transform(c, cidr_text), ";").alias(c)
    return rows.select("file", "sheet", "row_index", text("host"), F.to_json("vlan").alias("vlan"), F.variant_get("in_use", "$", "boolean").alias("in_use"), nets("network"), nets("second"), text("price"), F.to_json("nothing").alias("nothing"))


@query("s16_header_inventory", oracle(r"""
    SELECT file, sheet, CAST(col AS BIGINT) AS col, header, trim(regexp_replace(lower(header), '[^a-z0-9]+', '_', 'g'), '_') AS name, true AS valid
    FROM (SELECT file, trim(s) AS header, sheet, col, row_number() OVER (PARTITION BY file, trim(s) ORDER BY sheet, col) AS rn FROM z_cells WHERE row = 3 AND sheet <> 'Brand#12') t WHERE rn = 1"""))
def header_inventory(spark, d):
    return sheets.header_inventory(staged(spark, d, "z_cells"), 3, ("Brand#12",)).withColumn("col", F.col("col").cast("bigint"))


@query("s17_sheet_preview", oracle("""
    SELECT file, sheet, CAST(row AS BIGINT) AS row, string_agg(coalesce(CASE kind WHEN 'string' THEN trim(s) WHEN 'int' THEN CAST(i AS VARCHAR) WHEN 'bool' THEN CAST(b AS VARCHAR)
           WHEN 'float' THEN CASE WHEN f = floor(f) THEN CAST(CAST(f AS BIGINT) AS VARCHAR) ELSE CAST(f AS VARCHAR) END END, ''), ' | ' ORDER BY col) AS line FROM z_cells WHERE row BETWEEN 3 AND 5 GROUP BY ALL"""))
def sheet_preview(spark, d):
    return sheets.sheet_preview(staged(spark, d, "z_cells"), 3).withColumn("row", F.col("row").cast("bigint"))


@query("s18_write_sheet_rows", oracle("""
    SELECT concat('{"_source":{"file":"', file, '","sheet":"', sheet, '","row_index":', row_index, ',"sheettype":"backbone"},"host":"', host, '","vlan":', vlan, ',"in_use":', in_use, ',"network":["', a, CASE WHEN a = b THEN '' ELSE concat('","', b) END, '"]',
           CASE WHEN second IS NULL THEN '' ELSE concat(',"second":["', second, '"]') END, ',"price":"', price, '","nothing":""}') AS value FROM t WHERE NOT skipped""", t=TYPED))
def write_sheet_rows(spark, d):
    path = stage(spark, sheets.sheet_lines(sheets.kept_rows(typed_rows(spark, d)), CONFIG.columns), "sheet-out")
    return spark.read.text(path)


@query("s19_write_tables", oracle("SELECT network, netname, country, 'parquet' AS format FROM z_whois UNION ALL SELECT network, netname, country, 'json' FROM z_whois"))
def write_tables(spark, d):
    rows = shape(spark, d, "z_whois").select("network", "netname", "country")
    pq, js = staging_path(spark, "whois-pq"), staging_path(spark, "whois-js")
    sinks.write_parquet(rows, pq)
    sinks.write_json_lines(rows, js, skip_empty=True)
    out = sinks.read_table(spark, pq).withColumn("format", F.lit("parquet"))
    return out.unionByName(sinks.read_table(spark, js).withColumn("format", F.lit("json")))


@query("s20_write_enriched", oracle("""
    SELECT 'raw' AS part, concat(head, tail) AS line FROM z_log_texts
    UNION ALL SELECT 'projected', concat('{"id":', e.event_id, ',"r":"', ratio, '","t":"', event_type, '"}') FROM z_log_ips e JOIN z_log_texts t ON t.event_id = e.event_id"""))
def write_enriched(spark, d):
    logs = shape(spark, d, "z_logs").select(F.col("event_id").alias("log_id"), canonical(F.col("line")).alias("record"))
    root = staging_path(spark, "enriched-logs")
    sinks.write_enriched(logs, root, lambda t: project_logs(t, [ProjectedField("id"), ProjectedField("type", "t"), ProjectedField("ratio", "r", "string")]))
    line = lambda part: sinks.read_table(spark, root, part).select(F.lit(part).alias("part"), F.col("value").alias("line"))
    return line("raw").unionByName(line("projected"))


# The same logs as array files without line breaks.
@query("s4_read_log_arrays", oracle("SELECT event_id AS id, concat(head, tail) AS record FROM z_log_texts"))
def read_log_arrays(spark, d):
    lines = shape(spark, d, "z_logs").select((F.col("event_id") % 7).alias("file"), F.lit(1).alias("place"), F.col("line").alias("value"))
    # Each array is written element by element, between two rows that hold its brackets.
    files = lines.select("file").distinct()
    brackets = files.select("file", F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(v).alias("value")) for p, v in ((0, "["), (2, "]"))])).alias("b")).select("file", "b.*")
    rows = lines.filter(F.col("value").isNotNull()).unionByName(brackets)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("place"))).sortWithinPartitions("file", "n")
    value = F.when((F.col("place") == 1) & (F.col("n") > 2), F.concat(F.lit(","), "value")).otherwise(F.col("value"))
    path = staging_path(spark, "log-arrays")
    rows.select("file", value.alias("value")).write.partitionBy("file").option("lineSep", " ").text(path)
    record = readers.read_logs(spark, path).select("record")
    return record.select(F.get_json_object("record", "$.id").cast("bigint").alias("id"), "record")


@query("s21_append_traces", oracle("""
    SELECT destination, strftime(to_timestamp(820454400 + d.trace_id), '%Y-%m-%dT%H:%M:%SZ') AS measured_at, coalesce(m.deepest, 0) AS hops
    FROM docs d LEFT JOIN (SELECT trace_id, max(ttl) AS deepest FROM z_replies GROUP BY 1) m ON m.trace_id = d.trace_id WHERE kind = 'trace' AND d.trace_id % 103 <> 7""", docs=DOC_KINDS))
def append_trace_stream(spark, d):
    source = stage(spark, trace_docs(spark, d).select(F.col("doc").alias("value")), "docs")
    sink, checkpoint = staging_path(spark, "trace-sink"), staging_path(spark, "trace-checkpoint")
    append_traces(spark, source, sink, checkpoint, files_per_batch=4, every=None).awaitTermination()
    return spark.read.parquet(sink).select("destination", "measured_at", F.size("hops").cast("bigint").alias("hops"))


# Documents that land three times, twice in one run and once more in the next, are appended once per pair.
@query("s21_resume_traces", oracle("""
    SELECT range, destination, CAST(1 AS BIGINT) AS n FROM (SELECT d.destination, m.network AS range, row_number() OVER (PARTITION BY d.destination ORDER BY m.plen DESC) AS rn
        FROM (SELECT DISTINCT destination, dest FROM docs WHERE kind = 'trace' AND trace_id % 103 <> 7) d
        JOIN (SELECT DISTINCT network, net, plen, size FROM z_nets WHERE plen >= 27) m ON m.net <= d.dest AND d.dest < m.net + m.size) t WHERE rn = 1""", docs=DOC_KINDS))
def resume_trace_stream(spark, d):
    lines = cut_lineage(trace_docs(spark, d).select(F.col("doc").alias("value")))
    nets = run(spark, d, "SELECT DISTINCT network, CAST(net AS BIGINT) AS first, CAST(size AS BIGINT) AS size FROM z_nets WHERE plen >= 27")
    planned = nets.select("network", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("ip"))
    targets = planned.select(parse_cidr(F.col("network")).alias("net"), "ip")
    source, sink, checkpoint = (staging_path(spark, f"resume-{x}") for x in ("source", "sink", "checkpoint"))
    for copies in (2, 1):
        for _ in range(copies):
            lines.write.mode("append").text(source)
        append_traces(spark, source, sink, checkpoint, files_per_batch=3, every=None, targets=targets).awaitTermination()
    return spark.read.parquet(sink).groupBy("range", "destination").agg(F.count("*").alias("n"))
