"""Prefix joins, inventory matching, DNS joins and sheet checks."""

from pyspark.sql import functions as F

from cidrloom.functions.ip import parse_ip
from cidrloom.operators import conflicts as C
from cidrloom.operators import dns as D
from cidrloom.operators import match as M
from cidrloom.operators.asof import interval_join, record_intervals
from cidrloom.operators.prefix import longest_prefix_join
from cidrloom.plans.gateways import attach_whois, match_summary
from cidrloom.plans.reports import unmatched
from cidrloom.sources import sheets
from cidrloom.sources.readers import sheet_row_cidrs
from cidrloom.sources.registry import parse_delegation
from workload import inputs
from workload.q_sources import DELEGATIONS, TYPED, typed_rows
from workload.q_text import NAMES, PATTERNS, RE_COM, RE_NET
from workload.q_traces import GW_CTES
from workload.registry import query
from workload.shapes import ip4, oracle, run, shape, staged, table

RANGE_WHOIS = """
    SELECT network, netname, country, as_num, as_name, wnet FROM (
        SELECT t.network, w.netname, w.country, w.as_num, w.as_name, w.network AS wnet, row_number() OVER (PARTITION BY t.network ORDER BY w.plen DESC) AS rn
        FROM z_targets t JOIN z_whois w ON w.net <= t.net AND t.net + t.size <= w.net + w.size) x WHERE rn = 1"""


@query("j_lpm", oracle("SELECT t.network AS range, r.netname, r.country, r.as_num FROM z_targets t LEFT JOIN rw r ON r.network = t.network", rw=RANGE_WHOIS))
def lpm(spark, d):
    ranges = inputs.targets(spark, d).select(F.col("network").alias("range"))
    return attach_whois(ranges, inputs.whois(spark, d)).select("range", "netname", "country", "as_num")


IP_WHOIS = """
    SELECT ip, network, netname FROM (
        SELECT i.ip, w.network, w.netname, row_number() OVER (PARTITION BY i.ip ORDER BY w.plen DESC) AS rn
        FROM (SELECT DISTINCT ip FROM z_log_ips) i JOIN z_whois w ON w.net <= i.ip AND i.ip < w.net + w.size) x WHERE rn = 1"""
LOOKUP_SQL = oracle("SELECT e.event_id, e.ip, r.network, r.netname FROM z_log_ips e LEFT JOIN r ON r.ip = e.ip", r=IP_WHOIS)


def _records(spark, d):
    return inputs.whois(spark, d).select("net", "network", "whois.netname")


# As-of join over intervals; the name is from the broadcast form that it replaced.
@query("j_lookup_broadcast", LOOKUP_SQL)
def lookup_broadcast(spark, d):
    logs = shape(spark, d, "z_log_ips").select("event_id", "ip")
    out = interval_join(logs, "ip", record_intervals(_records(spark, d), "net"))
    return out.select("event_id", "ip", "record.network", "record.netname")


# Both address families: hash join on prefix lengths.
@query("j_lookup_shuffle", LOOKUP_SQL)
def lookup_shuffle(spark, d):
    logs = run(spark, d, f"SELECT event_id, ip, {ip4('ip')} AS text FROM z_log_ips").withColumn("probe", parse_ip(F.col("text")))
    return longest_prefix_join(logs, "probe", _records(spark, d), "net").select("event_id", "ip", "network", "netname")


# Addresses that stand as tokens in whole documents, looked up like log addresses.
@query("j_lookup_documents", oracle(r"""
    SELECT t.doc_id, t.ip_text, r.network FROM toks t LEFT JOIN (
        SELECT ip_text, network FROM (SELECT i.ip_text, w.network, row_number() OVER (PARTITION BY i.ip_text ORDER BY w.plen DESC) AS rn
            FROM (SELECT DISTINCT ip_text, ip FROM toks) i JOIN z_whois w ON w.net <= i.ip AND i.ip < w.net + w.size) x WHERE rn = 1) r ON r.ip_text = t.ip_text""",
    toks=r"""SELECT doc_id, ip_text, CAST(split_part(ip_text, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip_text, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip_text, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip_text, '.', 4) AS BIGINT) AS ip
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS ip_text FROM documents) x
        WHERE regexp_full_match(ip_text, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}')"""))
def lookup_documents(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), 0)
    rows = table(spark, d, "documents").select("doc_id", F.explode(found).alias("ip_text")).withColumn("probe", parse_ip(F.col("ip_text")))
    return longest_prefix_join(rows.filter("probe IS NOT NULL"), "probe", _records(spark, d), "net").select("doc_id", "ip_text", "network")


SHEET_SIZE = "CAST(pow(2, 32 - s.plen) AS BIGINT)"
RELATED = f"""
    SELECT r.network AS range, s.file, s.sheet, s.row_index, r.rk, count(*) OVER (PARTITION BY r.network) AS matches, row_number() OVER (PARTITION BY r.network ORDER BY s.file, s.sheet, s.row_index) AS rn
    FROM (SELECT network, net, size, 1 AS rk FROM z_targets) r JOIN z_sheet s ON s.sheettype = 'backbone' AND ((s.net <= r.net AND r.net + r.size <= s.net + {SHEET_SIZE}) OR (r.net <= s.net AND s.net + {SHEET_SIZE} <= r.net + r.size))"""
EXACT = """
    SELECT r.network AS range, s.file, s.sheet, s.row_index, count(*) OVER (PARTITION BY r.network) AS matches, row_number() OVER (PARTITION BY r.network ORDER BY s.file, s.sheet, s.row_index) AS rn
    FROM z_targets r JOIN z_sheet s ON s.sheettype = 'hosting' AND s.network = r.network"""
BY_PTR = """
    SELECT g.range, s.file, s.sheet, s.row_index, count(*) OVER (PARTITION BY g.range) AS matches, row_number() OVER (PARTITION BY g.range ORDER BY s.file, s.sheet, s.row_index) AS rn
    FROM gws g JOIN z_sheet s ON s.sheettype = 'backbone' AND (s.host IS NOT NULL OR s.port IS NOT NULL) AND (s.host IS NULL OR lower(s.host) = lower(g.device)) AND (s.port IS NULL OR replace(s.port, '/', '-') = g.interface)"""
FIRST = "SELECT range, file, sheet, row_index, CAST(matches AS BIGINT) AS matches FROM m WHERE rn = 1"


def _first(df):
    return df.select("range", "first.file", "first.sheet", "first.row_index", "matches")


@query("j_bidir", oracle(FIRST, m=RELATED))
def bidirectional(spark, d):
    ranges = inputs.targets(spark, d).select(F.col("network").alias("range"))
    return _first(M.match_related(ranges, sheet_row_cidrs(inputs.sheet_rows(spark, d))))


@query("j_exact", oracle(FIRST, m=EXACT))
def exact(spark, d):
    ranges = inputs.targets(spark, d).select(F.col("network").alias("range"))
    return _first(M.match_exact(ranges, sheet_row_cidrs(inputs.sheet_rows(spark, d))))


@query("j_ptr", oracle(FIRST, **GW_CTES, m=BY_PTR))
def by_ptr(spark, d):
    keys = M.sheet_ptr_keys(inputs.sheet_rows(spark, d), inputs.PTR_COLUMNS, inputs.NORMALIZERS)
    return _first(M.match_by_ptr(inputs.voted(spark, d), keys, ["device", "interface"], inputs.NORMALIZERS))


@query("w2_first_match", oracle(FIRST, **GW_CTES, m=BY_PTR))
def first_match(spark, d):
    # The first row per range and how many rows competed, from the attached result.
    rows = M.attach_matches(inputs.voted(spark, d), inputs.sheet_rows(spark, d), inputs.PTR_COLUMNS, inputs.NORMALIZERS)
    keys = M.sheet_ptr_keys(inputs.sheet_rows(spark, d), inputs.PTR_COLUMNS, inputs.NORMALIZERS)
    matched = M.match_by_ptr(inputs.voted(spark, d), keys, ["device", "interface"], inputs.NORMALIZERS).select("range")
    row = F.col("xlsx")["backbone"]
    get = lambda p, t: F.variant_get(row, f"$._source.{p}", t).alias(p)
    return rows.join(matched, "range", "left_semi").select("range", get("file", "string"), get("sheet", "string"), get("row_index", "bigint"), F.col("backbone_matches").alias("matches"))


ATTACHED = {
    **GW_CTES,
    "bp": BY_PTR,
    "br": RELATED,
    "bh": EXACT,
    "attached": """SELECT g.range, coalesce(p.file, b.file) AS bfile, coalesce(p.sheet, b.sheet) AS bsheet, coalesce(p.row_index, b.row_index) AS brow, coalesce(p.matches, b.matches) AS bmatches,
        h.sheet AS hsheet, h.row_index AS hrow, h.matches AS hmatches FROM gws g LEFT JOIN bp p ON p.range = g.range AND p.rn = 1 LEFT JOIN br b ON b.range = g.range AND b.rn = 1 LEFT JOIN bh h ON h.range = g.range AND h.rn = 1""",
}


@query("j_attach", oracle("""
    SELECT range, bfile AS backbone_file, bsheet AS backbone_sheet, brow AS backbone_row, CAST(bmatches AS BIGINT) AS backbone_matches, hsheet AS hosting_sheet, hrow AS hosting_row, CAST(hmatches AS BIGINT) AS hosting_matches,
           brow IS NOT NULL AS backbone, hrow IS NOT NULL AS hosting FROM attached""", **ATTACHED))
def attach(spark, d):
    rows = M.attach_matches(inputs.voted(spark, d), inputs.sheet_rows(spark, d), inputs.PTR_COLUMNS, inputs.NORMALIZERS)
    def get(kind, p, t):
        return F.variant_get(F.try_element_at("xlsx", F.lit(kind)), f"$._source.{p}", t)
    return rows.select("range", get("backbone", "file", "string").alias("backbone_file"), get("backbone", "sheet", "string").alias("backbone_sheet"), get("backbone", "row_index", "bigint").alias("backbone_row"), "backbone_matches",
                       get("hosting", "sheet", "string").alias("hosting_sheet"), get("hosting", "row_index", "bigint").alias("hosting_row"), "hosting_matches", F.col("xlsx_matched.backbone").alias("backbone"), F.col("xlsx_matched.hosting").alias("hosting"))


@query("a13_match_summary", oracle("SELECT CAST(count(*) FILTER (WHERE brow IS NOT NULL OR hrow IS NOT NULL) AS BIGINT) AS matched, CAST(count(*) AS BIGINT) AS total FROM attached", **ATTACHED))
def matched_ranges(spark, d):
    return match_summary(inputs.gateways(spark, d))


@query("j_dnsmerge", oracle(f"""
    SELECT ip_text AS ip, CAST(asn AS BIGINT) AS asn, ptr FROM z_dns WHERE asn IS NOT NULL OR ptr IS NOT NULL"""))
def dns_merge(spark, d):
    answers = inputs.dns(spark, d)
    return D.merge_answers(answers.filter("asn IS NOT NULL").select("ip", "asn"), answers.filter("ptr IS NOT NULL").select("ip", "ptr"))


# Origin answers landed for every second prefix; other addresses reuse a covering answer.
ANSWERS = f"SELECT {ip4('dest')} AS ip, CAST(64496 + k % 16 AS BIGINT) AS asn, CASE WHEN k % 7 = 0 THEN 'n/a' ELSE range END AS prefix, 'JP' AS country, 'apnic' AS registry, CAST(k AS STRING) AS allocated, dest, net, plen, size, k FROM z_traces WHERE stop_reason = 'COMPLETED'"


@query("j_origin", oracle("""
    SELECT event_id, ip, asn, prefix FROM (
        SELECT e.event_id, e.ip, o.asn, o.prefix, row_number() OVER (PARTITION BY e.event_id ORDER BY o.plen DESC) AS rn
        FROM z_log_ips e LEFT JOIN o ON o.net <= e.ip AND e.ip < o.net + o.size) t WHERE rn = 1""",
    ans=ANSWERS,
    o="""SELECT net, plen, size, asn, prefix FROM (SELECT *, row_number() OVER (PARTITION BY net, plen ORDER BY asn, prefix, allocated) AS rn FROM (
           SELECT CASE WHEN prefix = 'n/a' THEN dest ELSE net END AS net, CASE WHEN prefix = 'n/a' THEN 32 ELSE plen END AS plen, CASE WHEN prefix = 'n/a' THEN 1 ELSE size END AS size, asn, prefix, allocated FROM ans) x) y WHERE rn = 1"""))
def origin(spark, d):
    known = D.origin_table(run(spark, d, f"SELECT ip, asn, prefix, country, registry, allocated FROM ({ANSWERS}) t"))
    ips = run(spark, d, f"SELECT event_id, ip AS n, {ip4('ip')} AS ip FROM z_log_ips")
    return D.attach_origin(ips, "ip", known).select("event_id", F.col("n").alias("ip"), "asn", "prefix")


@query("j_asname", oracle("""
    SELECT k, w.asn, n.as_name FROM (SELECT k, CAST(64496 + c_nationkey % 16 AS BIGINT) AS asn FROM z_nets) w LEFT JOIN (SELECT 64496 + n AS asn, n_name AS as_name FROM z_nation WHERE n % 5 <> 0) n ON n.asn = w.asn"""))
def as_name(spark, d):
    from cidrloom.functions.text import parse_asname_txt

    origins = run(spark, d, "SELECT k, CAST(64496 + c_nationkey % 16 AS BIGINT) AS asn FROM z_nets")
    text = F.when(F.col("n") % 5 == 0, F.lit("1 | JP")).otherwise(F.concat(F.lit("1 | JP | apnic | 2001-01-01 | "), "n_name", F.lit(", JP")))
    names = shape(spark, d, "z_nation").select((64496 + F.col("n")).alias("asn"), parse_asname_txt(text).alias("as_name"))
    return D.attach_as_name(origins, names).select("k", "asn", "as_name")


@query("j_autnum", oracle("""
    SELECT k, CASE WHEN n.asn IS NULL THEN w.as_num0 ELSE concat('AS', n.asn) END AS as_num, n.n_name AS as_name FROM (SELECT k, 64496 + c_nationkey % 30 AS asn, concat('old', k) AS as_num0 FROM z_nets) w LEFT JOIN (SELECT 64496 + n AS asn, n_name FROM z_nation WHERE n % 4 <> 0) n ON n.asn = w.asn"""))
def aut_num(spark, d):
    empty = [F.lit(None).cast("string").alias(c) for c in ("as_name", "as_descr")]
    rows = run(spark, d, "SELECT k, CAST(64496 + c_nationkey % 30 AS BIGINT) AS asn, concat('old', k) AS old FROM z_nets").select("k", "asn", F.struct(F.col("old").alias("as_num"), *empty).alias("whois"))
    auts = shape(spark, d, "z_nation").filter("n % 4 <> 0").select(F.concat(F.lit("AS"), 64496 + F.col("n")).alias("aut_num"), F.col("n_name").alias("as_name"), F.lit(None).cast("string").alias("descr"))
    return D.attach_aut_num(rows, "asn", auts).select("k", "whois.as_num", "whois.as_name")


@query("j_deleg", oracle("""
    SELECT event_id, coalesce(refer, 'whois.default.example') AS server FROM (
        SELECT e.event_id, b.refer, row_number() OVER (PARTITION BY e.event_id ORDER BY b.plen DESC, b.refer) AS rn FROM z_log_ips e
        LEFT JOIN (SELECT net, plen, size, concat('whois', k % 5, '.example.net') AS refer FROM z_nets WHERE k % 4 <> 0 AND (k % 3 <> 0 OR k % 6 = 0)) b ON b.net <= e.ip AND e.ip < b.net + b.size) t WHERE rn = 1"""))
def delegation(spark, d):
    blocks = parse_delegation(run(spark, d, DELEGATIONS).select("response"), "response").filter("block IS NOT NULL")
    ips = run(spark, d, f"SELECT event_id, {ip4('ip')} AS text FROM z_log_ips").withColumn("probe", parse_ip(F.col("text")))
    return D.attach_server(ips, "probe", blocks, "whois.default.example").select("event_id", "server")


def _rows(spark, d):
    return inputs.once(spark, d, "typed", lambda: sheets.kept_rows(typed_rows(spark, d)).select("file", "sheet", "row_index", "sheettype", "network", "second"))


@query("f3_rows_in_nets", oracle("""
    SELECT file, sheet, row_index FROM t WHERE NOT skipped AND EXISTS (SELECT 1 FROM z_targets n WHERE n.plen >= 24 AND ((n.net <= t.x AND t.x < n.net + n.size) OR (n.net <= t.y AND t.y < n.net + n.size)))""",
    t=TYPED.replace("p_partkey,\n", "p_partkey, 3325256704 + (p_partkey * 7919) % 65536 AS x, 3325256704 + (p_partkey * 104729) % 65536 AS y,\n")))
def rows_in_nets(spark, d):
    nets = inputs.targets(spark, d).filter(F.col("net.plen") >= 24)
    return C.rows_in_nets(_rows(spark, d), ["file", "sheet", "row_index"], "network", nets, "net").select("file", "sheet", "row_index")


@query("f4_exclude_sheets", oracle("SELECT sheet, CAST(count(*) AS BIGINT) AS cells FROM z_cells WHERE sheet NOT IN ('Brand#12', 'Brand#33') GROUP BY sheet"))
def exclude_sheets(spark, d):
    return sheets.exclude_sheets(staged(spark, d, "z_cells"), ("Brand#12", "Brand#33")).groupBy("sheet").agg(F.count("*").alias("cells"))


UNMATCHED = rf"((ends_with(n, 'example.com') AND NOT regexp_matches(n, '^mgmt|unknown-3-') AND NOT regexp_matches(n, '{RE_COM}')) OR (ends_with(n, 'example.net') AND NOT regexp_matches(n, '{RE_NET}')))"


@query("f5_unmatched_hostnames", oracle(f"SELECT name FROM (SELECT name, name AS n FROM nm) t WHERE {UNMATCHED}", nm=NAMES))
def unmatched_hostnames(spark, d):
    return run(spark, d, NAMES).filter(unmatched(F.col("name"), PATTERNS)).select("name")


GROUPS = {"book0.xlsx": [["Brand#11", "Brand#13"], ["Brand#13", "Brand#21", "Nope"]], "book1.xlsx": [["Brand#11", "Brand#22", "Brand#23"]], "hosting.xlsx": [["S0", "S1", "S2"], ["S3"]]}
GROUP_ROWS = [(f, n, g) for g, (f, names) in enumerate((f, names) for f, lists in GROUPS.items() for names in lists) for n in names]
GROUP_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{n}', {g})" for f, n, g in GROUP_ROWS) + ") v(file, sheet, group_id)"


@query("a11_group_membership", oracle("""
    SELECT g.file, g.sheet, array_to_string(list_sort(list(DISTINCT g.group_id)), ',') AS group_ids, true AS known FROM gr g SEMI JOIN (SELECT DISTINCT file, sheet FROM z_sheet) s ON s.file = g.file AND s.sheet = g.sheet GROUP BY ALL
    UNION ALL SELECT DISTINCT g.file, g.sheet, '', false FROM gr g ANTI JOIN (SELECT DISTINCT file, sheet FROM z_sheet) s ON s.file = g.file AND s.sheet = g.sheet""", gr=GROUP_SQL))
def group_membership(spark, d):
    members, unknown = C.group_membership(C.group_table(spark, GROUPS), shape(spark, d, "z_sheet"))
    out = members.select("file", "sheet", F.array_join(F.transform("group_ids", lambda g: g.cast("string")), ",").alias("group_ids"), F.lit(True).alias("known"))
    return out.unionByName(unknown.select("file", "sheet", F.lit("").alias("group_ids"), F.lit(False).alias("known")))


DUPLICATES = {
    "gr": GROUP_SQL,
    "rows0": "SELECT s.*, coalesce((SELECT list(g.group_id) FROM gr g WHERE g.file = s.file AND g.sheet = s.sheet), []) AS gids FROM z_sheet s",
    "seen": "SELECT *, first_value(file) OVER w AS f1, first_value(sheet) OVER w AS s1, first_value(row_index) OVER w AS r1, first_value(gids) OVER w AS g1, row_number() OVER w AS rn FROM rows0 WINDOW w AS (PARTITION BY sheettype, net, plen ORDER BY file, sheet, row_index)",
}
DUP_SELECT = "SELECT sheettype, network, file, sheet, row_index, f1 AS first_file, s1 AS first_sheet, r1 AS first_row_index FROM seen WHERE rn > 1 AND NOT list_has_any(gids, g1)"


@query("w3_duplicate_cidrs", oracle(DUP_SELECT, **DUPLICATES))
def duplicate_cidrs(spark, d):
    members, _ = C.group_membership(C.group_table(spark, GROUPS), staged(spark, d, "z_sheet"))
    return C.duplicate_cidrs(sheet_row_cidrs(inputs.sheet_rows(spark, d)), members)


@query("a6_import_statistics", oracle("SELECT sheettype, CAST(count(DISTINCT (file, sheet)) AS BIGINT) AS sheets, CAST(count(*) AS BIGINT) AS rows FROM z_sheet GROUP BY sheettype"))
def import_statistics(spark, d):
    return C.import_statistics(inputs.sheet_rows(spark, d).select("source.*"))


@query("a8_sheet_summary", oracle("""
    SELECT file, sheet, 'backbone' AS sheettype, CAST(count(*) FILTER (WHERE NOT skipped) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE skipped) AS BIGINT) AS skipped, count(*) FILTER (WHERE NOT skipped) = 0 AS failed FROM t GROUP BY file, sheet""", t=TYPED))
def sheet_summary(spark, d):
    return sheets.sheet_summary(typed_rows(spark, d))


@query("a12_regroup_by_sheet", oracle("SELECT file, sheet, sheettype, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS cidrs FROM z_sheet GROUP BY file, sheet, sheettype"))
def regroup_by_sheet(spark, d):
    return C.regroup_by_sheet(sheet_row_cidrs(inputs.sheet_rows(spark, d)))


@query("t15_missing_header", oracle("""
    SELECT file, sheet, row_index, vlan = '""' AS vlan_empty, true AS nothing_empty FROM t WHERE NOT skipped""", t=TYPED))
def missing_header(spark, d):
    rows = sheets.kept_rows(typed_rows(spark, d))
    return rows.select("file", "sheet", "row_index", (F.to_json("vlan") == '""').alias("vlan_empty"), (F.to_json("nothing") == '""').alias("nothing_empty"))
