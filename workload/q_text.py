"""Text, JSON and pattern columns."""

from pyspark.sql import functions as F

from cidrloom.functions import fields, patterns, text
from cidrloom.functions.fields import ProjectedField
from cidrloom.functions.ip import cidr_text, let
from cidrloom.functions.jsontext import canonical
from cidrloom.functions.patterns import INTERFACE_CODES, INTERFACE_NORMALIZER, Normalizer, NormalizeRule, PtrPattern
from cidrloom.sources.sheets import cell_struct
from workload.registry import query
from workload.shapes import COUNTRIES, oracle, run, shape, table

PATTERNS = [
    PtrPattern(
        domain="example.com",
        regex=r"^(?:(?P<facing>user(?:\.virtual)?|virtual)\.)?(?:as(?P<customer_asn>\d+)\.)?(?P<interface>[a-z]+-[\d-]+)\.(?P<device>(?P<device_role>[a-z]+)\d+)\.(?P<facility>[a-z]+\d+)\.example\.com$",
        excludes=("^mgmt", "unknown-3-"),
    ),
    PtrPattern(domain="example.net", regex="{interface}.{device}.{facility}"),
]
# The same two patterns for DuckDB, without names: facing, asn, interface, device, role, facility.
RE_COM = r"^(?:(user(?:\.virtual)?|virtual)\.)?(?:as(\d+)\.)?([a-z]+-[\d-]+)\.(([a-z]+)\d+)\.([a-z]+\d+)\.example\.com$"
RE_NET = r"^([^.]+)\.([^.]+)\.([^.]+)\.example\.net$"


def duck_ptr(p: str) -> dict[str, str]:
    """DuckDB expressions of the parsed device of hostname `p`."""
    com = f"(ends_with({p}, 'example.com') AND regexp_matches({p}, '{RE_COM}'))"
    net = f"(ends_with({p}, 'example.net') AND regexp_matches({p}, '{RE_NET}'))"

    def pick(com_group: int, net_group: int | None) -> str:
        second = f"WHEN {net} THEN regexp_extract({p}, '{RE_NET}', {net_group})" if net_group else ""
        return f"nullif(CASE WHEN {com} THEN regexp_extract({p}, '{RE_COM}', {com_group}) {second} END, '')"

    facing = pick(1, None)
    asn = f"CAST({pick(2, None)} AS BIGINT)"
    return {
        "matched": f"coalesce({com} OR {net}, false)",
        "interface": pick(3, 1),
        "device": pick(4, 2),
        "device_role": pick(5, None),
        "facility": pick(6, 3),
        "customer_asn": asn,
        "facing": f"CASE WHEN NOT coalesce({com} OR {net}, false) THEN NULL WHEN {facing} LIKE 'user%' AND {facing} LIKE '%virtual%' THEN 'user_virtual' WHEN {facing} LIKE 'user%' THEN 'user' "
        f"WHEN {facing} LIKE 'virtual%' THEN 'virtual' WHEN {facing} IS NULL AND {asn} IS NOT NULL THEN 'bgp_peer' WHEN {facing} IS NULL THEN 'network' END",
    }


ASNS = "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN concat('AS', c_custkey) WHEN c_custkey % 7 = 1 THEN concat('as', c_custkey) WHEN c_custkey % 7 = 2 THEN concat('ASAS', c_custkey) WHEN c_custkey % 7 = 3 THEN concat(c_custkey, '00000000') WHEN c_custkey % 7 = 4 THEN concat(' ', c_custkey) WHEN c_custkey % 7 = 5 THEN '' ELSE CAST(c_custkey AS STRING) END AS t FROM @customer@"


@query("t1_parse_asn", oracle("""
    SELECT k, CASE WHEN k % 7 = 0 OR k % 7 = 6 THEN k WHEN k % 7 = 3 AND k * 100000000 <= 4294967295 THEN k * 100000000 END AS asn FROM a""", a=ASNS))
def parse_asn(spark, d):
    return run(spark, d, ASNS).select("k", text.parse_asn(F.col("t")).alias("asn"))


STRICT = "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN concat(' AS', c_custkey) WHEN c_custkey % 4 = 1 THEN concat('ASas', c_custkey, ' ') WHEN c_custkey % 4 = 2 THEN concat('ASAS', c_custkey) ELSE CAST(c_custkey AS STRING) END AS t FROM @customer@"


@query("t2_parse_asn_strict", oracle("SELECT k, k AS asn FROM a", a=STRICT))
def parse_asn_strict(spark, d):
    return run(spark, d, STRICT).select("k", text.parse_asn_strict(F.col("t")).alias("asn"))


CONTINENTS = "SELECT * FROM (VALUES ('JP','AS'),('CN','AS'),('US','NA'),('GB','EU'),('AU','OC'),('ZA','AF'),('BR','SA'),('DE','EU'),('FR','EU'),('IN','AS'),('KR','AS'),('AR','SA'),('EG','AF'),('NG','AF'),('NZ','OC'),('FJ','OC'),('CA','NA'),('MX','NA'),('CL','SA'),('SE','EU'),('IT','EU'),('KE','AF'),('AQ','AN'),('VN','AS')) v(cc, continent)"


@query("t3_continent_of", oracle("""
    SELECT w.k, w.country, c.continent FROM z_whois_all w LEFT JOIN conts c ON c.cc = w.country""", conts=CONTINENTS))
def continent_of(spark, d):
    return shape(spark, d, "z_whois_all").select("k", "country", text.continent_of(F.col("country")).alias("continent"))


ORIGIN_TXT = f"SELECT k, network, concat(CASE WHEN k % 10 = 0 THEN 'none' ELSE CAST(64496 + c_nationkey AS STRING) END, ' | ', network, ' | ', split_part('{COUNTRIES}', ' ', CAST(c_nationkey + 1 AS INT)), CASE WHEN k % 10 = 1 THEN '' ELSE ' | apnic | 2001-01-01 ' END) AS txt, c_nationkey FROM z_nets"


@query("t4_parse_origin_txt", oracle(f"""
    SELECT k, 64496 + CAST(c_nationkey AS BIGINT) AS asn, network AS prefix, split_part('{COUNTRIES}', ' ', CAST(c_nationkey + 1 AS INT)) AS country, 'apnic' AS registry, '2001-01-01' AS allocated
    FROM o WHERE k % 10 > 1""", o=ORIGIN_TXT))
def parse_origin_txt(spark, d):
    rows = run(spark, d, ORIGIN_TXT).select("k", text.parse_origin_txt(F.col("txt")).alias("o"))
    return rows.filter("o IS NOT NULL").select("k", "o.*")


ASNAME_TXT = "SELECT k, c_name, concat('64496 | JP | apnic | 2001-01-01', CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN ' | ' WHEN k % 5 = 2 THEN concat(' | ', c_name, ' Inc., JP') WHEN k % 5 = 3 THEN concat(' | ', c_name, ', jp') ELSE concat(' | ', c_name, ', US X') END) AS txt FROM z_nets"


@query("t5_parse_asname_txt", oracle("""
    SELECT k, CASE WHEN k % 5 < 2 THEN NULL WHEN k % 5 = 2 THEN concat(c_name, ' Inc.') WHEN k % 5 = 3 THEN concat(c_name, ', jp') ELSE concat(c_name, ', US X') END AS name FROM a""", a=ASNAME_TXT))
def parse_asname_txt(spark, d):
    return run(spark, d, ASNAME_TXT).select("k", text.parse_asname_txt(F.col("txt")).alias("name"))


@query("t6_trim_country_suffix", oracle(r"SELECT doc_id, regexp_replace(text, ', [A-Z]{2}$', '') AS trimmed FROM documents"))
def trim_country_suffix(spark, d):
    return table(spark, d, "documents").select("doc_id", text.trim_country_suffix(F.col("text")).alias("trimmed"))


@query("t7_trim_trailing_dots", oracle(r"SELECT page_id, rtrim(concat(host, CASE WHEN page_id % 3 = 0 THEN '..' WHEN page_id % 3 = 1 THEN '.' ELSE '' END), '.') AS host FROM z_hosts"))
def trim_trailing_dots(spark, d):
    rows = run(spark, d, "SELECT page_id, concat(host, CASE WHEN page_id % 3 = 0 THEN '..' WHEN page_id % 3 = 1 THEN '.' ELSE '' END) AS host FROM z_hosts")
    return rows.select("page_id", text.trim_trailing_dots(F.col("host")).alias("host"))


@query("t8_epoch_to_iso", oracle("SELECT event_id, strftime(to_timestamp(820454400 + event_id * 7919), '%Y-%m-%dT%H:%M:%SZ') AS at FROM z_log_ips"))
def epoch_to_iso(spark, d):
    return shape(spark, d, "z_log_ips").select("event_id", text.epoch_to_iso(820454400 + F.col("event_id") * 7919).alias("at"))


@query("t9_snake_case", oracle(r"""
    SELECT p_partkey, trim(regexp_replace(lower(trim(concat(' ', p_type, ' / ', p_name, '-(', p_brand, ') '))), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS name FROM part"""))
def snake_case(spark, d):
    header = F.concat(F.lit(" "), "p_type", F.lit(" / "), "p_name", F.lit("-("), "p_brand", F.lit(") "))
    return table(spark, d, "part").select("p_partkey", text.snake_case(header).alias("name"))


def _cells(spark, d):
    return shape(spark, d, "z_cells").select("file", "sheet", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), cell_struct().alias("cell"))


def _cast(spark, d, to, value):
    cells = _cells(spark, d).withColumn("v", text.CELL_CASTS[to](F.col("cell")))
    return cells.select("file", "sheet", "row", "col", value(F.col("v.value")).alias("value"), F.col("v.bad").alias("bad"))


CELL_KEYS = "file, sheet, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col"


@query("t10_cast_cell_string", oracle(f"""
    SELECT {CELL_KEYS}, CASE kind WHEN 'string' THEN trim(s) WHEN 'int' THEN CAST(i AS VARCHAR) WHEN 'bool' THEN CAST(b AS VARCHAR) WHEN 'empty' THEN ''
                        WHEN 'float' THEN CASE WHEN f = floor(f) THEN CAST(CAST(f AS BIGINT) AS VARCHAR) ELSE CAST(f AS VARCHAR) END END AS value, false AS bad FROM z_cells"""))
def cast_cell_string(spark, d):
    return _cast(spark, d, "string", lambda v: v)


@query("t11_cast_cell_integer", oracle(f"""
    SELECT {CELL_KEYS}, v AS value, v IS NULL AS bad FROM (SELECT *, CASE kind WHEN 'int' THEN i WHEN 'float' THEN CAST(trunc(f) AS BIGINT) WHEN 'bool' THEN CAST(b AS BIGINT)
        WHEN 'string' THEN CASE WHEN regexp_full_match(trim(s), '[+-]?[0-9]+') THEN CAST(trim(s) AS BIGINT) END END AS v FROM z_cells) t"""))
def cast_cell_integer(spark, d):
    return _cast(spark, d, "integer", lambda v: v)


@query("t12_cast_cell_bool", oracle(f"""
    SELECT {CELL_KEYS}, v AS value, v IS NULL AS bad FROM (SELECT *, CASE kind WHEN 'bool' THEN b WHEN 'int' THEN i <> 0
        WHEN 'string' THEN CASE WHEN lower(trim(s)) IN ('true', '1') THEN true WHEN lower(trim(s)) IN ('false', '0') THEN false END END AS v FROM z_cells) t"""))
def cast_cell_bool(spark, d):
    return _cast(spark, d, "bool", lambda v: v)


@query("t13_cast_cell_addresses", oracle(rf"""
    SELECT {CELL_KEYS}, CASE WHEN kind = 'empty' THEN '' WHEN kind = 'string' THEN array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(s, '\s*\([^)]*\)', '', 'g'), ','), lambda t: trim(t)),
           lambda t: regexp_full_match(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(/[0-9]+)?')), lambda t: CASE WHEN contains(t, '/') THEN t ELSE concat(t, '/32') END), ';') END AS value,
           kind NOT IN ('string', 'empty') AS bad FROM z_cells"""))
def cast_cell_addresses(spark, d):
    return _cast(spark, d, "addresses", lambda v: F.array_join(F.transform(v, cidr_text), ";"))


@query("t14_merge_addresses", oracle(r"""
    SELECT file, sheet, row, nullif(array_to_string(CASE WHEN x = y THEN [x] WHEN second THEN [x, y] ELSE [x, y] END, ';'), '') AS nets FROM (
        SELECT a.file, a.sheet, CAST(a.row AS BIGINT) AS row, split_part(a.s, ',', 1) AS x, concat(trim(split_part(split_part(a.s, ',', 2), '(', 1)), '/32') AS y, true AS second
        FROM z_cells a WHERE a.col = 3 AND a.row > 3) t"""))
def merge_addresses(spark, d):
    cells = _cells(spark, d).filter("row > 3 AND col IN (3, 4)").groupBy("file", "sheet", "row").agg(
        F.first(F.when(F.col("col") == 3, F.col("cell")), True).alias("a"), F.first(F.when(F.col("col") == 4, F.col("cell")), True).alias("b"))
    nets = text.merge_addresses([F.col("a"), F.col("b")])
    return cells.select("file", "sheet", "row", F.array_join(F.transform(nets, cidr_text), ";").alias("nets"))


def _logs(spark, d):
    return shape(spark, d, "z_logs").select("event_id", canonical(F.col("line")).alias("record"))


@query("t16_flatten_fields", oracle("""
    SELECT p.path, p.tag AS type_tag, CAST(count(*) AS BIGINT) AS n FROM z_logs l, LATERAL (
        SELECT unnest(['cents', 'deep', 'deep.x', 'deep.x.y', 'deep.z', 'flag', 'id', 'ip', 'num', 'props', 'props.k', 'ratio', 'tags', 'type']) AS path,
               unnest(['number', 'object', 'object', 'number', 'string', CASE WHEN event_id % 3 = 1 THEN 'bool' ELSE 'string' END, 'number', CASE WHEN event_id % 17 = 0 THEN 'null' ELSE 'string' END,
                       CASE WHEN event_id % 4 = 1 THEN 'number' ELSE 'string' END, 'object', 'number', 'number', 'list', 'string']) AS tag) p GROUP BY ALL"""))
def flatten_fields(spark, d):
    nodes = fields.flatten_fields(_logs(spark, d), "record", ["event_id"])
    return nodes.groupBy("path", "type_tag").agg(F.count("*").alias("n"))


@query("t17_flatten_display", oracle("""
    SELECT e.event_id, unnest(['cents', 'deep.x.y', 'deep.z', 'flag', 'id', 'ip', 'num', 'props.k', 'ratio', 'tags', 'type']) AS key,
           unnest([CAST(cents AS VARCHAR), CAST(e.event_id % 7 AS VARCHAR), 'w', flag, CAST(e.event_id AS VARCHAR), ip_text, num,
                   regexp_extract(props, '[0-9]+'), ratio, concat('a, ', e.event_id % 5, ', true, null'), event_type]) AS text FROM z_log_ips e JOIN z_log_texts t ON t.event_id = e.event_id"""))
def flatten_display(spark, d):
    return fields.flatten_display(_logs(spark, d), "record", ["event_id"]).select("event_id", "key", "text")


@query("t18_get_by_path", oracle("SELECT event_id, event_id % 7 AS y, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, true AS missing FROM z_log_ips"))
def get_by_path(spark, d):
    v = lambda p: fields.get_by_path(F.col("record"), p)
    logs = _logs(spark, d).withColumn("record", F.parse_json("record"))
    return logs.select("event_id", v("deep.x.y").cast("bigint").alias("y"), v("props.k").cast("bigint").alias("k"), v("deep.q.y").isNull().alias("missing"))


@query("t19_coerce", oracle("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN '64497' WHEN 1 THEN '7' ELSE '"not-a-number"' END AS as_integer,
           CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '"maybe"' END AS as_bool,
           concat('"a|', event_id % 5, '|true|null"') AS joined, '""' AS list_text, concat('{"y":', event_id % 7, '}') AS kept, concat('"', event_id, '"') AS as_string,
           concat('"', ratio, '"') AS ratio_string, ratio AS ratio_integer FROM z_log_texts"""))
def coerce(spark, d):
    def cell(path, to):
        return let(fields.node_at(F.col("record"), path), lambda n: fields.coerce_text(n["type_tag"], n["value"], to, "|"))

    return _logs(spark, d).select(
        "event_id", cell("num", "integer").alias("as_integer"), cell("flag", "bool").alias("as_bool"), cell("tags", "array_join").alias("joined"), cell("tags", "string").alias("list_text"),
        cell("deep.x", "array_join").alias("kept"), cell("id", "string").alias("as_string"), cell("ratio", "string").alias("ratio_string"), cell("ratio", "integer").alias("ratio_integer"))


PROJECTION = [ProjectedField("deep", "d", "string"), ProjectedField("deep.x.y", "why", "integer"), ProjectedField("id", None, "string"), ProjectedField("gone"), ProjectedField("tags", "t", "array_join"), ProjectedField("type", "id"), ProjectedField("ratio")]


@query("t20_project_fields", oracle("""
    SELECT e.event_id, concat('{"d.z":"w","id":"', event_type, '","ratio":', ratio, ',"t":"a, ', e.event_id % 5, ', true, null","why":', e.event_id % 7, '}') AS record FROM z_log_ips e JOIN z_log_texts t ON t.event_id = e.event_id"""))
def project_fields(spark, d):
    return fields.project_record(_logs(spark, d), "record", "event_id", PROJECTION)


def _duck_normalize(col: str) -> str:
    for prefix, code in INTERFACE_CODES:
        col = rf"regexp_replace({col}, '(?i){prefix}(\d+(?:[/\.]\d+)*)', '{code}-\1', 'g')"
    return f"lower(replace(replace({col}, '/', '-'), '.', '-'))"


HOST_RULES = Normalizer((NormalizeRule(r"^(?P<a>[a-z]+)\.(?P<b>[^.]+)", "$b<${a}>$$$none"), NormalizeRule("[aeiou]+", "")), "upper", ("^SH", r"\$$"))


@query("p1_normalize", oracle(r"""
    SELECT page_id, upper(regexp_replace(regexp_replace(host, '^([a-z]+)\.([^.]+)', '\2<\1>$'), '[aeiou]+', '', 'g')) AS host FROM z_hosts"""))
def normalize(spark, d):
    return shape(spark, d, "z_hosts").select("page_id", patterns.normalize(HOST_RULES, F.col("host")).alias("host"))


@query("p2_normalize_excluded", oracle(r"""
    SELECT page_id, regexp_matches(h, '^SH|\$$') AS excluded FROM (SELECT page_id, upper(regexp_replace(regexp_replace(host, '^([a-z]+)\.([^.]+)', '\2<\1>$'), '[aeiou]+', '', 'g')) AS h FROM z_hosts) t"""))
def normalize_excluded(spark, d):
    return shape(spark, d, "z_hosts").select("page_id", patterns.normalize_excluded(HOST_RULES, patterns.normalize(HOST_RULES, F.col("host"))).alias("excluded"))


NAMES = "SELECT DISTINCT ptr AS name FROM z_dns WHERE ptr IS NOT NULL UNION SELECT DISTINCT host AS name FROM z_hosts"
_D = duck_ptr("name")


@query("p4_parse_ptr", oracle(f"""
    SELECT name, {', '.join(f'{_D[c]} AS {c}' for c in ('interface', 'device', 'device_role', 'facility', 'customer_asn'))}, {_D['matched']} AS matched FROM n""", n=NAMES))
def parse_ptr(spark, d):
    rows = run(spark, d, NAMES).select("name", patterns.parse_ptr(F.col("name"), PATTERNS).alias("v"))
    return rows.select("name", *[F.col(f"v.{c}").alias(c) for c in ("interface", "device", "device_role", "facility", "customer_asn")], F.col("v").isNotNull().alias("matched"))


@query("p5_facing", oracle(f"SELECT name, {_D['facing']} AS facing FROM n", n=NAMES))
def facing(spark, d):
    rows = run(spark, d, NAMES).select("name", patterns.parse_ptr(F.col("name"), PATTERNS).alias("v"))
    return rows.select("name", F.col("v.facing").alias("facing"))


@query("p6_ptr_excluded", oracle("SELECT name, regexp_matches(name, '^mgmt|unknown-3-') AS excluded FROM n", n=NAMES))
def ptr_excluded(spark, d):
    return run(spark, d, NAMES).select("name", patterns.ptr_excluded(PATTERNS[0], F.col("name")).alias("excluded"))


@query("p7_vendor_interfaces", oracle(f"SELECT p_partkey, port, {_duck_normalize('port')} AS name FROM z_ports"))
def vendor_interfaces(spark, d):
    return shape(spark, d, "z_ports").select("p_partkey", "port", patterns.normalize(INTERFACE_NORMALIZER, F.col("port")).alias("name"))
