"""IP and CIDR functions."""

from pyspark.sql import functions as F

from cidrloom.functions import ip
from cidrloom.operators.traces import expand_targets
from workload.registry import query
from workload.shapes import BASE, ip4, oracle, run, shape, table

OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"{OCT}(\.{OCT}){{3}}"


def duck_ip(t: str) -> str:
    """DuckDB: dotted quad text to BIGINT."""
    return "(" + " + ".join(f"CAST(split_part({t}, '.', {i}) AS BIGINT) * {m}" for i, m in ((1, 16777216), (2, 65536), (3, 256), (4, 1))) + ")"


MIXED = """
    SELECT k, CASE WHEN k % 8 = 0 THEN concat('0', network) WHEN k % 8 = 1 THEN split_part(network, '/', 1)
                   WHEN k % 8 = 2 THEN concat(network, '9') WHEN k % 8 = 3 THEN concat('2001:db8:', k, '::/', 20 + k % 100)
                   ELSE concat({addr}, '/', plen) END AS text FROM z_nets""".format(addr=ip4("addr"))


@query("i1_parse_cidr", oracle(f"""
    SELECT k, CAST(CASE WHEN k % 8 = 3 THEN 6 ELSE 4 END AS BIGINT) AS family, CAST(split_part(text, '/', 2) AS BIGINT) AS plen,
           CASE WHEN k % 8 = 3 THEN text ELSE text END AS canonical,
           CASE WHEN k % 8 <> 3 THEN {duck_ip("split_part(text, '/', 1)")} END AS v4
    FROM m WHERE (k % 8 = 3 AND 20 + k % 100 <= 128) OR (regexp_full_match(text, '{V4}/[0-9]{{1,2}}') AND CAST(split_part(text, '/', 2) AS INT) <= 32)""",
    m=MIXED))
def parse_cidr(spark, d):
    rows = run(spark, d, MIXED).withColumn("c", ip.parse_cidr(F.col("text"))).filter("c IS NOT NULL")
    return rows.select("k", F.col("c.family").cast("bigint").alias("family"), F.col("c.plen").cast("bigint").alias("plen"),
                       ip.cidr_text(F.col("c")).alias("canonical"), F.when(F.col("c.family") == 4, F.col("c.lo")).alias("v4"))


@query("i1_parse_ip", oracle(f"""
    SELECT event_id, ip AS number FROM z_log_ips WHERE event_id % 9 <> 0"""))
def parse_ip(spark, d):
    text = run(spark, d, f"SELECT event_id, CASE WHEN event_id % 9 = 0 THEN concat(' ', {ip4('ip')}) ELSE {ip4('ip')} END AS text FROM z_log_ips")
    return text.withColumn("c", ip.parse_ip(F.col("text"))).filter("c IS NOT NULL").select("event_id", F.col("c.lo").alias("number"))


# Address tokens of whole document texts; every document counts.
@query("i2_parse_addresses_documents", oracle(rf"""
    SELECT doc_id, CAST(count(*) FILTER (WHERE good) AS BIGINT) AS nets, CAST(count(*) FILTER (WHERE NOT good) AS BIGINT) AS bad
    FROM (SELECT doc_id, regexp_full_match(tok, '{V4}(/(3[0-2]|[12]?[0-9]|0[0-9]))?') AS good FROM toks WHERE tok <> '') x GROUP BY doc_id""",
    toks=rf"""SELECT doc_id, unnest(list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n|\r|\n', ',', 'g'), '[\s\pZ\x0b\x85]*\([^)]*\)', '', 'g'), ','),
              lambda t: regexp_replace(t, '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g'))) AS tok FROM documents"""))
def parse_addresses_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ip.parse_addresses(F.col("text")).alias("p"))
    out = docs.select("doc_id", F.size("p.nets").cast("bigint").alias("nets"), F.col("p.bad").cast("bigint").alias("bad"))
    return out.filter((F.col("nets") > 0) | (F.col("bad") > 0))


CELLS = f"""SELECT k, concat({ip4('net')}, '/', plen, ', ', {ip4('addr')}, ' (VIP: x),', chr(10), 'host', k, chr(13), chr(10), {ip4('net')}, ' - ', {ip4('net + size - 1')}) AS cell, net, addr, plen FROM z_nets"""


@query("i2_parse_addresses_cells", oracle(f"""
    SELECT k, concat_ws(';', concat({ip4('net')}, '/', plen), concat({ip4('addr')}, '/32'), concat({ip4('net')}, '/', plen)) AS nets, CAST(1 AS BIGINT) AS bad FROM z_nets"""))
def parse_addresses_cells(spark, d):
    rows = run(spark, d, CELLS).select("k", ip.parse_addresses(F.col("cell")).alias("p"))
    return rows.select("k", F.array_join(F.transform("p.nets", ip.cidr_text), ";").alias("nets"), F.col("p.bad").cast("bigint").alias("bad"))


# Cover of [addr, addr + n]: at every size one block on either side, where the ends are not aligned to the next size.
RANGES = f"SELECT k, addr AS a, addr + (k * 7907) % 5000 AS z FROM z_nets"


@query("i3_range_to_cidrs", oracle("""
    SELECT k, CAST(lo AS BIGINT) AS lo, CAST(32 - lvl AS BIGINT) AS plen FROM (
        SELECT k, lvl, l * (1::BIGINT << lvl) AS lo FROM lv WHERE l < r AND l % 2 = 1
        UNION ALL SELECT k, lvl, (r - 1) * (1::BIGINT << lvl) FROM lv WHERE l < r AND r % 2 = 1) t""",
    rg=RANGES,
    lv="SELECT k, lvl, (a + (1::BIGINT << lvl) - 1) // (1::BIGINT << lvl) AS l, (z + 1) // (1::BIGINT << lvl) AS r FROM rg, (SELECT CAST(unnest(range(0, 33)) AS BIGINT) AS lvl) s"))
def range_to_cidrs(spark, d):
    rows = run(spark, d, RANGES)
    host = lambda c: ip.cidr_struct(4, 32, 0, F.col(c))
    nets = rows.select("k", F.explode(ip.range_to_cidrs(host("a"), host("z"))).alias("n"))
    return nets.select("k", F.col("n.lo").alias("lo"), F.col("n.plen").cast("bigint").alias("plen"))


INETNUM = f"""SELECT k, net, plen, size, CASE WHEN k % 5 = 0 THEN concat({ip4('net + 1')}, ' - ', {ip4('net + size')}) WHEN k % 5 = 1 THEN network WHEN k % 5 = 2 THEN {ip4('net')}
              WHEN k % 5 = 3 THEN concat({ip4('net')}, ' - 2001:db8::') ELSE concat({ip4('net')}, ' - ', {ip4('net + size - 1')}) END AS inetnum FROM z_nets"""


@query("i4_inetnum_to_net", oracle(f"""
    SELECT k, CASE WHEN k % 5 = 0 THEN CASE WHEN size = 1 THEN concat({ip4('net + 1')}, '/32') END WHEN k % 5 IN (2, 3) THEN NULL ELSE concat({ip4('net')}, '/', plen) END AS network FROM m""", m=INETNUM))
def inetnum_to_net(spark, d):
    rows = run(spark, d, INETNUM).select("k", ip.inetnum_to_net(F.col("inetnum")).alias("n"))
    return rows.select("k", ip.cidr_text(F.col("n")).alias("network"))


@query("i5_cidr_contains", oracle("""
    SELECT t.trace_id, (w.net <= t.dest AND t.dest < w.net + w.size) AS covers
    FROM z_traces t JOIN z_nets w ON w.k = 1 + t.k % 100"""))
def cidr_contains(spark, d):
    rows = run(spark, d, "SELECT t.trace_id, t.destination, w.network FROM z_traces t JOIN z_nets w ON w.k = 1 + t.k % 100")
    rows = rows.select("trace_id", ip.parse_cidr(F.col("network")).alias("n"), ip.parse_ip(F.col("destination")).alias("a"))
    return rows.select("trace_id", ip.cidr_contains(F.col("n"), F.col("a")).alias("covers"))


ORDERED = "SELECT k, CASE WHEN k % 10 = 0 THEN concat('bad-', k) WHEN k % 10 = 1 THEN concat('2001:db8:', k % 7, '::/48') ELSE network END AS text, net, plen FROM z_nets"


@query("i6_cidr_order", oracle("""
    SELECT DISTINCT text, k % 10 = 0 AS last, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN concat('6', '20010db8', lpad(CAST(k % 7 AS VARCHAR), 4, '0'), repeat('0', 20))
                           ELSE concat('4', lpad(lower(hex(net)), 32, '0')) END AS address, CASE WHEN k % 10 = 1 THEN 48 WHEN k % 10 > 1 THEN plen END AS plen
    FROM o""", o=ORDERED))
def cidr_order(spark, d):
    texts = run(spark, d, f"SELECT DISTINCT text FROM ({ORDERED}) t").orderBy(*ip.cidr_order(F.col("text")))
    keyed = texts.withColumn("c", ip.parse_cidr(F.col("text")))
    return keyed.select("text", F.col("c").isNull().alias("last"), ip.address_order(F.col("c")).alias("address"), F.col("c.plen").cast("bigint").alias("plen"))


def duck_targets(first4: str = "n.net + 1, n.net + 2, n.net + 3, n.net + 4, n.net + n.size - 4, n.net + n.size - 3, n.net + n.size - 2") -> str:
    return f"""SELECT network, unnest(CASE WHEN plen = 32 THEN [n.net] WHEN plen = 31 THEN [n.net, n.net + 1] WHEN plen = 30 THEN [n.net + 1, n.net + 2]
               WHEN plen = 29 THEN range(n.net + 1, n.net + 7) ELSE [{first4}] END) AS ip FROM (SELECT DISTINCT network, net, plen, size FROM z_nets) n"""


@query("i7_sample_targets", oracle(duck_targets()))
def sample_targets(spark, d):
    nets = run(spark, d, "SELECT DISTINCT network FROM z_nets").withColumn("net", ip.parse_cidr(F.col("network")))
    return expand_targets(nets, "net").select(ip.cidr_text(F.col("net")).alias("network"), "ip")


@query("i7_usable_hosts", oracle("""
    SELECT network, CAST(count(*) AS BIGINT) AS hosts, min(ip) AS first_host, max(ip) AS last_host
    FROM (SELECT network, unnest(CASE WHEN plen >= 31 THEN range(net, net + size) ELSE range(net + 1, net + size - 1) END) AS ip
          FROM (SELECT DISTINCT network, net, plen, size FROM z_nets) n) t GROUP BY network"""))
def usable_hosts(spark, d):
    nets = run(spark, d, "SELECT DISTINCT network FROM z_nets").withColumn("net", ip.parse_cidr(F.col("network")))
    hosts = expand_targets(nets, "net", full=True, block=1024)
    out = hosts.groupBy("net").agg(F.count("*").alias("hosts"), F.min("ip").alias("first_host"), F.max("ip").alias("last_host"))
    return out.select(ip.cidr_text(F.col("net")).alias("network"), "hosts", "first_host", "last_host")


@query("i8_ip_bucket", oracle(f"""
    SELECT concat({ip4('ip // 64 * 64')}, '/26') AS bucket, CAST(count(*) AS BIGINT) AS ips FROM z_log_ips GROUP BY 1"""))
def ip_bucket(spark, d):
    rows = run(spark, d, f"SELECT {ip4('ip')} AS text FROM z_log_ips").select(ip.parse_ip(F.col("text")).alias("a"))
    grouped = rows.select(ip.ip_bucket(F.col("a")).alias("b")).groupBy("b").agg(F.count("*").alias("ips"))
    return grouped.select(ip.cidr_text(F.col("b")).alias("bucket"), "ips")


@query("i9_host_net", oracle(f"SELECT event_id, concat({ip4('ip')}, '/32') AS network FROM z_log_ips"))
def host_net(spark, d):
    rows = run(spark, d, f"SELECT event_id, {ip4('ip')} AS text FROM z_log_ips").select("event_id", ip.parse_ip(F.col("text")).alias("a"))
    return rows.select("event_id", ip.cidr_text(ip.host_net(F.col("a"))).alias("network"))


@query("i10_reverse_name", oracle("""
    SELECT event_id, concat(ip % 256, '.', (ip // 256) % 256, '.', (ip // 65536) % 256, '.', ip // 16777216, '.origin.asn.cymru.com') AS name,
           concat('as', 64496 + user_id % 16, '.asn.cymru.com') AS as_name FROM z_log_ips"""))
def reverse_name(spark, d):
    rows = run(spark, d, f"SELECT event_id, user_id, {ip4('ip')} AS text FROM z_log_ips")
    return rows.select("event_id", ip.reverse_name(ip.parse_ip(F.col("text"))).alias("name"), ip.asname_key(64496 + F.col("user_id") % 16).alias("as_name"))


@query("i11_is_host_route", oracle("SELECT network, plen = 32 AS host_route FROM (SELECT DISTINCT network, plen FROM z_nets) t"))
def is_host_route(spark, d):
    rows = run(spark, d, "SELECT DISTINCT network FROM z_nets")
    return rows.select("network", ip.is_host_route(F.col("network")).alias("host_route"))
