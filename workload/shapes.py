"""Inputs derived from the given tables, in SQL that reads the same in Spark and DuckDB.

`@name@` is a base table, `//` is integer division; names that start with `z_` are shapes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cidrloom.session import staging_path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# First address of the derived address space (198.51.100.0) and its size.
BASE = 3325256704
COUNTRIES = "JP CN US GB AU ZA BR XX DE FR IN KR AR EG NG NZ FJ CA MX CL SE IT KE AQ VN"


def ip4(x: str) -> str:
    """BIGINT expression to dotted quad text."""
    return f"concat(({x}) // 16777216, '.', (({x}) // 65536) % 256, '.', (({x}) // 256) % 256, '.', ({x}) % 256)"


def pow2(n: str) -> str:
    return f"CAST(pow(2, {n}) AS BIGINT)"


def pad(x: str, n: int = 2) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


_HEADERS = " UNION ALL ".join(
    f"SELECT DISTINCT concat('book', p_partkey % 3, '.xlsx') AS file, p_brand AS sheet, {i} AS col, '{name}' AS name FROM @part@"
    for i, name in enumerate([" Host Name ", "VLAN-ID", "In Use?", "Address", "Address 2", "Price"])
)

SHAPES = {
    # Prefixes from customers, lengths 20..32.
    "z_nets": f"""
        SELECT k, c_name, c_mktsegment, c_nationkey, plen, size, a // size * size AS net, a AS addr,
               concat({ip4('a // size * size')}, '/', plen) AS network
        FROM (SELECT c_custkey AS k, c_name, c_mktsegment, c_nationkey, 20 + c_custkey % 13 AS plen,
                     {pow2('32 - (20 + c_custkey % 13)')} AS size, {BASE} + (c_custkey * 104729) % 65536 AS a
              FROM @customer@)""",
    # Registry records: customer prefixes plus a few wide ones, /0 among them.
    "z_whois_all": f"""
        SELECT k, network, net, plen, size, c_name AS netname, c_mktsegment AS descr,
               split_part('{COUNTRIES}', ' ', CAST(c_nationkey + 1 AS INT)) AS country,
               concat('AS', 64496 + c_nationkey % 16) AS as_num, concat('NET-', c_nationkey) AS as_name
        FROM z_nets
        UNION ALL
        SELECT -1 - r_regionkey AS k, concat({ip4(f'{BASE} // size * size')}, '/', plen) AS network,
               {BASE} // size * size AS net, plen, size, r_name AS netname, CAST(NULL AS STRING) AS descr,
               CAST(NULL AS STRING) AS country, CAST(NULL AS STRING) AS as_num, CAST(NULL AS STRING) AS as_name
        FROM (SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, CAST(r_regionkey * 4 AS BIGINT) AS plen,
                     {pow2('32 - r_regionkey * 4')} AS size FROM @region@)""",
    "z_whois": """
        SELECT k, network, net, plen, size, netname, descr, country, as_num, as_name
        FROM (SELECT *, row_number() OVER (PARTITION BY net, plen ORDER BY k DESC) AS rn FROM z_whois_all) t WHERE rn = 1""",
    "z_log_ips": f"""
        SELECT event_id, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents, props,
               {BASE} + (event_id * 7919) % 131072 AS ip FROM @events@""",
    "z_logs": f"""
        SELECT event_id, ip, concat('{{"id":', event_id, ',"ip":', CASE WHEN event_id % 17 = 0 THEN 'null' WHEN event_id % 19 = 0 THEN '"2001:db8::1"'
                 ELSE concat('"', {ip4('ip')}, '"') END, ',"type":"', event_type, '","cents":', cents, ',"ratio":', CASE WHEN event_id % 3 = 0 THEN '1.0' WHEN event_id % 3 = 1 THEN '1e3' ELSE '2.50' END, ',"props":', props,
                 ',"flag":', CASE WHEN event_id % 3 = 0 THEN '"yes"' WHEN event_id % 3 = 1 THEN 'false' ELSE '"maybe"' END,
                 ',"num":', CASE WHEN event_id % 4 = 0 THEN '"64497"' WHEN event_id % 4 = 1 THEN '7' ELSE '"not-a-number"' END,
                 ',"tags":["a",', event_id % 5, ',true,null],"deep":{{"z":"v","x":{{"y":-1,"y":', event_id % 7, '}},"z":"w"}}}}') AS line
        FROM z_log_ips""",
    # The same records in canonical form: keys sorted, the last of repeated keys, numbers spelled out.
    "z_log_texts": f"""
        SELECT event_id, ip, concat('{{"cents":', cents, ',"deep":{{"x":{{"y":', event_id % 7, '}},"z":"w"}},"flag":', CASE WHEN flag = 'false' THEN 'false' ELSE concat('"', flag, '"') END,
                 ',"id":', event_id, ',"ip":', CASE WHEN event_id % 17 = 0 THEN 'null' ELSE concat('"', ip_text, '"') END) AS head,
               concat(',"num":', CASE WHEN num = '7' THEN num ELSE concat('"', num, '"') END, ',"props":', replace(props, ' ', ''), ',"ratio":', ratio,
                 ',"tags":["a",', event_id % 5, ',true,null],"type":"', event_type, '"}}') AS tail, flag, num, ratio, ip_text
        FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 3 = 1 THEN 'false' ELSE 'maybe' END AS flag,
                 CASE WHEN event_id % 4 = 0 THEN '64497' WHEN event_id % 4 = 1 THEN '7' ELSE 'not-a-number' END AS num,
                 CASE WHEN event_id % 3 = 0 THEN '1.0' WHEN event_id % 3 = 1 THEN '1000.0' ELSE '2.5' END AS ratio,
                 CASE WHEN event_id % 17 = 0 THEN 'null' WHEN event_id % 19 = 0 THEN '2001:db8::1' ELSE {ip4('ip')} END AS ip_text FROM z_log_ips) t""",
    "z_traces": f"""
        SELECT o_orderkey AS trace_id, n.network AS range, n.net, n.plen, n.size, n.k,
               concat(replace(CAST(o_orderdate AS STRING), ' ', 'T'), 'Z') AS measured_at, '192.0.2.1' AS source,
               {ip4('n.net + o.o_orderkey % n.size')} AS destination, n.net + o.o_orderkey % n.size AS dest,
               CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'UNREACH' ELSE 'GAPLIMIT' END AS stop_reason
        FROM @orders@ o JOIN z_nets n ON n.k = o.o_custkey""",
    # Probe replies; 140 router addresses, half of them outside the prefixes.
    "z_replies": f"""
        SELECT l_orderkey AS trace_id, CAST(l_linenumber AS BIGINT) AS ttl, l_partkey, l_suppkey, l_suppkey % 20 AS s,
               CASE WHEN l_partkey % 11 <> 0 THEN {BASE} + ((l_suppkey % 20) * 7919 + l_linenumber * 257) % 131072 END AS ip,
               CASE WHEN l_partkey % 13 <> 0 THEN l_quantity END AS rtt,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 0 ELSE 11 END AS icmp_type
        FROM @lineitem@""",
    "z_dns": f"""
        SELECT ip, {ip4('ip')} AS ip_text, s, ttl, CASE WHEN s % 9 <> 0 THEN 64496 + s % 16 END AS asn,
               CASE WHEN s % 6 = 0 THEN concat('xe-0-0-', ttl, '.rtr', {pad('s')}, '.dc', {pad('s % 4')}, '.example.com')
                    WHEN s % 6 = 1 THEN concat('user.virtual.ge-1-0-', ttl, '.edge', {pad('s')}, '.dc', {pad('s % 4')}, '.example.com')
                    WHEN s % 6 = 2 THEN concat('as', 64500 + s, '.xe-0-1-', ttl, '.rtr', {pad('s')}, '.pop', {pad('s % 4')}, '.example.com')
                    WHEN s % 6 = 3 THEN concat('unknown-', s, '-', ttl, '.example.com')
                    WHEN s % 6 = 4 THEN concat('et', ttl, '.core', {pad('s')}, '.dc', {pad('s % 4')}, '.example.net') END AS ptr
        FROM (SELECT DISTINCT ip, s, ttl FROM z_replies WHERE ip IS NOT NULL) t""",
    # What the trace jobs should find, in plain SQL: majority hops, hops inside the prefixes, votes, gateways.
    "z_targets": "SELECT DISTINCT network, net, plen, size FROM z_nets",
    "z_hops": f"""
        SELECT trace_id, ttl, ip FROM (
            SELECT trace_id, ttl, ip, row_number() OVER (PARTITION BY trace_id, ttl ORDER BY n DESC, {ip4('ip')}) AS rn
            FROM (SELECT trace_id, ttl, ip, count(*) AS n FROM z_replies WHERE ip IS NOT NULL GROUP BY trace_id, ttl, ip) t) u WHERE rn = 1""",
    "z_inside": "SELECT DISTINCT h.ip FROM (SELECT DISTINCT ip FROM z_hops) h JOIN z_targets n ON n.net <= h.ip AND h.ip < n.net + n.size",
    "z_kept": """
        SELECT h.trace_id, t.range, t.measured_at, t.destination, h.ip, h.ttl, row_number() OVER (PARTITION BY h.trace_id ORDER BY h.ttl) AS hop
        FROM z_hops h JOIN z_inside i ON i.ip = h.ip JOIN z_traces t ON t.trace_id = h.trace_id""",
    "z_votes": f"""
        SELECT range, hop, ip, votes FROM (
            SELECT range, hop, ip, votes, row_number() OVER (PARTITION BY range, hop ORDER BY votes DESC, {ip4('ip')}) AS rn
            FROM (SELECT range, hop, ip, count(*) AS votes FROM z_kept GROUP BY range, hop, ip) t) u WHERE rn = 1""",
    # Inventory rows as JSON lines: parts are backbone, suppliers are hosting.
    "z_sheet": f"""
        SELECT concat('book', p_partkey % 3, '.xlsx') AS file, p_brand AS sheet, p_partkey AS row_index, 'backbone' AS sheettype,
               p_partkey AS id, net, plen, concat({ip4('net')}, '/', plen) AS network,
               CASE WHEN p_partkey % 4 <> 3 THEN concat('RTR', {pad('p_partkey % 30')}) END AS host,
               CASE WHEN p_partkey % 4 < 2 THEN concat('xe-0/0/', 1 + p_partkey % 7) END AS port,
               CASE WHEN p_partkey % 2 = 0 THEN concat('dc', {pad('p_partkey % 4')}) ELSE 'n/a' END AS site
        FROM (SELECT p_partkey, p_brand, plen, a // {pow2('32 - plen')} * {pow2('32 - plen')} AS net
              FROM (SELECT p_partkey, p_brand, 22 + p_partkey % 9 AS plen, {BASE} + (p_partkey * 15485863) % 131072 AS a FROM @part@) t) u
        UNION ALL
        SELECT 'hosting.xlsx' AS file, concat('S', s_nationkey % 5) AS sheet, s_suppkey AS row_index, 'hosting' AS sheettype,
               -s_suppkey AS id, net, plen, network, CAST(NULL AS STRING) AS host, CAST(NULL AS STRING) AS port, 'hosted' AS site
        FROM @supplier@ s JOIN z_nets n ON n.k = 1 + (s.s_suppkey * 3) % 90""",
    "z_sheet_lines": """
        SELECT *, concat('{"_source":{"file":"', file, '","sheet":"', sheet, '","row_index":', row_index,
                 CASE WHEN id % 10 = 0 AND sheettype = 'backbone' THEN '' ELSE concat(',"sheettype":"', sheettype, '"') END, '}',
                 CASE WHEN host IS NULL THEN '' ELSE concat(',"host":"', host, '"') END,
                 CASE WHEN port IS NULL THEN '' ELSE concat(',"port":"', port, '"') END,
                 ',"site":"', site, '","notes":["x","', network, '/bad"],"network":["', network, '"]}') AS line
        FROM z_sheet""",
    # Sheet cells: header in row 3, one data row per part.
    "z_cells": f"""
        SELECT file, sheet, 3 AS row, col, 'string' AS kind, name AS s, CAST(NULL AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS BOOLEAN) AS b
        FROM ({_HEADERS}) h
        WHERE NOT (sheet = 'Brand#11' AND col = 1)
        UNION ALL
        SELECT concat('book', p_partkey % 3, '.xlsx'), p_brand, CAST(4 + p_partkey AS INT), 0, 'string', concat('  rtr', {pad('p_partkey % 30')}), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN) FROM @part@
        UNION ALL
        SELECT concat('book', p_partkey % 3, '.xlsx'), p_brand, CAST(4 + p_partkey AS INT), 1,
               CASE WHEN p_partkey % 7 = 0 THEN 'float' WHEN p_partkey % 7 = 1 THEN 'string' WHEN p_partkey % 7 = 2 THEN 'bool' WHEN p_partkey % 31 = 5 THEN 'empty' ELSE 'int' END,
               CASE WHEN p_partkey % 7 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN ' 4000 ' ELSE 'n/a' END END,
               CASE WHEN p_partkey % 7 > 2 THEN p_partkey END, CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 0.75 END, CASE WHEN p_partkey % 7 = 2 THEN p_partkey % 2 = 0 END FROM @part@
        UNION ALL
        SELECT concat('book', p_partkey % 3, '.xlsx'), p_brand, CAST(4 + p_partkey AS INT), 2,
               CASE WHEN p_partkey % 5 = 0 THEN 'bool' WHEN p_partkey % 5 = 1 THEN 'string' ELSE 'int' END,
               CASE WHEN p_partkey % 5 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'TRUE' ELSE '0' END END,
               CASE WHEN p_partkey % 5 > 1 THEN p_partkey % 3 END, CAST(NULL AS DOUBLE), CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 2 = 0 END FROM @part@
        UNION ALL
        SELECT concat('book', p_partkey % 3, '.xlsx'), p_brand, CAST(4 + p_partkey AS INT), 3, 'string',
               concat({ip4(f'{BASE} + (p_partkey * 7919) % 65536')}, '/32, ', {ip4(f'{BASE} + (p_partkey * 104729) % 65536')}, ' (note)'), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN) FROM @part@
        UNION ALL
        SELECT concat('book', p_partkey % 3, '.xlsx'), p_brand, CAST(4 + p_partkey AS INT), 4, CASE WHEN p_partkey % 6 = 0 THEN 'empty' ELSE 'string' END,
               CASE WHEN p_partkey % 6 <> 0 THEN concat({ip4(f'{BASE} + (p_partkey * 7919) % 65536')}, CASE WHEN p_partkey % 6 = 1 THEN ' , nonsense' ELSE '' END) END, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN) FROM @part@
        UNION ALL
        SELECT concat('book', p_partkey % 3, '.xlsx'), p_brand, CAST(4 + p_partkey AS INT), 5, 'float', CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(p_size * 100 AS DOUBLE), CAST(NULL AS BOOLEAN) FROM @part@""",
    # Vendor port names.
    "z_ports": """
        SELECT p_partkey, concat(split_part('GigabitEthernet XGigabitEthernet 100GE TwentyFiveGigE xe- Te HundredGigE FastEthernet MultiGE Gi 10GE ge- TenGigE FortyGigabitEthernet GigE Hu', ' ', CAST(1 + p_partkey % 16 AS INT)),
               p_partkey % 3, '/', p_size % 4, CASE WHEN p_partkey % 2 = 0 THEN concat('/', p_size) ELSE concat('.', p_size) END) AS port FROM @part@""",
    # Host part of page addresses.
    "z_hosts": "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM @pages@",
    # Registry object text, one response per customer.
    "z_rpsl": f"""
        SELECT k, network, 64496 + c_nationkey % 16 AS asn, concat('% comment line', chr(10), chr(10), 'person: someone', chr(10), 'netname: NOT-A-NET', chr(10), chr(10),
               'remarks: before', chr(10), 'inetnum:        ', {ip4('net')}, ' - ', {ip4('net + size - 1 - CASE WHEN k % 9 = 0 AND size > 2 THEN 1 ELSE 0 END')}, chr(10),
               CASE WHEN k % 11 = 0 THEN '' ELSE concat('netname:  ', c_name, chr(10)) END,
               'descr: ', c_mktsegment, chr(10), '   second line ', k, chr(10), 'descr: ignored', chr(10),
               'country: ', split_part('{COUNTRIES}', ' ', CAST(c_nationkey + 1 AS INT)), chr(10), 'source: TEST', chr(10), chr(10),
               'inet6num: 2001:db8:', k % 1000, '::/48', chr(10), 'netname: V6-', k, chr(10), 'last-modified: 2020-01-01T00:00:00Z', chr(10)) AS response
        FROM z_nets""",
    "z_nation": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS n, n_name, CAST(n_regionkey AS BIGINT) AS r, split_part('{COUNTRIES}', ' ', n_nationkey + 1) AS country FROM @nation@""",
}


def _closure(text: str, found: dict[str, str]) -> None:
    for name in dict.fromkeys(re.findall(r"\bz_[a-z_0-9]+\b", text)):
        if name not in found:
            _closure(SHAPES[name], found)
            found[name] = SHAPES[name]


def oracle(select: str, **ctes: str) -> str:
    """DuckDB text: the needed shapes, then the given expressions, then the select."""
    found: dict[str, str] = {}
    for part in [*ctes.values(), select]:
        _closure(part, found)
    found.update(ctes)
    head = ",\n".join(f"{name} AS ({body})" for name, body in found.items())
    text = f"WITH RECURSIVE {head}\n{select}" if found else select
    return re.sub(r"@(\w+)@", r"\1", text)


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shape as a DataFrame."""
    return run(spark, sf_dir, f"SELECT * FROM {name}")


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shape as a table written once per session, for jobs that read their input more than once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        path = staging_path(spark, name)
        shape(spark, sf_dir, name).write.parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def run(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    found: dict[str, str] = {}
    _closure(select, found)
    head = ",\n".join(f"{name} AS ({body})" for name, body in found.items())
    text = f"WITH {head}\n{select}" if found else select
    text = re.sub(r"@(\w+)@", lambda m: f"parquet.`{sf_dir.rstrip('/')}/{m.group(1)}.parquet`", text)
    # Spark spells integer division `div`; addresses in text hold `://`.
    text = re.sub(r"(?<!:)//", " div ", text)
    # Keep a shape without session state: backslashes are not used, so both engines read the literals alike.
    return spark.sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
