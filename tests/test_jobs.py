import json

import pytest
from pyspark.sql import functions as F

from cidrloom.functions.fields import ProjectedField, flatten_fields, project_fields, project_record
from cidrloom.functions.ip import parse_cidr
from cidrloom.operators import topology as G
from cidrloom.operators import traces as T
from cidrloom.operators.conflicts import duplicate_cidrs, group_membership, group_table
from cidrloom.session import staging_path
from cidrloom.sources.readers import bad_json_count, parse_sheet_lines, read_gateways, read_logs, read_whois, sheet_row_cidrs
from cidrloom.sources.registry import parse_rpsl
from cidrloom.sources.sheets import check_sheets
from cidrloom.sources.traces import parse_trace_docs
from cidrloom.streaming.flows import enrich_stream
from workload.q_text import PATTERNS


def test_rpsl_blocks(spark):
    body = "% terms of use\n\ninetnum: 203.0.113.64 - 203.0.113.95\nnetname: QUAY-4\ndescr: Cold store\n  behind the quay\n\n% end of part\n\n\ninetnum: 203.0.113.8 - 203.0.113.15\nnetname: CRANE-2\n"
    rows = parse_rpsl(spark.createDataFrame([(1, body)], "k int, response string"), "response").orderBy("block").collect()
    assert [(r.whois.netname, r.whois.descr) for r in rows] == [("QUAY-4", "Cold store behind the quay"), ("CRANE-2", None)]


def test_trace_documents(spark):
    hops = [{"addr": "10.1.0.1", "probe_ttl": 1, "rtt": v} for v in (1.0, 3.0)] + [{"addr": "10.1.0.2", "probe_ttl": 1, "rtt": 2.0}, {"addr": "10.1.0.3", "probe_ttl": 3}]
    doc = {"type": "trace", "src": "a", "dst": "b", "stop_reason": "x", "start": {"sec": 0, "usec": 7}, "hops": hops}
    docs = [json.dumps(doc), json.dumps({**doc, "src": None}), '{"type":"cycle-stop"}', "{", "", "[1]"]
    rows = parse_trace_docs(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string"), "doc").orderBy("i").collect()
    assert [(r.i, r.kind, r.trace is not None) for r in rows] == [(0, "trace", True), (1, "trace", False), (2, "cycle-stop", False), (5, "unknown", False)]
    first = rows[0].trace
    assert first.measured_at == "1970-01-01T00:00:00Z" and [h.ip for h in first.hops] == ["10.1.0.1", None, "10.1.0.3"]
    assert (first.hops[0].rtt_avg, first.hops[0].rtt_best, first.hops[0].rtt_worst) == (2.0, 1.0, 3.0)


def test_votes_and_gateway(spark):
    ptr = {"192.0.2.1": "et-2-0-5.pier07.dc03.example.com", "192.0.2.2": None, "192.0.2.3": None}
    rows = []
    for i, ips in enumerate([["192.0.2.1", "192.0.2.2"], ["192.0.2.1", "192.0.2.3"], ["192.0.2.3", "10.9.9.9", "192.0.2.2"], ["192.0.2.1", None]]):
        rows.append((i, "192.0.2.0/29", f"2024-01-01T1{9 - i}:00:00Z", f"d{i}", [(n + 1, ip) for n, ip in enumerate(ips)]))
    rows.append((9, "198.51.100.0/24", "2024-01-01T00:00:00Z", "d9", []))
    raw = spark.createDataFrame(rows, "trace_id long, range string, measured_at string, destination string, h array<struct<hop:int,ip:string>>")
    nulls = {"rtt_avg": "double", "rtt_best": "double", "rtt_worst": "double", "icmp_type": "int", "asn": "bigint", "ptr": "string"}
    hops = F.transform("h", lambda h: F.struct(h["hop"].alias("hop"), h["ip"].alias("ip"), *[F.lit(None).cast(t).alias(c) for c, t in nulls.items()]))
    traces = raw.withColumn("hops", hops)
    nets = spark.createDataFrame([("192.0.2.0/29",)], "t string").select(parse_cidr(F.col("t")).alias("net"))
    dns = spark.createDataFrame([(k, 64496, v) for k, v in ptr.items()], "ip string, asn long, ptr string")
    kept = T.hops_in_nets(T.explode_hops(traces), nets, "net", dns)
    assert {(r.trace_id, r.hop, r.ip) for r in kept.collect()} == {(0, 1, "192.0.2.1"), (0, 2, "192.0.2.2"), (1, 1, "192.0.2.1"), (1, 2, "192.0.2.3"), (2, 1, "192.0.2.3"), (2, 2, "192.0.2.2"), (3, 1, "192.0.2.1")}
    got = {r.range: r for r in T.choose_gateways(T.vote_hops(kept), T.range_totals(traces), PATTERNS).collect()}
    gw = got["192.0.2.0/29"]
    assert (gw.gateway.ip, gw.gateway.votes, gw.gateway.total, gw.gateway.status, gw.gateway.device.device) == ("192.0.2.1", 3, 4, "inservice", "pier07")
    assert gw.measured_at == "2024-01-01T16:00:00Z" and len(gw.routes) == 1
    assert got["198.51.100.0/24"].gateway.status == "no_hops" and got["198.51.100.0/24"].routes == []


def sheet(spark, rows):
    lines = [(json.dumps({"_source": {"file": "f", "sheet": s, "row_index": i, "sheettype": t}, "network": nets}), i) for i, (s, t, nets) in enumerate(rows)]
    return parse_sheet_lines(spark.createDataFrame(lines, "value string, line_ord long"))


def test_duplicates_compare_with_the_first_sighting_only(spark):
    rows = sheet(spark, [("A", "backbone", ["192.0.2.0/24"]), ("B", "backbone", ["192.0.2.0/24"]), ("C", "backbone", ["192.0.2.0/24", "192.0.2.0/25"]), ("D", "backbone", ["192.0.2.0/24"]), ("E", "hosting", ["192.0.2.0/24"])])
    members, unknown = group_membership(group_table(spark, {"f": [["A", "B", "Z"], ["C"]]}), rows.select("source.*"))
    assert [r.sheet for r in unknown.collect()] == ["Z"]
    assert sorted(r.sheet for r in duplicate_cidrs(sheet_row_cidrs(rows), members).collect()) == ["C", "D"]


def test_projection(spark):
    record = {"peer": "203.0.113.77", "mmdb": {"asn": 65030, "ops": {"rack": "r12", "shift": "night"}}}
    df = spark.createDataFrame([(1, json.dumps(record))], "k int, j string").select("k", F.parse_json("j").alias("record"))
    fields = [ProjectedField("peer"), ProjectedField("mmdb", None, "string"), ProjectedField("mmdb.asn", "number", "string")]
    out = json.loads(project_record(df, "record", "k", fields).first().record)
    assert out == {"peer": "203.0.113.77", "number": "65030", "mmdb.ops.rack": "r12", "mmdb.ops.shift": "night"}
    assert {r.name: r.value for r in project_fields(df, "record", "k", fields).collect()} == {k: json.dumps(v) for k, v in out.items()}


def test_json_array_logs(spark):
    path = staging_path(spark, "array") + ".json"
    spark.createDataFrame([('[{"a":1},{"a":"x","b":[2]}]',)], "value string").coalesce(1).write.text(path)
    assert sorted(r.record for r in read_logs(spark, path).collect()) == ['{"a":"x","b":[2]}', '{"a":1}']


def test_graph_with_cycle_and_hub(spark):
    edges = [("Internet", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "y")] + [("a", f"n{i}") for i in range(50)]
    links = spark.createDataFrame([("device", s, t, 1) for s, t in edges], "granularity string, source string, target string, value long")
    salted = G.Adjacency(links, edges_per_salt=10)
    assert salted.hubs.count() == 1
    start = spark.createDataFrame([("device", "Internet")], "granularity string, name string")
    got = {r.name: r.depth for r in G.reach(salted, start).collect()}
    assert got == {"Internet": 0, "a": 1, "b": 2, "c": 3, **{f"n{i}": 2 for i in range(50)}}
    kept = {(r.source, r.target) for r in G.forward_links(links, G.depths(links)).collect()}
    assert kept == set(edges) - {("b", "a"), ("c", "b"), ("x", "y")}


def text_file(spark, lines, suffix):
    path = staging_path(spark, "lines") + suffix
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_repeated_keys_keep_the_last_value_and_bad_lines_are_counted(spark):
    lines = ['{"a":1,"b":{"c":2},"a":3}', '{"z":1}', '{"a":', "", "7"]
    records = read_logs(spark, text_file(spark, lines, ".JSONL")).collect()
    assert sorted(r.record for r in records) == ["7", '{"a":3,"b":{"c":2}}', '{"z":1}']
    assert tuple(bad_json_count(spark.createDataFrame([(line,) for line in lines], "value string")).first()) == (4, 1)
    row = parse_sheet_lines(spark.createDataFrame([('{"_source":{"file":"f"},"n":["x"],"n":["203.0.113.0/24"]}', 0)], "value string, line_ord long"))
    assert [r.network for r in sheet_row_cidrs(row).collect()] == ["203.0.113.0/24"]


def test_strict_readers_fail_on_the_first_bad_line(spark):
    whois = '{"network":"203.0.113.0/24","whois":{"inetnum":"203.0.113.0/24","netname":"A"}}'
    path = text_file(spark, [whois, '{"network":5}'], ".jsonl")
    assert [r.network for r in read_whois(spark, path).collect()] == ["203.0.113.0/24"]
    with pytest.raises(Exception, match="bad registry line"):
        read_whois(spark, path, strict=True).collect()
    with pytest.raises(Exception, match="bad gateway line"):
        read_gateways(spark, text_file(spark, ["{}"], ".jsonl")).collect()
    with pytest.raises(Exception):
        read_logs(spark, text_file(spark, ['[{"a":1},'], ".json")).collect()


def test_failed_sheets_raise(spark):
    schema = "file string, sheet string, sheettype string, rows long, skipped long, failed boolean"
    check_sheets(spark.createDataFrame([("f", "s", "hosting", 1, 4, False)], schema))
    with pytest.raises(ValueError, match="'t'"):
        check_sheets(spark.createDataFrame([("f", "s", "hosting", 1, 0, False), ("f", "t", "hosting", 0, 3, True)], schema))
    with pytest.raises(ValueError, match="excluded"):
        check_sheets(spark.createDataFrame([], schema))


def test_current_traces_and_pruned_count(spark):
    traces = spark.createDataFrame([(1, "203.0.113.0/25"), (2, "203.0.113.0/24"), (3, "2001:db8:5::/48"), (4, "none")], "trace_id int, range string")
    nets = spark.createDataFrame([("203.0.113.0/24",), ("2001:db8:5::/48",)], "t string").select(parse_cidr(F.col("t")).alias("net"))
    kept = T.current_traces(traces, nets, "net")
    assert sorted(r.trace_id for r in kept.collect()) == [2, 3]
    assert T.prune_counts(traces, kept).first().asDict() == {"kept": 2, "pruned": 2}


def test_stream_of_several_batches_stages_the_lookup_once(spark, monkeypatch):
    from cidrloom.plans import enrich

    staged = []
    monkeypatch.setattr(enrich, "record_intervals", lambda *a, real=enrich.record_intervals: staged.append(1) or real(*a))
    source, sink = staging_path(spark, "source"), staging_path(spark, "sink")
    for i in range(3):
        line = json.dumps({"ip": f"203.0.113.{i * 100}"})
        spark.createDataFrame([(i, line)], "log_id long, line string").coalesce(1).write.mode("append").parquet(source)
    lookup = spark.createDataFrame([("203.0.113.0/25", "low")], "range string, owner string")
    logs = spark.readStream.schema("log_id bigint, line string").option("maxFilesPerTrigger", 1).parquet(source)
    logs = logs.select("log_id", F.try_parse_json("line").alias("record"))
    enrich_stream(logs, "ip", lookup, sink, staging_path(spark, "state"), every=None).awaitTermination()
    rows = spark.read.parquet(sink)
    assert rows.select("batch").distinct().count() == 3 and len(staged) == 1
    got = {r.log_id: r.o for r in rows.select("log_id", F.try_variant_get("record", "$.mmdb.owner", "string").alias("o")).collect()}
    assert got == {0: "low", 1: "low", 2: None}


def test_flatten_passes_escaped_quotes_around_braces(spark):
    text = r'{"a":"x \"a}b\" z","deep":{"x":{"y":1}}}'
    df = spark.createDataFrame([(1, text)], "id int, t string").select("id", F.parse_json("t").alias("r"))
    nodes = {r["path"] for r in flatten_fields(df, "r", ["id"]).collect()}
    assert nodes == {"a", "deep", "deep.x", "deep.x.y"}


def test_shuffled_enrichment_covers_whole_records_and_a_hot_address(spark, monkeypatch):
    from workload import ORACLES, QUERIES, q_jobs

    def line(i):
        ip = "203.0.113.7" if i % 5 else [None, "203.0.113.200", "no address", "198.18.0.9"][i // 5 % 4]
        return json.dumps({"id": i, "ip": ip, "type": f"t{i % 3}", "deep": {"x": [1, {"y": None}]}})

    logs = spark.createDataFrame([(i, line(i)) for i in range(400)], "event_id long, line string")
    whole = "whois struct<netname string>, country struct<iso_code string>, gateway_found boolean, gateway struct<ip string>"
    lookup = spark.createDataFrame([("203.0.113.0/25", ("LOW",), ("JP",), True, ("192.0.2.1",)), ("203.0.113.128/25", ("HIGH",), None, False, None)], "range string, " + whole)
    monkeypatch.setattr(q_jobs, "shape", lambda s, d, name: logs)
    monkeypatch.setattr(q_jobs.inputs, "lookup", lambda s, d: lookup)
    low, high, none = (True, "LOW", "JP", True, "192.0.2.1"), (True, "HIGH", None, False, None), (False, None, None, None, None)
    out = QUERIES["j6_enrich_logs_shuffle"](spark, "none")
    want = [(i, f"t{i % 3}", *(low if i % 5 else high if i // 5 % 4 == 1 else none)) for i in range(400)]
    assert sorted(tuple(r) for r in out.select("log_id", "type", "found", "netname", "country", "gateway_found", "gateway_ip").collect()) == want
    assert ORACLES["j6_enrich_logs_shuffle"] == ORACLES["j6_enrich_logs"]
