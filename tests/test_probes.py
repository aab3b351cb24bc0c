"""Replies to hops against plain Python, and one parse of each document."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from cidrloom.functions.ip import parse_cidr
from cidrloom.operators.traces import current_traces
from cidrloom.sources.traces import aggregate_probes, parse_trace_docs


def plain_hops(probes):
    out = []
    for ttl in range(1, max([p["probe_ttl"] for p in probes], default=0) + 1):
        some = [p for p in probes if p["probe_ttl"] == ttl]
        votes = Counter(p["addr"] for p in some if p["addr"] is not None)
        times = [p["rtt"] for p in some if p["rtt"] is not None]
        total = 0.0
        for t in times:
            total += t
        finite = [t for t in times if t == t]
        out.append((
            ttl,
            min(votes, key=lambda a: (-votes[a], a.encode()), default=None),
            total / len(times) if times else None,
            min(finite, default=times[0] if times else None),
            max(finite) if times and len(finite) == len(times) else times and float("nan") or None,
            next((p["icmp_type"] for p in some if p["icmp_type"] is not None), None),
            None, None, None,
        ))
    return out


def test_replies_of_many_traces(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        probes = [{"addr": rng.choice([None, "10.0.0.9", "10.0.0.10", "é", "ｚ", "\U0001f600"]), "probe_ttl": rng.choice([0, 1, 2, 2, 3, 7, 255]), "rtt": rng.choice([None, 0.1, 0.2, 0.3, 1e300, -0.0, 0.0, float("nan")]), "icmp_type": rng.choice([None, 0, 11])} for _ in range(rng.randrange(9))]
        rows.append((i, probes if i % 50 else None))
    df = spark.createDataFrame([(i, p and [(x["addr"], x["probe_ttl"], x["rtt"], x["icmp_type"]) for x in p]) for i, p in rows], "i int, p array<struct<addr:string,probe_ttl:bigint,rtt:double,icmp_type:int>>")
    got = {r.i: [tuple(h) for h in r.h] for r in df.repartition(3).select("i", aggregate_probes(F.col("p")).alias("h")).collect()}
    assert {i: repr(h) for i, h in got.items()} == {i: repr(plain_hops(p or [])) for i, p in rows}


def test_a_document_is_parsed_once(spark):
    doc = {"type": "trace", "src": "a", "dst": "b", "stop_reason": "x", "start": {"sec": 0}, "hops": [{"addr": "10.1.0.1", "probe_ttl": 2, "rtt": 1.0, "icmp_type": 11}]}
    docs = spark.createDataFrame([(0, json.dumps(doc)), (1, json.dumps({**doc, "hops": []})), (2, "{"), (3, None)], "i int, doc string")
    hops = parse_trace_docs(docs, "doc").select("i", F.explode("trace.hops").alias("h")).filter("h.ip IS NOT NULL")
    assert [(r.i, r.h.hop, r.h.ip) for r in hops.collect()] == [(0, 2, "10.1.0.1")]
    plan = hops._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == plan.count("from_json(") == 1


def test_a_range_is_parsed_once_however_many_traces_it_has(spark):
    ranges = ["10.0.0.0/8", "10.0.0.0/08", "10.0.0.1/8", "2001:DB8::/32", "2001:db8:0::/32", "x", None, "192.0.2.0/24"]
    traces = spark.createDataFrame([(i, ranges[i % len(ranges)]) for i in range(80)], "trace_id int, range string")
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.0.0.0/8",), ("2001:db8::/32",)], "t string").select(parse_cidr(F.col("t")).alias("net"))
    kept = current_traces(traces, nets, "net")
    assert kept.columns == ["trace_id", "range"]
    want = {r.range for r in traces.select("range", parse_cidr(F.col("range")).alias("net")).join(nets, "net", "left_semi").select("range").collect()}
    assert {"10.0.0.0/8", "2001:DB8::/32"} <= want
    assert sorted((r.trace_id, r.range) for r in kept.collect()) == [(i, ranges[i % len(ranges)]) for i in range(80) if ranges[i % len(ranges)] in want]
    assert "RLIKE" not in kept._jdf.queryExecution().optimizedPlan().toString().upper()
