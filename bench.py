"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cidrloom.session import local_session  # noqa: E402
from workload import QUERIES, inputs  # noqa: E402

HEADLINE = [
    "j_lookup_broadcast",
    "j_lookup_shuffle",
    "j_lpm",
    "j_bidir",
    "i1_parse_ip",
    "i2_parse_addresses_documents",
    "i7_sample_targets",
    "s7_parse_trace_docs",
    "s8_parse_rpsl",
    "s15_type_rows",
    "p7_vendor_interfaces",
    "t17_flatten_display",
    "t20_project_fields",
    "f2_hops_in_nets",
    "a2_vote_hops",
    "a3_choose_gateways",
    "j4_gateway_table",
    "j5_lookup_records",
    "j6_enrich_logs",
    "j7_lookup_intervals",
    "w3_duplicate_cidrs",
    "g5_all_graphs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    # Stored inputs that several queries share are built before the clock runs.
    for make in (inputs.traces, inputs.targets, inputs.whois, inputs.voted, inputs.gateways, inputs.lookup):
        make(spark, sf_dir)
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
