import ipaddress
import random

from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_text, ip4_number, parse_cidr, parse_ip
from cidrloom.operators import asof
from cidrloom.operators.prefix import containing, disjoint_intervals, first_related, longest_prefix_join
from cidrloom.operators.skew import join_to_unique


def fixture(spark, seed=1, nets=150, probes=400, base="198.51.0.0"):
    rng = random.Random(seed)
    start = int(ipaddress.ip_address(base))
    net_rows = {}
    for i in range(nets):
        plen = rng.choice([0, 4, 8, 12, 13, 16, 20, 24, 26, 28, 30, 32])
        addr = start + rng.getrandbits(17) if plen > 8 else rng.getrandbits(32)
        net = ipaddress.ip_network((addr, plen), strict=False)
        net_rows.setdefault(net, f"n{i}")
    probe_rows = [(i, str(ipaddress.ip_address(start + rng.getrandbits(17)))) for i in range(probes)]
    probe_rows += [(probes + i, "198.51.100.7") for i in range(probes)] + [(9999, "not an ip"), (9998, None)]
    table = spark.createDataFrame([(str(n), v) for n, v in net_rows.items()], "net string, owner string").select("owner", parse_cidr(F.col("net")).alias("net"))
    left = spark.createDataFrame(probe_rows, "id int, ip string")
    return net_rows, probe_rows, table, left


def brute(net_rows, text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    best = max((n for n in net_rows if a in n), key=lambda n: n.prefixlen, default=None)
    return net_rows.get(best)


def test_longest_prefix_join_equals_brute_force(spark):
    net_rows, probe_rows, table, left = fixture(spark)
    left = left.withColumn("probe", parse_ip(F.col("ip")))
    got = {r.id: r.owner for r in longest_prefix_join(left, "probe", table, "net").select("id", "owner").collect()}
    assert got == {i: brute(net_rows, t) for i, t in probe_rows}


def test_ipv6_longest_prefix_and_containment(spark):
    rng = random.Random(12)
    base = int(ipaddress.ip_address("2001:db8::"))
    nets = {ipaddress.ip_network("2001:db8::/32"): "all", ipaddress.ip_network("::/0"): "any", ipaddress.ip_network("203.0.113.0/24"): "v4"}
    for i in range(60):
        plen = rng.choice([3, 12, 13, 29, 36, 40, 48, 56, 64, 96, 127, 128])
        nets.setdefault(ipaddress.ip_network((base + (rng.getrandbits(10) << 88) + rng.getrandbits(8), plen), strict=False), f"n{i}")
    probes = [(i, str(ipaddress.ip_address(base + (rng.getrandbits(10) << 88) + rng.getrandbits(8)))) for i in range(300)]
    probes += [(1000, "2400::1"), (1001, "203.0.113.9"), (1002, "192.0.2.1"), (1003, "::ffff:203.0.113.9")]
    table = spark.createDataFrame([(str(n), v) for n, v in nets.items()], "t string, owner string").select("owner", parse_cidr(F.col("t")).alias("net"))
    left = spark.createDataFrame(probes, "id int, ip string").withColumn("probe", parse_ip(F.col("ip")))

    def cover(text):
        a = ipaddress.ip_address(text)
        return [n for n in nets if n.version == a.version and a in n]

    got = {r.id: r.owner for r in longest_prefix_join(left, "probe", table, "net").select("id", "owner").collect()}
    assert got == {i: nets.get(max(cover(t), key=lambda n: n.prefixlen, default=None)) for i, t in probes}
    pairs = containing(left.select("probe").distinct(), "probe", table, "net").join(left, "probe").select("id", "owner")
    assert sorted(map(tuple, pairs.collect())) == sorted((i, nets[n]) for i, t in probes for n in cover(t))


def test_interval_join_equals_brute_force(spark, monkeypatch):
    """Nested nets from /0 to /32, block edges, one hot address, nulls; wide nets dealt to several copies of their row."""
    net_rows, probe_rows, table, left = fixture(spark, seed=2)
    edges = ["0.0.0.0", "255.255.255.255", "198.50.255.255", "198.51.0.0", "198.51.255.255", "198.52.0.0", "10.1.2.3"]
    probe_rows = probe_rows + [(20_000 + i, ip) for i, ip in enumerate(edges)]
    left = spark.createDataFrame(probe_rows, "id int, ip string").withColumn("n", ip4_number(F.col("ip")))
    for spread, rows in ((256, table), (2, table), (256, table.filter("net.plen > 20")), (256, table.filter("net.plen = 0")), (256, table.filter("false"))):
        monkeypatch.setattr(asof, "WIDE_SPREAD", spread)
        kept = {str(ipaddress.ip_network(k)) for k in (r.t for r in rows.select(cidr_text(F.col("net")).alias("t")).collect())}
        some = {n: v for n, v in net_rows.items() if str(n) in kept}
        out = asof.interval_join(left, "n", asof.record_intervals(rows, "net")).select("id", "record.owner").collect()
        assert sorted((r.id, r.owner) for r in out) == sorted((i, brute(some, t)) for i, t in probe_rows)


def test_interval_join_has_one_plan(spark):
    """No size of either side changes the plan, and groups of the merge are /16 blocks."""
    _, _, table, left = fixture(spark, nets=20, probes=20)
    intervals = asof.record_intervals(table, "net")
    plan = asof.resolve(left.select(ip4_number(F.col("ip")).alias("n")).distinct(), "n", intervals)._jdf.queryExecution().toString()
    assert "Window" in plan and "_block" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_intervals_are_disjoint(spark):
    _, _, table, _ = fixture(spark, seed=4)
    rows = sorted((r.lo, r.hi) for r in disjoint_intervals(table.filter("net.plen > 10"), "net").collect())
    assert all(a[1] < b[0] for a, b in zip(rows, rows[1:])) and all(a <= b for a, b in rows)


def test_first_related_both_directions(spark):
    rng = random.Random(8)
    base = int(ipaddress.ip_address("198.51.100.0"))
    nets = [(i, str(ipaddress.ip_network((base + rng.getrandbits(8), rng.choice([0, 16, 24, 26, 28, 30, 32])), strict=False))) for i in range(80)]
    ranges = sorted({str(ipaddress.ip_network((base + rng.getrandbits(9), rng.choice([20, 24, 27, 29, 32])), strict=False)) for _ in range(60)})
    nd = spark.createDataFrame(nets, "ord int, t string").select("ord", parse_cidr(F.col("t")).alias("net"))
    rd = spark.createDataFrame([(r,) for r in ranges], "t string").select(parse_cidr(F.col("t")).alias("range"))
    got = {r.t: (r.first, r.matches) for r in first_related(rd, "range", nd, "net", "ord").select(cidr_text(F.col("range")).alias("t"), "first", "matches").collect()}
    want = {}
    for r in ranges:
        rn = ipaddress.ip_network(r)
        hits = [i for i, t in nets if ipaddress.ip_network(t).supernet_of(rn) or rn.supernet_of(ipaddress.ip_network(t))]
        if hits:
            want[r] = (min(hits), len(hits))
    assert got == want


def test_join_to_unique_keeps_every_row(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(1000, None)], "id int, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 300, 6)], "k string, v int")
    got = {r.id: r.v for r in join_to_unique(left, right, ["k"], hot_keys=2).collect()}
    values = dict(r for r in [("hot", 1)] + [(f"k{i}", i) for i in range(0, 300, 6)])
    assert got == {**{i: values.get("hot" if i % 3 else f"k{i}") for i in range(300)}, 1000: None}
