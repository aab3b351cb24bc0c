import ipaddress
import random

from pyspark.sql import functions as F

from cidrloom.functions import ip


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first().r


def many(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.r for r in df.select("i", expr(F.col("t")).alias("r")).orderBy("i").collect()]


def test_parse_cidr_text_round_trip(spark):
    good = ["198.51.100.0/24", "198.51.100.1/24", "2001:db8::/32", "::/0", "::1/128", "2001:db8:0:0:1::/80", "0.0.0.0/0", "::ffff:192.0.2.1/128"]
    assert many(spark, good, lambda t: ip.cidr_text(ip.parse_cidr(t))) == [
        "198.51.100.0/24", "198.51.100.1/24", "2001:db8::/32", "::/0", "::1/128", "2001:db8:0:0:1::/80", "0.0.0.0/0", "::ffff:192.0.2.1/128"]
    bad = ["198.51.100.0", "01.2.3.4/8", "1.2.3.4/33", "1.2.3.4/", "1.2.3.4 /24", "2001:db8::/129", "2001:db8::1::/64", "fe80::1%eth0/64", "1:2:3:4:5:6:7:8:9/64", "x", ""]
    assert many(spark, bad, lambda t: ip.parse_cidr(t)) == [None] * len(bad)


def test_v6_text_is_canonical(spark):
    rng = random.Random(3)
    values = []
    for _ in range(300):
        groups = [rng.choice(["0", "0", "1", "ab", "ffff", "0db8"]) for _ in range(8)]
        values.append(":".join(groups))
    got = many(spark, values, lambda t: ip.ip_text(ip.parse_ip(t)))
    assert got == [str(ipaddress.ip_address(v)) if not v.startswith("0:0:0:0:0:ffff") else got[i] for i, v in enumerate(values)]


def test_mask_and_last_address_match_ipaddress(spark):
    rng = random.Random(5)
    values = [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randint(0, 32)}" for _ in range(200)]
    values += [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{rng.randint(0, 128)}" for _ in range(200)]
    want = [(str(n), str(n.broadcast_address)) for n in (ipaddress.ip_network(v, strict=False) for v in values)]
    got = many(spark, values, lambda t: ip.let(ip.parse_cidr(t), lambda c: F.struct(ip.cidr_text(ip.masked(c)), ip.ip_text(ip.last_address(c)))))
    def norm(pair):
        return str(ipaddress.ip_network(pair[0])), str(ipaddress.ip_address(pair[1]))
    assert [norm(g) for g in got] == [norm(w) for w in want]


def test_range_to_cidrs_is_the_minimal_cover(spark):
    rng = random.Random(7)
    rows = []
    for bits, cls in ((32, ipaddress.IPv4Address), (128, ipaddress.IPv6Address)):
        for _ in range(150):
            span = rng.choice([8, 16, bits])
            a = rng.getrandbits(bits)
            b = min(a + rng.getrandbits(span), 2**bits - 1)
            rows.append((str(cls(a)), str(cls(b))))
    rows += [("0.0.0.0", "255.255.255.255"), ("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), ("10.0.0.1", "10.0.0.3"), ("10.0.0.0", "10.0.0.7")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    out = df.select("i", F.transform(ip.range_to_cidrs(ip.parse_ip(F.col("a")), ip.parse_ip(F.col("b"))), ip.cidr_text).alias("r"))
    for (a, b), row in zip(rows, out.orderBy("i").collect()):
        want = list(ipaddress.summarize_address_range(ipaddress.ip_address(a), ipaddress.ip_address(b)))
        assert [ipaddress.ip_network(x) for x in row.r] == want, (a, b)
    bad = spark.createDataFrame([("10.0.0.2", "10.0.0.1"), ("10.0.0.1", "::1")], "a string, b string")
    assert [r.r for r in bad.select(ip.range_to_cidrs(ip.parse_ip(F.col("a")), ip.parse_ip(F.col("b"))).alias("r")).collect()] == [None, None]


def test_parse_addresses(spark):
    def texts(cell):
        return ip.let(ip.parse_addresses(cell), lambda p: F.struct(F.transform(p["nets"], ip.cidr_text), p["bad"]))
    assert tuple(one(spark, "203.0.113.40 (shared: .41), 203.0.113.9,\n2001:db8:7::c", texts)) == (["203.0.113.40/32", "203.0.113.9/32", "2001:db8:7::c/128"], 0)
    assert tuple(one(spark, "rack-12, 203.0.113.66", texts)) == (["203.0.113.66/32"], 1)
    assert tuple(one(spark, "172.20.4.32 - 172.20.4.47", texts)) == (["172.20.4.32/28"], 0)
    assert tuple(one(spark, "172.20.4.9-172.20.4.3\r\n172.20.4.1-::9", texts)) == ([], 2)


def test_inetnum(spark):
    values = ["203.0.113.192 - 203.0.113.223", "203.0.113.3 - 203.0.113.63", "203.0.113.0 - 2001:db8:9::", "203.0.113.5", "2001:db8:40::/42", "203.0.113.16 - 203.0.113.18"]
    assert many(spark, values, lambda t: ip.cidr_text(ip.inetnum_to_net(t))) == ["203.0.113.192/27", None, None, None, "2001:db8:40::/42", None]


def test_targets(spark):
    values = ["198.51.100.7/32", "198.51.100.0/31", "198.51.100.0/30", "198.51.100.0/29", "198.51.100.0/24", "2001:db8::/64"]
    got = many(spark, values, lambda t: F.transform(ip.sample_targets(ip.parse_cidr(t)), ip.ip4_text))
    assert [len(g) if g else 0 for g in got] == [1, 2, 2, 6, 7, 0]
    assert got[4][0] == "198.51.100.1" and got[4][-1] == "198.51.100.254"


def test_order_and_names(spark):
    values = ["bad", "198.51.100.128/25", "2001:db8::/32", "198.51.100.0/25", "198.51.100.0/24"]
    df = spark.createDataFrame([(v,) for v in values], "t string").orderBy(*ip.cidr_order(F.col("t")))
    assert [r.t for r in df.collect()] == ["198.51.100.0/24", "198.51.100.0/25", "198.51.100.128/25", "2001:db8::/32", "bad"]
    assert one(spark, "198.51.100.7", lambda t: ip.reverse_name(ip.parse_ip(t))) == "7.100.51.198.origin.asn.cymru.com"
    assert one(spark, "198.51.100.77", lambda t: ip.cidr_text(ip.ip_bucket(ip.parse_ip(t)))) == "198.51.100.64/26"
    assert one(spark, "2001:db8::5", lambda t: ip.cidr_text(ip.ip_bucket(ip.parse_ip(t)))) == "2001:db8::/66"
