import pytest
from pyspark.sql import functions as F

from cidrloom.functions import patterns as P
from cidrloom.functions import text as T
from workload.q_text import PATTERNS


def many(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.r for r in df.select("i", expr(F.col("t")).alias("r")).orderBy("i").collect()]


def test_asn_and_continent(spark):
    assert many(spark, ["AS65010", "65551", "", "AS-65010", " 12", "4294967296", "4294967295", "+31", "AS" + "0" * 50 + "9"], T.parse_asn) == [65010, 65551, None, None, None, None, 4294967295, 31, 9]
    assert many(spark, ["KR", "CA", "NO", "NZ", "KE", "PE", "QQ", "kr", ""], T.continent_of) == ["AS", "NA", "EU", "OC", "AF", "SA", None, None, None]
    assert many(spark, [" AS65536 ", "65537"], T.parse_asn_strict) == [65536, 65537]
    with pytest.raises(Exception, match="invalid AS number"):
        many(spark, ["AS12b"], T.parse_asn_strict)


def test_dns_texts(spark):
    rows = many(spark, ["65010 | 203.0.113.128/25 | NO | ripencc | 2019-07-30", "65010 | 203.0.113.128/25"], T.parse_origin_txt)
    assert rows[0].asDict() == {"asn": 65010, "prefix": "203.0.113.128/25", "country": "NO", "registry": "ripencc", "allocated": "2019-07-30"} and rows[1] is None
    names = ["FJORD-AS Fjord Fibre, North, NO", "HARBOUR, nor", "LOFT, NO Cabins", "PLAIN"]
    assert many(spark, names, T.trim_country_suffix) == ["FJORD-AS Fjord Fibre, North", "HARBOUR, nor", "LOFT, NO Cabins", "PLAIN"]


def test_vendor_interfaces(spark):
    ports = ["GigabitEthernet3/1/7", "XGigabitEthernet2/0/11", "100GE4/0/9", "TwentyFiveGigE1/2/3", "et-5/1/0", "ae12"]
    assert many(spark, ports, lambda c: P.normalize(P.INTERFACE_NORMALIZER, c)) == ["gi-3-1-7", "xe-2-0-11", "hu-4-0-9", "twe-1-2-3", "et-5-1-0", "ae12"]


def test_ptr_device(spark):
    device = many(spark, ["user.virtual.et-2-1-4.agg07.hall3.example.com", "", "lone.example.com", "as65020.et-2-1-4.agg07.hall3.example.com", "port.box.site.example.net"], lambda c: P.parse_ptr(c, PATTERNS))
    assert device[0].asDict() == {"interface": "et-2-1-4", "device": "agg07", "device_role": "agg", "facility": "hall3", "facing": "user_virtual", "customer_asn": None}
    assert device[1] is None and device[2] is None
    assert (device[3].facing, device[3].customer_asn) == ("bgp_peer", 65020)
    assert (device[4].device, device[4].facing) == ("box", "network")


def test_regex_translation(spark):
    regex = P.to_java(r"(?P<device_role>a+)(?:b)([c(]x)$")
    assert regex.groups == {"device_role": 1} and regex.count == 2 and regex.pattern.endswith(r"\z")
    assert P.to_java_replacement("$device_role-$none$$1", regex) == r"$1-\$1"
    with pytest.raises(ValueError):
        P.ptr_regex(P.PtrPattern(regex=r"{a}\d{2}"))
    with pytest.raises(ValueError):
        P.to_java("(")
