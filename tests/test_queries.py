import pytest

from workload import ORACLES, QUERIES
from workload.check import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["i3_range_to_cidrs", "j_lookup_broadcast", "j_lookup_shuffle", "j_lpm", "j_bidir", "s2_read_whois_lenient", "t19_coerce", "p4_parse_ptr", "w3_duplicate_cidrs"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
