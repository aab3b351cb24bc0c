"""Exact top-k search against a brute-force version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cidrloom.llm import op13_topk

LOW, HIGH = -(2**63), 2**63 - 1


def _cut(x):
    return max(LOW, min(HIGH, x))


def _plain(rows, k=5):
    whole = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v)
    kept = list(dict.fromkeys((i, tuple(_cut(math.floor(256 * x)) for x in v)) for i, v in rows if whole(v)))
    out = []
    for q, vec in kept:
        if q is not None and q % 50 == 0:
            scored = [(-_cut(sum(a * b for a, b in zip(vec, v))), i is None, i or 0) for i, v in kept if i != q]
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def _got(df):
    return sorted(map(tuple, op13_topk.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("block", [16384, 16])
def test_against_brute_force(shared, block, monkeypatch):
    """Clusters, far outliers, many equal vectors (ties), repeated rows and ids, odd vectors, clashing columns."""
    monkeypatch.setattr(op13_topk, "BLOCK", block)
    monkeypatch.setattr(op13_topk, "CHUNK", block)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (40 if i % 7 == 0 else 1)]) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(120)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")]), (550, [float("inf"), 1.0]), (600, []), (None, [1.0] * 6), (None, None)]
    rows += [(405, [1e30] * 3), (50, [3.0] * 6), (50, [3.0] * 6), (650, [-1e30, 5.0]), (700, [2.0] * 9), (750, [0.0])]
    df = shared.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, score int, rank int, id int")
    assert _got(df) == _plain(rows)


def test_few_rows(shared):
    schema = "vec_id long, embedding array<float>"
    assert _got(shared.createDataFrame([], schema)) == []
    assert _got(shared.createDataFrame([(0, [1.0])], schema)) == []
    assert _got(shared.createDataFrame([(0, [1.0]), (3, [2.0])], schema)) == [(0, 1, 3, 256 * 512)]
    assert _got(shared.createDataFrame([(1, [1.0]), (3, [2.0])], schema)) == []
