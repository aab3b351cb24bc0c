"""Anchors that are counted without their contexts, and the symbol ranks of the run-length index."""

from collections import Counter

import numpy as np

from cidrloom.llm import op1_suffix


def test_repeated_hashes_are_those_of_all_anchors(spark):
    rng = np.random.default_rng(5)
    line = "".join(map(chr, rng.integers(97, 123, 150)))
    texts = [None, "", "ab" * 300, line + line, "x" + line, *("".join(map(chr, rng.integers(97, 123, 400))) for _ in range(6))]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "d long, th long, text string").repartition(3)
    count = Counter(r.h for r in op1_suffix._anchor_rows(rows).select("h").collect())
    found = [r.h for r in op1_suffix._repeated(rows).collect()]
    assert sorted(found) == sorted(h for h, n in count.items() if n > 1) and found


def test_ranks_of_three_symbols_in_one_sort_and_in_several():
    rng = np.random.default_rng(6)
    for most in (4, 300, 1 << 40):  # the last does not fit in one sort
        symbol = rng.integers(0, 4, 500) * (most // 4) + 1
        symbol[-1] = 0
        order, three, _ = op1_suffix.RunIndex._sorted(symbol)
        assert order.tolist() == sorted(range(500), key=lambda i: symbol[i:].tolist())
        triples = [tuple(symbol[i : i + 3]) for i in range(500)]
        for i, j in zip(order[:-1], order[1:], strict=True):
            assert (triples[i] == triples[j]) == (three[i] == three[j])


def test_steps_need_no_search():
    rng = np.random.default_rng(8)
    one = rng.integers(97, 123, 160).astype(np.uint8)
    raw = np.concatenate((one, one[:120], one[20:]))
    index = op1_suffix.RunIndex(raw, np.array([0, 160, 280, 420]), np.arange(3), np.array([0, 0, 20]))
    row = np.arange(len(index.run))
    assert (index.run == np.searchsorted(index.start, row, "right") - 1).all()
    which, offset = index.repeated()
    assert sorted(zip(which.tolist(), offset.tolist(), strict=True)) == [(1, k) for k in range(21)] + [(2, k) for k in range(41)]
