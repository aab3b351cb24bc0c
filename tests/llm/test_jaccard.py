"""Keys of the n-gram Jaccard join: they lose no pair and unrelated sets share few."""

from collections import Counter

import numpy as np
import pytest

from cidrloom.llm import op3_jaccard


def _keys(sets, similarity):
    codes = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    keys, rows = op3_jaccard.signatures(codes, np.repeat(np.arange(len(sets)), size), size, similarity)
    return [set(keys[rows == i].tolist()) for i in range(len(sets))]


@pytest.mark.parametrize("n", [9, 60, 200, 1000])
def test_unrelated_sets_meet_at_few_keys(n):
    rng = np.random.default_rng(n)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(300)]
    met = Counter(k for keys in _keys(sets, (80, 100)) for k in keys)
    assert sum(m * (m - 1) for m in met.values()) <= 4 * len(sets)  # gaps that sets share by chance must not be keys


@pytest.mark.parametrize("similarity", [(80, 100), (90, 100), (70, 100)])
def test_similar_sets_share_a_key(similarity):
    part, whole = similarity
    rng = np.random.default_rng(7)
    sets = []
    for n in [*range(1, 40), 90, 135, 500]:
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        for union in range(n, 2 * n + 1):  # n of `union` codes are shared
            if n * whole >= part * union:
                cut = int(rng.integers(n, union + 1))
                sets += [base[:cut], np.concatenate((base[:n], base[cut:union]))]
    keys = _keys(sets, similarity)
    for i in range(0, len(sets), 2):
        equal = len(sets[i]) == len(sets[i + 1]) == len(np.intersect1d(sets[i], sets[i + 1]))
        assert equal or keys[i] & keys[i + 1]


def test_search_finds_pairs_of_wide_counts(spark):
    rng = np.random.default_rng(3)
    near = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    many = np.arange(2000, dtype=np.uint64)  # all in the first group
    sets = [near, np.append(near[:2900], many[:100]), many, many[:1900], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)]
    size = np.array([len(s) for s in sets])
    counts = op3_jaccard.group_counts(np.concatenate(sets), np.repeat(np.arange(5), size), size).to_pylist()
    table = spark.createDataFrame([(i, int(n), c) for i, (n, c) in enumerate(zip(size, counts, strict=True))], "node long, n long, counts binary")
    members = spark.createDataFrame([(k, i, i) for k in (1, 2) for i in range(5)], "key long, node long, part long")
    found = op3_jaccard.search_buckets(members, table, (80, 100)).collect()
    assert sorted((r.a, r.b) for r in found) == [(0, 1), (2, 3)]


def test_search_meets_a_pair_of_near_copies_a_few_times(shared, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(24):  # pairwise just below 90 %, so that no check against a centre joins them
        words = list(base)
        for at in rng.choice(400, 6, replace=False):
            words[at] = f"x{k}at{at}"
        texts.append(words)
    texts.append([w if i != 200 else "y" for i, w in enumerate(texts[3])])
    sets = [{tuple(t[i : i + 3]) for i in range(398)} for t in texts]
    links = [(i, j) for j in range(25) for i in range(j) if len(sets[i] & sets[j]) * 100 >= 90 * len(sets[i] | sets[j])]
    assert links == [(3, 24)]
    searched, search = [], op3_jaccard.search_buckets
    monkeypatch.setattr(op3_jaccard, "search_buckets", lambda members, *rest: searched.extend(members.collect()) or search(members, *rest))
    docs = shared.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in op3_jaccard.grouped(docs).collect()}
    assert got == {i: 3 if i == 24 else i for i in range(25)}
    met = Counter(r["key"] for r in searched)
    assert 0 < sum(m * (m - 1) // 2 for m in met.values()) <= 5 * 25 * 24 // 2  # a pair shares some twenty keys


def test_search_drops_pairs_just_below_the_limit(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 320, dtype=np.uint64) * np.uint64(2)
    sets = [np.concatenate((base, rng.integers(0, 1 << 63, 80, dtype=np.uint64) * np.uint64(2))) for _ in range(40)]  # 320 of 480 are shared
    sets.append(np.concatenate((sets[0][:380], rng.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2))))  # 380 of 430 with the first
    size = np.array([len(s) for s in sets])
    counts = op3_jaccard.group_counts(np.concatenate(sets), np.repeat(np.arange(41), size), size).to_pylist()
    table = spark.createDataFrame([(i, int(n), c) for i, (n, c) in enumerate(zip(size, counts, strict=True))], "node long, n long, counts binary")
    members = spark.createDataFrame([(1, i, i) for i in range(41)], "key long, node long, part long")
    found = {(r.a, r.b) for r in op3_jaccard.search_buckets(members, table, (80, 100)).collect()}
    assert (0, 40) in found and len(found) <= 41
