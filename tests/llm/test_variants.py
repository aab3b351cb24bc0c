"""Spelling variants against a plain version."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cidrloom.llm import op12_variants


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(rows):
    import re
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in count if v != w and _near(v, w)] for w in count}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = top if top and count[top] >= 5 * count[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, n, len(near[w]), form[w], count.get(form[w]), root(w)) for w, n in count.items()), key=str)


def _got(df):
    return sorted(map(tuple, op12_variants.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def _rows():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 9))) for _ in range(300)]
    chain = ["letter"] * 700 + ["lettre"] * 9 + ["letters"] * 130 + ["lettersx"] * 25 + ["letterxsx"] * 5 + ["aaaaaa"] * 30 + ["aaaaaaa"] * 160 + ["x" * 9000] * 6 + ["x" * 9001] * 40
    bag = words * 6 + chain + rnd.choices(words, k=3000)
    rnd.shuffle(bag)
    rows = [(i, rnd.choice([" ", ", ", "\n", "ÿ1"]).join(bag[i * 20 : i * 20 + 20]).upper() if i % 3 else " ".join(bag[i * 20 : i * 20 + 20])) for i in range(len(bag) // 20 + 1)]
    return rows + [(None, " ".join(words)), (None, None), (1, None), (2, ""), (2, " \n"), (7, "word-word " * 50), (7, "word-word " * 50)]


@pytest.mark.parametrize("tile", [2048, 8])
def test_against_plain_version(shared, tile, monkeypatch):
    monkeypatch.setattr(op12_variants, "TILE", tile)
    rows = _rows()
    df = shared.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    assert _got(df) == _plain(rows)


def test_few_rows(shared, odd):
    assert _got(shared.createDataFrame([], "doc_id long, text string")) == []
    assert _got(odd) == _plain([(r.doc_id, r.text) for r in odd.collect()])


def test_one_edit_is_exact():
    """All pairs of short words over two letters, whichever key finds them: each near pair once."""
    import itertools
    words = ["".join(w) for n in (6, 7) for w in itertools.product("ab", repeat=n)]
    tile = op12_variants.Tile(pa.array(words))
    found = []
    for by_head in (True, False):
        i, j = op12_variants.near_pairs(tile, tile, True, 6, by_head)
        found += [tuple(sorted((words[x], words[y]))) for x, y in zip(i.tolist(), j.tolist())]
    want = [tuple(sorted(p)) for p in itertools.combinations(words, 2) if _near(*p) and min(map(len, p)) == 6]
    assert sorted(found) == sorted(want) and len(set(found)) == len(found)
    assert np.array_equal(tile.counts.sum(axis=1), tile.size)
