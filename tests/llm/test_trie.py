"""The prefix trie of conversations against a plain version."""

import hashlib
import zlib

import pytest

from cidrloom.llm import op11_trie


def _plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        base, h = c - (c % 5 if c >= 0 else -(-c % 5)), zlib.crc32(str(c).encode()) % 9
        made[c] = v if c == base else own.get(base, [])[:h] + v[h:]
    members = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = sum(saved[p] for p in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), up, len(convs), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _got(df, **options):
    return sorted(map(tuple, op11_trie.trie(df, **options).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def _rows():
    rows = []
    for c in range(-12, 60):
        if c % 20 != 5:  # some groups have no head
            rows += [(c, t, ("user", "assistant")[t % 2], f"text {c // 8 if t < 4 else c} {t} é") for t in range((c * 7) % 13)]
    same = [(c, t, "user", f"copy {t}") for c in range(100, 300, 5) for t in range(9)]
    long = [(c, t, "user", "x" if t < 40 else f"{t * (c == 605)}") for c in (600, 605, 610) for t in range(70)]
    odd = [(700, None, None, None), (700, None, "user", "a"), (700, 1, "user", "b"), (700, 1, "user", "b"), (700, 1, "user", "a"), (701, 0, None, "alone"), (None, 0, "user", "x"), (None, None, None, None), (702, None, None, None)]
    return rows + same + long + odd


@pytest.mark.parametrize("chunk", [16, 256])
def test_against_plain_version(shared, chunk):
    """Copies, long conversations over many chunks, negative ids, missing heads, nulls, ties, repeated rows."""
    rows = _rows()
    df = shared.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", depth int, names string").repartition(7)
    assert _got(df, chunk=chunk) == _plain(rows)


def test_few_rows(shared):
    assert _got(shared.createDataFrame([], SCHEMA)) == []
    assert _got(shared.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    for rows in ([(3, 0, "user", "x")], [(5, 0, "user", "x" * 100_000)], [(-1, 0, "user", "")]):
        assert _got(shared.createDataFrame(rows, SCHEMA)) == _plain(rows)


def test_names_of_prefixes():
    """Equal prefixes of different sequences have one name, at every depth; different ones have two."""
    codes = [bytes([i]) for i in range(20)]
    whole = op11_trie.cut(b"", codes, 64)
    for n in range(1, 20):
        assert op11_trie.cut(b"", codes[:n], 64) == whole[:n]
        other = op11_trie.cut(b"", [*codes[: n - 1], b"other", *codes[n:]], 64)
        assert other[: n - 1] == whole[: n - 1] and not set(other[n - 1 :]) & set(whole)
