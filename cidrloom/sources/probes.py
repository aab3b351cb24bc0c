"""Probe replies of a batch of traces to hops, with numpy over the flat replies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cidrloom.functions.patterns import PTR_FIELDS

_DEVICE = pa.struct([(f, pa.int64() if f == "customer_asn" else pa.string()) for f in PTR_FIELDS])


def _taken(values: pa.Array, at: np.ndarray, hops: np.ndarray, size: int) -> pa.Array:
    """`values[at]` at the places `hops` of a column of `size` rows, null elsewhere."""
    index = np.full(size, -1, np.int64)
    index[hops] = at
    return values.take(pa.array(index, mask=index < 0))


def _ends(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of equal keys."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return first, np.append(first[1:], len(keys))[: len(first)] - 1


def _addresses(addr: pa.Array, hop: np.ndarray, size: int) -> pa.Array:
    """Most frequent address of each hop, of equally frequent ones the smallest text."""
    known = np.flatnonzero(addr.is_valid().to_numpy(False))
    coded = addr.take(pa.array(known)).dictionary_encode()
    texts = coded.dictionary.cast(pa.binary()).to_pylist()
    by_text = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
    rank = np.empty(len(texts), np.int64)
    rank[by_text] = np.arange(len(texts))
    keys, votes = np.unique(hop[known] * max(1, len(texts)) + rank[coded.indices.to_numpy()], return_counts=True)
    hops, ranks = np.divmod(keys, max(1, len(texts)))
    order = np.lexsort((ranks, -votes, hops))
    best = order[_ends(hops[order])[0]]
    return _taken(coded.dictionary, by_text[ranks[best]], hops[best], size)


def _times(rtt: pa.Array, hop: np.ndarray, size: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Average, smallest and largest time of each hop; NaN is the largest, of equal times the first counts."""
    known = np.flatnonzero(rtt.is_valid().to_numpy(False))
    hop, times = hop[known], rtt.take(pa.array(known))
    plain = times.to_numpy(zero_copy_only=False)
    number = np.bincount(hop, minlength=size)
    total = np.bincount(hop, weights=plain, minlength=size)
    with np.errstate(invalid="ignore", divide="ignore"):
        average = pa.array(total / number, mask=number == 0, from_pandas=False)
    up = np.lexsort((plain, hop))
    best = up[_ends(hop[up])[0]]
    down = np.lexsort((-np.arange(len(plain)), plain, hop))
    worst = down[_ends(hop[down])[1]]
    return average, _taken(times, best, hop[best], size), _taken(times, worst, hop[worst], size)


def hops_column(probes: pa.Array) -> pa.Array:
    """Lists of replies `addr, probe_ttl, rtt, icmp_type` to lists of hops; no replies give no hops."""
    lengths = pc.fill_null(pc.list_value_length(probes), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(probes)), lengths)
    addr, ttl, rtt, kind = (pc.struct_field(probes.flatten(), i) for i in range(4))
    ttl = pc.fill_null(ttl, 0).to_numpy(zero_copy_only=False)
    deepest = np.zeros(len(probes), np.int64)
    np.maximum.at(deepest, row, ttl)
    ends = np.concatenate([[0], np.cumsum(deepest)])
    size = int(ends[-1])
    counted = np.flatnonzero(ttl >= 1)
    hop = ends[row[counted]] + ttl[counted] - 1
    addr, rtt, kind = (c.take(pa.array(counted)) for c in (addr, rtt, kind))
    typed = np.flatnonzero(kind.is_valid().to_numpy(False))
    first_typed, first = np.unique(hop[typed], return_index=True)
    hops = pa.StructArray.from_arrays(
        [
            pa.array((np.arange(size) - np.repeat(ends[:-1], deepest) + 1).astype(np.int32)),
            _addresses(addr, hop, size),
            *_times(rtt, hop, size),
            _taken(kind, typed[first], first_typed, size),
            pa.nulls(size, pa.int64()),
            pa.nulls(size, pa.string()),
            pa.nulls(size, _DEVICE),
        ],
        ["hop", "ip", "rtt_avg", "rtt_best", "rtt_worst", "icmp_type", "asn", "ptr", "device"],
    )
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hops)
