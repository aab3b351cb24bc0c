"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments of `SEGMENT` bytes. A stretch of a document within `e` edits of a
segment of length L shares at least L + 1 - Q (e + 1) of its q-grams, on diagonals that differ by at most e. Shared
q-grams are counted per segment and diagonal band; bands overlap, so no such stretch is split. Regions that reach the
bound are kept and verified by banded alignment, free at both ends of the document's side. Edits count UTF-8 bytes, after
ASCII lower-casing and with every run of white space taken as one blank.

Segments start every `STRIDE` bytes, half of which is no more than the edits: an exact excerpt of `SEGMENT` bytes is
within the edits of a segment wherever it starts, and a replaced word with up to nine differing letters hides no segment.

The benchmark is a stated query set: it is read in blocks of at most `BLOCK` bytes of text (or one item), and every block
is matched against all documents. One block is held at a time: a benchmark of several blocks has what each block finds
(`matches`) or leaves (`clean`) written before the next block is read. Shared q-grams are expanded to their places in lots
of about `LOT`, cut by items and, where one item is left, by overlapping stretches of the documents.

Defined cases: null and empty texts match nothing; items of fewer than `LEAST` bytes, which a text may hold by chance, match
texts that are the same as a whole; repeated items each report; repeated rows and null ids each give their rows; empty tables give no rows; further columns of both
tables never travel in `matches` and stay in `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cidrloom.llm import kit

Q = 7
LEAST = 12  # bytes of the shortest item that is searched inside texts
LOT = 1_000_000  # places that shared q-grams are expanded to at a time
SEGMENT, STRIDE = 80, 16
EDITS = 0.1125  # of a segment's length: 9 of 80, a replaced word with up to nine differing letters
BLOCK = 4_000_000
TEXT_BLOCK = 250_000  # bytes of texts searched at a time; the search takes some 150 bytes of memory for each
BAND = 16  # diagonals of one band

_FORM = kit.LOWER.copy()
_FORM[kit.SPACE] = 0x20


def _grams(raw: np.ndarray) -> np.ndarray:
    """The q-grams at all bytes, as they are in the low bytes of 64-bit words."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.append(raw, np.zeros(8, np.uint8))
    return np.ndarray((n,), "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * Q) - 1)


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _folded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case, one blank for each run of white space in a row; bytes, offsets and the place of each byte in `raw`."""
    form = _FORM[raw]
    blank = form == 0x20
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[at[:-1][at[:-1] < len(raw)]] = True
    place = np.flatnonzero(keep)
    return form[place], np.searchsorted(place, at), place


class Segments:
    """The segments of a block of items with an index of the items' q-grams, each held once."""

    def __init__(self, ids: list, texts: list[str]):
        self.raw, item, start, grams, owner, place = [], [], [], [], [], []
        self.short: dict[bytes, list[int]] = {}
        self.longest = SEGMENT
        for k, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            raw = _folded(raw, np.array([0, len(raw)]))[0]
            if len(raw) < LEAST:
                self.short.setdefault(raw.tobytes(), []).append(k)
                continue
            self.longest = max(self.longest, len(raw))
            starts = list(range(0, max(1, len(raw) - SEGMENT + 1), STRIDE))
            if len(raw) > SEGMENT and starts[-1] + SEGMENT < len(raw):
                starts.append(len(raw) - SEGMENT)
            g = _grams(raw)
            grams.append(g)
            owner.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
            for s in starts:
                self.raw.append(raw[s : s + SEGMENT])
                item.append(k)
                start.append(s)
        self.ids = ids
        self.item, self.start = np.array(item, np.int64), np.array(start, np.int64)
        self.length = np.array([len(r) for r in self.raw], np.int64)
        # Never more edits than leave one q-gram whole.
        self.edits = np.minimum((EDITS * self.length).astype(np.int64), self.length // Q - 1)
        self.bound = self.length + 1 - Q * (self.edits + 1)
        self.least = np.full(len(texts), 1 << 40)
        np.minimum.at(self.least, self.item, self.bound)
        self.first = np.searchsorted(self.item, np.arange(len(texts) + 1))  # segments of each item
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, at = np.unique(keys[order], return_index=True)
        self.at = np.append(at, len(keys))  # places of each q-gram, by item
        self.owner = np.concatenate(owner)[order] if grams else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int64)
        self.spot = np.repeat(np.arange(len(self.keys)), np.diff(self.at)) * (len(texts) + 1) + self.owner
        self.bits = max(16, min(24, 6 + len(keys).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[_slots(self.keys, self.bits)] = True
        self.key_of = np.zeros(1 << self.bits, np.int32)  # one of the q-grams of each slot
        self.key_of[_slots(self.keys, self.bits)] = np.arange(len(self.keys))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each q-gram among the keys, and whether it is one."""
        if not len(self.keys):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        at = self.key_of[_slots(grams, self.bits)].astype(np.int64)
        other = np.flatnonzero(self.keys[at] != grams)  # none of the keys, or another one of the slot
        at[other] = np.minimum(np.searchsorted(self.keys, grams[other]), len(self.keys) - 1)
        return at, self.keys[at] == grams

    def places(self, gram: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of the places of each q-gram in the items from `low` up to `high`."""
        if (low, high) == (0, len(self.ids)):
            return self.at[gram], self.at[gram + 1]
        of = gram * (len(self.ids) + 1)
        return np.searchsorted(self.spot, of + low), np.searchsorted(self.spot, of + high)


def _repeated(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices lo, lo + 1, .. of each range."""
    return np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _bands(diagonal: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands of each hit and the hit's index.

    A band holds BAND diagonals and the edits before it, so a run of diagonals no wider than the edits lies in one band.
    """
    band, after = diagonal // BAND, (diagonal + edits) // BAND
    twice = np.flatnonzero(after != band)
    return np.concatenate((band, after[twice])), np.concatenate((np.arange(len(band)), twice))


def _candidates(index: Segments, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (segment, first byte of the segment's band, row) whose shared q-grams reach the bound."""
    grams = _grams(raw)
    hit = np.flatnonzero(index.seen[_slots(grams, index.bits)])
    gram, real = index.find(grams[hit])
    hit, gram = hit[real], gram[real]
    row_end = np.repeat(at[1:], np.diff(np.searchsorted(hit, at)))
    hit, gram = hit[hit + Q <= row_end], gram[hit + Q <= row_end]
    found, todo = [], [(0, len(hit), 0, len(index.ids))] if len(hit) else []
    over = SEGMENT + 2 * BAND + 3 * int(index.edits.max())  # a stretch that reaches the bound is no longer
    while todo:
        start, end, low, high = todo.pop()
        lo, hi = index.places(gram[start:end], low, high)
        total = int((hi - lo).sum())
        if not total:
            continue
        middle = (start + end) // 2
        if total > LOT and high - low > 1:
            todo += [(start, end, low, (low + high) // 2), (start, end, (low + high) // 2, high)]
        elif total > LOT and hit[end - 1] - hit[start] > 4 * over:
            half = int(np.searchsorted(hit, hit[middle] - over))
            todo += [(start, middle, low, high), (max(start + 1, half), end, low, high)]
        else:
            found.append(_reached(index, hit[start:end], lo, hi - lo))
    if not found:
        return np.zeros((0, 3), np.int64)
    segment, base = np.concatenate(found).T
    # The rows in reach of each band, mostly one.
    width = index.length[segment] + BAND + 3 * index.edits[segment]
    first = np.searchsorted(at, np.clip(base, 0, len(raw) - 1), "right") - 1
    last = np.searchsorted(at, np.clip(base + width, 0, len(raw) - 1), "right") - 1
    size = last - first + 1
    return np.unique(np.stack([np.repeat(segment, size), np.repeat(base, size), _repeated(first, size)], axis=1), axis=0)


def _reached(index: Segments, hit: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(segment, first byte of its band) of all segments that share enough q-grams in one band of diagonals.

    Hits are sorted by item, band and place, so that those of a segment in a band follow each other.
    """
    which = _repeated(lo, size)
    place, owner, hit = index.place[which], index.owner[which], np.repeat(hit, size)
    far = index.longest + SEGMENT  # makes diagonals positive
    band, of = _bands(hit - place + far, np.full(len(hit), index.edits.max()))
    group = band * len(index.ids) + owner[of]
    spread = index.longest + 1
    spot = np.sort(group * spread + place[of])
    head = spot // spread
    new = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
    count = np.diff(np.append(new, len(spot)))
    owner = head[new] % len(index.ids)
    good = count >= index.least[owner]
    head, owner = head[new][good], owner[good]
    size = index.first[owner + 1] - index.first[owner]
    segment, head = _repeated(index.first[owner], size), np.repeat(head, size)
    start = head * spread + index.start[segment]
    shared = np.searchsorted(spot, start + index.length[segment] - Q, "right") - np.searchsorted(spot, start)
    reach = shared >= index.bound[segment]
    segment, head = segment[reach], head[reach]
    return np.stack([segment, head // len(index.ids) * BAND - far + index.start[segment] - 2 * index.edits[segment]], axis=1)


def _alike(pattern: np.ndarray, text: np.ndarray, edits: int) -> np.ndarray:
    """Which patterns share enough four-byte grams, at any shift, with their texts to be within the edits."""
    def grams(x):
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x.astype(np.uint8), 4, axis=1)).view(np.uint32)[:, :, 0]

    mine, its = grams(pattern), grams(text)
    held = np.zeros(mine.shape, bool)
    for shift in range(its.shape[1] - mine.shape[1] + 1):
        held |= mine == its[:, shift : shift + mine.shape[1]]
    return held.sum(axis=1) >= pattern.shape[1] + 1 - 4 * (edits + 1)


def _verify(index: Segments, raw: np.ndarray, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits of each candidate and the document stretch that reaches them (absolute bytes)."""
    n = len(found)
    edits, start, end = np.full(n, 1 << 20), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for length in np.unique(index.length[found[:, 0]]):
        for lot in np.array_split(np.flatnonzero(index.length[found[:, 0]] == length), max(1, n // 2000)):
            if not len(lot):
                continue
            segment, base, row = found[lot].T
            e = int(index.edits[found[lot[0], 0]])
            width = length + BAND + 3 * e
            where = base[:, None] + np.arange(width)
            inside = (where >= at[row][:, None]) & (where < at[row + 1][:, None])
            text = np.where(inside, raw[np.clip(where, 0, len(raw) - 1)], 0)  # 0 never equals a segment's byte
            pattern = np.stack([index.raw[s] for s in segment])
            # The lemma again with four bytes, which few false candidates pass; alignment costs more.
            like = _alike(pattern, text, e)
            lot, text, pattern, base = lot[like], text[like], pattern[like], base[like]
            if not len(lot):
                continue
            steps = np.arange(width + 1)
            cost = np.zeros((len(lot), width + 1), np.int64)  # free start
            begin = np.broadcast_to(steps, cost.shape).copy()
            for i in range(length):
                across = cost[:, :-1] + (text != pattern[:, i : i + 1])
                down = cost[:, 1:] + 1
                best = np.minimum(across, down)
                origin = np.where(across <= down, begin[:, :-1], begin[:, 1:])
                best = np.concatenate((cost[:, :1] + 1, best), axis=1)
                origin = np.concatenate((begin[:, :1], origin), axis=1)
                # Insertions: the cheapest earlier column plus the distance to it.
                key = (best - steps) * (width + 1) * 2 + (width - steps)
                low = np.minimum.accumulate(key, axis=1)
                source = width - (low - np.floor_divide(low, (width + 1) * 2) * (width + 1) * 2)
                cost = np.floor_divide(low, (width + 1) * 2) + steps
                begin = np.take_along_axis(origin, source, axis=1)
            last = cost.argmin(axis=1)
            pick = np.arange(len(lot))
            edits[lot] = cost[pick, last]
            start[lot], end[lot] = base + begin[pick, last], base + last
    return edits, np.maximum(start, 0), end


def find_block(index: Segments, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, segments matched, start, end, fewest edits) per row and item, in bytes of the row."""
    if not len(raw):
        return []
    raw, at, source = _folded(raw, at)
    head = lambda row: source[at[row]]
    same = []
    if index.short:
        for row in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < LEAST)).tolist():
            same += [(row, k, 1, 0, int(source[at[row + 1] - 1] + 1 - head(row)), 0) for k in index.short.get(raw[at[row] : at[row + 1]].tobytes(), ())]
    found = _candidates(index, raw, at)
    if not len(found):
        return same
    edits, start, end = _verify(index, raw, at, found)
    good = edits <= index.edits[found[:, 0]]
    found, edits, start, end = found[good], edits[good], start[good], end[good]
    out: dict[tuple[int, int], list] = {}
    for (segment, _, row), e, a, b in zip(found.tolist(), edits.tolist(), start.tolist(), end.tolist(), strict=True):
        spot = out.setdefault((row, int(index.item[segment])), [set(), 1 << 60, 0, 1 << 20])
        spot[0].add(segment)
        spot[1], spot[2], spot[3] = min(spot[1], a), max(spot[2], b), min(spot[3], e)
    return same + [(row, item, len(s), int(source[a] - head(row)), int(source[b - 1] + 1 - head(row)), e) for (row, item), (s, a, b, e) in out.items()]


def hits_of(index: Segments, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int, int, int]]]]:
    """Runs of whole rows, as many as the search holds at a time, and what `find_block` has for them."""
    for part, raw, at in kit.blocks(batches, column, TEXT_BLOCK):
        yield part, find_block(index, raw, at)


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of at most BLOCK bytes of text."""
    ids, texts, size = [], [], 0
    for r in benchmark.filter(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        if texts and size + len(r["t"].encode()) > BLOCK:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"].encode())
    if texts:
        yield ids, texts


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per document and item with a match: `key, item, n_segments, start, end, edits` (bytes of the text)."""
    spark, rows = docs.sparkSession, kit.text_rows(docs, key)
    item_type = dict(benchmark.dtypes)[item]
    schema = f"`{key}` {dict(rows.dtypes)[key]}, `{item}` {item_type}, n_segments long, start long, end long, edits long"
    item_arrow = pa.int64() if item_type == "bigint" else None

    def found(shared) -> DataFrame:
        def work(batches):
            index = shared.value
            for part, hits in hits_of(index, batches, "text"):
                if hits:
                    row, which, *rest = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array([index.ids[k] for k in which], item_arrow), *[pa.array(x, pa.int64()) for x in rest]], names=[key, item, "n_segments", "start", "end", "edits"])

        return rows.mapInArrow(work, schema)

    out = spark.createDataFrame([], schema)
    for index, more in _with_next(item_blocks(benchmark, item, "text")):
        shared = spark.sparkContext.broadcast(Segments(*index))
        if more:
            out = out.unionByName(kit.Tables(spark).keep(found(shared), "matches"))
            shared.destroy()
        else:
            out = out.unionByName(found(shared))
    return out


def _with_next(blocks: Iterator) -> Iterator[tuple[tuple, bool]]:
    """Each block, and whether another one follows."""
    held = next(blocks, None)
    for block in blocks:
        yield held, True
        held = block
    if held is not None:
        yield held, False


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that match no item, with all their columns; no shuffle."""
    def left(docs: DataFrame, shared) -> DataFrame:
        def work(batches):
            for part, hits in hits_of(shared.value, batches, text):
                keep = [True] * part.num_rows
                for row, *_ in hits:
                    keep[row] = False
                yield part.filter(pa.array(keep))

        return docs.mapInArrow(work, docs.schema)

    tables, before = kit.Tables(docs.sparkSession), None
    for index, more in _with_next(item_blocks(benchmark, "item_id", "text")):
        shared = docs.sparkSession.sparkContext.broadcast(Segments(*index))
        docs = left(docs, shared)
        if more:
            docs = tables.keep(docs, "uncontaminated")
            shared.destroy()
            if before is not None:
                tables.drop(before)
            before = docs
    return docs
