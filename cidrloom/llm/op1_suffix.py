"""Suffix-array dedup with a run-length index (r-index).

Every byte covered by a `LENGTH`-byte string that also starts earlier in the corpus is removed.

1. Anchors. A `KMER`-byte string is an anchor where it has the smallest hash in some `LENGTH`-byte window that holds it.
   Equal windows have the same anchor at the same offset, so repeats meet at equal anchors. Anchors seen once have none.
2. Classes. The context of an anchor is all that windows around it can reach. Equal contexts of one anchor are a class,
   summed up to their first place before anything is shuffled; every later place of a class is a repeat as a whole.
3. Index. The distinct contexts of an anchor are compared window by window: they are concatenated, the Burrows-Wheeler transform is kept as runs with the suffix positions sampled at the runs' ends, and every
   context is streamed through it from its end to its start. Where `LENGTH` bytes match, the rows form an interval; its
   places are located from the sampled run ends, and a window whose earliest place lies before its own is marked.
4. Anchors with more than `CROWD` distinct contexts are dealt again by longer strings: each context is keyed by the bytes
   that all windows of a quarter of the offsets share; keys that are still crowded are dealt by single windows, whose
   first place is a minimum. No group is held by a task beyond CROWD contexts, and no pair of contexts is written.

Strings are compared by 64-bit hashes until they meet in an index, by bytes there; single windows by 128 bits of hash.

Defined cases: a null text is empty; a null id sorts after all others; rows that repeat an id with another text are
ordered by the texts' hashes, rows that repeat both are one document and each get its result; texts shorter than LENGTH
lose nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cidrloom.llm import kit
from cidrloom.llm.kit import staged

LENGTH = 100
KMER = 40
REACH = LENGTH - KMER  # bytes that a window can have on either side of its anchor
CROWD = 512
QUARTER = (REACH + 1) // 4 + 1
INDEX_BYTES = 1_000_000
PLACE = "d long, th long"


# ---- anchors --------------------------------------------------------------------------------------------------------


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over every run of `width` values."""
    step = 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray, at: np.ndarray, contexts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, row, k-mer hash and (else none) context hash of every anchor of a block."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    stretch = kit.Hashes(kit.BYTE_CODES[raw])
    n = len(raw) - KMER + 1
    i = np.arange(n)
    h = kit.mix(stretch.of(i, i + KMER))
    value = (h >> np.uint64(33)).astype(np.uint32)
    value += np.uint32(1)  # 0 stands for no window
    low = _slide(value, REACH + 1, np.minimum)
    # Windows that cross a row's end are none.
    edge = np.zeros(len(low) + 1, np.int32)
    for cut in at[1:-1]:
        edge[max(0, cut - LENGTH + 1) : cut + 1] = 1
    low[(edge[: len(low)] > 0) & (i[: len(low)] + LENGTH > at[np.searchsorted(at, i[: len(low)], "right")])] = 0
    padded = np.zeros(n + REACH, np.uint32)
    padded[REACH : REACH + len(low)] = low
    chosen = np.flatnonzero(_slide(padded, REACH + 1, np.maximum) == value)
    row = np.searchsorted(at, chosen, "right") - 1
    # A k-mer can equal the minimum of windows in its own row only: both ends lie there.
    good = chosen + KMER <= at[row + 1]
    chosen, row = chosen[good], row[good]
    if not contexts:
        return chosen - at[row], row, h[chosen], none.view(np.uint64)
    lo, hi = np.maximum(chosen - REACH, at[row]), np.minimum(chosen + LENGTH, at[row + 1])
    context = kit.mix(stretch.of(lo, hi) + kit.mix(((chosen - lo) << 20 | (hi - lo)).astype(np.uint64)))
    return chosen - at[row], row, h[chosen], context


def _anchor_rows(rows: DataFrame) -> DataFrame:
    def work(batches):
        for part, raw, at in kit.blocks(batches, "text"):
            pos, row, h, c = anchors(raw, at)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(pos), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], names=["d", "th", "pos", "h", "c"])

    return rows.select("d", "th", "text").mapInArrow(work, f"{PLACE}, pos long, h long, c long")


def _repeated(rows: DataFrame) -> DataFrame:
    """The hashes `h` of anchors that occur twice or more. Every block is summed up before its rows leave Python."""

    def work(batches):
        for _, raw, at in kit.blocks(batches, "text"):
            h = np.sort(anchors(raw, at, contexts=False)[2])
            head = np.flatnonzero(np.append(len(h) > 0, h[1:] != h[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(np.diff(np.append(head, len(h))))], names=["h", "n"])

    return rows.select("text").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


# ---- index ----------------------------------------------------------------------------------------------------------


class RunIndex:
    """Run-length BWT of a few contexts with suffix positions sampled at run ends.

    `document` (ranked in corpus order) and `lo` say where each context starts; contexts of one document may overlap.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, document: np.ndarray, lo: np.ndarray):
        m, n = len(at) - 1, len(raw) + len(at) - 1
        self.begin, self.end = at[:-1] + np.arange(m), at[1:] + np.arange(m)  # in the text with separators
        symbol = np.empty(n, np.int64)
        owner = kit.rows_of(at)
        place = np.arange(len(raw)) + owner
        symbol[place] = raw.astype(np.int64) + m
        symbol[self.end] = np.arange(m)  # every separator is a symbol of its own, so no two suffixes tie
        self.place = np.full(n, np.iinfo(np.int64).max)  # document and byte of every position
        self.place[place] = ((document << 40) + lo - at[:-1])[owner] + np.arange(len(raw))
        order, ranks3, ranks96 = self._sorted(symbol)
        self._runs(order, symbol)
        # Rows that share their first LENGTH symbols with the row before.
        same = np.maximum(order[:-1], order[1:]) + LENGTH <= n
        for value in (ranks96[order], ranks3[np.minimum(order + 96, n - 1)], ranks3[np.minimum(order + 97, n - 1)]):
            same &= value[1:] == value[:-1]
        self.interval = np.concatenate(([0], np.cumsum(~same)))
        self.earliest = self._locate(np.bincount(self.interval))
        self.m = m

    @staticmethod
    def _sorted(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix order, and ranks by the first 3 and the first 96 symbols (equal rank: equal symbols)."""
        n = len(symbol)
        at = np.arange(n)
        bits = n.bit_length()
        mask = (1 << bits) - 1

        def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if int(key.max(initial=0)).bit_length() + bits <= 63:
                packed = (key << bits) | at
                packed.sort()
                order, key = packed & mask, packed >> bits
            else:
                order = np.argsort(key, kind="stable")
                key = key[order]
            out = np.empty(n, np.int64)
            out[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if n else out
            return out, order

        def shifted(x: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate((x[by:] + 1, np.zeros(min(by, n), np.int64)))

        base = int(symbol.max(initial=0)) + 2
        if base**3 < 1 << (63 - bits):  # three symbols in one sort
            rank, order = ranked((symbol * base + shifted(symbol, 1)) * base + shifted(symbol, 2))
        else:
            one, _ = ranked(symbol)
            two, _ = ranked(one * (n + 1) + shifted(one, 1))
            rank, order = ranked(two * (n + 1) + shifted(one, 2))
        three, wide, width = rank, rank, 3
        while width < n and int(rank.max(initial=0)) < n - 1:
            rank, order = ranked(rank * (n + 1) + shifted(rank, width))
            width *= 2
            if width <= 96:
                wide = rank
        return order, three, wide

    def _runs(self, order: np.ndarray, symbol: np.ndarray):
        n = len(order)
        before = symbol[order - 1]
        head = np.concatenate(([True], before[1:] != before[:-1]))
        self.start = np.flatnonzero(head)
        self.run = np.cumsum(head, dtype=np.int32) - 1  # of every row
        self.stop = np.append(self.start[1:], n) - 1
        char, size = before[self.start], self.stop - self.start + 1
        by = np.argsort(char, kind="stable")  # first column: runs by symbol
        self.maps_to = np.empty(len(by), np.int64)
        self.maps_to[by] = np.cumsum(size[by]) - size[by]
        # Samples: the position at the last row of every run; and, for phi, the positions just before those at the
        # runs' first rows, with the position in the row above.
        self.tail = order[self.stop]
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.sample = np.sort((order[self.start] - 1) % n)
        self.prior = order[row[self.sample] - 1]

    def step(self, row: np.ndarray) -> np.ndarray:
        """LF: the row of the suffix that starts one symbol earlier."""
        run = self.run[row]
        return self.maps_to[run] + row - self.start[run]

    def above(self, position: np.ndarray) -> np.ndarray:
        """Phi: the position in the row above. Up to the next sample it moves in step with `position`."""
        k = np.searchsorted(self.sample, position)
        return self.prior[k] - (self.sample[k] - position)

    def position(self, row: np.ndarray) -> np.ndarray:
        """Position of a row: LF steps until the last row of a run, where it is sampled."""
        out = np.empty(len(row), np.int64)
        todo, steps = np.arange(len(row)), 0
        while len(todo):
            run = self.run[row]
            ends = self.stop[run] == row
            out[todo[ends]] = self.tail[run[ends]] + steps
            row, todo, run = row[~ends], todo[~ends], run[~ends]
            row = self.maps_to[run] + row - self.start[run]
            steps += 1
        return out

    def _locate(self, sizes: np.ndarray) -> np.ndarray:
        """Earliest place of every interval of two rows or more: from its last row's position upwards by phi."""
        earliest = np.full(len(sizes), np.iinfo(np.int64).max)
        many = np.flatnonzero(sizes > 1)
        if not len(many):
            return earliest
        position = self.position(np.cumsum(sizes)[many] - 1)
        left = sizes[many] - 1
        best = self.place[position]
        while len(many):
            position, left = self.above(position), left - 1
            best = np.minimum(best, self.place[position])
            done = left == 0
            earliest[many[done]] = best[done]
            many, position, left, best = many[~done], position[~done], left[~done], best[~done]
        return earliest

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(context, offset) of every window that also starts at an earlier place, by streaming all contexts."""
        size = self.end - self.begin
        order = np.argsort(-size, kind="stable")
        row = order.copy()  # the separators' suffixes are the first rows, in their order
        contexts, offsets = [], []
        for t in range(1, int(size.max(initial=0)) + 1):
            alive = int(np.searchsorted(-size[order], -t, "right"))
            row[:alive] = self.step(row[:alive])
            if t < LENGTH:
                continue
            which = order[:alive]
            offset = size[which] - t
            hit = self.earliest[self.interval[row[:alive]]] < self.place[self.begin[which] + offset]
            contexts.append(which[hit])
            offsets.append(offset[hit])
        return (np.concatenate(contexts), np.concatenate(offsets)) if contexts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spans(which: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the windows that start at `start` of item `which`: item, first byte, end."""
    if not len(which):
        return which, start, start
    by = np.lexsort((start, which))
    which, start = which[by], start[by]
    new = np.concatenate(([True], (which[1:] != which[:-1]) | (start[1:] > start[:-1] + LENGTH)))
    last = np.append(np.flatnonzero(new)[1:], len(which)) - 1
    return which[new], start[new], start[last] + LENGTH


_CONTEXT = f"key long, {PLACE}, lo long, bytes binary"
_SPAN = f"{PLACE}, start long, end long"


def index_contexts(contexts: DataFrame) -> DataFrame:
    """Marked spans of contexts `key, d, th, lo, bytes`, at most CROWD of a key, each key's in one index."""

    def work(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(table: pa.Table):
            raw, at = kit.utf8(table.column("bytes"))
            lo = table.column("lo").to_numpy()
            ids = np.stack((table.column("d").to_numpy(), table.column("th").to_numpy()), axis=1)
            which, offset = RunIndex(raw, at, np.unique(ids, axis=0, return_inverse=True)[1].reshape(-1), lo).repeated()
            which, start, end = _spans(which, offset)
            lo = lo[which]
            pick = pa.array(which)
            for part in table.select(["d", "th"]).take(pick).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lo + start), pa.array(lo + end)], names=["d", "th", "start", "end"])

        # Runs of whole keys of about INDEX_BYTES; batches are sorted by key and place.
        for batch in batches:
            raw_at = kit.utf8(batch.column(4))[1]
            keys = batch.column(0).to_numpy()
            lo = 0
            heads = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, batch.num_rows)
            for hi in [*([0] if held and held[-1].column(0)[-1].as_py() != keys[0] else []), *heads.tolist()]:
                if hi > lo:
                    piece = batch.slice(lo, hi - lo)
                    if held and size > INDEX_BYTES and held[-1].column(0)[-1].as_py() != keys[lo]:
                        yield from solve(pa.Table.from_batches(held))
                        held, size = [], 0
                    held.append(piece)
                    size += int(raw_at[hi] - raw_at[lo])
                    lo = hi
        if held:
            yield from solve(pa.Table.from_batches(held))

    return contexts.select("key", "d", "th", "lo", "bytes").repartition("key").sortWithinPartitions("key", "d", "th", "lo").mapInArrow(work, _SPAN)


def _cut(contexts: DataFrame, reach: int, step: int) -> DataFrame:
    """Contexts keyed anew by what all windows of `step` neighbouring offsets share; `skip` is the anchor's offset in them."""

    def work(batches):
        for batch in batches:
            raw, at = kit.utf8(batch.column(4))
            stretch = kit.Hashes(kit.BYTE_CODES[raw])
            left, size = batch.column(5).to_numpy(), np.diff(at)
            key, lo = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for first in range(0, reach + 1, step):  # windows that start first..last bytes before the anchor
                last = min(first + step - 1, reach)
                begin, end = np.maximum(left - last, 0), np.minimum(left - first + LENGTH, size)
                good = np.flatnonzero((end - begin >= LENGTH) & (left >= first) & (left - first + LENGTH > 0))
                # Shared by all windows of the lot: from `first` before the anchor to LENGTH - last after it.
                a, b = left[good] - first, np.minimum(left[good] - last + LENGTH, size[good])
                fresh = kit.mix(stretch.of(at[good] + a, at[good] + np.maximum(a, b)) + kit.mix(key[good].view(np.uint64) + np.uint64(first)))
                pieces = [bytes(raw[at[i] + x : at[i] + y]) for i, x, y in zip(good, begin[good], end[good], strict=True)]
                pick = pa.array(good)
                yield pa.RecordBatch.from_arrays([pa.array(fresh.view(np.int64)), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(lo[good] + begin[good]), pa.array(pieces, pa.binary())], names=["key", "d", "th", "lo", "bytes"])

    return contexts.select("key", "d", "th", "lo", "bytes", "left").mapInArrow(work, _CONTEXT)


def _windows(contexts: DataFrame) -> DataFrame:
    """Marked spans of crowded contexts: every window by 128 bits of hash, first place by minimum."""

    def work(batches):
        for batch in batches:
            raw, at = kit.utf8(batch.column(4))
            count = np.maximum(np.diff(at) - LENGTH + 1, 0)
            which = np.repeat(np.arange(batch.num_rows), count)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = at[which] + offset
            one = kit.Hashes(kit.BYTE_CODES[raw]).of(start, start + LENGTH)
            two = kit.Hashes(kit.mix(kit.BYTE_CODES + np.uint64(99))[raw]).of(start, start + LENGTH)
            pick = pa.array(which)
            lo = batch.column(3).to_numpy()[which] + offset
            yield pa.RecordBatch.from_arrays([pa.array(kit.mix(one).view(np.int64)), pa.array(kit.mix(two).view(np.int64)), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(lo)], names=["one", "two", "d", "th", "start"])

    rows = staged(contexts.select("key", "d", "th", "lo", "bytes").mapInArrow(work, f"one long, two long, {PLACE}, start long").distinct(), "windows")
    first = rows.groupBy("one", "two").agg(F.min(F.struct("d", "th", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = rows.join(first, ["one", "two"]).filter(F.struct("d", "th", "start") > F.col("first"))
    return late.select("d", "th", "start", (F.col("start") + LENGTH).alias("end"))


# ---- dedup ----------------------------------------------------------------------------------------------------------


def _packed(rows: DataFrame) -> DataFrame:
    """Texts as Zstandard frames, so that shuffles carry less."""

    def work(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packer.compress((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())], names=["d", "th", "packed"])

    return rows.select("d", "th", "text").mapInArrow(work, f"{PLACE}, packed binary")


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`key, d, th, lo, bytes, left, m` for the anchors `d, th, pos, h, m`."""
    per_text = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("pos", "h", "m")).alias("at"))  # as long as its text
    joined = _packed(rows).join(per_text, ["d", "th"]).select("d", "th", "packed", F.col("at.pos").alias("pos"), F.col("at.h").alias("h"), F.col("at.m").alias("m"))

    def work(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                text = unpacker.decompress(batch.column(2)[i].as_py())
                pos, h, m = (np.asarray(batch.column(k)[i].values) for k in (3, 4, 5))
                lo, hi = np.maximum(pos - REACH, 0), np.minimum(pos + LENGTH, len(text))
                n = len(pos)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h), pa.repeat(batch.column(0)[i], n), pa.repeat(batch.column(1)[i], n), pa.array(lo),
                    pa.array([text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()), pa.array(pos - lo), pa.array(m)], names=["key", "d", "th", "lo", "bytes", "left", "m"])

    return joined.mapInArrow(work, f"{_CONTEXT}, left long, m long")


def _removed(rows: DataFrame, full: DataFrame, spans: DataFrame) -> DataFrame:
    """Per distinct text its result, from anchors whose whole context repeats (`d, th, pos`) and marked spans."""
    marks = full.select("d", "th", "pos", F.lit(-1).cast("long").alias("end")).unionByName(spans.select("d", "th", F.col("start").alias("pos"), "end"))
    per_text = marks.groupBy("d", "th").agg(F.collect_list(F.struct("pos", "end")).alias("marks"))
    joined = _packed(rows).join(per_text, ["d", "th"], "left").select("d", "th", "packed", F.col("marks.pos").alias("pos"), F.col("marks.end").alias("end"))

    def work(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, p, e in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                text = unpacker.decompress(packed.as_py())
                removed, spans, kept = 0, 0, text
                if p.is_valid:
                    start, end = np.array(p.values), np.array(e.values)
                    whole = end < 0
                    end[whole] = np.minimum(start[whole] + LENGTH, len(text))
                    start[whole] = np.maximum(start[whole] - REACH, 0)
                    good = end - start >= LENGTH  # a shorter context holds no window
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, start[good], 1)
                    np.add.at(edge, end[good], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum()))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                                             names=["d", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(work, f"{PLACE}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """`key, n_bytes, n_removed, n_spans, kept_sha256, kept` (the remaining bytes) per row."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("d", F.coalesce(F.col("id"), F.lit((1 << 63) - 1)))
    once = rows.withColumn("th", F.lit(0).cast("long"))
    repeated = not rows.groupBy("d").count().filter("count > 1").isEmpty()
    if repeated:
        rows = rows.withColumn("th", F.xxhash64("text"))
        once = rows.dropDuplicates(["d", "th"])
    found = _anchor_rows(once)
    places = staged(found.join(_repeated(once), "h", "left_semi"), "anchors")
    classes = places.groupBy("h", "c").agg(F.min(F.struct("d", "th", "pos")).alias("first"))
    classes = staged(classes.select("h", "c", "first.*"), "classes")
    several = classes.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    contexts = staged(_contexts(once, classes.join(several, "h").select("d", "th", "pos", "h", "m")), "contexts")
    spans = index_contexts(contexts.filter(F.col("m") <= crowd))
    crowded = contexts.filter(F.col("m") > crowd)
    if not crowded.isEmpty():
        cut = staged(_cut(crowded, REACH, QUARTER), "cut")
        again = cut.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
        cut = staged(cut.join(again, "key"), "cut")
        spans = spans.unionByName(index_contexts(cut.filter(F.col("m") <= crowd))).unionByName(_windows(cut.filter(F.col("m") > crowd)))
    start = classes.select("h", "c", F.struct("d", "th", "pos").alias("first"))
    late = places.join(start, ["h", "c"]).filter(F.struct("d", "th", "pos") > F.col("first"))
    out = _removed(once, staged(late.select("d", "th", "pos"), "late"), staged(spans, "spans"))
    if repeated:
        out = rows.select("id", "d", "th").join(out, ["d", "th"])
        return out.select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out.select(F.when(F.col("d") != (1 << 63) - 1, F.col("d")).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
