"""N-gram Jaccard join over a count-vector R-tree.

A text's set is its distinct word shingles (3 words, or the width that is passed). Shingles are hashed into groups,
`DIMS` to 512 of them or a quarter of the shingles; the group counts are the text's point, folded to `DIMS` for the tree. The
overlap of two sets is at most the sum of the smaller coordinates, so a pair, or a whole R-tree node by the upper corner of
its box, is dropped when that sum is below what the similarity needs. Pairs that survive are verified on their exact sets.

Texts meet through group signatures, which lose no pair. Two sets of sizes a and b with similarity s or more differ in at
most (a + b)(1 - s)/(1 + s) shingles. Sizes are cut into classes; a class with at most D differing shingles hashes its
sets into more than D groups, so one group at least is the same in both, and its hash is a key both have. Sets near
the next class are keyed there too. There are more groups to spare than sets usually leave empty, so a pair shares a filled
one; only sets with more empty groups than that are also met through keys of those.
Keys are dealt in ranges of (key, node) and read once in their order, so the rows of a hot key spread over tasks and only
keys of several nodes are kept.

Equal sets are one node. In each bucket the node that meets most others is the centre. Every node is checked against its
best centre, then, where components still meet, against the centres of all its buckets, which joins groups of near
copies, however large. Buckets that still hold several components are searched by R-tree, across components only; those
of one centre are searched as one, without the centre, which all their nodes were checked against. Searches of over
`BUCKET` nodes are dealt to tasks as pairs of blocks, which covers every pair of nodes and holds two blocks at a time.

Defined cases: texts without words, null or empty, have no shingle and are alone; repeated rows and ids each give a row
(a null id is never a component's name while another exists); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.llm import kit
from cidrloom.llm.components import components
from cidrloom.llm.kit import staged

SIMILARITY = (90, 100)  # a pair links when 100 * overlap >= 90 * union
WORDS = 3
DIM_BITS = 7
DIMS = 1 << DIM_BITS
FINE_BITS = 9
CLASS = 1.5  # ratio of the sizes in one class
BUCKET = 2048
LEAF = 16
REMEMBERED = 500_000  # sets a task knows as seen; copies beyond are keyed again, which changes no result


# ---- sets -----------------------------------------------------------------------------------------------------------


def shingles(raw: np.ndarray, at: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block and their rows, sorted by row."""
    raw = kit.LOWER[raw]
    start, end, row = kit.words(raw, at)
    hashes = kit.word_hashes(raw, start, end)
    codes, first = kit.windows(hashes, row, width)
    owner = row[first]
    count = np.bincount(row, minlength=len(at) - 1)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(row, short)
        for words in range(1, width):
            some = count[short] == words
            codes, owner = np.concatenate((codes, kit.chained(hashes, begin[some], words))), np.concatenate((owner, short[some]))
    _, once = np.unique(kit.mix(codes + kit.mix(owner.astype(np.uint64) + np.uint64(11))), return_index=True)
    codes, owner = codes[once], owner[once]
    by = np.argsort(owner, kind="stable")
    return codes[by], owner[by]


@lru_cache
def size_classes(part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest size of each class (all 64-bit sizes) and the most shingles in which two of its sets may differ."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * CLASS)))
    low = np.array(low)
    # Similarity p/q: overlap I, union U, a + b = I + U, difference U - I <= (a + b)(q - p)/(q + p).
    return low, 2 * (np.append(low[1:], low[-1] * 2) - 1) * (whole - part) // (whole + part)


@lru_cache
def spare_groups(part: int, whole: int) -> np.ndarray:
    """Groups of each class beyond the shingles that may differ, more than its smallest sets usually leave empty.

    A pair then agrees on a filled group too. Keys of empty groups, which all sets with that gap share, are rare.
    """
    differ = size_classes(part, whole)[1]
    least = part * (whole + part) / (2 * CLASS * whole * (whole - part)) if whole > part else 1e9  # shingles to a differing one
    share = 0.0
    for _ in range(50 if least > 2 else 0):  # of empty groups, where their number adds to the groups; few words to a group have no use of it
        share = float(np.exp(-least * (1 - share)))
    empty = differ * share / (1 - share)
    return np.maximum(np.maximum(2, differ // 50), np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64))


def signatures(codes: np.ndarray, owner: np.ndarray, size: np.ndarray, similarity=SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of all sets of a block and their rows."""
    part, whole = similarity
    low, differ = size_classes(part, whole)
    spares = spare_groups(part, whole)
    own = np.searchsorted(low, size, "right") - 1
    keys, rows = [], []
    for ahead in (0, 1):
        cls = own + ahead
        # The class above is met by sets large enough to have a partner there.
        takes = (size > 0) & (differ[np.maximum(cls, 0)] > 0)
        if ahead:
            takes &= size * whole >= low[np.maximum(cls, 0)] * part
        members = np.flatnonzero(takes)
        if not len(members):
            continue
        groups = np.zeros(len(size), np.int64)
        groups[members] = differ[cls[members]] + 1 + spares[cls[members]]
        base = np.concatenate(([0], np.cumsum(groups)))
        item = takes[owner]
        slot = base[owner[item]] + (kit.mix(codes[item] ^ np.uint64(77)) % groups[owner[item]].astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, kit.mix(codes[item] + np.uint64(5)))
        filled = np.bincount(slot, minlength=base[-1])
        row = np.repeat(np.arange(len(size)), groups)
        number = np.arange(base[-1]) - base[row]
        # Empty groups are needed only where a pair could agree on more of them than are spare.
        empty = np.bincount(row[filled == 0], minlength=len(size))
        use = (filled > 0) | (empty[row] > spares[np.maximum(cls, 0)][row])
        row, number, total = row[use], number[use], total[use]
        keys.append(kit.mix(total + kit.mix((cls[row] * (1 << 40) + number).astype(np.uint64))))
        rows.append(row)
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def fetch_key(key: Column, text: Column) -> Column:
    return F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.md5(text)))


def profiles(docs: DataFrame, key: str, text: str, similarity=SIMILARITY, width: int = WORDS) -> DataFrame:
    """`id, fetch, n, node, counts, keys` of every row; `node` names the set, null for an empty one.

    Of equal sets in one task, the first alone has keys.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), fetch_key(F.col(key), F.col(text)).alias("fetch"))

    def work(batches):
        given: set[int] = set()  # sets whose keys this task gave already, for copies
        for part, raw, at in kit.blocks(batches, "text"):
            codes, owner = shingles(raw, at, width)
            n = part.num_rows
            size = np.bincount(owner, minlength=n)
            node = np.zeros(n, np.uint64)
            np.add.at(node, owner, kit.mix(codes + np.uint64(19)))
            node = kit.mix(node + size.astype(np.uint64)).view(np.int64)
            fresh = np.zeros(n, bool)
            for i in np.flatnonzero(size):
                if int(node[i]) not in given:
                    fresh[i] = True
                    if len(given) < REMEMBERED:
                        given.add(int(node[i]))
            asked = fresh[owner]
            keys, rows = signatures(codes[asked], owner[asked], np.where(fresh, size, 0), similarity)
            by = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[by], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(node, mask=size == 0),
                group_counts(codes, owner, size), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[by].view(np.int64)))], names=["id", "fetch", "n", "node", "counts", "keys"])

    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, fetch string, n long, node long, counts binary, keys array<long>")


# ---- group counts ---------------------------------------------------------------------------------------------------


def group_bits(size: np.ndarray) -> np.ndarray:
    """Binary digits of the number of groups of a set: about a quarter of its shingles, at least DIMS.

    Up to `FINE_BITS` there are more groups than shingles: what two sets do not share then seldom counts as shared.
    """
    size = np.maximum(size, 1)
    return np.maximum(np.maximum(DIM_BITS, np.log2(size / 4).astype(np.int64)), np.minimum(FINE_BITS, np.log2(size * 2).astype(np.int64)))


def group_counts(codes: np.ndarray, owner: np.ndarray, size: np.ndarray) -> pa.Array:
    """Shingles in each group, by the leading digits of their codes: a byte each, or four in sets with a count over 255."""
    bits = group_bits(size)
    base = np.concatenate(([0], np.cumsum(1 << bits)))
    total = np.bincount(base[owner] + (codes >> (64 - bits[owner]).astype(np.uint64)).astype(np.int64), minlength=base[-1])
    rows = np.split(total, base[1:-1])
    return pa.array([t.astype(np.uint8 if t.max() < 256 else "<i4").tobytes() for t in rows], pa.binary())


def unpacked(counts: list[bytes], bits: int, to: int) -> np.ndarray:
    """One row per set with `1 << bits` groups, folded to `1 << to`: neighbouring groups share their leading digits."""
    if all(len(c) == 1 << bits for c in counts):
        wide = np.frombuffer(b"".join(counts), np.uint8)
    else:
        wide = np.concatenate([np.frombuffer(c, np.uint8 if len(c) == 1 << bits else "<i4").astype(np.int32) for c in counts])
    wide = wide.reshape(len(counts), 1 << bits)
    return wide if bits == to else wide.reshape(len(counts), 1 << to, -1).sum(axis=2, dtype=np.int32)


# ---- R-tree ---------------------------------------------------------------------------------------------------------


def needed(a: np.ndarray, b: np.ndarray, similarity=SIMILARITY) -> np.ndarray:
    """Smallest overlap with which sets of sizes a and b link."""
    part, whole = similarity
    return -((-part * (a + b)) // (part + whole))


class RTree:
    """Points in a binary tree of boxes; a node keeps its upper corner, its smallest size and its range of components."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray):
        self.points, self.sizes, self.parts = points, sizes, parts
        self.nodes: list[tuple] = []
        if len(points):
            self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray) -> int:
        here = len(self.nodes)
        p = self.points[members]
        self.nodes.append(())
        children = None
        if len(members) > LEAF:
            axis = int((p.max(axis=0) - p.min(axis=0)).argmax())
            order = members[np.argsort(p[:, axis], kind="stable")]
            half = len(order) // 2
            children = (self._build(order[:half]), self._build(order[half:]))
        self.nodes[here] = (p.max(axis=0), int(self.sizes[members].min()), self.parts[members].min(), self.parts[members].max(), children, members)
        return here

    def join(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, similarity=SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) pairs of different components whose summed minima reach the needed overlap."""
        todo = [(0, np.arange(len(points)))] if len(self.points) else []
        while todo:
            at, asked = todo.pop()
            top, least, low, high, children, members = self.nodes[at]
            asked = asked[(low != high) | (parts[asked] != low)]
            bound = np.minimum(points[asked], top).sum(axis=1, dtype=np.int64)
            asked = asked[bound >= needed(sizes[asked], least, similarity)]
            if not len(asked):
                continue
            if children:
                todo += [(children[0], asked), (children[1], asked)]
                continue
            sums = np.minimum(points[asked][:, None, :], self.points[members][None]).sum(axis=2, dtype=np.int64)
            good = (sums >= needed(sizes[asked][:, None], self.sizes[members][None], similarity)) & (parts[asked][:, None] != self.parts[members][None])
            q, m = np.nonzero(good)
            if len(q):
                yield asked[q], members[m]


def folded(sets: DataFrame) -> DataFrame:
    """`node, n, point` of `node, n, counts`: the counts folded to `FINE_BITS` at most, a byte each, or four where one is over 255."""

    def work(batches):
        for batch in batches:
            bits = group_bits(batch.column(1).to_numpy())
            points = [unpacked([c.as_py()], int(b), min(int(b), FINE_BITS))[0] for c, b in zip(batch.column(2), bits, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.astype(np.uint8 if p.max() < 256 else "<i4").tobytes() for p in points], pa.binary())], names=["node", "n", "point"])
        kit.release_memory()

    return sets.select("node", "n", "counts").mapInArrow(work, "node long, n long, point binary")


def search_buckets(members: DataFrame, sets: DataFrame, similarity=SIMILARITY) -> DataFrame:
    """Candidate pairs `a, b` across components. `members`: `key, node, part` of buckets with several components."""
    size = members.groupBy("key").agg(F.count("*").alias("m"))
    rows = members.join(size, "key").withColumn("blocks", F.ceil(F.col("m") / BUCKET).cast("int"))
    own = F.pmod(F.hash("node"), F.col("blocks"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "part").join(folded(sets), "node")
    rows = rows.select("key", "lo", "hi", "own", "node", "part", "n", "point")

    def work(batches):
        held: list[pa.RecordBatch] = []

        def search(t: pa.Table):
            node, part, n, own = (t.column(c).to_numpy() for c in ("node", "part", "n", "own"))
            given, bits = t.column("point").to_pylist(), np.minimum(group_bits(n), FINE_BITS)

            @lru_cache
            def points(to: int) -> np.ndarray:  # of the sets that have so many groups
                out = np.zeros((len(n), 1 << to), np.int32)
                for b in np.unique(bits[bits >= to]).tolist():
                    at = np.flatnonzero(bits == b)
                    out[at] = unpacked([given[i] for i in at], b, to)
                return out.astype(np.int16) if out.max(initial=0) < 1 << 15 else out

            def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # by all groups that both have
                good, both = np.zeros(len(a), bool), np.minimum(bits[a], bits[b])
                for to in np.unique(both).tolist():
                    at = np.flatnonzero(both == to)
                    for some in np.array_split(at, len(at) // 4096 + 1):
                        shared = np.minimum(points(to)[a[some]], points(to)[b[some]]).sum(axis=1, dtype=np.int64)
                        good[some] = shared >= needed(n[a[some]], n[b[some]], similarity)
                return good

            left = np.flatnonzero(own == t.column("lo")[0].as_py())
            right = np.flatnonzero(own == t.column("hi")[0].as_py())
            p = points(DIM_BITS)
            pairs = []
            for q, m in RTree(p[left], n[left], part[left]).join(p[right], n[right], part[right], similarity):
                good = reach(right[q], left[m])
                a, b = node[right[q[good]]], node[left[m[good]]]
                pairs.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
            if pairs:
                found = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            spot = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            cut = [0, *(np.flatnonzero((spot[:, 1:] != spot[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if held and any(held[-1].column(i)[0] != batch.column(i)[lo] for i in range(3)):
                    yield from search(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from search(pa.Table.from_batches(held))
        kit.release_memory()

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(work, "a long, b long").distinct()


# ---- verification ---------------------------------------------------------------------------------------------------


def bounded(pairs: DataFrame, sets: DataFrame, similarity=SIMILARITY) -> DataFrame:
    """The pairs whose summed coordinate minima reach the needed overlap, over the groups that both sets have."""
    part, whole = similarity
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"c_{c}"))

    def work(batches):
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(lo, 512)
                n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
                bits_a, bits_b = group_bits(n_a), group_bits(n_b)
                good = np.zeros(batch.num_rows, bool)
                for x, y in set(zip(bits_a.tolist(), bits_b.tolist(), strict=True)):
                    at = np.flatnonzero((bits_a == x) & (bits_b == y))
                    points = [unpacked(batch.column(i).take(pa.array(at)).to_pylist(), bits, min(x, y)) for i, bits in ((4, x), (5, y))]
                    shared = np.minimum(*points).sum(axis=1, dtype=np.int64)
                    good[at] = shared >= needed(n_a[at], n_b[at], similarity)
                out = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["a", "b"])
        kit.release_memory()

    sizes = sets.select("node", "n")
    near = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").filter(F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part).select("a", "b")
    both = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "c_a", "c_b")
    return both.mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, tables: kit.Tables, similarity=SIMILARITY, width: int = WORDS) -> DataFrame:
    """The pairs `a, b` (a stored table) whose exact sets link, stored. Every text that takes part is fetched once, packed."""
    part_, whole = similarity

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())], names=["fetch", "packed"])
        kit.release_memory()

    takes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "fetch"), "node")
    texts = docs.select(fetch_key(F.col(key), F.col(text)).alias("fetch"), F.col(text)).mapInArrow(pack, "fetch string, packed binary").join(takes, "fetch")

    def sets(packed: list[bytes]) -> list[np.ndarray]:
        unpacker = zstandard.ZstdDecompressor()
        raw, at = kit.utf8(pa.array([unpacker.decompress(p) for p in packed], pa.large_binary()))
        codes, owner = shingles(raw, at, width)
        return np.split(codes, np.searchsorted(owner, np.arange(1, len(packed))))

    def named(batches):  # rows that share an id but not the text drop out here
        for batch in batches:
            keep = []
            for p, node in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at = kit.utf8(pa.array([zstandard.ZstdDecompressor().decompress(p)], pa.large_binary()))
                codes, _ = shingles(raw, at, width)
                with np.errstate(over="ignore"):
                    total = kit.mix(codes + np.uint64(19)).sum(dtype=np.uint64)
                keep.append(int(kit.mix(np.array([total + np.uint64(len(codes))], np.uint64)).view(np.int64)[0]) == node)
            yield batch.filter(pa.array(keep))
        kit.release_memory()

    texts = texts.select("fetch", "packed", "node").mapInArrow(named, "fetch string, packed binary, node long")
    texts = tables.keep(texts.select("node", "packed").dropDuplicates(["node"]), "texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("packed").alias(f"packed_{c}"))

    def compare(batches):
        for batch in batches:
            good, last, held = [], None, None
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                b = b.as_py()
                if b != last:
                    last, held = b, sets([b])[0]
                one = sets([a.as_py()])[0]
                overlap = len(np.intersect1d(one, held, assume_unique=True))
                good.append(overlap * whole >= part_ * (len(one) + len(held) - overlap) and overlap > 0)
            out = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["a", "b"])
        kit.release_memory()

    links = tables.keep(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "packed_a", "packed_b").mapInArrow(compare, "a long, b long"), "links")
    tables.drop(texts)
    kit.release_shuffles(docs.sparkSession)
    return links


# ---- buckets --------------------------------------------------------------------------------------------------------


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The distinct `key, node` of keys that several nodes have; a key at the edge of a range may also come with one node.

    One shuffle, by ranges of both columns, so that a key of many nodes spans as many tasks as it needs.
    """

    def work(batches):
        before = held = None  # the key before the held row; the last row, whose next row is not known yet
        for batch in batches:
            key, node = (batch.column(i).to_numpy() for i in range(2))
            if held is not None:
                key, node = np.concatenate((held[0], key)), np.concatenate((held[1], node))
            if not len(key):
                continue
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node = key[new], node[new]
            same = key[1:] == key[:-1]
            take = np.append(before is None or key[0] == before, same) | np.append(same, False)
            take[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[take]), pa.array(node[take])], names=["key", "node"])
            before = key[-2] if len(key) > 1 else before
            held = key[-1:].copy(), node[-1:].copy()
        if held is not None:  # the run may go on in the next range
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["key", "node"])
        kit.release_memory()

    return keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(work, "key long, node long")


# ---- centres --------------------------------------------------------------------------------------------------------


def centres(members: DataFrame) -> DataFrame:
    """`key, centre, met`: the node of each bucket that meets most others, counted over all its buckets.

    In a group of near copies that is the least edited one, which most others link with.
    """
    size = members.groupBy("key").agg(F.count("*").alias("m"))
    met = members.join(size, "key").groupBy("node").agg(F.sum("m").alias("met"))
    most = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("top"))
    return staged(most.select("key", F.col("top.node").alias("centre"), F.col("top.met").alias("met")), "centres")


def open_buckets(members: DataFrame, part: DataFrame) -> DataFrame:
    """`key, node, part` of the buckets that hold several components (`part`: `node, component`)."""
    placed = members.join(part, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    keys = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("key")
    return placed.join(keys, "key", "left_semi")


def by_centre(members: DataFrame, centre: DataFrame) -> DataFrame:
    """`key, node, part`: the buckets of one centre as one, named after it, without the centre itself.

    Near copies share most of their keys, and the buckets of these a centre: a pair comes up once for each centre, not
    once for each key. For buckets whose nodes have been checked against their centre; those of two nodes need no more.
    """
    rows = members.join(centre.select("key", "centre"), "key").filter("node != centre").select(F.col("centre").alias("key"), "node", "part").distinct()
    several = rows.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("key")
    return rows.join(several, "key", "left_semi")


# ---- the join -------------------------------------------------------------------------------------------------------


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity=SIMILARITY, width: int = WORDS) -> DataFrame:
    """`key, n, component, node` per row; `component` is the smallest id of its connected group."""
    spark = docs.sparkSession
    tables = kit.Tables(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = tables.keep(df, name)
        kit.release_shuffles(spark)
        return out

    check = lambda pairs: verified(pairs, sets, docs, key, text, tables, similarity, width)
    made = keep(profiles(docs, key, text, similarity, width), "profiles")
    rows = keep(made.select("id", "n", "node"), "rows")
    members = keep(shared_keys(made.select(F.explode("keys").alias("key"), "node")), "members")
    sets = keep(made.filter("node is not null").groupBy("node").agg(F.min("fetch").alias("fetch"), F.first("n").alias("n"), F.first("counts").alias("counts")), "sets")
    tables.drop(made)
    centre = centres(members)
    best = F.max_by("centre", F.struct("met", "centre"))
    star = members.join(centre, "key").filter("node != centre").groupBy(F.col("node").alias("a")).agg(best.alias("b"))
    pairs = keep(bounded(star, sets, similarity), "pairs")
    first_links = check(pairs)
    tables.drop(pairs)
    # Open buckets, which still hold several components: every node against the centre of each of them.
    part = keep(components(first_links), "parts")
    placed = keep(open_buckets(members, part), "open")
    tables.drop(members, part)
    place = lambda c: placed.select("key", F.col("node").alias(c), F.col("part").alias(f"part_{c}"))
    hubs = centre.select("key", F.col("centre").alias("b")).join(place("b"), ["key", "b"])
    spokes = place("a").join(hubs, "key").filter("part_a != part_b").select("a", "b").distinct()
    pairs = keep(bounded(spokes, sets, similarity), "pairs")
    links = first_links.unionByName(check(pairs))
    tables.drop(pairs)
    part = keep(components(links), "parts")
    # What is still open is searched.
    rest = keep(by_centre(open_buckets(placed.select("key", "node"), part), centre), "rest")
    tables.drop(placed)
    found = keep(search_buckets(rest, sets, similarity), "found")
    tables.drop(rest)
    pairs = keep(bounded(found, sets, similarity), "pairs")
    tables.drop(found)
    if not pairs.isEmpty():
        part = keep(components(links.unionByName(check(pairs))), "parts")
    tables.drop(pairs, sets)
    named = rows.join(part, "node", "left").select("id", "n", "node", F.coalesce("component", "node").alias("part"))
    named = staged(named, "named")
    tables.drop(rows)
    first = named.filter("part is not null").groupBy("part").agg(F.min("id").alias("component"))
    return named.join(first, "part", "left").select(F.col("id").alias(key), "n", F.coalesce("component", "id").alias("component"), "node")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity=SIMILARITY, width: int = WORDS) -> DataFrame:
    """`docs` with one row of each group: the one whose id names the group.

    Texts without words are linked with nothing and stay. Rows with a null id cannot name a group and stay. Of rows that
    repeat an id, one stays.
    """
    groups = grouped(docs, key, text, similarity, width)
    keep = groups.filter("component is not null").select(F.col("component").alias("_keep")).distinct()
    named = docs.filter(F.col(key).isNotNull())
    kept = named.join(keep, F.col(key) == F.col("_keep"), "left_semi")
    if not named.groupBy(key).count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.unionByName(docs.filter(F.col(key).isNull()))
