"""Spelling variants by blocked Gram matrices of letter counts.

Words are runs of letters, in lower case (A-Z only), with `n` occurrences over all texts. Two words are near if they differ
by one inserted, deleted or replaced code point. Their letter counts then differ by a squared distance of one (a letter
more) or two (a letter replaced), and |a - b|^2 = |a|^2 + |b|^2 - 2 <a, b> comes from one matrix product per pair of blocks.
What is left, anagrams and the like, is settled by the letters themselves: the common head and the common tail of a near
pair leave out one code point.

Blocks hold words of one length L and of the next one. One edit spares the first L // 2 code points or the last
L - L // 2, so both words carry the same head or the same tail, which is the key that brings them together. A pair is
taken under its head if that is equal, else under its tail, so that it is found once. Each word stands under four keys,
whatever its length. Blocks over `TILE` words are dealt to tasks as pairs of tiles, which covers all their pairs and holds
two tiles at a time; a tile of very long words has fewer words.

A word's `form` is its near word of largest n (ties: smallest in code-point order) if that n is `RATIO` times its own or
more. n grows by that factor at each step, so chains of forms are short; roots are found by doubling.

Defined cases: a null text has no words; a null id counts as empty text in the checksum; repeated rows and ids all count;
texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.llm.kit import Tables

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199  # a run whose checksum this number divides has lost one code point
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
ALPHABET = 26 + 64
TILE = 2048
TILE_BYTES = 8_000_000


def runs(key: Column, text: Column) -> Column:
    """All words of a text, each as often as it occurs."""
    def word(run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    return F.transform(found, word)


def counted(docs: DataFrame, key: str, text: str, least: int = MIN_COUNT) -> DataFrame:
    """`word, n` of all words that are long and frequent enough; counts are summed up before they are shuffled."""
    words = docs.select(F.explode(F.filter(runs(F.col(key), F.col(text)), lambda w: F.length(w) >= MIN_LENGTH)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


# ---- blocks ---------------------------------------------------------------------------------------------------------


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words as a matrix, 1 to 90 with zeros behind, and the word lengths."""
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    size = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.where(codes < 0xC0, codes - 96, codes - 0xC0 + 27).astype(np.uint8)
    out = np.zeros((len(size), int(size.max(initial=0))), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(code)) - (np.cumsum(size) - size)[row]] = code
    return out, size


class Tile:
    """Words of one block with their letter counts."""

    def __init__(self, words: pa.Array):
        self.words = words
        self.code, self.size = letters(words)
        row = np.repeat(np.arange(len(self.size)), self.size)
        flat = row * ALPHABET + self.code[self.code > 0].astype(np.int64) - 1
        self.counts = np.bincount(flat, minlength=len(self.size) * ALPHABET).reshape(-1, ALPHABET).astype(np.float64)
        self.square = (self.counts**2).sum(axis=1)


def near_pairs(a: Tile, b: Tile, same: bool, short: int, by_head: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the near pairs of two tiles of a block for lengths `short` and `short + 1`."""
    distance = a.square[:, None] + b.square - 2 * (a.counts @ b.counts.T)
    equal = (a.size[:, None] == short) & (b.size == short)
    next_ = a.size[:, None] != b.size
    i, j = np.nonzero((equal & (distance == 2)) | (next_ & (distance == 1)))
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    # Candidates are settled in runs whose letters stay within TILE_BYTES, however long the words are.
    step = max(1, TILE_BYTES // max(a.code.shape[1], b.code.shape[1]))
    fine = np.concatenate([one_edit(a, b, i[at : at + step], j[at : at + step], short, by_head) for at in range(0, len(i), step)])
    return i[fine], j[fine]


def one_edit(a: Tile, b: Tile, i: np.ndarray, j: np.ndarray, short: int, by_head: bool) -> np.ndarray:
    """Which of the pairs `i, j` differ by one edit and belong to this kind of key."""
    # The shorter word of each pair first.
    swap = a.size[i] > b.size[j]
    width = max(a.code.shape[1], b.code.shape[1])
    x, y = np.zeros((len(i), width), np.uint8), np.zeros((len(i), width), np.uint8)
    x[:, : a.code.shape[1]], y[:, : b.code.shape[1]] = a.code[i], b.code[j]
    x, y = np.where(swap[:, None], y, x), np.where(swap[:, None], x, y)
    size, more = np.minimum(a.size[i], b.size[j]), np.abs(a.size[i] - b.size[j])
    place = np.arange(width)
    head = np.where((x != y).any(axis=1), (x != y).argmax(axis=1), width)
    # Tails are compared from the right end of each word.
    right = lambda t, n: t[np.arange(len(t))[:, None], np.maximum(n[:, None] - 1 - place, 0)]
    apart = (right(x, size) != right(y, size + more)) | (place >= size[:, None])
    tail = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    near = np.minimum(head, size) + tail >= np.where(more == 1, size, size - 1)
    # Under the tail's key, pairs that share their head are left to the head's key.
    return near & ((head >= short // 2) == by_head)


def near_words(words: DataFrame) -> DataFrame:
    """`word, n, other, other_n` of each near pair, both ways. `words`: `word, n`, stored."""
    length = F.length("word")
    spots = []
    for short in (length, length - 1):
        half = F.floor(short / 2).cast("int")
        spots.append(F.struct(short.alias("short"), F.lit(True).alias("by_head"), F.substring(F.col("word"), F.lit(1), half).alias("part")))
        spots.append(F.struct(short.alias("short"), F.lit(False).alias("by_head"), F.right(F.col("word"), short - half).alias("part")))
    placed = words.select("word", "n", F.explode(F.array(*spots)).alias("s"))
    placed = placed.select(F.xxhash64("s.short", "s.by_head", "s.part").alias("key"), F.col("s.short").alias("short"), F.col("s.by_head").alias("by_head"), "word", "n")
    room = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (F.col("short") + 1))))
    # A block is of use only if some word has its shorter length.
    size = placed.groupBy("key", "short", "by_head").agg(F.count("*").alias("m"), F.min(F.length("word")).alias("least"))
    size = size.filter("m > 1 and least = short").withColumn("tiles", F.ceil(F.col("m") / room).cast("int")).drop("m", "least")
    met = placed.join(size, ["key", "short", "by_head"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("key", "short", "by_head", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "word", "n")
    spot = ["key", "short", "by_head", "lo", "hi"]
    names = ["word", "n", "other", "other_n"]

    def pairs(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        short, by_head, lo, hi = (t.column(c)[0].as_py() for c in spot[1:])
        own = t.column("own").to_numpy()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(left) or not len(right):
            return
        word = t.column("word").combine_chunks()
        a = Tile(word.take(pa.array(left)))
        b = a if lo == hi else Tile(word.take(pa.array(right)))
        i, j = near_pairs(a, b, lo == hi, short, by_head)
        x, y = pa.array(np.concatenate((left[i], right[j]))), pa.array(np.concatenate((right[j], left[i])))
        n = t.column("n").combine_chunks()
        yield pa.RecordBatch.from_arrays([word.take(x), n.take(x), word.take(y), n.take(y)], names=names)

    def work(batches: Iterator[pa.RecordBatch]):
        here, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(spot))])
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cut[:-1], cut[1:], strict=True):
                now = tuple(keys[:, start].tolist())
                if parts and now != here:
                    yield from pairs(parts)
                    parts = []
                here = now
                parts.append(batch.slice(start, end - start))
        if parts:
            yield from pairs(parts)

    return met.repartition(*spot).sortWithinPartitions(*spot).mapInArrow(work, "word string, n long, other string, other_n long")


# ---- forms ----------------------------------------------------------------------------------------------------------


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`word, n, n_near, form, form_n, root` of every word of `docs` that is long and frequent enough."""
    tables = Tables(docs.sparkSession)
    words = tables.keep(counted(docs, key, text), "variant-words")
    # The largest n wins, then the smallest word.
    rank = F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(rank).alias("top"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("top.m") >= RATIO * F.col("n"), F.struct(F.col("top.w").alias("w"), (-F.col("top.m")).alias("m"))).alias("f"))
    found = tables.keep(found.select("word", "n", "n_near", F.col("f.w").alias("form"), F.col("f.m").alias("form_n")), "variant-forms")
    # Doubling: after r rounds `root` is 2**r steps away, or the end. Every step multiplies n by RATIO, so rounds are few.
    ahead = tables.keep(found.filter("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = tables.keep(ahead.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        tables.drop(ahead)
        ahead = after
        if ahead.filter("moved").isEmpty():
            break
    done = found.join(ahead.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
    done = tables.keep(done, "variants")
    tables.drop(words, found, ahead)
    return done
