"""Quality rules from suffix-array repetition.

Per text, the words are suffix-sorted; neighbouring suffixes with a longest common prefix of at least `min_words`
words are the intervals of maximal repeated substrings. Their spans are united: a text is rejected when the union
covers more than `max_covered` of its words or when one repeat is longer than `max_repeat` words.

Defined cases: a null or empty text has no words and fails the base rule; one text never sees another, so row order,
ties, repeated rows, repeated or null `doc_id` change nothing; every input row gives one output row; an empty table
gives no rows; further columns are ignored by `quality` and kept by `keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cidrloom.llm import kit

MIN_WORDS = 8  # shortest repeat that counts
MAX_COVERED = 0.18  # share of words inside repeats
MAX_REPEAT = 60  # words in one repeat

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffix array of a code sequence by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(codes)
    order = np.argsort(codes)
    sorted_codes = codes[order]
    head = np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1])) if n else np.zeros(0, bool)
    rank = np.full(n + 1, -1, np.int64)
    step = 1
    rows = np.arange(n)
    group = np.maximum.accumulate(np.where(head, rows, 0))
    rank[order] = group
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at) or step >= n:
            return order
        i = order[at]
        key = rank[i] * (n + 2) + rank[np.minimum(i + step, n)] + 1
        by = np.argsort(key)
        key, i = key[by], i[by]
        order[at] = i
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        head[at] = fresh
        rank[i] = np.maximum.accumulate(np.where(fresh, at, 0))
        step *= 2


def repeats(hashes: np.ndarray, row: np.ndarray, n_rows: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: words covered by repeated substrings of `min_words` words or more, and the longest such repeat."""
    longest = np.zeros(n_rows, np.int64)
    n = len(hashes)
    if n < 2:
        return np.zeros(n_rows, np.int64), longest
    codes = kit.mix(hashes + kit.mix(row.astype(np.uint64) + np.uint64(1)))  # rows share no code, so no repeat crosses rows
    order = suffix_order(codes)
    stretch = kit.PrimeHashes(codes)
    row_end = np.searchsorted(row, row, "right")
    a, b = order[:-1], order[1:]
    room = row_end[np.maximum(a, b)] - np.maximum(a, b)
    near = np.flatnonzero((codes[a] == codes[b]) & (room >= min_words))
    near = near[stretch.of(a[near], a[near] + min_words) == stretch.of(b[near], b[near] + min_words)]
    a, b, room = a[near], b[near], room[near]
    lcp = np.full(len(near), min_words, np.int64)
    jump = 1 << max(0, int(room.max(initial=1)).bit_length() - 1)
    while jump:
        longer = lcp + jump
        fits = np.flatnonzero(longer <= room)
        same = stretch.of(a[fits], a[fits] + longer[fits]) == stretch.of(b[fits], b[fits] + longer[fits])
        lcp[fits[same]] = longer[fits[same]]
        jump >>= 1
    edge = np.zeros(n + 1, np.int64)
    for side in (a, b):
        np.add.at(edge, side, 1)
        np.add.at(edge, side + lcp, -1)
    np.maximum.at(longest, row[a], lcp)
    covered = np.cumsum(edge[:n]) > 0
    return np.bincount(row[covered], minlength=n_rows), longest


def measure(raw: np.ndarray, at: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """All counts of a block of texts, one value per row."""
    n_rows = len(at) - 1
    start, end, row = kit.words(raw, at)
    hashes = kit.word_hashes(raw, start, end)
    n_words = np.bincount(row, minlength=n_rows)
    out = {
        "n_words": n_words,
        "word_chars": kit.per_row(~kit.SPACE[raw] & ((raw & 0xC0) != 0x80), at),
        "n_symbols": kit.per_row(_SYMBOL[raw], at),
        "n_dup_lines": _repeated_lines(raw, at),
    }
    win, first = kit.windows(hashes, row, 5)
    order = np.argsort(keyed := kit.mix(win + kit.mix(row[first].astype(np.uint64) + np.uint64(7))))
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(win), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + 5, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n_rows)
    out["covered_words"], out["longest_repeat"] = repeats(hashes, row, n_rows, min_words)
    return out


def _repeated_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    n_rows = len(at) - 1
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.concatenate((at[:-1], breaks + 1))
    ends = np.concatenate((at[1:], breaks))
    # A line ends at its break or at the end of its row: pair sorted starts with sorted ends.
    row = np.concatenate((np.arange(n_rows), np.searchsorted(at, breaks, "right") - 1))
    by_start = np.lexsort((starts, row))
    by_end = np.lexsort((ends, row))
    starts, row = starts[by_start], row[by_start]
    ends = ends[by_end]
    ink = np.concatenate(([0], np.cumsum(~kit.SPACE[raw])))
    full = ink[ends] > ink[starts]
    starts, ends, row = starts[full], ends[full], row[full]
    code = kit.stretch_hashes(raw, starts, ends) + kit.mix(row.astype(np.uint64) + np.uint64(3))
    _, first = np.unique(code, return_index=True)
    return np.bincount(row, minlength=n_rows) - np.bincount(row[first], minlength=n_rows)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per text: its counts, `base_failed`, `kept`, the covered share and the longest repeat."""
    rows = kit.text_rows(docs, key, text)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def work(batches):
        for part, raw, at in kit.blocks(batches, text):
            found = measure(raw, at, min_words)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(found[c], pa.int64()) for c in counts]], names=[key, *counts])

    out = rows.mapInArrow(work, f"`{key}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = F.col("covered_words") / F.greatest("n_words", F.lit(1))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (share <= max_covered) & (F.col("longest_repeat") <= max_repeat)).withColumn("covered_share", share)


def keep_good(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of `docs` that pass both rules, with all their columns; no shuffle."""

    def work(batches):
        for part, raw, at in kit.blocks(batches, text):
            m = measure(raw, at, min_words)
            good = (m["n_words"] >= 10) & (100 * m["n_repeat_words"] <= 20 * m["n_words"]) & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
            yield part.filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)
