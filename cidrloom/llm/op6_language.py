"""Language identification by rank-order profiles.

A profile is the list of the most frequent byte n-grams (1 to 4 bytes, inside words padded with one blank) in rank
order. A text is compared with every language's profile by the out-of-place distance: the sum over the text's own most
frequent n-grams of the difference in rank, `PROFILE` where the language lacks the n-gram. The nearest language wins,
the alphabetically first one in a tie. The score is 1 - distance / largest possible distance.

Defined cases: null text, or text without a letter, gives `und` with score 0, as does a corpus without any labelled
text; equal counts rank by n-gram code, so results never depend on row order; repeated rows and ids each give a row; a
null id is held out of nothing and not learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cidrloom.llm import kit

PROFILE = 300
LONGEST = 4
FOLDS = 5
SALTS = 32

_FOLDED = kit.LOWER.copy()  # ASCII letters lower-cased, other ASCII a blank, all further bytes as they are
_FOLDED[[b for b in range(128) if not (97 <= kit.LOWER[b] <= 122)]] = 0x20


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and rows of all n-grams; a blank stands only at either end of one, and a text ends words."""
    rows = len(at) - 1
    # One blank before and after every text keeps n-grams from crossing rows.
    text = np.full(len(raw) + 2 * rows, 0x20, np.uint8)
    row = kit.rows_of(at)
    text[np.arange(len(raw)) + 2 * row + 1] = _FOLDED[raw]
    owner = np.repeat(np.arange(rows), np.diff(at) + 2)
    ink = text != 0x20
    codes, owners = [], []
    code = text.astype(np.int64)
    inner = np.ones(len(text), bool)  # every byte but the first and the last is not a blank
    for size in range(1, LONGEST + 1):
        if size > 1:
            code = code[:-1] | (text[size - 1 :].astype(np.int64) << (8 * (size - 1)))
            inner = inner[:-1] & (ink[size - 2 : -1] if size > 2 else True)
        good = inner & (ink[: len(code)] | ink[size - 1 : size - 1 + len(code)])
        codes.append(code[good])
        owners.append(owner[: len(code)][good])
    return np.concatenate(codes), np.concatenate(owners)


def _counts(codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) in order, with their counts."""
    key = (owners.astype(np.int64) << 32) | codes
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key)))


def _top(owner: np.ndarray, count: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and rank of the `limit` most frequent entries of each owner; equal counts keep their code order."""
    n = len(owner)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = int(count.max())
    bits_n, bits_c = n.bit_length(), most.bit_length()
    if bits_n + bits_c + int(owner[-1]).bit_length() <= 63:
        key = (owner << (bits_n + bits_c)) | ((most - count) << bits_n) | np.arange(n)
        key.sort()
        order = key & ((1 << bits_n) - 1)
    else:
        order = np.lexsort((-count, owner))
    sizes = np.bincount(owner)
    begin = np.concatenate(([0], np.cumsum(sizes)))[owner[order]]
    rank = np.arange(n) - begin
    return order[rank < limit], rank[rank < limit]


def profiles(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the sorted n-grams of all profiles, and each n-gram's rank per language (`PROFILE`: absent).

    `labelled`: `text, lang`, whole and all of it. Tasks send one count per language and n-gram.
    """

    def count(batches):
        names: dict[str, int] = {}
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for part, raw, at in kit.blocks(batches, "text"):
            lang = np.array([names.setdefault(x, len(names)) for x in part.column(1).to_pylist()], np.int64)
            codes, owners = _grams(raw, at)
            found = _counts(codes, lang[owners])
            owner, code, n = (np.concatenate(x) for x in zip(kept, found, strict=True))
            key, inverse = np.unique((owner << 32) | code, return_inverse=True)
            kept = [key >> 32, key & 0xFFFFFFFF, np.bincount(inverse, n).astype(np.int64)]
        if names:
            order = pa.array(list(names))
            yield pa.RecordBatch.from_arrays([order.take(pa.array(kept[0])), pa.array(kept[1]), pa.array(kept[2])], names=["lang", "code", "n"])

    totals = labelled.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Ranked within salts first, so that no task sees more than SALTS * PROFILE n-grams of a language.
    within = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "code"))
    totals = totals.withColumn("salt", F.pmod(F.hash("code"), F.lit(SALTS))).withColumn("within", within).filter(F.col("within") <= PROFILE)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    best = totals.withColumn("rank", rank).filter(F.col("rank") < PROFILE).collect()  # PROFILE rows a language
    names = sorted({r["lang"] for r in best})
    grams = np.array(sorted({r["code"] for r in best}), np.int64)
    table = np.full((len(grams), len(names)), PROFILE, np.int32)
    for r in best:
        table[np.searchsorted(grams, r["code"]), names.index(r["lang"])] = r["rank"]
    return names, grams, table


def _has_letter(part: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_letters = kit.per_row((raw < 128) & (_FOLDED[raw] != 0x20), at) > 0
    for i in np.flatnonzero(~ascii_letters & (kit.per_row(raw >= 128, at) > 0)):
        ascii_letters[i] = any(c.isalpha() for c in bytes(raw[at[i] : at[i + 1]]).decode("utf-8", "replace"))
    return ascii_letters


def predict(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key, held_out, lang_pred, score` per row; learns from rows of other folds that have text and `lang`."""
    learned = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    names, grams, table = profiles(learned)
    shared = docs.sparkSession.sparkContext.broadcast((names, grams, table))

    def work(batches):
        names, grams, table = shared.value
        labels = pa.array([*names, "und"])
        for part, raw, at in kit.blocks(batches, "text"):
            n_rows = part.num_rows
            best, score = np.full(n_rows, len(names)), np.zeros(n_rows)
            letters = _has_letter(part, raw, at)
            if names:
                owner, code, count = _counts(*_grams(raw, at))
                index, rank = _top(owner, count, PROFILE)
                owner, code = owner[index], code[index]
                place = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
                known = grams[place] == code
                away = np.stack([np.bincount(owner, np.where(known & (table[place, k] < PROFILE), np.abs(table[place, k] - rank), PROFILE), n_rows) for k in range(len(names))], axis=1)
                size = np.maximum(np.bincount(owner, minlength=n_rows) * PROFILE, 1)
                best = np.where(letters, away.argmin(axis=1), len(names))
                score = np.where(letters, 1 - away.min(axis=1) / size, 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), labels.take(pa.array(best)), pa.array(score.astype(float))], names=[key, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key), F.col("text"), held_out(F.col(key)).alias("held_out"))
    return rows.mapInArrow(work, f"`{key}` {dict(rows.dtypes)[key]}, held_out boolean, lang_pred string, score double")
