"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Two states (clean, toxic) over the words of a sentence. Words of labelled texts get token labels: in a toxic text a word
whose document frequency is far higher in toxic than in other texts is toxic, all others are clean. The field has a
weight per hashed word form, per neighbouring word form and per transition, fitted by gradient steps on the exact
forward-backward gradient. A text's score is a logistic function of its largest marginal, of the expected number of
toxic words and of their share; words whose marginal reaches `SPAN` are the offending offsets.

Training uses at most `SAMPLE` labelled rows (those with the smallest hash of doc_id) outside fold 0: one bounded task.
Scoring reads whole texts; a sentence longer than `CHAIN` words continues in a new chain, so no word is skipped.

Defined cases: null or empty texts get the score of a text without toxic evidence; labels that are null, contradict each
other for one id, or belong to no text teach nothing; no usable label of both classes gives score 0 everywhere; repeated
rows and ids each give a row; a null id is held out of nothing and not learned from; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.llm import kit

SAMPLE = 4000  # labelled rows that train the model
SLOT_BITS = 20  # of hashed word forms
SLOTS = 1 << SLOT_BITS
CHAIN = 64
FOLDS = 5
SPAN = 0.5
STEPS = 25
MIN_TEXTS = 3  # texts that must hold a toxic word
MIN_RATIO = 4.0  # its frequency in toxic texts against others
MIN_SURPRISE = 20.0  # log-likelihood ratio of that difference: chance alone reaches it for one word form in 10**5

_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True
_CODES = np.where(_LETTER, kit.BYTE_CODES[kit.LOWER], np.uint64(0))
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _xlog(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))


class Chains:
    """The words of a block of texts as chains, longest chain first, with their hashed features."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.rows = len(at) - 1
        self.start, self.end, self.row = kit.words(raw, at)
        n = len(self.start)
        # Punctuation has no code, so "word," and "word" are one form; quotes before a word are skipped.
        head = self.start + ~_LETTER[raw[self.start]] if n else self.start
        form = kit.Hashes(_CODES[raw]).of(np.minimum(head, self.end), self.end)
        self.form = (kit.mix(form) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        ends = np.zeros(n, bool)
        if n:
            ends[:-1] = self.row[1:] != self.row[:-1]
            ends |= _STOP[raw[self.end - 1]]
            ends[-1] = True
        begin = np.concatenate(([True], ends[:-1])) if n else ends
        run = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
        begin |= run % CHAIN == 0
        self.first = np.flatnonzero(begin)
        self.size = np.diff(np.append(self.first, n))
        order = np.argsort(-self.size, kind="stable")
        self.first, self.size = self.first[order], self.size[order]
        before = np.where(begin, 0, np.roll(self.form, 1))
        after = np.where(np.roll(begin, -1), 0, np.roll(self.form, -1)) if n else self.form
        self.features = (self.form, before, after)

    def steps(self):
        """For each time step: the word indices of the chains that are that long."""
        for t in range(int(self.size[0]) if len(self.size) else 0):
            yield self.first[: np.searchsorted(-self.size, -t, "left")] + t


class Field:
    """Weights of the toxic state relative to the clean one, and the 2 x 2 transition weights."""

    def __init__(self):
        self.emit = np.zeros((3, SLOTS))
        self.bias = -3.0
        self.move = np.zeros((2, 2))
        self.score = np.zeros(4)  # logistic: constant, largest marginal, log of expected words, share
        self.known = False

    def __getstate__(self):
        """Only the weights that training has moved."""
        used = np.nonzero(np.abs(self.emit) > 1e-6)
        return {**self.__dict__, "emit": (used, self.emit[used])}

    def __setstate__(self, state):
        self.__dict__.update(state)
        used, values = state["emit"]
        self.emit = np.zeros((3, SLOTS))
        self.emit[used] = values

    def potentials(self, c: Chains) -> np.ndarray:
        return self.bias + sum(w[f] for w, f in zip(self.emit, c.features, strict=True))

    def marginals(self, c: Chains, gradient: bool = False):
        """P(toxic) of every word by forward-backward; with `gradient` also the expected transitions."""
        n = len(c.form)
        up = self.potentials(c)
        out, pairs = np.zeros(n), np.zeros((2, 2))
        m = np.exp(self.move)
        e = np.exp(np.clip(up, -30, 30))  # clean: 1
        alpha = np.zeros((n, 2))
        steps = list(c.steps())
        for t, i in enumerate(steps):
            a = np.ones((len(i), 2)) if t == 0 else alpha[i - 1] @ m
            a[:, 1] *= e[i]
            alpha[i] = a / a.sum(axis=1, keepdims=True)
        beta = np.ones((n, 2))
        for t in range(len(steps) - 1, -1, -1):
            i = steps[t]
            if t + 1 < len(steps):
                j = steps[t + 1]
                b = beta[j].copy()
                b[:, 1] *= e[j]
                back = b @ m.T
                beta[j - 1] = back / back.sum(axis=1, keepdims=True)
                if gradient:
                    joint = alpha[j - 1][:, :, None] * m[None] * b[:, None, :]
                    pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            p = alpha[i] * beta[i]
            out[i] = p[:, 1] / p.sum(axis=1)
        return (out, pairs) if gradient else out

    def evidence(self, c: Chains, p: np.ndarray) -> np.ndarray:
        top = np.zeros(c.rows)
        np.maximum.at(top, c.row, p)
        expected = np.bincount(c.row, p, c.rows)
        return np.stack([np.ones(c.rows), top, np.log1p(expected), expected / np.maximum(np.bincount(c.row, minlength=c.rows), 1)], axis=1)

    def scores(self, c: Chains, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.evidence(c, p) @ self.score))) if self.known else np.zeros(c.rows)


def fit(raw: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> Field:
    """Train on one bounded block of texts with document labels."""
    field = Field()
    n_bad, n_good = int(toxic.sum()), int((1 - toxic).sum())
    if not n_bad or not n_good:
        return field
    c = Chains(raw, at)
    seen = np.unique(c.row * np.int64(SLOTS) + c.form)
    bad = toxic[seen // SLOTS] == 1
    in_bad, in_good = np.bincount(seen[bad] % SLOTS, minlength=SLOTS), np.bincount(seen[~bad] % SLOTS, minlength=SLOTS)
    ratio = ((in_bad + 0.5) / (n_bad + 1)) / ((in_good + 0.5) / (n_good + 1))
    total = in_bad + in_good
    surprise = 2 * (_xlog(in_bad, total * n_bad / (n_bad + n_good)) + _xlog(in_good, total * n_good / (n_bad + n_good)))
    label = ((toxic[c.row] == 1) & ((in_bad >= MIN_TEXTS) & (ratio >= MIN_RATIO) & (surprise >= MIN_SURPRISE))[c.form]).astype(float)
    state = label.astype(int)
    seen_pairs = np.zeros((2, 2))
    for i in list(c.steps())[1:]:
        np.add.at(seen_pairs, (state[i - 1], state[i]), 1)
    squares, square_bias, square_move = np.ones_like(field.emit) * np.array([[1.0], [16.0], [16.0]]), 1.0, np.ones((2, 2))
    n = len(label)
    for _ in range(STEPS):  # AdaGrad on the log-likelihood with a little shrinkage
        p, pairs = field.marginals(c, gradient=True)
        off = label - p
        for k, f in enumerate(c.features):
            g = np.bincount(f, off, SLOTS) - 0.01 * field.emit[k]
            squares[k] += g * g
            field.emit[k] += 0.8 * g / np.sqrt(squares[k])
        g = off.sum() / max(1, np.sqrt(n))
        square_bias += g * g
        field.bias += 0.8 * g / np.sqrt(square_bias)
        g = (seen_pairs - pairs) / max(1, np.sqrt(n)) - 0.01 * field.move
        square_move += g * g
        field.move += 0.3 * g / np.sqrt(square_move)
    x = field.evidence(c, field.marginals(c))
    w = np.zeros(4)
    for _ in range(25):  # Newton steps of the logistic fit
        q = 1 / (1 + np.exp(-(x @ w)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(4)
        w += np.linalg.solve(h, x.T @ (toxic - q) - 0.05 * w)
    field.score, field.known = w, True
    return field


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """One field from at most `sample` labelled texts outside fold 0."""
    key = F.col("doc_id")
    said = labels.select("doc_id", "toxic").filter(key.isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(key)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    chosen = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = rows.dropDuplicates(["doc_id"])  # at most `sample` rows, whatever repeats

    def work(batches):
        parts = sorted(((i, t, y) for b in batches for i, t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), key=lambda r: r[0])
        if parts:
            raw, at = kit.utf8(pa.array([t for _, t, _ in parts], pa.large_string()))
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(raw, at, np.array([y for _, _, y in parts])))]})

    models = rows.coalesce(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else Field()


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Per text: `held_out, score, predicted` and `spans`, the byte offsets start:end of offending words."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def work(batches):
        field = shared.value
        for part, raw, at in kit.blocks(batches, "text"):
            c = Chains(raw, at)
            p = field.marginals(c)
            s = field.scores(c, p)
            spans = [""] * c.rows
            if field.known:
                hit = np.flatnonzero(p >= SPAN)
                for r, a, e in zip(c.row[hit], c.start[hit] - at[c.row[hit]], c.end[hit] - at[c.row[hit]], strict=True):
                    spans[r] += f"{',' if spans[r] else ''}{a}:{e}"
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans)], names=[key, "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col(key), F.col("text"), held_out(F.col(key)).alias("held_out"))
    return rows.mapInArrow(work, f"`{key}` {dict(rows.dtypes)[key]}, held_out boolean, score double, predicted int, spans string")
