"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Word counts over the whole corpus choose up to `LEXICON` frequent words by a cut in the count. Their token ids are the outputs of a minimal
acyclic automaton: equal suffixes share states, outputs are numbers of id lists that sum along a path. Its tables are one
file in the shared folder, handed to every node once and memory-mapped there. Words of a text that the automaton accepts
get their ids from it; all others are merged exactly by rank, all words of a block at a time.

Ids equal those of the tokenizers library with the same vocabulary file and add_special_tokens=False, where the text of
an added token is that token. Decoding joins the tokens' bytes and reads them as UTF-8 with replacement.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows and ids, null ids and ties
among word counts (all in or all out) change no result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import re
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cidrloom.llm import kit

LEXICON = 50_000  # words compiled into the automaton
MIN_COUNT = 4  # occurrences of such a word
LEXICON_BYTES = 64  # longest such word
CACHED = 400_000  # words whose ids a task keeps between blocks
BLOCK_BYTES = 6_000_000

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same splits for texts of ASCII and Latin letters alone, in the faster expression engine.
_PLAIN = re.compile(r"[\t-\r\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF]*")
_LETTERS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF"
_PLAIN_SPLIT = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


class Vocabulary:
    """Merges and tokens of a byte-level BPE file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in printable}
        for b in range(256):
            char.setdefault(b, chr(256 + len(char) - len(printable)))
        byte = {c: b for b, c in char.items()}
        ids = model["vocab"]
        self.first = np.array([ids[char[b]] for b in range(256)], np.int64)
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        size = max([*ids.values(), *special.values()]) + 1
        tokens = [b""] * size
        for text, i in ids.items():
            tokens[i] = bytes(byte[c] for c in text)
        for text, i in special.items():
            tokens[i] = text.encode()
        self.special = special
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.size = size
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair, self.rank = key[order], order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank
        self.splitter = regex.compile(PATTERN)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merges of many words at once: in each round every word joins its pair of lowest rank everywhere."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        token, owner = self.first[data], np.repeat(np.arange(len(words)), sizes)
        done_token, done_owner = [], []
        none = len(self.pair)
        while len(token):
            key = token[:-1] * self.size + token[1:]
            place = np.minimum(np.searchsorted(self.pair, key), none - 1)
            rank = np.where((self.pair[place] == key) & (owner[:-1] == owner[1:]), self.rank[place], none)
            head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(np.append(rank, none), head)
            best_of = np.repeat(best, np.diff(np.append(head, len(token))))
            finished = best_of == none
            if finished.any():
                done_token.append(token[finished])
                done_owner.append(owner[finished])
            hit = np.append(rank, none) == best_of
            hit &= ~finished
            # Of overlapping hits (a a a) the leftmost of each pair counts: every other one in a run.
            at = np.flatnonzero(hit)
            if not len(at):
                break
            run_start = np.concatenate(([True], at[1:] != at[:-1] + 1))
            inside = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[inside % 2 == 0]
            token = token.copy()
            token[at] = self.merged[best_of[at]]
            keep = ~finished
            keep[at + 1] = False
            token, owner = token[keep], owner[keep]
        token, owner = np.concatenate(done_token), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.split(token[order], np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        at = np.repeat(self.starts[ids] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return self.data[at].tobytes()


class Lexicon:
    """A minimal acyclic transducer: bytes of a word in, number of its id list out."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.__dict__.update(tables)

    @staticmethod
    def build(words: list[bytes], ids: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Tables from sorted distinct words (incremental construction). A word's number is its place among `words`."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path = [0]
        before = b""

        def freeze(down_to: int):
            while len(path) - 1 > down_to:
                state = path.pop()
                shape = (final[state], tuple(arcs[state].items()))
                twin = known.setdefault(shape, state)
                if twin != state:
                    arcs[path[-1]][before[len(path) - 1]] = twin

        for word in words:
            same = 0
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
            freeze(same)
            for b in word[same:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][b] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            before = word
        freeze(0)
        # Number the states that are left; count the words below each for the outputs on the arcs.
        order, stack, number = [], [0], {}
        while stack:
            s = stack.pop()
            if s not in number:
                number[s] = len(number)
                order.append(s)
                stack.extend(arcs[s].values())
        below: dict[int, int] = {}

        def count(root: int):
            todo = [root]
            while todo:
                s = todo[-1]
                missing = [t for t in arcs[s].values() if t not in below]
                if missing:
                    todo.extend(missing)
                else:
                    below[s] = final[s] + sum(below[t] for t in arcs[s].values())
                    todo.pop()

        count(0)
        first, label, target, output = [0], [], [], []
        for s in order:
            passed = int(final[s])
            for b, t in sorted(arcs[s].items()):
                label.append(b)
                target.append(number[t])
                output.append(passed)
                passed += below[t]
            first.append(len(label))
        sizes = np.array([len(x) for x in ids], np.int64)
        arc_key = np.repeat(np.arange(len(order)), np.diff(first)) * 256 + np.array(label, np.int64) if label else np.zeros(0, np.int64)
        return {"arc": arc_key.astype(np.int64), "target": np.array(target, np.int64), "output": np.array(output, np.int64), "final": np.array([final[s] for s in order], bool),
                "id_start": np.concatenate(([0], np.cumsum(sizes))), "ids": np.concatenate(ids) if ids else np.zeros(0, np.int64)}

    def look_up(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words the automaton does not accept; all words walk together."""
        state, number = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        alive = np.flatnonzero(size <= LEXICON_BYTES) if len(self.arc) else np.zeros(0, np.int64)
        out = np.full(len(start), -1, np.int64)
        step = 0
        while len(alive):
            over = size[alive] == step
            ended = alive[over]
            accepted = self.final[state[ended]]
            out[ended[accepted]] = number[ended[accepted]]
            alive = alive[~over]
            key = state[alive] * 256 + data[start[alive] + step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            good = self.arc[at] == key
            alive, at = alive[good], at[good]
            state[alive] = self.target[at]
            number[alive] += self.output[at]
            step += 1
        return out


def _split(vocabulary: Vocabulary, text: str) -> list[str]:
    return (_PLAIN_SPLIT if _PLAIN.fullmatch(text) else vocabulary.splitter).findall(text)


def _pieces(vocabulary: Vocabulary, text: str) -> list[str]:
    """The words of a text; the text of an added token is a piece of its own."""
    split = vocabulary.special_split
    if split is None or not any(s in text for s in vocabulary.special):
        return _split(vocabulary, text)
    out = []
    for part in split.split(text):
        out += [part] if part in vocabulary.special else _split(vocabulary, part)
    return out


class Encoder:
    """Encodes blocks of texts with a vocabulary and a lexicon; keeps the ids of up to `CACHED` words between blocks."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHED:
            self._forget()
        number, known = self.number, len(self.number)
        numbers, sizes = [], [0]
        for text in texts:
            found = _pieces(self.vocabulary, text)
            sizes.append(len(found))
            numbers += [number.setdefault(w, len(number)) for w in found]
        if len(number) > known:
            ids, counts = self._words(list(itertools.islice(number, known, None)))
            self.ids, self.counts = np.concatenate((self.ids, ids.astype(np.int32))), np.concatenate((self.counts, counts))
        where = np.array(numbers, np.int64)
        size = self.counts[where]
        starts = np.cumsum(self.counts) - self.counts
        flat = self.ids[np.repeat(starts[where] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(sizes)]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and their counts."""
        v = self.vocabulary
        raw = [w.encode() for w in words]
        parts: list[np.ndarray | None] = [None] * len(raw)
        if self.lexicon is not None:
            size = np.array([len(w) for w in raw], np.int64)
            found = self.lexicon.look_up(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
            known, start = self.lexicon.ids, self.lexicon.id_start
            for i in np.flatnonzero(found >= 0).tolist():
                parts[i] = known[start[found[i]] : start[found[i] + 1]]
        for word, token in v.special.items():
            if self.number.get(word, -1) >= len(self.number) - len(words):
                parts[self.number[word] - len(self.number) + len(words)] = np.array([token], np.int64)
        rest = [i for i, p in enumerate(parts) if p is None]
        for i, ids in zip(rest, v.merge([raw[i] for i in rest]), strict=True):
            parts[i] = ids
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def frequent_words(docs: DataFrame, text: str = "text", limit: int = LEXICON) -> list[bytes]:
    """Up to `limit` of the most frequent words of all texts, sorted by their bytes. Counted inside Spark; where its
    regular expressions see another white space than the encoder, a word is merely missing from the lexicon.

    The cut is a count: words are summed up by the step of their count (16 steps to each doubling, so at most some
    thousand rows), and the steps that fit into `limit` together are fetched, never more than `limit` words.
    """
    said = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).alias("word")).filter(F.octet_length("word") <= LEXICON_BYTES)
    total = said.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)
    tables = kit.Tables(docs.sparkSession)
    counted = tables.keep(total.select("word", F.floor(F.log2("n") * 16).cast("int").alias("step")), "words")
    room, cut = limit, None
    for r in counted.groupBy("step").count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        cut = r["step"]
    words = [] if cut is None else sorted(r["word"].encode() for r in counted.filter(F.col("step") >= cut).select("word").collect())
    tables.drop(counted)
    return words


def publish(spark: SparkSession, tables: dict[str, np.ndarray]) -> str:
    """Write the automaton to the shared folder and have Spark hand it to every node; gives the file's name."""
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    memory = io.BytesIO()
    head = {}
    body = b""
    for k, a in tables.items():
        body += b"\0" * (-len(body) % 8)
        head[k] = (a.dtype.str, len(a), len(body))
        body += np.ascontiguousarray(a).tobytes()
    described = json.dumps(head).encode()
    memory.write(len(described).to_bytes(8, "little") + described + b" " * (-len(described) % 8) + body)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{kit.shared_folder(spark)}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(memory.getvalue()))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def mapped(name: str) -> Lexicon:
    """Memory-map a published automaton on this node."""
    file = np.memmap(SparkFiles.get(name), np.uint8, "r")
    size = int.from_bytes(bytes(file[:8]), "little")
    head = json.loads(bytes(file[8 : 8 + size]))
    body = 8 + size + -size % 8
    return Lexicon({k: file[body + at : body + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()})


def compile_lexicon(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LEXICON) -> str:
    v = Vocabulary(vocabulary)
    words = [w for w in frequent_words(docs, text, limit) if w.decode() not in v.special]
    return publish(docs.sparkSession, Lexicon.build(words, v.merge(words)))


def tokenise(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """`key, ids` (array) and `decoded`, or with `digests` `key, n_tokens, ids_sha256, decoded_sha256`."""
    name = compile_lexicon(docs, vocabulary, text)
    rows = kit.text_rows(docs, key, text)
    kind = dict(rows.dtypes)[key]

    def work(batches):
        v = Vocabulary(vocabulary)
        encoder = Encoder(v, mapped(name))
        for part, _, _ in kit.blocks(batches, text, BLOCK_BYTES):
            ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            back = [v.decode(x).decode("utf-8", "replace") if len(x) else "" for x in ids]
            if digests:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                                                  pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())], names=[key, "ids", "decoded"])

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(work, f"`{key}` {kind}, {made}")
