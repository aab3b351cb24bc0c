"""Prefix trie of conversations by the recursion of van Emde Boas layouts.

A sequence of turns is cut at half depth. The cut prefix gets a name, made of the name where the sequence starts and the
digest of the upper half; equal prefixes get equal names. Then the upper half, under the old name, and the lower half,
under the new one, are cut in the same way, all halves of all sequences at once. Cut points are multiples of powers of
two, so the digest of every half comes from a tree of digests, and a prefix of any depth is named from log2(depth) pieces.
The nodes of the trie are the distinct names; upper trie and lower forests fall out of one aggregate over them.

Sequences are rows of at most `CHUNK` turns. Inside a chunk the recursion runs on the row; above it, for conversations of
more than a chunk, every halving is a join on (conversation, place), both of which are unique.

Totals are grafted upward along paths. A node belongs to the path of its smallest member; a path owns its nodes from some
depth to its end. Sums along the owned part come from sums per chunk; the total of a path is then grafted onto every
ancestor above that part at once, which is one aggregate by name. No node's children, members or subtree are collected.

Turns are ordered by (turn, digest of role and text), null turns first, by a range partitioning, so that a conversation
may span tasks. Texts never travel: after the first scan a turn is 16 bytes and a length.

The list of conversations that end at a node is hashed as a stream: range-sorted ids are packed into pieces of at most
`PIECE` ids, pieces of a node are fed to SHA-256 in order. One digest over one list has to be fed by one task; it reads
one row per piece and holds one piece.

Defined cases: rows without conv_id are no conversation's; a null role or text is empty; repeated rows are turns of their
own; turns that tie on `turn` are ordered by the digest; an empty table has no nodes; other columns are ignored. The
remainder has the sign of the id, as in SQL, so that -3 hangs on 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cidrloom.llm.kit import Tables
from cidrloom.operators.skew import join_counted

SHARED, GROUP = 9, 5  # turns taken from the conversation at the group's head: crc32(id) % SHARED; ids are grouped by GROUP
CHUNK = 256
PIECE = 8192
ROOT = b""


def named(start: bytes, half: bytes) -> bytes:
    """The name of a prefix: where its sequence starts, and the digest of what was cut off."""
    return hashlib.sha256(b"n" + start + half).digest()[:16]


def joined(left: bytes, right: bytes) -> bytes:
    """The digest of two neighbouring halves."""
    return hashlib.sha256(b"j" + left + right).digest()[:16]


def hashed(mark: bytes, *parts: str) -> Column:
    """`named` (mark `n`) or `joined` (mark `j`) of two columns."""
    return F.unhex(F.substring(F.sha2(F.concat(F.lit(bytearray(mark)), *parts), 256), 1, 32))


# ---- order ----------------------------------------------------------------------------------------------------------


def turns(conversations: DataFrame, tables: Tables) -> DataFrame:
    """`conv_id, pos, code, bytes` of all turns; `pos` counts from 0 in each conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    code = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint"), "turn", code.alias("code"), F.octet_length(text).alias("bytes"))
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "code").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "code")

    def work(batches: Iterator[pa.RecordBatch]):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if last == conv[0]:
                at[: first[1] if len(first) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int32)), batch.column(0), pa.array(at.astype(np.int64)), batch.column(2), batch.column(3).cast(pa.int64())], names=["part", "conv_id", "at", "code", "bytes"])

    placed = tables.keep(dealt.mapInArrow(work, "part int, conv_id bigint, at bigint, code binary, bytes bigint"), "trie-placed")
    # A conversation that ends a partition may go on in later ones: one row per partition comes to the driver.
    ends = placed.groupBy("part").agg(F.max(F.struct("conv_id", "at")).alias("last")).orderBy("part").collect()
    shifts, open_, before = [], None, 0
    for part, (conv, at) in ends:
        if open_ is not None:
            shifts.append((open_, part, before))
        before = (before if conv == open_ else 0) + at + 1
        open_ = conv
    shift = tables.spark.createDataFrame(shifts, "conv_id bigint, part int, shift bigint")
    return placed.join(F.broadcast(shift), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("pos"), "code", "bytes")


def taken(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("int")


def sequences(rows: DataFrame, tables: Tables, chunk: int = CHUNK) -> tuple[DataFrame, bool]:
    """`conv_id, chunk, turns, last` of the rebuilt conversations, turnless ones included, and whether any has several chunks.

    Lent turns and own turns meet in one grouping. As a conversation takes less than a chunk, only its first chunk changes,
    and that keeps its length unless the head of the group had too few turns to lend.
    """
    base = F.col("conv_id") % GROUP == 0
    own = rows.select("conv_id", F.floor(F.col("pos") / chunk).alias("chunk"), F.when(base | (F.col("pos") >= taken(F.col("conv_id"))), 1).otherwise(2).alias("side"), "pos", "code", "bytes")
    # The head of a group lends its first turns to the other ids of the group: at most 8 of them, or 4 on either side of 0.
    steps = F.filter(F.sequence(F.lit(1 - GROUP), F.lit(GROUP - 1)), lambda r: (r != 0) & ((F.col("conv_id") == 0) | (F.signum(F.col("conv_id")) == F.signum(r))))
    lent = rows.filter(base & (F.col("pos") < SHARED - 1)).withColumn("step", F.explode(steps)).withColumn("conv_id", F.expr("try_add(conv_id, step)"))
    lent = lent.filter(F.col("pos") < taken(F.col("conv_id"))).select("conv_id", F.lit(0).cast("bigint").alias("chunk"), F.lit(0).alias("side"), "pos", "code", "bytes")
    turn = F.when(F.col("side") < 2, F.struct("side", "pos", "code", "bytes"))
    made = own.unionByName(lent).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("side").alias("side"), F.count_if(F.col("side") == 0).alias("lent"))
    # Ids that were only lent to do not exist.
    made = tables.keep(made.filter("side > 0").drop("side"), "trie-chunks")
    most = made.agg(F.max("chunk")).first()[0]
    if not most:
        return made.withColumn("last", F.lit(True)), False
    gap = F.when(base, 0).otherwise(taken(F.col("conv_id")) - F.col("lent"))
    moved = made.filter("chunk = 0").select("conv_id", gap.alias("gap")).filter("gap > 0").join(made.filter("chunk > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    moved = tables.keep(moved, "trie-moved")
    again = made.join(moved, "conv_id").select("conv_id", "gap", F.explode("turns").alias("t"))
    pos = F.col("t.pos") - F.when(F.col("t.side") == 1, F.col("gap")).otherwise(0)
    again = again.select("conv_id", F.struct("t.side", pos.alias("pos"), "t.code", "t.bytes").alias("t")).groupBy("conv_id", F.floor(F.col("t.pos") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = tables.keep(made.drop("lent").join(moved, "conv_id", "left_anti").unionByName(again), "trie-chunks")
    final = whole.groupBy("conv_id").agg(F.max("chunk").alias("final"))
    return whole.join(final, "conv_id").select("conv_id", "chunk", "turns", (F.col("chunk") == F.col("final")).alias("last")), True


# ---- names ----------------------------------------------------------------------------------------------------------


def digests(codes: list[bytes]) -> list[list[bytes]]:
    """Digests of all whole blocks of 1, 2, 4.. turns."""
    levels = [codes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([joined(low[i], low[i + 1]) for i in range(0, len(low) - 1, 2)])
    return levels


def cut(start: bytes, codes: list[bytes], chunk: int = CHUNK) -> list[bytes]:
    """Names of the prefixes of 1 .. len(codes) turns of a chunk; the one of a whole chunk is left out."""
    levels, names = digests(codes), {0: start}
    half = chunk // 2
    while half:
        for low in range(0, len(codes) - half + 1, 2 * half):
            names[low + half] = named(names[low], levels[half.bit_length() - 1][low // half])
        half //= 2
    return [names[d] for d in range(1, min(len(codes), chunk - 1) + 1)]


def starts(chunks: DataFrame, tables: Tables, chunk: int = CHUNK) -> DataFrame | None:
    """`conv_id, chunk, start` for chunks after the first, one more than a conversation's last whole chunk included.

    None when no conversation fills a chunk.
    """
    whole = chunks.filter(F.size("turns") == chunk)
    last = whole.agg(F.max("chunk")).first()[0]
    if last is None:
        return None

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            half = [digests(codes)[-1][0] for codes in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(half, pa.binary())], names=["conv_id", "i", "half"])

    codes = whole.select("conv_id", "chunk", F.transform("turns", lambda t: t["code"]).alias("codes"))
    levels = [tables.keep(codes.mapInArrow(work, "conv_id bigint, i bigint, half binary"), "trie-level")]
    depth = (last + 1).bit_length()
    for _ in range(depth - 1):
        pair = levels[-1].groupBy("conv_id", F.floor(F.col("i") / 2).alias("k")).agg(*[F.max(F.when(F.col("i") % 2 == side, F.col("half"))).alias(name) for side, name in ((0, "left"), (1, "right"))])
        levels.append(tables.keep(pair.filter("left is not null and right is not null").select("conv_id", F.col("k").alias("i"), hashed(b"j", "left", "right").alias("half")), "trie-level"))
    now = levels[0].select("conv_id").distinct().select("conv_id", F.lit(0).cast("bigint").alias("i"), F.lit(bytearray(ROOT)).alias("start"))
    for level in reversed(levels):
        upper = now.select("conv_id", (F.col("i") * 2).alias("i"), "start")
        lower = upper.join(level, ["conv_id", "i"]).select("conv_id", (F.col("i") + 1).alias("i"), hashed(b"n", "start", "half").alias("start"))
        after = tables.keep(upper.unionByName(lower), "trie-names")
        tables.drop(level, *([now] if level is not levels[-1] else []))
        now = after
    return now.select("conv_id", F.col("i").alias("chunk"), "start").filter("chunk > 0")


def paths(chunks: DataFrame, begun: DataFrame | None, chunk: int = CHUNK) -> DataFrame:
    """`conv_id, chunk, start, names, bytes, last`: chunks with the names of their prefixes."""
    if begun is None:
        ready = chunks.withColumn("start", F.lit(bytearray(ROOT))).withColumn("end", F.lit(None).cast("binary"))
    else:
        following = begun.select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("end"))
        ready = chunks.join(begun, ["conv_id", "chunk"], "left").join(following, ["conv_id", "chunk"], "left")
        ready = ready.withColumn("start", F.when(F.col("chunk") == 0, F.lit(bytearray(ROOT))).otherwise(F.col("start")))

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = []
            for start, end, codes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                here = cut(start, codes, chunk)
                names.append(here if len(codes) < chunk else [*here, end])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(names, pa.list_(pa.binary())), batch.column(5), batch.column(6)], names=["conv_id", "chunk", "start", "names", "bytes", "last"])

    parts = ready.select("conv_id", "chunk", "start", "end", F.transform("turns", lambda t: t["code"]).alias("codes"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"), "last")
    return parts.mapInArrow(work, "conv_id bigint, chunk bigint, start binary, names array<binary>, bytes array<bigint>, last boolean")


# ---- members that end at a node -------------------------------------------------------------------------------------


def ends_digest(ends: DataFrame) -> DataFrame:
    """`name, ends_sha256` over the ascending conv_ids of each name. `ends`: `name, conv_id`."""
    dealt = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            name, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at = [], 0
            while at < len(name):
                end = at
                while end < len(name) and end - at < PIECE and name[end] == name[at]:
                    end += 1
                out.append((name[at], conv[at], ",".join(map(str, conv[at:end]))))
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["name", "first", "ids"])

    def feed(batches: Iterator[pa.RecordBatch]):
        name, state = None, None
        for batch in batches:
            out = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if state is None or n != name:
                    if state is not None:
                        out.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    pieces = dealt.mapInArrow(pack, "name binary, first bigint, ids string")
    return pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(feed, "name binary, ends_sha256 string")


# ---- the trie -------------------------------------------------------------------------------------------------------


def trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per node: `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`.

    `chunk`, a power of two of at least `SHARED`, is the most turns in a row.
    """
    tables = Tables(conversations.sparkSession)
    chunks, several = sequences(turns(conversations, tables), tables, chunk)
    path = tables.keep(paths(chunks, starts(chunks, tables, chunk), chunk), "trie-paths")
    root_conv, n_convs = path.filter("chunk = 0").agg(F.min("conv_id"), F.count("*")).first()
    if not n_convs:
        empty = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
        return tables.spark.createDataFrame([], empty)

    # One row per turn: the node it leads to, and the one it comes from.
    steps = path.select("conv_id", "start", "chunk", "names", F.posexplode(F.arrays_zip("names", "bytes")).alias("at", "to"))
    steps = steps.select("conv_id", F.col("to.names").alias("name"), F.when(F.col("at") == 0, F.col("start")).otherwise(F.col("names")[F.col("at") - 1]).alias("parent"), (F.col("chunk") * chunk + F.col("at") + 1).alias("depth"), F.col("to.bytes").alias("bytes"))
    nodes = steps.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = tables.keep(nodes, "trie-nodes")
    empty_name = F.lit(bytearray(ROOT))
    zero = F.lit(0).cast("bigint")
    root = tables.spark.range(1).select(empty_name.alias("name"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("bytes"), F.lit(root_conv).cast("bigint").alias("conv_id"), F.lit(n_convs).cast("bigint").alias("n_convs"))
    # Each node and, under its parent's name, a mark that it is a child.
    fields = ["parent", "depth", "bytes", "conv_id", "n_convs"]
    own = nodes.unionByName(root).select("name", F.struct(*fields).alias("node"), zero.alias("child"))
    marks = nodes.select(F.col("parent").alias("name"), F.lit(None).cast(own.schema["node"].dataType).alias("node"), F.lit(1).cast("bigint").alias("child"))
    known = own.unionByName(marks).groupBy("name").agg(F.first("node", True).alias("node"), F.sum("child").alias("n_children")).select("name", "node.*", "n_children")

    # Sums along the owned part of each path, from its end: inside chunks, then over the sums of chunks.
    weighted = known.withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("bigint"))
    weighted = weighted.withColumn("chunk", F.greatest(zero, F.floor((F.col("depth") - 1) / chunk)))
    part = Window.partitionBy("conv_id", "chunk")
    tail = part.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    owned = weighted.select("name", *fields, "n_children", "chunk", F.sum("weight").over(tail).alias("saved"), F.sum("leaf").over(tail).alias("leaves"),
                            F.sum("weight").over(part).alias("w"), F.sum("leaf").over(part).alias("l"), F.min("depth").over(part).alias("low"))
    owned = tables.keep(owned.withColumn("heads", F.col("depth") == F.col("low")), "trie-owned")
    tables.drop(nodes)
    whole = owned.filter("heads").select("conv_id", "chunk", "low", "w", "l")
    if several:
        later = Window.partitionBy("conv_id").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
        below = whole.select("conv_id", "chunk", F.coalesce(F.sum("w").over(later), zero).alias("bw"), F.coalesce(F.sum("l").over(later), zero).alias("bl"))
        rest = owned.join(below, ["conv_id", "chunk"]).withColumn("saved", F.col("saved") + F.col("bw")).withColumn("leaves", F.col("leaves") + F.col("bl")).drop("bw", "bl")
        whole = whole.groupBy("conv_id").agg(F.min("low").alias("low"), F.sum("w").alias("w"), F.sum("l").alias("l"))
    else:
        rest, whole = owned, whole.drop("chunk")
    # A whole path, grafted onto each of its ancestors; the root is one of them unless it is owned.
    above = path.select("conv_id", "chunk", "names").join(whole, "conv_id").filter("low > 0")
    ancestors = F.slice("names", F.lit(1), F.greatest(F.lit(0), F.least(F.size("names"), (F.col("low") - 1 - F.col("chunk") * chunk).cast("int"))))
    ancestors = F.when(F.col("chunk") == 0, F.concat(F.array(empty_name), ancestors)).otherwise(ancestors)
    grafts = above.select(F.explode(ancestors).alias("name"), F.col("w").alias("saved"), F.col("l").alias("leaves"))

    # Where conversations end: at their last node, or at the root without turns.
    ends = ends_digest(path.filter("last").select(F.coalesce(F.try_element_at("names", F.lit(-1)), empty_name).alias("name"), "conv_id"))

    kept = ["parent", "depth", "conv_id", "n_convs", "n_children", "heads"]
    node = F.struct(*kept)
    whole_rows = rest.select("name", node.alias("node"), "saved", "leaves", F.lit(None).cast("string").alias("ends_sha256"))
    nothing = F.lit(None).cast(whole_rows.schema["node"].dataType).alias("node")
    rows = whole_rows.unionByName(grafts.select("name", nothing, "saved", "leaves", F.lit(None).cast("string").alias("ends_sha256")))
    rows = rows.unionByName(ends.select("name", nothing, zero.alias("saved"), zero.alias("leaves"), "ends_sha256"))
    out = rows.groupBy("name").agg(F.first("node", True).alias("node"), F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.max("ends_sha256").alias("ends_sha256"))
    out = tables.keep(out.select("name", "node.*", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie-out")
    tables.drop(path, owned)

    # Inside a path the parent has the same smallest member; only heads of paths look theirs up.
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    near = F.when(~F.col("heads"), F.col("conv_id")).when(F.col("parent") == empty_name, F.lit(root_conv))
    simple = ~F.col("heads") | F.col("parent").isNull() | (F.col("parent") == empty_name)
    names = out.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    asked = join_counted(out.filter(~simple), names, out.select(F.col("name").alias("parent"), "n_children"), "parent", "n_children")
    done = tables.keep(out.filter(simple).withColumn("parent_conv_id", near).select(result).unionByName(asked.select(result)), "trie")
    tables.drop(out)
    return done
