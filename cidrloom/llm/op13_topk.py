"""Exact top-k inner products over a pivot-distance index.

Vectors are made integers, `floor(256 * x)`. One further coordinate, `sqrt(M - |x|^2)` with M the largest squared norm,
gives all rows the same length, so that a larger inner product is a smaller distance: |x - q|^2 = M + |q|^2 - 2 <x, q>.
A row is keyed by its nearest pivot and its distance to it, in rings (annuli) of one width. With d the distances to a
pivot, |d(q) - d(x)| <= |x - q|, so a ring from `lo` to `hi` holds no score above (M + |q|^2 - gap^2) / 2, where `gap` is
how far d(q) lies outside [lo, hi]. A query first reads the rings of best bound that hold enough rows, which gives its
k-th score, then only the rings whose bound still reaches that score. In a ring, rows are sorted by distance and cut at
the same bound before the products are taken. Bounds are widened by more than their rounding, and scores are exact.

Pivots: `PIVOTS` rows of a sample of about `SAMPLE`, each the farthest from those before. The sample only shapes the rings: all
rows are indexed, the bounds are those of all rows, and the result is exact for any pivots.

Skew: equal vectors are cut to their k + 1 smallest ids before they are shuffled, which no query can tell. Rings are
dealt into blocks of at most about `BLOCK` rows, and the queries of a block into chunks of about `CHUNK`; block and chunk
meet by hash and stream through a task. What is broadcast has at most PIVOTS * RINGS rows.

Defined cases: a vector that is null or holds a null, NaN or infinite component takes no part, neither does an empty one.
Rows of one id are that id's own: none is its candidate. Repeated rows (equal id and vector) count once; an id with
several vectors asks once for each. A null id is no query and ranks after all others of its score. Shorter vectors are
as if filled with zeros. Components beyond 64 bits are cut to 64 bits, and so are scores. Ties go to the smaller id. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cidrloom.llm.kit import Tables

SCALE = 256
PIVOTS = 32
RINGS = 64
SAMPLE = 2048
BLOCK = 16384
CHUNK = 16384
_EXACT = float(1 << 53)


def integers(vector: Column) -> Column:
    """`array<bigint>` of floor(256 * x); null for vectors that take no part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    return F.when((F.size(vector) > 0) & F.forall(vector, lambda x: fine(x.cast("double"))), whole)


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """The rows of a list column, filled with zeros on the right."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    at, values = at - at[0], column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(at)
    out = np.zeros((len(column), max(width, int(size.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - at[row]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of `a` with all rows of `b`, exact within 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(width, 1)
    if most < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Pivots:
    """Pivots with their further coordinate, and the ring width."""

    def __init__(self, sample: np.ndarray, top: float, pivots: int = PIVOTS, rings: int = RINGS):
        self.top, self.rings = top, rings
        points = np.concatenate((sample.astype(float), self._more(sample)[:, None]), axis=1)
        # Each pivot is the sampled row farthest from the pivots before it; the first one is farthest from the mean.
        chosen, near = [], ((points - points.mean(axis=0)) ** 2).sum(axis=1)
        for _ in range(min(pivots, len(points))):
            far = int(near.argmax())
            gap = ((points - points[far]) ** 2).sum(axis=1)
            near = np.minimum(near, gap) if chosen else gap
            chosen.append(far)
            if not near.max() > 0:
                break
        self.points = points[chosen]
        self.width = float(np.sqrt(max(near.max(), 0.0))) / rings or 1.0

    def _more(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x.astype(float) ** 2).sum(axis=1), 0.0))

    def distances(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        """Distances to all pivots; a query's further coordinate is zero."""
        own = x.astype(float)
        more = np.zeros(len(own)) if is_query else self._more(x)
        width = min(own.shape[1], self.points.shape[1] - 1)
        dot = own[:, :width] @ self.points[:, :width].T + more[:, None] * self.points[:, -1]
        square = (own**2).sum(axis=1) + more**2
        return np.sqrt(np.maximum(square[:, None] + (self.points**2).sum(axis=1) - 2 * dot, 0.0))

    def slack(self) -> float:
        """More than the rounding of a distance."""
        return 1e-6 * (1.0 + self.top) ** 0.5 + 1e-9


def keyed(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """`id, vec, pivot, ring, dist` of every row."""
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            far = pivots.distances(matrix(batch.column(1)), False)
            pivot = far.argmin(axis=1)
            dist = far[np.arange(len(far)), pivot]
            ring = np.minimum(dist / pivots.width, pivots.rings - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pivot.astype(np.int32)), pa.array(ring), pa.array(dist)], names=["id", "vec", "pivot", "ring", "dist"])

    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, vec array<bigint>, pivot int, ring int, dist double")


class Rings:
    """All rings that hold rows: at most PIVOTS * RINGS entries, whatever the size of the table."""

    def __init__(self, pivots: Pivots, pivot, ring, low, high, count):
        self.pivots = pivots
        self.pivot, self.ring = np.array(pivot, np.int32), np.array(ring, np.int32)
        self.low, self.high, self.count = np.array(low, float), np.array(high, float), np.array(count, np.int64)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Least distance between each query and any row of each ring, by the triangle inequality."""
        d = self.pivots.distances(x, True)[:, self.pivot]
        return np.maximum(np.maximum(self.low - d, d - self.high) - self.pivots.slack(), 0.0)

    def first(self, x: np.ndarray, rows: int) -> np.ndarray:
        """Per query the rings of smallest gap that hold `rows` rows together, as a mask."""
        gap = self.gaps(x)
        by = np.argsort(gap, axis=1, kind="stable")
        before = np.cumsum(self.count[by], axis=1) - self.count[by]
        take = np.zeros(gap.shape, bool)
        np.put_along_axis(take, by, before < rows, axis=1)
        return take

    def reach(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The rings whose score bound is not below the query's `least` score (NaN: all), as a mask."""
        square = (x.astype(float) ** 2).sum(axis=1)
        total = self.pivots.top + square[:, None]
        bound = (total * (1 + 1e-9) - self.gaps(x) ** 2) / 2 + 1
        return ~(bound < least[:, None])


def asked(queries: DataFrame, rings: Rings, rows: int, first: bool) -> DataFrame:
    """`pivot, ring, row, qid, qvec, least`: each query once for each ring that it reads in this pass."""
    def work(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = matrix(batch.column(2))
                seen = rings.first(x, rows)
                least = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                take = seen if first else rings.reach(x, least) & ~seen
                q, r = np.nonzero(take)
                out = batch.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([pa.array(rings.pivot[r]), pa.array(rings.ring[r]), *out.columns], names=["pivot", "ring", "row", "qid", "qvec", "least"])

    return queries.mapInArrow(work, f"pivot int, ring int, row bigint, qid {dict(queries.dtypes)['qid']}, qvec array<bigint>, least bigint")


def search(asks: DataFrame, index: DataFrame, rings: Rings, blocks: DataFrame, chunks: int, k: int) -> DataFrame:
    """`row, qid, id, score`: of every block that a query reads, its `k` best rows.

    Each block (part of a ring) meets each chunk of its queries in one task: rows of the block come first, sorted by
    distance, queries follow batch by batch.
    """
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")
    asks = asks.join(F.broadcast(blocks), ["pivot", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = asks.select("pivot", "ring", "part", chunk.alias("chunk"), F.lit(1).alias("side"), F.lit(0.0).alias("dist"), F.col("qid").alias("id"), F.col("qvec").alias("vec"), "least", "row")
    # Blocks travel only where a chunk of queries asks for them.
    places = asks.select("pivot", "ring", "part", "chunk").distinct()
    held = index.join(places, ["pivot", "ring", "part"]).select("pivot", "ring", "part", "chunk", F.lit(0).alias("side"), "dist", "id", "vec", F.lit(None).cast("bigint").alias("least"), F.lit(None).cast("bigint").alias("row"))
    key = ["pivot", "ring", "part", "chunk"]
    met = held.unionByName(asks).repartition(*key).sortWithinPartitions(*key, "side", "dist")
    pivots = rings.pivots

    def compare(block: tuple, queries: pa.RecordBatch, pivot: int):
        ids, dist, x = block
        q = matrix(queries.column(queries.schema.get_field_index("vec")))
        qid = queries.column(queries.schema.get_field_index("id"))
        asker = queries.column(queries.schema.get_field_index("row"))
        least = queries.column(queries.schema.get_field_index("least")).to_numpy(zero_copy_only=False).astype(float)
        # Rows whose distance to the pivot differs by more than `gap` from the query's score below `least`.
        square = (q.astype(float) ** 2).sum(axis=1)
        gap = np.sqrt(np.maximum((pivots.top + square) * (1 + 1e-9) - 2 * (least - 1), 0.0)) + pivots.slack()
        gap = np.where(np.isnan(gap), np.inf, gap)
        d = pivots.distances(q, True)[:, pivot]
        lo, hi = int(np.searchsorted(dist, (d - gap).min())), int(np.searchsorted(dist, (d + gap).max(), "right"))
        if lo >= hi:
            return
        names = ids.slice(lo, hi - lo)
        none = names.is_null().to_numpy(zero_copy_only=False)
        name = names.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((name, none))  # columns by id, null ids last, so that a stable sort by score breaks ties
        score = products(q, x[lo:hi][order])
        own = (name[order] == qid.to_numpy()[:, None]) & ~none[order]
        rank = np.where(own, np.iinfo(np.int64).max, -np.maximum(score, -np.iinfo(np.int64).max))
        if rank.shape[1] > k:
            edge = np.partition(rank, k - 1, axis=1)[:, k - 1 : k]
            row, col = np.nonzero((rank <= edge) & ~own)
        else:
            row, col = np.nonzero(~own)
        # Ties at the edge may be many: of each query's hits only the first k by (score, id) leave.
        by = np.lexsort((col, rank[row, col], row))
        row, col = row[by], col[by]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[nth < k], col[nth < k]
        yield pa.RecordBatch.from_arrays([asker.take(pa.array(row)), qid.take(pa.array(row)), names.take(pa.array(order[col])), pa.array(score[row, col])], names=["row", "qid", "id", "score"])

    def work(batches: Iterator[pa.RecordBatch]):
        spot, block, parts = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(5)])
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                here, piece = tuple(keys[:4, lo].tolist()), batch.slice(lo, hi - lo)
                if here != spot:
                    spot, block, parts = here, None, []
                if keys[4, lo] == 0:
                    parts.append(piece)
                    continue
                if parts:
                    whole, parts = pa.Table.from_batches(parts), []
                    block = whole.column("id").combine_chunks(), whole.column("dist").to_numpy(), matrix(whole.column("vec"))
                for at in range(0, piece.num_rows if block is not None else 0, 256):
                    yield from compare(block, piece.slice(at, 256), here[0])

    return met.mapInArrow(work, f"row bigint, qid {dict(asks.dtypes)['id']}, id {dict(asks.dtypes)['id']}, score bigint")


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`query_id, rank, <key>, score`: the `k` best rows for each row of which the condition `queries` holds."""
    spark = vectors.sparkSession
    tables = Tables(spark)
    rows = vectors.select(F.col(key).alias("id"), integers(F.col(vector)).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = tables.keep(rows.filter("vec is not null").dropDuplicates(["id", "vec"]).withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    square = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    asking = rows.filter("asks and id is not null")
    top, n, n_queries = rows.agg(F.max(square), F.count("*"), F.count_if(F.col("asks") & F.col("id").isNotNull())).first()
    if not n_queries:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(key), F.lit(0).cast("bigint").alias("score")).filter("false")
    drawn = rows.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 40)) <= int((1 << 40) * min(1.0, SAMPLE / n)))
    sample = [r[0] for r in drawn.select("vec").limit(2 * SAMPLE).collect()] or [rows.first()["vec"]]
    pivots = Pivots(matrix(pa.array(sample, pa.list_(pa.int64()))), float(top))
    same = Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last())
    once = rows.select("id", "vec", F.row_number().over(same).alias("_nth")).filter(F.col("_nth") <= k + 1).select("id", "vec")
    index = tables.keep(keyed(once, pivots), "topk-keyed")
    found = index.groupBy("pivot", "ring").agg(F.min("dist"), F.max("dist"), F.count("*")).collect()
    rings = Rings(pivots, *zip(*found, strict=True))
    blocks = spark.createDataFrame([(int(p), int(r), int(-(-n // BLOCK))) for p, r, n in zip(rings.pivot, rings.ring, rings.count, strict=True)], "pivot int, ring int, parts int")
    index = index.join(F.broadcast(blocks), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec", "id"), F.col("parts")).cast("int")).drop("parts")
    chunks = -(-n_queries // CHUNK)
    asking = asking.select("row", F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.lit(None).cast("bigint").alias("least"))
    # Enough rows for k others even where the query's own row is among them.
    near = tables.keep(best(search(asked(asking, rings, k + 1, True), index, rings, blocks, chunks, k), k).drop("rank"), "topk-near")
    least = near.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asking = asking.drop("least").join(least, "row", "left")
    far = search(asked(asking, rings, k + 1, False), index, rings, blocks, chunks, k)
    done = tables.keep(best(near.unionByName(far), k).select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score"), "topk")
    tables.drop(rows, near)
    return done
