"""JSON array files read by many tasks, whether or not they hold line breaks.

The file is read as pieces between commas, which splits at any byte.  A piece knows its own quotes and brackets; whether it
starts inside a string, and how deep, follows from the pieces before it.  Both are prefix sums: inside a split for either
state at its start, then over the splits of a file, of which there is one row each.  Commas at depth one end an element,
and the pieces of an element are joined again.  A bad element fails the job with its offset.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cidrloom.functions.jsontext import canonical
from cidrloom.session import cut_lineage

SPLIT = ["file_path", "file_block_start"]
FILE_BITS = 40  # elements of a file; the rest of a log id is the file's number


CHANGE = "struct<quotes:int,out:int,in:int>"
CHANGE_BYTES = 2_000_000  # pieces are worked on in runs of about this size; numpy takes some twenty times as much


def changes_column(pieces: pa.Array) -> pa.Array:
    """Quotes of each piece, and its change of depth when it starts outside or inside a string."""
    # No escape crosses a comma: outside strings there is none, and inside a backslash does not stand before a comma.
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, np.int32, len(pieces) + 1, pieces.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])) if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if len(raw) > CHANGE_BYTES and len(pieces) > 1:
        middle = min(max(1, int(np.searchsorted(at, len(raw) // 2))), len(pieces) - 1)
        return pa.concat_arrays([changes_column(pieces[:middle]), changes_column(pieces[middle:])])
    piece = np.repeat(np.arange(len(pieces)), np.diff(at))
    # Of a run of backslashes every other one escapes the character behind it.
    back = np.flatnonzero(raw == ord("\\"))
    new = np.ones(len(back), bool)
    new[1:] = (np.diff(back) > 1) | (piece[back[1:]] != piece[back[:-1]])
    place = np.arange(len(back))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    escaping = back[nth % 2 == 0]
    escaping = escaping[escaping + 1 < len(raw)]
    escaped = np.zeros(len(raw), bool)
    escaped[escaping[piece[escaping] == piece[escaping + 1]] + 1] = True
    quote = (raw == ord('"')) & ~escaped
    step = ((raw == ord("[")) | (raw == ord("{"))).astype(np.int8) - ((raw == ord("]")) | (raw == ord("}")))
    step[escaped] = 0
    total = np.concatenate([[0], np.cumsum(quote)])
    bracket = np.flatnonzero(step)
    inside = (total[bracket] - total[at[piece[bracket]]]) % 2
    quotes = (total[at[1:]] - total[at[:-1]]).astype(np.int32)
    depth = [np.bincount(piece[bracket], step[bracket] * (inside == side), len(pieces)).astype(np.int32) for side in (0, 1)]
    return pa.StructArray.from_arrays([pa.array(quotes), pa.array(depth[0]), pa.array(depth[1])], ["quotes", "out", "in"])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """`value` between commas with its place, its quotes, and its change of depth from either state at its start."""
    pieces = spark.read.option("lineSep", ",").text(path).select("value", *[f"_metadata.{c}" for c in SPLIT])
    pieces = pieces.withColumn("id", F.monotonically_increasing_id())
    rows = pieces.withColumn("_change", F.arrow_udf(changes_column, CHANGE)("value"))
    return rows.select(*pieces.columns, "_change.*", (F.octet_length("value") + 1).alias("bytes"))


def _before(column: str, keys: list[str], order: str) -> Column:
    return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """`file_path, number, element, offset, text, last, framed` of every element of the JSON arrays under `path`, brackets taken off.

    `number` counts the files by their path, `element` counts from 0 in each file, and `offset` is the byte of the file where its first piece starts.
    """
    local = _pieces(spark, path).withColumn("q", _before("quotes", SPLIT, "id"))
    # Change of depth when the split starts outside (0) or inside (1) a string.
    for start in (0, 1):
        local = local.withColumn(f"d{start}", F.when((F.col("q") + start) % 2 == 0, F.col("out")).otherwise(F.col("in")))
    for start in (0, 1):
        local = local.withColumn(f"p{start}", _before(f"d{start}", SPLIT, "id"))
    local = cut_lineage(local.withColumn("at", _before("bytes", SPLIT, "id")))
    splits = local.groupBy(*SPLIT).agg(F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"), F.sum("bytes").alias("bytes"))
    splits = splits.withColumn("inside", _before("quotes", SPLIT[:1], SPLIT[1]) % 2).withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    splits = splits.select(*SPLIT, "inside", _before("d", SPLIT[:1], SPLIT[1]).alias("depth"), _before("bytes", SPLIT[:1], SPLIT[1]).alias("start"))
    known = local.join(splits, SPLIT)
    quoted = (F.col("inside") + F.col("q") + F.col("quotes")) % 2
    deep = F.col("depth") + F.when(F.col("inside") == 0, F.col("p0") + F.col("d0")).otherwise(F.col("p1") + F.col("d1"))
    ends = F.when((quoted == 0) & (deep == 1), 1).otherwise(0)
    known = known.select(*SPLIT, "id", "value", (F.col("start") + F.col("at")).alias("offset"), ends.alias("ends"))
    known = cut_lineage(known.withColumn("nth", _before("ends", SPLIT, "id")))
    counts = known.groupBy(*SPLIT).agg(F.sum("ends").alias("ends"), F.max("nth").alias("nth"))
    counts = counts.withColumn("first", _before("ends", SPLIT[:1], SPLIT[1]))
    counts = counts.select(*SPLIT, "first", F.max(F.col("first") + F.col("nth")).over(Window.partitionBy(SPLIT[0])).alias("final"))
    counts = counts.withColumn("number", F.dense_rank().over(Window.orderBy(SPLIT[0])) - 1)  # one row per split
    pieces = known.join(counts, SPLIT).withColumn("element", F.col("first") + F.col("nth"))
    # One element is one record, so what is gathered is bounded by the largest record.
    piece = F.struct(SPLIT[1], "id", "value")
    whole = pieces.groupBy("file_path", "element").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.min("offset").alias("offset"), F.first("final").alias("final"), F.first("number").alias("number"))
    text = F.array_join(F.transform("p", lambda p: p["value"]), ",")
    last = F.col("element") == F.col("final")
    opened = F.when(F.col("element") == 0, F.regexp_replace(text, r"\A\s*+\[", F.lit(""))).otherwise(text)
    bare = F.when(last, F.regexp_replace(opened, r"\]\s*+\z", F.lit(""))).otherwise(opened)
    is_array = (F.col("element") > 0) | text.rlike(r"\A\s*+\[")
    is_closed = ~last | text.rlike(r"\]\s*+\z")
    return whole.select("file_path", "number", "element", "offset", bare.alias("text"), last.alias("last"), (is_array & is_closed).alias("framed"))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """`log_id, record` (canonical text) of the elements of JSON array files; the job fails at the first bad one."""
    rows = array_elements(spark, path)
    empty = F.col("framed") & F.col("last") & (F.col("element") == 0) & F.col("text").rlike(r"\A\s*\z")
    where = F.concat(F.lit(" at byte "), F.col("offset").cast("string"), F.lit(" of "), F.col("file_path"))
    record = F.coalesce(canonical(F.col("text")), F.raise_error(F.concat(F.lit("bad JSON array element"), where)).cast("string"))
    frame = F.raise_error(F.concat(F.lit("log file is no JSON array"), where)).cast("string")
    good = rows.filter(~empty).withColumn("record", F.when(F.col("framed"), record).otherwise(frame))
    return good.select((F.col("number") * (1 << FILE_BITS) + F.col("element")).cast("bigint").alias("log_id"), "record")
