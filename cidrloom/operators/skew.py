"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
HOT_SPREAD = 4096
COPIES = 64


def join_to_unique(left: DataFrame, right: DataFrame, on: list[str], hot_keys: int = HOT_KEYS) -> DataFrame:
    """Left outer join to a table with one row per key, in one pass over `left`.

    The `hot_keys` most frequent keys of `left` (any key with at least 1/hot_keys of the rows is among
    them) get their row from a broadcast of at most `hot_keys` rows.  Everything else joins by hash.
    Hot rows still pass through that join, under a salt that no right row has, so that they spread
    evenly instead of meeting in one task.
    """
    payload = [c for c in right.columns if c not in on]
    hot = left.groupBy(*on).count().orderBy(F.desc("count"), *on).limit(hot_keys).select(*on, F.lit(True).alias("_hot"))
    hot_rows = right.join(F.broadcast(hot), on).select(
        *on, F.lit(True).alias("_known"), *[F.col(c).alias(f"_hot_{c}") for c in payload]
    )
    tagged = left.join(F.broadcast(hot), on, "left").join(F.broadcast(hot_rows), on, "left")
    # Null keys match nothing and would also meet in one task.
    apart = F.coalesce(F.col("_hot"), F.lit(False))
    for c in on:
        apart = apart | F.col(c).isNull()
    salt = F.when(apart, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SPREAD))).otherwise(0)
    tagged = tagged.withColumn("_salt", salt.cast("bigint"))
    joined = tagged.join(right.withColumn("_salt", F.lit(0).cast("bigint")), [*on, "_salt"], "left")
    values = [F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in payload]
    return joined.select(*left.columns, *values)


def join_counted(left: DataFrame, right: DataFrame, counts: DataFrame, key: str, rows: str, hot_keys: int = HOT_KEYS, copies: int = COPIES, shuffle: bool = False) -> DataFrame:
    """Left outer join to a table with one row per key; `counts` holds the number `rows` of left rows per key, stored.

    The counts name the hot keys, so `left` is read once.  The rows of the `hot_keys` most frequent keys are dealt to
    `copies` copies of their right row; only those keys are broadcast, with `shuffle` whatever the size of `right`.
    """
    payload = [c for c in right.columns if c != key]
    hot = F.broadcast(counts.orderBy(F.desc(rows), key).limit(hot_keys).select(key, F.lit(True).alias("_hot")))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(copies)).cast("int")
    # Null keys match nothing and would also meet in one task.
    deal = F.when(F.col("_hot"), spread).when(F.col(key).isNull(), -1 - spread).otherwise(0)
    dealt = left.join(hot, key, "left").withColumn("_copy", deal)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, key, "left").withColumn("_copy", F.explode(every))
    copied = copied.select(key, "_copy", *payload)
    joined = dealt.join(copied.hint("merge") if shuffle else copied, [key, "_copy"], "left")
    return joined.select(*left.columns, *payload)
