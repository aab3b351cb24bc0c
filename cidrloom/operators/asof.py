"""Lookup of addresses in disjoint intervals: an as-of join with one carried interval.

Intervals and distinct addresses are dealt by the /16 block of their start, sorted by address, and merged in one pass: each
address takes the last interval that starts at or before it.  Intervals never cross a block (`disjoint_intervals` cuts
them there), so nothing is carried between groups, and a group has at most 65,536 interval starts and 65,536 distinct
addresses whatever the size of the tables.  There is one plan for all sizes; what is broadcast is bounded by constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cidrloom.operators.prefix import BLOCK, disjoint_intervals, one_per_net
from cidrloom.operators.skew import join_counted
from cidrloom.session import cut_lineage

WIDE_PLEN = 16  # nets up to this length cover whole blocks
WIDE_SPREAD = 256


def _block(address: Column) -> Column:
    return F.shiftright(address, 16)


def record_intervals(table: DataFrame, net: str) -> DataFrame:
    """Disjoint IPv4 intervals `lo, hi, record STRUCT`, each with the row of its longest covering net.

    A wide net owns intervals in many blocks, up to all of them.  Its row is copied once per block it covers, at most
    `WIDE_SPREAD` times, and its intervals meet those copies by block, so that no net is a hot key; all nets of one
    length make at most 65,536 copies.
    """
    unique = cut_lineage(one_per_net(table.filter(F.col(net)["family"] == 4), net))
    spans = disjoint_intervals(unique, "match")
    plen = F.col("match")["plen"]
    copies = F.when(plen < WIDE_PLEN, F.least(F.lit(WIDE_SPREAD), F.call_function("shiftleft", F.lit(1), WIDE_PLEN - plen))).otherwise(1)
    rows = unique.select("match", F.struct(*[c for c in unique.columns if c not in ("match", net)]).alias("record"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    spans = spans.withColumn("_copy", F.pmod(_block(F.col("lo")), copies).cast("int"))
    return spans.join(rows, ["match", "_copy"]).select("lo", "hi", "record")


def resolve(probes: DataFrame, ip: str, intervals: DataFrame) -> DataFrame:
    """`ip, record` of the addresses `probes` (distinct) that some interval holds."""
    kind = dict(intervals.dtypes)["record"]
    asked = probes.select(F.col(ip).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_hi"), F.lit(None).cast(kind).alias("_record"))
    # Only blocks that are asked for take part: at most 65,536 numbers are broadcast.
    blocks = probes.select(_block(F.col(ip)).alias("_block")).distinct()
    held = intervals.withColumn("_block", _block(F.col("lo"))).join(F.broadcast(blocks), "_block", "left_semi")
    held = held.select(F.col("lo").alias("_at"), F.lit(0).alias("_side"), F.col("hi").alias("_hi"), F.col("record").alias("_record"))
    carried = Window.partitionBy("_block").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_hi", "_record")), ignorenulls=True).over(carried)
    merged = held.unionByName(asked).withColumn("_block", _block(F.col("_at"))).withColumn("_last", last)
    found = merged.filter((F.col("_side") == 1) & (F.col("_last._hi") >= F.col("_at")))
    return found.select(F.col("_at").alias(ip), F.col("_last._record").alias("record"))


def interval_join(left: DataFrame, ip: str, intervals: DataFrame, shuffle: bool = False) -> DataFrame:
    """Left outer join of an IPv4 number column to the `record` of the interval that holds it.

    Each distinct address is looked up once, however many rows have it. With `shuffle` the records are not broadcast.
    """
    counts = cut_lineage(left.select(ip).filter(F.col(ip).isNotNull()).groupBy(ip).agg(F.count("*").alias("_rows")))
    found = cut_lineage(resolve(counts.select(ip), ip, intervals))
    return join_counted(left, found, counts, ip, "_rows", shuffle=shuffle)
