"""Sheet-table checks: filters, groups, duplicate prefixes, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_struct, masked
from cidrloom.operators.prefix import in_any_net
from cidrloom.operators.skew import join_to_unique
from cidrloom.session import cut_lineage


def rows_in_nets(rows: DataFrame, row_key: list[str], nets_col: str, filters: DataFrame, net: str) -> DataFrame:
    """Rows with at least one prefix whose network address lies in a filter prefix.

    Only the network address is tested, so a wider prefix that starts inside passes.
    """
    cells = rows.select(*row_key, F.explode(nets_col).alias("_n"))
    base = masked(F.col("_n"))
    host = cidr_struct(base["family"], F.when(base["family"] == 4, 32).otherwise(128), base["hi"], base["lo"])
    cells = cut_lineage(cells.select(*row_key, host.alias("_a")))
    inside = in_any_net(cells, "_a", filters, net).withColumn("_in", F.lit(True))
    keep = join_to_unique(cells, inside, ["_a"]).filter("_in").select(*row_key).distinct()
    return rows.join(keep, row_key, "left_semi")


def group_table(spark: SparkSession, groups: dict[str, list[list[str]]]) -> DataFrame:
    """Configured sheet groups as `file, sheet, group_id`; ids count across files."""
    rows, group_id = [], 0
    for file, lists in groups.items():
        for names in lists:
            rows += [(file, name, group_id) for name in names]
            group_id += 1
    return spark.createDataFrame(rows, "file string, sheet string, group_id int")


def group_membership(groups: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`file, sheet, group_ids` of known sheets, configured sheets that are unknown)."""
    known = sheets.select("file", "sheet").distinct()
    member = groups.join(known, ["file", "sheet"], "left_semi")
    members = member.groupBy("file", "sheet").agg(F.sort_array(F.collect_set("group_id")).alias("group_ids"))
    unknown = groups.join(known, ["file", "sheet"], "left_anti").select("file", "sheet").distinct()
    return members, unknown


def duplicate_cidrs(cidrs: DataFrame, members: DataFrame) -> DataFrame:
    """Repeats of a prefix within a sheettype whose sheet shares no group with its first sighting.

    `cidrs` are rows `ord, source, net, network`.  The first sighting per prefix is an aggregate; rows
    are compared with it, not with each other.
    """
    rows = cidrs.select("ord", "net", "network", "source.file", "source.sheet", "source.row_index", "source.sheettype")
    rows = join_to_unique(rows, members, ["file", "sheet"])
    seen = F.struct("ord", "file", "sheet", "row_index", F.coalesce("group_ids", F.array().cast("array<int>")).alias("group_ids"))
    rows = cut_lineage(rows.withColumn("_seen", seen))
    first = rows.groupBy("sheettype", "net").agg(F.min("_seen").alias("_first"))
    rows = join_to_unique(rows, first, ["sheettype", "net"])
    later = rows.withColumn("_rank", F.col("ord") > F.col("_first.ord"))
    clash = later.filter(F.col("_rank") & ~F.arrays_overlap("_seen.group_ids", "_first.group_ids"))
    return clash.select(
        "sheettype", "network", "file", "sheet", "row_index",
        F.col("_first.file").alias("first_file"), F.col("_first.sheet").alias("first_sheet"), F.col("_first.row_index").alias("first_row_index"),
    )


def import_statistics(rows: DataFrame) -> DataFrame:
    """Sheets and rows per sheettype."""
    sheets = rows.groupBy("sheettype", "file", "sheet").agg(F.count("*").alias("n"))
    return sheets.groupBy("sheettype").agg(F.count("*").alias("sheets"), F.sum("n").alias("rows"))


def regroup_by_sheet(cidrs: DataFrame) -> DataFrame:
    """Rows with prefixes and prefixes per sheet."""
    per_row = cidrs.groupBy("source.file", "source.sheet", "source.sheettype", "ord").agg(F.count("*").alias("n"))
    return per_row.groupBy("file", "sheet", "sheettype").agg(F.count("*").alias("rows"), F.sum("n").alias("cidrs"))
