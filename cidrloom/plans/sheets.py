"""Sheet cells to the checked sheet table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_text
from cidrloom.functions.text import no_nets
from cidrloom.operators.conflicts import duplicate_cidrs, group_membership, group_table, import_statistics, rows_in_nets
from cidrloom.session import cut_lineage
from cidrloom.sources.sheets import SheetConfig, check_sheets, kept_rows, sheet_summary, type_rows

ROW_KEY = ["file", "sheet", "row_index"]


@dataclass
class SheetTable:
    rows: DataFrame
    summary: DataFrame
    conflicts: DataFrame
    unknown_groups: DataFrame
    statistics: DataFrame


def row_cidrs(rows: DataFrame, config: SheetConfig) -> DataFrame:
    """Prefixes of typed rows as `ord, source, net, network`, in column order."""
    arrays = [F.coalesce(F.col(c.name), no_nets()) for c in config.columns if c.type == "addresses"]
    nets = rows.select(*ROW_KEY, "sheettype", F.posexplode(F.concat(*arrays)).alias("pos", "net"))
    return nets.select(
        F.struct("file", "sheet", "row_index", F.col("pos").cast("bigint").alias("pos")).alias("ord"),
        F.struct("file", "sheet", "row_index", "sheettype").alias("source"),
        "net",
        cidr_text(F.col("net")).alias("network"),
    )


def build_sheet_table(
    cells: DataFrame, config: SheetConfig, groups: dict[str, list[list[str]]] | None = None,
    filters: DataFrame | None = None, net: str = "net", fail_on_conflict: bool = False,
) -> SheetTable:
    """Type the rows, keep those in the filter prefixes, check groups and duplicates.

    Groups are checked after the filter, so a sheet the filter empties counts as unknown.
    """
    # Typing is the costly part and everything below reads its rows, so they are written once.
    typed = cut_lineage(type_rows(cells, config))
    summary = sheet_summary(typed)
    check_sheets(summary)
    rows = kept_rows(typed)
    if filters is not None:
        arrays = [F.coalesce(F.col(c.name), no_nets()) for c in config.columns if c.type == "addresses"]
        rows = cut_lineage(rows_in_nets(rows.withColumn("_nets", F.concat(*arrays)), ROW_KEY, "_nets", filters, net).drop("_nets"))
    members, unknown = group_membership(group_table(cells.sparkSession, groups or {}), rows)
    conflicts = duplicate_cidrs(cut_lineage(row_cidrs(rows, config)), members)
    if fail_on_conflict:
        if not unknown.isEmpty():
            raise ValueError("groups name unknown sheets")
        if not conflicts.isEmpty():
            raise ValueError("duplicate prefixes within a sheet type")
    return SheetTable(rows, summary, conflicts, unknown, import_statistics(rows))
