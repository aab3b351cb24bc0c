"""Quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.patterns import PtrPattern, in_domain, ptr_excluded, ptr_matches
from cidrloom.operators.conflicts import duplicate_cidrs, group_membership, regroup_by_sheet
from cidrloom.sources.readers import sheet_row_cidrs
from cidrloom.sources.sheets import header_inventory, sheet_preview


def unmatched(ptr: Column, patterns: list[PtrPattern]) -> Column:
    """Hostnames in scope of their first pattern by domain that it neither excludes nor matches."""
    out = F.lit(False)
    for pattern in reversed(patterns):
        missed = ~ptr_excluded(pattern, ptr) & ~ptr_matches(pattern, ptr)
        out = F.when(in_domain(pattern, ptr), missed).otherwise(out)
    return F.coalesce(out, F.lit(False))


def hostname_coverage(gateways: DataFrame, patterns: list[PtrPattern]) -> DataFrame:
    """Distinct hostnames of gateways and hops that no pattern explains, sorted."""
    names = gateways.select(F.explode(F.concat(F.array("gateway.ptr"), F.coalesce("routes.ptr", F.array()))).alias("ptr"))
    names = names.filter(F.col("ptr").isNotNull()).distinct()
    return names.filter(unmatched(F.col("ptr"), patterns)).orderBy("ptr")


def duplicate_report(sheet_rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conflicts, rows and prefixes per sheet, unknown group sheets) of a landed sheet table."""
    cidrs = sheet_row_cidrs(sheet_rows)
    sheets = regroup_by_sheet(cidrs)
    members, unknown = group_membership(groups, sheets)
    return duplicate_cidrs(cidrs, members), sheets, unknown


def onboarding_report(cells: DataFrame, header_row: int = 1, excludes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(headers with generated names, preview lines) of new sheets."""
    return header_inventory(cells, header_row, excludes), sheet_preview(cells, header_row, excludes)
