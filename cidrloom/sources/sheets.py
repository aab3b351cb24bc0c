"""Sheet cells to typed rows.

Cells are a long table `file, sheet, row, col, kind, s, i, f, b`; `row` counts from 1, `col` from 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_text, strip
from cidrloom.functions.text import CELL_CASTS, address_lists, no_nets, number_text, snake_case
from cidrloom.operators.skew import join_to_unique
from cidrloom.sources.schemas import CELL


@dataclass(frozen=True)
class ColumnMapping:
    """Output column: from one header (`sheet_name`) or, for addresses, several (`sheet_names`)."""

    name: str
    sheet_name: str | None = None
    sheet_names: tuple[str, ...] = ()
    type: str = "string"
    ptr_field: str | None = None


@dataclass(frozen=True)
class SheetConfig:
    columns: tuple[ColumnMapping, ...]
    header_row: int = 1
    excludes_sheets: tuple[str, ...] = ()
    sheettype: str = "backbone"
    groups: tuple[tuple[str, ...], ...] = field(default=())

    def __post_init__(self):
        for c in self.columns:
            if c.type not in CELL_CASTS:
                raise ValueError(f"unknown column type {c.type!r}")
            if c.sheet_names and c.type != "addresses":
                raise ValueError(f"column {c.name!r}: several headers need type addresses")


def cell_struct() -> Column:
    return F.struct("kind", "s", "i", "f", "b").cast(CELL)


def cell_text(cell: Column) -> Column:
    """Cell as bare text, null when empty."""
    kind = cell["kind"]
    text = (
        F.when(kind == "string", strip(cell["s"]))
        .when(kind == "float", number_text(cell["f"]))
        .when(kind == "int", cell["i"].cast("string"))
        .when(kind == "bool", cell["b"].cast("string"))
    )
    return F.nullif(text, F.lit(""))


def exclude_sheets(cells: DataFrame, excludes: tuple[str, ...]) -> DataFrame:
    return cells.filter(~F.col("sheet").isin(*excludes)) if excludes else cells


def type_rows(cells: DataFrame, config: SheetConfig) -> DataFrame:
    """One row per data row: `file, sheet, row_index, sheettype, skipped` and the mapped columns.

    Address columns are prefix arrays, null when empty; other columns are VARIANT.  `skipped` marks
    rows with a cell that cannot be converted; their mapped columns are null.
    """
    wanted = sorted({n for c in config.columns for n in (c.sheet_names or (c.sheet_name or "",))})
    cells = exclude_sheets(cells, config.excludes_sheets)
    header = cells.filter(F.col("row") == config.header_row).withColumn("name", cell_text(cell_struct()))
    last = header.filter(F.col("name").isin(*wanted)).groupBy("file", "sheet", "name").agg(F.max("col").alias("col"))
    # At most one entry per mapped name.
    names = last.groupBy("file", "sheet").agg(F.map_from_entries(F.collect_list(F.struct("col", "name"))).alias("names"))
    data = join_to_unique(cells.filter(F.col("row") > config.header_row), names, ["file", "sheet"])
    named = data.withColumn("name", F.try_element_at("names", F.col("col")))
    picks = [F.first(F.when(F.col("name") == n, cell_struct()), ignorenulls=True).alias(f"_c{i}") for i, n in enumerate(wanted)]
    rows = named.groupBy("file", "sheet", "row").agg(F.first("names", ignorenulls=True).alias("names"), *picks)
    empty = F.struct(F.lit("empty").alias("kind"), F.lit(None).alias("s"), F.lit(None).alias("i"), F.lit(None).alias("f"), F.lit(None).alias("b")).cast(CELL)
    slot = {n: F.coalesce(F.col(f"_c{i}"), empty) for i, n in enumerate(wanted)}

    def has(n: str) -> Column:
        return F.coalesce(F.array_contains(F.map_values("names"), n), F.lit(False))

    # All address headers go through one parse expression, evaluated once per row.
    addressed = sorted({n for c in config.columns if c.type == "addresses" for n in (c.sheet_names or (c.sheet_name or "",))})
    rows = rows.withColumn("_parsed", address_lists([F.when(has(n), slot[n]).otherwise(empty) for n in addressed]))
    parsed = {n: F.col("_parsed")[i] for i, n in enumerate(addressed)}
    values, skipped = [], F.lit(False)
    for c in config.columns:
        if c.sheet_names:
            nets = F.array_distinct(F.flatten(F.array(*[F.coalesce(parsed[n], no_nets()) for n in c.sheet_names])))
            value = F.when(F.size(nets) > 0, nets)
        elif c.type == "addresses":
            nets = parsed[c.sheet_name or ""]
            skipped = skipped | nets.isNull()
            value = F.when(F.size(nets) > 0, nets)
        else:
            cast = CELL_CASTS[c.type](slot[c.sheet_name or ""])
            skipped = skipped | (has(c.sheet_name or "") & cast["bad"])
            # A missing header gives an empty text whatever the type.
            value = F.when(has(c.sheet_name or ""), cast["value"].cast("variant")).otherwise(F.lit("").cast("variant"))
        values.append((c.name, value))
    outputs = [F.when(~skipped, value).alias(name) for name, value in values]
    index = (F.col("row") - config.header_row - 1).cast("bigint")
    return rows.select("file", "sheet", index.alias("row_index"), F.lit(config.sheettype).alias("sheettype"), skipped.alias("skipped"), *outputs)


def sheet_summary(typed: DataFrame) -> DataFrame:
    """Rows kept and skipped per sheet; `failed` when every row was skipped."""
    return typed.groupBy("file", "sheet", "sheettype").agg(
        F.count_if(~F.col("skipped")).alias("rows"), F.count_if("skipped").alias("skipped")
    ).withColumn("failed", (F.col("rows") == 0) & (F.col("skipped") > 0))


def check_sheets(summary: DataFrame) -> None:
    """Raise when no sheet is left or a sheet failed as a whole."""
    n = summary.agg(F.count("*").alias("sheets"), F.count_if("failed").alias("failed"), F.min(F.when(F.col("failed"), F.col("sheet"))).alias("name")).first()
    if n.sheets == 0:
        raise ValueError("every sheet was excluded or the workbook holds none")
    if n.failed:
        raise ValueError(f"all data rows failed in {n.failed} sheet(s), e.g. {n.name!r}")


def kept_rows(typed: DataFrame) -> DataFrame:
    return typed.filter(~F.col("skipped")).drop("skipped")


def header_inventory(cells: DataFrame, header_row: int = 1, excludes: tuple[str, ...] = ()) -> DataFrame:
    """Distinct text headers per file, at their first place: `file, sheet, col, header, name, valid`."""
    found = exclude_sheets(cells, excludes).filter((F.col("row") == header_row) & (F.col("kind") == "string"))
    found = found.select("file", "sheet", "col", strip(F.col("s")).alias("header")).filter(F.col("header") != "")
    first = found.groupBy("file", "header").agg(F.min(F.struct("sheet", "col")).alias("at"))
    named = first.select("file", "at.sheet", "at.col", "header", snake_case(F.col("header")).alias("name"))
    return named.withColumn("valid", F.col("name").rlike(r"^[a-z0-9_]*\z"))


def sheet_preview(cells: DataFrame, header_row: int = 1, excludes: tuple[str, ...] = ()) -> DataFrame:
    """Header row and the two rows below it as one text line each: `file, sheet, row, line`."""
    rows = exclude_sheets(cells, excludes).filter(F.col("row").between(header_row, header_row + 2))
    cell = F.struct("col", F.coalesce(cell_text(cell_struct()), F.lit("")).alias("text"))
    # Three rows per sheet, each as wide as the sheet.
    lines = rows.groupBy("file", "sheet", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return lines.select("file", "sheet", "row", F.array_join(F.transform("cells", lambda c: c["text"]), " | ").alias("line"))


def sheet_lines(rows: DataFrame, columns: tuple[ColumnMapping, ...]) -> DataFrame:
    """Typed rows as JSON text `value`: `_source` first, then the fields; empty address columns left out."""
    source = F.struct("file", "sheet", "row_index", "sheettype").alias("_source")
    fields = [F.transform(c.name, cidr_text).alias(c.name) if c.type == "addresses" else F.col(c.name) for c in columns]
    return rows.select(F.to_json(F.struct(source, *fields)).alias("value"))
