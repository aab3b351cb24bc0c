"""Inventory rows matched to ranges.

Sheet rows are `ord, source, fields VARIANT`; the first row by `ord` wins.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import parse_cidr
from cidrloom.functions.patterns import PTR_FIELDS, Normalizer, normalize
from cidrloom.operators.prefix import first_related
from cidrloom.operators.skew import join_to_unique
from cidrloom.session import cut_lineage
from cidrloom.sources.readers import sheet_row_cidrs


def _clean(name: str, value: Column, normalizers: dict[str, Normalizer]) -> Column:
    return normalize(normalizers[name], value) if name in normalizers else value


def _key(names: tuple[str, ...], values: dict[str, Column]) -> Column:
    """Composite key: which fields take part, and their values."""
    return F.struct(F.lit(",".join(names)).alias("fields"), F.array(*[values[n] for n in names]).alias("values"))


def _subsets(names: list[str]) -> list[tuple[str, ...]]:
    return [c for n in range(1, len(names) + 1) for c in combinations(names, n)]


def sheet_ptr_keys(rows: DataFrame, ptr_columns: dict[str, str], normalizers: dict[str, Normalizer]) -> DataFrame:
    """`key, first, matches`: sheet rows summed up by the device fields they carry.

    `ptr_columns` maps a sheet column to a device field.  Two columns of one field must agree,
    otherwise the row cannot match anything.
    """
    by_field: dict[str, list[str]] = {}
    for column, name in ptr_columns.items():
        by_field.setdefault(name, []).append(column)
    names = [f for f in PTR_FIELDS if f in by_field]

    def text(column: str) -> Column:
        path = "$['" + column.replace("'", "\\'") + "']"
        v = F.try_variant_get("fields", path, "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("fields", path, "string"))

    columns = [c for n in names for c in by_field[n]]
    raw = {c: F.col(f"_raw{i}") for i, c in enumerate(columns)}
    rows = rows.filter(F.col("source.sheettype") != "hosting").select("ord", *[text(c).alias(f"_raw{i}") for i, c in enumerate(columns)])
    # Long rule chains run once per combination of texts, not once per row and use.
    rows = rows.groupBy(*raw.values()).agg(F.min("ord").alias("first"), F.count("*").alias("matches"))
    seen = {n: F.array_distinct(F.filter(F.array(*[_clean(n, raw[c], normalizers) for c in by_field[n]]), lambda v: v.isNotNull())) for n in names}
    rows = cut_lineage(rows.select("first", "matches", *[seen[n].alias(n) for n in names]))
    for n in names:
        rows = rows.filter(F.size(n) <= 1)
    present = F.concat_ws(",", *[F.when(F.size(n) == 1, F.lit(n)) for n in names])
    values = F.concat(*[F.col(n) for n in names])
    keyed = rows.select("first", "matches", F.struct(present.alias("fields"), values.alias("values")).alias("key")).filter(F.col("key.fields") != "")
    return keyed.groupBy("key").agg(F.min("first").alias("first"), F.sum("matches").alias("matches"))


def match_by_ptr(gateways: DataFrame, keys: DataFrame, fields: list[str], normalizers: dict[str, Normalizer]) -> DataFrame:
    """`range, first, matches`: ranges whose device equals every device field a sheet row carries.

    A device offers one key per non-empty subset of its fields; all subsets meet the summed-up sheet
    keys in one hash join.
    """
    names = [f for f in PTR_FIELDS if f in fields]
    values = {n: _clean(n, F.col(f"gateway.device.{n}"), normalizers) for n in names}
    flat = gateways.filter(F.col("gateway.device").isNotNull()).select("range", *[values[n].alias(n) for n in names])
    flat = cut_lineage(flat)
    cols = {n: F.col(n) for n in names}
    offers = []
    for subset in _subsets(names):
        complete = F.lit(True)
        for n in subset:
            complete = complete & cols[n].isNotNull()
        offers.append(F.when(complete, _key(subset, cols)))
    offered = flat.select("range", F.explode(F.filter(F.array(*offers), lambda k: k.isNotNull())).alias("key"))
    hits = join_to_unique(offered, keys, ["key"]).filter(F.col("first").isNotNull())
    return hits.groupBy("range").agg(F.min("first").alias("first"), F.sum("matches").alias("matches"))


def match_related(ranges: DataFrame, cidrs: DataFrame) -> DataFrame:
    """`range, first, matches`: first backbone row with a network above or below the range."""
    keyed = ranges.select("range", parse_cidr(F.col("range")).alias("_r")).filter(F.col("_r").isNotNull())
    nets = cidrs.filter(F.col("source.sheettype") != "hosting").select("net", "ord")
    found = first_related(keyed, "_r", nets, "net", "ord")
    return keyed.join(found, "_r").select("range", "first", "matches")


def match_exact(ranges: DataFrame, cidrs: DataFrame) -> DataFrame:
    """`range, first, matches`: first hosting row that lists the range exactly as written."""
    keyed = ranges.select("range", parse_cidr(F.col("range")).alias("net")).filter(F.col("net").isNotNull())
    nets = cidrs.filter(F.col("source.sheettype") == "hosting")
    summed = nets.groupBy("net").agg(F.min("ord").alias("first"), F.count("*").alias("matches"))
    return keyed.join(summed, "net").select("range", "first", "matches")


def attach_matches(
    gateways: DataFrame, rows: DataFrame, ptr_columns: dict[str, str], normalizers: dict[str, Normalizer]
) -> DataFrame:
    """Add `xlsx MAP<sheettype, row VARIANT>` (null when nothing matches) and the match counts.

    Backbone: by device first, then by containment for the ranges left; hosting: exact.  Only row
    ordinals travel through the joins; rows are fetched for the winners at the end.  Tables that are
    read several times are written once.
    """
    gateways, rows = cut_lineage(gateways), cut_lineage(rows)
    cidrs = cut_lineage(sheet_row_cidrs(rows))
    fields = [f for f in PTR_FIELDS if f in ptr_columns.values()]
    related = match_related
    if fields:
        keys = cut_lineage(sheet_ptr_keys(rows, ptr_columns, normalizers))
        by_ptr = cut_lineage(match_by_ptr(gateways, keys, fields, normalizers))
        rest = gateways.join(by_ptr, "range", "left_anti")
        backbone = by_ptr.unionByName(related(rest, cidrs))
    else:
        backbone = related(gateways, cidrs)
    hosting = match_exact(gateways, cidrs)
    picked = gateways.join(backbone.select("range", F.col("first").alias("_b"), F.col("matches").alias("backbone_matches")), "range", "left")
    picked = picked.join(hosting.select("range", F.col("first").alias("_h"), F.col("matches").alias("hosting_matches")), "range", "left")
    picked = cut_lineage(picked)
    table = rows.select(F.col("ord"), F.col("fields"))
    picked = join_to_unique(picked, table.select(F.col("ord").alias("_b"), F.col("fields").alias("_brow")), ["_b"])
    picked = cut_lineage(picked)
    picked = join_to_unique(picked, table.select(F.col("ord").alias("_h"), F.col("fields").alias("_hrow")), ["_h"])
    entries = F.filter(
        F.array(
            F.when(F.col("_b").isNotNull(), F.struct(F.lit("backbone").alias("key"), F.col("_brow").alias("value"))),
            F.when(F.col("_h").isNotNull(), F.struct(F.lit("hosting").alias("key"), F.col("_hrow").alias("value"))),
        ),
        lambda e: e.isNotNull(),
    )
    flags = F.struct(F.col("_b").isNotNull().alias("backbone"), F.col("_h").isNotNull().alias("hosting"))
    out = picked.withColumn("xlsx", F.when(F.size(entries) > 0, F.map_from_entries(entries))).withColumn("xlsx_matched", flags)
    return out.drop("_b", "_h", "_brow", "_hrow")
