"""Dynamic JSON records: field inventory, display text, dotted paths, typed projection.

Records are canonical JSON text (`jsontext`) or VARIANT columns.  Object keys come in sorted order.  Each function is one
pass inside the row: no job runs while a plan is made, nothing is shuffled, and streams may use it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import let
from cidrloom.functions.jsontext import nodes, quoted, record_text, unquoted


@dataclass(frozen=True)
class ProjectedField:
    """One output field: dotted path, optional output name, type auto | string | integer | bool | array_join."""

    field: str
    output_name: str | None = None
    type: str = "auto"


def json_path(dotted: str, whole: bool = False) -> str:
    """`a.b` to a quoted JSON path of object keys; `whole` takes the text as one key."""
    keys = [dotted] if whole else dotted.split(".")
    return "$" + "".join("['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" for key in keys)


def get_by_path(record: Column, dotted: str) -> Column:
    """Follow object keys split on dots; null when a key is missing."""
    return F.try_variant_get(record, json_path(dotted), "variant")


def type_tag(value: Column) -> Column:
    """string | number | bool | list | object | null of a VARIANT value."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "list")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "VOID", "null")
        .otherwise("number")
    )


def text_of(df: DataFrame, record: str) -> Column:
    return record_text(F.col(record), df.schema[record].dataType.simpleString())


def flatten_fields(df: DataFrame, record: str, keep: list[str]) -> DataFrame:
    """All nodes as `keep..., ord, path, type_tag, value`; objects are listed, then entered, whatever their depth.

    A root that is no object is one node with an empty path.  `ord` sorts the nodes of a record in walk order, `value` is
    JSON text, null for objects.
    """
    found = df.select(*keep, F.posexplode(nodes(text_of(df, record))).alias("ord", "n"))
    return found.select(*keep, "ord", "n.path", "n.type_tag", "n.value")


def scalar_text(value: Column) -> Column:
    """String, number, bool and null as text; arrays and objects as an empty string."""
    tag = type_tag(value)
    return (
        F.when(tag == "null", "null")
        .when(tag.isin("list", "object"), "")
        .when(tag == "number", _number_json(value))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def _number_json(value: Column) -> Column:
    return F.to_json(value)


def display_text(tag: Column, value: Column) -> Column:
    """Leaf as shown to people: strings bare, null as `null`, arrays joined by comma and blank."""
    items = F.array_join(F.from_json(value, "array<string>"), ", ", "null")
    return F.when(tag == "list", items).when(tag == "string", unquoted(value)).otherwise(value)


def flatten_display(df: DataFrame, record: str, keep: list[str]) -> DataFrame:
    """Leaves as `keep..., ord, key, text`; objects without keys give nothing."""
    leaves = flatten_fields(df, record, keep).filter(F.col("type_tag") != "object")
    return leaves.select(*keep, "ord", F.col("path").alias("key"), display_text(F.col("type_tag"), F.col("value")).alias("text"))


def coerce(value: Column, to: str, array_sep: str = ", ") -> Column:
    """Typed VARIANT; a value that cannot be converted is kept as it is."""
    def convert(v: Column) -> Column:
        tag = type_tag(v)
        text = F.try_variant_get(v, "$", "string")
        as_string = F.when(tag == "string", text)
        if to == "auto":
            return v
        if to == "string":
            return _variant(scalar_text(v))
        if to == "integer":
            integral = F.schema_of_variant(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
            number = F.when(integral & F.to_json(v).rlike("^-?[0-9]+$"), F.try_variant_get(v, "$", "bigint")).when(
                as_string.rlike(r"^[+-]?[0-9]+\z"), as_string.try_cast("bigint")
            )
            return F.when(number.isNotNull(), _variant(number)).otherwise(v)
        if to == "bool":
            low = F.lower(as_string)
            flag = (
                F.when(tag == "bool", F.try_variant_get(v, "$", "boolean"))
                .when(low.isin("true", "1", "yes"), True)
                .when(low.isin("false", "0", "no"), False)
            )
            return F.when(flag.isNotNull(), _variant(flag)).otherwise(v)
        if to == "array_join":
            items = F.try_variant_get(v, "$", "array<variant>")
            flat = (tag == "list") & ~F.exists(items, lambda e: F.coalesce(type_tag(e) == "object", F.lit(False)))
            joined = F.array_join(F.transform(items, lambda e: F.coalesce(scalar_text(e), F.lit("null"))), array_sep)
            return F.when(flat, _variant(joined)).otherwise(v)
        raise ValueError(f"unknown field type {to!r}")

    return let(value, convert)


def _variant(scalar: Column) -> Column:
    return scalar.cast("variant")


def coerce_text(tag: Column, value: Column, to: str, array_sep: str = ", ") -> Column:
    """`coerce` of a node, JSON text to JSON text, so that numbers stay as they are written."""
    content = unquoted(value)
    if to == "auto":
        return value
    if to == "string":
        return F.when(tag == "string", value).when(tag == "list", '""').otherwise(F.concat(F.lit('"'), value, F.lit('"')))
    if to == "integer":
        number = F.when(tag == "number", F.when(value.rlike("^-?[0-9]+$"), value.try_cast("bigint"))).when(
            (tag == "string") & content.rlike(r"^[+-]?[0-9]+\z"), content.try_cast("bigint"))
        return F.coalesce(number.cast("string"), value)
    if to == "bool":
        low = F.when(tag == "string", F.lower(content))
        return F.when(low.isin("true", "1", "yes"), "true").when(low.isin("false", "0", "no"), "false").otherwise(value)
    if to == "array_join":
        kinds = F.transform(F.from_json(value, "array<variant>"), lambda v: F.coalesce(type_tag(v), F.lit("null")))
        texts = F.zip_with(F.from_json(value, "array<string>"), kinds, lambda t, k: F.when(k == "list", "").otherwise(F.coalesce(t, F.lit("null"))))
        flat = (tag == "list") & ~F.array_contains(kinds, "object")
        return F.when(flat, quoted(F.array_join(texts, array_sep))).otherwise(value)
    raise ValueError(f"unknown field type {to!r}")


def node_at(text: Column, dotted: str) -> Column:
    """`struct<type_tag, value>` of the node at a dotted path of canonical text; null when a key is missing."""
    found = F.filter(nodes(text), lambda n: (n["path"] == dotted) & (n["depth"] == dotted.count(".") + 1))
    whole = F.get_json_object(text, json_path(dotted))
    return let(F.get(found, F.lit(0)), lambda n: F.when(n.isNotNull(), F.struct(n["type_tag"].alias("type_tag"), F.when(n["type_tag"] == "object", whole).otherwise(n["value"]).alias("value"))))


def projected(text: Column, fields: list[ProjectedField], array_sep: str = ", ") -> Column:
    """Flat projection of canonical text as `array<struct<name, value>>` sorted by name; `value` is JSON text.

    A path that names an object expands to its leaves under the output name, except leaves that are listed themselves; a
    later field of the same name replaces an earlier one; missing paths give no entry.
    """
    listed = [f.field for f in fields]

    def reachable(n: Column) -> Column:
        # A key that itself holds a dot cannot be reached by a dotted path.
        return (n["type_tag"] != "object") & (n["depth"] == F.size(F.split(n["path"], r"\.")))

    def entries_of(leaves: Column, f: ProjectedField) -> Column:
        def fits(n: Column) -> Column:
            return (n["path"] == f.field) | (n["path"].startswith(f.field + ".") & ~n["path"].isin(listed))

        def entry(n: Column) -> Column:
            name = F.concat(F.lit(f.output_name or f.field), F.substring(n["path"], F.lit(len(f.field) + 1), F.length(n["path"])))
            return F.struct(name.alias("name"), coerce_text(n["type_tag"], n["value"], f.type, array_sep).alias("value"))

        return F.transform(F.filter(leaves, fits), entry)

    def picked(leaves: Column) -> Column:
        return F.concat(*[entries_of(leaves, f) for f in fields])

    def last(entries: Column) -> Column:
        again = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["name"] == e["name"])
        return F.array_sort(F.filter(entries, lambda e, i: ~again(e, i)))

    return let(let(F.filter(nodes(text), reachable), picked), last)


def project_text(text: Column, fields: list[ProjectedField], array_sep: str = ", ") -> Column:
    """`projected` as JSON text; a record without any listed field gives `{}`."""
    members = F.transform(projected(text, fields, array_sep), lambda e: F.concat(quoted(e["name"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def project_fields(df: DataFrame, record: str, key: str, fields: list[ProjectedField], array_sep: str = ", ") -> DataFrame:
    """Flat projection as a long table `key, name, value`, one row per output field; `value` is JSON text."""
    rows = df.select(key, F.explode(projected(text_of(df, record), fields, array_sep)).alias("p"))
    return rows.select(key, "p.name", "p.value")


def project_record(df: DataFrame, record: str, key: str, fields: list[ProjectedField], array_sep: str = ", ") -> DataFrame:
    """Flat projection as `key, record`, one JSON object text per record."""
    return df.select(key, project_text(text_of(df, record), fields, array_sep).alias("record"))
