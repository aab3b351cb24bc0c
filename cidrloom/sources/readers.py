"""Line-oriented readers.  Files are read as text and parsed with explicit schemas, so that required
fields are enforced and bad lines can be counted or made fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cidrloom.functions.ip import cidr_text, parse_cidr
from cidrloom.functions.jsontext import canonical
from cidrloom.sources import schemas
from cidrloom.sources.arrays import read_array

BAD = "_bad"


def parse_lines(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Parse a text column `value` holding one JSON object per line; `_bad` marks lines that fail.

    A line fails when it is not JSON, a field has another type, or a required field is missing.
    Blank lines are dropped.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = lines.filter(F.trim("value") != "").withColumn(
        "_row", F.from_json("value", f"{schema}, _corrupt string", options)
    )
    bad = F.col("_row").isNull() | F.col("_row._corrupt").isNotNull()
    for path in required:
        bad = bad | F.col(f"_row.{path}").isNull()
    return rows.select(*[c for c in lines.columns if c != "value"], "_row.*", bad.alias(BAD), F.col("value").alias("_line")).drop("_corrupt")


def good_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col(BAD)).drop(BAD, "_line")


def strict_lines(parsed: DataFrame, what: str) -> DataFrame:
    """Same rows, but the first bad line fails the job."""
    error = F.raise_error(F.concat(F.lit(f"bad {what} line: "), F.col("_line"))).cast("boolean")
    return parsed.filter(F.when(F.col(BAD), error).otherwise(True)).drop(BAD, "_line")


def bad_line_count(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("lines"), F.count_if(F.col(BAD)).alias("bad_lines"))


def _text(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a unique `line_id` and their place in the input as `line_ord` (file, split start, line).

    Both come straight off the scan, so a retried task gives the same values.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    lines = lines.withColumn("line_id", F.monotonically_increasing_id())
    place = F.struct("file_path", "file_block_start", "line_id").alias("line_ord")
    return lines.select("value", "line_id", place)


def parse_trace_lines(lines: DataFrame) -> DataFrame:
    required = ["range", "routes.version", "routes.measured_at", "routes.source", "routes.destination", "routes.stop_reason", "routes.hops"]
    parsed = parse_lines(lines, schemas.TRACE_LINE, required)
    return parsed.withColumn(BAD, F.col(BAD) | F.coalesce(F.exists("routes.hops", lambda h: h["hop"].isNull()), F.lit(False)))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """`trace_id, range, version, measured_at, source, destination, stop_reason, hops`; bad lines skipped."""
    good = good_lines(parse_trace_lines(_text(spark, path)))
    return good.select(F.col("line_id").alias("trace_id"), "range", "routes.*")


def parse_whois_lines(lines: DataFrame) -> DataFrame:
    return parse_lines(lines, schemas.WHOIS_LINE, ["network", "whois.inetnum", "whois.netname"])


def read_whois(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """`network, net, whois`.  Lenient: bad lines and networks go, the last line of a network wins."""
    parsed = parse_whois_lines(_text(spark, path))
    if strict:
        return strict_lines(parsed, "registry").select("network", parse_cidr(F.col("network")).alias("net"), "whois")
    rows = good_lines(parsed).withColumn("net", parse_cidr(F.col("network"))).filter(F.col("net").isNotNull())
    last = rows.groupBy("net").agg(F.max_by(F.struct("network", "whois"), "line_ord").alias("r"))
    return last.select("r.network", "net", "r.whois")


def json_value(text: Column) -> Column:
    """JSON text as VARIANT, null when it is none; of repeated keys the last value is kept, at every depth."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(canonical(text)))


def bad_json_count(lines: DataFrame) -> DataFrame:
    """`lines, bad_lines` of a text column `value`: what the sheet and log readers skip, blank lines apart."""
    text = lines.filter(F.trim("value") != "")
    return text.agg(F.count("*").alias("lines"), F.count_if(canonical(F.col("value")).isNull()).alias("bad_lines"))


def parse_sheet_lines(lines: DataFrame) -> DataFrame:
    """Text column `value` plus `line_ord` to `ord, source, fields VARIANT`; lines that are no object go."""
    record = lines.withColumn("fields", json_value(F.col("value")))
    record = record.filter(F.schema_of_variant("fields").startswith("OBJECT"))

    def text(key: str) -> Column:
        v = F.try_variant_get("fields", f"$._source.{key}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("fields", f"$._source.{key}", "string"))

    file, sheet = F.coalesce(text("file"), F.lit("")), F.coalesce(text("sheet"), F.lit(""))
    row = F.coalesce(F.try_variant_get("fields", "$._source.row_index", "bigint"), F.lit(0)).cast("bigint")
    kind = F.when(text("sheettype") == "hosting", "hosting").otherwise("backbone")
    source = F.struct(file.alias("file"), sheet.alias("sheet"), row.alias("row_index"), kind.alias("sheettype"))
    rows = record.select(source.alias("source"), "fields", "line_ord")
    order = F.struct("source.file", "source.sheet", "source.row_index", "line_ord")
    return rows.select(order.alias("ord"), "source", "fields")


def read_sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    return parse_sheet_lines(_text(spark, path))


def sheet_row_cidrs(rows: DataFrame) -> DataFrame:
    """Every CIDR text in any array field of a sheet row, repeats kept: `ord, source, net, network`."""
    spark = rows.sparkSession
    items = spark.sql(
        """
        SELECT r.ord, r.source, variant_get(item.value, '$', 'string') AS text
        FROM {rows} r,
             LATERAL variant_explode(r.fields) f,
             LATERAL variant_explode(CASE WHEN schema_of_variant(f.value) LIKE 'ARRAY%' THEN f.value END) item
        WHERE f.key <> '_source' AND schema_of_variant(item.value) = 'STRING'
        """,
        rows=rows,
    )
    nets = items.withColumn("net", parse_cidr(F.col("text"))).filter(F.col("net").isNotNull())
    return nets.select("ord", "source", "net", cidr_text(F.col("net")).alias("network"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """`log_id, record` (canonical JSON text).  `.jsonl`: one value per line, blank and bad lines skipped; else one JSON array."""
    if not path.lower().endswith(".jsonl"):
        return read_array(spark, path)
    parsed = _text(spark, path).withColumn("record", canonical(F.col("value")))
    return parsed.filter(F.col("record").isNotNull()).select(F.col("line_id").alias("log_id"), "record")


def read_gateways(spark: SparkSession, path: str) -> DataFrame:
    """Gateway records; blank lines are skipped and the first bad line fails the job."""
    return strict_lines(parse_lines(_text(spark, path), schemas.GATEWAY_LINE, ["range", "gateway.status"]), "gateway").drop("line_id")
