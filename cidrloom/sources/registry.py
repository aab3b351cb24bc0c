"""Landed registry responses (object text and JSON bodies) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.functions.ip import inetnum_to_net, let, parse_cidr, strip
from cidrloom.sources import schemas


def _value(block: Column, key: str, start: str = "") -> Column:
    """Trimmed first value of `key` in a block of `key: value` lines; null when the key is absent."""
    pattern = rf"(?m)^{start}{key}[ \t]*:(.*)$"
    return F.when(block.rlike(pattern), strip(F.regexp_extract(block, pattern, 1)))


def _blocks(text: Column) -> Column:
    """Blocks between blank lines, without comment lines."""
    unix = F.regexp_replace(text, "\r\n", "\n")
    blocks = F.split(unix, r"\n\s*\n")
    def clean(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda line: ~line.rlike("^[%#]") & (F.trim(line) != ""))
        return F.array_join(lines, "\n")
    return F.transform(blocks, clean)


def parse_rpsl(df: DataFrame, text: str) -> DataFrame:
    """One row per network object of a response: the input columns but `text`, `block` and `whois`.

    A block counts from its first inetnum / inet6num line and needs a netname.  The first value of a key wins;
    descr takes its continuation lines.
    """
    keep = [c for c in df.columns if c != text]
    blocks = df.select(*keep, F.posexplode(_blocks(F.col(text))).alias("block", "_b"))
    tail = F.regexp_extract("_b", r"(?ms)^(?:inetnum|inet6num)[ \t]*:.*", 0)
    blocks = blocks.withColumn("_t", tail).filter(F.col("_t") != "")
    t = F.col("_t")
    descr_pattern = r"(?m)^descr[ \t]*:(.*(?:\n[ \t].*)*)"
    lines = F.transform(F.split(F.regexp_extract(t, descr_pattern, 1), "\n"), strip)
    whois = F.struct(
        _value(t, "(?:inetnum|inet6num)").alias("inetnum"),
        _value(t, "netname").alias("netname"),
        F.when(t.rlike(descr_pattern), F.array_join(lines, " ")).alias("descr"),
        _value(t, "country").alias("country"),
        _value(t, "source").alias("source"),
        _value(t, "last-modified").alias("last_modified"),
        *[F.lit(None).cast("string").alias(c) for c in ("as_num", "as_name", "as_descr")],
    )
    return blocks.select(*keep, "block", whois.alias("whois")).filter(F.col("whois.netname").isNotNull())


def parse_aut_num(df: DataFrame, text: str) -> DataFrame:
    """First AS object of a response: `aut_num, as_name, descr`; rows without both names go."""
    keep = [c for c in df.columns if c != text]
    pad = r"[ \t]*"
    objects = F.filter(_blocks(F.col(text)), lambda b: b.rlike(r"(?m)^[ \t]*aut-num[ \t]*:"))
    rows = df.select(*keep, F.get(objects, 0).alias("_b"))
    rows = rows.withColumn("_t", F.regexp_extract("_b", r"(?ms)^[ \t]*aut-num[ \t]*:.*", 0))
    t = F.col("_t")
    out = rows.select(*keep, _value(t, "aut-num", pad).alias("aut_num"), _value(t, "as-name", pad).alias("as_name"), _value(t, "descr", pad).alias("descr"))
    return out.filter(F.col("aut_num").isNotNull() & F.col("as_name").isNotNull())


def parse_delegation(df: DataFrame, text: str) -> DataFrame:
    """Delegation of a response: `block` prefix and `refer` host; `block` is set only when both are there."""
    keep = [c for c in df.columns if c != text]
    t = F.regexp_replace(F.col(text), "\r\n", "\n")
    nets = F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*(?:inetnum|inet6num)[ \t]*:(.*)$"), 1), lambda v: inetnum_to_net(strip(v)))
    hosts = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*refer[ \t]*:(.*)$"), 1), strip), lambda v: v != "")
    refer = F.get(hosts, 0)
    block = F.get(F.filter(nets, lambda n: n.isNotNull()), 0)
    return df.select(*keep, F.when(refer.isNotNull(), block).alias("block"), refer.alias("refer"))


def _first(pairs: Column, *keys: str) -> Column:
    return F.get(F.filter(pairs, lambda kv: kv["key"].isin(*keys)), 0)["value"]


def registry_records(df: DataFrame, body: str) -> DataFrame:
    """Network objects of a JSON body, one row each: first value per key; needs inetnum and netname."""
    keep = [c for c in df.columns if c != body]
    rows = df.select(*keep, F.posexplode(F.from_json(body, schemas.REGISTRY_RECORDS)["data"]["records"]).alias("block", "_r"))
    r = F.col("_r")
    whois = F.struct(
        _first(r, "inetnum", "inet6num").alias("inetnum"),
        _first(r, "netname").alias("netname"),
        _first(r, "descr").alias("descr"),
        _first(r, "country").alias("country"),
        _first(r, "source").alias("source"),
        _first(r, "last-modified").alias("last_modified"),
        *[F.lit(None).cast("string").alias(c) for c in ("as_num", "as_name", "as_descr")],
    )
    out = rows.select(*keep, "block", whois.alias("whois"))
    return out.filter(F.col("whois.inetnum").isNotNull() & F.col("whois.netname").isNotNull())


def announced_prefixes(df: DataFrame, body: str) -> DataFrame:
    """Announced prefixes of a JSON body, one row each; bad ones skipped."""
    keep = [c for c in df.columns if c != body]
    rows = df.select(*keep, F.posexplode(F.from_json(body, schemas.REGISTRY_PREFIXES)["data"]["prefixes"]["prefix"]).alias("pos", "prefix"))
    return rows.withColumn("net", parse_cidr(F.col("prefix"))).filter(F.col("net").isNotNull())


def origin_asn(df: DataFrame, body: str) -> DataFrame:
    """First origin AS number of a JSON body, null when there is none."""
    keep = [c for c in df.columns if c != body]
    return df.select(*keep, F.get(F.from_json(body, schemas.REGISTRY_ASNS)["data"]["asns"], 0).alias("asn"))


def aut_num_from_json(df: DataFrame, body: str) -> DataFrame:
    """AS object from the first record of a JSON body; rows without both names go."""
    keep = [c for c in df.columns if c != body]
    first = F.get(F.from_json(body, schemas.REGISTRY_RECORDS)["data"]["records"], 0)
    rows = df.select(*keep, first.alias("_r"))
    r = F.col("_r")
    out = rows.select(*keep, _first(r, "aut-num").alias("aut_num"), _first(r, "as-name").alias("as_name"), _first(r, "descr").alias("descr"))
    return out.filter(F.col("aut_num").isNotNull() & F.col("as_name").isNotNull())
