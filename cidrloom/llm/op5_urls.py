"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule accepts or rejects train two variable-order Markov models (orders 0 to `ORDER`, Witten-Bell smoothed:
each order backs off to the next shorter context). A URL without a rule is judged by the difference of its
log-likelihoods divided by its length; the threshold is calibrated on ruled URLs that were left out of the counts.

The models are tables, exact and without a bound on contexts: a gram is a context of up to `ORDER` bytes and the byte
after it, packed in one integer with its order. Counts cover every ruled URL outside the calibration fold. Only the
distinct grams of the URLs that are to be judged are looked up and smoothed, order by order, so a join meets at most 256
rows under one context; URLs then meet the log ratios of their grams, where frequent grams are spread. Log ratios are
summed as integers, so that no order of rows changes a score. URLs that differ only in digits, scheme or query are one text.

Defined cases: a null URL or one without `://` has an empty host and path and no evidence (score 0, judged against the
threshold like others); with no ruled URL in one class both models agree and everything is allowed; repeated rows and
ids each give a row; an empty table gives no rows; very long URLs are counted in pieces, whole; other columns, whatever
their names, are ignored. Each input row gives one output row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.llm import kit
from cidrloom.operators.skew import join_counted, join_to_unique

ORDER = 5  # a gram of this order has 48 bits; its order stands above them
TAG = 48
PIECE = 200_000  # bytes whose grams are counted at once
SCALE = 1 << 30  # log ratios are integers in this unit
FOLDS = 5  # fold 0 calibrates, the others count
BINS = 2000  # of the calibration histogram, over score differences from -10 to 10

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null when none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _letters(pages: DataFrame) -> DataFrame:
    """Digits say nothing about a site: all become 0."""
    return pages.withColumn("_letters", F.regexp_replace(F.concat("_host", "_path"), "[0-9]", "0"))


def name_of(letters: Column) -> Column:
    return F.unhex(F.md5(letters))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per text of `rows` (`_letters`, `_said`: allow, block or null, `_fold`): `name, letters` and the numbers of
    rows that train the two models (`a`, `b`), that calibrate (`cal_a`, `cal_b`) and that have no rule (`m`)."""
    count = lambda said, fold: F.sum(F.when((F.col("_said") == said) & fold, 1).otherwise(0))
    trains = F.col("_fold") != 0
    by = rows.groupBy(F.col("_letters").alias("letters")).agg(
        count("allow", trains).alias("a"), count("block", trains).alias("b"), count("allow", ~trains).alias("cal_a"),
        count("block", ~trains).alias("cal_b"), F.sum(F.when(F.col("_said").isNull(), 1).otherwise(0)).alias("m"))
    return by.select(name_of(F.col("letters")).alias("name"), "*")


def packed(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte at each place with the `ORDER` bytes before it, nearest lowest; 255, no byte of UTF-8, before the text."""
    inside = np.arange(len(raw)) - at[:-1][kit.rows_of(at)]
    out = raw.astype(np.int64)
    for back in range(1, ORDER + 1):
        before = np.full(len(raw), 255, np.int64)
        before[back:] = raw[:-back]
        before[inside < back] = 255
        out |= before << (8 * back)
    return out


def _orders(full: np.ndarray) -> np.ndarray:
    """The grams of all orders that end at each place, one row per order."""
    return np.stack([(full & ((1 << 8 * (k + 1)) - 1)) | (k << TAG) for k in range(ORDER + 1)])


def count_grams(urls: DataFrame) -> DataFrame:
    """`gram, a, b`: how often each gram occurs in accepted and in rejected URLs."""

    def count(batches):
        for part, raw, at in kit.blocks(batches, "letters"):
            full, row = packed(raw, at), kit.rows_of(at)
            weights = [part.column(i).to_numpy(zero_copy_only=False)[row] for i in (1, 2)]
            for lo in range(0, len(full), PIECE):
                grams, inverse = np.unique(_orders(full[lo : lo + PIECE]), return_inverse=True)
                sums = [np.bincount(inverse.ravel(), np.tile(w[lo : lo + PIECE], ORDER + 1)).astype(np.int64) for w in weights]
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(sums[0]), pa.array(sums[1])], names=["gram", "a", "b"])

    counted = urls.filter("a + b > 0").select("letters", "a", "b").mapInArrow(count, "gram long, a long, b long")
    return counted.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def ratios(asked: DataFrame, model: DataFrame, tables: kit.Tables) -> DataFrame:
    """`gram, ratio`: the log ratio of accepted to rejected probability, in units of 1 / SCALE, of the longest grams.

    `asked`: distinct `gram`s, with each gram all shorter ones that end like it. `model`: the counts.
    """
    context = F.shiftright("gram", 8).alias("context")
    contexts = model.groupBy(context).agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"), F.count_if(F.col("a") > 0).alias("kinds_a"), F.count_if(F.col("b") > 0).alias("kinds_b"))
    known = tables.keep(asked.select("gram", context).join(contexts, "context", "left").join(model, "gram", "left").drop("context").fillna(0), "grams")

    def smoothed(c: str, below: Column) -> Column:
        weight = F.col(f"all_{c}") + F.col(f"kinds_{c}")
        return F.when(weight > 0, (F.col(c) + F.col(f"kinds_{c}") * below) / weight).otherwise(below).alias(f"p_{c}")

    of = lambda k: known.filter((F.col("gram") >= k << TAG) & (F.col("gram") < (k + 1) << TAG))
    p = of(0).select("gram", *[smoothed(c, F.lit(1 / 256)) for c in "ab"])
    for k in range(1, ORDER + 1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)) + F.lit((k - 1) << TAG)
        below = p.select(F.col("gram").alias("shorter"), F.col("p_a").alias("q_a"), F.col("p_b").alias("q_b"))
        p = of(k).withColumn("shorter", shorter).join(below, "shorter").select("gram", *[smoothed(c, F.col(f"q_{c}")) for c in "ab"])
    out = tables.keep(p.select("gram", F.round((F.log("p_a") - F.log("p_b")) * SCALE).cast("long").alias("ratio")), "ratios")
    tables.drop(known)
    return out


def scores(urls: DataFrame, tables: kit.Tables) -> DataFrame:
    """`name, score` of the texts that have no rule or calibrate: the mean over their bytes of the log ratio."""

    def distinct_grams(batches):
        for _, raw, at in kit.blocks(batches, "letters"):
            full = packed(raw, at)
            for lo in range(0, len(full), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_orders(full[lo : lo + PIECE])))], names=["gram"])

    def longest_grams(batches):
        for part, raw, at in kit.blocks(batches, "letters"):
            full, row = packed(raw, at) | (ORDER << TAG), kit.rows_of(at)
            for lo in range(0, len(full), PIECE):
                names = part.column(0).take(pa.array(row[lo : lo + PIECE]))
                yield pa.RecordBatch.from_arrays([names, pa.array(full[lo : lo + PIECE])], names=["name", "gram"])

    texts = urls.filter("m + cal_a + cal_b > 0").select("name", "letters")
    model = tables.keep(count_grams(urls), "model")
    ratio = ratios(texts.select("letters").mapInArrow(distinct_grams, "gram long").distinct(), model, tables)
    tables.drop(model)
    met = join_to_unique(texts.mapInArrow(longest_grams, "name binary, gram long"), ratio, ["gram"])
    out = tables.keep(met.groupBy("name").agg((F.sum("ratio") / F.count("*") / SCALE).alias("score")), "scores")
    tables.drop(ratio)
    return out


def calibrated(urls: DataFrame, score: DataFrame) -> float:
    """The threshold with the best balanced accuracy over the calibration rows, in the middle of its plateau; 0 without both classes."""
    step = F.floor((F.coalesce("score", F.lit(0.0)) + 10) * (BINS / 20)).cast("int")
    left_out = urls.filter("cal_a + cal_b > 0").join(score, "name", "left").groupBy(F.least(F.greatest(step, F.lit(0)), F.lit(BINS - 1)).alias("bin"))
    histogram = np.zeros((2, BINS + 1))
    for r in left_out.agg(F.sum("cal_a").alias("a"), F.sum("cal_b").alias("b")).collect():  # at most BINS rows
        histogram[:, r["bin"] + 1] = r["a"], r["b"]
    if not histogram.sum(axis=1).all():
        return 0.0
    shares = np.cumsum(histogram, axis=1) / histogram.sum(axis=1, keepdims=True)
    gain = shares[1] - shares[0]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 * 20 / BINS - 10)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """`key, host, path, rule, verdict, score`; score is null where a rule decides."""
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    rule, said = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = _letters(rows.withColumn("_rule", rule).withColumn("_said", said))
    fold = F.coalesce(F.pmod(F.crc32(F.col("_url").cast("binary")), F.lit(FOLDS)), F.lit(0))
    tables = kit.Tables(pages.sparkSession)
    urls = tables.keep(grouped(rows.withColumn("_fold", fold)), "urls")
    seen = urls.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if seen["a"] and seen["b"]:
        score = scores(urls, tables)
        by_model = F.when(F.coalesce("score", F.lit(0.0)) >= F.lit(calibrated(urls, score)), "allow").otherwise("block")
    else:
        score = urls.select("name", F.lit(0.0).alias("score"))
        by_model = F.lit("allow")
    unruled = rows.select("_key", "_host", "_path", "_rule", "_said", F.when(F.col("_said").isNull(), name_of(F.col("_letters"))).alias("name"))
    out = join_counted(unruled, score, urls.filter("m > 0").select("name", "m"), "name", "m")
    value = F.when(F.col("_said").isNull(), F.coalesce("score", F.lit(0.0)))
    return out.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_said", by_model).alias("verdict"), value.alias("score"))
