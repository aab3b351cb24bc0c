"""Personal data, with information-theoretic sanitisation. Built-in Spark functions only.

Base spans are four fixed patterns (e-mail, IPv4, payment card, phone) with their checks. Each valid value is a
protected entity. All words of a text that holds an entity are its terms. The corpus gives n(t,e) (distinct texts
that hold term t and entity e) and n(e), and over all rows n(t) (texts that hold t) and N. The disclosure of e by t
is PMI(t;e) / IC(e) = log(n(t,e) N / (n(t) n(e))) / log(N / n(e)): 1 when the term occurs only with the entity.
A term is generalised from `GENERALISE` on and removed from `REMOVE` on, if at least `SUPPORT` distinct texts show the
pair: for that, exact copies are one text, so a copied page is no evidence about its own words. It goes wherever it
stands, at any distance and in texts without the entity too: what discloses an entity does so in any text.

The texts are read by row, never dealt by a key. A set of terms that is asked for or told goes to the rows as a Bloom filter
of `FILTER_BITS` bits, whatever its size; words that pass it leave their row, and a join on the term settles them. A set
too large for the filter lets more words pass, which costs time and changes nothing. Terms of a join are dealt to
`SPREAD` copies, because one term may stand in a third of all texts.

Defined cases: a null text is empty and has no span; repeated rows, ids and null ids each give their row, judged by
their text alone; an empty table gives no rows; further columns never travel in `find` and are kept by `sanitise`.
Offsets are code points, end exclusive. Overlapping spans: in `sanitise` the one that starts first replaces the text
and the rest of a later one is dropped with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cidrloom.llm.kit import Tables

SUPPORT = 3
GENERALISE = 0.75
REMOVE = 0.95
FILTER_BITS = 1 << 18
SPREAD = 16
KINDS = ("email", "ip", "card", "phone")

# The first character and the look-behind let a match start only at the head of a run (or where the match before ended),
# and possessive repeats never give back: every pattern reads a text once, whatever it holds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-](?:(?<![A-Za-z0-9._%+-]{2})|(?<=\G.))[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"\p{L}[\p{L}\p{N}'-]*+"
_MARK = {"email": "@", "phone": "+"}  # texts without the mark are not searched


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda span: _valid(kind, span["value"])


def _is(kind: str):
    return lambda span: span["kind"] == kind


def located(text: Column, matches: Column, pattern: str, kind: Column) -> Column:
    """`array<kind, start, end, value>` of non-overlapping matches, in order, from the pieces between them."""
    pieces = F.split(text, pattern, -1)
    step = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("found"))

    def add(state, pair):
        start = state["at"] + F.length(pair["piece"])
        span = F.struct(kind.alias("kind"), start.alias("start"), (start + F.length(pair["value"])).alias("end"), pair["value"].alias("value"))
        return F.struct(span["end"].alias("at"), F.concat(F.coalesce(state["found"], F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")), F.array(span)).alias("found"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    return F.aggregate(pairs, step, add)["found"]


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds `_spans`, the valid base spans in order of kind and start (empty for texts without)."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    out = docs
    for kind in KINDS:
        found = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))
        out = out.withColumn(f"_m_{kind}", F.when(F.col(text).contains(_MARK[kind]), found) if kind in _MARK else found)
    spans = []
    for kind in KINDS:
        at = F.when(F.size(f"_m_{kind}") > 0, F.filter(located(F.col(text), F.col(f"_m_{kind}"), PATTERNS[kind], F.lit(kind)), _check(kind)))
        spans.append(F.coalesce(at, empty))
    return out.withColumn("_spans", F.concat(*spans)).drop(*[f"_m_{k}" for k in KINDS])


def _terms_of(text: Column) -> Column:
    """The distinct terms of a text: words of three letters and more in lower case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: F.length(w) > 2))


def _masked(text: Column, spans: Column) -> Column:
    """The text with blanks of the same length in place of its base spans, whose own words are no terms."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def add(state, s):
        fresh = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.repeat(F.lit(" "), s["end"] - F.greatest(state["at"], s["start"])))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["end"] > state["at"], fresh).otherwise(state["out"]).alias("out"))

    end = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return F.when(F.size(spans) > 0, F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text)))).otherwise(text)


def _places(term: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(term, F.lit(k)), F.lit(FILTER_BITS)) for k in (1, 2)]


def term_filter(terms: DataFrame) -> Column:
    """A Bloom filter of `term` as one binary literal: always FILTER_BITS bits, whatever the number of terms."""
    bits = terms.select(F.explode(F.array(*_places(F.col("term")))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))
    whole = bytearray(FILTER_BITS // 8)
    for word, value in bits.groupBy(F.shiftright("at", 6)).agg(F.bit_or(bit)).collect():
        whole[8 * word : 8 * word + 8] = value.to_bytes(8, "little", signed=True)
    return F.lit(whole)


def may_hold(bits: Column, term: Column) -> Column:
    """Whether the filter may hold the term: true for all of its terms."""
    def one(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1

    first, second = _places(term)
    return one(first) & one(second)


def disclosing_terms(rows: DataFrame, text: str, tables: Tables, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """`term, kind`: the terms to generalise or remove wherever they stand. `rows`: see `with_base`.

    Filters lose no pair: a pair needs an entity and a term with `support` texts each, all of them texts of such entities.
    """
    entities = F.array_distinct(F.transform("_spans", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    held = rows.filter(F.size("_spans") > 0).select(F.md5(text).alias("md5"), entities.alias("entities"), "_spans", F.col(text).alias("_text"))
    total = float(rows.filter(F.col(text).isNotNull()).count())
    n_e = held.select("md5", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    n_e = tables.keep(n_e.filter((F.col("n_e") >= support) & (F.col("n_e") < total)), "pii-entities")
    # Only texts of such entities, each once, give their terms.
    bits = term_filter(n_e.select(F.col("entity").alias("term")))
    some = held.withColumn("entities", F.filter("entities", lambda e: may_hold(bits, e))).filter(F.size("entities") > 0)
    once = some.select("md5", "entities", _terms_of(_masked(F.col("_text"), F.col("_spans"))).alias("terms")).dropDuplicates(["md5"])
    once = tables.keep(once, "pii-once")
    # An entity may stand in many texts, so its row is dealt to copies.
    entity = once.select("md5", F.explode("entities").alias("entity"))
    copies = n_e.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    known = entity.withColumn("copy", F.pmod(F.xxhash64("md5"), F.lit(SPREAD)).cast("int")).join(copies, ["entity", "copy"])
    known = known.groupBy("md5").agg(F.collect_list(F.struct("entity", "n_e")).alias("known"))
    told_in = tables.keep(once.select("md5", "terms").join(known, "md5").select("known", "terms"), "pii-known")
    least = told_in.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("term")
    likely = term_filter(tables.keep(least, "pii-least"))
    said = told_in.select("known", F.explode(F.filter("terms", lambda t: may_hold(likely, t))).alias("term"))
    pairs = said.select("term", F.explode("known").alias("e")).groupBy("term", "e.entity", "e.n_e").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= support)
    # n(t) is at least n(t, e).
    rare = F.log(F.lit(total) / F.col("n_e"))
    disclosure = lambda n_t: F.when(rare > 0, F.log(F.col("n_te") * F.lit(total) / (n_t * F.col("n_e"))) / rare).otherwise(0.0)
    pairs = tables.keep(pairs.filter(disclosure(F.col("n_te")) >= generalise), "pii-pairs")
    asked = tables.keep(pairs.select("term").distinct(), "pii-asked")
    bits = term_filter(asked)
    heard = rows.select(F.explode(F.filter(_terms_of(_masked(F.col(text), F.col("_spans"))), lambda t: may_hold(bits, t))).alias("term"))
    n_t = heard.groupBy("term").agg(F.count("*").alias("n_t"))
    told = pairs.join(n_t, "term").withColumn("disclosure", disclosure(F.col("n_t"))).filter(F.col("disclosure") >= generalise)
    told = tables.keep(told.groupBy("term").agg(F.max(F.when(F.col("disclosure") >= remove, "removed").otherwise("general")).alias("kind")), "pii-told")
    tables.drop(once, n_e, told_in, pairs, asked)
    return told


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def told_spans(rows: DataFrame, told: DataFrame, text: str) -> DataFrame:
    """`_row, _terms`: the spans of told terms in the whole texts, in order of kind and start, for rows that hold any."""
    bits = term_filter(told)
    said = _masked(F.col(text), F.col("_spans"))
    pieces, words = F.split(F.col("_said"), _WORD, -1), F.regexp_extract_all("_said", F.lit(_WORD), F.lit(0))
    passing = F.exists("_words", lambda w: may_hold(bits, F.lower(w)))

    def add(state, pair):
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        span = F.struct(F.lit("").alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(may_hold(bits, F.lower(pair["value"])), F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size("_words")), F.col("_words"), lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    at = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found")), add)["found"]
    some = rows.select("_row", said.alias("_said")).withColumn("_words", words).filter(passing)
    spans = some.select("_row", F.explode(at).alias("s")).select("_row", "s.start", "s.end", "s.value", F.lower("s.value").alias("term"))
    copies = told.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    sure = spans.withColumn("copy", F.pmod(F.xxhash64("_row"), F.lit(SPREAD)).cast("int")).join(copies, ["term", "copy"])
    return sure.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("_terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of base spans, their digest, and all spans as text."""
    tables = Tables(docs.sparkSession)
    rows = with_base(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    rows = tables.keep(rows.withColumn("_row", F.monotonically_increasing_id()), "pii-base")
    terms = told_spans(rows, disclosing_terms(rows, "_text", tables), "_text")
    counts = [F.size(F.filter("_spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    base = rows.select("_row", F.col("_key").alias(key), *counts, _joined(F.col("_spans")).alias("_base"))
    found = base.join(terms, "_row", "left")
    also = F.coalesce(_joined(F.col("_terms")), F.lit(""))
    both = F.when(F.length(also) == 0, F.col("_base")).when(F.length("_base") == 0, also).otherwise(F.concat_ws(",", "_base", also))
    return found.select(key, *[f"n_{kind}" for kind in KINDS], F.sha2("_base", 256).alias("base_sha256"), both.alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its label, or by nothing."""
    label = lambda s: F.when(s["kind"] == "removed", "").when(s["kind"] == "general", F.when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def add(state, s):
        fresh = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), label(s))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    end = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text)))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with base spans and disclosing terms replaced in `text`, wherever they stand; other columns stay."""
    columns, tables = docs.columns, Tables(docs.sparkSession)
    rows = tables.keep(with_base(docs, text).withColumn("_row", F.monotonically_increasing_id()), "pii-held")
    terms = tables.keep(told_spans(rows, disclosing_terms(rows, text, tables), text), "pii-terms")
    done = rows.join(terms, "_row", "left")
    spans = F.concat("_spans", F.coalesce("_terms", F.array().cast(SPANS)))
    return done.withColumn(text, F.when(F.size(spans) > 0, _replaced(F.col(text), spans)).otherwise(F.col(text))).select(columns)
