"""Records as JSON text: canonical form, nodes by one fold over the tokens, insertion of a member.

Canonical text is compact, its keys are sorted, of repeated keys the last value is kept at every depth, and numbers keep
their kind: `1.0` stays a fraction and `1e3` is `1000.0`.  VARIANT sorts and checks the text, but refuses repeated keys and
forgets how numbers were written.  Numbers therefore pass through it as marked strings, and texts that it refuses are
given a second time with every key made unique; what is still refused is no JSON.

Nearly all texts are settled before that by one pass in Python (`jsonrows`), which costs some microseconds a record where
the folds over tokens cost about a millisecond.  Nodes come from such a pass, too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cidrloom.functions.ip import let
from cidrloom.functions.jsonrows import MARKED, UNSETTLED, canonical_column, nodes_column

_STRING = r'"(?:[^"\\]|\\.)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_MARK = r"\u0001"  # as JSON text: starts a string that stands for a number
_SERIAL = r"\u0000"  # as JSON text: sets the serial number of a key apart, below any other character
_DIGITS = 9
# Where the decimal exponent of a number is spelled out.
_PLAIN_BELOW, _PLAIN_ABOVE = -5, 16


def _java(text: str) -> str:
    """Literal text as a Java pattern or replacement."""
    return text.replace("\\", "\\\\")


def _marked(text: Column) -> Column:
    """Every number outside strings as a marked string; strings that begin with the mark get it once more."""
    doubled = F.regexp_replace(text, rf'"{_java(_MARK)}', F.lit(f'"{_java(_MARK + _MARK)}'))
    pattern = rf'\G((?:{_STRING}|[^"0-9\-])*+)({_NUMBER})(?=\s*+(?:[,\]}}]|\z))'
    return F.regexp_replace(doubled, pattern, F.lit(f'$1"{_java(_MARK)}$2"'))


def _unmarked(json: Column) -> Column:
    mark = _java(_MARK)
    # Zeros at the end of a fraction go, all but the first digit.
    plain = F.regexp_replace(json, rf'"{mark}(-?[0-9]++(?:\.[0-9]+?(?=0*+"))?+)0*+"', F.lit("$1"))
    odd = json.rlike(rf'"{mark}(?:-0"|[^"]*[eE]|-?0\.0{{5}}|-?[0-9.]{{16,}})')

    def piece(part: Column, i: Column) -> Column:
        number = F.regexp_extract(part, rf"^({_NUMBER})\"", 1)
        spelled = F.concat(number_text(number), F.substring(part, F.length(number) + 2, F.length(part)))
        return F.when(i == 0, part).when(number == "", F.concat(F.lit(f'"{_MARK}'), part)).otherwise(spelled)

    exact = F.transform(F.split(json, rf'"{mark}'), piece)
    exact = F.when(~F.exists(exact, lambda p: p.isNull()), F.array_join(exact, ""))
    return F.regexp_replace(F.when(odd, exact).otherwise(plain), rf'"{mark}{mark}', F.lit(f'"{mark}'))


def number_text(number: Column) -> Column:
    """A JSON number as it is written out: whole numbers of 64 bits as they are, others as the shortest double."""
    whole = number.rlike("^-?[0-9]+$") & (number != "-0")
    wide = number.try_cast("decimal(38,0)")
    fits = whole & wide.between(F.lit(str(-(2**63))).cast("decimal(38,0)"), F.lit(str(2**64 - 1)).cast("decimal(38,0)"))
    return F.when(F.coalesce(fits, F.lit(False)), number).otherwise(let(number.try_cast("double"), _double_text))


def _double_text(value: Column) -> Column:
    shown = value.cast("string")
    sign = F.when(shown.startswith("-"), "-").otherwise("")
    pattern = r"^-?([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$"
    whole, part = F.regexp_extract(shown, pattern, 1), F.regexp_extract(shown, pattern, 2)
    power = F.coalesce(F.regexp_extract(shown, pattern, 3).try_cast("int"), F.lit(0))
    all_digits = F.concat(whole, part)
    lead = F.length(F.regexp_extract(all_digits, "^(0*)", 1))
    digits = F.regexp_replace(F.substring(all_digits, lead + 1, F.length(all_digits)), "0+$", F.lit(""))

    def spelled(v: Column) -> Column:
        d, point = v["digits"], v["point"]  # value = 0.digits * 10**point
        n = F.length(d)
        tens = F.concat(F.lit("e"), (point - 1).cast("string"))
        return (
            F.when(n == 0, "0.0")
            .when((point >= n) & (point <= _PLAIN_ABOVE), F.concat(d, F.repeat(F.lit("0"), point - n), F.lit(".0")))
            .when((point > 0) & (point <= _PLAIN_ABOVE), F.concat(F.substring(d, F.lit(1), point), F.lit("."), F.substring(d, point + 1, n)))
            .when((point > _PLAIN_BELOW) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
            .when(n == 1, F.concat(d, tens))
            .otherwise(F.concat(F.substring(d, F.lit(1), F.lit(1)), F.lit("."), F.substring(d, F.lit(2), n), tens))
        )

    text = let(F.struct(digits.alias("digits"), (F.length(whole) + power - lead).alias("point")), spelled)
    return F.when(shown.rlike(pattern), F.concat(sign, text))


def _serial_keys(text: Column) -> Column:
    """Every key with its place in the text behind it, so that none is repeated."""
    tokens = F.regexp_extract_all(text, F.lit(rf'{_STRING}\s*+:|{_STRING}|[^"]++|"'), F.lit(0))

    def token(t: Column, i: Column) -> Column:
        is_key = t.startswith('"') & t.endswith(":")
        end = F.length(F.regexp_extract(t, rf"^({_STRING})", 1))
        serial = F.concat(F.lit(_SERIAL), F.lpad(i.cast("string"), _DIGITS, "0"), F.lit('":'))
        return F.when(is_key, F.concat(F.substring(t, F.lit(1), end - 1), serial)).otherwise(t)

    return F.array_join(F.transform(tokens, token), "")


def _last_of_repeated(json: Column) -> Column:
    """Canonical text with serial keys: the keys as they were, and of equal keys, which follow each other, the last value.

    One fold over the tokens, with a stack of open containers and their finished members.
    """
    member = "struct<key:string,text:string>"
    level = f"struct<open:string,members:array<{member}>>"
    none = F.array().cast(f"array<{member}>")
    behind = len(_SERIAL) + _DIGITS + 2

    def put(members: Column, one: Column) -> Column:
        same = (F.size(members) > 0) & (one["key"] != "") & (F.element_at(members, -1)["key"] == one["key"])
        return F.concat(F.when(same, F.slice(members, F.lit(1), F.size(members) - 1)).otherwise(members), F.array(one))

    def step(state: Column, raw: Column) -> Column:
        token = F.when(raw.startswith(","), F.substring(raw, F.lit(2), F.length(raw))).otherwise(raw)
        is_key = token.startswith('"') & token.endswith(":")
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        top = F.element_at(state["stack"], -1)
        rest = F.slice(state["stack"], F.lit(1), F.size(state["stack"]) - 1)
        inside = F.array_join(F.transform(top["members"], lambda m: F.concat(F.when(m["key"] == "", "").otherwise(F.concat(m["key"], F.lit(":"))), m["text"])), ",")
        whole = F.when(closes, F.concat(top["open"], inside, token)).otherwise(token)
        keys = F.when(closes, F.slice(state["keys"], F.lit(1), F.size(state["keys"]) - 1)).otherwise(state["keys"])
        key = F.when(closes, F.element_at(state["keys"], -1)).otherwise(state["key"])
        below = F.when(closes, rest).otherwise(state["stack"])
        under = F.element_at(below, -1)
        done = F.struct(key.alias("key"), whole.alias("text"))
        added = F.concat(F.slice(below, F.lit(1), F.size(below) - 1), F.array(F.struct(under["open"].alias("open"), put(under["members"], done).alias("members"))))
        fresh = F.struct(token.alias("open"), none.alias("members"))
        stack = F.when(is_key, state["stack"]).when(opens, F.concat(state["stack"], F.array(fresh))).otherwise(added)
        named = F.concat(F.substring(token, F.lit(1), F.length(token) - behind), F.lit('"'))
        now = F.when(is_key, named).otherwise("")
        open_keys = F.when(opens, F.concat(state["keys"], F.array(state["key"]))).otherwise(keys)
        return F.struct(stack.alias("stack"), open_keys.alias("keys"), now.alias("key"))

    bottom = F.array(F.struct(F.lit("").alias("open"), none.alias("members"))).cast(f"array<{level}>")
    start = F.struct(bottom.alias("stack"), F.array().cast("array<string>").alias("keys"), F.lit("").alias("key"))
    pattern = rf',?(?:{_STRING}:|{_STRING}|[\[\]{{}}]|[^,:\[\]{{}}"]++)'
    end = F.aggregate(F.regexp_extract_all(json, F.lit(pattern), F.lit(0)), start, step)
    return F.element_at(end["stack"], 1)["members"][0]["text"]


def canonical(text: Column) -> Column:
    """Canonical text of one JSON value, null when the text is none."""
    settled = F.arrow_udf(canonical_column, "string")(text)
    return F.when(settled == UNSETTLED, worked_out(text)).when(settled.contains(MARKED), let(settled, _unmarked)).otherwise(settled)


def worked_out(text: Column) -> Column:
    """`canonical` by expressions alone."""
    # Inside an object, nothing can follow the value unseen: the closing member has to be the last one.
    head, tail = rf'{{"{_SERIAL}":', rf',"{_MARK}":0}}'

    def checked(marked: Column) -> Column:
        wrapped = F.concat(F.lit(head), marked, F.lit(tail))
        repeated = _last_of_repeated(F.to_json(F.try_parse_json(_serial_keys(wrapped))))
        return F.coalesce(F.to_json(F.try_parse_json(wrapped)), repeated)

    def inner(json: Column) -> Column:
        whole = json.startswith(head) & json.endswith(tail)
        return F.when(whole, F.substring(json, F.lit(len(head) + 1), F.length(json) - len(head) - len(tail)))

    return let(let(let(_marked(text), checked), inner), _unmarked)


def record_text(record: Column, kind: str) -> Column:
    """Canonical text of a record column: VARIANT is written out, text has to be canonical already."""
    return F.to_json(record) if kind == "variant" else record


def quoted(text: Column) -> Column:
    """Text as a JSON string."""
    return F.when(text.rlike(r'["\\\\\x00-\x1f]'), F.to_json(text.cast("variant"))).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def set_member(record: Column, key: str, value: Column) -> Column:
    """Canonical text with `value` (canonical text) under `key`; texts of other values than objects stay as they are."""
    # A short stand-in takes the member's place among the sorted keys; no quoted text can look like it.
    stand_in = f'"{key}":"{_MARK}{_MARK}"'
    head = F.concat(F.substring(record, F.lit(1), F.length(record) - 1), F.when(record != "{}", ",").otherwise(""))

    def filled(text: Column) -> Column:
        before = F.substring_index(text, stand_in, 1)
        after = F.substring(text, F.length(before) + len(stand_in) + 1, F.length(text))
        return F.concat(before, F.lit(f'"{key}":'), value, after)

    return F.when(record.startswith("{"), let(canonical(F.concat(head, F.lit(stand_in + "}"))), filled)).otherwise(record)


# ---- nodes ----------------------------------------------------------------------------------------------------------

NODE = "struct<path:string,type_tag:string,value:string,depth:int>"


def unquoted(token: Column) -> Column:
    """The content of a JSON string."""
    escaped = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]
    return F.when(token.contains("\\"), escaped).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def nodes(text: Column) -> Column:
    """`array<struct<path, type_tag, value, depth>>` of canonical text, in walk order, whatever its depth.

    Objects are listed, then entered; arrays are not entered; a root that is no object is one node with an empty path.
    `value` is JSON text, null for objects; `depth` counts the keys above.  No job is needed to plan it.
    """
    return F.arrow_udf(nodes_column, f"array<{NODE}>")(text)
