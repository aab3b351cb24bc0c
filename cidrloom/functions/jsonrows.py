"""Canonical text and nodes of whole Arrow columns of JSON text, row by row in plain Python.

`canonical_column` answers what the expressions of `jsontext` answer.  Numbers that have to be spelled out stay marked
strings.  The few texts that Python's JSON would settle in another way (see `_unusual`) get `UNSETTLED` instead, and
`jsontext` works those out itself.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pyarrow as pa

UNSETTLED = "?"  # no canonical text
MARK = "\x01"  # starts a string that stands for a number
MARKED = r'"\u0001'  # as JSON text

# Numbers that are not written out as they are read: exponents, many digits, small fractions, minus zero.
_ODD = re.compile(r"[0-9][eE][+-]?[0-9]|[0-9.]{16}|0\.0000|-0(?![0-9.])")
_SURROGATE = re.compile("[\ud800-\udfff]")
_WIDE = re.compile("[\U00010000-\U0010ffff]")
_HEX = re.compile(r"\\u00[01][a-f]")
_STRING = r'"(?:[^"\\]|\\.)*+"'
_PART = re.compile(rf"{_STRING}|[\[\]{{}}]")
# Tokens of canonical text: key, string, array of scalars, bracket, other scalar.
_TOKEN = re.compile(rf'{_STRING}:?|\[(?:[^\[\]{{}}"]|{_STRING})*+\]|[\[\]{{}}]|[^,:\[\]{{}}"]++')
# Above these the limits of the JVM's parser (1,000 levels, keys of 50,000 characters, values of some megabytes) may count.
_LEVELS, _LONG, _LONGEST = 400, 20_000, 10_000_000
_DIGITS = 15  # so many digits are the same in every shortest spelling of a double


def _refuse(_: str) -> None:
    raise ValueError("no JSON number")


def _fraction(text: str) -> float | str:
    value = float(text)
    spelled = repr(value)
    plain = not spelled.strip("-0123456789.") and len(spelled.strip("-0.").replace(".", "")) <= _DIGITS
    return value if plain else MARK + text


def _whole(text: str) -> int | str:
    return int(text) if len(text) < 19 and text != "-0" else MARK + text


_plain = json.JSONDecoder(parse_constant=_refuse).decode
_odd = json.JSONDecoder(parse_constant=_refuse, parse_float=_fraction, parse_int=_whole).decode
_sorted = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":"), sort_keys=True).encode
_as_is = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":")).encode


def _unusual(text: str) -> bool:
    """Deep or very long texts, and keys or values that only the JVM's marks and limits decide."""
    if "\\u0000" in text or len(text) > _LONGEST or (not text.isascii() and _SURROGATE.search(text)):
        return True
    if len(text) > _LEVELS and text.count("[") + text.count("{") > _LEVELS:
        parts = (p for p in _PART.findall(text) if p[0] != '"')
        return max(accumulate(1 if p in "[{" else -1 for p in parts), default=0) > _LEVELS
    return len(text) > _LONG and max((len(p) for p in _PART.findall(text)), default=0) > _LONG


def _by_code_unit(value):
    """Keys in the order of their UTF-16 units, as the JVM compares them."""
    if isinstance(value, dict):
        return {k: _by_code_unit(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be"))}
    return [_by_code_unit(v) for v in value] if isinstance(value, list) else value


def canonical_text(text: str) -> str | None:
    """Canonical text of one JSON value with marked numbers, `None` when it is none, `UNSETTLED` when the JVM has to say."""
    if _unusual(text):
        return UNSETTLED
    if MARKED in text:
        text = text.replace(MARKED, MARKED + MARKED[1:])
    try:
        value = _odd(text) if _ODD.search(text) else _plain(text)
        out = _sorted(value)
    except RecursionError:
        return UNSETTLED
    except ValueError:
        return None
    if "\\u00" in out and _HEX.search(out):
        return UNSETTLED
    if not out.isascii():
        if _SURROGATE.search(out):
            return UNSETTLED
        if _WIDE.search(out):
            return _as_is(_by_code_unit(value))
    return out


def _texts(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:  # bytes that are no UTF-8 become lone surrogates
        return [b if b is None else b.decode("utf-8", "surrogateescape") for b in column.cast(pa.binary()).to_pylist()]


def canonical_column(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else canonical_text(t) for t in _texts(texts)], pa.string())


def _content(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def _tag(first: str) -> str:
    return "string" if first == '"' else "list" if first == "[" else "bool" if first in "tf" else "null" if first == "n" else "number"


def _walk(text: str, add) -> None:
    """`add(path, type_tag, value, depth)` for every node of canonical text, in walk order."""
    above: list[str] = []  # paths of the open objects
    path = here = ""  # of the object, of its current member
    skip = start = 0  # open brackets of an array with containers, and where it starts
    for found in _TOKEN.finditer(text):
        token = found[0]
        first = token[0]
        if skip:
            skip += (token in "[{") - (token in "]}")
            if not skip:
                add(here, "list", text[start : found.end()], len(above))
        elif first == '"' and token[-1] == ":":
            key = _content(token[:-1])
            here = f"{path}.{key}" if path else key
        elif token == "{":
            if here:
                add(here, "object", None, len(above))
            above.append(path)
            path = here
        elif token == "}":
            path = above.pop() if above else ""
        elif token == "[":
            skip, start = 1, found.start()
        else:
            add(here, _tag(first), token, len(above))


def _strings(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # lone surrogates
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def nodes_column(texts: pa.Array) -> pa.Array:
    paths, tags, values, depths, ends = [], [], [], [], [0]

    def add(path: str, tag: str, value: str | None, depth: int) -> None:
        paths.append(path)
        tags.append(tag)
        values.append(value)
        depths.append(depth)

    rows = _texts(texts)
    for text in rows:
        if text is not None:
            _walk(text, add)
        ends.append(len(paths))
    node = pa.StructArray.from_arrays([_strings(paths), pa.array(tags, pa.string()), _strings(values), pa.array(depths, pa.int32())], ["path", "type_tag", "value", "depth"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), node, mask=pa.array([t is None for t in rows], pa.bool_()))
