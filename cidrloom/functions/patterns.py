"""User-supplied patterns as Columns.

Patterns are written in a linear-time regex dialect (named groups `(?P<name>..)`, `$name`
replacements, Unicode classes).  `to_java` rewrites one on the driver into the dialect Spark runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cidrloom.functions.text import unsigned32

DEVICE_FIELDS = ("interface", "device", "device_role", "facility")
PTR_FIELDS = ("interface", "device", "device_role", "facility", "facing")
DEVICE_TYPE = "struct<interface:string,device:string,device_role:string,facility:string,facing:string,customer_asn:bigint>"


@dataclass(frozen=True)
class NormalizeRule:
    pattern: str
    replacement: str


@dataclass(frozen=True)
class Normalizer:
    """Ordered replace-all rules, a final case (`lower`, `upper`, `none`) and exclude patterns."""

    rules: tuple[NormalizeRule, ...] = ()
    case: str = "lower"
    excludes: tuple[str, ...] = ()


@dataclass(frozen=True)
class PtrPattern:
    """Hostname pattern: optional plain-text domain suffix, regex or `{name}` template, exclude patterns."""

    regex: str
    domain: str | None = None
    excludes: tuple[str, ...] = ()


@dataclass(frozen=True)
class JavaRegex:
    pattern: str
    groups: dict[str, int] = field(default_factory=dict)
    count: int = 0


def to_java(pattern: str) -> JavaRegex:
    """Strip group names (keeping name -> number), make `$` mean end of text and classes Unicode-aware."""
    out, names, count, i, in_class = [], {}, 0, 0, 0
    multiline = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    if re.search(r"\(\?[a-zA-Z]*U", pattern):
        raise ValueError(f"swapped greediness is not supported: {pattern}")
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class += (ch == "[") - (ch == "]")
            out.append(ch)
        elif ch == "[":
            in_class = 1
            out.append(ch)
        elif ch == "(":
            named = re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>", pattern[i:])
            if named:
                count += 1
                names[named.group(1)] = count
                out.append("(")
                i += named.end()
                continue
            count += pattern[i + 1 : i + 2] != "?"
            out.append(ch)
        elif ch == "$" and not multiline:
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    java = "(?Ud)" + "".join(out)
    try:
        re.compile("".join(out).replace(r"\z", r"\Z"))
    except re.error as err:
        if "unterminated" in str(err) or "missing" in str(err) or "unbalanced" in str(err) or "nothing to repeat" in str(err):
            raise ValueError(f"invalid pattern {pattern!r}: {err}") from err
    return JavaRegex(java, names, count)


def to_java_replacement(replacement: str, regex: JavaRegex) -> str:
    """`$name`, `${name}` and `$n` to explicit group numbers; unknown groups become empty, `$$` a dollar."""
    def one(match: re.Match) -> str:
        if match.group(0) == "$$":
            return r"\$"
        name = match.group(1) or match.group(2)
        number = int(name) if name.isdigit() else regex.groups.get(name)
        # The brace keeps a digit that follows from being read as part of the group number.
        return f"${number}" if number is not None and number <= regex.count else ""

    pieces, last = [], 0
    for match in re.finditer(r"\$\$|\$\{([^}]+)\}|\$([0-9A-Za-z_]+)", replacement):
        pieces.append(_java_literal(replacement[last : match.start()], pieces))
        pieces.append(one(match))
        last = match.end()
    pieces.append(_java_literal(replacement[last:], pieces))
    return "".join(pieces)


def _java_literal(text: str, before: list[str]) -> str:
    quoted = text.replace("\\", "\\\\").replace("$", r"\$")
    if quoted[:1].isdigit() and before and re.match(r"\$[0-9]+$", before[-1]):
        quoted = "\\" + quoted
    return quoted


def normalize(norm: Normalizer, col: Column) -> Column:
    """Apply the rules in order, then the case."""
    for rule in norm.rules:
        regex = to_java(rule.pattern)
        col = F.regexp_replace(col, F.lit(regex.pattern), F.lit(to_java_replacement(rule.replacement, regex)))
    return {"lower": F.lower, "upper": F.upper, "none": lambda c: c}[norm.case](col)


def any_match(patterns: tuple[str, ...], col: Column) -> Column:
    """True when one of the patterns is found in the value."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | col.rlike(to_java(pattern).pattern)
    return F.coalesce(out, F.lit(False))


def normalize_excluded(norm: Normalizer, normalised: Column) -> Column:
    return any_match(norm.excludes, normalised)


def ptr_excluded(pattern: PtrPattern, ptr: Column) -> Column:
    return any_match(pattern.excludes, ptr)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)


def ptr_regex(pattern: PtrPattern) -> JavaRegex:
    """Compile a pattern; `{name}` turns it into an anchored template of dot-free groups plus the domain."""
    if "{" not in pattern.regex:
        return to_java(pattern.regex)
    body = ""
    for literal, name in re.findall(r"([^{]*)(?:\{([^}]*)\})?", pattern.regex):
        body += _quote(literal)
        if name:
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                raise ValueError(f"invalid placeholder {{{name}}} in {pattern.regex!r}")
            body += f"(?P<{name}>[^.]+)"
    suffix = r"\." + _quote(pattern.domain) if pattern.domain else ""
    return to_java(f"^{body}{suffix}$")


def facing(raw: Column, has_asn: Column) -> Column:
    """Canonical side a port faces."""
    return (
        F.when(raw.startswith("user") & raw.contains("virtual"), "user_virtual")
        .when(raw.startswith("user"), "user")
        .when(raw.startswith("virtual"), "virtual")
        .when(raw.isNull() & has_asn, "bgp_peer")
        .when(raw.isNull(), "network")
    )


def in_domain(pattern: PtrPattern, ptr: Column) -> Column:
    """The domain is a bare text suffix."""
    return ptr.endswith(pattern.domain) if pattern.domain is not None else ptr.isNotNull()


def ptr_matches(pattern: PtrPattern, ptr: Column) -> Column:
    return F.coalesce((ptr != "") & in_domain(pattern, ptr) & ptr.rlike(ptr_regex(pattern).pattern), F.lit(False))


def ptr_device(pattern: PtrPattern, ptr: Column) -> Column:
    """Device struct of one pattern; only meaningful where `ptr_matches` holds."""
    regex = ptr_regex(pattern)

    def group(name: str) -> Column:
        if name not in regex.groups:
            return F.lit(None).cast("string")
        return F.nullif(F.regexp_extract(ptr, regex.pattern, regex.groups[name]), F.lit(""))

    asn = unsigned32(group("customer_asn"))
    return F.struct(
        *[group(f).alias(f) for f in DEVICE_FIELDS],
        facing(group("facing"), asn.isNotNull()).alias("facing"),
        asn.alias("customer_asn"),
    )


def parse_ptr(ptr: Column, patterns: list[PtrPattern]) -> Column:
    """Device of the first pattern whose domain and regex match, else null."""
    out = F.when(F.lit(False), F.lit(None).cast(DEVICE_TYPE))
    for pattern in patterns:
        out = out.when(ptr_matches(pattern, ptr), ptr_device(pattern, ptr))
    return out


def _ports(prefix: str, code: str) -> NormalizeRule:
    return NormalizeRule(rf"(?i){prefix}(\d+(?:[/\.]\d+)*)", f"{code}-$1")


# Interface name prefixes of common vendors and their short codes, longest names first.
INTERFACE_CODES = (
    ("HundredGigabitEthernet", "hu"),
    ("FortyGigabitEthernet", "fo"),
    ("TenGigabitEthernet", "te"),
    ("FiveGigabitEthernet", "fi5g"),
    ("TwoGigabitEthernet", "tw"),
    ("XGigabitEthernet", "xe"),
    ("GigaEthernet", "gi"),
    ("GigabitEthernet", "gi"),
    ("FourHundredGigE", "fh"),
    ("TwoHundredGigE", "th"),
    ("TwentyFiveGigE", "twe"),
    ("HundredGigE", "hu"),
    ("FiftyGigE", "fi50g"),
    ("FortyGigE", "fo"),
    ("TenGigE", "te"),
    ("GigE", "gi"),
    ("FastEthernet", "fa"),
    ("MultiGE", "mge"),
    ("800GE", "800ge"),
    ("400GE", "400ge"),
    ("200GE", "200ge"),
    ("100GE", "hu"),
    ("40GE", "40ge"),
    ("25GE", "25ge"),
    ("10GE", "xe"),
    ("5GE", "fi5g"),
    ("GE", "ge"),
    (r"\bHu", "hu"),
    (r"\bFo", "fo"),
    (r"\bTwe", "twe"),
    (r"\bTe", "te"),
    (r"\bTw", "tw"),
    (r"\bGi", "gi"),
    (r"\bFa", "fa"),
)

INTERFACE_NORMALIZER = Normalizer(
    rules=tuple(_ports(p, c) for p, c in INTERFACE_CODES) + (NormalizeRule("/", "-"), NormalizeRule(r"\.", "-"))
)
