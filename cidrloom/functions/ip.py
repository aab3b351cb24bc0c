"""IP and CIDR columns.

A parsed prefix is one struct `family INT, plen INT, hi BIGINT, lo BIGINT`: the address as written
(host bits kept) in two 64-bit halves, IPv4 in `lo` with `hi = 0`.  Two prefixes are equal when all
four fields are equal; containment compares masked addresses.  Everything is built-in expressions,
so both families stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIDR_TYPE = "struct<family:int,plen:int,hi:bigint,lo:bigint>"

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V6_GROUPS = "([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?"

# Zones of the landed DNS answers.
ORIGIN_ZONE = "origin.asn.cymru.com"
ORIGIN6_ZONE = "origin6.asn.cymru.com"
ASNAME_ZONE = "asn.cymru.com"

# Bucket prefix lengths per family.
BUCKET_PLEN_V4 = 26
BUCKET_PLEN_V6 = 66


def let(value: Column, body) -> Column:
    """Bind `value` once and use it many times in `body`."""
    return F.transform(F.array(value), body)[0]


def _shl(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


def cidr_struct(family, plen, hi, lo) -> Column:
    """Build the prefix struct; null when any part is null."""
    parts = [F.lit(v) if isinstance(v, int) else v for v in (family, plen, hi, lo)]
    family, plen, hi, lo = (c.cast(t) for c, t in zip(parts, ("int", "int", "bigint", "bigint")))
    return F.when(
        plen.isNotNull() & hi.isNotNull() & lo.isNotNull(),
        F.struct(family.alias("family"), plen.alias("plen"), hi.alias("hi"), lo.alias("lo")),
    )


def ip4_number(text: Column) -> Column:
    """Dotted quad to BIGINT, null unless it is a strict IPv4 address (no leading zeros, no blanks)."""
    def octet(i: int) -> Column:
        return F.split_part(text, F.lit("."), F.lit(i)).try_cast("bigint")

    value = octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)
    return F.when(text.rlike(V4_PATTERN), value)


def ip4_text(number: Column) -> Column:
    """BIGINT to dotted quad."""
    return F.concat_ws(
        ".",
        F.shiftright(number, 24).cast("string"),
        F.shiftright(number, 16).bitwiseAND(255).cast("string"),
        F.shiftright(number, 8).bitwiseAND(255).cast("string"),
        number.bitwiseAND(255).cast("string"),
    )


def _tail_quad_to_groups(text: Column) -> Column:
    """Rewrite an embedded dotted quad at the end of an IPv6 text as two hex groups."""
    quad = F.substring_index(text, ":", -1)
    number = ip4_number(quad)
    high = F.lower(F.hex(F.shiftright(number, 16)))
    low = F.lower(F.hex(number.bitwiseAND(65535)))
    head = F.substring(text, F.lit(1), F.length(text) - F.length(quad))
    return F.when(~text.contains("."), text).when(number.isNotNull(), F.concat(head, high, F.lit(":"), low))


def ip6_hex(text: Column) -> Column:
    """IPv6 text to 32 hex digits, null when invalid; scope ids are rejected."""
    def expand(t: Column) -> Column:
        full = F.split(t, ":")
        left = F.substring_index(t, "::", 1)
        right = F.substring_index(t, "::", -1)
        lefts = F.when(left == "", F.array().cast("array<string>")).otherwise(F.split(left, ":"))
        rights = F.when(right == "", F.array().cast("array<string>")).otherwise(F.split(right, ":"))
        gap = F.lit(8) - F.size(lefts) - F.size(rights)
        short_ok = t.rlike(f"^{_V6_GROUPS}::{_V6_GROUPS}$") & (gap >= 1)
        groups = F.when(t.rlike("^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"), full).when(
            short_ok, F.concat(lefts, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), rights)
        )
        return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")

    return F.when(text.contains(":"), let(_tail_quad_to_groups(F.lower(text)), expand))


def _hex64(hex16: Column) -> Column:
    return F.conv(hex16, 16, -10).try_cast("bigint")


def parse_ip(text: Column) -> Column:
    """Bare address of either family to a host prefix (/32 or /128), null when invalid."""
    def six(h: Column) -> Column:
        return cidr_struct(6, 128, _hex64(F.substring(h, 1, 16)), _hex64(F.substring(h, 17, 16)))

    return F.when(text.contains(":"), let(ip6_hex(text), six)).otherwise(cidr_struct(4, 32, 0, ip4_number(text)))


def parse_cidr(text: Column, promote_hosts: bool = False) -> Column:
    """`addr/len` to the prefix struct, null when invalid; `promote_hosts` also takes bare addresses."""
    length_text = F.substring_index(text, "/", -1)
    length = F.when(length_text.rlike("^[0-9]{1,3}$"), length_text.try_cast("int"))

    def sized(ip: Column) -> Column:
        ok = (length <= ip["plen"]) & ((ip["family"] == 6) | (F.length(length_text) <= 2))
        net = F.when(text.rlike("^[^/]+/[^/]+$") & ok, cidr_struct(ip["family"], length, ip["hi"], ip["lo"]))
        return F.when(text.contains("/"), net).otherwise(ip) if promote_hosts else net

    return let(parse_ip(F.substring_index(text, "/", 1)), sized)


def masked(cidr: Column, plen: Column | None = None) -> Column:
    """The network of `cidr` at prefix length `plen` (its own length by default)."""
    p = cidr["plen"] if plen is None else plen
    ones = F.lit(-1).cast("bigint")
    v4 = cidr["lo"].bitwiseAND(_shl(ones, F.lit(32) - p))
    hi = F.when(p == 0, F.lit(0).cast("bigint")).when(p >= 64, cidr["hi"]).otherwise(
        cidr["hi"].bitwiseAND(_shl(ones, F.lit(64) - p))
    )
    lo = F.when(p <= 64, F.lit(0).cast("bigint")).otherwise(cidr["lo"].bitwiseAND(_shl(ones, F.lit(128) - p)))
    is4 = cidr["family"] == 4
    return F.when(
        cidr.isNotNull() & p.isNotNull(),
        F.struct(
            cidr["family"].alias("family"),
            p.cast("int").alias("plen"),
            F.when(is4, F.lit(0).cast("bigint")).otherwise(hi).alias("hi"),
            F.when(is4, v4).otherwise(lo).alias("lo"),
        ),
    )


def last_address(cidr: Column) -> Column:
    """The highest address of the prefix as a host prefix."""
    return let(cidr, lambda c: let(masked(c), _last_of_network))


def _last_of_network(net: Column) -> Column:
    one = F.lit(1).cast("bigint")
    p = net["plen"]
    v4 = net["lo"].bitwiseOR(_shl(one, F.lit(32) - p) - 1)
    all_ones = F.lit(-1).cast("bigint")
    hi = F.when(p == 0, all_ones).when(p >= 64, net["hi"]).otherwise(
        net["hi"].bitwiseOR(F.bitwise_not(_shl(all_ones, F.lit(64) - p)))
    )
    lo = F.when(p <= 64, all_ones).otherwise(net["lo"].bitwiseOR(F.bitwise_not(_shl(all_ones, F.lit(128) - p))))
    is4 = net["family"] == 4
    return cidr_struct(
        net["family"],
        F.when(is4, 32).otherwise(128),
        F.when(is4, F.lit(0).cast("bigint")).otherwise(hi),
        F.when(is4, v4).otherwise(lo),
    )


def cidr_contains(net: Column, other: Column) -> Column:
    """True when `net` covers the prefix or host `other`; false across families."""
    fits = (net["family"] == other["family"]) & (net["plen"] <= other["plen"])
    same = masked(net) == masked(other, net["plen"])
    return F.coalesce(F.when(fits, same), F.lit(False))


def host_net(ip: Column) -> Column:
    """Address as its own /32 or /128."""
    return cidr_struct(ip["family"], F.when(ip["family"] == 4, 32).otherwise(128), ip["hi"], ip["lo"])


def ip_bucket(ip: Column) -> Column:
    """Group key of an address: its /26 (IPv4) or /66 (IPv6)."""
    return masked(ip, F.when(ip["family"] == 4, BUCKET_PLEN_V4).otherwise(BUCKET_PLEN_V6))


def _hex128(cidr: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(cidr["hi"]), 16, "0"), F.lpad(F.hex(cidr["lo"]), 16, "0")))


def _compress6(cidr: Column) -> Column:
    """Canonical IPv6 text: the first longest run of zero groups becomes `::`."""
    def write(digits: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda i: F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", ""),
        )

        def squeeze(t: Column) -> Column:
            out = F.when(
                F.lit(False), t
            )
            for run in range(8, 1, -1):
                pattern = rf"^(.*?)(^|:)0(:0){{{run - 1}}}(:|$)(.*)$"
                out = out.when(t.rlike(pattern), F.regexp_replace(t, pattern, "$1::$5"))
            return out.otherwise(t)

        return let(F.array_join(groups, ":"), squeeze)

    mapped = (cidr["hi"] == 0) & (F.shiftright(cidr["lo"], 32) == 65535)
    return F.when(mapped, F.concat(F.lit("::ffff:"), ip4_text(cidr["lo"].bitwiseAND(4294967295)))).otherwise(
        let(_hex128(cidr), write)
    )


def ip_text(cidr: Column) -> Column:
    """Address part as canonical text."""
    return let(cidr, lambda c: F.when(c["family"] == 4, ip4_text(c["lo"])).when(c["family"] == 6, _compress6(c)))


def cidr_text(cidr: Column) -> Column:
    """`addr/len` as canonical text, host bits as written."""
    return let(cidr, lambda c: F.concat(ip_text(c), F.lit("/"), c["plen"].cast("string")))


def _bits(cidr: Column) -> Column:
    four = F.lpad(F.bin(cidr["lo"]), 32, "0")
    six = F.concat(F.lpad(F.bin(cidr["hi"]), 64, "0"), F.lpad(F.bin(cidr["lo"]), 64, "0"))
    return F.when(cidr["family"] == 4, four).otherwise(six)


def _from_bits(family: Column, bits: Column, plen: Column) -> Column:
    """Prefix whose leading bits are `bits` and whose remaining bits are zero."""
    four = F.conv(F.rpad(bits, 32, "0"), 2, 10).cast("bigint")
    wide = F.rpad(bits, 128, "0")
    hi = F.conv(F.substring(wide, 1, 64), 2, -10).cast("bigint")
    lo = F.conv(F.substring(wide, 65, 64), 2, -10).cast("bigint")
    is4 = family == 4
    return cidr_struct(
        family, plen, F.when(is4, F.lit(0).cast("bigint")).otherwise(hi), F.when(is4, four).otherwise(lo)
    )


def address_order(ip: Column) -> Column:
    """Sortable unsigned key of the address part."""
    return F.concat(ip["family"].cast("string"), _hex128(ip))


def range_to_cidrs(start: Column, end: Column) -> Column:
    """Minimal prefix cover of the inclusive range, in address order; null on mixed family or start > end.

    Works on the bit strings of both ends.  Below the first differing bit, every 0 of `start` has a
    right sibling inside the range and every 1 of `end` a left sibling; trailing zeros of `start`
    and trailing ones of `end` merge into the last block of their side.
    """
    def cover(ends: Column) -> Column:
        family, s, e = ends["family"], ends["s"], ends["e"]
        width = F.length(s)
        differing = F.filter(F.sequence(F.lit(1), width), lambda i: F.substring(s, i, F.lit(1)) != F.substring(e, i, F.lit(1)))
        first = F.coalesce(F.try_element_at(differing, F.lit(1)), width + 1)

        def block(bits: Column) -> Column:
            return _from_bits(family, bits, F.length(bits))

        def sides(at: Column) -> Column:
            shared = F.substring(s, F.lit(1), at - 1)
            low = F.greatest(F.length(F.rtrim(s, F.lit("0"))), at)
            high = F.greatest(F.length(F.rtrim(e, F.lit("1"))), at)
            whole = ~F.substring(s, at, width).contains("1") & ~F.substring(e, at, width).contains("0")

            def below(text: Column, stop: Column, bit: str, sibling: str) -> Column:
                spots = F.when(at + 1 <= stop, F.sequence(at + 1, stop)).otherwise(F.array().cast("array<int>"))
                spots = F.filter(spots, lambda i: F.substring(text, i, F.lit(1)) == bit)
                return F.transform(spots, lambda i: block(F.concat(F.substring(text, F.lit(1), i - 1), F.lit(sibling))))

            left = F.concat(F.array(block(F.substring(s, F.lit(1), low))), F.reverse(below(s, low, "0", "1")))
            right = F.concat(below(e, high, "1", "0"), F.array(block(F.substring(e, F.lit(1), high))))
            return F.when(whole, F.array(block(shared))).otherwise(F.concat(left, right))

        return let(first, sides)

    def checked(r: Column) -> Column:
        same = r["a"]["family"] == r["b"]["family"]
        bound = F.struct(r["a"]["family"].alias("family"), _bits(r["a"]).alias("s"), _bits(r["b"]).alias("e"))
        return F.when(same, let(bound, lambda b: F.when(b["s"] <= b["e"], cover(b))))

    return let(F.struct(start.alias("a"), end.alias("b")), checked)


def inetnum_to_net(text: Column) -> Column:
    """`a - b` or `addr/len` to one prefix; null when the range is not exactly one aligned block."""
    def single(cover: Column) -> Column:
        return F.when(F.size(cover) == 1, cover[0])

    start = parse_ip(F.trim(F.substring_index(text, " - ", 1)))
    tail = F.substring(text, F.instr(text, " - ") + 3, F.length(text))
    ranged = F.when(
        text.contains(" - "),
        let(range_to_cidrs(start, parse_ip(F.trim(tail))), single),
    )
    # A whole-family range has no representable size in the source format and stays null.
    return F.coalesce(parse_cidr(text), let(ranged, lambda r: F.when(r["plen"] > 0, r)))


def parse_addresses(cell: Column) -> Column:
    """A free-text address cell to `struct<nets array<cidr>, bad int>`.

    Line breaks count as commas, parenthesised notes go, tokens are CIDRs, bare addresses or `a-b` ranges.
    """
    flat = F.regexp_replace(F.regexp_replace(cell, r"\r\n|\r|\n", ","), r"(?U)\s*\([^)]*\)", "")
    tokens = F.filter(F.transform(F.split(flat, ","), strip), lambda t: t != "")

    def token_nets(token: Column) -> Column:
        dash = F.instr(token, "-")
        sides = F.array(F.substring(token, F.lit(1), dash - 1), F.substring(token, dash + 1, F.length(token)))
        ranged = let(F.transform(sides, lambda side: parse_ip(strip(side))), lambda r: range_to_cidrs(r[0], r[1]))
        # No address holds a dash, so a token is either a range or a prefix.
        single = let(parse_cidr(token, promote_hosts=True), lambda c: F.when(c.isNotNull(), F.array(c)))
        return F.when(dash > 0, ranged).otherwise(single)

    def summarise(parsed: Column) -> Column:
        return F.struct(
            F.flatten(F.filter(parsed, lambda p: p.isNotNull())).alias("nets"),
            F.size(F.filter(parsed, lambda p: p.isNull())).alias("bad"),
        )

    return F.when(cell.isNotNull(), let(F.transform(tokens, token_nets), summarise))


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sample_targets(cidr: Column) -> Column:
    """IPv4 probe targets of a prefix as BIGINTs: all hosts up to /29, else the first four and last three."""
    def pick(net: Column) -> Column:
        lo, p = net["lo"], net["plen"]
        last = lo + _shl(F.lit(1).cast("bigint"), F.lit(32) - p) - 1
        return (
            F.when(p == 32, F.array(lo))
            .when(p == 31, F.array(lo, last))
            .when(p >= 29, F.sequence(lo + 1, last - 1))
            .otherwise(F.array(lo + 1, lo + 2, lo + 3, lo + 4, last - 3, last - 2, last - 1))
        )

    return let(cidr, lambda c: F.when(c["family"] == 4, let(masked(c), pick)))


def host_bounds(cidr: Column) -> Column:
    """First and last usable IPv4 host as `struct<first, last>`: both ends for /31 and /32, else without them."""
    def bounds(net: Column) -> Column:
        inner = F.when(net["plen"] >= 31, 0).otherwise(1)
        last = net["lo"] + _shl(F.lit(1).cast("bigint"), F.lit(32) - net["plen"]) - 1
        return F.when(net["family"] == 4, F.struct((net["lo"] + inner).alias("first"), (last - inner).alias("last")))

    return let(cidr, lambda c: let(masked(c), bounds))


def reverse_name(ip: Column) -> Column:
    """Key of a landed DNS origin answer."""
    return let(ip, _reverse_name)


def _reverse_name(ip: Column) -> Column:
    four = F.concat(F.array_join(F.reverse(F.split(ip4_text(ip["lo"]), r"\.")), "."), F.lit("." + ORIGIN_ZONE))
    # IPv6 nibbles are written without separating dots in the landed keys.
    six = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.reverse(F.substring(_hex128(ip), i * 2 + 1, F.lit(2)))), ""), F.lit("." + ORIGIN6_ZONE))
    return F.when(ip["family"] == 4, four).otherwise(six)


def asname_key(asn: Column) -> Column:
    """Key of a landed AS-name answer."""
    return F.concat(F.lit("as"), asn.cast("string"), F.lit("." + ASNAME_ZONE))


def is_host_route(text: Column) -> Column:
    """Label that ends with /32 or /128."""
    return text.endswith("/32") | text.endswith("/128")


def cidr_order(text: Column) -> list[Column]:
    """Sort keys: IPv4 before IPv6, address, prefix length; unparseable text last, by text."""
    def key(c: Column) -> Column:
        return F.struct(c.isNull().alias("bad"), address_order(c).alias("address"), c["plen"].alias("plen"))

    return [let(parse_cidr(text), key).asc(), text.asc()]
