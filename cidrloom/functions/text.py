"""Scalar text rules: AS numbers, continents, DNS answers, cell casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cidrloom.functions.ip import CIDR_TYPE, let, parse_addresses, strip

# ISO 3166-1 alpha-2 codes per continent code.
CONTINENT_COUNTRIES = {
    "AS": "JP CN KR TW HK MO MN SG MY TH VN PH ID IN PK BD LK NP MM KH LA BN TL AF IR IQ SY LB JO IL PS SA AE QA KW BH OM YE KZ UZ TM KG TJ AZ AM GE TR CY",
    "EU": "GB DE FR IT ES PT NL BE LU CH AT SE NO DK FI IS IE PL CZ SK HU RO BG HR SI RS BA ME MK AL GR EE LV LT UA BY MD RU MT LI MC SM VA AD",
    "NA": "US CA MX GT BZ HN SV NI CR PA CU JM HT DO PR TT BB LC VC GD AG DM KN BS TC KY BM AW CW SX BQ VI VG AI MS MF GP MQ PM",
    "SA": "BR AR CL CO PE VE EC BO PY UY GY SR GF FK",
    "AF": "ZA NG EG KE ET GH TZ UG DZ MA TN LY SD SO CM CI SN ZW ZM MZ AO NA BW MW RW BI DJ ER GA CG CD CF TD NE ML BF GN GW SL LR TG BJ MR GM CV ST GQ SS LS SZ KM SC MU MG RE YT EH",
    "OC": "AU NZ FJ PG SB VU WS TO KI FM MH PW NR TV CK NU TK WF PF NC GU MP AS UM CX CC NF HM",
    "AN": "AQ TF GS BV",
}

MAX_ASN = 4294967295


def unsigned32(text: Column) -> Column:
    """Decimal text to an unsigned 32-bit number as BIGINT; an optional plus sign, no blanks."""
    digits = F.regexp_replace(text, r"^\+?0*(?=[0-9])", "")
    number = F.when(F.length(digits) <= 10, digits).try_cast("bigint")
    return F.when(text.rlike(r"^\+?[0-9]+\z") & (number <= MAX_ASN), number)


def parse_asn(text: Column) -> Column:
    """AS number with at most one case-sensitive `AS` prefix; null when it is not one."""
    return unsigned32(F.regexp_replace(text, "^AS", ""))


def parse_asn_strict(text: Column) -> Column:
    """AS number after trimming and dropping any run of `AS`, then of `as`; a bad entry fails the job."""
    asn = unsigned32(F.regexp_replace(strip(text), "^(AS)*(as)*", ""))
    return F.when(asn.isNotNull(), asn).otherwise(
        F.raise_error(F.concat(F.lit("invalid AS number: "), F.coalesce(text, F.lit("null")))).cast("bigint")
    )


def continent_of(country: Column) -> Column:
    """Continent code of a country code, null when unknown."""
    out = F.lit(None).cast("string")
    for code, countries in CONTINENT_COUNTRIES.items():
        out = F.when(country.isin(countries.split()), code).otherwise(out)
    return out


def parse_origin_txt(text: Column) -> Column:
    """`asn | prefix | country | registry | date` to a struct; null when short or the AS number is bad."""
    def build(parts: Column) -> Column:
        fields = F.transform(parts, strip)

        def named(f: Column) -> Column:
            asn = unsigned32(f[0])
            return F.when(
                (F.size(f) == 5) & asn.isNotNull(),
                F.struct(
                    asn.alias("asn"),
                    F.get(f, 1).alias("prefix"),
                    F.get(f, 2).alias("country"),
                    F.get(f, 3).alias("registry"),
                    F.get(f, 4).alias("allocated"),
                ),
            )

        return let(fields, named)

    return let(F.split(text, r"\|", 5), build)


def parse_asname_txt(text: Column) -> Column:
    """Organisation name of an AS-name answer: fifth part without its country suffix."""
    name = strip(F.get(F.split(text, r"\|", 5), 4))
    return F.when(name != "", trim_country_suffix(name))


def trim_country_suffix(name: Column) -> Column:
    """Drop a trailing `, XX` of two ASCII capitals."""
    return F.regexp_replace(name, r", [A-Z]{2}\z", "")


def trim_trailing_dots(name: Column) -> Column:
    """Host name of a PTR answer."""
    return F.regexp_replace(name, r"\.+\z", "")


def epoch_to_iso(seconds: Column) -> Column:
    """Unix seconds to ISO text in UTC with second precision."""
    stamp = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snake_case(header: Column) -> Column:
    """Column name for a sheet header; letters and digits of any script stay."""
    words = F.regexp_replace(F.lower(strip(header)), r"(?U)[^\p{IsAlphabetic}\p{N}]+", "_")
    return F.regexp_replace(words, "^_+|_+$", "")


def number_text(value: Column) -> Column:
    """Double as text, whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.try_cast("bigint").cast("string")).otherwise(value.cast("string"))


# A sheet cell is a struct `kind, s, i, f, b` with kind string | int | float | bool | empty | other.
# Casts return `struct<value, bad boolean>`; `bad` drops the row.


def _cast(value: Column, bad: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(bad, F.lit(True)).alias("bad"))


def cast_cell_string(cell: Column) -> Column:
    kind = cell["kind"]
    value = (
        F.when(kind == "string", strip(cell["s"]))
        .when(kind == "float", number_text(cell["f"]))
        .when(kind == "int", cell["i"].cast("string"))
        .when(kind == "bool", cell["b"].cast("string"))
        .when(kind == "empty", F.lit(""))
    )
    return _cast(value, value.isNull())


def cast_cell_integer(cell: Column) -> Column:
    kind = cell["kind"]
    text = strip(cell["s"])
    value = (
        F.when(kind == "int", cell["i"])
        .when(kind == "float", F.when(cell["f"] < 0, F.ceil(cell["f"])).otherwise(F.floor(cell["f"])))
        .when(kind == "string", F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint")))
        .when(kind == "bool", cell["b"].cast("bigint"))
    )
    return _cast(value, value.isNull())


def cast_cell_bool(cell: Column) -> Column:
    kind = cell["kind"]
    text = F.lower(strip(cell["s"]))
    value = (
        F.when(kind == "bool", cell["b"])
        .when((kind == "string") & text.isin("true", "1"), True)
        .when((kind == "string") & text.isin("false", "0"), False)
        .when(kind == "int", cell["i"] != 0)
    )
    return _cast(value, value.isNull())


def no_nets() -> Column:
    """Empty prefix list."""
    return F.array().cast(f"array<{CIDR_TYPE}>")


def _cell_nets(cell: Column) -> Column:
    return F.when(cell["kind"] == "string", parse_addresses(cell["s"])["nets"]).when(cell["kind"] == "empty", no_nets())


def cast_cell_addresses(cell: Column) -> Column:
    """Address cells never fail on bad tokens; only a cell of another type drops the row."""
    return _cast(_cell_nets(cell), ~cell["kind"].isin("string", "empty"))


def address_lists(cells: list[Column]) -> Column:
    """Prefix lists of several cells, in order; null for a cell of another type."""
    return F.transform(F.array(*cells), _cell_nets)


CELL_CASTS = {
    "string": cast_cell_string,
    "integer": cast_cell_integer,
    "bool": cast_cell_bool,
    "addresses": cast_cell_addresses,
}


def merge_addresses(cells: list[Column]) -> Column:
    """Addresses of several cells in order without repeats; null when there are none."""
    lists = F.transform(address_lists(cells), lambda nets: F.coalesce(nets, no_nets()))
    return let(F.array_distinct(F.flatten(lists)), lambda nets: F.when(F.size(nets) > 0, nets))
