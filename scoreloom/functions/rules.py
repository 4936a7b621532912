"""Column rules: rounding, bands, statuses, white space, predicates and query strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom import rubric

#: Fixed value: white space as browsers trim it, which neither \s nor trim() matches.
BLANKS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: What schema_of_variant says of a number.
NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
EMAIL = rf"^[^{BLANKS}@]+@[^{BLANKS}@]+\.[^{BLANKS}@]+\z"


def percent(raw: Column, most: int) -> Column:
    """Half up, as a whole number."""
    return percent_of(raw, F.lit(most))


def percent_of(raw: Column, most: Column) -> Column:
    return F.floor(raw / most * 100 + F.lit(0.5)).cast("int")


def status(percentage: Column) -> Column:
    """The first status whose upper bound holds the percentage; the best one above all bounds, and for NaN."""
    return reduce(lambda rest, s: F.when(percentage <= s[0], s[1]).otherwise(rest), reversed(rubric.STATUSES), F.lit(rubric.BEST_STATUS))


def band(percentage: Column) -> Column:
    """The title of the band that holds the percentage; that of the first band if none does."""
    chain = reduce(lambda rest, b: F.when(percentage.between(b[0], b[1]), b[2]).otherwise(rest), reversed(rubric.BANDS), F.lit(rubric.BANDS[0][2]))
    return chain


def severity(of: Column) -> Column:
    """0 for Strong, up to 4 for a severe leak; unknown statuses are severe."""
    names = [s for _, s in rubric.STATUSES]
    return F.coalesce(F.nullif(F.lit(len(names)) + 1 - F.array_position(F.array(*map(F.lit, names)), of).cast("int"), F.lit(len(names) + 1)), F.when(of == rubric.BEST_STATUS, 0).otherwise(len(names))).cast("int")


def icon(of: Column) -> Column:
    return F.when(of == rubric.BEST_STATUS, "check").when(of == rubric.STATUSES[-1][1], "minor").otherwise("alert")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(EMAIL), F.lit(False))


def is_filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def query_parameters(url: Column) -> Column:
    """The url's query as an array of (key, value) in order: decoded, a missing value empty, of a repeated key the last only.

    A % that begins no byte stays as it is; bytes that are no UTF-8 become U+FFFD. A url without a query has none. No row is taken apart for this, so nothing is shuffled.
    """
    decoded = lambda x: F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^#?]*\?([^#]*)", 1), "&"), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(decoded(F.substring_index(x, "=", 1)).alias("key"), decoded(F.regexp_replace(x, r"^[^=]*=?", "")).alias("value")))
    last = lambda p: F.filter(p, lambda x, k: ~F.exists(F.slice(p, k + 2, F.greatest(F.size(p), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.get(F.transform(F.array(pairs), last), F.lit(0))  # a lambda's own array, so that it is decoded once


def tracked_parameters(url: Column) -> Column:
    """Those that campaigns set: utm_* and the two click ids, case-sensitive."""
    return F.filter(query_parameters(url), lambda x: F.startswith(x["key"], F.lit("utm_")) | x["key"].isin("gclid", "fbclid"))


def iso_time(at: Column) -> Column:
    """A timestamp as text in UTC with milliseconds, whatever the session's time zone; one without a zone is taken to be in UTC."""
    seconds = (F.unix_micros(at.cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    text = F.when(F.typeof(at) == "timestamp_ntz", at.cast("timestamp_ntz")).otherwise(utc).cast("string")
    part = lambda start, n: F.substring(text, start, n)
    return F.concat(part(1, 10), F.lit("T"), part(12, 8), F.lit("."), F.rpad(part(21, 3), 3, "0"), F.lit("Z"))


def micros(at: Column) -> Column:
    """A timestamp as microseconds since 1970, to order by; one without a zone is taken to be in UTC."""
    day = F.unix_date(at.cast("date")).cast("long") * 86_400_000_000
    of_day = ((F.hour(at) * 60 + F.minute(at)) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.when(F.typeof(at) == "timestamp_ntz", day + of_day).otherwise(F.unix_micros(at.cast("timestamp")))


#: Before all times: microseconds that no timestamp has.
NEVER = -(1 << 62)


def moment(at: Column, event_id: Column) -> Column:
    """(at, event_id) as one number that orders as the pair does, null first in each. Of fixed width, so that hash aggregation can hold it
    and combine rows before they are dealt."""
    second = F.coalesce(event_id, F.lit(-(1 << 63))).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return (F.coalesce(micros(at), F.lit(NEVER)).cast("decimal(19,0)") * F.lit(str(1 << 62)).cast("decimal(19,0)") * 4 + second).cast("decimal(38,0)")


def variant_fields(value: Column, names: tuple[str, ...]) -> Column:
    """The fields of a VARIANT object as a struct of VARIANT: null where they are missing, and null as a whole for what is no object."""
    return F.try_variant_get(value, "$", f"struct<{', '.join(f'{n}: variant' for n in names)}>")


def given(value: Column) -> Column:
    """A value as VARIANT, of which a null stays null in JSON; fields that are SQL NULL are left out of JSON, as undefined ones are."""
    return F.coalesce(value.cast("variant"), F.parse_json(F.lit("null")))


def session_id(seed: int | None = None) -> Column:
    """A new random id for each row, as a browser makes one for a new visitor."""
    return F.uuid() if seed is None else F.uuid(seed)


def fallback_session_id(at: Column, seed: int | None = None) -> Column:
    """session_, the time in milliseconds, and random hexadecimal digits: the id where there is no UUID."""
    digits = F.lower(F.hex(F.floor((F.rand() if seed is None else F.rand(seed)) * float(1 << 52))))
    return F.concat(F.lit("session_"), F.floor(micros(at) / 1000).cast("string"), F.lit("_"), digits)


def total_label(raw: Column) -> Column:
    return F.concat(raw.cast("string"), F.lit(f"/{rubric.MAX_TOTAL}"))


def percent_label(percentage: Column) -> Column:
    return F.concat(percentage.cast("string"), F.lit("%"))
