"""Scalar expressions, Column to Column; all built in, none a Python UDF.

"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- numbers -------------------------------------------------------------


def safe_divide(numerator: Column | str, denominator: Column | str, fallback: float | None = 0.0) -> Column:
    """[X7, P18] The quotient as a double; ``fallback`` for a null or zero denominator."""
    num, den = _c(numerator).cast("double"), _c(denominator).cast("double")
    return F.when(den.isNull() | (den == 0), F.lit(fallback).cast("double")).otherwise(num / den)


def clean_number(x: Column | str, to: str = "double") -> Column:
    """[X3] Null for '', 'None' and what isn't a number."""
    text = F.trim(_c(x).cast("string"))
    number = F.when(~text.isin("", "None"), text).try_cast("double")
    return number if to == "double" else F.when(~F.isnan(number), number).try_cast(to)


def clip(x: Column | str, low: float, high: float) -> Column:
    """[X15] Bounded, null stays null."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(low)), F.lit(high)))


def in_range_or_null(x: Column | str, low: float, high: float) -> Column:
    """[P13] Null outside of the range."""
    return F.when(_c(x).between(low, high), _c(x))


def money(x: Column | str, scale: int = 2) -> Column:
    """An exact decimal, so that sums don't depend on their order."""
    return _c(x).cast(T.DecimalType(18, scale))


# --- text ----------------------------------------------------------------


def normal_text(x: Column | str) -> Column:
    """[P2, X14] Trimmed and lower case."""
    return F.lower(F.trim(_c(x)))


def blank_to_null(x: Column | str) -> Column:
    """[X13] Null for the empty text."""
    return F.nullif(_c(x), F.lit(""))


def contains_any(x: Column | str, words: Iterable[str]) -> Column:
    """[P20, R6] Whether any of ``words`` is a substring, whatever the case; false for null."""
    low = F.lower(_c(x))
    hits = [low.contains(w.lower()) for w in words]
    found = F.lit(False)
    for h in hits:
        found = found | h
    return F.coalesce(found, F.lit(False))


def is_digits(x: Column | str) -> Column:
    """[X5]"""
    return F.coalesce(_c(x).rlike(r"^\d+$"), F.lit(False))


def title(x: Column | str) -> Column:
    """[P12, X14] First letter of each word in upper case, words parted by blanks."""
    return F.initcap(_c(x))


# --- keys ----------------------------------------------------------------


def surrogate_key(*columns: Column | str) -> Column:
    """[X8] MD5 over the columns joined by '-'; null counts as a fixed mark."""
    return F.md5(F.concat_ws("-", *[F.coalesce(_c(x).cast("string"), F.lit("_null_")) for x in columns]))


def event_key(*columns: Column | str) -> Column:
    """[X9, P14] SHA-256 over the columns joined by '||'; null counts as ''."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(_c(x).cast("string"), F.lit("")) for x in columns]), 256)


def short_name(prefix: str, *columns: Column | str) -> Column:
    """[X9] ``prefix`` and the first ten digits of a SHA-1, for names of bounded length."""
    return F.concat(F.lit(prefix), F.lit("_"), F.substring(F.sha1(F.concat_ws("|", *[_c(x).cast("string") for x in columns])), 1, 10))


# --- time ----------------------------------------------------------------


def clock_seconds(x: Column | str) -> Column:
    """[X1] Seconds of 'M:S' or 'H:M:S' with fractions; null for anything else."""
    parts = F.split(F.trim(_c(x)), ":")
    n, at = F.size(parts), lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return (
        F.when(n == 3, at(0) * 3600 + at(1) * 60 + at(2))
        .when(n == 2, at(0) * 60 + at(1))
    )


def gap_seconds(x: Column | str) -> Column:
    """[X2] '+5.123' is 5.123; no text is 0; laps behind, clock times and the rest are null."""
    text = _c(x)
    return (
        F.when(text.isNull() | (text == ""), F.lit(0.0))
        .otherwise(F.ltrim(F.trim(text), F.lit("+")).try_cast("double"))
    )


def day_part(hour: Column | str) -> Column:
    """[X6] Time of day of an hour."""
    h = _c(hour)
    return (
        F.when(h.between(6, 9), "morning_rush").when(h.between(10, 15), "midday")
        .when(h.between(16, 19), "evening_rush").when(h.between(20, 22), "evening").otherwise("overnight")
    )


def minute_boundaries(start: Column | str, end: Column | str) -> Column:
    """[X11, P8] Whole minutes begun between two times, as a count of minute boundaries."""
    minute = lambda x: F.unix_timestamp(F.date_trunc("minute", _c(x).cast("timestamp")))
    return ((minute(end) - minute(start)) / 60).cast("long")


def day_count(start: Column | str, end: Column | str) -> Column:
    """[X11] Days between two dates."""
    return F.datediff(_c(end), _c(start))


def weekday_number(x: Column | str) -> Column:
    """[X10, P9] 1 is Sunday."""
    return F.dayofweek(_c(x))


def weekday_name(x: Column | str) -> Column:
    return F.date_format(_c(x), "EEEE")


def year_month(x: Column | str) -> Column:
    return F.date_format(_c(x), "yyyy-MM")


def parsed_time(x: Column | str, pattern: str | None = None) -> Column:
    """[X12] A timestamp, or null for what isn't one."""
    return F.try_to_timestamp(_c(x), F.lit(pattern)) if pattern else F.try_to_timestamp(_c(x))


def hour_parts(x: Column | str) -> dict[str, Column]:
    """[A6, C10, C17] Partition columns year, month, day, hour, as padded text."""
    return {name: F.date_format(_c(x), pattern) for name, pattern in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))}


def hour_from_path(path: Column | str) -> Column:
    """[X17, S18] The hour of a path that holds year=/month=/day=/hour= folders, as a timestamp; null if there is none."""
    found = lambda name, n: F.regexp_extract(_c(path), rf"{name}=(\d{{{n}}})", 1)
    return F.try_to_timestamp(F.concat_ws("-", found("year", 4), found("month", 2), found("day", 2), found("hour", 2)), F.lit("yyyy-MM-dd-HH"))


# --- categories ----------------------------------------------------------

#: Results that count as finished, and words of the retirement groups.
FINISHED = ("Finished", "+1 Lap", "+2 Laps", "+3 Laps", "+4 Laps", "+5 Laps")
NOT_STARTED = ("Did not qualify", "Did not prequalify")
MECHANICAL = ("Engine", "Gearbox", "Hydraulics", "Brakes", "Electrical", "Transmission", "Clutch", "Turbo", "Oil", "Water", "Fire", "Exhaust", "Wheel", "Suspension", "Differential", "Alternator", "Fuel", "ERS", "MGU", "Power Unit", "Overheating")
ACCIDENT = ("Accident", "Collision", "Spun off", "Damage")


def status_category(x: Column | str) -> Column:
    """[X4] FINISHED, DISQUALIFIED, DID_NOT_START, RETIRED_MECHANICAL, RETIRED_ACCIDENT or OTHER; the first that fits."""
    s = _c(x)
    return (
        F.when(s.isin(*FINISHED), "FINISHED").when(s == "Disqualified", "DISQUALIFIED").when(s.isin(*NOT_STARTED), "DID_NOT_START")
        .when(contains_any(s, MECHANICAL), "RETIRED_MECHANICAL").when(contains_any(s, ACCIDENT), "RETIRED_ACCIDENT").otherwise("OTHER")
    )


def sentiment(score: Column | str) -> Column:
    """[P3] 4 and more positive, 3 neutral, less negative; null stays null."""
    return F.when(_c(score) >= 4, "positive").when(_c(score) == 3, "neutral").when(_c(score) < 3, "negative")


# --- JSON ----------------------------------------------------------------


def decode_json(payload: Column | str, schema: str | T.StructType) -> Column:
    """[S20, X16] A struct from JSON bytes or text; null if malformed."""
    text = _c(payload).cast("string")
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(text).isNotNull(), parsed)


def decode_base64_json(payload: Column | str, schema: str | T.StructType) -> Column:
    """[S21] A struct from Base64 text of JSON; null if either is malformed."""
    return decode_json(F.when(F.coalesce(_c(payload).rlike(r"^[A-Za-z0-9+/]*={0,2}$"), F.lit(False)), F.unbase64(_c(payload))), schema)


def missing_fields(record: Column | str, names: Iterable[str]) -> Column:
    """[S20, S21] Names of the fields of a struct that are null or ''."""
    at = _c(record)
    absent = [F.when(at[n].isNull() | (at[n].cast("string") == ""), F.lit(n)) for n in names]
    return F.array_compact(F.array(*absent))
