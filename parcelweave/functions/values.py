"""Dates, arrays, casts and JSON as expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelweave.functions.text import col


# dates


def day(value: dt.date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def month_key(date: Column | str) -> Column:
    return F.date_format(col(date), "yyyy-MM")


def iso_micros(ts: Column | str) -> Column:
    return F.date_format(col(ts).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def years_before(as_of: dt.date | str | Column, years: int) -> Column:
    return F.add_months(day(as_of), -12 * years)


def short_date(date: Column | str) -> Column:
    """Month, day of the week counted from Sunday as 1, year."""
    d = col(date)
    return F.concat(F.date_format(d, "MMM"), F.lit(" "), F.dayofweek(d).cast("string"), F.lit(", "), F.date_format(d, "yyyy"))


def is_late(as_of: Column, value: Column, expected: Column, threshold: Column) -> Column:
    """Whether an update due ``expected`` after ``value`` is late by more than ``threshold``; day-time intervals."""
    return ((as_of.cast("timestamp") - expected) - value.cast("timestamp")) > threshold


# arrays


def array_or_null(a: Column | str) -> Column:
    """Without nulls; null if nothing is left."""
    return F.nullif(F.array_compact(col(a)), F.array().cast("array<string>"))


def length_or_null(a: Column | str) -> Column:
    """The number of elements; null for none."""
    return F.nullif(F.size(col(a)), F.lit(0))


def overlap(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.arrays_overlap(col(a), col(b)), F.lit(False))


def nearest(c: Column | str) -> Column:
    """The nearest whole number of a double that isn't negative, halves up: ``round`` without its decimal."""
    x = col(c)
    return F.floor(x) + (x - F.floor(x) >= 0.5).cast("long")


def last_element(a: Column | str) -> Column:
    return F.try_element_at(col(a), F.lit(-1))


def split_evenly(a: Column | str, parts: Column) -> Column:
    """An array in ``parts`` consecutive pieces, the first of which are longer by one where it doesn't divide."""
    own = col(a)
    least, more = F.floor(F.size(own) / parts).cast("int"), F.size(own) % parts
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.slice(own, i * least + F.least(i, more) + 1, least + F.when(i < more, 1).otherwise(0)))


# casts and guards


def typed(text: Column | str, kind: str) -> Column:
    """A cast of text, of which blank is null."""
    return F.nullif(col(text), F.lit("")).cast(kind)


def round_int(x: Column | str) -> Column:
    """To the nearest integer, halves to the even one."""
    return F.bround(col(x).cast("double")).cast("int")


def ratio(a: Column | str, b: Column | str) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def or_zero(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(0))


def latest_non_zero(*columns: Column | str, default: int | None = None) -> Column:
    """The first value, in the order given, that is neither null nor 0."""
    found = [F.nullif(col(c), F.lit(0)) for c in columns]
    return F.coalesce(*found, *([] if default is None else [F.lit(default)]))


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def any_in(columns: dict[str, list]) -> Column:
    """Whether any column has one of its values; an empty list matches nothing."""
    out = F.lit(False)
    for name, values in columns.items():
        if values:
            out = out | is_true(F.col(name).isin(list(values)))
    return out


def band(value: Column | str, bounds: list[tuple[float, float]], beyond: float, missing: float = 0.0) -> Column:
    """The weight of the first bound that the value is under."""
    v = col(value)
    out = F.when(v.isNull(), F.lit(missing))
    for bound, weight in bounds:
        out = out.when(v < bound, F.lit(weight))
    return out.otherwise(F.lit(beyond))


# JSON


def to_json(value: Column | str) -> Column:
    """JSON with null fields kept."""
    return F.to_json(col(value), {"ignoreNullFields": "false"})


def json_quoted(text: Column) -> Column:
    """A JSON string in ASCII, but for letters outside it, which ``object_id`` escapes."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"'))


def ascii_escaped(text: Column) -> Column:
    """Letters outside ASCII as ``\\uXXXX`` of their UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("([0-9A-F]{4})"), 1)
    return F.array_join(F.transform(units, lambda u: F.when(u < "0080", F.decode(F.unhex(u), "UTF-16BE")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")


def object_id(fields: dict[str, Column]) -> Column:
    """MD5 of the object's JSON with sorted keys, ``", "`` and ``": "`` between, in ASCII."""
    inside = [F.concat(F.lit(f'"{k}": '), json_quoted(v)) for k, v in sorted(fields.items())]
    return F.md5(ascii_escaped(F.concat(F.lit("{"), F.concat_ws(", ", *inside), F.lit("}"))).cast("binary"))
