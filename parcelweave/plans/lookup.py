"""Lookups by parcel and text, and what a client derives from them."""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions.text import sentence_list, title_case
from parcelweave.functions.values import or_zero
from parcelweave.operators.relational import co_members
from parcelweave.plans import indexes
from parcelweave.sources.load import csv_lines, join_parts, json_parts, point, result_lines

COUNTS = ("permits_total", "violations_open", "violations_total", "requests_311_total")
ADDRESS = (
    "pin", "housenumber", "streetname", "address", "city", "state", "zip", "units_res", "land_class", "building_class", "owner_id", "owner_name",
    "mailing_address", "mailing_city", "mailing_state", "mailing_zip", "lat", "lng", "ward", "community_area", "census_tract",
)
PIN = re.compile(r"[0-9]{14}")


def valid_pin(pin: str | None) -> str:
    if pin is None or not PIN.fullmatch(pin.strip()):
        raise ValueError(f"Invalid PIN: {pin!r}")
    return pin.strip()


def valid_pins(text: str | None) -> list[str]:
    """A comma-separated list of pins."""
    if not text or not text.strip():
        raise ValueError("a list of pins is required")
    return [valid_pin(p) for p in text.split(",")]


def valid_query(q: str | None) -> str:
    if not q or not q.strip():
        raise ValueError("a search text is required")
    return q.strip()


def _with_counts(parcels: DataFrame, indicators: DataFrame) -> DataFrame:
    return parcels.join(indicators, "pin", "left").select(*ADDRESS, *[or_zero(c).alias(c) for c in COUNTS])


def _members(portfolios: DataFrame | str, parcels: DataFrame, pin: str) -> DataFrame:
    if isinstance(portfolios, str):
        return indexes.co_members(parcels.sparkSession, portfolios, pin)
    return co_members(portfolios, "pins", pin, "pin")


def portfolio_addresses(parcels: DataFrame, portfolios: DataFrame | str, indicators: DataFrame, pin: str) -> DataFrame:
    """All parcels of the portfolios that hold a pin, in order; none for an unknown pin.

    ``portfolios`` is the table, or the path of what ``indexes.write_members`` wrote of it, from
    which a pin's portfolios are read without the others.
    """
    pin = valid_pin(pin)
    return _with_counts(parcels.join(_members(portfolios, parcels, pin), "pin", "left_semi"), indicators).orderBy("pin")


def portfolio_totals(parcels: DataFrame, portfolios: DataFrame | str, indicators: DataFrame, pin: str) -> DataFrame:
    """One row of sums over a pin's portfolios; zeros for an unknown pin."""
    rows = portfolio_addresses(parcels, portfolios, indicators, pin)
    return rows.agg(F.count(F.lit(1)).cast("int").alias("parcels"), *[F.coalesce(F.sum(c), F.lit(0)).cast("int").alias(name) for c, name in (("units_res", "units_res"), *[(c, c) for c in COUNTS])])


def building_info(parcels: DataFrame, indicators: DataFrame, pin: str) -> DataFrame:
    return _with_counts(point(parcels, "pin", valid_pin(pin)), indicators)


def _search_texts() -> list[Column]:
    both = F.concat(F.coalesce("housenumber", F.lit("")), F.lit(" "), F.coalesce("streetname", F.lit("")))
    return [F.coalesce("address", F.lit("")), both]


def write_search_index(parcels: DataFrame, path: str) -> None:
    """What ``address_search`` reads in place of all addresses."""
    indexes.write_trigrams(parcels, path, "pin", *_search_texts())


def address_search(parcels: DataFrame, q: str, limit: int = 5, index: str | None = None) -> DataFrame:
    """The first addresses that contain a text, in any case; ``%`` and ``_`` in it are wildcards.

    With the path of a search index only parcels with the text's rarest trigrams are compared; a text without
    three plain characters in a row is compared with all.
    """
    # a backslash stands for the character behind it, which LIKE takes for wildcards and backslashes only
    pattern = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{valid_query(q)}%", flags=re.DOTALL)
    near = indexes.candidates(parcels.sparkSession, index, valid_query(q)) if index else None
    rows = parcels if near is None else parcels.join(near.withColumnRenamed("key", "pin"), "pin", "left_semi")
    address, both = _search_texts()
    rows = rows.where(address.ilike(pattern) | both.ilike(pattern))
    return rows.orderBy(F.col("address").asc_nulls_last(), "pin").limit(limit).select("pin", "housenumber", "streetname", "address", "city", "state", "zip")


def address_response(parcels: DataFrame, portfolios: DataFrame, indicators: DataFrame, pin: str) -> Iterator[str]:
    """A portfolio's addresses as JSON beside the pin asked for, in pieces."""
    rows = portfolio_addresses(parcels, portfolios, indicators, pin)
    return result_lines(rows, "addrs", geosearch=json.dumps({"pin": valid_pin(pin)}))


def address_export(parcels: DataFrame, portfolios: DataFrame, indicators: DataFrame, pin: str) -> Iterator[str] | None:
    """A portfolio's addresses as CSV, line by line; ``None`` for an unknown pin."""
    lines = csv_lines(portfolio_addresses(parcels, portfolios, indicators, pin))
    first = next(lines, None)
    return None if first is None else itertools.chain([first], lines)


def export_portfolios(portfolios: DataFrame, path: str, work: str | None = None) -> None:
    """All portfolios as one JSON array in the order of their ids, in the file ``path``; its parts are written to the folder ``work``."""
    rows = portfolios.select("orig_id", "pins", "owner_names", F.from_json("graph", "struct<nodes:array<string>,edges:array<string>>").alias("portfolio"))
    parts = work or f"{path}-parts-{uuid.uuid4().hex}"
    json_parts(rows, parts, "orig_id", "pins")
    join_parts(portfolios.sparkSession, parts, path)


def building_infos(parcels: DataFrame, indicators: DataFrame) -> DataFrame:
    """What ``building_info`` tells, for all parcels."""
    return _with_counts(parcels, indicators)


def answered(asked: DataFrame, pin: str, known: DataFrame) -> DataFrame:
    """``asked`` with ``status`` and, where there is one, ``answer``: the row of ``known`` for each pin as JSON, or what is wrong with the pin."""
    key = F.trim(F.col(pin))
    good = F.coalesce(key.rlike(f"^{PIN.pattern}$"), F.lit(False))
    rows = known.select(F.col("pin").alias("_key"), F.to_json(F.struct(*known.columns), {"ignoreNullFields": "false"}).alias("answer"))
    error = F.to_json(F.struct(F.lit("Bad request").alias("error"), F.concat(F.lit("Invalid PIN: "), F.coalesce(F.col(pin), F.lit("None"))).alias("validationErrors")))
    return asked.join(rows, (key == F.col("_key")) & good, "left").drop("_key").withColumn("status", F.when(good, 200).otherwise(400)).withColumn("error", F.when(~good, error))


def summary(addresses: DataFrame) -> DataFrame:
    """What a client shows about a portfolio: counts, sums, and open violations by parcel and by unit."""
    sums = addresses.agg(F.count(F.lit(1)).alias("parcels"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("units_res", *COUNTS)])
    by = {"violations_open_per_parcel": "parcels", "violations_open_per_unit": "units_res"}
    return sums.select("*", *[F.when(F.col(d) != 0, F.col("violations_open") / F.col(d)).otherwise(F.lit(0.0)).alias(name) for name, d in by.items()])


def bounding_box(addresses: DataFrame) -> DataFrame:
    """The corners of all usable coordinates."""
    usable = addresses.where("lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)")
    return usable.agg(F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"))


def most_frequent(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties in order."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def headline(df: DataFrame, name: str, items: str) -> DataFrame:
    return df.select(title_case(name).alias(name), sentence_list(items).alias(items))


def respond(call, *args, **kwargs) -> tuple[int, Iterator[str]]:
    """A call's rows or error as a status and the body's pieces."""
    try:
        return 200, result_lines(call(*args, **kwargs))
    except ValueError as e:
        return 400, iter([json.dumps({"error": "Bad request", "validationErrors": str(e)})])
