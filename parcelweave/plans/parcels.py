"""Parcels, their owners' portfolios and their indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions.text import house_number, norm_address, street_name
from parcelweave.functions.values import or_zero, typed
from parcelweave.operators.relational import latest_by, list_members, with_dense_id

#: Where the pin lists of permits are cut.
LIST_CUT = r"\s*\|\s*"


def _latest(df: DataFrame) -> DataFrame:
    """The row of the latest year of each pin; of several the one with the smallest row id."""
    return latest_by(df, ["pin"], typed("year", "int"), F.col("row_id").asc_nulls_last())


def owner_key() -> Column:
    return F.coalesce(F.nullif("mail_address_name", F.lit("")), F.nullif("row_id", F.lit("")), F.col("pin"))


def _with_owner(parcels: DataFrame, owners: DataFrame, own: list[str], theirs: list[str]) -> DataFrame:
    return _latest(parcels).select("pin", *own).join(_latest(owners).select("pin", *theirs), "pin", "left")


def build_parcels(parcels: DataFrame, owners: DataFrame) -> DataFrame:
    """One row for each pin: its latest parcel with its latest owner."""
    rows = _with_owner(
        parcels, owners,
        ["pin10", "class", "zip_code", "lat", "lon", "ward_num", "chicago_community_area_name", "census_tract_geoid"],
        ["prop_address_full", "prop_address_city_name", "prop_address_state", "prop_address_zipcode_1", "mail_address_name", "mail_address_full", "mail_address_city_name", "mail_address_state", "mail_address_zipcode_1", "row_id"],
    )
    address = F.col("prop_address_full")
    return rows.select(
        "pin",
        house_number(address).alias("housenumber"),
        street_name(address).alias("streetname"),
        address.alias("address"),
        F.col("prop_address_city_name").alias("city"),
        F.col("prop_address_state").alias("state"),
        F.coalesce("prop_address_zipcode_1", "zip_code").alias("zip"),
        F.lit(None).cast("int").alias("units_res"),
        F.col("class").alias("land_class"),
        F.lit(None).cast("string").alias("building_class"),
        F.col("row_id").alias("owner_id"),
        F.col("mail_address_name").alias("owner_name"),
        F.col("mail_address_full").alias("mailing_address"),
        F.col("mail_address_city_name").alias("mailing_city"),
        F.col("mail_address_state").alias("mailing_state"),
        F.col("mail_address_zipcode_1").alias("mailing_zip"),
        typed("lat", "double").alias("lat"),
        typed("lon", "double").alias("lng"),
        F.col("ward_num").alias("ward"),
        F.col("chicago_community_area_name").alias("community_area"),
        F.col("census_tract_geoid").alias("census_tract"),
        "pin10",
    )


def portfolios_of(rows: DataFrame, key: Column | str, member: str, members: str = "pins", names: str = "owner_names") -> DataFrame:
    """Groups of members by key, with a dense id in the order of the keys."""
    key = F.col(key) if isinstance(key, str) else key
    groups = rows.groupBy(key.alias("_key")).agg(F.array_sort(F.collect_list(member)).alias(members)).where(F.size(members) > 0)
    numbered = with_dense_id(groups, [F.col("_key").asc_nulls_last()], "orig_id")
    return numbered.select(F.col("orig_id").cast("int").alias("orig_id"), members, F.array("_key").alias(names), F.lit("{}").alias("graph"))


def build_portfolios(parcels: DataFrame, owners: DataFrame) -> DataFrame:
    """Pins with one owner, named by mailing name, else by the owner's row, else by the pin itself."""
    return portfolios_of(_with_owner(parcels, owners, [], ["mail_address_name", "row_id"]), owner_key(), "pin")


def portfolio_members(portfolios: DataFrame, members: str = "pins", member: str = "pin") -> DataFrame:
    """A row for each member, so that membership is an equality."""
    return portfolios.select(F.explode(members).alias(member), "orig_id")


def count_by_list(rows: DataFrame, key: str, lists: DataFrame, text: str, name: str, on: str) -> DataFrame:
    """For each row, how often its ``on`` is an element of the lists; repeats count."""
    counts = list_members(lists, [], text, LIST_CUT, on).groupBy(on).agg(F.count(F.lit(1)).alias(name))
    return rows.select(key, on).join(counts, on, "left").select(key, or_zero(name).alias(name))


def count_by_address(rows: DataFrame, key: str, address: Column, facts: DataFrame, theirs: Column, aggregates: list[Column]) -> DataFrame:
    """For each row, aggregates of the facts at its normalised address; facts without one match nothing."""
    grouped = facts.withColumn("_a", theirs).where("_a <> ''").groupBy("_a").agg(*aggregates)
    names = [c for c in grouped.columns if c != "_a"]
    return rows.select(key, address.alias("_a")).join(grouped, "_a", "left").select(key, *[or_zero(c).alias(c) for c in names])


def build_indicators(parcels: DataFrame, permits: DataFrame, violations: DataFrame, requests: DataFrame, strict_unit: bool = False) -> DataFrame:
    """One row for each parcel: permits by pin list; violations and requests by address, aggregated before they are joined."""
    ours = norm_address("address", strip_unit=True, strict_unit=strict_unit)

    def theirs() -> Column:
        return norm_address(F.concat_ws(" ", "street_number", "street_direction", "street_name", "street_type"))

    by_permit = count_by_list(parcels, "pin", permits, "pin_list", "permits_total", "pin10")
    open_ = F.coalesce(F.col("violation_status"), F.lit("")).ilike("open%")
    by_violation = count_by_address(parcels, "pin", ours, violations, theirs(), [F.count_if(open_).alias("violations_open"), F.count(F.lit(1)).alias("violations_total")])
    by_request = count_by_address(parcels, "pin", ours, requests, theirs(), [F.count(F.lit(1)).alias("requests_311_total")])
    return by_permit.join(by_violation, "pin").join(by_request, "pin").select("pin", "permits_total", "violations_open", "violations_total", "requests_311_total")
