"""The lookups as table functions that SQL can call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parcelweave.plans.lookup import ADDRESS, COUNTS
from parcelweave.plans.parcels import portfolio_members


def register_pin_functions(parcels: DataFrame, portfolios: DataFrame, indicators: DataFrame) -> None:
    """``assoc_addrs_from_pin(pin)`` and ``agg_info_from_pin(pin)`` for this session, over these tables.

    Membership is kept as a long table, so that a call is two equalities; give tables that are
    written and sorted by pin, of which a call then reads a few row groups.
    """
    spark = parcels.sparkSession
    parcels.createOrReplaceTempView("pw_parcels")
    portfolio_members(portfolios).createOrReplaceTempView("pw_members")
    indicators.createOrReplaceTempView("pw_indicators")
    kinds = {f.name: f.dataType.simpleString() for f in parcels.schema}
    columns = [f"{c} {kinds[c]}" for c in ADDRESS] + [f"{c} bigint" for c in COUNTS]
    own, counts = ", ".join(f"p.{c}" for c in ADDRESS), ", ".join(f"coalesce(i.{c}, 0)" for c in COUNTS)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION assoc_addrs_from_pin(wanted STRING) RETURNS TABLE({", ".join(columns)})
      RETURN SELECT DISTINCT {own}, {counts} FROM pw_members o JOIN pw_members m ON m.orig_id = o.orig_id JOIN pw_parcels p ON p.pin = m.pin LEFT JOIN pw_indicators i ON i.pin = p.pin
      WHERE o.pin = wanted""")
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS INT)" for c in ("units_res", *COUNTS))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION agg_info_from_pin(wanted STRING) RETURNS TABLE(parcels int, units_res int, {", ".join(f"{c} int" for c in COUNTS)})
      RETURN SELECT CAST(count(*) AS INT), {sums} FROM assoc_addrs_from_pin(wanted)""")


def register_building_functions(buildings: DataFrame, registered: DataFrame, contacts: DataFrame) -> None:
    """``assoc_addrs_from_bbl(bbl)`` and ``assoc_addrs_from_name(first, last)``, as in ``buildings_from_bbl`` and ``buildings_from_name``."""
    from parcelweave.plans.buildings import relation_keys

    spark = buildings.sparkSession
    keyed = relation_keys(registered).distinct()
    own = registered.select("bbl", "registrationid")
    shared = own.join(keyed, "registrationid").select("bbl", "key").distinct().join(keyed, "key").select("bbl", "registrationid")
    buildings.createOrReplaceTempView("pw_buildings")
    shared.union(own).createOrReplaceTempView("pw_related")
    contacts.select("registrationid", "firstname", "lastname").createOrReplaceTempView("pw_contacts")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in buildings.schema)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION assoc_addrs_from_bbl(wanted STRING) RETURNS TABLE({columns})
      RETURN SELECT DISTINCT b.* FROM pw_related r JOIN pw_buildings b ON b.registrationid = r.registrationid WHERE r.bbl = wanted""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION assoc_addrs_from_name(given STRING, family STRING) RETURNS TABLE({columns})
      RETURN SELECT DISTINCT b.* FROM pw_contacts c JOIN pw_buildings b ON b.registrationid = c.registrationid WHERE upper(c.firstname) = upper(given) AND upper(c.lastname) = upper(family)""")
