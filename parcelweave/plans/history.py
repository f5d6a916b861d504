"""Evictions in court, deeds and monthly histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.functions.values import length_or_null, month_key, typed
from parcelweave.operators.relational import month_spine, unpivot_years, zero_filled

CLASSES = ("Holdover", "Non-Payment")
EMERGENCY = ("IMMEDIATE EMERGENCY", "HAZARDOUS", "EMERGENCY")
CALM = ("REFERRAL", "NON EMERGENCY")
#: The measures of a building's history, in order.
MEASURES = (
    "hpdviolations_class_a", "hpdviolations_class_b", "hpdviolations_class_c", "hpdviolations_class_i", "hpdviolations_total",
    "hpdcomplaints_emergency", "hpdcomplaints_nonemergency", "hpdcomplaints_total", "dobpermits_total", "dobviolations_regular", "dobviolations_ecb",
    "dobviolations_total", "evictionfilings", "rentstabilizedunits",
)


def _filings(index: DataFrame, addresses: DataFrame) -> DataFrame:
    """Residential holdover and non-payment filings in buildings of over ten units."""
    asked = index.where(F.col("classification").isin(*CLASSES) & (F.col("propertytype") == "Residential"))
    large = addresses.where("bbl IS NOT NULL").where(typed("unitsres", "double") > 10).select("indexnumberid", "bbl")
    return asked.join(large, "indexnumberid")


def evictions_by_building(index: DataFrame, addresses: DataFrame, since: str = "2017-01-01") -> DataFrame:
    rows = _filings(index, addresses).where(F.col("fileddate") >= since)
    return rows.groupBy("bbl").agg(F.countDistinct("indexnumberid").alias("eviction_filings_since_2017"))


def evictions_by_month(index: DataFrame, addresses: DataFrame) -> DataFrame:
    return _filings(index, addresses).groupBy("bbl", month_key("fileddate").alias("month")).agg(F.countDistinct("indexnumberid").alias("evictionfilings"))


def latest_deed(master: DataFrame, legals: DataFrame, bbl: str) -> DataFrame:
    """A building's last sale by the deed's own date."""
    sales = master.where((F.col("doctype") == "DEED") & (F.col("docamount") > 1))
    rows = sales.join(legals.where(F.col("bbl") == bbl).select("documentid"), "documentid", "left_semi")
    return rows.orderBy(F.col("docdate").desc_nulls_last(), "documentid").limit(1).select("documentid", F.coalesce("docdate", "recordedfiled").alias("docdate"), "docamount")


def portfolio_size(portfolios: DataFrame, value: str, members: str = "bbls") -> DataFrame:
    return portfolios.where(F.array_contains(members, value)).orderBy("orig_id").limit(1).select(length_or_null(members).alias("portfolio_size"))


def _monthly(rows: DataFrame, date: Column, since: str, **counts: Column) -> DataFrame:
    kept = rows.withColumn("_d", date).where(F.col("_d") >= since)
    return kept.groupBy(month_key("_d").alias("month")).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])


def indicator_history(spark: SparkSession, bbl: str, as_of: str, violations: DataFrame, complaints: DataFrame, jobs: DataFrame, dob: DataFrame, ecb: DataFrame, filings: DataFrame, rentstab: DataFrame, pluto: DataFrame, years: tuple[int, ...] = tuple(range(2007, 2024)), since: str = "2010-01-01") -> DataFrame:
    """A building's months from 2007 with its measures, 0 where there is nothing.

    Filings are null where the building is known to have ten units or fewer.
    """
    def own(df: DataFrame, key: str = "bbl") -> DataFrame:
        return df.where(F.col(key) == bbl)

    all_ = F.lit(True)
    kind = F.col("class")
    facts = [
        _monthly(own(violations), F.coalesce("inspectiondate", "novissueddate"), since, hpdviolations_class_a=kind == "A", hpdviolations_class_b=kind == "B", hpdviolations_class_c=kind == "C", hpdviolations_class_i=kind == "I", hpdviolations_total=all_),
        _monthly(own(complaints), F.col("receiveddate"), since, hpdcomplaints_emergency=F.col("type").isin(*EMERGENCY), hpdcomplaints_nonemergency=F.col("type").isin(*CALM), hpdcomplaints_total=all_),
        _monthly(own(jobs).where("jobtype IS NOT NULL"), F.col("prefilingdate"), since, dobpermits_total=all_),
        _monthly(own(dob).where("violationtypecode IS NOT NULL"), F.col("issuedate"), since, dobviolations_regular=all_, dobviolations_total=all_),
        _monthly(own(ecb).where("severity IS NOT NULL"), F.col("issuedate"), since, dobviolations_ecb=all_, dobviolations_total=all_),
        own(filings).where("month >= '2017-01'").select("month", "evictionfilings"),
        unpivot_years(own(rentstab, "ucbbl"), [], {f"uc{y}": y for y in years if f"uc{y}" in rentstab.columns}, value="rentstabilizedunits"),
    ]
    spine = month_spine(spark, "2007-01-01", as_of)
    rows = zero_filled(spine, facts, ["month"], MEASURES)
    few = F.broadcast(own(pluto).agg(F.max("unitsres").alias("_units")))  # one row
    rows = rows.crossJoin(few).withColumn("evictionfilings", F.when(F.coalesce(F.col("_units") < 11, F.lit(False)), None).otherwise(F.col("evictionfilings")))
    return rows.select("month", *[F.col(m).cast("long").alias(m) for m in MEASURES]).orderBy("month")
