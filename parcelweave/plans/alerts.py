"""Alerts about buildings and areas, and the freshness of datasets.

``indicators`` is a table with one row for each building, its areas, and its counts for the last
week, month and six months; ``areas`` maps the columns of areas to the values asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions.values import any_in, band, day, is_late, iso_micros, or_zero
from parcelweave.operators.relational import min_max, ranked_many, with_total
from parcelweave.sources.load import points

AREAS = ("coun_dist", "nta", "census_tract", "community_dist", "assem_dist", "stsen_dist", "zipcode")
ADDRESS = ("bbl", "housenumber", "streetname", "boro")
CASES = ("Tenant Action", "Tenant Action/Harrassment", "Heat and Hot Water")
#: Weights of buildings by their units, under each bound; fixed values.
SIZES, LARGEST = [(6, 0.0), (10, 0.5), (200, 1.0), (300, 0.5)], 0.25
#: Measures: our name, the input's name, and what a week of it weighs in the last rank; fixed values.
METRICS = (
    ("comp", "hpd_comp", 1.0), ("comp_per_unit", "hpd_comp_per_unit", 0.75), ("viol", "hpd_viol_bc", 1.0), ("viol_per_unit", "hpd_viol_per_unit_bc", 0.75),
    ("dob_ecb_viol", "dob_ecb_viol", 0.5), ("dob_comp", "dob_comp", 0.5),
)
SIX_MONTHS = ("comp", "viol", "dob_ecb_viol", "dob_comp")
SIX_MONTH_WEIGHT = 0.1
OUT = {"comp": "hpd_comp", "comp_per_unit": "hpd_comp_per_unit", "viol": "hpd_viol", "viol_per_unit": "hpd_viol_per_unit", "dob_ecb_viol": "dob_ecb_viol", "dob_comp": "dob_comp"}


def in_areas(rows: DataFrame, areas: Mapping[str, Sequence]) -> DataFrame:
    unknown = set(areas) - set(AREAS)
    if unknown:
        raise ValueError(f"unknown areas: {', '.join(sorted(unknown))}")
    return rows.where(F.col("bbl").isNotNull() & any_in({k: list(v) for k, v in areas.items()}))


def buildings(indicators: DataFrame, bbls: Sequence[str]) -> DataFrame:
    months = [(f"{c}__bldg_month", f"{c}__month") for c in ("hpd_comp", "dob_ecb_viol", "dob_comp", "evictions_filed")]
    named = {"hpd_viol_all__week": "hpd_viol__week", "hpd_viol_all__bldg_month": "hpd_viol__month", **dict(months)}
    order = ("bbl", "hpd_viol_all__week", "hpd_viol_all__bldg_month", "hpd_comp__week", "hpd_comp__bldg_month", "dob_ecb_viol__week", "dob_ecb_viol__bldg_month", "dob_comp__week", "dob_comp__bldg_month", "evictions_filed__week", "evictions_filed__bldg_month", "lagged_eviction_filings", "lagged_eviction_date", "hpd_link", "dob_ecb_viol_bin", "dob_comp_bin")
    return points(indicators, "bbl", bbls).select(*[F.col(c).alias(named.get(c, c)) for c in order])


def prioritised(rows: DataFrame) -> DataFrame:
    """Buildings with known measures by unit: priorities grow with the logarithm of the units; no units, no priority."""
    size = F.log(F.col("unitsres").cast("double"))
    size = F.when(F.col("unitsres") > 0, size)
    spans = {m: ("week", "1mo") if m.endswith("per_unit") else ("week", "1mo", "6mo") for m, _, _ in METRICS}
    priority = [(or_zero(f"{source}__{span}") * size).alias(f"priority_{m}__{span}") for m, source, _ in METRICS for span in spans[m]]
    raw = [(F.col(f"{source}__{span}") if m.endswith("per_unit") else or_zero(f"{source}__{span}")).alias(f"{OUT[m]}__{span}") for m, source, _ in METRICS for span in (("week",) if m.endswith("per_unit") else spans[m])]
    filed = [or_zero(f"evictions_filed__{span}").alias(f"evictions_filed__{span}") for span in ("week", "1mo", "6mo")]
    known = rows.where("hpd_comp_per_unit__week IS NOT NULL AND hpd_viol_per_unit_bc__week IS NOT NULL")
    return known.select("bbl", "bin", "housenumber", "streetname", "boro", "unitsres", "rsunitslatest", "portfolio_id", "hpd_link", "dob_ecb_viol_bin", "dob_comp_bin", band("unitsres", SIZES, LARGEST).alias("size_metric"), *priority, *raw, *filed)


def final_weight() -> Column:
    out = F.col("size_metric")
    for m, _, weight in METRICS:
        out = out + F.coalesce(F.col(f"priority_{m}__week_norm"), F.lit(0.0)) * weight
    half = sum((F.coalesce(F.col(f"priority_{m}__6mo_norm"), F.lit(0.0)) for m in SIX_MONTHS), F.lit(0.0)) / len(SIX_MONTHS)
    return out + half * SIX_MONTH_WEIGHT


def ranked_area(indicators: DataFrame, areas: Mapping[str, Sequence]) -> DataFrame:
    """The area's buildings with six ranks and the last one; ``area_bbls_all`` counts those without known measures too."""
    inside = in_areas(indicators, areas)
    rows = prioritised(inside)
    rows = min_max(rows, [c for c in rows.columns if c.startswith("priority_")])
    weeks = {f"rank_{m}__week": F.col(f"{OUT[m]}__week") for m, _, _ in METRICS}
    rows = ranked_many(rows, weeks | {"rank_final": final_weight()}, {name: value == 0 for name, value in weeks.items()})
    shared = rows.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("area_bbls_shared_portfolio"))
    every = inside.agg(F.count(F.lit(1)).alias("area_bbls_all"))  # one row
    rows = rows.join(shared, "portfolio_id", "left").crossJoin(F.broadcast(every))
    ranks = [c for m, _, _ in METRICS for c in (f"{OUT[m]}__week", f"rank_{m}__week")]
    spans = [f"{OUT[m]}__{span}" for m in SIX_MONTHS for span in ("1mo", "6mo")]
    return rows.select("bbl", "bin", "housenumber", "streetname", "boro", "unitsres", "rsunitslatest", "portfolio_id", "area_bbls_shared_portfolio", "area_bbls_all", "hpd_link", "rank_final", *ranks, "dob_ecb_viol_bin", "dob_comp_bin", *spans, *[f"evictions_filed__{s}" for s in ("week", "1mo", "6mo")])


def district(indicators: DataFrame, areas: Mapping[str, Sequence], top: int = 5, more: int = 3) -> DataFrame:
    """The area's first buildings with anything to show, and more of the first portfolio that several of its buildings share."""
    active = F.lit(False)
    for c in ("hpd_comp", "hpd_viol", "dob_ecb_viol", "dob_comp", "evictions_filed"):
        active = active | (F.col(f"{c}__6mo") > 0)
    rows = ranked_area(indicators, areas).where(active)
    first = rows.where(F.col("rank_final") <= top).orderBy("rank_final", "bbl").limit(top)
    shared = first.where("area_bbls_shared_portfolio > 1").orderBy("rank_final", "bbl").limit(1).select("portfolio_id")
    others = rows.where(F.col("rank_final") > top).join(F.broadcast(shared), "portfolio_id", "left_semi").orderBy("rank_final", "bbl").limit(more)
    both = first.unionByName(others.select(first.columns))
    counts = indicators.join(F.broadcast(both.select("portfolio_id").distinct()), "portfolio_id", "left_semi").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("all_bbls_shared_portfolio"))
    return both.join(counts, "portfolio_id", "left").select(*both.columns, "all_bbls_shared_portfolio").orderBy("rank_final", "bbl")


def _cutoff(tracker: DataFrame, key: str) -> DataFrame:
    """One row: the day before a dataset's last update; null for an unknown one."""
    return tracker.where(F.col("key") == key).agg(F.date_sub(F.max(F.col("value").cast("timestamp").cast("date")), 1).alias("last_updated"))


def _recent(rows: DataFrame, cutoff: DataFrame, date: str, total: str, limit: int = 10) -> DataFrame:
    dated = rows.crossJoin(F.broadcast(cutoff)).where(F.col(date) > F.date_sub("last_updated", 30))  # one row
    return with_total(dated, total).orderBy(F.col(date).desc_nulls_first(), "bbl").limit(limit)


def litigations(indicators: DataFrame, cases: DataFrame, tracker: DataFrame, areas: Mapping[str, Sequence], as_of: str) -> DataFrame:
    """The last ten tenants' cases opened in the area within thirty days of the data's last day."""
    opened = cases.where(F.col("casetype").isin(*CASES) & (F.col("caseopendate") < day(as_of))).select("bbl", "caseopendate", "casetype", "respondent")
    rows = in_areas(indicators, areas).select(*ADDRESS).join(opened, "bbl")
    return _recent(rows, _cutoff(tracker, "hpd_litigations"), "caseopendate", "total_litigations").select(*ADDRESS, "caseopendate", "casetype", "respondent", "total_litigations", "last_updated")


def sales(indicators: DataFrame, tracker: DataFrame, areas: Mapping[str, Sequence], least: int = 10000) -> DataFrame:
    rows = in_areas(indicators, areas).where(F.col("lastsaleamount") >= least).select(*ADDRESS, "lastsaleacrisid", "lastsaleamount", "lastsaledate")
    return _recent(rows, _cutoff(tracker, "acris"), "lastsaledate", "total_sales").select(*ADDRESS, "lastsaleacrisid", "lastsaleamount", "lastsaledate", "total_sales", "last_updated")


def vacate_orders(indicators: DataFrame, areas: Mapping[str, Sequence]) -> DataFrame:
    columns = ("unitsres", "hpd_vacate_date", "hpd_vacate_type", "hpd_vacate_units_affected", "hpd_vacate_reason", "hpd_link", "dob_vacate_bin", "dob_vacate_date", "dob_vacate_type", "dob_vacate_complaint_number")
    rows = in_areas(indicators, areas).where("dob_vacate_date IS NOT NULL OR hpd_vacate_date IS NOT NULL")
    return rows.select(*ADDRESS, *columns, F.coalesce("dob_vacate_date", "hpd_vacate_date").alias("vacate_date"))


def last_updated(tracker: DataFrame, dataset: str | None = None) -> DataFrame:
    rows = tracker if dataset is None else tracker.where(F.col("key") == dataset)
    return rows.select(F.col("key").alias("dataset"), iso_micros("value").alias("last_updated"))


def tracker_status(tracker: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """Each dataset with its last update and whether it is late; unknown without a rule for it."""
    rows = tracker.join(alerts, tracker["key"] == alerts["datasetname"], "left")
    late = is_late(day(as_of), F.col("value").cast("timestamp"), F.col("expectedupdate"), F.col("alertthreshold"))
    return rows.select(F.col("key").alias("dataset"), iso_micros("value").alias("last_updated"), F.col("expectedupdate").cast("string").alias("update_cadence"), F.col("alertthreshold").cast("string").alias("alert_threshold"), late.alias("is_late"))
