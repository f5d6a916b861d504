"""The domain plans as queries: the star schema is dealt to their source tables, the same way in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelweave.catalog import query
from parcelweave.plans import alerts, buildings, dashboard, goodcause, history, landlords, lookup, parcels
from parcelweave.plans.functions import register_pin_functions
from parcelweave.sources.load import write_table
from parcelweave.storage import shared_dir

_PARCELS = """
raw_parcels AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 14, '0') AS pin, lpad(CAST(p_partkey // 2 AS VARCHAR), 10, '0') AS pin10, CAST(2020 + p_size % 3 AS VARCHAR) AS year, p_brand AS class, p_partkey, p_size, p_name FROM part
  UNION ALL SELECT lpad(CAST(p_partkey AS VARCHAR), 14, '0'), lpad(CAST(p_partkey // 2 AS VARCHAR), 10, '0'), '2024', 'LATEST', p_partkey, p_size, p_name FROM part WHERE p_partkey % 2 = 0),
raw_owners AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 14, '0') AS pin, p_partkey % 40 || ' ' || p_name || CASE WHEN p_size % 5 = 0 THEN '  APT 3' ELSE '' END AS address, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand END AS owner, 'R' || p_size AS row_id FROM part WHERE p_partkey % 10 <> 3),
latest AS (SELECT DISTINCT ON (pin) * FROM raw_parcels ORDER BY pin, CAST(year AS INT) DESC NULLS LAST),
joined AS (SELECT l.pin, l.pin10, l.class, l.p_partkey, o.address, o.owner, o.row_id FROM latest l LEFT JOIN raw_owners o USING (pin)),
keyed AS (SELECT *, coalesce(nullif(owner, ''), nullif(row_id, ''), pin) AS k FROM joined)"""


def _pin(column: str = "p_partkey", width: int = 14):
    return F.lpad(F.col(column).cast("string"), width, "0")


def raw_parcels(part: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    rest = {c: none for c in ("zip_code", "lat", "lon", "ward_num", "chicago_community_area_name", "census_tract_geoid", "row_id")}
    pin10 = F.lpad(F.floor(F.col("p_partkey") / 2).cast("string"), 10, "0")
    first = part.select(_pin().alias("pin"), pin10.alias("pin10"), (F.col("p_size") % 3 + 2020).cast("string").alias("year"), F.col("p_brand").alias("class"))
    later = part.where("p_partkey % 2 = 0").select(_pin().alias("pin"), pin10.alias("pin10"), F.lit("2024").alias("year"), F.lit("LATEST").alias("class"))
    return first.unionByName(later).withColumns(rest)


def raw_owners(part: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    address = F.concat((F.col("p_partkey") % 40).cast("string"), F.lit(" "), "p_name", F.when(F.col("p_size") % 5 == 0, "  APT 3").otherwise(""))
    rows = part.where("p_partkey % 10 <> 3").select(_pin().alias("pin"), F.lit("2024").alias("year"), address.alias("prop_address_full"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_brand")).alias("mail_address_name"), F.concat(F.lit("R"), F.col("p_size").cast("string")).alias("row_id"))
    return rows.withColumns({c: none for c in ("prop_address_city_name", "prop_address_state", "prop_address_zipcode_1", "mail_address_full", "mail_address_city_name", "mail_address_state", "mail_address_zipcode_1")})


def built(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    raw, owners = raw_parcels(part), raw_owners(part)
    return parcels.build_parcels(raw, owners), parcels.build_portfolios(raw, owners)


def counted(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    both = F.concat(F.lpad(F.floor(F.col("l_partkey") / 2).cast("string"), 10, "0"), F.lit(" | "), F.lpad(F.floor((F.col("l_partkey") + 2) / 2).cast("string"), 10, "0"), F.lit(" |"))
    permits = lineitem.select(both.alias("pin_list"))
    names = part.select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("street_name"))
    seen = lineitem.join(names, "l_partkey").select((F.col("l_partkey") % 40).cast("string").alias("street_number"), none.alias("street_direction"), "street_name", F.lit("").alias("street_type"), F.when(F.col("l_linestatus") == "O", "Opened").otherwise("CLOSED").alias("violation_status"), "l_tax")
    return parcels.build_indicators(built(part)[0], permits, seen, seen.where("l_tax > 0.05"))


_COUNTS = _PARCELS + """,
lists AS (SELECT unnest([lpad(CAST(l_partkey // 2 AS VARCHAR), 10, '0'), lpad(CAST((l_partkey + 2) // 2 AS VARCHAR), 10, '0')]) AS pin10 FROM lineitem),
permits AS (SELECT pin10, count(*) AS n FROM lists GROUP BY 1),
ours AS (SELECT pin, upper(regexp_replace(regexp_replace(trim(coalesce(address, '')), '(?i)\\s+(?:APT|UNIT|#|SUITE|STE|FL|FLOOR|RM|ROOM|P-?\\S+).*$', ''), '\\s+', ' ', 'g')) AS a FROM joined),
facts AS (SELECT upper(l_partkey % 40 || ' ' || p_name) AS a, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_tax > 0.05) AS requests FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
counts AS (SELECT j.pin, coalesce(p.n, 0) AS permits_total, coalesce(open, 0) AS violations_open, coalesce(total, 0) AS violations_total, coalesce(requests, 0) AS requests_311_total FROM joined j JOIN ours USING (pin) LEFT JOIN permits p ON p.pin10 = j.pin10 LEFT JOIN facts USING (a))"""


@query(f"""
WITH {_PARCELS} SELECT pin, nullif(regexp_extract(address, '^\\s*(\\d+\\S*)', 1), '') AS housenumber, trim(regexp_replace(address, '^\\s*\\d+\\S*\\s*', '')) AS streetname, address, class AS land_class, row_id AS owner_id, owner AS owner_name, pin10 FROM joined""")
def plan_parcels(part):
    return built(part)[0].select("pin", "housenumber", "streetname", "address", "land_class", "owner_id", "owner_name", "pin10")


@query(f"""
WITH {_PARCELS} SELECT CAST(dense_rank() OVER (ORDER BY k) AS INT) AS orig_id, string_agg(pin, ',' ORDER BY pin) AS pins, k AS owner_name, '{{}}' AS graph FROM keyed GROUP BY k""")
def plan_portfolios(part):
    return built(part)[1].select("orig_id", F.array_join("pins", ",").alias("pins"), F.get("owner_names", F.lit(0)).alias("owner_name"), "graph")


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def plan_indicators(part, lineitem):
    return counted(part, lineitem)


@query(f"""
WITH {_COUNTS} SELECT pin, address, class AS land_class, permits_total, violations_open, violations_total, requests_311_total FROM keyed JOIN counts USING (pin) WHERE k IN (SELECT k FROM keyed WHERE pin = '00000000000012')""")
def plan_portfolio_addresses(part, lineitem):
    rows, groups = built(part)
    found = lookup.portfolio_addresses(rows, groups, counted(part, lineitem), "00000000000012")
    return found.select("pin", "address", "land_class", "permits_total", "violations_open", "violations_total", "requests_311_total")


@query(f"""
WITH {_COUNTS}, asked(p) AS (VALUES ('00000000000012'), ('99999999999999'))
SELECT p AS asked, CAST(count(k.pin) AS INT) AS parcels, 0 AS units_res, CAST(coalesce(sum(permits_total), 0) AS INT) AS permits_total, CAST(coalesce(sum(violations_open), 0) AS INT) AS violations_open, CAST(coalesce(sum(violations_total), 0) AS INT) AS violations_total, CAST(coalesce(sum(requests_311_total), 0) AS INT) AS requests_311_total
FROM asked LEFT JOIN (SELECT pin AS p, k FROM keyed) USING (p) LEFT JOIN keyed k USING (k) LEFT JOIN counts c ON c.pin = k.pin GROUP BY p""")
def plan_portfolio_totals(part, lineitem):
    rows, groups = built(part)
    facts = counted(part, lineitem)
    known, unknown = (lookup.portfolio_totals(rows, groups, facts, p).select(F.lit(p).alias("asked"), "*") for p in ("00000000000012", "99999999999999"))
    return known.unionByName(unknown)


@query(f"""
WITH {_COUNTS}, asked(p) AS (VALUES ('00000000000013'), ('99999999999999'))
SELECT 'sum' AS said, p AS pin, CAST(count(k.pin) AS BIGINT) AS n, CAST(coalesce(sum(violations_total), 0) AS BIGINT) AS violations FROM asked LEFT JOIN (SELECT pin AS p, k FROM keyed) USING (p) LEFT JOIN keyed k USING (k) LEFT JOIN counts c ON c.pin = k.pin GROUP BY p
UNION ALL SELECT 'member', pin, permits_total, violations_total FROM keyed JOIN counts USING (pin) WHERE k IN (SELECT k FROM keyed WHERE pin = '00000000000013')""")
def plan_sql_lookups(spark, part, lineitem):
    """The lookups as table functions that SQL calls, over tables written and sorted by pin."""
    rows, groups = built(part)
    kept = [write_table(t, f"{shared_dir(spark)}/lookup-{uuid.uuid4().hex}", by) for t, by in ((rows, "pin"), (groups, None), (counted(part, lineitem), "pin"))]
    register_pin_functions(*kept)
    sums = [f"SELECT 'sum' AS said, '{p}' AS pin, CAST(parcels AS BIGINT) AS n, CAST(violations_total AS BIGINT) AS violations FROM agg_info_from_pin('{p}')" for p in ("00000000000013", "99999999999999")]
    return spark.sql(" UNION ALL ".join([*sums, "SELECT 'member', pin, permits_total, violations_total FROM assoc_addrs_from_pin('00000000000013')"]))


@query(f"""
WITH {_PARCELS} SELECT pin, address FROM joined WHERE coalesce(address, '') ILIKE '%2 %re%' ORDER BY address NULLS LAST, pin LIMIT 5""")
def plan_address_search(part):
    return lookup.address_search(built(part)[0], "2 %re").select("pin", "address")


@query(f"""
WITH {_COUNTS} SELECT count(*) AS parcels, 0 AS units_res, CAST(sum(permits_total) AS BIGINT) AS permits_total, CAST(sum(violations_open) AS BIGINT) AS violations_open, CAST(sum(violations_total) AS BIGINT) AS violations_total, CAST(sum(requests_311_total) AS BIGINT) AS requests_311_total,
CAST(sum(violations_open) AS DOUBLE) / count(*) AS violations_open_per_parcel, CAST(0 AS DOUBLE) AS violations_open_per_unit FROM counts""")
def plan_summary(part, lineitem):
    rows = built(part)[0].select("pin", "units_res").join(counted(part, lineitem), "pin")
    return lookup.summary(rows).withColumn("units_res", F.col("units_res").cast("int"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def plan_most_frequent(customer):
    return lookup.most_frequent(customer, "c_mktsegment", 3)


GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: list_transform(range(1, length(x) + 2), lambda i: substring('  ' || x || ' ', i, 3)))))"
_LANDLORDS = "l AS (SELECT CAST(p_partkey AS VARCHAR) AS bbl, p_brand AS name, p_name AS street, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'APT ' || p_size % 4 END AS apt, CAST(p_size % 10 AS VARCHAR) AS zip FROM part), n AS (SELECT DISTINCT name, street, apt, regexp_replace(apt, '\\D', '', 'g') AS num, zip FROM l)"


def landlord_rows(part: DataFrame) -> DataFrame:
    apt = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("APT "), (F.col("p_size") % 4).cast("string")))
    return part.select(F.col("p_partkey").cast("string").alias("bbl"), F.lit(1).alias("registrationid"), F.col("p_brand").alias("name"), F.col("p_name").alias("bizaddr"), F.col("p_name").alias("bizhousestreet"), apt.alias("bizapt"), (F.col("p_size") % 10).cast("string").alias("bizzip"))


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    def side(key: str, prefix: str) -> DataFrame:
        return nodes.select(F.col("nodeid").alias(key), F.concat_ws("|", "name", "bizhousestreet", "bizapt", "bizzip").alias(prefix))

    return edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("a", "b", F.round("weight", 5).alias("weight"))


@query(f"""
WITH {_LANDLORDS} SELECT concat_ws('|', x.name, x.street, x.apt, x.zip) AS a, concat_ws('|', y.name, y.street, y.apt, y.zip) AS b, round(2 + CAST(len(list_intersect({GRAMS.format('x.name')}, {GRAMS.format('y.name')})) AS DOUBLE) / len(list_distinct({GRAMS.format('x.name')} || {GRAMS.format('y.name')})), 5) AS weight
FROM n x JOIN n y USING (street, zip) WHERE (x.name, x.apt) <> (y.name, y.apt) AND (x.num = y.num OR x.num = '' OR y.num = '')""")
def plan_address_edges(part):
    nodes = landlords.landlord_nodes(landlord_rows(part))
    return _named(landlords.address_edges(nodes), nodes)


@query(f"""
WITH {_LANDLORDS}, p AS (SELECT x.*, y.street AS ystreet, y.apt AS yapt, y.num AS ynum, CAST(CAST(len(list_intersect({GRAMS.format('x.street')}, {GRAMS.format('y.street')})) AS DOUBLE) / len(list_distinct({GRAMS.format('x.street')} || {GRAMS.format('y.street')})) AS FLOAT) AS sim
FROM n x JOIN n y USING (name, zip) WHERE (x.street, x.apt) <> (y.street, y.apt))
SELECT concat_ws('|', name, street, apt, zip) AS a, concat_ws('|', name, ystreet, yapt, zip) AS b, round(CAST(sim AS DOUBLE) + CASE WHEN apt = yapt THEN 0.5 ELSE 0 END + 1, 5) AS weight FROM p WHERE sim > 0.9 OR (sim > 0.8 AND num = ynum)""")
def plan_name_edges(part):
    nodes = landlords.landlord_nodes(landlord_rows(part))
    return _named(landlords.name_edges(nodes), nodes)


@query("""
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS bbl, CASE WHEN o_orderkey % 3 = 0 THEN 'GENERAL' ELSE o_orderpriority END AS major, o_orderstatus AS minor, o_orderdate AS d FROM orders),
t AS (SELECT bbl, CASE WHEN major = 'GENERAL' THEN minor ELSE major END AS type, count(*) AS n, count(*) FILTER (WHERE CAST(d AS DATE) > DATE '2000-06-01' - INTERVAL 3 YEAR) AS r FROM o GROUP BY ALL)
SELECT bbl, CAST(sum(n) AS BIGINT) AS totalcomplaints, CAST(sum(r) AS BIGINT) AS recentcomplaints, string_agg(type || ' (' || r || ')', ', ' ORDER BY r DESC, type) FILTER (WHERE r > 0) AS by_type FROM t GROUP BY bbl""")
def plan_complaints(orders):
    rows = orders.select(F.col("o_custkey").cast("string").alias("bbl"), F.when(F.col("o_orderkey") % 3 == 0, "GENERAL").otherwise(F.col("o_orderpriority")).alias("majorcategory"), F.col("o_orderstatus").alias("minorcategory"), F.col("o_orderdate").cast("date").alias("receiveddate"))
    made = buildings.complaints_by_type(rows, "2000-06-01")
    listed = F.array_join(F.transform("recentcomplaintsbytype", lambda c: F.concat(c["type"], F.lit(" ("), c["count"].cast("string"), F.lit(")"))), ", ")
    return made.select("bbl", "totalcomplaints", "recentcomplaints", listed.alias("by_type"))


@query("""
WITH f AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS bbl, CAST(l_orderkey AS VARCHAR) AS i FROM lineitem WHERE l_quantity > 10)
SELECT bbl, count(DISTINCT i) AS eviction_filings_since_2017 FROM f JOIN orders ON i = CAST(o_orderkey AS VARCHAR) WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '1997-01-01' AND o_orderpriority = '1-URGENT' GROUP BY bbl""")
def plan_evictions(orders, lineitem):
    index = orders.select(F.col("o_orderkey").cast("string").alias("indexnumberid"), F.when(F.col("o_orderstatus").isin("F", "O"), "Holdover").otherwise("x").alias("classification"), F.when(F.col("o_orderpriority") == "1-URGENT", "Residential").alias("propertytype"), F.col("o_orderdate").cast("date").alias("fileddate"))
    addresses = lineitem.select(F.col("l_orderkey").cast("string").alias("indexnumberid"), F.col("l_quantity").cast("string").alias("unitsres"), F.col("l_suppkey").cast("string").alias("bbl"))
    return history.evictions_by_building(index, addresses, "1997-01-01")


@query("""
WITH m AS (SELECT strftime(d, '%Y-%m') AS month FROM generate_series(DATE '2007-01-01', DATE '2007-11-20', INTERVAL 1 MONTH) t(d)),
v AS (SELECT l_returnflag AS c, CAST(l_shipdate AS DATE) + INTERVAL 9 YEAR AS d FROM lineitem WHERE l_suppkey = 7)
SELECT month, count(d) FILTER (WHERE c = 'A') AS hpdviolations_class_a, count(d) AS hpdviolations_total, 0 AS hpdcomplaints_total FROM m LEFT JOIN v ON strftime(d, '%Y-%m') = month GROUP BY month""")
def plan_history(spark, lineitem):
    from parcelweave.sources.schemas import schema

    def none(name: str) -> DataFrame:
        return spark.createDataFrame([], schema(name))

    moved = F.add_months(F.col("l_shipdate").cast("date"), 108)
    rows = lineitem.select(F.col("l_suppkey").cast("string").alias("bbl"), F.col("l_returnflag").alias("class"), moved.alias("inspectiondate"), F.lit(None).cast("date").alias("novissueddate"))
    filed = spark.createDataFrame([], "bbl string, month string, evictionfilings long")
    made = history.indicator_history(spark, "7", "2007-12-20", rows, none("hpd_complaints_and_problems"), none("dobjobs"), none("dob_violations"), none("ecb_violations"), filed, none("rentstab_v2"), none("pluto_latest"), since="2000-01-01")
    return made.select("month", "hpdviolations_class_a", "hpdviolations_total", F.col("hpdcomplaints_total").cast("int").alias("hpdcomplaints_total"))


@query("""
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS bbl, substring(p_type, 1, 1) || p_size % 9 AS bldgclass, p_size AS unitsres, p_partkey FROM part), r AS (SELECT CAST(p_partkey AS VARCHAR) AS bbl, p_size % 4 AS uc2023, p_size % 6 AS uc2022 FROM part WHERE p_partkey % 3 = 0),
s AS (SELECT p_partkey, sum(l_quantity) AS q FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1), x AS (SELECT p.*, coalesce(nullif(uc2023, 0), nullif(uc2022, 0), 0) AS rs, p_partkey % 5 = 0 AS sub, CASE WHEN p_partkey % 2 = 0 THEN 40 END AS pu FROM p LEFT JOIN r USING (bbl))
SELECT bbl, least(rs, unitsres) AS post_hstpa_rs_units, NOT regexp_matches(bldgclass, '^[RIMHW]|C8|C6|CC|D0|DC|D4', 'i') AS eligible_bldgclass, rs = 0 AS eligible_rent_stab, NOT sub AS eligible_subsidy, unitsres > 10 OR pu > 10 AS eligible_portfolio_size,
NOT regexp_matches(bldgclass, '^[RIMHW]|C8|C6|CC|D0|DC|D4', 'i') AND rs = 0 AND NOT sub AND (unitsres > 10 OR pu > 10) AS eligible FROM x""")
def plan_eligibility(spark, part):
    from parcelweave.sources.schemas import schema

    bbl = F.col("p_partkey").cast("string")
    known = part.select(bbl.alias("bbl"), F.concat(F.substring("p_type", 1, 1), (F.col("p_size") % 9).cast("string")).alias("bldgclass"), F.col("p_size").alias("unitsres"))
    rest = [f for f in schema("pluto_latest") if f.name not in known.columns]
    pluto = known.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    stab = part.where("p_partkey % 3 = 0").select(bbl.alias("ucbbl"), (F.col("p_size") % 4).alias("uc2023"), (F.col("p_size") % 6).alias("uc2022"), *[F.lit(None).cast("int").alias(f"uc{y}") for y in (2019, 2020, 2021)])
    members = part.where("p_partkey % 2 = 0").select(F.lit(1).cast("long").alias("portfolio_id"), bbl.alias("bbl"))
    sizes = spark.createDataFrame([(1, 40, 9)], "portfolio_id long, portfolio_units long, portfolio_bbls long")
    public = part.where("p_partkey % 5 = 0").select(bbl.alias("bbl"))
    none = {n: spark.createDataFrame([], schema(n)) for n in ("fc_shd_building", "hpd_ll44_projects", "hpd_ll44_tax_incentive", "hpd_ll44_buildings", "pluto_latest_districts")}
    subsidies = goodcause.subsidised(none["fc_shd_building"], none["hpd_ll44_projects"], none["hpd_ll44_tax_incentive"], none["hpd_ll44_buildings"], public, "2024-01-01")
    certs = spark.createDataFrame([], "bbl string, co_bin string, co_issued date, co_type string")
    made = goodcause.eligibility(pluto, none["pluto_latest_districts"], stab, subsidies, certs, members, sizes)
    return made.select("bbl", "post_hstpa_rs_units", "eligible_bldgclass", "eligible_rent_stab", "eligible_subsidy", "eligible_portfolio_size", "eligible")


_SUMS = "CAST(count(*) AS INT) AS buildings_agg, CAST(sum(units) AS INT) AS units_res_agg, CAST(count(*) FILTER (WHERE bip >= 500) AS DOUBLE) / nullif(count(bip), 0) * 100 AS bip_500_pct_agg, CAST(sum(units) AS DOUBLE) / nullif(sum(units), 0) AS hpd_viol_bc_open_per_unit_agg"


@query(f"""
WITH b AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE n_name END AS landlord, r_name AS pool, s_suppkey % 30 AS units, CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal / 10) AS INT) END AS bip FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey % 11 <> 0)
SELECT 'landlord' AS collection_type, landlord AS collection_name, max(pool) AS loan_pool_name, {_SUMS} FROM b WHERE landlord IS NOT NULL GROUP BY landlord UNION ALL SELECT 'loan_pool', pool, pool, {_SUMS} FROM b GROUP BY pool UNION ALL SELECT 'all', 'all', NULL, {_SUMS} FROM b""")
def plan_collections(supplier, nation, region):
    rows = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    units = (F.col("s_suppkey") % 30).cast("int")
    numbers = {c: units for c in dashboard.SUMS} | {"water_charges": F.lit(1.0), "debt_total": F.lit(2.0), "bip": F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 10).cast("int"))}
    made = rows.select(F.col("s_suppkey").cast("string").alias("bbl"), F.when(F.col("s_suppkey") % 9 != 0, F.col("n_name")).alias("landlord"), F.col("r_name").alias("loan_pool"), F.when(F.col("s_suppkey") % 11 == 0, "satisfied").otherwise("no_action").alias("latest_action"), *[c.alias(n) for n, c in numbers.items()])
    return dashboard.collections(made).select("collection_type", "collection_name", "loan_pool_name", "buildings_agg", "units_res_agg", "bip_500_pct_agg", "hpd_viol_bc_open_per_unit_agg")


@query("""
WITH o AS (SELECT o_custkey AS k, count(*) AS week, count(*) FILTER (WHERE o_orderstatus = 'F') AS viol FROM orders GROUP BY 1),
i AS (SELECT CAST(c_custkey AS VARCHAR) AS bbl, c_nationkey AS units, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 50 END AS portfolio, week, viol FROM customer LEFT JOIN o ON k = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
j AS (SELECT *, count(*) OVER () AS every FROM i), x AS (SELECT * FROM j WHERE week IS NOT NULL)
SELECT bbl, portfolio AS portfolio_id, every AS area_bbls_all, CASE WHEN portfolio IS NOT NULL THEN count(*) OVER (PARTITION BY portfolio) END AS area_bbls_shared_portfolio, CASE WHEN week <> 0 THEN rank() OVER (ORDER BY week DESC) END AS rank_comp__week, CASE WHEN viol <> 0 THEN rank() OVER (ORDER BY viol DESC) END AS rank_viol__week FROM x""")
def plan_alert_ranks(spark, customer, orders):
    from pyspark.sql import types as T

    from parcelweave.sources.schemas import INDICATORS

    weeks = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("int").alias("hpd_comp__week"), F.count_if(F.col("o_orderstatus") == "F").cast("int").alias("hpd_viol_bc__week"))
    known = customer.join(weeks, "c_custkey", "left").select(F.col("c_custkey").cast("string").alias("bbl"), F.col("c_nationkey").alias("unitsres"), F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 50).cast("int")).alias("portfolio_id"), F.col("c_mktsegment").alias("nta"), "hpd_comp__week", "hpd_viol_bc__week", F.col("hpd_comp__week").cast("double").alias("hpd_comp_per_unit__week"), F.col("hpd_comp__week").cast("double").alias("hpd_viol_per_unit_bc__week"))
    rest = [f for f in T.StructType.fromDDL(INDICATORS) if f.name not in known.columns]
    table = known.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    made = alerts.ranked_area(table, {"nta": ["BUILDING", "MACHINERY"]})
    return made.select("bbl", F.col("portfolio_id").cast("long").alias("portfolio_id"), "area_bbls_all", "area_bbls_shared_portfolio", "rank_comp__week", "rank_viol__week")


@query("""
WITH i AS (SELECT CAST(o_custkey AS VARCHAR) AS bbl, CAST(max(o_orderdate) AS DATE) AS d, max(o_totalprice) AS amount FROM orders GROUP BY 1)
SELECT bbl, d AS lastsaledate, amount AS lastsaleamount, count(*) OVER () AS total_sales, DATE '2001-07-31' AS last_updated FROM i WHERE d > DATE '2001-07-31' - INTERVAL 30 DAY AND amount >= 10000 ORDER BY d DESC, bbl LIMIT 10""")
def plan_sales(spark, orders):
    rows = orders.groupBy(F.col("o_custkey").cast("string").alias("bbl")).agg(F.max("o_orderdate").cast("date").alias("lastsaledate"), F.max("o_totalprice").alias("lastsaleamount"))
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("housenumber", "streetname", "boro", "lastsaleacrisid")}).withColumn("zipcode", F.lit("1"))
    tracker = spark.createDataFrame([("acris", "2001-08-01 10:00:00")], "key string, value string")
    return alerts.sales(rows, tracker, {"zipcode": ["1"]}).select("bbl", "lastsaledate", "lastsaleamount", "total_sales", "last_updated")
