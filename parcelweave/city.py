"""The star schema dealt to the city's source tables, by SQL that Spark and DuckDB both read.

A customer is a lot, a registration and a loan; an order is an event at the customer's lot.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelweave.sources.schemas import INDICATORS, schema

#: The day that counts as today.
AS_OF = "2021-07-01"
#: Twenty years in days, by which dates are moved.
_DAY = "CAST(o_orderdate AS DATE) + 7305"
_LOT = "CAST(o_custkey AS STRING)"

TABLES = {
    "pluto_latest": """SELECT CAST(c_custkey AS STRING) AS bbl, '1' AS borocode, CAST(c_custkey % 90 AS STRING) AS block, CAST(c_custkey % 7 AS STRING) AS lot, c_name AS address,
      CASE c_nationkey % 5 WHEN 0 THEN 'MN' WHEN 1 THEN 'BX' WHEN 2 THEN 'BK' WHEN 3 THEN 'QN' ELSE 'SI' END AS borough, CAST(10000 + c_nationkey AS STRING) AS zipcode,
      substring(c_mktsegment, 1, 1) || CAST(c_custkey % 9 AS STRING) AS bldgclass, CASE WHEN c_custkey % 4 = 0 THEN 'OWNER ' || CAST(c_custkey % 50 AS STRING) || ' LLC' ELSE c_name END AS ownername,
      CAST(c_custkey % 30 AS INT) AS unitsres, CAST(c_custkey % 30 + c_custkey % 2 AS INT) AS unitstotal, CAST(1900 + c_custkey % 100 AS INT) AS yearbuilt, c_nationkey AS council,
      CAST(c_custkey % 400 AS DOUBLE) / 1000 + 40.5 AS latitude, CAST(c_custkey % 500 AS DOUBLE) / 1000 - 74.2 AS longitude FROM {customer}""",
    "pluto_latest_districts": """SELECT CAST(c_custkey AS STRING) AS bbl, CAST(c_custkey % 51 AS STRING) AS coun_dist, CASE WHEN c_custkey % 8 > 0 THEN CAST(c_custkey % 65 AS STRING) END AS assem_dist,
      CAST(c_custkey % 26 AS STRING) AS stsen_dist, CAST(c_custkey % 12 AS STRING) AS cong_dist FROM {customer}""",
    "hpd_registrations": """SELECT CAST(c_custkey AS INT) AS registrationid, CAST(c_custkey % 1200 AS STRING) AS bbl, CAST(c_custkey % 7 AS INT) AS buildingid, CAST(c_custkey % 80 AS STRING) AS housenumber, 'MAIN ST' AS streetname,
      'BRONX' AS boro, '10450' AS zip, DATE '2019-01-01' + CAST(c_custkey % 300 AS INT) AS lastregistrationdate, DATE '2020-01-01' + CAST(c_custkey % 400 AS INT) AS registrationenddate FROM {customer}""",
    "hpd_contacts": """SELECT CAST(c_custkey AS INT) AS registrationid, CASE c_custkey % 5 WHEN 0 THEN 'HeadOfficer' WHEN 1 THEN 'IndividualOwner' WHEN 2 THEN 'CorporateOwner' WHEN 3 THEN 'JointOwner' ELSE 'SiteManager' END AS type,
      CASE WHEN c_custkey % 5 = 2 THEN 'CORP ' || CAST(c_custkey % 40 AS STRING) END AS corporationname, CASE WHEN c_custkey % 5 <> 2 AND c_custkey % 17 > 0 THEN 'F' || CAST(c_custkey % 11 AS STRING) END AS firstname,
      CASE WHEN c_custkey % 5 <> 2 THEN 'L' || CAST(c_custkey % 13 AS STRING) END AS lastname, CAST(c_custkey % 20 AS STRING) AS businesshousenumber,
      CASE WHEN c_custkey % 19 > 0 THEN 'Street ' || CAST(c_nationkey AS STRING) END AS businessstreetname, CASE c_custkey % 4 WHEN 0 THEN 'FL 2' WHEN 1 THEN '3 APT' WHEN 2 THEN 'GFL.' END AS businessapartment,
      'NY' AS businesscity, 'NY' AS businessstate, CAST(10000 + c_nationkey AS STRING) AS businesszip FROM {customer}
      UNION ALL SELECT CAST(c_custkey AS INT), 'CorporateOwner', 'CORP ' || CAST(c_custkey % 40 AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), '9', 'PLAZA', CAST(NULL AS STRING), 'NY', 'NY', '10001' FROM {customer} WHERE c_custkey % 3 = 0""",
    "hpd_violations": f"""SELECT {_LOT} AS bbl, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'I' END AS class, CASE WHEN o_orderstatus = 'F' THEN 'Close' ELSE 'Open' END AS violationstatus,
      CASE o_orderkey % 5 WHEN 0 THEN '666' WHEN 1 THEN '868' WHEN 2 THEN '583' ELSE '100' END AS ordernumber, CASE WHEN o_orderkey % 7 = 0 THEN 'Mold on wall' END AS novdescription,
      CASE WHEN o_orderkey % 9 > 0 THEN {_DAY} END AS inspectiondate, {_DAY} AS novissueddate FROM {{orders}}""",
    "hpd_complaints_and_problems": f"""SELECT {_LOT} AS bbl, CASE o_orderkey % 5 WHEN 0 THEN 'EMERGENCY' WHEN 1 THEN 'HAZARDOUS' WHEN 2 THEN 'REFERRAL' WHEN 3 THEN 'NON EMERGENCY' ELSE 'OTHER' END AS type,
      CASE o_orderkey % 4 WHEN 0 THEN 'HEAT/HOT WATER' WHEN 1 THEN 'GENERAL' WHEN 2 THEN 'MOLD' ELSE 'PESTS' END AS majorcategory, o_orderpriority AS minorcategory,
      CASE WHEN o_orderkey % 9 = 0 THEN 'BLDG' ELSE CAST(o_orderkey % 6 AS STRING) END AS apartment, {_DAY} AS receiveddate FROM {{orders}} WHERE o_orderkey % 2 = 0""",
    "hpd_litigations": f"""SELECT {_LOT} AS bbl, CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS openjudgement, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 100 AS STRING) END AS penalty,
      CASE WHEN o_orderkey % 5 = 0 THEN 'After Trial' END AS findingofharassment, CASE WHEN o_orderkey % 4 = 0 THEN 'PENDING' ELSE 'CLOSED' END AS casestatus,
      CASE o_orderkey % 3 WHEN 0 THEN 'Tenant Action' WHEN 1 THEN 'Heat and Hot Water' ELSE 'Access Warrant' END AS casetype, 'R' || CAST(o_orderkey AS STRING) AS respondent, {_DAY} AS caseopendate FROM {{orders}} WHERE o_orderkey % 5 = 0""",
    "hpd_omo_charges": f"SELECT CAST(o_orderkey AS STRING) AS omonumber, {_LOT} AS bbl, {_DAY} AS omocreatedate FROM {{orders}} WHERE o_orderkey % 6 = 0",
    "hpd_omo_invoices": "SELECT CAST(l_orderkey AS STRING) AS omonumber, l_quantity AS chargeamount FROM {lineitem}",
    "hpd_hwo_charges": f"SELECT {_LOT} AS bbl, {_DAY} AS hwocreatedate, CAST(o_orderkey % 50 AS DOUBLE) AS chargeamount FROM {{orders}} WHERE o_orderkey % 7 = 0",
    "hpd_vacateorders": f"SELECT {_LOT} AS bbl, CASE WHEN o_orderkey % 2 = 0 THEN 'PARTIAL' ELSE 'ENTIRE-BUILDING' END AS vacatetype, {_DAY} AS vacateeffectivedate, CASE WHEN o_orderkey % 3 = 0 THEN {_DAY} + 9 END AS rescinddate FROM {{orders}} WHERE o_orderkey % 13 = 0",
    "hpd_aep": "SELECT CAST(c_custkey AS STRING) AS bbl, CASE WHEN c_custkey % 2 = 0 THEN 'AEP Active' ELSE 'AEP Discharged' END AS currentstatus FROM {customer} WHERE c_custkey % 5 = 0",
    "hpd_conh": "SELECT CAST(c_custkey AS STRING) AS bbl FROM {customer} WHERE c_custkey % 14 = 0",
    "hpd_underlying_conditions": "SELECT CAST(c_custkey AS STRING) AS bbl, 'Active' AS currentstatus FROM {customer} WHERE c_custkey % 15 = 0",
    "nycha_bbls_24": "SELECT CAST(c_custkey AS STRING) AS bbl FROM {customer} WHERE c_custkey % 23 = 0",
    "fc_shd_building": """SELECT CAST(c_custkey AS STRING) AS bbl, c_custkey % 12 = 0 AS dataml, c_custkey % 18 = 0 AS datahudcon, c_custkey % 27 = 0 AS datahpd, c_custkey % 30 = 0 AS datanycha,
      DATE '2019-01-01' + CAST(c_custkey % 2000 AS INT) AS end421a, CASE WHEN c_custkey % 4 = 0 THEN DATE '2018-01-01' + CAST(c_custkey % 1900 AS INT) END AS endj51 FROM {customer} WHERE c_custkey % 3 = 0""",
    "hpd_ll44_projects": "SELECT CAST(c_custkey AS STRING) AS projectid FROM {customer} WHERE c_custkey % 4 = 0",
    "hpd_ll44_tax_incentive": "SELECT CAST(c_custkey AS STRING) AS projectid, CASE WHEN c_custkey % 3 = 0 THEN 'Article XI' ELSE '420-c' END AS taxincentivename FROM {customer} WHERE c_custkey % 2 = 0",
    "hpd_ll44_buildings": "SELECT CAST(c_custkey AS STRING) AS projectid, CAST(c_custkey + 1 AS STRING) AS bbl FROM {customer}",
    "real_property_master": f"""SELECT 'D' || CAST(o_orderkey AS STRING) AS documentid, CASE o_orderkey % 5 WHEN 0 THEN 'DEED' WHEN 1 THEN 'DEEDO' WHEN 2 THEN 'MTGE' WHEN 3 THEN 'AGMT' ELSE 'SAT' END AS doctype,
      CASE WHEN o_orderkey % 8 > 0 THEN {_DAY} END AS docdate, {_DAY} + 20 AS recordedfiled, CASE WHEN o_orderkey % 25 > 0 THEN o_totalprice ELSE 0 END AS docamount FROM {{orders}}""",
    "real_property_legals": f"SELECT 'D' || CAST(o_orderkey AS STRING) AS documentid, {_LOT} AS bbl FROM {{orders}} UNION ALL SELECT 'D' || CAST(o_orderkey AS STRING), CAST(o_custkey + 1 AS STRING) FROM {{orders}} WHERE o_orderkey % 4 = 0",
    "real_property_parties": "SELECT 'D' || CAST(l_orderkey AS STRING) AS documentid, 'P' || CAST(l_suppkey % 40 AS STRING) AS name, CAST(1 + l_linenumber % 2 AS INT) AS partytype FROM {lineitem}",
    "rentstab": "SELECT CAST(c_custkey AS STRING) AS ucbbl, CAST(c_custkey % 5 AS INT) AS uc2010, CAST(c_custkey % 4 AS INT) AS uc2015, CAST(c_custkey % 9 AS INT) AS uc2017 FROM {customer} WHERE c_custkey % 2 = 0",
    "rentstab_v2": "SELECT CAST(c_custkey AS STRING) AS ucbbl, CAST(c_custkey % 3 AS INT) AS uc2023, CAST(c_custkey % 4 AS INT) AS uc2022, CAST(c_custkey % 6 AS INT) AS uc2019, CAST(c_custkey % 8 AS INT) AS uc2018 FROM {customer} WHERE c_custkey % 3 > 0",
    "rentstab_summary": "SELECT CAST(c_custkey AS STRING) AS ucbbl, CAST(c_custkey % 11 AS INT) AS unitsstab2007 FROM {customer} WHERE c_custkey % 2 = 1",
    "dof_exemptions": "SELECT CAST(c_custkey AS STRING) AS bbl, 'e' || CAST(c_custkey % 3 AS STRING) AS exmpcode, CAST(1980 + c_custkey % 40 AS INT) AS benftstart FROM {customer}",
    "dof_exemption_classification_codes": "SELECT 'e' || CAST(r_regionkey AS STRING) AS exemptcode, CASE r_regionkey WHEN 0 THEN 'J-51 ALTERATION' WHEN 1 THEN '421A (10-15 YR)' ELSE 'OTHER' END AS description FROM {region}",
    "marshal_evictions_all": f"SELECT {_LOT} AS bbl, CASE WHEN o_orderkey % 4 > 0 THEN 'RESIDENTIAL' ELSE 'COMMERCIAL' END AS residentialcommercialind, {_DAY} AS executeddate FROM {{orders}} WHERE o_orderkey % 3 = 0",
    "oca_index": f"SELECT CAST(o_orderkey AS STRING) AS indexnumberid, CASE o_orderkey % 3 WHEN 0 THEN 'Holdover' WHEN 1 THEN 'Non-Payment' ELSE 'Other' END AS classification, CASE WHEN o_orderkey % 5 > 0 THEN 'Residential' ELSE 'Commercial' END AS propertytype, {_DAY} AS fileddate FROM {{orders}}",
    "oca_addresses_with_bbl": f"SELECT CAST(o_orderkey AS STRING) AS indexnumberid, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_custkey % 30 AS STRING) ELSE '' END AS unitsres, {_LOT} AS bbl FROM {{orders}}",
    "dob_certificate_occupancy": "SELECT CAST(c_custkey AS STRING) AS bbl, 'B' || CAST(c_custkey % 700 AS STRING) AS bin, 'NB' AS jobtype, DATE '2000-01-01' + CAST(c_custkey % 5000 AS INT) AS coissuedate FROM {customer} WHERE c_custkey % 2 = 0",
    "dob_foil_certificate_occupancy": "SELECT CAST(c_custkey + 900000 AS STRING) AS bbl, 'B' || CAST(c_custkey % 700 AS STRING) AS bin, 'A1' AS jobtype, DATE '2005-01-01' + CAST(c_custkey % 3000 AS INT) AS issuedate FROM {customer} WHERE c_custkey % 3 = 0",
    "dob_now_certificate_occupancy": "SELECT CAST(c_custkey AS STRING) AS bbl, 'B' || CAST(c_custkey % 700 AS STRING) AS bin, CASE WHEN c_custkey % 2 = 0 THEN 'New Building' ELSE 'Alteration CO' END AS jobtype, '2015-05-05' AS cofoissuancedate FROM {customer} WHERE c_custkey % 7 = 0",
    "pad_adr": "SELECT 'B' || CAST(c_custkey AS STRING) AS bin, CAST(c_custkey AS STRING) AS bbl FROM {customer} WHERE c_custkey < 700",
    "dobjobs": f"SELECT {_LOT} AS bbl, 'J' || CAST(o_orderkey % 4000 AS STRING) AS job, CASE WHEN o_orderkey % 6 > 0 THEN 'A1' END AS jobtype, {_DAY} AS prefilingdate FROM {{orders}} WHERE o_orderkey % 3 = 1",
    "dob_now_jobs": f"SELECT {_LOT} AS bbl, 'N' || CAST(o_orderkey % 4000 AS STRING) AS jobfilingnumber, {_DAY} AS filingdate FROM {{orders}} WHERE o_orderkey % 3 = 2",
    "dob_violations": f"SELECT {_LOT} AS bbl, CASE WHEN o_orderkey % 6 > 0 THEN 'V' END AS violationtypecode, CASE WHEN o_orderkey % 2 = 0 THEN 'V-DOB ACTIVE' ELSE 'V*-DOB Resolved' END AS violationcategory, {_DAY} AS issuedate FROM {{orders}} WHERE o_orderkey % 4 = 1",
    "ecb_violations": f"SELECT {_LOT} AS bbl, CASE WHEN o_orderkey % 6 > 1 THEN 'CLASS - 1' END AS severity, CASE o_orderkey % 3 WHEN 0 THEN 'CERTIFICATE PENDING' WHEN 1 THEN 'CERTIFICATE ACCEPTED' END AS certificationstatus, {_DAY} AS issuedate FROM {{orders}} WHERE o_orderkey % 4 = 2",
    "dohmh_rodent_inspections": f"SELECT {_LOT} AS bbl, CASE WHEN o_orderkey % 3 = 0 THEN 'BAIT' ELSE 'Initial' END AS inspectiontype, CASE o_orderkey % 4 WHEN 0 THEN 'Rat Activity' WHEN 1 THEN 'Passed' WHEN 2 THEN 'Failed for Other R' END AS result, {_DAY} AS inspectiondate, CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} + 3 END AS approveddate FROM {{orders}} WHERE o_orderkey % 5 = 2",
    "signature_unhp_buildings": """SELECT CAST(c_custkey AS STRING) AS bbl, 'Pool ' || CAST(c_nationkey % 4 AS STRING) AS loan_pool, CASE WHEN c_custkey % 9 > 0 THEN 'Ann & Co. ' || CAST(c_nationkey AS STRING) END AS landlord, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 1100 AS STRING) ELSE '' END AS bip,
      CAST(c_custkey % 300 AS STRING) AS water_charges, '2016-06-06' AS origination_date, CAST(c_custkey * 10 AS STRING) AS debt_total FROM {customer} WHERE c_custkey % 2 = 0""",
    "signature_unhp_loan_status": "SELECT CAST(c_custkey AS STRING) AS bbl, CASE c_custkey % 3 WHEN 0 THEN 'satisfied' WHEN 1 THEN 'watchlist' END AS action, '2020-02-02' AS date, CASE WHEN c_custkey % 5 = 0 THEN 'u' END AS url, 'l' AS label FROM {customer} WHERE c_custkey % 6 < 3",
    "landlords": """SELECT CAST(c_custkey AS STRING) AS bbl, CAST(c_custkey AS INT) AS registrationid, 'NAME ' || CAST(c_custkey % 300 AS STRING) AS name, CAST(c_custkey % 200 AS STRING) || ' OAK ST, NY' AS bizaddr,
      CAST(c_custkey % 200 AS STRING) || ' OAK ST' AS bizhousestreet, CASE c_custkey % 4 WHEN 0 THEN '' ELSE 'APT ' || CAST(c_custkey % 2 AS STRING) END AS bizapt, CAST(c_custkey % 3 AS STRING) AS bizzip FROM {customer}""",
}


def city(spark: SparkSession, star: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """Source tables with all their columns, null where the star schema has nothing for them."""
    out = {}
    for name in names:
        wanted = T.StructType.fromDDL(INDICATORS) if name == "indicators" else schema(name)
        used = set(re.findall(r"\{(\w+)\}", TABLES[name]))
        made = spark.sql(TABLES[name], **{t: star[t] for t in used})
        out[name] = made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    return out


def ctes(*names: str) -> str:
    """The same tables, as far as they have values, for the head of a WITH clause."""
    return ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', TABLES[n])})" for n in names)
