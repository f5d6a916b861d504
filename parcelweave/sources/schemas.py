"""The columns that the plans read of each source table, with their types."""

from __future__ import annotations

from pyspark.sql import types as T


def _columns(**kinds: str) -> str:
    """Names by type; in the order given."""
    return ", ".join(f"{name} {kind}" for kind, names in kinds.items() for name in names.split())


def _yearly(first: int, last: int) -> str:
    return " ".join(f"uc{y}" for y in range(first, last + 1))


SOURCES = {
    "hpd_registrations": _columns(string="housenumber streetname zip boro bbl bin", int="registrationid buildingid", date="lastregistrationdate registrationenddate"),
    "hpd_contacts": _columns(int="registrationid", string="type corporationname firstname lastname businesshousenumber businessstreetname businessapartment businesscity businessstate businesszip"),
    "landlords": _columns(string="bbl name bizaddr bizhousestreet bizapt bizzip", int="registrationid"),
    "hpd_violations": _columns(string="bbl class violationstatus ordernumber novdescription", date="inspectiondate novissueddate"),
    "hpd_complaints_and_problems": _columns(string="bbl type majorcategory minorcategory apartment", date="receiveddate"),
    "hpd_litigations": _columns(string="bbl openjudgement penalty findingofharassment casestatus casetype respondent", date="caseopendate"),
    "hpd_omo_charges": _columns(string="omonumber bbl", date="omocreatedate"),
    "hpd_omo_invoices": _columns(string="omonumber", double="chargeamount"),
    "hpd_hwo_charges": _columns(string="bbl", date="hwocreatedate", double="chargeamount"),
    "hpd_vacateorders": _columns(string="bbl vacatetype", date="vacateeffectivedate rescinddate"),
    "hpd_aep": _columns(string="bbl currentstatus"),
    "hpd_conh": _columns(string="bbl"),
    "hpd_underlying_conditions": _columns(string="bbl currentstatus"),
    "hpd_ll44_projects": _columns(string="projectid"),
    "hpd_ll44_tax_incentive": _columns(string="projectid taxincentivename"),
    "hpd_ll44_buildings": _columns(string="projectid bbl"),
    "nycha_bbls_24": _columns(string="bbl"),
    "fc_shd_building": _columns(string="bbl", boolean="datanycha datahpd datahcrlihtc datahudlihtc datahudcon datahudfin dataml", date="end421a endj51"),
    "pluto_latest": _columns(string="bbl borocode block lot address borough zipcode bldgclass ownername", int="unitsres unitstotal yearbuilt council", double="latitude longitude"),
    "pluto_latest_districts": _columns(string="bbl coun_dist assem_dist stsen_dist cong_dist"),
    "real_property_master": _columns(string="documentid doctype", date="docdate recordedfiled", double="docamount"),
    "real_property_legals": _columns(string="documentid bbl"),
    "real_property_parties": _columns(string="documentid name", int="partytype"),
    "rentstab": _columns(string="ucbbl", int=_yearly(2007, 2017)),
    "rentstab_v2": _columns(string="ucbbl", int=_yearly(2018, 2023)),
    "rentstab_summary": _columns(string="ucbbl", int="unitsstab2007"),
    "dof_exemptions": _columns(string="bbl exmpcode", int="benftstart"),
    "dof_exemption_classification_codes": _columns(string="exemptcode description"),
    "marshal_evictions_all": _columns(string="bbl residentialcommercialind", date="executeddate"),
    "oca_index": _columns(string="indexnumberid classification propertytype", date="fileddate"),
    "oca_addresses_with_bbl": _columns(string="indexnumberid unitsres bbl"),
    "dob_certificate_occupancy": _columns(string="bbl bin jobtype", date="coissuedate"),
    "dob_foil_certificate_occupancy": _columns(string="bbl bin jobtype", date="issuedate"),
    "dob_now_certificate_occupancy": _columns(string="bbl bin cofoissuancedate jobtype"),
    "pad_adr": _columns(string="bin bbl"),
    "dobjobs": _columns(string="bbl job jobtype", date="prefilingdate"),
    "dob_now_jobs": _columns(string="bbl jobfilingnumber", date="filingdate"),
    "dob_violations": _columns(string="bbl violationtypecode violationcategory", date="issuedate"),
    "ecb_violations": _columns(string="bbl severity certificationstatus", date="issuedate"),
    "dohmh_rodent_inspections": _columns(string="bbl inspectiontype result", date="approveddate inspectiondate"),
    "signature_unhp_buildings": _columns(string="bbl loan_pool landlord bip water_charges origination_date debt_total"),
    "signature_unhp_loan_status": _columns(string="bbl action date url label"),
    "dataset_tracker": _columns(string="key value"),
    "dataset_alerts": "datasetname string, expectedupdate interval day to second, alertthreshold interval day to second",
}

_SPANS = "week 1mo 6mo bldg_month"
#: The table of indicators by building that the alerts read.
INDICATORS = ", ".join([
    _columns(string="bbl bin housenumber streetname boro hpd_link coun_dist nta census_tract assem_dist stsen_dist zipcode dob_ecb_viol_bin dob_comp_bin lastsaleacrisid hpd_vacate_type hpd_vacate_reason dob_vacate_bin dob_vacate_type dob_vacate_complaint_number"),
    _columns(int="unitsres rsunitslatest portfolio_id community_dist lagged_eviction_filings hpd_vacate_units_affected hpd_viol_bc__week hpd_viol_bc__1mo hpd_viol_bc__6mo hpd_viol_all__week hpd_viol_all__bldg_month"),
    _columns(int=" ".join(f"{m}__{s}" for m in ("hpd_comp", "dob_ecb_viol", "dob_comp", "evictions_filed") for s in _SPANS.split())),
    _columns(double="hpd_comp_per_unit__week hpd_comp_per_unit__1mo hpd_viol_per_unit_bc__week hpd_viol_per_unit_bc__1mo lastsaleamount", date="lagged_eviction_date lastsaledate hpd_vacate_date dob_vacate_date"),
])


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SOURCES[name])
