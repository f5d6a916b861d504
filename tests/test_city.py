"""Registrations, buildings, histories, eligibility, dashboard, alerts and maps on small tables."""

import datetime as dt
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelweave.functions.geo import Conic, hex_bin, hex_centre
from parcelweave.operators import polygons as pg
from parcelweave.plans import alerts, buildings, dashboard, goodcause, history, maps

AS_OF = "2024-03-15"


def test_registrations(source):
    contacts = source(
        "hpd_contacts",
        dict(registrationid=1, type="CorporateOwner", corporationname="ACME LLC", businesshousenumber="1", businessstreetname="MAIN ST", businesszip="10001"),
        dict(registrationid=1, type="CorporateOwner", corporationname="ACME LLC", businesshousenumber="1", businessstreetname="MAIN ST", businesszip="10001"),
        dict(registrationid=1, type="HeadOfficer", firstname="ANN", lastname="LEE", corporationname=""),
        dict(registrationid=2, type="HeadOfficer", firstname=None, lastname="X"),
        dict(registrationid=2, type="IndividualOwner", firstname="BO", lastname="Y"),
    )
    registrations = source("hpd_registrations", dict(registrationid=1, bbl="1"), dict(registrationid=2, bbl="2"), dict(registrationid=3, bbl="3"))
    made = {r.registrationid: r for r in buildings.registrations_with_contacts(registrations, contacts).collect()}
    assert made[1].corpnames == ["ACME LLC"] and made[1].businessaddrs == ["1 MAIN ST 10001"]
    assert [tuple(o) for o in made[1].ownernames] == [("HeadOfficer", "ANN LEE")]
    assert [c.title for c in made[1].allcontacts] == ["HeadOfficer", "Corporation", "Corporation"]
    assert made[2].corpnames is None and made[2].businessaddrs is None and made[3].allcontacts is None
    one = {r.registrationid: (r.businessaddr, r.ownername) for r in buildings.landlord_contact(registrations, contacts).collect()}
    assert one == {1: ("1 MAIN ST 10001", "ANN LEE"), 2: (None, None), 3: (None, None)}


@pytest.fixture(scope="module")
def city(sources):
    return sources(
        hpd_registrations=[dict(registrationid=1, bbl="1", buildingid=10, registrationenddate="2024-01-01"), dict(registrationid=2, bbl="1", buildingid=11, registrationenddate="2023-01-01"), dict(registrationid=3, bbl="2", buildingid=12)],
        hpd_contacts=[dict(registrationid=i, type="HeadOfficer", firstname="ANN", lastname="LEE", corporationname=None) for i in (1, 3)],
        hpd_violations=[dict(bbl="1", **{"class": c}, violationstatus=s, inspectiondate=d, ordernumber=o, novdescription=n) for c, s, d, o, n in (("A", "Open", "2024-01-10", "1", None), ("B", "Open", "2024-01-20", "666", None), ("C", "Close", "2024-02-01", "566", "MOLD on wall"), ("B", "Open", "2020-01-01", "1", None))],
        hpd_complaints_and_problems=[dict(bbl="1", type="EMERGENCY", majorcategory="GENERAL", minorcategory="DOOR", receiveddate="2024-02-02", apartment="5"), dict(bbl="1", type="EMERGENCY", majorcategory="HEATING", receiveddate="2024-02-03", apartment="BLDG"), dict(bbl="1", type="REFERRAL", majorcategory="HEATING", receiveddate="2024-02-04", apartment="6"), dict(bbl="1", type="REFERRAL", majorcategory="OLD", receiveddate="2015-02-04")],
        hpd_litigations=[dict(bbl="1", openjudgement="YES", penalty="10.5", casestatus="PENDING", casetype="Tenant Action", caseopendate="2024-03-01"), dict(bbl="1", openjudgement="NO", penalty="3", casetype="Tenant Action", caseopendate="2023-01-01")],
        hpd_omo_charges=[dict(omonumber="o1", bbl="1", omocreatedate="2024-01-05")],
        hpd_omo_invoices=[dict(omonumber="o1", chargeamount=5), dict(omonumber="o1", chargeamount=7)],
        hpd_hwo_charges=[dict(bbl="1", hwocreatedate="2024-01-05", chargeamount=12), dict(bbl="1", hwocreatedate="2024-01-06", chargeamount=1)],
        hpd_vacateorders=[dict(bbl="1", vacatetype="PARTIAL", vacateeffectivedate="2024-01-05"), dict(bbl="1", vacatetype="ENTIRE-BUILDING", vacateeffectivedate="2023-01-04")],
        hpd_aep=[dict(bbl="1", currentstatus="AEP Active")],
        pluto_latest=[
            dict(bbl="1", borocode="1", block="2", lot="3", address="1 MAIN ST", borough="MN", zipcode="10001", unitsres=20, unitstotal=21, yearbuilt=1950, bldgclass="D1", ownername="ACME LLC", latitude=40.7484, longitude=-73.9857),
            dict(bbl="2", address="2 MAIN ST", borough="BK", zipcode="11201", unitsres=5, unitstotal=5, bldgclass="C1", ownername="ACME LLC", latitude=40.75, longitude=-73.98),
            dict(bbl="3", borough="BX", unitsres=0, bldgclass="R4", ownername="ACME LLC"),
        ],
        pluto_latest_districts=[dict(bbl="1", assem_dist="7", coun_dist="3"), dict(bbl="2", assem_dist="7")],
        real_property_master=[dict(documentid="d1", doctype="DEED", docdate="2019-01-01", docamount=100), dict(documentid="d2", doctype="DEEDO", recordedfiled="2020-01-01", docamount=200), dict(documentid="m1", doctype="MTGE", docdate="2021-01-01"), dict(documentid="m2", doctype="AGMT", docdate="2018-01-01")],
        real_property_legals=[dict(documentid=d, bbl=b) for d, b in (("d1", "1"), ("d2", "1"), ("m1", "1"), ("m1", "2"), ("m2", "1"))],
        real_property_parties=[dict(documentid="m1", name="ANN", partytype=1), dict(documentid="m1", name="BANK", partytype=2)],
        rentstab=[dict(ucbbl="1", uc2015=9)],
        rentstab_v2=[dict(ucbbl="1", uc2023=0, uc2022=4), dict(ucbbl="2", uc2023=9)],
        rentstab_summary=[dict(ucbbl="1", unitsstab2007=12)],
        dof_exemptions=[dict(bbl="1", exmpcode="e", benftstart=1999), dict(bbl="1", exmpcode="f", benftstart=2005)],
        dof_exemption_classification_codes=[dict(exemptcode="e", description="J-51 ALTERATION"), dict(exemptcode="f", description="421A (1-15)")],
        marshal_evictions_all=[dict(bbl="1", residentialcommercialind="RESIDENTIAL", executeddate="2018-05-05"), dict(bbl="1", residentialcommercialind="COMMERCIAL", executeddate="2018-05-05")],
        oca_index=[dict(indexnumberid=i, classification="Holdover", propertytype="Residential", fileddate="2023-06-01") for i in ("i1", "i2")],
        oca_addresses_with_bbl=[dict(indexnumberid="i1", unitsres="20", bbl="1"), dict(indexnumberid="i1", unitsres="20", bbl="1"), dict(indexnumberid="i2", unitsres="5", bbl="2")],
        dob_certificate_occupancy=[dict(bbl="9", bin="b1", jobtype="NB", coissuedate="2010-01-01"), dict(bbl="2", bin="b2", jobtype="A1", coissuedate="2005-01-01")],
        dob_now_certificate_occupancy=[dict(bbl="2", bin="b2", cofoissuancedate="2004-01-01", jobtype="New Building")],
        pad_adr=[dict(bin="b1", bbl="1")],
        nycha_bbls_24=[dict(bbl="2")],
        fc_shd_building=[dict(bbl="1", dataml=False, end421a="2030-01-01")],
        dobjobs=[dict(bbl="1", job="j1", jobtype="A1", prefilingdate="2024-01-01")],
        dob_now_jobs=[dict(bbl="1", jobfilingnumber="n1", filingdate="2024-01-02")],
        dob_violations=[dict(bbl="1", violationtypecode="x", violationcategory="V-ACTIVE", issuedate="2024-01-01")] * 2,
        ecb_violations=[dict(bbl="1", severity="s", issuedate="2022-01-01")],
        dohmh_rodent_inspections=[dict(bbl="1", inspectiontype="Initial", result="Rat Activity", inspectiondate="2023-01-01"), dict(bbl="1", inspectiontype="Initial", result="Passed", inspectiondate="2022-01-01")],
        signature_unhp_buildings=[dict(bbl="1", loan_pool="Pool A", landlord="Ann & Co.", bip="600", debt_total="100"), dict(bbl="2", loan_pool="Pool A", landlord=None, bip="", debt_total="50")],
        signature_unhp_loan_status=[dict(bbl="2", action="satisfied", date="2024-01-01"), dict(bbl="1", action=None, date="2024-01-02", url="u", label="l")],
        landlords=[dict(bbl=b, name="ANN", bizaddr="1 A", bizhousestreet="1 A", bizzip="1") for b in "12"],
    )


def test_buildings(city):
    filings = history.evictions_by_building(city["oca_index"], city["oca_addresses_with_bbl"])
    registered = buildings.registrations_with_contacts(city["hpd_registrations"], city["hpd_contacts"]).cache()
    made = buildings.build_buildings(registered, city["hpd_violations"], city["hpd_complaints_and_problems"], city["pluto_latest"], city["marshal_evictions_all"], city["dof_exemptions"], city["dof_exemption_classification_codes"], city["rentstab_summary"], city["rentstab_v2"], city["real_property_master"], city["real_property_legals"], filings, AS_OF).cache()
    rows = {r.bbl: r for r in made.collect()}
    one = rows["1"]
    assert (one.registrationid, one.hpdbuildings, one.totalviolations, one.openviolations, one.totalcomplaints, one.recentcomplaints) == (1, 2, 4, 3, 4, 3)
    assert [tuple(c) for c in one.recentcomplaintsbytype] == [("HEATING", 2), ("DOOR", 1)]
    assert (one.evictions, one.rsunits2007, one.rsdiff, one.yearstartedj51, one.yearstarted421a, one.lastsaleacrisid, one.evictionfilings) == (1, 12, -12, 1999, 2005, "d2", 1)
    assert rows["2"].evictionfilings is None and rows["2"].recentcomplaintsbytype is None
    assert len(made.columns) == 36
    assert [r.bbl for r in buildings.buildings_from_bbl(made, registered, "1").collect()] == ["1", "2"]
    assert [r.bbl for r in buildings.buildings_from_name(made, city["hpd_contacts"], "ann", "Lee").collect()] == ["1", "2"]
    assert buildings.buildings_csv(made).where("bbl = '1'").first().recentcomplaintsbytype == "HEATING (2), DOOR (1)"


def test_history(spark, city, frame):
    filings = history.evictions_by_month(city["oca_index"], city["oca_addresses_with_bbl"])
    stabilised = city["rentstab"].join(city["rentstab_v2"], "ucbbl", "full")
    args = city["hpd_violations"], city["hpd_complaints_and_problems"], city["dobjobs"], city["dob_violations"], city["ecb_violations"], filings, stabilised, city["pluto_latest"]
    rows = {r.month: r for r in history.indicator_history(spark, "1", AS_OF, *args).collect()}
    assert min(rows) == "2007-01" and max(rows) == "2024-02" and len(rows) == 206
    assert (rows["2024-01"].hpdviolations_total, rows["2024-01"].hpdviolations_class_b, rows["2024-01"].dobviolations_total, rows["2024-02"].hpdcomplaints_emergency) == (2, 1, 2, 2)
    assert rows["2023-06"].evictionfilings == 1 and rows["2015-01"].rentstabilizedunits == 9 and rows["2022-01"].rentstabilizedunits == 4
    small = {r.month: r for r in history.indicator_history(spark, "2", AS_OF, *args).collect()}
    assert small["2023-06"].evictionfilings is None and small["2023-06"].hpdviolations_total == 0
    unknown = history.indicator_history(spark, "x", AS_OF, *args).first()
    assert unknown.evictionfilings == 0
    deed = history.latest_deed(city["real_property_master"], city["real_property_legals"], "1").first()
    assert (deed.documentid, deed.docdate) == ("d1", dt.date(2019, 1, 1))
    assert history.portfolio_size(frame("orig_id int, bbls array<string>", (1, ["1", "2"])), "2").first().portfolio_size == 2


@pytest.fixture(scope="module")
def cause(city, frame):
    certs = goodcause.latest_certificates(goodcause.certificates(city["dob_certificate_occupancy"], city["dob_foil_certificate_occupancy"], city["dob_now_certificate_occupancy"]), city["pad_adr"], city["pluto_latest"]).cache()
    members = goodcause.portfolio_bbls(frame("bbls array<string>", (["1", "2"],), (["3"],))).cache()
    sizes = goodcause.portfolio_sizes(members, city["pluto_latest"]).cache()
    subsidies = goodcause.subsidised(city["fc_shd_building"], city["hpd_ll44_projects"], city["hpd_ll44_tax_incentive"], city["hpd_ll44_buildings"], city["nycha_bbls_24"], AS_OF).cache()
    return certs, members, sizes, subsidies


def test_eligibility(city, cause):
    certs, members, sizes, subsidies = cause
    assert {r.bbl: (str(r.co_issued), r.co_type) for r in certs.collect()} == {"1": ("2010-01-01", "NB"), "2": ("2005-01-01", "A1")}
    assert {r.portfolio_id: (r.portfolio_units, r.portfolio_bbls) for r in sizes.collect()} == {1: (25, 2), 2: (0, 1)}
    rows = {r.bbl: r for r in goodcause.eligibility(city["pluto_latest"], city["pluto_latest_districts"], city["rentstab_v2"], subsidies, certs, members, sizes).collect()}
    one, two, three = rows["1"], rows["2"], rows["3"]
    assert (one.eligible_bldgclass, one.eligible_co, one.eligible_rent_stab, one.eligible_subsidy, one.eligible_portfolio_size, one.eligible) == (True, False, False, True, True, False)
    assert (two.post_hstpa_rs_units, two.subsidy_name, two.eligible_subsidy, two.eligible_portfolio_size) == (5, "NYCHA", False, True)
    assert not three.eligible_bldgclass and not three.eligible_portfolio_size


def test_screener(city, cause):
    certs, members, sizes, subsidies = cause
    numbered = goodcause.documents_since_deed(city["real_property_master"], city["real_property_legals"], city["pluto_latest"]).cache()
    assert {(r.bbl, r.documentid, r.doc_order) for r in numbered.collect()} == {("1", "m1", 1), ("2", "m1", 1)}
    docs = goodcause.documents_by_bbl(numbered, city["real_property_parties"]).cache()
    owner, shared = goodcause.owner_pairs(city["pluto_latest"]), goodcause.document_pairs(numbered)
    assert {(r.ref_bbl, r.bbl) for r in owner.collect()} == {(a, b) for a in "123" for b in "123" if a != b}
    pairs = goodcause.portfolio_pairs(members, city["landlords"], city["pluto_latest"])
    related = goodcause.related_lots(pairs, owner, shared, city["pluto_latest"], docs).cache()
    row = related.where("ref_bbl = '1'").first()
    assert (row.bbl, row.match_ownername, row.match_multidoc, row.party_name_match, row.address) == ("2", True, True, True, "2 MAIN ST, Brooklyn, 11201")
    assert 1600 < row.distance_ft < 1800
    made = goodcause.screener(city["pluto_latest"], city["rentstab_v2"], subsidies, certs, members, sizes, docs, related)
    assert len(made.columns) == 25 or len(made.columns) == 26
    got = goodcause.screener_lookup(made, "1").first()
    assert got.acris_docs[0].doc_id == "m1" and got.related_properties[0].bbl == "2" and got.portfolio_units == 25
    assert goodcause.screener_lookup(made, "3").first().related_properties == []


def test_related_by_evidence_equals_pairs(frame, source, city, cause):
    """Cells of two members, names and streets that are null or shared by others, and a lot that is a member twice."""
    certs, _, _, subsidies = cause
    lots = [dict(bbl=str(i), address=f"{i} ST", borough="MN", zipcode="1", unitsres=i % 4, ownername=("A LLC", "B CORP", "ANN")[i % 3], latitude=40.7 + i / 1000, longitude=-73.9) for i in range(20)]
    pluto = source("pluto_latest", *lots)
    landlords = source("landlords", *[dict(bbl=str(i), registrationid=i, name=None if i % 7 == 6 else f"N{i % 3}", bizaddr=f"a{i % 2}", bizhousestreet=None if i % 11 == 10 else f"S{i % 4}", bizzip="1") for i in range(20)])
    members = frame("portfolio_id long, bbl string", *[(i % 2, str(i)) for i in range(20)], (0, "3"))
    sizes = goodcause.portfolio_sizes(members, pluto)
    numbered = frame("bbl string, documentid string, doctype string, doc_date date, doc_order int", *[(str(i % 12), f"d{i % 5}", "MTGE", dt.date(2020, 1, 1), 1 + i // 12) for i in range(30)])
    docs = goodcause.documents_by_bbl(numbered, frame("documentid string, name string, partytype int", *[(f"d{i}", f"p{i % 3}", 1) for i in range(4)])).cache()
    pairs = goodcause.portfolio_pairs(members, landlords, pluto)
    want = goodcause.related_lots(pairs, goodcause.owner_pairs(pluto), goodcause.document_pairs(numbered), pluto, docs)
    rows = goodcause.evidence(members, landlords, pluto, numbered, docs)
    got = goodcause.related_by_evidence(rows, 2)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) != []
    whole = goodcause.screener(pluto, city["rentstab_v2"], subsidies, certs, members, sizes, docs, want)
    made = goodcause.screener_by_evidence(pluto, city["rentstab_v2"], subsidies, certs, members, sizes, docs, rows, 2)
    assert sorted(map(str, made.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    plain = goodcause.screener_with_bbls(pluto, city["rentstab_v2"], subsidies, certs, members, sizes, docs, goodcause.standing(members, landlords, pluto), 2)
    assert sorted((r.bbl, r.portfolio_bbls, r.related_properties) for r in plain.collect()) == sorted((r.bbl, r.portfolio_bbls, [x.bbl for x in r.related_properties]) for r in whole.collect())


def test_pairs_of_one_owner_are_told_by_one_comparison(frame, source):
    """Documents that only other portfolios' lots share tell no pair, and lists of one element are not searched."""
    pluto = source("pluto_latest", *[dict(bbl=str(i), address=f"{i} ST", borough="MN", zipcode="1", unitsres=1, ownername=("A LLC", "B CORP", "ANN")[i % 3], latitude=40.7 + i / 1000, longitude=-73.9) for i in range(12)])
    landlords = source("landlords", *[dict(bbl=str(i), registrationid=i, name=f"N{i // 4}", bizhousestreet="S", bizzip="1") for i in range(12)])
    members = frame("portfolio_id long, bbl string", *[(i // 6, str(i)) for i in range(12)])
    numbered = frame("bbl string, documentid string, doctype string, doc_date date, doc_order int", *[(str(i), d, "MTGE", dt.date(2020, 1, 1), 1) for i, d in ((0, "near"), (3, "near"), (1, "far"), (9, "far"), (2, "own"), (2, "own"), (4, "far"))])
    docs = frame("bbl string, party_names array<string>, acris_docs array<struct<doc_id:string,doc_type:string,doc_date:date>>")
    rows = goodcause.evidence(members, landlords, pluto, numbered, docs)
    assert {r.bbl: r.documents for r in rows.collect() if r.documents} == {"0": ["near"], "3": ["near"], "1": ["far"], "4": ["far"]}
    want = goodcause.related_lots(goodcause.portfolio_pairs(members, landlords, pluto), goodcause.owner_pairs(pluto), goodcause.document_pairs(numbered), pluto, docs)
    got = goodcause.related_by_evidence(rows, 2)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) != []
    assert "arrays_overlap" not in got.select("match_ownername", "match_multidoc")._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_is_round(spark):
    from parcelweave.functions.values import nearest

    values = [0.0, 0.49999999999999994, 0.5, 1.4999999999999998, 1.5, 2.5, 3.5, 1e9 + 0.5, 4503599627370495.5, 9007199254740993.0]
    made = spark.createDataFrame([(x,) for x in [*values, None]], "x double").select("x", nearest("x").alias("n"), F.round("x").cast("long").alias("want")).collect()
    assert all(r.n == r.want for r in made) and len(made) == 11


def test_screener_makes_no_pairs(spark, frame, source, city, cause):
    """Where each lot is a member once nothing is dealt for pairs, and lists of bbls are those of one name's portfolio without the lot."""
    certs, _, _, subsidies = cause
    pluto = source("pluto_latest", *[dict(bbl=str(i), address="A", borough="MN", zipcode="1", unitsres=i % 4, latitude=40.7, longitude=-73.9) for i in range(9)])
    landlords = source("landlords", *[dict(bbl=str(i), registrationid=i, name="N" if i < 6 else f"N{i % 2}", bizhousestreet=f"S{i % 3}", bizzip="1") for i in range(9)])
    members = frame("portfolio_id long, bbl string", *[(int(i >= 6), str(i)) for i in range(9)])
    docs = frame("bbl string, party_names array<string>, acris_docs array<struct<doc_id:string,doc_type:string,doc_date:date>>")
    numbered = frame("bbl string, documentid string, doctype string, doc_date date, doc_order int")
    args = pluto, city["rentstab_v2"], subsidies, certs, members, goodcause.portfolio_sizes(members, pluto), docs
    whole = goodcause.screener_by_evidence(*args, goodcause.evidence(members, landlords, pluto, numbered, docs), 2)
    assert "b_acris_docs" not in whole._jdf.queryExecution().optimizedPlan().toString()
    got = {r.bbl: r.related_properties for r in goodcause.screener_with_bbls(*args, goodcause.standing(members, landlords, pluto), 2).collect()}
    assert got == {r.bbl: [x.bbl for x in r.related_properties] for r in whole.collect()}
    assert got["0"] == ["1", "2", "3", "5"] and got["1"] == ["2", "3", "5"] and got["6"] == [] and got["8"] == ["6"]


def test_dashboard(spark, city):
    made = dashboard.buildings(city, AS_OF).cache()
    rows = {r.bbl: r for r in made.collect()}
    one, two = rows["1"], rows["2"]
    assert (one.hp_total, one.hp_open_judgements, one.hp_penalies, one.hp_active) == (2, 1, 10.5, 1)
    assert (one.hpd_erp_orders, one.hpd_erp_charges, one.hpd_erp_orders_per_unit) == (2, 13.0, 0.1)  # two equal orders collapse
    assert (one.hpd_viol_bc_open, one.hpd_viol_bc_total, one.hpd_viol_heat, one.hpd_viol_pests, one.hpd_viol_water) == (2, 2, 1, 1, 1)
    assert (one.hpd_comp_emerg_total, one.hpd_comp_apts, one.hpd_comp_apts_pct, one.hpd_comp_heat) == (2, "5, 6", 10.0, 2)
    assert one.hpd_active_vacate == "Entire-Building (Jan 4, 2023)"  # the fourth day of its week
    assert (one.dob_jobs, one.dob_ecb_viol_total, one.dob_ecb_viol_open) == (1, 1, 2)  # equal counts and rows collapse
    assert (one.evictions_executed, one.evictions_filed, two.evictions_filed, one.rs_units, one.in_aep, one.in_conh) == (1, 1, None, 4, True, False)
    assert (one.landlord_slug, one.latest_action, two.latest_action, one.last_rodent_result, str(one.last_sale_date)) == ("ann-co", "no_action", "satisfied", "Failed", "2020-01-01")
    assert one.link_hpd.endswith("?boroId=1&block=2&lot=3") or one.link_hpd.endswith("/10")
    assert dashboard.buildings(city, AS_OF)._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 3 + 16 // dashboard.TOGETHER
    groups = dashboard.collections(made).cache()
    got = {(r.collection_type, r.collection_name): r for r in groups.collect()}
    assert set(got) == {("landlord", "Ann & Co."), ("loan_pool", "Pool A"), ("all", "all")}
    assert got["all", "all"].buildings_agg == 1 and len(got["all", "all"].bldg_data) == 2 and got["all", "all"].bip_500_pct_agg == 100.0
    assert dashboard.landlords(groups).first().landlord_slug == "ann-co"
    assert {(r.collection_slug, r.landlords, r.buildings_agg) for r in dashboard.portfolios(groups).collect()} == {("pool-a", 1, 1), ("all", 1, 1)}
    assert [r.bbl for r in dashboard.map_points(made).collect()] == ["1"]
    months = dashboard.charts(spark, city, AS_OF).cache()
    chart = {(r.bbl, r.month): r for r in months.collect()}
    assert len(chart) == 2 * 170
    jan = chart["1", "2024-01"]
    assert (jan.hpdviolations_total, jan.hpderp_charges, jan.dobpermits_jobs, jan.dobviolations_total) == (2, 13.0, 1, 2)
    assert (chart["1", "2023-01"].evictions_filed, chart["2", "2023-01"].evictions_filed, chart["1", "2018-01"].evictions_executed, chart["1", "2015-01"].rentstab_units) == (1, None, 2, 9)
    plain = dashboard.collection_months(spark, city, dashboard.base(city).where("bbl IS NOT NULL"), AS_OF)
    assert sorted(map(str, plain.collect())) == sorted(map(str, dashboard.collection_charts(made, months).select(plain.columns).collect()))
    sums = {(r.collection_type, r.collection_name, r.month): r for r in dashboard.collection_charts(made, months).collect()}
    assert sums["all", "all", "2024-01"].hpdviolations_total == 2.0


def test_no_bip(frame):
    from parcelweave.functions.values import ratio

    assert frame("a int, b int", (1, 0)).select(ratio("a", "b").alias("r")).first().r is None


@pytest.fixture(scope="module")
def area(source):
    def row(bbl, units, portfolio, week, half, **more):
        return dict(bbl=bbl, unitsres=units, portfolio_id=portfolio, zipcode="1", hpd_comp__week=week, hpd_comp__6mo=half, hpd_comp_per_unit__week=week / max(units or 1, 1), hpd_viol_per_unit_bc__week=0.0, **more)

    rows = [row(f"b{i}", 10 + i, 1 if i in (0, 8, 9) else 100 + i, 20 - i, 5) for i in range(10)]
    rows += [row("zero", 20, None, 0, 0), row("nounits", 0, 7, 3, 1), dict(bbl="unknown", unitsres=5, zipcode="1"), row("far", 50, 1, 99, 99) | {"zipcode": "2"}]
    rows[0] |= dict(lastsaledate="2024-03-10", lastsaleamount=50000, lastsaleacrisid="s")
    rows[1] |= dict(lastsaledate="2024-03-11", lastsaleamount=5, hpd_vacate_date="2024-01-01")
    return source("indicators", *rows)


def test_district(area):
    rows = alerts.district(area, {"zipcode": ["1"], "nta": []}).collect()
    assert len(rows) == 7 and {r.bbl for r in rows[5:]} == {"b8", "b9"}
    assert all(r.area_bbls_all == 13 for r in rows) and rows[0].area_bbls_shared_portfolio in (1, 3)
    assert {r.all_bbls_shared_portfolio for r in rows if r.portfolio_id == 1} == {4}
    ranks = {r.bbl: r for r in alerts.ranked_area(area, {"zipcode": ["1"]}).collect()}
    assert "unknown" not in ranks and ranks["zero"].rank_comp__week is None and ranks["b0"].rank_comp__week == 1
    assert alerts.district(area, {"zipcode": []}).count() == 0
    with pytest.raises(ValueError):
        alerts.district(area, {"ward": ["1"]})


def test_recent(area, source):
    tracker = source("dataset_tracker", dict(key="acris", value="2024-03-12T01:02:03.000004"), dict(key="hpd_litigations", value="2024-03-12"))
    sales = alerts.sales(area, tracker, {"zipcode": ["1"]}).collect()
    assert [(r.bbl, r.total_sales, str(r.last_updated)) for r in sales] == [("b0", 1, "2024-03-11")]
    cases = source("hpd_litigations", *[dict(bbl="b1", casetype="Tenant Action", caseopendate=f"2024-03-{d:02d}") for d in range(1, 15)], dict(bbl="b1", casetype="Other", caseopendate="2024-03-01"))
    got = alerts.litigations(area, cases, tracker, {"zipcode": ["1"]}, "2024-03-13").collect()
    assert len(got) == 10 and got[0].total_litigations == 12 and str(got[0].caseopendate) == "2024-03-12"
    assert [r.bbl for r in alerts.vacate_orders(area, {"zipcode": ["1"]}).collect()] == ["b1"]
    assert alerts.buildings(area, ["b1", "b2"]).count() == 2
    rules = source("dataset_alerts", dict(datasetname="acris", expectedupdate=dt.timedelta(days=1), alertthreshold=dt.timedelta(hours=1)))
    late = {r.dataset: (r.last_updated, r.is_late) for r in alerts.tracker_status(tracker, rules, "2024-03-14").collect()}
    assert late == {"acris": ("2024-03-12T01:02:03.000004Z", True), "hpd_litigations": ("2024-03-12T00:00:00.000000Z", None)}
    assert alerts.last_updated(tracker, "acris").count() == 1


def test_projection(frame):
    x, y = Conic().forward("lon", "lat")
    rows = frame("lon double, lat double", (-73.985664, 40.748441), (-74.0, 40 + 10 / 60)).select(x.alias("x"), y.alias("y"))
    lon, lat = Conic().inverse("x", "y")
    made = rows.select("x", "y", lon.alias("lon"), lat.alias("lat")).collect()
    assert abs(made[0].x - 988222.2) < 0.2 and abs(made[0].y - 211954.2) < 0.2
    assert abs(made[1].x - 984250) < 0.01 and abs(made[1].y) < 0.01
    assert abs(made[0].lon + 73.985664) < 1e-8 and abs(made[0].lat - 40.748441) < 1e-8


def test_hexagons(frame, city, cause):
    points = [(float(37 * i % 1013), float(71 * i % 997)) for i in range(300)]
    q, r = hex_bin("x", "y", 50.0)
    cx, cy = hex_centre("q", "r", 50.0)
    rows = frame("x double, y double", *points).select("x", "y", q.alias("q"), r.alias("r")).select("*", cx.alias("cx"), cy.alias("cy")).collect()
    centres = {(c.cx, c.cy) for c in rows}
    for p in rows:  # no other centre is nearer
        own = math.hypot(p.x - p.cx, p.y - p.cy)
        assert own <= 50 + 1e-9 and all(math.hypot(p.x - a, p.y - b) >= own - 1e-6 for a, b in centres)
    certs, members, sizes, subsidies = cause
    eligible = goodcause.eligibility(city["pluto_latest"], city["pluto_latest_districts"], city["rentstab_v2"], subsidies, certs, members, sizes).cache()
    made = maps.hexagons(eligible).collect()
    assert {z.zoom_level for z in made} == set(range(10, 17)) and sum(z.bbls_count for z in made if z.zoom_level == 16) == 2
    ring = json.loads(made[0].geom_json)["coordinates"][0]
    assert len(ring) == 7 and abs(ring[0][0] + 74) < 1 and abs(ring[0][1] - 40.7) < 1
    rolled = {d.assemdist: d.unitsres for d in maps.district_rollup(eligible, "assem_dist").collect()}
    assert rolled == {7: 25, None: 0}


def square(x, y, side):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y))]


@settings(max_examples=30, deadline=None)
@given(st.floats(1, 100), st.floats(1, 100))
def test_label_points(w, h):
    ring = [(0.0, 0.0), (w, 0.0), (w, h), (0.0, h), (0.0, 0.0)]
    x, y = pg.label_point([ring])
    assert pg.to_edge((x, y), [ring]) >= 0.98 * min(w, h) / 2
    assert abs(pg.area([ring]) - w * h) < 1e-6 * w * h and pg.inside((w / 2, h / 2), [ring]) and not pg.inside((2 * w, h / 2), [ring])
    middle = pg.centre([[ring]])
    assert math.isclose(middle[0], w / 2) and math.isclose(middle[1], h / 2)


def test_simplify():
    ring = [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    assert len(pg.simplify(ring, 1.0)) == 5 and len(pg.simplify(ring, 100.0)) >= 4


def test_layers(frame):
    geom = f"geom {pg.GEOMETRY}"
    one = [[square(984250, 1000, 500)]]
    two = [[square(984250, 1000, 500)], [square(990000, 1000, 900), square(990400, 1400, 100)]]
    shapes = {
        "nycc_25a": frame(f"coundist int, {geom}", (3, one)), "nyad_25a": frame(f"assemdist int, {geom}", (7, two)), "nyss_25a": frame(f"stsendist int, {geom}", (9, one)),
        "nynta2020_25a": frame(f"nta2020 string, ntaname string, cdta2020 string, cdtaname string, borocode int, {geom}", ("MN01", "Some Place", "MN01", "MN01 Downtown (CD 1 Equivalent)", 1, one)),
        "nycd_25a": frame(f"borocd int, {geom}", (101, one), (199, one)), "zipcodes": frame(f"zipcode string, {geom}", ("10001", one), ("00083", one)),
        "nyct2020_25a": frame(f"boroct2020 string, nta2020 string, ct2020 string, {geom}", ("1000100", "MN01", "000100", one)),
    }
    layers = maps.layers(shapes).cache()
    rows = {(r.typevalue, r.areavalue): r.arealabel for r in layers.collect()}
    assert rows == {("coun_dist", "3"): "District 3", ("assem_dist", "7"): "District 7", ("stsen_dist", "9"): "District 9", ("nta", "MN01"): "Some Place", ("community_dist", "101"): "MN01 Downtown", ("community_dist", "199"): None, ("zipcode", "10001"): "10001", ("census_tract", "1000100"): "MN 000100"}
    made = maps.features(layers)
    got = {r.typeValue: r for r in made.collect()}
    both = json.loads(got["assem_dist"].districts_geojson), json.loads(got["assem_dist"].labels_geojson)
    assert both[0]["features"][0]["geometry"]["type"] == "MultiPolygon" and both[0]["features"][0]["id"] == both[1]["features"][0]["id"]
    assert abs(both[1]["features"][0]["geometry"]["coordinates"][0] + 73.98) < 0.05
    assert maps.district_lookup(made, "zipcode").first().label == "Zip Code"
    placed = maps.located(frame("id int, x double, y double", (1, 984300.0, 1100.0), (2, 990450.0, 1450.0), (3, 990100.0, 1100.0), (4, 0.0, 0.0)), shapes["nyad_25a"], "assemdist")
    assert sorted(r.id for r in placed.collect()) == [1, 3]


def test_costly_steps_on_small_rows_are_dealt(spark):
    """Covers of few small shapes run in many tasks, which adaptive execution does not lower."""
    from parcelweave.operators.cover import cover
    from parcelweave.shipping import many_tasks

    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    shapes = spark.createDataFrame([(i, [[corners]]) for i in range(40)], f"k int, geom {pg.GEOMETRY}").coalesce(1)
    cells = cover(shapes, "k")
    assert cells.select("k").distinct().count() == 40 and cells.rdd.getNumPartitions() == many_tasks(spark)
