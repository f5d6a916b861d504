"""The build from files to lookups, on a street of five parcels."""

import csv
import json

import pytest

from parcelweave.plans import lookup
from parcelweave.plans.functions import register_pin_functions
from parcelweave.plans.parcels import build_indicators, build_parcels, build_portfolios
from parcelweave.sources.datasets import DATASETS
from parcelweave.sources.load import BuildFile, load_csv, load_dataset, load_positional, read_table, write_table

MILL, BARN, QUAY, ROW, LONE = (f"{n:014d}" for n in (70010, 70011, 70020, 70031, 70099))
NOBODY = "9" * 14


def parcel(pin, year="2024", **more):
    return dict(pin=pin, pin10=pin[:10], year=year, **more)


def owner(pin, address, name, row, year="2024"):
    return dict(pin=pin, year=year, prop_address_full=address, prop_address_city_name="CHICAGO", mail_address_name=name, mail_address_full="PO BOX 8", row_id=row)


def seen(number, street, status="OPEN", kind="RD"):
    return dict(violation_status=status, street_number=number, street_name=street, street_type=kind)


ROWS = {
    "chi_parcels": [
        parcel(MILL, **{"class": "211"}, zip_code="60644", lon="-87.75", lat="41.9", ward_num="29"), parcel(MILL, "2019", **{"class": "100"}, ward_num="1"),
        parcel(BARN, zip_code="60644", lon="-87.76", lat="41.91"), parcel(QUAY, lon="", lat=""), parcel(ROW, "2022"), parcel(LONE),
    ],
    "chi_owners": [
        owner(MILL, "12 WINDMILL RD", "TERN TRUST", "A1"), owner(BARN, "14-16  Windmill Rd Unit 2", "TERN TRUST", "A2"), owner(ROW, "18 WINDMILL RD", "TERN TRUST", "A3"),
        owner(QUAY, "3 QUAY, REAR", "", "B7"), owner(QUAY, "1 OLD QUAY", "SOLD LONG AGO", "B6", "2001"),
    ],
    "chi_permits": [dict(pin_list=MILL[:10]), dict(pin_list=f"{MILL[:10]} |{LONE[:10]}| "), dict(pin_list=""), dict(pin_list="1234")],
    "chi_violations": [seen("12", "WINDMILL"), seen("12", " windmill  ", "COMPLIED", "Rd"), seen("18", "WINDMILL", "OPENED"), seen("", "", "OPEN", "")],
    "chi_311": [dict(street_number="14-16", street_name="WINDMILL", street_type="RD")] * 3,
    "chi_geographies": [dict(geo_type="ward", ward="29", ward_id="29")],
}
STEPS = {
    "indicators.sql": ("indicators", ("parcels", "chi_permits", "chi_violations", "chi_311"), build_indicators),
    "parcels.sql": ("parcels", ("chi_parcels", "chi_owners"), build_parcels),
    "groups.sql": ("portfolios", ("chi_parcels", "chi_owners"), build_portfolios),
}
PLAN = """---
dependencies:
  # what the steps read
  - chi_parcels
  - chi_owners
  - chi_permits
  - chi_violations
  - chi_311
api_dependencies: [chi_geographies]
wow_pre_sql:
  - parcels.sql
  - groups.sql
wow_post_sql:
  - indicators.sql
other: []
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("csv")
    for name, rows in ROWS.items():
        with open(made / f"{name}.csv", "w", newline="") as f:
            out = csv.DictWriter(f, DATASETS[name].columns)
            out.writeheader()
            out.writerows(rows)
    return str(made)


@pytest.fixture(scope="module")
def built(spark, folder):
    return {k: v.cache() for k, v in BuildFile.read(PLAN).build(spark, folder, STEPS).items()}


@pytest.fixture(scope="module")
def args(built):
    return built["parcels"], built["portfolios"], built["indicators"]


def test_build_file(spark, folder):
    plan = BuildFile.read(PLAN)
    assert plan.steps("pre") == ("parcels.sql", "groups.sql") and plan.steps("post") == ("indicators.sql",) and len(plan.steps()) == 3
    assert len(plan.datasets()) == 5 and plan.datasets(for_api=True)[-1] == "chi_geographies"
    with pytest.raises(ValueError, match="an entry outside"):
        BuildFile.read("- x")
    with pytest.raises(ValueError, match="unknown datasets: nothing"):
        BuildFile.read("dependencies: [nothing]").build(spark, folder, {})


def test_parcel(built):
    rows = {r.pin: r for r in built["parcels"].collect()}
    mill, barn, quay = rows[MILL], rows[BARN], rows[QUAY]
    assert (mill.housenumber, mill.streetname, mill.owner_name, mill.ward, mill.land_class, mill.lat) == ("12", "WINDMILL RD", "TERN TRUST", "29", "211", 41.9)
    assert (barn.housenumber, barn.streetname) == ("14-16", "Windmill Rd Unit 2")
    assert (quay.address, quay.owner_id, quay.lat) == ("3 QUAY, REAR", "B7", None)
    assert rows[LONE].address is None and len(rows) == 5 and len(built["parcels"].columns) == 22


def test_indicators(built):
    rows = {r.pin: tuple(r)[1:] for r in built["indicators"].collect()}
    # permits go by the first ten digits of a pin, which all five parcels share
    assert rows == {MILL: (3, 1, 2, 0), BARN: (3, 0, 0, 3), ROW: (3, 1, 1, 0), QUAY: (3, 0, 0, 0), LONE: (3, 0, 0, 0)}


def test_portfolio(args):
    rows = lookup.portfolio_addresses(*args, BARN).collect()
    assert [r.pin for r in rows] == [MILL, BARN, ROW] and rows[0].address == "12 WINDMILL RD"
    assert lookup.portfolio_addresses(*args, NOBODY).count() == 0
    groups = {tuple(r.owner_names): r.pins for r in args[1].collect()}
    assert groups == {("TERN TRUST",): [MILL, BARN, ROW], ("B7",): [QUAY], (LONE,): [LONE]}


def test_totals(args):
    assert tuple(lookup.portfolio_totals(*args, ROW).first()) == (3, 0, 9, 2, 3, 3)
    assert tuple(lookup.portfolio_totals(*args, NOBODY).first()) == (0,) * 6


def test_sql_functions(spark, args):
    register_pin_functions(*args)
    called = spark.sql(f"SELECT * FROM assoc_addrs_from_pin('{BARN}') ORDER BY pin").collect()
    assert called == lookup.portfolio_addresses(*args, BARN).collect()
    for pin in (ROW, NOBODY):
        assert tuple(spark.sql("SELECT * FROM agg_info_from_pin(:pin)", {"pin": pin}).first()) == tuple(lookup.portfolio_totals(*args, pin).first())


def test_exports(built, args, tmp_path):
    for name, rows in (("all", built["portfolios"].repartition(3)), ("none", built["portfolios"].limit(0))):
        lookup.export_portfolios(rows, str(tmp_path / name), str(tmp_path / f"{name}-parts"))
        assert [r["pins"] for r in json.loads((tmp_path / name).read_text())] == [r.pins for r in rows.orderBy("orig_id").collect()]
    lines = list(lookup.address_export(*args, MILL))
    assert lines[0].startswith("pin,housenumber") and [x.split(",")[0] for x in lines[1:]] == [MILL, BARN, ROW]
    assert lookup.address_export(*args, NOBODY) is None
    said = json.loads("".join(lookup.address_response(*args, QUAY)))
    assert said["geosearch"] == {"pin": QUAY} and [a["address"] for a in said["addrs"]] == ["3 QUAY, REAR"]


def test_search(built):
    assert [r.pin for r in lookup.address_search(built["parcels"], "windmill").collect()] == [MILL, BARN, ROW]
    assert [r.pin for r in lookup.address_search(built["parcels"], "_8 W%RD").collect()] == [ROW]
    status, body = lookup.respond(lookup.address_search, built["parcels"], "quay")
    assert status == 200 and [r["pin"] for r in json.loads("".join(body))["result"]] == [QUAY]
    assert lookup.respond(lookup.address_search, built["parcels"], " ")[0] == 400
    status, body = lookup.respond(lookup.building_info, built["parcels"], built["indicators"], "12x")
    assert status == 400 and json.loads("".join(body))["validationErrors"] == "Invalid PIN: '12x'"


def test_corners(built, frame):
    assert tuple(lookup.bounding_box(built["parcels"]).first()) == (-87.76, 41.9, -87.75, 41.91)
    row = lookup.headline(frame("name string, areas array<string>", ("TERN TRUST", ["A", "B"])), "name", "areas").first()
    assert (row.name, row.areas) == ("Tern Trust", "A and B")


def test_pins():
    assert lookup.valid_pins(f"{MILL}, {ROW}") == [MILL, ROW]
    with pytest.raises(ValueError, match="Invalid PIN: '5'"):
        lookup.valid_pins(f"{MILL},5")


def test_summary(frame):
    cols = "units_res int, permits_total int, violations_open int, violations_total int, requests_311_total int"
    row = lookup.summary(frame(cols, (6, 0, 9, 9, 1), (4, 1, 1, 3, 0))).first()
    assert tuple(row) == (2, 10, 1, 10, 12, 1, 5.0, 1.0)
    assert lookup.summary(frame(cols)).first().violations_open_per_unit == 0.0


def test_headers(spark, tmp_path):
    spec = DATASETS["chi_owners"]

    def load(text):
        (tmp_path / "some.csv").write_text(text)
        return load_csv(spark, str(tmp_path / "some.csv"), spec)

    rows = load('﻿pin,odd,mail_address_name\n1,x,\n2,y,""\n').collect()
    assert [(r.pin, r.mail_address_name, r.row_id) for r in rows] == [("1", None, None), ("2", "", None)]
    assert load_csv(spark, str(tmp_path / "none.csv"), spec).count() == 0
    for bad in ("a,b\n1,2\n", ""):
        with pytest.raises(ValueError):
            load(bad)


def test_quoted_breaks(spark, tmp_path):
    spec = DATASETS["chi_owners"]
    (tmp_path / "quoted.csv").write_text('pin,mail_address_name,row_id\n1,"A\nB, ""C""",x\n2,D,y\n')
    rows = load_csv(spark, str(tmp_path / "quoted.csv"), spec).collect()
    assert [(r.pin, r.mail_address_name, r.row_id) for r in rows] == [("1", 'A\nB, "C"', "x"), ("2", "D", "y")]
    for bad in ("1,A,x,more\n", "1,A\n"):
        (tmp_path / "bad.csv").write_text(f"pin,mail_address_name,row_id\n{bad}")
        with pytest.raises(Exception, match="MALFORMED"):
            load_csv(spark, str(tmp_path / "bad.csv"), spec).select("pin").collect()


def test_each_file_has_its_own_header(spark, tmp_path):
    spec, folder = DATASETS["chi_owners"], tmp_path / "many"
    folder.mkdir()
    for name, text in {"a.csv": "pin,mail_address_name\n1,ANN\n", "b [1].csv": 'mail_address_name,pin\nBOB,2\n"",3', "c.csv": '"odd\nname",row_id,pin\r\nx,r,4\r\n\r\n', "d.csv": ""}.items():
        (folder / name).write_text(text, newline="")
    rows = load_csv(spark, str(folder), spec).orderBy("pin").collect()
    assert [(r.pin, r.mail_address_name, r.row_id) for r in rows] == [("1", "ANN", None), ("2", "BOB", None), ("3", "", None), ("4", None, "r")]
    for bad in ("pin,PIN\n1,2\n", 'pin,"mail\n'):
        (folder / "e.csv").write_text(bad)
        with pytest.raises(ValueError):
            load_csv(spark, str(folder), spec)


@pytest.mark.parametrize("size", [1, 7, 16, 41])
def test_quoted_breaks_across_splits(spark, tmp_path, size):
    import csv
    import random

    r = random.Random(size)
    rows = [[r.choice(["a", "", 'x"y', "\n", "1\n\n2", "long " * 9 + "\n" * 4, ",", "\r\n", "é"]) for _ in range(3)] for _ in range(60)]
    path = tmp_path / "some.csv"
    with path.open("w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["a", "b", "c"], *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size * 16))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = load_positional(spark, str(path), ["a", "b", "c"])
        assert sorted(map(list, got.collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_files_of_two_headers_across_splits(spark, tmp_path):
    """Splits depend on the size of all files, so that each header's files may not be read alone."""
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("pin,mail_address_name\n" + "".join(f'{i},"n\n""{i}"""\n' for i in range(400)))
    (folder / "b.csv").write_text("MAIL_ADDRESS_NAME,odd,Pin\n" + "".join(f'"m\n{i}",x,{i + 1000}\n' for i in range(900)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = load_csv(spark, str(folder), DATASETS["chi_owners"]).select("pin", "mail_address_name").collect()
        assert sorted(map(tuple, got)) == sorted([(str(i), f'n\n"{i}"') for i in range(400)] + [(str(i + 1000), f"m\n{i}") for i in range(900)])
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_positional(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Any,Names\n1,"x\ny"\n')
    assert [tuple(r) for r in load_positional(spark, str(tmp_path / "p.csv"), ["a", "b"]).collect()] == [("1", "x\ny")]
    assert load_positional(spark, None, ["a", "b"]).columns == ["a", "b"]


def test_versions(spark, tmp_path, frame):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    first = write_table(frame("a int", (1,)), path)
    assert write_table(frame("a int", (1,), (2,)), path, "a").count() == 2
    assert first.count() == 1  # a reader that has begun
    frame("a int", (9,)).write.parquet(f"{path}/00000003-unfinished")  # a crash before the version counts
    assert read_table(spark, path).count() == 2
    write_table(frame("a int", (3,)), path)
    assert [r.a for r in read_table(spark, path).collect()] == [3]
    assert sorted(p.name for p in (tmp_path / "t" / "_versions").iterdir() if not p.name.startswith("."))[0].startswith("00000002")
