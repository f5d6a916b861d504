import pytest

from parcelweave.sources.builds import build_file_needed, build_needed
from parcelweave.sources.load import BuildFile, write_table


@pytest.fixture
def world(spark, tmp_path):
    for name, rows in (("a", [(1, 2), (2, 3)]), ("b", [(1, 5)])):
        spark.createDataFrame(rows, "k int, v int").coalesce(1).write.parquet(str(tmp_path / name))
    inputs = {n: (str(tmp_path / n), lambda n=n: spark.read.parquet(str(tmp_path / n))) for n in "ab"}
    steps = {"joined": (("sums", "b"), lambda s, b: s.join(b, "k", "left")), "sums": (("a",), lambda a: a.groupBy("k").agg({"v": "sum"})), "alone": (("b",), lambda b: b)}
    return tmp_path, inputs, steps


def test_only_what_changed(spark, world):
    path, inputs, steps = world
    def build(**more):
        return build_needed(spark, str(path / "made"), steps, inputs, **more)
    tables, ran = build()
    assert sorted(ran) == ["alone", "joined", "sums"] and ran.index("sums") < ran.index("joined") and tables["joined"].count() == 2
    again, ran = build()
    assert ran == [] and sorted(again["joined"].collect()) == sorted(tables["joined"].collect())
    spark.createDataFrame([(7, 7)], "k int, v int").coalesce(1).write.mode("append").parquet(str(path / "b"))
    tables, ran = build()
    assert sorted(ran) == ["alone", "joined"] and tables["alone"].count() == 2
    assert sorted(build(versions={"sums": "2"})[1]) == ["joined", "sums"] and build(versions={"sums": "2"})[1] == []
    write_table(tables["alone"].limit(0), str(path / "made" / "alone"))  # written by another hand
    tables, ran = build(versions={"sums": "2"})
    assert ran == ["alone"] and tables["alone"].count() == 2


def test_a_step_that_fails_runs_again(spark, world):
    path, inputs, steps = world
    def fails(_):
        raise RuntimeError("no")
    with pytest.raises(RuntimeError):
        build_needed(spark, str(path / "made"), {**steps, "alone": (("b",), fails)}, inputs)
    assert "alone" in build_needed(spark, str(path / "made"), steps, inputs)[1]
    with pytest.raises(ValueError, match="missing or circular: x"):
        build_needed(spark, str(path / "made"), {"x": (("x",), fails)}, inputs)


def test_build_file(spark, tmp_path):
    (tmp_path / "chi_owners.csv").write_text("pin,mail_address_name\n1,ANN\n")
    plan = BuildFile.read("dependencies:\n  - chi_owners\nwow_pre_sql:\n  - owners.sql\n")
    builders = {"owners.sql": ("owners", ("chi_owners",), lambda o: o.select("pin", "mail_address_name"))}
    def build():
        return build_file_needed(spark, plan, str(tmp_path), str(tmp_path / "made"), builders)
    assert build()[1] == ["owners"] and build()[1] == []
    (tmp_path / "chi_owners.csv").write_text("pin,mail_address_name\n1,ANN\n2,BOB\n")
    tables, ran = build()
    assert ran == ["owners"] and tables["owners"].count() == 2
