"""Shared operators and functions: ties, nulls and order."""

import datetime as dt

from pyspark.sql import functions as F

from parcelweave.functions import text as tx
from parcelweave.functions import values as v
from parcelweave.operators import relational as op


def test_latest(frame):
    rows = frame("k string, v int, t int", ("a", None, 1), ("a", 2, 2), ("a", 2, 1), ("b", None, 1))
    assert sorted(tuple(r) for r in op.latest_by(rows, ["k"], "v", F.col("t")).collect()) == [("a", 2, 1), ("b", None, 1)]
    assert sorted(tuple(r) for r in op.latest_by(rows, ["k"], "v", F.col("t"), nulls_first=True).collect()) == [("a", None, 1), ("b", None, 1)]


def test_ranks(frame):
    values = [5, 3, 3, 0, None, 0, 9, 1]
    rows = frame("i int, a int", *enumerate(values))
    made = op.ranked_many(rows, {"up": F.col("a"), "down": -F.col("a")}, {"up": F.col("a") == 0}).collect()
    def place(x, sign):
        return 1 + sum(y is None if x is not None else False for y in values) + sum(y is not None and x is not None and sign * y > sign * x for y in values)
    for r in made:
        assert r.up == (None if r.a == 0 else place(r.a, 1)) and r.down == place(r.a, -1)
    inside = op.ranked(frame("k int, a int", (1, 5), (1, 5), (1, 2), (2, 1)), "a", "r", partition=["k"]).collect()
    assert sorted((x.k, x.r) for x in inside) == [(1, 1), (1, 1), (1, 3), (2, 1)]
    assert op.ranked(rows.limit(0), "a", "r").count() == 0


def test_dense_ids(spark):
    rows = spark.range(5000).repartition(7).withColumn("k", F.expr("id * 7919 % 5000"))
    got = {r.k: r.n for r in op.with_dense_id(rows, ["k"], "n").collect()}
    assert got == {k: k + 1 for k in range(5000)}


def test_min_max(frame):
    assert [r.a_norm for r in op.min_max(frame("a int", (3,), (3,)), ["a"]).collect()] == [None, None]
    assert sorted(r.a_norm for r in op.min_max(frame("a double", (1.0,), (2.0,), (5.0,)), ["a"]).collect()) == [0.0, 0.25, 1.0]


def test_spine(spark, frame):
    months = [r.month for r in op.month_spine(spark, "2023-11-01", "2024-03-31").collect()]
    assert months == ["2023-11", "2023-12", "2024-01", "2024-02"]
    facts = [frame("month string, a long", ("2023-12", 2)), frame("month string, a long, b long", ("2023-12", 3, 1), ("1999-01", 9, 9))]
    made = {r.month: (r.a, r.b) for r in op.zero_filled(op.month_spine(spark, "2023-11-01", "2024-01-31"), facts, ["month"], ["a", "b"]).collect()}
    assert made == {"2023-11": (0.0, 0.0), "2023-12": (5.0, 1.0)}


def test_stack(frame):
    rows = frame("a string, b string, x int", ("p", None, 1), ("p", "q", 2))
    made = {(r.collection_type, r.collection): r.s for r in op.stacked(rows, {"a": F.col("a"), "b": F.col("b"), "all": None}, [F.sum("x").alias("s")]).collect()}
    assert made == {("a", "p"): 3, ("b", "q"): 2, ("all", "all"): 3}
    assert op.stacked(rows, {"b": F.col("b")}, [F.sum("x").alias("s")], keep_null=True).count() == 2


def test_lists(frame):
    rows = frame("k int, l string", (1, "a | b |"), (2, " |"), (3, None), (4, "a|a"))
    assert sorted((r.k, r.member) for r in op.list_members(rows, ["k"], "l", r"\s*\|\s*").collect()) == [(1, "a"), (1, "b"), (4, "a"), (4, "a")]
    groups = frame("g int, m array<string>", (1, ["a", "b"]), (2, ["b", "c"]), (3, ["d"]))
    assert sorted(r.member for r in op.co_members(groups, "m", "b").collect()) == ["a", "b", "c"]


def test_text(frame):
    row = frame("a string, l array<string>", ("  O'Neil-SMITH  st 5b ", ["x", "y", "z"])).select(
        tx.initcap_words("a").alias("initcap"), tx.slugify("a").alias("slug"), tx.squish("a").alias("squish"), tx.sentence_list("l").alias("three"),
        tx.sentence_list(F.slice("l", 1, 2)).alias("two"), tx.sentence_list(F.slice("l", 1, 1)).alias("one"), tx.sentence_list(F.slice("l", 1, 0)).alias("none"), tx.join_words(F.lit("a"), F.lit(None), F.lit("b")).alias("joined"),
        tx.norm_address(F.lit("100 Park  Ave"), strip_unit=True).alias("over"), tx.norm_address(F.lit("100 Park  Ave apt 5"), strip_unit=True, strict_unit=True).alias("strict"), tx.norm_address(F.lit("1 A St # 7"), strip_unit=True, strict_unit=True).alias("number"),
        tx.house_number(F.lit("12-5 X")).alias("house"), tx.house_number(F.lit("X 12")).alias("no_house"), tx.title_case(F.lit("ab-c dE")).alias("title"),
    ).first()
    assert (row.initcap, row.slug, row.squish) == ("  O'Neil-Smith  St 5b ", "o-neil-smith-st-5b", "O'Neil-SMITH st 5b")
    assert (row.three, row.two, row.one, row.none, row.joined) == ("x, y, and z", "x and y", "x", "", "ab")
    assert (row.over, row.strict, row.number) == ("100", "100 PARK AVE", "1 A ST")
    assert (row.house, row.no_house, row.title) == ("12-5", None, "Ab-c De")


def test_values(frame):
    row = frame("a array<string>, d date", ([None, "x"], dt.date(2024, 1, 6))).select(
        v.array_or_null("a").alias("some"), v.array_or_null(F.array(F.lit(None).cast("string"))).alias("none"), v.length_or_null(F.array().cast("array<int>")).alias("n"), v.overlap("a", F.array(F.lit("y"), F.lit(None).cast("string"))).alias("overlap"),
        v.short_date("d").alias("short"), v.round_int(F.lit(2.5)).alias("even"), v.latest_non_zero(F.lit(0), F.lit(None).cast("int"), F.lit(7), default=0).alias("latest"), v.typed(F.lit(""), "int").alias("typed"),
        v.ratio(F.lit(1), F.lit(0)).alias("ratio"), v.band(F.lit(None).cast("int"), [(6, 1.0)], 2.0).alias("band"), F.array_join(F.transform(v.split_evenly(F.sequence(F.lit(1), F.lit(5)), F.lit(3)), lambda p: F.size(p).cast("string")), ",").alias("parts"),
    ).first()
    assert (row.some, row.none, row.n, row.overlap, row.short, row.even, row.latest) == (["x"], None, None, False, "Jan 7, 2024", 2, 7)
    assert (row.typed, row.ratio, row.band, row.parts) == (None, None, 0.0, "2,2,1")


def test_plans_push_down(spark, tmp_path):
    """Only the wanted columns are read, and filters reach the scan."""
    from parcelweave.sources.load import point

    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id").cast("string").alias("pin"), F.lit(1).alias("a"), F.lit(2).alias("b")).write.parquet(path)
    plan = point(spark.read.parquet(path), "pin", "7").select("a")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(pin), EqualTo(pin,7)]" in plan and "b:int" not in plan.split("ReadSchema")[1]
