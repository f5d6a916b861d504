from parcelweave.plans import indexes, lookup


def read(df):
    """Rows that the scans of a plan gave, for which it is run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        for stage in range(3):
            if leaf.getClass().getSimpleName().endswith("QueryStageExec"):
                leaf = leaf.plan().collectLeaves().apply(0)
        if leaf.getClass().getSimpleName() == "FileSourceScanExec":
            total += leaf.metrics().apply("numOutputRows").value()
    return total


def test_members_read_little(spark, tmp_path):
    spark.range(200_000).selectExpr("id div 20 AS orig_id", "id AS pin").createOrReplaceTempView("m")
    groups = spark.sql("SELECT orig_id, collect_list(pin) AS pins FROM m GROUP BY orig_id UNION ALL SELECT 900001, array(7L, 555555L, NULL) UNION ALL SELECT NULL, array(7L)")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        indexes.write_members(groups, str(tmp_path / "m"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = indexes.co_members(spark, str(tmp_path / "m"), 7)
    assert sorted(r.pin for r in found.collect()) == [*range(20), 555_555]
    assert read(found) < 30_000  # of 200,000, two groups of rows
    assert indexes.co_members(spark, str(tmp_path / "m"), -1).count() == 0


def test_search_equals_the_scan(frame, tmp_path):
    rows = [("1", "12", "Elm Street", "12 ELM STREET"), ("2", None, None, "4 Éclair Ave"), ("3", "7", "Elmwood", None), ("4", "", "a_b%c", "x\\y"), ("5", "100", "Oak", "100 OAK ST, REAR")]
    parcels = frame("pin string, housenumber string, streetname string, address string, city string, state string, zip string", *[(*r, None, None, None) for r in rows])
    path = str(tmp_path / "t")
    lookup.write_search_index(parcels, path)
    for q in ("elm", "ELM st", "m%t", "2 e", "é", "ÉCLAIR", "éclair av", "st, rear", "a_b", "b%c", "x\\y", "oak%rear", "_ak", "zzz", "7 elmw"):
        assert lookup.address_search(parcels, q, index=path).collect() == lookup.address_search(parcels, q).collect(), q
    assert indexes.candidates(parcels.sparkSession, path, "elm%oo").count() == 2 and indexes.candidates(parcels.sparkSession, path, "el") is None
