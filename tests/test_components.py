import random

from pyspark.sql import functions as F

from parcelweave import catalog


def test_all_rows_count(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(300), r.randrange(400), float(r.randint(1, 50)), 0.05) for _ in range(420)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    root, first = {s: s for s, *_ in rows}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for s, p, *_ in rows:
        a, b = sorted((find(s), find(first.setdefault(p, s))))
        root[b] = a
    got = {x.node: x.component for x in catalog.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == {s: find(s) for s in root}


def test_spanning(spark, frame, monkeypatch):
    from parcelweave.operators import components
    from parcelweave.operators.components import connected_components, spanning

    r = random.Random(8)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i + 1, i) for i in range(1000, 1100)] + [(10**12, 2000 + i) for i in range(90)] + [(7000, 7000)]
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(components, "AT_A_TIME", most)
        edges = frame("src long, dst long", *pairs, (None, 3), (3, None))
        lone = edges.select("src", F.col("src").alias("dst"))
        links = spanning(edges)
        found, wanted = ({(x.node, x.component) for x in connected_components(e.unionByName(lone)).collect()} for e in (links, edges))
        assert found == wanted
    assert spanning(edges.where("src < 0")).count() == 0
    dense = spark.range(40).crossJoin(spark.range(40).toDF("dst")).toDF("src", "dst").coalesce(1)
    assert spanning(dense).count() == 39


def test_split_moves_few_links(spark, monkeypatch):
    """Two joined cliques: components see a few links for each node, and each edge is written once."""
    from parcelweave.operators import communities

    seen, written = [], {}
    plain, kept = communities.connected_components, communities.materialize

    def counted(edges):
        seen.append(edges.where("src <> dst").count())
        return plain(edges)

    def listed(df, label):
        made = kept(df, label)
        written.setdefault(label, []).append(made.count())
        return made

    monkeypatch.setattr(communities, "connected_components", counted)
    monkeypatch.setattr(communities, "materialize", listed)
    own = spark.range(40).toDF("src").crossJoin(spark.range(40).toDF("dst")).where("src < dst")
    edges = own.unionByName(own.selectExpr("src + 40", "dst + 40").toDF("src", "dst")).selectExpr("src", "dst", "3.0D AS weight").coalesce(2)
    edges = edges.unionByName(spark.createDataFrame([(39, 40, 1.0)], "src long, dst long, weight double"))
    made = communities.split_components(spark.range(80).selectExpr("id AS nodeid", "5 AS size"), edges).collect()
    assert {(x.nodeid // 40, x.orig_id, x.portfolio) for x in made} == {(0, 1, 1), (1, 1, 2)} and len(made) == 80
    assert seen[0] <= 2 * 80 and written["links"][0] == 2 * 780 + 1
