"""The stages, one after the other, against what each must do to its own input."""

import os
import random

import corpus_pipeline
import pytest

from parcelweave import storage
from parcelweave.llm import toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, prose, tmp_path_factory):
    r = random.Random(12)
    items = [prose(9000 + k, 30) for k in range(5)]
    rows, labels = [], []
    for k in range(400):
        text, bad = prose(k, r.randint(40, 150)), k % 4 == 0
        if bad:
            text += " " + " ".join(r.choices(("blorgfish", "snorkwit", "grumbletoad"), k=3))
        if k % 50 == 7:
            text += "\n" + items[k % 5]
        rows.append((k, text, "en", f"s{k % 3}", len(text), "x", k, "y", "z"))
        labels.append((k, 1, int(bad)))
    rows += [(k + 1000, t, "en", "s1", len(t), "x", k, "y", "z") for k, t, *_ in rows[1:40:2]]
    rows += [(2000, None, None, None, None, None, None, None, None), (2001, "", "en", "s0", 0, "", 0, "", ""), (2000, None, None, None, None, None, None, None, None)]
    rows += [(2002, prose(5000, 30_000), "en", "s1", 9, "x", 1, "y", "z")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Size string, fp int, source_size string, _row string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert at == len(corpus_pipeline.STAGES) - 1 or out.columns == columns, name
        out.write.parquet(f"{sf_dir}/out-{at}")
        docs = spark.read.parquet(f"{sf_dir}/out-{at}")
        seen[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(k >= 1000 or k % 4 for k in seen["toxicity"]) and len(seen["toxicity"]) >= 300 + 3
    unique = seen["near_duplicates"]
    assert len(unique) == len(set(unique)) and not any(1000 <= k < 2000 for k in unique) and 2000 in unique and 2001 not in unique
    assert seen["benchmark_passages"] == [k for k in unique if k >= 1000 or k % 50 != 7]
    assert set(seen["mixture"]) <= set(seen["benchmark_passages"]) and len(seen["mixture"]) != len(set(seen["mixture"]))
    assert seen["shards"] == seen["mixture"]
    with storage.scope() as written:
        assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == seen["shards"]
    left = [t._folder for t in written if os.path.exists(t._folder.removeprefix("file://").removeprefix("file:"))]
    assert len([f for f in left if "mixture-" in f]) == 1 and len(left) <= 3  # the last corpus and what the last stage reads of it


def test_empty(spark, sf_dir, tmp_path):
    path = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    assert toxicity.held_out("doc_id") is not None


def test_names(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
