"""The stream gives what a batch over the same events gives, and a rerun adds nothing."""

import datetime as dt

from parcelweave.streaming.events import EVENTS, distinct_events, read_events, run_to_table, window_counts


def test_windows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(24 * 10)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        run_to_table(window_counts(read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and set(got.values()) == {12} and max(k[0] for k in got) < start + dt.timedelta(days=8)


def test_repeats(spark, tmp_path):
    rows = [(i % 5, dt.datetime(2024, 1, 1), 0, "a", 1.0, "{}") for i in range(20)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    run_to_table(distinct_events(read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
