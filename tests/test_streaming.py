"""Streams against the same numbers worked out in one go."""

import datetime

from evloom import streaming as S

BEGIN = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp_ntz, kind string"


def folder(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame([(k, BEGIN + datetime.timedelta(seconds=s), kind) for k, s, kind in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    return f"{tmp_path}/in/*"


def test_rates(spark, tmp_path):
    path = folder(spark, tmp_path, [[(1, 0, "a"), (2, 59, "a"), (3, 60, "b")], [(4, 61, "b"), (5, 200, "a")]])
    stream = S.rates(S.event_stream(spark, path, SCHEMA))
    found = S.drain(stream, f"{tmp_path}/out", "complete").collect()
    start = int(BEGIN.replace(tzinfo=datetime.UTC).timestamp())
    assert sorted((r["start"] - start, r["n"]) for r in found) == [(0, 2), (60, 2), (180, 1)]


def test_once(spark, tmp_path):
    path = folder(spark, tmp_path, [[(1, 0, "a"), (1, 5, "a"), (2, 6, "b")], [(2, 8, "b"), (3, 9, "c")]])
    found = S.drain(S.once(S.event_stream(spark, path, SCHEMA), "id"), f"{tmp_path}/out").collect()
    assert sorted(r["id"] for r in found) == [1, 2, 3]


def test_sessions(spark, tmp_path):
    path = folder(spark, tmp_path, [[(1, 0, "a"), (1, 20, "a"), (1, 100, "a")]])
    found = S.drain(S.user_sessions(S.event_stream(spark, path, SCHEMA), "id", "30 seconds"), f"{tmp_path}/out", "complete").collect()
    assert sorted(r["n"] for r in found) == [1, 2]


def test_late_events_go(spark, tmp_path):
    """An event older than the watermark is left out of the windows that are still open."""
    spark.createDataFrame([(1, BEGIN + datetime.timedelta(hours=9), "a")], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = lambda: S.rates(S.event_stream(spark, f"{tmp_path}/in", SCHEMA), late="1 minute")
    S.drain(stream(), f"{tmp_path}/out", "append", f"{tmp_path}/state")
    spark.createDataFrame([(2, BEGIN, "a"), (3, BEGIN + datetime.timedelta(hours=12), "a")], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    S.drain(stream(), f"{tmp_path}/out", "append", f"{tmp_path}/state")
    spark.createDataFrame([(4, BEGIN + datetime.timedelta(hours=15), "a")], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    found = S.drain(stream(), f"{tmp_path}/out", "append", f"{tmp_path}/state").collect()
    start = int(BEGIN.replace(tzinfo=datetime.UTC).timestamp())
    assert start not in {r["start"] for r in found} and start + 9 * 3600 in {r["start"] for r in found}
