"""Audit records of each kind of call."""

import json

from compare import difference, engine
from evloom import catalog
from evloom.sources import trail
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_every_mapping_gives_its_signal(spark):
    records = []
    for i, (source, call, _, _, *paths) in enumerate(trail.MAPPINGS):
        record = {"eventID": str(i), "eventSource": source, "eventName": call, "awsRegion": "eu-1"}
        for path in filter(None, paths):
            at = record
            *steps, last = path.removeprefix("$.").split(".")
            for step in steps:
                if step.endswith("[*]"):
                    at = at.setdefault(step[:-3], [{}, {}])
                else:
                    at = at.setdefault(step, {})
            for k, item in enumerate(at if isinstance(at, list) else [at]):
                item[last] = f"{last}-{i}-{k}"
        records.append(record)
    records.append({"eventID": "half", "eventSource": "ec2.amazonaws.com", "eventName": "AttachVolume", "requestParameters": {"instanceId": "i-1"}})
    rows = trail.parse(trail.records(spark.createDataFrame([(json.dumps({"Records": records}),)], "json string"))).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["eventID"], []).append(r)
    assert [r["outcome"] for r in by_id.pop("half")] == ["incomplete"]
    for i, (_, call, signal, kind, path, other) in enumerate(trail.MAPPINGS):
        got = by_id[str(i)]
        assert {(r["outcome"], r["signal"], r["resource_type"]) for r in got} == {("signal", signal, kind)}, call
        assert sorted(r["resource_id"] for r in got) == [f"{path.rsplit('.', 1)[1]}-{i}-{k}" for k in range(2 if "[*]" in path else 1)]
        assert {r["target"] for r in got} == ({f"volumeId-{i}-0"} if signal == "dependency" else {None})


def test_first_record_of_an_id_counts(spark):
    """By the order of the documents, then by the place in one, however the rows arrive."""
    made = lambda id_, bucket: {"eventID": id_, "eventSource": "s3.amazonaws.com", "eventName": "CreateBucket", "requestParameters": {"bucketName": bucket}}
    documents = [(2, [made("a", "late"), made("b", "first")]), (1, [made("a", "first"), made("c", "first"), made("c", "late"), made("a", "later")]), (3, [made("b", "late")])]
    for some in (documents, documents[::-1]):
        rows = spark.createDataFrame([(n, json.dumps({"Records": r})) for n, r in some], "n long, json string").repartition(3)
        got = trail.parse(trail.records(rows, order="n")).select("eventID", "resource_id").collect()
        assert sorted(map(tuple, got)) == [("a", "first"), ("b", "first"), ("c", "first")]


def test_trail_of_a_log_in_any_order(spark, tmp_path):
    """The rows are those of the SQL if events lie in files backwards, and if some are missing whose ids are repeated."""
    events = spark.read.parquet(f"{SF}/events.parquet").filter("event_id not in (30, 60, 306, 510)")
    events.orderBy(F.desc("event_id")).coalesce(1).write.parquet(f"{tmp_path}/x/events")
    (file,) = (tmp_path / "x/events").glob("*.parquet")
    file.rename(tmp_path / "events.parquet")
    sql = catalog.ORACLES["src_cloudtrail"]
    assert difference(catalog.QUERIES["src_cloudtrail"](spark, str(tmp_path)), engine(str(tmp_path)), sql) is None
