"""Commit logs and event files as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "sequence long, previous_hash string, commit_hash string, idempotency_key string, n_events long, committed_at timestamp_ntz"


def read_commits(spark: SparkSession, path: str, schema: str = COMMIT) -> DataFrame:
    """A commit log, a batch a line; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_commits(batches: DataFrame, path: str) -> None:
    batches.write.mode("append").json(path)


def write_events(events: DataFrame, path: str) -> None:
    """An event file for each tenant."""
    events.write.mode("append").partitionBy("tenant_id").json(path)


def read_events(spark: SparkSession, path: str, schema: str, tenant: str | None = None, after: int | None = None, cascade: int | None = None) -> DataFrame:
    """A tenant's events (the folder is pruned), optionally after an event id or of one cascade."""
    rows = spark.read.schema(f"{schema}, tenant_id string").json(path)
    for column, value, test in (("tenant_id", tenant, "="), ("seq", after, ">"), ("cascade_id", cascade, "=")):
        if value is not None:
            rows = rows.filter(F.expr(f"{column} {test} {value!r}"))
    return rows


def tenants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).select("tenant_id").distinct()
