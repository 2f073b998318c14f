"""Schemas as tables: lookups, validation of records of any kind, and the gate that admits them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_schema(payloads: DataFrame, schemas: DataFrame) -> DataFrame:
    """payloads (entity, label, mode, id) with the schema_id of the active schema of their label, or null."""
    active = schemas.filter("status = 'Active'").select("entity", "label", "schema_id")
    return payloads.join(active, ["entity", "label"], "left")


def validate(payloads: DataFrame, fields: DataFrame, schemas: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """entity, mode, id, schema_id, field, error: all errors of each record, not the first.

    ``fields``: entity, id, field, tag of what the records have. A required field may be missing in an update; a Float
    field takes an Int. Records without a schema have no errors, and fields that no schema names are free."""
    named = with_schema(payloads, schemas).filter("schema_id is not null").select("entity", "mode", "id", "schema_id")
    wanted = named.join(schema_fields, "schema_id")
    rows = wanted.join(fields, ["entity", "id", "field"], "left")
    missing = F.col("tag").isNull() & F.col("required") & (F.col("mode") == "create")
    wrong = (F.col("tag") != F.col("type")) & ~((F.col("type") == "Float") & (F.col("tag") == "Int"))
    error = F.when(missing, "missing required field").when(wrong, F.concat(F.lit("expected "), F.col("type"), F.lit(", is "), F.col("tag")))
    return rows.withColumn("error", error).filter("error is not null").select("entity", "mode", "id", "schema_id", "field", "error")


def gate(payloads: DataFrame, errors: DataFrame, schemas: DataFrame, mode: str, unknown: str) -> DataFrame:
    """entity, id, verdict (accepted, or why not) under a mode (Off, Permissive, Strict) and a policy for records
    without a schema (Allow, Reject). Permissive reports what it would reject, but admits it."""
    rows = with_schema(payloads, schemas).select("entity", "id", "schema_id")
    if mode == "Off":
        return rows.select("entity", "id", F.lit("accepted").alias("verdict"))
    bad = errors.select("entity", "id", F.lit(True).alias("bad")).distinct()
    unknown_bad = F.lit(unknown == "Reject") & F.col("schema_id").isNull()
    why = F.when(unknown_bad, "no schema").when(F.col("bad"), "invalid")
    told = why if mode == "Strict" else F.concat(F.lit("would reject: "), why)
    return rows.join(bad, ["entity", "id"], "left").select("entity", "id", F.coalesce(told, F.lit("accepted")).alias("verdict"))
