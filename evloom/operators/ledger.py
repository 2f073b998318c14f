"""The commit ledger: hash chains, their verification, compaction, snapshots and recovery.

A ledger is chained in blocks of ``BLOCK`` sequences. A commit's hash covers the hash before it and its own content; the
first of a block takes the block's anchor for the hash before, which covers the contents of all blocks before. So blocks
are chained side by side, only the anchors follow each other, and each commit can be checked by itself.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import remove


def digest(*columns: str):
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def content_hashed(batches: DataFrame) -> DataFrame:
    """Batches with content_hash; the content alone can be hashed in parallel."""
    return batches.withColumn("content_hash", digest("sequence", "first_seq", "last_seq", "n_events", "idempotency_key", "material"))


BLOCK = 1024


def _sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _block(size: int):
    return F.floor((F.col("sequence") - 1) / size).cast("long")


def _digests(rows: DataFrame, block: int) -> DataFrame:
    """block, digest of the contents of each block of rows (sequence, content_hash)."""
    ordered = F.sort_array(F.collect_list(F.struct("sequence", "content_hash")))
    return rows.groupBy(_block(block).alias("block")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["content_hash"]), ""), 256).alias("digest"))


def anchors(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, anchor of each block of rows (sequence, content_hash): a fold over one digest a block."""
    digests = _digests(rows, block)

    def fold(table: pa.Table) -> pa.Table:
        table, at, out = table.sort_by("block"), "", []
        for digest in table.column("digest").to_pylist():
            out.append(at)
            at = _sha(at, digest)
        return pa.table({"block": table.column("block"), "anchor": pa.array(out, pa.string())})

    return digests.groupBy(F.lit(0).alias("all")).applyInArrow(fold, "block long, anchor string")


def commit(batches: DataFrame, block: int = BLOCK) -> DataFrame:
    """sequence, previous_hash, commit_hash. Only 64-byte hashes travel, not the events."""
    rows = content_hashed(batches).select("sequence", "content_hash")

    def chain(table: pa.Table) -> pa.Table:
        table, before, out = table.sort_by("sequence"), [], []
        at = table.column("anchor")[0].as_py()
        for content in table.column("content_hash").to_pylist():
            before.append(at)
            at = _sha(at, content)
            out.append(at)
        return pa.table({"sequence": table.column("sequence"), "previous_hash": pa.array(before, pa.string()), "commit_hash": pa.array(out, pa.string())})

    placed = rows.withColumn("block", _block(block)).join(anchors(rows, block), "block")
    return placed.groupBy("block").applyInArrow(chain, "sequence long, previous_hash string, commit_hash string")


def verify(commits: DataFrame, block: int = BLOCK) -> DataFrame:
    """sequence, error of each commit (the batch's columns, previous_hash, commit_hash) that breaks the chain. Contents are
    hashed again; the commit before is found by a join on its number, so nothing is sorted as a whole.

    A block's anchor is held against the anchor and the contents of the block before, unless a commit there fails by its
    own hash or is missing: then that one is the error, and the anchor can't be told from what is left of the contents.
    A status that isn't Committed, or an id that an earlier commit had, is an error too, where the columns are there."""
    rows = content_hashed(commits).withColumn("block", _block(block))
    before = rows.select((F.col("sequence") + 1).alias("sequence"), F.col("commit_hash").alias("hash_before"))
    first = (F.col("sequence") - 1) % block == 0
    sound = F.col("commit_hash").eqNullSafe(F.sha2(F.concat("previous_hash", "content_hash"), 256))
    whole = rows.groupBy("block").agg((F.bool_and(sound) & (F.countDistinct("sequence") == block)).alias("whole"), F.max(F.when(first, F.col("previous_hash"))).alias("own"))
    after = _digests(rows, block).join(whole, "block").select((F.col("block") + 1).alias("block"), "whole", F.sha2(F.concat("own", "digest"), 256).alias("anchor"))
    rows = rows.join(before, "sequence", "left").join(after, "block", "left")
    wrong = F.when(~first, ~F.col("previous_hash").eqNullSafe(F.col("hash_before"))).when(F.col("block") == 0, ~F.col("previous_hash").eqNullSafe(F.lit("")))
    wrong = wrong.otherwise(F.col("whole") & ~F.col("previous_hash").eqNullSafe(F.col("anchor")))
    error = F.when((F.col("sequence") != 1) & F.col("hash_before").isNull(), "sequence").when(wrong, "previous_hash").when(~sound, "commit_hash")
    if "status" in commits.columns:
        error = error.when(F.col("status") != "Committed", "status")
    if "idempotency_key" in commits.columns:
        seen = commits.groupBy("idempotency_key").agg(F.min("sequence").alias("first"))
        rows = rows.join(seen, "idempotency_key", "left")
        error = error.when(F.col("sequence") > F.col("first"), "idempotency_key")
    return rows.withColumn("error", error).filter("error is not null").select("sequence", "error")


def acceptable(arriving: DataFrame, head: tuple[int, str], known_keys: DataFrame) -> DataFrame:
    """sequence, error (null: may be applied) of batches that a replica is sent (the batch's columns, status,
    previous_hash, commit_hash), after ``head`` (sequence and hash of what it has). ``known_keys``: idempotency_key.

    The first must follow the head and each other the one before; what is wrong in one doesn't excuse the next."""
    rows = content_hashed(arriving)
    before = arriving.select((F.col("sequence") + 1).alias("sequence"), F.col("commit_hash").alias("hash_before"))
    rows = rows.join(before, "sequence", "left").withColumn("hash_before", F.when(F.col("sequence") == head[0] + 1, head[1]).otherwise(F.col("hash_before")))
    rows = rows.join(known_keys.select("idempotency_key").distinct().withColumn("known", F.lit(True)), "idempotency_key", "left")
    error = (
        F.when((F.col("sequence") <= head[0]) | F.col("hash_before").isNull(), "sequence").when(F.col("status") != "Committed", "status")
        .when(~F.col("previous_hash").eqNullSafe(F.col("hash_before")), "previous_hash").when(F.col("known"), "idempotency_key")
        .when(F.col("commit_hash") != F.sha2(F.concat("previous_hash", "content_hash"), 256), "commit_hash")
    )
    return rows.select("sequence", error.alias("error"))


def duplicates(commits: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n of values that more than one commit has."""
    parts = [commits.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(c).alias("column"), "value", "n") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def idempotent(batches: DataFrame) -> DataFrame:
    """The first batch of each idempotency key; a repeated key returns the batch it had."""
    w = Window.partitionBy("idempotency_key").orderBy("sequence")
    return batches.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def gaps(commits: DataFrame, block: int = BLOCK) -> DataFrame:
    """after, missing: where sequences are skipped in a stream of commits. Repeats are no gaps. Each block looks at its
    own neighbours; its first commit follows the last of the block before, which a fold over one row a block finds."""
    rows = commits.select("sequence").distinct().withColumn("block", _block(block))
    ends = rows.groupBy("block").agg(F.max("sequence").alias("last"))
    ends = ends.select("block", F.lag("last").over(Window.orderBy("block")).alias("last_before"))
    own = F.lag("sequence").over(Window.partitionBy("block").orderBy("sequence"))
    rows = rows.withColumn("own", own).join(ends, "block").select("sequence", F.coalesce("own", "last_before").alias("after"))
    return rows.filter(F.col("sequence") > F.col("after") + 1).select("after", (F.col("sequence") - F.col("after") - 1).alias("missing"))


def compact(spark, path: str, to: str, cutoff: int) -> tuple[int, int]:
    """Rewrites a log without the batches up to ``cutoff`` (then the caller swaps the folders); removed and retained."""
    rows = spark.read.parquet(path)
    rows.filter(F.col("sequence") > cutoff).write.mode("overwrite").parquet(to)
    n = rows.agg(F.count_if(F.col("sequence") <= cutoff).alias("removed"), F.count_if(F.col("sequence") > cutoff).alias("retained")).first()
    return n["removed"], n["retained"]


def snapshot(tables: dict[str, DataFrame], path: str, snapshot_id: str, sequence: int) -> None:
    """A folder per table and a manifest of their counts."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{snapshot_id}/{name}")
    counts = [spark.read.parquet(f"{path}/{snapshot_id}/{n}").agg(F.lit(snapshot_id).alias("snapshot_id"), F.lit(sequence).cast("long").alias("sequence"), F.lit(n).alias("collection"), F.count(F.lit(1)).alias("n")) for n in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    out.write.mode("append").parquet(f"{path}/manifest")


def snapshots(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def latest(spark, path: str) -> DataFrame:
    """The manifest rows of the snapshot of greatest sequence."""
    rows = snapshots(spark, path)
    return rows.join(rows.agg(F.max("sequence").alias("sequence")), "sequence", "left_semi")


def delete_snapshot(spark, path: str, snapshot_id: str) -> None:
    remove(spark, f"{path}/{snapshot_id}")


def recover(log: DataFrame, snapshot_rows: DataFrame | None, sequence: int) -> DataFrame:
    """The snapshot's rows and those of the log after it, in one table for the folds."""
    tail = log.filter(F.col("sequence") > sequence)
    return tail if snapshot_rows is None else snapshot_rows.unionByName(tail)


def page(rows: DataFrame, key: str, after, limit: int = 100) -> DataFrame:
    """The next ``limit`` rows (at most 500) after a cursor, in order, with ``more``: whether others follow.

    A cursor that no row has is an error."""
    limit = min(max(1, limit), 500)
    if after is not None:
        if rows.filter(F.col(key) == after).isEmpty():
            raise ValueError(f"unknown cursor: {after}")
        rows = rows.filter(F.col(key) > after)
    top = rows.orderBy(key).limit(limit + 1)
    w = Window.orderBy(key)
    return top.withColumn("nth", F.row_number().over(w)).withColumn("more", F.max("nth").over(Window.partitionBy()) > limit).filter(F.col("nth") <= limit).drop("nth")
