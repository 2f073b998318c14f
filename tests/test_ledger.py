"""The ledger in several blocks, against a plain loop."""

import hashlib

from pyspark.sql import functions as F

from evloom.operators import ledger as L


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def test_blocks(spark):
    rows = [(i, i * 10, i * 10 + 9, 10, f"k{i}", i * i) for i in range(1, 24)]
    batches = spark.createDataFrame(rows, "sequence long, first_seq long, last_seq long, n_events long, idempotency_key string, material long").repartition(3)
    content = {r[0]: sha("|".join(map(str, r))) for r in rows}
    want, anchor = {}, ""
    for start in range(1, 24, 5):
        inside = range(start, min(24, start + 5))
        at = anchor
        for i in inside:
            want[i] = (at, sha(at, content[i]))
            at = want[i][1]
        anchor = sha(anchor, sha(*(content[i] for i in inside)))
    commits = batches.join(L.commit(batches, 5), "sequence")
    assert {r["sequence"]: (r["previous_hash"], r["commit_hash"]) for r in commits.collect()} == want
    assert L.verify(commits, 5).count() == 0
    bad = commits.withColumn("previous_hash", F.when(F.col("sequence") == 9, "x").otherwise(F.col("previous_hash")))
    assert [tuple(r) for r in L.verify(bad, 5).collect()] == [(9, "previous_hash")]
    assert ("sequence", 13) in {(r["error"], r["sequence"]) for r in L.verify(commits.filter("sequence != 12"), 5).collect()}
    assert sorted(map(tuple, L.gaps(commits.filter("sequence not in (5, 6, 7, 20)"), 5).collect())) == [(4, 3), (19, 1)]


def test_changed_contents_show_once(spark):
    """A changed batch is an error by itself; the anchors of later blocks are none. A rewritten block shows in the next one."""
    rows = [(i, i * 10, i * 10 + 9, 10, f"k{i}", i * i) for i in range(1, 24)]
    batches = spark.createDataFrame(rows, "sequence long, first_seq long, last_seq long, n_events long, idempotency_key string, material long")
    commits = batches.join(L.commit(batches, 5), "sequence")
    found = lambda rows: sorted(map(tuple, L.verify(rows, 5).collect()))
    more = F.when(F.col("sequence").isin(3, 14), F.col("n_events") + 1).otherwise(F.col("n_events"))
    assert found(commits.withColumn("n_events", more)) == [(3, "commit_hash"), (14, "commit_hash")]
    again = batches.withColumn("n_events", more)
    forged = again.join(L.commit(again, 5), "sequence").filter("sequence between 11 and 15").unionByName(commits.filter("sequence not between 11 and 15"))
    assert (16, "previous_hash") in found(forged)
    assert found(commits.filter("sequence != 9")) == [(10, "sequence")]
