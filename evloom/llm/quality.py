"""Quality classifier: supervised subword embeddings.

A text's features are hashed to ``BUCKETS`` vectors: its words, pairs of neighbouring words, runs of three bytes and an
end mark. A word that repeats the one before reads as a repeat mark. Their mean goes through a softmax layer; vectors
and layer are learned together by stochastic gradient descent in numpy, a document a step, with a falling rate.

Learning reads a bounded sample (``max_rows`` labelled documents, taken by a hash of doc_id, and ``max_bytes`` of their
bucket counts) and runs in one task, which sends the driver no more than the model. Scoring folds vectors and layer to
one number a bucket, as both are linear.

Null or empty text: only the end mark, so a score all the same. Rows with null doc_id are scored, never learned from.
A doc_id labelled more than once counts by its mean label (a tie counts as 1); texts that repeat are learned once and
scored each. No label to learn from: score 0.5. A text of any length is scored whole; no rows give no rows. All columns
but one named as the score pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .scratch import drop, keep

BUCKETS, DIM = 1 << 16, 8


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows' features (three runs: words, pairs, byte runs; then an end mark each), and their rows."""
    data, off = A.texts(column)
    h, _, row = A.words(data, off)
    count = np.diff(row)
    of_word = np.repeat(np.arange(len(count)), count)
    h = h.copy()
    again = np.flatnonzero((h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])) + 1
    h[again] = A.U(0x3C79AC492BA7B653)
    pair = A.grams(h, 2)
    in_row = A.inside(row, len(h), 2)[: len(pair)]
    n = max(0, len(data) - 2)
    wide = data.astype(A.U)
    three = A.mix((wide[:n] << A.U(16)) | (wide[1 : n + 1] << A.U(8)) | wide[2 : n + 2])
    of_byte = np.repeat(np.arange(len(count)), np.diff(off))[:n]
    whole = A.inside(off, len(data), 3)[:n]
    bucket = np.concatenate([h, pair[in_row], three[whole], np.full(len(count), 0x1C69B3F74AC4AE35, A.U)]) >> A.U(48)
    return bucket.astype(np.uint16), np.concatenate([of_word, of_word[: len(pair)][in_row], of_byte[whole], np.arange(len(count))])


@dataclass
class Model:
    weight: np.ndarray  # of each bucket
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        bucket, row = features(column)
        total = np.bincount(row, self.weight[bucket], minlength=len(column))
        x = total / np.maximum(1, np.bincount(row, minlength=len(column))) + self.bias
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """``rows``: buckets, counts and label (0 or 1) of each document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * max(1, len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, n, y = rows[i]
            part = (n / n.sum()).astype(np.float32)[:, None]
            hidden = (vectors[at] * part).sum(axis=0)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = layer.T @ p
            layer -= step * np.outer(p, hidden)
            bias -= step * np.float32(0.1) * p
            vectors[at] -= step * np.float32(20) * part * back
            done += 1
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 64 << 20) -> Model:
    """A model from ``labels`` (doc_id, quality) of ``docs``; the caller leaves out what must not be learned.

    At most ``max_rows`` texts and ``max_bytes`` of counts are learned from, by a hash of the counts, in one task."""
    y = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded, so it may be broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.pieces(batches):
            bucket, row = features(batch.column("text"))
            key, n = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            at = np.searchsorted(key, np.arange(batch.num_rows + 1) * BUCKETS)
            cells = [((key[s:e] % BUCKETS).astype(np.uint16).tobytes(), n[s:e].astype(np.float32).tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary()), batch.column("y")], names=["at", "n", "y"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("y", "ascending")])
        rows = [(np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(n.as_buffer(), np.float32), y.as_py()) for a, n, y in zip(*(table.column(c) for c in ("at", "n", "y")), strict=True)]
        model = train(rows)
        return pa.table({"weight": pa.array([model.weight.tobytes()], pa.binary()), "bias": pa.array([model.bias])})

    # A text that repeats counts once, so that the bound holds however often it does.
    found = keep(sample.mapInArrow(count, "at binary, n binary, y int").withColumn("h", F.xxhash64("at", "n")).dropDuplicates(["h", "y"]), "label_counts")
    sizes = found.select("h", "y", (F.octet_length("at") + F.octet_length("n")).alias("b")).orderBy("h", "y").limit(max_rows).collect()
    fits = [r for r, total in zip(sizes, np.cumsum([r["b"] for r in sizes]), strict=True) if total <= max_bytes] or sizes[:1]
    if not fits:
        return Model(np.zeros(BUCKETS), 0.0)
    last = fits[-1]
    within = (F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("y") <= last["y"])
    row = found.filter(within).groupBy(F.lit(0).alias("g")).applyInArrow(fit, "weight binary, bias double").first()
    drop(found)
    return Model(np.frombuffer(bytes(row["weight"])), row["bias"])


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of ``docs`` (which has text) and the score, which replaces a column of its name."""
    kept = [c for c in docs.columns if c != into]
    schema = docs.select(*kept).withColumn(into, F.lit(0.0)).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.pieces(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column("text")))], names=[*kept, into])

    return docs.select(*kept).mapInArrow(add, schema)
