"""Language identification with bit-sliced Bloom filters.

All languages' filters share their positions: slot i of the table holds one bit for each language, so that the "and"
of an n-gram's slots gives every language that contains it at once. A text's n-grams are counted per language by those
bits, each count is corrected for its filter's share of false positives, and the largest wins.

N-grams are runs of ``GRAM`` bytes of the text with A-Z lower-cased. A language's filter holds those seen twice or
more in its sample whose share there is at least a quarter of the largest share in any language. The sample is bounded
by ``per_lang`` documents a language, taken by a hash of doc_id; nothing else is sampled.

Null text, or a text without a letter: ``und``, score 0. A text none of whose n-grams is known: the language with the
most learned documents, score 1 / languages. Rows with null lang or doc_id are not learned from. No language to learn:
``und`` for all. Ties go to the language with more documents, then by name. Repeated rows are learned as often as they are
there, and predicted each. A text of any length is counted whole; no rows give no rows. Other columns are left behind.
N-grams seen once in a language's sample are left out of its filter: a parameter of the index, not of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

GRAM, HASHES = 4, 3


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, their positions' validity, and row starts."""
    data, off = A.texts(column)
    low = A.LOWER[data].astype(A.U)
    n = max(0, len(low) - GRAM + 1)
    x = np.zeros(n, A.U)
    for i in range(GRAM):
        x = (x << A.U(8)) | low[i : n + i]
    return A.mix(x), A.inside(off, len(low), GRAM)[:n], off


@dataclass
class Filters:
    langs: list[str]
    table: np.ndarray  # words x slots: a bit for each language
    false: np.ndarray  # each language's share of n-grams that its filter holds by chance

    @classmethod
    def build(cls, langs: list[str], lang: np.ndarray, gram: np.ndarray) -> Filters:
        most = max(1, int(np.bincount(lang, minlength=1).max(initial=0)))
        slots = 1 << max(10, (most * 16 - 1).bit_length())
        table = np.zeros((max(1, (len(langs) + 63) // 64), slots), A.U)
        for at in cls.slots(gram, slots):
            np.bitwise_or.at(table, (lang >> 6, at), A.U(1) << (lang & 63).astype(A.U))
        fill = np.array([((table[i >> 6] >> A.U(i & 63)) & A.U(1)).mean() for i in range(len(langs))])
        small = next((t for t in (np.uint8, np.uint16, np.uint32) if len(langs) <= 8 * t().itemsize), A.U)
        return cls(langs, table.astype(small), fill**HASHES)

    @staticmethod
    def slots(gram: np.ndarray, slots: int) -> list[np.ndarray]:
        shift = slots.bit_length() - 1
        return [((gram >> A.U(i * 20 % 44)) ^ (gram >> A.U(63 - shift - i))).astype(np.int64) & (slots - 1) for i in range(HASHES)]

    def counts(self, gram: np.ndarray, valid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (rows x languages) and n-grams of each row."""
        at = self.slots(gram, self.table.shape[1])
        ends = np.minimum(off, len(gram))
        n = A.row_sums(valid, ends)
        out = np.zeros((len(off) - 1, len(self.langs)))
        for w in range(len(self.table)):
            mask = self.table[w][at[0]]
            for x in at[1:]:
                mask &= self.table[w][x]
            mask[~valid] = 0
            for i in range(64 * w, min(len(self.langs), 64 * w + 64)):
                out[:, i] = A.row_sums((mask >> mask.dtype.type(i & 63)) & mask.dtype.type(1), ends)
        return np.maximum(0, (out - n[:, None] * self.false) / np.maximum(1e-9, 1 - self.false)), n


def learn(rows: DataFrame, per_lang: int = 1500) -> Filters:
    """Filters from ``rows`` (doc_id, text, lang), of which a bounded sample is read."""
    rows = rows.filter("doc_id is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(size, key=lambda x: (-size[x], x))
    if not langs:
        return Filters.build([], np.zeros(0, np.int64), np.zeros(0, A.U))
    spark = rows.sparkSession
    share = spark.createDataFrame([(x, i, min(1.0, per_lang / size[x])) for i, x in enumerate(langs)], "lang string, k int, share double")
    sample = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.pieces(batches):
            gram, valid, off = _grams(batch.column("text"))
            k = np.repeat(batch.column("k").to_numpy(), np.diff(off))[: len(gram)][valid]
            gram = gram[valid]
            for lang in np.unique(k):
                g, n = np.unique(gram[k == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), lang, np.int32)), pa.array(g.view(np.int64)), pa.array(n)], names=["k", "gram", "n"])

    grams = sample.select("text", "k").mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    found = grams.filter("n > 1").toArrow()
    k, gram, n = (np.asarray(found.column(c).to_numpy()) for c in ("k", "gram", "n"))
    gram = gram.view(A.U) if len(gram) else np.zeros(0, A.U)
    share_of = n / np.bincount(k, n, minlength=len(langs))[k] if len(k) else n
    names, at = np.unique(gram, return_inverse=True)
    best = np.zeros(len(names))
    np.maximum.at(best, at, share_of)
    good = share_of >= best[at] / 4
    return Filters.build(langs, k[good].astype(np.int64), gram[good])


def identify(docs: DataFrame, model: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every document, and held_out where ``docs`` has it."""
    docs = docs.select("doc_id", "held_out", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"), "text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.pieces(batches):
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            names, score = np.full(len(letters), "und", object), np.zeros(len(letters))
            if model.langs:
                counts, _ = model.counts(*_grams(batch.column("text")))
                total, best = counts.sum(axis=1), counts.argmax(axis=1)
                share = np.where(total > 0, counts[np.arange(len(best)), best] / np.maximum(total, 1e-9), 1 / len(model.langs))
                names[letters] = np.array(model.langs, object)[best[letters]]
                score[letters] = share[letters]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
