"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

The inverted index is over the items: a term's postings are the items that have it, cut in blocks that know their
largest impact. Impacts are BM25 weights divided by what the item scores against itself, so one threshold serves all.
Each passage (``2 * stride`` words, every ``stride`` words; stride is the longest item's length or more, so that an
item lies whole in some passage) is a query of its distinct terms. A passage whose terms' largest impacts don't add up
to the threshold has no WAND pivot; that is decided for all passages of a batch at once, first for the whole index,
then for the ranges of items that blocks cover. What is left goes through block-max WAND, which gives all items above
the threshold. They are verified: an item's question (its first three quarters) and answer (the rest) must overlap
the passage in shingles of five words.

Items are indexed in shards of bounded size (``items_per_shard``, ``bytes_per_shard``), each broadcast in its turn. Document
frequencies, number of items, mean and longest length are those of all items (``Corpus``), however many shards there are.

Null or empty texts of documents or items match nothing. Repeated rows count once; among passages of one score the one
of larger overlaps, then of later place, is shown. A null doc_id is reported as null. A text of any length is cut in
passages. No documents or no items give no rows. Columns of other names don't matter: ``contaminated`` leaves them
behind, ``without_leaks`` passes all through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .scratch import keep

K1, B = 1.2, 0.75
THRESHOLD = 0.5
BLOCK = 2
SLACK = 1 + 1e-9  # for sums in another order
SHINGLE = 5
OVERLAP = 0.5  # of an item's question, and of its answer, that a passage must have
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, punctuation aside, and row starts."""
    h, _, row = A.words(*A.texts(column), lower=True, breaks=BREAKS)
    return h, row


def _shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(A.grams(h, min(SHINGLE, max(1, len(h))))) if len(h) else h


@dataclass
class Corpus:
    """What a shard needs to know of all items: the frequencies of its own terms, and three figures."""

    term: np.ndarray  # sorted hashes, all terms of the shard among them
    df: np.ndarray
    items: int
    mean: float
    longest: int


@dataclass
class Index:
    ids: list[int]
    vocab: np.ndarray  # sorted term hashes
    start: np.ndarray  # of each term's postings
    item: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # largest impact of each term
    range_start: np.ndarray  # of each term's ranges of BLOCK items
    range_at: np.ndarray
    range_most: np.ndarray  # largest impact there
    question: list[np.ndarray]
    answer: list[np.ndarray]
    words: list[int]
    longest: int

    @classmethod
    def build(cls, ids: list[int], column: pa.Array, corpus: Corpus | None = None) -> Index:
        """Of items that are all there are, or a shard of ``corpus``."""
        h, row = terms(column)
        n = np.diff(row)
        order = np.argsort(n, kind="stable")  # neighbours of like length bound each other well
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        vocab, t = np.unique(h, return_inverse=True)
        pair, tf = np.unique(t * max(1, len(n)) + np.repeat(place, n), return_counts=True)
        t, item = pair // max(1, len(n)), pair % max(1, len(n))
        if corpus is None:
            corpus = Corpus(vocab, np.bincount(t, minlength=len(vocab)), len(n), n.mean() if len(n) else 1.0, int(n.max(initial=1)))
        df = corpus.df[np.searchsorted(corpus.term, vocab)]
        length = n[order]
        idf = np.log(1 + (corpus.items - df + 0.5) / (df + 0.5))
        impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(1.0, corpus.mean)))
        impact /= np.bincount(item, impact, minlength=len(n))[item]
        most = np.zeros(len(vocab))
        np.maximum.at(most, t, impact)
        blocks = max(1, -(-len(n) // BLOCK))
        key = t * blocks + item // BLOCK  # ascending, as the postings are
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        range_most = np.maximum.reduceat(impact, first) if len(key) else impact
        range_start = np.searchsorted(key[first] // blocks, np.arange(len(vocab) + 1))
        cuts = [(row[i], row[i] + n[i] * 3 // 4, row[i + 1]) for i in order]
        return cls([ids[i] for i in order], vocab, np.searchsorted(t, np.arange(len(vocab) + 1)), item, impact, most, range_start, key[first] % blocks, range_most, [_shingles(h[a:b]) for a, b, _ in cuts], [_shingles(h[b:c]) for _, b, c in cuts], length.tolist(), corpus.longest)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of hashes, -1 for terms of no item."""
        if not len(self.vocab):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at, -1)

    def range_bound(self, term: int, block: int) -> float:
        s, e = self.range_start[term], self.range_start[term + 1]
        at = s + int(np.searchsorted(self.range_at[s:e], block))
        return float(self.range_most[at]) if at < e and self.range_at[at] == block else 0.0

    def range_bounds(self, terms: np.ndarray) -> float:
        """The largest sum of the terms' bounds in any range."""
        s, n = self.range_start[terms], self.range_start[terms + 1] - self.range_start[terms]
        at = np.repeat(s - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return float(np.bincount(self.range_at[at], self.range_most[at]).max(initial=0.0))

    def search(self, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items that score ``threshold`` or more against the terms ``query``."""
        lists = [[int(self.item[self.start[t]]), int(self.start[t]), int(self.start[t + 1]), float(self.most[t]), int(t)] for t in query]
        out = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[3]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            target = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            block = target // BLOCK
            if sum(self.range_bound(x[4], block) for x in lists[: pivot + 1]) * SLACK >= threshold:
                if lists[0][0] == target:
                    score = sum(float(self.impact[x[1]]) for x in lists[: pivot + 1])
                    if score >= threshold:
                        out.append((target, score))
                    move, to = lists[: pivot + 1], target + 1
                else:
                    move, to = [x for x in lists[:pivot] if x[0] < target], target
            else:  # nothing in this block, up to where another list starts
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                move, to = lists[: pivot + 1], max(to, target + 1)
            for x in move:
                x[1] = x[1] + int(np.searchsorted(self.item[x[1] : x[2]], to))
                x[0] = int(self.item[x[1]]) if x[1] < x[2] else -1
            lists = [x for x in lists if x[0] >= 0]
        return out

    def passages(self, h: np.ndarray, row: np.ndarray, stride: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Document, first and last word and distinct known terms of each passage that may reach the threshold."""
        t = self.lookup(h)
        known = np.flatnonzero(t >= 0)
        of = np.searchsorted(row, known, "right") - 1
        part = (known - row[of]) // stride
        n = np.diff(row)
        count = np.maximum(1, -(-n // stride) - 1)  # passages of a document: parts i and i + 1 make passage i
        base = np.append(0, np.cumsum(count))
        here, before = part < count[of], part > 0
        passage = np.concatenate([base[of[here]] + part[here], base[of[before]] + part[before] - 1])
        wide = max(1, len(self.vocab))
        key = np.sort(passage * wide + np.concatenate([t[known[here]], t[known[before]]]))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        passage, t = key // wide, key % wide
        first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(key) else key
        if not len(first):
            return
        total = np.add.reduceat(self.most[t], first)
        last = np.append(first[1:], len(key))
        for i in np.flatnonzero(total >= THRESHOLD).tolist():
            mine = t[first[i] : last[i]]
            if self.range_bounds(mine) * SLACK >= THRESHOLD:
                p = int(passage[first[i]])
                d = int(np.searchsorted(base, p, "right")) - 1
                s = int(row[d]) + (p - int(base[d])) * stride
                yield d, s, min(s + 2 * stride, int(row[d + 1])), mine


def overlap(part: np.ndarray, h: np.ndarray, words: int) -> float:
    """Share of a part's shingles that the words h have."""
    if not len(part):
        return 1.0
    return float(np.isin(part, A.grams(h, min(SHINGLE, max(1, words)))).mean())


def leaks(column: pa.Array, index: Index) -> Iterator[tuple[int, int, float, float, float, int]]:
    """Row, item, score, overlaps and first word of each verified passage."""
    stride = max(32, index.longest)
    h, row = terms(column)
    for d, s, e, query in index.passages(h, row, stride):
        for item, score in index.search(query, THRESHOLD):
            words = index.words[item]
            q = overlap(index.question[item], h[s:e], words * 3 // 4)
            a = overlap(index.answer[item], h[s:e], words - words * 3 // 4)
            if q >= OVERLAP and a >= OVERLAP:
                yield d, index.ids[item], score, q, a, s - int(row[d])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item, and under no term its number of words."""
    for batch in A.pieces(batches):
        h, row = terms(batch.column("text"))
        n = np.diff(row)
        for i in range(batch.num_rows):
            t = np.unique(h[row[i] : row[i + 1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(t, 0), mask=np.append(np.zeros(len(t), bool), True)), pa.array(np.append(np.zeros(len(t), np.int64), n[i])), pa.array(np.full(len(t) + 1, batch.column("shard")[i].as_py(), np.int32))], names=["term", "words", "shard"])


def indexes(benchmark: DataFrame, items_per_shard: int = 2000, bytes_per_shard: int = 16 << 20) -> Iterator[Index]:
    """The index of each shard of the items (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).filter("text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    shards = max(1, math.ceil(size["n"] / items_per_shard), math.ceil(size["b"] / bytes_per_shard))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    if shards > 1:
        counts = keep(items.dropDuplicates().mapInArrow(_terms, "term long, words long, shard int").groupBy("term", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.max("words").alias("longest")), "term_counts")
        every = counts.filter("term is null").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")).first()
        df = keep(counts.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")), "term_df")
    for shard in range(shards):
        part = items.filter(F.col("shard") == shard).drop("shard").dropDuplicates().orderBy("item_id", "text").toArrow()
        corpus = None
        if shards > 1:
            known = df.join(counts.filter(F.col("shard") == shard).select("term"), "term").toArrow()
            term, n = A.longs(known.column("term")).view(A.U), A.longs(known.column("df"))
            order = np.argsort(term)
            corpus = Corpus(term[order], n[order], every["n"], every["words"] / every["n"], max(1, every["longest"]))
        yield Index.build(part.column("item_id").to_pylist(), part.column("text").combine_chunks(), corpus)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap and word (where the passage starts) of each leak."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word"]
    out = None
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in A.pieces(batches):
                rows = [(batch.column("doc_id")[d].as_py(), *x) for d, *x in leaks(batch.column("text"), shared.value)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        found = docs.mapInArrow(find, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word long")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", "word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; each row is judged by itself, so nothing is shuffled."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in A.pieces(batches):
                hit = np.zeros(batch.num_rows, bool)
                hit[[x[0] for x in leaks(batch.column("lower"), shared.value)]] = True
                yield batch.filter(pa.array(~hit)).select(["row"])

        whole = docs.select(F.struct(*docs.columns).alias("row"), F.lower("text").alias("lower"), F.col("text"))
        docs = whole.mapInArrow(clean, whole.select("row").schema).select("row.*")
    return docs
