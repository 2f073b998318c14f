"""Repeated windows without a row per window: runs of windows that share a minimiser.

Every window of ``width`` symbols has a minimiser, its k-gram of least hash (the leftmost at ties), at a place that
depends on the window's content alone. Neighbouring windows with the same minimiser form a run (a super-k-mer). Equal
windows have equal minimisers, so they meet under the minimiser's hash ``a``; runs whose ``a`` is unique are dropped.
Runs of equal content (``seg``) are settled by their coordinates; the others with a shared ``a`` are candidates, whose
content is fetched and compared by the operator.

A document is known by ``did`` (doc_id; null as the largest long) and ``th`` (hash of its text), so rows that repeat a
document count as one document: its runs go on once, and its text is fetched once, however often it is there. Symbols,
runs and strings are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A

RUNS = "did long, th long, s int, n int, a long, seg long, settled boolean, src long, src_th long, src_s int"
#: Rows of one minimiser that one task of the compare step may get; the rest go to further tasks and are merged after.
SPLIT = 8192
#: Candidate runs in a task of the compare step, on average.
SHARD = 12000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, did, th, text of the documents; columns of other names are left behind."""
    text = F.col("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("did"), F.xxhash64(text).alias("th"), text)


def _runs(sym: np.ndarray, off: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, first symbol (in the row), windows, minimiser and content of each run."""
    if len(sym) < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, A.U, A.U))
    levels: dict[int, np.ndarray] = {}
    g = A.grams(sym, k, levels)
    least = A.sliding_min((g & A.U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=A.U), width - k + 1)
    at = np.flatnonzero(A.inside(off, len(sym), width)[: len(least)])
    pos = (least[at] & A.U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(pos) != 0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    s, anchor = at[first], pos[first]
    c = 1
    while c * 2 <= width:
        c *= 2
    cover, length = A.grams(sym, c, levels), n + width - 1
    last = s + length - c
    seg = A.join_hash(A.join_hash(cover[s], cover[last]), A.join_hash(cover[(s + last) // 2], (length * 4096 + anchor - s).astype(A.U)))
    row = np.searchsorted(off, s, "right") - 1
    return row, s - off[row], n, A.mix(g[anchor] ^ A.U(0x5851F42D4C957F2D)), seg


def _scan(symbols: Callable, width: int, k: int, by_document: bool) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.pieces(batches):
            sym, off = symbols(batch.column("text"))
            row, s, n, a, seg = _runs(sym, off, width, k)
            did, th = A.longs(batch.column("did"))[row], A.longs(batch.column("th"))[row]
            order = np.lexsort((s, th, did, seg, a))
            did, th, s, n, a, seg = (x[order] for x in (did, th, s, n, a, seg))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (seg[1:] != seg[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            settled = did != did[head]
            if not by_document:
                settled |= (th != th[head]) | (s != s[head])
            a = np.where(settled, A.join_hash(did.astype(A.U) + th.astype(A.U), s.astype(A.U)), a)  # spread evenly
            source = [pa.array(x[head], mask=~settled) for x in (did, th, s.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(did), pa.array(th), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(settled), *source], names=["did", "th", "s", "n", "a", "seg", "settled", "src", "src_th", "src_s"])

    return scan


def repeated_runs(docs: DataFrame, symbols: Callable, width: int, k: int, by_document: bool) -> DataFrame:
    """Runs with a shared minimiser: settled (all their windows start earlier elsewhere: from ``src_s`` on in the
    document ``src``, ``src_th``) or candidates.

    ``symbols`` gives an Arrow column's symbols and row starts. ``by_document``: only a smaller doc_id counts as
    earlier; else an earlier start in the same document does too. Runs of equal content within a task's batch are
    settled there, before anything is shuffled.
    """
    runs = docs.select("did", "th", "text").mapInArrow(_scan(symbols, width, k, by_document), RUNS)
    one, same = Window.partitionBy("a", "settled"), Window.partitionBy("a", "settled", "seg")
    in_order = one.orderBy("seg", "did", "th", "s")
    runs = runs.select("*", F.count(F.lit(1)).over(one).alias("c"), F.min("seg").over(one).alias("lo"), F.max("seg").over(one).alias("hi"))
    runs = runs.filter("settled or c > 1")
    runs = runs.withColumn("first", F.min(F.struct("did", "th", "s")).over(same)).withColumn("nth", F.row_number().over(in_order)).withColumn("before", F.lag(F.struct("seg", "did", "th", "s")).over(in_order))
    runs = runs.filter("before is null or before != struct(seg, did, th, s)")  # the runs of a document that repeats, once
    later = F.col("did") > F.col("first.did") if by_document else F.struct("did", "th", "s") != F.col("first")
    source = [F.coalesce(x, F.when(later, F.col(f"first.{y}"))).alias(x) for x, y in (("src", "did"), ("src_th", "th"), ("src_s", "s"))]
    runs = runs.select("*", (F.col("settled") | later).alias("now")).filter("now or lo != hi")
    return runs.select("did", "th", "s", "n", "a", F.col("now").alias("settled"), *source, (F.col("c") > SPLIT).alias("hot"), F.floor((F.col("nth") - 1) / SPLIT).cast("int").alias("sub"))


def contents(docs: DataFrame, candidates: DataFrame, cut: Callable, ends: Callable | None = None) -> DataFrame:
    """Candidates with their content: did, th, s, n, a, hot, sub, body. ``cut`` gives one row's pieces as bytes, ``ends``
    what is wanted of those whose ``sub`` is -1."""
    wanted = candidates.groupBy("did", "th").agg(F.collect_list(F.struct("s", "n", "a", "hot", "sub")).alias("runs"))
    both = docs.select("did", "th", "text").join(wanted.hint("shuffle_hash"), ["did", "th"]).dropDuplicates(["did", "th"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.pieces(batches):
            runs = batch.column("runs").combine_chunks() if isinstance(batch.column("runs"), pa.ChunkedArray) else batch.column("runs")
            flat, at = runs.flatten(), np.append(0, np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False)))
            cols = {k: flat.field(k) for k in ("s", "n", "a", "hot", "sub")}
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            body = cut(batch.column("text"), row, cols["s"].to_numpy(), cols["n"].to_numpy()) if ends is None else np.empty(len(row), object)
            if ends is not None:
                short = cols["sub"].to_numpy() < 0
                for get, those in ((cut, ~short), (ends, short)):
                    body[those] = get(batch.column("text"), row[those], cols["s"].to_numpy()[those], cols["n"].to_numpy()[those])
            yield pa.RecordBatch.from_arrays([pa.array(A.longs(batch.column("did"))[row]), pa.array(A.longs(batch.column("th"))[row]), cols["s"], cols["n"], cols["a"], cols["hot"], cols["sub"], pa.array(body, pa.binary())], names=["did", "th", "s", "n", "a", "hot", "sub", "body"])

    return both.mapInArrow(fetch, "did long, th long, s int, n int, a long, hot boolean, sub int, body binary")


def with_marks(docs: DataFrame, marks: DataFrame, *more: str) -> DataFrame:
    """The documents with ``marks``, an array of the marked [s, e) ranges and their columns ``more`` (null: none)."""
    by_doc = marks.groupBy("did", "th").agg(F.collect_list(F.struct("s", "e", *more)).alias("marks"))
    return docs.join(by_doc.hint("shuffle_hash"), ["did", "th"], "left")


def merged(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Marked ranges as the fewest disjoint, separate ones, ascending."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(marks):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
