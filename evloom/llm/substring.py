"""Word-window dedup by compacting a de Bruijn graph.

Each word goes that is covered by a window of ``width`` words whose word sequence also starts in a document of smaller
doc_id. Windows are judged on the input.

A window is an edge of the graph from its first ``width - 1`` words to its last. Windows that share a minimiser come in
runs (``superkmers``). A run of the content of an earlier document's run is named by the place there, and neighbouring
runs of neighbouring places are one piece of the graph (of pieces that overlap those that cover the words go on, so words that
alternate, whose runs all have one place, don't give a piece for every other word); the other runs of a shared minimiser are compared edge by edge
in shards, which compact neighbouring repeated edges of one earliest source into pieces. Spark joins then glue pieces, at nodes with one way in and one way out, into
long paths. A path's occurrences are spans, and each span is verified: the digest of its words must be that of the words
at its coordinates in the source. The words of verified spans go, and no others.

Null text: no words. Null doc_id: after all others, and rows of null doc_id count as one document. Rows that repeat a
document get the same result; of rows of one doc_id with different texts (ties) none counts as earlier. A text of any
length is cut in runs of windows. No rows give no rows. Columns of any name pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from . import superkmers as S
from .scratch import drop, keep

#: A piece: where it occurs (null in rows that only describe a source's piece), its windows, its first and last node, the
#: word that leads into the last and the word that leads out of the first, its source (null in rows of single edges of
#: a split minimiser, whose source is found later by ``edge``).
PIECE = "did long, th long, s int, n int, head long, tail long, last long, next long, src long, src_th long, src_s int, edge long"
_PIECE = pa.schema([(c, pa.int32() if t == "int" else pa.int64()) for c, t in (x.split() for x in PIECE.split(", "))])


def word_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, _, row = A.words(*A.texts(column))
    return h, row


def _rows(columns: dict[str, np.ndarray]) -> pa.Table:
    n = len(columns["n"])
    return pa.table([pa.array(columns[f.name].astype(f.type.to_pandas_dtype(), copy=False)) if f.name in columns else pa.nulls(n, f.type) for f in _PIECE], schema=_PIECE)


def _ends(sym: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Nodes and neighbouring words of pieces of ``n`` windows that start at the symbols ``at``."""
    node = A.grams(sym, width - 1)
    return {"head": node[at], "tail": node[at + n], "last": sym[at + n - 1], "next": sym[at + width - 1]}


def _shard(table: pa.Table, width: int) -> pa.Table:
    """The pieces of one shard: of sources' pieces (``sub`` -1) their ends; of the others the repeated edges, compacted, a
    row for each occurrence with its earliest source here. Edges of a split minimiser that have none here may have one
    in another shard and go on singly."""
    short = pc.less(table.column("sub"), 0)
    ends = table.filter(short)
    data = A.texts(ends.column("body"))[0]
    four = dict(zip(("head", "tail", "last", "next"), (data.view(A.U) if len(data) else np.zeros(0, A.U)).reshape(-1, 4).T, strict=True))
    out = [_rows({**{c: A.longs(ends.column(x)) for c, x in (("src", "did"), ("src_th", "th"), ("src_s", "s"), ("n", "n"))}, **four})]
    table = table.filter(pc.invert(short))
    data, off = A.texts(table.column("body"))
    sym, off = data.view(A.U) if len(data) else np.zeros(0, A.U), off[:-1] // 8
    did, th, s, n, a = (A.longs(table.column(c)) for c in ("did", "th", "s", "n", "a"))
    hot = table.column("hot").to_numpy()
    if not len(n):
        return out[0]
    edges = A.grams(sym, width)
    run = np.repeat(np.arange(len(n)), n)
    t = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    edge, bucket = edges[off[run] + t], a[run]
    order = np.lexsort((s[run] + t, th[run], did[run], edge, bucket))
    e, b, r, t = edge[order], bucket[order], run[order], t[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    src, src_th, src_s = did[r[head]], th[r[head]], s[r[head]] + t[head]
    later = did[r] > src
    i = np.flatnonzero(~later & hot[r])
    out.append(_rows({"did": did[r[i]], "th": th[r[i]], "s": s[r[i]] + t[i], "n": np.ones(len(i), np.int64), "edge": e[i], **_ends(sym, off[r[i]] + t[i], np.ones(len(i), np.int64), width)}))
    order = np.lexsort((t, r))
    order = order[later[order]]
    r, t, src, src_th, src_s = (x[order] for x in (r, t, src, src_th, src_s))
    new = np.ones(len(r), bool)
    new[1:] = (np.diff(r) != 0) | (np.diff(t) != 1) | (np.diff(src) != 0) | (np.diff(src_th) != 0) | (np.diff(src_s) != 1)
    first = np.flatnonzero(new)
    m = np.diff(np.append(first, len(r)))
    r, t = r[first], t[first]
    out.append(_rows({"did": did[r], "th": th[r], "s": s[r] + t, "src": src[first], "src_th": src_th[first], "src_s": src_s[first], "n": m, **_ends(sym, off[r] + t, m, width)}))
    return pa.concat_tables(out)


def compact(pieces: DataFrame) -> DataFrame:
    """The pieces (one row for each different one) with ``path``, the number of the nonbranching path each is in."""
    each = pieces.groupBy("src", "src_th", "src_s", "n").agg(*(F.first(c).alias(c) for c in ("head", "tail", "last", "next")))
    one_in = each.groupBy(F.col("tail").alias("node")).agg((F.min("last") == F.max("last")).alias("one_in"))
    one_out = each.groupBy(F.col("head").alias("node")).agg((F.min("next") == F.max("next")).alias("one_out"))
    plain = one_in.join(one_out, "node").filter("one_in and one_out").select(F.col("node").alias("head"))
    each = each.join(plain.withColumn("glued", F.lit(True)), "head", "left")
    along = Window.partitionBy("src", "src_th").orderBy("src_s", "n")
    before = F.lag(F.col("src_s") + F.col("n")).over(along)
    each = each.withColumn("breaks", F.when(F.col("glued") & (before == F.col("src_s")), 0).otherwise(1))
    each = each.withColumn("path", F.sum("breaks").over(along))
    return each.select("src", "src_th", "src_s", "n", "path")


def _copies(settled: DataFrame) -> DataFrame:
    """Settled runs, neighbours with neighbouring places in one source as one."""
    one = Window.partitionBy("did", "th", "src", "src_th", "shift").orderBy("s")
    reached = F.max(F.col("s") + F.col("n")).over(one.rowsBetween(Window.unboundedPreceding, -1))
    runs = settled.withColumn("shift", F.col("s") - F.col("src_s")).withColumn("new", F.when(F.col("s") <= reached, 0).otherwise(1))
    runs = runs.withColumn("island", F.sum("new").over(one)).groupBy("did", "th", "src", "src_th", "shift", "island")
    runs = runs.agg(F.min("s").alias("s"), F.max(F.col("s") + F.col("n")).alias("to"))
    return runs.select("did", "th", "s", (F.col("to") - F.col("s")).alias("n"), "src", "src_th", (F.col("s") - F.col("shift")).alias("src_s"))


def _needed(copies: DataFrame, width: int) -> DataFrame:
    """Of the copies that begin in the same ``width`` words of a document the first and the one that reaches furthest. Each
    has ``width`` words at least, so these two meet and cover the words of all between them."""
    cell, reach = Window.partitionBy("did", "th", F.floor(F.col("s") / width)), F.col("s") + F.col("n")
    both = copies.select("*", F.min("s").over(cell).alias("least"), F.max(reach).over(cell).alias("most"))
    return both.filter((F.col("s") == F.col("least")) | (reach == F.col("most"))).drop("least", "most")


def _sourced(edges: DataFrame) -> DataFrame:
    """Single edges of split minimisers, those that are first in a shard, with their earliest source; those that have none
    go."""
    first = edges.groupBy("edge").agg(F.min(F.struct("did", "th", "s")).alias("first"))
    both = edges.drop("src", "src_th", "src_s").join(first, "edge").filter("did > first.did")
    return both.select("*", F.col("first.did").alias("src"), F.col("first.th").alias("src_th"), F.col("first.s").alias("src_s"))


def _digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """src, src_th, src_s, size of ``spans`` with ``digest``, that of the ``size`` words at these coordinates."""
    wanted = spans.select("src", "src_th", "src_s", "size").distinct().groupBy(F.col("src").alias("did"), F.col("src_th").alias("th")).agg(F.collect_list(F.struct("src_s", "size")).alias("spans"))
    both = docs.select("did", "th", "text").join(wanted.hint("shuffle_hash"), ["did", "th"]).dropDuplicates(["did", "th"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.pieces(batches):
            data, off = A.texts(batch.column("text"))
            out = []
            for i, (did, th, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("did", "th", "spans")), strict=True)):
                words = data[off[i] : off[i + 1]].tobytes().split()
                out += [(did, th, x["src_s"], x["size"], _digest(words, x["src_s"], x["src_s"] + x["size"])) for x in spans]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["src", "src_th", "src_s", "size", "digest"])

    return both.mapInArrow(read, "src long, src_th long, src_s int, size int, digest binary")


def _digest(words: list[bytes], s: int, e: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[s:e]), digest_size=16).digest()


def repeated_spans(docs: DataFrame, width: int = 13) -> DataFrame:
    """did, th, s, e, src, src_th, src_s, size, digest: word ranges of documents (``keyed``), each an occurrence of a path
    (or a part of one), with its place in an earlier document and the digest of the words there."""
    runs = keep(S.repeated_runs(docs, word_symbols, width, 6, True), "word_runs")
    settled, candidates = keep(_needed(_copies(runs.filter("settled")), width), "copies"), runs.filter("not settled")
    sources = settled.select("src", "src_th", "src_s", "n").distinct()
    sources = sources.select(F.col("src").alias("did"), F.col("src_th").alias("th"), F.col("src_s").alias("s"), "n", F.xxhash64("src", "src_th", "src_s").alias("a"), F.lit(False).alias("hot"), F.lit(-1).alias("sub"))
    wanted = candidates.select("did", "th", "s", "n", "a", "hot", "sub").unionByName(sources)
    shards = max(1, math.ceil(wanted.count() / S.SHARD))

    def cut(column: pa.Array, row: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[bytes]:
        sym, off = word_symbols(column)
        at = off[row] + s
        whole = sym.tobytes()
        return [whole[8 * x : 8 * y] for x, y in zip(at.tolist(), (at + n + width - 1).tolist(), strict=True)]

    def ends(column: pa.Array, row: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[bytes]:
        sym, off = word_symbols(column)
        return [x.tobytes() for x in np.stack(list(_ends(sym, off[row] + s, n, width).values()), axis=1)] if len(row) else []

    # The runs of a split minimiser go to as many shards as it has parts; each one's first edges meet in ``_sourced``.
    shard = F.pmod(F.xxhash64("a", F.when(F.col("hot"), F.col("sub")).otherwise(0)), F.lit(shards))
    pieces = keep(S.contents(docs, wanted, cut, ends).withColumn("shard", shard).groupBy("shard").applyInArrow(lambda t: _shard(t, width), PIECE), "pieces")
    found = pieces.filter("src is not null").drop("edge").unionByName(_sourced(pieces.filter("edge is not null")).drop("first", "edge"))
    keys = ["src", "src_th", "src_s", "n"]
    occurs = settled.select("did", "th", "s", *keys).unionByName(found.filter("did is not null").select("did", "th", "s", *keys))
    placed = occurs.join(compact(found), keys).withColumn("shift", F.col("s") - F.col("src_s"))
    spans = placed.groupBy("did", "th", "src", "src_th", "path", "shift").agg(F.min("s").alias("s"), F.max(F.col("s") + F.col("n")).alias("last"), F.collect_list(F.struct("s", "n")).alias("parts"))
    # A path's occurrence is one span if its parts cover it without a gap; else each part stands for itself.
    covered = F.aggregate(F.sort_array("parts"), F.struct(F.col("s").alias("to"), F.lit(True).alias("ok")), lambda x, p: F.struct(F.greatest(x["to"], p["s"] + p["n"]).alias("to"), (x["ok"] & (p["s"] <= x["to"])).alias("ok")))["ok"]
    spans = spans.withColumn("each", F.explode(F.when(covered, F.array(F.struct("s", (F.col("last") - F.col("s")).alias("n")))).otherwise(F.col("parts"))))
    spans = spans.select("did", "th", F.col("each.s").alias("s"), "src", "src_th", (F.col("each.s") - F.col("shift")).alias("src_s"), (F.col("each.n") + F.lit(width - 1)).alias("size"))
    spans = keep(spans, "spans")
    for done in (runs, settled, pieces):
        drop(done)
    return spans.join(_digests(docs, spans), ["src", "src_th", "src_s", "size"]).withColumn("e", F.col("s") + F.col("size"))


def dedup_windows(docs: DataFrame, width: int = 13, into: str = "dedup") -> DataFrame:
    """All columns of ``docs``, text with the kept words joined by one space (unchanged where no word goes), and
    ``into``, which replaces a column of its name: n_words, n_removed, kept_sha256 (of the kept words joined by one
    space) and spans, the removed word ranges.

    Of the spans of ``repeated_spans`` those go whose words have the digest of the words in the source."""
    keyed = S.keyed(docs)
    order = [c for c in docs.columns if c != into]
    rest = F.struct(*(c for c in order if c != "text")).alias("row")
    whole = docs.select(rest, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("did"), F.xxhash64("text").alias("th"), "text")
    kind = "struct<n_words:bigint,n_removed:bigint,kept_sha256:string,spans:array<struct<s:int,e:int>>>"
    schema = whole.select("row", "text", F.lit(None).cast(kind).alias("dedup")).schema
    detail = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.pieces(batches):
            texts, details = [], []
            data, off = A.texts(batch.column("text"))
            for i, marks in enumerate(batch.column("marks")):
                body = data[off[i] : off[i + 1]].tobytes()
                words = body.split()
                spans = S.merged([(x["s"], x["e"]) for x in marks.as_py() or () if _digest(words, x["s"], x["e"]) == x["digest"]])
                kept, at = [], 0
                for s, e in spans:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                left = b" ".join(kept)
                texts.append((left if spans else body).decode() if batch.column("text")[i].is_valid else None)
                details.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(left).hexdigest(), "spans": [{"s": s, "e": e} for s, e in spans]})
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(details, detail)], names=["row", "text", "dedup"])

    marked = S.with_marks(whole, repeated_spans(keyed, width), "digest")
    out = marked.select("row", "text", "marks").mapInArrow(remove, schema)
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in order), F.col("dedup").alias(into))
