"""Exact substring dedup with suffix arrays.

Each byte goes that is covered by a ``width``-byte string which also starts earlier: in a document of smaller doc_id,
or earlier in the same document. Strings are judged on the input; matches never cross documents.

The corpus is sharded by content (``superkmers``): equal strings share a minimiser, so they meet in one shard. A shard
sorts the suffixes of its byte runs (Larsson and Sadakane: ranks by the first bytes, then doubling, refining only the
groups still unsorted), gets common prefixes by Kasai's rule, all runs in step, and reads equal strings off
neighbours with a common prefix of ``width`` or more. A minimiser with very many runs is split over several shards;
their sorted strings are merged by binary search.

Null text: empty. Null doc_id: after all others. Rows that repeat a document wholly count as one document and get the
same result; rows of one doc_id with different texts (ties) are ordered by the hash of their text. A text of any length
is cut in runs of windows before anything is compared. No rows give no rows. Only doc_id and text are read, so columns
of other names, whatever they are, don't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import superkmers as S
from .scratch import keep

#: The strings of a minimiser that is split over shards are merged in so many parts, by their hash.
PART_BITS = 10
FIRST = 7  # bytes in the first sort key, 9 bits each: 0 is the end of a run


def suffix_array(sym: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Positions with a symbol, sorted by their first ``depth`` symbols, ties by position. ``sym``: 0 after each run, else byte + 1;
    ``end``: of each position, where its run ends."""
    n = len(sym)
    key = np.zeros(n, np.int64)
    for i in range(FIRST):
        key[: n - i] |= sym[i:].astype(np.int64) << (9 * (FIRST - 1 - i))
    for i in range(1, FIRST):  # symbols after the run's end don't count
        past = np.flatnonzero((sym > 0) & (end - np.arange(n) == i))
        key[past] &= ~((1 << (9 * (FIRST - i))) - 1)
    sa = np.flatnonzero(sym)
    sa = sa[np.argsort(key[sa], kind="stable")]
    rank = np.zeros(n, np.int64)

    def renew(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes in these slots from their sorted keys; the slots of groups that stay unsorted."""
        new = np.ones(len(slots), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank[sa[slots]] = slots[head] + 1
        return slots[~(new & np.append(new[1:], True))]

    slots, h = renew(np.arange(len(sa)), key[sa]), FIRST
    while h < depth and len(slots):
        p = sa[slots]
        ahead = np.where(p + h < end[p], rank[np.minimum(p + h, n - 1)], 0)
        pair = (rank[p] << 32) | ahead
        order = np.argsort(pair, kind="stable")
        sa[slots] = p[order]
        slots, h = renew(slots, pair[order]), 2 * h
    return sa


def common_prefixes(sym: np.ndarray, end: np.ndarray, sa: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Of the first ``counts`` positions of each run: the prefix shared with the suffix before it in ``sa``, up to
    ``most``. Kasai: the next position's is at least one less; here all runs take their steps together."""
    before = np.full(len(sym), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp, h, lane = np.zeros(len(sym), np.int32), np.zeros(len(starts), np.int64), np.argsort(-counts, kind="stable")
    starts, counts = starts[lane], counts[lane]
    for t in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -t, "left"))
        p = starts[:live] + t
        q = before[p]
        most_here = np.where(q < 0, 0, np.minimum(np.minimum(end[p] - p, end[q] - q), most))
        now = np.minimum(np.maximum(h[:live] - 1, 0), most_here)
        go = np.flatnonzero(now < most_here)
        while len(go):
            go = go[sym[p[go] + now[go]] == sym[q[go] + now[go]]]
            now[go] += 1
            go = go[now[go] < most_here[go]]
        lcp[p], h[:live] = now, now
    return lcp


def _shard(table: pa.Table, width: int) -> Iterator[dict]:
    """Marks of one shard (s, e of each run of marked strings), and of hot minimisers the strings that are first here."""
    body = table.column("body").combine_chunks()
    data, off = A.texts(body)
    n = np.diff(off)
    did, th, s, count, a = (A.longs(table.column(c)) for c in ("did", "th", "s", "n", "a"))
    hot, sub = table.column("hot").to_numpy(), A.longs(table.column("sub"))
    start = off[:-1] + np.arange(len(n))
    sym, end = np.zeros(len(data) + len(n), np.uint16), np.zeros(len(data) + len(n), np.int64)
    at = np.arange(len(data)) + np.repeat(np.arange(len(n)), n)
    sym[at] = data.astype(np.uint16) + 1
    end[at] = np.repeat(start + n, n)
    sa = suffix_array(sym, end, int(n.max(initial=0)))  # to the full depth, or else Kasai's rule doesn't hold
    lcp = common_prefixes(sym, end, sa, start, count, width)
    group = np.cumsum(lcp[sa] < width)
    run = np.full(len(sym), -1, np.int64)
    run[at] = np.repeat(np.arange(len(n)), n)
    offset = sa - start[run[sa]]
    is_start = offset < count[run[sa]]
    sa, group, offset = sa[is_start], group[is_start], offset[is_start]
    r = run[sa]
    order = np.lexsort((s[r] + offset, th[r], did[r], group))
    sa, group, offset, r = sa[order], group[order], offset[order], r[order]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    key = [did[r], th[r], s[r] + offset]
    later = np.zeros(len(group), bool)
    for x in key:
        later |= x != x[head]
    pick = np.flatnonzero(later)
    yield _ranges(did, th, s, r[pick], offset[pick], width)
    for value in np.unique(a[hot]):
        mine = np.flatnonzero(~later & (a[r] == value) & hot[r])
        cover = A.grams(sym.astype(A.U), 64)
        digest = A.join_hash(cover[sa[mine]], cover[sa[mine] + width - 64])
        order = np.argsort(digest)
        mine, digest = mine[order], digest[order]
        cuts = np.searchsorted(digest >> A.U(64 - PART_BITS), np.arange((1 << PART_BITS) + 1, dtype=A.U))
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            pos, d = mine[cuts[part] : cuts[part + 1]], digest[cuts[part] : cuts[part + 1]]
            yield {"a": [int(value)], "part": [part], "sub": [int(sub[r[mine[0]]])], "reps": [np.stack([d.view(np.int64), key[0][pos], key[1][pos], key[2][pos]]).tobytes()]}


def _ranges(did: np.ndarray, th: np.ndarray, s: np.ndarray, r: np.ndarray, offset: np.ndarray, width: int) -> dict:
    """Neighbouring marked strings of one run as one range of bytes."""
    order = np.lexsort((offset, r))
    r, offset = r[order], offset[order]
    new = np.ones(len(r), bool)
    new[1:] = (np.diff(r) != 0) | (np.diff(offset) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(r))[: len(first)] - 1
    return {"did": did[r[first]], "th": th[r[first]], "s": (s[r[first]] + offset[first]).astype(np.int32), "e": (s[r[first]] + offset[last] + width).astype(np.int32)}


_SHARD_OUT = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("a", pa.int64()), ("part", pa.int32()), ("sub", pa.int32()), ("reps", pa.binary())])
_MARKS = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _table(columns: dict, schema: pa.Schema) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _merge(table: pa.Table, width: int) -> pa.Table:
    """Sorted strings of several shards: which of them start earlier in another shard, found by binary search."""
    parts = [np.frombuffer(x.as_py(), np.int64).reshape(4, -1) for x in table.column("reps")]
    keys, first = parts[0][0].view(A.U), parts[0][1:]
    for part in parts[1:]:
        d = part[0].view(A.U)
        at = np.searchsorted(keys, d)
        same = at < len(keys)
        same[same] = keys[at[same]] == d[same]
        mine, there = part[1:, same], first[:, at[same]]
        less = (mine[0] < there[0]) | (mine[0] == there[0]) & ((mine[1] < there[1]) | (mine[1] == there[1]) & (mine[2] < there[2]))
        first = first.copy()
        first[:, at[same][less]] = mine[:, less]
        keys, first = np.insert(keys, at[~same], d[~same]), np.insert(first, at[~same], part[1:, ~same], axis=1)
    out = []
    for part in parts:
        there = first[:, np.searchsorted(keys, part[0].view(A.U))]
        out.append(part[1:, (there != part[1:]).any(axis=0)])
    did, th, s = np.concatenate(out, axis=1)
    return _table({"did": did, "th": th, "s": s.astype(np.int32), "e": (s + width).astype(np.int32)}, _MARKS)


def repeated_bytes(docs: DataFrame, width: int = 100) -> DataFrame:
    """did, th, s, e: byte ranges of documents (``keyed``) whose strings of ``width`` bytes all start earlier elsewhere."""
    runs = keep(S.repeated_runs(docs, A.texts, width, 32, False).drop("src", "src_th", "src_s"), "runs")
    settled = runs.filter("settled").select("did", "th", "s", (F.col("s") + F.col("n") + F.lit(width - 1)).alias("e"))
    candidates = runs.filter("not settled")
    shards = max(1, math.ceil(candidates.count() / S.SHARD))

    def cut(column: pa.Array, row: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[bytes]:
        data, off = A.texts(column)
        at = off[row] + s
        whole = data.tobytes()
        return [whole[x:y] for x, y in zip(at.tolist(), (at + n + width - 1).tolist(), strict=True)]

    def shard(table: pa.Table) -> pa.Table:
        return pa.concat_tables([_table(x, _SHARD_OUT) for x in _shard(table, width)])

    bodies = S.contents(docs, candidates, cut).withColumn("shard", F.pmod(F.xxhash64("a", "sub"), F.lit(shards)))
    found = keep(bodies.groupBy("shard").applyInArrow(shard, "did long, th long, s int, e int, a long, part int, sub int, reps binary"), "found")
    across = found.filter("reps is not null").select("a", "part", "reps").groupBy("a", "part").applyInArrow(lambda t: _merge(t.select(["reps"]), width), "did long, th long, s int, e int")
    return settled.unionByName(found.filter("reps is null").select("did", "th", "s", "e")).unionByName(across)


def dedup_substrings(docs: DataFrame, width: int = 100) -> DataFrame:
    """Per document: doc_id, text (without the repeated bytes; characters cut in two are dropped), n_bytes, n_removed,
    n_spans, kept_sha256 and spans, the removed byte ranges."""
    docs = S.keyed(docs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.pieces(batches):
            rows = []
            data, off = A.texts(batch.column("text"))
            for i, marks in enumerate(batch.column("marks")):
                body, spans = data[off[i] : off[i + 1]].tobytes(), S.merged([(x["s"], x["e"]) for x in marks.as_py() or ()])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(body[at:s])
                    at = e
                left = b"".join([*kept, body[at:]]) if spans else body
                rows.append((left.decode(errors="ignore"), len(body), len(body) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"s": s, "e": e} for s, e in spans]))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    marked = S.with_marks(docs, repeated_bytes(docs, width))
    return marked.select("doc_id", "text", "marks").mapInArrow(remove, "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>")
