"""MinHash near-dedup with SuperMinHash signatures.

Sets are the distinct shingles of ``SHINGLE`` lower-cased words (fewer words: the whole sequence). Documents with equal
sets form a class. Each class gets a SuperMinHash signature: an element draws a random permutation of the slots, step
by step, and offers step number + random fraction to the slot of each step, so that its ranks differ from slot to slot;
a document stops once every slot holds less than the next step's number. Signatures are cut in bands. Classes that
share a band are compared with the band's first class, and then, where they still lie in different components, with
each other; links are confirmed on the full sets, and components joined by union-find (``components``).

At a likeness of 0.85, 24 bands of 5 miss a pair with a probability under 1e-6.

Null or empty text: the empty set, linked with nothing. Null doc_id: each different text is a document after all
others (doc_ids below 2**62); its component_id is null if it reaches no doc_id. Rows of one doc_id are one node, so
their links count together. A text of any length is one set. Ties among equal sets go to the smaller doc_id. No rows
give no rows. Columns of other names are left behind, or pass through whole (``first_of_each``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .scratch import keep

SHINGLE, BANDS, ROWS = 5, 24, 5
SLOTS = BANDS * ROWS
#: Equal slots that a pair needs before its sets are compared: six standard deviations below the mean at 0.85.
LEAST_EQUAL = 78
UNNUMBERED = 2**62
#: Rows of bands, and shingles of theirs, that a task of the last comparison gets, about.
TASK_ROWS, TASK_SHINGLES = 4096, 1 << 19


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows in a row, and where each row starts."""
    h, _, row = A.words(*A.texts(column), lower=True)
    count = np.diff(row)
    g = A.grams(h, SHINGLE)
    whole = A.inside(row, len(h), SHINGLE)[: len(g)]
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    off = np.append(0, np.cumsum(size))
    out = np.zeros(off[-1], A.U)
    big = np.repeat(count >= SHINGLE, size)
    out[big] = g[whole]
    for n in range(1, SHINGLE):
        few = np.flatnonzero(count == n)
        out[off[few]] = A.mix(A.grams(h, n)[row[few]] + A.U(n))
    for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if e - s > 1:
            out[s:e].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[off[:-1][size > 0]] = True
    total = np.append(0, np.cumsum(new))
    return out[new], total[off]


def super_minhash(elements: np.ndarray, off: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (a row for each set, m slots: 7 bits of step, 25 of fraction); all sets take their steps together."""
    sets = len(off) - 1
    h = np.full(sets * m, 2**32 - 1, np.uint32)
    at = np.repeat(np.arange(sets), np.diff(off))
    past = np.zeros((0, len(elements)), np.uint8)
    for j in range(m):
        x = A.mix(elements + A.U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        swap = (A.U(j) + (((x & A.U(0xFFFFFFFF)) * A.U(m - j)) >> A.U(32))).astype(np.uint8)
        slot = swap
        for t in range(j - 1, -1, -1):  # which slot the swaps so far have brought here
            slot = np.where(slot == past[t], np.uint8(t), slot)
        np.minimum.at(h, at * m + slot, (np.uint32(j) << np.uint32(25)) | (x >> A.U(39)).astype(np.uint32))
        open_ = h.reshape(sets, m).max(axis=1) >= np.uint32(j + 1) << np.uint32(25) if j < m - 1 else np.zeros(sets, bool)
        live = open_[at]
        if not live.any():
            break
        elements, at, past = elements[live], at[live], np.vstack([past, swap[None]])[:, live]
    return h.reshape(sets, m)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in A.pieces(batches):
        sets, off = shingle_sets(batch.column("text"))
        sig = super_minhash(sets, off)
        n, raw = np.diff(off), sets.tobytes()
        digest = np.frombuffer(b"".join(hashlib.blake2b(raw[8 * s : 8 * e], digest_size=16).digest() for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), pa.array(n.astype(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([x.tobytes() for x in sig], pa.binary())], names=["did", "th", "n", "cls", "cls2", "sig"])


def _signatures(column: pa.Array) -> np.ndarray:
    return A.texts(column)[0].view(np.uint32).reshape(-1, SLOTS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = _signatures(batch.column("sig")).reshape(-1, BANDS, ROWS).astype(A.U)
            key = np.broadcast_to(np.arange(BANDS, dtype=A.U), sig.shape[:2]).copy()
            for i in range(ROWS):
                key = A.join_hash(key, sig[:, :, i])
            row = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in ("rep", "cls", "n")), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows))], names=["band", "rep", "cls", "n", "nb"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            same = (_signatures(batch.column("sig_x")) == _signatures(batch.column("sig_y"))).sum(axis=1)
            yield batch.filter(pa.array(same >= LEAST_EQUAL)).select(["x", "xc", "y", "yc"])


def _across(table: pa.Table, percent: int) -> pa.Table:
    """Links between classes of different components that share one of some bands; no more than join them.

    A pair is compared in its first common band only, and only while the two are in different components: likely ones
    first, on full sets, and every link found merges the components at once."""
    table = table.combine_chunks()
    band, rep, n, root, nb, block, one, two = (A.longs(table.column(c)) for c in ("band", "rep", "n", "root", "nb", "block", "one", "two"))
    key = A.join_hash(A.join_hash(band.view(A.U), one.view(A.U)), two.view(A.U))
    sig = _signatures(table.column("sig"))
    sets = table.column("shingles").combine_chunks()
    value, off = sets.flatten().to_numpy(), np.append(0, np.cumsum(n))
    order = np.lexsort((n, key))
    out = []
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        size, high, part, sigs = n[rows], 0, root[rows].copy(), sig[rows]
        across = one[rows[0]] != two[rows[0]]  # then pairs within a block are another task's
        for i in range(len(rows)):
            high = max(high, int(np.searchsorted(size, size[i] * 100 // percent, "right")))
            apart = part[i + 1 : high] != part[i]
            if across:
                apart &= block[rows[i + 1 : high]] != block[rows[i]]
            to = i + 1 + np.flatnonzero(apart)
            if not len(to):
                continue
            equal = sigs[to] == sigs[i]
            count = equal.sum(axis=1)
            likely = np.flatnonzero(count >= LEAST_EQUAL)
            likely = likely[equal[likely].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == nb[rows[i]]]
            mine = value[off[rows[i]] : off[rows[i] + 1]]
            for j in to[likely[np.argsort(-count[likely], kind="stable")]].tolist():
                if part[j] == part[i]:
                    continue
                other = value[off[rows[j]] : off[rows[j] + 1]]
                both = int((mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other).sum())
                if both * 100 >= (len(mine) + len(other) - both) * percent:
                    out.append((rep[rows[i]], rep[rows[j]]))
                    part[part == part[j]] = part[i]
    u, v = np.array(out, np.int64).reshape(-1, 2).T
    return pa.table({"u": u, "v": v})


_PAIR = "x long, xc long, y long, yc long"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each class's first document."""
    for batch in A.pieces(batches):
        sets, off = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("cls"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["rep", "cls", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, xc, y, yc) whose sets are alike enough, as links u, v."""
    a = sets.select(F.col("rep").alias("x"), F.col("cls").alias("xc"), F.col("shingles").alias("sx"))
    b = sets.select(F.col("rep").alias("y"), F.col("cls").alias("yc"), F.col("shingles").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    enough = both * 100 >= (F.size("sx") + F.size("sy") - both) * percent
    return pairs.join(a, ["x", "xc"]).join(b, ["y", "yc"]).filter(enough).select(F.col("x").alias("u"), F.col("y").alias("v"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; linked at intersection >= percent / 100 of the union."""
    out = components_of(docs, percent)
    shown = lambda c: F.when(F.col(c) < UNNUMBERED, F.col(c)).alias
    return out.select(shown("did")("doc_id"), "n_shingles", shown("component")("component_id"), (F.col("component") == F.col("did")).alias("kept"))


def node_keys() -> list:
    """did, the node of a row, and th, the hash of its text."""
    th = F.xxhash64("text")
    return [F.coalesce(F.col("doc_id").cast("long"), th.bitwiseAND(F.lit(UNNUMBERED - 1)) + F.lit(UNNUMBERED)).alias("did"), th.alias("th")]


def first_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, of the first document of each component; one row where a document repeats."""
    row = docs.select(F.struct(*docs.columns).alias("row"), *node_keys())
    chosen = components_of(docs, percent).filter("did = component").groupBy("did").agg(F.min("th").alias("th"))
    row = row.join(chosen.hint("shuffle_hash"), ["did", "th"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("did", "th").orderBy("th"))
    return row.withColumn("nth", nth).filter("nth = 1").select("row.*")


def components_of(docs: DataFrame, percent: int) -> DataFrame:
    """did, th (``node_keys``), n_shingles and component of every row."""
    docs = docs.select(*node_keys(), "text")
    every = keep(docs.mapInArrow(_features, "did long, th long, n long, cls long, cls2 long, sig binary"), "signatures")
    classes = keep(every.filter("n > 0").groupBy("cls", "cls2").agg(F.min("did").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    bands = classes.mapInArrow(_bands, "band long, rep long, cls long, n long, nb int")
    # Summed on the map side and joined back, so that a band of very many classes is no single task's.
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rep", "cls", "n")).alias("first")).filter("c > 1")
    bands = keep(bands.join(shared, "band"), "bands")
    pivots = bands.filter(f"(rep, cls) != (first.rep, first.cls) and least(n, first.n) * 100 >= greatest(n, first.n) * {percent}")
    pairs = pivots.select(F.col("rep").alias("x"), F.col("cls").alias("xc"), F.col("first.rep").alias("y"), F.col("first.cls").alias("yc")).distinct()
    sig = classes.select("rep", "cls", "sig")
    pairs = pairs.join(sig.toDF("x", "xc", "sig_x"), ["x", "xc"]).join(sig.toDF("y", "yc", "sig_y"), ["y", "yc"]).mapInArrow(_likely, _PAIR)
    wanted = bands.select("rep", "cls").distinct().join(classes.select("rep", "cls", "cls2"), ["rep", "cls"])
    chosen = every.select("did", "th", "cls", "cls2").join(wanted.withColumnRenamed("rep", "did"), ["did", "cls", "cls2"]).groupBy("did", "cls").agg(F.min("th").alias("th"))
    source = docs.join(chosen.hint("shuffle_hash"), ["did", "th"])
    sets = keep(source.select(F.col("did").alias("rep"), "cls", "text").mapInArrow(_sets, "rep long, cls long, shingles array<long>").dropDuplicates(["rep", "cls"]), "sets")
    links = keep(_confirmed(pairs, sets, percent), "confirmed")
    roots = components(links)
    placed = bands.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    several = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("all")).filter("lo != hi").drop("lo", "hi")
    mixed = keep(placed.join(several, "band").select("band", "nb", "rep", "cls", "n", "root", "c", "all"), "mixed")
    size = mixed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    groups = max(1, size["rows"] // TASK_ROWS, size["n"] // TASK_SHINGLES)
    # A band that is too much for a task is cut in blocks, and every two of its blocks meet in a task of their own.
    cut = F.greatest(F.ceil(F.col("c") / TASK_ROWS), F.ceil(F.col("all") / TASK_SHINGLES)).cast("int")
    mixed = mixed.withColumn("cut", cut).withColumn("block", F.pmod(F.xxhash64("rep", "cls"), F.col("cut")).cast("int"))
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    mixed = mixed.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    task = F.when(F.col("cut") == 1, F.pmod(F.xxhash64("band"), F.lit(groups))).otherwise(F.xxhash64("band", "one", "two"))
    mixed = mixed.select(task.alias("g"), "band", "nb", "rep", "cls", "n", "root", "block", "one", "two")
    mixed = mixed.join(sig, ["rep", "cls"]).join(sets, ["rep", "cls"])
    rest = mixed.groupBy("g").applyInArrow(lambda t: _across(t, percent), "u long, v long")
    links = links.unionByName(rest)
    roots = components(links)
    named = classes.select("cls", "cls2", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("cls", "cls2", F.coalesce("root", "rep").alias("component"))
    out = every.select("did", "th", "n", "cls", "cls2").join(named, ["cls", "cls2"], "left")
    return out.select("did", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("did")).otherwise(F.col("component")).alias("component"))
