"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer of words is an anchor if its least inner s-mer stands at its first or last place (here k = 3 words, s = 1, by
hash): whether it does depends on the k-mer alone, so the same passage gives the same anchors in any context. Before and
after its words every text has two marks, greater than all words, so that a text of any length has anchors by the one
rule; a text without words has none. All anchors are kept, with the place of their first word (-2 and -1: a mark).

The likeness of two texts is the Dice coefficient of their whole anchor lists: each place of an anchor in one text is
matched with the place of the same number, in order, of that anchor in the other, and the matched places of both are
divided by all places of both. Two texts without anchors have likeness 1, one without and another 0. ``fingerprint``
shows the ``SIZE`` least hashes of the distinct anchors; no likeness is taken from it.

Null text: empty. The next document is that of the next larger
doc_id (rows of one doc_id follow each other by text); rows with null doc_id have no place in that order: they are
edited with, and compared to, the empty text. A text of any length keeps all its anchors. No rows give no rows. Only doc_id
and text are read, so columns of other names don't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 64
MARK = 2**63 - 1
#: doc_ids in a block, which one task orders.
BLOCK = 1024


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def anchors(text: Column) -> Column:
    """word and hash of a text's anchors, in order."""
    words = F.transform(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    marks = F.array(F.lit(MARK), F.lit(MARK))

    def found(h: Column) -> Column:
        kmers = F.transform(h, lambda a, i: F.struct((i - 2).alias("word"), a.alias("a"), F.get(h, i + 1).alias("b"), F.get(h, i + 2).alias("c")))
        closed = F.filter(kmers, lambda x: x["c"].isNotNull() & (F.least(x["a"], x["c"]) <= x["b"]))
        return F.transform(closed, lambda x: F.struct(x["word"].alias("word"), F.xxhash64(x["a"], x["b"], x["c"]).alias("hash")))

    none = F.array().cast("array<struct<word:int,hash:bigint>>")
    return _once(F.concat(marks, words, marks), lambda h: F.when(F.size(h) > 4, found(h)).otherwise(none))


def places(found: Column) -> Column:
    """A hash for each place of an anchor: of the anchor and of how many places of it come before."""

    def numbered(s: Column) -> Column:
        def several(first: Column) -> Column:
            def each(at: Column, j: Column) -> Column:
                return F.transform(F.sequence(F.lit(0), F.coalesce(F.get(first, j + 1), F.size(s)) - at - 1), lambda k: F.when(k == 0, F.get(s, at)).otherwise(F.xxhash64(F.get(s, at), k)))

            return F.when(F.size(first) == F.size(s), s).otherwise(F.flatten(F.transform(first, each)))

        starts = F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i))
        return _once(F.filter(starts, lambda i: i.isNotNull()), several)

    return _once(F.sort_array(F.transform(found, lambda x: x["hash"])), numbered)


def sketch(found: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.transform(found, lambda x: x["hash"]))), 1, SIZE)


def fingerprint(least: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.concat_ws("", F.transform(least, lambda x: F.lpad(F.hex(x), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Of two texts' ``places``."""
    all_places = F.size(a) + F.size(b)
    return F.when(all_places == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / all_places)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, places and ``next``, the same of the document that follows; the first one follows the last.

    Texts are shuffled once, to blocks of neighbouring doc_ids. A block's first text is a guest at the end of the block
    before it, so that all next documents are found inside blocks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = docs.filter("doc_id is not null").withColumns({"block": F.floor(F.col("doc_id") / BLOCK), "guest": F.lit(0)})
    heads = placed.groupBy("block").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    # Which block comes before is found over blocks of blocks; the last comes before the first.
    blocks = heads.select("block", F.floor(F.col("block") / BLOCK).alias("above"))
    inside = blocks.select("block", "above", F.lag("block").over(Window.partitionBy("above").orderBy("block")).alias("before"))
    above = blocks.groupBy("above").agg(F.max("block").alias("most"))
    above = above.select("above", F.coalesce(F.lag("most").over(Window.orderBy("above")), F.max("most").over(Window.partitionBy())).alias("past"))
    order = inside.join(above, "above").select("block", F.coalesce("before", "past").alias("before"))
    guests = heads.join(order, "block").select("head.doc_id", "head.text", F.col("before").alias("block"), F.lit(1).alias("guest"))
    rows = placed.unionByName(guests).repartition("block").withColumn("places", places(anchors(F.col("text"))))
    in_order = Window.partitionBy("block").orderBy("guest", "doc_id", "text")
    rows = rows.withColumn("next", F.lead(F.struct("text", "places")).over(in_order)).filter("guest = 0")
    blank = F.struct(F.lit("").alias("text"), F.array().cast("array<bigint>").alias("places"))
    lost = docs.filter("doc_id is null").select("doc_id", "text", places(anchors(F.col("text"))).alias("places"), blank.alias("next"))
    return rows.select("doc_id", "text", "places", "next").unionByName(lost)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    and anchors, all of them.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or all) of the next
    document, the first document following the last."""
    rows = with_next(docs)
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("substring(next.text, 1, cast(floor(char_length(text) / 2) as int))"))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "places", F.col("next.places").alias("next_places"), anchors(F.col("text")).alias("anchors"))
    rows = rows.withColumn("edited_anchors", anchors(F.col("edited")))
    near = likeness(F.col("places"), places(F.col("edited_anchors"))).alias("near_edited"), likeness(F.col("places"), F.col("next_places")).alias("near_next")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(sketch(F.col("anchors"))).alias("fingerprint"), fingerprint(sketch(F.col("edited_anchors"))).alias("edited_fingerprint"), *near, "anchors")
