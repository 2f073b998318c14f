"""Cost-balanced packing of documents into sequences of fixed length.

A document is its token ids and an end id. Full lengths of it are sequences by themselves; the rests are packed group
by group: as many sequences as the group's tokens need, rests by descending length, each to the sequence of least
attention cost (linear plus quadratic in a piece's length) that has room, cut only where none has. A group wastes less
than one sequence.

Null text: empty, so one end id, as for an empty text. Rows that repeat a document are packed each for itself, and are
dealt to groups by their place in the table, so many repeats don't meet in one. A text of any length is one row; its
full lengths are cut off before anything is shuffled. Ties in length go by doc_id, then in no stated order. An empty
table gives no pieces. Only doc_id and text are read; other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

END = 0
GROUP = 8192
#: Runs of white space of this length go to the tokenizer itself: the other one's pattern steps back over the whole run.
LONG_RUN = re.compile(r"\s{20000}")


class Encoder:
    """Ids of the tokenizer at ``path``. The same vocabulary as ranks (``ranks``, if given) is some times as fast; texts
    that hold a special token's string always go to the tokenizer itself."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.full, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and not any(s in text for s in self.special) and not (len(text) >= 20000 and LONG_RUN.search(text)):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


@cache
def encoder(path: str | None = None) -> Encoder:
    """One of each in a process."""
    import public_tokenizers as P

    return Encoder(path) if path else Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def assign(lengths: np.ndarray, size: int, linear: float = 1.0, quadratic: float = 1 / 512) -> list[tuple[int, int, int, int, int]]:
    """Item, start in the item, length, sequence and offset of each piece. ``lengths``: 1 to size - 1 each."""
    n = -(-int(lengths.sum()) // size)
    cost, used, out = np.zeros(n), np.zeros(n, np.int64), []

    def put(item: int, start: int, length: int, at: int) -> None:
        out.append((item, start, length, at, int(used[at])))
        used[at] += length
        cost[at] += linear * length + quadratic * length * length

    for item in np.argsort(-lengths, kind="stable").tolist():
        length, start = int(lengths[item]), 0
        while start < length:
            left = length - start
            fits = used + left <= size
            if fits.any():
                put(item, start, left, int(np.where(fits, cost, np.inf).argmin()))
                break
            at = int(used.argmin())
            part = size - int(used[at])
            put(item, start, part, at)
            start += part
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, size: int = 1024, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = max(1, docs.count() // GROUP)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in A.pieces(batches):
            rows = []
            for text in batch.column("text"):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                full = len(ids) // size
                rows.append((len(ids), [crc(ids[i * size : (i + 1) * size]) for i in range(full)], ids[full * size :].tobytes()))
            n, crcs, rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary())], names=["doc_id", "n", "crcs", "rest"])

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("doc_id", "ascending")])
        doc, n, rests = table.column("doc_id").to_pylist(), table.column("n").to_pylist(), table.column("rest").to_pylist()
        rows, at = [], key[0].as_py() << 32
        for d, total, crcs in zip(doc, n, table.column("crcs").to_pylist(), strict=True):
            for i, c in enumerate(crcs):
                rows.append((d, i * size, size, c, total, at, 0))
                at += 1
        some = [i for i, r in enumerate(rests) if r]
        for item, start, length, seq, offset in assign(np.array([len(rests[i]) // 4 for i in some], np.int64), size):
            i = some[item]
            ids = np.frombuffer(rests[i], "<u4")
            rows.append((doc[i], n[i] - len(ids) + start, length, crc(ids[start : start + length]), n[i], at + seq, offset))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    rows = docs.mapInArrow(tokens, "doc_id long, n long, crcs array<long>, rest binary")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(groups)))
    return rows.groupBy("g").applyInArrow(lambda k, t: place(k, t), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
