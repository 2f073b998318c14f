"""Language-model scoring with an Elias-Fano n-gram trie of order three.

Tokens are a text's words, A-Z lower-cased, and one end; the end is also what stands before a first word. Probabilities
are mixed from long contexts to short ones by the contexts' counts, so the model needs no more than counts of n-grams:
p(w) = (c(w) - D) / N, all unknown words together D V / N; p(w | v) = (c(v, w) + PAIR p(w)) / (c(v) + PAIR);
p(w | u, v) = (c(u, v, w) + TRIPLE p(w | v)) / (c(u, v) + TRIPLE). A first word has no third level. Nothing is pruned.

Each task cuts its texts in chunks of bounded size. A chunk sends its distinct words, pairs and triples, with their counts in
its training texts, to shards by the hash of the pair (a triple goes with its last two words). A shard adds the counts,
builds its trie (word, words that follow it, words before the pair) in memory-mapped levels and answers each chunk's
n-grams in the order in which they came; the chunk, which gets its texts again, puts the scores together. So each
n-gram takes one entry for each chunk that has it, however often it occurs, and the model never passes through the
driver. Triples whose two words both occur more than ``HOT`` times in the training texts are spread by their first
word over as many shards as that takes; the list of such words has at most N / HOT rows.

Words are known by 64-bit hashes, within a list by 40 bits. Counts of pairs and triples are 16-bit codes, exact below
32768. Null text: no words, one end. Empty texts and repeated rows each count. A row whose ``train`` is null is scored
only. A text of any length is one row of its chunk. No row at all gives no row; nothing to learn from: score and base
score 0 for every token. Columns of other names pass through; text does not, and n_tokens, n_known, train_tokens,
base_score and score are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .elias_fano import Trie, decode, mapped, tail
from .scratch import keep

END = A.mix(np.array([0x656E64], A.U))[0]
TOP = A.U(1 << 63)
D, PAIR, TRIPLE = 0.75, 400.0, 30.0
#: Bytes of text in a chunk, and for each shard, about. Uses of both words of a pair that isn't spread.
CHUNK, HOT = 5 << 20, 1 << 21
#: Words with names of 16 bits.
COMMON = (1 << 16) - 1
#: Tokens that a task of the first count holds before it sends their counts.
HELD = 1 << 20
MESSAGE = "shard int, chunk long, body binary"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and row starts. A chunked column is read chunk by chunk, which bounds the memory it takes."""
    if isinstance(column, pa.ChunkedArray):
        each = [tokens(c) for c in column.chunks] or [(np.zeros(0, A.U), np.zeros(1, np.int64))]
        at = np.cumsum([0, *(len(w) for w, _ in each)])
        return np.concatenate([w for w, _ in each]), np.concatenate([np.zeros(1, np.int64), *(row[1:] + a for (_, row), a in zip(each, at))])
    h, _, row = A.words(*A.texts(column), lower=True)
    return np.insert(h, row[1:], END), row + np.arange(len(row))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number, all first bytes first, which compresses well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _body(sizes: tuple[int, ...], parts: list[bytes]) -> bytes:
    raw = b"".join((np.array(sizes, np.int64).tobytes(), *parts))
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


_ZSTD = pa.Codec("zstd", compression_level=1)


class _Reader:
    """The numbers of a message, in the order in which they were written."""

    def __init__(self, body: bytes) -> None:
        self.body, self.at = _ZSTD.decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True), 32
        self.sizes = np.frombuffer(self.body, np.int64, 4)  # of words, contexts, pairs, triples

    def numbers(self, kind: int, width: int) -> np.ndarray:
        n = int(self.sizes[kind])
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = np.frombuffer(self.body, np.uint8, n * width, self.at).reshape(width, n).T
        self.at += n * width
        return out.view("<u8").ravel()


def _distinct(x: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (below 2**bits), sorted, and each value's number among them. Value and place are sorted as one
    number, which is some times as fast as sorting places by value; of 64-bit hashes the first bits mostly decide."""
    n = len(x)
    places = n.bit_length()
    less = max(0, bits + places - 64)
    if bits < 64 and less:
        return np.unique(x, return_inverse=True)
    both = np.sort(((x.astype(A.U) >> A.U(less)) << A.U(places)) | np.arange(n, dtype=A.U))
    at = (both & A.U((1 << places) - 1)).astype(np.int64)
    value = x[at]
    if less and (value[1:] < value[:-1]).any():
        return np.unique(x, return_inverse=True)
    new = np.append(True, value[1:] != value[:-1])[:n]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[at] = np.cumsum(new, dtype=rank.dtype) - 1
    return value[new], rank


def _by_shard(shard: np.ndarray, most: int) -> np.ndarray:
    return np.argsort(shard.astype(np.uint16) if most < 65536 else shard, kind="stable")  # the first is a radix sort


class Grams:
    """The distinct n-grams of a chunk in the order of its messages: words by hash, pairs and triples by shard.

    ``node``: a pair in a shard; a pair whose triples are spread has several, of which the first knows its count."""

    def __init__(self, column: pa.Array, shards: int, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        w, self.row = tokens(column)
        self.word, self.of = _distinct(w)
        n = max(1, len(self.word))
        first = np.zeros(len(w), bool)
        first[self.row[:-1]] = True
        before = np.append(0, self.of[:-1])[: len(w)].astype(np.int64)
        del w
        before[first] = np.searchsorted(self.word, END)
        pair, self.pair_of = _distinct(before * n + self.of, (n * n).bit_length())
        self.later = np.flatnonzero(~first)
        triple, self.triple_of = _distinct(self.pair_of[self.later].astype(np.int64) * n + before[self.later - 1], (n * max(1, len(pair))).bit_length())
        self.v, w = pair // n, pair % n
        of_pair, u = triple // n, triple % n
        h = A.join_hash(self.word[self.v], self.word[w])
        home = self.ranged(h, shards)
        node_shard, node_pair, of_node = home, np.arange(len(pair)), of_pair
        uses, self.name = self.known(common)
        parts = -(-np.minimum(uses[self.v], uses[w]) // HOT)[of_pair]
        spread = np.flatnonzero(parts > 1)
        if len(spread):
            salt = A.mix(self.word[u[spread]]) % parts[spread].astype(A.U)
            to = self.ranged(A.join_hash(h[of_pair[spread]], salt + A.U(1)), shards)
            key, at = np.unique(to * len(pair) + of_pair[spread], return_inverse=True)
            node_shard, node_pair = np.append(home, key // len(pair)), np.append(node_pair, key % len(pair))
            of_node = of_pair.copy()
            of_node[spread] = len(pair) + at
        by_shard = _by_shard(node_shard, shards)
        rank = np.empty(len(by_shard), np.int64)
        rank[by_shard] = np.arange(len(by_shard))
        self.home, of_node = rank[: len(pair)], rank[of_node]
        self.order = _by_shard(node_shard[by_shard][of_node], shards) if not len(spread) else np.argsort(of_node, kind="stable")
        self.node_pair, self.triples_in = node_pair[by_shard], np.bincount(of_node, minlength=len(rank))
        short = tail(self.name)
        self.node_v, self.node_w, self.u = self.v[self.node_pair], short[w[self.node_pair]], short[u[self.order]]
        cuts = np.arange(shards + 1)
        self.word_cut = np.searchsorted(self.ranged(self.word, shards), cuts)
        self.node_cut = np.searchsorted(node_shard[by_shard], cuts)
        self.triple_cut = np.append(0, np.cumsum(self.triples_in))[self.node_cut]

    @staticmethod
    def ranged(h: np.ndarray, shards: int) -> np.ndarray:
        return (((h >> A.U(32)) * A.U(shards)) >> A.U(32)).astype(np.int64)

    def known(self, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, its uses in the training texts if it is common (else 0), and its name: its rank, or its hash."""
        hashes, uses, rank = common
        if not len(hashes):
            return np.zeros(len(self.word), np.int64), self.word | TOP
        at = np.minimum(np.searchsorted(hashes, self.word), len(hashes) - 1)
        same = hashes[at] == self.word
        return np.where(same, uses[at], 0), np.where(same, rank[at], self.word | TOP)

    def messages(self, chunk: int, train: np.ndarray) -> pa.Table:
        """A row for each shard that gets something; ``train``: of each text, whether its n-grams count."""
        weight = np.repeat(train, np.diff(self.row)).astype(np.float64)
        words = np.bincount(self.of, weight, len(self.word)).astype(np.int64)
        pairs = np.zeros(len(self.node_pair), np.int64)
        pairs[self.home] = np.bincount(self.pair_of, weight, len(self.v))
        triples = np.bincount(self.triple_of, weight[self.later], len(self.order))[self.order].astype(np.int64)
        shards, bodies = [], []
        for s in range(len(self.word_cut) - 1):
            (a, b), (c, d), (e, f) = (x[s : s + 2] for x in (self.word_cut, self.node_cut, self.triple_cut))
            if a < b or c < d:
                v = self.node_v[c:d]
                first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))[: len(v)]
                parts = [_planes(self.word[a:b], 8), _planes(words[a:b], 4), _planes(self.name[v[first]], 8), _planes(np.diff(np.append(first, len(v))), 4), _planes(self.node_w[c:d], 5), _planes(pairs[c:d], 4), _planes(self.triples_in[c:d], 4), _planes(self.u[e:f], 5), _planes(triples[e:f], 4)]
                shards.append(s)
                bodies.append(_body((b - a, len(first), d - c, f - e), parts))
        return pa.table([pa.array(shards, pa.int32()), pa.array([chunk] * len(shards), pa.int64()), pa.array(bodies, pa.binary())], names=["shard", "chunk", "body"])

    def scores(self, replies: list[bytes], n: int, v: int) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text; ``replies``: by shard."""
        read = [_Reader(x) for x in replies]
        words, pairs, triples = ([r.numbers(kind, width) for r in read] for kind, width in ((0, 8), (2, 2), (3, 2)))
        words, pairs, triples = (np.concatenate([np.zeros(0, A.U), *x]).astype(np.int64) for x in (words, pairs, triples))
        pair = decode(pairs)[self.home][self.pair_of]
        triple = np.empty(len(self.order))
        triple[self.order] = decode(triples)
        c = words[self.of]
        p = np.where(c > 0, c - D, D * v) / max(1, n)
        p = (pair + PAIR * p) / (words[self.v][self.pair_of] + PAIR)
        p[self.later] = (triple[self.triple_of] + TRIPLE * p[self.later]) / (pair[self.later - 1] + TRIPLE)
        p = np.log10(np.minimum(1, p)) if n else np.zeros(len(p))
        sums = [np.add.reduceat(x, self.row[:-1]) for x in ((c > 0).astype(np.int64), np.log10((c + 1) / (n + v + 1)), p)]
        return np.diff(self.row), *sums


def _merge(bodies: list[bytes]) -> tuple[Trie, bytes, list[tuple[np.ndarray, ...]]]:
    """The trie of a shard, its bytes, and what each message asks for: words, contexts, words after, number of the pair
    (in the message) of each triple, and words before."""
    asked, counts = [], []
    for x in map(_Reader, bodies):
        word, n = x.numbers(0, 8), x.numbers(0, 4)
        context = np.repeat(x.numbers(1, 8), x.numbers(1, 4).astype(np.int64))
        after, m, inside = x.numbers(2, 5), x.numbers(2, 4), x.numbers(2, 4)
        before, k = x.numbers(3, 5), x.numbers(3, 4)
        asked.append((word, context, after, np.repeat(np.arange(len(inside)), inside.astype(np.int64)), before))
        counts.append((n, m, k))
    word, context, after, of, before = (np.concatenate(x) for x in zip(*asked, strict=True))
    n, m, k = (np.concatenate(x).astype(np.float64) for x in zip(*counts, strict=True))
    of = of + np.repeat(np.cumsum([0, *(len(x[1]) for x in asked[:-1])]), [len(x[3]) for x in asked])
    word, at = np.unique(word[n > 0], return_inverse=True)
    n = np.bincount(at, n[n > 0], len(word)).astype(np.int64)
    order = np.lexsort((after, context))
    c, a = context[order], after[order]
    new = np.append(True, (c[1:] != c[:-1]) | (a[1:] != a[:-1]))[: len(c)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    c, a, m = c[new], a[new], np.bincount(number, m, int(new.sum())).astype(np.int64)
    key = (number[of].astype(A.U) << A.U(40)) | before
    key, at = np.unique(key[k > 0], return_inverse=True)
    k = np.bincount(at, k[k > 0], len(key)).astype(np.int64)
    of = (key >> A.U(40)).astype(np.int64)
    # Only pairs that were learned stay, and those that lead to learned triples.
    some = m > 0
    some[of] = True
    place = np.cumsum(some) - 1
    blob = Trie.build(word, n, c[some], a[some], m[some], place[of], key & A.U((1 << 40) - 1), k)
    return Trie.load(mapped(blob)), blob, asked


def _answer(table: pa.Table) -> pa.Table:
    trie, _, asked = _merge([x.as_py() for x in table.column("body")])
    out = []
    for word, context, after, of, before in asked:
        pairs, place = trie.pair_codes(context, after)
        triples = trie.triple_codes(place[of], before)
        out.append(_body((len(word), 0, len(pairs), len(triples)), [_planes(trie.counts(word), 8), _planes(pairs, 2), _planes(triples, 2)]))
    return pa.table([table.column("shard"), table.column("chunk"), pa.array(out, pa.binary())], names=["shard", "chunk", "body"])


def _first_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in training texts; under no word, the bytes of all texts."""
    held: list[np.ndarray] = []

    def send() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["w", "n"])

    size = 0
    for batch in A.pieces(batches):
        size += len(A.texts(batch.column("text"))[0])
        w, row = tokens(batch.column("text"))
        train = batch.column("train").to_numpy(zero_copy_only=False)
        held.append(w[np.repeat(train, np.diff(row))])
        if sum(map(len, held)) > HELD:
            yield send()
    if held:
        yield send()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([size], pa.int64())], names=["w", "n"])


def _prepared(docs: DataFrame, train: Column) -> tuple[DataFrame, int, int, int, Broadcast]:
    """The texts as pieces of chunks; the number of shards, N, V, and the common words."""
    texts = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    words = keep(texts.select("text", "train").mapInArrow(_first_count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm_words")
    known = F.col("w").isNotNull()
    total = words.agg(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n"), F.count("w").alias("v")).first()
    # No more words than N / HOT occur more than HOT times.
    common = words.filter(known).orderBy(F.desc("n"), "w").limit(max(COMMON, total["n"] // HOT)).toArrow()
    word, uses = A.longs(common.column("w")).view(A.U), A.longs(common.column("n"))
    order = np.argsort(word)
    shards = max(1, math.ceil(total["bytes"] / CHUNK))
    shared = docs.sparkSession.sparkContext.broadcast((word[order], uses[order], order.astype(A.U)))
    return texts.mapInArrow(_cut, "chunk long, piece binary"), shards, total["n"], total["v"], shared


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the task's texts, each with the number of its chunk."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in A.pieces(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        here = len(A.texts(batch.column("text"))[0])
        if size and size + here > CHUNK:
            chunk, size = chunk + 1, 0
        size += here
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "piece"])


def _texts(chunk: pa.Table) -> pa.Table:
    """row, text, train of a chunk; its pieces by their content, so that the order is always the same."""
    pieces = sorted(x.as_py() for x in chunk.column("piece"))
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in pieces])


def _messages(pieces: DataFrame, shards: int, common: Broadcast) -> DataFrame:
    def send(table: pa.Table) -> pa.Table:
        texts = _texts(table)
        return Grams(texts.column("text"), shards, common.value).messages(table.column("chunk")[0].as_py(), texts.column("train").to_numpy())

    return pieces.groupBy("chunk").applyInArrow(send, MESSAGE)


def learn(docs: DataFrame) -> DataFrame:
    """The tries of all texts of ``docs``: shard, trie (``Trie.load`` reads it)."""
    pieces, shards, _, _, common = _prepared(docs, F.lit(True))

    def build(table: pa.Table) -> pa.Table:
        return pa.table([table.column("shard")[:1], pa.array([_merge([x.as_py() for x in table.column("body")])[1]], pa.binary())], names=["shard", "trie"])

    return _messages(pieces, shards, common).groupBy("shard").applyInArrow(build, "shard int, trie binary")


def score(docs: DataFrame, train: Column) -> DataFrame:
    """All columns of ``docs`` but text, and n_tokens, n_known, train_tokens, base_score, score (log10), by the model
    of the rows for which ``train`` holds."""
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [c for c in docs.columns if c != "text" and c not in added]
    pieces, shards, n, v, common = _prepared(docs, train)
    replies = _messages(pieces, shards, common).groupBy("shard").applyInArrow(_answer, MESSAGE)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _texts(table)
        order = np.argsort(A.longs(answers.column("shard")), kind="stable")
        found = Grams(texts.column("text"), shards, common.value).scores([answers.column("body")[i].as_py() for i in order.tolist()], n, v)
        return pa.table([texts.column("row"), *map(pa.array, found)], names=["row", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row")).schema
    for c, k in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        kind = kind.add(c, k)
    out = pieces.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, kind)
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
