"""The eleven queries against brute force and SQL, on the smallest tables and on rows made to be awkward."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import difference, engine
from llm import brute

import corpus_pipeline
from evloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
LINE = "the quick brown fox jumps over the lazy dog while seven wizards boxed quietly in june and nobody looked up at them at all"
LICENSE = "Licensed under the Apache License, Version 2.0\nGNU general PUBLIC license cc-by gnu general public license"


def rows_of(spark, sf_dir, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, empty and very long texts, repeats, ties and extra columns with clashing names."""
    at = tmp_path_factory.mktemp("odd")
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(vocabulary, 30000))
    base = " ".join(rng.choice(vocabulary, 300))
    near = base.split()
    near[5] = "changed"
    texts = [None, "", " \t\n", "a", "one two three four", LINE, LINE, LINE.upper(), f"{LINE} {LINE}", "x" * 350, "x" * 350 + "y", "ab" * 400, long, long[:9000], "tail " + long[9000:30000], base, base, " ".join(near), base + " and more words", LICENSE, "mit license " * 3, "Ünïcödé straße 日本語 テキスト " * 30, "12345 67890 --- !!!", "Kİ CC BY", "nul\x00byte in a text", "<|endoftext|> in a text"]
    texts += [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(1, 90, 20)]
    rows = [(i * 3, t, ("en", "de", None)[i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "did long, th long, n long, score double, held_out boolean, row string, marks string, dedup string, w string, _row int, sequence_id string, next string, label string"
    values = (1, 2, 3, 0.5, True, "r", "m", "d", "w", 4, "s", "n", "l")
    spark.createDataFrame([(*r, *values) for r in rows], f"{schema}, {extra}").repartition(5).write.parquet(f"{at}/a/documents.parquet")
    labels = [(i * 3, i % 2, 0) for i in range(0, 40)] + [(0, None, None), (None, 1, 1), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/a/labels.parquet")
    items = [(1, LINE), (2, None), (3, ""), (4, " ".join(long.split()[2000:2040])), (4, " ".join(long.split()[2000:2040])), (None, "short item")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/a/benchmark.parquet")
    # Null doc_ids and rows that repeat wholly, besides.
    again = [*rows, *rows[5:16], (None, LINE, "en", "s", 1), (None, base, None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(again, schema).repartition(3).write.parquet(f"{at}/b/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{at}/empty/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/a/{t}.parquet").write.parquet(f"{at}/b/{t}.parquet")
        spark.read.parquet(f"{at}/a/{t}.parquet").limit(0).write.parquet(f"{at}/empty/{t}.parquet")
    return at


@pytest.fixture(params=["small", "odd"])
def sf_dir(request):
    return SF if request.param == "small" else f"{request.getfixturevalue('odd')}/a"


def got(spark, sf_dir, name, *columns):
    rows = Q.QUERIES[name](spark, sf_dir).collect()
    found = {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}
    assert len(found) == len(rows)
    return found


def test_substrings(spark, sf_dir):
    assert got(spark, sf_dir, "op2_suffix_array_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substrings(rows_of(spark, sf_dir), 100)


def test_windows(spark, sf_dir):
    assert got(spark, sf_dir, "op5_substring_dedup", "n_words", "n_removed", "kept_sha256") == brute.windows(rows_of(spark, sf_dir), 13)


@pytest.mark.parametrize("split", [3, 8192])
def test_hot_minimisers(spark, split, monkeypatch):
    """A line that very many documents share, between words of their own: one minimiser, split over shards or not."""
    from evloom.llm import substring, suffix_dedup, superkmers

    monkeypatch.setattr(superkmers, "SPLIT", split)
    monkeypatch.setattr(superkmers, "SHARD", 40)
    rng = np.random.default_rng(9)
    line = " ".join(f"shared{i}" for i in range(16))
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows = [(i, f"{own(i % 7)} {line} {own(i % 5)} {line if i % 11 == 0 else ''}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_substrings(df).collect()}
    assert found == brute.substrings(rows, 100)
    found = {r["doc_id"]: tuple(r["dedup"])[:3] for r in substring.dedup_windows(df).collect()}
    assert found == brute.windows(rows, 13)


def test_paths_decide_which_words_go(spark, monkeypatch):
    """A long passage is one verified span from its source; without paths, or from other places, nothing goes."""
    from evloom.llm import substring, superkmers

    rng = np.random.default_rng(3)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage = own(300)
    rows = [(1, f"{own(20)} {passage}"), (2, f"{own(7)} {passage} {own(9)}"), (3, f"{passage} {own(30)}"), (4, own(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = {(r["did"], r["s"], r["e"], r["src"] < r["did"]) for r in substring.repeated_spans(superkmers.keyed(df)).collect()}
    assert spans == {(2, 7, 307, True), (3, 0, 300, True)}
    real, removed = substring.compact, lambda: {r["doc_id"]: r["dedup"]["n_removed"] for r in substring.dedup_windows(df).collect()}
    assert removed() == {1: 0, 2: 300, 3: 300, 4: 0}
    monkeypatch.setattr(substring, "compact", lambda pieces: real(pieces).filter("false"))
    assert set(removed().values()) == {0}
    monkeypatch.setattr(substring, "compact", real)
    monkeypatch.setattr(substring, "_digest", lambda words, s, e: str(s).encode())
    assert set(removed().values()) == {0}


def test_alternating_words_give_few_spans(spark):
    """Two words by turns, in many documents: two spans at most for those that begin in the same 13 words, and all words go."""
    from evloom.llm import substring, superkmers

    rng = np.random.default_rng(4)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage = own(60)
    rows = [(i, f"{own(i % 6)} {'left right ' * (100 + i)}{own(i % 4)} {passage if i % 3 == 0 else ''}{' of the in' * (i % 5 * 9)}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: tuple(r["dedup"])[:3] for r in substring.dedup_windows(df).collect()} == brute.windows(rows, 13)
    spans = Counter(r["did"] for r in substring.repeated_spans(superkmers.keyed(df)).collect())
    assert all(spans[i] <= 2 * len(t.split()) / 13 + 12 for i, t in rows)


def test_repeated_rows_cost_no_squares(spark):
    """A document that is there five hundred times has each of its runs compared once."""
    from evloom.llm import arrays as A
    from evloom.llm import superkmers

    text, other = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}" for i in range(10, 40))
    for n in (1, 500):
        docs = superkmers.keyed(spark.createDataFrame([(1, text)] * n + [(2, f"start {other} end")], "doc_id long, text string").repartition(4))
        runs = superkmers.repeated_runs(docs, A.texts, 100, 32, False)
        cut = lambda column, row, s, n: [b"x"] * len(row)
        bodies = superkmers.contents(docs, runs.filter("not settled"), cut).count()
        assert bodies == runs.filter("not settled").count() < 60
        if n == 1:
            once = bodies
    assert bodies == once


def test_near_copies(spark, sf_dir):
    assert got(spark, sf_dir, "op3_minhash_near_dedup", "n_shingles", "component_id", "kept") == brute.components(rows_of(spark, sf_dir), 85)


def test_licenses(spark, sf_dir):
    found = got(spark, sf_dir, "op4_license_scan", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {d: x[:5] for d, x in found.items()} == {d: brute.licenses(t) for d, t in rows_of(spark, sf_dir)}
    for *_, base, labels, score in found.values():
        assert set(filter(None, base.split(","))) <= set(filter(None, labels.split(","))) and 0 <= score <= 1
        assert labels == ",".join(sorted(set(labels.split(",")))) and (score > 0) == bool(labels)


def test_wrapped_licenses(spark):
    """A notice has its label however its lines break, and with comment marks; parts of notices far apart have none."""
    import textwrap

    from evloom.llm import license_scan

    rows, want = [], {}
    for label, text in license_scan.TEMPLATES:
        for width in (12, 40, 72):
            for mark in ("", "# ", " * "):
                body = "\n".join(mark + x for x in textwrap.wrap(text, width, break_long_words=False))
                want[len(rows)] = label
                rows.append((len(rows), f"some code here\n{body}\n\nand more of it"))
    apart = ("\n" + "word " * 40 + "\n").join(license_scan.TEMPLATES[8][1].split(", "))
    rows.append((len(rows), apart))
    found = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, label in want.items():
        assert label in found[d]["labels"].split(",") and found[d]["score"] == 1.0
        assert all(m["block"] >= 0 for m in found[d]["matches"])
    assert found[len(rows) - 1]["labels"] == ""


def test_fingerprints(spark, sf_dir):
    docs = rows_of(spark, sf_dir)
    found = got(spark, sf_dir, "op6_document_fingerprints", "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
    assert {d: x[:2] for d, x in found.items()} == brute.edited(docs)
    by_text = {}
    for d, t in docs:
        assert by_text.setdefault(t or "", found[d][2]) == found[d][2]
    assert all(0 <= x <= 1 for f in found.values() for x in f[3:])
    if sf_dir == SF:  # half of a text is left in its edited form; the next document is another text
        long = [found[d] for d, t in docs if len(t) > 400]
        assert 0.3 < np.median([f[3] for f in long]) < 0.75 and np.median([f[4] for f in long]) < 0.1


def test_whole_anchor_lists(spark):
    """One rule for all lengths, every anchor with its place, and likeness by matched places of whole lists."""
    from pyspark.sql import functions as F

    from evloom.llm import syncmers as S

    rng = np.random.default_rng(11)
    long = [f"w{i}" for i in rng.permutation(5000)]
    texts = ["", "one", "one two", " ".join(long[:23]), " ".join(long[:24]), " ".join(long), " ".join(long[1000:1400] + [f"v{i}" for i in range(4600)]), "a b c d " * 30, "a b c d " * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("anchors", S.anchors(F.col("text"))).withColumn("places", S.places(F.col("anchors")))
    rows = df.orderBy("doc_id").collect()
    hashes = dict(spark.createDataFrame([(w,) for t in texts for w in set(t.split())], "w string").select("w", F.xxhash64("w")).distinct().collect())
    for r in rows:
        h = [hashes[w] for w in r["text"].split()]
        h = [S.MARK] * 2 + h + [S.MARK] * 2 if h else []
        assert [a["word"] for a in r["anchors"]] == [i - 2 for i in range(len(h) - 2) if min(h[i], h[i + 2]) <= h[i + 1]]
        assert len(r["places"]) == len(set(r["places"])) == len(r["anchors"])
    pairs = df.alias("x").crossJoin(df.alias("y")).select(F.col("x.doc_id"), F.col("y.doc_id"), S.likeness(F.col("x.places"), F.col("y.places"))).collect()
    near = {(a, b): x for a, b, x in pairs}
    for (a, b), x in near.items():
        c, d = (Counter(y["hash"] for y in rows[i]["anchors"]) for i in (a, b))
        assert x == pytest.approx(2 * (c & d).total() / (c + d).total() if c or d else 1)
    assert near[3, 4] > 0.8 and 0.03 < near[5, 6] < 0.15 and near[1, 1] == 1 and near[0, 1] == 0


def test_packing(spark, sf_dir):
    from evloom.llm.packing import encoder

    docs = dict(rows_of(spark, sf_dir))
    pieces = Q.op9_packing(spark, sf_dir).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(by_doc) == set(docs)
    for d, parts in by_doc.items():
        ids = [*encoder().full.encode(docs[d] or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert len(by_sequence) == math.ceil(sum(p["length"] for p in pieces) / 1024)


def test_packing_long_runs(spark):
    """Runs of two million spaces, letters, line ends, digits and other marks have the tokenizer's ids and end nothing."""
    from evloom.llm.packing import encoder, pack

    texts = [" " * 2_000_000 + "x", "a" * 2_000_000, "\n" * 2_000_000, "x" + "\u00a0" * 300_000 + "y", "\u3000" * 300_000, "7!" * 500_000, None, "", "same", "same"]
    pieces = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1024).collect()
    for d, text in enumerate(texts):
        ids = [*encoder().full.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces if p["doc_id"] == d)
        assert [x[3] for x in mine] == [len(ids)] * len(mine) and sum(x[1] for x in mine) == len(ids)
        for start, length, crc, _ in mine:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())


def test_packing_repeats(spark, monkeypatch):
    """A row that repeats very often is spread over the groups."""
    from evloom.llm import packing

    monkeypatch.setattr(packing, "GROUP", 100)
    pieces = packing.pack(spark.createDataFrame([(1, "some words of a text")] * 2000, "doc_id long, text string"), 64).collect()
    assert len({p["sequence_id"] >> 32 for p in pieces}) == 20
    assert sum(p["length"] for p in pieces) == 2000 * pieces[0]["doc_tokens"]


def test_language_model(spark, sf_dir):
    docs = rows_of(spark, sf_dir)
    found = got(spark, sf_dir, "op10_lm_scoring", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    counts = Counter(t for d, text in docs if brute.fold(d, 7) != 2 for t in brute.tokens(text))
    n, v = sum(counts.values()), len(counts)
    better = 0
    for d, text in docs:
        t = brute.tokens(text)
        held, n_tokens, n_known, total, base, score = found[d]
        assert (held, n_tokens, n_known, total) == (brute.fold(d, 7) == 2, len(t), sum(counts[x] > 0 for x in t), n)
        assert base == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), rel=1e-9)
        assert score <= 1e-6
        better += held and score > base
    if sf_dir == SF:
        assert better > 0.6 * sum(f[0] for f in found.values())


def model_of_all(docs):
    """p(w | u, v) by plain counts, from (doc_id, text) rows; u is None for a first word, v the end."""
    from evloom.llm import lm

    one, two, three = Counter(), Counter(), Counter()
    for d, text in docs:
        t = brute.tokens(text)
        before = [None, *t]
        one.update(t)
        two.update(zip(before, t))
        three.update((before[i - 1], before[i], t[i]) for i in range(1, len(t)))
    n, v = sum(one.values()), len(one)

    def p(u, c, w):
        own = (one[w] - lm.D if one[w] else lm.D * v) / n
        own = (two[c, w] + lm.PAIR * own) / (one[c] + lm.PAIR)
        return own if u == "first" else (three[u, c, w] + lm.TRIPLE * own) / (two[u, c] + lm.TRIPLE)

    return p, one


def log_score(p, text):
    t = brute.tokens(text)
    before = [None, *t]
    return sum(math.log10(p(before[i - 1] if i else "first", before[i], t[i])) for i in range(len(t)))


def test_probabilities_add_up():
    """Over all words that can follow, known and unknown, a context's probabilities add up to one."""
    p, one = model_of_all([(0, " ".join("abcab"[i % 5] for i in range(200)) + " d e f")] * 3 + [(1, "a f")])
    for c in one:
        for u in ["first", "new", *(one if c is not None else ())]:
            assert sum(p(u, c, w) for w in [*one, "new"]) == pytest.approx(1)


@pytest.mark.parametrize("small", [False, True])
def test_all_triples_count(spark, sf_dir, small, monkeypatch):
    """Scores are those of a model of all words, pairs and triples, in one chunk or in many with their triples spread."""
    from evloom.llm import lm

    if small:
        monkeypatch.setattr(lm, "CHUNK", 1 << 14)
        monkeypatch.setattr(lm, "HOT", 20)
        monkeypatch.setattr(lm, "HELD", 1 << 10)
    docs = rows_of(spark, sf_dir)
    p, _ = model_of_all([x for x in docs if brute.fold(x[0], 7) != 2])
    found = got(spark, sf_dir, "op10_lm_scoring", "score")
    for d, text in docs:
        assert found[d][0] == pytest.approx(log_score(p, text), abs=1e-6, rel=1e-9)


def test_tries_hold_all_counts(spark, monkeypatch):
    """Every word, pair and triple is found by its context in one shard's trie, with its count; others are not."""
    from evloom.llm import arrays as A
    from evloom.llm import elias_fano, lm

    monkeypatch.setattr(lm, "CHUNK", 1 << 13)
    monkeypatch.setattr(lm, "COMMON", 0)  # so that all names are hashes
    docs = rows_of(spark, SF)[:40]
    rows = lm.learn(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) > 3
    tries = [elias_fano.Trie.load(bytes(r["trie"])) for r in rows]
    one, two, three = Counter(), Counter(), Counter()
    for _, text in docs:
        t = lm.tokens(__import__("pyarrow").array([text]))[0].tolist()
        before = [int(lm.END), *t]
        one.update(t)
        two.update(zip(before, t))
        three.update((before[i - 1], before[i], t[i]) for i in range(1, len(t)))
    arrays = lambda keys: [np.array(x, np.uint64) for x in zip(*keys)]
    words, = arrays([(w,) for w in one])
    assert sum(t.counts(words) for t in tries).tolist() == list(one.values())
    name = lambda h: h | lm.TOP
    v, w = map(name, arrays(two))
    assert sum(t.pair_codes(v, elias_fano.tail(w))[0].astype(int) for t in tries).tolist() == list(two.values())
    u, v, w = map(name, arrays(three))
    found = [t.triple_codes(t.pair_codes(v, elias_fano.tail(w))[1], elias_fano.tail(u)) for t in tries]
    assert sum(x.astype(int) for x in found).tolist() == list(three.values())
    other = name(A.mix(u))
    assert not any(t.triple_codes(t.pair_codes(v, elias_fano.tail(w))[1], elias_fano.tail(other)).any() for t in tries)
    n = np.array([0, 1, 32767, 32768, 10**6, 10**12])
    assert elias_fano.decode(elias_fano.encode(n)) == pytest.approx(n, rel=2e-3)


def test_quality(spark, sf_dir):
    found = got(spark, sf_dir, "op1_quality_classifier", "held_out", "score", "predicted")
    docs = rows_of(spark, sf_dir)
    assert set(found) == {d for d, _ in docs}
    for d, _ in docs:
        held, score, predicted = found[d]
        assert held == (brute.fold(d, 5) == 0) and 0 <= score <= 1 and predicted == int(score >= 0.3)


def test_quality_scorer():
    """The array form of features and scores against plain loops over words and bytes."""
    import pyarrow as pa

    from evloom.llm import arrays as A
    from evloom.llm import quality as K

    texts = ["", None, "a", "same same same other", "Grün and ünder", "x  y\tz\n" * 30, "two words"]
    model = K.Model(np.random.default_rng(1).normal(size=K.BUCKETS), 0.25)
    mix = lambda x: int(A.mix(np.array([x % 2**64], np.uint64))[0])
    pair = lambda x, y: int(A.join_hash(np.array([x], np.uint64), np.array([y], np.uint64))[0])
    for text, score in zip(texts, model.scores(pa.array(texts))):
        h, raw = [], (text or "").encode()
        words = raw.split()
        for i, w in enumerate(words):
            own = int(A.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
            h.append(0x3C79AC492BA7B653 if i and words[i - 1] == w else own)
        seen = h + [pair(a, b) for a, b in zip(h, h[1:])] + [mix(a << 16 | b << 8 | c) for a, b, c in zip(raw, raw[1:], raw[2:])] + [0x1C69B3F74AC4AE35]
        x = np.mean([model.weight[f >> 48] for f in seen]) + 0.25
        assert score == pytest.approx(1 / (1 + math.exp(-x)))


def test_quality_learns_from_a_bounded_sample(spark):
    """A labelled document that repeats very often, or very long texts, don't make the sample grow; learning still works."""
    from evloom.llm import quality as K

    good, bad = "clear plain words that read well", "buy cheap !!! click click"
    docs = spark.createDataFrame([(i % 40, f"{(bad, good)[i % 2]} {i % 40}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for bound in (1 << 20, 4000):
        model = K.learn(docs, labels, max_rows=30, max_bytes=bound)
        assert model.scores(__import__("pyarrow").array([good]))[0] > model.scores(__import__("pyarrow").array([bad]))[0]
    assert K.learn(docs, labels.limit(0)).scores(__import__("pyarrow").array([good]))[0] == 0.5


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = Q.op1_quality_classifier(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in docs]) > 0.85


def test_language(spark, sf_dir):
    found = got(spark, sf_dir, "op8_language_id", "held_out", "lang_pred", "score")
    for d, t in rows_of(spark, sf_dir):
        held, lang, score = found[d]
        assert held == (brute.fold(d, 4) == 2) and 0 <= score <= 1
        assert (lang == "und") == (not any(c.isalpha() for c in t or ""))


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = Q.op8_language_id(spark, sf).filter("held_out and lang_pred != 'und'").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.9


def test_leaks(spark):
    """Every item that stands whole in a document is found there; nothing is found that shares no run of five words."""
    items = [(r["item_id"], " ".join(brute.WORD.findall(brute.lower(r["text"])))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = rows_of(spark, SF)
    found = {(r["doc_id"], r["item_id"]) for r in Q.op7_benchmark_decontamination(spark, SF).collect()}
    flat = {d: " ".join(brute.WORD.findall(brute.lower(t))) for d, t in docs}
    whole = {(d, i) for d, t in flat.items() for i, text in items if text in t}
    assert whole and whole <= found
    for d, i in found:
        assert brute.shingles(flat[d]) & brute.shingles(dict(items)[i])


def test_leaks_odd(spark, odd):
    found = {(r["doc_id"], r["item_id"]) for r in Q.op7_benchmark_decontamination(spark, f"{odd}/a").collect()}
    text = dict(rows_of(spark, f"{odd}/a"))
    assert {d for d, i in found if i == 1} == {d for d, t in text.items() if t and LINE in t.lower()}
    assert {d for d, i in found if i == 4} == {d for d, t in text.items() if t and len(t) > 15000}


def test_leaks_do_not_depend_on_shards(spark, monkeypatch):
    """Items in several index shards are found as in one, with the same scores."""
    from evloom.llm import decontaminate as D

    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs, items).collect()}
    cut, seen = D.indexes, []
    monkeypatch.setattr(D, "indexes", lambda b: (seen.append(x) or x for x in cut(b, items_per_shard=max(1, items.count() // 7))))
    several = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs, items).collect()}
    assert len(seen) > 5 and one and set(several) == set(one)
    for k, r in one.items():
        assert tuple(several[k]) == pytest.approx(tuple(r), rel=1e-9)


def test_all_index_hits_come_back(spark):
    """Block-max WAND gives the same items as scoring every item."""
    import pyarrow as pa

    from evloom.llm.decontaminate import Index

    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(60)]
    index = Index.build(list(range(80)), pa.array([" ".join(rng.choice(vocabulary, n)) for n in rng.integers(3, 30, 80)]))
    for _ in range(50):
        query = np.unique(rng.integers(0, len(index.vocab), 25))
        every = np.zeros(80)
        for t in query:
            at = slice(index.start[t], index.start[t + 1])
            every[index.item[at]] += index.impact[at]
        assert {i for i, _ in index.search(query, 0.4)} == set(np.flatnonzero(every >= 0.4).tolist())


@pytest.mark.parametrize("name", Q.QUERIES)
@pytest.mark.parametrize("case", ["b", "empty"])
def test_awkward_tables(spark, odd, name, case):
    rows = Q.QUERIES[name](spark, f"{odd}/{case}").collect()
    docs = spark.read.parquet(f"{odd}/{case}/documents.parquet").count()
    if name.startswith(("op7", "op9")):
        assert bool(rows) <= bool(docs)
    elif name.startswith("op6"):
        assert len(rows) == docs
    else:
        assert len(rows) == docs
    if case == "empty":
        assert not rows


@pytest.mark.parametrize("name", Q.ORACLES)
def test_sql(spark, name):
    assert difference(Q.QUERIES[name](spark, SF), engine(SF), Q.ORACLES[name]) is None


def test_pipeline(spark, sf_dir):
    """Each stage against brute force over what it was given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.keep(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        texts = [(d, r["text"]) for d, r in before.items()]
        if name == "near dedup":
            assert set(after) == {d for d, x in brute.components(texts, 85).items() if x[2]}
        if name == "substring dedup":
            want = brute.windows(texts, 13)
            assert set(after) == {d for d, x in want.items() if not x[1] or x[1] < x[0]}
            assert all(brute.sha(" ".join(brute.WORD.findall(r["text"] or "")).encode()) == want[d][2] for d, r in after.items())
        if name == "decontamination":
            gone = {d for d in before if d not in after}
            items = [t for t in spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()["text"] if t]
            assert all(any(brute.shingles(before[d]["text"]) & brute.shingles(t) for t in items) for d in gone)
            assert not any(" ".join(brute.WORD.findall(brute.lower(t))) in " ".join(brute.WORD.findall(brute.lower(r["text"] or ""))) for r in after.values() for t in items if len(t.split()) > 3)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_of_nothing(spark, odd):
    assert corpus_pipeline.run(spark, f"{odd}/empty").count() == 0
    assert corpus_pipeline.run(spark, f"{odd}/b").count() > 0
