"""What the queries must give, worked out plainly in Python over lists of rows (doc_id, text)."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return text.translate(UPPER)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def substrings(docs, width):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    first, data = {}, sorted((d, (t or "").encode()) for d, t in docs)
    out = {}
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first.setdefault(b[i : i + width], (d, i)) != (d, i):
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def windows(docs, width):
    """doc_id: (n_words, n_removed, kept_sha256)."""
    first, data = {}, sorted((d, WORD.findall(t or "")) for d, t in docs)
    out = {}
    for d, w in data:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), d) != d:
                gone[i : i + width] = b"\1" * width
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def shingles(text, n=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, percent):
    """doc_id: (n_shingles, component_id, kept)."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a1, b1 = top(a), top(b)
                    root[max(a1, b1)] = min(a1, b1)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at = [(i, label) for i in range(len(w)) for p, label in PHRASES.items() if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def edited(docs):
    """doc_id: (n_chars, edited_sha256)."""
    data = sorted((d, t or "") for d, t in docs)
    out = {}
    for i, (d, t) in enumerate(data):
        following, half = data[(i + 1) % len(data)][1], len(t) // 2
        out[d] = (len(t), sha((t[: len(t) - half] + following[:half]).encode()))
    return out


def tokens(text):
    return [*WORD.findall(lower(text or "")), None]
