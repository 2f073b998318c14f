"""SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .license_scan import CONTAINED, PHRASES, TEMPLATES

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, breaks: str) -> str:
    return f"list_filter(string_split_regex({text}, '{breaks}'), lambda x: x <> '')"


SUBSTRINGS = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS g1, md5(substr(h, 2 * i + 1, 200)) AS g2
    FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM b)),
f AS (SELECT doc_id, i, first_value({'d': doc_id, 'i': i}) OVER (PARTITION BY g1, g2 ORDER BY doc_id, i) AS source FROM e),
m AS (SELECT doc_id, i, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 100 AS opens FROM f WHERE source.d <> doc_id OR source.i <> i),
s AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m) GROUP BY doc_id, span),
k AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS past FROM s),
r AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(substr(h, 2 * past + 1, 2 * (s - past)), '' ORDER BY s) || substr(max(h), 2 * max(e) + 1) AS kept
    FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN r USING (doc_id)"""

WINDOWS = f"""
WITH w AS (SELECT doc_id, {_words("coalesce(text, '')", _SPACE)} AS w FROM documents),
e AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS d FROM e),
m AS (SELECT DISTINCT doc_id, i + k AS place FROM f, range(13) r(k) WHERE d < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS k FROM p ANTI JOIN m USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOWER, _SPACE)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM both_of JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_phrases = " UNION ALL ".join(f"SELECT {_quoted(label)} AS label, {phrase.split()!r} AS parts" for phrase, label in PHRASES.items())
_templates = " UNION ALL ".join(f"SELECT {i} AS template, {_quoted(label)} AS label, {_quoted(text)} AS text" for i, (label, text) in enumerate(TEMPLATES))

LICENSES = f"""
WITH w AS (SELECT doc_id, {_words(_LOWER, _BREAKS)} AS w, coalesce(text, '') AS text FROM documents),
phrases AS ({_phrases}),
places AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) JOIN phrases ON w[i] = parts[1] AND w[i:i + len(parts) - 1] = parts),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base_labels FROM places GROUP BY doc_id),
t AS (SELECT template, label, list_distinct({_words(_LOWER, _BREAKS)}) AS t_words FROM ({_templates})),
lines AS (SELECT doc_id, list_distinct({_words(_LOWER, _BREAKS)}) AS b_words FROM (SELECT doc_id, unnest(string_split_regex(text, '[\\n\\r]+')) AS text FROM w)),
met AS (SELECT doc_id, label, len(list_intersect(b_words, t_words)) / len(t_words) AS contained FROM lines, t WHERE len(b_words) >= ceil(len(t_words) * {CONTAINED})),
more AS (SELECT doc_id, max(contained) AS contained, list(DISTINCT label) AS labels FROM met WHERE contained >= {CONTAINED} GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(contained, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""
