"""DuckDB SQL that computes the same rows by brute force, for the operators that SQL can express."""

from __future__ import annotations

_SPLIT = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _words(text: str) -> str:
    return _SPLIT.format(t=text)


_LOWER_ASCII = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN least USING (s), (SELECT unnest(range(0, 13)) AS k) WHERE m < doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

OP6 = f"""
WITH i0 AS (SELECT item_id, {_words("lower(text)")} AS w FROM benchmark),
it AS (SELECT item_id, least(5, len(w)) AS k, w FROM i0 WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM it)),
n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
d AS (SELECT doc_id, {_words("lower(text)")} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM it),
dsh AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dsh JOIN ish USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM hit JOIN n USING (item_id) WHERE n_shared + 1e-9 >= 0.8 * n_item
"""


# Thresholds and words are written out here and not taken from the operator, so that a slip there shows.
_STOP_LINES = (
    "the of and to in is that for with was as on are by this be it at from or an a",
    "le la les de des du et un une en est que pour dans sur par au qui",
    "der die das und in zu den von mit ist des auf im ein eine nicht sich dem",
    "el los las del y que en un una por con para se no al lo es su",
)
_STOP = ", ".join(f"'{v}'" for v in sorted({v for line in _STOP_LINES for w in line.split() for v in (w, w.capitalize())}))

OP8 = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_words("text")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN rep USING (doc_id, s), (SELECT unnest(range(0, 3)) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND 10 * n_symbols <= n_words
  AND (50 * n_stop_words >= n_words OR coalesce(lang, 'en') NOT IN ('en', 'fr', 'de', 'es')) AND 2 * n_dup_lines <= n_lines AS kept FROM b
"""

# A rate over 64 is the sum of ceil(rate / 64) draws of equal parts, each at a hashed number of its own.
OP9 = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r0 AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM c) * (SELECT sum(n) FROM c) / n AS whole FROM c),
r AS (SELECT source, greatest(1, ceil(whole / 64))::BIGINT AS parts, whole / greatest(1, ceil(whole / 64)) AS rate FROM r0),
p AS (SELECT source, rate, unnest(range(0, 181)) AS k FROM r),
cdf AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS f FROM p),
d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS first FROM documents),
parts AS (SELECT d.*, unnest(range(1, r.parts + 1)) AS part FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source),
u AS (SELECT doc_id, source, text_md5, (CASE WHEN part = 1 THEN first ELSE ('0x' || substr(md5('mix-1:' || first || ':' || part), 1, 13))::BIGINT END) / 4503599627370496.0 AS u FROM parts),
n AS (SELECT u.doc_id, u.source, u.text_md5, count(k) AS n FROM u LEFT JOIN cdf ON cdf.source IS NOT DISTINCT FROM u.source AND f <= u.u AND f < 1 - 1e-15 GROUP BY ALL)
SELECT doc_id, source, text_md5, unnest(range(0, n))::INT AS copy, n::INT AS n_copies FROM n
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER_ASCII)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
edge AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) c ON c.x = d.doc_id
"""
