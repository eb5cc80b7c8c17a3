"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from html.entities import entitydefs

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({_LOWER.format(text)}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


OP1 = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS total, count(*) AS k FROM s),
r AS (SELECT source, 1.0::DOUBLE / k * total / n AS rate FROM s, t),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: ln(i::DOUBLE))), 0)) AS p FROM steps),
c AS (SELECT source, rate, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
u AS (SELECT doc_id, source, text, lang, n_chars, ('0x' || substr(md5('count 1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
d AS (SELECT u.doc_id, u.source, any_value(u.text) AS text, any_value(u.lang) AS lang, any_value(u.n_chars) AS n_chars, any_value(c.rate) AS rate, count(*) FILTER (c.c <= u.u) AS copies
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id, u.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::BIGINT AS copy, copies::BIGINT AS copies, round(rate, 6) AS rate FROM d
"""

_UUID = "'urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-8' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
#: Named character references of HTML 4; the ampersand comes last, so that no reference is made by another.
_NAMED = [(f"&{name};", " " if name == "nbsp" else char) for name, char in sorted(entitydefs.items()) if name != "amp"] + [("&#39;", "'"), ("&amp;", "&")]


def _unescaped(text: str) -> str:
    for name, char in _NAMED:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


_TAGLESS = r"""regexp_replace(regexp_replace(regexp_replace(payload,
    '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'),
    '(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/title)\b[^>]*>', chr(10), 'g'),
  '<[^>]*>', ' ', 'g')"""
_TEXT = rf"""trim(regexp_replace(regexp_replace({_unescaped(_TAGLESS)}, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"""
_TITLE = _unescaped("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")
OP4 = f"""
WITH p AS (SELECT page_id, url AS target_uri, '1970-01-01T00:00:00Z' AS date, coalesce(html, '') AS payload,
  sha256('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS h FROM pages),
r AS (SELECT page_id, target_uri, date, payload, {_UUID.format(h="h")} AS refers_to, 'sha256:' || sha256(payload) AS payload_digest, chr(13) || chr(10) AS nl FROM p),
b AS (
  SELECT page_id, target_uri, date, refers_to, payload_digest, nl, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-header: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=utf-8' || nl || 'source-header: Content-Length: ' || strlen(payload) || nl
    || 'title: ' || regexp_replace({_TITLE}, '[\\r\\n\\t ]+', ' ', 'g') || nl
    || 'payload-digest: ' || payload_digest || nl || 'payload-length: ' || strlen(payload) || nl
    || coalesce(array_to_string(list_transform(regexp_extract_all(payload, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1), lambda x: 'outlink: ' || x || nl), ''), '') AS block FROM r
  UNION ALL
  SELECT page_id, target_uri, date, refers_to, payload_digest, nl, 'conversion', 'text/plain', {_TEXT} FROM r),
i AS (SELECT *, sha256(record_type || '|' || refers_to) AS h, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM b),
j AS (SELECT *, {_UUID.format(h="h")} AS record_id FROM i)
SELECT page_id, target_uri, date, payload_digest, refers_to, record_type, content_type, block, record_id, block_digest, content_length,
  'WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: <' || record_id || '>' || nl || 'WARC-Refers-To: <' || refers_to || '>' || nl
  || coalesce('WARC-Target-URI: ' || target_uri || nl, '') || 'WARC-Date: ' || date || nl || 'WARC-Payload-Digest: ' || payload_digest || nl
  || 'WARC-Block-Digest: ' || block_digest || nl || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || content_length || nl AS headers
FROM j
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""

OP7 = f"""
WITH i0 AS (SELECT DISTINCT item_id, {_words("coalesce(text, '')")} AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS len, least(len(w), 5) AS n FROM i0 WHERE len(w) > 0),
ig AS (SELECT item_id, len, n, unnest(list_transform(range(1, len - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM i),
ic AS (SELECT item_id, len, n, g, count(*) AS c FROM ig GROUP BY ALL),
d0 AS (SELECT DISTINCT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
d AS (SELECT doc_id, w, len(w) AS size FROM d0 WHERE len(w) > 0),
dg AS (SELECT doc_id, size, n, unnest(range(0, size - n + 1)) AS pos, unnest(list_transform(range(1, size - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g
       FROM d, (SELECT DISTINCT n FROM i) WHERE size >= n),
hits AS (SELECT DISTINCT dg.doc_id, dg.size, dg.n, dg.pos, ic.len FROM dg JOIN ic ON ic.g = dg.g AND ic.n = dg.n),
win AS (SELECT DISTINCT doc_id, size, n, len, unnest(range(least(greatest(0, pos - (len - n)), greatest(0, least(pos, size - len))), greatest(0, least(pos, size - len)) + 1)) AS start FROM hits),
wc AS (SELECT win.doc_id, win.n, win.len, win.start, dg.g, count(*) AS c
       FROM win JOIN dg ON dg.doc_id = win.doc_id AND dg.n = win.n AND dg.pos BETWEEN win.start AND win.start + win.len - win.n GROUP BY ALL),
wg AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, n, len, start) AS m FROM wc),
it AS (SELECT item_id, sum(c) AS im FROM ic GROUP BY item_id),
j AS (SELECT wg.doc_id, wg.start, ic.item_id, sum(least(wg.c, ic.c)) / (any_value(wg.m) + any_value(it.im) - sum(least(wg.c, ic.c))) AS sim
      FROM wg JOIN ic ON ic.g = wg.g AND ic.len = wg.len AND ic.n = wg.n JOIN it ON it.item_id = ic.item_id GROUP BY wg.doc_id, wg.start, ic.item_id, wg.n, wg.len)
SELECT doc_id, item_id, count(*)::BIGINT AS n_windows, arg_min(start, (-sim, start))::BIGINT AS best_start, round(max(sim), 6)::DOUBLE AS best_similarity
FROM j WHERE sim >= 0.8 GROUP BY doc_id, item_id
"""

OP8 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (c.key IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON c.key = k.key GROUP BY doc_id
"""

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_STEP = "CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1))) ELSE c END"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(doc_id::VARCHAR))), lambda c, k: xor(({_STEP}) >> 1, (({_STEP}) & 1) * 3988292384)), 4294967295)"

# A run of period q is an island of words equal to the one q words on; an island with a smaller period around it is no run of its own.
OP11 = f"""
WITH h AS (SELECT doc_id, {_WORDS} AS w, {_CRC} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
t AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
c AS MATERIALIZED (SELECT doc_id, q, min(i) AS start, count(*) + q AS len FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.q < c.q AND o.start <= c.start AND o.start + o.len >= c.start + c.len)),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'len': len, 'q': q}}, (-len::DOUBLE / q, start, q)) AS b, string_agg(start || ',' || len || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + len)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.b.start::BIGINT AS start, b.b.len::BIGINT AS length, b.b.q::BIGINT AS period, (1000 * b.b.len // b.b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP12 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
g AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS g FROM d WHERE len(w) >= 50),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT doc_id, i FROM g JOIN f USING (g) WHERE doc_id > first),
m AS (SELECT t.doc_id, t.i, word, max(c.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = t.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_TERMS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d),
f AS (SELECT doc_id, size, term, count(*) AS tf FROM t GROUP BY ALL),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term, n),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // l))))::BIGINT AS score FROM i JOIN f USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES = {"op1_mixing": OP1, "op4_warc_derivatives": OP4, "op6_jaccard_join": OP6, "op7_decontamination": OP7, "op8_line_dedup": OP8, "op11_periodic_runs": OP11, "op12_suffix_trees": OP12, "op13_lexical_search": OP13}
