"""DuckDB SQL of queries whose operators are longer than their SQL."""

from . import quality

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _windows(n: int, order: str = "i") -> str:
    """Concatenation of a row's word and the next n - 1."""
    return " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER (PARTITION BY rid ORDER BY {order})" for k in range(1, n))])


OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT rid, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
win AS (SELECT rid, i, {_windows(quality.WINDOW)} AS s FROM words),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win WHERE s IS NOT NULL) WHERE c > 1),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {quality.WINDOW})) AS p FROM rep) GROUP BY 1),
lines AS (SELECT rid, source, unnest(string_split(t, chr(10))) AS l FROM d),
full_lines AS (SELECT rid, source, l, len(regexp_extract_all(l, '{WORD}')) AS n,
  regexp_replace(regexp_replace(lower(trim(l, {_TRIM})), '[0-9]+', '0', 'g'), '{BLANK}+', ' ', 'g') AS norm FROM lines WHERE regexp_matches(l, '{WORD}')),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM full_lines GROUP BY 1),
host AS (SELECT source, greatest({quality.MIN_DOCS}e0, count(*) * {quality.MAX_SHARE}e0) AS most FROM d GROUP BY 1),
often AS (SELECT f.source, norm FROM full_lines f JOIN host h ON f.source IS NOT DISTINCT FROM h.source GROUP BY f.source, norm, most HAVING count(DISTINCT rid) > greatest(most, {quality.MIN_DOCS})),
lost AS (SELECT rid, sum(n)::BIGINT AS n FROM full_lines f JOIN often o ON f.source IS NOT DISTINCT FROM o.source AND f.norm = o.norm GROUP BY 1),
m AS (SELECT d.doc_id, len(regexp_extract_all(t, '{WORD}'))::BIGINT AS n_words, length(regexp_replace(t, '{BLANK}+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS n_lost
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN hit USING (rid) LEFT JOIN lost USING (rid)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_lost >= {quality.MIN_LEFT}e0 * n_words AS kept FROM f
"""

OP7 = rf"""
WITH RECURSIVE words AS (SELECT doc_id AS rid, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM documents)),
sh AS (SELECT DISTINCT rid, s FROM (SELECT rid, {_windows(4)} AS s FROM words WHERE n >= 4 UNION ALL SELECT rid, string_agg(w, ' ' ORDER BY i) FROM words WHERE n < 4 GROUP BY 1) WHERE s IS NOT NULL),
size AS (SELECT rid, count(*) AS n FROM sh GROUP BY 1),
inter AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, c.m AS component_id
FROM documents d LEFT JOIN size ON size.rid = d.doc_id JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) c ON c.a = d.doc_id
"""

_NORM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = rf"""
WITH iw AS (SELECT item_id AS rid, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM (SELECT item_id, {_NORM} AS ws FROM benchmark)),
items AS (SELECT DISTINCT rid AS item_id, 10 AS size, s FROM (SELECT rid, {_windows(10)} AS s FROM iw WHERE n >= 10) WHERE s IS NOT NULL
  UNION ALL SELECT rid, n, string_agg(w, ' ' ORDER BY i) FROM iw WHERE n < 10 GROUP BY rid, n),
docs AS (SELECT doc_id, {_NORM} AS ws FROM documents),
dw AS (SELECT doc_id AS rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
win AS ({" UNION ALL ".join(f"SELECT rid, i, {n} AS size, {_windows(n)} AS s FROM dw WHERE {n} IN (SELECT size FROM items)" for n in range(1, 11))}),
found AS (SELECT win.rid, win.i, size, item_id FROM win JOIN items USING (size, s)),
hits AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
ids AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits ON hits.rid = doc_id LEFT JOIN ids ON ids.rid = doc_id
"""
