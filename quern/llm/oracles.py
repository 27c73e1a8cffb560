"""SQL (of DuckDB) for the corpus queries that SQL can express, over the whole tables."""

from __future__ import annotations

from quern.llm import collocations, quality, suffix_family, url_filter, vector_codes

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _base32(hex_: str) -> str:
    """Base32 of 40 hex digits: 5 of them are 4 characters."""
    five = [f"CAST('0x' || substr({hex_}, {5 * i + 1}, 5) AS BIGINT)" for i in range(8)]
    return " || ".join(f"substr('{_UP}234567', (({v} >> {s}) & 31)::INT + 1, 1)" for v in five for s in (15, 10, 5, 0))


OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_base32('x')} AS payload_digest,
    CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM d
"""

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), {_WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT x, y FROM both_ways UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON reach.b = both_ways.x),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""

OP5 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late),
cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1),
kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(ps), 0) AS r,
    CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END AS left_ FROM w LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(left_, ' ')) AS kept_sha256 FROM kept
"""

OP10 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM w),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.c, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_letterless, len(list_distinct(ws)) AS n_distinct
    FROM w JOIN lines USING (doc_id) LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR word_chars > {quality.MAX_MEAN_WORD} * n_words OR 100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * word_chars
        OR (n_dup_lines >= {quality.MIN_DUP_LINES} AND 100 * n_dup_lines > {quality.MAX_DUP_LINE_PERCENT} * n_lines)
        OR 100 * n_letterless > {quality.MAX_LETTERLESS_PERCENT} * n_words OR 4 * n_distinct * n_distinct < {quality.MIN_DISTINCT_ROOTS**2} * n_words) AS kept FROM b
"""

ORACLES = {
    "op1_warc": OP1,
    "op2_minhash_dedup": OP2,
    "op5_substring_dedup": OP5,
    "op6_url_filter": url_filter.oracle(),
    "op10_quality": OP10,
    "op11_vector_codes": vector_codes.oracle(),
    "op12_collocations": collocations.oracle(),
    "op13_suffix_dedup": suffix_family.oracle(),
}
