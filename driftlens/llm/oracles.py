"""DuckDB statements for the queries that SQL can express; every threshold is spelled out here once more."""

from __future__ import annotations

WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, url,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _shingles(table: str, key: str) -> str:
    """Distinct five-word shingles; shorter texts have one of all their words."""
    return (
        f"SELECT DISTINCT {key}, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM"
        f" (SELECT {key}, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {table}) WHERE len(w) > 0)"
    )


LEAKS = f"""
WITH q AS ({_shingles('benchmark', 'item_id')}),
ks AS (SELECT DISTINCT k FROM q),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
d AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM q JOIN d ON q.k = d.k AND q.s = d.s GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""


#: Function words of four languages, lower case.
_STOP = (
    "the of and to in is that it for was with as on be at by this from or an are not have but his her they "
    "le la les de des du et un une est que qui dans pour sur par au aux en il elle ne pas se avec "
    "der die das und ist den von zu mit sich auf für nicht ein eine dem im auch als an bei nach "
    "el los las y por con para es una su al lo como más del no"
)
QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_bangs,
  CAST(len(list_filter(w, lambda x: list_contains(string_split('{_STOP}', ' '), lower(x)) AND x IN (lower(x), upper(x), concat(upper(x[1]), lower(x[2:]))))) AS BIGINT) AS n_stop_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words >= 20 AND word_chars BETWEEN 2.5 * n_words AND 12 * n_words AND n_symbols <= 0.1 * n_words AND n_bangs <= 0.25 * n_words
  AND n_stop_words >= 0.03 * n_words AND n_dup_lines <= 0.35 * n_lines AND n_repeat_words <= 0.3 * n_words AS kept FROM b
"""

ORACLE_SQL = {"op1_warc_archive": WARC, "op8_benchmark_leaks": LEAKS, "op10_quality_rules": QUALITY}
