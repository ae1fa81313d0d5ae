"""DuckDB SQL for the text operators that SQL can express over whole tables."""

from __future__ import annotations

from .chat import ROTATED_SQL
from .lexical import SEARCH_SQL
from .negatives import NEGATIVES_SQL
from .secrets import RULES

#: Windows of 35 words that occur twice, and what is left without their words.
REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT rid, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35
), k AS (
  SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS m FROM w
), r AS (
  SELECT rid, i FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)
), g AS (
  SELECT rid, list(i ORDER BY i) AS starts FROM r GROUP BY rid
), m AS (
  SELECT rid, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 35)))) AS gone FROM g
), b AS (
  SELECT rid, map(gone, list_transform(gone, lambda x: true)) AS gone FROM m
), o AS (
  SELECT doc_id, len(ws) AS n_words, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, j: gone[j] IS NULL) END AS kept FROM d LEFT JOIN b USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
"""


def scan_sql() -> str:
    """Matches of each rule from left to right; places from the lengths of the pieces between them."""
    each = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        each.append(
            f"SELECT rid, {k} AS kno, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')"
        )
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({' UNION ALL '.join(each)}),
y AS (SELECT rid, kno, kind, least, unnest(range(1, len(m) + 1)) AS j, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g FROM x),
z AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid, kno ORDER BY j) AS BIGINT) AS stop FROM y),
s AS (SELECT rid, kno, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM z WHERE length(v) >= least),
a AS (SELECT rid, count(*) FILTER (kno = 0) AS n_assign, count(*) FILTER (kno = 1) AS n_access, count(*) FILTER (kno = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kno) FILTER (kno < 3) AS base, string_agg(span, ',' ORDER BY start, kno) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


ORACLES = {"op6_substring": REPEATS_SQL, "op8_chat": ROTATED_SQL, "op10_secrets": scan_sql(), "op12_hard_negatives": NEGATIVES_SQL, "op13_search": SEARCH_SQL}
