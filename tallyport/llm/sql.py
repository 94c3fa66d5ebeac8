"""SQL (DuckDB) that gives the rows of the registered queries that SQL can express on whole tables."""

from __future__ import annotations

from . import debruijn, embeddings, quality_rules
from .shared import WORD

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {embeddings.MIN_COSINE}),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON a = vec_id"""

WORD_SPANS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {debruijn.WINDOW - 1})) AS p FROM w WHERE len(ws) >= {debruijn.WINDOW}),
u AS (SELECT doc_id, p, array_to_string(ws[p : p + {debruijn.WINDOW - 1}], ' ') AS s FROM p),
c AS (SELECT s FROM u GROUP BY s HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, p + k AS q FROM u SEMI JOIN c USING (s), range({debruijn.WINDOW}) t(k)),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS q FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS kept FROM a ANTI JOIN g USING (doc_id, q) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


def _quality_rules() -> str:
    classes = {n: p.rstrip("+") for n, p in quality_rules.CLASSES.items()}
    common = ", ".join(f"('{lang}', {i}, '{form}')" for lang, words in quality_rules.COMMON_WORDS.items() for i, w in enumerate(words) for form in (w, w.capitalize()))
    most = max(map(len, quality_rules.COMMON_WORDS.values()))
    counts = ", ".join(f"length(text) - length(regexp_replace(text, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS c_{n}" for n, p in classes.items())
    chars = " UNION ALL ".join(f"SELECT doc_id, lang, base_failed, n_words, n_chars, 'c' AS kind, '{n}' AS bin, c_{n} AS c FROM f" for n in classes)
    rest = f"SELECT doc_id, lang, base_failed, n_words, n_chars, 'c', 'rest', n_chars - ({' + '.join(f'c_{n}' for n in classes)}) FROM f"
    words = f"""SELECT doc_id, lang, base_failed, n_words, n_chars, 'w', CAST(i AS VARCHAR), coalesce(x.n, 0) FROM f CROSS JOIN range({most}) t(i) LEFT JOIN x USING (doc_id, i)
UNION ALL SELECT doc_id, lang, base_failed, n_words, n_chars, 'w', 'rest', n_words - coalesce((SELECT sum(n) FROM x WHERE x.doc_id = f.doc_id), 0) FROM f"""
    q = quality_rules
    return f"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {q.WINDOW - 1})) AS p FROM w WHERE len(ws) >= {q.WINDOW}),
u AS (SELECT doc_id, p, ws[p : p + {q.WINDOW - 1}] AS g FROM p),
again AS (SELECT doc_id, g FROM u GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM u JOIN again USING (doc_id, g), range({q.WINDOW}) t(k) GROUP BY 1),
base AS (SELECT w.doc_id, lang, text, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(text) - length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS blanks,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, length(text) AS n_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {counts} FROM base),
common(lang, i, word) AS (VALUES {common}),
x AS (SELECT doc_id, i, count(*) AS n FROM (SELECT doc_id, lang, unnest(ws) AS word FROM base) JOIN common USING (lang, word) GROUP BY 1, 2),
h AS ({chars} UNION ALL {rest} UNION ALL {words}),
ref AS (SELECT lang, kind, bin, sum(c) / sum(sum(c)) OVER (PARTITION BY lang, kind) AS q FROM h WHERE NOT base_failed AND lang IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN a > 0 THEN a * log2(2 * a / (a + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (a + q)) ELSE 0 END) / 2, 0)) AS d
    FROM (SELECT *, c / nullif(sum(c) OVER (PARTITION BY doc_id, kind), 0) AS a FROM h) JOIN ref USING (lang, kind, bin) GROUP BY 1, 2),
far AS (SELECT DISTINCT doc_id FROM s JOIN f USING (doc_id) WHERE (kind = 'c' AND n_chars >= {q.MIN_CHARS} AND d > {q.MAX_CHAR_DISTANCE}) OR (kind = 'w' AND n_words >= {q.MIN_WORDS} AND d > {q.MAX_WORD_DISTANCE}))
SELECT doc_id, n_words, CAST(n_chars - blanks AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM far) AS kept FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op1_cross_polytope": EMBEDDINGS, "op5_quality_rules": _quality_rules(), "op8_debruijn": WORD_SPANS}
