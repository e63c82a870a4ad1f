"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _shingles(n: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return (
        f"list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {n} THEN [array_to_string(w, ' ')] "
        f"ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: {joined}) END)"
    )


NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOW)} AS w FROM documents), s AS (SELECT doc_id, {_shingles(4)} AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS t FROM s), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * k >= 85 * (len(a.s) + len(b.s) - k)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links), reach(n, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.n),
least_id AS (SELECT n, min(c) AS c FROM reach GROUP BY n)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN least_id ON n = doc_id"""

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, k, line, {_words(_LOW.replace('text', 'line'))} AS w FROM l), s AS (SELECT doc_id, k, line, {_shingles(5)} AS s FROM w),
first_of AS (SELECT list_sort(s) AS f, min((doc_id, k)) AS place, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY 1), e AS (SELECT place, len(s) AS n, unnest(s) AS t FROM first_of),
p AS (SELECT a.place AS x, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND b.place < a.place GROUP BY a.place, b.place),
gone AS (SELECT DISTINCT x FROM p WHERE 100 * c >= 80 * (na + nb - c)),
lost AS (SELECT s.doc_id, s.k FROM s JOIN first_of f ON f.f = list_sort(s.s) LEFT JOIN gone g ON g.x = f.place WHERE len(s.s) > 0 AND (g.x IS NOT NULL OR f.place <> (s.doc_id, s.k))),
left_over AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.k) FILTER (WHERE lost.k IS NULL) AS text, count(*) AS n_lines, count(lost.k) AS n_removed FROM l LEFT JOIN lost ON lost.doc_id = l.doc_id AND lost.k = l.k GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed FROM documents d LEFT JOIN left_over o ON o.doc_id = d.doc_id"""

_ODD = "'\\### Assistant: </turn> ok'"
_ESC = "replace(replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '#', '\\h'), ':', '\\c')"
_NEXT = "CASE WHEN state = 'start' AND role = 'system' THEN 'ready' WHEN state IN ('start', 'ready') AND role = 'user' THEN 'asked' WHEN state = 'asked' AND role = 'assistant' THEN 'ready' END"

CHAT_FORMAT = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_ODD} UNION ALL SELECT -7, 1, 'assistant', {_ODD}),
n AS (SELECT *, {_ESC.format('role')} AS r, {_ESC.format('text')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, {_ESC.format('text')}) AS k FROM c),
walk(conv_id, k, state, bad) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'start', CAST(0 AS BIGINT) FROM n
  UNION ALL SELECT n.conv_id, n.k, coalesce({_NEXT}, state), CASE WHEN ({_NEXT}) IS NULL AND bad = 0 THEN n.k ELSE bad END FROM walk w JOIN n ON n.conv_id = w.conv_id AND n.k = w.k + 1),
ends AS (SELECT conv_id, max(bad) AS bad FROM walk GROUP BY 1)
SELECT n.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(4 + length(r) + 2 + length(x) + 8) AS BIGINT) AS formatted_chars, any_value(bad) = 0 AS valid, CAST(any_value(bad) AS INTEGER) AS first_error
FROM n JOIN ends USING (conv_id) GROUP BY n.conv_id"""
