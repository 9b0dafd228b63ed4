"""DuckDB SQL of the contracts that SQL can express; the other queries are tested against brute force."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

OP4 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS pos, ws FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 34], ' ') AS key FROM i),
twice AS (SELECT doc_id, pos FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(35)) AS pos FROM twice),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT words.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS t
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP5 = f"""
WITH p AS (SELECT page_id, {LOWER.format(x="regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rule, rh, rp, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT p.*, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC NULLS LAST, length(rp) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1"""

OP7 = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
k AS (SELECT *, {LOWER.format(x=f"trim(line, {BLANKS})")} AS key FROM u),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, top IS NOT NULL AND top <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY 1"""

OP10 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS pos, ws FROM w WHERE len(ws) >= 5),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, array_to_string(ws[pos:pos + 4], ' ') AS key FROM i) QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1),
rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
f AS (SELECT w.doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      coalesce(lines.n - d, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines
    OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) < 7 * n_words
    OR 10 * length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) > 6 * length(regexp_replace(t, '\P{{L}}+', '', 'g'))
    OR 10 * len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) > 3 * n_words) AS kept FROM b"""


def _op11(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after another: cN are the centroids, aN each vector's nearest of cN."""
    out = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS k, e FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        out.append(f"""a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(ve) AS e, min((d, k)) AS best FROM (
        SELECT v.r, v.vec_id, v.e AS ve, c.k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS d FROM v, c{n} c) GROUP BY r)""")
        if n < rounds:
            out.append(f"""c{n + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.e, o.e) AS e FROM c{n} o LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM (
        SELECT a.best[2] AS k, i, sum(a.e[i]) AS s, count(*) AS n FROM a{n} a, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY k) m USING (k))""")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, best[2] AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.k = best[2]"""


def _least(*of: str) -> str:
    return f"list_min([{', '.join(of)}])"


def _edit(state: str, cost: str, letter: str, when: str = "true") -> str:
    return f"{{'c': {state}.c + CASE WHEN {when} THEN {cost} ELSE 1000000000 END, 'p': {state}.p || '{letter}'}}"


#: The Viterbi search as a recursion over a conversation's rows; e, s, u, a are the grammar's states with least cost and audit.
OP13 = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b, t FROM conversations, t),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS how FROM h),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM c JOIN (VALUES (0), (1)) k(k) ON k = 0 OR how = 3 WHERE how <> 0),
n AS MATERIALIZED (SELECT *, rtrim(text, {BLANKS}) AS said, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), nth) AS i FROM n),
g AS MATERIALIZED (SELECT conv_id, i, turn, role, text, left(role, 1) AS r, said = '' AS blank, said <> '' AND nth > 1 AS dup, said <> '' AND nth = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS cut,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
m AS (SELECT DISTINCT conv_id FROM conversations),
v(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'p': ''}}, {{'c': 1000000000::BIGINT, 'p': ''}}, {{'c': 2::BIGINT, 'p': 'I'}}, {{'c': 4::BIGINT, 'p': 'II'}} FROM m
  UNION ALL
  SELECT conv_id, i, e, s, u, {_least("a", _edit("u", "2", "I"))} FROM (SELECT conv_id, i, e, s, {_least("u", _edit("e", "2", "I"), _edit("s", "2", "I"), _edit("a", "2", "I"))} AS u, a FROM (
    SELECT v.conv_id, g.i, {_edit("e", "3", "D")} AS e,
      {_least(_edit("s", "3", "D"), _edit("e", "cut::BIGINT", "K", "ok AND r = 's'"))} AS s,
      {_least(_edit("u", "3", "D"), *[_edit(x, "cut::BIGINT", "K", "ok AND r = 'u'") for x in "esa"], *[_edit(x, "2 + cut::BIGINT", "R", "ok") for x in "esa"])} AS u,
      {_least(_edit("a", "3", "D"), _edit("u", "cut::BIGINT", "K", "ok AND r = 'a'"), _edit("u", "2 + cut::BIGINT", "R", "ok"))} AS a
    FROM v JOIN (SELECT *, NOT (blank OR dup) AS ok FROM g) g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i + 1))),
best AS (SELECT conv_id, {_least("e", "a")} AS b FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
edits AS (SELECT conv_id, j, edit, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w AS place, sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id) AS n
          FROM (SELECT conv_id, unnest(string_split(b.p, '')) AS edit, unnest(range(length(b.p))) AS j FROM best) WHERE edit <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lines AS (SELECT x.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - 1 - n % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body
          FROM edits x LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.i = x.i WHERE edit <> 'D' GROUP BY 1),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
          count(*) FILTER (WHERE before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
SELECT m.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.p AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM m LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM m.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": OP3, "op4_substring_dedup": OP4, "op5_url_filter": OP5, "op7_line_dedup": OP7, "op10_quality_rules": OP10, "op11_centroid_clustering": _op11(), "op13_conversation_repair": OP13}
