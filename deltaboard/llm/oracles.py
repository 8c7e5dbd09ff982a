"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

# The rules of op7: base counts, then the lines that more than max(5, a tenth) of a host's distinct texts have.
QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, text, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT r, list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS words FROM d
), g AS (
  SELECT r, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS spot FROM twice) GROUP BY r
), lines AS (
  SELECT r, line, place FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS place FROM d)
), normal AS (
  SELECT l.r, l.place, l.line, trim(regexp_replace(translate(lower(line), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' +', ' ', 'g'), ' ') AS norm
  FROM lines l
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM normal WHERE norm <> '' GROUP BY r
), host_docs AS (
  SELECT host, count(DISTINCT text) AS docs FROM d WHERE text IS NOT NULL GROUP BY host
), common AS (
  SELECT d.host, norm FROM normal JOIN d USING (r) JOIN host_docs h ON h.host = d.host
  WHERE norm <> '' AND d.text IS NOT NULL
  GROUP BY d.host, norm, h.docs HAVING count(DISTINCT d.text) > 5 AND count(DISTINCT d.text) > h.docs * 0.1
), lost AS (
  SELECT n.r, sum(len(list_filter(string_split(n.norm, ' '), lambda x: x <> ''))) AS words
  FROM normal n JOIN d USING (r) JOIN common c ON c.host = d.host AND c.norm = n.norm GROUP BY n.r
), counts AS (
  SELECT d.doc_id, len(w.words)::BIGINT AS n_words,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lost.words, 0) AS lost
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, (n_words - lost)::BIGINT AS n_words_left FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words_left >= 20 AND 2 * n_words_left >= n_words AS kept, n_words_left
FROM judged
"""

# The phrases of op13: every phrase of 1 to 4 words is counted, then the candidates are cut, dropped and ranked.
PHRASES = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz ') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), q AS (
  SELECT lang, row_number() OVER () AS k, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM p
), w AS (
  SELECT lang, k, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM q
), g AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY k ORDER BY pos)
), f AS (
  SELECT lang, phrase, size, count(*) AS f FROM (
    SELECT lang, w1 AS phrase, 1 AS size FROM g
    UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM g WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM g WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM g WHERE w4 IS NOT NULL
  ) GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), enough AS (
  SELECT * FROM f WHERE f >= 30
), c AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM enough WHERE size > 1
), around AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, array_to_string(ws[i:i + short - 1], ' ') AS part
    FROM (SELECT lang, a, ws, short, unnest(range(1, size - short + 2)) AS i FROM c, (VALUES (2), (3)) AS s(short) WHERE short < size)
  ) GROUP BY ALL
), sides AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), cut AS (
  SELECT s.lang, s.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM sides s JOIN enough x ON x.lang = s.lang AND x.phrase = head JOIN enough y ON y.lang = s.lang AND y.phrase = tail
), worst AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cut
), best AS (
  SELECT w.lang, w.phrase, a, l, r, score::BIGINT AS score
  FROM worst w LEFT JOIN around o ON o.lang = w.lang AND o.part = w.phrase
  WHERE place = 1 AND (most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

# The repair of op12: crc32 by its table, the damage, and the cheapest audit by whole strings, one row of all conversations a step.
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
REPAIR = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) AS b(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), groups AS (
  SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)
), keyed AS (
  SELECT g, row_number() OVER () AS id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS letters
  FROM conversations c JOIN groups x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
), crc AS (
  SELECT keyed.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(letters, lambda a: ascii(a)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS hurt FROM keyed, tab
), d AS (
  SELECT g, id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role,
    CASE hurt WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN hurt = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc WHERE hurt <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text), id, copy) AS i,
    row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, id, copy) AS nth FROM d
), f AS (
  SELECT *, substr(role, 1, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '-' ELSE 't' END AS fault FROM o
), pairs AS (
  SELECT g, count(*) AS illegal FROM (SELECT g, lag(c) OVER (PARTITION BY g ORDER BY i) || c AS two, i FROM f) WHERE i > 1 AND two NOT IN ('su', 'ua', 'au') GROUP BY g
), counts AS (
  SELECT g, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM f GROUP BY g
), ins(s, t, cost, edits, lines) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', 'user:' || chr(10)), (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    (1, 1, 0, '', ''), (1, 2, 2, 'I', 'user:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    (2, 2, 0, '', ''), (2, 3, 2, 'I', 'assistant:' || chr(10)), (3, 3, 0, '', ''), (3, 2, 2, 'I', 'user:' || chr(10))
), act(s, t, kind, c, cost) AS (
  VALUES (0, 0, 'D', '', 3), (1, 1, 'D', '', 3), (2, 2, 'D', '', 3), (3, 3, 'D', '', 3),
    (0, 2, 'R', '', 2), (1, 2, 'R', '', 2), (2, 3, 'R', '', 2), (3, 2, 'R', '', 2),
    (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0), (3, 2, 'K', 'u', 0)
), walk AS (
  SELECT g, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS body FROM groups
  UNION ALL
  SELECT g, i, t, min(way).cost, min(way).audit, arg_min(body, way) FROM (
    SELECT w.g, f.i, e.t, {'cost': (w.cost + n.cost + e.cost + CASE WHEN f.fault = 't' AND e.kind <> 'D' THEN 1 ELSE 0 END)::BIGINT, 'audit': w.audit || n.edits || e.kind} AS way,
      w.body || n.lines || CASE e.kind WHEN 'K' THEN f.role || ':' || f.text || chr(10) WHEN 'R' THEN CASE e.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) ELSE '' END AS body
    FROM walk w JOIN f ON f.g = w.g AND f.i = w.i + 1 JOIN ins n ON n.s = w.s
      JOIN act e ON e.s = n.t AND (e.kind = 'D' OR (f.fault NOT IN ('b', 'd') AND (e.kind = 'R' OR e.c = f.c)))
  ) GROUP BY g, i, t
), last AS (
  SELECT g, min(way).cost AS cost, min(way).audit AS audit, arg_min(body, way) AS body FROM (
    SELECT w.g, {'cost': (w.cost + n.cost)::BIGINT, 'audit': w.audit || n.edits} AS way, w.body || n.lines AS body
    FROM walk w JOIN ins n ON n.s = w.s AND n.t IN (0, 3) LEFT JOIN counts c ON c.g = w.g WHERE w.i = coalesce(c.n, 0)
  ) GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit,
  sha256(CASE WHEN body = '' THEN '' ELSE left(body, length(body) - 1) END) AS repaired_sha256
FROM groups JOIN last USING (g) LEFT JOIN counts USING (g) LEFT JOIN pairs USING (g)
"""


def all_sql() -> dict[str, str]:
    return {"op7_quality_rules": QUALITY, "op12_conversations": REPAIR, "op13_phrases": PHRASES}
