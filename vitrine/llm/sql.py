"""DuckDB SQL of the queries that SQL can express."""
from __future__ import annotations

OP8 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""

#: Targets by trying every number of limited sources and taking the one whose level fits.
OP7 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), levels AS (
  SELECT a.source, (1.5 * (SELECT sum(source_size) FROM s)
          - coalesce(sum(2.0 * b.source_size) FILTER (b.source_size / b.weight < a.source_size / a.weight), 0))
         / sum(b.weight) FILTER (b.source_size / b.weight >= a.source_size / a.weight) AS level
  FROM s a, s b GROUP BY a.source
), t AS (
  SELECT source, source_size, least(2.0 * source_size, weight * (SELECT max(level) FROM levels)) AS target FROM s
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size::BIGINT AS source_size, t.target::DOUBLE AS target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0
    ELSE greatest(0, least(2, ceil((target - (start + size / 2.0)) / source_size)))::INT END AS copies FROM p
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM c
"""

#: Quoted lines and passages are compared as texts; the latest earlier message that says one is its source.
OP6 = r"""
WITH m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, 'user') AS role, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM conversations
), d AS (
  SELECT *, list_transform(lines, lambda x: len(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+'), '[^>]', '', 'g'))) AS depths FROM m
), o AS (
  SELECT *, list_filter(lines, lambda x, i: depths[i] = 0 AND NOT (
      regexp_matches(x, '^.*(?:wrote|writes|schrieb|écrit|escribió) ?:[ \t]*$') AND coalesce(depths[i + 1], 0) > 0)) AS own
  FROM d
), l AS (
  SELECT id, conv_id, turn, depths[i] AS depth, i,
         regexp_replace(regexp_replace(lines[i], '^(?:[ \t]*>)+', ''), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS body
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)
), runs AS (
  SELECT *, sum(changed) OVER (PARTITION BY id ORDER BY i) AS passage FROM (
    SELECT *, (depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY id ORDER BY i))::INT AS changed FROM l)
), quoted AS (
  SELECT DISTINCT conv_id, turn, passage, depth, trim(regexp_replace(lower(t), '[ \t\r\n]+', ' ', 'g')) AS key FROM (
    SELECT conv_id, turn, passage, depth, body AS t FROM runs WHERE depth > 0
    UNION ALL
    SELECT conv_id, turn, passage, depth, string_agg(body, chr(10) ORDER BY i) FROM runs WHERE depth > 0 GROUP BY id, conv_id, turn, passage, depth)
), said AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(t), '[ \t\r\n]+', ' ', 'g')) AS key FROM (
    SELECT conv_id, turn, unnest(own) AS t FROM o UNION ALL SELECT conv_id, turn, array_to_string(own, chr(10)) FROM o)
), links AS (
  SELECT conv_id, turn, passage, depth, source_turn, sum(len(key)) AS total FROM (
    SELECT q.conv_id, q.turn, q.passage, q.depth, q.key, max(s.turn) AS source_turn
    FROM quoted q JOIN said s ON q.conv_id = s.conv_id AND q.key = s.key AND s.turn < q.turn
    WHERE q.key <> '' GROUP BY ALL)
  GROUP BY ALL
), best AS (
  SELECT conv_id, turn, passage, depth, max({'n': total, 't': source_turn}).t AS source_turn FROM links GROUP BY ALL
), replies AS (
  SELECT conv_id, turn, arg_min(source_turn, {'d': depth, 'p': passage}) AS source_turn, count(*) AS n FROM best GROUP BY ALL
), turns AS (
  SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
  FROM (SELECT DISTINCT conv_id, turn FROM m)
), c AS (
  SELECT o.*, regexp_replace(array_to_string(own, chr(10)), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS content FROM o
)
SELECT c.conv_id, c.turn, c.role, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.id) AS position,
       coalesce(r.source_turn, t.previous) AS reply_to, coalesce(r.n, 0) AS n_quotes, c.content,
       '<|' || c.role || '|>' || chr(10) || c.content || chr(10) || '<|end|>' || chr(10) AS rendered
FROM c JOIN turns t USING (conv_id, turn) LEFT JOIN replies r USING (conv_id, turn)
"""

#: What stands in the article element, where the given pages keep their main text.
OP3 = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS x FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(h1|p|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a
), c AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(39|x27);', chr(39), 'g'), '&amp;?', '&', 'g') AS x
  FROM b
), d AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""

#: A word goes if one of the windows that end at it or up to 12 words later is known from an earlier document.
OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), k AS (
  SELECT doc_id, i, word, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS key
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), known AS (
  SELECT doc_id, i, word, n = 13 AND min(doc_id) FILTER (n = 13) OVER (PARTITION BY key) < doc_id AS known FROM k
), gone AS (
  SELECT doc_id, i, word, bool_or(known) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM known
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM gone GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: All pairs that share a shingle, counted; then the smallest id that links reach.
OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), w AS (
  SELECT doc_id, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), k AS (
  SELECT doc_id, n_words, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS key, i
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
), s AS (
  SELECT DISTINCT doc_id, key FROM k WHERE n = 4 OR (n_words < 4 AND i = 1)
), sizes AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.key = y.key AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n >= 85 * (p.size + q.size - n)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM sides
  UNION
  SELECT reach.doc_id, sides.b FROM reach JOIN sides ON sides.a = reach.other
)
SELECT d.doc_id, coalesce(sizes.size, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes: a fold over its hexadecimal digits, of each byte the low one first."""
    steps = [n for n in range(16)]
    for _ in range(4):
        steps = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in steps]
    digits = f"hex(encode({text}))"
    values = f"list_transform(range(0, len({digits})), lambda i: (instr('0123456789ABCDEF', {digits}[(i + 2 - i % 2 * 2)::INT]) - 1)::BIGINT)"
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, x: xor(c >> 4, {steps}[(xor(c, x) & 15) + 1]))"
    return f"xor({fold}, 4294967295)"


#: Runs counted by document, then words; near words by what is left without each of their symbols.
OP11 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), d AS (
  SELECT *, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM w GROUP BY ALL)
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM d)
  GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5
), p AS (
  SELECT word, n, left(word, i - 1) AS pre, substr(word, i + 1) AS post FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.pre = b.pre AND a.post = b.post AND a.word <> b.word
  UNION SELECT p.word, v.word, v.n FROM p JOIN v ON v.word = p.pre || p.post
  UNION SELECT v.word, p.word, p.n FROM p JOIN v ON v.word = p.pre || p.post
), best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)
), follow AS (
  SELECT word, word AS at FROM f UNION ALL SELECT follow.word, f.form FROM follow JOIN f ON f.word = follow.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, follow.at AS root, f.n, f.n_near, f.form_n FROM f JOIN follow USING (word) JOIN f AS l ON l.word = follow.at WHERE l.form IS NULL
"""

#: Every prefix of every rebuilt conversation; the ancestors of a node are the prefixes of its smallest conversation.
OP13 = rf"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS tie
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, list(struct_pack(key := sha256(length(role)::VARCHAR || ':' || role || text), chars := length(text)) ORDER BY turn NULLS FIRST, role, tie) AS own
  FROM t GROUP BY c
), h AS (SELECT *, {_crc32("c::VARCHAR")} % 6 AS h FROM o),
b AS (SELECT h.c, list_concat(coalesce(base.own, [])[1:h.h], h.own[h.h + 1:]) AS path FROM h LEFT JOIN o base ON base.c = h.c - h.c % 100),
r AS (
  SELECT c, len(path) AS size, d AS depth, array_to_string(list_transform(path[1:d], lambda x: x.key), '') AS key,
         array_to_string(list_transform(path[1:d - 1], lambda x: x.key), '') AS above, coalesce(path[d].chars, 0) AS chars
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM b)
), n AS (
  SELECT key, min(c) AS conv_id, min(depth) AS depth, min(above) AS above, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = size), '')) AS ends_sha256
  FROM r GROUP BY key
), k AS (SELECT above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
s AS (
  SELECT r.key, count(*) FILTER (n.key NOT IN (SELECT above FROM k)) AS n_leaves, sum(n.own)::BIGINT AS saved_tokens
  FROM n JOIN r ON r.c = n.conv_id AND r.depth <= n.depth GROUP BY r.key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (key) LEFT JOIN k ON k.above = n.key LEFT JOIN n p ON p.key = n.above AND n.depth > 0
"""

SQL: dict[str, str] = {"op1_substring_dedup": OP1, "op2_ngram_join": OP2, "op3_main_text": OP3, "op6_quotation_links": OP6, "op7_mix_sources": OP7, "op8_exact_dedup": OP8, "op11_spelling_forms": OP11, "op13_turn_trie": OP13}
