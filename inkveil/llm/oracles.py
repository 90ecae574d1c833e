"""DuckDB SQL for the queries that SQL can express."""

_WORDS = "list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, {_WORDS} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM d),
g AS (SELECT *, CASE WHEN len(words) < 8 THEN [] ELSE list_transform(range(1, len(words) - 6), lambda i: hash(list_slice(words, i, i + 7))) END AS win FROM w),
u AS (SELECT doc_id, unnest(win) AS h, generate_subscripts(win, 1) AS i FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM u) WHERE c > 1),
v AS (SELECT doc_id, sum(least(8, i - coalesce(prev, i - 8)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(words)::BIGINT AS n_words,
  length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM g LEFT JOIN v USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM b GROUP BY source),
p AS (SELECT least(greatest(sum(f) / sum(n), 1e-4), 1 - 1e-4) AS mean, var_pop(f / n) AS spread, avg(1 / n) AS inverse FROM h),
s AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * inverse, 1e-6) - 1, 1.0), 1e4) AS strength FROM p),
q AS (SELECT source, mean * strength + f AS a, (1 - mean) * strength + n - f AS bb FROM h, s),
x AS (SELECT source, a / (a + bb) - 2.0 * sqrt(a * bb / ((a + bb) * (a + bb) * (a + bb + 1))) > 0.5 AS bad FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT x.bad AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

IMPORTANCE = r"""
WITH RECURSIVE crc(i, k, c) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS entries FROM crc WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS row, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM texts),
used AS (SELECT row, side, unnest(words) AS word FROM numbered),
spelt AS (SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT word FROM used)),
hashed AS (SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM spelt, crc_table),
counted AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM used JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain FROM counted, totals),
weighed AS (SELECT row, sum(gain)::BIGINT AS weight FROM used JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM numbered LEFT JOIN weighed USING (row) WHERE side = 'd'),
able AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (row)
"""
