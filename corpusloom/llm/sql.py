"""The SQL that gives the rows of the queries, where SQL can express them."""

from __future__ import annotations

from corpusloom.llm.centroids import CLUSTERS, COMPONENTS, ROUNDS, SCALE, SEED
from corpusloom.llm.quality import LEAST_WORDS, MOST_REPEATED_PERCENT, RULES, STOP_WORDS
from corpusloom.llm.sharding import ROW_COST, SHARDS

OP3 = r"""
WITH p AS (
  SELECT page_id, url, '"' || md5(html) || '"' AS tag, md5(html) AS digest, length(html) AS size,
    1700000000 + page_id * 60 AS t0, regexp_replace(url, '^https?://', '') AS host
  FROM pages),
c AS (
  SELECT page_id * 8 AS record_id, url, t0 AS captured, FALSE AS asks, tag, digest, size FROM p
  UNION ALL SELECT page_id * 8 + 1, url, t0 + 500000, FALSE, tag, digest, size FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT page_id * 8 + 2, 'HTTP://WWW.' || host, t0 + 400000, TRUE, 'W/' || tag, digest, 0 FROM p
  UNION ALL SELECT page_id * 8 + 3, url || '#later', t0 + 900000, TRUE, tag, NULL, 0 FROM p
  UNION ALL SELECT page_id * 8 + 4, url, t0 + 900001, TRUE, '"other"', NULL, 0 FROM p WHERE page_id % 5 = 0
  UNION ALL SELECT page_id * 8 + 5, url, t0 - 1, TRUE, tag, digest, 0 FROM p WHERE page_id % 7 = 0
  UNION ALL SELECT page_id * 8 + 6, url, t0 + 900002, TRUE, NULL, NULL, 0 FROM p WHERE page_id % 11 = 0),
bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') AS u FROM c),
parts AS (
  SELECT *, regexp_replace(regexp_replace(
      translate(regexp_extract(u, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      ':(80|443)$', ''), '^www\.', '') AS h,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'),
      lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^(utm_[a-z]*|fbclid|gclid|ref|sessionid)(=|$)'))), '&') AS q
  FROM bare),
k AS (SELECT *, h || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM parts),
found AS (
  SELECT *, last_value(CASE WHEN NOT asks THEN {'id': record_id, 'captured': captured, 'tag': tag,
      'digest': digest, 'size': size} END IGNORE NULLS) OVER (
    PARTITION BY canonical ORDER BY captured, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
  FROM k),
judged AS (
  SELECT *, CASE WHEN l IS NULL THEN 'missing'
      WHEN (tag IS NOT NULL AND replace(tag, 'W/', '') <> l.tag) OR (digest IS NOT NULL AND digest <> l.digest)
        THEN 'mismatch'
      WHEN tag IS NULL AND digest IS NULL THEN 'no_validator' ELSE 'resolved' END AS state
  FROM found WHERE asks)
SELECT record_id, canonical, captured, state,
  CASE WHEN state IN ('resolved', 'no_validator') THEN l.id END AS refers_to,
  CASE WHEN state IN ('resolved', 'no_validator') THEN l.captured END AS refers_captured,
  'age: 1' || chr(10) || CASE WHEN state IN ('resolved', 'no_validator')
    THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || l.size || chr(10)
      || 'content-type: text/html' || chr(10) || 'date: ' || captured || chr(10) || 'etag: ' || coalesce(tag, l.tag)
    ELSE 'content-length: 0' || chr(10) || 'date: ' || captured || coalesce(chr(10) || 'etag: ' || tag, '') END
    AS header_block
FROM judged"""

_SPACE = r"[\x20\x09-\x0D]+"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TESTS = " AND ".join(
    f"{r.metric} {op} {bound}::DOUBLE"
    for r in RULES
    for op, bound in ((">=", r.least), ("<=", r.most))
    if bound is not None
)

OP5 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d),
g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words,
    len(ls) AS n_lines,
    len(list_filter(ws, lambda x: list_contains({_STOP}, x))) AS n_stop
  FROM w LEFT JOIN covered c USING (r)),
q AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_TESTS} AS kept
FROM q"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (
    "list_filter(regexp_split_to_array(" + _LOWER
    + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes)),
hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
words AS (SELECT r, count(DISTINCT k) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

OP8 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, CASE WHEN lag(role) OVER o IS NOT DISTINCT FROM role THEN 0
      ELSE length(replace(replace(role, '\', '\\'), '###', '\h')) + 5 END AS header,
    length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) + 7 AS body,
    row_number() OVER o AS n
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(header + body) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""

_NEAREST = """
{assigned} AS MATERIALIZED (
  SELECT r, x, min_by(c, (distance, c)) AS c, min(distance) AS distance
  FROM (SELECT v.r, v.x, m.c, CAST(list_sum(list_transform(list_zip(v.x, m.x),
      lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM v, {centroids} m) GROUP BY r, x)"""
# s - (s mod n) is a multiple of n, so the division gives the floor for negative sums too.
_MOVED = """
{moved} AS MATERIALIZED (
  SELECT m.c, coalesce(n.x, m.x) AS x
  FROM {centroids} m LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
    FROM (SELECT c, i, sum(x[i]) AS s, count(*) AS n
      FROM {assigned}, (SELECT unnest(range(1, {components} + 1)) AS i) GROUP BY c, i) GROUP BY c) n ON m.c = n.c)"""


def _rounds() -> str:
    steps = [
        text.format(assigned=f"a{k}", centroids=f"m{k}", moved=f"m{k + 1}", components=COMPONENTS)
        for k in range(ROUNDS)
        for text in (_NEAREST, _MOVED)
    ]
    return ",".join([*steps, _NEAREST.format(assigned="last", centroids=f"m{ROUNDS}")])


OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS}
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {COMPONENTS}),
m0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS INTEGER) AS c, x
  FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {CLUSTERS})),
{_rounds()},
t AS (SELECT c, CAST(sum(distance) AS BIGINT) AS s FROM last GROUP BY c)
SELECT vec_id, a.c AS cluster, distance, t.s AS cluster_inertia,
  (SELECT CAST(sum(s) AS BIGINT) FROM t) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM last a JOIN v USING (r) JOIN t ON t.c = a.c JOIN m{ROUNDS} m ON m.c = a.c"""

# The checksum goes over the bytes with a table of 256 remainders, made by its rule.
OP13 = f"""
WITH c AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_COST} AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda x, b: xor(x >> 8, crc[1 + (xor(x, b) & 255)])), 4294967295) AS text_crc32
  FROM documents, c),
p AS (
  SELECT *, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER () AS total, row_number() OVER o AS place
  FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
s AS (SELECT *, CAST((2 * before + size) * {SHARDS} // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s"""


ORACLE = {
    "op3_warc_revisits": OP3,
    "op5_quality_rules": OP5,
    "op7_decontaminate": OP7,
    "op8_chat_format": OP8,
    "op12_centroid_clusters": OP12,
    "op13_shards": OP13,
}
