"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: rows of the exact path: cells of 20 bits decide every shard (more bits are needed only beyond about 2^20 shards)
_OP3 = r"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
                  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
g AS (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS depth),
nodes AS (SELECT g.depth, d.h >> (60 - g.depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS docs FROM d, g GROUP BY ALL),
fit AS (SELECT *, bytes <= 1048576 OR docs = 1 AS fits FROM nodes),
leaf AS (SELECT f.* FROM fit f LEFT JOIN fit p ON p.depth = f.depth - 1 AND p.prefix = f.prefix >> 1 WHERE f.fits AND (f.depth = 0 OR NOT p.fits))
SELECT d.doc_id, CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(leaf.prefix), leaf.depth, '0') END AS shard, leaf.depth AS depth, d.n_bytes,
       CAST(leaf.bytes AS BIGINT) AS shard_bytes, leaf.docs AS shard_docs, leaf.bytes > 1048576 AS oversized
FROM d JOIN leaf ON d.h >> (60 - leaf.depth) = leaf.prefix
"""

_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || coalesce(text, '~')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(source_rank % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
m AS (SELECT arg_min(level, cap / weight) AS water FROM l WHERE level * weight <= cap),
t AS (SELECT l.source, source_rank, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM l, m),
q AS (SELECT d.*, t.source_size, t.target, t.source_rank, sum(size) OVER (PARTITION BY t.source_rank ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
             row_number() OVER (PARTITION BY t.source_rank ORDER BY key, doc_id, size) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, epoch, CASE WHEN target > 0 THEN (upto + epoch * source_size)::DOUBLE / target ELSE 0 END AS finish FROM q, (VALUES (0), (1)) v(epoch)),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, source_rank, key, doc_id, place, epoch ROWS UNBOUNDED PRECEDING) AS total FROM e),
b AS (SELECT sum(target) AS budget FROM t)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN total <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM c, b GROUP BY doc_id, source_rank, place, size, source_size, target
"""

_OP7 = "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_tokens FROM documents"

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
keyed AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM win),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM keyed) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM rep, range(0, 8) t(j) GROUP BY rid),
m AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS x FROM f GROUP BY source),
p AS (SELECT sum(n) AS n, sum(x) / sum(n) AS mean, greatest(sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2, 0) AS v FROM h),
k AS (SELECT mean, CASE WHEN v > 0 THEN least(n, greatest(2.0, mean * (1 - mean) / v - 1)) ELSE n END AS strength FROM p),
b AS (SELECT source, mean, (x + mean * strength) / (n + strength) AS rate, n + strength AS weight FROM h, k),
l AS (SELECT source, mean, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) AS low FROM b),
j AS (SELECT source, low * (1 - mean) > 2.0 * mean * (1 - low) AS rejected FROM l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source
"""

_OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker <> 'system'),
m AS (SELECT c.conv_id, perspective, speaker, text, row_number() OVER (PARTITION BY c.conv_id, perspective ORDER BY turn NULLS LAST, speaker, text) - 1 AS position,
             CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10) WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
                  ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
      FROM c JOIN v ON c.conv_id IS NOT DISTINCT FROM v.conv_id),
x AS (SELECT *, length(head) + length(text) + 11 AS size FROM m),
s AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM x)
SELECT conv_id, perspective, position, speaker, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
       head || text || '<|im_end|>' || chr(10) AS rendered, char_start, char_start + size AS char_end,
       CASE WHEN speaker = perspective THEN char_start + length(head) ELSE char_start END AS mask_start,
       CASE WHEN speaker = perspective THEN char_start + length(head) + length(text) + 10 ELSE char_start END AS mask_end
FROM s
"""

ORACLES = {"op3_extendible_sharding": _OP3, "op4_fair_queue_mixing": _OP4, "op7_separator_scan": _OP7, "op8_host_rules": _OP8, "op10_perspective_rotation": _OP10}
