"""DuckDB equivalents of the operators that SQL can express."""

from lumenarc.llm import decontaminate, mixing, quality, slots, trie, vafile

SLOTS = f"""
WITH RECURSIVE crc(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
checks AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc
  FROM texts, crc_table),
r AS (
  SELECT doc_id, strlen(coalesce(d.text, '')) + {slots.ROW_BYTES} AS size, crc AS text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || crc::VARCHAR), 1, 8))::BIGINT % {slots.N_SLOTS} AS vslot
  FROM documents d JOIN checks ON coalesce(d.text, '') = checks.text),
s AS (SELECT vslot, sum(size)::BIGINT AS bytes, count(*) AS n_rows, vslot % {slots.N_SHARDS} AS shard FROM r GROUP BY vslot),
f AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, vslot) AS filled, (SELECT sum(bytes) * {slots.KEEP} / {slots.N_SHARDS} FROM s) AS fair FROM s),
pool AS (SELECT vslot, bytes, row_number() OVER (ORDER BY bytes DESC, vslot) AS k FROM f WHERE filled > fair),
start AS (SELECT list(coalesce(b, 0) ORDER BY range) AS loads FROM range({slots.N_SHARDS}) LEFT JOIN (SELECT shard, sum(bytes)::BIGINT AS b FROM f WHERE filled <= fair GROUP BY shard) ON shard = range),
fold(k, vslot, shard, loads) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, loads::BIGINT[] FROM start
  UNION ALL
  SELECT pool.k, pool.vslot, list_position(loads, list_min(loads)) - 1,
    list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + pool.bytes ELSE v END)
  FROM fold JOIN pool ON pool.k = fold.k + 1),
m AS (SELECT vslot, shard FROM f WHERE filled <= fair UNION ALL SELECT vslot, shard FROM fold WHERE k > 0)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM r JOIN m USING (vslot)
"""

MIXING = f"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null') || '/' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.MAX_REPEATS} * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
t AS (
  SELECT source, source_size, CASE WHEN cap * weights <= rest * weight THEN cap::DOUBLE
    ELSE weight::DOUBLE * (SELECT arg_max(rest, weights)::DOUBLE / max(weights)::DOUBLE FROM l WHERE cap * weights > rest * weight) END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least({mixing.MAX_REPEATS}, floor(target / source_size))::BIGINT ELSE 0 END AS repeats FROM t),
u AS (SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS through FROM r GROUP BY source, h)
SELECT r.doc_id, r.size, g.source_size, g.target,
  (r.size * (g.repeats + CASE WHEN g.repeats < {mixing.MAX_REPEATS} AND u.through - u.n / 2.0 <= g.target - g.repeats * g.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source JOIN u ON u.source IS NOT DISTINCT FROM r.source AND u.h = r.h
"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, {_WORDS.format('text')} AS words FROM d),
win AS (SELECT k, i, words[i:i + {quality.REPEAT_WINDOW - 1}] AS win FROM (SELECT k, words, unnest(range(1, len(words) - {quality.REPEAT_WINDOW - 2})) AS i FROM w)),
twice AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, win) > 1),
rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + {quality.REPEAT_WINDOW})) AS p FROM twice) GROUP BY k),
ln AS (SELECT k, i, lines[i] AS line FROM (SELECT k, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT k, string_split(text, chr(10)) AS lines FROM d))),
lw AS (SELECT k, i, line, len({_WORDS.format('line')})::BIGINT AS nw, row_number() OVER (PARTITION BY k, line ORDER BY i) > 1 AS again FROM ln),
judged AS (
  SELECT k, nw, again, again OR len(regexp_extract_all(line, '[#*$%&|<>]')) * {quality.MARKUP_PER_WORDS} > nw OR len(regexp_extract_all(line, '!!')) * {quality.SHOUTS_PER_WORDS} > nw
    OR (nw < {quality.NAVIGATION_WORDS} AND NOT regexp_matches(line, '[.!?:;"'')\\]…”»。][\\x20\\x09-\\x0D]*$'))
    OR (nw <= {quality.BOILERPLATE_WORDS} AND regexp_matches(line, '(?i)({'|'.join(quality.BOILERPLATE)})')) AS failed
  FROM lw WHERE nw > 0),
per AS (SELECT k, count_if(again) AS n_dup_lines, count_if(failed) AS n_lines_removed, coalesce(sum(nw) FILTER (NOT failed), 0)::BIGINT AS n_kept_words FROM judged GROUP BY k),
f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(n_kept_words, 0)::BIGINT AS n_kept_words
  FROM w LEFT JOIN rep USING (k) LEFT JOIN per USING (k)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_kept_words >= {quality.KEEP_PERCENT} * n_words AS kept, n_lines_removed, n_kept_words FROM b
"""


def _vectors() -> str:
    """Rounds as numbered tables: b<k> entries, a<k> assignments (distance * N_ENTRIES + entry, so ties go to the lower entry)."""
    n, parts = vafile.N_ENTRIES, vafile.N_PARTS
    out = f"""
WITH r AS (SELECT row_number() OVER () AS k, vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT greatest((max(len(v)) + {parts - 1}) // {parts}, 1) AS d FROM r),
x AS (SELECT k, vec_id, label, i // d AS part, i % d AS pos, CASE WHEN i < len(v) THEN floor({vafile.SCALE} * v[i + 1]::DOUBLE)::BIGINT ELSE 0 END AS x FROM (SELECT k, vec_id, label, v, d, unnest(range(d * {parts})) AS i FROM r, w)),
s AS (SELECT k, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM r WHERE vec_id IS NOT NULL QUALIFY entry < {n}),
b0 AS (SELECT part, entry, pos, x AS y FROM x JOIN s USING (k))"""
    for k in range(vafile.ROUNDS + 1):
        out += f""",
a{k} AS (SELECT k, part, min(apart * {n} + entry) AS best FROM (SELECT k, part, entry, sum((x - y) * (x - y))::BIGINT AS apart FROM x JOIN b{k} USING (part, pos) GROUP BY k, part, entry) GROUP BY k, part)"""
        if k < vafile.ROUNDS:
            out += f""",
m{k} AS (SELECT part, best % {n} AS entry, pos, sum(x)::BIGINT AS t, count(*) AS c FROM a{k} JOIN x USING (k, part) GROUP BY ALL),
b{k + 1} AS (SELECT b{k}.part, b{k}.entry, b{k}.pos, CASE WHEN c IS NULL THEN y ELSE (t - ((t % c) + c) % c) // c END AS y FROM b{k} LEFT JOIN m{k} USING (part, entry, pos))"""
    last = vafile.ROUNDS
    return out + f""",
e AS (SELECT k, string_agg(printf('%02x', best % {n}), '' ORDER BY part) AS code, sum(best // {n})::BIGINT AS error FROM a{last} GROUP BY k),
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN e USING (k), h
"""


VECTORS = _vectors()

TRIE = f"""
WITH RECURSIVE crc(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, turns, conv_id - conv_id % {trie.FAMILY} AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {trie.STARTS} AS h
  FROM own, crc_table),
built AS (SELECT heads.conv_id, list_concat(coalesce(own.turns, [])[1:h], heads.turns[h + 1:]) AS turns FROM heads LEFT JOIN own ON own.conv_id = heads.base),
prefix AS (SELECT conv_id, turns, d, turns[1:d] AS p FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = d)), sha256('')) AS ends_sha256,
    (count(*) - 1) * strlen(CASE WHEN d = 0 THEN '' ELSE p[d].text END) AS saved
  FROM prefix GROUP BY p, d),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
ups AS (SELECT p[1:a] AS p, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_nodes)),
totals AS (SELECT p, count_if(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM ups GROUP BY p)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes f JOIN totals USING (p) LEFT JOIN full_nodes g ON f.depth > 0 AND g.p = f.p[1:f.depth - 1]
"""

BENCHMARK = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORDS}') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORDS}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), {decontaminate.WINDOW}) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT k, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT k, s, n, item FROM dw JOIN iw USING (n, win)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT k, s, n FROM hits)) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""
