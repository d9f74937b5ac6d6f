"""DuckDB SQL for the queries that SQL can express; nulls and ties as the operators define them."""

from __future__ import annotations

OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
                  row_number() OVER () AS r FROM documents),
 g AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
 twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM g) WHERE n > 1),
 cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY r),
 m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
              length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
              (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, length(regexp_replace(text, '\P{L}+', '', 'g'))::BIGINT AS n_letters,
              coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cover USING (r)),
 b AS (SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
              + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (100 * n_letters < 75 * word_chars)::BIGINT
              + 32 * (word_chars < 2 * n_words)::BIGINT + 64 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
       n_lines, n_letters, fail_bits FROM b
"""

OP3 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
 g AS (SELECT h, count(*)::BIGINT AS group_size FROM d GROUP BY h),
 k AS (SELECT h, doc_id AS keep_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS r FROM d) WHERE r = 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h) JOIN k USING (h)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, chr(0))), 1, 12))::BIGINT AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
 w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
 f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
              sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others, sum(source_size) OVER () AS al FROM w),
 c AS (SELECT *, 2 * cap * others <= (3 * al - 2 * below) * weight AS capped FROM f),
 t AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS held, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS open FROM c),
 u AS (SELECT source, source_size, nth, CASE WHEN capped THEN cap::DOUBLE ELSE (3 * al - 2 * held)::DOUBLE * weight::DOUBLE / (2 * open::DOUBLE) END AS target,
              ceil(source_size / 64.0)::BIGINT AS blocks FROM t),
 v AS (SELECT *, CASE WHEN source_size > 0 THEN round(target * blocks / source_size, 6) ELSE 0 END AS due FROM u),
 q AS (SELECT nth, count(*)::BIGINT AS seats FROM (SELECT nth, row_number() OVER (ORDER BY due / (2 * i + 1) DESC, nth, i) AS r FROM (SELECT nth, due, unnest(range(2 * blocks)) AS i FROM v))
       WHERE r <= (SELECT round(sum(due::DECIMAL(38, 6))) FROM v) GROUP BY nth),
 p AS (SELECT v.*, coalesce(seats, 0) AS seats, CASE WHEN blocks > 0 THEN ('0x' || substr(md5('mix-1:' || coalesce(source, chr(0))), 1, 12))::BIGINT % blocks ELSE 0 END AS first,
              CASE WHEN blocks > 0 THEN coalesce(seats, 0) // blocks ELSE 0 END AS whole FROM v LEFT JOIN q USING (nth)),
 e AS (SELECT *, first + seats - whole * blocks AS last FROM p),
 x AS (SELECT *, (first * source_size) // greatest(blocks, 1) AS a1, (least(last, blocks) * source_size) // greatest(blocks, 1) AS b1,
              (greatest(last - blocks, 0) * source_size) // greatest(blocks, 1) AS b2 FROM e),
 o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(least(pos + size, b1) - greatest(pos, a1), 0) + greatest(least(pos + size, b2) - pos, 0))::BIGINT AS taken
FROM o JOIN x ON o.source IS NOT DISTINCT FROM x.source
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
 w AS (SELECT r, doc_id, i, array_to_string(l[i+1:i+3], chr(10)) AS t FROM (SELECT r, doc_id, l, unnest(range(len(l) - 2)) AS i FROM d WHERE len(l) >= 3)),
 f AS (SELECT r, i FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, i) AS k FROM w WHERE regexp_matches(t, '[^\x20\x09-\x0D]')) WHERE k > 1),
 g AS (SELECT DISTINCT r, i + k AS i FROM f, (SELECT unnest(range(3)) AS k)),
 s AS (SELECT r, count(*) AS n, sum(CASE WHEN p IS NULL OR p < i - 1 THEN 1 ELSE 0 END) AS m FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM g) GROUP BY r),
 x AS (SELECT r, unnest(range(len(l))) AS i, unnest(l) AS line FROM d),
 k AS (SELECT x.r, string_agg(line, chr(10) ORDER BY x.i) AS kept FROM x ANTI JOIN g ON x.r = g.r AND x.i = g.i GROUP BY x.r)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r) LEFT JOIN k USING (r)
"""

#: CRC-32 byte by byte, with its table made from the polynomial; order, cuts and slots by windows over all records.
OP4 = r"""
WITH t AS (SELECT list(v ORDER BY k) AS tab FROM (SELECT k, list_reduce([k::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(k))),
 d AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, substr(md5(coalesce(text, '')), 1, 15) AS h,
              xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
                              lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM documents, t),
 o AS (SELECT *, coalesce(sum(size) OVER w, 0) AS before, count(*) OVER w AS nth, sum(size) OVER () AS total FROM d
       WINDOW w AS (ORDER BY h, doc_id NULLS FIRST, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s AS (SELECT *, least(((before * 2 + size) * 16) // greatest(1, 2 * total), 15)::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY nth) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""

#: Exact similarity join of whole sets by counting shared shingles, then what can be reached.
OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
 c AS (SELECT a AS doc_id, min(b)::BIGINT AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Every 100-byte string as hexadecimal digits, by first start; then what the later ones cover.
OP9 = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, coalesce(text, '')) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 s AS (SELECT r, i, md5(substr(x, 2 * i + 1, 200)) AS t FROM (SELECT r, x, unnest(range(len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200)),
 f AS (SELECT t, min(r * 1000000000 + i) AS first FROM s GROUP BY t HAVING count(*) > 1),
 m AS (SELECT r, i FROM s JOIN f USING (t) WHERE r * 1000000000 + i > first),
 b AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM m),
 c AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM b),
 g AS (SELECT r, span, min(i) AS lo, max(i) + 100 AS hi FROM c GROUP BY r, span),
 k AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY r ORDER BY lo) IS NULL AS final FROM g),
 j AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
              string_agg(substr(x, 2 * before + 1, 2 * (lo - before)) || CASE WHEN final THEN substr(x, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) AS kept FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN j USING (r)
"""

#: Windows of 2048 (a half is 1024) with up to four turns before them; the template's marks are 24 characters of a turn.
OP11 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) t(i)),
 t AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]{1,4}')) + len(regexp_extract_all(role, '[^\x20\x09-\x0D]{1,4}')) + 4 AS cost,
              24 + length(replace(role, '<|', '<||')) + length(replace(text, '<|', '<||')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM c),
 s AS (SELECT *, sum(cost) OVER w AS upto, first_value(CASE WHEN role = 'system' THEN {'place': place, 'cost': cost, 'size': size} END IGNORE NULLS) OVER b AS sys
       FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY place), b AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v AS (SELECT conv_id, (upto - 1) // 1024 AS k, min(place) AS p, sum(cost) AS new, sum(size) AS size, min(upto - cost) AS start, arg_min({'s': sys}, place).s AS sys FROM s GROUP BY ALL),
 h AS (SELECT v.conv_id, v.k, sum(s.size) AS size, bool_or(s.place = v.sys.place) AS has FROM v JOIN s ON s.conv_id = v.conv_id AND s.place BETWEEN v.p - 4 AND v.p - 1
       AND v.start - (s.upto - s.cost) <= 2048 - v.new - coalesce(v.sys.cost, 0) GROUP BY ALL),
 f AS (SELECT v.conv_id, sum(v.size + coalesce(h.size, 0) + CASE WHEN v.sys IS NOT NULL AND NOT coalesce(h.has, false) THEN v.sys.size ELSE 0 END)::BIGINT AS formatted_chars, count(*) AS n_windows
       FROM v LEFT JOIN h ON h.conv_id = v.conv_id AND h.k = v.k GROUP BY v.conv_id),
 d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
              coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learned FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, n_windows FROM d JOIN f USING (conv_id)
"""

OP12 = r"""
WITH x AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
 p AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM x),
 w AS (SELECT lang, p, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM p),
 s AS (SELECT lang, a, lead(a) OVER q AS b, lead(a, 2) OVER q AS c FROM w WINDOW q AS (PARTITION BY p ORDER BY i)),
 f AS MATERIALIZED (SELECT lang, 1 AS m, a AS ph, count(*) AS a FROM s GROUP BY ALL
   UNION ALL SELECT lang, 2, a || ' ' || b AS ph, count(*) FROM s WHERE b IS NOT NULL GROUP BY ALL
   UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c AS ph, count(*) FROM s WHERE c IS NOT NULL GROUP BY ALL),
 c AS MATERIALIZED (SELECT *, string_split(ph, ' ') AS v FROM f WHERE m > 1 AND a >= 10),
 cut AS MATERIALIZED (SELECT c.lang, c.m, c.ph, c.a, l.a AS l, r.a AS r, k, ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
   FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f l ON l.lang || chr(9) || l.ph = c.lang || chr(9) || array_to_string(c.v[1:k], ' ') JOIN f r ON r.lang || chr(9) || r.ph = c.lang || chr(9) || array_to_string(c.v[k + 1:], ' ')),
 low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS o FROM cut) WHERE o = 1),
 longer AS (SELECT lang, ph, max(a) AS a FROM (SELECT lang, a, array_to_string(v[i:i + 1], ' ') AS ph FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE m = 3)) GROUP BY ALL),
 kept AS MATERIALIZED (SELECT low.* FROM low LEFT JOIN longer h ON low.m = 2 AND h.lang = low.lang AND h.ph = low.ph WHERE h.a IS NULL OR 100 * h.a < 50 * low.a),
 n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank, ph AS phrase, a, l, r, n, score FROM kept JOIN n USING (lang)) WHERE rank <= 2000
"""

ORACLES = {"op1_quality_rules": OP1, "op3_exact_dedup": OP3, "op4_sharding": OP4, "op6_mixing": OP6, "op7_line_dedup": OP7, "op8_minhash": OP8, "op9_repeats": OP9, "op11_chat": OP11, "op12_phrases": OP12}
