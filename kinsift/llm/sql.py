"""SQL (DuckDB) for the rows of those queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op4_mix_sources"] = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, 0.5) * (SELECT sum(n) FROM n) / ((SELECT sum(pow(n, 0.5)) FROM n) * n) AS rate FROM n),
p AS (
  SELECT source, rate, 0 AS j, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL
  SELECT source, rate, j + 1, p * rate / (j + 1), c + p * rate / (j + 1) FROM p WHERE j < 200),
u AS (SELECT doc_id, source, lang, text, (('0x' || substr(md5('17:0:' || doc_id::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 AS u FROM documents),
cs AS (SELECT source, list(c) AS cdf FROM p GROUP BY source),
k AS (SELECT u.doc_id, u.source, u.lang, u.text, len(list_filter(cdf, lambda c: c < u.u))::int AS n_copies FROM u JOIN cs ON cs.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, unnest(range(n_copies))::int AS copy_no, n_copies, source, lang, text FROM k WHERE n_copies > 0
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op8_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, item_id::varchar AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

SQL["op10_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length('<|im_end|>') + 2 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::bigint AS formatted_chars
FROM c GROUP BY conv_id
"""

SQL["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN f USING (h) WHERE m < doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op5_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
f AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN f USING (h)),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 199 AS e FROM (SELECT doc_id, i, sum((before IS NULL OR i > before + 200)::int) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit) GROUP BY doc_id, r),
gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER w, 0) + 1 AS s, s - 1 AS e FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT doc_id, max(e) + 1, 2000000000 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[s:e]), '' ORDER BY s) AS t FROM gaps JOIN d USING (doc_id) WHERE s <= e GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(e - s + 1) AS n_removed FROM runs GROUP BY doc_id)
SELECT doc_id, octet_length(b)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(t, ''))) END AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
