"""SQL (DuckDB) for the rows of the registered queries; None of it is used by the engine."""

from __future__ import annotations

from kinsift.operators.minhash import SEED, parameters

K, R = 32, 8
#: A lexicon in which one brand is a part of another.
LEXICON = ("brand 1", "brand 2", "brand 3", "brand 4", "brand 5", *(f"brand {i}{j}" for i in range(1, 6) for j in range(1, 6)))
FIXED_RESULTS = [
    (b, r, n, (1 / n) ** (1 / r), 1000 // r + 10 * b, 40 - 3 * r, 30 - 2 * r - b, round(0.5 / r + 0.01 * b, 4), round(0.02 * r, 4), round(0.95 - 0.05 * r - 0.01 * b, 4), round(0.03 * r, 4), round(0.5 / r + 0.01 * b, 4), round(0.015 * r, 4), None if (b, r) == (1, 16) else round(0.9 - 0.05 * r, 4), round(0.025 * r, 4))
    for b in (0, 1)
    for r, n in ((1, 32), (2, 16), (4, 8), (8, 4), (16, 2))
]

_NUM = r"[-+]?\d*\.?\d+"
_TITLE = r"[A-Za-z0-9]*((?:[0-9]+[^0-9, ]+)|(?:[^0-9, ]+[0-9]+))[A-Za-z0-9]*"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _normal(x: str) -> str:
    t = _strip(f"lower(coalesce({x}, 'none'))")
    for p, u in ((r'(\d+)\s*["”]', "inch"), (r"(\d+)\s*(?:inches|inch|in)\b", "inch"), (r"(\d+(?:\.\d+)?)\s*hz\b", "hz"), (r"(\d+(?:\.\d+)?)\s*hertz\b", "hz")):
        t = rf"regexp_replace({t}, '{p}', '\1{u} ', 'g')"
    return t


def _basic(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({_normal(x)}, '[\s\W]+(inch|hz)\b', '\1 ', 'g'), '\s+', ' ', 'g'))"


def _unified(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(replace({_normal(x)}, '-', ''), '/', ''), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, '{_TITLE}'), lambda w: lower(w)))"


def _value(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '(\d+(?:\.\d+)?)[a-zA-Z]*\z', 1), '')"


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 3), lambda i: substr('##' || {x} || '##', i, 3)))"


def _dice(a: str, b: str) -> str:
    return f"2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


def _jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


def _lev(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 ELSE levenshtein({a}, {b})::double / greatest(length({a}), length({b})) END)"


_p, _pairs = parameters(K, SEED)
_PERMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_pairs))
_BRANDS = ", ".join(f"({i}, '{b}')" for i, b in enumerate(LEXICON))

#: Named relations; a query is its last SELECT after those that it names, in this order.
_WITH: dict[str, str] = {
    "offers": """SELECT p_partkey * 4 + shop_no AS product_idx, 'M' || p_partkey AS model_id, 'shop' || shop_no AS shop,
  CASE shop_no WHEN 0 THEN concat(p_brand, ' ', p_name, ' ', p_size, '" ', p_type, ' P', p_partkey, 'X')
    WHEN 1 THEN concat(p_name, ' ', p_size, ' inch ', p_type, ' (', p_brand, ') P', p_partkey, 'X')
    WHEN 2 THEN concat(p_brand, ' ', p_size, '-Inch ', p_name, ' - ', p_type, ' P', p_partkey, '-X')
    ELSE concat(p_type, ' ', p_name, ' ', p_size, ' inches/', 60 + 60 * (p_partkey % 3), ' Hertz P', p_partkey, 'X') END AS title,
  p_partkey, shop_no, p_brand, p_type, p_size
FROM (SELECT DISTINCT l_partkey, l_suppkey % 4 AS shop_no FROM lineitem) JOIN part ON p_partkey = l_partkey""",
    "raw_features": """SELECT product_idx, 0 AS key_pos, 'Brand' AS key, p_brand AS value FROM offers
UNION ALL SELECT product_idx, 1, CASE WHEN shop_no = 1 THEN 'Screen Size Class' ELSE 'Screen Size' END, concat(p_size, CASE WHEN shop_no = 2 THEN '"' ELSE ' inches' END) FROM offers
UNION ALL SELECT product_idx, 2, CASE WHEN shop_no = 3 THEN 'Refresh Rate:' ELSE 'Refresh Rate' END, concat(60 + 60 * (p_partkey % 3), CASE WHEN shop_no = 0 THEN 'Hz' ELSE ' hertz' END) FROM offers
UNION ALL SELECT product_idx, 3, 'Type', p_type FROM offers WHERE shop_no <> 3
UNION ALL SELECT product_idx, 4, 'Estimated Operation Cost', concat('USD ', p_partkey % 17, '.5') FROM offers WHERE shop_no = 0 AND p_partkey % 5 = 0""",
    "basic_titles": f"SELECT product_idx, {_basic('title')} AS title FROM offers",
    "titles": f"SELECT product_idx, {_unified('title')} AS title FROM offers",
    "basic_features": f"SELECT product_idx, key, {_basic('value')} AS value FROM raw_features",
    "features": f"SELECT product_idx, key, {_unified('value')} AS value FROM raw_features",
    "relevant": "SELECT key FROM raw_features GROUP BY key HAVING count(*) >= 0.10 * (SELECT count(*) FROM offers)",
    "basic_words": f"""SELECT DISTINCT product_idx, word FROM (SELECT product_idx, unnest({_words("title")}) AS word FROM basic_titles
UNION ALL SELECT product_idx, {_value("value")} FROM basic_features) WHERE word IS NOT NULL""",
    "words": f"""SELECT DISTINCT product_idx, word FROM (SELECT product_idx, unnest({_words("title")}) AS word FROM titles
UNION ALL SELECT product_idx, unnest({_words("value")}) FROM features WHERE key IN (SELECT key FROM relevant))""",
    "word_idx": "SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_idx FROM (SELECT DISTINCT word FROM words)",
    "sig": f"SELECT product_idx, perm_id, min((a + b * word_idx) % {_p}) AS minhash FROM words JOIN word_idx USING (word) CROSS JOIN (VALUES {_PERMS}) f(perm_id, a, b) GROUP BY ALL",
    "bands": f"SELECT product_idx, perm_id // {R} AS band_id, string_agg(minhash::varchar, ',' ORDER BY perm_id) AS band_key FROM sig GROUP BY ALL",
    "sizes": "SELECT band_id, band_key, count(*) AS n FROM bands GROUP BY ALL",
    "candidates": "SELECT DISTINCT a.product_idx AS i, b.product_idx AS j FROM bands a JOIN bands b USING (band_id, band_key) WHERE a.product_idx < b.product_idx",
    "truth": "SELECT a.product_idx AS i, b.product_idx AS j FROM offers a JOIN offers b USING (model_id) WHERE a.product_idx < b.product_idx",
    "ranked": "SELECT product_idx, row_number() OVER (ORDER BY product_idx) - 1 AS ordinal FROM offers",
    "spots": "SELECT unnest(range(5))::int AS bootstrap, ordinal AS local_pos FROM ranked",
    "drawn": f"SELECT bootstrap, local_pos, product_idx FROM (SELECT bootstrap, local_pos, ('0x' || substr(md5('{SEED}:' || bootstrap || ':' || local_pos), 1, 13))::bigint % (SELECT count(*) FROM offers) AS ordinal FROM spots) JOIN ranked USING (ordinal)",
    "oob": "SELECT bootstrap, product_idx FROM (SELECT unnest(range(5))::int AS bootstrap, product_idx FROM ranked) ANTI JOIN drawn USING (bootstrap, product_idx)",
    "pairs": "SELECT a.product_idx AS i, b.product_idx AS j FROM offers a JOIN offers b ON a.p_partkey // 4 = b.p_partkey // 4 AND a.product_idx < b.product_idx",
    "cross_shop": "SELECT i, j FROM pairs JOIN offers a ON a.product_idx = i JOIN offers b ON b.product_idx = j WHERE a.shop <> b.shop",
    "brand_text": "SELECT product_idx, concat_ws(' ', title, v) AS text FROM titles JOIN (SELECT product_idx, string_agg(value, ' ' ORDER BY key, value) AS v FROM features GROUP BY 1) USING (product_idx)",
    "lexicon": f"SELECT * FROM (VALUES {_BRANDS}) x(rank, brand)",
    "whole": r"SELECT product_idx, min(brand) AS brand FROM brand_text LEFT JOIN lexicon ON regexp_matches(lower(text), '\b' || brand || '\b') GROUP BY 1",
    "tp": "SELECT i, j, a.title AS t1, b.title AS t2 FROM cross_shop JOIN titles a ON a.product_idx = i JOIN titles b ON b.product_idx = j",
    "keys": f"SELECT key, {_grams('key')} AS g, {_grams('lower(key)')} AS gl FROM (SELECT DISTINCT key FROM raw_features)",
    "key_sim": f"SELECT * FROM (SELECT a.key AS k1, b.key AS k2, {_dice('a.g', 'b.g')} AS key_sim FROM keys a, keys b) WHERE key_sim > 0.756",
    "key_sim_fast": f"SELECT * FROM (SELECT a.key AS k1, b.key AS k2, {_jaccard('a.gl', 'b.gl')} AS key_sim FROM keys a, keys b) WHERE key_sim > 0.756",
    "fg": f"SELECT product_idx, key, value, {_grams('value')} AS g, {_grams('lower(value)')} AS gl FROM features",
    "km": f"SELECT i, j, k1, k2, key_sim, {_dice('a.g', 'b.g')} AS value_sim FROM cross_shop JOIN fg a ON a.product_idx = i JOIN key_sim ON k1 = a.key JOIN fg b ON b.product_idx = j AND b.key = k2",
    "km_fast": f"SELECT i, j, k1, k2, key_sim, {_jaccard('a.gl', 'b.gl')} AS value_sim FROM cross_shop JOIN fg a ON a.product_idx = i JOIN key_sim_fast ON k1 = a.key JOIN fg b ON b.product_idx = j AND b.key = k2",
}
for _v in ("", "_fast"):
    _WITH |= {
        f"kv{_v}": f"SELECT i, j, count(*) AS m, sum(key_sim) AS w, sum(key_sim * value_sim) / sum(key_sim) AS kv FROM km{_v} GROUP BY ALL",
        f"um{_v}": f"""SELECT i, j, 'i' AS side, key, value FROM cross_shop JOIN features ON product_idx = i ANTI JOIN (SELECT i, j, k1 AS key FROM km{_v}) USING (i, j, key)
UNION ALL SELECT i, j, 'j', key, value FROM cross_shop JOIN features ON product_idx = j ANTI JOIN (SELECT i, j, k2 AS key FROM km{_v}) USING (i, j, key)""",
        f"hsm{_v}": f"""SELECT i, j, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) END AS hsm
FROM (SELECT i, j, coalesce(list(DISTINCT w) FILTER (side = 'i' AND w IS NOT NULL), []) AS a, coalesce(list(DISTINCT w) FILTER (side = 'j' AND w IS NOT NULL), []) AS b FROM (SELECT i, j, side, {_value("value")} AS w FROM um{_v}) GROUP BY ALL)""",
    }
_WITH |= {
    "tok": r"SELECT product_idx, w FROM (SELECT product_idx, unnest(list_distinct(string_split_regex(title, '\s+'))) AS w FROM titles) WHERE w <> ''",
    "tok_fast": r"SELECT product_idx, w FROM (SELECT product_idx, unnest(string_split_regex(title, '\s+')) AS w FROM titles) WHERE w <> ''",
    "ntok": "SELECT product_idx, count(*) AS n, list(w) AS l FROM tok GROUP BY 1",
    "cos": "SELECT i, j, len(list_intersect(a.l, b.l))::double / (sqrt(a.n) * sqrt(b.n)) AS cosine FROM cross_shop JOIN ntok a ON a.product_idx = i JOIN ntok b ON b.product_idx = j",
    "avg_words": f"SELECT i, j, sum((1 - {_lev('a.w', 'b.w')}) * (length(a.w) + length(b.w))) / sum(length(a.w) + length(b.w)) AS sim FROM cross_shop JOIN tok a ON a.product_idx = i JOIN tok b ON b.product_idx = j GROUP BY ALL",
    "avg_words_fast": f"SELECT i, j, sum((1 - {_lev('a.w', 'b.w')}) * (length(a.w) + length(b.w))) / sum(length(a.w) + length(b.w)) AS sim FROM cross_shop JOIN tok_fast a ON a.product_idx = i JOIN tok_fast b ON b.product_idx = j GROUP BY ALL",
    "mw": f"SELECT product_idx, w, array_to_string(regexp_extract_all(w, '{_NUM}'), '') AS n, trim(regexp_replace(w, '{_NUM}', '', 'g')) AS o FROM (SELECT product_idx, unnest({_words('title')}) AS w FROM titles)",
    "mwp": f"SELECT i, j, a.w AS w1, b.w AS w2, a.n = b.n AS eq, {_lev('a.o', 'b.o')} < 0.5 AS near FROM cross_shop JOIN mw a ON a.product_idx = i JOIN mw b ON b.product_idx = j",
    "mwa": f"""SELECT i, j, coalesce(bool_or(near AND NOT eq), false) AS conflict, coalesce(bool_or(near AND eq), false) AS agree,
  coalesce(sum((1 - {_lev("w1", "w2")}) * (length(w1) + length(w2))) FILTER (near AND eq) / sum(length(w1) + length(w2)) FILTER (near AND eq), 0) AS sim FROM mwp GROUP BY ALL""",
}
for _v in ("", "_fast"):
    _share = "coalesce(m, 0) / (least(ni, nj) + 1e-8)" if _v else "coalesce(m, 0)::double / least(ni, nj)"
    _WITH |= {
        f"tm{_v}": f"""SELECT i, j, CASE WHEN cosine > 0.602 THEN 1.0 WHEN coalesce(conflict, false) THEN -1.0 WHEN coalesce(agree, false) THEN 0.5 * coalesce(mwa.sim, 0) + 0.5 * (0.0 * cosine + 1.0 * w.sim) ELSE 0.0 * cosine + 1.0 * w.sim END AS tmwm
FROM cos JOIN avg_words{_v} w USING (i, j) LEFT JOIN mwa USING (i, j)""",
        f"ps{_v}": f"""SELECT i, j, coalesce(m, 0)::bigint AS m, CASE WHEN tmwm = -1 THEN s * kv + (1 - s) * hsm ELSE 0.35 * s * kv + (0.35 - 0.35 * s) * hsm + 0.65 * tmwm END AS similarity
FROM (SELECT i, j, m, coalesce(kv, 0) AS kv, coalesce(hsm, 0) AS hsm, tmwm, {_share} AS s FROM tm{_v} LEFT JOIN kv{_v} USING (i, j) LEFT JOIN hsm{_v} USING (i, j)
  JOIN (SELECT product_idx AS i, count(*) AS ni FROM features GROUP BY 1) USING (i) JOIN (SELECT product_idx AS j, count(*) AS nj FROM features GROUP BY 1) USING (j))""",
    }

_SELECT: dict[str, str] = {
    "clean_basic": "SELECT product_idx, title FROM basic_titles",
    "clean_unified": "SELECT product_idx, title FROM titles",
    "clean_features": "SELECT product_idx, key, value FROM features",
    "title_model_words": f"SELECT product_idx, unnest({_words('title')}) AS word FROM basic_titles",
    "feature_model_words": f"SELECT * FROM (SELECT product_idx, key, {_value('value')} AS word FROM basic_features) WHERE word IS NOT NULL",
    "unified_model_words": "SELECT product_idx, word FROM words",
    "vocabulary_basic": "SELECT DISTINCT word FROM basic_words",
    "vocabulary_unified": "SELECT DISTINCT word FROM words",
    "feature_frequency": "SELECT key, count(*) AS n_products FROM raw_features GROUP BY key",
    "relevant_features": "SELECT key FROM relevant",
    "word_index": "SELECT word, word_idx FROM word_idx",
    "product_words_basic": "SELECT product_idx, word_idx FROM basic_words JOIN (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_idx FROM (SELECT DISTINCT word FROM basic_words)) USING (word)",
    "product_words_unified": "SELECT product_idx, word_idx FROM words JOIN word_idx USING (word)",
    "minhash_size": "SELECT n AS n_words, (n // 2)::int AS k FROM (SELECT count(DISTINCT word) AS n FROM words)",
    "minhash_params": f"SELECT perm_id, a::bigint AS a, b::bigint AS b, {_p}::bigint AS p FROM (VALUES {_PERMS}) f(perm_id, a, b)",
    "minhash_signatures": "SELECT product_idx, perm_id, minhash FROM sig",
    "signature_agreement": f"SELECT i, j, round(count(*) FILTER (a.minhash = b.minhash) / {K}.0, 6) AS jaccard_estimate FROM pairs JOIN sig a ON a.product_idx = i JOIN sig b ON b.product_idx = j AND a.perm_id = b.perm_id GROUP BY i, j",
    "sample_signatures": "SELECT local_pos, product_idx, perm_id, minhash FROM drawn JOIN sig USING (product_idx) WHERE bootstrap = 0",
    "band_configs": f"SELECT r::int AS r, b::int AS b FROM (SELECT r, ceil({K} / r) AS b FROM range(1, {K} + 1) x(r)) WHERE r * b - {K} BETWEEN 0 AND 3",
    "band_threshold": f"SELECT r::int AS r, b::int AS b, round(pow(1.0 / b, 1.0 / r), 6) AS t FROM (SELECT r, ceil({K} / r) AS b FROM range(1, {K} + 1) x(r)) WHERE r * b - {K} BETWEEN 0 AND 3",
    "lsh_bands": "SELECT product_idx, band_id, band_key FROM bands",
    "lsh_buckets": "SELECT band_id, band_key, product_idx FROM bands JOIN sizes USING (band_id, band_key) WHERE n > 1",
    "lsh_bucket_sizes": "SELECT band_id, band_key, n FROM sizes",
    "lsh_candidates": "SELECT i, j FROM candidates",
    "lsh_candidates_float64": """SELECT DISTINCT a.product_idx AS i, b.product_idx AS j FROM h a JOIN h b ON a.band_id = b.band_id AND a.h = b.h WHERE a.product_idx < b.product_idx""",
    "candidates_global": "SELECT DISTINCT least(a.product_idx, b.product_idx) AS i, greatest(a.product_idx, b.product_idx) AS j FROM db a JOIN db b USING (band_id, band_key) WHERE a.local_pos < b.local_pos",
    "prune_same_shop": "SELECT i, j FROM cross_shop",
    "brand_substring": "SELECT product_idx, arg_min(brand, rank) AS brand FROM brand_text LEFT JOIN lexicon ON contains(text, brand) GROUP BY 1",
    "brand_whole_word": "SELECT product_idx, brand FROM whole",
    "prune_brand": "SELECT i, j FROM pairs JOIN whole a ON a.product_idx = i JOIN whole b ON b.product_idx = j WHERE a.brand IS NULL OR b.brand IS NULL OR a.brand = b.brand",
    "qgrams": "SELECT key, unnest(g) AS gram FROM keys",
    "qgram_dice": f"SELECT i, j, round({_dice('a', 'b')}, 6) AS sim FROM (SELECT i, j, {_grams('t1')} AS a, {_grams('t2')} AS b FROM tp)",
    "qgram_jaccard": f"SELECT i, j, round({_jaccard('a', 'b')}, 6) AS sim FROM (SELECT i, j, {_grams('lower(t1)')} AS a, {_grams('lower(t2)')} AS b FROM tp)",
    "key_similarity": "SELECT k1, k2, round(key_sim, 6) AS key_sim FROM key_sim",
    "kv_match": "SELECT i, j, m, round(w, 6) AS w, round(kv, 6) AS kv FROM kv",
    "unmatched_keys": "SELECT i, j, side, key FROM um",
    "hsm": "SELECT i, j, round(hsm, 6) AS hsm FROM hsm",
    "title_cosine": "SELECT i, j, round(cosine, 6) AS cosine FROM cos",
    "split_numeric": f"SELECT word, array_to_string(regexp_extract_all(word, '{_NUM}'), '') AS numeric, {_strip(f'regexp_replace(word, {chr(39)}{_NUM}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')} AS other FROM (SELECT DISTINCT unnest({_words('title')}) AS word FROM basic_titles)",
    "lev_norm": f"SELECT i, j, round({_lev('t1', 't2')}, 6) AS lev FROM tp",
    "avg_lev_words": "SELECT i, j, round(sim, 6) AS sim FROM avg_words",
    "avg_lev_model_words": "SELECT i, j, round(coalesce(sim, 0), 6) AS sim FROM cross_shop LEFT JOIN mwa USING (i, j)",
    "tmwm": "SELECT i, j, round(tmwm, 6) AS tmwm FROM tm",
    "tmwm_fast": "SELECT i, j, round(tmwm, 6) AS tmwm FROM tm_fast",
    "pair_similarity": "SELECT i, j, m, round(similarity, 6) AS similarity FROM ps",
    "pair_similarity_fast": "SELECT i, j, m, round(similarity, 6) AS similarity FROM ps_fast",
    "dissimilarity": "SELECT i, j, round(1 - similarity, 6) AS dissim FROM ps",
    "epsilon_components": """SELECT node AS product_idx, min(root) AS component FROM reach GROUP BY node""",
    "clusters": "SELECT product_idx, cluster_id FROM clustered",
    "cluster_pairs": "SELECT a.product_idx AS i, b.product_idx AS j FROM clustered a JOIN clustered b USING (cluster_id) WHERE a.product_idx < b.product_idx",
    "cluster_metrics": """SELECT c AS comparisons, f AS found, t AS total, n, round(pq, 6) AS pq, round(pc, 6) AS pc, round(coalesce(2 * pq * pc / (pq + pc), 0), 6) AS f1, round(c / (n * (n - 1) / 2), 6) AS foc
FROM quality CROSS JOIN (SELECT count(*) AS n FROM offers)""",
    "epsilon_grid_best": "SELECT e AS epsilon, round(coalesce(2 * pq * pc / (pq + pc), 0), 6) AS f1 FROM quality ORDER BY coalesce(2 * pq * pc / (pq + pc), -1) DESC, e LIMIT 1",
    "true_pairs": "SELECT i, j FROM truth",
    "bootstrap_oob": "SELECT bootstrap, 'train' AS split, local_pos, product_idx FROM drawn UNION ALL SELECT bootstrap, 'test', row_number() OVER (PARTITION BY bootstrap ORDER BY product_idx) - 1, product_idx FROM oob",
    "true_pairs_in_sample": "SELECT i, j FROM truth WHERE i IN (SELECT product_idx FROM oob WHERE bootstrap = 0) AND j IN (SELECT product_idx FROM oob WHERE bootstrap = 0)",
    "found_duplicates": "SELECT i, j FROM candidates INTERSECT SELECT i, j FROM truth",
    "pair_metrics": """SELECT c AS comparisons, f AS found, t AS total, n, round(f / c, 6) AS pq, round(f / t, 6) AS pc, round(coalesce(2 * (f / c) * (f / t) / (f / c + f / t), 0), 6) AS f1, round(c / (n * (n - 1) / 2), 6) AS foc
FROM (SELECT (SELECT count(*) FROM candidates) AS c, (SELECT count(*) FROM (SELECT i, j FROM candidates INTERSECT SELECT i, j FROM truth)) AS f, (SELECT count(*) FROM truth) AS t, (SELECT count(*) FROM offers) AS n)""",
}
#: The same steps over all LSH candidates: pairs that pruning leaves, components of close ones, and in each the
#: clusters, in order of creation; a round merges the two nearest of those all of whose pairs have a distance.
_FLOW = {
    "tagged": "SELECT product_idx, arg_min(brand, rank) AS brand FROM brand_text LEFT JOIN lexicon ON contains(text, brand) GROUP BY 1",
    "cross_shop": "SELECT i, j FROM candidates JOIN offers a ON a.product_idx = i JOIN offers b ON b.product_idx = j JOIN tagged x ON x.product_idx = i JOIN tagged y ON y.product_idx = j WHERE a.shop <> b.shop AND (x.brand IS NULL OR y.brand IS NULL OR x.brand = y.brand)",
}
_LINKED = {
    "edges": "SELECT i, j, round(1 - similarity, 9) AS dissim FROM ps",
    "undirected": "SELECT e, i AS a, j AS b FROM edges, grid WHERE dissim <= e UNION SELECT e, j, i FROM edges, grid WHERE dissim <= e",
    "reach": "SELECT e, a AS node, a AS root FROM undirected UNION SELECT undirected.e, undirected.b, root FROM reach JOIN undirected ON undirected.e = reach.e AND undirected.a = reach.node",
    "part": "SELECT e, node, min(root) AS c FROM reach GROUP BY e, node",
    "inside": "SELECT x.e, x.c, list({'i': i, 'j': j, 'd': dissim}) AS es FROM edges JOIN part x ON x.node = i JOIN part y ON y.node = j AND y.e = x.e AND y.c = x.c GROUP BY x.e, x.c",
    "merging": """SELECT e, c, 0 AS step, list([node] ORDER BY node) AS cl FROM part GROUP BY e, c
UNION ALL SELECT e, c, step + 1, list_append(list_filter(cl, lambda x: x <> cl[best.p] AND x <> cl[best.q]), list_concat(cl[best.p], cl[best.q])) FROM (
  SELECT e, c, any_value(step) AS step, any_value(cl) AS cl, min({'d': d, 'p': p, 'q': q}) AS best FROM (
    SELECT e, c, any_value(step) AS step, any_value(cl) AS cl, p, q, min(x.d) AS d FROM (
      SELECT e, c, step, cl, x, list_position(list_transform(cl, lambda y: list_contains(y, x.i)), true) AS u, list_position(list_transform(cl, lambda y: list_contains(y, x.j)), true) AS v, least(u, v) AS p, greatest(u, v) AS q
      FROM (SELECT merging.e, merging.c, step, cl, unnest(es) AS x FROM merging JOIN inside ON inside.e = merging.e AND inside.c = merging.c))
    WHERE p <> q GROUP BY e, c, p, q HAVING count(*) = len(any_value(cl)[p]) * len(any_value(cl)[q]) AND min(x.d) <= e)
  GROUP BY e, c)""",
    "grouped": "SELECT e, list_min(g) AS cluster_id, unnest(g) AS product_idx FROM (SELECT e, unnest(arg_max(cl, step)) AS g FROM merging GROUP BY e, c)",
    "clustered": "SELECT grid.e, o.product_idx, coalesce(cluster_id, o.product_idx) AS cluster_id FROM offers o CROSS JOIN grid LEFT JOIN grouped ON grouped.e = grid.e AND grouped.product_idx = o.product_idx",
    "matched": "SELECT e, count(*) AS f FROM clustered a JOIN clustered b USING (e, cluster_id) JOIN truth ON i = a.product_idx AND j = b.product_idx GROUP BY e",
    "quality": "SELECT grid.e, c, coalesce(f, 0) AS f, t, f / c AS pq, f / t AS pc FROM grid LEFT JOIN matched USING (e) CROSS JOIN (SELECT count(*) AS c FROM candidates) CROSS JOIN (SELECT count(*) AS t FROM truth)",
}


def _linked(*grid: float) -> dict[str, str]:
    return {"grid": f"SELECT unnest({list(grid)!r}::double[]) AS e"} | _LINKED


#: Relations that only one query names.
_OWN = {
    "lsh_candidates_float64": {"h": f"SELECT product_idx, band_id, list_reduce(l, lambda h, v: fmod(h * 31.0 + v, 2305843009213693952.0), 0.0::double) AS h FROM (SELECT product_idx, perm_id // {R} AS band_id, list(minhash::double ORDER BY perm_id) AS l FROM sig GROUP BY ALL)"},
    "candidates_global": {"db": "SELECT local_pos, d.product_idx, band_id, band_key FROM drawn d JOIN bands USING (product_idx) WHERE bootstrap = 0"},
    "epsilon_components": {
        "close": "SELECT i, j FROM ps WHERE 1 - similarity <= 0.5",
        "undirected": "SELECT i AS a, j AS b FROM close UNION SELECT j, i FROM close",
        "reach": "SELECT a AS node, a AS root FROM undirected UNION SELECT undirected.b, root FROM reach JOIN undirected ON undirected.a = reach.node",
    },
    "clusters": _FLOW | _linked(0.5),
    "cluster_pairs": _FLOW | _linked(0.5),
    "cluster_metrics": _FLOW | _linked(0.5),
    "cluster_metrics_fast": _FLOW | {"tagged": _WITH["whole"]} | _linked(0.5) | {"edges": _LINKED["edges"].replace("ps", "ps_fast")},
    "epsilon_grid_best": _FLOW | _linked(*(round(0.1 * k, 1) for k in range(11))),
}


def _names(body: str, known: dict[str, str]) -> list[str]:
    import re

    seen: set[str] = set()

    def walk(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                seen.add(name)
                walk(known[name])

    walk(body)
    return [n for n in known if n in seen]


def _sql(name: str, body: str) -> str:
    own = _OWN.get(name, {})
    known: dict[str, str] = {}
    for n, q in _WITH.items():  # a relation of its own stands in place of a common one
        if n == "cross_shop" and "tagged" in own:
            for late in ("brand_text", "lexicon", "tagged"):
                known[late] = own.get(late) or _WITH[late]
        known[n] = own.get(n, q)
    known |= {n: q for n, q in own.items() if n not in known}
    used = _names(body, known)
    if not used:
        return body
    recursive = "RECURSIVE " if "reach" in own else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({known[n]})" for n in used) + "\n" + body


#: A little is added before rounding, in the queries too: sums of another order may not part a tie.
SQL: dict[str, str] = {name: _sql(name, body.replace(", 6)", " + 1e-9, 6)")) for name, body in _SELECT.items()}

SQL["cluster_metrics_fast"] = _sql("cluster_metrics_fast", _SELECT["cluster_metrics"].replace(", 6)", " + 1e-9, 6)"))
for _r in (4, 2):  # shorter bands
    SQL[f"pair_metrics_r{_r}"] = SQL["pair_metrics"].replace(f"perm_id // {R}", f"perm_id // {_r}")
SQL["flatten_groups"] = """SELECT * FROM (VALUES (0::bigint, 'g1', 'm1', 'x', 'a', '29"'), (1::bigint, 'g1', 'm1', 'y', 'b', '29"'), (2::bigint, 'g2', 'm2', 'x', 'c', NULL)) v(product_idx, group_key, model_id, shop, title, size)""".replace("NULL", "'29\"'")

_METRICS = ("candidate_pairs", "duplicates_found_lsh", "duplicates_found_msm", "foc_lsh", "pq_lsh", "pc_lsh", "f1_star", "foc_msm", "pq_msm", "pc_msm", "f1")
_ROWS = ", ".join("(" + ", ".join("NULL::double" if v is None else f"{v!r}::double" if isinstance(v, float) else str(v) for v in row) + ")" for row in FIXED_RESULTS)
_RESULTS = f"res AS (SELECT * FROM (VALUES {_ROWS}) v(bootstrap, r, b, t, {', '.join(_METRICS)}))"
SQL["summarize_results"] = f"WITH {_RESULTS} SELECT r, b, round(t, 6) AS t, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)} FROM res GROUP BY r, b, res.t"
SQL["quality_curves"] = f"WITH {_RESULTS} SELECT r, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('foc_lsh', 'pc_lsh', 'pq_lsh', 'f1_star', 'f1'))} FROM res GROUP BY r, b, t"
SQL["fair_auc"] = f"""WITH {_RESULTS}, m AS (SELECT bootstrap AS c, r, avg(foc_lsh) AS x, avg(pc_lsh) AS y FROM res GROUP BY 1, 2),
cut AS (SELECT min(mx) AS e FROM (SELECT c, max(x) AS mx FROM m GROUP BY c)),
s AS (SELECT c, x, y, lag(x) OVER (PARTITION BY c ORDER BY x, r) AS px, lag(y) OVER (PARTITION BY c ORDER BY x, r) AS py FROM m, cut WHERE x <= e)
SELECT round(sum((x - px) * (y + py) / 2) FILTER (c = 0), 6) AS auc_first, round(sum((x - px) * (y + py) / 2) FILTER (c = 1), 6) AS auc_second FROM s"""
SQL["pending_configs"] = f"WITH {_RESULTS} SELECT bootstrap, r, b FROM (SELECT unnest(range(2))::int AS bootstrap, r::int AS r, b::int AS b FROM (SELECT r, ceil({K} / r) AS b FROM range(1, {K} + 1) x(r)) WHERE r * b - {K} BETWEEN 0 AND 3) ANTI JOIN res USING (bootstrap, r, b)"

for _name in ("summarize_results", "quality_curves", "fair_auc"):
    SQL[_name] = SQL[_name].replace(", 6)", " + 1e-9, 6)")
