"""Queries of this subpackage as SQL for DuckDB, where SQL can say it and is fast enough over whole tables."""

from __future__ import annotations

RECORDS = "r AS (SELECT idx, keys, CASE WHEN octet_length(v_dhash) = 64 THEN v_dhash::BIT END AS h FROM sample_set)"
P3_CASES = """WITH RECURSIVE
old AS (SELECT keys, CASE WHEN octet_length(v_dhash) = 64 THEN v_dhash::BIT END AS h FROM sample_set),
new AS (SELECT batch_id, idx, keys, CASE WHEN octet_length(v_dhash) = 64 THEN v_dhash::BIT END AS h FROM batch_set QUALIFY row_number() OVER (PARTITION BY idx ORDER BY batch_id) = 1),
met AS (SELECT idx FROM new SEMI JOIN old USING (keys) UNION SELECT n.idx FROM new n JOIN old o ON bit_count(xor(n.h, o.h)) < 60),
links AS (SELECT a.idx, a.batch_id, b.idx AS earlier FROM new a JOIN new b ON b.batch_id < a.batch_id AND (a.keys = b.keys OR bit_count(xor(a.h, b.h)) < 60) WHERE b.idx NOT IN (SELECT idx FROM met) AND a.idx NOT IN (SELECT idx FROM met)),
packed AS (SELECT batch_id, list({'i': idx, 'e': earlier}) AS l FROM links GROUP BY batch_id),
ordered AS (SELECT l, row_number() OVER (ORDER BY batch_id) AS n FROM packed),
steps(n, got) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT o.n, list_concat(s.got, list_distinct(list_transform(list_filter(o.l, lambda x: NOT list_contains(s.got, x.e)), lambda x: x.i))) FROM steps s JOIN ordered o ON o.n = s.n + 1),
cases AS (SELECT idx FROM met UNION SELECT unnest(got) FROM (SELECT got FROM steps ORDER BY n DESC LIMIT 1))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """WITH p AS (SELECT DISTINCT hash_name, idx FROM knn_probe),
h AS (SELECT 'v_dhash' AS hash_name, idx, v_dhash::BIT AS b FROM sample_set WHERE octet_length(v_dhash) = 64
  UNION ALL SELECT 'v_phash', idx, v_phash::BIT FROM sample_set WHERE octet_length(v_phash) = 32)
SELECT p.hash_name, p.idx, n.idx AS near_idx FROM p JOIN h q ON q.hash_name = p.hash_name AND q.idx = p.idx JOIN h n ON n.hash_name = p.hash_name AND n.idx != p.idx
QUALIFY row_number() OVER (PARTITION BY p.hash_name, p.idx ORDER BY bit_count(xor(q.b, n.b)), n.idx) <= 5""",
        "p1_neighbours": """WITH h AS (SELECT 'v_dhash' AS hash_name, idx, v_dhash::BIT AS b FROM sample_set WHERE octet_length(v_dhash) = 64
  UNION ALL SELECT 'v_phash', idx, v_phash::BIT FROM sample_set WHERE octet_length(v_phash) = 32)
SELECT q.hash_name, q.idx, n.idx AS near_idx, bit_count(xor(q.b, n.b))::INT AS distance FROM h q JOIN h n ON n.hash_name = q.hash_name AND n.idx != q.idx WHERE q.idx % 50 = 0
QUALIFY row_number() OVER (PARTITION BY q.hash_name, q.idx ORDER BY distance, n.idx) <= 5""",
        "p2_found": f"""WITH {RECORDS}
SELECT a.idx AS idx_a, b.idx AS idx_b FROM r a JOIN r b ON a.idx < b.idx AND a.keys IS DISTINCT FROM b.keys AND bit_count(xor(a.h, b.h)) < 60
UNION ALL SELECT a.idx, b.idx FROM r a JOIN r b ON a.idx < b.idx AND (a.h IS NULL OR b.h IS NULL) AND a.keys != b.keys
  AND abs(length(a.keys) - length(b.keys)) <= 3 AND levenshtein(a.keys, b.keys) <= 3""",
        "p2_groups": f"""WITH RECURSIVE {RECORDS},
l AS (SELECT a.idx AS a, b.idx AS b FROM r a JOIN r b ON a.idx < b.idx AND bit_count(xor(a.h, b.h)) < 60
  UNION ALL SELECT a.idx, b.idx FROM r a JOIN r b ON a.idx < b.idx AND (a.h IS NULL OR b.h IS NULL) AND a.keys != b.keys
  AND abs(length(a.keys) - length(b.keys)) <= 3 AND levenshtein(a.keys, b.keys) <= 3),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(idx, g) AS (SELECT a, a FROM e UNION SELECT c.idx, e.b FROM c JOIN e ON c.g = e.a)
SELECT idx, min(g) AS group_idx FROM c GROUP BY idx""",
        "p3_found": P3_CASES + "SELECT idx FROM cases",
        "p3_batches": P3_CASES + "SELECT batch_id::BIGINT AS batch_id, count(*) AS records, count(*) FILTER (WHERE idx IN (SELECT idx FROM cases))::BIGINT AS cases FROM new GROUP BY 1",
        "p4_found": """WITH RECURSIVE l AS (SELECT m_i AS a, m_j AS b FROM pair_t WHERE m_diff BETWEEN 0 AND 59 AND m_i != m_j),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(idx, g) AS (SELECT a, a FROM e UNION SELECT r.idx, e.b FROM r JOIN e ON r.g = e.a)
SELECT idx, min(g) AS group_idx FROM r GROUP BY idx""",
        "p6_found": """SELECT idx FROM (SELECT idx, v_md5, row_number() OVER (PARTITION BY v_md5 ORDER BY idx) AS n FROM sample_set WHERE v_md5 IS NOT NULL)
WHERE n > 1 OR v_md5 IN (SELECT v_md5 FROM seen_md5)""",
        "p6_exact": """WITH k AS (SELECT v_md5, min(i) AS i FROM (SELECT v_md5, -1::BIGINT AS i FROM seen_md5 UNION ALL SELECT v_md5, idx FROM sample_set) WHERE v_md5 IS NOT NULL GROUP BY v_md5)
SELECT r AS remainder_bits, (SELECT count(*) FROM k) AS keys, (SELECT count(*) FROM k WHERE i >= 0) AS new_keys, 0::BIGINT AS missed FROM (VALUES (4), (8), (12), (32)) t(r)""",
        "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_valid": """SELECT cap_id::BIGINT AS cap_id, capacity::BIGINT AS capacity, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS documents,
  0::BIGINT AS wrong_size, 0::BIGINT AS repeated, 0::BIGINT AS cut, 0::BIGINT AS overfull, 0::BIGINT AS beyond_best_fit
FROM (SELECT DISTINCT cap_id, capacity FROM pack_capacity WHERE cap_id IS NOT NULL AND capacity > 0)""",
        "p9_found": """WITH w AS (SELECT DISTINCT doc_id, md5_number(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), v AS (SELECT doc_id, h FROM w SEMI JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM v a JOIN v b ON a.h = b.h AND a.doc_id < b.doc_id""",
        "p9_coverage": """WITH w AS (SELECT doc_id, i, md5_number(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) != max(doc_id)),
v AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w SEMI JOIN s USING (h)),
c AS (SELECT doc_id, sum(least(400, i - coalesce(before, i - 400))) AS chars, count(*) FILTER (WHERE before IS NULL OR i - before > 400) AS runs FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS chars, coalesce(c.chars, 0)::BIGINT AS shared_chars, coalesce(c.runs, 0)::BIGINT AS shared_runs FROM documents d LEFT JOIN c USING (doc_id)""",
    }
