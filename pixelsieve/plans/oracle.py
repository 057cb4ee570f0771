"""The queries of plans/queries.py as SQL for DuckDB."""

from __future__ import annotations

FILES = """files AS (
  SELECT doc_id, text, coalesce(source, 'none') || '/' || doc_id::VARCHAR || '.' || (['JPG', 'png', 'tex', 'jpeg'])[doc_id % 4 + 1] AS path, encode(text) AS content
  FROM documents WHERE text IS NOT NULL)"""
EXT = "lower(CASE WHEN contains({0}, '.') THEN string_split({0}, '.')[-1] ELSE {0} END)"
SAMPLES = """samples AS (
  SELECT idx, keys AS path, v_md5 AS md5, CASE WHEN octet_length(v_dhash) = 64 THEN v_dhash::BIT END AS dhash, CASE WHEN octet_length(v_phash) = 32 THEN v_phash::BIT END AS phash
  FROM sample_set)"""
BATCHES = """batches AS (
  SELECT DISTINCT idx, keys AS path, batch_id, CASE WHEN octet_length(v_dhash) = 64 THEN v_dhash::BIT END AS dhash, CASE WHEN octet_length(v_phash) = 32 THEN v_phash::BIT END AS phash
  FROM batch_set QUALIFY row_number() OVER (PARTITION BY idx ORDER BY batch_id) = 1)"""
SHAPED = "least({0}, {1}) >= 128 AND greatest({0}, {1}) <= 2048 AND greatest({0}, {1})::FLOAT / nullif(least({0}, {1}), 0)::FLOAT <= 3"


def _pairs(column: str, below: int) -> str:
    return f"""WITH {SAMPLES} SELECT a.idx AS i, b.idx AS j, bit_count(xor(a.{column}, b.{column}))::INT AS diff
FROM samples a JOIN samples b ON a.idx > b.idx AND bit_count(xor(a.{column}, b.{column})) < {below}"""


def _remain(column: str, below: int) -> str:
    return f"""WITH {SAMPLES}, {BATCHES} SELECT idx, path FROM batches b WHERE {column} IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM samples s WHERE bit_count(xor(s.{column}, b.{column})) < {below})"""


def _merge(column: str, below: int) -> str:
    return f"""WITH {SAMPLES}, {BATCHES},
t0 AS (SELECT 0 AS part, idx, path, {column} FROM samples WHERE {column} IS NOT NULL),
t1 AS (SELECT 1 AS part, idx, path, {column} FROM batches b WHERE batch_id % 2 = 0 AND {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t0 WHERE bit_count(xor(t0.{column}, b.{column})) < {below})),
t01 AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1),
t2 AS (SELECT 2 AS part, idx, path, {column} FROM batches b WHERE batch_id % 2 = 1 AND {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t01 WHERE bit_count(xor(t01.{column}, b.{column})) < {below}))
SELECT part, idx, path FROM t01 UNION ALL SELECT part, idx, path FROM t2"""


def _greedy(edges: str, x: str = "") -> str:
    """CTEs edges (a, b) and gone (v): the vertices removed one by one, of most remaining edges, the largest of equals."""
    return f"""edges{x} AS (SELECT DISTINCT greatest(a, b) AS a, least(a, b) AS b FROM ({edges}) WHERE a != b),
steps{x}(v, e) AS (SELECT NULL::BIGINT, (SELECT list({{'a': a, 'b': b}}) FROM edges{x})
  UNION ALL SELECT p, list_filter(e, lambda x: x.a != p AND x.b != p) FROM (
    SELECT e, (SELECT u FROM (SELECT unnest(list_concat(list_transform(e, lambda x: x.a), list_transform(e, lambda x: x.b))) AS u) GROUP BY u ORDER BY count(*) DESC, u DESC LIMIT 1) AS p
    FROM steps{x} WHERE len(e) > 0)),
gone{x} AS (SELECT v FROM steps{x} WHERE v IS NOT NULL)"""


def _near_dedup(source: str, column: str, below: int, x: str = "") -> str:
    """CTE kept (all columns of the source): equal hashes first, then greedy removal."""
    return f"""firsts{x} AS (SELECT * FROM {source} WHERE {column} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {column} ORDER BY idx) = 1),
{_greedy(f"SELECT x.idx AS a, y.idx AS b FROM firsts{x} x JOIN firsts{x} y ON x.idx > y.idx AND bit_count(xor(x.{column}, y.{column})) < {below}", x)},
kept{x} AS (SELECT * FROM firsts{x} WHERE idx NOT IN (SELECT v FROM gone{x}))"""


def _dedup(column: str, below: int) -> str:
    return f"WITH RECURSIVE {SAMPLES}, {_near_dedup('samples', column, below)} SELECT idx, path FROM kept"


def _bits(cells: str, n: int) -> str:
    """Hex of n bits given as a list of booleans."""
    return f"array_to_string(list_transform(range(0, {n // 4}), lambda q: substr('0123456789abcdef', (8 * ({cells})[4 * q + 1] + 4 * ({cells})[4 * q + 2] + 2 * ({cells})[4 * q + 3] + ({cells})[4 * q + 4] + 1)::INT, 1)), '')"


#: The means of the code points of equal stretches of the whole text.
GRID = """t AS (SELECT doc_id, length(text)::BIGINT AS n, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT) AS a FROM documents),
p AS (SELECT doc_id, CASE WHEN n > 0 THEN list_transform(range(0, {0}), lambda k: CASE WHEN (k + 1) * n // {0} > k * n // {0}
  THEN (list_sum(a[k * n // {0} + 1 : (k + 1) * n // {0}]) // ((k + 1) * n // {0} - k * n // {0}))::BIGINT ELSE a[k * n // {0} + 1] END) END AS g FROM t)"""


def oracle_sql() -> dict[str, str]:
    ext_keys, ext_path = EXT.format("keys"), EXT.format("path")
    jpeg = "ends_with(lower(path), '.jpg') OR ends_with(lower(path), '.jpeg')"
    return {
        "md5_gen": f"WITH {FILES} SELECT doc_id, md5(content) AS md5 FROM files",
        "dedup_md5": f"WITH {FILES} SELECT min(doc_id) AS idx, md5(content) AS md5 FROM files GROUP BY md5(content)",
        "dedup_md5_samples": "SELECT idx, keys AS path FROM sample_set WHERE v_md5 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY v_md5 ORDER BY idx) = 1",
        "filter_ext": f"SELECT idx, {ext_keys} AS ext FROM sample_set WHERE {ext_keys} IN ('jpg', 'jpeg', 'png')",
        "filter_size": f"WITH {FILES} SELECT doc_id, octet_length(content)::INT AS length FROM files WHERE octet_length(content) >= 1000",
        "filter_magic": f"""WITH {FILES} SELECT doc_id, path FROM files
WHERE NOT ({jpeg} OR ends_with(path, '.png')) OR doc_id // 4 % 4 = 0""",
        "filter_geometry": f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, trunc(l_quantity * 40)::INT AS width, trunc(l_extendedprice / 40)::INT AS height FROM lineitem)
WHERE {SHAPED.format('width', 'height')}""",
        "filter_quality": f"""WITH {FILES}, sides AS (SELECT doc_id, (length(text) // 4)::INT AS w, (length(title) * 10)::INT AS h FROM documents)
SELECT doc_id, path FROM files JOIN sides USING (doc_id) WHERE octet_length(content) >= 1000 AND NOT ({jpeg} OR ends_with(path, '.png')) AND {SHAPED.format('w', 'h')}""",
        "dhash_gen": f"""WITH {GRID.format(289)},
b AS (SELECT doc_id, list_concat(list_transform(range(0, 256), lambda k: (g[k // 16 * 17 + k % 16 + 1] < g[k // 16 * 17 + k % 16 + 2])::INT), list_transform(range(0, 256), lambda k: (g[k % 16 * 17 + k // 16 + 1] < g[k % 16 * 17 + k // 16 + 18])::INT)) AS c FROM p)
SELECT doc_id, CASE WHEN c IS NOT NULL AND len(c) > 0 AND c[1] IS NOT NULL THEN {_bits('c', 512)} END AS dhash FROM b""",
        "phash_gen": f"""WITH {GRID.format(256)},
m AS (SELECT doc_id, g, list_aggregate(g, 'median') AS m FROM p), b AS (SELECT doc_id, list_transform(g, lambda v: (v > m)::INT) AS c FROM m)
SELECT doc_id, CASE WHEN c IS NOT NULL AND c[1] IS NOT NULL THEN {_bits('c', 256)} END AS phash FROM b""",
        "embedding_hash": f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS g FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT vec_id, g, list_sort(g) AS o FROM p), b AS (SELECT vec_id, list_transform(g, lambda v: (v > (o[32] + o[33]) / 2)::INT) AS c FROM s)
SELECT vec_id, {_bits('c', 64)} AS hash FROM b""",
        "popcount_hist": f"WITH {SAMPLES} SELECT bit_count(dhash)::BIGINT AS bits_set, count(*) AS n FROM samples WHERE dhash IS NOT NULL GROUP BY 1",
        "pairs_dhash": _pairs("dhash", 60),
        "pairs_phash": _pairs("phash", 50),
        "pairs_banded": _pairs("dhash", 12),
        "pairs_embedding": f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS g FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT vec_id, g, list_sort(g) AS o FROM p),
b AS (SELECT vec_id, array_to_string(list_transform(g, lambda v: CASE WHEN v > (o[32] + o[33]) / 2 THEN '1' ELSE '0' END), '')::BIT AS c FROM s)
SELECT x.vec_id AS i, y.vec_id AS j, bit_count(xor(x.c, y.c))::INT AS diff FROM b x JOIN b y ON x.vec_id > y.vec_id AND bit_count(xor(x.c, y.c)) < 20""",
        "remain_dhash": _remain("dhash", 60),
        "remain_phash": _remain("phash", 50),
        "merge_dhash": _merge("dhash", 60),
        "merge_phash": _merge("phash", 50),
        "concat_lists": "SELECT idx, path, 0 AS part FROM merged_list UNION ALL SELECT idx, keys, 1 FROM sample_set",
        "greedy_pairs": f"""WITH RECURSIVE {_greedy("SELECT m_i AS a, m_j AS b FROM pair_t WHERE m_diff BETWEEN 1 AND 59")} SELECT v AS idx FROM gone""",
        "greedy_rounds": f"""WITH RECURSIVE {_greedy("SELECT m_i AS a, m_j AS b FROM pair_t WHERE m_diff BETWEEN 1 AND 59")} SELECT v AS idx FROM gone""",
        "dedup_dhash": _dedup("dhash", 60),
        "dedup_phash": _dedup("phash", 50),
        "pipeline_full": f"""WITH RECURSIVE {SAMPLES},
fine AS (SELECT * FROM samples WHERE {ext_path} IN ('jpg', 'jpeg', 'png', 'webp') AND md5 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY idx) = 1),
hashed AS (SELECT * FROM fine WHERE dhash IS NOT NULL AND phash IS NOT NULL),
{_near_dedup('hashed', 'phash', 50, '1')}, {_near_dedup('kept1', 'dhash', 60, '2')} SELECT idx, path FROM kept2""",
        "hash_roundtrip": "SELECT idx, keys AS path, lower(hex(v_dhash)) AS hex FROM sample_set WHERE octet_length(v_dhash) = 64",
        "load_lines": """SELECT DISTINCT file_name, line_no, CASE WHEN contains(line, ',') THEN substr(line, 1, instr(line, ',') - 1) ELSE line END AS path,
CASE WHEN contains(line, ',') AND regexp_full_match(substr(line, instr(line, ',') + 1), '[0-9a-f]{128}') THEN substr(line, instr(line, ',') + 1) END AS hex FROM hash_lines WHERE line IS NOT NULL""",
        "pair_lines": """SELECT DISTINCT greatest(m_i, m_j) AS i, least(m_i, m_j) AS j, a.path || ',' || b.path || ',' || m_diff::VARCHAR AS value
FROM pair_t JOIN merged_list a ON a.idx = greatest(m_i, m_j) JOIN merged_list b ON b.idx = least(m_i, m_j) WHERE m_diff BETWEEN 0 AND 59 AND m_i != m_j""",
        **_scanner(),
        "p5_found": f"WITH {LINES} SELECT DISTINCT file_name, line_no, reason FROM judged WHERE reason IS NOT NULL",
        "p5_loaded": f"""WITH {LINES} SELECT DISTINCT file_name, line_no, replace(CASE WHEN f1 LIKE '"%' THEN substr(f1, 2, length(f1) - 2) ELSE f1 END, '""', '"') AS keys, trim(f2, '"') AS v_dhash FROM judged WHERE reason IS NULL""",
    }


#: A field is quoted as a whole, with quotes inside doubled, or holds neither quotes nor commas.
FIELD = '("([^"]|"")*"|[^",]*)'
LINES = f"""
cut AS (SELECT file_name, line_no, CASE WHEN right(coalesce(line, ''), 1) = chr(13) THEN left(line, length(line) - 1) ELSE coalesce(line, '') END AS l FROM hash_lines),
shaped AS (SELECT *, regexp_full_match(l, '(?s){FIELD}(,{FIELD})*') AS fine, regexp_full_match(l, '(?s){FIELD},{FIELD}') AS two, regexp_extract(l, '(?s)^({FIELD}),({FIELD})$', 1) AS f1, regexp_extract(l, '(?s)^({FIELD}),({FIELD})$', 4) AS f2 FROM cut),
judged AS (SELECT *, CASE WHEN NOT fine THEN 'quoting' WHEN NOT two THEN 'columns' WHEN f1 IN ('', '""') OR NOT regexp_full_match(f2, '([0-9a-f]{{128}}|"[0-9a-f]{{128}}")') THEN 'value' END AS reason FROM shaped)"""


def _scanner() -> dict[str, str]:
    nl = "chr(10)"
    texts = f"['', 'libpng warning: iCCP: known incorrect sRGB profile', 'fmt_mismatch:PNG!=JPEG', 'pil_error:broken data stream' || {nl} || 'second line', 'libpng warning: iCCP: x' || {nl} || 'libpng error: bad', '']"
    verdicts = f"""checks AS (SELECT event_id, '/img/' || user_id::VARCHAR || '/' || event_type AS path, ({texts})[event_id % 6 + 1] AS stderr, ([0, 0, 1, -11, 0, 1, 0, -6])[event_id % 8 + 1] AS code, event_id % 97 = 5 AS late FROM events),
verdicts AS (SELECT *, CASE WHEN late THEN 'crash:timeout' WHEN code = -11 THEN 'crash:signal SIGSEGV(11)' WHEN code = -6 THEN 'crash:signal SIGABRT(6)' WHEN stderr != '' THEN 'c_warning_or_error:' || stderr WHEN code != 0 THEN 'error:exit ' || code::VARCHAR END AS reason FROM checks),
classed AS (SELECT *, CASE WHEN reason LIKE 'c_warning_or_error:fmt_mismatch:%' THEN 'fmt_mismatch' WHEN reason LIKE 'c_warning_or_error:libpng warning: iCCP: known%' THEN 'warn_clevel' WHEN reason IS NOT NULL THEN 'bad_clevel' END AS class FROM verdicts)"""
    return {
        "scanner_classify": f"WITH {verdicts} SELECT event_id, path, replace(reason, {nl}, '|') AS reason, class FROM classed WHERE class IS NOT NULL",
        "scanner_clean": f"WITH {verdicts} SELECT event_id AS idx, path FROM classed WHERE path NOT IN (SELECT path FROM classed WHERE class IS NOT NULL AND event_id % 10 = 3)",
        "scanner_summary": f"""WITH {verdicts}, s AS (SELECT count(*) AS t, count(DISTINCT CASE WHEN class IS NOT NULL THEN path END) AS g FROM classed)
SELECT class, count(*) AS n FROM classed WHERE class IS NOT NULL GROUP BY 1 UNION ALL SELECT 'total', t FROM s UNION ALL SELECT 'removed', g FROM s UNION ALL SELECT 'remaining', t - g FROM s""",
    }
