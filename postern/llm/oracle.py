"""DuckDB SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from postern.llm.mixing import MIX_SQL

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""

REACH_SQL = """
reach AS (
  SELECT a AS node, b AS other FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
"""

EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id
  WHERE list_inner_product(p.x, q.x) / (sqrt(list_inner_product(p.x, p.x)) * sqrt(list_inner_product(q.x, q.x))) >= 0.9
), {REACH_SQL}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON node = e.vec_id
"""

NGRAM_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id), overlap AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM overlap JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * i >= 90 * (s.n + t.n - i)
), {REACH_SQL}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON node = d.doc_id
"""

SUFFIX_SQL = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM bytes)
), firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING count(*) > 1), hits AS (
  SELECT w.doc_id, w.p, lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) AS before FROM windows w JOIN firsts f ON f.s = w.s AND f.first < w.doc_id
), numbered AS (
  SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits
), runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run), gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS open FROM runs
), cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, list({'f': open, 't': a} ORDER BY a) AS parts FROM gaps GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN parts IS NULL THEN h ELSE array_to_string(list_transform(parts, lambda x: substr(h, 2 * x.f + 1, 2 * (x.t - x.f))), '') || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM bytes d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""

# CRC-32 of a list of byte values: the table follows from its polynomial
CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc_sql(values: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {values}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


def bytes_sql(digits: str) -> str:
    """Byte values of a text of hexadecimal digits."""
    digit = lambda k: f"strpos('123456789ABCDEF', {digits}[CAST(2 * p + {k} AS BIGINT)])"
    return f"list_transform(range(0, length({digits}) // 2), lambda p: CAST({digit(1)} * 16 + {digit(2)} AS BIGINT))"


SHARDING_SQL = f"""
WITH crc AS {CRC_TABLE}, d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, md5(coalesce(text, '')) AS g, strlen(coalesce(text, '')) + 1 AS size, row_number() OVER () AS r FROM documents
), hexed AS (SELECT *, hex(b) AS h FROM d), o AS (
  SELECT doc_id, h, g, r, size, CAST(sum(size) OVER (ORDER BY g, doc_id, r ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM hexed
), groups AS (SELECT g, min(before) AS low, max(before + size) AS high FROM o GROUP BY g), inside AS (
  SELECT k, total, before, before + size AS after, low, high FROM (SELECT unnest(range(1, 16)) AS k) JOIN o ON 16 * before <= k * total AND k * total < 16 * (before + size) JOIN groups USING (g)
), edges AS (
  SELECT CASE WHEN 200 * least(abs(16 * low - k * total), abs(16 * high - k * total)) <= total
    THEN CASE WHEN abs(16 * low - k * total) <= abs(16 * high - k * total) THEN low ELSE high END
    ELSE CASE WHEN abs(16 * before - k * total) <= abs(16 * after - k * total) THEN before ELSE after END END AS edge FROM inside
), placed AS (
  SELECT doc_id, size, h, g, r, (SELECT count(*) FROM edges WHERE edge <= before) AS shard FROM o
)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  {crc_sql(bytes_sql("h"))} AS text_crc32,
  'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY g, doc_id, r) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, crc
"""

SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), sized AS (
  SELECT doc_id, r, w, CAST(len(w) AS BIGINT) AS n, CAST(count(*) OVER () AS BIGINT) AS docs, CAST(sum(len(w)) OVER () AS BIGINT) AS total FROM d WHERE len(w) > 0
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), counted AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), (SELECT DISTINCT docs FROM sized)
), scored AS (
  SELECT item_id, s.doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sized s USING (r) GROUP BY item_id, s.doc_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

VARIANTS_SQL = f"""
WITH RECURSIVE crc AS {CRC_TABLE}, seen AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
  ) WHERE length(run) >= 6 GROUP BY doc_id, run
), blobs AS (SELECT run, times, hex(encode(doc_id || ':' || run)) AS b FROM seen), checked AS (
  SELECT run, times, {crc_sql(bytes_sql("b"))} AS h FROM blobs, crc
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, times FROM checked
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cuts AS (
  SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.rest = y.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n,
    CASE WHEN top >= 5 * w.n THEN (SELECT min(other) FROM pairs p WHERE p.word = w.word AND other_n = top) END AS form
  FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS reached, 0 AS step FROM formed
  UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN formed f ON f.word = s.reached WHERE f.form IS NOT NULL
)
SELECT f.word, form, (SELECT max_by(reached, step) FROM steps s WHERE s.word = f.word) AS root, n, n_near, form_n FROM formed f
"""

ORACLE = {"op1_topk": TOP_K_SQL, "op2_ngram_join": NGRAM_SQL, "op3_embedding_dedup": EMBEDDING_SQL, "op4_mixing": MIX_SQL, "op8_suffix_dedup": SUFFIX_SQL, "op11_sharding": SHARDING_SQL, "op12_lexical_search": SEARCH_SQL, "op13_variants": VARIANTS_SQL}
