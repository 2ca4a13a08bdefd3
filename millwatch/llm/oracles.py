"""DuckDB SQL of the operators that SQL can express; none is given where it cannot."""

from __future__ import annotations

LLM_SQL: dict[str, str] = {}

LLM_SQL["op1_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, UNNEST(string_split(COALESCE(text, ''), chr(10))) AS line, generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines),
firsts AS (SELECT k, MIN(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT keyed.*, COALESCE(first < doc_id, FALSE) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped,
    sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

LLM_SQL["op9_mixing"] = r"""
WITH RECURSIVE sizes AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM totals),
-- One row per pass: the level that is shared while the sources of the earlier passes stay at their caps.
level AS (
    SELECT 0 AS pass, SUM(source_size) / SUM(weight) AS per_weight, CAST(-1 AS DOUBLE) AS before FROM weighed
    UNION ALL
    SELECT pass + 1, (SELECT (SUM(source_size) - SUM(CASE WHEN cap <= per_weight * weight THEN cap ELSE 0 END)) / NULLIF(SUM(CASE WHEN cap <= per_weight * weight THEN 0 ELSE weight END), 0) FROM weighed), per_weight
    FROM level WHERE per_weight <> before AND per_weight IS NOT NULL),
settled AS (SELECT max_by(per_weight, pass) AS per_weight FROM level),
targets AS (
    SELECT source, source_size, CASE WHEN per_weight IS NULL OR cap <= per_weight * weight THEN CAST(cap AS DOUBLE) ELSE per_weight * weight END AS target
    FROM weighed, settled),
placed AS (
    SELECT doc_id, size, source_size, target,
        row_number() OVER (PARTITION BY sizes.source ORDER BY size, doc_id % 64, doc_id) AS place,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5('7:' || COALESCE('s' || sizes.source, 'n')), 1, 8) AS BIGINT) / 4294967296.0 AS shift
    FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
    CAST(LEAST(floor(rate * place + shift) - floor(rate * (place - 1) + shift), 3) AS BIGINT) * size AS taken
FROM placed
"""

LLM_SQL["op5_substring_dedup"] = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS words
    FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 11)) AS pos FROM texts WHERE len(w) >= 13)),
firsts AS (SELECT words, MIN(doc_id) AS first FROM windows GROUP BY words),
gone AS (
    SELECT DISTINCT doc_id, UNNEST(range(pos, pos + 13)) AS pos
    FROM windows JOIN firsts USING (words) WHERE first < doc_id),
words AS (SELECT doc_id, UNNEST(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
judged AS (SELECT words.*, gone.pos IS NOT NULL AS lost FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos),
kept AS (
    SELECT doc_id, COUNT(*) FILTER (lost) AS n_removed, COALESCE(string_agg(word, ' ' ORDER BY pos) FILTER (NOT lost), '') AS text
    FROM judged GROUP BY doc_id)
SELECT texts.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

LLM_SQL["op6_top_k"] = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

LLM_SQL["op3_embedding_dedup"] = """
WITH RECURSIVE good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
    SELECT vec_id AS node, vec_id AS root FROM embeddings
    UNION
    SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node WHERE reach.root < links.b)
SELECT vec_id, (SELECT COUNT(*) FROM links WHERE a = vec_id) AS n_links, MIN(root) AS component_id, vec_id = MIN(root) AS kept
FROM embeddings JOIN reach ON node = vec_id GROUP BY vec_id
"""

_SQUARED = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
_ROUNDS = ",".join(
    f"""
a{i} AS (
    SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, MIN(d) AS d
    FROM (SELECT vec_id, v, cluster, {_SQUARED} AS d FROM good, c{i}) GROUP BY vec_id, v)"""
    + f""",
m{i} AS (
    SELECT cluster, list(m ORDER BY pos) AS c
    FROM (
        SELECT cluster, pos, CAST((SUM(x) - ((SUM(x) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*) AS BIGINT) AS m
        FROM (SELECT cluster, UNNEST(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY cluster, pos)
    GROUP BY cluster),
c{i + 1} AS (SELECT c{i}.cluster, COALESCE(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""
    for i in range(4)
)

LLM_SQL["op12_centroids"] = f"""
WITH good AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
    SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, c
    FROM (SELECT sha256('1:' || vec_id) AS h, v AS c FROM good ORDER BY h NULLS LAST LIMIT 16)),
{_ROUNDS.strip()},
sums AS (SELECT cluster, CAST(SUM(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT vec_id, CAST(a3.cluster AS INT) AS cluster, d AS distance, cluster_inertia, CAST((SELECT SUM(d) FROM a3) AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN sums USING (cluster) JOIN c3 USING (cluster)
"""
