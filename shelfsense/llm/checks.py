"""DuckDB SQL that must give the same rows as the queries of the same name."""

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"



def _clustering(k: int = 40, rounds: int = 5) -> str:
    """k-means by measuring every distance, one pair of table expressions per round."""
    apart = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v
  FROM e ORDER BY sha256('2:' || vec_id) LIMIT {k})"""
    ]
    for turn in range(rounds + 1):
        parts.append(f"""a{turn} AS MATERIALIZED (
  SELECT vec_id, e.v, c, CAST({apart} AS BIGINT) AS d FROM e, c{turn} AS c
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if turn < rounds:
            parts.append(f"""c{turn + 1} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{turn}, range(1, 65) AS r(i) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, v FROM c{turn} WHERE c NOT IN (SELECT c FROM a{turn}))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.c = c.c"""


SQL = {
    "op4_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
""",
    "op5_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, k.n, i, array_to_string(w[i:i + k.n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(generate_series(1, len(w) - k.n + 1)) AS s(i)
), h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op11_warc": f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages
), h AS (SELECT *, sha1(body) AS hex FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '')
         AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM h
""",
    "op12_centroid_clustering": _clustering(),
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS pos, h, w FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
    FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, list(h || ':' || w ORDER BY pos) AS turns,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
             lambda x: ascii(x)::BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id
), whole AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
  FROM own AS o LEFT JOIN own AS b ON b.conv_id = o.conv_id - o.conv_id % 20
), member AS (
  SELECT conv_id, d, array_to_string(turns[1:d], ' ') AS path, d = len(turns) AS ends,
         CASE WHEN d > 0 THEN array_to_string(turns[1:d - 1], ' ') END AS up,
         CASE WHEN d > 0 THEN CAST(split_part(turns[d], ':', 2) AS BIGINT) ELSE 0 END AS w
  FROM whole, unnest(generate_series(0, len(turns))) AS s(d)
), node AS (
  SELECT path, d, up, w, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM member GROUP BY path, d, up, w
), kids AS (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.up = node.path),
below AS (
  SELECT u.path, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.w) AS saved
  FROM full_node AS u JOIN full_node AS m ON m.path = u.path OR u.d = 0 OR starts_with(m.path, u.path || ' ')
  GROUP BY u.path
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
       n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node AS n JOIN below USING (path) LEFT JOIN node AS p ON p.path = n.up
""",
}
