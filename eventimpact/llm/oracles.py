"""DuckDB SQL of the queries of this folder that SQL can express."""

from __future__ import annotations


def centroid_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    """k-means in integers: every round is an assignment of all vectors and a new table of centroids."""
    square = "CAST(list_sum(list_transform(range(1, {d}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT)".format(d=dim + 1)
    parts = [f"""
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dim}
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM
  (SELECT sha256('{seed}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY 1, 2 LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT v.vec_id, any_value(v.x) AS x, min(struct_pack(d := {square}, c := c.c)) AS m
  FROM (SELECT row_number() OVER () AS n, * FROM v) v CROSS JOIN c{r} c GROUP BY v.n, v.vec_id)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN
  (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM
    (SELECT m.c AS c, i, sum(x[i]) AS t, count(*) AS n FROM a{r}, range(1, {dim + 1}) r(i) GROUP BY 1, 2) GROUP BY c) s USING (c))""")
    last = f"a{rounds}"
    return "WITH " + ",".join(parts) + f"""
SELECT vec_id, CAST(m.c AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM {last} a JOIN c{rounds} c ON c.c = a.m.c"""


def spelling_sql(ratio: int = 5, least_length: int = 6, least_n: int = 5, drop: int = 199) -> str:
    """Words, near words by shared deletions, forms and roots. DuckDB has no crc32: it is folded over the bytes."""
    low = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT id, {low} AS run, count(*) AS n FROM (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {least_length} GROUP BY 1, 2),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
      ELSE [CAST(192 | (unicode(c) >> 6) AS BIGINT), CAST(128 | (unicode(c) & 63) AS BIGINT)] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs CROSS JOIN crc_table),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % {drop} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word, n FROM hashed) WHERE length(word) >= {least_length} GROUP BY word HAVING sum(n) >= {least_n}),
cuts AS MATERIALIZED (SELECT word, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.l = b.l AND a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.d = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.d = w.word),
best AS MATERIALIZED (SELECT p.word, count(*) AS n_near, min(struct_pack(less := -w.n, form := p.other)) AS b
  FROM near p JOIN words w ON w.word = p.other GROUP BY p.word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {ratio} * w.n THEN b.form END AS form,
  CASE WHEN -b.less >= {ratio} * w.n THEN -b.less END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM forms
  UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k ON k.word = f.word
JOIN forms e ON e.word = k.root AND e.form IS NULL"""
