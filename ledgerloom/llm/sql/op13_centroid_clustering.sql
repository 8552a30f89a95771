WITH RECURSIVE kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64),
start AS (SELECT list(v ORDER BY h, v) AS cents FROM (SELECT * FROM kept ORDER BY h, v LIMIT 8) s),
rounds AS (
  SELECT 0 AS r, cents FROM start
  UNION ALL
  SELECT r + 1, list(coalesce(moved, old) ORDER BY k)
  FROM (
    SELECT c.r, c.k, any_value(c.old) AS old,
           CASE WHEN count(a.v) > 0 THEN list_transform(range(1, 65), lambda i:
             CAST((list_sum(list_transform(list(a.v) FILTER (a.v IS NOT NULL), lambda w: CAST(w[i] AS HUGEINT)))
               - ((list_sum(list_transform(list(a.v) FILTER (a.v IS NOT NULL), lambda w: CAST(w[i] AS HUGEINT))) % count(a.v)) + count(a.v)) % count(a.v)) // count(a.v) AS BIGINT)) END AS moved
    FROM (SELECT r, unnest(range(1, len(cents) + 1)) AS k, unnest(cents) AS old FROM rounds WHERE r < 10) c
    LEFT JOIN (
      SELECT v, list_position(ds, list_min(ds)) AS k
      FROM (SELECT v, list_transform(cents, lambda c: list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS ds
            FROM kept, rounds WHERE r < 10) d) a ON a.k = c.k
    GROUP BY c.r, c.k) g
  GROUP BY r),
assigned AS MATERIALIZED (
  SELECT vec_id, list_position(ds, list_min(ds)) AS k, CAST(list_min(ds) AS BIGINT) AS distance, cents
  FROM (SELECT vec_id, cents, list_transform(cents, lambda c: list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS ds
        FROM kept, rounds WHERE r = 10) d)
SELECT vec_id, CAST(k - 1 AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(cents[k], ',')) AS centroid_sha256
FROM assigned
