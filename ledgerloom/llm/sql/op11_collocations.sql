WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
counted AS MATERIALIZED (
  SELECT lang, phrase, any_value(size) AS size, count(*) AS f
  FROM (SELECT lang, 1 AS size, unnest(ws) AS phrase FROM listed
        UNION ALL
        SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM listed
        UNION ALL
        SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM listed) x
  GROUP BY lang, phrase),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE size > 1 AND f >= 10),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, 1 AS k, ws[1] AS lp, array_to_string(ws[2:size], ' ') AS rp FROM cand
  UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM cand WHERE size = 3),
cuts AS MATERIALIZED (
  SELECT c.lang, c.phrase, c.a, c.k, lc.f AS l, rc.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (lc.f::HUGEINT * rc.f) AS BIGINT) AS score
  FROM parts c JOIN counted lc ON lc.lang = c.lang AND lc.phrase = c.lp JOIN counted rc ON rc.lang = c.lang AND rc.phrase = c.rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS outer_f
  FROM (SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM cand WHERE size = 3
        UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM cand WHERE size = 3) x
  GROUP BY 1, 2),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.outer_f IS NULL OR 100 * o.outer_f < 50 * b.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang
WHERE r.rank <= 2000
