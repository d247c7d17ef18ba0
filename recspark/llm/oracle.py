"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .divergence import MIN_DOCS, SCALE, TOP_TERMS
from .licenses import FILE_SHARE, TEMPLATES, THRESHOLD

# Words are runs of anything but ASCII white space.
_WORDS = "[^\\x20\\x09-\\x0D]+"

_TEMPLATES = ", ".join(
    f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))

OP2 = f"""
WITH templates(k, license, body) AS (VALUES {_TEMPLATES}),
tt AS (SELECT k, license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term
       FROM templates),
files AS (
  SELECT doc_id, coalesce(text, '') AS text,
         concat_ws('/', coalesce(source, 'none'),
                   CASE WHEN doc_id % 4 > 0 THEN coalesce(lang, 'none') END,
                   CASE WHEN doc_id % 4 > 1 THEN (doc_id % 100)::VARCHAR END) AS dir
  FROM documents),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM files),
seen AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(w) AS term FROM words)
         WHERE term IN (SELECT term FROM tt)),
total AS (SELECT count(*) AS n FROM files),
idf AS (
  SELECT v.term, ln((1 + (SELECT n FROM total)) / (1 + count(s.term))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM tt) v LEFT JOIN seen s ON s.term = v.term GROUP BY v.term),
raw AS (SELECT k, license, term, count(*) * any_value(idf) AS x
        FROM tt JOIN idf USING (term) GROUP BY ALL),
weights AS (SELECT k, license, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS w FROM raw),
parts AS (
  SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])[ \\t]+', '\\1\n', 'g'),
                                    '[\\r\\n]+') AS p FROM files),
lines AS (SELECT doc_id, unnest(p) AS body, generate_subscripts(p, 1) AS line FROM parts),
terms AS (
  SELECT doc_id, line, term, count(*) AS n FROM (
    SELECT doc_id, line, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM lines)
  GROUP BY ALL),
weighed AS (
  SELECT t.*, t.n * coalesce(i.idf, ln((1 + (SELECT n FROM total)) / 2.0) + 1) AS x
  FROM terms t LEFT JOIN idf i ON i.term = t.term),
sizes AS (SELECT doc_id, line, sqrt(sum(x * x)) AS size, sum(n) AS length
          FROM weighed GROUP BY ALL),
scores AS (
  SELECT d.*, s.length, round(dot / size, 9) AS score FROM (
    SELECT doc_id, line, k, license, sum(x * w) AS dot
    FROM weighed JOIN weights USING (term) GROUP BY ALL) d
  JOIN sizes s USING (doc_id, line)
  WHERE round(dot / size, 9) >= {THRESHOLD}),
own AS (
  SELECT doc_id, arg_min(license, (-score, license)) AS license, max(score) AS score
  FROM scores GROUP BY doc_id),
share AS (
  SELECT doc_id, sum(length) AS length
  FROM (SELECT DISTINCT doc_id, line, length FROM scores) GROUP BY doc_id),
votes AS (
  SELECT f.dir, o.license, count(*) AS n
  FROM own o JOIN share USING (doc_id) JOIN files f USING (doc_id) JOIN words USING (doc_id)
  WHERE share.length / len(w) >= {FILE_SHARE} GROUP BY ALL),
licensed AS (SELECT dir, arg_min(license, (-n, license)) AS license FROM votes GROUP BY dir),
ups AS (
  SELECT dir, unnest([array_to_string(string_split(dir, '/')[1:i], '/')
                      for i in range(1, len(string_split(dir, '/')) + 1)]) AS up
  FROM (SELECT DISTINCT dir FROM files)),
near AS (
  SELECT u.dir, arg_max(u.up, length(u.up)) AS up, arg_max(l.license, length(u.up)) AS license
  FROM ups u JOIN licensed l ON l.dir = u.up GROUP BY u.dir)
SELECT f.doc_id, f.dir || '/' || f.doc_id || '.txt' AS path,
       coalesce(o.license, n.license) AS license,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' END
         AS how,
       round(o.score, 6) AS score, CASE WHEN o.license IS NULL THEN n.up END AS from_directory
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN near n USING (dir)
"""

OP8 = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept,
       sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d
JOIN (SELECT coalesce(text, '') AS text, max(doc_id) AS keep_id, count(*) AS group_size
      FROM documents GROUP BY 1) g ON coalesce(d.text, '') = g.text
"""

OP9 = f"""
WITH rows_ AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' ||
                             md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
              WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM rows_ GROUP BY source),
ends AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER o AS pos, sum(2 * source_size) OVER o AS full_,
         sum(w) OVER () - sum(w) OVER o AS left_, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM sizes
  WINDOW o AS (ORDER BY 2 * source_size / w, encode(source) NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
level_ AS (
  SELECT min_by((total - full_ + cap) / (left_ + w), pos) AS x
  FROM ends WHERE full_ + cap / w * left_ >= total),
plan_ AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes
  FROM (SELECT source, source_size, coalesce(least(cap::DOUBLE, w * x), cap::DOUBLE) AS target
        FROM ends, level_)),
groups_ AS (
  SELECT source, h, sum(size) AS size FROM rows_ GROUP BY source, h),
upto AS (
  SELECT g.*, p.target - p.passes * p.source_size AS need,
         sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
  FROM groups_ g JOIN plan_ p ON g.source IS NOT DISTINCT FROM p.source),
edges AS (
  SELECT source, min_by(CASE WHEN 2 * (need - upto + size) >= size THEN h + 1 ELSE h END, h) AS below
  FROM upto WHERE need > 0 AND upto > need GROUP BY source)
SELECT r.doc_id, r.size, p.source_size, round(p.target, 6) AS target,
       (r.size * (p.passes + CASE WHEN r.h < coalesce(e.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows_ r
JOIN plan_ p ON r.source IS NOT DISTINCT FROM p.source
LEFT JOIN edges e ON r.source IS NOT DISTINCT FROM e.source
"""

OP10 = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank
  FROM scored)
WHERE rank <= 20
"""

# Sets and links as defined; components by the smallest id that links reach.
OP4 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN coalesce(len(w), 0) = 0 THEN []
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
  WHERE 100 * c >= 80 * (m.n + n.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS seen FROM ways
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN ways l ON r.seen = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles,
       coalesce(r.component_id, d.doc_id) AS component_id
FROM documents d
LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) r
  ON r.doc_id = d.doc_id
"""

# Anchors, positives and windows as defined, over all pairs.
OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
good AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT g.anchor_id, g.positive_id,
       (row_number() OVER (PARTITION BY g.anchor_id, g.positive_id
                           ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, g.positive_score, s.score AS negative_score
FROM good g JOIN scored s ON s.anchor_id = g.anchor_id AND NOT s.same
  AND 100 * s.score BETWEEN 30 * g.positive_score AND 90 * g.positive_score
QUALIFY rank <= 10
"""

# Terms, kept ones, shares and divergences as defined; sums in 128-bit integers.
OP12 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
seen AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
lt AS (SELECT lang, term, count(*)::HUGEINT AS n FROM seen GROUP BY ALL
       HAVING count(DISTINCT d) >= {MIN_DOCS}),
lang_ AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM lt GROUP BY lang),
gt AS (SELECT s.lang, s.source, s.term, count(*)::HUGEINT AS n
       FROM seen s SEMI JOIN lt ON lt.lang = s.lang AND lt.term = s.term GROUP BY ALL),
grp AS (
  SELECT g.lang, g.source, coalesce(t.total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM gt GROUP BY ALL) t
    ON t.lang = g.lang AND t.source = g.source),
p AS (
  SELECT g.lang, g.source, lt.term, coalesce(gt.n, 0) AS n,
         1 + ({SCALE}::HUGEINT * (coalesce(gt.n, 0) + 1)) // (g.total + l.v) AS p,
         1 + ({SCALE}::HUGEINT * (lt.n + 1)) // (l.total + l.v) AS q
  FROM grp g JOIN lt ON lt.lang = g.lang JOIN lang_ l ON l.lang = g.lang
  LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source AND gt.term = lt.term),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT
  FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part
                                ORDER BY value DESC, encode(item)))::INTEGER AS rank
  FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

ORACLE_SQL = {
    "op2_licenses": OP2,
    "op4_ngram_jaccard": OP4,
    "op8_exact_dedup": OP8,
    "op9_mixing": OP9,
    "op10_topk": OP10,
    "op11_hard_negatives": OP11,
    "op12_divergence": OP12,
}
