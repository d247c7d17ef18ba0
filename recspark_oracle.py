"""SQL statements the registered queries are checked against, built from shared WITH parts."""

from __future__ import annotations

# Stop words of the registered text queries (a parameter of the text index).
STOP_WORDS = [
    "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he",
    "her", "his", "if", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "she",
    "so", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was",
    "we", "were", "which", "will", "with", "you",
]

_INTER = """
inter AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(floor((l_quantity - 1) / 10) + 1 AS DOUBLE) AS rating,
         md5(concat_ws('|', 42, o_custkey, l_partkey, l_orderkey, l_linenumber, l_suppkey,
                       CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_SPLIT = _INTER + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_key, item_id, rating) AS rk,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM inter),
labelled AS (
  SELECT user_id, item_id, rating, row_key,
         CASE WHEN rk <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM numbered),
train AS (SELECT user_id, item_id, rating, row_key FROM labelled WHERE split = 'train'),
test AS (SELECT user_id, item_id, rating, row_key FROM labelled WHERE split = 'test')"""

_STATS = _SPLIT + """,
istats AS (SELECT item_id, count(*) AS n_ratings, sum(rating) AS sum_rating,
                  avg(rating) AS avg_rating FROM train GROUP BY 1),
ipos AS (SELECT *, row_number() OVER (ORDER BY n_ratings DESC, item_id) AS pos,
                n_ratings / max(n_ratings) OVER () AS popularity FROM istats),
hist AS (SELECT DISTINCT user_id, item_id FROM train),
sizes AS (SELECT user_id, count(*) AS n_train FROM hist GROUP BY 1),
raters AS (SELECT item_id, count(*) AS n_raters FROM hist GROUP BY 1)"""

_LISTS = _STATS + """,
lists AS (
  SELECT user_id, item_id, rank, CAST(n_ratings AS DOUBLE) AS score FROM (
    SELECT s.user_id, p.item_id, p.n_ratings,
           row_number() OVER (PARTITION BY s.user_id ORDER BY p.pos) AS rank
    FROM sizes s JOIN ipos p ON p.pos <= 15 + s.n_train
    WHERE NOT EXISTS (SELECT 1 FROM hist h
                      WHERE h.user_id = s.user_id AND h.item_id = p.item_id))
  WHERE rank <= 15),
recs AS (SELECT * FROM lists WHERE rank <= 10)"""

_IDEAL = """ideal AS (SELECT m, sum(1 / log2(m + 1)) OVER (ORDER BY m) AS idcg
                      FROM range(1, 11) t(m))"""


def _metrics(lists: str, min_train: int, threshold: float | None, tag: str = "") -> str:
    """WITH parts giving per-user list metrics ``per<tag>`` of a table of lists."""
    where = f"WHERE rating >= {threshold}" if threshold is not None else ""
    return f"""
rel{tag} AS (SELECT user_id, item_id, count(*) AS c FROM test {where} GROUP BY 1, 2),
eval{tag} AS (
  SELECT r.user_id, CAST(sum(c) AS BIGINT) AS n_rel_rows, count(*) AS n_rel_items,
         any_value(n_train) AS n_train
  FROM rel{tag} r JOIN sizes s USING (user_id) WHERE n_train >= {min_train} GROUP BY 1),
hits{tag} AS (
  SELECT l.user_id, count(*) AS hits, sum(1 / log2(l.rank + 1)) AS dcg
  FROM {lists} l JOIN rel{tag} USING (user_id, item_id) WHERE l.rank <= 10 GROUP BY 1),
per{tag} AS (
  SELECT e.user_id, e.n_train, coalesce(hits, 0) AS hits, coalesce(hits, 0) / 10.0 AS precision,
         coalesce(hits, 0) / n_rel_rows AS recall, coalesce(dcg, 0) / idcg AS ndcg
  FROM eval{tag} e LEFT JOIN hits{tag} USING (user_id)
  JOIN ideal ON m = least(n_rel_items, 10))"""


def _f(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2.0 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


def _summary(tag: str = "") -> str:
    return f"""
SELECT round(p, 9) AS "Precision", round(r, 9) AS "Recall", round({_f('p', 'r')}, 9) AS "F_measure",
       round(n, 9) AS "NDCG", k AS n_users_eval
FROM (SELECT coalesce(avg(precision), 0) AS p, coalesce(avg(recall), 0) AS r,
             coalesce(avg(ndcg), 0) AS n, count(*) AS k FROM per{tag})"""


_PER_USER = (
    _LISTS + ", " + _IDEAL + "," + _metrics("recs", 5, 4.0) + """,
cover AS (SELECT (SELECT count(DISTINCT item_id) FROM recs JOIN eval USING (user_id))
                 / (SELECT count(DISTINCT item_id) FROM train) AS catalog_coverage),
listpop AS (SELECT user_id, avg(popularity) AS pop FROM recs JOIN ipos USING (item_id) GROUP BY 1),
pu AS (SELECT user_id AS "user", n_train, precision, recall, ndcg,
              CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit_rate,
              coalesce(pop, 0) AS avg_recommended_popularity, catalog_coverage
       FROM per LEFT JOIN listpop USING (user_id), cover)"""
)

_BUCKETS = _PER_USER + """,
edges AS (SELECT DISTINCT unnest(quantile_cont(n_train, [0.25, 0.5, 0.75, 1.0])) AS edge FROM pu),
bucketed AS (SELECT pu.*, (SELECT min(edge) FROM edges WHERE edge >= n_train) AS bucket FROM pu),
summary AS (
  SELECT bucket, count(*) AS n_users, min(n_train) AS min_train, max(n_train) AS max_train,
         avg(ndcg) AS mean_ndcg, stddev_samp(ndcg) AS std_ndcg, median(ndcg) AS median_ndcg,
         avg(precision) AS mean_precision, stddev_samp(precision) AS std_precision,
         median(precision) AS median_precision, avg(recall) AS mean_recall,
         stddev_samp(recall) AS std_recall, median(recall) AS median_recall,
         avg(hit_rate) AS mean_hit_rate,
         avg(avg_recommended_popularity) AS mean_recommended_popularity,
         avg(catalog_coverage) AS mean_catalog_coverage
  FROM bucketed GROUP BY 1)"""


def _ratio(col: str) -> str:
    return (f"CASE WHEN count(*) FILTER ({col} > 0) >= 2 THEN max({col}) "
            f"/ min({col}) FILTER ({col} > 0) END")


def _gap(table: str, cold: int = 15, warm: int = 40) -> str:
    """One row with both sides of the activity range."""
    parts = [f"CAST(count(*) FILTER (n_train <= {cold}) AS DOUBLE) AS n_cold_users",
             f"CAST(count(*) FILTER (n_train >= {warm}) AS DOUBLE) AS n_warm_users"]
    for m in ("ndcg", "precision", "recall"):
        parts.append(f"coalesce(avg({m}) FILTER (n_train <= {cold}), 0) AS cold_mean_{m}")
        parts.append(f"coalesce(avg({m}) FILTER (n_train >= {warm}), 0) AS warm_mean_{m}")
    return f"SELECT {', '.join(parts)} FROM {table}"


_GAP_COLUMNS = ", ".join(
    ["n_cold_users", "n_warm_users"]
    + [f"round(cold_mean_{m}, 9) AS cold_mean_{m}, round(warm_mean_{m}, 9) AS warm_mean_{m}, "
       f"round(warm_mean_{m} - cold_mean_{m}, 9) AS cold_warm_{m}_gap"
       for m in ("ndcg", "precision", "recall")]
)

_OVERLAP = """
overlap AS (SELECT a.item_id AS ia, b.item_id AS ib, count(*) AS c
            FROM hist a JOIN hist b USING (user_id) WHERE a.item_id <> b.item_id GROUP BY 1, 2)"""

_SUPPORTS = _LISTS + "," + _OVERLAP + """,
own AS (SELECT user_id, item_id, max(rating) AS rating FROM train GROUP BY 1, 2),
hsup AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id
             ORDER BY user_overlap DESC, similarity DESC, avg_rating DESC, support_item) AS rank
    FROM (SELECT r.user_id, r.item_id, o.item_id AS support_item, c AS user_overlap,
                 ra.n_raters + rb.n_raters - c AS user_union,
                 c / (ra.n_raters + rb.n_raters - c) AS similarity, o.rating AS avg_rating
          FROM RECS r JOIN own o ON o.user_id = r.user_id AND o.rating >= 4
          JOIN overlap ON ia = r.item_id AND ib = o.item_id
          JOIN raters ra ON ra.item_id = ia JOIN raters rb ON rb.item_id = ib))
  WHERE rank <= 3),
near AS (
  SELECT ia AS item_id, ib AS support_item, c AS user_overlap,
         ra.n_raters + rb.n_raters - c AS user_union,
         c / (ra.n_raters + rb.n_raters - c) AS similarity, s.avg_rating
  FROM overlap JOIN raters ra ON ra.item_id = ia JOIN raters rb ON rb.item_id = ib
  JOIN istats s ON s.item_id = ib WHERE ia IN (SELECT item_id FROM RECS)),
ssup AS (
  SELECT * FROM (
    SELECT r.user_id, n.*, row_number() OVER (PARTITION BY r.user_id, r.item_id
             ORDER BY similarity DESC, user_overlap DESC, avg_rating DESC, support_item) AS rank
    FROM RECS r JOIN near n USING (item_id)
    WHERE NOT EXISTS (SELECT 1 FROM hist h
                      WHERE h.user_id = r.user_id AND h.item_id = n.support_item))
  WHERE rank <= 3)"""

_SUPPORT_COLUMNS = """user_id, item_id, rank, support_item, user_overlap, user_union,
       round(similarity, 9) AS similarity, round(avg_rating, 9) AS avg_rating"""


def _ratio_text(num: str, den: str) -> str:
    h = f"CAST((200 * {num} + {den}) // (2 * {den}) AS BIGINT)"
    return f"(CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0'))"


_EXPLAIN = _SUPPORTS + f""",
expl AS (
  SELECT r.user_id, r.item_id AS recommended_item,
         CASE WHEN h.support_item IS NOT NULL THEN 'history_and_overlap'
              WHEN z.n_train > 0 THEN 'profile_support' ELSE 'cold_start_popularity' END
           AS explanation_type,
         CASE WHEN h.support_item IS NOT NULL THEN
           'Recommended because your strong interaction with ' || h.support_item
           || ' is supported by ' || h.user_overlap || ' overlapping users and item similarity '
           || {_ratio_text('h.user_overlap', 'h.user_union')} || '.'
         WHEN z.n_train > 0 THEN
           'Recommended from your broader interaction profile and local item-neighborhood support '
           || 'around ' || r.item_id || '.'
         ELSE 'Recommended mainly from global popularity because there is little or no user '
           || 'history.' END AS explanation_text,
         CASE WHEN h.support_item IS NULL AND s.support_item IS NULL THEN 0.15 ELSE
           greatest(0.0, least(1.0, 0.55 * least(coalesce(h.user_overlap, 0) / 5.0, 1.0)
             + 0.30 * coalesce(h.similarity, 0.0) + 0.15 * coalesce(s.similarity, 0.0))) END
           AS support_confidence,
         (SELECT count(*) FROM hsup x WHERE x.user_id = r.user_id AND x.item_id = r.item_id)
           AS n_history,
         (SELECT count(*) FROM ssup x WHERE x.user_id = r.user_id AND x.item_id = r.item_id)
           AS n_similar
  FROM RECS r LEFT JOIN hsup h ON h.user_id = r.user_id AND h.item_id = r.item_id AND h.rank = 1
  LEFT JOIN ssup s ON s.user_id = r.user_id AND s.item_id = r.item_id AND s.rank = 1
  LEFT JOIN sizes z ON z.user_id = r.user_id)"""

_NEXT = """
next AS (
  SELECT *, CASE WHEN score IS NOT NULL AND next_item_score IS NOT NULL
                 THEN greatest(0.0, score - next_item_score) END AS estimated_margin
  FROM (SELECT user_id, item_id, rank, score,
               lead(item_id) OVER (PARTITION BY user_id ORDER BY rank) AS next_item,
               lead(score) OVER (PARTITION BY user_id ORDER BY rank) AS next_item_score
        FROM LISTED))"""

_CAUSES = """
acts AS (
  SELECT *, row_number() OVER w AS rn, sum(impact) OVER w AS cum,
         count(*) OVER (PARTITION BY user_id, item_id) AS n
  FROM (SELECT user_id, item_id, support_item, user_overlap, user_union,
               greatest(0.0, least(1.0, 0.55 * least(user_overlap / 5.0, 1.0) + 0.30 * similarity
                 + 0.15 * least(avg_rating / 5.0, 1.0))) AS impact FROM hsup)
  WINDOW w AS (PARTITION BY user_id, item_id ORDER BY -impact, support_item)),
joined AS (
  SELECT a.user_id, a.item_id, string_agg(CAST(a.support_item AS VARCHAR), ', ' ORDER BY a.rn)
           AS names
  FROM acts a JOIN next x USING (user_id, item_id)
  WHERE a.cum - a.impact < x.estimated_margin OR a.rn = 1 GROUP BY 1, 2),
cf AS (
  SELECT e.user_id, e.recommended_item, x.rank AS current_rank, x.score AS current_score,
         x.next_item, x.next_item_score, x.estimated_margin,
         e.n_history AS n_actions, a.support_item AS first_item, a.impact AS first_impact,
         'Support item ' || a.support_item || ' contributes overlap=' || a.user_overlap
           || ' and similarity=' || RATIO || '.' AS first_reason,
         CASE WHEN a.support_item IS NULL THEN
           'If broader popularity or neighborhood support for ' || e.recommended_item
           || ' weakened, its position would likely fall.'
         WHEN a.n > 1 AND x.estimated_margin IS NOT NULL AND a.impact < x.estimated_margin THEN
           'If support from ' || j.names || ' were jointly weakened, ' || e.recommended_item
           || ' would likely lose its current rank advantage.'
         ELSE 'If the positive interaction with ' || a.support_item
           || ' were removed or weakened, ' || e.recommended_item
           || ' would likely drop in rank or score.' END AS minimal_change_text,
         e.support_confidence AS confidence, e.explanation_type
  FROM expl e JOIN next x ON x.user_id = e.user_id AND x.item_id = e.recommended_item
  LEFT JOIN acts a ON a.user_id = e.user_id AND a.item_id = e.recommended_item AND a.rn = 1
  LEFT JOIN joined j ON j.user_id = e.user_id AND j.item_id = e.recommended_item)""".replace(
    "RATIO", _ratio_text("a.user_overlap", "a.user_union")
)


def _recs(sql: str, table: str) -> str:
    return sql.replace("RECS", table)


def _listed(sql: str, table: str) -> str:
    return sql.replace("LISTED", table)


_ELEVEN = "(SELECT * FROM lists WHERE rank <= 11)"


def _adjusted(source: str) -> str:
    return f"""
adj AS (
  SELECT *, row_number() OVER (PARTITION BY user_id
           ORDER BY adjusted_score DESC, base_rank, item_id) AS rank, adjusted_score AS score
  FROM (SELECT *, effective_base_score + support_boost - popularity_penalty AS adjusted_score
        FROM (SELECT l.user_id, l.item_id, l.rank AS base_rank, l.score AS raw_model_score,
                     l.score AS effective_base_score,
                     coalesce(e.support_confidence, 0.0) AS support_confidence,
                     2.0 * coalesce(e.support_confidence, 0.0) AS support_boost,
                     1.0 * coalesce(p.popularity, 0.0) AS popularity_penalty
              FROM {source} l
              LEFT JOIN expl e ON e.user_id = l.user_id AND e.recommended_item = l.item_id
              LEFT JOIN ipos p ON p.item_id = l.item_id)))"""


_CF_SIM = _STATS + """,
rated AS (
  SELECT r.user_id, r.item_id, r.rating, r.rating - s.item_mean AS dev
  FROM (SELECT user_id, item_id, arg_max(rating, row_key) AS rating FROM train GROUP BY 1, 2) r
  JOIN (SELECT item_id, round(avg_rating, 12) AS item_mean FROM istats) s USING (item_id)),
means AS (SELECT item_id, round(avg_rating, 12) AS item_mean FROM istats),
sims AS (
  SELECT item_a, item_b, greatest(0.0, num / (sqrt(da * db) + 1e-9)) AS sim
  FROM (SELECT a.item_id AS item_a, b.item_id AS item_b, sum(a.dev * b.dev) AS num,
               sum(a.dev * a.dev) AS da, sum(b.dev * b.dev) AS db
        FROM rated a JOIN rated b ON a.user_id = b.user_id AND a.item_id < b.item_id
        GROUP BY 1, 2))"""

_CF_PRED = _CF_SIM + """,
targets AS (
  SELECT DISTINCT t.user_id, t.item_id FROM test t
  WHERE t.item_id IN (SELECT item_id FROM means) AND t.user_id IN (SELECT user_id FROM rated)
    AND NOT EXISTS (SELECT 1 FROM rated r WHERE r.user_id = t.user_id AND r.item_id = t.item_id)),
nbr AS (
  SELECT t.user_id, t.item_id, r.dev, s.sim,
         row_number() OVER (PARTITION BY t.user_id, t.item_id
                            ORDER BY round(s.sim, 9) DESC, r.item_id) AS k
  FROM targets t JOIN rated r USING (user_id)
  JOIN sims s ON s.item_a = least(t.item_id, r.item_id)
             AND s.item_b = greatest(t.item_id, r.item_id)),
dev AS (SELECT user_id, item_id, CASE WHEN sum(sim) >= 1e-9 THEN sum(sim * dev) / sum(sim)
               ELSE 0.0 END AS d FROM nbr WHERE k <= 50 GROUP BY 1, 2),
pred AS (
  SELECT t.row_key, t.user_id, t.item_id, t.rating,
         CASE WHEN m.item_mean IS NOT NULL AND u.user_id IS NOT NULL
              THEN coalesce(r.rating, m.item_mean + d.d, m.item_mean)
              ELSE (SELECT avg(item_mean) FROM means) END AS prediction
  FROM test t LEFT JOIN means m USING (item_id)
  LEFT JOIN (SELECT DISTINCT user_id FROM rated) u ON u.user_id = t.user_id
  LEFT JOIN rated r ON r.user_id = t.user_id AND r.item_id = t.item_id
  LEFT JOIN dev d ON d.user_id = t.user_id AND d.item_id = t.item_id)"""

def _candidates(cut: int | None, least: int = 20, exclude: str | None = None) -> str:
    """Candidates of all users, at most ``cut`` each; ``exclude`` selects (user_id, item_id)."""
    cap = 2**31 if cut is None else cut
    taken = "SELECT user_id, item_id FROM hist" + (f" UNION {exclude}" if exclude else "")
    return _STATS + f""",
taken AS ({taken}),
elig AS (SELECT item_id, pos FROM ipos WHERE n_ratings >= {least}),
pairs AS (SELECT DISTINCT a.item_id AS anchor, b.item_id
          FROM hist a JOIN hist b USING (user_id) WHERE a.item_id <> b.item_id),
reach AS (SELECT DISTINCT h.user_id, p.item_id, e.pos
          FROM hist h JOIN pairs p ON p.anchor = h.item_id JOIN elig e ON e.item_id = p.item_id
          WHERE NOT EXISTS (SELECT 1 FROM taken x
                            WHERE x.user_id = h.user_id AND x.item_id = p.item_id)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rk
                        FROM reach) WHERE rk <= {cap}),
found AS (SELECT s.user_id, s.n_train, coalesce(max(rk), 0) AS n
          FROM sizes s LEFT JOIN kept USING (user_id) GROUP BY 1, 2),
pad AS (SELECT * FROM (
  SELECT f.user_id, e.item_id, f.n + row_number() OVER (PARTITION BY f.user_id ORDER BY e.pos)
           AS rk
  FROM found f CROSS JOIN elig e
  WHERE f.n < {cap}
    AND NOT EXISTS (SELECT 1 FROM taken x WHERE x.user_id = f.user_id AND x.item_id = e.item_id)
    AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.user_id = f.user_id AND x.item_id = e.item_id))
  WHERE rk <= {cap}),
cand AS (SELECT user_id, item_id, rk, 'cooccurrence' AS source FROM kept
         UNION ALL SELECT user_id, item_id, rk, 'popular' FROM pad)"""

# Pairs left out of rankings on top of what was seen, some of them among the most popular items.
_EXCLUDED = """SELECT s.user_id, i.item_id FROM sizes s JOIN ipos i
  ON i.pos <= 40 AND (s.user_id + i.item_id) % 3 = 0"""

# Reviews ------------------------------------------------------------------------------------------

_REVIEWS = r"""
rv AS (
  SELECT CAST(floor(doc_id / 400) * 20 + doc_id % 20 AS BIGINT) AS user_id, CAST(floor(doc_id / 10) AS BIGINT) AS item_id,
         CAST(1 + n_chars % 5 AS DOUBLE) AS rating, split_part(text, chr(10), 1) AS summary,
         text AS reviewText,
         CASE quality WHEN 1 THEN 'true' WHEN 0 THEN 'false' END AS verified,
         lang, source, doc_id AS row_key
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)),
parts AS (
  SELECT *, concat_ws(' ', CAST(CAST(rating AS INTEGER) AS VARCHAR) || ' star rating',
         CASE verified WHEN 'true' THEN 'verified purchase' WHEN 'false' THEN 'unverified review'
         END, 'Lang ' || lang || ' Source ' || source) AS meta FROM rv),
snips AS (
  SELECT user_id, item_id, row_key, trim(concat_ws(' ',
    nullif(substr(trim(regexp_replace(meta, '\s+', ' ', 'g')), 1, 120), ''),
    nullif(substr(trim(regexp_replace(summary, '\s+', ' ', 'g')), 1, 200), ''),
    nullif(substr(trim(regexp_replace(reviewText, '\s+', ' ', 'g')), 1, 400), ''))) AS snippet
  FROM parts)"""

_DOCS = _REVIEWS + """,
idocs AS (
  SELECT item_id, string_agg(snippet, ' ' ORDER BY rn) AS doc
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY row_key, snippet) AS rn
        FROM snips WHERE snippet <> '') WHERE rn <= 12 GROUP BY 1 HAVING length(doc) >= 30),
udocs AS (
  SELECT user_id, string_agg(snippet, ' ' ORDER BY rn) AS doc
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_key, snippet) AS rn
        FROM snips WHERE snippet <> '') WHERE rn <= 15 GROUP BY 1 HAVING length(doc) >= 20)"""

_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _terms(docs: str, key: str) -> str:
    return rf"""
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)),
             lambda i: w[i] || ' ' || w[i + 1]))) AS term
    FROM (SELECT {key}, list_filter(regexp_extract_all(lower(doc), '[\p{{L}}\p{{N}}_]{{2,}}'),
                                    lambda x: NOT list_contains({_STOPS}, x)) AS w FROM {docs}))
  GROUP BY 1, 2"""


_TFIDF = _DOCS + f""",
iterms AS ({_terms('idocs', 'item_id')}),
uterms AS ({_terms('udocs', 'user_id')}),
vocab AS (
  SELECT term, df, corpus_tf, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_tf FROM iterms GROUP BY 1
        HAVING count(*) >= 2 ORDER BY corpus_tf DESC, term LIMIT 3500),
       (SELECT count(*) AS n_docs FROM idocs)),
iw AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight
       FROM (SELECT item_id, term, tf * idf AS w FROM iterms JOIN vocab USING (term))),
uw AS (SELECT user_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS weight
       FROM (SELECT user_id, term, tf * idf AS w FROM uterms JOIN vocab USING (term)))"""


def _review_pool(source: str, tag: str = "") -> str:
    """Popularity lists of 80 items over a table of review rows."""
    return f"""
rstats{tag} AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS pos
                FROM {source} GROUP BY 1),
rhist{tag} AS (SELECT DISTINCT user_id, item_id FROM {source}),
sizes{tag} AS (SELECT user_id, count(*) AS n_train FROM rhist{tag} GROUP BY 1),
rpool{tag} AS (SELECT * FROM (
  SELECT s.user_id, p.item_id, row_number() OVER (PARTITION BY s.user_id ORDER BY p.pos) AS rank
  FROM sizes{tag} s JOIN rstats{tag} p ON p.pos <= 80 + s.n_train
  WHERE NOT EXISTS (SELECT 1 FROM rhist{tag} h
                    WHERE h.user_id = s.user_id AND h.item_id = p.item_id))
  WHERE rank <= 80)"""


def _text_scores(pool: str) -> str:
    return f"""
tsim AS (
  SELECT p.user_id, p.item_id, round(greatest(0.0, least(1.0, coalesce(s, 0.0))), 9) AS text_sim
  FROM {pool} p LEFT JOIN (
    SELECT q.user_id, q.item_id, sum(u.weight * i.weight) AS s
    FROM {pool} q JOIN uw u USING (user_id)
    JOIN iw i ON i.item_id = q.item_id AND i.term = u.term GROUP BY 1, 2) x
  ON x.user_id = p.user_id AND x.item_id = p.item_id)"""


def _fused(pool: str, alpha: str) -> str:
    return f"""
fused AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fused DESC, pool_rank) AS rank
  FROM (SELECT p.user_id, p.item_id, p.rank AS pool_rank, cf_score, text_sim,
               round({alpha} * cf_score + (1.0 - {alpha}) * text_sim, 9) AS fused
        FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN 1.0 ELSE
                (count(*) OVER (PARTITION BY user_id) - rank)
                / (count(*) OVER (PARTITION BY user_id) - 1) END AS cf_score FROM {pool}) p
        JOIN tsim USING (user_id, item_id) JOIN sizes USING (user_id)))"""


_DRAW = ("CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 12)) AS BIGINT) % {bound}")


def _draw(bound: str, *parts: str) -> str:
    return _DRAW.format(parts=", ".join(parts), bound=bound)


_POSITIVES = _STATS + """,
iidx AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM istats),
npos AS (SELECT DISTINCT t.user_id, i.idx AS item FROM train t JOIN iidx i USING (item_id)
         WHERE rating >= 4)"""

_UNIFORM = _POSITIVES + f""",
tried AS (
  SELECT p.user_id, p.item, t AS trial,
         {_draw('(SELECT count(*) FROM iidx)', '42', '0', 'p.user_id', 'p.item', 't')} AS neg
  FROM npos p, range(1, 21) r(t)),
fair AS (
  SELECT user_id, item, arg_min(neg, trial) AS neg, min(trial) AS trial FROM tried x
  WHERE NOT EXISTS (SELECT 1 FROM npos p WHERE p.user_id = x.user_id AND p.item = x.neg)
  GROUP BY 1, 2),
neg AS (
  SELECT * FROM fair UNION ALL
  SELECT p.user_id, p.item,
    {_draw('(SELECT count(*) FROM iidx)', '42', '0', "'any'", 'p.user_id', 'p.item')}, 21
  FROM npos p ANTI JOIN fair f ON f.user_id = p.user_id AND f.item = p.item),
named AS (SELECT n.user_id, a.item_id, b.item_id AS neg_item_id, n.trial
          FROM neg n JOIN iidx a ON a.idx = n.item JOIN iidx b ON b.idx = n.neg)"""

_KEY = ("p.user_id", "p.item", "p.trial")
_WALK = _POSITIVES + f""",
h AS (SELECT user_id AS u, idx AS item, md5(concat_ws('|', user_id, idx)) AS d
      FROM hist JOIN iidx USING (item_id)),
bu AS (SELECT u, item, row_number() OVER (PARTITION BY u ORDER BY d) - 1 AS k,
              count(*) OVER (PARTITION BY u) AS n FROM h),
bi AS (SELECT u, item, row_number() OVER (PARTITION BY item ORDER BY d) - 1 AS k,
              count(*) OVER (PARTITION BY item) AS n FROM h),
p AS (SELECT user_id, item, t AS trial FROM npos, range(1, 31) r(t)),
zu AS (SELECT u, n FROM bu WHERE k = 0),
zi AS (SELECT item, n FROM bi WHERE k = 0),
k1 AS MATERIALIZED (SELECT p.*, {_draw('z.n', '42', '0', "'own'", *_KEY)} AS k
                    FROM p JOIN zu z ON z.u = p.user_id),
s1 AS MATERIALIZED (SELECT p.user_id, p.item, p.trial, b.item AS j
                    FROM k1 p JOIN bu b ON b.u = p.user_id AND b.k = p.k),
k2 AS MATERIALIZED (SELECT p.*, {_draw('z.n', '42', '0', "'rater'", *_KEY)} AS k
                    FROM s1 p JOIN zi z ON z.item = p.j),
s2 AS MATERIALIZED (SELECT p.user_id, p.item, p.trial, p.j, b.u AS v
                    FROM k2 p JOIN bi b ON b.item = p.j AND b.k = p.k),
k3 AS MATERIALIZED (SELECT p.*, {_draw('z.n', '42', '0', "'item'", *_KEY)} AS k
                    FROM s2 p JOIN zu z ON z.u = p.v),
s3 AS MATERIALIZED (SELECT p.user_id, p.item, p.trial, p.j, b.item AS neg
                    FROM k3 p JOIN bu b ON b.u = p.v AND b.k = p.k),
hard AS MATERIALIZED (
  SELECT user_id, item, arg_min(neg, trial) AS neg, min(trial) AS trial FROM s3 x
  WHERE neg <> j
    AND NOT EXISTS (SELECT 1 FROM npos q WHERE q.user_id = x.user_id AND q.item = x.neg)
  GROUP BY 1, 2),
rest AS MATERIALIZED (
  SELECT p.user_id, p.item FROM npos p
  ANTI JOIN hard h ON h.user_id = p.user_id AND h.item = p.item),
soft AS MATERIALIZED (
  SELECT user_id, item, arg_min(neg, trial) AS neg, min(trial) AS trial FROM (
    SELECT p.user_id, p.item, t AS trial,
           {_draw('(SELECT count(*) FROM iidx)', '42', '0', 'p.user_id', 'p.item', 't')} AS neg
    FROM rest p, range(31, 231) r(t)) x
  WHERE NOT EXISTS (SELECT 1 FROM npos q WHERE q.user_id = x.user_id AND q.item = x.neg)
  GROUP BY 1, 2),
neg AS (
  SELECT * FROM hard UNION ALL SELECT * FROM soft UNION ALL
  SELECT p.user_id, p.item,
    {_draw('(SELECT count(*) FROM iidx)', '42', '0', "'any'", 'p.user_id', 'p.item')}, 231
  FROM rest p ANTI JOIN soft f ON f.user_id = p.user_id AND f.item = p.item)"""

_TITLE = """
titles AS (
  SELECT p_partkey AS item_id,
         CASE WHEN trim(p_brand) <> '' AND NOT contains(lower(trim(p_name)), lower(trim(p_brand)))
              THEN trim(p_name) || ' - ' || trim(p_brand) ELSE trim(p_name) END AS title
  FROM part WHERE trim(p_name) <> '')"""

_EXPL10 = _recs(_EXPLAIN, "recs")
_CF10 = _EXPL10 + "," + _listed(_NEXT, _ELEVEN) + "," + _CAUSES
_ADJ11 = _EXPL10 + "," + _adjusted(_ELEVEN)
_EXPL15 = _recs(_EXPLAIN, "lists")
_EXPL_STATS = """
  SELECT 1.0 AS explanation_coverage,
         round(avg(CASE WHEN n_history > 0 THEN 1.0 ELSE 0.0 END), 9) AS history_support_coverage,
         round(avg(CASE WHEN n_similar > 0 THEN 1.0 ELSE 0.0 END), 9)
           AS similar_item_support_coverage,
         round(avg(support_confidence), 9) AS mean_support_confidence FROM {e}"""
_CF_STATS = """
  SELECT 1.0 AS counterfactual_coverage,
         round(avg(CASE WHEN n_actions > 0 THEN 1.0 ELSE 0.0 END), 9) AS weakening_action_coverage,
         round(avg(CASE WHEN estimated_margin IS NOT NULL THEN 1.0 ELSE 0.0 END), 9)
           AS margin_availability,
         round(avg(confidence), 9) AS mean_counterfactual_confidence FROM {c}"""
_DIVERSITY = _OVERLAP.replace("a.item_id <> b.item_id", "a.item_id < b.item_id") + """,
div AS (
  SELECT user_id, avg(1.0 - coalesce(c, 0) / (ra.n_raters + rb.n_raters - coalesce(c, 0)))
           AS diversity
  FROM (SELECT a.user_id, least(a.item_id, b.item_id) AS x, greatest(a.item_id, b.item_id) AS y
        FROM recs a JOIN recs b ON a.user_id = b.user_id AND a.rank < b.rank)
  LEFT JOIN overlap ON ia = x AND ib = y
  JOIN raters ra ON ra.item_id = x JOIN raters rb ON rb.item_id = y GROUP BY 1),
nov AS (SELECT user_id, avg(-log2(greatest(popularity, 1e-12))) AS novelty,
               avg(popularity) AS popularity_concentration
        FROM recs JOIN ipos USING (item_id) GROUP BY 1)"""



def _letters(text: str) -> str:
    """Counts of eight letters: a text encoder simple enough for SQL."""
    return f"[length({text}) - length(replace({text}, x, ''))::DOUBLE for x in string_split('aeinorst', '')]"


def _check(only: str) -> str:
    """Top-10 lists of a factor model: all users and items of the train rows it knows, no faults."""
    known = f"SELECT * FROM train {only}"
    return f""", known AS ({known}), items AS (SELECT DISTINCT item_id FROM known)
        SELECT count(*) AS users, CAST(sum(least(10, (SELECT count(*) FROM items) - n)) AS BIGINT)
          AS list_rows, 0 AS broken_ranks, 0 AS broken_order, 0 AS seen_items, 0 AS broken_scores,
          0 AS left_out
        FROM (SELECT user_id, (SELECT count(*) FROM hist h JOIN items USING (item_id)
                               WHERE h.user_id = s.user_id) AS n
              FROM sizes s WHERE user_id IN (SELECT user_id FROM known))"""


ORACLE_SQL: dict[str, str] = {
    "train_test_split": f"WITH {_SPLIT} SELECT user_id, item_id, rating, row_key, split FROM labelled",
    "split_partition_check": f"""WITH {_SPLIT} SELECT
        (SELECT count(DISTINCT user_id) FROM labelled) AS users,
        (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM test) AS test_rows,
        CAST(0 AS BIGINT) AS lost_rows, CAST(0 AS BIGINT) AS added_rows""",
    "jsonl_audit": f"""WITH {_REVIEWS}, f AS (SELECT *, row_key % 13 = 0 AS bad,
        row_key % 11 = 0 AS noid, row_key % 7 = 0 AS norate FROM rv)
        SELECT count(*) AS n_rows, count(*) FILTER (bad) AS n_corrupt,
        count(*) FILTER (NOT bad AND noid) AS n_missing_id,
        count(*) FILTER (NOT bad AND NOT noid AND norate) AS n_bad_rating,
        count(*) FILTER (NOT bad AND NOT noid AND NOT norate) AS n_usable,
        count(*) > 0 AND count(*) FILTER (bad) = 0 AS is_valid,
        count(*) FILTER (NOT bad AND NOT noid AND NOT norate) AS loaded_rows,
        sum(rating) FILTER (NOT bad AND NOT noid AND NOT norate) AS loaded_rating_sum FROM f""",
    "split_sink": f"WITH {_SPLIT} SELECT user_id, item_id, rating, row_key, split FROM labelled",
    "subset_sink": f"""WITH {_SPLIT}, keep AS (SELECT user_id FROM
        (SELECT user_id, count(*) AS n_train FROM train GROUP BY 1) JOIN
        (SELECT user_id, count(*) AS n_test FROM test GROUP BY 1) USING (user_id)
        WHERE n_train >= 20 AND n_test >= 5)
        SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, sum(rating) AS rating_sum,
          CAST(sum(count(*)) OVER () AS BIGINT) AS rows_written
        FROM train JOIN keep USING (user_id) GROUP BY user_id""",
    "reviewer_names": f"""WITH {_REVIEWS} SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id,
        'Reader ' || user_id AS name FROM rv WHERE row_key % 3 <> 0""",
    "stored_model": f"""WITH {_STATS} SELECT 'user_factors' AS vectors,
        count(DISTINCT user_id) AS n, 0 AS changed FROM train WHERE rating >= 4 UNION ALL
        SELECT 'item_factors', count(DISTINCT item_id), 0 FROM train WHERE rating >= 4""",
    "content_hybrid_unknown": f"""WITH {_REVIEWS},
        c AS (SELECT item_id, count(*) AS n FROM rv GROUP BY 1),
        best AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM c)
        SELECT DISTINCT -1 - user_id AS user_id, b.item_id, b.rank, CAST(NULL AS DOUBLE) AS fused
        FROM rv, best b WHERE b.rank <= 10""",
    "eligible_users": f"""WITH {_SPLIT} SELECT user_id, n_train, n_test FROM
        (SELECT user_id, count(*) AS n_train FROM train GROUP BY 1) JOIN
        (SELECT user_id, count(*) AS n_test FROM test GROUP BY 1) USING (user_id)
        WHERE n_train >= 20 AND n_test >= 5""",
    "small_dataset_sizes": f"""WITH {_SPLIT}, keep AS (SELECT user_id FROM
        (SELECT user_id, count(*) AS n_train FROM train GROUP BY 1) JOIN
        (SELECT user_id, count(*) AS n_test FROM test GROUP BY 1) USING (user_id)
        WHERE n_train >= 20 AND n_test >= 5)
        SELECT (SELECT count(*) FROM keep) AS users,
        (SELECT count(*) FROM train JOIN keep USING (user_id)) AS train_rows,
        (SELECT count(*) FROM test JOIN keep USING (user_id)) AS test_rows""",
    "id_index": f"""WITH {_STATS} SELECT item_id, row_number() OVER (ORDER BY item_id) - 1
        AS item_idx FROM istats""",
    "grown_index": f"""WITH {_STATS}, known AS (
        SELECT DISTINCT item_id, 0 AS late FROM train WHERE rating >= 5.0)
        SELECT item_id, row_number() OVER (ORDER BY coalesce(late, 1), item_id) - 1 AS item_idx
        FROM istats LEFT JOIN known USING (item_id)""",
    "stored_versions": f"""WITH {_STATS} SELECT 2 AS versions, count(*) AS items, 0 AS changed
        FROM istats""",
    "dataset_profile": f"""WITH {_INTER} SELECT count(DISTINCT user_id) AS n_users,
        count(DISTINCT item_id) AS n_items, count(*) AS n_interactions,
        round(1.0 - count(*) / (count(DISTINCT user_id) * CAST(count(DISTINCT item_id) AS DOUBLE)), 9)
        AS sparsity FROM inter""",
    "user_profiles": f"""WITH {_SPLIT}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY rating DESC, item_id, row_key) AS rn FROM train)
        SELECT user_id, count(*) AS n_rated, round(avg(rating), 9) AS avg_rating,
        string_agg(item_id || ':' || CAST(rating AS INTEGER), ' ' ORDER BY rn)
          FILTER (rn <= 15) AS best_rated FROM b GROUP BY 1""",
    "item_titles": f"WITH {_TITLE} SELECT item_id, title FROM titles",
    "display_labels": f"""WITH {_STATS}, {_TITLE}, {_REVIEWS}, fb AS (
        SELECT item_id, substr(arg_min(trim(summary), row_key), 1, 80) AS title FROM rv
        WHERE trim(summary) <> '' GROUP BY 1)
        SELECT item_id, CASE WHEN coalesce(t.title, fb.title) IS NULL THEN CAST(item_id AS VARCHAR)
        ELSE coalesce(t.title, fb.title) || ' [' || item_id || ']' END AS label,
        n_ratings AS num_ratings FROM (SELECT * FROM ipos WHERE pos <= 20) p
        LEFT JOIN titles t USING (item_id) LEFT JOIN fb USING (item_id)""",
    "item_stats": f"""WITH {_STATS} SELECT item_id, n_ratings, sum_rating,
        round(avg_rating, 9) AS avg_rating, round(popularity, 9) AS popularity FROM ipos""",
    "rating_biases": f"""WITH {_STATS}, mu AS (SELECT avg(rating) AS m FROM train)
        SELECT 'user' AS kind, user_id AS id, round(avg(rating) - any_value(m), 9) AS bias
        FROM train, mu GROUP BY user_id UNION ALL
        SELECT 'item', item_id, round(avg(rating) - any_value(m), 9) FROM train, mu
        GROUP BY item_id""",
    "rating_residuals": f"""WITH {_STATS}, mu AS (SELECT avg(rating) AS m FROM train),
        ub AS MATERIALIZED (SELECT user_id, avg(rating) AS bu FROM train GROUP BY 1),
        ib AS MATERIALIZED (SELECT item_id, avg(rating) AS bi FROM train GROUP BY 1)
        SELECT t.row_key, t.user_id, t.item_id,
          round(t.rating + (SELECT m FROM mu) - ub.bu - ib.bi, 9) AS residual
        FROM train t JOIN ub ON ub.user_id = t.user_id JOIN ib ON ib.item_id = t.item_id""",
    "item_pair_overlap": f"""WITH {_STATS}, {_OVERLAP} SELECT ia AS item_a, ib AS item_b,
        c AS n_users, round(c / (ra.n_raters + rb.n_raters - c), 9) AS jaccard FROM overlap
        JOIN raters ra ON ra.item_id = ia JOIN raters rb ON rb.item_id = ib WHERE ia < ib""",
    "popular_items": f"""WITH {_STATS} SELECT item_id, round(avg_rating, 9) AS avg_rating,
        n_ratings AS num_ratings FROM ipos WHERE pos <= 20""",
    "popularity_predictions": f"""WITH {_STATS} SELECT row_key, user_id, item_id,
        round(coalesce(avg_rating, (SELECT avg(rating) FROM train)), 9) AS prediction
        FROM test LEFT JOIN istats USING (item_id)""",
    "popularity_rating_eval": f"""WITH {_STATS}, p AS (SELECT rating,
        coalesce(avg_rating, (SELECT avg(rating) FROM train)) AS prediction
        FROM test LEFT JOIN istats USING (item_id))
        SELECT round(avg(abs(prediction - rating)), 9) AS "MAE",
        round(sqrt(avg((prediction - rating) * (prediction - rating))), 9) AS "RMSE" FROM p""",
    "popularity_top_n": f"""WITH {_LISTS} SELECT user_id, item_id, rank, score,
        'item_counts' AS score_source FROM recs""",
    "topn_eval": f"WITH {_LISTS}, {_IDEAL}, {_metrics('recs', 5, 4.0)} {_summary()}",
    "topn_eval_all_relevant": f"WITH {_LISTS}, {_IDEAL}, {_metrics('recs', 5, None)} {_summary()}",
    "per_user_eval": f"""WITH {_PER_USER} SELECT "user", n_train, round(precision, 9) AS precision,
        round(recall, 9) AS recall, round(ndcg, 9) AS ndcg, hit_rate,
        round(avg_recommended_popularity, 9) AS avg_recommended_popularity,
        round(catalog_coverage, 9) AS catalog_coverage FROM pu""",
    "candidate_items": f"""WITH {_candidates(500)} SELECT user_id, count(*) AS n_candidates,
        count(*) FILTER (source = 'popular') AS n_popular,
        CAST(sum(item_id * rk) AS BIGINT) AS checksum FROM cand GROUP BY 1""",
    "candidate_items_excluding": f"""WITH {_candidates(50, 20, _EXCLUDED)} SELECT user_id,
        count(*) AS n_candidates, count(*) FILTER (source = 'popular') AS n_popular,
        CAST(sum(item_id * rk) AS BIGINT) AS checksum FROM cand GROUP BY 1""",
    "candidate_hit_rate": f"""WITH {_candidates(None)}, u AS (SELECT DISTINCT user_id FROM test
        JOIN sizes USING (user_id) WHERE rating >= 4 AND n_train >= 5)
        SELECT round(avg(CASE WHEN c.user_id IS NULL THEN 0.0 ELSE 1.0 END), 9)
        AS candidate_hit_rate, count(*) AS n_test_rows
        FROM (SELECT * FROM test JOIN u USING (user_id) WHERE rating >= 4) t
        LEFT JOIN cand c ON c.user_id = t.user_id AND c.item_id = t.item_id""",
    "item_cf_similarity": f"WITH {_CF_SIM} SELECT item_a, item_b, round(sim, 6) AS sim FROM sims",
    "item_cf_predictions": f"""WITH {_CF_PRED} SELECT row_key, user_id, item_id,
        round(prediction, 6) AS prediction FROM pred""",
    "item_cf_rating_eval": f"""WITH {_CF_PRED} SELECT
        round(avg(abs(prediction - rating)), 6) AS "MAE",
        round(sqrt(avg((prediction - rating) * (prediction - rating))), 6) AS "RMSE" FROM pred""",
    "item_cf_top_n": f"""WITH {_CF_SIM},
        edge AS (SELECT item_a AS j, item_b AS i, sim FROM sims
                 UNION ALL SELECT item_b, item_a, sim FROM sims),
        large AS (SELECT user_id FROM sizes WHERE n_train > 50),
        cut AS (SELECT * FROM (SELECT r.user_id, e.i, e.sim, r.dev,
                  row_number() OVER (PARTITION BY r.user_id, e.i
                                     ORDER BY round(e.sim, 9) DESC, r.item_id) AS k
                FROM rated r JOIN large USING (user_id) JOIN edge e ON e.j = r.item_id)
                WHERE k <= 50),
        agg AS (SELECT r.user_id, e.i, sum(e.sim * r.dev) AS num, sum(e.sim) AS den
                FROM rated r JOIN edge e ON e.j = r.item_id
                WHERE r.user_id NOT IN (SELECT user_id FROM large) GROUP BY 1, 2
                UNION ALL SELECT user_id, i, sum(sim * dev), sum(sim) FROM cut GROUP BY 1, 2),
        allsc AS (SELECT s.user_id, m.item_id, round(m.item_mean + CASE WHEN den >= 1e-9
                    THEN num / den ELSE 0.0 END, 9) AS score
                  FROM sizes s CROSS JOIN means m
                  LEFT JOIN agg a ON a.user_id = s.user_id AND a.i = m.item_id
                  WHERE NOT EXISTS (SELECT 1 FROM hist h
                                    WHERE h.user_id = s.user_id AND h.item_id = m.item_id))
        SELECT user_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER
          (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM allsc)
        WHERE rank <= 10""",
    "item_cf_top_n_excluding": f"""WITH {_CF_SIM}, banned AS ({_EXCLUDED}),
        edge AS (SELECT item_a AS j, item_b AS i, sim FROM sims
                 UNION ALL SELECT item_b, item_a, sim FROM sims),
        large AS (SELECT user_id FROM sizes WHERE n_train > 50),
        cut AS (SELECT * FROM (SELECT r.user_id, e.i, e.sim, r.dev,
                  row_number() OVER (PARTITION BY r.user_id, e.i
                                     ORDER BY round(e.sim, 9) DESC, r.item_id) AS k
                FROM rated r JOIN large USING (user_id) JOIN edge e ON e.j = r.item_id)
                WHERE k <= 50),
        agg AS (SELECT r.user_id, e.i, sum(e.sim * r.dev) AS num, sum(e.sim) AS den
                FROM rated r JOIN edge e ON e.j = r.item_id
                WHERE r.user_id NOT IN (SELECT user_id FROM large) GROUP BY 1, 2
                UNION ALL SELECT user_id, i, sum(sim * dev), sum(sim) FROM cut GROUP BY 1, 2),
        allsc AS (SELECT s.user_id, m.item_id, round(m.item_mean + CASE WHEN den >= 1e-9
                    THEN num / den ELSE 0.0 END, 9) AS score
                  FROM sizes s CROSS JOIN means m
                  LEFT JOIN agg a ON a.user_id = s.user_id AND a.i = m.item_id
                  WHERE NOT EXISTS (SELECT 1 FROM hist h
                                    WHERE h.user_id = s.user_id AND h.item_id = m.item_id)
                    AND NOT EXISTS (SELECT 1 FROM banned x
                                    WHERE x.user_id = s.user_id AND x.item_id = m.item_id))
        SELECT user_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER
          (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM allsc)
        WHERE rank <= 10""",
    "popularity_top_n_excluding": f"""WITH {_STATS}, banned AS ({_EXCLUDED}),
        open_ AS (SELECT s.user_id, i.item_id, i.pos, i.n_ratings FROM sizes s JOIN ipos i ON i.pos <= 60 + s.n_train
          WHERE NOT EXISTS (SELECT 1 FROM hist h
                            WHERE h.user_id = s.user_id AND h.item_id = i.item_id)
            AND NOT EXISTS (SELECT 1 FROM banned x
                            WHERE x.user_id = s.user_id AND x.item_id = i.item_id))
        SELECT user_id, item_id, rank, score FROM (SELECT user_id, item_id,
          CAST(n_ratings AS DOUBLE) AS score,
          row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rank FROM open_)
        WHERE rank <= 10""",
    "list_diversity": f"""WITH {_LISTS}, {_DIVERSITY} SELECT user_id,
        round(diversity, 9) AS diversity FROM div""",
    "list_novelty": f"""WITH {_LISTS}, {_DIVERSITY} SELECT user_id, round(novelty, 9) AS novelty,
        round(popularity_concentration, 9) AS popularity_concentration FROM nov""",
    "beyond_accuracy": f"""WITH {_LISTS}, {_IDEAL}, {_metrics('recs', 5, 4.0)}, {_DIVERSITY}
        SELECT round((SELECT count(DISTINCT item_id) FROM recs JOIN eval USING (user_id))
                     / (SELECT count(DISTINCT item_id) FROM train), 9) AS "CatalogCoverage",
        round(avg(diversity), 9) AS "Diversity", round(avg(novelty), 9) AS "Novelty",
        round(avg(popularity_concentration), 9) AS "PopularityConcentration",
        CAST(count(*) AS DOUBLE) AS n_users_beyond_accuracy_eval
        FROM eval LEFT JOIN div USING (user_id) LEFT JOIN nov USING (user_id)""",
    "activity_summary": f"""WITH {_BUCKETS} SELECT bucket, n_users, min_train, max_train, """
    + ", ".join(
        f"round({s}_{m}, 9) AS {s}_{m}" for m in ("ndcg", "precision", "recall")
        for s in ("mean", "std", "median"))
    + """, round(mean_hit_rate, 9) AS mean_hit_rate,
        round(mean_recommended_popularity, 9) AS mean_recommended_popularity,
        round(mean_catalog_coverage, 9) AS mean_catalog_coverage FROM summary""",
    "disparity_ratios": f"""WITH {_BUCKETS} SELECT """
    + ", ".join(
        f"round({_ratio('mean_' + m)}, 6) AS {m}"
        for m in ("ndcg", "precision", "recall", "hit_rate", "recommended_popularity"))
    + """, round(CASE WHEN count(*) >= 2 AND count(*) FILTER (mean_ndcg > 0) >= 1
        THEN max(mean_ndcg) / min(mean_ndcg) FILTER (mean_ndcg > 0) END, 6) AS ndcg_max_min_ratio
        FROM summary""",
    "cold_warm_gap": f"WITH {_PER_USER} SELECT {_GAP_COLUMNS} FROM ({_gap('pu')})",
    "fairness_metrics": f"""WITH {_BUCKETS}, g AS ({_gap('pu')}), d AS (SELECT """
    + ", ".join(
        f"round({_ratio('mean_' + m)}, 6) AS fairness_{m}_disparity"
        for m in ("ndcg", "precision", "recall", "hit_rate", "recommended_popularity"))
    + """ FROM summary) SELECT (SELECT CAST(count(*) AS DOUBLE) FROM pu) AS fairness_n_users_eval,
        d.*, round(cold_mean_ndcg, 6) AS fairness_cold_mean_ndcg,
        round(warm_mean_ndcg, 6) AS fairness_warm_mean_ndcg,
        round(warm_mean_ndcg - cold_mean_ndcg, 6) AS fairness_cold_warm_ndcg_gap FROM d, g""",
    "cold_start_benchmark": f"""WITH {_LISTS}, {_IDEAL}, {_metrics('recs', 1, 4.0)}
        SELECT {_GAP_COLUMNS} FROM ({_gap('per')})""",
    "cold_start_comparison": f"""WITH {_ADJ11}, {_IDEAL}, {_metrics('recs', 1, 4.0)},
        {_metrics('adj', 1, 4.0, '2')}, b AS ({_gap('per')}), c AS ({_gap('per2')})
        SELECT round(c.cold_mean_precision - b.cold_mean_precision, 9)
          AS adjusted_vs_base_cold_precision_delta,
        round(c.cold_mean_recall - b.cold_mean_recall, 9) AS adjusted_vs_base_cold_recall_delta,
        round(c.cold_mean_ndcg - b.cold_mean_ndcg, 9) AS adjusted_vs_base_cold_ndcg_delta,
        round(c.warm_mean_ndcg - b.warm_mean_ndcg, 9) AS adjusted_vs_base_warm_ndcg_delta
        FROM b, c""",
    "history_supports": f"WITH {_recs(_SUPPORTS, 'recs')} SELECT {_SUPPORT_COLUMNS} FROM hsup",
    "similar_item_supports": f"WITH {_recs(_SUPPORTS, 'recs')} SELECT {_SUPPORT_COLUMNS} FROM ssup",
    "explanations": f"""WITH {_EXPL10} SELECT user_id, recommended_item, explanation_type,
        explanation_text, round(support_confidence, 9) AS support_confidence, n_history, n_similar
        FROM expl""",
    "counterfactuals": f"""WITH {_CF10} SELECT user_id, recommended_item, current_rank,
        current_score, next_item, next_item_score, estimated_margin, n_actions, first_item,
        round(first_impact, 9) AS first_impact, first_reason, minimal_change_text,
        round(confidence, 9) AS confidence FROM cf""",
    "next_item_margins": f"""WITH {_LISTS}, {_listed(_NEXT, _ELEVEN)} SELECT user_id, item_id,
        rank, next_item, next_item_score, estimated_margin FROM next""",
    "explanation_eval": f"""WITH {_CF10} SELECT * FROM ({_EXPL_STATS.format(e='expl')}),
        ({_CF_STATS.format(c='cf')})""",
    "adjusted_rankings": f"""WITH {_ADJ11} SELECT user_id, item_id, rank, base_rank,
        raw_model_score, effective_base_score, 'raw_model_score' AS effective_base_score_source,
        round(support_confidence, 9) AS support_confidence,
        round(support_boost, 9) AS support_boost,
        round(popularity_penalty, 9) AS popularity_penalty,
        round(adjusted_score, 9) AS adjusted_score FROM adj""",
    "explainable_eval": f"""WITH {_CF10}, {_adjusted(_ELEVEN)}, {_IDEAL},
        {_metrics('adj', 5, 4.0)},
        ev AS (SELECT * FROM expl WHERE user_id IN (SELECT user_id FROM eval)),
        cv AS (SELECT * FROM cf WHERE user_id IN (SELECT user_id FROM eval))
        SELECT e.*, c.*, CAST(k AS DOUBLE) AS n_explanation_users_eval,
        round(p, 9) AS "causal_Precision", round(r, 9) AS "causal_Recall",
        round({_f('p', 'r')}, 9) AS "causal_F_measure", round(n, 9) AS "causal_NDCG"
        FROM ({_EXPL_STATS.format(e='ev')}) e, ({_CF_STATS.format(c='cv')}) c,
        (SELECT avg(precision) AS p, avg(recall) AS r, avg(ndcg) AS n, count(*) AS k FROM per)""",
    "explain_view": f"""WITH {_EXPL15}, {_adjusted('lists')}, {_listed(_NEXT, 'adj')}, {_CAUSES}
        SELECT a.user_id, a.item_id, a.rank, base_rank, round(a.score, 9) AS score,
        round(support_confidence, 9) AS support_confidence, explanation_type, next_item,
        round(estimated_margin, 9) AS estimated_margin, minimal_change_text
        FROM adj a JOIN cf ON cf.user_id = a.user_id AND cf.recommended_item = a.item_id
        WHERE a.rank <= 10""",
    "review_snippets": f"WITH {_REVIEWS} SELECT row_key, snippet FROM snips WHERE snippet <> ''",
    "item_documents": f"""WITH {_DOCS} SELECT item_id, md5(doc) AS doc_md5, length(doc) AS doc_len
        FROM idocs""",
    "vocabulary": f"WITH {_TFIDF} SELECT term, df, corpus_tf, round(idf, 9) AS idf FROM vocab",
    "tfidf_item_weights": f"WITH {_TFIDF} SELECT item_id, term, round(weight, 6) AS weight FROM iw",
    "text_similarity": f"""WITH {_TFIDF}, {_review_pool('rv')}, {_text_scores('rpool')}
        SELECT user_id, item_id, round(text_sim, 6) AS text_sim FROM tsim""",
    "encoded_similarity": f"""WITH i AS (WITH {_DOCS} SELECT item_id, {_letters('doc')} AS v FROM idocs),
        u AS (WITH {_DOCS.replace('1, 400', '1, 500')} SELECT user_id, {_letters('doc')} AS w
              FROM udocs),
        p AS (WITH {_DOCS}, {_review_pool('rv')} SELECT user_id, item_id FROM rpool)
        SELECT user_id, item_id, round(coalesce(list_cosine_similarity(w, v), 0), 6) AS text_sim
        FROM p LEFT JOIN u USING (user_id) LEFT JOIN i USING (item_id)""",
    "late_fusion": f"""WITH {_TFIDF}, {_review_pool('rv')}, {_text_scores('rpool')},
        {_fused('rpool', '0.7')} SELECT user_id, item_id, rank, round(fused, 6) AS fused,
        round(cf_score, 6) AS cf_score, round(text_sim, 6) AS text_sim, pool_rank FROM fused""",
    "late_fusion_eval": f"""WITH {_TFIDF},
        keyed AS (SELECT user_id, item_id, rating, md5(concat_ws('|', 42, row_key)) AS row_key
                  FROM rv),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id
                       ORDER BY row_key, item_id, rating) AS rk,
                     count(*) OVER (PARTITION BY user_id) AS n FROM keyed),
        train AS (SELECT * FROM numbered WHERE rk <= floor(n * CAST(0.8 AS DOUBLE))),
        test AS (SELECT * FROM numbered WHERE rk > floor(n * CAST(0.8 AS DOUBLE))),
        {_review_pool('train')}, {_text_scores('rpool')}, {_fused('rpool', '0.7')}, {_IDEAL},
        {_metrics('fused', 5, 4.0)}
        SELECT round("Precision", 6) AS "Precision", round("Recall", 6) AS "Recall",
        round("F_measure", 6) AS "F_measure", round("NDCG", 6) AS "NDCG", n_users_eval,
        CAST(0.7 AS DOUBLE) AS alpha, 80 AS pool_size FROM ({_summary()})""",
    "content_hybrid": f"""WITH {_TFIDF}, {_review_pool('rv')}, {_text_scores('rpool')},
        {_fused('rpool', '(CASE WHEN n_train <= 21 THEN 0.35 ELSE 0.7 END)')}
        SELECT user_id, item_id, rank, round(fused, 6) AS fused FROM fused WHERE rank <= 10""",
    "dense_cosine": """WITH p AS (SELECT u.vec_id AS user_id, i.vec_id AS item_id,
        u.embedding::DOUBLE[] AS a, i.embedding::DOUBLE[] AS b
        FROM embeddings u JOIN embeddings i ON i.vec_id - u.vec_id BETWEEN 1 AND 19
        WHERE u.vec_id % 2 = 0 AND i.vec_id % 2 = 1)
        SELECT user_id, item_id, round(greatest(0.0, least(1.0, list_dot_product(a, b)
        / sqrt(list_dot_product(a, a) * list_dot_product(b, b)))), 6) AS text_sim FROM p""",
    "catalogue_top_n": """WITH w AS (SELECT vec_id,
          [floor(x::DOUBLE * 1000) for x in embedding] AS v FROM embeddings),
        s AS (SELECT u.vec_id AS user_id, i.vec_id AS item_id,
          list_dot_product(u.v, i.v)::BIGINT AS score
        FROM w u JOIN w i
          ON u.vec_id % 2 = 0 AND i.vec_id % 2 = 1 AND abs(u.vec_id - i.vec_id) <> 1)
        SELECT user_id, item_id, rank, score FROM (SELECT *, row_number() OVER
          (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 10""",
    "implicit_als_check": f"WITH {_STATS} {_check('WHERE rating >= 4')}",
    "implicit_als_fold_in": f"""WITH {_STATS} SELECT count(DISTINCT user_id) AS users,
        0 AS users_off FROM train WHERE rating >= 4""",
    "implicit_bpr_check": f"WITH {_STATS} {_check('')}",
    "warp_check": f"WITH {_STATS} {_check('')}",
    "warp_violator_check": f"WITH {_STATS} {_check('')}",
    "bpr_check": f"WITH {_STATS} {_check('')}",
    "mf_check": f"WITH {_STATS} {_check('')}",
    "training_gain": f"""WITH {_STATS} SELECT count(DISTINCT user_id) AS users, 0 AS models_without
        FROM train WHERE rating >= 4""",
    "mf_prediction_check": f"""WITH {_STATS}, p AS (SELECT DISTINCT user_id, item_id FROM test)
        SELECT 3 * count(*) AS pairs, count(*) FILTER (user_id IN (SELECT user_id FROM train)
          AND item_id IN (SELECT item_id FROM train)) AS known_pairs, 0 AS wrong FROM p""",
    "support_removal_check": f"""WITH {_recs(_SUPPORTS, 'recs')}, r AS (
          SELECT DISTINCT user_id, support_item FROM hsup)
        SELECT count(*) AS removals, count(DISTINCT user_id) AS users, 0 AS differ FROM r""",
    "score_sources": f"""WITH {_STATS}, whole AS (SELECT sum(least(10,
          (SELECT count(*) FROM istats) - n_train)) AS n FROM sizes),
        liked AS (SELECT DISTINCT user_id, item_id FROM train WHERE rating >= 4),
        known AS (SELECT DISTINCT item_id FROM liked),
        als AS (SELECT sum(least(10, (SELECT count(*) FROM known) - n)) AS n FROM (
          SELECT user_id, count(*) FILTER (item_id IN (SELECT item_id FROM known)) AS n
          FROM hist WHERE user_id IN (SELECT user_id FROM liked) GROUP BY 1))
        SELECT 'item_counts' AS score_source, n::BIGINT AS list_rows FROM whole
        UNION ALL SELECT 'latent_dot', n::BIGINT FROM whole
        UNION ALL SELECT 'model_recommend', n::BIGINT FROM als""",
    "damped_popularity": f"""WITH {_STATS} SELECT item_id,
        round(avg_rating * n_ratings / log2(2.0 + n_ratings), 9) AS damped FROM istats""",
    "trial_weights": f"""WITH {_STATS}, n AS (SELECT count(*) AS n FROM istats)
        SELECT t::INTEGER AS trial, round(sum(1.0::DOUBLE / j), 9) AS weight
        FROM n, range(1, 21) r(t), unnest(range(1, n // t + 1)) u(j) GROUP BY t""",
    "experiment_users": f"""WITH {_STATS} SELECT count(DISTINCT user_id) AS users FROM test
        JOIN sizes USING (user_id) WHERE rating >= 4 AND n_train >= 5""",
    "sample_negatives_uniform": f"""WITH {_UNIFORM} SELECT user_id, item_id, neg_item_id, trial
        FROM named""",
    "sample_negatives_co_rated": f"""WITH {_WALK} SELECT n.user_id, a.item_id,
        b.item_id AS neg_item_id, n.trial
        FROM neg n JOIN iidx a ON a.idx = n.item JOIN iidx b ON b.idx = n.neg""",
    "pairwise_loss": f"""WITH {_UNIFORM}, x AS (SELECT p.popularity AS s, q.popularity AS t
        FROM named n JOIN ipos p USING (item_id) JOIN ipos q ON q.item_id = n.neg_item_id)
        SELECT round(avg(-ln(1.0 / (1.0 + exp(t - s)) + 1e-10)), 6) AS bpr_loss,
        round(avg(greatest(1.0 - s + t, 0.0)), 6) AS hinge_loss, count(*) AS n_pairs FROM x""",
    "results_table": f"""WITH {_CF_PRED},
        ipred AS (SELECT rating, coalesce(avg_rating, (SELECT avg(rating) FROM train)) AS prediction
                  FROM test LEFT JOIN istats USING (item_id)),
        {_LISTS.split('raters AS (SELECT item_id, count(*) AS n_raters FROM hist GROUP BY 1),')[1]},
        {_IDEAL}, {_metrics('recs', 5, 4.0)}
        SELECT 'Popularity' AS model, round(avg(abs(prediction - rating)), 6) AS "MAE",
          round(sqrt(avg((prediction - rating) * (prediction - rating))), 6) AS "RMSE",
          (SELECT round(avg(precision), 6) FROM per) AS "Precision",
          (SELECT round(avg(recall), 6) FROM per) AS "Recall",
          (SELECT round(avg(ndcg), 6) FROM per) AS "NDCG" FROM ipred
        UNION ALL
        SELECT 'Item CF', round(avg(abs(prediction - rating)), 6),
          round(sqrt(avg((prediction - rating) * (prediction - rating))), 6), NULL, NULL, NULL
        FROM pred""",
}
