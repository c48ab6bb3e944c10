"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH dw AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS k,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
seq AS (SELECT doc_id, pos, word,
               string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS nxt
        FROM dw),
cand AS (SELECT doc_id, pos, k, array_to_string(list_slice(string_split(nxt, ' '), 1, k), ' ') AS win
         FROM seq, ks WHERE len(string_split(nxt, ' ')) >= k),
hit AS (SELECT c.doc_id, c.pos, c.k, w.item_id FROM cand c JOIN win w USING (win, k)),
words AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hit)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s
       FROM hit GROUP BY 1),
nw AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY 1)
SELECT d.doc_id, coalesce(nw.n, 0) AS n_words, coalesce(nh.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       coalesce(it.s, sha256('')) AS items_sha256, coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN nw USING (doc_id) LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""


OP3 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id < b.vec_id
         WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
n AS (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY 1),
reach(node, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.node)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.m AS component_id, v.vec_id = c.m AS kept
FROM v LEFT JOIN n USING (vec_id) JOIN (SELECT node AS vec_id, min(r) AS m FROM reach GROUP BY 1) c USING (vec_id)
"""

OP4 = r"""
WITH u AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                           ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
       (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h || p) DESC, h || p LIMIT 1) AS rule,
       coalesce((SELECT action FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
                 ORDER BY length(h || p) DESC, h || p LIMIT 1),
                CASE WHEN regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)(\.|$)')
                          AND len(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
                                  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) = 0
                     THEN 'block' ELSE 'allow' END) AS verdict
FROM u
"""

OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                   (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(24 + length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>'))
                + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
         FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
         WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(node, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(r) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
             sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM w),
p AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
             sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
f AS (SELECT ratio, stopped, rest FROM p WHERE (total - stopped) * w < cap * rest ORDER BY ratio, stopped LIMIT 1),
t AS (SELECT p.source, p.source_size,
             CASE WHEN f.ratio IS NULL OR p.ratio < f.ratio THEN CAST(p.cap AS DOUBLE)
                  ELSE CAST(p.w * (p.total - f.stopped) AS DOUBLE) / CAST(f.rest AS DOUBLE) END AS target
      FROM p LEFT JOIN f ON true),
k AS (SELECT *, CASE WHEN size < 4 THEN size ELSE length(bin(size)) * 4 + ((size >> (length(bin(size)) - 3)) & 3) END AS cls FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, place, doc_id) - 1 AS rank,
             ('0x' || substr(md5(coalesce(source, '')), 1, 5))::INTEGER / 1048576.0::DOUBLE AS u FROM k),
c AS (SELECT n.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS r
      FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(u + r * (rank + 1)) - floor(u + r * rank)) AS BIGINT) * size AS taken FROM c
"""


def _op11(k: int = 40, rounds: int = 5) -> str:
    """One pair of tables for each round: assignment, then new centroids."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = [f"""
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x FROM (
    SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v) ORDER BY h, x LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, vec_id, x, min(struct_pack(d, c)) AS best FROM (
    SELECT v.row, v.vec_id, v.x, CAST({distance} AS BIGINT) AS d, c.c FROM v, c{r} c) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT best.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m{r}.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(e, lambda y: CAST(floor(y * 256) AS BIGINT)) AS x
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE len(e) = 64 AND len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0),{",".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} f ON f.c = best.c
"""


OP12 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?
-
]') AS p FROM documents),
piece AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM (SELECT lang, unnest(p) AS p FROM d)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY 1),
part AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (
      SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, range(1, 6) t(k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 100),
cut AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n, j,
         (1000 * c.f::HUGEINT * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM part WHERE k > 1) c
  JOIN part l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, j), ' ')
  JOIN part r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, j + 1, c.k), ' ')
  JOIN total t ON t.lang = c.lang),
best AS (SELECT lang, k, phrase, a, min(struct_pack(score, j, l, r, n)) AS s FROM cut GROUP BY ALL),
inner_ AS (
  SELECT DISTINCT b.lang, x.phrase FROM (
    SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM part WHERE k > 2) b,
    LATERAL (SELECT array_to_string(list_slice(b.w, i, i + b.m - 1), ' ') AS phrase FROM range(1, b.k - b.m + 2) t(i)) x
  JOIN part p ON p.lang = b.lang AND p.phrase = x.phrase AND 100 * b.f >= 100 * p.f),
kept AS (SELECT * FROM best WHERE NOT EXISTS (
  SELECT 1 FROM inner_ i WHERE i.lang = best.lang AND i.phrase = best.phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, s.l AS l, s.r AS r, s.n AS n, CAST(s.score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

OP13 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1,
        "op3_embedding_neardup": OP3,
        "op4_url_filter": OP4,
        "op5_chat_format": OP5,
        "op6_jaccard_join": OP6,
        "op7_mixing": OP7,
        "op11_centroid_clustering": _op11(),
        "op12_collocations": OP12,
        "op13_warc": OP13,
    }
