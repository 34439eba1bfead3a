"""SQL that must give the same rows as the queries of the same names."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NEAREST = """
dist{r} AS (SELECT v.vec_id, v.row_no, v.part, c.entry, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d
    FROM pieces v JOIN book{r} c USING (part)),
near{r} AS (SELECT vec_id, row_no, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM dist{r} GROUP BY ALL)"""

_MOVED = """
cells{r} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT v.part, a.entry, unnest(v.x) AS x, unnest(range(len(v.x))) AS pos FROM pieces v JOIN near{r} a USING (row_no, part)) GROUP BY ALL),
means{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM cells{r} GROUP BY ALL),
book{t} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means{r} m USING (part, entry))"""

CODES = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_no, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT vec_id, row_no, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS part FROM kept)),
book0 AS (SELECT part, row_no AS entry, x FROM pieces WHERE row_no < 64),
{_NEAREST.format(r=0)},{_MOVED.format(r=0, t=1)},{_NEAREST.format(r=1)},{_MOVED.format(r=1, t=2)},{_NEAREST.format(r=2)},
coded AS (SELECT row_no, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY row_no),
sha AS (SELECT sha256(string_agg(y, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(x, ',') AS y FROM book2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row_no) CROSS JOIN sha
"""

PHRASES = f"""
WITH lowered AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
cut AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM lowered),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM cut),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang HAVING sum(len(w)) > 0),
starts AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, range(1, 5) AS sizes(size) WHERE len(w) >= size),
found AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM found WHERE size > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scores AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
    FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = c.head JOIN found y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS most
    FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM candidates WHERE size > 2)) GROUP BY ALL),
free AS (SELECT c.* FROM lowest c LEFT JOIN longer o USING (lang, phrase) WHERE o.most IS NULL OR 100 * o.most < 80 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

SIMILAR = f"""
WITH RECURSIVE lowered AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE len(w) WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM lowered),
classes AS (SELECT min(doc_id) AS v, md5(array_to_string(list_sort(s), chr(10))) AS h, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY h),
shingled AS (SELECT v, len(s) AS n, unnest(s) AS g FROM classes),
rare AS (SELECT v, n, g, row_number() OVER (PARTITION BY v ORDER BY of, g) AS nth FROM (SELECT *, count(*) OVER (PARTITION BY g) AS of FROM shingled)),
heads AS (SELECT v, n, g FROM rare WHERE nth <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.v AS a, b.v AS b FROM heads a JOIN heads b ON a.g = b.g AND a.v < b.v AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (SELECT p.a, p.b FROM pairs p JOIN classes x ON x.v = p.a JOIN classes y ON y.v = p.b
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT v, v AS root FROM classes UNION SELECT s.b, r.root FROM reach r JOIN sides s ON s.a = r.v),
roots AS (SELECT v, min(root) AS root FROM reach GROUP BY v)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON len(d.s) > 0 AND c.h = md5(array_to_string(list_sort(d.s), chr(10))) LEFT JOIN roots r ON r.v = c.v
"""
