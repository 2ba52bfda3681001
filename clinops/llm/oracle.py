"""DuckDB statements for the corpus queries that SQL can express (slow but plain; for small tables)."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
r(node, seen) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT d.doc_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links, coalesce(m.root, d.doc_id) AS class_id,
       coalesce(m.root, d.doc_id) = d.doc_id AS is_first
FROM d LEFT JOIN m ON m.node = d.doc_id
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
f AS (SELECT doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (
          SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (
            SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM f WHERE n_words >= 8))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win WHERE n > 1)
        GROUP BY doc_id),
b AS (SELECT f.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM f LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{C0}}-\x{{10FFFF}}]'))) < 7 * n_words
            OR 10 * n_dup_lines > 3 * len(lines)
            OR (n_words >= 20 AND 3 * list_max(map_values(list_aggregate(w, 'histogram'))) > n_words)
            OR (len(lines) >= 3 AND 10 * len(list_filter(lines,
                lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(- |\* |•)'))) > 9 * len(lines))) AS kept
FROM v
"""

OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, seen) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node, min(seen) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.root, v.vec_id) AS component_id,
       coalesce(m.root, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN m ON m.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP7 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, octet_length(b) AS n, b FROM d),
w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM (
        SELECT doc_id, i, md5(array_slice(b, i, i + 199)) AS k FROM (
          SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM s WHERE n >= 200))),
h AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 200 THEN 0 ELSE 1 END AS fresh
      FROM w WHERE c > 1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (
        SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM h) GROUP BY doc_id, grp),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS before FROM g),
p AS (SELECT doc_id, before AS lo, lo AS hi FROM e
      UNION ALL SELECT s.doc_id, coalesce(max(g.hi), 1), s.n + 1 FROM s LEFT JOIN g USING (doc_id) GROUP BY s.doc_id, s.n),
k AS (SELECT p.doc_id, sha256(unhex(coalesce(string_agg(
        CASE WHEN p.hi > p.lo THEN hex(array_slice(s.b, p.lo, p.hi - 1)) ELSE '' END, '' ORDER BY p.lo), ''))) AS sha
      FROM p JOIN s USING (doc_id) GROUP BY p.doc_id),
t AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM g GROUP BY doc_id)
SELECT s.doc_id, s.n::BIGINT AS n_bytes, coalesce(t.gone, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans,
       k.sha AS kept_sha256
FROM s JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
        ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
      FROM d GROUP BY source),
q AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][rank % 3 + 1] AS weight, (source_size * 2)::DOUBLE AS cap FROM p),
r AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER b, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM q
      WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT level FROM r WHERE cap / weight > level ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN (SELECT level FROM x) IS NULL THEN cap
        ELSE least(cap, (SELECT level FROM x) * weight) END AS target FROM r),
s AS (SELECT d.*, t.source_size, t.rank, t.target, sum(d.size) OVER (PARTITION BY t.rank ORDER BY h, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, size, rank, h, epoch, (source_size * epoch + run)::BIGINT / target AS finish
      FROM s, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0),
o AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rank, epoch, h, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e),
n AS (SELECT doc_id, sum(size) AS taken FROM o WHERE upto <= (SELECT round(sum(target), 6) FROM t) GROUP BY doc_id)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(n.taken, 0)::BIGINT AS taken FROM s LEFT JOIN n USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS d0 FROM (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (
          SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50))),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE d0 < doc_id),
k AS (SELECT a.doc_id, string_agg(a.x, ' ' ORDER BY a.p) AS kept FROM (
        SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) a
      LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p WHERE g.p IS NULL GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.gone, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) || '0' AS h FROM pages),
f AS (SELECT t, min(page_id) AS lead FROM p GROUP BY t)
SELECT page_id, octet_length(encode(p.t))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM p JOIN f ON p.t = f.t
"""

OP12 = r"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
             SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, (len(w) + 2 - m)::BIGINT),
            lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
          FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS lead, array_to_string(w[k + 1:m], ' ') AS rest
         FROM (SELECT *, unnest(range(1, m::BIGINT)) AS k FROM c)),
s AS (SELECT cuts.*, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a) // (x.a + y.a) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lead JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, phrase, max(a) AS longer FROM (
          SELECT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase
          FROM (SELECT *, unnest(range(1, (m + 2 - j)::BIGINT)) AS i
                FROM (SELECT *, unnest(range(2, m::BIGINT)) AS j FROM c WHERE m > 2))) GROUP BY lang, phrase),
k AS (SELECT b.* FROM b LEFT JOIN sub ON sub.lang = b.lang AND sub.phrase = b.phrase
      WHERE longer IS NULL OR 100 * longer < 80 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM r JOIN size ON size.lang = r.lang WHERE rank <= 2000
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
e AS (SELECT t, min(doc_id) AS lead FROM d GROUP BY t),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 2 * length(d.t))::INT
        + 8 * regexp_matches(d.t, '[#$%&*|]')::INT + 16 * (d.doc_id > lead)::INT AS bad
      FROM d JOIN e ON d.t = e.t LEFT JOIN m ON m.doc_id = d.doc_id),
g AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY part, bad),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step::INT, 1) AS f,
        list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::INT, 1)) - 65)))::INT AS before
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
q AS (SELECT part, filter_order, step, f, 1 << (ascii(f) - 65) AS bit, coalesce(before, 0) AS before, bad, n, good, toxic
      FROM g, s),
r AS (SELECT part, filter_order, step, f,
        sum(CASE WHEN bad & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN bad & bit > 0 AND bad & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN bad & bit > 0 AND bad & before > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN bad = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN bad & bit > 0 AND bad & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN bad & bit > 0 AND bad & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM q GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
