"""DuckDB SQL for the queries of this folder that SQL can express."""

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

MIX = f"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END)::DOUBLE AS w FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, source, coalesce(len({WORDS}), 0) AS size,
         -ln(('0x' || substr(md5('42|mix|' || d.doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 + pow(2.0, -54)) / coalesce(q.w, 1.0) AS k
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS total FROM r),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER u, 0)) / ((SELECT sum(w) FROM c) - coalesce(sum(w) OVER u, 0)) AS level,
         coalesce(sum(cap) OVER u, 0) AS caps
  FROM c WINDOW u AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN cap <= w * level OR (SELECT count(*) FROM l WHERE cap > w * level) = 0 THEN cap
              ELSE w * (SELECT level FROM l WHERE cap > w * level ORDER BY caps LIMIT 1) END AS target
  FROM l),
x AS (
  SELECT d.doc_id, size, source_size, target, floor(target / nullif(source_size, 0))::BIGINT AS e,
         floor(target + 0.5)::BIGINT AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (coalesce(e, 0) * size + greatest(0, least(size, whole - coalesce(e, 0) * source_size - before)))::BIGINT AS taken
FROM x"""

HOSTS = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hit AS (
  SELECT DISTINCT p.host, p.path, arg_max(r.h || r.p, length(r.h || r.p)) OVER g AS rule, arg_max(r.v, length(r.h || r.p)) OVER g AS v
  FROM p JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  WINDOW g AS (PARTITION BY p.host, p.path)),
seen AS (SELECT doc_id, sum(1 - quality)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, coalesce(sum(bad), 0) AS bad, coalesce(sum(n), 0) AS n, string_split(host, '.') AS ls
  FROM p LEFT JOIN seen ON page_id = doc_id GROUP BY host),
hosts AS (
  SELECT host, bad, n, ls[-1] AS suffix,
         array_to_string(ls[greatest(1, len(ls) - CASE WHEN length(ls[-1]) = 2 AND len(ls) > 2 AND length(ls[-2]) <= 3 THEN 2 ELSE 1 END):], '.') AS domain
  FROM h),
domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY domain, suffix),
tops AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY suffix),
root AS (SELECT sum(bad) AS bad, sum(n) AS n FROM tops),
spread AS (
  SELECT 0 AS level, c.bad, c.n, r.bad / r.n AS m FROM tops c, root r WHERE r.n > 0
  UNION ALL SELECT 1, c.bad, c.n, r.bad / r.n FROM domains c JOIN tops r USING (suffix) WHERE r.n > 0
  UNION ALL SELECT 2, c.bad, c.n, r.bad / r.n FROM hosts c JOIN domains r USING (domain) WHERE r.n > 0),
rho AS (
  SELECT level, coalesce(sum(n * (bad / n - m) ** 2 - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0) AS rho
  FROM spread WHERE n > 1 AND m > 0 AND m < 1 GROUP BY level),
s AS (SELECT l.level, round(1 / least(greatest(coalesce(rho, 0), 1e-3), 0.99) - 1, 6) AS s FROM (VALUES (0), (1), (2)) l(level) LEFT JOIN rho USING (level)),
t AS (SELECT suffix, (bad + s * (SELECT coalesce(bad / nullif(n, 0), 0) FROM root)) / (n + s) AS p0 FROM tops, s WHERE level = 0),
d AS (SELECT domain, (bad + s * p0) / (n + s) AS p1 FROM domains JOIN t USING (suffix), s WHERE level = 1),
b AS (SELECT host, (bad + s * p1) / (n + s) AS m, n + s + 1 AS k FROM hosts JOIN d USING (domain), s WHERE level = 2)
SELECT page_id, p.host, p.path, hit.rule, coalesce(hit.v, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / k) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit USING (host, path) LEFT JOIN b ON p.host = b.host"""

WINDOWS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 19], ' ')) AS k FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM f WHERE nth > 1),
g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = r"[\x20\x09-\x0D]+"

LINES = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, {LOWER.format(f"regexp_replace(line, '^{BLANK}|{BLANK}$', '', 'g')")} AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE last <> doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id"""

# crc32 by its table; letters of the words have one byte, or two that start with 195. Near words
# share what is left when one letter is taken out: at one place (replaced), or of one of them only.
SPELLING = f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
t AS MATERIALIZED (SELECT list(c::BIGINT ORDER BY i) AS t FROM steps WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
o AS (SELECT id, w, count(*) AS n, string_split(id || ':' || w, '') AS ls FROM r WHERE length(w) >= 5 GROUP BY id, w),
b AS (SELECT w, n, flatten(list_transform(ls, lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS bytes FROM o),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x::BIGINT) + 1])), 4294967295) AS h FROM b, t),
v AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1),
u AS MATERIALIZED (SELECT word, n FROM v WHERE n >= 3 AND length(word) >= 5),
c AS (SELECT DISTINCT word, n, word[1:i - 1] || word[i + 1:] AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM u)),
s AS (SELECT word, n, word[1:i - 1] || '*' || word[i + 1:] AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM u)),
near AS (
  SELECT a.word, b.word AS o, b.n AS o_n FROM s a JOIN s b ON a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM c a JOIN u b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM c a JOIN u b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, first(o ORDER BY o_n DESC, o) AS o, first(o_n ORDER BY o_n DESC, o) AS o_n FROM near GROUP BY word),
f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN o_n >= 2 * n THEN o END AS form, CASE WHEN o_n >= 2 * n THEN o_n END AS form_n
  FROM u LEFT JOIN best USING (word)),
follow(word, tip) AS (SELECT word, word FROM f UNION SELECT x.word, f.form FROM follow x JOIN f ON x.tip = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, x.tip AS root, f.n, f.n_near, f.form_n
FROM f JOIN follow x ON x.word = f.word JOIN f e ON e.word = x.tip AND e.form IS NULL"""


def _clusters(rounds: int = 10) -> str:
    """Rounds written out one after the other."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (q[i] - e[i]) * (q[i] - e[i])))"
    out = ["""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q AS e FROM v ORDER BY c LIMIT 8)"""]  # fmt: skip
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, q, min({{'d': d, 'c': c}}) AS best FROM (SELECT vec_id, q, c, {gap} AS d FROM v, c{r}) GROUP BY vec_id, q)")
        if r < rounds:
            out.append(f"""s{r} AS (SELECT best.c AS c, i, sum(q[i]) AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""
WITH {", ".join(out)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(e, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best.c"""


ORACLES: dict[str, str] = {
    "op2_repeated_windows": WINDOWS,
    "op3_url_reputation": HOSTS,
    "op5_mix_sources": MIX,
    "op8_near_vectors": VECTORS,
    "op11_centroid_clusters": _clusters(),
    "op12_spelling_variants": SPELLING,
    "op13_shared_lines": LINES,
}
