"""SQL over whole tables that gives the rows of the queries, where SQL can express them."""

from __future__ import annotations

from plantlens.llm import url_filter

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM r),
w AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM d),
k AS (SELECT w.doc_id, count(gone.pos) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE gone.pos IS NULL), '') AS kept
      FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.pos = gone.pos GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS gram FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM r),
t AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s),
u AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM t GROUP BY doc_id, span),
v AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM u),
x AS (SELECT v.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS stop
      FROM v JOIN d ON v.doc_id = d.doc_id GROUP BY v.doc_id)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * stop + 1), h))) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""

OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) END) AS gram FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.a
"""


def _prior(name: str, groups: str, key: str, parents: str, parent: str) -> str:
    """Shrunk means and bounds of one level, as two steps."""
    low, high = 1 / (url_filter.MOST_STRENGTH + 1), 1 / (url_filter.LEAST_STRENGTH + 1)
    return f"""
{name}_in AS (SELECT g.*, p.mean AS up FROM {groups} g JOIN {parents} p ON g.{parent} = p.{parent}),
{name}_rho AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(good / n - up, 2)) - sum(up * (1 - up))) / nullif(sum(up * (1 - up) * (n - 1)), 0), {low}), {low}), {high}) - 1 AS k FROM {name}_in),
{name} AS (SELECT {key}, a / (a + b) AS mean, a / (a + b) - {url_filter.Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS bound
  FROM (SELECT {key}, k * up + good AS a, k * (1 - up) + n - good AS b FROM {name}_in, {name}_rho))"""


def op9(rules: list[tuple[str, str, str]]) -> str:
    order = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r), reverse=True)
    fits = [(f"(p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind) for kind, h, p in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{kind}'" for f, _, kind in fits) + " END"
    levels = ",".join((
        _prior("by_suffix", "gs", "suffix", "root", "root"), _prior("by_domain", "gd", "domain", "by_suffix", "suffix"), _prior("by_host", "gh", "host", "by_domain", "domain")))
    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain, string_split(host, '.')[-1] AS suffix FROM p),
gh AS (SELECT p.host, domain, count(*) AS n, CAST(sum(quality) AS DOUBLE) AS good FROM p JOIN labels l ON l.doc_id = p.page_id JOIN h ON h.host = p.host WHERE quality IS NOT NULL GROUP BY 1, 2),
gd AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM gh JOIN (SELECT DISTINCT domain, suffix FROM h) USING (domain) GROUP BY 1, 2),
gs AS (SELECT suffix, 1 AS root, sum(n) AS n, sum(good) AS good FROM gd GROUP BY 1),
root AS (SELECT 1 AS root, a / n AS mean, a / n - {url_filter.Z} * sqrt(a * (n - a) / (n * n * (n + 1))) AS bound
  FROM (SELECT coalesce(sum(good), 0) + 1.0 AS a, coalesce(sum(n), 0) + 2.0 AS n FROM gs)),
{levels},
known AS (SELECT h.host, coalesce(by_host.bound, by_domain.bound, by_suffix.bound, root.bound) AS bound
  FROM h LEFT JOIN by_host ON h.host = by_host.host LEFT JOIN by_domain ON h.domain = by_domain.domain LEFT JOIN by_suffix ON h.suffix = by_suffix.suffix, root)
SELECT page_id, p.host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN round(bound, 9) < {url_filter.LEAST_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN known ON p.host = known.host
"""


OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
    OR list_sum(list_transform(embedding, lambda x: abs(x))) = 0 THEN NULL ELSE CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.least, vec_id)) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN m ON v.vec_id = m.a
"""


def op11(dim: int, scale: int, k: int, rounds: int, seed: int) -> str:
    """Every round as two steps: assign, then move the centroids."""
    parts = [f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: CAST(floor({scale} * x) AS BIGINT)) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE len(e) = {dim} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, x, m.c, m.d FROM (SELECT vec_id, v.x, arg_min({{'c': c, 'd': d}}, (d, c)) AS m FROM
  (SELECT v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c) v GROUP BY v.vec_id, v.x))""")
        if r < rounds:
            parts.append(f"""
s{r} AS (SELECT c, i, sum(t) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, {dim + 1})) AS i, unnest(x) AS t FROM a{r}) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN
  (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY c) m ON m.c = c{r}.c)""")
    return ",".join(parts) + f"""
SELECT vec_id, a{rounds}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c
"""


# crc32 of a list of bytes, from its table of 256 remainders
_CRC = "xor(list_reduce({}, lambda c, b: xor(c >> 8, tab[1 + CAST(xor(c & 255, b) AS INTEGER)]), CAST(4294967295 AS BIGINT)), 4294967295)"

OP12 = f"""
WITH RECURSIVE t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END)) AS bytes FROM r),
h AS (SELECT run, n, {_CRC.format("bytes")} AS h FROM b, t),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM
  (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word FROM g JOIN w ON g.less = w.word UNION SELECT w.word, g.word FROM g JOIN w ON g.less = w.word),
f AS MATERIALIZED (SELECT a, count(*) AS n_near, max(n) AS best, min(b) FILTER (WHERE n = top) AS form FROM
  (SELECT a, b, n, max(n) OVER (PARTITION BY a) AS top FROM p JOIN w ON w.word = b) GROUP BY a),
e AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN best >= 2 * n THEN form END AS form, CASE WHEN best >= 2 * n THEN best END AS form_n FROM w LEFT JOIN f ON f.a = word),
way(word, here, steps) AS (SELECT word, form, 1 FROM e WHERE form IS NOT NULL UNION ALL SELECT way.word, e.form, steps + 1 FROM way JOIN e ON e.word = way.here WHERE e.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, steps) AS root FROM way GROUP BY word)
SELECT e.word, form, coalesce(root, e.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM e LEFT JOIN ends ON ends.word = e.word
"""
