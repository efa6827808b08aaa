"""Checking SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

import math

from . import clustering, quality, topk

#: Classes of near duplicates: exact Jaccard similarity of five-word shingles, components by reachability.
NEAR_CLASSES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
   FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c)),
 b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 walk AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT walk.x, b.y FROM walk JOIN b ON b.x = walk.y)
SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_size FROM walk GROUP BY x
"""


def quality_sql(risk: float = quality.RISK, level: float = quality.LEVEL) -> str:
    """Counts, base rule, cutoffs by the exact binomial bound, and the verdict."""
    values = {name: sql.replace(" div ", " // ") for name, sql in quality.RULES.items()}
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, '{name}' AS rule, CAST({sql} AS BIGINT) AS value FROM m WHERE NOT base_failed" for name, sql in values.items())
    shares = " ".join(f"WHEN '{name}' THEN {risk * share!r}" for name, share in quality.SHARES.items())
    broken = ", ".join(f"CASE WHEN CAST({sql} AS BIGINT) >= (SELECT cutoff FROM cut WHERE cut.stratum = m.stratum AND rule = '{name}') THEN '{name}' END" for name, sql in values.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
 ws AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
 tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM ws),
 tri AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
 cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM rep) GROUP BY 1),
 ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
   WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
 c AS (SELECT d.doc_id, stratum, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
   coalesce(ln.n, 0) AS n_lines, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
   FROM d JOIN ws ON ws.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id),
 m AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM c),
 lab AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1 HAVING min(quality) = max(quality)),
 hist AS (SELECT stratum, rule, value, count(*) FILTER (quality > 0) AS good, count(*) FILTER (quality <= 0) AS bad
   FROM ({long}) r JOIN lab ON lab.doc_id = r.doc_id WHERE value IS NOT NULL GROUP BY 1, 2, 3),
 curve AS (SELECT stratum, rule, value, sum(good) OVER o AS lost, sum(bad) OVER o AS caught, sum(good) OVER (PARTITION BY stratum, rule) AS n
   FROM hist WINDOW o AS (PARTITION BY stratum, rule ORDER BY value DESC)),
 tot AS (SELECT stratum, rule, CAST(max(n) AS DOUBLE) AS n, CASE rule {shares} END AS rate FROM curve GROUP BY 1, 2),
 terms AS (SELECT stratum, rule, n, j, exp(CASE WHEN n = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) END + j * ln(rate) + (n - j) * ln(1 - rate)) AS term
   FROM (SELECT *, unnest(range(0, CAST(floor(n * rate) AS BIGINT) + 1)) AS j FROM tot)),
 bound AS (SELECT stratum, rule, max(j) AS most FROM (SELECT *, sum(term) OVER (PARTITION BY stratum, rule ORDER BY j) AS total FROM terms)
   WHERE ln(total) <= {math.log(level)!r} - ln((SELECT greatest(count(DISTINCT stratum), 1) FROM hist) * {len(quality.RULES)}) GROUP BY 1, 2),
 usable AS (SELECT curve.*, caught - {quality.COST} * lost AS gain FROM curve JOIN bound USING (stratum, rule) WHERE lost <= most AND caught > {quality.COST} * lost),
 best AS (SELECT stratum, rule, max(value) AS hi FROM (SELECT *, max(gain) OVER (PARTITION BY stratum, rule) AS top FROM usable) WHERE gain = top GROUP BY 1, 2),
 cut AS (SELECT b.stratum, b.rule, coalesce((hi + max(value) + 2) // 2, hi) AS cutoff FROM best b
   LEFT JOIN curve x ON x.stratum = b.stratum AND x.rule = b.rule AND x.value < hi GROUP BY b.stratum, b.rule, hi),
 v AS (SELECT *, concat_ws(',', {broken}) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM v
"""


def _finite(scale: int, size: str = "") -> str:
    """key, vec_id, e (integer components) of the vectors that take part."""
    return f"""SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
   FROM embeddings WHERE embedding IS NOT NULL{size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


#: The k best rows for every 20th vector, by all inner products.
TOP_K = f"""
WITH v AS ({_finite(topk.SCALE)}),
 p AS (SELECT q.key, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
   FROM v q JOIN v c ON q.key != c.key WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id NULLS FIRST) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= {topk.K}
"""


def clusters_sql(clusters: int = clustering.CLUSTERS, rounds: int = clustering.ROUNDS) -> str:
    """Lloyd's rounds written out, one choice and one move each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT key, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (SELECT v.key, c.k,
   list_sum(list_transform(generate_series(1, {clustering.DIMENSIONS}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS d FROM v, c{r} c) GROUP BY key)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT k, list(x ORDER BY i) AS e FROM (SELECT k, i, CAST(floor(sum(e[i]) / count(*)) AS BIGINT) AS x
   FROM (SELECT a{r}.k, v.e, unnest(generate_series(1, {clustering.DIMENSIONS})) AS i FROM a{r} JOIN v USING (key)) GROUP BY k, i) GROUP BY k),
 c{r + 1} AS (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    chain = ",\n ".join(steps)
    return f"""
WITH v AS ({_finite(clustering.SCALE, f" AND len(embedding) = {clustering.DIMENSIONS}")}),
 h AS (SELECT e, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, e LIMIT {clusters}),
 c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e FROM h),
 {chain},
 n AS (SELECT k, sum(d) AS cluster_inertia FROM a{rounds} GROUP BY k)
SELECT v.vec_id, CAST(a.k AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(n.cluster_inertia AS BIGINT) AS cluster_inertia,
 CAST((SELECT sum(cluster_inertia) FROM n) AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (key) JOIN n USING (k) JOIN c{rounds} c USING (k)
"""
