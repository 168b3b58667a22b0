"""DuckDB SQL for the queries that SQL can express."""

from .license_scan import license_sql

# words of a text: runs of anything but ASCII white space
WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')"


def _bounds(buckets: int) -> str:
    """Dynamic programming, one table expression per number of buckets; then the way back."""
    steps, back = [], []
    for k in range(2, buckets + 1):
        steps.append(f"d{k} AS (SELECT j, min(v) AS v, arg_min(i, (v, i)) AS i FROM (SELECT b.j, a.j AS i, a.v + b.len * (b.total - a.total) AS v FROM d{k - 1} a0 JOIN lengths a ON a0.j = a.j JOIN lengths b ON a.j < b.j CROSS JOIN (SELECT 1) WHERE a.j >= {k - 1}) GROUP BY j)".replace("a.v", "a0.v"))
    return ",\n".join(steps)


def _packing(buckets: int = 8, budget: int = 32768) -> str:
    last = [f"b{buckets} AS (SELECT max(j) AS j FROM lengths)"]
    for k in range(buckets, 1, -1):
        last.append(f"b{k - 1} AS (SELECT d{k}.i AS j FROM d{k} JOIN b{k} USING (j))")
    union = " UNION ALL ".join(f"SELECT j FROM b{k}" for k in range(1, buckets + 1))
    return f"""
WITH counts AS (SELECT doc_id, text, len({WORDS}) AS n FROM documents),
lengths AS (SELECT n AS len, row_number() OVER (ORDER BY n) AS j, sum(count(*)) OVER (ORDER BY n)::BIGINT AS total FROM counts GROUP BY n),
d1 AS (SELECT j, len * total AS v FROM lengths),
{_bounds(buckets)},
{", ".join(last)},
bounds AS (SELECT len AS bound, row_number() OVER (ORDER BY len) - 1 AS bucket FROM lengths WHERE j IN ({union})),
placed AS (SELECT c.doc_id, c.text, c.n, (SELECT min(bound) FROM bounds WHERE bound >= c.n) AS bound FROM counts c)
SELECT doc_id, n AS n_tokens, bucket::INT AS bucket, p.bound,
       (row_number() OVER (PARTITION BY bucket ORDER BY md5('pack:' || doc_id || ':' || md5(text))) - 1) // greatest(1, {budget} // greatest(p.bound, 1)) AS batch
FROM placed p JOIN bounds b ON p.bound = b.bound
"""


def _quality(alpha: float = 0.05, delta: float = 0.05, cost: int = 19) -> str:
    ink = r"strlen(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g'))"
    share = lambda what: f"(strlen(regexp_replace(text, '[^{what}]', '', 'g')) * 10000 // greatest({ink}, 1))::INT"
    part = lambda some, all_: f"(len({some}) * 10000 // greatest(len({all_}), 1))::INT"
    rules = "symbol_share, upper_share, repeat_share, digit_share, line_repeat_share, long_word_share"
    return f"""
WITH word AS (
  SELECT doc_id, lang, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {WORDS.replace("text,", "coalesce(text, ''),")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[ \\t\\n\\r\\f\\v]', '', 'g') <> '') AS l FROM documents
), v AS (
  SELECT doc_id, lang, stratum, {share(r"#$%&*|!<>{{}}\[\]\^~=+_\\@/".replace("{{", "{").replace("}}", "}"))} AS symbol_share, {share("A-Z")} AS upper_share,
    {part("list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])", "w")} AS repeat_share, {share("0-9")} AS digit_share,
    ((len(l) - len(list_distinct(l))) * 10000 // greatest(len(l), 1))::INT AS line_repeat_share, {part("list_filter(w, lambda x: strlen(x) > 24)", "w")} AS long_word_share
  FROM word
), truth AS (SELECT doc_id, max(quality) > 0 AS good, substr(md5('quality:' || doc_id), 1, 1) < '8' AS train FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
each AS (SELECT doc_id, stratum, rule, value FROM (UNPIVOT v ON {rules} INTO NAME rule VALUE value)),
-- training: share of bad ones at or above each value, rising with the value
spot AS (SELECT stratum, rule, value, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b FROM each JOIN truth USING (doc_id) WHERE train GROUP BY ALL),
share AS (SELECT stratum, rule, value, sum(b) OVER w * 1000 // (sum(b) OVER w + sum(g) OVER w + 1) AS s FROM spot WINDOW w AS (PARTITION BY stratum, rule ORDER BY value DESC)),
step AS (SELECT stratum, rule, value, max(s) OVER (PARTITION BY stratum, rule ORDER BY value) AS s FROM share),
score AS (
  SELECT doc_id, max(coalesce(s, 0))::INT AS score FROM each e ASOF LEFT JOIN step t ON e.stratum = t.stratum AND e.rule = t.rule AND e.value >= t.value GROUP BY doc_id
),
-- holdout: exact binomial tail
held AS (SELECT stratum, score, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b FROM v JOIN score USING (doc_id) JOIN truth USING (doc_id) WHERE NOT train GROUP BY ALL),
size AS (SELECT stratum, sum(g)::BIGINT AS n, sum(b) AS m FROM held GROUP BY ALL),
tests AS (SELECT {delta} / count(*) AS d FROM size),
tail AS (
  SELECT stratum, m, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))) OVER (PARTITION BY stratum ORDER BY i) AS p
  FROM size, unnest(range(0, least(n, 20 + n // 10)::BIGINT)) AS u(i)
), most AS (SELECT stratum, max(i) AS k FROM tail, tests WHERE p <= d AND m > 0 GROUP BY ALL),
-- between two scores that occur, the highest cutoff is the one below the upper score
above AS (SELECT stratum, score - 1 AS cut, sum(g) OVER w AS g, sum(b) OVER w AS b FROM held WINDOW w AS (PARTITION BY stratum ORDER BY score DESC)),
cutoff AS (SELECT stratum, arg_max(cut, (b - {cost} * g, cut)) AS cut FROM above JOIN most USING (stratum) WHERE g <= k AND cut >= 0 AND b - {cost} * g > 0 GROUP BY ALL)
SELECT doc_id, lang, {rules}, score FROM v JOIN score USING (doc_id) LEFT JOIN cutoff USING (stratum) WHERE score <= coalesce(cut, 1000)
"""


def _mixing(temperature: float = 0.7) -> str:
    return f"""
WITH counts AS (SELECT doc_id, coalesce(source, '') AS source, len({WORDS}) AS n FROM documents WHERE len({WORDS}) > 0),
total AS (SELECT source, sum(n)::BIGINT AS t FROM counts GROUP BY source),
plan AS (
  SELECT source, t, floor((SELECT sum(t) FROM total) * pow(t::DOUBLE, {temperature}) / (SELECT sum(pow(x.t::DOUBLE, {temperature}) ORDER BY x.source) FROM total x))::BIGINT AS b FROM total
), keyed AS (
  SELECT c.*, b // t AS whole, b % t AS rest, md5('mix:' || (b // t) || ':' || c.source || ':' || c.doc_id) AS key FROM counts c JOIN plan USING (source)
), last AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM keyed
)
SELECT doc_id, source, n AS n_tokens, epoch, (-1)::BIGINT AS prefix_tokens, n AS take_tokens FROM keyed, unnest(range(0, whole)) AS u(epoch)
UNION ALL
SELECT doc_id, source, n, whole, p, least(n, rest - p) FROM last WHERE p < rest
"""


ORACLES = {
    "op6_line_dedup": r"""
WITH line AS (
  SELECT doc_id, i, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)
), ranked AS (
  SELECT doc_id, i, line, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' AS blank,
         row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS rn
  FROM line
), text AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE blank OR rn = 1), '') AS text FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, t.text, d.lang, d.source, length(t.text) AS n_chars FROM documents d JOIN text t USING (doc_id)
""",
    "op7_packing": _packing(),
    "op8_quality_rules": _quality(),
    "op10_mixing": _mixing(),
    "op2_suffix_dedup": f"""
WITH word AS (SELECT doc_id, {WORDS} AS w FROM documents),
gram AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS h FROM word, unnest(range(0, len(w) - 49)) AS u(p)),
shared AS (SELECT h, min(doc_id) AS first FROM gram GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, p, doc_id <> first AS later FROM gram JOIN shared USING (h)),
mark AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, later ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, later ORDER BY p) AS i FROM mark)
SELECT doc_id, min(p) AS start_word, max(p) + 50 - min(p) AS n_words, later FROM island GROUP BY doc_id, later, i
""",
    "op3_media_columns": """
SELECT page_id, CASE WHEN lower(html[:14]) = '<!doctype html' OR lower(html[:5]) = '<html' THEN 'text/html' ELSE 'application/octet-stream' END AS media_type,
       strlen(html) AS n_bytes, sha256(html) AS digest, 1 AS attempts, '' AS error, html FROM pages
""",
    "op4_license_scan": license_sql(),
}
