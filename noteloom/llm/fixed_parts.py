"""What the operators' fixed parts give, by themselves: queries whose every column SQL can express, which those of the whole operators can't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ppm, quality, secrets, urls
from .common import only, table


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    measured = quality.with_features(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
    return measured.select("doc_id", *(F.col(f"q_{n}").alias(n) for n in names), quality.base_failed().alias("base_failed"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {f.__name__: f for f in (secret_patterns, quality_measures, url_rules, unigram_scores)}

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "secret_patterns": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), '~~~') AS t FROM documents),
k AS (
  SELECT r, 0 AS k, 6 AS least, regexp_replace(t, '(([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))',
    chr(1) || '\1' || chr(3) || '\3' || chr(2), 'g') AS t FROM d
  UNION ALL SELECT r, 1, 20, regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || '\1' || chr(3) || '\1' || chr(2), 'g') FROM d
  UNION ALL SELECT r, 2, 24, regexp_replace(t, '([0-9a-f]+)', chr(1) || '\1' || chr(3) || '\1' || chr(2), 'g') FROM d
), p AS (SELECT r, k, least, unnest(string_split(t, chr(1))) AS p, generate_subscripts(string_split(t, chr(1)), 1) AS j FROM k),
z AS (SELECT r, k, least, j, CASE WHEN j > 1 THEN length(split_part(p, chr(3), 1)) ELSE 0 END AS n, length(split_part(split_part(p, chr(3), 2), chr(2), 1)) AS v, length(CASE WHEN j > 1 THEN split_part(p, chr(2), 2) ELSE p END) AS rest FROM p),
a AS (SELECT r, k, j, least, n, v, CAST(coalesce(sum(n + rest) OVER (PARTITION BY r, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM z),
s AS (SELECT r, k, a, a + n AS b FROM a WHERE j > 1 AND v >= least),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(['assign', 'access', 'hex'][k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)
""",
    "quality_measures": f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS l FROM w),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
t AS (SELECT r, unnest(range(i, i + 5)) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1),
p AS (SELECT r, count(DISTINCT i) AS n FROM t GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w JOIN l USING (r) LEFT JOIN p USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
""",
    "url_rules": """
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(h, f, verdict)),
f AS (SELECT page_id, arg_max(h || f, length(h || f)) AS rule, arg_max(verdict, length(h || f)) AS ruled FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY page_id)
SELECT page_id, host, path, rule, ruled FROM p LEFT JOIN f USING (page_id)
""",
    "unigram_scores": f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b, {_WORDS.format(_LOWER)} AS w FROM documents),
d AS (SELECT r, doc_id, w, xor(list_reduce(list_concat([4294967295], b), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 5 = 1 AS held_out FROM b),
t AS (SELECT r, held_out, unnest(list_append(list_transform(w, lambda x: 'w' || x), 'end')) AS t FROM d),
c AS (SELECT t, count(*) AS c FROM t WHERE NOT held_out GROUP BY t),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (coalesce(n, 0) + 0.5::DOUBLE * (v + 1)))) AS score FROM t LEFT JOIN c USING (t) CROSS JOIN n GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, CAST(coalesce(n, 0) AS BIGINT) AS train_tokens, round(score, 4) AS base_score FROM d JOIN s USING (r) CROSS JOIN n
""",
}
