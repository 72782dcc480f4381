"""The operators as registered queries with production parameters, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontam, jaccard, linededup, mixing, pii, rules, substring, tokencount, urlfilter
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classifier.score_documents(docs, classifier.train(docs, read(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_verdicts(read(spark, sf_dir, "documents"), short=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_pii, op2_substring_dedup, op3_url_filter, op4_ngram_jaccard, op5_decontamination, op6_quality_rules, op7_quality_classifier, op8_line_dedup, op9_token_counts, op10_source_mixing)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, t.i AS i, array_to_string(w[t.i:t.i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + t.j AS p FROM later, unnest(range(0, 20)) AS t(j)),
word AS (SELECT doc_id, t.p AS p, w[t.p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP3_SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, arg_max(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
    FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)
"""

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[t.i:t.i + least(len(w), 13) - 1], ' ') AS s
    FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT doc_id, t.i AS i, k, array_to_string(w[t.i:t.i + k - 1], ' ') AS s FROM d, size, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
met AS (SELECT doc_id, i, k, item_id FROM dwin JOIN win USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT i + t.j) AS n FROM met, unnest(range(0, k)) AS t(j) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(item.s, '')) AS items_sha256,
    coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, sum(source_size) OVER () * 3 / 2.0::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM s),
f AS (SELECT *, 2 * source_size * w_left <= w * left_ AS capped FROM c),
level AS (SELECT left_, w_left FROM f WHERE NOT capped ORDER BY 2 * source_size / w::DOUBLE, encode(source) NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE w * (SELECT left_ FROM level)::DOUBLE / (SELECT w_left FROM level)::DOUBLE END AS target FROM f),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) AS epochs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, (size * epochs + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM p
"""

OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[t.i:t.i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.k + q.k - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id WHERE r.m < e.b)
SELECT id AS doc_id, coalesce(any_value(k), 0)::BIGINT AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""

#: Lines within an edit: equal but for one place (s keeps a mark there), or one is the other with a character left out.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
j AS (SELECT doc_id, t.i - 1 AS pos, lines[t.i] AS line FROM d, unnest(range(1, len(lines) + 1)) AS t(i) WHERE regexp_matches(lines[t.i], '[^\x20\x09-\x0D]')),
c AS (SELECT line, length(line) AS n, min(struct_pack(doc_id, pos)) AS f FROM j GROUP BY line),
v AS (SELECT line, n, f, t.i AS i, left(line, t.i - 1) AS a, substr(line, t.i + 1) AS z FROM c, unnest(range(1, n + 1)) AS t(i) WHERE n >= 20),
changed AS (SELECT line FROM (SELECT line, f, min(f) OVER (PARTITION BY n, i, a, z) AS m FROM v) WHERE m < f),
pairs AS (SELECT DISTINCT v.line AS x, v.f AS fx, c.line AS y, c.f AS fy FROM v JOIN c ON v.a || v.z = c.line AND c.n >= 20),
gone AS (SELECT line FROM changed UNION SELECT CASE WHEN fx > fy THEN x ELSE y END FROM pairs),
out AS (SELECT j.doc_id, j.pos FROM j JOIN c USING (line) WHERE struct_pack(doc_id := j.doc_id, pos := j.pos) <> c.f OR line IN (SELECT line FROM gone)),
g AS (SELECT doc_id, count(*) AS k, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS s FROM out GROUP BY 1)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(k, 0)::BIGINT AS n_removed, coalesce(s, '') AS removed FROM d LEFT JOIN g USING (doc_id)
"""

ORACLE_SQL = {"op2_substring_dedup": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op5_decontamination": OP5_SQL, "op8_line_dedup": OP8_SQL, "op10_source_mixing": OP10_SQL}
