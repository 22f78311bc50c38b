"""The thin queries opN_<name> over the supplied tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import fold, table

TOKENIZER = "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkstone.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.backoff import score_documents

    return score_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.zlang import fit_dictionaries, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit_dictionaries(docs.where(fold("doc_id", 3) != 1)))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.webp import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("repeats")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.minhash import near_groups

    found = near_groups(table(spark, sf_dir, "documents"), k=3, least=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(coalesce({t}, ''), '[^\\x20\\x09-\\x0D]+')"

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.replace("{t}", LOWER.replace("{t}", "text"))} AS ws FROM documents),
p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
g AS (SELECT r, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM p),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w), c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w), t AS (SELECT count(*) AS n FROM g),
s AS (SELECT g.r, CASE WHEN c2.n IS NOT NULL THEN ln(c2.n) - ln(cv.n) ELSE ln(c1.n) - ln(t.n) + CASE WHEN g.v IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM g JOIN c1 ON g.w = c1.w CROSS JOIN t LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN c1 cv ON cv.w = g.v),
z AS (SELECT r, sum(s) AS s FROM s GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(coalesce(s, 0), 4) AS score, round(CASE WHEN len(ws) > 0 THEN s / len(ws) ELSE 0 END, 6) AS mean_score FROM d LEFT JOIN z USING (r)"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.replace("{t}", "text")} AS ws FROM documents),
w AS (SELECT r, doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13 AND doc_id IS NOT NULL),
k AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w),
m AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM k JOIN m USING (k) WHERE least < doc_id),
e AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
h AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN h USING (r)"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("{t}", LOWER.replace("{t}", "text"))} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, seen) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.seen = edges.a),
least AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least ON doc_id = node"""


OP10 = f"""
WITH u AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL),
r AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT url, {LOWER.replace("{t}", "regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM r),
k AS (SELECT *, list_distinct(list_concat(
    CASE WHEN host = '' THEN [] ELSE ['h' || CAST(i AS VARCHAR) || ':' || list_reverse(string_split(host, '.'))[i + 1] FOR i IN range(0, len(string_split(host, '.')))] END,
    ['p:' || x FOR x IN string_split(path, '/') IF x <> '' AND NOT regexp_matches(x, '[0-9]')],
    CASE WHEN q = '' THEN [] ELSE ['q:' || regexp_extract(x, '^([^=]*)', 1) FOR x IN string_split(q, '&')] END,
    CASE WHEN strpos(url, '://') > 0 THEN ['s:' || lower(regexp_extract(url, '^(.*?)://', 1))] ELSE [] END)) AS tokens,
  CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
l AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS listed FROM k),
t AS (SELECT url, listed, unnest(tokens) AS x FROM l),
sets AS (SELECT url, listed, [x] AS s FROM t UNION ALL SELECT a.url, a.listed, [a.x, b.x] FROM t a JOIN t b ON a.url = b.url AND a.x < b.x
  UNION ALL SELECT a.url, a.listed, [a.x, b.x, c.x] FROM t a JOIN t b ON a.url = b.url AND a.x < b.x JOIN t c ON a.url = c.url AND b.x < c.x),
bodies AS (SELECT s, count(*) AS body FROM sets GROUP BY s),
heads AS (SELECT s, listed AS v, count(*) AS n FROM sets WHERE listed IS NOT NULL GROUP BY s, listed HAVING count(*) >= ceil(0.01 * (SELECT count(*) FROM u))),
rules AS (SELECT s, v, n / body AS c FROM heads JOIN bodies USING (s) WHERE n / body >= 0.6),
less AS (SELECT s, v, c, unnest([list_filter(s, lambda y: y <> x) FOR x IN s]) AS part FROM rules),
mined AS (SELECT * FROM rules ANTI JOIN (SELECT less.s, less.v FROM less JOIN rules p ON p.s = less.part AND p.v = less.v AND p.c >= less.c) g USING (s, v)),
fired AS (SELECT url, max((c, len(s), v = 'block', v)) AS best FROM (SELECT url, s FROM sets WHERE listed IS NULL) JOIN mined USING (s) GROUP BY url)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(listed, best[4], 'allow') AS verdict FROM pages LEFT JOIN l USING (url) LEFT JOIN fired USING (url)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_backoff": OP4, "op8_substring": OP8, "op9_minhash": OP9, "op10_url_rules": OP10}
