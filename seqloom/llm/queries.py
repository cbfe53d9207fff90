"""The queries opN_<name> over the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import editembed, langid, lines, mixing, quality, ranking, sharding, simhash, spelling, tiling, tokencount, tokenout, urlfilter
from .common import table


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.apply_rules(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, rhost, rpath, v) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
best AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.v,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best WHERE k = 1
"""


def tokenizer_file() -> str:
    """Place of the public tokenizer that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(table(spark, sf_dir, "documents"))
    taken = (F.size("draws") * F.col("size")).cast("long").alias("taken")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken, F.col("draws.shard").alias("shards"), F.col("draws.block").alias("blocks"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.round_trip(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op6_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editembed.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiling.with_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.get("leaks", F.lit(0))
    return out.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), best["item_id"].alias("item_id"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), F.array_sort(F.col("leaks.item_id")).alias("items"),
    )


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", "kept_text")


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN coalesce(html, '') = '' THEN CAST([] AS VARCHAR[])
              ELSE string_split(regexp_replace(html, '(</p>|</div>|</nav>|</footer>|</h1>|</head>|<br>)', '\1' || chr(10), 'g'), chr(10)) END AS ls
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM parts WHERE host <> '' GROUP BY host HAVING count(*) >= 4),
seen AS (SELECT DISTINCT page_id, host, trim(x.l) AS line FROM parts, (SELECT unnest(ls) AS l) x WHERE host <> '' AND trim(x.l) <> ''),
common AS (SELECT s.host, s.line FROM seen s JOIN totals t USING (host) GROUP BY s.host, s.line, t.pages HAVING count(*) > 0.5 * t.pages),
lists AS (SELECT host, list(line) AS c FROM common GROUP BY host),
kept AS (SELECT p.page_id, p.host, p.ls, list_filter(p.ls, lambda x: NOT list_contains(coalesce(l.c, CAST([] AS VARCHAR[])), trim(x))) AS k FROM parts p LEFT JOIN lists l USING (host))
SELECT page_id, host, len(ls)::INT AS n_lines, (len(ls) - len(k))::INT AS n_dropped, coalesce(array_to_string(k, chr(10)), '') AS kept_text FROM kept
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
g AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) GROUP BY doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, docs),
q AS (
  SELECT DISTINCT item_id, t FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark)),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, k::INT AS rank, doc_id, score FROM ranked WHERE k <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE codes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS (
  SELECT doc_id, r, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY doc_id, r),
hexes AS (SELECT r, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM runs),
hashed AS (
  SELECT r, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
  FROM hexes, codes),
spoilt AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT u, v, vn FROM (
    SELECT a.word AS u, b.word AS v, b.n AS vn FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word)),
best AS (SELECT u, count(*)::BIGINT AS n_near, first(v ORDER BY vn DESC, encode(v)) AS v, max(vn) AS vn FROM pairs GROUP BY u),
forms AS (SELECT word, CASE WHEN vn >= 5 * n THEN v END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN vn >= 5 * n THEN vn END AS form_n FROM words LEFT JOIN best ON word = u),
chain AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_rules": op1_url_rules,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_token_ids": op5_token_ids,
    "op6_edit_embedding": op6_edit_embedding,
    "op7_token_counts": op7_token_counts,
    "op8_histogram_sort": op8_histogram_sort,
    "op9_decontamination": op9_decontamination,
    "op10_site_lines": op10_site_lines,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_language_id": op13_language_id,
}
SQL: dict[str, str] = {"op1_url_rules": OP1_SQL, "op10_site_lines": OP10_SQL, "op11_ranked_search": OP11_SQL, "op12_spelling_variants": OP12_SQL}
