"""The registered queries of this subpackage; each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.llm import bpe, chat, decontam, jaccard, langid, lcp, secrets, toxicity, urls

TOXIC_FROM = 0.7
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "cnn")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", line), ",").alias("spans"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def toxicity_machine(docs: DataFrame, labels: DataFrame) -> toxicity.Machine:
    return toxicity.learn(docs, labels.where(fold(3) != 1))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_machine(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(fold(4) != 2))
    return langid.identify(docs, model).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.edited_fingerprints(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1_secrets that SQL can say: how many spans of the fixed patterns each document has."""
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_urls that SQL can say: hosts, paths and rules, and the verdict where a rule fits."""
    judged = op8_urls(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_chat, op3_bpe, op4_jaccard, op5_toxicity, op6_tokens, op7_decontam, op8_urls, op9_language, op10_fingerprints, secrets_base, url_rules)}


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (
  SELECT conv_id, place, role, text,
         sha256(array_to_string(list(length(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY place), chr(1))) AS upto
  FROM t),
ends AS (SELECT conv_id, max(place) AS place, arg_max(upto, place) AS upto FROM p GROUP BY conv_id),
kept AS (
  SELECT min(e.conv_id) AS conv_id FROM ends e
  WHERE NOT EXISTS (SELECT 1 FROM p JOIN ends x ON p.conv_id = x.conv_id WHERE p.upto = e.upto AND p.place < x.place)
  GROUP BY e.upto)
SELECT p.conv_id, CAST(floor((p.place - 1) / 512) AS BIGINT) AS segment, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY p.place) AS rendered
FROM p JOIN kept ON p.conv_id = kept.conv_id GROUP BY 1, 2""",
        "op7_decontam": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, w[s : s + size - 1] AS words
  FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT doc_id, s, size, w[s : s + size - 1] AS words
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)),
met AS (SELECT doc_id, s, spots.size, item_id FROM spots JOIN windows ON spots.size = windows.size AND spots.words = windows.words),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS place FROM met) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY 1),
vocabulary AS (SELECT DISTINCT unnest(w) AS term FROM b),
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) JOIN vocabulary USING (term) GROUP BY 1),
rare AS (
  SELECT item_id, w, term, count(*) OVER (PARTITION BY item_id, w) AS need
  FROM (SELECT item_id, w, term FROM (SELECT DISTINCT item_id, w, unnest(w) AS term FROM b) JOIN counts USING (term)
        QUALIFY row_number() OVER (PARTITION BY item_id, w ORDER BY n, term) <= 3)),
found AS (
  SELECT doc_id, item_id, r.w AS words, need, term, spot
  FROM (SELECT doc_id, unnest(w) AS term, unnest(generate_series(0, len(w) - 1)) AS spot FROM d WHERE len(w) > 0) p JOIN rare r USING (term)),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near
  FROM (SELECT x.doc_id, x.item_id, x.words, x.spot FROM found x JOIN found y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.words = y.words AND y.spot BETWEEN x.spot - 20 AND x.spot
        GROUP BY ALL HAVING count(DISTINCT y.term) = any_value(x.need)) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
       coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id LEFT JOIN near ON d.doc_id = near.doc_id""",
        "secrets_base": rf"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 2), lambda v: length(v) >= 6)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS BIGINT) AS n_access,
       CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda v: length(v) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "url_rules": rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), {_LOWER}) AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rule_verdict FROM ruled""",
    }
