"""Queries over whole tables, one for each operator, and DuckDB SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, line_crf, ngram_jaccard, packing, quality_rules, sharding, token_files, url_filter
from .common import cut, read, shared_folder

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_texts(read(spark, sf_dir, "documents"), tokenizer_path(), path)
    return token_files.read(spark, path, with_ids=False).withColumnRenamed("id", "doc_id")


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_crf.scored(docs, line_crf.fit(docs, read(spark, sf_dir, "labels")))


def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "weight")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licenses.scanned(docs, licenses.fit(docs))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(ngram_jaccard.jaccard_components(read(spark, sf_dir, "documents"), carry=("source",)))
    return packing.packed(found, units=F.col("n_words"), cluster=F.col("component_key"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(read(spark, sf_dir, "conversations"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op8_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = quality_rules.with_quality_rules(docs.select("doc_id", "text"), quality_rules.weights(docs, trusted(spark, sf_dir)))
    return out.select("doc_id", *quality_rules.ADDED)


def op9_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_files, op2_line_crf, op3_url_vocabulary, op4_license_scan, op5_best_fit_packing, op6_winnowing, op7_chat_repair, op8_ngram_ratio, op9_shard_table, op10_ngram_jaccard)}


def _url_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    order = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [(v, h, p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in order]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{h}{p}'" for _, h, p, c in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, _, _, c in fits) + " END"
    weight = " + ".join(f"CASE WHEN regexp_matches(search, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0.0 END" for t, w in url_filter.VOCABULARY.items())
    return f"""
WITH split AS (
  SELECT page_id,
    coalesce({lower.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce({lower.format("regexp_extract(url, '^(?s:.*?)://((?s:.*))$', 1)")}, '') AS search
  FROM pages),
judged AS (SELECT page_id, host, path, {rule} AS rule, {said} AS said, CAST({weight} AS DOUBLE) AS weight FROM split)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN weight >= 1 THEN 'block' ELSE 'allow' END) AS verdict, weight FROM judged"""


_WINNOW_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
l AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM l)),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT r, p, n, item_id FROM dw JOIN iw USING (n, t)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

_JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT r, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM d WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_of AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.r <> b.r GROUP BY 1, 2),
link AS (SELECT x, y FROM both_of JOIN size a ON a.r = x JOIN size b ON b.r = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach(r, y) AS (SELECT r, r FROM d UNION SELECT reach.r, link.y FROM reach JOIN link ON link.x = reach.y),
least_of AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN size USING (r) JOIN least_of USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_vocabulary": _url_sql(), "op6_winnowing": _WINNOW_SQL, "op10_ngram_jaccard": _JACCARD_SQL}
