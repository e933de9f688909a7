"""The registered query of every operator and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf_langid, ctw, exact_dedup, line_dedup, packing, quality, simhash, spelling, tool_calls, turn_repair, url_filter, vector_join
from .common import split_of, table


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_corpus(table(spark, sf_dir, "documents"), split_of("doc_id", 7) == 2)


def op2_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf_langid.fit_sample(docs.filter(split_of("doc_id", 3) != 1))
    return crf_langid.label(docs.select("doc_id", "text", (split_of("doc_id", 3) == 1).alias("held_out")), model).drop("text")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_points=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_conversations(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link_calls(calls, results)
    return linked.select("conv_id", "turn", "call_id", "name", "status", "problem", "round", F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.labelled_hosts(pages)).drop("listed")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.report(turns, turn_repair.damage(turns))


def op13_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_ctw_score, op2_crf_langid, op3_exact_dedup, op4_quality, op5_line_dedup, op6_packing, op7_simhash_dedup, op8_bpe_round_trip, op9_tool_calls, op10_url_filter,
        op11_spelling_variants, op12_conversation_repair, op13_vector_join,
    )
    return {f.__name__: f for f in registered}


OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id NULLS LAST) AS rn FROM t)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY rn) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
 rn = 1 AS kept, h AS text_sha256 FROM r
"""


OP5_SQL = r"""
WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
e AS (SELECT doc_id, r, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM l),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
 sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, k.doc_id
"""

OP10_SQL = r"""
WITH p AS (SELECT page_id, lower(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(\.html|/)$', '') END AS canon FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE list_has_any(string_split(host, '.'), ['casino-win', 'free-bets', 'cheap-pills', 'ads-track'])),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(v, h, q)),
b AS (SELECT page_id, url_key, v, h || q AS rule, row_number() OVER (PARTITION BY url_key ORDER BY length(h || q) DESC) AS rn
 FROM (SELECT row_number() OVER () AS url_key, * FROM c) x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT x.page_id, host, path, b.rule, coalesce(b.v, CASE WHEN l.canon IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM (SELECT row_number() OVER () AS url_key, * FROM c) x LEFT JOIN b ON b.url_key = x.url_key AND rn = 1 LEFT JOIN l ON l.canon = x.canon
"""


def oracles() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_line_dedup": OP5_SQL, "op10_url_filter": OP10_SQL}
