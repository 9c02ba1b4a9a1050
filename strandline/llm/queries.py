"""The op queries and the pipeline, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import langid
from strandline.llm.bpe import encode_documents
from strandline.llm.cuckoo import exact_duplicates
from strandline.llm.fingerprint import edited_fingerprints
from strandline.llm.html_density import extract_pages
from strandline.llm.mixing import mix
from strandline.llm.periodic import collapse_runs
from strandline.llm.pii import replace_entities
from strandline.llm.sharding import assign_shards
from strandline.llm.simhash import near_duplicates
from strandline.llm.spelling import spelling_variants
from strandline.llm.toxicity import grade_toxicity, train
from strandline.llm.urlcascade import Rule, judge_urls
from strandline.session import table

URL_RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


#: The vocabulary that op1 and the pipeline encode with, by name; its place is a parameter of the operators.
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op4_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 24)


def op7_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: The key that surrogates depend on; a deployment passes its own secret to replace_entities.
SURROGATE_KEY = "strandline-demo-key"


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return grade_toxicity(documents, train(documents, table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "documents"), planted=True)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.train(documents))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_roundtrip": op1_bpe_roundtrip,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_text_density": op3_text_density,
        "op4_ipf_mixing": op4_ipf_mixing,
        "op5_multiset_fingerprint": op5_multiset_fingerprint,
        "op6_jump_shards": op6_jump_shards,
        "op7_cuckoo_dedup": op7_cuckoo_dedup,
        "op8_bloom_cascade": op8_bloom_cascade,
        "op9_surrogates": op9_surrogates,
        "op10_ordinal_toxicity": op10_ordinal_toxicity,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_language_id": op13_language_id,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_cuckoo_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
            g AS (SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
        """,
        "op8_bloom_cascade": r"""
            WITH p AS (
                SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            h AS (
                SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
            r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
            m AS (
                SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
                FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
        """,
    }
