"""The pipeline: stages keep what they should, and its result is that of the stages one after the other."""

import hashlib
import re

import pytest

import corpus_pipeline
from strandline.llm import mixing, queries
from test_minhash import brute_links, kept


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixture", "encode"]


def test_run_equals_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns or name == "encode"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    source = {r["doc_id"]: r for r in before.sparkSession.read.parquet(f"{sf}/documents.parquet").collect()}
    clean = [i for i, t in labels.items() if not t and i in source]
    assert sum(i in seen["toxicity"] for i in clean) > 0.98 * len(clean)
    least = {}
    for i, r in sorted(seen["toxicity"].items()):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), i)
    assert set(seen["exact_dedup"]) == set(least.values())
    texts = {i: r["text"] for i, r in seen["exact_dedup"].items()}
    stay = set(seen["near_dedup"])
    assert stay == kept(texts, brute_links(texts))
    assert set(seen["mixture"]) <= stay and set(seen["encode"]) == set(seen["mixture"])
    for i, r in seen["encode"].items():
        assert r["decoded_sha256"] == hashlib.sha256(seen["mixture"][i]["text"].encode()).hexdigest()
    run = {r["doc_id"]: r["ids_sha256"] for r in queries.pipeline(spark, sf).collect()}
    assert run == {i: r["ids_sha256"] for i, r in seen["encode"].items()}


ODD = [(3, "a b"), (3, "a b"), (1, "a  b"), (None, "a b"), (None, None), (7, ""), (8, " "), (None, "only here"), (9, "x y " * 400_000)]


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "near_dedup", "mixture", "encode"])
def test_stages_take_nulls_repeats_ties_long_texts_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "cast(null AS string) AS source", "cast(length(text) AS long) AS n_chars")
    docs = docs.selectExpr("*", "1 AS k1", "2 AS word", "3 AS gone", "4 AS _row", "5 AS print", "6 AS probability", "7 AS tokens")
    out = stage(spark, docs, "/root/testdata/sf0.001")
    ids = sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=str)
    wanted = {
        "toxicity": [3, 3, 1, None, None, 7, 8, None, 9],  # labels name none of these ids' texts: nothing is rejected for words it lacks
        "exact_dedup": [1, 7, 8, None, 9],  # "a b" by its smallest id, "" by 7, " " is not ""
        "near_dedup": [1, 7, None, 9],  # texts without words are one group
        "encode": [3, 3, 1, None, None, 7, 8, None, 9],
    }
    if name in wanted:
        assert ids == sorted(wanted[name], key=str)
    else:
        assert all(ids.count(i) <= [r[0] for r in ODD].count(i) for i in ids)
    assert out.columns == docs.columns or name == "encode"
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_many_cells_of_the_mixture_are_merged_whatever_their_files_hold(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a b ', id) AS text", "cast(id % 5 AS string) AS source", "'en' AS lang")
    few = {r["doc_id"] for r in mixing.sample_mixture(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    many = mixing.sample_mixture(docs)
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"] for r in many.collect()} == few
