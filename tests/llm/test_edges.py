"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import zlib

import pytest

from chronoweave.llm import decontam, embed, jaccard, langid, mixing, pii, quality, secrets, sharding, tokens
from chronoweave.llm.common import fresh_path


def run_langid(spark, docs):
    return langid.identify(docs, langid.fit(docs))


def run_quality(spark, docs):
    model = quality.fit_labels(docs)
    return quality.classify(docs, model, quality.fit_scorer(docs, model, rounds=2))


OPERATORS = {
    "pii": lambda s, d: pii.detect(d),
    "secrets": lambda s, d: secrets.BlobLedger(s, fresh_path(s, "ledger")).scan(d),
    "jaccard": lambda s, d: jaccard.near_duplicates(d, 4, 85),
    "tokens": lambda s, d: tokens.write_tokens(d, tokens.default_vocabulary()).digests(),
    "quality": run_quality,
    "sharding": lambda s, d: sharding.shard_documents(d),
    "mixing": lambda s, d: mixing.mix_sources(d),
    "langid": run_langid,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, edge_docs, edge_rows, name):
    out = [r["doc_id"] for r in OPERATORS[name](spark, edge_docs).collect()]
    assert sorted(out, key=str) == sorted((r[0] for r in edge_rows), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, no_docs, name):
    assert OPERATORS[name](spark, no_docs).collect() == []


def test_defined_results(spark, edge_docs):
    lang = {r["doc_id"]: r for r in run_langid(spark, edge_docs).collect()}
    assert [lang[i]["lang_pred"] for i in (4, 5, 6, 9)] == ["und"] * 4
    assert lang[1]["lang_pred"] == "en" and lang[7]["lang_pred"] == "fr" and 0 < lang[7]["score"] <= 1
    groups = {r["doc_id"]: r for r in jaccard.near_duplicates(edge_docs, 4, 85).collect()}
    assert groups[2]["component_id"] == groups[3]["component_id"] == 1
    assert groups[10]["component_id"] == 7 and groups[5]["component_id"] == 5 and groups[5]["n_shingles"] == 0 and groups[11]["n_shingles"] == 1
    assert groups[13]["n_shingles"] == 29_997
    shards = sharding.shard_documents(edge_docs).collect()
    by = {r["doc_id"]: r for r in shards}
    assert by[4]["size"] == 1 and by[4]["text_crc32"] == 0 and by[12]["size"] == len("héé ßß ñ".encode()) + 1
    assert by[1]["shard"] == by[2]["shard"] and by[1]["text_crc32"] == zlib.crc32(edge_docs.where("doc_id = 1").first()["text"].encode())
    mix = {r["doc_id"]: r for r in mixing.mix_sources(edge_docs).collect()}
    assert mix[4]["size"] == 0 and mix[4]["taken"] == 0 and all(r["taken"] <= 2 * r["size"] for r in mix.values())


def test_benchmark_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (2, None), (3, ""), (None, "too short")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(edge_docs, items).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert decontam.overlaps(no_docs, items).collect() == [] and decontam.overlaps(edge_docs, items.limit(0)).collect() == []
    assert {r["doc_id"] for r in decontam.decontaminate(edge_docs, items).select("doc_id").collect()}.isdisjoint({1, 2, 3})


def test_vector_edges(spark):
    rows = [
        (1, [1.0, 0.0, 0.0, 0.0], "x"), (2, [1.0, 0.0, 0.0, 0.0], "x"), (3, [2.0, 0.01, 0.0, 0.0], "x"), (4, None, None), (5, [], "x"),
        (6, [0.0, 0.0, 0.0, 0.0], "x"), (7, [1.0, None, 0.0, 0.0], "x"), (8, [float("nan"), 0.0, 0.0, 1.0], "x"), (9, [float("inf"), 0.0, 0.0, 0.0], "x"),
        (10, [1.0, 0.0], "x"), (None, [1.0, 0.0, 0.0, 0.0], "x"), (11, [0.0, 1.0, 0.0, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").selectExpr("*", "label cls", "label links", "label component")
    out = {r["vec_id"]: r for r in embed.near_duplicates(df).collect()}
    assert len(out) == len(rows)
    assert [out[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1] and [out[i]["n_links"] for i in (1, 2, 3)] == [2, 2, 2]
    assert all(out[i]["component_id"] == i and out[i]["n_links"] == 0 and out[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert embed.near_duplicates(df.limit(0)).collect() == []
