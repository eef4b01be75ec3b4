"""Each pipeline stage on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "stage"), pipeline.STAGES)
def test_empty_table(spark, no_docs, name, stage):
    out = stage(spark, no_docs, SF)
    assert out.collect() == []
    assert name == "token_files" or out.columns == list(pipeline.COLUMNS)


@pytest.fixture(scope="module")
def results(spark, edge_docs):
    return {name: stage(spark, edge_docs, SF).collect() for name, stage in pipeline.STAGES}


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_columns(results, name):
    assert results[name] and list(results[name][0].asDict()) == list(pipeline.COLUMNS)


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=str)


def test_language(results):
    """Texts without letters go, null and empty ones too; all rows of a repeated id and those without an id stay."""
    kept = ids(results["language"])
    assert not {4, 5, 6, 9} & set(kept) and kept.count(10) == 2 and None in kept and {1, 2, 3, 7, 8} <= set(kept)
    assert {r["doc_id"]: r["lang"] for r in results["language"]}[8] == "fr"


def test_near_duplicates(results):
    """One row of each group, the one with the least id; rows without words or id, and texts of their own, stay."""
    kept = ids(results["near_duplicates"])
    assert {1, 7, 4, 5, 6, 9, 11, 12, 13, 14, 15, 16} <= set(kept) and not {2, 3, 8, 10} & set(kept) and None in kept


def test_decontamination(results, edge_rows):
    assert ids(results["decontamination"]) == ids([{"doc_id": r[0]} for r in edge_rows])


def test_mixture(results, edge_docs):
    """At most two copies; nothing without words or id is taken."""
    taken = ids(results["mixture"])
    assert taken and not {None, 4, 5, 6} & set(taken)
    assert all(taken.count(i) <= (4 if i == 10 else 2) for i in set(taken))


def test_token_files(results, edge_rows):
    """A row for each row; texts without content have the end id alone."""
    out = results["token_files"]
    assert ids(out) == ids([{"doc_id": r[0]} for r in edge_rows])
    assert all(r["n_tokens"] == 1 for r in out if r["doc_id"] in (4, 5))
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
