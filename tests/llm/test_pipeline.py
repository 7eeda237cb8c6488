"""Each stage of the pipeline against a plain version on what the stage before it kept, and the whole run."""

import pytest

import corpus_pipeline
from cubewright.llm import substring
from test_operators import jaccard_groups
from tests_llm_help import SPACED, benchmark_windows, hits, words


@pytest.fixture(scope="module")
def kept(spark, docs, data):
    """Name to (table given to the stage, its rows, rows returned)."""
    out, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, at, data)
        rows = done.collect()
        out[name] = (at, at.collect(), rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == docs.columns
            at = spark.createDataFrame(rows, docs.schema)
    return out


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontaminate", "packing"]


def test_language_drops_letterless_texts(kept):
    _, given, got = kept["language"]
    assert sorted(got) == sorted(r for r in given if any(c.isalpha() for c in r["text"] or ""))


def test_one_document_of_each_group_stays(kept):
    _, given, got = kept["near_duplicates"]
    _, least = jaccard_groups({r["doc_id"]: r["text"] for r in given}, 5, 80)
    assert sorted(got) == sorted(r for r in given if least[r["doc_id"]] == r["doc_id"])


def test_repeats_are_cut_and_all_documents_stay(kept):
    docs, given, got = kept["substrings"]
    new = {r["doc_id"]: r for r in substring.dedup_substrings(docs).collect()}  # held against brute force in test_operators
    assert len(got) == len(given)
    before = {r["doc_id"]: r for r in given}
    for r in got:
        old = before[r["doc_id"]]
        assert r["text"] == new[r["doc_id"]]["text"] and (r["lang"], r["source"]) == (old["lang"], old["source"])
        assert r["n_chars"] == (len(r["text"]) if new[r["doc_id"]]["n_removed"] else old["n_chars"])


def test_contaminated_documents_go(spark, data, kept):
    _, given, got = kept["decontaminate"]
    windows = benchmark_windows(spark.read.parquet(f"{data}/benchmark.parquet").collect())
    clean = lambda w, hit, _: not hit or 20 * len(hit) < len(w)
    assert sorted(got) == sorted(r for r in given if clean(*hits(r["text"], windows)))


def test_every_word_is_packed_once(kept):
    _, given, got = kept["packing"]
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {r["doc_id"]: len(words(r["text"], SPACED)) for r in given}


def test_run_applies_all_stages(spark, data, kept):
    lengths = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows)
    assert lengths(corpus_pipeline.run(spark, data).collect()) == lengths(kept["packing"][2])


def test_odd_rows_and_empty_tables(spark, data, odd_docs, no_docs):
    """Texts without a letter go (ids 1, 2, 3, 9 and a row of nulls); of near duplicates the larger id goes; repeated rows and a row without an id stay."""
    at, ids = odd_docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, data).collect() == []
        done = stage(spark, at, data)
        rows = done.collect()
        assert done.columns == odd_docs.columns
        ids[name] = sorted((r["doc_id"] or 0) for r in rows)
        at = spark.createDataFrame(rows, odd_docs.schema)
    assert ids["language"] == [0, 4, 5, 5, 6, 7, 8]
    assert ids["near_duplicates"] == ids["substrings"] == ids["decontaminate"] == [0, 4, 5, 5, 7]
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted({(r["doc_id"] or 0) for r in last(spark, at, data).collect()}) == [0, 4, 5, 7]
    assert last(spark, no_docs, data).collect() == []
