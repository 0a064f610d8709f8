"""Blocks, phrases and dependent results: nulls, empty texts, ties, repeats and empty tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import materials as m
from tests.conftest import rows

STATUS = "id string, status string, open_keys string"
ABOVE = "id string, ancestor_id string"


def test_block_texts_of_repeated_and_null_rows(spark):
    df = spark.createDataFrame(
        [("t", "b", "x", None), ("t", "b", "x", "y"), ("t", "c", None, None)], "task_id string, block_id string, title string, summary string"
    ).withColumn("id", F.lit("other"))
    assert rows(m.block_texts(df)) == sorted([("t/b", "x", "y"), ("t/c", None, None)], key=repr)


def test_best_of_tasks_takes_the_least_block_of_a_tie(spark):
    df = spark.createDataFrame([("q", "t/b", 1.0), ("q", "t/a", 1.0), ("q", "s/z", 0.5)], "query_id string, id string, score double")
    assert rows(m.best_of_tasks(df)) == [("q", "s", "z", 0.5), ("q", "t", "a", 1.0)]
    assert m.best_of_tasks(df.limit(0)).count() == 0


def test_phrases_stand_as_whole_words(spark):
    queries = spark.createDataFrame([(1, "The Swap-Gate, swap gate"), (2, "swapgate"), (3, None), (4, "")], "query_id int, query string")
    phrases = spark.createDataFrame([("swap gate",), ("gate",), ("the swap gate is long",), (None,), ("",)], "phrase string")
    assert rows(m.phrase_hits(queries, phrases)) == [(1, "gate"), (1, "swap gate")]
    assert m.phrase_hits(queries, phrases.limit(0)).count() == 0


def test_fillers_go_unless_nothing_else_is_there(spark):
    queries = spark.createDataFrame([(1, "how to swap gate"), (2, "how to"), (3, None)], "query_id int, query string")
    phrases = spark.createDataFrame([("swap gate",)], "phrase string")
    fillers = spark.createDataFrame([("how",), ("to",), ("to",)], "term string")
    assert rows(m.query_terms(queries, phrases, fillers)) == [(1, ["swap", "gate", "swap_gate"]), (2, ["how", "to"]), (3, [])]


def test_uncovered_keeps_what_only_worse_hits_inherit(spark):
    ranked = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 3)], "query_id string, id string, rank int")
    above = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "c")], ABOVE)
    assert [r[:2] for r in rows(m.uncovered(ranked, above))] == [("q", "b"), ("q", "c")]
    assert m.uncovered(ranked, above.limit(0)).count() == 3


def test_inherited_status_is_the_worst(spark):
    status = spark.createDataFrame([("a", "unknown", "k"), ("b", "matched", ""), ("c", "mismatch", "j")], STATUS)
    above = spark.createDataFrame([("b", "a"), ("b", "gone"), ("a", "c")], ABOVE)
    assert rows(m.inherited_status(status, above)) == [("a", "mismatch", "j,k"), ("b", "unknown", "k"), ("c", "mismatch", "j")]


def test_retired_reaches_below_what_goes(spark):
    status = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", False)], "id string, withdrawn boolean")
    above = spark.createDataFrame([("b", "a"), ("c", "gone"), ("d", "d2"), ("d", "b"), ("d", "a")], ABOVE)
    assert rows(m.retired(status, above)) == [("a", "withdrawn"), ("b", "dangling"), ("c", "dangling"), ("d", "dangling")]


def test_rebased_prefers_the_remote_row(spark):
    one = lambda *x: spark.createDataFrame(list(x), "id string, revision int")
    got = m.rebased(one(("a", 1), ("n", None)), one(("b", 1), ("a", 1)), one(("a", 2), ("b", 1), ("c", None)))
    assert rows(got) == [("a", 1, "remote", True), ("c", None, "draft", False), ("n", None, "remote", False)]


def test_even_shares_pass_on_what_is_left(spark):
    df = spark.createDataFrame(
        [("t", "a", 0, 10), ("t", "b", 1, 100), ("t", "c", 2, None), ("t", "d", 3, 100), ("t", "e", 4, 1)],
        "task_id string, block_id string, pos int, n_bytes bigint",
    )
    assert rows(m.even_shares(df, 4, 100)) == [("t", 1, "a", 10), ("t", 2, "b", 30), ("t", 3, "c", 0), ("t", 4, "d", 60)]


def test_documents_come_back_whole(spark):
    texts = ["", "a\n" * 50, "ä漢😀" * 40, "x" * 300, "\r\n  ", "tail\n"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id int, text string")
    stored = m.stored_blocks(df, 64)
    assert stored.agg(F.max(F.octet_length("block"))).first()[0] <= 64
    assert rows(m.put_together(stored.orderBy(F.rand(1)))) == sorted(enumerate(texts), key=repr)


def test_marked_indexed_ignores_unknown_and_repeated_ids(spark):
    df = spark.createDataFrame([("t", "a", None), ("t", "b", True)], "task_id string, block_id string, indexed boolean")
    done = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "zz"), (None, None)], "task_id string, block_id string")
    assert rows(m.marked_indexed(df, done)) == [("t", "a", None, True), ("t", "b", True, True)]


def test_two_sides_names_the_missing_one(spark):
    df = spark.createDataFrame([("x", "p", 10), ("x", "p", 20), ("x", "q", 30), ("y", "q", 5), ("z", "p", None)], "case string, side string, ms bigint")
    assert rows(m.two_sides(df, "p", "q")) == [("x", "both", 15, 30, 2.0), ("y", "candidate only", None, 5, None)]


def test_remedies(spark):
    df = spark.createDataFrame([("failed", "budget"), ("failed", None), ("invoking", None), ("applied", None), (None, "x")], "status string, error string")
    assert [r[0] for r in df.select(m.remedy("status", "error")).collect()] == ["split", "look", "unknown outcome", None, None]


def test_bm25_is_the_same_with_spread_terms(spark):
    from corpusmill.operators.ranking import bm25

    corpus = spark.createDataFrame(
        [("a", "swap gate", "swap the gate"), ("b", None, "gate"), ("c", "", None), ("d", "other", "gate gate")], "id string, header string, body string"
    )
    queries = spark.createDataFrame([(1, "swap gate"), (2, "gate"), (3, ""), (4, None), (5, "absent")], "query_id int, query string")
    few = rows(bm25(corpus, queries, broadcast_terms=0))
    assert few == rows(bm25(corpus, queries))
    assert [r[:2] for r in few] == [(1, "a"), (1, "b"), (1, "d"), (2, "a"), (2, "b"), (2, "d")]
    assert bm25(corpus.limit(0), queries).count() == 0 and bm25(corpus, queries.limit(0)).count() == 0


def test_best_units_are_the_top_of_bm25(spark):
    from corpusmill.operators.ranking import best_units, bm25, top_k

    units = [(f"u{i:03}", ["red stock", "blueKey_red", None, "stock of 7"][i % 4], f"stock the key {'red ' * (i % 5)}{'中文字' * (i % 3)} n{i % 7}") for i in range(60)]
    units += [("none", None, None), ("empty", "", "")]
    corpus = spark.createDataFrame(units, "id string, header string, body string").repartition(3)
    asked = [(f"u{i:03}", f"the {'stock ' * (i % 2)}red n{i % 7} 中文 blueKey") for i in range(0, 60, 7)] + [("a", "absent"), ("b", ""), ("c", None), ("d", "stock")]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    for parts in (True, False):
        want = rows(top_k(bm25(corpus, queries, parts), 4).select("query_id", "id", "score", "rank"))
        assert len(want) == 4 * 10
        for limit in (200_000, 30):
            assert rows(best_units(corpus, queries, 4, parts, limit).select("query_id", "id", "score", "rank")) == want
    assert best_units(corpus.limit(0), queries, 4).count() == 0 and best_units(corpus, queries.limit(0), 4).count() == 0


def test_best_units_sends_no_row_for_each_pair():
    """60 equal queries against 4,000 units in 8 blocks that all hold the term: 240,000 pairs, 60 * 8 * 3 rows at most."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from corpusmill.operators.ranking import _best, _postings

    docs = [pa.RecordBatch.from_pydict({"id": [f"u{j + i:04}" for i in range(500)], "terms": [["x"] * (1 + i % 9) for i in range(500)], "header": [["x"]] * 500}) for j in range(0, 4000, 500)]
    asked = SimpleNamespace(value=(pa.array([f"q{i}" for i in range(60)]), [[0]] * 60, np.array([0.1]), 5.0))
    postings = list(_postings(SimpleNamespace(value=pa.array(["x"])))(iter(docs)))
    got = [b.num_rows for b in _best(asked, 3, block=500)(iter(postings))]
    assert 60 * 3 <= sum(got) <= 60 * 8 * 3


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
@pytest.mark.parametrize("name", ["a12_known_item_eval", "l03_related_units"])
def test_queries_that_grow_with_the_units_make_no_pairs(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from corpusmill.operators import ranking

    monkeypatch.setattr(ranking, "bm25", lambda *_, **__: pytest.fail("a row for each pair of title and unit"))
    assert entry.queries()[name](spark, "/root/testdata/sf0.01").count() > 0
