from datetime import datetime

from corpusmill.operators.snapshots import _two_pointers, snapshot_changes
from tests.conftest import rows

SCHEMA = "snapshot_id bigint, delivered_at timestamp, id string, revision bigint, content_sha256 string, delta string, row string"


def at(day):
    return datetime(2030, 1, day)


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


def test_two_pointers_emit_each_kind():
    left = [("a", 1, "x"), ("b", 1, "x"), ("d", 1, None)]
    right = [("b", 2, "y"), ("c", 1, "x"), ("d", 1, "z")]
    assert list(_two_pointers(left, right)) == [
        ("a", "removed", None),
        ("b", "changed", "revision,content_sha256"),
        ("c", "added", None),
    ]
    assert list(_two_pointers([], [])) == []


def test_changes_between_present_deliveries(spark):
    data = [
        (1, at(1), "a", 1, "S"),
        (1, at(1), " A ", 1, "S"),  # the same unit again
        (1, at(1), "b", 1, None),
        (3, at(3), "a", 1, "sha256:s"),  # an unclean spelling is no change
        (3, at(3), "b", 1, "t"),  # a digest that was not given is no change
        (3, at(3), "c", 5, "old"),
        (3, at(9), "c", 1, "new"),  # late, but the one that counts
        (4, at(4), "a", 2, "s"),
        (4, at(4), "c", 1, "NEW"),
        (4, at(4), None, 1, "x"),
        (None, at(4), "z", 1, "x"),
    ]
    got = rows(snapshot_changes(frame(spark, data)))
    assert got == [(3, "c", "added", None), (4, "a", "changed", "revision"), (4, "b", "removed", None)]


def test_null_revision_ties_and_nulls_in_time(spark):
    data = [
        (1, None, "a", None, ""),
        (1, None, "a", 3, ""),  # a tie in time: the highest revision
        (2, at(2), "a", None, "d"),
        (2, None, "a", 3, "d"),  # no time counts as the earliest
    ]
    assert rows(snapshot_changes(frame(spark, data))) == [(2, "a", "changed", "revision")]


def test_one_unit_with_a_third_of_all_rows(spark):
    data = [(s, at(1), "hot", s, "x") for s in (1, 2) for _ in range(500)]
    data += [(s, at(1), f"u{i}", 1, "x") for s in (1, 2) for i in range(500)]
    assert rows(snapshot_changes(frame(spark, data))) == [(2, "hot", "changed", "revision")]


def test_empty_and_single_delivery(spark):
    assert rows(snapshot_changes(frame(spark, []))) == []
    assert rows(snapshot_changes(frame(spark, [(1, at(1), "a", 1, "x")]))) == []
