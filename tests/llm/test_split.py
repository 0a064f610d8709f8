import json

import pytest

from corpusmill.llm import split
from tests.conftest import rows

TEXT = ("Ein Satz. Noch einer! 第一句。第二句？\nline\n\n" * 60) + "x" * 900 + "中" * 500 + "🤖" * 200


def cut(spark, text, limit, overlap):
    df = spark.createDataFrame([("k", text, 1, 2)], "id string, body string, pos int, cut int")
    return [tuple(r) for r in split.split_texts(df, "id", "body", limit, overlap).orderBy("pos").collect()]


@pytest.mark.parametrize("limit,overlap", [(64, 0), (100, 16), (512, 64), (16_384, 512), (9, 5)])
def test_round_trip_limit_and_overlap(spark, limit, overlap):
    pieces = cut(spark, TEXT, limit, overlap)
    whole = b""
    for _, pos, n, start, lead, piece in pieces:
        raw = piece.encode()
        assert len(raw) <= limit and n == len(pieces) and start == len(whole)
        assert lead <= overlap and whole.endswith(raw[:lead])
        assert lead > overlap - 4 or lead == len(whole) or pos == 0
        whole += raw[lead:]
    assert whole.decode() == TEXT


def test_boundaries_in_order_of_strength(spark):
    def first(text, limit):
        return cut(spark, text, limit, 0)[0][5]

    assert first("a" * 30 + "\n\n" + "b" * 10 + "\n" + "c. " + "d" * 60, 60) == "a" * 30 + "\n\n"
    assert first("a" * 30 + "\n" + "b. " + "d" * 60, 60) == "a" * 30 + "\n"
    assert first("a" * 30 + ". " + "d" * 60, 60) == "a" * 30 + ". "
    assert first("甲" * 10 + "。" + "乙" * 40, 60) == "甲" * 10 + "。"
    assert first("ab\n\n" + "c" * 99, 60) == "ab\n\n"  # before the half, but there is no other
    assert first("ab " + "c" * 99, 60) == "ab "
    assert first("é" * 99, 61) == "é" * 30


def test_defined_cases(spark):
    assert cut(spark, None, 64, 8) == []
    assert cut(spark, "", 64, 8) == [("k", 0, 1, 0, 0, "")]
    assert cut(spark, "x" * 64, 64, 8) == [("k", 0, 1, 0, 0, "x" * 64)]
    assert len(cut(spark, "x" * 1_000_000, 16_384, 512)) == -(-1_000_000 // 15_872)
    with pytest.raises(ValueError):
        split.text_pieces("body", 64, 61)


def test_valid_units_only(spark):
    data = [("a", 1, "x" * 50), ("A ", 2, "x" * 5), ("b", 1, "y" * 50), ("b", 1, "y" * 50), (None, 1, "z" * 50), ("c", 1, None)]
    df = spark.createDataFrame(data, "id string, revision bigint, body string")
    assert rows(split.oversized_units(df, 10)) == [("b", "y" * 50)]


def fold(ids, size, most, most_bytes):
    """Brute force of the sublists."""
    out, cur = [], []
    weigh = lambda x: sum(size.get(i, 0) for i in set(x))
    for x in ids:
        if not cur or (len(cur) < most and weigh([*cur, x]) <= most_bytes):
            cur.append(x)
        else:
            out.append(cur)
            both = most > 1 and size.get(cur[-1], 0) + size.get(x, 0) <= most_bytes
            cur = [cur[-1], x] if both else [x]
    return [*out, cur]


def test_lists_against_brute_force(spark):
    size = {f"b{i}": (i * 37) % 50 for i in range(30)}
    lists = {
        "a": [f"b{i}" for i in range(30)], "b": ["b1", "b1", "b2"], "c": ["lost"] * 12, "d": ["b7"], "e": [f"b{i % 4}" for i in range(20)],
    }
    data = [(k, json.dumps(v)) for k, v in lists.items()] + [("a", json.dumps(lists["a"], indent=1))]
    data += [("n", None), ("m", ""), ("o", "[]"), ("p", "[broken"), ("q", "{}")]
    attempts = spark.createDataFrame(data, "attempt_id string, block_ids string")
    blocks = spark.createDataFrame([*size.items(), ("b1", None), ("b2", size["b2"])], "block_id string, n_bytes bigint")
    for most, most_bytes in ((8, 120), (3, 60), (1, 50)):
        got = {r["attempt_id"]: (r["ids"], r["sublists"]) for r in split.split_lists(attempts, blocks, most, most_bytes).collect()}
        assert got == {k: (len(v), fold(v, size, most, most_bytes)) for k, v in lists.items()}
    assert rows(split.split_lists(attempts.limit(0), blocks)) == []
