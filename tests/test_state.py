from pyspark.sql import functions as F

from corpusmill.operators import evidence, state as st
from corpusmill.sources import files
from tests.conftest import rows


def attempts(spark, data):
    return spark.createDataFrame(data, "attempt_id string, task_id string, batch_id string, status string, created double, updated double")


def test_stagnation_and_settled(spark):
    data = [
        ("a", "t", "b1", "applied", 1.0, 1.0),
        *[(f"f{i}", "t", "b1", "failed", 2.0 + i, 2.0) for i in range(3)],
        ("r", "t", "b2", "invoking", 9.0, 9.0),
        ("x", None, "b3", "applied", 1.0, 1.0),
        ("y", "u", "b4", "failed", 1.0, 1.0),
        ("y", "u", "b4", "applied", 1.0, 2.0),
    ]
    valid = st.attempts(attempts(spark, data))
    assert valid.count() == 7
    assert rows(st.stagnation(valid)) == [("t", 5, 3, "stuck"), ("u", 1, 0, "moving"), (None, 1, 0, "moving")]
    assert dict((b, s) for b, _, s in rows(st.settled(valid))) == {"b1": "failed", "b2": "pending", "b3": "complete", "b4": "complete"}
    assert rows(st.stagnation(attempts(spark, []))) == []


def test_blocks(spark):
    schema = "task_id string, block_id string, pos int, n_bytes bigint, sha256 string, title string, source_range struct<range_start: bigint, range_end: bigint>, indexed boolean"
    data = [("t", f"b{i}", i, 20_000, "s", "x", (i * 10, i * 10 + (5 if i == 2 else 10)), True) for i in range(10)]
    data += [data[0], ("u", "z", None, None, None, None, None, None)]
    valid = st.blocks(spark.createDataFrame(data, schema))
    assert rows(st.packed(valid)) == [("t", 0, 3, 60_000), ("t", 1, 3, 60_000), ("t", 2, 3, 60_000), ("t", 3, 1, 20_000), ("u", 0, 1, 0)]
    assert rows(st.coverage_gaps(valid)) == [("t", 25, 30)]
    assert ("t", 0, "b0", None, "b1") in rows(st.neighbours(valid))
    assert rows(st.packed(valid.limit(0))) == []


def test_frontier_against_brute_force(spark):
    data = [(g, f"c{g}{i}", (i * 7) % 5 / 4, (i * 3) % 7 * 1.0, 0) for g in range(2) for i in range(15)]
    frame = spark.createDataFrame(data, "g int, id string, good double, cost double, _other int")
    want = [
        r for r in data
        if not any(o[0] == r[0] and o[2] >= r[2] and o[3] <= r[3] and (o[2] > r[2] or o[3] < r[3]) for o in data)
    ]
    got = rows(evidence.pareto_frontier(frame, "g", "good", "cost").select("g", "id", "good", "cost", "_other"))
    assert got == sorted(want, key=repr)


def test_retention(spark):
    data = [
        ("g", True, True, 4.0, 2.0, False), ("g", True, True, 1.0, 2.0, True), ("g", True, False, 1.0, 1.0, False),
        ("g", False, True, 1.0, 1.0, False), ("g", False, False, None, None, False), ("g", None, True, 1.0, 1.0, False),
        ("g", True, True, 0.0, 1.0, False),
    ]
    schema = "k string, baseline_pass boolean, candidate_pass boolean, baseline_ms double, candidate_ms double, guard boolean"
    got = rows(evidence.retention(spark.createDataFrame(data, schema), "k"))
    assert got == [("g", 2, 1, 1, 1, 2, 0.666667, 1.0, False)]


def test_json_lines_and_markdown(spark, tmp_path):
    data = [("a", 1, ["p"], "line\n---\nbody"), ("b", None, None, ""), ("c", 2, [], None)]
    frame = spark.createDataFrame(data, "id string, revision bigint, inherits_from array<string>, body string")
    files.write_json_lines(frame, str(tmp_path / "x"))
    back = files.read_json_lines(spark, str(tmp_path / "x"), "id string, revision bigint, inherits_from array<string>, body string")
    assert rows(back.drop("_damaged")) == sorted(data, key=repr)
    schema = {"id": "string", "revision": "bigint", "inherits_from": "array<string>"}
    parsed = files.parse_markdown(files.unit_markdown(frame).select("markdown"), schema)
    assert rows(parsed) == sorted([(*r[:3], r[3] or "", None) for r in data], key=repr)
    bad = spark.createDataFrame([("no head",), ("---\nid: 1\nid: 2\n---\nx",)], "markdown string")
    assert sorted(r["error"] for r in files.parse_markdown(bad, schema).collect()) == ["no front matter", "repeated key"]
    assert files.parse_markdown(bad.where(F.lit(False)), schema).count() == 0


def test_pages_carry_open_blocks():
    from corpusmill.streaming.carried import scan_page

    assert scan_page("a ``` bcd", False) == (4, True)
    assert scan_page("ef ``` g", True) == (3, False)
    assert scan_page("plain", True) == (5, True)
    assert scan_page("```x``````y```", False) == (2, False)
    assert scan_page("", False) == (0, False)


def test_fences_that_page_borders_cut():
    from corpusmill.streaming.carried import scan_carried, scan_page

    for text in ("ab```cd```ef", "a``b```c`d```", "```x``````y```z``", "````a```", "a```b``"):
        for size in (1, 2, 3, 5):
            inside, open_, ticks = 0, False, 0
            for i in range(0, len(text), size):
                n, open_, ticks = scan_carried(text[i : i + size], open_, ticks)
                inside += n
            assert (inside, open_) == scan_page(text, False)
