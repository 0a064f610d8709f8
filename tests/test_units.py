import math
import re

from corpusmill.operators import ranking, units as u
from tests.conftest import rows


def conditions(spark, *texts):
    return spark.createDataFrame([(f"u{i}", x) for i, x in enumerate(texts)], "id string, conditions string")


def test_conditions_are_three_valued(spark):
    observed = {"device": "a3", "framework.qx": "2.5", "batch": "unknown", "size": "8"}
    cases = [
        ('{"device": "a3"}', "matched", ""),
        ('{"device": "a2"}', "mismatch", ""),
        ('{"device": ["a2", "a3"]}', "matched", ""),
        ('{"device": "any", "lost": "general"}', "matched", ""),
        ('{"lost": "x"}', "unknown", "lost"),
        ('{"device": "unknown"}', "unknown", "device"),
        ('{"batch": 8}', "unknown", "batch"),
        ('{"framework": {"qx": ">=2.4,<3"}}', "matched", ""),
        ('{"framework": {"qx": ">=2.10"}}', "mismatch", ""),
        ('{"framework": {"other": ">=1"}}', "unknown", "framework"),
        ('{"framework": {"qx": ">=new"}}', "unknown", "framework"),
        ('{"size": {"exact_set": ["8"]}}', "matched", ""),
        ('{"size": {"exact_set": ["8", "9"]}}', "mismatch", ""),
        ('{"lost": "x", "device": "a2"}', "mismatch", "lost"),
        ("not json", "unknown", ""),
        (None, "unknown", ""),
    ]
    got = rows(u.match_conditions(conditions(spark, *[c for c, _, _ in cases]), observed))
    want = sorted(((f"u{i}", s, k) for i, (_, s, k) in enumerate(cases)), key=repr)
    assert got == want
    assert rows(u.match_conditions(conditions(spark), observed)) == []


def test_valid_rows(spark):
    data = [("a", 1, "old", "x"), ("A ", 2, "new", "y"), ("a", 2, "new", "y"), (None, 3, "z", "z")]
    got = rows(u.valid_units(spark.createDataFrame(data, "id string, revision bigint, body string, row string")))
    assert got == [("a", 2, "new", "y")]


def test_bm25_against_brute_force(spark):
    docs = [("a", "alpha lane", "alpha beta beta"), ("b", None, "beta gamma"), ("c", "lane", None), ("d", "", "")]
    queries = [("q1", "alpha beta"), ("q2", "lane lane"), ("q3", ""), ("q4", "nothing")]
    corpus = spark.createDataFrame(docs, "id string, header string, body string")
    asked = spark.createDataFrame(queries, "query_id string, query string")
    words = {i: re.findall("[a-z]+", f"{h or ''}\n{b or ''}") for i, h, b in docs}
    average = sum(map(len, words.values())) / 4
    want = []
    for q, text in queries:
        for i, h, _ in docs:
            score = 0
            for term in set(text.split()):
                tf, df = words[i].count(term), sum(term in w for w in words.values())
                if tf:
                    idf = math.log(1 + (4 - df + 0.5) / (df + 0.5))
                    head = 1.25 if term in (h or "").split() else 1
                    score += head * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / average))
            if score:
                want.append((q, i, round(score, 6)))
    got = ranking.bm25(corpus, asked)
    assert rows(got) == sorted(want, key=repr)
    assert [r["id"] for r in ranking.top_k(got, 1).where("query_id = 'q1'").collect()] == ["a"]
    assert rows(ranking.bm25(corpus.limit(0), asked)) == []


def test_duplicate_rules_and_trigger_classes(spark):
    schema = (
        "id string, body string, conditions string, tier string, category string, evidence_strength string, inherits_from array<string>,"
        "provenance struct<source: string>, triggers struct<error_signatures: array<string>, keywords: array<string>>, domain_path string"
    )
    base = ("x", "{}", "L1", "c", "e")
    data = [
        ("a", *base, ["p", "q"], ("s",), (["E1"], ["Lane Bias"]), "x/y/z/w"),
        ("b", *base, ["q", "p"], ("t",), (None, ["bias", "lane e1", None]), "x/y"),
        ("c", "other", "[]", "L1", "c", "e", None, None, (["e1"], ["bias-lane"]), None),
        ("d", None, None, None, None, None, None, None, None, ""),
    ]
    frame = spark.createDataFrame(data, schema)
    assert [r[1:] for r in rows(u.duplicate_rules(frame.withColumn("rule", u.rule_key())))] == [(2, "a", 2, "other_source")]
    assert rows(u.trigger_classes(frame)) == [("bias e1 lane", 3, "a", 2)]
    got = {(k, p): n for k, p, n, *_ in rows(u.shard_metrics(u.with_size(frame)))}
    assert got["subtree", "x/y/z"] == 1 and got["subtree", "x/y"] == 1 and got["leaf", "."] == 2 and got["federation", "x"] == 2
