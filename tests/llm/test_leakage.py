import random
import re

import numpy as np
import pytest

from corpusmill.llm import leakage
from tests.conftest import rows

WORDS = re.compile("[㐀-鿿]|[^\\W_㐀-鿿]+")


def share(passage, text):
    """Brute force: the share of the passage's words in runs of the text."""
    p, t = (WORDS.findall(x.lower()) for x in (passage, text))
    run = 32 if 2 * sum("㐀" <= w <= "鿿" for w in p) > len(p) else 16
    here = {tuple(t[i : i + run]) for i in range(len(t) - run + 1)}
    covered = {i + k for i in range(len(p) - run + 1) if tuple(p[i : i + run]) in here for k in range(run)}
    return len(covered) / len(p) if p else 0


def case(rng, words):
    passage = [rng.choice(words) for _ in range(rng.randint(10, 90))]
    text = [rng.choice(words) for _ in range(60)]
    for _ in range(rng.randint(0, 3)):
        a = rng.randrange(len(passage))
        at = rng.randrange(len(text))
        text[at:at] = passage[a : a + rng.randint(8, 60)]
    return passage, text


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] if seed % 2 else [chr(0x4E00 + i) for i in range(40)]
    pairs = [case(rng, words) for _ in range(30)]
    passages = [(f"c{i}", " ".join(p)) for i, (p, _) in enumerate(pairs)]
    docs = [(i, "_-\n".join(t).upper()) for i, (_, t) in enumerate(pairs)]
    found = leakage.leaked_passages(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "case_id string, passage string")
    )
    want = {(i, c) for i, t in docs for c, p in passages if share(p, t) >= 0.5}
    got = found.collect()
    assert {(r[0], r[1]) for r in got if r["share"] >= 0.5} == want and want
    assert all(abs(r["share"] - share(dict(passages)[r[1]], dict(docs)[r[0]])) < 1e-9 for r in got)
    assert all(r["distance"] == 0 for r in got if r["share"] >= 0.5)


def test_joined_keys_give_the_same(spark):
    rng = random.Random(9)
    pairs = [case(rng, [f"w{i}" for i in range(400)]) for _ in range(20)] + [case(rng, [chr(0x4E00 + i) for i in range(400)]) for _ in range(10)]
    passages = [(f"c{i}", " ".join(p)) for i, (p, _) in enumerate(pairs)]
    docs = [(i, " ".join(t)) for i, (_, t) in enumerate(pairs)]
    docs += [(100 + i, " ".join(w if rng.random() > 0.06 else "new" for w in p.split())) for i, (_, p) in enumerate(passages)]
    args = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "case_id string, passage string")
    whole = rows(leakage.leaked_passages(*args))
    assert rows(leakage.leaked_passages(*args, broadcast_keys=0)) == whole and len(whole) > 20


def brute_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        last = row
    return last[-1]


def test_edit_distances():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (50, 12)), rng.integers(0, 3, (50, 12))
    assert leakage.distances(a, b).tolist() == [brute_distance(x, y) for x, y in zip(a.tolist(), b.tolist())]


def edited(rng, words, rate):
    out = []
    for w in words:
        how = rng.random() / rate
        if how < 1 / 3:
            out += [w, f"new{rng.randrange(10**9)}"]
        elif how < 2 / 3:
            out.append(f"new{rng.randrange(10**9)}")
        elif how >= 1:
            out.append(w)
    return out


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2])
def test_recall_of_edited_copies(spark, rate):
    """Items of 80 words (characters), copied with a share of their words edited, into other text."""
    rng = random.Random(4)
    passages = [(f"c{i}", " ".join(f"p{rng.randrange(3000)}" for _ in range(80))) for i in range(60)]
    passages += [(f"h{i}", "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(80))) for i in range(60)]
    docs = []
    for i, (_, p) in enumerate(passages):
        copy = edited(rng, WORDS.findall(p), rate)
        docs.append((i, " ".join([f"x{rng.randrange(3000)}" for _ in range(100)] + copy + ["end"] * 30)))
    found = leakage.leaked_passages(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "case_id string, passage string"), 0.1
    )
    met = {(r[0], r[1]) for r in found.collect()}
    recall = sum((i, c) in met for i, (c, _) in enumerate(passages)) / len(passages)
    print(f"recall at {rate:.0%} edits: {recall:.3f}")
    assert recall >= 0.9


def test_defined_cases(spark):
    words = " ".join(f"w{i}" for i in range(30))
    items = [("a", words), ("a", words), ("b", words), ("c", None), ("d", ""), ("e", "short one"), (None, words)]
    docs = [(1, words), (1, words), (2, None), (3, ""), (4, words + " x" * 200_000), (5, "short one")]
    i = spark.createDataFrame([(*r, 0) for r in items], "case_id string, passage string, doc_id int")
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id bigint, text string, case_id int")
    got = [tuple(r)[:2] for r in rows(leakage.leaked_passages(d, i))]
    assert got == [(1, "a"), (1, "b"), (4, "a"), (4, "b")]
    assert rows(leakage.leaked_passages(d.limit(0), i)) == [] and rows(leakage.leaked_passages(d, i.limit(0))) == []
