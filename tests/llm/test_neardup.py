import random
import re

import numpy as np
import pytest

from corpusmill.llm import neardup as n
from tests.conftest import rows

SCHEMA = "id string, revision bigint, body string, class string, bands string, key string"


def units(spark, data):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)


def similarity(a, b):
    s = []
    for x in (a, b):
        w = re.findall("[㐀-鿿]|[^\\W_㐀-鿿]+", x.lower())
        s.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 20 else set())
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        i = rng.randrange(len(out))
        out[i : i + 1] = [f"e{rng.random()}"] if rng.random() < 0.7 else []
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_pairs_against_brute_force(spark, block):
    rng = random.Random(4)
    bodies = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(25, 300))]
        bodies += [" ".join(edited(rng, base, share)) for share in (0, 0, 0.01, 0.03, 0.06, 0.1)]
    data = [(f"u{i:03}", 1, b) for i, b in enumerate(bodies)]
    want = {(a, b) for a, _, x in data for b, _, y in data if a < b and similarity(x, y) >= 0.5}
    members, pairs = n.similar_classes(units(spark, data), block=block)
    by = {}
    for i, c in members.collect():
        by.setdefault(c, []).append(i)
    got = {tuple(sorted((x, y))) for a, b, _ in pairs.collect() for x in by[a] for y in by[b]}
    got |= {(x, y) for m in by.values() for x in m for y in m if x < y}
    assert got == want and len(want) > 40
    if block == 1024:
        assert {tuple(r) for r in n.similar_pairs(units(spark, data)).collect()} == want


def test_close_pairs_against_brute_force():
    rng = np.random.default_rng(1)
    sketches = rng.integers(0, 256, (500, 32), dtype=np.uint8)
    sketches[1::3] = sketches[0:-1:3]
    sketches[1::3, :4] ^= 255
    group = np.sort(rng.integers(0, 20, 500))
    block, crossed = rng.integers(0, 2, 500), group % 2 == 0
    bits = np.unpackbits(sketches, axis=1).astype(int)
    want = {
        (i, j)
        for i in range(500)
        for j in range(i + 1, 500)
        if group[i] == group[j] and (not crossed[i] or block[i] != block[j]) and (bits[i] != bits[j]).sum() <= 120
    }
    assert set(n.close_pairs(sketches, group, block, crossed, 120)) == want and want
    assert list(n.close_pairs(sketches[:1], group[:1], block[:1], crossed[:1])) == []


def test_a_third_of_all_rows_are_copies(spark):
    words = " ".join(f"w{i}" for i in range(50))
    data = [(f"c{i:03}", 1, words) for i in range(60)] + [(f"r{i}", 1, " ".join(f"{i}x{k}" for k in range(40))) for i in range(120)]
    data += [("near", 1, words + " and a bit more")]
    groups = {r["id"]: (r["group"], r["links"]) for r in n.similar_groups(units(spark, data)).collect()}
    assert len(groups) == 181 and len({groups[f"c{i:03}"] for i in range(60)} | {groups["near"]}) == 1
    assert groups["near"][1] == 1 and groups["r1"][1] == 0
    want = sorted({tuple(sorted((x, y))) for x in list(groups) for y in list(groups) if x < y and groups[x][0] == groups[y][0]})
    assert rows(n.similar_pairs(units(spark, data), spread=7)) == want == rows(n.similar_pairs(units(spark, data))) and len(want) == 61 * 60 // 2


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    words = " ".join(f"v{i}" for i in range(19))
    data = [
        ("a", 1, long), ("b", 1, long + " x"), ("b", 1, long + " x"), ("c", 1, long), ("c", 2, "short"), ("d", 1, None), ("e", 1, ""),
        ("f", 1, words), ("g", 1, words), (None, 1, long), (" A", 0, "old"), ("h", None, long),
    ]
    assert rows(n.similar_pairs(units(spark, data))) == [("a", "b"), ("a", "h"), ("b", "h")]
    assert rows(n.similar_pairs(units(spark, []))) == [] and rows(n.similar_groups(units(spark, []))) == []
    with pytest.raises(ValueError):
        n.similar_classes(units(spark, []), 0.3)


def test_minima_of_32_bits_meet_as_often_as_texts_agree():
    """Equal minima stand for the share of common sequences, and 300 pairs at one half all share a bucket key."""
    from corpusmill.llm.neardup import BANDS, ROWS, minima

    rng, shares = np.random.default_rng(3), []
    for _ in range(300):
        x = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
        a, b = minima(x[:300]), minima(x[100:])  # 200 in both of 400
        assert a.dtype == np.uint32
        shares.append((a == b).mean())
        same = (a == b)[: BANDS * ROWS].reshape(ROWS, BANDS)
        assert same.all(axis=0).any()
    assert abs(np.mean(shares) - 0.5) < 0.01 and np.std(shares) < 0.05
