import random

import pytest

from corpusmill.io import Stages
from corpusmill.operators.hierarchy import back_edges, closure, connected_components, paths, roots, valid_parents
from tests.conftest import rows

SCHEMA = "id string, revision bigint, inherits_from array<string>, component string, parents string, row string"


def units(spark, data):
    return spark.createDataFrame([(i, r, p, "x", "y", "z") for i, r, p in data], SCHEMA)


def brute(parents):
    """Fewest links to each root, or the cycle, by walking every path."""
    out = {}
    for start in parents:
        best, seen, level, loop = {}, set(), [start], False
        reach = {}
        for k in range(len(parents) + 2):
            for n in level:
                reach.setdefault(n, k)
            level = [p for n in level for p in parents.get(n, ()) if p not in reach]
        for n in reach:
            todo, met = list(parents.get(n, ())), set()
            while todo:
                x = todo.pop()
                if x not in met:
                    met.add(x)
                    todo += parents.get(x, ())
            loop |= n in met
            if not parents.get(n):
                best[n] = reach[n]
        out[start] = {"cycle": -1} if loop else best
    return sorted(((i, r, d) for i, b in out.items() for r, d in b.items()), key=repr)


CASES = [
    ("a", 1, None),
    ("b", 1, [" A ", "a", None, " "]),
    ("c", 1, ["b", "a"]),
    ("d", 1, ["c", "lost"]),
    ("e", 1, ["e"]),
    ("f", 1, ["e", "a"]),
    ("g", 1, ["h"]),
    ("h", 1, ["g"]),
    ("i", 1, []),
    ("i", 2, ["a"]),
    ("i", 2, ["a"]),
    (None, 9, ["a"]),
]
EXPECTED = [
    ("a", "a", 0), ("b", "a", 1), ("c", "a", 1), ("d", "a", 2), ("d", "lost", 1), ("e", "cycle", -1),
    ("f", "cycle", -1), ("g", "cycle", -1), ("h", "cycle", -1), ("i", "a", 1),
]


LIMITS = [200_000, 1]


@pytest.mark.parametrize("task_links", LIMITS)
def test_roots_depths_and_cycles(spark, task_links):
    assert rows(roots(units(spark, CASES), task_links)) == EXPECTED


def test_ancestors_paths_and_links_on_cycles(spark):
    df = units(spark, CASES)
    assert rows(closure(df)) == [
        ("b", "a", 1), ("c", "a", 1), ("c", "b", 1), ("d", "a", 2), ("d", "b", 2), ("d", "c", 1), ("d", "lost", 1), ("i", "a", 1),
    ]
    got = {r["id"]: tuple(r)[1:] for r in paths(df).collect()}
    assert got["d"] == ("lost", 1, ["lost", "d"]) and got["c"] == ("a", 1, ["a", "c"]) and got["a"] == ("a", 0, ["a"])
    assert got["f"] == got["g"] == ("cycle", -1, None) and len(got) == 9
    assert rows(back_edges(df)) == [("e", "e"), ("g", "h"), ("h", "g")]


def above(parents, start):
    met, todo = set(), list(parents.get(start, ()))
    while todo:
        x = todo.pop()
        if x not in met:
            met.add(x)
            todo += parents.get(x, ())
    return met


@pytest.mark.parametrize("seed", [1])
def test_random_graphs_at_every_limit_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(24)]
    few = [0, 1, 1, 1, 2] if seed % 2 else [0, 0, 1, 1, 2]
    parents = {n: sorted(rng.sample(names, rng.choice(few))) for n in names}
    df = units(spark, [(n, 1, p) for n, p in parents.items()])
    want = brute(parents)
    reach = {n: above(parents, n) for n in names}
    rings = sorted(((n, p) for n in names for p in parents[n] if n in reach[p] or n == p), key=repr)
    best = {}
    for i, _, d in want:
        best[i] = min(d, best.get(i, d))
    seen = []
    for task_links in (200_000, 1):
        assert rows(roots(df, task_links)) == want
        assert rows(back_edges(df, task_links)) == rings
        ways = paths(df, task_links).collect()
        assert {r["id"]: r["depth"] for r in ways} == best and len(ways) == len(names)
        for r in ways:
            assert r["depth"] < 0 or (len(r["path"]) == r["depth"] + 1 and r["path"][0] == r["root_id"])
            assert r["depth"] < 0 or all(a in parents[b] for a, b in zip(r["path"], r["path"][1:]))
        pairs = rows(closure(df, task_links))
        assert {(i, a) for i, a, _ in pairs} == {(n, a) for n in names if best[n] >= 0 for a in reach[n]}
        seen.append((sorted(map(tuple, ways), key=repr), pairs))
    assert repr(seen[0]) == repr(seen[1])


def test_no_cycle_is_left_without_its_links(spark):
    parents = {"a": ["b", "c"], "b": ["a"], "c": ["a", "d"], "d": ["e"], "e": ["d", "f"], "f": [], "g": ["c"]}
    df = units(spark, [(n, 1, p) for n, p in parents.items()])
    for task_links in (1,):
        assert rows(back_edges(df, task_links)) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "d")]


def test_deep_chain_wide_star_and_long_circle_beyond_a_task(spark):
    chain = [(f"c{i:05}", 1, [f"c{i - 1:05}"] if i else []) for i in range(6000)]
    star = [(f"s{i}", 1, ["hub"]) for i in range(500)]
    circle = [(f"o{i}", 1, [f"o{(i + 1) % 300}"]) for i in range(300)] + [("under", 1, ["o7"])]
    got = {(a, b): c for a, b, c in rows(roots(units(spark, chain + star + circle), 50))}
    assert got["c05999", "c00000"] == 5999 and got["s17", "hub"] == 1 and got["under", "cycle"] == -1 and len(got) == 6801


def test_empty(spark):
    none = units(spark, [])
    for op in (roots, closure, paths, back_edges):
        assert rows(op(none)) == []
    assert rows(valid_parents(units(spark, [(None, 1, None)]))) == []


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), ("c", "a")], "a string, b string")
    got = rows(connected_components(edges, Stages(spark, "t")))
    assert got == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
