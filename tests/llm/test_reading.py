import random

import numpy as np
import pytest

from corpusmill.llm import reading
from tests.conftest import rows

EASY = "The {a} is {b}. We {c} the {a}. It is {b}!"
MIDDLE = "After the update we {c} the {a} once more, and the {a} reports every {b} queue soon after the {a} of the second host."
HARD = (
    "Although the {a} of the residual {b} ordering degrades, it is the {c} of concomitant {a} that, in turn, redistributes the {b}"
    " latency, so that neither the {a} nor the {b} explains the measured remainder of the observed contention."
)
TOP = (
    "Notwithstanding the epistemic {a}isation of {b} admissibility, which presupposes quasi-{b} attributability, the inference that"
    " ergodic {c}ability vitiates the presumed {a}, insofar as it obtains, rests on an implicit falsifiability that, being contingent,"
    " the counterfactual evidence does not license, whatever the orthogonal homogenisation thereof."
)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["lane", "queue", "table", "cache", "frame", "kernel", "batch", "stream"]
    out = []
    for i in range(n):
        level = i % 4
        body = " ".join(
            (EASY, MIDDLE, HARD, TOP)[level].format(a=rng.choice(words), b=rng.choice(words), c=rng.choice(words)) for _ in range(8)
        )
        out.append((i, body + "\n```\ncode_x = 1 admissibility\n```\n> Exported by the mirror.", reading.LEVELS[level]))
    return out


def frames(spark, data, labelled):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in data], "doc_id bigint, text string, language string, f string")
    labels = spark.createDataFrame([(i, l) for i, l in labelled], "doc_id bigint, reading_level string")
    return docs, labels


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    data = corpus(240)
    labelled = [(i, l if rng.random() < 0.9 else rng.choice(reading.LEVELS)) for i, _, l in data[:120]]
    labelled += [(3, " Expert "), (3, None), (5, "nonsense"), (None, "basic")]
    docs, labels = frames(spark, data, labelled)
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, labels).collect()}
    right = [got[i] == l for i, _, l in data[120:]]
    assert len(got) == 240 and np.mean(right) > 0.95


def test_what_is_left_out_of_the_prose():
    text = "# Head line\nOne short sentence. Another one here!\n```\nx = run(1)\n```\n> Footer text.\n| a | b |\ntile_a9 v3_x 12 9\n"
    p = reading.Prose([text, "", "```\nonly_code 1\n```", "只有中文。第二句！"], reading.Tokens(), np.empty(0, np.uint64))
    assert p.words.tolist() == [6, 0, 0, 7] and p.language.tolist() == [0, 0, 0, 2]


def test_known_sentences_are_left_out():
    tokens = reading.Tokens()
    known = reading.Prose(["Another one here!"], tokens, None)
    text = "One short sentence. Another one here! And a third."
    values = np.unique(known.values[known.length > 0])
    assert reading.Prose([text], tokens, values).words.tolist() == [6]
    assert reading.Prose(["Another one here!"], tokens, values).words.tolist() == [3]  # nothing else is left


def test_defined_cases(spark):
    data = [*corpus(16), (90, None, ""), (91, "", ""), (92, " \n ", ""), (93, "``` x = 1 ```", ""), (94, "word " * 300_000, ""), (94, "word", "")]
    docs, labels = frames(spark, data, [(i, l) for i, _, l in data[:8]])
    got = sorted(r["doc_id"] for r in reading.reading_levels(docs, labels).collect())
    assert got == [*range(16), 93, 94, 94]
    assert rows(reading.reading_levels(docs, labels.limit(0))) == []
    assert rows(reading.reading_levels(docs.limit(0), labels)) == []


@pytest.mark.parametrize("levels", [[0, 1, 2, 3], [3, 3, 3, 3]])
def test_fit_orders_the_levels(levels):
    rng = np.random.default_rng(0)
    y = np.array(levels * 50)
    x = y[:, None] + rng.normal(0, 0.3, (200, 1))
    weights, cuts = reading.fit(x, np.zeros(200, int), y)
    assert (np.diff(cuts) > 0).all()
    if len(set(levels)) > 1:
        level = np.searchsorted(cuts, x[:, 0] * weights[0, 0] + weights[0, 1])
        assert (level == y).mean() > 0.85
