"""Reading level of each document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.io import Stages
from corpusmill.llm.words import mix

# The levels in order, and the function words that mark a language, link clauses or subordinate them.
LEVELS = ["basic", "intermediate", "advanced", "expert"]
LANGUAGES = ["en", "de", "zh"]
GERMAN = set("der die das und ist nicht ein eine den dem des mit von auf wenn sich wird wir im zu für auch".split())
ENGLISH = set("the a of and to is in that it for we with on this as by are be our not when if each".split())
CONNECTIVES = set(
    """because although while whereas therefore hence thus since unless insofar inasmuch notwithstanding despite however
    whereby thereby which that whether when once if before after until so and but or
    weil obwohl während sodass daher somit sofern insofern ungeachtet gleichwohl wodurch wonach dass ob wenn sobald falls
    bevor nachdem bis und aber oder deren dessen""".split()
)
HAN_CONNECTIVES = set(
    "因为 所以 虽然 尽管 除非 否则 由于 倘若 倘使 然而 唯当 方可 由是 而言 从而 如果 只有 然后 最后 就 并 则 之 若 故 才 先 再 当".split()
)

#: Buckets of the hashed document frequencies: their size does not grow with the corpus.
BUCKETS = 1 << 18
#: Labelled rows that the model is fitted on at most, chosen by a hash of the document: one half gives the grades of
#: words, the other the regression.
LABELS = 20_000
#: Texts of the mean grade that every word is taken to have been seen in besides.
SMOOTHING = 3.0
RIDGE, SHARED_RIDGE, STEPS = 0.003, 0.002, 1500
#: Sentences of evaluation passages at most: they are broadcast.
KNOWN = 2_000_000
#: Standardised features count up to so many deviations from the mean.
CLIP = 3.0

ASIDE = re.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|(?m:^[ \t]*(?:#{1,6}[ \t\n]|>|\||[-=_*]{3,}[ \t]*$)[^\n]*)")
BULLET = re.compile(r"(?m)^[ \t]*(?:[-*+•]|\d+[.)])[ \t]+")
TOKEN = re.compile(
    r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*(?!\w)|\w+|[.!?](?=\s)|[。！？\n]|[,;:，；、：]"
)
#: Kinds of tokens: words, Han characters, names and numbers, ends of sentences, commas.
PLAIN, CHARACTER, OTHER, END, COMMA = range(5)
NAMES = (
    "length_mean length_median length_high length_low clauses clauses_high connectives diversity rarity rarity_high "
    "word_length long_words rare_share sentence_share rarity_median rarity_low rarity_top "
    "grade grade_median grade_low grade_top"
).split()


class Tokens(dict):
    """Numbers of tokens, with what is known of each: kind, hash, length, and whether it is a function word."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple] = []
        self.done = 0
        self.columns: list[np.ndarray] = []

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first in ".!?。！？\n":
            kind = END
        elif first in ",;:，；、：":
            kind = COMMA
        elif "㐀" <= first <= "鿿":
            kind = CHARACTER
        else:
            kind = PLAIN if first.isalpha() and "_" not in token and not any(c.isdigit() for c in token) else OTHER
        word = token.lower()
        link = word in (HAN_CONNECTIVES if kind == CHARACTER else CONNECTIVES)
        value = xxhash.xxh64_intdigest(word, seed=17)
        self.rows.append((kind, value, len(token), link, word in GERMAN, word in ENGLISH))
        self[token] = n = len(self.rows) - 1
        return n

    def table(self) -> list[np.ndarray]:
        if self.done < len(self.rows):
            types = (np.int8, np.uint64, np.int32, bool, bool, bool)
            new = [np.array(c, t) for c, t in zip(zip(*self.rows[self.done :]), types)]
            self.columns = [np.concatenate(x) for x in zip(self.columns, new)] if self.done else new
            self.done = len(self.rows)
        return self.columns


class Prose:
    """The prose of a batch of texts, as arrays over its sentences and words.

    Left out are fenced code, headings, quotes, tables, sentences that are mostly no words, and those in
    ``known`` (sentences of evaluation passages); of a text of which nothing is left, the latter are
    kept, and else all. ``known`` None: nothing is known and the values of all sentences are at hand.
    """

    def __init__(self, texts: list[str], tokens: Tokens, known: np.ndarray | None):
        if len(tokens) > 1_000_000:
            tokens.__init__()
            tokens.clear()
        lists = [TOKEN.findall(BULLET.sub("", ASIDE.sub("\n", t)) + "\n") for t in texts]
        code = np.fromiter(chain.from_iterable(map(tokens.__getitem__, x) for x in lists), np.int64)
        kind, value, size, link, german, english = (c[code] for c in tokens.table())
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
        end = kind == END
        sentence = np.cumsum(end) - end
        n = int(end.sum())
        self.docs, self.doc_of = len(texts), doc[end]
        word = kind <= CHARACTER
        count = lambda mask: np.bincount(sentence[mask], minlength=n)
        self.length, other, self.commas = count(word), count(kind == OTHER), count(kind == COMMA)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(kind <= OTHER, mix(value), np.uint64(0)))])
        at = np.flatnonzero(end) + 1
        self.values = sums[at] - sums[np.concatenate([[0], at[:-1]])]

        plain = (self.length > 0) & (self.length >= 0.55 * (self.length + other))
        keep = plain if known is None else plain & ~np.isin(self.values, known)
        for fallback in (plain, self.length > 0):
            some = np.zeros(len(texts), bool)
            some[self.doc_of[keep]] = True
            keep = keep | (fallback & ~some[self.doc_of])
        self.keep = keep

        here = word & keep[sentence]
        self.doc, self.sentence = doc[here], sentence[here]
        self.value, self.size, self.link = value[here], size[here], link[here]
        by_doc = lambda mask: np.bincount(self.doc[mask], minlength=len(texts))
        self.words = np.bincount(self.doc, minlength=len(texts))
        han = by_doc(kind[here] == CHARACTER) > 0.3 * self.words
        self.language = np.where(han, 2, by_doc(german[here]) > by_doc(english[here]))

        pair = mix(self.value[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.value[1:])
        pair = np.append(pair, self.value[-1:])
        chinese = self.language[self.doc] == 2
        joined = np.append(self.doc[1:] == self.doc[:-1], [False] * min(1, len(self.doc)))
        self.link = self.link | (chinese & np.isin(pair, HAN_PAIRS))
        self.term = (np.where(chinese & joined, pair, self.value) % np.uint64(BUCKETS)).astype(np.int64)


def _pair_value(two: str) -> np.uint64:
    a, b = (np.array([xxhash.xxh64_intdigest(c, seed=17)], np.uint64) for c in two)
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)[0]


HAN_PAIRS = np.array([_pair_value(w) for w in sorted(HAN_CONNECTIVES) if len(w) == 2], np.uint64)


def _frequencies(known, graded):
    """Of each bucket the documents that hold it, and of the graded ones their number and the sum of their grades."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, docs = Tokens(), 0
        count, number, total = (np.zeros(BUCKETS) for _ in range(3))
        for batch in batches:
            p = Prose(batch.column(1).to_pylist(), tokens, known.value)
            doc, bucket = np.divmod(np.unique(p.doc * BUCKETS + p.term), BUCKETS)
            count += np.bincount(bucket, minlength=BUCKETS)
            grade = np.array([graded.value.get(d, np.nan) for d in batch.column(0).to_pylist()])[doc]
            has = ~np.isnan(grade)
            if has.any():
                number += np.bincount(bucket[has], minlength=BUCKETS)
                total += np.bincount(bucket[has], grade[has], minlength=BUCKETS)
            docs += p.docs
        used = np.flatnonzero(count)
        columns = [np.append(used, -1).astype(np.int32), *(np.append(c[used], x) for c, x in ((count, docs), (number, 0), (total, 0)))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "n", "graded", "total"])

    return run


def features(p: Prose, idf: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """One row a text with the features of NAMES; zeros for a text without words."""
    n = p.docs
    total = np.maximum(p.words, 1)

    def quantile(values: np.ndarray, doc: np.ndarray, *shares: float) -> list[np.ndarray]:
        order = np.lexsort((values, doc))
        size = np.bincount(doc, minlength=n)
        first = np.cumsum(size) - size
        sorted_ = np.append(values[order], 0.0)
        return [np.where(size > 0, sorted_[np.minimum(first + (q * np.maximum(size - 1, 0)).round().astype(int), len(values))], 0.0) for q in shares]

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(p.doc, values, minlength=n) / total

    kept = p.keep & (p.length > 0)
    doc, length = p.doc_of[kept], p.length[kept].astype(float)
    in_doc = np.maximum(np.bincount(doc, minlength=n), 1)
    rare = idf[p.term]
    graded = grade[p.term]
    sentence_mean = lambda x: (np.bincount(p.sentence, x, minlength=len(p.length)) / np.maximum(p.length, 1))[kept]
    types = np.bincount(np.unique(p.doc * BUCKETS + p.term) // BUCKETS, minlength=n)
    low, mid, high = quantile(length, doc, 0.3, 0.5, 0.8)
    commas, commas_high = quantile(p.commas[kept] + 1.0, doc, 0.5, 0.8)
    rare_low, rare_mid, rare_top = quantile(sentence_mean(rare), doc, 0.3, 0.5, 0.7)
    grade_low, grade_mid, grade_top = quantile(sentence_mean(graded), doc, 0.3, 0.5, 0.7)
    (rare_high,) = quantile(rare, p.doc, 0.8)
    long_ = length >= np.where(p.language[doc] == 2, 40, 22)
    log = lambda x: np.log(np.maximum(x, 1.0))
    columns = [
        log(np.bincount(doc, length, minlength=n) / in_doc),
        log(mid),
        log(high),
        log(low),
        commas,
        commas_high,
        mean(p.link.astype(float)),
        log(types) / np.log(total + 1),
        mean(rare),
        rare_high,
        mean(p.size.astype(float)),
        mean((p.size >= 10).astype(float)),
        mean((rare > 2.5).astype(float)),
        np.bincount(doc, long_.astype(float), minlength=n) / in_doc,
        rare_mid,
        rare_low,
        rare_top,
        mean(graded),
        grade_mid,
        grade_low,
        grade_top,
    ]
    return np.where(p.words[:, None] > 0, np.stack(columns, axis=1), 0.0)


def _rows(known, lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            p = Prose(batch.column(1).to_pylist(), tokens, known.value)
            x = features(p, *lexicon.value)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([LANGUAGES[g] for g in p.language.tolist()], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(x.ravel())),
                ],
                names=["doc_id", "language", "f"],
            )

    return run


def fit(x: np.ndarray, lang: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportional-odds regression with ridge: weights by language (a shared part and a deviation), and three cuts.

    x: standardised features, lang and level: numbers. Minimised by gradient steps (Adam).
    """
    k, n = x.shape[1], len(LANGUAGES)
    wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    shared, own = np.zeros(k + 1), np.zeros((n, k + 1))
    cuts = np.array([-1.0, 0.5, np.log(1.5)])  # the first cut, and logarithms of the gaps
    params = np.concatenate([shared, own.ravel(), cuts])
    m, v = np.zeros_like(params), np.zeros_like(params)
    y = (level[:, None] > np.arange(3)[None, :]).astype(float)
    hot = np.eye(n)[lang]
    for step in range(1, STEPS + 1):
        shared, own, cuts = params[: k + 1], params[k + 1 : -3].reshape(n, k + 1), params[-3:]
        gaps = np.exp(np.clip(cuts[1:], -3, 4))
        t = np.array([cuts[0], cuts[0] + gaps[0], cuts[0] + gaps.sum()])
        score = wide @ shared + (wide * (hot @ own)).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - t, -30, 30)))
        err = (p - y) / len(x)
        ds = err.sum(axis=1)
        dt = -err.sum(axis=0)
        grad = np.concatenate(
            [
                wide.T @ ds + SHARED_RIDGE * shared,
                (hot.T @ (wide * ds[:, None]) + RIDGE * own).ravel(),
                [dt.sum(), dt[1:].sum() * gaps[0], dt[2] * gaps[1]],
            ]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    shared, own, cuts = params[: k + 1], params[k + 1 : -3].reshape(n, k + 1), params[-3:]
    gaps = np.exp(np.clip(cuts[1:], -3, 4))
    return shared + own, np.array([cuts[0], cuts[0] + gaps[0], cuts[0] + gaps.sum()])


def _known(passages: DataFrame | None) -> np.ndarray:
    """Values of the passages' sentences, eight bytes each; a held-out set of more than KNOWN sentences is refused."""
    found, total = [np.empty(0, np.uint64)], 0
    if passages is not None:
        tokens = Tokens()
        for row in passages.select("passage").where("passage is not null").distinct().toLocalIterator():
            p = Prose([row[0]], tokens, None)
            found.append(p.values[p.length > 0])
            if (total := total + len(found[-1])) > KNOWN:
                raise ValueError(f"more than {KNOWN} sentences of evaluation passages")
    return np.unique(np.concatenate(found))


def reading_levels(documents: DataFrame, labels: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """A level for every document with text: doc_id, language, score, reading_level.

    Code, logs, headings, quotes (footers) and, if ``passages`` (column passage) are given, sentences of
    evaluation passages are left out of the prose. Word rarity comes from document frequencies over all
    documents, hashed into a fixed number of buckets. Features are standardised by language over all
    documents. At most ``LABELS`` labelled rows, chosen by hash, are used: one half gives each word the
    mean level of the texts that hold it, the other fits an ordinal regression (all give both where one
    half is empty); several annotators of a document count each. Labels are compared without case and outer space; null
    and other labels are ignored.

    Two passes over the texts, no shuffle of texts. Null, empty and blank texts give no row; a text
    without prose is judged by its lines. Without any valid label there is no model: no rows.
    """
    spark = documents.sparkSession
    stages = Stages(spark, "reading")
    some = documents.where("trim(text) rlike r'\\S'").select("doc_id", "text")
    sc = spark.sparkContext
    known_b = sc.broadcast(_known(passages))
    clean = F.lower(F.regexp_replace("reading_level", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    valid = labels.select("doc_id", clean.alias("level")).where(F.col("level").isin(LEVELS) & F.col("doc_id").isNotNull())
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    picked = valid.withColumn("half", half).orderBy(F.xxhash64("doc_id", "level")).limit(LABELS).collect()
    by_doc: dict = {}
    both = {r["half"] for r in picked} == {0, 1}
    for r in picked:
        if r["half"] == 0 or not both:
            by_doc.setdefault(r["doc_id"], []).append(LEVELS.index(r["level"]))
    graded_b = sc.broadcast({d: float(np.mean(x)) for d, x in by_doc.items()})

    counts = (
        some.select("doc_id", "text")
        .mapInArrow(_frequencies(known_b, graded_b), "bucket int, n double, graded double, total double")
        .groupBy("bucket")
        .agg(*[F.sum(c).alias(c) for c in ("n", "graded", "total")])
        .toPandas()  # BUCKETS rows at most
    )
    df, number, total = (np.zeros(BUCKETS) for _ in range(3))
    real = counts[counts.bucket >= 0]
    for c, name in ((df, "n"), (number, "graded"), (total, "total")):
        c[real.bucket.to_numpy()] = real[name].to_numpy()
    docs = float(counts.loc[counts.bucket < 0, "n"].sum())
    middle = float(np.mean(list(graded_b.value.values()))) if by_doc else 0.0
    grade = (total + SMOOTHING * middle) / (number + SMOOTHING)
    lexicon_b = sc.broadcast((np.log((docs + 1) / (df + 1)), grade))

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = stages.keep(some.mapInArrow(_rows(known_b, lexicon_b), f"doc_id {kind}, language string, f array<double>"))
    k = len(NAMES)
    f = [F.col("f")[i] for i in range(k)]
    stats = rows.groupBy("language").agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(f)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(f)]
    )
    mean, std = np.zeros((3, k)), np.ones((3, k))
    for r in stats.collect():  # one row a language
        g = LANGUAGES.index(r["language"])
        mean[g] = [r[f"m{i}"] for i in range(k)]
        std[g] = [r[f"s{i}"] or 1.0 for i in range(k)]

    level_of = spark.createDataFrame([(r["doc_id"], r["level"], int(r["half"])) for r in picked], f"doc_id {kind}, level string, half int")
    sample = rows.join(F.broadcast(level_of), "doc_id").collect()  # LABELS rows at most
    sample = [r for r in sample if r["half"] == 1 or not both]
    if not sample:
        return rows.select("doc_id", "language", F.lit(0.0).alias("score"), F.lit("").alias("reading_level")).limit(0)
    lang = np.array([LANGUAGES.index(r["language"]) for r in sample])
    x = np.array([r["f"] for r in sample])
    weights, cuts = fit(np.clip((x - mean[lang]) / std[lang], -CLIP, CLIP), lang, np.array([LEVELS.index(r["level"]) for r in sample]))

    score: Column = F.lit(None).cast("double")
    for g, name in enumerate(LANGUAGES):
        linear = F.lit(float(weights[g, k]))
        for i in range(k):
            z = (f[i] - float(mean[g, i])) / float(std[g, i])
            linear = linear + F.least(F.lit(CLIP), F.greatest(F.lit(-CLIP), z)) * float(weights[g, i])
        score = F.when(F.col("language") == name, linear).otherwise(score)
    scored = rows.select("doc_id", "language", score.alias("score"))
    level = F.lit(LEVELS[0])
    for name, cut in zip(LEVELS[1:], cuts):
        level = F.when(F.col("score") > float(cut), name).otherwise(level)
    return scored.withColumn("reading_level", level)
