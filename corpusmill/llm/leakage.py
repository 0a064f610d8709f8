"""Evaluation texts that leak into a training corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.io import Stages
from corpusmill.llm.words import HAN, WordIds, grams, mix, text_value

#: Consecutive words that count as a run, of other and of Chinese passages.
RUNS = (16, 32)
#: Words of a window, by the same kinds: three quarters of the shortest part of an item that counts. Windows of a
#: document start every run - window + 1 words, those of a passage at every word: a run holds a whole document window.
WINDOWS = (12, 24)
#: Positions of the embedding that make a key.
SAMPLED = 5
#: Edits, as a share of a window's words, up to which a window counts as found; those for which the repetitions are
#: counted, and the share of windows with so many edits that must be met.
EDITS, AIM, RECALL = 1 / 4, 1 / 6, 0.9
#: Keys of an index that is broadcast (20 bytes each); beyond that, documents and items are joined by key.
BROADCAST_KEYS = 4_000_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)

def most_edits(kind: int) -> int:
    """Edits up to which a window counts as found."""
    return round(EDITS * WINDOWS[kind])


def stride(kind: int) -> int:
    return RUNS[kind] - WINDOWS[kind] + 1


def sample(kind: int, repeat: int) -> np.ndarray:
    """Positions of the embedding of which the key of a repetition is made."""
    return np.sort(np.random.default_rng(1000 * kind + repeat).choice(2 * WINDOWS[kind], SAMPLED, replace=False))


def keys(ids: np.ndarray, starts: np.ndarray, kind: int, repeat: int) -> np.ndarray:
    """One LSH key a window at ``starts``: CGK embedding, of which a sample of positions is taken.

    The embedding is a walk that copies the word it stands on and moves on by a random bit, a function of
    the step and the word that is the same for all windows; past the window's end a filler is copied. Equal
    windows walk alike, and an edit sets two walks apart for some steps only, so that windows at a small
    edit distance differ in few positions and agree in a sample with a fair chance.
    """
    width = WINDOWS[kind]
    picked = sample(kind, repeat)
    seed = np.uint64((2 * repeat + kind + 1) * int(GOLDEN) % (1 << 64))
    coins = mix(ids + seed)
    at = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), seed)
    for step in range(int(picked[-1]) + 1):
        here = starts + np.minimum(at, width - 1)
        inside = at < width
        if step in picked:
            key = mix(key * GOLDEN + np.where(inside, ids[here], np.uint64(step)))
        at += np.where(inside, (coins[here] >> np.uint64(step)) & np.uint64(1), np.uint64(1)).astype(np.int64)
    return key


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact edit distances of the rows of two arrays of windows, all pairs of a row at once."""
    n, width = a.shape
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    last = np.repeat(np.arange(width + 1, dtype=np.int8)[:, None], n, axis=1)
    for i in range(width):
        row = np.minimum(last[:-1] + (a[i] != b), last[1:] + np.int8(1))
        last[0] = i + 1
        for j in range(width):
            last[j + 1] = np.minimum(row[j], last[j] + np.int8(1))
    return last[-1].astype(np.int32)


@lru_cache
def repeats(kind: int) -> int:
    """Repetitions after which a window with a share AIM of edits has been met with the chance RECALL.

    The chance of one repetition is measured on random windows, each edited at random places by
    substitutions, insertions and deletions; what one repetition misses, others miss more often than by
    chance, so that the repetitions are counted on the windows themselves.
    """
    rng = np.random.default_rng(7)
    width, n = WINDOWS[kind], 1500
    plain = rng.integers(0, 1 << 63, (n, 2 * width), dtype=np.uint64)
    edited = []
    for row in plain.tolist():
        for _ in range(round(AIM * width)):
            i, how = int(rng.integers(width)), int(rng.integers(3))
            row[i : i + (how != 1)] = [] if how == 2 else [int(rng.integers(1 << 62))]
        edited.append(row[:width])
    a, b = plain[:, :width].ravel(), np.array(edited, np.uint64).ravel()
    starts = np.arange(n) * width
    met = np.zeros(n, bool)
    for repeat in range(64):
        met |= keys(a, starts, kind, repeat) == keys(b, starts, kind, repeat)
        if met.mean() >= RECALL:
            return repeat + 1
    raise ValueError("the recall is not reached: sample fewer positions")


def _begins(texts: list[np.ndarray], kind: int, step: int) -> np.ndarray:
    """Where windows begin in the texts laid end to end."""
    ends = np.cumsum([len(x) for x in texts])
    parts = [np.arange(e - len(x), e - WINDOWS[kind] + 1, step) for x, e in zip(texts, ends)]
    return np.concatenate([np.empty(0, np.int64), *parts])


def _at(ids: np.ndarray, starts: np.ndarray, kind: int) -> np.ndarray:
    """Windows as rows of 32-bit values of their words."""
    return (ids[starts[:, None] + np.arange(WINDOWS[kind])] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def run_share(here: np.ndarray, sought: np.ndarray, run: int, words: int) -> float:
    """The share of a passage's words that stand in a document in runs: values of all runs of both, the passage's in order."""
    edges = np.zeros(words + 1, np.int64)
    begin = np.flatnonzero(np.isin(sought, here))
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + run, -1)
    return float((np.cumsum(edges[:-1]) > 0).sum() / words)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(case_id, passage) -> (case_id, item, kind, words) of passages that are long enough; item is a value of the words."""
    ids = WordIds()
    for batch in batches:
        rows = []
        for case, passage in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = ids.of(passage)
            kind = int(2 * len(HAN.findall(passage)) > len(words))
            if len(words) >= RUNS[kind]:
                rows.append((case, text_value(words), kind, words.view(np.int64).tolist()))
        cols = list(zip(*rows)) or [[]] * 4
        types = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["case_id", "item", "kind", "words"])


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x, np.int64).view(np.uint64) for x in column.to_pylist()]


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, kind, words) -> (key, kind, item, pos, words of the window): of every window a key a repetition."""
    for batch in batches:
        items, kinds, words = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _words(batch.column(2))
        for kind in (0, 1):
            mine = np.flatnonzero(kinds == kind)
            some = [words[i] for i in mine]
            if some:
                starts = _begins(some, kind, 1)
                size = np.array([len(w) for w in some])
                owner = np.searchsorted(np.cumsum(size), starts, "right")
                pos = (starts - (np.cumsum(size) - size)[owner]).astype(np.int32)
                yield from _key_rows(np.concatenate(some), starts, kind, [("item", items[mine][owner]), ("pos", pos)])


def _key_rows(words: np.ndarray, starts: np.ndarray, kind: int, columns: list) -> Iterator[pa.RecordBatch]:
    window = _at(words, starts, kind)
    rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * WINDOWS[kind]), len(starts), [None, pa.py_buffer(window.tobytes())])
    for repeat in range(repeats(kind)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys(words, starts, kind, repeat).view(np.int64)), pa.array(np.full(len(starts), kind, np.int32))]
            + [pa.array(c) for _, c in columns]
            + [rows.cast(pa.binary())],
            names=["key", "kind", *(n for n, _ in columns), "words"],
        )


def _doc_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (key, kind, text, at, words of the window); ``text`` is a value of the words."""
    ids = WordIds()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            words = ids.of(text)
            for kind in (0, 1):
                starts = _begins([words], kind, stride(kind))
                if len(starts) and (kind == 0 or HAN.search(text)):
                    yield from _key_rows(words, starts, kind, [("text", np.full(len(starts), text_value(words))), ("at", starts.astype(np.int32))])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, item, kind, pos, words, sought) -> (text, item, pos, distance) of windows that are close enough."""
    for batch in batches:
        for kind in (0, 1):
            some = batch.filter(pa.array(np.asarray(batch.column(2)) == kind))
            a, b = (np.frombuffer(b"".join(some.column(i).to_pylist()), np.uint32).reshape(-1, WINDOWS[kind]) for i in (4, 5))
            far = distances(a, b)
            keep = pa.array(far <= most_edits(kind))
            picked = [some.column(i).filter(keep) for i in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(far).filter(keep)], names=["text", "item", "pos", "distance"])


def _doc_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (text, run): the values of all runs of a text, each once."""
    ids = WordIds()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            words = ids.of(text)
            values = np.unique(np.concatenate([grams(words, run) for run in RUNS])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), text_value(words))), pa.array(values)], names=["text", "run"])


def _text_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = WordIds()
    for batch in batches:
        values = [text_value(ids.of(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], names=["doc_id", "text", "value"])


@dataclass
class Index:
    """Keys of all items' windows in order, with their places in the items' words, which are laid end to end."""

    some: np.ndarray  # whether any key has these last bits
    key: np.ndarray
    place: np.ndarray
    flat: np.ndarray
    begin: np.ndarray  # of each item the place of its first word
    size: np.ndarray
    kind: np.ndarray
    item: np.ndarray


def _met(x: Index, flat: np.ndarray, starts: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of documents and places of items' windows that share a key in any repetition, each pair once."""
    found = [np.empty(0, np.int64)]
    for repeat in range(repeats(kind)):
        key = keys(flat, starts, kind, repeat)
        hit = np.flatnonzero(x.some[key & np.uint64(len(x.some) - 1)])
        left = np.searchsorted(x.key, key[hit], "left")
        count = np.searchsorted(x.key, key[hit], "right") - left
        at = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found.append(np.repeat(starts[hit], count) * len(x.flat) + x.place[at])
    pairs = np.sort(np.concatenate(found))
    return np.divmod(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]], len(x.flat))


def _search(index, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = index.value
        ids = WordIds()
        sought: dict[int, np.ndarray] = {}  # values of the runs of items met so far
        for batch in batches:
            plain = batch.column(1).to_pylist()
            texts = [ids.of(t) for t in plain]
            rows, here = [], {}
            for kind in (0, 1):
                some = [w if kind == 0 or HAN.search(t) else w[:0] for w, t in zip(texts, plain)]
                flat = np.concatenate([np.empty(0, np.uint64), *some])
                mine, theirs = _met(x, flat, _begins(some, kind, stride(kind)), kind)
                for a, b in zip(*(np.array_split(v, len(mine) // 50_000 + 1) for v in (mine, theirs))):
                    far = distances(_at(flat, a, kind), _at(x.flat, b, kind)) if len(a) else np.empty(0, np.int32)
                    near = far <= most_edits(kind)
                    rows.append((a[near], b[near], far[near]))
                window, place, far = (np.concatenate(c) for c in zip(*rows))
                rows = []
                doc = np.searchsorted(np.cumsum([len(w) for w in some]), window, "right")
                owner = np.searchsorted(x.begin, place, "right") - 1
                order = np.lexsort((place, owner, doc))
                doc, owner, place, far = doc[order], owner[order], place[order], far[order]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]))[: len(doc)])
                if not len(new):
                    continue
                step = np.minimum(np.diff(place, append=0), WINDOWS[kind])
                step[np.append(new[1:], len(doc)) - 1] = WINDOWS[kind]
                covered = np.add.reduceat(step, new) / x.size[owner[new]]
                least = np.minimum.reduceat(far, new)
                # windows cover more than half of the runs that they stand in
                for i in np.flatnonzero(covered >= share / 2).tolist():
                    d, r = int(doc[new[i]]), int(owner[new[i]])
                    if r not in sought:
                        sought[r] = grams(x.flat[x.begin[r] : x.begin[r] + x.size[r]], RUNS[kind])
                    if (d, kind) not in here:
                        here[d, kind] = np.unique(grams(texts[d], RUNS[kind]))
                    part = run_share(here[d, kind], sought[r], RUNS[kind], int(x.size[r]))
                    if max(part, covered[i]) >= share:
                        here.setdefault("found", []).append((d, int(x.item[r]), part, float(covered[i]), int(least[i])))
            cols = list(zip(*here.get("found", ()))) or [[]] * 5
            doc = batch.column(0).take(pa.array(cols[0], pa.int64()))
            types = (pa.int64(), pa.float64(), pa.float64(), pa.int32())
            rest = [pa.array(c, t) for c, t in zip(cols[1:], types)]
            yield pa.RecordBatch.from_arrays([doc, *rest], names=["doc_id", "item", "share", "covered", "distance"])

    return run


def _by_broadcast(documents: DataFrame, entries: DataFrame, share: float) -> DataFrame:
    """One pass over the documents, beside an index whose size was checked; its keys are made by Spark."""
    items = entries.select("item", "kind", "words").toArrow()
    words = _words(items.column("words"))
    size = np.array([len(w) for w in words])
    begin = np.cumsum(size) - size
    first = dict(zip(items.column("item").to_pylist(), begin.tolist()))
    made = entries.mapInArrow(_item_keys, "key bigint, kind int, item bigint, pos int, words binary").select("key", "item", "pos").toArrow()
    key = made.column("key").to_numpy().view(np.uint64)
    place = np.array([first[i] for i in made.column("item").to_pylist()]) + made.column("pos").to_numpy()
    order = np.argsort(key, kind="stable")
    some = np.zeros(1 << min(24, (8 * len(key)).bit_length()), bool)
    some[key & np.uint64(len(some) - 1)] = True
    index = Index(some, key[order], place[order], np.concatenate(words), begin, size, items.column("kind").to_numpy(), items.column("item").to_numpy())
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(index)
    return documents.mapInArrow(_search(sent, share), f"doc_id {kind}, item bigint, share double, covered double, distance int")


def _by_join(documents: DataFrame, entries: DataFrame, share: float, stages: Stages) -> DataFrame:
    """Keys of documents joined to keys of items, however many those are; runs are then joined likewise, of texts met so far."""
    length = entries.select("item", "kind", F.size("words").alias("n"))
    left = documents.mapInArrow(_doc_keys, "key bigint, kind int, text bigint, at int, words binary").distinct()
    right = entries.mapInArrow(_item_keys, "key bigint, kind int, item bigint, pos int, words binary").withColumnRenamed("words", "sought").distinct()
    met = left.join(right, ["key", "kind"]).select("text", "item", "kind", "pos", "words", "sought").distinct()
    near = stages.keep(met.mapInArrow(_close, "text bigint, item bigint, pos int, distance int").groupBy("text", "item", "pos").agg(F.min("distance").alias("distance")))
    size = F.element_at(F.array(*[F.lit(w) for w in WINDOWS]), F.col("kind") + 1)
    cover = near.join(length, "item").select("text", "item", "n", "distance", F.explode(F.sequence("pos", F.col("pos") + size - 1)).alias("word"))
    covered = cover.groupBy("text", "item", "n").agg((F.countDistinct("word") / F.col("n")).alias("covered"), F.min("distance").alias("distance"))
    covered = stages.keep(covered.where(F.col("covered") >= share / 2))
    valued = documents.mapInArrow(_text_values, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text string, value bigint")
    texts = covered.select(F.col("text").alias("value")).distinct()
    held = stages.keep(valued.join(texts, "value", "left_semi").select("doc_id", "text", "value"))
    runs = held.dropDuplicates(["value"]).select("doc_id", "text").mapInArrow(_doc_runs, "text bigint, run bigint")
    sought = entries.mapInArrow(_item_runs, "item bigint, run bigint, pos int")
    size = F.element_at(F.array(*[F.lit(r) for r in RUNS]), F.col("kind") + 1)
    words = (
        runs.join(sought, "run")
        .join(covered.select("text", "item"), ["text", "item"], "left_semi")
        .join(length, "item")
        .select("text", "item", F.explode(F.sequence("pos", F.col("pos") + size - 1)).alias("word"))
    )
    shares = words.groupBy("text", "item").agg(F.countDistinct("word").alias("words"))
    found = covered.join(shares, ["text", "item"], "left").select(
        F.col("text").alias("value"), "item", (F.coalesce("words", F.lit(0)) / F.col("n")).alias("share"), "covered", "distance"
    )
    return held.select("doc_id", "value").join(found, "value").select("doc_id", "item", "share", "covered", "distance")


def _item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, kind, words) -> (item, run, pos)."""
    for batch in batches:
        for item, kind, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _words(batch.column(2))):
            values = grams(words, RUNS[kind]).view(np.int64)
            n = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, item)), pa.array(values), pa.array(np.arange(n, dtype=np.int32))], names=["item", "run", "pos"]
            )


def leaked_passages(documents: DataFrame, items: DataFrame, share: float = 0.5, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Documents that hold passages of items: doc_id, case_id, share, covered, distance.

    ``share`` is the part of the passage's words that stands in the document in runs of 16 or more
    consecutive words of the passage (32 where most of its words are Han characters), whatever stands
    between words; ``covered`` the part in windows of 12 words (24) that stand there with up to a quarter
    of them edited; ``distance`` the least edit distance of such a window. A pair comes out where either part
    reaches ``share``.

    Windows are embedded by a random walk that turns edits into few differing positions, looked up by
    repeated samples of positions (see ``repeats``), and each that meets one of an item is verified by its
    exact edit distance. Equal windows always meet and every run holds one, so that ``share`` misses
    nothing; windows with a sixth of their words edited are met with the chance RECALL, with fewer edits more often.

    Up to ``broadcast_keys`` keys of items are broadcast: one pass over the documents, no shuffle. Beyond
    that keys are joined, with the same rows. Null or empty texts, null ids and passages shorter than a run
    give nothing. Items that share a passage and documents that share a text each count; repeated rows once.
    """
    stages = Stages(documents.sparkSession, "leakage")
    cases = items.where("case_id is not null and passage is not null").select("case_id", "passage").distinct()
    passages = stages.keep(cases.mapInArrow(_items, "case_id string, item bigint, kind int, words array<bigint>"))
    entries = passages.select("item", "kind", "words").dropDuplicates(["item"])
    counts = {r["kind"]: r["n"] for r in entries.groupBy("kind").agg(F.sum(F.size("words")).alias("n")).collect()}  # two rows
    docs = documents.where("doc_id is not null and text != ''").select("doc_id", "text")
    if not counts:
        return docs.selectExpr("doc_id", "'' as case_id", "0d as share", "0d as covered", "0 as distance").limit(0)
    if sum(n * repeats(k) for k, n in counts.items()) <= broadcast_keys:
        found = _by_broadcast(docs, entries, share)
    else:
        found = _by_join(docs, entries, share, stages)
    found = found.where(F.greatest("share", "covered") >= share)
    return found.join(passages.select("item", "case_id"), "item").select("doc_id", "case_id", "share", "covered", "distance").distinct()
