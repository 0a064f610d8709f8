"""Near-duplicate records with small edits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.clean import clean_id
from corpusmill.io import Stages
from corpusmill.llm.words import WordIds, grams, mix, text_value
from corpusmill.operators.hierarchy import connected_components

#: Words of a sequence, the least words of a body, and the least share of common sequences.
GRAM, LEAST_WORDS, SIMILARITY = 5, 20, 0.5
#: Minima of a sketch. The first BANDS * ROWS make the bucket keys: two bodies that share half of their sequences meet
#: with a probability of 1 - (1 - 0.5 ** 3) ** 64 > 0.9998. Each minimum gives one bit of the compared planes.
BITS, BANDS, ROWS = 256, 64, 3
#: Differing bits up to which a pair is verified: at half of the sequences in common 64 differ, sd 7; of unrelated, 128.
RADIUS = 99
#: Members of a bucket that are compared in one block; larger buckets are compared block by block.
BLOCK = 1024
#: Planes added up before blocks that exceed the radius are abandoned.
SLAB = 64
#: Classes to verify up to which their keys are broadcast, not shuffled.
BROADCAST_ROWS = 200_000
#: Copies of a body that meet the other side under one key.
SPREAD = 1024

FEATURES = "id string, revision bigint, class bigint, bands array<bigint>, sketch binary"


_RANDOM = np.random.default_rng(5)
_FACTOR = _RANDOM.integers(0, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SUMMAND = _RANDOM.integers(0, 1 << 32, BITS, dtype=np.uint32)
#: Values of this many sequences stand in one buffer, which fits a core's cache.
_AT_ONCE = 128
_VALUES = np.empty((_AT_ONCE, BITS), np.uint32)


def minima(sequences: np.ndarray) -> np.ndarray:
    """The least value of BITS random functions over the sequences: 32 bits, of the sequences' upper ones."""
    short = (sequences >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), _AT_ONCE):
        part = short[i : i + _AT_ONCE]
        values = _VALUES[: len(part)]
        np.multiply(part, _FACTOR, out=values)
        np.add(values, _SUMMAND, out=values)
        np.minimum(out, values.min(axis=0), out=out)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordIds()
    golden = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        held, classes, least = [], [], []
        for body in batch.column(2).to_pylist():
            ids = words.of(body) if body else ()
            held.append(len(ids) >= LEAST_WORDS)
            if held[-1]:
                classes.append(text_value(ids))
                least.append(minima(grams(ids, GRAM)))
        rows = np.array(least, np.uint64).reshape(-1, BITS)
        key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(rows), 1))
        for r in range(ROWS):
            key = mix(key * golden + rows[:, r * BANDS : (r + 1) * BANDS])
        sketch = np.packbits((mix(rows) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(key.view(np.int64).ravel()))
        held = np.array(held, bool)
        place = pa.array(np.cumsum(held) - 1, mask=~held)  # null for those that are no cases
        columns = (pa.array(classes, pa.int64()), bands, pa.array([x.tobytes() for x in sketch], pa.binary()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(c.take(place) for c in columns)], names=["id", "revision", "class", "bands", "sketch"]
        )


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, body) -> (class, distinct sequences), of rows whose body has that class."""
    words = WordIds()
    for batch in batches:
        classes, lists = [], []
        for c, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = words.of(body) if body else ()
            if len(ids) >= LEAST_WORDS and text_value(ids) == c:
                classes.append(c)
                lists.append(np.unique(grams(ids, GRAM)).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(classes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["class", "sequences"]
        )


def _add(planes: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """Carry-save: by weight, three bit planes become a sum plane and a carry plane of the next weight."""
    weight = 0
    while weight <= max(planes):
        rows = planes[weight]
        x = np.concatenate(rows) if len(rows) > 1 else rows[0]
        while len(x) > 2:
            k = len(x) // 3
            a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            u = a ^ b
            planes.setdefault(weight + 1, []).append((a & b) | (u & c))
            x = np.concatenate([u ^ c, x[3 * k :]])
        planes[weight] = [x]
        weight += 1
    return planes


def _above(planes: dict[int, list[np.ndarray]], radius: int, width: int) -> np.ndarray:
    """Words with a bit for each lane whose count is above the radius."""
    digits, carry = [], np.zeros(width, np.uint64)
    for w in range(max(planes) + 3):
        rows = [*planes[w][0], carry] if w in planes else [carry]
        s, carry = np.zeros(width, np.uint64), np.zeros(width, np.uint64)
        for x in rows:
            carry |= s & x  # two of three at most carry once
            s = s ^ x
        digits.append(s)
    above, equal = np.zeros(width, np.uint64), np.full(width, ~np.uint64(0))
    for w in range(len(digits) - 1, -1, -1):
        if radius >> w & 1:
            equal &= digits[w]
        else:
            above |= equal & digits[w]
            equal &= ~digits[w]
    return above


def _shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """Bit planes whose lane i holds lane i + by."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(planes)
    if words < planes.shape[1]:
        out[:, : planes.shape[1] - words] = planes[:, words:]
    if bits:
        out >>= np.uint64(bits)
        if words + 1 < planes.shape[1]:
            out[:, : planes.shape[1] - words - 1] |= planes[:, words + 1 :] << np.uint64(64 - bits)
    return out


def close_pairs(sketches: np.ndarray, group: np.ndarray, block: np.ndarray, crossed: np.ndarray, radius: int = RADIUS):
    """Pairs (i, j) of rows of one group, i < j, that differ in at most ``radius`` bits; groups stand together.

    The sketches (bytes by row) are turned into vertical bit planes, one bit a row. For each offset all
    rows are compared with those so far behind them at once: XOR of shifted planes, added up by
    carry-save counters slab by slab; words of 64 rows are abandoned once all their rows exceed the
    radius. ``crossed`` groups compare rows of different blocks only.
    """
    n = len(group)
    pad = -n % 64
    bits = np.unpackbits(sketches, axis=1, bitorder="little")
    upright = np.ascontiguousarray(np.packbits(np.pad(bits, ((0, pad), (0, 0))).T, axis=1, bitorder="little"))
    planes = upright.view(np.uint64)
    offset = 0
    while True:
        offset += 1
        same = np.zeros(n + pad, bool)
        if offset < n:
            same[: n - offset] = group[:-offset] == group[offset:]
        if not same.any():
            return
        same[: n - offset] &= ~crossed[:-offset] | (block[:-offset] != block[offset:])
        lanes = np.packbits(same, bitorder="little").view(np.uint64)
        live = np.flatnonzero(lanes)
        differ = planes ^ _shifted(planes, offset)
        counts: dict[int, list[np.ndarray]] = {}
        lanes = lanes[live]
        for slab in range(0, len(planes), SLAB):
            counts.setdefault(0, []).append(differ[slab : slab + SLAB, live])
            counts = _add(counts)
            lanes &= ~_above(counts, radius, len(live))
            keep = np.flatnonzero(lanes)
            if len(keep) < len(live):
                live, lanes = live[keep], lanes[keep]
                counts = {w: [x[:, keep] for x in rows] for w, rows in counts.items()}
            if not len(live):
                break
        for word, mask in zip(live.tolist(), lanes.tolist()):
            while mask:
                bit = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                yield word * 64 + bit, word * 64 + bit + offset


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, low, high, class, block, sketch) sorted by their task (key, low, high) -> close pairs of classes."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(6)))

    def pairs(held: list[list[tuple]]):
        flat = [r for g in held for r in g]
        group = np.repeat(np.arange(len(held)), [len(g) for g in held])
        sketches = np.frombuffer(b"".join(r[5] for r in flat), np.uint8).reshape(len(flat), -1)
        block = np.array([r[4] for r in flat])
        crossed = np.array([r[1] != r[2] for r in flat])
        found = {
            tuple(sorted((flat[i][3], flat[j][3]))) for i, j in close_pairs(sketches, group, block, crossed)
        }
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list[list[tuple]] = []
    size = 0
    for _, members in groupby(rows(), key=lambda r: r[:3]):
        g = list(members)  # two blocks at most
        if held and (size + len(g) > 4096 or len(g) > 128):
            yield pairs(held)
            held, size = [], 0
        held.append(g)
        size += len(g)
        if len(g) > 128:
            yield pairs(held)
            held, size = [], 0
    if held:
        yield pairs(held)


def similar_classes(units: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Valid bodies of at least 20 words, by text: members (id, class) and pairs of classes (a, b, similarity), a < b.

    ``class`` is a 64-bit value of the body's words, so copies share one and are compared once. The
    similarity of two classes is the number of distinct five-word sequences in both divided by those in
    either, and is exact for each pair that comes out; a pair at 0.5 is met with a probability above
    0.9998, closer ones with more. ``similarity`` must be at least 0.5, for which the sketch is laid out.

    Sketches of 256 minima are made in one pass. Classes that share a bucket key are compared by vertical
    bit planes with carry-save counters (see ``close_pairs``), larger buckets in blocks of ``block``
    rows, each pair of blocks being a task of its own; the rest is verified over whole bodies, which are
    read again for the few classes concerned. Nothing is capped.

    Of an id the row with the highest revision is valid (ties: the greater class). Null ids, null bodies
    and short bodies are no cases. Empty table: no rows.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"sketches are laid out for similarities from {SIMILARITY} on")
    spark = units.sparkSession
    stages = Stages(spark, "neardup")
    source = units.select(clean_id("id").alias("id"), F.col("revision").cast("bigint").alias("revision"), "body").where(
        "id is not null"
    )
    row = F.struct("revision", "class", "bands", "sketch")
    valid = source.mapInArrow(_features, FEATURES).groupBy("id").agg(F.max(row).alias("row")).select("id", "row.*")
    kept = stages.keep(valid.where("class is not null"))
    members = kept.select("id", "revision", "class")
    classes = stages.keep(kept.groupBy("class").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))

    keyed = classes.select("class", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # no task sees a whole bucket
    met = keyed.join(sizes, "key").join(classes.select("class", "sketch"), "class")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    tasks = (
        met.select("key", "class", "sketch", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "class", "block", "sketch")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
    )
    close = stages.keep(tasks.mapInArrow(_compare, "a bigint, b bigint").distinct())

    wanted = stages.keep(
        close.select(F.explode(F.array("a", "b")).alias("class"))
        .distinct()
        .join(members.groupBy("class").agg(F.min(F.struct("id", "revision")).alias("r")), "class")
        .select("class", "r.id", "r.revision")
    )
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    bodies = source.join(side, (source["id"] == side["id"]) & source["revision"].eqNullSafe(side["revision"]))
    lists = stages.keep(bodies.select("class", "body").mapInArrow(_sequences, "class bigint, sequences array<bigint>").dropDuplicates(["class"]))
    both = close.join(lists.select(F.col("class").alias("a"), F.col("sequences").alias("sa")), "a").join(
        lists.select(F.col("class").alias("b"), F.col("sequences").alias("sb")), "b"
    )
    common = F.size(F.array_intersect("sa", "sb"))
    share = common / (F.size("sa") + F.size("sb") - common)
    pairs = both.select("a", "b", share.alias("similarity")).where(F.col("similarity") >= similarity)
    return members.select("id", "class"), stages.keep(pairs)


def similar_pairs(units: DataFrame, similarity: float = SIMILARITY, spread: int = SPREAD) -> DataFrame:
    """All pairs of ids (id_a < id_b) of ``similar_classes``, copies expanded: as many rows as there are pairs.

    A class of more than ``spread`` copies is no single key: its rows meet the other side in parts of about that
    many, which the other side's rows are sent to each.
    """
    members, pairs = similar_classes(units, similarity)
    parts = members.groupBy("class").agg(F.ceil(F.count("*") / spread).cast("int").alias("parts"))
    large = members.join(parts.where("parts > 1"), "class", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = large.select(F.col("id").alias("x"), F.col("class").alias("a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts")
    right = members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    copies = left.join(large.select(F.col("id").alias("y"), F.col("class").alias("a"), every), ["a", "part"]).where("x < y").select("x", "y")
    sent = pairs.join(parts.withColumnRenamed("class", "a"), "a").select("a", "b", every)
    across = sent.join(right, "b").join(left.drop("parts"), ["a", "part"]).select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_groups(units: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row a unit of ``similar_classes``: id, group (its least class), links (other classes it is similar to)."""
    members, pairs = similar_classes(units, similarity)
    labels = connected_components(pairs.select("a", "b"), Stages(units.sparkSession, "groups"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return (
        members.join(labels.withColumnRenamed("node", "class"), "class", "left")
        .join(ends, "class", "left")
        .select("id", F.coalesce("component", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
    )
