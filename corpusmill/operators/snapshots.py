"""What changed between full snapshots of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.clean import clean_digest, clean_id

SCHEMA = "snapshot_id bigint, id string, delta string, changed string"


def _two_pointers(left: list[tuple], right: list[tuple]) -> Iterator[tuple[str, str, str | None]]:
    """Merges two snapshots' rows (key, revision, digest), both sorted by key: (key, delta, changed columns)."""
    i = j = 0
    while i < len(left) or j < len(right):
        if j == len(right) or (i < len(left) and left[i][0] < right[j][0]):
            yield left[i][0], "removed", None
            i += 1
        elif i == len(left) or right[j][0] < left[i][0]:
            yield right[j][0], "added", None
            j += 1
        else:
            (_, rev_a, sha_a), (_, rev_b, sha_b) = left[i], right[j]
            what = ["revision"] * (rev_a != rev_b)
            what += ["content_sha256"] * (sha_a is not None and sha_b is not None and sha_a != sha_b)
            if what:
                yield right[j][0], "changed", ",".join(what)
            i += 1
            j += 1


def _merge(deliveries: list[int]):
    """Streams one key range, sorted by key: rows are buffered up to the last whole key, then merged pair by pair."""

    def changes(rows: list[tuple]) -> pa.RecordBatch:
        by: dict[int, list[tuple]] = {s: [] for s in deliveries}
        for key, snapshot, revision, digest in rows:
            by[snapshot].append((key, revision, digest))
        out = [
            (after, *change)
            for before, after in zip(deliveries, deliveries[1:])
            for change in _two_pointers(by[before], by[after])
        ]
        cols = list(zip(*out)) or [[], [], [], []]
        types = (pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types)], names=["snapshot_id", "id", "delta", "changed"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(4)))
            if not held:
                continue
            last, cut = held[-1][0], len(held)
            while cut and held[cut - 1][0] == last:
                cut -= 1
            if cut:
                yield changes(held[:cut])
                held = held[cut:]
        if held:
            yield changes(held)

    return run


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Typed changes between each delivery and the next lower ``snapshot_id`` present.

    Input: snapshot_id, delivered_at, id, revision, content_sha256; other columns are not read.
    Result: snapshot_id (the later delivery), id, delta (added, removed or changed) and, for
    ``changed``, the names of the columns that differ.

    Repeated rows are reduced map-side to one row a delivery and unit, the one with the latest
    ``delivered_at`` (ties: highest revision, then digest; null counts as lowest), so a unit
    repeated for a third of all rows is one row before any range is cut. The rows then are
    range-partitioned and sorted by id, and each range is a streamed two-pointer merge that holds
    one key's rows over a batch border.

    Null snapshot_id or null id: no unit, ignored. Blank ids are ids. A null revision differs from
    a given one; a null or blank digest differs from none. Empty table: no rows.
    """
    rows = snapshots.select(
        "snapshot_id",
        clean_id("id").alias("id"),
        "delivered_at",
        "revision",
        clean_digest("content_sha256").alias("digest"),
    ).where("snapshot_id is not null and id is not null")
    deliveries = sorted(r[0] for r in rows.select("snapshot_id").distinct().collect())  # one value a delivery
    valid = rows.groupBy("snapshot_id", "id").agg(F.max(F.struct("delivered_at", "revision", "digest")).alias("row"))
    ranges = (
        valid.select("id", "snapshot_id", "row.revision", "row.digest")
        .repartitionByRange("id")
        .sortWithinPartitions("id", "snapshot_id")
    )
    return ranges.mapInArrow(_merge(deliveries), SCHEMA)
