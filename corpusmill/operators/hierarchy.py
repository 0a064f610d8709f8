"""Parent-child links to full hierarchies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.clean import clean_id
from corpusmill.io import Stages

#: Links of a component that are walked in one task. A greater component is first cut down by pointer doubling.
TASK_LINKS = 200_000
#: The same where every ancestor comes out, of which a chain of n links has n * n / 2.
CLOSURE_LINKS = 5_000

NODE = pa.schema(
    [
        ("id", pa.string()),
        ("cyclic", pa.bool_()),
        ("roots", pa.list_(pa.struct([("root_id", pa.string()), ("depth", pa.int32())]))),
        ("path", pa.list_(pa.string())),
        ("ancestors", pa.list_(pa.struct([("ancestor_id", pa.string()), ("depth", pa.int32())]))),
        ("ring", pa.list_(pa.string())),
    ]
)
NODE_SQL = (
    "id string, cyclic boolean, roots array<struct<root_id: string, depth: int>>, path array<string>, "
    "ancestors array<struct<ancestor_id: string, depth: int>>, ring array<string>"
)
ROOTS = "id string, root_id string, depth int"
Links = dict[str, list[tuple[str, int]]]


def valid_parents(units: DataFrame) -> DataFrame:
    """One row a unit (id, parents): of an id the row with the highest revision, parent ids cleaned and distinct.

    Null ids are ignored; null and blank parent ids are none. Equal revisions: the greater list of parents.
    """
    parents = F.array_sort(F.array_distinct(F.transform("inherits_from", clean_id)))
    return (
        units.select(
            clean_id("id").alias("id"),
            F.struct(
                "revision",
                F.filter(F.coalesce(parents, F.array().cast("array<string>")), lambda x: x != "").alias("parents"),
            ).alias("row"),
        )
        .where("id is not null")
        .groupBy("id")
        .agg(F.max("row").alias("row"))
        .select("id", F.col("row.parents").alias("parents"))
    )


def connected_components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, component) for undirected edges (a, b): alternating large and small stars.

    Each round takes minima by partial aggregation and joins them back, so a node with very many
    neighbours never stands in one row. Rounds grow with the logarithm of the longest path.
    """
    step = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct()
    cur, last = stages.keep(step), None
    while True:
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select("lo", "hi"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
            .select("e.hi", F.col("e.m").alias("lo"))
            .where("hi != lo")
            .distinct()
        )
        cur = stages.keep(small, replaces=cur)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        cur.select("lo", "lo").distinct()
    )


def _walk(ups: Links) -> tuple[dict[str, tuple | None], dict[str, list[str]]]:
    """Depth-first along parent links with an explicit stack: white (no number yet), grey (open) and black (done) nodes.

    A link to a grey node closes a cycle: all open nodes from that one on hang together and come off the stack
    as one group. Groups come off parents first, so that roots are handed down. Gives of each node its roots
    with their depth and the parent on its path (None on or below a cycle), and of nodes on a cycle their
    parents there.
    """
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    grey: list[str] = []
    done: dict[str, tuple | None] = {}
    ring: dict[str, list[str]] = {}
    for start in sorted(ups):
        if start in number:
            continue
        number[start] = low[start] = len(number)
        grey.append(start)
        stack = [(start, iter(ups[start]))]
        while stack:
            node, rest = stack[-1]
            for up, _ in rest:
                if up not in number:
                    number[up] = low[up] = len(number)
                    grey.append(up)
                    stack.append((up, iter(ups.get(up, ()))))
                    break
                if up not in done:
                    low[node] = min(low[node], number[up])
            else:
                stack.pop()
                if stack:
                    below = stack[-1][0]
                    low[below] = min(low[below], low[node])
                if low[node] == number[node]:
                    group = {grey.pop()}
                    while node not in group:
                        group.add(grey.pop())
                    for member in group:
                        inside = [p for p, _ in ups.get(member, ()) if p in group]
                        if inside:
                            ring[member] = inside
                        done[member] = None if inside else _handed_down(member, ups.get(member, ()), done)
    return done, ring


def _handed_down(node: str, ups, done: dict[str, tuple | None]) -> tuple | None:
    """A node's roots, and its parent on the shortest way (ties: the least id), out of what its parents have."""
    if not ups:
        return {node: 0}, None
    roots: dict[str, int] = {}
    near = None
    for parent, steps in ups:
        if done[parent] is None:
            return None
        above = done[parent][0]
        for root, depth in above.items():
            roots[root] = min(depth + steps, roots.get(root, 1 << 60))
        way = (min(above.values()) + steps, parent)
        near = way if near is None else min(near, way)
    return roots, near[1]


def _above(node: str, ups: Links) -> list[tuple[str, int]]:
    """Every node above one without a cycle, with the fewest links to it."""
    met: dict[str, int] = {}
    level, depth = [node], 0
    while level:
        depth += 1
        level = list(dict.fromkeys(p for n in level for p, _ in ups.get(n, ()) if p not in met))
        met.update(dict.fromkeys(level, depth))
    return list(met.items())


def _components(ancestors: bool):
    """Rows (component, id, parents) sorted by component: one whole component after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

        def flush(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out))
            cols[2] = [[{"root_id": r, "depth": d} for r, d in x] for x in cols[2]]
            cols[4] = [x and [{"ancestor_id": a, "depth": d} for a, d in x] for x in cols[4]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, NODE)], schema=NODE)

        out: list[tuple] = []
        size = 0
        for _, members in groupby(rows(), key=lambda r: r[0]):
            ups = {node: [(p["parent"], p["steps"]) for p in parents] for _, node, parents in members}
            done, ring = _walk(ups)
            for node in ups:
                if done[node] is None:
                    out.append((node, True, [("cycle", -1)], None, None, ring.get(node, [])))
                else:
                    roots, at = done[node]
                    path = [node]
                    while at is not None:
                        path.append(at)
                        at = done[at][1]
                    above = _above(node, ups) if ancestors else None
                    out.append((node, False, sorted(roots.items()), path[::-1], above, []))
                    size += len(path) + len(above or ())
                size += 1
                if size >= 20_000:
                    yield flush(out)
                    out, size = [], 0
        if out:
            yield flush(out)

    return run


def _walked(rows: DataFrame, ancestors: bool = False) -> DataFrame:
    """NODE rows of whole components: (component, id, parents array<struct<parent, steps>>), co-located and sorted."""
    placed = rows.select("component", "id", "parents").repartition("component").sortWithinPartitions("component")
    return placed.mapInArrow(_components(ancestors), NODE_SQL)


def _by_size(labelled: DataFrame, task_links: int, stages: Stages) -> tuple[DataFrame, DataFrame | None]:
    """Rows of components that fit a task, and those of the others (None: there are none)."""
    sizes = labelled.groupBy("component").agg(F.sum(F.size("parents")).alias("links"))
    large = stages.keep(sizes.where(F.col("links") > task_links).select("component"))
    if large.isEmpty():
        return labelled, None
    return labelled.join(large, "component", "left_anti"), stages.keep(labelled.join(large, "component", "left_semi"))


def _labelled(nodes: DataFrame, links: DataFrame, stages: Stages) -> DataFrame:
    """component, id, parents of nodes (id, parents) whose links (child, parent) are given."""
    labels = connected_components(links.select(F.col("child").alias("a"), F.col("parent").alias("b")), stages)
    joined = nodes.join(labels.withColumnRenamed("node", "id"), "id", "left")
    return joined.select(F.coalesce("component", "id").alias("component"), "id", "parents")


def _placed(units: DataFrame, task_links: int, stages: Stages) -> tuple[DataFrame, DataFrame | None]:
    """All units by component, parted by size."""
    nodes = stages.keep(valid_parents(units))
    links = nodes.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))
    one = F.transform("parents", lambda p: F.struct(p.alias("parent"), F.lit(1).alias("steps")))
    return _by_size(_labelled(nodes.select("id", one.alias("parents")), links, stages), task_links, stages)


def _links(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("child"), F.inline("parents")).select("child", "parent", "steps")


def _chains(links: DataFrame, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Of each child with one parent the first node above with none or several, by pointer doubling.

    Gives (id, target, depth), and the ids that never come to such a node: they lead into a circle. One row
    a child in every round, and as many rounds as the longest chain has binary digits.
    """
    single = links.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("target")).where("n = 1")
    open_ = stages.keep(single.select(F.col("child").alias("id"), "target", F.lit(1).alias("depth")))
    closed = stages.grow("chains", open_.limit(0))
    for _ in range(open_.count().bit_length() + 1):
        every = closed.unionByName(open_).select(F.col("id").alias("target"), F.col("target").alias("next"), F.col("depth").alias("more"))
        hop = open_.join(every, "target", "left").select(
            "id",
            F.coalesce("next", "target").alias("target"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNull().alias("arrived"),
        )
        moved = stages.keep(hop)
        closed = stages.grow("chains", moved.where("arrived").select("id", "target", "depth"))
        open_ = moved.where("not arrived").select("id", "target", "depth")
        if open_.isEmpty():
            break
    return closed, open_.select("id")


def _by_levels(links: DataFrame, stages: Stages) -> DataFrame:
    """id, root_id, depth of children whose links (child, parent, steps) no task holds: all parents first.

    Each round hands the roots of the units that were resolved last to their children; what never resolves
    is on or below a cycle. As many rounds as the longest way has links.
    """
    level = stages.keep(
        links.select(F.col("parent").alias("id"))
        .distinct()
        .join(links.select(F.col("child").alias("id")).distinct(), "id", "left_anti")
        .select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"))
    )
    found, waiting, held = stages.grow("levels", level.limit(0)), links, None
    while True:
        handed = waiting.join(level.withColumnRenamed("id", "parent"), "parent").select(
            F.col("child").alias("id"), "root_id", (F.col("depth") + F.col("steps")).alias("depth")
        )
        held = handed if held is None else held.unionByName(handed)
        held = stages.keep(held.groupBy("id", "root_id").agg(F.min("depth").alias("depth")))
        waiting = stages.keep(waiting.join(level.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti"))
        blocked = waiting.select(F.col("child").alias("id")).distinct()
        level = stages.keep(held.join(blocked, "id", "left_anti"))
        if level.isEmpty():
            break
        found = stages.grow("levels", level)
        held = held.join(blocked, "id", "left_semi")
    cyclic = waiting.select(F.col("child").alias("id"), F.lit("cycle").alias("root_id"), F.lit(-1).alias("depth"))
    return found.unionByName(cyclic.distinct())


def _large_roots(rows: DataFrame, task_links: int, stages: Stages) -> DataFrame:
    """id, root_id, depth of units in components that no task holds.

    Chains of units with one parent are contracted by pointer doubling. What is left, units with several
    parents and weighted links between them, is a graph of its own: its components are walked where a task
    holds them, else resolved level by level. The chains then take over what stands at their upper ends.
    """
    links = stages.keep(_links(rows))
    chains, circular = (stages.keep(x) for x in _chains(links, stages))
    cycle = [F.lit("cycle").alias("root_id"), F.lit(-1).alias("depth")]
    several = links.join(chains.unionByName(circular.withColumn("target", F.lit("")).withColumn("depth", F.lit(0))).select(F.col("id").alias("child")), "child", "left_anti")
    ends = chains.select(F.col("id").alias("parent"), "target", "depth")
    lost = circular.select(F.col("id").alias("parent"), F.lit(True).alias("lost"))
    inner = stages.keep(
        several.join(ends, "parent", "left")
        .join(lost, "parent", "left")
        .groupBy("child", F.coalesce("target", "parent").alias("parent"))
        .agg(F.min(F.col("steps") + F.coalesce("depth", F.lit(0))).cast("int").alias("steps"), F.coalesce(F.max("lost"), F.lit(False)).alias("lost"))
    )
    # a way that ends in a circle is written as a link to itself: a cycle as well
    weighted = inner.select("child", F.when(F.col("lost"), F.col("child")).otherwise(F.col("parent")).alias("parent"), "steps")
    nodes = weighted.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_list(F.struct("parent", "steps"))).alias("parents"))
    small, large = _by_size(_labelled(nodes, weighted, stages), task_links, stages)
    at = _walked(small).select("id", F.inline("roots"))
    if large is not None:
        at = at.unionByName(_by_levels(stages.keep(_links(large)), stages).join(large.select("id"), "id", "left_semi"))
    at = stages.keep(at)
    upper = at.select(F.col("id").alias("target"), "root_id", F.col("depth").alias("above"))
    taken = chains.join(upper, "target", "left").select(
        "id",
        F.coalesce("root_id", "target").alias("root_id"),
        F.when(F.col("above") < 0, -1).otherwise(F.col("depth") + F.coalesce("above", F.lit(0))).alias("depth"),
    )
    tops = rows.where("size(parents) = 0").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"))
    return taken.unionByName(at).unionByName(tops).unionByName(circular.select("id", *cycle))


def roots(units: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """id, root_id, depth: one row a unit and root it reaches, over units that name parents in ``inherits_from``.

    The depth is the fewest links between them; a root gives itself with 0. A parent without a row is a root
    and gets no row. A unit on or below a cycle has the single root ``cycle`` at depth -1; a self link is a
    cycle. Null ids are ignored, of an id the row with the highest revision counts. Empty table: no rows.

    Components are found by stars, co-located, sorted and walked depth-first with coloured nodes, one after
    another. A component of more than ``task_links`` links is cut down by pointer doubling before (see
    ``_large_roots``); the limit bounds a task's memory and changes no row.
    """
    stages = Stages(units.sparkSession, "roots")
    small, large = _placed(units, task_links, stages)
    found = _walked(small).select("id", F.inline("roots"))
    return found if large is None else found.unionByName(_large_roots(large, task_links, stages))


def closure(units: DataFrame, task_links: int = CLOSURE_LINKS) -> DataFrame:
    """id, ancestor_id, depth: each unit and every unit above it once, with the fewest links between them.

    Read from the ancestor's side these are its descendants. Units on or below a cycle have none; missing
    parents are ancestors. Components up to ``task_links`` links are walked as in ``roots``; in greater ones
    ways are joined to ways, so that each round doubles their length and as many rounds are run as the
    longest one has binary digits.
    """
    stages = Stages(units.sparkSession, "closure")
    small, large = _placed(units, task_links, stages)
    found = _walked(small, ancestors=True).select("id", F.inline("ancestors"))
    if large is None:
        return found
    cyclic = _large_roots(large, TASK_LINKS, stages).where("depth < 0").select("id")
    whole = large.join(cyclic, "id", "left_anti")
    ways = stages.keep(_links(whole).select(F.col("child").alias("id"), F.col("parent").alias("ancestor_id"), F.col("steps").alias("depth")))
    reach, size = 1, None
    while True:
        upper = ways.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("far"), F.col("depth").alias("more"))
        longest = ways.where(F.col("depth") == reach)  # shorter ways were continued before
        on = longest.join(upper, "ancestor_id").select("id", F.col("far").alias("ancestor_id"), (F.col("depth") + F.col("more")).alias("depth"))
        ways = stages.keep(ways.unionByName(on).groupBy("id", "ancestor_id").agg(F.min("depth").alias("depth")), replaces=ways)
        now = ways.count()
        if now == size:
            break
        reach, size = 2 * reach, now
    return found.unionByName(ways)


def paths(units: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """id, root_id, depth, path of each unit: a shortest way from a root, the root first, the unit last.

    Of several nearest parents the least id is taken, from the unit up. Of a unit on or below a cycle
    root_id is ``cycle``, depth -1 and path null. In components beyond a task, parts of paths are joined to
    parts of paths, which doubles their length in each round.
    """
    stages = Stages(units.sparkSession, "paths")
    small, large = _placed(units, task_links, stages)
    near = F.col("roots")[0]  # of a unit without a path the cycle
    known = _walked(small).select("id", F.coalesce(F.col("path")[0], near["root_id"]).alias("root_id"), F.coalesce(F.size("path") - 1, near["depth"]).alias("depth"), "path")
    known = known.withColumn("depth", F.when(F.col("path").isNull(), -1).otherwise(F.col("depth")))
    if large is None:
        return known
    depths = stages.keep(_large_roots(large, task_links, stages).groupBy("id").agg(F.min("depth").alias("depth")))
    above = depths.select(F.col("id").alias("parent"), F.col("depth").alias("d"))
    nearest = F.min(F.struct(F.coalesce("d", F.lit(0)).alias("d"), "parent")).alias("near")
    via = _links(large).join(depths.where("depth > 0").select(F.col("id").alias("child")), "child", "left_semi")
    via = via.join(above, "parent", "left").groupBy(F.col("child").alias("id")).agg(nearest)
    joined = depths.where("depth >= 0").join(via, "id", "left")
    lone = F.col("near.parent")  # a parent without a row has no path of its own to be joined
    start = joined.select("id", lone.alias("top"), F.when(lone.isNull(), F.array("id")).otherwise(F.array(lone, "id")).alias("path"))
    open_ = stages.keep(start)
    whole = stages.grow("paths", open_.limit(0))
    while True:
        every = whole.unionByName(open_).select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("lead"))
        hop = open_.join(every, "top", "left").select(
            "id",
            "next",
            F.when(F.col("lead").isNull(), F.col("path")).otherwise(F.concat("lead", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(1))))).alias("path"),
        )
        moved = stages.keep(hop.withColumnRenamed("next", "top"))
        whole = stages.grow("paths", moved.where("top is null"))
        open_ = moved.where("top is not null")
        if open_.isEmpty():
            break
    found = whole.select("id", F.col("path")[0].alias("root_id"), (F.size("path") - 1).alias("depth"), "path")
    cyclic = depths.where("depth < 0").select("id", F.lit("cycle").alias("root_id"), "depth", F.lit(None).cast("array<string>").alias("path"))
    return known.unionByName(found).unionByName(cyclic)


def back_edges(units: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """id, parent of every link that stands on a cycle: whichever unit a walk begins at, what it finds to go back is among them.

    Without these links no unit is on or below a cycle. In components beyond a task, ways are doubled until
    they are longer than there are units: what they end in is on a cycle or between two. Of that, circles of
    units with one parent are done, and in knots each link's parent must reach its child, by squaring.
    """
    stages = Stages(units.sparkSession, "rings")
    small, large = _placed(units, task_links, stages)
    found = _walked(small).select("id", F.explode("ring").alias("parent"))
    if large is None:
        return found
    cyclic = stages.keep(_large_roots(large, task_links, stages).where("depth < 0").select("id"))
    if cyclic.isEmpty():
        return found
    both = lambda links, ids: links.join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")
    links = stages.keep(both(_links(large).select(F.col("child").alias("id"), "parent"), cyclic))
    ways = links
    for _ in range(cyclic.count().bit_length()):
        ways = stages.keep(
            ways.join(ways.select(F.col("id").alias("parent"), F.col("parent").alias("far")), "parent").select("id", F.col("far").alias("parent")).distinct()
        )
    links = stages.keep(both(links, ways.select(F.col("parent").alias("id")).distinct()))
    labels = stages.keep(connected_components(links.select(F.col("id").alias("a"), F.col("parent").alias("b")), stages).withColumnRenamed("node", "id"))
    # a unit that names itself alone has no component
    placed = links.join(labels, "id", "left").select("id", "parent", F.coalesce("component", "id").alias("component"))
    several = placed.groupBy("component", "id").agg(F.count("*").alias("n")).where("n > 1").select("component").distinct()
    knots = stages.keep(placed.join(several, "component", "left_semi").select("id", "parent"))
    circles = placed.join(several, "component", "left_anti").select("id", "parent")
    reach, size = knots, knots.count()
    while True:
        on = reach.join(reach.select(F.col("id").alias("parent"), F.col("parent").alias("far")), "parent").select("id", F.col("far").alias("parent"))
        reach = stages.keep(reach.unionByName(on).distinct())
        now = reach.count()
        if now == size:
            break
        size = now
    tied = knots.join(reach.select(F.col("id").alias("parent"), F.col("parent").alias("id")), ["id", "parent"], "left_semi")
    return found.unionByName(circles).unionByName(tied.select("id", "parent"))
