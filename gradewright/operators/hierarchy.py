"""Parent-child rows to full hierarchies: path, depth, root, descendants, cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.operators.graph import connected_components
from gradewright.scratch import Scratch

#: Nodes that one task walks; a component above it is not gathered but resolved by path doubling.
MAX_COMPONENT = 200_000
#: Small components are walked together, about so many nodes a task.
NODES_PER_TASK = 4_000

_SCHEMA = "id long, parent long, root long, depth long, path array<long>, node_state string, back_edge boolean"


def _walk(ids: list[int], parents: list[int | None]) -> Iterator[tuple]:
    """Rows of whole components by an iterative depth-first walk with node colouring (white, grey, black).

    A node's path is the walk's own trail when the node is entered, so no more than one path is held.
    """
    parent = dict(zip(ids, parents))
    children: dict[int, list[int]] = {}
    for i, p in parent.items():
        if p is not None:
            children.setdefault(p, []).append(i)
    colour: dict[int, int] = {}
    ring_low: dict[int, int] = {}

    # Upward walk: grey marks the walk in hand; meeting grey again closes a cycle.
    for start in ids:
        trail, i = [], start
        while i is not None and colour.get(i, 0) == 0:
            colour[i] = 1
            trail.append(i)
            i = parent[i]
        if i is not None and colour[i] == 1:
            ring = trail[trail.index(i):]
            ring_low.update(dict.fromkeys(ring, min(ring)))
        for x in trail:
            colour[x] = 2

    # Downward walk from every root and every cycle node; the stack holds what is still to be entered and how deep it lies.
    for top in ids:
        on_ring = top in ring_low
        if parent[top] is not None and not on_ring:
            continue
        root = ring_low[top] if on_ring else top
        trail = [] if on_ring else [top]
        back = on_ring and parent[top] == root  # the link that closes the cycle
        yield top, parent[top], root, -1 if on_ring else 0, list(trail), "cycle" if on_ring else "tree", back
        base = len(trail)
        stack = [(c, base) for c in sorted(children.get(top, ()), reverse=True) if c not in ring_low]
        while stack:
            node, depth = stack.pop()
            del trail[depth:]
            trail.append(node)
            yield node, parent[node], root, -1 if on_ring else depth, list(trail), "below_cycle" if on_ring else "tree", False
            stack += [(c, depth + 1) for c in sorted(children.get(node, ()), reverse=True)]


def _walk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks the keys of a partition, which come one after the other; rows leave in batches of bounded path length."""
    names = ["id", "parent", "root", "depth", "path", "node_state", "back_edge"]
    rows: list[tuple] = []
    held = 0

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["parent"] = out["parent"].astype("Int64")
        return out

    def groups() -> Iterator[tuple[list, list]]:
        key, ids, parents = None, [], []
        for pdf in batches:
            up = pdf["parent"].astype("Int64")
            for k, i, p in zip(pdf["k"].tolist(), pdf["id"].tolist(), up.where(up.notna(), None).astype(object).tolist()):
                if k != key and ids:
                    yield ids, parents
                    ids, parents = [], []
                key = k
                ids.append(i)
                parents.append(None if p is None or p is pd.NA else int(p))
        if ids:
            yield ids, parents

    for ids, parents in groups():
        for row in _walk(ids, parents):
            rows.append(row)
            held += len(row[4]) + 4
            if held > 500_000:
                yield frame()
                rows, held = [], 0
    if rows:
        yield frame()


def _double(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The same result for components too large for one task, by pointer doubling, then path doubling.

    First pass: each node keeps a pointer 2^k steps up and the smallest node passed. Pointers that run out belong
    to trees; after as many steps as there are nodes all others stand on a cycle, and as doubling moves a cycle onto itself,
    the nodes pointed at are exactly the cycle nodes. Second pass: cycle nodes are made roots, and the
    paths of what is left, a forest, are doubled; they are no longer than the result.
    """
    total = nodes.count()
    jump = scratch.write(nodes.select("id", F.col("parent").alias("top"), F.col("id").alias("low")))
    steps = 1
    while steps < 2 * total and not jump.filter("top is not null").isEmpty():
        up = jump.select(F.col("id").alias("top"), F.col("top").alias("t2"), F.col("low").alias("l2"))
        nxt = scratch.write(
            jump.join(up, "top", "left").select("id", F.col("t2").alias("top"), F.least("low", F.coalesce("l2", "low")).alias("low"))
        )
        scratch.drop(jump)
        jump, steps = nxt, steps * 2
    ring = jump.filter("top is not null").select(F.col("top").alias("id")).distinct()
    ring = scratch.write(ring.join(jump.select("id", F.col("low").alias("ring_low")), "id"))

    forest = nodes.join(ring, "id", "left").select(
        "id", "parent", "ring_low", F.when(F.col("ring_low").isNull(), F.col("parent")).alias("top"), F.array("id").alias("path")
    )
    forest = scratch.write(forest)
    while not forest.filter("top is not null").isEmpty():
        up = forest.select(F.col("id").alias("top"), F.col("top").alias("t2"), F.col("path").alias("p2"))
        nxt = scratch.write(
            forest.join(up, "top", "left").select(
                "id", "parent", "ring_low", F.col("t2").alias("top"),
                F.when(F.col("p2").isNotNull(), F.concat("p2", "path")).otherwise(F.col("path")).alias("path"),
            )
        )
        scratch.drop(forest)
        forest = nxt
    head = F.get("path", F.lit(0))
    marked = forest.withColumn("head", head).join(
        ring.select(F.col("id").alias("head"), F.col("ring_low").alias("head_low")), "head", "left"
    )
    on, below = F.col("ring_low").isNotNull(), F.col("head_low").isNotNull()
    return marked.select(
        "id", "parent",
        F.coalesce("ring_low", "head_low", "head").alias("root"),
        F.when(on | below, F.lit(-1)).otherwise(F.size("path") - 1).cast("long").alias("depth"),
        F.when(on, F.array().cast("array<long>")).when(below, F.slice("path", 2, 2147483647)).otherwise(F.col("path")).alias("path"),
        F.when(on, F.lit("cycle")).when(below, F.lit("below_cycle")).otherwise(F.lit("tree")).alias("node_state"),
        (on & (F.col("parent") == F.col("ring_low"))).alias("back_edge"),
    )


def hierarchy(
    nodes: DataFrame, id_col: str = "id", parent_col: str = "parent",
    max_component: int = MAX_COMPONENT, nodes_per_task: int = NODES_PER_TASK,
) -> DataFrame:
    """Every node with (id, parent, root, depth, path, node_state, back_edge).

    Components are found first, then each is brought into one task and walked depth first without recursion,
    colouring nodes; small components share tasks, and rows leave a task as they are found. A component above ``max_component`` nodes is never gathered:
    it is resolved by pointer doubling, with the same result.

    node_state ``tree``: root is the topmost ancestor, depth its distance, path the ids from root to node.
    ``cycle``: the node is on a cycle; root is the smallest id on it, depth -1, path empty. ``below_cycle``:
    ancestors lead into a cycle; root as there, depth -1, path the ids from below the cycle to the node.
    back_edge marks the cycle node whose parent is the smallest of the cycle: the link that closes it.

    Nulls: rows with a null id are left out; a null or unknown parent makes a root. Repeated ids: the row with
    the smallest parent counts. A node that names itself is a cycle of one. An empty table gives no rows.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "hierarchy")
    raw = (
        nodes.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"))
        .filter("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    )
    raw = scratch.write(raw)
    known = raw.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    clean = scratch.write(
        raw.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))
    )
    links = clean.filter("parent is not null")
    comp = connected_components(links, "id", "parent")
    placed = scratch.write(
        clean.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    )
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > max_component).select("component")
    has_large = not large.isEmpty()
    tasks = placed.count() // nodes_per_task + 1
    small = placed.join(large, "component", "left_anti") if has_large else placed
    # A third of the nodes may be one component: components of over half a task's load get a key of their own.
    sized = small.join(sizes, "component")
    key = F.when(F.col("n") > nodes_per_task // 2, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(tasks)))
    # The number of tasks is given, as small rows would be put together into one although their paths are long.
    ordered = sized.select("id", "parent", key.alias("k")).repartition(tasks, "k").sortWithinPartitions("k", "id")
    walked = ordered.mapInPandas(_walk_batches, _SCHEMA)
    if not has_large:
        return walked
    return walked.unionByName(_double(placed.join(large, "component", "left_semi").select("id", "parent"), scratch))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) from hierarchy()'s paths; as many rows as the paths have steps.

    Cycle nodes have no listed descendants; below a cycle only the part outside the cycle counts.
    """
    n = F.size("path")
    return (
        tree.select(F.col("id").alias("descendant_id"), n.alias("n"), F.posexplode("path").alias("pos", "ancestor_id"))
        .filter("ancestor_id <> descendant_id")
        .select("ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("pos")).cast("long").alias("distance"))
    )


def latest_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One whole row a key: the one with the highest values of order; ties fall to the row that sorts last.

    Rows whose key is null are left out.
    """
    cols = df.columns
    ranked = F.struct(*order, *[c for c in cols if c not in order])
    return (
        df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(ranked).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in cols])
    )


def title_form(c):
    """Lower-cased, trimmed, inner blanks reduced to one."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def prerequisite_parents(drafts: DataFrame) -> DataFrame:
    """(id, parent): the first prerequisite, in array order, that is the title of another draft of the course.

    Where several other drafts have the title, the smallest concept_id is the parent. Null, blank or
    unresolved entries are passed over; drafts without a resolved entry keep a null parent.
    """
    base = drafts.select("concept_id", "course_id", title_form("title").alias("form"), "prerequisites")
    titles = base.filter("form is not null").groupBy("course_id", "form").agg(F.min("concept_id").alias("low"))
    # The draft that has the title itself may need the next one.
    second = (
        base.join(titles, ["course_id", "form"]).filter(F.col("concept_id") != F.col("low"))
        .groupBy("course_id", "form").agg(F.min("concept_id").alias("next"))
    )
    titles = titles.join(second, ["course_id", "form"], "left")
    asked = base.select("concept_id", "course_id", F.posexplode("prerequisites").alias("pos", "entry")).select(
        "concept_id", "course_id", "pos", title_form("entry").alias("form")
    )
    found = asked.join(titles, ["course_id", "form"]).select(
        "concept_id", "pos", F.when(F.col("low") != F.col("concept_id"), F.col("low")).otherwise(F.col("next")).alias("parent")
    ).filter("parent is not null")
    first = found.groupBy("concept_id").agg(F.min_by("parent", "pos").alias("parent"))
    return base.select("concept_id").join(first, "concept_id", "left").select(F.col("concept_id").alias("id"), "parent")
