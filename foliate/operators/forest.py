"""Forests: leaves of adaptive trees as DataFrames, and the operators that make new forests of old ones.

Leaves have `tree_id`, `level`, `id` (the element's id among those of its level) and `lo` (id of the first descendant at the forest's greatest
level), and any columns besides. (tree_id, lo) orders them along the curve; leaves of a tree never overlap. All trees of a forest have one
element class. Joins between levels are equi-joins on ancestors: each element is looked for under its ancestor's id at each level that the
forest has, never by ranges.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import elements, morton, shapes
from foliate.functions.eclass import PYRAMID
from foliate.functions.morton import shl, shr
from foliate.operators import topology
from foliate.operators.topology import ancestor, ancestors, first_descendant
from foliate.plans.tables import written

#: Ids made by one row of a generator.
FAN = 12


@dataclass(frozen=True)
class Forest:
    leaves: DataFrame
    eclass: int
    maxlevel: int

    def derived(self, leaves: DataFrame) -> Forest:
        return replace(self, leaves=leaves)

    @property
    def dim(self) -> int:
        return shapes.DIM[self.eclass]

    @property
    def bits(self) -> int:
        return shapes.BITS[self.eclass]

    @property
    def payload(self) -> list[str]:
        return [c for c in self.leaves.columns if c not in ("tree_id", "level", "id", "lo")]


def with_lo(cells: DataFrame, eclass: int, maxlevel: int) -> DataFrame:
    return cells.withColumn("lo", first_descendant(eclass, F.col("id"), F.col("level"), F.lit(maxlevel)))


def stored(forest: Forest, label: str = "forest") -> Forest:
    """The forest with its leaves in the shared folder, so that operators that read them more than once don't make them anew."""
    return forest.derived(written(forest.leaves, label))


def uniform(trees: DataFrame, eclass: int, level: int, maxlevel: int) -> Forest:
    """All elements of a level in every tree. Ids are made in two steps, so no row carries more than 2^12 of them; pyramids are split level by level."""
    if eclass == PYRAMID:
        cells = trees.select("tree_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("id"))
        for _ in range(level):
            cells = children(cells, eclass)
        return Forest(with_lo(cells, eclass, maxlevel), eclass, maxlevel)
    bits = shapes.BITS[eclass] * level
    low = min(bits, FAN)
    ids = trees.select("tree_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << bits - low) - 1).cast("long"))).alias("high"))
    ids = ids.select("tree_id", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << low) - 1).cast("long"))).alias("low"))
    cells = ids.select("tree_id", F.lit(level).alias("level"), (shl(F.col("high"), low) + F.col("low")).alias("id"))
    return Forest(with_lo(cells, eclass, maxlevel), eclass, maxlevel)


def children(cells: DataFrame, eclass: int) -> DataFrame:
    """All children of each cell, with the cell's other columns."""
    if eclass == PYRAMID:
        last = elements.n_children(eclass, elements.place(eclass, F.col("id"), F.col("level"))) - 1
        each = cells.withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    else:
        each = cells.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(len(shapes.children(eclass, 0)))])))
    return each.withColumn("id", shl(F.col("id"), shapes.BITS[eclass]) + F.col("_i")).withColumn("level", F.col("level") + 1).drop("_i")


def parent_id(eclass: int, id: Column) -> Column:
    return shr(id, shapes.BITS[eclass])


def child_number(eclass: int, id: Column) -> Column:
    return id.bitwiseAND(F.lit((1 << shapes.BITS[eclass]) - 1).cast("long"))


def family_size(eclass: int, parent: Column, level: Column) -> Column:
    """Children of the element `parent` of a level."""
    if eclass != PYRAMID:
        return F.lit(len(shapes.children(eclass, 0)))
    return elements.n_children(eclass, elements.place(eclass, parent, level))


def adapt(forest: Forest, refine: Column | None = None, coarsen: Column | None = None, remove: Column | None = None, merged: dict[str, Column] | None = None) -> Forest:
    """One pass of adaption, the same for any partitioning.

    `refine` and `remove` are conditions on a leaf; `coarsen` is an aggregate over the leaves of a complete family. The first
    member decides: if it is to be removed or refined the family stays apart, otherwise the aggregate replaces the family by
    its parent, whatever its other members would do. New children copy their parent's columns; a new parent gets the
    aggregates in `merged`, or null.
    """
    eclass, leaves = forest.eclass, forest.leaves
    no = F.lit(False)
    refine = F.coalesce(refine, no) & (F.col("level") < forest.maxlevel) if refine is not None else no
    remove = F.coalesce(remove, no) if remove is not None else no
    marked = leaves.withColumn("_act", F.when(remove, -2).when(refine, 1).otherwise(0))
    joined = None
    if coarsen is not None:
        family = [F.col("tree_id"), F.col("level"), parent_id(eclass, F.col("id")).alias("parent")]
        aggregates = {c: (merged or {}).get(c, F.first(F.lit(None).cast(leaves.schema[c].dataType))) for c in forest.payload}
        first = F.max(F.when(child_number(eclass, F.col("id")) == 0, F.col("_act")))
        families = marked.where(F.col("level") > 0).groupBy(*family).agg(F.count("*").alias("_n"), first.alias("_first"), coarsen.alias("_yes"), *[a.alias(c) for c, a in aggregates.items()])
        families = families.where((F.col("_n") == family_size(eclass, F.col("parent"), F.col("level") - 1)) & (F.col("_first") == 0) & F.col("_yes"))
        joined = families.select("tree_id", (F.col("level") - 1).alias("level"), F.col("parent").alias("id"), *forest.payload)
        gone = families.select("tree_id", "level", F.col("parent").alias("_parent"))
        marked = marked.withColumn("_parent", parent_id(eclass, F.col("id"))).join(gone, ["tree_id", "level", "_parent"], "left_anti").drop("_parent")
    columns = ["tree_id", "level", "id", *forest.payload]
    out = marked.where("_act = 0").select(*columns).unionByName(children(marked.where("_act = 1").select(*columns), eclass))
    if joined is not None:
        out = out.unionByName(joined)
    return forest.derived(with_lo(out, eclass, forest.maxlevel))


def refine_recursive(forest: Forest, refine: Column) -> Forest:
    """Refine leaves, and their new children in turn, while `refine` holds and the greatest level is not reached. Children copy their parent's columns.

    A round looks only at the children that the last one made, and each is written to the shared folder; the rounds end when there are
    none, at the greatest level at the latest.
    """
    columns = ["tree_id", "level", "id", *forest.payload]
    wanted = F.coalesce(refine, F.lit(False)) & (F.col("level") < forest.maxlevel)
    active, kept = forest.leaves.select(*columns), []
    for _ in range(forest.maxlevel + 1):
        marked = written(active.withColumn("_split", wanted), "refining")
        kept.append(marked.where("not _split").select(*columns))
        split = marked.where("_split")
        if split.isEmpty():
            break
        active = children(split.select(*columns), forest.eclass)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return forest.derived(with_lo(out, forest.eclass, forest.maxlevel))


def coarsen_recursive(forest: Forest, coarsen: Column, merged: dict[str, Column] | None = None) -> Forest:
    """Merge complete families for which the aggregate `coarsen` holds, and the families that form by that, until none is left."""
    now = forest
    for _ in range(forest.maxlevel):
        after = now.derived(written(adapt(now, coarsen=coarsen, merged=merged).leaves, "coarsening"))
        if after.leaves.count() == now.leaves.count():
            return after
        now = after
    return now


def levels_of(forest: Forest) -> list[int]:
    """The levels that leaves have: at most as many numbers as levels."""
    return sorted(r[0] for r in forest.leaves.select("level").distinct().collect())


def search(points: DataFrame, forest: Forest) -> DataFrame:
    """`points(tree_id, id, ...)`, id at the greatest level, with the level and id of the leaf that holds each as `leaf_level` and `leaf_id`; points outside all leaves are left out.

    A point is dealt to its ancestors at the levels that the forest has leaves of, and to no others.
    """
    levels = levels_of(forest)
    if not levels:
        return points.select("*", F.lit(0).alias("leaf_level"), F.lit(0).cast("long").alias("leaf_id")).where(F.lit(False))
    asked = points.withColumn("at_level", F.explode(F.array(*[F.lit(x) for x in levels])))
    asked = asked.withColumn("at_id", ancestor(forest.eclass, F.col("id"), F.lit(forest.maxlevel), F.col("at_level")))
    leaves = forest.leaves.select("tree_id", F.col("level").alias("at_level"), F.col("id").alias("at_id"))
    return asked.join(leaves, ["tree_id", "at_level", "at_id"]).withColumnsRenamed({"at_level": "leaf_level", "at_id": "leaf_id"})


def counted(points: DataFrame, eclass: int, depth: int) -> DataFrame:
    """(tree_id, level, id, n): points of `points(tree_id, id)` in every cell of every level that has any. Points are summed by finest cell before they are dealt to ancestors."""
    finest = points.groupBy("tree_id", "id").agg(F.count("*").alias("n")).withColumn("level", F.lit(depth))
    return ancestors(finest, eclass).groupBy("tree_id", F.col("at_level").alias("level"), F.col("at_id").alias("id")).agg(F.sum("n").alias("n"))


def by_count(points: DataFrame, eclass: int, depth: int, limit: int) -> Forest:
    """The tree whose cells are refined while they hold over `limit` points, to `depth` at most; leaves have their count n, empty ones too."""
    cells = counted(points, eclass, depth)
    split = cells.where((F.col("n") > limit) & (F.col("level") < depth)).select("tree_id", "level", "id")
    below = children(split, eclass)
    roots = cells.where("level = 0").select("tree_id", "level", "id")
    leaves = below.unionByName(roots).join(split, ["tree_id", "level", "id"], "left_anti")
    return Forest(with_lo(leaves.join(cells, ["tree_id", "level", "id"], "left").select("tree_id", "level", "id", F.coalesce("n", F.lit(0)).alias("n")), eclass, depth), eclass, depth)


def face_neighbours(cells: DataFrame, eclass: int, tree_faces: DataFrame | None = None) -> DataFrame:
    return topology.face_neighbours(cells, eclass, tree_faces)


def leaf_neighbours(forest: Forest, tree_faces: DataFrame | None = None) -> DataFrame:
    """(tree_id, level, id, face, n_tree, n_level, n_id, n_face): every pair of leaves that share a part of a face, seen from both sides.

    From each leaf the equal or coarser neighbour is found under the ancestors of the element across the face, at the levels that the
    forest has; a finer neighbour is such a pair seen from the other side. A coarser neighbour's face is found from its own side too.
    """
    eclass, levels = forest.eclass, levels_of(forest)
    own = forest.leaves.select("tree_id", "level", "id")
    if not levels:
        return own.select("*", F.lit(0).alias("face"), F.col("tree_id").alias("n_tree"), F.col("level").alias("n_level"), F.col("id").alias("n_id"), F.lit(0).alias("n_face"))
    across = topology.face_neighbours(own, eclass, tree_faces).where("neigh_id is not null")
    up = across.withColumn("n_level", F.explode(F.array(*[F.lit(x) for x in levels]))).where("n_level <= level")
    up = up.withColumn("n_id", ancestor(eclass, F.col("neigh_id"), F.col("level"), F.col("n_level")))
    there = own.select(F.col("tree_id").alias("neigh_tree"), F.col("level").alias("n_level"), F.col("id").alias("n_id"))
    met = up.join(there, ["neigh_tree", "n_level", "n_id"])
    n_face = topology.ancestor_face(eclass, F.col("neigh_id"), F.col("level"), F.col("n_level"), F.col("dual"))
    met = met.select("tree_id", "level", "id", "face", F.col("neigh_tree").alias("n_tree"), "n_level", "n_id", n_face.cast("int").alias("n_face"))
    names = ["tree_id", "level", "id", "face"]
    others = ["n_tree", "n_level", "n_id", "n_face"]
    # Each row as it is, and with the sides changed where the neighbour is coarser: in one pass over the join.
    own_way = F.struct(*names, *others)
    other_way = F.struct(*[F.col(o).alias(n) for n, o in zip(names, others, strict=True)], *[F.col(n).alias(o) for n, o in zip(names, others, strict=True)])
    return met.select(F.explode(F.when(F.col("n_level") < F.col("level"), F.array(own_way, other_way)).otherwise(F.array(own_way))).alias("p")).select("p.*")


def balance(forest: Forest, tree_faces: DataFrame | None = None) -> Forest:
    """The least refinement in which leaves that share a face differ by one level at most.

    A split cell needs its face neighbours to exist as cells, so their parents are split too. All levels are looked at in a round, and each
    round only at the cells that the last one added; it ends with a round that adds none, after as many as a cell can force others in a
    row, which the number of levels bounds. Payload is inherited from the leaf a new leaf lies in.
    """
    eclass, keys = forest.eclass, ["tree_id", "level", "id"]
    old = written(forest.leaves, "leaves")
    above = ancestors(old.select(*keys), eclass).where("at_level < level")
    done = written(above.select("tree_id", F.col("at_level").alias("level"), F.col("at_id").alias("id")).distinct(), "cells")
    last = done
    for _ in range(forest.maxlevel):
        forced = topology.face_neighbours(last.where("level > 0"), eclass, tree_faces).where("neigh_id is not null")
        forced = forced.select(F.col("neigh_tree").alias("tree_id"), (F.col("level") - 1).alias("level"), parent_id(eclass, F.col("neigh_id")).alias("id")).distinct()
        last = written(forced.join(done, keys, "left_anti"), "forced")
        if last.isEmpty():
            break
        done = done.unionByName(last)
    roots = old.select("tree_id").distinct().select("tree_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("id"))
    leaves = children(done, eclass).unionByName(roots).join(done, keys, "left_anti")
    held = ancestors(leaves, eclass).join(old.select("tree_id", F.col("level").alias("at_level"), F.col("id").alias("at_id"), *forest.payload), ["tree_id", "at_level", "at_id"])
    return forest.derived(written(with_lo(held.select(*keys, *forest.payload), eclass, forest.maxlevel), "balanced"))


def is_balanced(forest: Forest, tree_faces: DataFrame | None = None) -> bool:
    """Whether no leaf has a face neighbour that is two levels finer, or more."""
    return leaf_neighbours(forest, tree_faces).where("n_level > level + 1").isEmpty()


def numbered(forest: Forest, weight: Column | None = None) -> DataFrame:
    """Leaves with `elem_id`, their place along the curve from 0, and with a weight also `running`, its sum up to and including each.

    Leaves are dealt out by ranges of the curve and numbered within each, and the ranges' totals, one row each, are summed up: no task
    sorts more than its share, however refined a corner is. The ranges are written, so that numbers and totals agree.
    """
    rows = forest.leaves if weight is None else forest.leaves.withColumn("_w", weight.cast("long"))
    dealt = rows.repartitionByRange("tree_id", "lo").sortWithinPartitions("tree_id", "lo").withColumn("_m", F.monotonically_increasing_id())
    dealt = written(dealt.withColumns({"_part": shr(F.col("_m"), 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))}).drop("_m"), "numbered")
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), (F.sum("_w") if weight is not None else F.lit(0)).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    out = dealt.join(F.broadcast(starts), "_part").withColumn("elem_id", F.col("_n0") + F.col("_at"))  # a row for each range
    if weight is not None:
        own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("running", F.col("_s0") + F.sum("_w").over(own)).drop("_w")
    return out.drop("_part", "_at", "_n0", "_s0")


def partition(forest: Forest, ranks: int, weight: Column | None = None, offsets: list[int] | None = None, for_coarsening: bool = False) -> DataFrame:
    """Leaves with `elem_id` and `rank`: equal numbers, or equal shares of a non-negative integer weight, of consecutive leaves for each rank.

    With `offsets` each rank begins at the given place. With `for_coarsening` no complete family is split: all of it goes to the rank of its
    first member.
    """
    rows = numbered(forest, weight)
    if offsets is not None:
        if len(offsets) != ranks or offsets[0] != 0 or sorted(offsets) != offsets:
            raise ValueError("offsets have to rise from 0, one for each rank")
        rank = sum((F.when(F.col("elem_id") >= o, 1).otherwise(0) for o in offsets[1:]), F.lit(0))
        rows = rows.withColumn("rank", rank.cast("int"))
    elif weight is None:
        n = rows.agg(F.count("*").alias("_all"))
        rows = rows.crossJoin(F.broadcast(n)).withColumn("rank", F.expr(f"((elem_id + 1) * {ranks} - 1) div _all").cast("int")).drop("_all")  # one row
    else:
        total = rows.agg(F.max("running").alias("_all"))
        place = F.expr(f"case when running = 0 then 0 else (running * {ranks} + _all - 1) div _all - 1 end")
        rows = rows.crossJoin(F.broadcast(total)).withColumn("rank", place.cast("int")).drop("_all")  # one row
    rows = rows.drop("running")
    return _whole_families(forest, rows) if for_coarsening else rows


def _whole_families(forest: Forest, ranked: DataFrame) -> DataFrame:
    eclass, family = forest.eclass, ["tree_id", "level", "_parent"]
    ranked = written(ranked, "ranked").withColumn("_parent", F.when(F.col("level") > 0, parent_id(eclass, F.col("id"))))
    split = ranked.where("_parent is not null").groupBy(*family).agg(F.count("*").alias("_n"), F.min("rank").alias("_to"), F.max("rank").alias("_most")).where("_to < _most")
    split = split.where(F.col("_n") == family_size(eclass, F.col("_parent"), F.col("level") - 1)).select(*family, "_to")
    return ranked.join(split, family, "left").withColumn("rank", F.coalesce("_to", "rank")).drop("_parent", "_to")


def ghosts(forest: Forest, ranked: DataFrame, tree_faces: DataFrame | None = None) -> DataFrame:
    """(rank, tree_id, level, id, owner): for each rank the leaves of others that share a face with its own."""
    pairs = leaf_neighbours(forest, tree_faces)
    mine = ranked.select("tree_id", "level", "id", "rank")
    theirs = ranked.select(F.col("tree_id").alias("n_tree"), F.col("level").alias("n_level"), F.col("id").alias("n_id"), F.col("rank").alias("owner"))
    met = pairs.join(mine, ["tree_id", "level", "id"]).join(theirs, ["n_tree", "n_level", "n_id"]).where("rank <> owner")
    return met.select("rank", F.col("n_tree").alias("tree_id"), F.col("n_level").alias("level"), F.col("n_id").alias("id"), "owner").distinct()


def ghost_data(ghost: DataFrame, leaves: DataFrame, columns: list[str]) -> DataFrame:
    """The ghosts with the owners' values of `columns`."""
    return ghost.join(leaves.select("tree_id", "level", "id", *columns), ["tree_id", "level", "id"])


def offsets(ranked: DataFrame, ranks: int) -> DataFrame:
    """(rank, tree_id, lo, elem_id): where each rank begins, one row for each that has leaves."""
    first = F.min(F.struct("tree_id", "lo", "elem_id")).alias("f")
    return ranked.groupBy("rank").agg(first).select("rank", "f.tree_id", "f.lo", "f.elem_id")


def owners(cells: DataFrame, forest: Forest, begins: DataFrame) -> DataFrame:
    """`cells(tree_id, level, id, ...)` with `first_owner` and `last_owner`: the ranks that own an element's first and last descendant.

    `begins` are the offsets of the ranks: one array of at most as many places as ranks, in which each row looks by halving.
    """
    places = begins.agg(F.sort_array(F.collect_list(F.struct("tree_id", "lo", "rank"))).alias("_places"))
    ranks = begins.count()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(ranks.bit_length(), 1)))])

    def owner(lo: Column) -> Column:
        before = lambda i: (F.get("_places", i)["tree_id"] < F.col("tree_id")) | ((F.get("_places", i)["tree_id"] == F.col("tree_id")) & (F.get("_places", i)["lo"] <= lo))
        n = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("_places")) & before(at + step - 1), at + step).otherwise(at))
        return F.get("_places", F.greatest(n - 1, F.lit(0)))["rank"]

    lo = first_descendant(forest.eclass, F.col("id"), F.col("level"), F.lit(forest.maxlevel))
    hi = topology.last_descendant(forest.eclass, F.col("id"), F.col("level"), F.lit(forest.maxlevel))
    return cells.crossJoin(F.broadcast(places)).withColumns({"first_owner": owner(lo), "last_owner": owner(hi)}).drop("_places")  # one row


def leaves_at_face(forest: Forest, cells: DataFrame) -> DataFrame:
    """(tree_id, level, id, face, leaf_level, leaf_id, leaf_face): the leaves inside elements `cells(tree_id, level, id, face)` that have a face in theirs."""
    eclass = forest.eclass
    keyed = cells.select("tree_id", F.col("level").alias("at_level"), F.col("id").alias("at_id"), "face").distinct()
    held = ancestors(forest.leaves.select("tree_id", "level", "id"), eclass).join(keyed, ["tree_id", "at_level", "at_id"])
    at = elements.place(eclass, F.col("id"), F.col("level"))
    faced = held.withColumn("leaf_face", F.explode(F.sequence(F.lit(0), elements.n_faces(eclass, at) - 1)))
    up = topology.ancestor_face(eclass, F.col("id"), F.col("level"), F.col("at_level"), F.col("leaf_face"))
    return faced.where(up == F.col("face")).select("tree_id", F.col("at_level").alias("level"), F.col("at_id").alias("id"), "face", F.col("level").alias("leaf_level"), F.col("id").alias("leaf_id"), "leaf_face")


def owners_at_face(forest: Forest, ranked: DataFrame, cells: DataFrame) -> DataFrame:
    """(tree_id, level, id, face, owners): the ranks of the leaves at each element's face."""
    met = leaves_at_face(forest, cells)
    by = ranked.select("tree_id", F.col("level").alias("leaf_level"), F.col("id").alias("leaf_id"), "rank")
    return met.join(by, ["tree_id", "leaf_level", "leaf_id"]).groupBy("tree_id", "level", "id", "face").agg(F.sort_array(F.collect_set("rank")).alias("owners"))


def owners_across(forest: Forest, ranked: DataFrame, tree_faces: DataFrame | None = None) -> DataFrame:
    """(tree_id, level, id, face, owners): the ranks of the leaves on the other side of each leaf's face."""
    pairs = leaf_neighbours(forest, tree_faces)
    theirs = ranked.select(F.col("tree_id").alias("n_tree"), F.col("level").alias("n_level"), F.col("id").alias("n_id"), "rank")
    return pairs.join(theirs, ["n_tree", "n_level", "n_id"]).groupBy("tree_id", "level", "id", "face").agg(F.sort_array(F.collect_set("rank")).alias("owners"))


def top_down(forest: Forest, roots: DataFrame, keep) -> DataFrame:
    """Search from the roots down, with pruning: (tree_id, level, id, columns of roots) of the leaves that are reached.

    `roots(tree_id, ...)` are trees, each with one row for each query that is asked of it; `keep(eclass, id, level)` is a condition on an element
    and the row's columns. Only children of kept elements are looked at, and only elements that leaves lie in. Each level is written, so the
    plan stays that of one level; the search ends when nothing is active.
    """
    eclass = forest.eclass
    leaves = written(forest.leaves.select("tree_id", "level", "id"), "search-leaves")
    inner = written(ancestors(leaves, eclass).where("at_level < level").select("tree_id", F.col("at_level").alias("level"), F.col("at_id").alias("id")).distinct(), "search-inner")
    keys, found = ["tree_id", "level", "id"], None
    active = roots.withColumns({"level": F.lit(0), "id": F.lit(0).cast("long")})
    for _ in range(forest.maxlevel + 1):
        active = written(active.where(keep(eclass, F.col("id"), F.col("level"))), "search-active")
        if active.isEmpty():
            break
        hit = active.join(leaves, keys)
        found = hit if found is None else found.unionByName(hit)
        active = children(active.join(inner, keys, "left_semi"), eclass)
    return found if found is not None else active.limit(0)


def replaced(old: Forest, new: Forest) -> DataFrame:
    """Pairs of old and new leaves of which one holds the other: (tree_id, old_level, old_id, new_level, new_id, change), change being 1 for refined, 0 kept, -1 coarsened; any difference of levels."""
    a = old.leaves.select("tree_id", "level", "id")
    b = new.leaves.select("tree_id", "level", "id")
    names = lambda x, y: ["tree_id", F.col("at_level").alias(f"{x}_level"), F.col("at_id").alias(f"{x}_id"), F.col("level").alias(f"{y}_level"), F.col("id").alias(f"{y}_id")]
    key = lambda df: df.select("tree_id", F.col("level").alias("at_level"), F.col("id").alias("at_id"))
    finer = ancestors(b, old.eclass).join(key(a), ["tree_id", "at_level", "at_id"]).select(*names("old", "new"))
    coarser = ancestors(a, old.eclass).where("at_level < level").join(key(b), ["tree_id", "at_level", "at_id"]).select(*names("new", "old"))
    both = finer.unionByName(coarser)
    return both.withColumn("change", F.signum(F.col("new_level") - F.col("old_level")).cast("int"))


def interpolated(old: Forest, new: Forest, value: str) -> DataFrame:
    """Values on the new leaves: copied into children, averaged into parents, by volume in the classes whose children are alike and by number of pyramid leaves' finest parts else."""
    pairs = replaced(old, new)
    values = old.leaves.select("tree_id", F.col("level").alias("old_level"), F.col("id").alias("old_id"), value)
    part = 1.0 / shl(F.lit(1), F.greatest(F.col("old_level") - F.col("new_level"), F.lit(0)) * old.dim)
    if old.eclass == PYRAMID:
        # A tet is half a pyramid of its level.
        half = lambda level, id: F.when(elements.place(PYRAMID, F.col(id), F.col(level))["kind"] < shapes.UP, 0.5).otherwise(1.0)
        part = F.when(F.col("old_level") > F.col("new_level"), part * half("old_level", "old_id") / half("new_level", "new_id")).otherwise(1.0)
    return pairs.join(values, ["tree_id", "old_level", "old_id"]).groupBy("tree_id", F.col("new_level").alias("level"), F.col("new_id").alias("id")).agg(F.sum(F.col(value) * part).alias(value))


def unique_faces(forest: Forest, tree_faces: DataFrame | None = None) -> DataFrame:
    """Each face once: (kind, tree_id, level, id, face), kind being boundary, conformal (kept from the side that comes first) or mortar (from the coarser side)."""
    own = forest.leaves.select("tree_id", "level", "id")
    outer = topology.face_neighbours(own, forest.eclass, tree_faces).where("neigh_id is null").select(F.lit("boundary").alias("kind"), "tree_id", "level", "id", "face")
    pairs = written(leaf_neighbours(forest, tree_faces), "face-pairs")
    first = F.struct("tree_id", "id", "face") < F.struct(F.col("n_tree").alias("tree_id"), F.col("n_id").alias("id"), F.col("n_face").alias("face"))
    equal = pairs.where((F.col("level") == F.col("n_level")) & first).select(F.lit("conformal").alias("kind"), "tree_id", "level", "id", "face")
    mortar = pairs.where("n_level > level").select(F.lit("mortar").alias("kind"), "tree_id", "level", "id", "face").distinct()
    return outer.unionByName(equal).unionByName(mortar)


def same_leaves(a: Forest, b: Forest) -> bool:
    """Whether both have the same leaves in the same trees."""
    keys = ["tree_id", "level", "id"]
    x, y = (f.leaves.select(*keys).withColumn("_side", F.lit(k)) for k, f in enumerate((a, b)))
    odd = x.unionByName(y).groupBy(*keys).agg(F.count_if(F.col("_side") == 0).alias("n0"), F.count_if(F.col("_side") == 1).alias("n1")).where("n0 <> n1")
    return odd.isEmpty()


def overlapping(forest: Forest) -> DataFrame:
    """Leaves that lie in another: none in a sound forest."""
    keyed = forest.leaves.select("tree_id", F.col("level").alias("at_level"), F.col("id").alias("at_id"))
    return ancestors(forest.leaves.select("tree_id", "level", "id"), forest.eclass).where("at_level < level").join(keyed, ["tree_id", "at_level", "at_id"], "left_semi").select("tree_id", "level", "id")


def volumes(leaves: DataFrame, dim: int) -> DataFrame:
    """Leaves of unit trees of lines, quads or hexes with `volume` and the centroid's reference coordinates."""
    size = shl(F.lit(1), F.col("level")).cast("double")
    centre = [((c + 0.5) / size).alias(f"c{a}") for c, a in zip(morton.decode(F.col("id"), dim), "xyz", strict=False)]
    return leaves.select("*", F.pow(1.0 / size, F.lit(dim)).alias("volume"), *centre)


def upwind(forest: Forest, value: str, velocity: tuple[float, ...], dt: float, tree_faces: DataFrame | None = None) -> DataFrame:
    """One explicit upwind step of a constant flow over unit trees of boxes: (tree_id, level, id, value). Nothing flows through boundary faces.

    Leaves may differ in level: over a face that has finer leaves on one side the flux is the sum over its parts, each as large as the finer leaf's face.
    """
    dim = forest.dim
    if forest.eclass not in (1, 2, 4):
        raise ValueError("boxes only: lines, quads and hexes")
    values = forest.leaves.select("tree_id", "level", "id", F.col(value).alias("_here"))
    there = values.select(F.col("tree_id").alias("n_tree"), F.col("level").alias("n_level"), F.col("id").alias("n_id"), F.col("_here").alias("_there"))
    pairs = leaf_neighbours(forest, tree_faces).join(there, ["n_tree", "n_level", "n_id"])
    speed = F.lit(0.0)
    for f in range(2 * dim):
        speed = F.when(F.col("face") == f, F.lit(float(velocity[f // 2]) * (1 if f % 2 else -1))).otherwise(speed)
    area = 1.0 / shl(F.lit(1), F.greatest("level", "n_level") * (dim - 1)).cast("double")
    met = pairs.join(values, ["tree_id", "level", "id"])
    out = F.when(speed > 0, speed * F.col("_here")).otherwise(speed * F.col("_there")) * area
    lost = met.groupBy("tree_id", "level", "id").agg(F.sum(out).alias("_out"))
    volume = 1.0 / shl(F.lit(1), F.col("level") * dim).cast("double")
    return values.join(lost, ["tree_id", "level", "id"], "left").select("tree_id", "level", "id", (F.col("_here") - dt * F.coalesce("_out", F.lit(0.0)) / volume).alias(value))
