"""Box joins on a grid of several cell sizes.

A box lives in the cells of the size class its longer side calls for, so it takes at most four of them;
a smaller box or a point looks into the classes at or above its own that hold a box of its key. Only ids
and boxes travel through the join, and each pair comes out once.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutledger.session import kept

#: Cell sizes by a factor of four, up to 67 km.
CELL_MM = [16.0 * 4**k for k in range(12)]


def size_class(side: Column) -> Column:
    """Number of the smallest cell size not below ``side`` (the largest class takes the rest)."""
    out = F.lit(len(CELL_MM) - 1)
    for k in range(len(CELL_MM) - 2, -1, -1):
        out = F.when(side <= CELL_MM[k], F.lit(k)).otherwise(out)
    return out


def cell_size(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CELL_MM]), level + 1)


def _span(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def into_cells(df: DataFrame) -> DataFrame:
    """Explode rows with a level and a box into the cells they touch at that level."""
    size = cell_size(F.col("level"))
    return df.withColumn("cx", F.explode(_span(F.col("box.min_x"), F.col("box.max_x"), size))).withColumn(
        "cy", F.explode(_span(F.col("box.min_y"), F.col("box.max_y"), size))
    )


def longest_side(box: Column) -> Column:
    return F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])


def at_levels(df: DataFrame, boxes: DataFrame, keys: list[str], first: Column) -> DataFrame:
    """Rows once per size class that holds a box of their key, from ``first`` on; boxes have a column ``own``."""
    held = boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("own").alias("level")).distinct()
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("level") >= first]
    return df.join(held, on).drop(*[f"_{k}" for k in keys])


def boxes_touch(a: Column, b: Column) -> Column:
    return (
        (a["min_x"] <= b["max_x"])
        & (b["min_x"] <= a["max_x"])
        & (a["min_y"] <= b["max_y"])
        & (b["min_y"] <= a["max_y"])
    )


def touching_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (left_id, right_id) of touching boxes within equal keys; inputs have the keys, id and box.

    Each side is registered at its own level and looks up: a left box finds larger or equal right boxes,
    a right box finds strictly larger left ones. A pair counts only in the cell that holds the corner
    of its shared area, so it appears once.
    """
    cols = [*keys, "id", "box"]
    a = left.select(cols).withColumn("own", size_class(longest_side(F.col("box"))))
    b = right.select(cols).withColumn("own", size_class(longest_side(F.col("box"))))

    def at_own(df: DataFrame) -> DataFrame:
        return into_cells(df.withColumn("level", F.col("own")))

    def at_upper(df: DataFrame, other: DataFrame, first: Column) -> DataFrame:
        return into_cells(at_levels(df, other, keys, first))

    def meet(small: DataFrame, large: DataFrame) -> DataFrame:
        on = [*keys, "level", "cx", "cy"]
        s = small.withColumnsRenamed({"id": "s_id", "box": "s_box"}).drop("own")
        g = large.withColumnsRenamed({"id": "g_id", "box": "g_box"}).drop("own")
        size = cell_size(F.col("level"))
        corner = (F.floor(F.greatest("s_box.min_x", "g_box.min_x") / size) == F.col("cx")) & (
            F.floor(F.greatest("s_box.min_y", "g_box.min_y") / size) == F.col("cy")
        )
        return s.join(g, on).where(boxes_touch(F.col("s_box"), F.col("g_box")) & corner).select(*keys, "s_id", "g_id")

    up = meet(at_upper(a, b, F.col("own")), at_own(b)).withColumnsRenamed({"s_id": "left_id", "g_id": "right_id"})
    down = meet(at_upper(b, a, F.col("own") + 1), at_own(a)).withColumnsRenamed({"g_id": "left_id", "s_id": "right_id"})
    return up.unionByName(down)


def self_pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unordered pairs of touching boxes of one table as (left_id, right_id) with left_id < right_id."""
    cols = [*keys, "id", "box"]
    a = df.select(cols).withColumn("own", size_class(longest_side(F.col("box"))))
    here = into_cells(a.withColumn("level", F.col("own"))).withColumnsRenamed({"id": "g_id", "box": "g_box"}).drop("own")
    look = into_cells(at_levels(a, a, keys, F.col("own")))
    size = cell_size(F.col("level"))
    corner = (F.floor(F.greatest("box.min_x", "g_box.min_x") / size) == F.col("cx")) & (
        F.floor(F.greatest("box.min_y", "g_box.min_y") / size) == F.col("cy")
    )
    once = (F.col("level") > F.col("own")) | (F.col("id") < F.col("g_id"))
    met = look.join(here, [*keys, "level", "cx", "cy"]).where(
        boxes_touch(F.col("box"), F.col("g_box")) & corner & once
    )
    return met.select(*keys, F.least("id", "g_id").alias("left_id"), F.greatest("id", "g_id").alias("right_id"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (point_id, box_id) of points within boxes; points have the keys, id, x and y."""
    sized = boxes.select(*keys, F.col("id").alias("box_id"), "box").withColumn("own", size_class(longest_side(F.col("box"))))
    here = into_cells(sized.withColumn("level", F.col("own"))).drop("own")
    look = at_levels(points.select(*keys, F.col("id").alias("point_id"), "x", "y"), sized, keys, F.lit(0))
    size = cell_size(F.col("level"))
    look = look.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    inside = F.col("x").between(F.col("box.min_x"), F.col("box.max_x")) & F.col("y").between(
        F.col("box.min_y"), F.col("box.max_y")
    )
    return look.join(here, [*keys, "level", "cx", "cy"]).where(inside).select(*keys, "point_id", "box_id")


#: Rows of a key, on either side, up to which its pairs come from one join on the key.
FEW = 64


def paired(
    left: DataFrame, right: DataFrame, keys: list[str], ids: tuple[str, str], near: Column, search: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """Pairs of rows that pass ``near``, with the columns of both sides, which have only the keys in common.

    Keys with few rows meet in one join on the key: each side is shuffled once and no row looks into cells. For keys with more rows ``search``
    gives the ids of the pairs (a grid join), and their rows are joined back on. Rows are counted by their keys first, so that both sides are worked
    out a second time only if there are such keys.
    """
    sides = [df.select(*keys, F.lit(i).alias("_side")) for i, df in enumerate((left, right))]
    counts = sides[0].unionByName(sides[1]).groupBy(*keys).agg(*[F.count_if(F.col("_side") == i).alias(f"_n{i}") for i in (0, 1)])
    crowded = kept(counts.where((F.col("_n0") > FEW) | (F.col("_n1") > FEW)).select(*keys), "crowded")
    if crowded.isEmpty():
        return left.hint("merge").join(right.hint("merge"), keys).where(near)
    few = left.join(crowded, keys, "left_anti").hint("merge").join(right.hint("merge"), keys).where(near)
    a, b = left.join(crowded, keys, "left_semi"), right.join(crowded, keys, "left_semi")
    many = search(a, b).join(a, [*keys, ids[0]]).join(b, [*keys, ids[1]])
    return few.unionByName(many)


def points_paired(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, point_id, x, y) within boxes (keys, box_id, box), with all columns of both."""
    within = F.col("x").between(F.col("box.min_x"), F.col("box.max_x")) & F.col("y").between(F.col("box.min_y"), F.col("box.max_y"))

    def search(a: DataFrame, b: DataFrame) -> DataFrame:
        return points_in_boxes(a.select(*keys, F.col("point_id").alias("id"), "x", "y"), b.select(*keys, F.col("box_id").alias("id"), "box"), keys)

    return paired(points, boxes, keys, ("point_id", "box_id"), within, search)


def by_crowding(df: DataFrame, keys: list[str], most: int = FEW) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with up to ``most`` rows, and those of the other keys, None without any. The table is read again: it should be a stored one."""
    crowded = kept(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys), "crowded")
    if crowded.isEmpty():
        return df, None
    return df.join(crowded, keys, "left_anti"), df.join(crowded, keys, "left_semi")


#: Cells that the longest box of a key may take along one side.
MOST_CELLS = 1_000


def own_grid(boxes: DataFrame, keys: list[str], coarse: float = 1.0) -> DataFrame:
    """Boxes once per square cell they touch, on a grid per key; adds side, cx and cy.

    The side of a cell is ``coarse`` times the mean width plus height, or the side of the mean area if that is more, so the cells of all boxes
    together are at most some three times their number, however long or thin some are.
    """
    wide, high = F.expr("box.max_x - box.min_x"), F.expr("box.max_y - box.min_y")
    side = F.greatest(F.avg(wide + high), F.sqrt(F.avg(wide * high)), F.max(F.greatest(wide, high)) / MOST_CELLS)
    grid = boxes.groupBy(*keys).agg((F.when(side > 0, side).otherwise(1.0) * coarse).alias("side"))
    placed = boxes.join(grid, keys)
    placed = placed.withColumn("cx", F.explode(_span(F.col("box.min_x"), F.col("box.max_x"), F.col("side"))))
    return placed.withColumn("cy", F.explode(_span(F.col("box.min_y"), F.col("box.max_y"), F.col("side"))))


def sweep(boxes: Iterable[tuple]) -> Iterator[tuple[int, int]]:
    """Links (id, smallest id of its component) that connect touching boxes (id, min_x, min_y, max_x, max_y), which come in order of min_x.

    The line of the sweep is kept as disjoint stretches of y, each with the x up to which some box covers it and the id of one. A box meets
    the stretches it crosses that are not over, takes their place, and leaves longer ones as they are. One link per box less one
    comes out for each component, whatever touches, and all of them lead to one box: chains would take more rounds to join.
    """
    lows: list[float] = []
    line: list[tuple[float, float, float, int]] = []
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while (up := parent.get(k, k)) != k:
            parent[k] = k = parent.get(up, up)
        return k

    for own, x0, y0, x1, y1 in boxes:
        first = max(bisect_right(lows, y0) - 1, 0)
        while first > 0 and line[first - 1][1] >= y0:
            first -= 1
        if first < len(line) and line[first][1] < y0:
            first += 1
        last, made, at = first, [], y0
        before = after = None
        while last < len(line) and line[last][0] <= y1:
            low, high, until, other = line[last]
            last += 1
            if until < x0:
                continue
            a, b = root(own), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
            if low < y0:
                before = (low, y0, until, other)
            if high > y1:
                after = (y1, high, until, other)
            if until > x1:
                low, high = max(low, y0), min(high, y1)
                if low > at:
                    made.append((at, low, x1, own))
                made.append((low, high, until, other))
                at = high
        if at < y1 or not made:
            made.append((at, y1, x1, own))
        new = ([before] if before else []) + made + ([after] if after else [])
        line[first:last] = new
        lows[first:last] = [s[0] for s in new]
    for own in list(parent):
        yield own, root(own)


def streamed(rows: DataFrame, group: list[str], order: list, fold: Callable, schema: str, keep: bool = False) -> DataFrame:
    """Fold each group's rows, in order, into rows of ``schema`` (plain numbers): groups are dealt over the tasks and stream through them.

    ``fold`` takes an iterator of tuples without the group's columns. A group of any size needs no more memory than the fold holds. With ``keep``
    the group's columns come first in the result.
    """
    rows = rows.select(*group, *[c for c in rows.columns if c not in group])
    n, names = len(group), [part.split()[0] for part in schema.split(",")]
    kinds = [pa.float64() if part.split()[1] == "double" else pa.int64() for part in schema.split(",")]
    out = T.StructType.fromDDL(schema)
    if keep:
        carried = rows.select(*group).schema
        names, kinds = group + names, [f.type for f in to_arrow_schema(carried)] + kinds
        out = T.StructType(carried.fields + out.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

        made = []
        for value, some in groupby(flat(), key=lambda row: row[:n]):
            for result in fold(row[n:] for row in some):
                made.append(value + result if keep else result)
                if len(made) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)
                    made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, out)


def touch_links(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) whose components are those of touching boxes (keys, id, box) with equal keys: some links, not all pairs.

    Cells are dealt over the tasks and sorted by x; a cell streams through its sweep, so that crowded cells take time and little memory.
    """
    cell = [*keys, "cx", "cy"]
    corners = [F.col(f"box.{c}").cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    rows = own_grid(boxes.select(*keys, "id", "box"), keys).select(*cell, F.col("id").cast("long").alias("id"), *corners)
    return streamed(rows, cell, ["min_x", "id"], sweep, "a long, b long")


def _fold_cell(rows: Iterator[tuple]) -> Iterator[tuple[int, int, int]]:
    """Fold the boxes (id, min_x, min_y, max_x, max_y, home, side) of a cell, in order of min_x, into (id, root, 1) for those at home in it and
    (id, root, 0) for some that lie in other cells too; side is 0 for boxes that do not."""
    home: list[int] = []
    across: dict[tuple, list[tuple]] = {}

    def boxes() -> Iterator[tuple]:
        for own, x0, y0, x1, y1, here, side in rows:
            box = (own, x0, y0, x1, y1)
            if here:
                home.append(own)
            if side:
                across.setdefault(tuple(math.floor(v / side) for v in box[1:]), []).append(box)
            yield box

    root = dict(sweep(boxes()))
    for own in home:
        yield own, root.get(own, own), 1
    # boxes in the same cells meet in all of these: the smallest of those that touch stands for them in each
    for some in across.values():
        under = dict(sweep(some))
        for own, *_ in some:
            if own not in under and own in root:
                yield own, root[own], 0


#: Side of a cell in widths plus heights of a mean box, where cells are swept: few boxes lie in more than one.
COARSE = 4.0


def touching_groups(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(id, root, home): each box (keys, id, box) once with home = 1 and the smallest id of the boxes that hang together with it within its cell, and
    links id to root with home = 0, so that the components of all links and roots are those of touching boxes with equal keys.

    A link comes out for a cell's border and a group of boxes that cross it together, not for every box.
    """
    cell = [*keys, "cx", "cy"]
    corners = [F.col(f"box.{c}").cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    at = {c: F.floor(F.col(f"box.{c}") / F.col("side")) for c in ("min_x", "min_y", "max_x", "max_y")}
    here = ((at["min_x"] == F.col("cx")) & (at["min_y"] == F.col("cy"))).cast("long").alias("home")
    one = (at["min_x"] == at["max_x"]) & (at["min_y"] == at["max_y"])
    rows = own_grid(boxes.select(*keys, "id", "box"), keys, COARSE).select(
        *cell, F.col("id").cast("long").alias("id"), *corners, here, F.when(one, 0.0).otherwise(F.col("side")).alias("side")
    )
    return streamed(rows, cell, ["min_x", "id"], _fold_cell, "id long, root long, home long")


class _Seats:
    """The boxes of one cell by size, for finding the smallest ones that hold another box."""

    def __init__(self, rows: list[tuple]) -> None:
        self.size = np.array([r[1] for r in rows], np.float64)
        self.id = [r[2] for r in rows]
        self.node = [r[3] for r in rows]
        self.box = np.array([r[4:8] for r in rows], np.float64).reshape(-1, 4)

    def holding(self, after: tuple[float, int], box: tuple[float, ...], most: int) -> list[int]:
        """Places of the first boxes behind ``after`` (size, id) that hold the box; looks at stretches of growing length."""
        low, high = (int(np.searchsorted(self.size, after[0], side)) for side in ("left", "right"))
        at = bisect_right(self.id, after[1], low, high)
        found, step = [], 32
        while at < len(self.size) and len(found) < most:
            b = self.box[at : at + step]
            ok = (b[:, 0] <= box[0]) & (b[:, 1] <= box[1]) & (b[:, 2] >= box[2]) & (b[:, 3] >= box[3])
            found += (at + np.flatnonzero(ok)).tolist()
            at, step = at + step, 2 * step
        return found[:most]


def smallest_holders(inner: DataFrame, outer: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(node, holders): for each inner box the ``most`` smallest outer boxes that hold it, as an array of (size, id, node), smallest first.

    Outer boxes have keys, node, id, size and box; inner ones keys, node, box and the (after_size, after_id) behind which to look. Each size
    class and cell keeps its outer boxes in order of size and answers with its first few, so deep nests do not come out as pairs.
    """
    sized = outer.select(*keys, "node", "id", "size", "box").withColumn("own", size_class(longest_side(F.col("box"))))
    corners = [F.col(f"box.{c}").cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    cell = [*keys, "level", "cx", "cy"]
    here = into_cells(sized.withColumn("level", F.col("own"))).select(
        *cell, F.lit(0).alias("kind"), F.col("size").cast("double").alias("size"), F.col("id").cast("long").alias("id"), "node", *corners
    )
    size = cell_size(F.col("level"))
    look = at_levels(inner, sized, keys, size_class(longest_side(F.col("box"))))
    look = look.withColumns({"cx": F.floor(F.col("box.min_x") / size), "cy": F.floor(F.col("box.min_y") / size)}).select(
        *cell, F.lit(1).alias("kind"), F.col("after_size").cast("double").alias("size"), F.col("after_id").cast("long").alias("id"), "node", *corners
    )

    def find(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, seats = [], None
        for row in rows:
            if row[0] == 0:
                held.append(row)
                continue
            seats = seats or _Seats(held)
            for at in seats.holding((row[1], row[2]), row[4:8], most):
                yield row[3], float(seats.size[at]), seats.id[at], seats.node[at]

    met = streamed(here.unionByName(look), cell, ["kind", "size", "id"], find, "node long, size double, id long, holder long")
    place = F.struct("size", "id", "holder")
    return met.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(place)), 1, most).alias("holders"))
