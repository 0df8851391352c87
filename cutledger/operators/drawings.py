"""Drawing operators: contours, holes, decorations, gaps, layer statistics, clusters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.functions import geometry as geo
from cutledger.operators import spatial
from cutledger.operators.scan import top_one
from cutledger.session import cut_lineage, kept

# Entity types that draw contours, and those that only decorate.
CONTOUR_TYPES = ["LWPOLYLINE", "POLYLINE", "CIRCLE", "ELLIPSE", "SPLINE", "ARC"]
DECORATION_TYPES = ["LINE", "TEXT", "MTEXT", "INSERT", "HATCH", "ATTRIB"]
GROUP = ["drawing_id", "layer"]
GAP_TOLERANCE_MM = 1.0
MIN_CLIP_MM = 0.01
CLUSTER_PAD_MM = 15.0


def join_tolerance(tol: float) -> float:
    """Distance within which outlines count as touching."""
    return max(tol * 4.0, 1.0)


def meaningful(polys: DataFrame, tol: float) -> DataFrame:
    """Polygons that are neither tiny nor sliver-thin."""
    return polys.where(
        (geo.polygon_area(F.col("rings")) >= tol * tol) & (geo.compactness(F.col("rings")) >= geo.MIN_COMPACTNESS)
    )


def drop_micro(polys: DataFrame, tol: float, keys: list[str] = GROUP) -> DataFrame:
    """Drop fragments far below their group's largest polygon; a polygon alone in its group stays."""
    sized = polys.withColumn("_area", geo.polygon_area(F.col("rings")))
    facts = sized.groupBy(*keys).agg(F.max("_area").alias("_largest"), F.count("*").alias("_n"))
    floor = F.greatest(F.col("_largest") * 0.015, F.lit((tol * 4.0) ** 2 * 20.0))
    return sized.join(facts, keys).where((F.col("_n") <= 1) | (F.col("_area") >= floor)).select(polys.columns)


def dedup_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """First of the lines with equal points to 3 decimals; lines of fewer than two points are dropped."""
    key = F.transform("points", lambda p: F.transform(p, lambda v: F.round(v, 3)))
    keyed = lines.where(F.size("points") >= 2).withColumn("_key", key)
    return top_one(keyed, [*keys, "_key"], [F.col("id")], lowest=True).select(lines.columns)


def layer_entity_counts(entities: DataFrame) -> DataFrame:
    """Entities per drawing, layer and type."""
    return entities.groupBy(*GROUP, "etype").agg(F.count("*").alias("n"))


def recommend_layers(entities: DataFrame) -> DataFrame:
    """Role per layer: the layer richest in contours is primary, layers of decorations are auxiliary.

    Other layers that could have been primary get no role.
    """
    counts = entities.groupBy(*GROUP).agg(
        F.count_if(F.col("etype").isin(CONTOUR_TYPES)).alias("contours"),
        F.count_if(F.col("etype").isin(DECORATION_TYPES)).alias("decorations"),
    )
    total = F.col("contours") + F.col("decorations")
    candidate = (F.col("contours") > 0) & (F.col("contours") / F.nullif(total, F.lit(0)) >= 0.6)
    facts = counts.where(total > 0).withColumn("_candidate", candidate)
    best = top_one(
        facts.where("_candidate").select("drawing_id", "layer", "contours"),
        ["drawing_id"],
        [(-F.col("contours")).alias("k"), F.col("layer")],
        lowest=True,
    ).select("drawing_id", F.col("layer").alias("_best"))
    role = F.when(F.col("layer") == F.col("_best"), "primary").when(
        ~F.col("_candidate") & (F.col("decorations") > 0), "auxiliary"
    )
    return facts.join(best, "drawing_id", "left").select(*GROUP, "contours", "decorations", role.alias("role"))


def layer_catalog(layers_by_file: DataFrame) -> DataFrame:
    """Union of layer names over a project's files; the first file with a colour gives it."""
    first = F.min_by("color", F.when(F.col("color").isNotNull(), F.col("file_no")))
    return layers_by_file.groupBy("project_id", "layer_name").agg(first.alias("color"))


def layer_names(layers_by_file: DataFrame) -> DataFrame:
    """Distinct layer names of a project."""
    return layers_by_file.select("project_id", "layer_name").distinct()


def _shapes(polys: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct outline with its facts, so that copies are compared once."""
    rings = F.col("rings")
    return (
        polys.groupBy(*keys, "rings")
        .agg(F.min("id").alias("id"))
        .withColumns(
            {
                "box": geo.bbox(rings),
                "area": geo.polygon_area(rings),
                "radius": geo.circle_radius(rings),
                "center": geo.centroid(rings),
            }
        )
    )


def _boxed(df: DataFrame, grow: float = 0.0) -> Column:
    return F.struct(
        (F.col("box.min_x") - grow).alias("min_x"),
        (F.col("box.min_y") - grow).alias("min_y"),
        (F.col("box.max_x") + grow).alias("max_x"),
        (F.col("box.max_y") + grow).alias("max_y"),
    )


def containment_parent(polys: DataFrame, tol: float, keys: list[str] = GROUP) -> DataFrame:
    """Smallest larger polygon that contains each polygon (within tolerance); NULL if none.

    Keys with few polygons compare each with all larger ones of its key in one join. In larger keys distinct outlines are compared, not copies; each
    asks for the few smallest larger ones whose box holds its own, and an outline that fails with all of them asks for twice as many behind them.
    """
    same = polys.schema["id"].dataType
    rows = kept(polys.select(*keys, "id", "rings"), "contours")
    few, many = spatial.by_crowding(rows, keys)
    out = _parents_at_once(few, tol, keys)
    if many is not None:
        out = out.unionByName(_parents_by_asking(many, tol, keys))
    return out.select(*keys, "id", F.col("parent_id").cast(same).alias("parent_id"))


def _facts(rings: Column) -> dict[str, Column]:
    return {"box": geo.bbox(rings), "size": geo.polygon_area(rings), "radius": geo.circle_radius(rings), "center": geo.centroid(rings)}


def _lies_in(tol: float) -> tuple[Column, Column]:
    """Is the polygon i coaxial with the circle o around it, and does its outline lie in o? From columns i_ and o_ of their facts."""
    base = F.lit(join_tolerance(tol))
    round_both = F.col("i_radius").isNotNull() & F.col("o_radius").isNotNull()
    reach = F.when(round_both, F.greatest(base, F.col("o_radius") * 0.02, F.col("i_radius") * 0.02)).otherwise(base)
    off = F.hypot(F.expr("i_center.x - o_center.x"), F.expr("i_center.y - o_center.y"))
    coaxial = (
        round_both
        & (F.col("i_radius") < F.col("o_radius"))
        & (off + F.col("i_radius") <= F.col("o_radius") + reach * 2.0)
    )
    return F.coalesce(coaxial, F.lit(False)), geo.ring_within(geo.outer(F.col("i_rings")), F.col("o_rings"), reach)


def _parents_at_once(polys: DataFrame, tol: float, keys: list[str]) -> DataFrame:
    """Parents by one join on the key."""
    facts = polys.withColumns(_facts(F.col("rings"))).withColumn("node", F.monotonically_increasing_id())
    facts = kept(facts, "contour-facts")
    carried = ["rings", "box", "size", "radius", "center", "id"]
    inner = facts.select(*keys, "node", *[F.col(c).alias(f"i_{c}") for c in carried])
    outer = facts.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in carried])
    holds = F.expr(
        "o_size > i_size and o_box.min_x <= i_box.min_x and o_box.min_y <= i_box.min_y and o_box.max_x >= i_box.max_x and o_box.max_y >= i_box.max_y"
    )
    on = [F.col(k) == F.col(f"o_{k}") for k in keys] + [holds]
    met = inner.hint("merge").join(outer.hint("merge"), on, "left")
    coaxial, inside = _lies_in(tol)
    parent = F.when(F.col("o_id").isNotNull() & (coaxial | inside), F.struct(F.col("o_size"), F.col("o_id")))
    return met.select(*keys, "node", "i_id", parent.alias("h")).groupBy(*keys, "node", "i_id").agg(F.min("h").alias("h")).select(
        *keys, F.col("i_id").alias("id"), F.col("h.o_id").alias("parent_id")
    )


def _parents_by_asking(polys: DataFrame, tol: float, keys: list[str]) -> DataFrame:
    """Parents in keys of any size; a nest of rings is settled by its first answers."""
    shapes = polys.groupBy(*keys, "rings").agg(F.min("id").alias("id")).withColumns(_facts(F.col("rings")))
    shapes = cut_lineage(shapes.withColumn("node", F.monotonically_increasing_id()))
    coaxial, inside = _lies_in(tol)
    side = lambda name: shapes.select(*[F.col(c).alias(f"{name}_{c}") for c in ("node", "rings", "radius", "center")])
    # strictly larger ones: behind every id of the own size
    open_ = shapes.select(*keys, "node", "box", F.col("size").alias("after_size"), F.lit((1 << 63) - 1).alias("after_id"))
    found, most = [], 2
    while True:
        asked = cut_lineage(spatial.smallest_holders(open_, shapes, keys, most))
        if asked.isEmpty():
            break
        pairs = asked.select(F.col("node").alias("i_node"), F.explode("holders").alias("h")).select("i_node", "h", F.col("h.holder").alias("o_node"))
        tested = pairs.join(side("i"), "i_node").join(side("o"), "o_node")
        good = cut_lineage(tested.where(coaxial | inside).groupBy("i_node").agg(F.min("h").alias("h")).select(F.col("i_node").alias("node"), F.col("h.id").alias("parent_id")))
        found.append(good)
        last = F.element_at("holders", most)
        behind = asked.where(F.size("holders") == most).join(good, "node", "left_anti").select("node", last["size"].alias("_s"), last["id"].alias("_i"))
        open_ = cut_lineage(open_.join(behind, "node").select(*keys, "node", "box", F.col("_s").alias("after_size"), F.col("_i").alias("after_id")))
        if open_.isEmpty():
            break
        most *= 2
    parents = shapes.select("node", F.lit(None).cast("long").alias("parent_id")).limit(0)
    for good in found:
        parents = parents.union(good)
    member = polys.join(shapes.select(*keys, "rings", "node"), [*keys, "rings"])
    return member.join(parents, "node", "left").select(*keys, "id", "parent_id")


def _take_largest_first(base: float, every: bool = False) -> Callable:
    """Fold over circles (r, id, node, cx, cy), largest first: one that lies on the axis of an outer circle is taken by the largest
    such, any other becomes outer and comes out without a taker if ``every`` one is asked for. Outer circles are kept by the size and place of
    their reach."""

    def fold(circles: Iterator[tuple]) -> Iterator[tuple[int, int | None]]:
        outers: dict[tuple, list[tuple]] = {}
        levels: set[int] = set()
        for down, own, node, x, y in circles:
            r, best = -down, None
            for level in levels:
                size = 2.0**level
                cx, cy = math.floor(x / size), math.floor(y / size)
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        for o_r, o_id, ox, oy, reach in outers.get((level, cx + i, cy + j), ()):
                            if o_r > r and math.hypot(x - ox, y - oy) <= reach and (best is None or (-o_r, o_id) < best):
                                best = (-o_r, o_id)
            if best is not None:
                yield node, best[1]
                continue
            if every:
                yield node, None
            reach = max(base, r * 0.02)
            level = math.frexp(reach)[1]
            levels.add(level)
            outers.setdefault((level, math.floor(x / 2.0**level), math.floor(y / 2.0**level)), []).append((r, own, x, y, reach))

    return fold


#: Circles of a key that stream through one task as they are.
WHOLE_CIRCLES = 4096
_NUMBERS = ["-cast(r as double) as down", "cast(id as long) as id", "node", "cast(cx as double) as cx", "cast(cy as double) as cy"]


def washers(circles: DataFrame, tol: float, keys: list[str] = GROUP) -> DataFrame:
    """Outer circle each inner circle becomes a hole of; NULL for circles that stay pieces.

    Largest first, a circle not yet taken takes every smaller coaxial one not yet taken. The circles of a key stream once through a task, which holds
    the outer ones. Keys of more than ``WHOLE_CIRCLES`` are first cut into groups of circles whose centres are within reach of each other, directly
    or through others, which stream through their tasks in the same way. Circles with a null number or key stay pieces.
    """
    same = circles.schema["id"].dataType
    rows = kept(circles.select(*keys, "cx", "cy", "r", "id"), "circles")
    full = " and ".join(f"`{c}` is not null" for c in rows.columns)
    few, many = spatial.by_crowding(rows.where(full), keys, WHOLE_CIRCLES)
    whole = few.selectExpr(*keys, *[n.replace("node", "cast(id as long) as node") for n in _NUMBERS])
    out = spatial.streamed(whole, keys, ["down", "id"], _take_largest_first(join_tolerance(tol), True), "id long, outer_id long", keep=True)
    out = out.unionByName(rows.where(f"not ({full})").select(*keys, "id", F.lit(None).cast("long").alias("outer_id")))
    if many is not None:
        out = out.unionByName(_washers_by_axis(many, join_tolerance(tol), keys))
    return out.select(*keys, F.col("id").cast(same).alias("id"), F.col("outer_id").cast(same).alias("outer_id"))


def _washers_by_axis(circles: DataFrame, base: float, keys: list[str]) -> DataFrame:
    """The same for keys of any size: copies are walked once, circles around one axis are a group."""
    shapes = circles.groupBy(*keys, "cx", "cy", "r").agg(F.min("id").alias("id"))
    shapes = cut_lineage(shapes.withColumn("node", F.monotonically_increasing_id()))
    reach = F.greatest(F.lit(base), F.col("r") * 0.02)
    seat = F.struct((F.col("cx") - reach).alias("min_x"), (F.col("cy") - reach).alias("min_y"), (F.col("cx") + reach).alias("max_x"), (F.col("cy") + reach).alias("max_y"))
    seats = shapes.select(*keys, F.col("node").alias("id"), seat.alias("box"))
    groups = connected(seats, spatial.touch_links(seats, keys)).select(F.col("id").alias("node"), F.col("label").alias("axis"))
    rows = shapes.join(groups, "node").selectExpr("axis", *_NUMBERS)
    taken = spatial.streamed(rows, ["axis"], ["down", "id"], _take_largest_first(base), "node long, outer_id long")
    member = circles.join(shapes.drop("id"), [*keys, "cx", "cy", "r"])
    return member.join(taken, "node", "left").select(*keys, "id", "outer_id")


def drop_hole_fillers(polys: DataFrame, tol: float, keys: list[str] = GROUP) -> DataFrame:
    """Drop polygons that merely refill a hole of another: centred in it and no larger than it.

    A round one must match the hole in centre and radius. Keys with few polygons compare them with the holes of their key in one join, which carries
    the rings of holed polygons only; in larger keys distinct outlines meet on a grid.
    """
    near = join_tolerance(tol)
    crowded = kept(polys.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > spatial.FEW).select(*keys), "crowded")
    if crowded.isEmpty():
        return _unfilled_at_once(polys, near, keys)
    few, many = polys.join(crowded, keys, "left_anti"), polys.join(crowded, keys, "left_semi")
    return _unfilled_at_once(few, near, keys).unionByName(_unfilled_by_outline(many, near, keys))


def _slots(shapes: DataFrame, near: float, carried: list) -> DataFrame:
    """The holes of polygons, one row each: their ring, area, centre and padded box."""
    slots = shapes.select(*carried, F.posexplode(geo.holes(F.col("rings"))).alias("no", "ring"))
    slots = slots.withColumn("rings", F.array("ring")).withColumns(
        {"box": geo.bbox(F.col("rings")), "h_area": geo.solid_area(F.col("rings")), "h_center": geo.centroid(F.col("rings"))}
    )
    return slots.withColumn("box", _boxed(slots, near)).drop("rings")


def _fills(near: float) -> Column:
    """Does a polygon (center, area, radius) refill a hole (ring, h_area, h_center)?"""
    x, y = F.col("center.x"), F.col("center.y")
    held = geo.in_ring(F.col("ring"), x, y) | (geo.edge_distance(F.col("ring"), x, y) <= near)
    off = F.hypot(F.expr("center.x - h_center.x"), F.expr("center.y - h_center.y"))
    match = (off <= near * 2) & (F.abs(F.col("radius") - F.sqrt(F.col("h_area") / F.pi())) <= near * 2)
    return (F.col("area") <= F.col("h_area") * 1.05) & (F.col("radius").isNull() | match) & held


def _unfilled_at_once(polys: DataFrame, near: float, keys: list[str]) -> DataFrame:
    """The polygons that fill no hole of another outline, by one join on the key. An outline with holes is told from its copies by its rings."""
    rings = F.col("rings")
    spots = polys.withColumns(
        {"area": geo.polygon_area(rings), "radius": geo.circle_radius(rings), "center": geo.centroid(rings), "own": F.when(F.size(rings) > 1, rings)}
    )
    slots = _slots(polys, near, [*[F.col(k).alias(f"h_{k}") for k in keys], rings.alias("h_rings")])
    within = F.expr("center.x between box.min_x and box.max_x and center.y between box.min_y and box.max_y")
    on = [F.col(k) == F.col(f"h_{k}") for k in keys]
    met = [*on, within, _fills(near), ~F.col("own").eqNullSafe(F.col("h_rings"))]
    return spots.hint("merge").join(slots.hint("merge"), met, "left_anti").select(polys.columns)


def _unfilled_by_outline(polys: DataFrame, near: float, keys: list[str]) -> DataFrame:
    """The same for keys of any size."""
    shapes = kept(_shapes(polys, keys), "outlines")
    slots = _slots(shapes, near, [*keys, F.col("id").alias("owner")]).withColumn("box_id", F.concat_ws(":", "owner", "no"))
    padded = slots.select(*keys, "box_id", "owner", "ring", "h_area", "h_center", "box")
    spots = shapes.select(*keys, F.col("id").alias("point_id"), F.col("center.x").alias("x"), F.col("center.y").alias("y"), "area", "radius", "center")
    full = spatial.points_paired(spots, padded, keys).where("point_id <> owner")
    gone = full.where(_fills(near)).select(*keys, F.col("point_id").alias("id")).distinct()
    gone = shapes.join(gone, [*keys, "id"], "left_semi")
    return polys.join(gone.select(*keys, "rings"), [*keys, "rings"], "left_anti").select(polys.columns)


def attach_points(points: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Piece each decoration point belongs to: the first whose inside or hole holds it.

    Pieces have id, piece_index, rings and box.
    """
    full = spatial.points_paired(
        points.select(*keys, F.col("id").alias("point_id"), "x", "y"),
        pieces.select(*keys, F.col("id").alias("box_id"), "piece_index", "rings", "box"),
        keys,
    )
    x, y, rings = F.col("x"), F.col("y"), F.col("rings")
    inside = geo.contains(rings, x, y) | geo.in_hole(rings, x, y)
    return (
        full.where(inside)
        .groupBy(*keys, "point_id")
        .agg(F.min_by("box_id", F.struct("piece_index", "box_id")).alias("piece_id"))
    )


def attach_lines(lines: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces each decoration segment crosses, with the length inside; or whose hole holds its middle.

    Lines have id, segment ([[x, y], [x, y]]) and box.
    """
    left = lines.select(*keys, F.col("id").alias("line_id"), "segment", F.col("box").alias("line_box"))
    right = pieces.select(*keys, F.col("id").alias("piece_id"), "rings", F.col("box").alias("piece_box"))

    def search(a: DataFrame, b: DataFrame) -> DataFrame:
        boxed = [df.select(*keys, F.col(f"{n}_id").alias("id"), F.col(f"{n}_box").alias("box")) for df, n in ((a, "line"), (b, "piece"))]
        return spatial.touching_pairs(*boxed, keys).withColumnsRenamed({"left_id": "line_id", "right_id": "piece_id"})

    full = spatial.paired(left, right, keys, ("line_id", "piece_id"), spatial.boxes_touch(F.col("line_box"), F.col("piece_box")), search)

    def end(i: int, j: int) -> Column:
        return F.get(F.get("segment", i), j)

    measured = full.where(F.hypot(end(1, 0) - end(0, 0), end(1, 1) - end(0, 1)) >= MIN_CLIP_MM).withColumn(
        "inside_mm", geo.length_inside(F.col("segment"), F.col("rings"))
    )
    middle = geo.in_hole(F.col("rings"), (end(0, 0) + end(1, 0)) / 2, (end(0, 1) + end(1, 1)) / 2)
    how = F.when(F.col("inside_mm") >= MIN_CLIP_MM, "crosses").when(middle, "in_hole")
    return measured.withColumn("how", how).where("how is not null").select(*keys, "line_id", "piece_id", "how", "inside_mm")


def match_gaps(gaps: DataFrame, polylines: DataFrame, tol: float = GAP_TOLERANCE_MM, keys: list[str] = GROUP) -> DataFrame:
    """Open polylines whose ends lie within ``tol`` of a gap's ends, either way round.

    Gaps have id, start, end; polylines id and points. Ends meet in cells of the tolerance's size and
    their neighbours. A pair that fits both ways counts on its first way only, so pairs come out once without being shuffled. Both sides are
    sorted: a small file may hold many outlines, too many for the driver to broadcast.
    """
    first, last = F.get("points", 0), F.element_at("points", -1)
    ways = F.array(
        F.struct(first.alias("a"), last.alias("b"), F.lit(False).alias("back")), F.struct(last.alias("a"), first.alias("b"), F.lit(True).alias("back"))
    )
    ends = polylines.where(F.size("points") >= 2).select(*keys, F.col("id").alias("polyline_id"), F.inline(ways))
    ends = ends.withColumns(
        {"cx": F.floor(F.get("a", 0) / tol), "cy": F.floor(F.get("a", 1) / tol)}
    )
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    wanted = (
        gaps.select(*keys, F.col("id").alias("gap_id"), "start", "end")
        .withColumn("cx", F.explode(F.transform(around, lambda i: F.floor(F.get("start", 0) / tol) + i)))
        .withColumn("cy", F.explode(F.transform(around, lambda i: F.floor(F.get("start", 1) / tol) + i)))
    )

    def near(p: str, q: str) -> Column:
        return (F.abs(F.get(p, 0) - F.get(q, 0)) <= tol) & (F.abs(F.get(p, 1) - F.get(q, 1)) <= tol)

    fits, other = near("a", "start") & near("b", "end"), near("b", "start") & near("a", "end")
    return (
        wanted.hint("merge").join(ends.hint("merge"), [*keys, "cx", "cy"])
        .where(fits & ~(F.col("back") & F.coalesce(other, F.lit(False))))
        .select(*keys, "gap_id", "polyline_id")
    )


def _to_roots(parents: DataFrame) -> DataFrame:
    """Follow (id, parent) to the top, doubling the reach with every step."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("_next"))
        jumped = kept(
            parents.join(up, "parent", "left").select(
                "id", F.coalesce("_next", "parent").alias("parent"), (F.col("_next") < F.col("parent")).alias("_moved")
            ),
            "hooks",
        )
        parents = jumped.select("id", "parent")
        if not jumped.where("_moved").limit(1).count():
            return parents


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest id of each node's component; nodes have id, links a and b.

    Every round hooks each node to its smallest neighbour, follows the hooks to their roots and keeps
    only the links between different roots, so the links shrink at least by half each time. Rounds are
    written to the shared folder: the plan stays short and a lost executor costs one re-read.
    """
    labels = nodes.select("id", F.col("id").alias("label")).distinct()
    left = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_least"))
        roots = _to_roots(hooks.select("id", F.least("id", "_least").alias("parent")))
        far = roots.select(F.col("id").alias("label"), F.col("parent").alias("_root"))
        labels = kept(labels.join(far, "label", "left").select("id", F.coalesce("_root", "label").alias("label")), "labels")
        moved = left.join(roots.select(F.col("id").alias("a"), F.col("parent").alias("_a")), "a").join(
            roots.select(F.col("id").alias("b"), F.col("parent").alias("_b")), "b"
        )
        left = kept(
            moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a < b").distinct(), "links"
        )
    return labels


def cluster(entities: DataFrame, pad_mm: float = CLUSTER_PAD_MM, keys: list[str] | None = None) -> DataFrame:
    """Cluster label (smallest member id) of entity boxes that touch once each is padded on every side.

    Boxes are cut into the square cells of a grid as fine as their drawing allows, and each cell is swept for the groups of boxes that hang together
    in it. What joins the groups of neighbouring cells are the boxes across their border, one for each group of those: these links are joined into
    components, and a box takes the label of its group.
    """
    keys = keys or ["drawing_id"]
    rows = kept(entities, "entities")
    grown = [F.col(c) + (-pad_mm if c.startswith("min") else pad_mm) for c in ("min_x", "min_y", "max_x", "max_y")]
    box = F.struct(*[g.alias(c) for g, c in zip(grown, ("min_x", "min_y", "max_x", "max_y"))])
    groups = kept(spatial.touching_groups(rows.select(*keys, "id", box.alias("box")), keys), "groups")
    home = groups.where("home = 1")
    links = groups.where("home = 0").select(F.col("id").alias("a"), F.col("root").alias("b"))
    labels = connected(home.select(F.col("root").alias("id")), links).withColumnsRenamed({"id": "root", "label": "cluster_id"})
    return rows.join(home.join(labels, "root").select("id", "cluster_id"), "id").select(*entities.columns, "cluster_id")


def cluster_boxes(clustered: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bounding box and size of each cluster."""
    return clustered.groupBy(*(keys or ["drawing_id"]), "cluster_id").agg(
        F.count("*").alias("n_entities"),
        F.min("min_x").alias("min_x"),
        F.min("min_y").alias("min_y"),
        F.max("max_x").alias("max_x"),
        F.max("max_y").alias("max_y"),
    )
