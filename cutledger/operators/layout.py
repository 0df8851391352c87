"""Layout operators: fit, scores, orderings, sheet assignment, splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.functions import geometry as geo
from cutledger.functions.vectorised import clip_area
from cutledger.operators.inventory import consumption_rank
from cutledger.operators.scan import Running, id_block, running, top_one
from cutledger.operators.spatial import by_crowding, self_pairs
from cutledger.session import kept

DISPLAY_GAP_MM = 60.0
SPLIT_EPS = 1e-6


def usable(stocks: DataFrame, margin_mm: float) -> DataFrame:
    """Stocks with their size less the margin on every side."""
    return stocks.withColumns(
        {
            "usable_w": F.greatest(F.col("width_mm") - 2 * margin_mm, F.lit(0.0)),
            "usable_h": F.greatest(F.col("height_mm") - 2 * margin_mm, F.lit(0.0)),
        }
    )


#: Sheets of a project that each of its pieces is compared with.
FEW_SHEETS = 64


def fits(pieces: DataFrame, stocks: DataFrame, margin_mm: float, kerf_mm: float = 0.0) -> DataFrame:
    """Flag pieces whose box fits some stock of their project, upright or turned by 90 degrees.

    A box fits when its longer and shorter sides are within those of a sheet. The sizes of up to ``FEW_SHEETS`` sheets of a project join its pieces
    as one row; the pieces of projects with more sizes meet them on a line.
    """
    w, h = F.col("width_mm") + max(kerf_mm, 0.0), F.col("height_mm") + max(kerf_mm, 0.0)
    sheets = usable(stocks, margin_mm).select(
        "project_id", F.greatest("usable_w", "usable_h").alias("long"), F.least("usable_w", "usable_h").alias("short")
    ).distinct()
    items = pieces.select("project_id", F.greatest(w, h).alias("long"), F.least(w, h).alias("side"), "piece_index")
    few, many = by_crowding(sheets, ["project_id"], FEW_SHEETS)
    sizes = few.groupBy("project_id").agg(F.collect_list(F.struct("long", "short")).alias("sizes"))
    held = F.exists("sizes", lambda s: (s["long"] >= F.col("long")) & (s["short"] >= F.col("side")))
    flag = F.coalesce(held, F.lit(False)).alias("fits")
    if many is None:
        return items.join(sizes, "project_id", "left").select("project_id", "piece_index", flag)
    crowded = many.select("project_id").distinct()
    out = items.join(crowded, "project_id", "left_anti").join(sizes, "project_id", "left").select("project_id", "piece_index", flag)
    return out.unionByName(_fits_on_a_line(items.join(crowded, "project_id", "left_semi"), many))


def _fits_on_a_line(items: DataFrame, sheets: DataFrame) -> DataFrame:
    """Pieces and sheets on one line by longer side, longest first: the largest shorter side seen so far decides, so no piece meets every sheet.
    Pieces of one size are cut into blocks by their index."""
    sheets = sheets.select("project_id", F.lit(0).alias("kind"), "long", "short")
    items = items.withColumn("kind", F.lit(1))
    line = sheets.unionByName(items, allowMissingColumns=True)
    seen = running(
        line,
        ["project_id"],
        [-F.col("long"), F.col("kind"), F.coalesce("piece_index", F.lit(0))],
        [
            F.struct((-F.col("long")).alias("k"), F.col("kind"), id_block(F.coalesce("piece_index", F.lit(0))).alias("i")),
            F.floor(-F.col("long") / 4.0),
            F.floor(-F.col("long") / 4096.0),
        ],
        [Running("widest", "max", F.col("short"))],
    )
    return seen.where("kind = 1").select(
        "project_id", "piece_index", F.coalesce(F.col("side") <= F.col("widest"), F.lit(False)).alias("fits")
    )


def orphan_reasons(
    pieces: DataFrame, placed: DataFrame, stocks: DataFrame, margin_mm: float, kerf_mm: float = 0.0
) -> DataFrame:
    """Why each unplaced piece was left: too big for every sheet, or no sheet left."""
    left = pieces.join(placed.select("project_id", "piece_index"), ["project_id", "piece_index"], "left_anti")
    reason = F.when(F.col("fits"), "no_sheet_capacity").otherwise("oversized_for_sheet")
    return fits(left, stocks, margin_mm, kerf_mm).withColumn("reason", reason).drop("fits")


def world(placed: DataFrame) -> DataFrame:
    """Placed rows with their solid outline as ``ring``, its ``box`` and ``solid_mm2``; needs rings, x_mm, y_mm."""
    x, y = F.col("x_mm"), F.col("y_mm")
    if "rotation_deg" in placed.columns:
        moved = geo.place(F.col("rings"), x, y, F.col("rotation_deg"))
    else:
        moved = geo.map_points(F.col("rings"), lambda px, py: (px + x, py + y))
    return placed.withColumn("ring", F.get(moved, 0)).withColumns(
        {"box": geo.bbox(F.array("ring")), "solid_mm2": F.abs(geo.ring_area(F.col("ring")))}
    )


SHEET = ["run_id", "sheet_index"]


def outline_members(placed: DataFrame) -> DataFrame:
    """Pieces of each distinct outline on a sheet: shape_index (its lowest piece) and piece_index."""
    placed = world(placed).select(*SHEET, "ring", "piece_index")
    shapes = placed.groupBy(*SHEET, "ring").agg(F.min("piece_index").alias("shape_index"))
    return placed.join(shapes, [*SHEET, "ring"]).select(*SHEET, "shape_index", "piece_index")


def _outlines(placed: DataFrame) -> DataFrame:
    """Distinct outlines of each sheet, stored: id (the lowest piece), copies, box and solid area. Sizes are worked out once per outline."""
    x, y = F.col("x_mm"), F.col("y_mm")
    if "rotation_deg" in placed.columns:
        rows = world(placed).select(*SHEET, "ring", "piece_index")
    else:
        ring = F.get(geo.map_points(F.slice("rings", 1, 1), lambda px, py: (px + x, py + y)), 0)
        rows = placed.select(*SHEET, ring.alias("ring"), "piece_index")
    shapes = rows.groupBy(*SHEET, "ring").agg(F.min("piece_index").alias("id"), F.count("*").alias("copies"))
    return kept(shapes.withColumns({"box": geo.bbox(F.array("ring")), "solid": geo.solid_area(F.array("ring"))}), "outlines")


def overlapping_pairs(placed: DataFrame, min_area: float = 1.0) -> DataFrame:
    """Outlines on one sheet sharing more than ``min_area`` mm2.

    Pieces with the very same outline are one row here: a_copies and b_copies tell how many there are, a row with
    a_index = b_index says that copies lie on each other, and ``outline_members`` lists the pieces behind an index.
    Sheets with few outlines compare them in one join, others on a grid. Rectangles are compared natively; only other shapes' outlines reach the
    clipping function, once per pair.
    """
    return _overlaps(_outlines(placed), min_area)


def _overlaps(shapes: DataFrame, min_area: float) -> DataFrame:
    area = (F.col("box.max_x") - F.col("box.min_x")) * (F.col("box.max_y") - F.col("box.min_y"))
    boxed = shapes.withColumn("is_box", F.abs(area - F.col("solid")) < 1e-6)

    def common(low: str, high: str) -> Column:
        edge = F.least(f"a_box.{high}", f"b_box.{high}") - F.greatest(f"a_box.{low}", f"b_box.{low}")
        return F.greatest(edge, F.lit(0.0))

    def sides(df: DataFrame) -> list[DataFrame]:
        return [df.select(*SHEET, *[F.col(c).alias(f"{x}_{c}") for c in ("id", "ring", "copies", "box", "is_box")]) for x in "ab"]

    shared = common("min_x", "max_x") * common("min_y", "max_y")
    few, many = by_crowding(boxed, SHEET)
    a, b = sides(few)
    near = a.hint("merge").join(b.hint("merge"), SHEET).where((F.col("a_id") < F.col("b_id")) & (shared > min_area))
    if many is not None:
        a, b = sides(many)
        met = self_pairs(many, SHEET).withColumnsRenamed({"left_id": "a_id", "right_id": "b_id"})
        near = near.unionByName(met.join(a, [*SHEET, "a_id"]).join(b, [*SHEET, "b_id"]).where(shared > min_area))
    both = F.col("a_is_box") & F.col("b_is_box")
    near = near.withColumn("boxed", shared)
    # explode, so that the area is worked out once, below the filter on it
    clipped = F.explode(F.array(clip_area(F.when(~both, F.col("a_ring")), F.when(~both, F.col("b_ring")))))
    pairs = near.select("*", clipped.alias("clipped")).withColumn("shared_mm2", F.when(both, F.col("boxed")).otherwise(F.col("clipped")))
    keep = [*SHEET, F.col("a_id").alias("a_index"), "a_copies", F.col("b_id").alias("b_index"), "b_copies", "shared_mm2"]
    stacked = shapes.where((F.col("copies") > 1) & (F.col("solid") > min_area)).select(
        *SHEET,
        F.col("id").alias("a_index"),
        F.col("copies").alias("a_copies"),
        F.col("id").alias("b_index"),
        F.col("copies").alias("b_copies"),
        F.col("solid").alias("shared_mm2"),
    )
    return pairs.where(F.col("shared_mm2") > min_area).select(keep).unionByName(stacked)


def overlapping_pieces(placed: DataFrame, min_area: float = 1.0) -> DataFrame:
    """Every pair of overlapping pieces (a_piece < b_piece), copies included; as many rows as there are such pairs.

    An outline without copies is its piece; only sheets with copies among their overlaps look for the pieces behind their outlines.
    """
    shapes = _outlines(placed)
    pairs = _overlaps(shapes, min_area)
    alone = (F.col("a_copies") == 1) & (F.col("b_copies") == 1)
    copied = not shapes.where("copies > 1").isEmpty()
    if copied:
        pairs = kept(pairs, "overlaps")
    one = pairs.where(alone).select(*SHEET, F.col("a_index").alias("a_piece"), F.col("b_index").alias("b_piece"), "shared_mm2")
    if copied:
        stacked = pairs.where(~alone)
        members = outline_members(placed.join(stacked.select(*SHEET).distinct(), SHEET, "left_semi"))
        a, b = (members.select(*SHEET, F.col("shape_index").alias(f"{x}_index"), F.col("piece_index").alias(f"{x}_piece")) for x in "ab")
        met = stacked.join(a, [*SHEET, "a_index"]).join(b, [*SHEET, "b_index"])
        met = met.where((F.col("a_index") != F.col("b_index")) | (F.col("a_piece") < F.col("b_piece")))
        one = one.unionByName(met.select(*one.columns))
    return one.select(*SHEET, F.least("a_piece", "b_piece").alias("a_piece"), F.greatest("a_piece", "b_piece").alias("b_piece"), "shared_mm2")


def sheets_with_overlaps(placed: DataFrame, min_area: float = 1.0) -> DataFrame:
    """Sheets that hold at least one significant overlap."""
    return overlapping_pairs(placed, min_area).select("run_id", "sheet_index").distinct()


def sheet_scores(placed: DataFrame, sheets: DataFrame, margin_mm: float) -> DataFrame:
    """Score of every sheet, empty ones included; free_strip_mm2 is the strip estimate of the free area.

    ``placed`` needs material_mm2 and the world box; ``sheets`` run_id, sheet_index, width_mm, height_mm.
    """
    sums = placed.groupBy("run_id", "sheet_index").agg(
        F.sum("material_mm2").alias("_material"),
        F.min("box.min_x").alias("_x0"),
        F.min("box.min_y").alias("_y0"),
        F.max("box.max_x").alias("_x1"),
        F.max("box.max_y").alias("_y1"),
    )
    m = F.lit(float(margin_mm))
    zero = F.lit(0.0)
    uw, uh = F.col("width_mm") - 2 * m, F.col("height_mm") - 2 * m
    right = F.greatest(F.col("width_mm") - m - F.col("_x1"), zero) * uh
    top = F.greatest(F.col("_x1") - m, zero) * F.greatest(F.col("height_mm") - m - F.col("_y1"), zero)
    return sheets.join(sums, ["run_id", "sheet_index"], "left").select(
        "run_id",
        "sheet_index",
        F.greatest(uw * uh - F.coalesce("_material", zero), zero).alias("waste_mm2"),
        F.coalesce((F.col("_x1") - m) * (F.col("_y1") - m), zero).alias("footprint_mm2"),
        F.coalesce("_y1", m).alias("layout_maxy"),
        F.coalesce("_y0", m).alias("min_y"),
        F.coalesce("_x0", m).alias("min_x"),
        F.when(F.col("_x1").isNull(), uw * uh).otherwise(F.greatest(right, top, zero)).alias("free_strip_mm2"),
    )


def layout_scores(scores: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """Score per run; each orphan costs one more sheet and one reference sheet area.

    ``orphans`` has run_id, orphan_count and reference_area_mm2.
    """
    total = scores.groupBy("run_id").agg(
        F.count("*").alias("sheet_count"),
        F.sum("waste_mm2").alias("total_waste_mm2"),
        F.sum("footprint_mm2").alias("total_footprint_mm2"),
        F.max("layout_maxy").alias("max_layout_maxy"),
        F.min("min_y").alias("min_min_y"),
        F.min("min_x").alias("min_min_x"),
        F.sum("free_strip_mm2").alias("total_free_strip_mm2"),
    )
    if orphans is None:
        return total
    n = F.coalesce("orphan_count", F.lit(0))
    return (
        total.join(orphans, "run_id", "left")
        .withColumns(
            {
                "sheet_count": F.col("sheet_count") + n,
                "total_waste_mm2": F.col("total_waste_mm2") + n * F.coalesce("reference_area_mm2", F.lit(0.0)),
            }
        )
        .drop("orphan_count", "reference_area_mm2")
    )


def layout_key() -> Column:
    """Layouts in order of preference: fewer sheets, less waste, smaller footprint, lower, more free area."""
    return F.struct(
        "sheet_count",
        "total_waste_mm2",
        "total_footprint_mm2",
        "max_layout_maxy",
        (-F.col("total_free_strip_mm2")).alias("k5"),
        "min_min_y",
        "min_min_x",
        "run_id",
    )


def best_layout(scores: DataFrame, job: str = "job_id") -> DataFrame:
    """Best layout per job, lexicographic on its key."""
    return top_one(scores, [job], [layout_key()], lowest=True)


def best_placement(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Best candidate per group: most free area, then smallest footprint, height and corner."""
    order = [
        (-F.col("free_strip_mm2")).alias("k1"),
        F.col("footprint_mm2"),
        F.col("layout_maxy"),
        F.col("min_y"),
        F.col("min_x"),
        F.col("id"),
    ]
    return top_one(candidates, keys, order, lowest=True)


def sheet_lower_bound(pieces: DataFrame, stocks: DataFrame, margin_mm: float) -> DataFrame:
    """Fewest sheets of each stock that could hold a project's area; 0 without area, NULL without room."""
    need = pieces.groupBy("project_id").agg(F.sum("area_mm2").alias("_area"))
    room = F.col("usable_w") * F.col("usable_h")
    return usable(stocks, margin_mm).join(need, "project_id", "left").select(
        "project_id",
        F.col("id").alias("stock_id"),
        F.when(F.coalesce("_area", F.lit(0.0)) <= 0, F.lit(0).cast("bigint"))
        .when(room > 0, F.greatest(F.ceil(F.col("_area") / room), F.lit(1).cast("bigint")))
        .alias("min_sheets"),
    )


def largest_bin(stocks: DataFrame, margin_mm: float) -> DataFrame:
    """Largest usable width and height per project, each on its own."""
    return usable(stocks, margin_mm).groupBy("project_id").agg(
        F.max("usable_w").alias("max_w"), F.max("usable_h").alias("max_h")
    )


def sheet_offsets(sheets: DataFrame, gap_mm: float) -> DataFrame:
    """Sheets renumbered from 0 with their left edge: the widths and gaps of the sheets before."""
    out = running(
        sheets,
        ["run_id"],
        [F.col("sheet_index")],
        [id_block(F.col("sheet_index"), 4096)],
        [
            Running("offset_x_mm", "sum", F.col("width_mm") + gap_mm, False),
            Running("new_index", "sum", F.lit(1), False),
        ],
    )
    return out.withColumn("offset_x_mm", F.col("offset_x_mm").cast("double"))


def display_offsets(sheets: DataFrame, gap_mm: float = DISPLAY_GAP_MM) -> DataFrame:
    """Sheets side by side for display, in the order of their stored left edge."""
    out = running(
        sheets,
        ["run_id"],
        [F.col("offset_x_mm"), F.col("sheet_index")],
        [
            F.struct(F.col("offset_x_mm").alias("k"), id_block(F.col("sheet_index"), 4096).alias("i")),
            F.floor(F.col("offset_x_mm") / 100_000.0),
        ],
        [Running("display_x_mm", "sum", F.col("width_mm") + gap_mm, False)],
    )
    return out.withColumn("display_x_mm", F.col("display_x_mm").cast("double"))


def ffd_order(pieces: DataFrame) -> DataFrame:
    """Pieces by falling area, lower index first on ties."""
    return pieces.orderBy("project_id", F.desc("area_mm2"), "piece_index")


#: Pieces of a project whose orders are worked out as arrays, within its row.
WHOLE_PIECES = 4096


def _order_keys(seed: int, shuffles: int) -> list[tuple[str, Column]]:
    """Names and sort keys of the orders; descending ones keep the lower index first on equal keys, as ascending ones do."""
    keys = [
        ("area_desc", -F.col("area_mm2")),
        ("area_asc", F.col("area_mm2")),
        ("max_width_desc", -F.col("width_mm")),
        ("bar_first", -geo.aspect_of(F.col("width_mm"), F.col("height_mm"))),
        ("index_desc", -F.col("piece_index").cast("double")),
        ("index_asc", F.col("piece_index").cast("double")),
    ]
    for i in range(shuffles):
        digest = F.md5(F.concat(F.lit(f"{seed + i}:"), F.col("piece_index").cast("string")))
        keys.append((f"shuffle_{seed + i}", F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")))
    return [(name, key.cast("double")) for name, key in keys]


def _profiles() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("_p"), F.lit(p).alias("profile")) for i, p in enumerate(geo.PROFILES)])


def _orders_at_once(pieces: DataFrame, keys: list[tuple[str, Column]]) -> DataFrame:
    """Different orders of each project by sorting its pieces as arrays: one shuffle of the pieces, whatever the number of orders."""
    listed = pieces.select("project_id", F.struct("piece_index", *[key.alias(f"k{i}") for i, (_, key) in enumerate(keys)]).alias("_x"))
    listed = listed.groupBy("project_id").agg(F.collect_list("_x").alias("_all"))

    def along(i: int) -> Column:
        by_key = F.transform("_all", lambda x: F.struct(x[f"k{i}"].alias("k"), x["piece_index"].alias("piece_index")))
        return F.array_sort(by_key)["piece_index"]

    sorted_ = listed.select("project_id", F.array(*[along(i) for i in range(len(keys))]).alias("_lists"))
    names = F.array(*[F.lit(name) for name, _ in keys])
    # the first of equal lists stays
    entry = F.transform("_lists", lambda at, i: F.struct(i.alias("order_no"), F.get(names, i).alias("order_name"), at.alias("_at")))
    unique = F.filter(entry, lambda e: F.array_position("_lists", e["_at"]) == e["order_no"] + 1)
    return (
        sorted_.select("project_id", F.posexplode(unique).alias("_pos", "_e"))
        .select("project_id", "_e.order_no", "_e.order_name", "_pos", F.posexplode("_e._at").alias("rank", "piece_index"))
        .select("project_id", "order_no", "order_name", F.col("_pos").cast("long").alias("_pos"), "piece_index", F.col("rank").cast("long").alias("rank"))
    )


def _orders_in_blocks(pieces: DataFrame, keys: list[tuple[str, Column]]) -> DataFrame:
    """The same for projects of any size: ranks by blocks, equal orders seen from order-independent sums of hashed (rank, piece) pairs."""
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("order_no"), F.lit(name).alias("order_name"), key.alias("key"))
            for i, (name, key) in enumerate(keys)
        ]
    )
    ranked = running(
        pieces.select("project_id", "piece_index", F.inline(entries)),
        ["project_id", "order_no"],
        [F.col("key"), F.col("piece_index")],
        [
            F.struct(F.col("key").alias("k"), id_block(F.col("piece_index")).alias("i")),
            F.floor(F.col("key") / 1024.0),
            F.floor(F.col("key") / 16_777_216.0),
        ],
        [Running("rank", "sum", F.lit(1), False)],
    )
    marks = ranked.groupBy("project_id", "order_no", "order_name").agg(
        F.sum(F.xxhash64("rank", "piece_index").cast("decimal(20,0)")).alias("_m1"),
        F.sum(F.xxhash64("piece_index", "rank", F.lit(7)).cast("decimal(20,0)")).alias("_m2"),
    )
    unique = top_one(marks, ["project_id", "_m1", "_m2"], [F.col("order_no")], lowest=True)
    listed = running(unique, ["project_id"], [F.col("order_no")], [], [Running("_pos", "sum", F.lit(1), False)])
    return listed.select("project_id", "order_no", "order_name", "_pos").join(
        ranked.select("project_id", "order_no", "piece_index", "rank"), ["project_id", "order_no"]
    ).select("project_id", "order_no", "order_name", "_pos", "piece_index", "rank")


def piece_orders(pieces: DataFrame, max_seeds: int | None = None, seed: int = 42, shuffles: int = 4) -> DataFrame:
    """Ranked piece orders per project, equal orders dropped, times the orientation profiles; the first ``max_seeds`` if given.

    Two orders are equal when every piece has the same rank in both. Projects of up to ``WHOLE_PIECES`` pieces sort their pieces in place, so that
    no row per order is shuffled; the pieces of larger ones are ranked by blocks over many tasks.
    """
    keys = _order_keys(seed, shuffles)
    pieces = pieces.select("project_id", "piece_index", "area_mm2", "width_mm", "height_mm").where("project_id is not null")
    large = pieces.groupBy("project_id").agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE_PIECES).select("project_id")
    orders = _orders_at_once(pieces.join(large, "project_id", "left_anti"), keys).unionByName(
        _orders_in_blocks(pieces.join(large, "project_id", "left_semi"), keys)
    )
    return (
        orders.select("project_id", "order_no", "order_name", "_pos", "piece_index", "rank", F.inline(_profiles()))
        .withColumn("seed_no", F.col("_pos") * len(geo.PROFILES) + F.col("_p"))
        .where(F.lit(True) if max_seeds is None else F.col("seed_no") < max_seeds)
        .select("project_id", "order_no", "order_name", "profile", "seed_no", "piece_index", "rank")
    )


ASSIGNED = "project_id bigint, piece_index int, stock_id bigint, copy_no bigint, placed boolean"


class Sheets:
    """The opened copies of one stock: a tournament tree over the area each has left, so the first that has enough is found in a logarithm of
    their number."""

    def __init__(self, no: int, width: float, height: float, copies: float) -> None:
        self.no, self.width, self.height, self.copies = no, width, height, copies
        self.opened, self.cap = 0, 1
        self.most = [-1.0, -1.0]

    def admits(self, w: float, h: float) -> bool:
        return (w <= self.width and h <= self.height) or (h <= self.width and w <= self.height)

    def _first(self, area: float) -> int | None:
        if self.most[1] < area:
            return None
        at = 1
        while at < self.cap:
            at *= 2
            at += self.most[at] < area
        return at - self.cap

    def _set(self, k: int, left: float) -> None:
        at = self.cap + k
        self.most[at] = left
        while at > 1:
            at //= 2
            self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])

    def _open(self) -> int:
        if self.opened == self.cap:
            leaves = self.most[self.cap :] + [-1.0] * self.cap
            self.cap *= 2
            self.most = [-1.0] * self.cap + leaves
            for at in range(self.cap - 1, 0, -1):
                self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])
        self.opened += 1
        return self.opened - 1

    def take(self, area: float) -> int | None:
        """Number of the copy that takes the area, opening the next one if no open one can; None if there is none."""
        k = self._first(area)
        if k is not None:
            self._set(k, self.most[self.cap + k] - area)
            return k
        whole = self.width * self.height
        if self.opened >= self.copies or whole < area:
            return None
        k = self._open()
        self._set(k, whole - area)
        return k


def _first_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk (project, stocks first, pieces by falling area); memory holds the opened sheets only."""
    project, stocks = None, []
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            if r.project_id != project:
                project, stocks = r.project_id, []
            if r.kind == 0:
                stocks.append(Sheets(r.no, r.w, r.h, np.inf if pd.isna(r.quantity) else int(r.quantity)))
                continue
            spot = None
            for s in stocks:
                if s.admits(r.w, r.h) and (k := s.take(r.area)) is not None:
                    spot = (s.no, k + 1)
                    break
            last = (stocks[-1].no, -1) if stocks else (None, -1)
            rows.append((r.project_id, r.no, *(spot or last), spot is not None))
        if rows:
            out = pd.DataFrame(rows, columns=["project_id", "piece_index", "stock_id", "copy_no", "placed"])
            yield out.astype({"stock_id": "Int64"})


def ffd_assign(pieces: DataFrame, stocks: DataFrame, margin_mm: float) -> DataFrame:
    """First-fit-decreasing assignment by box and remaining area, finite stocks first.

    Each choice depends on all before it, so a project is walked in order by one task; rows stream
    through sorted, and only the opened sheets stay in memory. A piece without a place goes to the last
    stock with copy_no -1.
    """
    sheets = usable(stocks, margin_mm).select(
        "project_id",
        F.lit(0).alias("kind"),
        F.col("quantity").isNull().cast("double").alias("k1"),
        F.col("sort_order").cast("double").alias("k2"),
        F.col("id").alias("no"),
        F.col("usable_w").alias("w"),
        F.col("usable_h").alias("h"),
        F.lit(0.0).alias("area"),
        F.col("quantity").cast("double").alias("quantity"),
    )
    items = pieces.select(
        "project_id",
        F.lit(1).alias("kind"),
        (-F.col("area_mm2")).alias("k1"),
        F.lit(0.0).alias("k2"),
        F.col("piece_index").cast("bigint").alias("no"),
        F.col("width_mm").alias("w"),
        F.col("height_mm").alias("h"),
        F.col("area_mm2").alias("area"),
        F.lit(None).cast("double").alias("quantity"),
    )
    return (
        sheets.unionByName(items)
        .repartition("project_id")
        .sortWithinPartitions("project_id", "kind", "k1", "k2", "no")
        .mapInPandas(_first_fit, ASSIGNED)
    )


def split_grid(pieces: DataFrame, stocks: DataFrame, margin_mm: float, max_children: int | None = None) -> DataFrame:
    """Cut plan of pieces on their boxes: columns and rows at the largest usable size.

    One row per child, column by column. A plan of more than ``max_children`` (if given) lists them all but is marked as
    not feasible; without a usable sheet there is one row without a child. Needs project_id, piece_index, min_x, min_y, width_mm, height_mm.
    """
    bins = largest_bin(stocks, margin_mm)
    roomy = (F.col("max_w") > SPLIT_EPS) & (F.col("max_h") > SPLIT_EPS)
    nx = F.greatest(F.ceil((F.col("width_mm") - SPLIT_EPS) / F.col("max_w")), F.lit(1).cast("bigint"))
    ny = F.greatest(F.ceil((F.col("height_mm") - SPLIT_EPS) / F.col("max_h")), F.lit(1).cast("bigint"))
    planned = (
        pieces.join(bins, "project_id", "left")
        .withColumns({"nx": F.when(roomy, nx), "ny": F.when(roomy, ny)})
        .withColumn("feasible", F.coalesce(F.col("nx") * F.col("ny") <= (2**62 if max_children is None else max_children), F.lit(False)))
    )
    last = F.col("nx") * F.col("ny") - 1
    numbered = planned.withColumn(
        "child_no", F.explode_outer(F.when(F.col("nx").isNotNull(), F.sequence(F.lit(0).cast("bigint"), last)))
    )
    cx, cy = F.floor(F.col("child_no") / F.col("ny")), F.col("child_no") % F.col("ny")
    x0 = F.col("min_x") + cx * F.col("max_w")
    y0 = F.col("min_y") + cy * F.col("max_h")
    return numbered.select(
        "project_id",
        "piece_index",
        "feasible",
        F.when(~F.col("feasible"), "split_not_feasible").alias("reason"),
        "child_no",
        geo.child_label(F.col("child_no")).alias("label"),
        x0.alias("x0"),
        y0.alias("y0"),
        F.least(x0 + F.col("max_w"), F.col("min_x") + F.col("width_mm")).alias("x1"),
        F.least(y0 + F.col("max_h"), F.col("min_y") + F.col("height_mm")).alias("y1"),
    )


def materialize(proposals: DataFrame, resolutions: DataFrame, derived: DataFrame) -> DataFrame:
    """Derived pieces after acceptance: children of accepted proposals replace their mother's earlier ones.

    The newest accepted proposal of an orphan counts.
    """
    accepted = top_one(
        proposals.where("status = 'accepted'"), ["orphan_resolution_id"], [F.col("version"), F.col("id")]
    )
    owner = resolutions.select(F.col("id").alias("orphan_resolution_id"), "project_id", "piece_key")
    number = F.regexp_extract("piece_key", "^([0-9]+)", 1).try_cast("bigint")
    new = (
        accepted.join(owner, "orphan_resolution_id")
        .select("project_id", "piece_key", F.posexplode("child_piece_geometries").alias("sort_order", "child"))
        .select(
            "project_id",
            F.col("piece_key").alias("parent_piece_key"),
            F.concat(
                F.lit("Pieza-"), (F.coalesce(number, F.lit(0)) + 1).cast("string"), F.col("child.label")
            ).alias("label"),
            "sort_order",
            F.col("child.rings").alias("rings"),
        )
    )
    mothers = new.select("project_id", "parent_piece_key").distinct()
    kept = derived.join(mothers, ["project_id", "parent_piece_key"], "left_anti").select(new.columns)
    return kept.unionByName(new)


def log_acceptance(projects: DataFrame, accepted: DataFrame) -> DataFrame:
    """Append one entry per accepted split to the project's workflow log.

    ``accepted`` has one row per project with piece_key, proposal_id and accepted_at.
    """
    entry = F.create_map(
        F.lit("event"),
        F.lit("split_accepted"),
        F.lit("piece_key"),
        F.col("piece_key"),
        F.lit("split_proposal_id"),
        F.col("proposal_id").cast("string"),
        F.lit("at"),
        F.date_format("accepted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    log = F.coalesce("session_workflow_log", F.array().cast("array<map<string,string>>"))
    return (
        projects.join(accepted, projects.id == accepted.project_id, "left")
        .withColumn(
            "session_workflow_log", F.when(F.col("piece_key").isNotNull(), F.array_append(log, entry)).otherwise(log)
        )
        .select(projects.columns)
    )


def workflow_log(projects: DataFrame) -> DataFrame:
    """One row per workflow log entry."""
    return projects.select("id", F.posexplode("session_workflow_log").alias("entry_no", "entry")).select(
        F.col("id").alias("project_id"),
        "entry_no",
        *[F.col("entry")[k].alias(k) for k in ("event", "piece_key", "at")],
    )


def nestable_pieces(pieces: DataFrame, derived: DataFrame) -> DataFrame:
    """Pieces to lay out: mothers that were split are replaced by their children."""
    mothers = derived.select("project_id", F.col("parent_piece_key").alias("piece_key")).distinct()
    kept = pieces.select("project_id", "piece_key", "rings").join(mothers, ["project_id", "piece_key"], "left_anti")
    children = derived.select(
        "project_id", F.concat("parent_piece_key", F.lit("/"), "label").alias("piece_key"), "rings"
    )
    return kept.withColumn("is_derived", F.lit(False)).unionByName(children.withColumn("is_derived", F.lit(True)))


def accepted_cuts(resolutions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Cut segments of accepted proposals per project."""
    owner = resolutions.select(F.col("id").alias("orphan_resolution_id"), "project_id")
    return (
        proposals.where("status = 'accepted'")
        .join(owner, "orphan_resolution_id")
        .select("project_id", F.col("id").alias("proposal_id"), F.posexplode("cut_segments").alias("cut_no", "segment"))
    )


def still_present(mothers: DataFrame, pieces: DataFrame) -> DataFrame:
    """Mother pieces whose outline still occurs among the project's pieces (same layer and rings)."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_fp", geo.fingerprint(F.col("layer"), F.col("rings")))

    return (
        keyed(mothers).join(keyed(pieces).select("project_id", "_fp"), ["project_id", "_fp"], "left_semi").drop("_fp")
    )


def edges(pieces: DataFrame) -> DataFrame:
    """One row per edge of every ring."""
    rings = pieces.select("project_id", "piece_index", F.posexplode("rings").alias("ring_no", "ring"))
    return rings.select(
        "project_id", "piece_index", "ring_no", F.posexplode(geo.ring_edges(F.col("ring"))).alias("edge_no", "e")
    ).select("project_id", "piece_index", "ring_no", "edge_no", "e.*")
