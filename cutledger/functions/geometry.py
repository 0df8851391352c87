"""Polygon columns built from native array functions; areas, centroids, turning, placing and clipped lengths work over whole Arrow batches.

A polygon is a list of rings (ring 0 outer, the others holes), a ring a list of [x, y] with the closing
point left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutledger.functions.vectorised import axis_shares, boxes, inside_length, measures, turned_about, turned_about_centroid

RINGS = "array<array<array<double>>>"
# Tolerances and limits of the measures.
EPS_MM = 1e-6
MIN_COMPACTNESS = 0.08
MIN_CIRCLE_COMPACTNESS = 0.55
ORTHOGONAL_SHARE = 0.70
STRIP_MAX_AREA = 250_000.0
STRIP_ASPECT = 3.0
BAR_ASPECT = 3.0


def zero() -> Column:
    return F.lit(0.0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (array lambdas re-evaluate what they capture)."""
    return F.get(F.transform(F.array(value), body), 0)


def ring_edges(ring: Column) -> Column:
    """Edges of a closed ring as structs x0, y0, x1, y1."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        turned,
        lambda a, b: F.struct(
            F.get(a, 0).alias("x0"), F.get(a, 1).alias("y0"), F.get(b, 0).alias("x1"), F.get(b, 1).alias("y1")
        ),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, zero(), lambda acc, v: acc + v)


def _edge_values(ring: Column, measure) -> Column:
    """One value per edge from its two points."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1)), measure)


def ring_area(ring: Column) -> Column:
    """Signed area, positive counter-clockwise."""
    return _total(_edge_values(ring, lambda a, b: a[0] * b[1] - b[0] * a[1])) / 2


def ring_perimeter(ring: Column) -> Column:
    return _total(_edge_values(ring, lambda a, b: F.hypot(b[0] - a[0], b[1] - a[1])))


def outer(rings: Column) -> Column:
    return F.get(rings, 0)


def holes(rings: Column) -> Column:
    return F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1)))


def solid_area(rings: Column) -> Column:
    """Area of the outer ring, holes ignored."""
    return F.abs(ring_area(outer(rings)))


def polygon_area(rings: Column) -> Column:
    """Area with the holes taken out."""
    return measures(rings)["area"]


def perimeter(rings: Column) -> Column:
    """Length of all rings."""
    return _total(F.transform(rings, ring_perimeter))


def compactness(rings: Column) -> Column:
    """4 pi A / P squared, 0 for a polygon without length."""
    p = measures(rings)["length"]
    return F.when(p > 0, 4 * F.pi() * polygon_area(rings) / (p * p)).otherwise(zero())


def circle_radius(rings: Column) -> Column:
    """Radius of the circle of equal area, NULL unless compact enough to be round."""
    return F.when(compactness(rings) >= MIN_CIRCLE_COMPACTNESS, F.sqrt(polygon_area(rings) / F.pi()))


def bbox(rings: Column) -> Column:
    """Bounding box struct min_x, min_y, max_x, max_y of the outer ring."""
    return boxes(rings)


def aspect_of(width: Column, height: Column) -> Column:
    """Long side over short side, 1 for a degenerate box."""
    return F.when((width <= 0) | (height <= 0), F.lit(1.0)).otherwise(
        F.greatest(width, height) / F.least(width, height)
    )


def aspect(rings: Column) -> Column:
    b = bbox(rings)
    return aspect_of(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"])


def centroid(rings: Column) -> Column:
    """Area centroid struct x, y; holes count negative."""
    return F.struct(measures(rings)["x"].alias("x"), measures(rings)["y"].alias("y"))


def map_points(rings: Column, move) -> Column:
    """Rings with every point passed through ``move(x, y) -> (x, y)`` columns."""
    return F.transform(
        rings, lambda ring: F.transform(ring, lambda p: F.array(*move(F.get(p, 0), F.get(p, 1))))
    )


def turn(rings: Column, center: Column, deg: Column) -> Column:
    """Rings rotated about a point."""
    return shift_turn(rings, center, deg, zero(), zero())


def shift_turn(rings: Column, center: Column, deg: Column, x: Column, y: Column) -> Column:
    return turned_about(rings, center["x"], center["y"], deg, x, y)


def place(rings: Column, x: Column, y: Column, deg: Column, center: Column | None = None) -> Column:
    """Rotate about the area centroid (or the given centre, for decorations), then translate."""
    if center is not None:
        return shift_turn(rings, center, deg, x, y)
    return turned_about_centroid(rings, deg, x, y)


def place_line(line: Column, x: Column, y: Column, deg: Column, center: Column) -> Column:
    """Decoration points moved with their piece: same centre, turn and shift."""
    return F.get(place(F.array(line), x, y, deg, center), 0)


def _crossings(ring: Column, x: Column, y: Column) -> Column:
    hits = _edge_values(
        ring,
        lambda a, b: ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]),
    )
    return F.size(F.filter(hits, lambda hit: hit))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test against one ring."""
    return _crossings(ring, x, y) % 2 == 1


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Point inside the outer ring and outside every hole."""
    return in_ring(outer(rings), x, y) & ~F.exists(holes(rings), lambda h: in_ring(h, x, y))


def in_hole(rings: Column, x: Column, y: Column) -> Column:
    return F.exists(holes(rings), lambda h: in_ring(h, x, y))


def edge_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the nearest edge of a ring."""

    def one(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        length2 = dx * dx + dy * dy
        t = F.when(length2 > 0, ((x - e["x0"]) * dx + (y - e["y0"]) * dy) / length2).otherwise(zero())
        t = F.greatest(zero(), F.least(F.lit(1.0), t))
        return F.hypot(x - e["x0"] - t * dx, y - e["y0"] - t * dy)

    return F.array_min(F.transform(ring_edges(ring), one))


def _stops(s: Column, rings: Column) -> Column:
    """Where along a segment (x, y, dx, dy) it meets the edges of some rings: shares of its length, with 0 and 1, in order."""

    def cut(a: Column, b: Column) -> Column:
        ex, ey = b[0] - a[0], b[1] - a[1]
        den = s["dx"] * ey - s["dy"] * ex
        t = ((a[0] - s["x"]) * ey - (a[1] - s["y"]) * ex) / den
        u = ((a[0] - s["x"]) * s["dy"] - (a[1] - s["y"]) * s["dx"]) / den
        return F.when((den != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    found = F.flatten(F.transform(rings, lambda r: _edge_values(r, cut)))
    return F.array_sort(F.concat(F.array(zero(), F.lit(1.0)), F.array_compact(found)))


def ring_within(inner: Column, outer_rings: Column, tol: Column) -> Column:
    """A ring lies in the polygon or within ``tol`` of its outline, and no hole wider than twice that lies in the ring.

    Corners are tested first. Then each edge is cut where it meets the outline, and the middle of each part is tested, so an edge may not
    cross a notch either.
    """

    def held(x: Column, y: Column) -> Column:
        near = F.array_min(F.transform(outer_rings, lambda r: edge_distance(r, x, y))) <= tol
        return contains(outer_rings, x, y) | near

    def edge_held(e: Column) -> Column:
        s = F.struct(e["x0"].alias("x"), e["y0"].alias("y"), (e["x1"] - e["x0"]).alias("dx"), (e["y1"] - e["y0"]).alias("dy"))

        def parts(seg: Column) -> Column:
            def mids(at: Column) -> Column:
                return F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda p, q: (p + q) / 2)

            return F.forall(
                let(_stops(seg, outer_rings), mids), lambda m: held(seg["x"] + m * seg["dx"], seg["y"] + m * seg["dy"])
            )

        return let(s, parts)

    def wide(h: Column) -> Column:
        sides = [F.array_max(F.transform(h, lambda p: F.get(p, k))) - F.array_min(F.transform(h, lambda p: F.get(p, k))) for k in (0, 1)]
        return F.least(*sides) > 2 * tol

    corners = F.forall(inner, lambda p: held(F.get(p, 0), F.get(p, 1)))
    covered_hole = F.exists(
        holes(outer_rings), lambda h: wide(h) & F.forall(h, lambda p: in_ring(inner, F.get(p, 0), F.get(p, 1)))
    )
    return corners & F.forall(ring_edges(inner), edge_held) & ~covered_hole


def length_inside(segment: Column, rings: Column) -> Column:
    """Length of a segment ([[x, y], [x, y]]) inside a polygon.

    The segment is cut wherever it meets an edge, and the middle of each part is tested, over whole Arrow batches.
    """
    return inside_length(segment, rings)


def fits_bin(box: Column, width: Column, height: Column, margin: Column) -> Column:
    """World box inside the sheet less its margin, with a hair of slack."""
    return (
        (box["min_x"] >= margin - EPS_MM)
        & (box["min_y"] >= margin - EPS_MM)
        & (box["max_x"] <= width - margin + EPS_MM)
        & (box["max_y"] <= height - margin + EPS_MM)
    )


def axis_share(ring: Column, tol_deg: float = 1.0) -> Column:
    """Share of a ring's length within ``tol_deg`` of the axes."""
    return axis_shares(ring, F.lit(float(tol_deg)))


def is_axis_aligned(ring: Column) -> Column:
    return axis_share(ring) >= ORTHOGONAL_SHARE


def snap(value: Column, grid: float) -> Column:
    """Coordinate moved to the grid, halves to even."""
    return F.rint(value / grid) * grid


def end_gap(points: Column, tol: float) -> Column:
    """Gap between the ends of an open polyline, NULL up to ``tol``; fields as stored with a layer."""
    first, last = F.get(points, 0), F.element_at(points, -1)
    gap = F.hypot(F.get(last, 0) - F.get(first, 0), F.get(last, 1) - F.get(first, 1))
    return F.when(
        (F.size(points) >= 2) & (gap > tol),
        F.struct(
            F.round(gap, 4).alias("distance_mm"),
            F.transform(first, lambda v: F.round(v, 4)).alias("start"),
            F.transform(last, lambda v: F.round(v, 4)).alias("end"),
        ),
    )


def is_strip(rings: Column, max_area: float = STRIP_MAX_AREA, min_aspect: float = STRIP_ASPECT) -> Column:
    """Small and elongated."""
    b = bbox(rings)
    w, h = b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]
    return (w > 0) & (h > 0) & (polygon_area(rings) <= max_area) & (aspect_of(w, h) >= min_aspect)


def kerf_box(box: Column, kerf_mm: float) -> Column:
    """Box grown by half the kerf on every side."""
    half = max(kerf_mm, 0.0) / 2
    return F.struct(
        (box["min_x"] - half).alias("min_x"),
        (box["min_y"] - half).alias("min_y"),
        (box["max_x"] + half).alias("max_x"),
        (box["max_y"] + half).alias("max_y"),
    )


PROFILES = ["as_extracted", "cardinal_90", "bar_parallel_long_edge"]


def orient(rings: Column, profile: Column, sheet_w: Column, sheet_h: Column, orthogonal: Column) -> Column:
    """Rings under an orientation profile: as is, turned 90 degrees if orthogonal, or long bars laid along
    the sheet's long side."""
    b = bbox(rings)
    w, h = b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]
    bar = (w > 0) & (h > 0) & (aspect_of(w, h) >= BAR_ASPECT) & ((sheet_w >= sheet_h) != (w >= h))
    turned = place(rings, zero(), zero(), F.lit(90.0))
    return F.when((profile == "cardinal_90") & orthogonal, turned).when(
        (profile == "bar_parallel_long_edge") & bar, turned
    ).otherwise(rings)


def fingerprint(layer: Column, rings: Column) -> Column:
    """First 16 hex digits of the SHA-256 of layer and rings rounded to 3 decimals."""
    rounded = map_points(rings, lambda x, y: (F.round(x, 3), F.round(y, 3)))
    return F.substring(F.sha2(F.to_json(F.struct(layer.alias("layer_name"), rounded.alias("rings"))), 256), 1, 16)


PIECE_KEY = r"^(?:[0-9]+|[0-9]+:(?:piece-[0-9]+|fp-[a-f0-9]{16}))$"


def index_key(blob_id: Column, piece_index: Column) -> Column:
    return F.concat(blob_id.cast("string"), F.lit(":piece-"), piece_index.cast("string"))


def geometry_key(blob_id: Column, layer: Column, rings: Column) -> Column:
    return F.concat(blob_id.cast("string"), F.lit(":fp-"), fingerprint(layer, rings))


def valid_piece_key(key: Column) -> Column:
    return key.rlike(PIECE_KEY)


def child_label(index: Column) -> Column:
    """a to z, then a1 to z1 and so on."""
    letter = F.chr(F.lit(97) + index % 26)
    return F.when(index < 26, letter).otherwise(F.concat(letter, F.floor(index / 26).cast("string")))


def layer_hue(name: Column) -> Column:
    """Colour angle of a layer without a colour."""
    return F.crc32(name.cast("binary")) % 360
