"""Registered queries over geometry columns and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.functions import geometry as geo
from cutledger.functions.vectorised import classify
from cutledger.operators import layout as lay
from cutledger.plans.registry import Registry
from cutledger.sources import driver as src

R = Registry()
MARGIN = 5.0


def _pieces(s, d):
    return src.pieces(s, d)


def _sized(s, d):
    return _pieces(s, d).withColumn("area_mm2", geo.polygon_area(F.col("rings")))


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


R.add(
    "m1_ring_area",
    lambda s, d: _pieces(s, d).select("project_id", "piece_index", geo.ring_area(geo.outer(F.col("rings"))).alias("area")),
    "SELECT project_id, piece_index, width_mm * height_mm * CASE WHEN kind = 2 THEN 0.75::DOUBLE ELSE 1 END AS area FROM pieces",
)
R.add(
    "m2_perimeter",
    lambda s, d: _pieces(s, d).select("project_id", "piece_index", geo.perimeter(F.col("rings")).alias("length")),
    """SELECT project_id, piece_index, (width_mm + height_mm) * CASE WHEN kind = 1 THEN 3 ELSE 2 END::DOUBLE AS length FROM pieces""",
)
R.add(
    "m3_polygon_area",
    lambda s, d: _pieces(s, d).select(
        "project_id", "piece_index", geo.polygon_area(F.col("rings")).alias("area"), geo.solid_area(F.col("rings")).alias("solid")
    ),
    """SELECT project_id, piece_index, area, width_mm * height_mm * CASE WHEN kind = 2 THEN 0.75::DOUBLE ELSE 1 END AS solid
    FROM pieces""",
)
_COMPACT = "(4 * pi() * area / power((width_mm + height_mm) * CASE WHEN kind = 1 THEN 3 ELSE 2 END, 2))"
R.add(
    "m4_compactness",
    lambda s, d: _pieces(s, d).select("project_id", "piece_index", F.round(geo.compactness(F.col("rings")), 6).alias("c")),
    f"SELECT project_id, piece_index, round({_COMPACT}, 6) AS c FROM pieces",
)
R.add(
    "m5_circle_radius",
    lambda s, d: _pieces(s, d).select(
        "project_id", "piece_index", F.round(F.coalesce(geo.circle_radius(F.col("rings")), F.lit(-1.0)), 4).alias("radius")
    ),
    f"""SELECT project_id, piece_index, round(CASE WHEN {_COMPACT} >= 0.55 THEN sqrt(area / pi()) ELSE -1 END, 4) AS radius
    FROM pieces""",
)
R.add(
    "m6_bbox_aspect",
    lambda s, d: _pieces(s, d).select("project_id", "piece_index", geo.bbox(F.col("rings")).alias("b"), geo.aspect(F.col("rings")).alias("a")).select(
        "project_id", "piece_index", "b.max_x", "b.max_y", F.round("a", 6).alias("aspect")
    ),
    """SELECT project_id, piece_index, width_mm AS max_x, height_mm AS max_y,
    round(greatest(width_mm, height_mm) / least(width_mm, height_mm), 6) AS aspect FROM pieces""",
)


def _worlds(s, d):
    turn = F.expr("cast(piece_index % 4 * 90 as double)")
    rect = _pieces(s, d).withColumn("rotation_deg", turn)
    moved = geo.place(F.col("rings"), F.lit(10.0), F.lit(20.0), F.col("rotation_deg"))
    return rect.select("project_id", "piece_index", geo.bbox(moved).alias("b"))


R.add(
    "m7_place",
    lambda s, d: _round(_worlds(s, d).select("project_id", "piece_index", "b.*"), "min_x", "min_y", "max_x", "max_y", digits=4),
    """SELECT project_id, piece_index, round(10 + CASE t WHEN 0 THEN 0 WHEN 1 THEN cx + cy - h WHEN 2 THEN 2 * cx - w ELSE cx - cy END, 4) AS min_x,
      round(20 + CASE t WHEN 0 THEN 0 WHEN 1 THEN cy - cx WHEN 2 THEN 2 * cy - h ELSE cx + cy - w END, 4) AS min_y,
      round(10 + CASE t WHEN 0 THEN w WHEN 1 THEN cx + cy WHEN 2 THEN 2 * cx ELSE cx - cy + h END, 4) AS max_x,
      round(20 + CASE t WHEN 0 THEN h WHEN 1 THEN cy - cx + w WHEN 2 THEN 2 * cy ELSE cx + cy END, 4) AS max_y
    FROM (SELECT project_id, piece_index, piece_index % 4 AS t, width_mm::DOUBLE AS w, height_mm::DOUBLE AS h,
      CASE WHEN kind = 2 THEN width_mm * 5 / 12 ELSE width_mm / 2 END::DOUBLE AS cx,
      CASE WHEN kind = 2 THEN height_mm * 5 / 12 ELSE height_mm / 2 END::DOUBLE AS cy FROM pieces)""",
)


def _decorated(s, d):
    """A diagonal drawn on each piece, moved with it; both ends."""
    turn = F.expr("cast(piece_index % 4 * 90 as double)")
    line = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.col("width_mm").cast("double"), F.col("height_mm").cast("double")))
    moved = geo.place_line(line, F.lit(10.0), F.lit(20.0), turn, geo.centroid(F.col("rings")))
    ends = _pieces(s, d).select("project_id", "piece_index", moved.alias("l"))
    return ends.selectExpr("project_id", "piece_index", "l[0][0] as x0", "l[0][1] as y0", "l[1][0] as x1", "l[1][1] as y1")


R.add(
    "m7_place_line",
    lambda s, d: _round(_decorated(s, d), "x0", "y0", "x1", "y1", digits=4),
    """SELECT project_id, piece_index, round(10 + CASE t WHEN 0 THEN 0 WHEN 1 THEN cx + cy WHEN 2 THEN 2 * cx ELSE cx - cy END, 4) AS x0,
      round(20 + CASE t WHEN 0 THEN 0 WHEN 1 THEN cy - cx WHEN 2 THEN 2 * cy ELSE cx + cy END, 4) AS y0,
      round(10 + CASE t WHEN 0 THEN w WHEN 1 THEN cx + cy - h WHEN 2 THEN 2 * cx - w ELSE cx - cy + h END, 4) AS x1,
      round(20 + CASE t WHEN 0 THEN h WHEN 1 THEN cy - cx + w WHEN 2 THEN 2 * cy - h ELSE cx + cy - w END, 4) AS y1
    FROM (SELECT project_id, piece_index, piece_index % 4 AS t, width_mm::DOUBLE AS w, height_mm::DOUBLE AS h,
      CASE WHEN kind = 2 THEN width_mm * 5 / 12 ELSE width_mm / 2 END::DOUBLE AS cx,
      CASE WHEN kind = 2 THEN height_mm * 5 / 12 ELSE height_mm / 2 END::DOUBLE AS cy FROM pieces)""",
)
R.add(
    "m8_contains",
    lambda s, d: _pieces(s, d).select(
        "project_id", "piece_index", geo.contains(F.col("rings"), F.lit(300.5), F.lit(200.5)).alias("inside")
    ),
    """SELECT project_id, piece_index, (300.5 < width_mm AND 200.5 < height_mm) AND CASE kind
      WHEN 1 THEN NOT (300.5 > width_mm / 4 AND 300.5 < width_mm * 3 / 4 AND 200.5 > height_mm / 4 AND 200.5 < height_mm * 3 / 4)
      WHEN 2 THEN NOT (300.5 > width_mm / 2 AND 200.5 > height_mm / 2) ELSE true END AS inside FROM pieces""",
)
R.add(
    "m9_fits_bin",
    lambda s, d: lay.world(src.placed(s, d)).select(
        "run_id", "piece_index", geo.fits_bin(F.col("box"), F.lit(1220.0), F.lit(1000.0), F.lit(MARGIN)).alias("fits")
    ),
    """SELECT run_id, piece_index, x_mm >= 5 - 1e-6 AND y_mm >= 5 - 1e-6 AND x_mm + width_mm <= 1215 + 1e-6
    AND y_mm + height_mm <= 995 + 1e-6 AS fits FROM placed""",
)
R.add(
    "m10_axis_share",
    lambda s, d: src.contours(s, d)
    .withColumn("turned", geo.turn(F.col("rings"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.expr("cast(id % 3 * 15 as double)")))
    .select("id", geo.is_axis_aligned(F.get("turned", 0)).alias("aligned")),
    "SELECT id, id % 3 = 0 AS aligned FROM contours",
)
R.add(
    "m11_snap",
    lambda s, d: src.table(s, d, "lineitem").select(
        geo.snap(F.col("l_quantity") / 4, 0.5).alias("snapped")
    ).groupBy("snapped").agg(F.count("*").alias("n")),
    "SELECT round_even(l_quantity / 4 / 0.5, 0) * 0.5 AS snapped, count(*) AS n FROM lineitem GROUP BY 1",
)
R.add(
    "m12_end_gap",
    lambda s, d: _pieces(s, d).select("project_id", "piece_index", geo.end_gap(geo.outer(F.col("rings")), 300.0).alias("g")).select(
        "project_id", "piece_index", F.coalesce("g.distance_mm", F.lit(-1.0)).alias("gap_mm")
    ),
    """SELECT project_id, piece_index, CASE WHEN height_mm > 300 THEN round(height_mm, 4) ELSE -1 END AS gap_mm FROM pieces""",
)
R.add(
    "m13_is_strip",
    lambda s, d: _pieces(s, d).select("project_id", "piece_index", geo.is_strip(F.col("rings")).alias("strip")),
    """SELECT project_id, piece_index, area <= 250000 AND greatest(width_mm, height_mm) / least(width_mm, height_mm) >= 3
    AS strip FROM pieces""",
)
R.add(
    "m14_kerf_box",
    lambda s, d: _pieces(s, d).select("project_id", "piece_index", geo.kerf_box(geo.bbox(F.col("rings")), 3.0).alias("b")).select(
        "project_id", "piece_index", "b.min_x", "b.max_x", "b.max_y"
    ),
    "SELECT project_id, piece_index, -1.5::DOUBLE AS min_x, width_mm + 1.5 AS max_x, height_mm + 1.5 AS max_y FROM pieces",
)


def _oriented(s, d):
    profile = F.element_at(F.array(*[F.lit(p) for p in geo.PROFILES]), F.col("piece_index") % 3 + 1)
    return (
        _pieces(s, d)
        .withColumn("orthogonal", geo.axis_share(geo.outer(F.col("rings"))) >= geo.ORTHOGONAL_SHARE)
        .select(
            "project_id",
            "piece_index",
            geo.bbox(geo.orient(F.col("rings"), profile, F.lit(1220.0), F.lit(1000.0), F.col("orthogonal"))).alias("b"),
        )
        .select("project_id", "piece_index", F.round(F.expr("b.max_x - b.min_x"), 4).alias("w"))
    )


R.add(
    "m15_orient",
    _oriented,
    """SELECT project_id, piece_index, round(CASE piece_index % 3 WHEN 0 THEN width_mm WHEN 1 THEN height_mm
      ELSE CASE WHEN height_mm / width_mm >= 3 THEN height_mm ELSE width_mm END END, 4) AS w FROM pieces""",
)
R.add(
    "g24_bounds",
    lambda s, d: _pieces(s, d).select("project_id", geo.bbox(F.col("rings")).alias("b")).groupBy("project_id").agg(
        F.min("b.min_x").alias("min_x"), F.max("b.max_x").alias("max_x"), F.max("b.max_y").alias("max_y")
    ),
    "SELECT project_id, 0::DOUBLE AS min_x, max(width_mm) AS max_x, max(height_mm) AS max_y FROM pieces GROUP BY 1",
)
R.add(
    "p20_piece_key",
    lambda s, d: _pieces(s, d).select(
        "project_id",
        "piece_index",
        geo.index_key(F.col("project_id"), F.col("piece_index")).alias("key"),
        geo.valid_piece_key(geo.geometry_key(F.col("project_id"), F.col("layer"), F.col("rings"))).alias("valid"),
        geo.valid_piece_key(F.concat(F.lit("x"), F.col("piece_index"))).alias("bad_valid"),
    ),
    """SELECT project_id, piece_index, project_id || ':piece-' || piece_index AS key, true AS valid, false AS bad_valid
    FROM pieces""",
)
def _ring_json(*corners: tuple[str, str]) -> str:
    """A ring as JSON text in SQL, from the SQL of its corners."""
    points = " || ',' || ".join(f"'[' || CAST({x} AS DOUBLE)::VARCHAR || ',' || CAST({y} AS DOUBLE)::VARCHAR || ']'" for x, y in corners)
    return f"'[' || {points} || ']'"


_BOX_JSON = _ring_json(("0", "0"), ("w", "0"), ("w", "h"), ("0", "h"))
_HOLE_JSON = _ring_json(("w / 4", "h / 4"), ("w * 3 / 4", "h / 4"), ("w * 3 / 4", "h * 3 / 4"), ("w / 4", "h * 3 / 4"))
_ELL_JSON = _ring_json(("0", "0"), ("w", "0"), ("w", "h / 2"), ("w / 2", "h / 2"), ("w / 2", "h"), ("0", "h"))
R.add(
    "p20_fingerprint",
    lambda s, d: _pieces(s, d).groupBy("layer", geo.fingerprint(F.col("layer"), F.col("rings")).alias("fp")).agg(F.count("*").alias("n")),
    f"""SELECT layer, substr(sha256('{{"layer_name":"' || layer || '","rings":[' || CASE kind WHEN 0 THEN {_BOX_JSON}
      WHEN 1 THEN {_BOX_JSON} || ',' || {_HOLE_JSON} ELSE {_ELL_JSON} END || ']}}'), 1, 16) AS fp, count(*) AS n
    FROM (SELECT layer, kind, CAST(width_mm AS DOUBLE) AS w, CAST(height_mm AS DOUBLE) AS h FROM pieces) GROUP BY 1, 2""",
)
R.add(
    "p22_child_label",
    lambda s, d: _pieces(s, d).select((F.col("l_partkey") % 60).alias("i")).distinct().select(
        "i", geo.child_label(F.col("i")).alias("label")
    ),
    """SELECT DISTINCT l_partkey % 60 AS i, chr(CAST(97 + l_partkey % 60 % 26 AS INTEGER))
    || CASE WHEN l_partkey % 60 < 26 THEN '' ELSE CAST(l_partkey % 60 // 26 AS VARCHAR) END AS label FROM pieces""",
)
R.add(
    "r5_edges",
    lambda s, d: lay.edges(_pieces(s, d)).groupBy("project_id", "piece_index").agg(
        F.count("*").alias("n_edges"), F.sum(F.hypot(F.expr("x1 - x0"), F.expr("y1 - y0"))).alias("length")
    ),
    """SELECT project_id, piece_index, CASE kind WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 6 END AS n_edges,
    (width_mm + height_mm) * CASE WHEN kind = 1 THEN 3 ELSE 2 END::DOUBLE AS length FROM pieces""",
)
_FITS = """EXISTS (SELECT 1 FROM stocks s WHERE s.project_id = p.project_id AND (
    (p.width_mm + {k} <= s.width_mm - 10 AND p.height_mm + {k} <= s.height_mm - 10)
    OR (p.height_mm + {k} <= s.width_mm - 10 AND p.width_mm + {k} <= s.height_mm - 10)))"""
R.add(
    "j17_fits",
    lambda s, d: lay.fits(_pieces(s, d), src.stocks(s, d), MARGIN),
    f"SELECT project_id, piece_index, {_FITS.format(k=0)} AS fits FROM pieces p",
)


def _done(s, d):
    """Pieces of the first two indices count as placed."""
    return src.placed(s, d).where("x_mm + width_mm <= 1220").selectExpr("run_id as project_id", "piece_index")


R.add(
    "j19_orphan_reasons",
    lambda s, d: lay.orphan_reasons(_pieces(s, d), _done(s, d), src.stocks(s, d), MARGIN, 2.0),
    f"""SELECT project_id, piece_index, CASE WHEN {_FITS.format(k=2)} THEN 'no_sheet_capacity' ELSE 'oversized_for_sheet' END
    AS reason FROM pieces p WHERE NOT EXISTS (SELECT 1 FROM placed q WHERE q.run_id = p.project_id
      AND q.piece_index = p.piece_index AND q.x_mm + q.width_mm <= 1220)""",
)
def _shape_sql(t: str) -> str:
    """The one or two boxes a solid shape is made of."""
    return f"""SELECT run_id, sheet_index, piece_index, x_mm AS x0, y_mm AS y0, x_mm + width_mm AS x1,
      y_mm + CASE WHEN kind = 2 THEN height_mm / 2 ELSE height_mm END AS y1 FROM {t}
    UNION ALL SELECT run_id, sheet_index, piece_index, x_mm, y_mm + height_mm / 2, x_mm + width_mm / 2, y_mm + height_mm
      FROM {t} WHERE kind = 2"""


_ALLPAIRS = f"""SELECT a.run_id, a.sheet_index, a.piece_index AS a_index, b.piece_index AS b_index,
      sum(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) AS shared
    FROM ({_shape_sql('placed')}) a JOIN ({_shape_sql('placed')}) b ON a.run_id = b.run_id AND a.sheet_index = b.sheet_index
      AND a.piece_index < b.piece_index GROUP BY 1, 2, 3, 4 HAVING shared > 1"""
R.add(
    "j24_overlapping_pairs",
    lambda s, d: lay.overlapping_pieces(src.placed(s, d)).select(
        "run_id", "sheet_index", "a_piece", "b_piece", F.round("shared_mm2", 3).alias("shared_mm2")
    ),
    f"SELECT run_id, sheet_index, a_index AS a_piece, b_index AS b_piece, round(shared, 3) AS shared_mm2 FROM ({_ALLPAIRS})",
)
R.add(
    "j24_outline_members",
    lambda s, d: lay.outline_members(src.placed(s, d)),
    """SELECT run_id, sheet_index, min(piece_index) OVER (PARTITION BY run_id, sheet_index, kind, x_mm, y_mm, width_mm, height_mm)
    AS shape_index, piece_index FROM (SELECT * REPLACE (CASE WHEN kind = 2 THEN 2 ELSE 0 END AS kind) FROM placed)""",
)
R.add(
    "u2_clip_area_pairs",
    lambda s, d: lay.overlapping_pieces(src.placed(s, d)).select(
        "run_id", "sheet_index", F.col("a_piece").alias("a_index"), F.col("b_piece").alias("b_index"), F.round("shared_mm2", 3).alias("shared_mm2")
    ),
    f"SELECT run_id, sheet_index, a_index, b_index, round(shared, 3) AS shared_mm2 FROM ({_ALLPAIRS})",
)
R.add(
    "j24_sheets_with_overlaps",
    lambda s, d: lay.sheets_with_overlaps(src.placed(s, d)),
    f"SELECT DISTINCT run_id, sheet_index FROM ({_ALLPAIRS})",
)
R.add(
    "u2_clip_length",
    lambda s, d: _pieces(s, d).select(
        "project_id",
        "piece_index",
        F.round(
            geo.length_inside(
                F.array(F.array(F.lit(-5.0), F.lit(50.5)), F.array(F.lit(2000.0), F.lit(50.5))), F.col("rings")
            ),
            3,
        ).alias("inside_mm"),
    ),
    """SELECT project_id, piece_index, round(CASE WHEN height_mm <= 50.5 THEN 0 WHEN kind = 1 AND 50.5 > height_mm / 4
      AND 50.5 < height_mm * 3 / 4 THEN width_mm / 2 WHEN kind = 2 AND 50.5 > height_mm / 2 THEN width_mm / 2 ELSE width_mm END, 3)
      AS inside_mm FROM pieces""",
)
def _tilted():
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return geo.turn(F.col("rings"), origin, F.expr("cast(piece_index % 5 * 10 as double)"))


R.add(
    "u1_classify",
    lambda s, d: _pieces(s, d)
    # explode, so that the array lambdas are evaluated before the Python function sees the column
    .select("project_id", "piece_index", F.expr("if(width_mm = height_mm, 90D, 180D)").alias("turn"), F.explode(F.slice(_tilted(), 1, 1)).alias("t"))
    .select("project_id", "piece_index", "turn", classify("t").alias("c"))
    .select(
        "project_id", "piece_index", "c.is_orthogonal",
        # a square's two directions are equal
        F.pmod(F.round("c.principal_deg", 4), F.col("turn")).alias("principal_deg"),
        F.pmod(F.round("c.align_deg", 4), F.col("turn")).alias("align_deg"),
    ),
    """SELECT project_id, piece_index, true AS is_orthogonal, deg AS principal_deg, deg AS align_deg FROM (SELECT *,
      (piece_index % 5 * 10 + CASE WHEN width_mm >= height_mm THEN 0 ELSE 90 END)::DOUBLE AS deg FROM pieces)""",
)
_SHEETS = "SELECT run_id, sheet_index, width_mm, height_mm, offset_x_mm FROM doc_sheets"


def _sheets(s, d):
    return src.placement_docs(s, d).select("run_id", F.inline("sheets")).drop("pieces")


def _scores(s, d):
    worlds = lay.world(src.placed(s, d)).withColumn("material_mm2", geo.polygon_area(F.col("rings")))
    return lay.sheet_scores(worlds, _sheets(s, d), MARGIN)


_SCORES = """SELECT h.run_id, h.sheet_index, greatest((h.width_mm - 10) * (h.height_mm - 10) - coalesce(m, 0), 0) AS waste_mm2,
    coalesce((x1 - 5) * (y1 - 5), 0) AS footprint_mm2, coalesce(y1, 5) AS layout_maxy, coalesce(y0, 5) AS min_y,
    coalesce(x0, 5) AS min_x, CASE WHEN x1 IS NULL THEN (h.width_mm - 10) * (h.height_mm - 10)
      ELSE greatest(greatest(h.width_mm - 5 - x1, 0) * (h.height_mm - 10), greatest(x1 - 5, 0) * greatest(h.height_mm - 5 - y1, 0), 0) END
      AS free_strip_mm2
    FROM doc_sheets h LEFT JOIN (SELECT run_id, sheet_index, sum(area) AS m, min(x_mm) AS x0, min(y_mm) AS y0,
      max(x_mm + width_mm) AS x1, max(y_mm + height_mm) AS y1 FROM placed GROUP BY 1, 2) p
      ON p.run_id = h.run_id AND p.sheet_index = h.sheet_index"""
R.add("g25_sheet_scores", _scores, _SCORES)


def _run_orphans(s, d):
    return src.runs(s, d).selectExpr("id as run_id", "size(report.orphans) as orphan_count", "490000D as reference_area_mm2")


_LAYOUT = f"""SELECT s.run_id, count(*) + max(r.id % 4) AS sheet_count, sum(waste_mm2) + max(r.id % 4) * 490000 AS total_waste_mm2,
    sum(footprint_mm2) AS total_footprint_mm2, max(layout_maxy) AS max_layout_maxy, min(min_y) AS min_min_y,
    min(min_x) AS min_min_x, sum(free_strip_mm2) AS total_free_strip_mm2
    FROM ({_SCORES}) s JOIN runs r ON r.id = s.run_id GROUP BY 1"""
R.add("g26_layout_scores", lambda s, d: lay.layout_scores(_scores(s, d), _run_orphans(s, d)), _LAYOUT)
R.add(
    "w17_best_layout",
    lambda s, d: lay.best_layout(
        lay.layout_scores(_scores(s, d), _run_orphans(s, d)).withColumn("job_id", F.expr("run_id % 1000"))
    ).select("job_id", "run_id", "sheet_count"),
    f"""SELECT run_id % 1000 AS job_id, run_id, sheet_count FROM ({_LAYOUT}) QUALIFY row_number() OVER (PARTITION BY run_id % 1000
      ORDER BY sheet_count, total_waste_mm2, total_footprint_mm2, max_layout_maxy, total_free_strip_mm2 DESC, min_min_y,
      min_min_x, run_id) = 1""",
)
R.add(
    "w18_best_placement",
    lambda s, d: lay.best_placement(_scores(s, d).withColumn("id", F.col("run_id")), ["sheet_index"]).select(
        "sheet_index", "run_id", "free_strip_mm2"
    ),
    f"""SELECT sheet_index, run_id, free_strip_mm2 FROM ({_SCORES}) QUALIFY row_number() OVER (PARTITION BY sheet_index
      ORDER BY free_strip_mm2 DESC, footprint_mm2, layout_maxy, min_y, min_x, run_id) = 1""",
)
R.add(
    "g27_sheet_lower_bound",
    lambda s, d: lay.sheet_lower_bound(_sized(s, d), src.stocks(s, d), MARGIN),
    """SELECT s.project_id, s.id AS stock_id, CASE WHEN a IS NULL THEN 0 ELSE greatest(1,
      CAST(ceil(a / ((s.width_mm - 10) * (s.height_mm - 10))) AS BIGINT)) END AS min_sheets FROM stocks s
    LEFT JOIN (SELECT project_id, sum(area) AS a FROM pieces GROUP BY 1) p ON p.project_id = s.project_id""",
)
R.add(
    "g28_largest_bin",
    lambda s, d: lay.largest_bin(src.stocks(s, d), MARGIN),
    "SELECT project_id, max(width_mm) - 10 AS max_w, max(height_mm) - 10 AS max_h FROM stocks GROUP BY 1",
)
R.add(
    "w6_sheet_offsets",
    lambda s, d: lay.sheet_offsets(_sheets(s, d), 15.0).select("run_id", "new_index", F.col("offset_x_mm").alias("x")),
    """SELECT run_id, row_number() OVER w - 1 AS new_index, coalesce(sum(width_mm + 15) OVER (w ROWS BETWEEN UNBOUNDED
      PRECEDING AND 1 PRECEDING), 0) AS x FROM doc_sheets WINDOW w AS (PARTITION BY run_id ORDER BY sheet_index)""".replace(
        "OVER (w ROWS BETWEEN UNBOUNDED\n      PRECEDING AND 1 PRECEDING)",
        "OVER (PARTITION BY run_id ORDER BY sheet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    ),
)
R.add(
    "w7_display_offsets",
    lambda s, d: lay.display_offsets(_sheets(s, d)).select("run_id", "sheet_index", "display_x_mm"),
    """SELECT run_id, sheet_index, coalesce(sum(width_mm + 60) OVER (PARTITION BY run_id ORDER BY offset_x_mm, sheet_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS display_x_mm FROM doc_sheets""",
)
R.add(
    "l7_ffd_order",
    lambda s, d: lay.ffd_order(_sized(s, d)).select("project_id", "piece_index", "area_mm2"),
    "SELECT project_id, piece_index, area AS area_mm2 FROM pieces",
)
_ORDERS = """long AS (SELECT project_id, piece_index, n, o.* FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS n FROM pieces),
      LATERAL (VALUES (0, 'area_desc', -area), (1, 'area_asc', area), (2, 'max_width_desc', -width_mm),
        (3, 'bar_first', -(greatest(width_mm, height_mm) / least(width_mm, height_mm))), (4, 'index_desc', -piece_index::DOUBLE),
        (5, 'index_asc', piece_index::DOUBLE),
        (6, 'shuffle_42', CAST('0x' || substr(md5('42:' || piece_index), 1, 8) AS BIGINT)::DOUBLE),
        (7, 'shuffle_43', CAST('0x' || substr(md5('43:' || piece_index), 1, 8) AS BIGINT)::DOUBLE),
        (8, 'shuffle_44', CAST('0x' || substr(md5('44:' || piece_index), 1, 8) AS BIGINT)::DOUBLE),
        (9, 'shuffle_45', CAST('0x' || substr(md5('45:' || piece_index), 1, 8) AS BIGINT)::DOUBLE)) AS o(order_no, order_name, k)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, order_no ORDER BY k, piece_index) - 1 AS rank FROM long),
    seq AS (SELECT project_id, order_no, order_name, list(piece_index ORDER BY rank) AS l FROM ranked GROUP BY 1, 2, 3),
    uniq AS (SELECT project_id, l, min(order_no) AS order_no FROM seq GROUP BY 1, 2),
    pos AS (SELECT project_id, order_no, row_number() OVER (PARTITION BY project_id ORDER BY order_no) - 1 AS p FROM uniq)"""
R.add(
    "w16_piece_orders",
    lambda s, d: lay.piece_orders(_sized(s, d)).select("project_id", "order_name", "profile", "seed_no", "piece_index", "rank"),
    f"""WITH {_ORDERS} SELECT r.project_id, r.order_name, q.profile, pos.p * 3 + q.i AS seed_no, r.piece_index, r.rank
    FROM pos JOIN ranked r ON r.project_id = pos.project_id AND r.order_no = pos.order_no,
      (VALUES (0, 'as_extracted'), (1, 'cardinal_90'), (2, 'bar_parallel_long_edge')) AS q(i, profile)""",
)
R.add(
    "w20_ffd_assign",
    lambda s, d: lay.ffd_assign(_sized(s, d), src.stocks(s, d), MARGIN).withColumn(
        "stock_id", F.coalesce("stock_id", F.lit(-1))
    ),
    """WITH RECURSIVE one AS (SELECT s.project_id, s.id, s.quantity IS NULL AS u, s.sort_order AS so, c,
        greatest(s.width_mm - 10, 0) AS w, greatest(s.height_mm - 10, 0) AS h FROM stocks s
        LEFT JOIN (SELECT project_id, count(*) AS n FROM pieces GROUP BY 1) p ON p.project_id = s.project_id,
        unnest(range(1, 1 + coalesce(s.quantity, p.n, 0))) AS t(c)),
    bins AS (SELECT project_id, list(id ORDER BY u, so, id, c) AS ids, list(c ORDER BY u, so, id, c) AS cs,
        list(w ORDER BY u, so, id, c) AS ws, list(h ORDER BY u, so, id, c) AS hs FROM one GROUP BY 1),
    item AS (SELECT project_id, piece_index, width_mm AS w, height_mm AS h, area,
        row_number() OVER (PARTITION BY project_id ORDER BY area DESC, piece_index) AS n FROM pieces),
    fold(project_id, n, piece_index, lefts, pos) AS (
      SELECT project_id, 0::BIGINT, -1::INTEGER, [ws[i] * hs[i] FOR i IN range(1, len(ws) + 1)], 0::INTEGER FROM bins
      UNION ALL SELECT q.project_id, q.n, q.piece_index,
        [CASE WHEN i = q.pos THEN q.lefts[i] - q.area ELSE q.lefts[i] END FOR i IN range(1, len(q.lefts) + 1)], q.pos
      FROM (SELECT f.project_id, t.n, t.piece_index, t.area, f.lefts, coalesce(list_position([((t.w <= b.ws[i] AND t.h <= b.hs[i])
          OR (t.h <= b.ws[i] AND t.w <= b.hs[i])) AND f.lefts[i] >= t.area FOR i IN range(1, len(b.ws) + 1)], true), 0)::INTEGER AS pos
        FROM fold f JOIN item t ON t.project_id = f.project_id AND t.n = f.n + 1 JOIN bins b ON b.project_id = f.project_id) q)
    SELECT f.project_id, f.piece_index, CASE WHEN pos > 0 THEN b.ids[pos] ELSE b.ids[len(b.ids)] END AS stock_id,
      CASE WHEN pos > 0 THEN b.cs[pos] ELSE -1 END AS copy_no, pos > 0 AS placed
    FROM fold f JOIN bins b ON b.project_id = f.project_id WHERE n > 0""",
)


def _oversized(s, d):
    return _pieces(s, d).selectExpr("project_id", "piece_index", "0D as min_x", "0D as min_y", "width_mm", "height_mm")


R.add(
    "r1_split_grid",
    lambda s, d: lay.split_grid(_oversized(s, d), src.stocks(s, d), 405.0).select(
        "project_id", "piece_index", "feasible", F.coalesce("child_no", F.lit(-1)).alias("child_no"), "x0", "y0", "x1", "y1"
    ),
    """SELECT project_id, piece_index, ok AS feasible, coalesce(c, -1) AS child_no,
      c // ny * 410.0::DOUBLE AS x0, c % ny * 190.0::DOUBLE AS y0,
      least((c // ny + 1) * 410.0::DOUBLE, width_mm) AS x1, least((c % ny + 1) * 190.0::DOUBLE, height_mm) AS y1
    FROM (SELECT *, true AS ok, unnest(range(nx * ny)) AS c
      FROM (SELECT *, CAST(greatest(1, ceil((width_mm - 1e-6) / 410)) AS BIGINT) AS nx,
        CAST(greatest(1, ceil((height_mm - 1e-6) / 190)) AS BIGINT) AS ny FROM pieces))""",
)
_NEWEST = """SELECT p.*, r.project_id, r.piece_key FROM proposals p JOIN resolutions r ON r.id = p.orphan_resolution_id
    WHERE p.status = 'accepted' QUALIFY row_number() OVER (PARTITION BY orphan_resolution_id ORDER BY version DESC) = 1"""
R.add(
    "r2_materialize",
    lambda s, d: lay.materialize(src.proposals(s, d), src.resolutions(s, d), src.derived(s, d)).select(
        "project_id", "parent_piece_key", "label", "sort_order"
    ),
    f"""SELECT project_id, piece_key AS parent_piece_key, 'Pieza-' || (CAST(piece_key AS BIGINT) + 1) || chr(CAST(97 + i AS INTEGER)) AS label,
      i AS sort_order FROM ({_NEWEST}), unnest(range(version % 3 + 1)) AS t(i)
    UNION ALL SELECT project_id, parent_piece_key, 'Pieza-1a', 0 FROM derived d WHERE NOT EXISTS (SELECT 1 FROM ({_NEWEST}) n
      WHERE n.project_id = d.project_id AND n.piece_key = d.parent_piece_key)""",
)


def _log(s, d):
    last = src.resolutions(s, d).where("resolution_state = 'resolved'").groupBy("project_id").agg(
        F.max("piece_key").alias("piece_key"), F.max("id").alias("proposal_id")
    ).withColumn("accepted_at", F.lit("2024-01-02").cast("timestamp"))
    start = F.array(F.create_map(F.lit("event"), F.lit("opened"), F.lit("at"), F.lit("2024-01-01")))
    return lay.workflow_log(lay.log_acceptance(src.projects(s, d).select("id", start.alias("session_workflow_log")), last))


R.add(
    "r4_workflow_log",
    _log,
    """SELECT o_orderkey AS project_id, 0 AS entry_no, 'opened' AS event, NULL AS piece_key, '2024-01-01' AS at FROM orders
    UNION ALL SELECT project_id, 1, 'split_accepted', max(piece_key), '2024-01-02T00:00:00Z' FROM resolutions
    WHERE resolution_state = 'resolved' AND project_id IN (SELECT o_orderkey FROM orders) GROUP BY 1""".replace(" AS at ", ' AS "at" '),
)


def _keyed(s, d):
    return _pieces(s, d).withColumn("piece_key", F.col("piece_index").cast("string"))


R.add(
    "j13_nestable_pieces",
    lambda s, d: lay.nestable_pieces(_keyed(s, d), src.derived(s, d)).select("project_id", "piece_key", "is_derived"),
    """SELECT project_id, CAST(piece_index AS VARCHAR) AS piece_key, false AS is_derived FROM pieces p WHERE NOT EXISTS
      (SELECT 1 FROM derived d WHERE d.project_id = p.project_id AND d.parent_piece_key = CAST(p.piece_index AS VARCHAR))
    UNION ALL SELECT project_id, parent_piece_key || '/Pieza-1a', true FROM derived""",
)
R.add(
    "j14_accepted_cuts",
    lambda s, d: lay.accepted_cuts(src.resolutions(s, d), src.proposals(s, d)).select(
        "project_id", "proposal_id", "cut_no", F.get(F.get("segment", 0), 1).alias("y")
    ),
    """SELECT r.project_id, p.id AS proposal_id, 0 AS cut_no, p.version::DOUBLE AS y FROM proposals p
    JOIN resolutions r ON r.id = p.orphan_resolution_id WHERE p.status = 'accepted'""",
)
R.add(
    "x4_still_present",
    lambda s, d: lay.still_present(
        _pieces(s, d).where("piece_index = 0"), _pieces(s, d).where("piece_index > 0")
    ).select("project_id", "layer", "width_mm"),
    """SELECT project_id, layer, width_mm FROM pieces m WHERE piece_index = 0 AND EXISTS (SELECT 1 FROM pieces p
      WHERE p.project_id = m.project_id AND p.piece_index > 0 AND p.layer = m.layer AND p.kind = m.kind
      AND p.width_mm = m.width_mm AND p.height_mm = m.height_mm)""",
)
R.add(
    "l6_latest_per_group",
    lambda s, d: lay.top_one(_sized(s, d).drop("rings"), ["project_id"], [F.col("area_mm2"), -F.col("piece_index")]).select(
        "project_id", "piece_index", "area_mm2"
    ),
    """SELECT project_id, piece_index, area AS area_mm2 FROM pieces
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY area DESC, piece_index) = 1""",
)
