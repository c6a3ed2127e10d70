"""Kernels and folds over the given tables. Most are beyond SQL; tests/ hold them against their definitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from emberframe.functions import shapes
from emberframe.functions import images, polygons
from emberframe.operators.reading import Calibration, ReadOptions, read_frames
from emberframe.plans import tables
from emberframe.plans.registry import query
from emberframe.streaming import folds, registration


def _frames(spark, d):
    """embeddings as movies of packed 8 x 8 frames, by label."""
    from pyspark.sql import Window

    e = tables.read(spark, d, "embeddings")
    own = images.pack(e, "vec_id", "embedding", 8, 4096.0, 1.0).join(e.select(F.col("vec_id").alias("frame"), F.col("label").alias("movie_id")), "frame")
    pos = (F.row_number().over(Window.partitionBy("movie_id").orderBy("frame")) - 1).cast("int")
    return own.select("movie_id", pos.alias("pos"), (pos.cast("long") * 20_000_000).alias("ts_ns"), "h", "w", "px")


def _hashed(frames, *more):
    return frames.select("movie_id", "pos", *more, F.md5("px").alias("px_md5"))


def _image(name, kernel, sql):
    @query(name, sql)
    def run(spark, d):
        return images.pixels_of(tables.packed(spark, d), kernel)


#: Pixel (y, x) of a frame moved by (dx, dy): its place in the source, and bilinear values there; `wrap` takes places as periods.
_MOVED = """WITH {px}, t AS (SELECT frame, y, x, px, x - ({dx}) AS u, y - ({dy}) AS v FROM px),
f AS (SELECT *, {place} FROM t), g AS (SELECT *, floor(p)::INTEGER AS x0, floor(q)::INTEGER AS y0, p - floor(p) AS a, q - floor(q) AS b FROM f),
k AS (SELECT g.*, (c.px * (1 - b) + d.px * b) * (1 - a) + (e.px * (1 - b) + h.px * b) * a AS value FROM g
  JOIN px c ON c.frame = g.frame AND c.x = x0 AND c.y = y0 JOIN px d ON d.frame = g.frame AND d.x = x0 AND d.y = {y1}
  JOIN px e ON e.frame = g.frame AND e.x = {x1} AND e.y = y0 JOIN px h ON h.frame = g.frame AND h.x = {x1} AND h.y = {y1}) """
_NEAREST = _MOVED.format(px=tables.PX, dx=1.25, dy=-0.5, place="least(greatest(u, 0), 7) AS p, least(greatest(v, 0), 7) AS q", x1="least(x0 + 1, 7)", y1="least(y0 + 1, 7)")
_WRAPPED = _MOVED.format(px=tables.PX, dx=2.5, dy=0.5, place="(u + 8) % 8 AS p, (v + 8) % 8 AS q", x1="(x0 + 1) % 8", y1="(y0 + 1) % 8")
_image("k1_translate_bilinear", lambda img: images.translate(img, 1.25, -0.5, "nearest"), _NEAREST + """
SELECT k.frame, k.y, k.x, CASE WHEN u >= 0 AND u < 8 AND v >= 0 AND v < 8 THEN trunc(value)::INTEGER ELSE o.px END AS px FROM k JOIN px o ON o.frame = k.frame AND o.x = trunc(p)::INTEGER AND o.y = trunc(q)::INTEGER""")
_image("k1_translate_wrap", lambda img: images.translate(img, 2.5, 0.5, "wrap"), _WRAPPED + "SELECT frame, y, x, trunc(value)::INTEGER AS px FROM k")
_image("c14_correct_bad_pixels", lambda img: images.correct_bad_pixels(img, images.bad_pixels(img, 2.0)), tables.BAD.format(k=2.0) + """, r AS (
  SELECT a.frame, a.y, a.x, list_sort(list(b.px)) AS v FROM bad a JOIN px b ON a.frame = b.frame AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY a.frame, a.y, a.x),
w AS (SELECT frame, m - trunc(2 * sqrt(list_avg(list_transform(s, lambda v: ((v - m) ** 2)::DOUBLE))))::INTEGER AS low FROM m)
SELECT p.frame, p.y, p.x, greatest(coalesce(r.v[len(r.v) // 2 + 1], p.px), greatest(w.low, 0)) AS px FROM px p JOIN w USING (frame) LEFT JOIN r ON r.frame = p.frame AND r.y = p.y AND r.x = p.x""")


def half(levels: np.ndarray) -> np.ndarray:
    """A calibration for the given frames: half a level, from 1000 on."""
    return ((levels & 8191) // 2 + 1000).astype(levels.dtype)


class Half(Calibration):
    def to_temp(self, v, ti, inv_emissivity):
        return F.floor(v.bitwiseAND(F.lit(8191)) / 2) + 1000

    def to_dl(self, t, ti, inv_emissivity):
        return (t - 1000) * 2

    def apply(self, img, inv_emissivity=1.0):
        return half(img)


@query("c1_read_pipeline")
def read_pipeline(spark, d):
    f = _frames(spark, d)
    shifts = f.select("movie_id", "pos", (F.col("pos") % 3).cast("double").alias("dx"), F.lit(0.5).alias("dy"))
    return _hashed(read_frames(f, ReadOptions(min_t=100, min_t_height=4, calibration=Half(), correct_bad=True, motion=True), shifts))


@query("z1_lossy")
def lossy(spark, d):
    return _hashed(folds.lossy(_frames(spark, d), high_error=300, low_error=600, std_factor=0.5, average=8), "low_error", "high_error")


@query("z2_lossy_with_camera")
def lossy_with_camera(spark, d):
    out = folds.lossy(_frames(spark, d), high_error=150, low_error=300, std_factor=0.5, average=4, lossy_height=6, calibrate=half, local_min=True)
    return _hashed(out, "low_error", "high_error", "min_t", F.md5("times").alias("times_md5"))


@query("z3_add_loss")
def add_loss(spark, d):
    return _hashed(folds.lossy(_frames(spark, d), high_error=300, low_error=600, std_factor=0.5, reduce_only=True), "low_error", "high_error")


@query("z5_downsample")
def downsample(spark, d):
    return _hashed(folds.downsample(_frames(spark, d), 5), "ts_ns")


@query("z6_downsample_steady")
def downsample_steady(spark, d):
    return _hashed(folds.downsample(_frames(spark, d), 5, steady=True), "ts_ns")


@query("k12_hash_bytes")
def hashed(spark, d):
    from emberframe.functions.hashing import murmur64

    return tables.read(spark, d, "documents").select("doc_id", murmur64(F.encode("text", "UTF-8")).alias("hash"))


@query("k9_register")
def register(spark, d):
    return registration.register(_frames(spark, d), sigma=0.8).select("movie_id", "pos", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"), F.round("confidence", 4).alias("confidence"))


def _poly(name, schema, f, sql=None):
    @query(name, sql)
    def run(spark, d):
        def each(batches):
            for b in batches:
                pts = b.column("pts")
                flat = pts.flatten()  # all points of a batch as two arrays
                own = np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in "xy"])
                ends = np.r_[0, np.cumsum(pts.value_lengths().to_numpy(zero_copy_only=False))]
                out = [f(own[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
                columns = [pa.array([r[k] for r in out], pa.string()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([b.column("poly_id"), *columns], ["poly_id", *names])

        names = [c.split()[0] for c in schema.split(", ")]  # strings
        return tables.polygons(spark, d).mapInArrow(each, f"poly_id long, {schema}")


def _shape(points) -> str:
    return ";".join(f"{round(float(x), 6) + 0.0:g},{round(float(y), 6) + 0.0:g}" for x, y in points)


_poly("g1_interpolate", "points string", lambda p: (_shape(polygons.interpolate(p, p[::-1] * 1.5, 0.4)),))
_poly("g2_enclosing_simplification", "points string", lambda p: (_shape(polygons.enclosing_simplification(p, 5.0)),))
_poly("g3_simplify_to", "points string", lambda p: (_shape(polygons.simplify_to(p, 6)),))
_poly("g8_extract_polygon", "points string", lambda p: (_shape(polygons.extract_polygon(polygons.draw(np.zeros((100, 100), np.int32), p, 1), 1)),))
_poly("g9_extract_polygons", "shapes string", lambda p: ("|".join(f"{v}:{_shape(r)}" for v, r in polygons.extract_polygons(polygons.draw(polygons.draw(np.zeros((100, 100), np.int32), p, 1), p / 2, 2)).items()),))
_POINTS = f"WITH {tables.POINTS} "


def _native(name, sql, **out):
    @query(name, _POINTS + sql)
    def run(spark, d):
        return tables.polygons(spark, d).select("poly_id", *[f(F.col("pts")).alias(k) for k, f in out.items()])


_native("g16_without_collinear", """, k AS (
  SELECT e.poly_id, e.pos, e.x, e.y, (e.x - p.x) * (e.ny - e.y) - (e.y - p.y) * (e.nx - e.x) AS turn FROM edges e JOIN edges p ON p.poly_id = e.poly_id AND p.pos = (e.pos + e.n - 1) % e.n)
SELECT poly_id, coalesce(string_agg(x::INTEGER || ',' || y::INTEGER, ';' ORDER BY pos) FILTER (turn <> 0), '') AS points FROM k GROUP BY poly_id""",
        points=lambda p: F.array_join(F.transform(shapes.without_collinear(p), lambda a: F.concat_ws(",", a["x"].cast("int"), a["y"].cast("int"))), ";"))
_native("g20_is_non_concave", """, d AS (
  SELECT poly_id, nx - x AS dx, ny - y AS dy, row_number() OVER (PARTITION BY poly_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY poly_id) AS m FROM edges WHERE nx <> x OR ny <> y),
t AS (SELECT a.poly_id, atan2(a.dx * b.dy - a.dy * b.dx, a.dx * b.dx + a.dy * b.dy) AS turn FROM d a JOIN d b ON a.poly_id = b.poly_id AND b.i = a.i % a.m + 1)
SELECT poly_id, (bool_and(turn >= -1e-12) OR bool_and(turn <= 1e-12)) AND abs(abs(sum(turn)) - 2 * pi()) < 1e-6 AS convex FROM t GROUP BY poly_id""", convex=shapes.is_non_concave)  # fmt: skip

_HULL = """, u AS (SELECT DISTINCT poly_id, x, y FROM pts), a AS (
  SELECT p.poly_id, p.x, p.y, atan2(q.y - p.y, q.x - p.x) AS angle FROM u p JOIN u q ON p.poly_id = q.poly_id AND (p.x <> q.x OR p.y <> q.y)),
g AS (SELECT poly_id, x, y, coalesce(lead(angle) OVER w, first(angle) OVER w + 2 * pi()) - angle AS gap FROM a WINDOW w AS (PARTITION BY poly_id, x, y ORDER BY angle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
hull AS (SELECT poly_id, x, y FROM g GROUP BY poly_id, x, y HAVING max(gap) > pi() + 1e-9)"""


@query("g10_convex_hull", _POINTS + _HULL + " SELECT poly_id, x, y FROM hull")
def hull(spark, d):
    ring = shapes.convex_hull(F.col("pts"))
    each = tables.polygons(spark, d).select("poly_id", F.explode(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))).alias("p"))
    return each.select("poly_id", "p.x", "p.y")


# a box along any two corners of the hull holds it; the least one is along a side
@query("g11_minimum_area_box", _POINTS + _HULL + """, dir AS (SELECT p.poly_id, atan2(q.y - p.y, q.x - p.x) AS angle FROM hull p JOIN hull q ON p.poly_id = q.poly_id AND (p.x <> q.x OR p.y <> q.y)),
r AS (SELECT d.poly_id, d.angle, max(h.x * cos(angle) + h.y * sin(angle)) AS u1, min(h.x * cos(angle) + h.y * sin(angle)) AS u0, max(h.y * cos(angle) - h.x * sin(angle)) AS v1, min(h.y * cos(angle) - h.x * sin(angle)) AS v0 FROM dir d JOIN hull h USING (poly_id) GROUP BY ALL),
k AS (SELECT *, u1 - u0 AS p, v1 - v0 AS q, (u0 + u1) / 2 AS mu, (v0 + v1) / 2 AS mv, row_number() OVER (PARTITION BY poly_id ORDER BY round((u1 - u0) * (v1 - v0), 6), angle) AS n FROM r)
SELECT poly_id, round(mu * cos(angle) - mv * sin(angle), 4) + 0 AS cx, round(mu * sin(angle) + mv * cos(angle), 4) + 0 AS cy, round(least(p, q), 4) + 0 AS width, round(greatest(p, q), 4) + 0 AS height FROM k WHERE n = 1
UNION ALL SELECT poly_id, min(x), min(y), 0.0, 0.0 FROM u GROUP BY poly_id HAVING count(*) = 1""")
def least_box(spark, d):
    box = tables.polygons(spark, d).select("poly_id", shapes.minimum_area_box(shapes.convex_hull(F.col("pts")), decimals=6).alias("b"))
    return box.select("poly_id", *[(F.round(F.col(f"b.{k}"), 4) + F.lit(0.0)).alias(k) for k in ("cx", "cy", "width", "height")])


_RUNS = """, o AS (SELECT *, x - row_number() OVER (PARTITION BY poly_id, y ORDER BY x) AS island FROM covered)
SELECT poly_id, y, min(x) AS a, max(x) AS b FROM o GROUP BY poly_id, y, island"""


@query("g4_fill_pixels", _POINTS + tables.COVERED + _RUNS)
def filled(spark, d):
    from emberframe.operators import raster

    return raster.spans(tables.polygons(spark, d), 100, 100)


@query("g7_triangle_pixels", _POINTS + """, three AS (SELECT poly_id, x::INTEGER AS x, y::INTEGER AS y, row_number() OVER (PARTITION BY poly_id ORDER BY y, x) AS k FROM (
  SELECT poly_id, x, y FROM pts WHERE pos = 0 UNION ALL SELECT poly_id, x, y FROM pts WHERE pos = n // 3 UNION ALL SELECT poly_id, x, y FROM pts WHERE pos = 2 * n // 3)),
t AS (SELECT a.poly_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3, CASE WHEN c.y > a.y THEN trunc(a.x + (b.y - a.y)::DOUBLE / (c.y - a.y) * (c.x - a.x))::INTEGER ELSE c.x END AS cut
  FROM three a JOIN three b ON b.poly_id = a.poly_id AND b.k = 2 JOIN three c ON c.poly_id = a.poly_id AND c.k = 3 WHERE a.k = 1),
parts AS (SELECT poly_id, y1 AS y0, x1 AS x0, y2 AS ye, x2 AS l, cut AS r FROM t WHERE y1 < y2 UNION ALL SELECT poly_id, y3, x3, y2, x2, cut FROM t WHERE y2 < y3 UNION ALL SELECT poly_id, y1, x1, y1, x1, x3 FROM t WHERE y1 = y3),
lines AS (SELECT *, unnest(range(greatest(least(y0, ye), 0), least(greatest(y0, ye), 99) + 1))::INTEGER AS y FROM parts),
ends AS (SELECT poly_id, y, CASE WHEN y0 = ye THEN l ELSE round(x0 + (l - x0)::DOUBLE / (ye - y0) * (y - y0))::INTEGER END AS p, CASE WHEN y0 = ye THEN r ELSE round(x0 + (r - x0)::DOUBLE / (ye - y0) * (y - y0))::INTEGER END AS q FROM lines),
covered AS (SELECT DISTINCT poly_id, y, unnest(range(greatest(least(p, q), 0), least(greatest(p, q), 99) + 1))::INTEGER AS x FROM ends)""" + _RUNS)
def triangles(spark, d):
    from emberframe.operators import raster

    corner = lambda k: F.element_at("pts", F.expr(f"int({k} * size(pts) div 3)") + 1)
    own = tables.polygons(spark, d).select("poly_id", F.array(corner(0), corner(1), corner(2)).alias("pts"))
    return raster.triangle_spans(own, 100, 100)


#: Polygons in frames of 8 x 8, for movies by label.
_SMALL = f"WITH {tables.EV}, pts AS (SELECT movie_id AS poly_id, pos, (event_id % 8)::DOUBLE AS x, (event_id * 7 // 8 % 8)::DOUBLE AS y, count(*) OVER (PARTITION BY movie_id) AS n FROM ev), edges AS (SELECT a.poly_id, a.pos, a.n, a.x, a.y, b.x AS nx, b.y AS ny FROM pts a JOIN pts b ON a.poly_id = b.poly_id AND b.pos = (a.pos + 1) % a.n)"


@query("g24_values_in_regions", _SMALL + tables.COVERED + ", " + tables.PX + """, m AS (SELECT p.*, e.label AS movie_id FROM px p JOIN embeddings e ON e.vec_id = p.frame)
SELECT m.movie_id, m.frame, c.poly_id, count(*) AS n, round(avg(px), 6) AS mean, max(px) AS max FROM m JOIN covered c ON c.poly_id % 10 = m.movie_id AND c.y = m.y AND c.x = m.x GROUP BY ALL""")
def values_in_regions(spark, d):
    from emberframe.operators import raster

    shapes = tables.polygons(spark, d, lambda i: i % 8, lambda i: F.floor(i * 7 / 8) % 8).select((F.col("poly_id") % 10).cast("int").alias("movie_id"), "poly_id", "pts")
    labels = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("movie_id"))
    return raster.region_values_of_frames(tables.rows_of_pixels(spark, d).join(labels, "frame"), shapes, 8, 8, decimals=6)


@query("g5_covered_pixels", _POINTS + tables.COVERED + "SELECT poly_id, y, x FROM covered")
def covered(spark, d):
    from emberframe.operators import raster

    return raster.covered(tables.polygons(spark, d), 100, 100)


@query("g6_pixel_counts", _POINTS + tables.COVERED + "SELECT poly_id, count(*) AS n FROM covered GROUP BY poly_id")
def pixel_counts(spark, d):
    from emberframe.operators import raster

    return raster.pixel_counts(tables.polygons(spark, d), 100, 100)
