"""Expressions over polygons, arrays of points (x, y): convex hulls, least boxes, corners. Each polygon is one row; nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe.functions.columns import open_polygon

POINT = "struct<x:double,y:double>"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _turned(p: Column, by: int) -> Column:
    """Each point's next one, or for -1 the one before, around the ring."""
    head, tail = (F.slice(p, 1, 1), F.slice(p, F.lit(2), F.size(p))) if by > 0 else (F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, -1, 1))
    return F.concat(tail, head)


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _chain(sorted_points: Column) -> Column:
    """Half a hull, without its last point: what a new point leaves of the chain before it is where the chain turns left to it; as the
    chain itself turns left everywhere, that is its beginning."""

    def step(chain: Column, a: Column) -> Column:
        left = F.filter(chain, lambda q, i: (i < 1) | (_cross(F.get(chain, i - 1), q, a) > 0))
        return F.concat(left, F.array(a))

    whole = F.aggregate(sorted_points, F.array().cast(f"array<{POINT}>"), step)
    return F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0)))


def convex_hull(p: Column) -> Column:
    """Closed, from the first point of greatest y on; collinear points are left out. Fewer than three points stay as they are."""
    place = lambda ys: F.array_position(ys, F.array_max(ys)).cast("int")
    from_top = lambda ring: let(let(F.transform(ring, lambda a: a["y"]), place), lambda top: F.concat(F.slice(ring, top, F.size(ring)), F.slice(ring, F.lit(1), top - 1), F.slice(ring, top, F.lit(1))))
    of = lambda own: F.when(F.size(own) < 3, F.concat(own, F.slice(own, 1, 1))).otherwise(let(F.concat(_chain(own), _chain(F.reverse(own))), from_top))
    points = F.transform(p, lambda a: F.struct(a["x"].cast("double").alias("x"), a["y"].cast("double").alias("y")))
    return F.when(F.size(p) < 3, points).otherwise(let(F.array_sort(F.array_distinct(points)), of))


def minimum_area_box(hull: Column, decimals: int | None = None) -> Column:
    """As _box, of a hull that is worked out once."""
    return let(hull, lambda own: _box(own, decimals))


_BOX = ("cx", "cy", "width", "height", "width_angle", "height_angle")


def _box(hull: Column, decimals: int | None) -> Column:
    """cx, cy, width <= height, and the angles (radians) of both sides of the least box around a hull as from convex_hull; zeros for no
    points. One of its sides is along a side of the hull; of sides that give equal boxes the first one's.

    decimals: areas that are equal to so many are ties; then the box counts that has the least angle, in (-pi, pi], of a line from one
    corner of the hull to another along or across it."""
    ends = F.when(F.size(hull) > 1, F.slice(hull, F.lit(2), F.size(hull))).otherwise(hull)
    sides = F.zip_with(F.slice(hull, F.lit(1), F.size(ends)), ends, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    boxes = F.transform(sides, lambda d: _around(hull, d, decimals))
    if decimals is None:
        kind = "struct<" + ",".join(f"{k}:double" for k in ("area", "x", "y", *_BOX)) + ">"
        less = lambda best, b: F.when(best.isNull() | (b["area"] < best["area"] - 1e-12), b).otherwise(best)
        found = F.aggregate(boxes, F.lit(None).cast(kind), less)
    else:
        least = lambda of: F.array_min(F.transform(of, lambda b: b["area"]))
        tied = lambda of: let(least(of), lambda m: F.filter(of, lambda b: b["area"] <= m))
        ranked = lambda of: F.transform(of, lambda b: F.struct(_least_angle(hull, b["x"], b["y"]).alias("angle"), b.alias("b")))
        found = let(let(boxes, tied), lambda of: F.when(F.size(of) < 2, F.get(of, 0)).otherwise(F.array_min(ranked(of))["b"]))
    return let(found, lambda b: F.struct(*[F.coalesce(b[k], F.lit(0.0)).alias(k) for k in _BOX]))


def _least_angle(hull: Column, x: Column, y: Column) -> Column:
    """Of lines between corners of a hull, along or across (x, y) in either direction, the least angle."""
    across = lambda a, b: (b["x"] - a["x"]) * x + (b["y"] - a["y"]) * y
    along = lambda a, b: (b["x"] - a["x"]) * y - (b["y"] - a["y"]) * x
    scale = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]) * F.hypot(x, y)
    on = lambda a, b: ((a["x"] != b["x"]) | (a["y"] != b["y"])) & (F.least(F.abs(across(a, b)), F.abs(along(a, b))) <= 1e-12 * scale(a, b))
    return F.array_min(F.transform(hull, lambda a: F.array_min(F.transform(F.filter(hull, lambda b: on(a, b)), lambda b: F.atan2(b["y"] - a["y"], b["x"] - a["x"])))))


def _around(hull: Column, d: Column, decimals: int | None) -> Column:
    """The box around a hull along d, and its area, rounded to decimals."""

    def box(angle: Column) -> Column:
        turn = F.struct(F.cos(angle).alias("c"), F.sin(angle).alias("s"))
        sides_of = lambda t: F.struct(F.transform(hull, lambda a: a["x"] * t["c"] + a["y"] * t["s"]).alias("u"), F.transform(hull, lambda a: a["y"] * t["c"] - a["x"] * t["s"]).alias("v"), t["c"].alias("c"), t["s"].alias("s"))
        ends_of = lambda q: F.struct(F.array_min(q["u"]).alias("u0"), F.array_max(q["u"]).alias("u1"), F.array_min(q["v"]).alias("v0"), F.array_max(q["v"]).alias("v1"), q["c"].alias("c"), q["s"].alias("s"))
        return let(let(let(turn, sides_of), ends_of), lambda e: _told(e, angle))

    def _told(e: Column, angle: Column) -> Column:
        c, s, w, h = e["c"], e["s"], e["u1"] - e["u0"], e["v1"] - e["v0"]
        mu, mv = (e["u1"] + e["u0"]) / 2, (e["v1"] + e["v0"]) / 2
        along = F.when(w >= h, -angle).otherwise(F.lit(math.pi / 2) - angle)
        return F.struct(
            (w * h if decimals is None else F.round(w * h, decimals)).alias("area"), d["x"].alias("x"), d["y"].alias("y"),
            (mu * c - mv * s).alias("cx"), (mu * s + mv * c).alias("cy"), F.least(w, h).alias("width"), F.greatest(w, h).alias("height"), (along - F.lit(math.pi / 2)).alias("width_angle"), along.alias("height_angle")
        )

    return let(F.atan2(d["y"], d["x"]), box)


def without_collinear(p: Column) -> Column:
    """Points at which the direction changes; fewer than three stay as they are."""
    three = F.arrays_zip(_turned(p, -1).alias("a"), p.alias("p"), _turned(p, 1).alias("b"))
    long = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    corner = lambda z: F.abs(_cross(z["a"], z["p"], z["b"])) > 1e-12 * F.greatest(long(z["a"], z["p"]) * long(z["p"], z["b"]), F.lit(1e-300))
    return F.when(F.size(p) < 3, p).otherwise(F.transform(F.filter(three, corner), lambda z: z["p"]))


def is_non_concave(p: Column) -> Column:
    """Whether the turning angles add up to one turn in one direction."""
    return let(open_polygon(p), _turns_once)


def _turns_once(ring: Column) -> Column:
    steps = F.filter(F.zip_with(ring, _turned(ring, 1), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y"))), lambda d: (d["x"] != 0) | (d["y"] != 0))
    turns_of = lambda s: F.zip_with(s, _turned(s, 1), lambda d, e: F.atan2(d["x"] * e["y"] - d["y"] * e["x"], d["x"] * e["x"] + d["y"] * e["y"]))
    one_way = lambda t: F.forall(t, lambda a: a >= -1e-12) | F.forall(t, lambda a: a <= 1e-12)
    one_turn = lambda t: F.abs(F.abs(F.aggregate(t, F.lit(0.0), lambda s, a: s + a)) - 2 * math.pi) < 1e-6
    return (F.size(ring) >= 3) & let(let(steps, turns_of), lambda t: one_way(t) & one_turn(t))
