"""Column builders: pixel words, text helpers, polygon arithmetic. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- pixel words: 13 bits of digital level, 3 bits of integration time


def digital_level(v: Column) -> Column:
    return v.bitwiseAND(8191)


def integration_time(v: Column) -> Column:
    return F.shiftright(v.bitwiseAND(57344), 13)


def add_min_t(v: Column, y: Column, min_t: int, min_t_height: int) -> Column:
    """Adds min_t back to the first rows, in 16 bits; nothing if either is zero."""
    if not min_t or not min_t_height:
        return v
    return F.when(y < min_t_height, (v + min_t).bitwiseAND(65535)).otherwise(v)


def clamp_min(v: Column, least: int) -> Column:
    return F.greatest(v, F.lit(least))


def is_uncompressed(size: Column, n: Column, w: Column, h: Column) -> Column:
    return size == n * w * h * 2 + 1024


def unwrap_bytes_literal(s: Column) -> Column:
    """b'..' becomes .. ; everything else stays."""
    return F.regexp_replace(s, "^b'(.*)'$", "$1")


def fix_time_unit(t0: Column, t: Column, every_close: Column) -> Column:
    """Nanoseconds from milliseconds or nanoseconds, and without the trigger's offset of 32 s."""
    ns = F.when(((t0 > 28000) & (t0 < 32000)) | every_close, t * 1_000_000).otherwise(t)
    first = F.when(((t0 > 28000) & (t0 < 32000)) | every_close, t0 * 1_000_000).otherwise(t0)
    return F.when((first > 28_000_000_000) & (first < 32_000_000_000), ns - 32_000_000_000).otherwise(ns)


# --- text


def count_substring(s: Column, needle: str) -> Column:
    if not needle:
        return F.lit(0)
    return ((F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def split_text(s: Column, separator: str, keep_empty: bool = False) -> Column:
    """At a literal separator; without empty pieces unless kept."""
    out = F.split(s, "\\Q" + separator + "\\E")
    return out if keep_empty else F.filter(out, lambda x: x != "")


def find_case_insensitive(s: Column, needle: str, start: int = 0) -> Column:
    """First index from start, or -1."""
    return F.locate(needle.lower(), F.lower(s), start + 1) - 1


def to_number(s: Column) -> Column:
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def binary32(v: Column, size: int) -> Column:
    return F.right(F.lpad(F.bin(v), 32, "0"), F.lit(size))


def compress_bound(n: Column) -> Column:
    """Worst case of a zstd frame."""
    return n + F.shiftright(n, 8) + F.when(n < 131072, F.shiftright(131072 - n, 11)).otherwise(F.lit(0))


# --- polygons: array<struct<x:double,y:double>>


def _next(p: Column) -> Column:
    return F.concat(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def _cross(p: Column) -> Column:
    return F.zip_with(p, _next(p), lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])


def signed_area(p: Column) -> Column:
    return F.aggregate(_cross(p), F.lit(0.0), lambda s, x: s + x) / 2


def area(p: Column) -> Column:
    return F.abs(signed_area(p))


def is_clockwise(p: Column) -> Column:
    return signed_area(p) < 0


def reverse_polygon(p: Column) -> Column:
    return F.reverse(p)


def orient(p: Column, clockwise: bool) -> Column:
    return F.when(is_clockwise(p) == F.lit(clockwise), p).otherwise(F.reverse(p))


def reorder(p: Column, start: Column) -> Column:
    """The same ring from index start on."""
    return F.concat(F.slice(p, start + 1, F.size(p)), F.when(start > 0, F.slice(p, F.lit(1), start)).otherwise(F.slice(p, 1, 0)))


def close_polygon(p: Column) -> Column:
    return F.when(F.size(p) == 0, p).when(F.element_at(p, -1) == F.get(p, 0), p).otherwise(F.concat(p, F.slice(p, 1, 1)))


def open_polygon(p: Column) -> Column:
    return F.when((F.size(p) > 1) & (F.element_at(p, -1) == F.get(p, 0)), F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)


def without_consecutive_duplicates(p: Column) -> Column:
    pairs = F.arrays_zip(p.alias("own"), F.concat(F.array(F.lit(None).cast("struct<x:double,y:double>")), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))).alias("before"))
    return F.when(F.size(p) == 0, p).otherwise(F.transform(F.filter(pairs, lambda z: z["before"].isNull() | (z["own"] != z["before"])), lambda z: z["own"]))


def round_polygon(p: Column) -> Column:
    return F.transform(p, lambda a: F.struct(F.round(a["x"]).alias("x"), F.round(a["y"]).alias("y")))


def is_rect(p: Column) -> Column:
    return (F.size(F.array_distinct(F.transform(p, lambda a: a["x"]))) <= 2) & (F.size(F.array_distinct(F.transform(p, lambda a: a["y"]))) <= 2)


def centroid(p: Column) -> Column:
    """Weighted by the unsigned area; null where that is zero."""
    both = F.zip_with(p, _next(p), lambda a, b: F.struct(((a["x"] + b["x"]) * (a["x"] * b["y"] - a["y"] * b["x"])).alias("x"), ((a["y"] + b["y"]) * (a["x"] * b["y"] - a["y"] * b["x"])).alias("y")))
    total = F.aggregate(both, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, v: F.struct((s["x"] + v["x"]).alias("x"), (s["y"] + v["y"]).alias("y")))
    return F.struct(F.try_divide(total["x"], 6 * area(p)).alias("x"), F.try_divide(total["y"], 6 * area(p)).alias("y"))


def bounding_rect(p: Column) -> Column:
    x, y = F.transform(p, lambda a: a["x"]), F.transform(p, lambda a: a["y"])
    return F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("top"), F.array_max(x).alias("right"), F.array_max(y).alias("bottom"))


def distance_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n)))
    return F.sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)


def line_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees counter-clockwise in [0, 360), with y downwards."""
    a = F.degrees(F.atan2(-(y2 - y1), x2 - x1))
    return F.when(a < 0, a + 360).otherwise(a)


def fuzzy_compare(a: Column, b: Column) -> Column:
    return F.abs(a - b) * 1e12 <= F.least(F.abs(a), F.abs(b))


def tolerance_compare(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two numbers differ by no more than a share of the greater one."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * tolerance


def angle_to(first: Column, second: Column) -> Column:
    """Degrees counter-clockwise in [0, 360) to add to the first line's angle for the second one's; lines are (x1, y1, x2, y2), and
    0 for one without length."""
    flat = lambda s: (s["x1"] == s["x2"]) & (s["y1"] == s["y2"])
    d = line_angle(second["x1"], second["y1"], second["x2"], second["y2"]) - line_angle(first["x1"], first["y1"], first["x2"], first["y2"])
    d = F.when(d < 0, d + 360).otherwise(d)
    return F.when(flat(first) | flat(second) | (d >= 360), F.lit(0.0)).otherwise(d)


def rect_contains(r: Column, x: Column, y: Column) -> Column:
    """Left and top belong to a rectangle, right and bottom don't."""
    return (x >= r["left"]) & (x < r["right"]) & (y >= r["top"]) & (y < r["bottom"])


def rect_intersection(a: Column, b: Column) -> Column:
    """What both cover; null where they don't meet."""
    out = F.struct(*[f(a[c], b[c]).alias(c) for f, c in ((F.greatest, "left"), (F.greatest, "top"), (F.least, "right"), (F.least, "bottom"))])
    return F.when((out["left"] < out["right"]) & (out["top"] < out["bottom"]), out)


def rect_union(a: Column, b: Column) -> Column:
    """The least rectangle around both; an empty one doesn't count."""
    empty = lambda r: (r["right"] <= r["left"]) | (r["bottom"] <= r["top"])
    out = F.struct(*[f(a[c], b[c]).alias(c) for f, c in ((F.least, "left"), (F.least, "top"), (F.greatest, "right"), (F.greatest, "bottom"))])
    return F.when(empty(a), b).when(empty(b), a).otherwise(out)


def matrix_inverse(m: Column) -> Column:
    """Of 2 x 2 matrices (m11, m12, m21, m22); null where the determinant is 1e-12 at most."""
    det = m["m11"] * m["m22"] - m["m12"] * m["m21"]
    return F.when(F.abs(det) > 1e-12, F.struct((m["m22"] / det).alias("m11"), (-m["m12"] / det).alias("m12"), (-m["m21"] / det).alias("m21"), (m["m11"] / det).alias("m22")))
