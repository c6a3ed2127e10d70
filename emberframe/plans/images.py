"""Pixels: calibration steps and image operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from emberframe.functions import columns as c
from emberframe.functions import images
from emberframe.operators import frames as fr
from emberframe.operators import labels
from emberframe.plans.registry import query
from emberframe.plans.tables import BAD, PX, packed, pixels, read

W = f"WITH {PX} "


@query("pixels_view", W + "SELECT * FROM px")
def pixels_view(spark, d):
    return pixels(spark, d)


@query("p10_integration_time", W + "SELECT frame, y, x, (px * 7 & 57344) >> 13 AS ti, px * 7 & 8191 AS dl FROM px")
def integration_time(spark, d):
    v = F.col("px") * 7
    return pixels(spark, d).select("frame", "y", "x", c.integration_time(v).alias("ti"), c.digital_level(v).alias("dl"))


@query("c2_add_min_t", W + "SELECT frame, y, x, CASE WHEN y < 5 THEN (px + 62000) & 65535 ELSE px END AS px FROM px")
def add_min_t(spark, d):
    return pixels(spark, d).select("frame", "y", "x", c.add_min_t(F.col("px"), F.col("y"), 62000, 5).alias("px"))


@query("c8_emissivity", W + "SELECT frame, y, x, px, CASE WHEN x = y THEN 0.5 + x / 16.0 ELSE 1.0 END::DOUBLE AS e FROM px")
def emissivity(spark, d):
    table = spark.createDataFrame([(i, i, 0.5 + i / 16) for i in range(8)], "y int, x int, e double")
    return fr.emissivity(pixels(spark, d), table)


@query("c10_flip", W + "SELECT frame, 7 - y AS y, 7 - x AS x, px FROM px")
def flip(spark, d):
    return fr.flip(pixels(spark, d), 8, 8, True, True)


@query("k1_translate_nearest", W + "SELECT a.frame, a.y, a.x, b.px FROM px a JOIN px b ON a.frame = b.frame AND b.y = least(greatest(a.y + 1, 0), 7) AND b.x = least(greatest(a.x - 2, 0), 7)")
def translate(spark, d):
    return fr.translate_nearest(pixels(spark, d), 2, -1, 8, 8)


@query("k2_gaussian", W + """, t AS (SELECT a.frame, a.y, a.x, b.px, exp(-((b.y - a.y) ** 2 + (b.x - a.x) ** 2)::DOUBLE / (2 * 0.75 * 0.75)) AS k
  FROM px a JOIN px b ON a.frame = b.frame AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1)
SELECT frame, y, x, round(sum(k * px) / sum(k), 4) AS value FROM t GROUP BY 1, 2, 3""")
def gaussian(spark, d):
    return images.pixels_of(packed(spark, d), lambda img: images.gaussian(img, 0.75, np.float64), "double").select("frame", "y", "x", F.round("px", 4).alias("value"))


@query("k3_median_filter", W + """, t AS (SELECT a.frame, a.y, a.x, b.px FROM px a JOIN px b ON a.frame = b.frame AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
  WHERE CASE WHEN a.y IN (0, 7) THEN b.y = a.y WHEN a.x IN (0, 7) THEN b.x = a.x ELSE true END)
SELECT frame, y, x, CASE WHEN y IN (0, 7) AND x IN (0, 7) THEN min(px) ELSE quantile_disc(px, 0.5) END AS px FROM t GROUP BY frame, y, x""")
def median_filter(spark, d):
    return images.pixels_of(packed(spark, d), images.median3)


@query("k4_find_median_pixel", W + """, h AS (SELECT frame, px, count(*) AS n FROM px GROUP BY 1, 2),
u AS (SELECT frame, px, sum(n) OVER (PARTITION BY frame ORDER BY px) AS upto, sum(n) OVER (PARTITION BY frame) AS total FROM h)
SELECT frame, min(px) AS median FROM u WHERE upto >= round(total * 0.3) GROUP BY frame""")
def median_pixel(spark, d):
    return fr.median_pixel(pixels(spark, d), 0.3)


@query("k4_find_median_pixel_masked", W + """, h AS (SELECT frame, px, count(*) AS n FROM px WHERE (y + x) % 2 = 0 GROUP BY 1, 2),
u AS (SELECT frame, px, sum(n) OVER (PARTITION BY frame ORDER BY px) AS upto, sum(n) OVER (PARTITION BY frame) AS total FROM h)
SELECT frame, min(px) AS median FROM u WHERE upto >= round(total * 0.5) GROUP BY frame""")
def median_pixel_masked(spark, d):
    p = pixels(spark, d)
    mask = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x")).where((F.col("y") + F.col("x")) % 2 == 0)
    return fr.median_pixel(p, 0.5, F.broadcast(mask))  # as many rows as a frame has pixels


@query("k5_clamp_min", W + "SELECT frame, y, x, greatest(px, 4000) AS px FROM px")
def clamp(spark, d):
    return pixels(spark, d).select("frame", "y", "x", c.clamp_min(F.col("px"), 4000).alias("px"))


@query("k6_bad_pixels", BAD.format(k=1.5) + "SELECT * FROM bad")
def bad_pixels(spark, d):
    return images.bad_pixels_of(packed(spark, d), 1.5)


_LABEL_SQL = """WITH RECURSIVE """ + PX + """, fg AS (SELECT frame, y, x, y * 8 + x AS id FROM px WHERE px > 4200),
r(frame, id, root) AS (
  SELECT frame, id, id FROM fg
  UNION
  SELECT r.frame, b.id, r.root FROM r JOIN fg a ON a.frame = r.frame AND a.id = r.id JOIN fg b ON b.frame = a.frame AND abs(a.y - b.y) + abs(a.x - b.x) = 1
), c AS (SELECT frame, id, min(root) AS root FROM r GROUP BY 1, 2),
l AS (SELECT frame, root, count(*) AS area, (row_number() OVER (PARTITION BY frame ORDER BY root))::INTEGER AS label FROM c GROUP BY 1, 2) """


@query("k7_label_regions", _LABEL_SQL + "SELECT frame, label, (root % 8)::INTEGER AS first_x, (root // 8)::INTEGER AS first_y, area FROM l")
def label_regions(spark, d):
    return labels.regions(pixels(spark, d), 8, 8, 4200)


@query("k7_label_values", "WITH RECURSIVE " + PX + """, fg AS (SELECT frame, y, x, y * 8 + x AS id, px // 200 - 18 AS v FROM px WHERE px >= 3800),
r(frame, id, root) AS (
  SELECT frame, id, id FROM fg
  UNION
  SELECT r.frame, b.id, r.root FROM r JOIN fg a ON a.frame = r.frame AND a.id = r.id JOIN fg b ON b.frame = a.frame AND b.v = a.v AND abs(a.y - b.y) + abs(a.x - b.x) = 1
), c AS (SELECT frame, id, min(root) AS root FROM r GROUP BY 1, 2),
l AS (SELECT frame, root, count(*) AS area, (row_number() OVER (PARTITION BY frame ORDER BY root))::INTEGER AS label FROM c GROUP BY 1, 2)
SELECT l.frame, label, fg.v::INTEGER AS value, (root % 8)::INTEGER AS first_x, (root // 8)::INTEGER AS first_y, area FROM l JOIN fg ON fg.frame = l.frame AND fg.id = l.root""")
def label_values(spark, d):
    p = pixels(spark, d).select("frame", "y", "x", F.greatest(F.lit(0), F.floor(F.col("px") / 200) - 18).cast("int").alias("px"))
    return labels.value_regions(p, 8, 8)


@query("k8_keep_largest_area", _LABEL_SQL + """, b AS (SELECT frame, root FROM l QUALIFY row_number() OVER (PARTITION BY frame ORDER BY area DESC, label) = 1)
SELECT p.frame, p.y, p.x, CASE WHEN c.id IS NULL THEN 0 ELSE 7 END AS px FROM px p LEFT JOIN (SELECT c.* FROM c JOIN b USING (frame, root)) c ON c.frame = p.frame AND c.id = p.y * 8 + p.x""")
def keep_largest(spark, d):
    return labels.largest(pixels(spark, d), 8, 8, 4200, 0, 7)


@query("k13_frame_differences", W + """, l AS (SELECT *, lag(px) OVER (PARTITION BY y, x ORDER BY frame) AS b FROM px)
SELECT frame, round(stddev_samp(abs(px - b)), 6) AS std_diff, round(avg(px), 6) AS mean, max(px) AS max FROM l GROUP BY frame""")
def frame_differences(spark, d):
    return fr.frame_differences(pixels(spark, d))


@query("k14_background", W + """, h AS (SELECT frame, px >> 2 AS bin, count(*) AS n FROM px GROUP BY 1, 2)
SELECT frame, bin * 4 + 1 AS background FROM h QUALIFY row_number() OVER (PARTITION BY frame ORDER BY n DESC, bin) = 1""")
def background(spark, d):
    return fr.background(pixels(spark, d))


@query("k15_split_deviation", W + """, h AS (SELECT frame, px >> 2 AS bin, count(*) AS n FROM px GROUP BY 1, 2),
g AS (SELECT frame, bin * 4 + 1 AS bg FROM h QUALIFY row_number() OVER (PARTITION BY frame ORDER BY n DESC, bin) = 1),
l AS (SELECT *, lag(px) OVER (PARTITION BY y, x ORDER BY frame) AS b FROM px), e AS (SELECT frame, abs(px - b)::DOUBLE AS d, px > bg AS fore FROM l JOIN g USING (frame) WHERE b IS NOT NULL)
SELECT frame, round(coalesce(sqrt(sum(d) FILTER (NOT fore) ** 2 - sum(d * d) FILTER (NOT fore)) / nullif(count(*) FILTER (NOT fore), 0), 0), 6) AS background_dev,
  round(coalesce(sqrt(sum(d) FILTER (fore) ** 2 - sum(d * d) FILTER (fore)) / nullif(count(*) FILTER (fore), 0), 0), 6) AS foreground_dev FROM e GROUP BY frame""")
def split_deviation(spark, d):
    p = pixels(spark, d)
    return fr.split_deviation(p, fr.background(p))


#: Calibrations of movies by label: of parts, levels by key and temperatures as the cents that they cost up to there.
_TABLES = "k AS (SELECT (p_partkey % 10)::INTEGER AS movie_id, (p_partkey * 37 % 8192)::INTEGER AS dl, sum(round(p_retailprice * 100)::BIGINT)::BIGINT AS cents FROM part GROUP BY 1, 2), tab AS (SELECT movie_id, dl, sum(cents) OVER (PARTITION BY movie_id ORDER BY dl)::BIGINT / 1000.0::DOUBLE AS t FROM k)"


@query("c4_calibration_tables", "WITH " + PX + ", " + _TABLES + """, v AS (SELECT p.frame, p.y, p.x, e.label AS movie_id, p.px FROM px p JOIN embeddings e ON e.vec_id = p.frame),
a AS (SELECT v.*, s.dl AS d0, s.t AS t0 FROM v ASOF LEFT JOIN tab s ON v.movie_id = s.movie_id AND v.px >= s.dl), b AS (SELECT a.*, s.dl AS d1, s.t AS t1 FROM a ASOF LEFT JOIN tab s ON a.movie_id = s.movie_id AND a.px < s.dl),
w AS (SELECT *, CASE WHEN d0 IS NULL THEN t1 WHEN d1 IS NULL THEN t0 ELSE t0 + (t1 - t0) * ((px - d0)::DOUBLE / (d1 - d0)) END AS temperature FROM b),
c AS (SELECT w.*, s.dl AS e0, s.t AS u0 FROM w ASOF LEFT JOIN tab s ON w.movie_id = s.movie_id AND w.temperature >= s.t), d AS (SELECT c.*, s.dl AS e1, s.t AS u1 FROM c ASOF LEFT JOIN tab s ON c.movie_id = s.movie_id AND c.temperature < s.t)
SELECT frame, y, x, round(temperature, 6) AS temperature, floor(CASE WHEN e0 IS NULL THEN e1 WHEN e1 IS NULL THEN e0 ELSE e0 + (e1 - e0) * ((temperature - u0) / (u1 - u0)) END + 0.5)::INTEGER AS level FROM d""")
def calibration_tables(spark, d):
    from pyspark.sql import Window

    from emberframe.operators import calibration

    part = read(spark, d, "part").groupBy((F.col("p_partkey") % 10).cast("int").alias("movie_id"), (F.col("p_partkey") * 37 % 8192).cast("int").alias("dl")).agg(F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("cents"))
    table = part.select("movie_id", F.lit(0).alias("ti"), "dl", (F.sum("cents").over(Window.partitionBy("movie_id").orderBy("dl")) / F.lit(1000.0)).alias("t"))
    tables = calibration.lookups(table)
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("movie_id"))
    warm = calibration.of_pixels(pixels(spark, d).join(labels, "frame"), tables)
    return calibration.to_levels(warm, tables).select("frame", "y", "x", F.round("temperature", 6).alias("temperature"), "level")


@query("t7_running_average", W + "SELECT frame, y, x, (sum(px) OVER w // count(px) OVER w)::BIGINT AS mean FROM px WINDOW w AS (PARTITION BY y, x ORDER BY frame ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)")
def running_average(spark, d):
    return fr.running_average(pixels(spark, d), 32)
