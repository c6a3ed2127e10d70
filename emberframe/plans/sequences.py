"""Time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.operators import series as sr
from emberframe.plans.registry import query
from emberframe.plans.tables import EV, SERIES, events, series

W = f"WITH {SERIES} "
#: Series with repeated times: days of users' events.
DAYS = f"WITH {EV}, days AS (SELECT movie_id AS series_id, floor(t / 86400000000)::DOUBLE AS t FROM ev), k AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id, t ORDER BY t) AS again FROM days) "


def _days(spark, d):
    return events(spark, d).select(F.col("movie_id").alias("series_id"), F.floor(F.col("t") / 86_400_000_000).cast("double").alias("t"))


@query("t1_extract_times_union", DAYS + "SELECT t FROM (SELECT DISTINCT t, again FROM k)")
def union(spark, d):
    return sr.extract_times(_days(spark, d))


@query("t2_extract_times_inter", DAYS + ", b AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(t) AS a, max(t) AS b FROM days GROUP BY series_id)) SELECT t FROM (SELECT DISTINCT t, again FROM k, b WHERE t BETWEEN a AND b)")
def intersection(spark, d):
    return sr.extract_times(_days(spark, d), sr.Strategy.INTERSECTION)


#: The same with every 13th event without a time; such an event ends a vector.
SPLIT = f"WITH {EV}, days AS (SELECT movie_id AS series_id, pos, CASE WHEN event_id % 13 = 0 THEN NULL ELSE floor(t / 86400000000)::DOUBLE END AS t FROM ev), parts AS (SELECT *, count(*) FILTER (t IS NULL) OVER (PARTITION BY series_id ORDER BY pos) AS part FROM days), k AS (SELECT t, row_number() OVER (PARTITION BY series_id, part, t ORDER BY t) AS again FROM parts WHERE t IS NOT NULL) "


@query("t3_times_of_split_vectors", SPLIT + "SELECT t FROM (SELECT DISTINCT t, again FROM k)")
def split_vectors(spark, d):
    t = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.floor(F.col("t") / 86_400_000_000).cast("double"))
    return sr.extract_times(events(spark, d).select(F.col("movie_id").alias("series_id"), "pos", t.alias("t")), order="pos", width=64)


@query("t7_running_average_resets", f"WITH {EV}, v AS (SELECT movie_id, pos, event_id % 1000 AS v, event_type = (SELECT min(event_type) FROM events) AS reset FROM ev), r AS (SELECT *, max(pos) FILTER (reset) OVER (PARTITION BY movie_id ORDER BY pos) AS at FROM v), j AS (SELECT a.movie_id, a.pos, CASE WHEN b.pos < a.at THEN c.v ELSE b.v END AS v FROM r a JOIN v b ON a.movie_id = b.movie_id AND b.pos BETWEEN a.pos - 4 AND a.pos LEFT JOIN v c ON c.movie_id = a.movie_id AND c.pos = a.at) SELECT movie_id, pos, sum(v)::BIGINT // count(*) AS mean FROM j GROUP BY movie_id, pos")
def average_with_resets(spark, d):
    from emberframe.operators import frames as fr

    e = events(spark, d)
    least = e.agg(F.min("event_type")).first()[0]
    own = e.select("movie_id", "pos", (F.col("event_id") % 1000).cast("long").alias("v"), (F.col("event_type") == least).alias("reset"))
    return fr.running_average_with_resets(own, 5, "v", F.col("reset"), width=64).select("movie_id", "pos", "mean")


_NEAR = W + """, grid AS (SELECT DISTINCT s.series_id, g.t FROM (SELECT DISTINCT series_id FROM series) s, (SELECT floor(t / 10000) * 10000 AS t FROM series) g),
p AS (SELECT g.series_id, g.t, s.t AS pt, s.v AS pv FROM grid g ASOF LEFT JOIN series s ON g.series_id = s.series_id AND g.t >= s.t),
n AS (SELECT g.series_id, g.t, s.t AS nt, s.v AS nv FROM grid g ASOF LEFT JOIN series s ON g.series_id = s.series_id AND g.t <= s.t), b AS (SELECT * FROM p JOIN n USING (series_id, t)) """


#: Seconds of a series that go to one task.
RANGE = 86_400.0


def _grid(spark, d):
    s = series(spark, d)
    t = s.select((F.floor(F.col("t") / 10000) * 10000).cast("double").alias("t")).distinct()
    # every series at every time, as the query asks: both sides are distinct values, dealt by a salt of the times
    salts = 64
    ids = s.select("series_id").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return t.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(salts)).cast("int")).join(ids, "salt").select("series_id", "t")


@query("t4_resample_linear", _NEAR + "SELECT series_id, t, round(CASE WHEN pt IS NULL OR nt IS NULL THEN coalesce(pv, nv) WHEN pt = t THEN pv ELSE nv * ((t - pt) / (nt - pt)) + (1 - (t - pt) / (nt - pt)) * pv END, 6) AS v FROM b")
def linear(spark, d):
    return sr.resample(series(spark, d), _grid(spark, d), width=RANGE).withColumn("v", F.round("v", 6))


@query("t4_resample_nearest", _NEAR + "SELECT series_id, t, CASE WHEN pt IS NULL OR nt IS NULL THEN 0.0 WHEN pt = t THEN pv WHEN t - pt < nt - t THEN pv ELSE nv END::DOUBLE AS v FROM b")
def nearest(spark, d):
    return sr.resample(series(spark, d), _grid(spark, d), pad=0.0, interpolate=False, width=RANGE)


@query("t5_resample_pair", W + """, a AS (SELECT * FROM series WHERE series_id = (SELECT min(series_id) FROM series)), b AS (SELECT * FROM series WHERE series_id = (SELECT max(series_id) FROM series)),
e AS (SELECT greatest((SELECT min(t) FROM a), (SELECT min(t) FROM b)) AS lo, least((SELECT max(t) FROM a), (SELECT max(t) FROM b)) AS hi),
g AS (SELECT DISTINCT t FROM (SELECT t FROM a UNION ALL SELECT t FROM b), e WHERE t BETWEEN lo AND hi), two AS (SELECT 0 AS k, t, v FROM a UNION ALL SELECT 1, t, v FROM b), q AS (SELECT k, t FROM g, (VALUES (0), (1)) x(k)),
p AS (SELECT q.k, q.t, s.t AS pt, s.v AS pv FROM q ASOF LEFT JOIN two s ON q.k = s.k AND q.t >= s.t), n AS (SELECT q.k, q.t, s.t AS nt, s.v AS nv FROM q ASOF LEFT JOIN two s ON q.k = s.k AND q.t <= s.t),
r AS (SELECT k, t, CASE WHEN pt IS NULL OR nt IS NULL THEN coalesce(pv, nv) WHEN pt = t THEN pv ELSE nv * ((t - pt) / (nt - pt)) + (1 - (t - pt) / (nt - pt)) * pv END AS v FROM p JOIN n USING (k, t))
SELECT t, round(max(v) FILTER (k = 0), 6) AS a, round(max(v) FILTER (k = 1), 6) AS b FROM r GROUP BY t""")
def pair(spark, d):
    s = series(spark, d)
    ends = s.agg(F.min("series_id"), F.max("series_id")).first()
    a, b = (s.where(F.col("series_id") == x).drop("series_id") for x in ends)
    out = sr.resample_pair(a, b, sr.Strategy.INTERSECTION | sr.Strategy.INTERPOLATION, RANGE)
    return out.select("t", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))
