"""Random access, metadata, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.functions import columns as c
from emberframe.operators import frames as fr
from emberframe.plans.registry import query
from emberframe.plans.tables import EV, events, read

W = f"WITH {EV} "


@query("p1_load_pos", W + "SELECT movie_id, pos, event_id FROM ev WHERE pos = 5")
def load_pos(spark, d):
    return fr.at_position(events(spark, d), 5, 1 << 31).select("movie_id", "pos", "event_id")


@query("p2_frame_slice", W + "SELECT movie_id, pos, event_id FROM ev WHERE pos >= 3 AND pos < 40 AND (pos - 3) % 4 = 0")
def frame_slice(spark, d):
    return fr.slice_frames(events(spark, d), 1000, 3, 40, 4).select("movie_id", "pos", "event_id")


@query("p3_fancy_index", W + "SELECT movie_id, nr, pos, event_id FROM ev JOIN (VALUES (0, 7), (1, 2), (2, 2), (3, 11)) v(nr, pos) USING (pos)")
def fancy_index(spark, d):
    return fr.at_positions(events(spark, d), [7, 2, 2, 11]).select("movie_id", "nr", "pos", "event_id")


@query("p4_nearest_frame", W + """, probes AS (SELECT DISTINCT movie_id, t + 1800000000 AS t FROM ev), one AS (SELECT movie_id, t, min(pos) AS pos FROM ev GROUP BY 1, 2)
SELECT movie_id, t, pos FROM (
  SELECT p.movie_id, p.t, o.pos, row_number() OVER (PARTITION BY p.movie_id, p.t ORDER BY abs(o.t - p.t), o.pos) AS r FROM probes p JOIN one o USING (movie_id)
) WHERE r = 1""")
def nearest_frame(spark, d):
    e = events(spark, d).select("movie_id", "t", "pos")
    return fr.nearest(e, e.select("movie_id", (F.col("t") + 1_800_000_000).alias("t")).distinct())


@query("p5_frame_count", W + "SELECT movie_id, count(*) AS n_frames, max(pos) + 1 AS length FROM ev GROUP BY movie_id")
def frame_count(spark, d):
    return events(spark, d).groupBy("movie_id").agg(F.count("*").alias("n_frames"), (F.max("pos") + 1).alias("length"))


@query("p6_image_size", "SELECT vec_id AS movie_id, 8 AS width, (len(embedding) // 8)::INTEGER AS height FROM embeddings")
def image_size(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("movie_id"), F.lit(8).alias("width"), F.expr("cast(size(embedding) div 8 as int)").alias("height"))


@query("p7_timestamps", W + "SELECT movie_id, pos, round(ts_ns * 1e-9, 6) AS seconds FROM ev")
def timestamps(spark, d):
    return events(spark, d).select("movie_id", "pos", F.round(F.col("ts_ns") * 1e-9, 6).alias("seconds"))


@query("p8_frame_period", W + ", g AS (SELECT movie_id, ts_ns - lag(ts_ns) OVER (PARTITION BY movie_id ORDER BY pos) AS gap FROM ev) SELECT movie_id, round(avg(gap) / 1e9, 6) AS frame_period_s FROM g GROUP BY movie_id")
def frame_period(spark, d):
    return fr.frame_period(events(spark, d)).select("movie_id", F.round(F.col("frame_period") / 1e9, 6).alias("frame_period_s"))


@query("p9_duration", W + "SELECT movie_id, round((arg_max(ts_ns, pos) - arg_min(ts_ns, pos)) * 1e-9, 6) AS duration FROM ev GROUP BY movie_id")
def duration(spark, d):
    return fr.duration(events(spark, d)).select("movie_id", F.round("duration", 6).alias("duration"))


@query("p11_frame_attributes_wide", W + "SELECT movie_id, pos, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM ev")
def attributes_wide(spark, d):
    return fr.attributes_wide(events(spark, d), ["k", "missing"])


@query("p12_frame_attribute", W + "SELECT movie_id, pos, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM ev WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL")
def attribute(spark, d):
    return fr.attribute(events(spark, d), "k")


@query("p14_is_uncompressed", "SELECT l_orderkey, l_linenumber, (l_partkey * 2 + 1024 = l_partkey * 1 * 1 * 2 + 1024 AND l_linenumber < 4) AS plain FROM lineitem")
def uncompressed(spark, d):
    t = read(spark, d, "lineitem")
    size = F.when(F.col("l_linenumber") < 4, F.col("l_partkey") * 2 + 1024).otherwise(F.lit(0))
    return t.select("l_orderkey", "l_linenumber", c.is_uncompressed(size, F.col("l_partkey"), F.lit(1), F.lit(1)).alias("plain"))


@query("p15_attribute_cleanup", """WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'b''' || event_type || '''' WHEN 1 THEN event_type ELSE 'b' || event_type END AS said FROM events)
SELECT event_id, CASE WHEN starts_with(said, 'b''') AND ends_with(said, '''') THEN said[3:-2] ELSE said END AS cleaned FROM s""")
def cleanup(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("b'"), "event_type", F.lit("'"))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat(F.lit("b"), "event_type"))
    return read(spark, d, "events").select("event_id", c.unwrap_bytes_literal(said).alias("cleaned"))


@query("io8_time_units", """WITH t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 29000 WHEN o_orderkey % 3 = 1 THEN 29000000000 ELSE 5000000000 END AS t0 FROM orders)
SELECT o_orderkey, CASE WHEN t0 = 29000 THEN (t0 + o_custkey) * 1000000 - 32000000000 WHEN t0 = 29000000000 THEN t0 + o_custkey - 32000000000 ELSE t0 + o_custkey END AS ts_ns FROM t""")
def time_units(spark, d):
    t = read(spark, d, "orders").withColumn("t0", F.when(F.col("o_orderkey") % 3 == 0, 29000).when(F.col("o_orderkey") % 3 == 1, 29_000_000_000).otherwise(5_000_000_000).cast("long"))
    return t.select("o_orderkey", c.fix_time_unit(F.col("t0"), F.col("t0") + F.col("o_custkey"), F.lit(False)).alias("ts_ns"))


@query("io17_filter_wheel_positions", W + """, w AS (SELECT movie_id, pos, event_type AS fw, row_number() OVER (PARTITION BY movie_id, event_type ORDER BY pos) AS again FROM ev),
r AS (SELECT movie_id, coalesce(min(pos) FILTER (WHERE again > 1), 1000000000) AS stop FROM w GROUP BY movie_id)
SELECT w.movie_id, w.pos, w.fw FROM w JOIN r USING (movie_id) WHERE w.pos < r.stop""")
def filter_wheel(spark, d):
    from pyspark.sql import Window

    w = events(spark, d).select("movie_id", "pos", F.col("event_type").alias("fw"))
    w = w.withColumn("again", F.row_number().over(Window.partitionBy("movie_id", "fw").orderBy("pos")))
    stop = F.min(F.when(F.col("again") > 1, F.col("pos"))).over(Window.partitionBy("movie_id"))
    return w.withColumn("stop", stop).where("stop is null or pos < stop").select("movie_id", "pos", "fw")


@query("io23_export_range", W + "SELECT movie_id, pos, ts_ns FROM ev WHERE pos >= 10 AND pos < 25")
def export_range(spark, d):
    return events(spark, d).where("pos >= 10 and pos < 25").select("movie_id", "pos", "ts_ns")


@query("io25_split_chunks", W + ", n AS (SELECT movie_id, count(*) AS n FROM ev GROUP BY 1) SELECT movie_id, pos, (pos // 30)::INTEGER AS chunk, (pos % 30)::BIGINT * 20000000 AS ts_ns FROM ev JOIN n USING (movie_id) WHERE (pos // 30 + 1) * 30 <= n")
def split_chunks(spark, d):
    e = events(spark, d)
    return fr.chunks(e, 30, e.groupBy("movie_id").agg(F.count("*").alias("n")))
