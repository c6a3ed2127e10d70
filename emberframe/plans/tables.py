"""The given tables as movies, pixels, series and polygons; and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators import frames as fr

SIDE = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames of 8 x 8 words of 13 bits."""
    value = F.floor((F.col("v").cast("double") + 1.0) * 4096.0).cast("int")
    return fr.pixels_of(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIDE, value)


def rows_of_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as rows: frame, px, an array line by line."""
    own = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 4096.0).cast("int"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), own.alias("px"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames, packed: frame, h, w, px."""
    from emberframe.functions import images

    return images.pack(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIDE, 4096.0, 1.0)


PX = """px AS (
  SELECT vec_id AS frame, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, floor((v::DOUBLE + 1.0) * 4096.0)::INTEGER AS px
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
)"""


#: Bad pixels beyond k deviations, with the medians m of frames.
BAD = "WITH " + PX + """, g AS (SELECT frame, list_sort(list(px)) AS s FROM px GROUP BY frame), m AS (SELECT frame, s[len(s) // 2 + 1] AS m, s FROM g),
f AS (SELECT frame, greatest(0, m - trunc({k} * sqrt(list_avg(list_transform(s, lambda v: ((v - m) ** 2)::DOUBLE))))::INTEGER) AS floor FROM m),
n AS (SELECT a.frame, a.y, a.x, a.px, list_sort(list(b.px)) AS v FROM px a JOIN px b ON a.frame = b.frame AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY a.frame, a.y, a.x, a.px),
s AS (SELECT frame, y, x, px, v[len(v) // 2 + 1] AS med, v[len(v) // 5 + 1 : len(v) * 4 // 5] AS inner_v FROM n),
d AS (SELECT *, sqrt(list_avg(list_transform(inner_v, lambda q: ((q - med) ** 2)::DOUBLE))) AS dev FROM s),
bad AS (SELECT frame, y, x FROM d JOIN f USING (frame) WHERE px < med - {k} * dev OR px > med + {k} * dev OR px < floor) """


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: a movie for each user, positions by time."""
    from pyspark.sql import Window

    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("movie_id"), pos.alias("pos"), (ts * 1000).alias("ts_ns"), ts.alias("t"), "event_id", "event_type", "value", F.from_json("props", "map<string,string>").alias("attrs"))


EV = """ev AS (
  SELECT user_id AS movie_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS pos, epoch_us(ts) * 1000 AS ts_ns, epoch_us(ts) AS t,
         event_id, event_type, value, props FROM events
)"""


def polygons(spark: SparkSession, sf_dir: str, x=lambda i: i % 97, y=lambda i: i * 7 % 89) -> DataFrame:
    """A polygon for each user, of points made from the ids of all events, in the order of time. Work goes by points and not by their few bytes, so
    partitions are as many as the session says, and not merged by bytes."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("poly_id"), "ts", "event_id")
    dealt = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "poly_id")
    g = dealt.groupBy("poly_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("p"))
    place = lambda a: F.struct(x(a["event_id"]).cast("double").alias("x"), y(a["event_id"]).cast("double").alias("y"))
    return g.select("poly_id", F.transform("p", place).alias("pts"))


POINTS = f"""{EV}, pts AS (
  SELECT movie_id AS poly_id, pos, (event_id % 97)::DOUBLE AS x, (event_id * 7 % 89)::DOUBLE AS y, count(*) OVER (PARTITION BY movie_id) AS n FROM ev
), edges AS (
  SELECT a.poly_id, a.pos, a.n, a.x AS x, a.y AS y, b.x AS nx, b.y AS ny FROM pts a JOIN pts b ON a.poly_id = b.poly_id AND b.pos = (a.pos + 1) % a.n
)"""


#: Pixels of 100 x 100 that polygons of three points or more cover: crossings by row, in pairs; each once on the first row.
COVERED = """, box AS (SELECT poly_id, min(x)::INTEGER AS l, max(x)::INTEGER AS r, min(y)::INTEGER AS t, max(y)::INTEGER AS b FROM pts GROUP BY poly_id),
rows AS (SELECT poly_id, l, r, greatest(0, t) AS low, unnest(range(greatest(0, t), least(99, b) + 1)) AS row FROM box),
crossing AS (SELECT poly_id, row, low, l, r, floor(x + (row - y) * (nx - x) / (ny - y) + 0.5)::INTEGER AS c FROM rows JOIN edges USING (poly_id)
  WHERE y <> ny AND row <= greatest(y, ny) AND (least(y, ny) < row OR (row = low AND least(y, ny) <= row))),
single AS (SELECT * FROM crossing WHERE row > low UNION ALL SELECT DISTINCT * FROM crossing WHERE row = low),
paired AS (SELECT *, row_number() OVER w AS i, lead(c) OVER w AS d, count(*) OVER (PARTITION BY poly_id, row) AS k FROM single WINDOW w AS (PARTITION BY poly_id, row ORDER BY c)),
covered AS (SELECT DISTINCT poly_id, row::INTEGER AS y, unnest(range(greatest(c, l, 0), least(coalesce(d, c), r, 99) + 1))::INTEGER AS x FROM paired WHERE i % 2 = 1 AND (d IS NOT NULL OR (row = low AND k = 1))) """


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each event type, of whole seconds and the mean value there."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("series_id"), F.floor(F.col("t") / 1_000_000).cast("double").alias("t"), "event_id")
    return e.groupBy("series_id", "t").agg(F.max("event_id").cast("double").alias("v"))


SERIES = f"""{EV}, series AS (
  SELECT event_type AS series_id, floor(t / 1000000)::DOUBLE AS t, max(event_id)::DOUBLE AS v FROM ev GROUP BY 1, 2
)"""
