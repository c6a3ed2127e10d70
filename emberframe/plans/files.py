"""Movies through files: frames of the embeddings, written by the saver and read back by the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.plans.registry import query
from emberframe.plans.tables import PX, packed, read
from emberframe.sources import attributes, datasource, metadata, movies

#: Movies by label; what a frame is, and the sum of its pixels and the one in its middle.
_FRAMES = f"WITH {PX}, m AS (SELECT 'm' || label AS movie, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS pos, vec_id FROM embeddings), f AS (SELECT movie, pos, vec_id, vec_id * 1000 AS ts_ns, sum(px)::BIGINT AS total, max(px) FILTER (y = 4 AND x = 3)::BIGINT AS middle FROM m JOIN px ON px.frame = m.vec_id GROUP BY ALL) "


def scratch(spark: SparkSession) -> str:
    """A new folder that all of the cluster sees: in spark.checkpoint.dir, or the warehouse; on one machine a temporary one."""
    import re
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        import tempfile

        base = tempfile.mkdtemp(prefix="movies-")
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/movies-{uuid.uuid4().hex}"


def frames(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "embeddings").select(F.concat(F.lit("m"), "label").alias("movie_id"), "vec_id", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("pos"))
    word = F.map_from_arrays(F.array(F.lit("id")), F.array(F.col("vec_id").cast("string").cast("binary")))
    return packed(spark, d).join(own, F.col("frame") == F.col("vec_id")).select("movie_id", "pos", (F.col("vec_id") * 1000).alias("ts_ns"), "h", "w", "px", word.alias("attrs"))


def written(spark: SparkSession, d: str, codec: str) -> str:
    folder = scratch(spark)
    datasource.to_files(frames(spark, d), folder, codec=codec, **{"attr.codec": codec})
    return folder


def _name(path: str = "movie_id"):
    return F.regexp_extract(path, r"([^/]*)\.[^.]*$", 1)


def _word(i):
    byte = lambda k: F.conv(F.hex(F.substring("px", k, F.lit(1))), 16, 10).cast("long")
    return byte(i * 2 + 1) + byte(i * 2 + 2) * 256


def _told(own: DataFrame) -> DataFrame:
    total = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda n, i: n + _word(i))
    return own.select(_name().alias("movie"), "pos", "ts_ns", total.alias("total"), _word(F.lit(35)).alias("middle"))


@query("io1_movie_source", _FRAMES + "SELECT movie, pos, ts_ns, total, middle FROM f")
def movie_source(spark, d):
    return _told(datasource.from_files(spark, written(spark, d, "pcr")))


@query("io11_frames_by_index", _FRAMES + "SELECT movie, pos, ts_ns, total, middle FROM f WHERE pos BETWEEN 7 AND 12 AND ts_ns >= 60000")
def frames_by_index(spark, d):
    return _told(datasource.from_files(spark, written(spark, d, "zstd")).where("pos between 7 and 12 and ts_ns >= 60000"))


@query("io5_recognised_movies", _FRAMES + "SELECT movie, 'ZSTD' AS format, 8 AS width, 8 AS height, count(*)::INTEGER AS n_frames, true AS readable FROM f GROUP BY movie")
def recognised(spark, d):
    return movies.read_movies(spark, written(spark, d, "zstd")).select(_name().alias("movie"), "format", "width", "height", "n_frames", "readable")


@query("io27_frame_attributes", _FRAMES + "SELECT movie, pos, vec_id::VARCHAR AS id FROM f")
def frame_attributes(spark, d):
    own = datasource.from_files(spark, written(spark, d, "zstd"), columns=["movie_id", "pos", "attrs"])
    return attributes.strings(own).select(_name().alias("movie"), "pos", F.col("attrs")["id"].alias("id"))


@query("io28_changed_attributes", _FRAMES + ", n AS (SELECT movie, count(*) AS n FROM f GROUP BY movie) SELECT movie, unnest(['codec', 'frames']) AS key, unnest(['pcr', n::VARCHAR]) AS value FROM n")
def changed_attributes(spark, d):
    folder = written(spark, d, "pcr")
    counts = datasource.from_files(spark, folder, columns=["movie_id", "pos"]).groupBy(F.col("movie_id").alias("path")).agg(F.count("*").cast("string").cast("binary").alias("n"))
    metadata.write_attributes(counts.select("path", F.map_from_arrays(F.array(F.lit("frames"), F.lit("attributes.positions")), F.array("n", F.lit(None).cast("binary"))).alias("attrs")))
    return metadata.read_attributes(spark, folder).select(_name("path").alias("movie"), "key", F.decode("value", "UTF-8").alias("value"))
