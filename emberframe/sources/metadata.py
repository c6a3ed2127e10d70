"""Attributes of many files: read as a table, changed in the files by writing their ends only, and kept in a table of their own.

A trailer is at the end of its file and begins with the attributes of the movie, so a change moves the trailer and no frame. Where a file
can be written in place, that is all that is written: first to a file beside it, then over the old trailer. A task that is lost in between
leaves that file, and the next attempt goes on from it. Other stores have no such writes; there the file is copied by blocks."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.sources import formats, ranges
from emberframe.sources.datasource import ChunkReader, files_of, store_of

ATTRIBUTES = "path string, key string, value binary"


def _paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    own = spark.createDataFrame(pa.table({"path": pa.array(paths, pa.string())}))
    return own.repartition(max(1, len(paths) // 64), "path")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """path, key, value: the attributes of the movies at path. Of each file the end and the start of its trailer are read."""

    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                read = ChunkReader(p)
                rows += [(p, k, v) for k, v in ranges.MovieFile(read, read.size).attributes().items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["path", "key", "value"])

    return _paths(spark, files_of(path)).mapInArrow(run, ATTRIBUTES)


def changed_tail(path: str, changes: dict[str, bytes | None]) -> tuple[int, bytes] | None:
    """Where the trailer of a file begins, and the new one; None if nothing changes. A None removes an attribute."""
    read = ChunkReader(path)
    own = ranges.MovieFile(read, read.size)
    before = own.attributes()
    after = {k: v for k, v in (before | changes).items() if v is not None}
    if before == after:
        return None
    start = own.size - own.trailer
    if not own.trailer:
        return start, formats.write_trailer(after, [], [])
    rest = read(own._maps_at, own.size - own._maps_at - len(formats.TRAILER) - 8)  # frames' attributes, times, their number
    body = formats.mapping(after) + rest
    return start, body + (len(body) + 8 + len(formats.TRAILER)).to_bytes(8, "little") + formats.TRAILER


def _local(path: str) -> str | None:
    from pyarrow import fs

    store, own = store_of(path)
    return own if isinstance(store, fs.LocalFileSystem) else None


def _applied(path: str) -> None:
    """Puts the tail that is beside a file over its end, if there is one: 8 bytes of where it begins, then the tail."""
    beside = f"{path}.tail"
    if not os.path.exists(beside):
        return
    with open(beside, "rb") as f:
        at, tail = int.from_bytes(f.read(8), "little"), f.read()
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(tail)
        f.truncate()
        f.flush()
        os.fsync(f.fileno())
    os.remove(beside)


def change_file(path: str, changes: dict[str, bytes | None]) -> int:
    """Changes the attributes of one file; returns the bytes that were written to it."""
    own = _local(path)
    if own is not None:
        _applied(own)
    found = changed_tail(path, changes)
    if found is None:
        return 0
    at, tail = found
    if own is not None:
        with open(f"{own}.tail.tmp", "wb") as f:
            f.write(at.to_bytes(8, "little") + tail)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{own}.tail.tmp", f"{own}.tail")
        _applied(own)
        return len(tail)
    store, name = store_of(path)
    read = ChunkReader(path)
    with store.open_output_stream(f"{name}.tmp") as out:
        for start in range(0, at, ranges.BLOCK):
            out.write(read(start, min(ranges.BLOCK, at - start)))
        out.write(tail)
    store.move(f"{name}.tmp", name)
    return at + len(tail)


def write_attributes(changes: DataFrame) -> DataFrame:
    """path, bytes written: of changes (path, attrs map<string,binary>), added to or put in place of what the files have; a null value
    removes an attribute. Files are dealt to tasks; several rows of a file are one change, of a key that comes again any value."""
    each = changes.select("path", F.explode("attrs").alias("key", "value")).groupBy("path", "key").agg(F.max("value").alias("value"))
    own = each.groupBy("path").agg(F.collect_list(F.struct("key", "value")).alias("changes"))

    def run(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            n = [change_file(p, {c["key"]: c["value"] for c in given}) for p, given in zip(paths, batch.column("changes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(n, pa.int64())], ["path", "bytes"])

    done = own.mapInArrow(run, "path string, bytes long").collect()  # a number for each changed file
    return changes.sparkSession.createDataFrame(done, "path string, bytes long")


# --- a table of attributes


def merged(table: DataFrame, changes: DataFrame) -> DataFrame:
    """path, key, value: a table with changes (path, key, value) put in by path and key; a null value removes a row. Of changes of one key
    the greatest value counts."""
    new = changes.groupBy("path", "key").agg(F.max("value").alias("value"), F.lit(True).alias("is_new"))
    both = table.select("path", "key", F.col("value").alias("old")).join(new, ["path", "key"], "full")
    return both.select("path", "key", F.when(F.col("is_new"), F.col("value")).otherwise(F.col("old")).alias("value")).where("value is not null")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of the table in a folder; empty if there is none."""
    last = _last(spark, folder)
    return spark.read.schema(ATTRIBUTES).parquet(f"{folder}/v{last}") if last else spark.createDataFrame([], ATTRIBUTES)


def _last(spark: SparkSession, folder: str) -> int:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
    whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and store.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return max(whole, default=0)


def upsert(changes: DataFrame, folder: str) -> None:
    """Merges changes (path, key, value) into the table in a folder: a new version beside the old one, which readers keep until the new
    one is whole. One writer at a time."""
    spark = changes.sparkSession
    merged(current(spark, folder), changes).write.mode("overwrite").parquet(f"{folder}/v{_last(spark, folder) + 1}")
