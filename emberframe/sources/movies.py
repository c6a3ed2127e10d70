"""Movies in any store that Spark reads: files come as rows of `binaryFile`, decoded by a kernel, one task a file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.sources import formats, loaders

FRAMES = "movie_id string, pos int, ts_ns long, h int, w int, px binary, attrs map<string,binary>"
MOVIES = "movie_id string, format string, width int, height int, n_frames int, attrs map<string,binary>, readable boolean"
#: Frames that leave a task at once.
BATCH = 64


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """One row a frame. A trailer's times and attributes go before what the format itself says. Registered loaders are asked first.

    A file is a row here, so it is limited to 2 GB and read as a whole; datasource.from_files reads ranges of files of any size."""
    own_loaders = loaders.registered()

    def run(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                _, per_frame, times, size = formats.read_trailer(data)
                rows = []
                for pos, ts, img, attrs in loaders.load(data[: len(data) - size], own_loaders):
                    more = per_frame[pos] if pos < len(per_frame) else {}
                    rows.append((path, pos, times[pos] if pos < len(times) else ts, *img.shape, img.tobytes(), attrs | more))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=["movie_id", "pos", "ts_ns", "h", "w", "px", "attrs"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["movie_id", "pos", "ts_ns", "h", "w", "px", "attrs"])

    return _files(spark, path).mapInPandas(run, FRAMES)


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, also for files that cannot be decoded (readable is false): those of no known format, and those whose frames
    do not all come out, as they end early or are damaged."""
    own_loaders = loaders.registered()

    def whole(data: bytes) -> bool:
        try:
            return sum(1 for _ in loaders.load(data, own_loaders)) > 0
        except Exception:  # noqa: BLE001  whatever a decoder says of damaged bytes
            return False

    def run(batches):
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                attrs, *_, size = formats.read_trailer(data)
                m = formats.sniff(data[:4096], len(data) - size)
                out.append((path, m.format, m.width, m.height, m.n, m.attrs | attrs, whole(data[: len(data) - size])) if m else (path, loaders.find_loader(data[:4096], len(data) - size, own_loaders) or "UNKNOWN", 0, 0, 0, attrs, whole(data[: len(data) - size])))
            yield pd.DataFrame(out, columns=["movie_id", "format", "width", "height", "n_frames", "attrs", "readable"])

    return _files(spark, path).mapInPandas(run, MOVIES)


#: First bytes of text matrices that some programs put before the numbers, by how many there are.
MATRIX_HEADERS = (256, 261)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, v) of text files of numbers; lines that start with C, #, % or // are comments. Reading ends at the first
    empty line after numbers; rows of a file that differ in length are an error. A file is a row of text."""

    def run(batches):
        for batch in batches:
            for path, text in zip(batch["path"], batch["value"], strict=True):
                rows = matrix_of(text)
                if rows:
                    a = np.array(rows)
                    row, col = np.indices(a.shape).reshape(2, -1)
                    yield pd.DataFrame({"path": path, "row": row, "col": col, "v": a.ravel()})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, "path string, row long, col int, v double")


def matrix_of(text: str) -> list[list[float]]:
    for size in MATRIX_HEADERS:  # a header that isn't text
        if len(text) > size and "\0" in text[:size]:
            text = text[size:] if "\0" not in text[size:] else text
    rows: list[list[float]] = []
    for line in text.splitlines():
        line = line.strip()
        if not line:
            if rows:
                break
            continue
        if line.startswith(("C", "#", "%", "//")):
            continue
        rows.append([float(v) for v in line.replace(",", " ").replace(";", " ").split()])
        if len(rows[-1]) != len(rows[0]):
            raise ValueError("rows of a matrix have one length")
    return rows


def read_translations(spark: SparkSession, path: str, n_frames: int | None = None) -> DataFrame:
    """pos, dx, dy, confidence of a tab-separated registration file: four columns, and a row for each of n_frames if that is given."""
    t = spark.read.csv(path, sep="\t", header=True, schema="pos int, dx double, dy double, confidence double", mode="FAILFAST", enforceSchema=True)
    if n_frames is not None and t.count() != n_frames:
        raise ValueError(f"a registration file has a row for each of {n_frames} frames")
    return t


def write_translations(table: DataFrame, path: str) -> None:
    table.select("pos", "dx", "dy", "confidence").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames as Parquet with zstd, by movie: the store to query from."""
    frames.write.mode("overwrite").option("compression", "zstd").partitionBy("movie_id").parquet(path)
