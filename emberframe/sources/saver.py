"""Making movies: from arrays, and to files."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.sources import datasource, formats
from emberframe.streaming import folds

#: Parameters of a saver and their defaults.
PARAMETERS = {
    "compressionLevel": 3, "lowValueError": 6, "highValueError": 2, "codec": "zstd", "GOP": 50, "threads": 1, "slices": 1, "stdFactor": 5.0,
    "inputCamera": 0, "removeBadPixels": 0, "runningAverage": 32, "subtractMin": 0, "subtractLocalMin": 0,
}
MOST_AVERAGED = 64


def from_array(spark: SparkSession, movie_id: str, array: np.ndarray, times: Sequence[int] | None = None, attrs: Sequence[dict] | None = None) -> DataFrame:
    """Frames of an image (h, w) or of images (n, h, w); any other rank is an error."""
    a = np.asarray(array)
    if a.ndim == 2:
        a = a[None]
    if a.ndim != 3:
        raise ValueError(f"an image or a list of images is needed, not {a.ndim} dimensions")
    if (times is not None and len(times) != len(a)) or (attrs is not None and len(attrs) != len(a)):
        raise ValueError("times and attributes are one for each image")
    own = np.ascontiguousarray(a, "<u2")
    table = pa.table({
        "movie_id": pa.array([movie_id] * len(a)), "pos": pa.array(np.arange(len(a), dtype=np.int32)), "ts_ns": pa.array(np.asarray(times, np.int64) if times is not None else np.arange(len(a)) * 20_000_000),
        "h": pa.array(np.full(len(a), a.shape[1], np.int32)), "w": pa.array(np.full(len(a), a.shape[2], np.int32)), "px": pa.array([i.tobytes() for i in own], pa.binary()),
        "attrs": pa.array([[(k, v if isinstance(v, bytes) else str(v).encode()) for k, v in (attrs[i] if attrs else {}).items()] for i in range(len(a))], pa.map_(pa.string(), pa.binary())),
    })
    return spark.createDataFrame(table)


def parameters(**given) -> dict:
    """Checked parameters over the defaults."""
    if unknown := given.keys() - PARAMETERS.keys():
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    out = PARAMETERS | given
    if not 0 <= int(out["runningAverage"]) <= MOST_AVERAGED:
        raise ValueError(f"runningAverage is at most {MOST_AVERAGED}")
    return out


def encode_movies(frames: DataFrame, codec: str = "zstd", frequency: int = 50, attrs: dict[str, bytes] | None = None, level: int = 3) -> DataFrame:
    """movie_id, content: each movie as a file of that codec ("zstd" or "pcr"), with a trailer of attributes and times.

    A movie's frames meet in one task, as its file is one; movies are made in parallel."""
    if codec not in datasource.SUFFIX:
        raise ValueError(f"no such codec here: {codec}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("pos")
        images = [np.frombuffer(r.px, "<u2").reshape(r.h, r.w) for r in own.itertuples(index=False)]
        times = [int(t) for t in own["ts_ns"]]
        if len({i.shape for i in images}) > 1:
            raise ValueError("images of a movie are of one size")
        per_frame = [{k: bytes(v) for k, v in (dict(a) if a is not None else {}).items()} for a in own["attrs"]]
        return pd.DataFrame([(own["movie_id"].iloc[0], formats.with_trailer(formats.movie_of(images, times, codec, frequency, level), attrs or {}, per_frame, times))], columns=["movie_id", "content"])

    return frames.groupBy("movie_id").applyInPandas(run, "movie_id string, content binary")


class Saver:
    """Records movies into the files of a folder: add frames, whole or with loss, then close. As a context it closes itself.

    Frames of a movie count on from those added before. Parameters are those of PARAMETERS; what is added later goes by those set
    last, but a movie's loss is one fold over all that is added with loss. Frames added with loss say BackgroundError and
    ForegroundError, and the file says the greatest errors and the minimum that was taken off."""

    def __init__(self, path: str, mode: str = "append", attrs: dict[str, bytes] | None = None, calibrate=None, **given):
        self.path, self.mode, self.attrs, self.calibrate = path, mode, dict(attrs or {}), calibrate
        self.parameters = parameters(**given)
        self.parts: list[DataFrame] = []
        self.opened = True

    def set_parameter(self, name: str, value) -> None:
        self.parameters = parameters(**self.parameters | {name: value})

    def is_open(self) -> bool:
        return self.opened

    def add(self, frames: DataFrame) -> None:
        """Frames as they are."""
        self._append(frames.select("movie_id", "pos", "ts_ns", "h", "w", "px", "attrs"))

    def add_lossy(self, frames: DataFrame) -> None:
        """Frames with bounded errors; with inputCamera, digital levels that `calibrate` turns into temperatures."""
        p = self.parameters
        kept = folds.lossy(
            frames, high_error=int(p["highValueError"]), low_error=int(p["lowValueError"]), std_factor=float(p["stdFactor"]), average=int(p["runningAverage"]), subtract_min=bool(int(p["subtractMin"])),
            local_min=bool(int(p["subtractLocalMin"])), remove_bad_pixels=bool(int(p["removeBadPixels"])), calibrate=self.calibrate if int(p["inputCamera"]) else None,
        )
        own = kept.join(frames.select("movie_id", "pos", "ts_ns", "attrs"), ["movie_id", "pos"])
        said = F.when(F.col("pos") == 0, F.map_from_arrays(F.array(F.lit("GlobalBackgroundError"), F.lit("GlobalForegroundError")), F.array(F.col("low_error").cast("string").cast("binary"), F.col("high_error").cast("string").cast("binary"))))
        said = said.otherwise(F.map_from_arrays(F.array(F.lit("BackgroundError"), F.lit("ForegroundError")), F.array(F.col("low_error").cast("string").cast("binary"), F.col("high_error").cast("string").cast("binary"))))
        least = F.when(F.col("min_t").isNotNull(), F.map_from_arrays(F.array(F.lit("MIN_T"), F.lit("MIN_T_HEIGHT")), F.array(F.col("min_t").cast("string").cast("binary"), F.col("h").cast("string").cast("binary"))))
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<binary>"))
        self._append(own.select("movie_id", "pos", "ts_ns", "h", "w", "px", F.map_concat(F.coalesce("attrs", none), said, F.coalesce(least, none)).alias("attrs")))

    def _append(self, frames: DataFrame) -> None:
        if not self.opened:
            raise ValueError("the saver is closed")
        if self.parts:
            before = self._whole().groupBy("movie_id").agg((F.max("pos") + 1).alias("n"))
            frames = frames.join(before, "movie_id", "left").select("movie_id", (F.col("pos") + F.coalesce("n", F.lit(0))).cast("int").alias("pos"), "ts_ns", "h", "w", "px", "attrs")
        self.parts.append(frames)

    def _whole(self) -> DataFrame:
        out = self.parts[0]
        for more in self.parts[1:]:
            out = out.unionByName(more)
        return out

    def close(self) -> None:
        """Writes the files; nothing for a saver without frames, or one that is closed."""
        if self.opened and self.parts:
            codec = self.parameters["codec"]
            given = {"codec": codec, "level": str(self.parameters["compressionLevel"]), **{f"attr.{k}": v.decode() if isinstance(v, bytes) else str(v) for k, v in self.attrs.items()}}
            mode, more = ("append", {"ifExists": "ignore"}) if self.mode == "ignore" else (self.mode, {})
            datasource.to_files(self._whole(), self.path, mode, **given, **more)
        self.opened = False

    def __enter__(self) -> Saver:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()
        self.opened = False


def convert(spark: SparkSession, source: str, target: str, codec: str = "zstd", first: int = 0, count: int = -1, missing_only: bool = False) -> None:
    """Movies of one format into files of another, of the same names: frames first to first + count (-1: all), with all attributes.
    missing_only: movies that the target has already are not read; otherwise they are replaced."""
    more = ({} if count < 0 else {"last": first + count - 1}) | ({"unless": target} if missing_only else {})
    frames = datasource.from_files(spark, source, first=first, **more)
    named = frames.withColumn("movie_id", F.regexp_replace(F.element_at(F.split("movie_id", "/"), -1), r"\.[^.]*$", ""))
    datasource.to_files(named.withColumn("pos", F.col("pos") - first), target, "overwrite", codec=codec)


def export_range(frames: DataFrame, n: int, start: int = 0, count: int = -1) -> DataFrame:
    """Frames start to start + count (-1: to the end; clamped), counted anew from 0; an empty range is an error."""
    stop = n if count < 0 else min(n, start + count)
    if not 0 <= start < stop:
        raise ValueError("the range is empty")
    return frames.where((F.col("pos") >= start) & (F.col("pos") < stop)).withColumn("pos", F.col("pos") - start)
