"""The read pipeline of frames: minimum, calibration, bad pixels, motion, in this order; and the registries behind it."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from emberframe.functions.images import bad_pixels, translate

#: Rows at the bottom of a frame that hold metadata, not an image.
META_ROWS = 3


class CalibrationNotFound(LookupError):
    pass


class Calibration(ABC):
    """Digital levels to temperature and back, as columns and as arrays."""

    name = "Temperature"

    @abstractmethod
    def to_temp(self, v: Column, ti: Column, inv_emissivity: Column) -> Column: ...

    @abstractmethod
    def to_dl(self, t: Column, ti: Column, inv_emissivity: Column) -> Column: ...

    @abstractmethod
    def apply(self, img: np.ndarray, inv_emissivity: np.ndarray | float = 1.0) -> np.ndarray: ...

    def tables(self) -> dict[str, np.ndarray]:
        """Tables by name."""
        return {}

    def files(self) -> list[str]:
        """Files that the calibration was read from."""
        return []

    def supports_emissivity(self) -> bool:
        return False

    def prepare(self, attrs: dict) -> Calibration:
        """The calibration for a movie of these attributes."""
        return self

    def flip_transmissions(self, left_right: bool, up_down: bool) -> None:
        """Turns per-pixel transmissions, where there are any."""

    def apply_float(self, img: np.ndarray, inv_emissivity: np.ndarray | float = 1.0) -> np.ndarray:
        """Temperatures that are not rounded; those of apply, where a calibration has no finer ones."""
        return self.apply(img, inv_emissivity).astype(np.float32)


_BUILDERS: list[tuple[str, Callable[[dict], bool], Callable[[dict], Calibration]]] = []


def register_calibration(name: str, probe: Callable[[dict], bool], build: Callable[[dict], Calibration]) -> None:
    """The last registered builder is asked first."""
    _BUILDERS.insert(0, (name, probe, build))


def find_calibration(attrs: dict) -> Calibration | None:
    """That of the first builder whose probe accepts a movie's attributes."""
    return next((build(attrs) for _, probe, build in _BUILDERS if probe(attrs)), None)


def choose(name: str | int, calibration: Calibration | None) -> Calibration | None:
    """None for digital levels (0, "DL", "Digital Level"), the calibration for 1 or its name."""
    if name in (0, "DL", "Digital Level"):
        return None
    if calibration is not None and name in (1, calibration.name):
        return calibration
    raise CalibrationNotFound(str(name))


def table_names(calibration: Calibration | None) -> list[str]:
    return sorted(calibration.tables()) if calibration is not None else []


def table(calibration: Calibration | None, name: str) -> np.ndarray:
    if calibration is None or name not in calibration.tables():
        raise CalibrationNotFound(name)
    return np.asarray(calibration.tables()[name])


def features(calibration: Calibration | None) -> dict:
    """What a movie with this calibration supports, and the files it comes from."""
    return {"calibrations": ["Digital Level"] + ([calibration.name] if calibration else []), "emissivity": bool(calibration and calibration.supports_emissivity()), "files": calibration.files() if calibration else []}


def saturated(levels: Column) -> Column:
    """Whether a pixel word holds the greatest digital level."""
    from pyspark.sql import functions as F

    return levels.bitwiseAND(F.lit(8191)) == 8191


def raw_values(frames: DataFrame, y: int, x: int) -> DataFrame:
    """movie_id, pos, value: the word of one pixel of packed frames as it was read, before any calibration; none outside."""
    from pyspark.sql import functions as F

    at = (F.lit(y) * F.col("w") + x) * 2 + 1
    byte = lambda i: F.conv(F.hex(F.substring("px", i, F.lit(1))), 16, 10).cast("int")
    own = frames.where((F.col("h") > y) & (F.col("w") > x) & F.lit(y >= 0 and x >= 0))
    return own.select("movie_id", "pos", (byte(at) + byte(at + 1) * 256).alias("value"))


def checked_emissivity(e: float) -> float:
    if not 0 <= e <= 1:
        raise ValueError("an emissivity is between 0 and 1")
    return e


def replace_bad(img: np.ndarray, bad: list[tuple[int, int]]) -> np.ndarray:
    """Each bad pixel becomes the median of the good ones of its 3x3, which moves inwards at borders; without any it stays."""
    out, h, w, known = img.copy(), *img.shape, set(bad)
    for y, x in bad:
        top, left = min(max(y - 1, 0), max(0, h - 3)), min(max(x - 1, 0), max(0, w - 3))
        v = sorted(img[a, b] for a in range(top, min(h, top + 3)) for b in range(left, min(w, left + 3)) if (a, b) not in known)
        if v:
            out[y, x] = v[len(v) // 2]
    return out


def correct_one_pass(img: np.ndarray) -> np.ndarray:
    return replace_bad(img, bad_pixels(img))


@dataclass
class ReadOptions:
    min_t: int = 0
    min_t_height: int = 0
    calibration: Calibration | None = None
    inv_emissivity: float = 1.0
    correct_bad: bool = False
    motion: bool = False
    functor: Callable[[np.ndarray, int], np.ndarray] | None = None


def read_image(img: np.ndarray, o: ReadOptions, bad: list[tuple[int, int]] = (), shift: tuple[float, float] | None = None, pos: int = 0) -> np.ndarray:
    out = img.astype(np.int64)
    if o.min_t and o.min_t_height:
        out[: o.min_t_height] = (out[: o.min_t_height] + o.min_t) & 0xFFFF
    out = out.astype("<u2")
    if o.calibration is not None:
        out = o.calibration.apply(out, o.inv_emissivity)
    image = out[:-META_ROWS] if len(out) > META_ROWS else out[:0]
    if o.correct_bad and len(image):
        image = replace_bad(image, list(bad))
    if o.motion and len(image):
        if o.functor is not None:
            image = o.functor(image, pos)
        elif shift is not None:
            image = translate(image.astype(np.float32), -shift[0], -shift[1], "nearest").astype(out.dtype)
    return np.concatenate([image, out[len(image) :]])


def bad_pixels_by_movie(frames: DataFrame) -> DataFrame:
    """movie_id, bad (y * w + x) of each movie's first frame among these. Frames with the header of an HCC camera, which corrects its
    own bad pixels, have none."""
    from pyspark.sql import functions as F

    if "attrs" in frames.columns:
        frames = frames.where(~F.coalesce(F.map_contains_key("attrs", F.lit("ImageHeaderLength")), F.lit(False)))
    least = frames.groupBy("movie_id").agg(F.min("pos").alias("pos"))  # of this, a source reads no pixel
    first = frames.select("movie_id", "pos", "h", "w", "px").join(least, ["movie_id", "pos"]).dropDuplicates(["movie_id"])

    def detect(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                img = np.frombuffer(r.px, "<u2").reshape(r.h, r.w)
                out.append((r.movie_id, [y * r.w + x for y, x in bad_pixels(img[:-META_ROWS])]))
            yield pd.DataFrame(out, columns=["movie_id", "bad"])

    return first.select("movie_id", "h", "w", "px").mapInPandas(detect, f"movie_id {dict(frames.dtypes)['movie_id']}, bad array<int>")


def read_frames(frames: DataFrame, options: ReadOptions, translations: DataFrame | None = None, bad: DataFrame | None = None) -> DataFrame:
    """Frames (movie_id, pos, h, w, px) through the pipeline. Bad pixels (movie_id, bad) are by default those of the first frame that
    each movie has here; for a part of a movie they are to be given as those of the whole (bad_pixels_by_movie). They come to the frames
    by a join with a row a movie, which Spark broadcasts or splits by its size; translations (movie_id, pos, dx, dy) join by frame."""
    from pyspark.sql import functions as F

    own = frames.select("movie_id", "pos", "h", "w", "px")
    if translations is not None and options.motion:
        own = own.join(translations.select("movie_id", "pos", "dx", "dy"), ["movie_id", "pos"], "left")
    else:
        own = own.withColumns({"dx": F.lit(None).cast("double"), "dy": F.lit(None).cast("double")})
    if options.correct_bad:
        own = own.join(bad if bad is not None else bad_pixels_by_movie(frames), "movie_id", "left")
    else:
        own = own.withColumn("bad", F.array().cast("array<int>"))

    def run(batches):
        for batch in batches:
            px = []
            for r in batch.itertuples(index=False):
                img = np.frombuffer(r.px, "<u2").reshape(r.h, r.w)
                shift = None if pd.isna(r.dx) else (r.dx, r.dy)
                px.append(read_image(img, options, [divmod(int(i), r.w) for i in (r.bad if r.bad is not None else [])], shift, r.pos).astype("<u2").tobytes())
            yield batch[["movie_id", "pos", "h", "w"]].assign(px=px)

    return own.mapInPandas(run, f"movie_id {dict(frames.dtypes)['movie_id']}, pos int, h int, w int, px binary")
