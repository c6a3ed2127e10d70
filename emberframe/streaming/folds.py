"""Operators that follow a movie frame by frame: one step function each, for batches and for streams.

A movie is a fold, so it is one task; parallelism is across movies. Batches come as an iterator of Arrow batches sorted by
position, so a task holds the fold's state, which is a few images, and a batch of frames, whatever the movie's length."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from emberframe.streaming import ordered

#: Frames that leave a task at once.
BATCH = 64


class Fold:
    """What is folded over the frames of a movie. SCALARS and IMAGES name the attributes that make up its state."""

    SCALARS: tuple[str, ...] = ()
    IMAGES: tuple[str, ...] = ()

    def scalars(self) -> dict:
        return {k: list(v) if isinstance(v := getattr(self, k), deque) else v for k in self.SCALARS}

    def images(self) -> dict[str, np.ndarray]:
        return {k: v for k in self.IMAGES if (v := getattr(self, k)) is not None}

    def restore(self, scalars: dict, images: dict[str, np.ndarray]) -> None:
        for k in self.SCALARS:
            setattr(self, k, deque(scalars[k], old.maxlen) if isinstance(old := getattr(self, k), deque) else scalars[k])
        for k in self.IMAGES:
            setattr(self, k, images.get(k))


class Loss(Fold):
    """Bounded-error smoothing: pixels stay at the mean of their history while they are within an error of a reference.

    The errors shrink by the distance of a frame's deviation from the mean of the first deviation and the last HISTORY ones,
    times std_factor, rounded. A pixel whose integration time (its upper three bits) changes starts anew. Rows from
    lossy_height on stay as they are.

    subtract_min takes the first frame's minimum off all frames, local_min the least so far; frames then say min_t.
    calibrate turns digital levels into temperatures, which are smoothed in their stead; background and integration times are
    still those of the levels, and frames come with the integration times. reduce_only (loss without recording) shrinks errors
    only for deviations above the mean, and integration times don't count.
    remove_bad_pixels corrects what is a bad pixel of the first frame."""

    HISTORY = 40
    SCALARS, IMAGES = ("first", "last", "min_t"), ("reference", "previous", "level", "bad")

    def __init__(
        self, high_error: int = 2, low_error: int = 6, std_factor: float = 5.0, average: int = 0, lossy_height: int | None = None, subtract_min: bool = False, local_min: bool = False,
        calibrate: Callable[[np.ndarray], np.ndarray] | None = None, reduce_only: bool = False, remove_bad_pixels: bool = False,
    ):
        self.high, self.low, self.std_factor, self.average, self.lossy_height = high_error, low_error, std_factor, min(average, 64), lossy_height
        self.subtract_min, self.local_min, self.calibrate, self.reduce_only, self.remove_bad_pixels = subtract_min, local_min, calibrate, reduce_only, remove_bad_pixels
        self.reference = self.previous = self.level = self.bad = self.min_t = self.times = None
        self.first: tuple[float, float] | None = None
        self.last: deque = deque(maxlen=self.HISTORY)
        self.held = RunningAverage(max(1, self.average))

    @staticmethod
    def background(img: np.ndarray) -> int:
        return int(np.bincount(img.ravel() >> 2).argmax()) * 4 + 1

    @staticmethod
    def deviation(d: np.ndarray) -> float:
        if not len(d):
            return 0.0
        s = d.sum()
        return float(np.sqrt(max(0.0, s * s - (d * d).sum())) / len(d))

    def _prepared(self, img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels and what is smoothed, of the lossy rows."""
        from emberframe.functions.images import bad_pixels, correct_bad_pixels

        level = img[: self.lossy_height]
        if self.remove_bad_pixels:
            self.bad = bad_pixels(level) if self.bad is None else self.bad
            level = correct_bad_pixels(level, self.bad)
        value = self.calibrate(level) if self.calibrate is not None else level
        self.times = level >> 13 if self.calibrate is not None else None
        if self.subtract_min or self.local_min:
            least = int(value.min())
            self.min_t = least if self.min_t is None else min(self.min_t, least) if self.local_min else self.min_t
            value = np.maximum(value.astype(np.int64) - self.min_t, 0).astype(img.dtype)
        return level, value

    def _errors(self, level: np.ndarray, value: np.ndarray, background: int) -> tuple[int, int]:
        d, fore = np.abs(value.astype(np.float64) - self.previous).ravel(), level.ravel() > background
        whole = self.deviation(d)
        own = (self.deviation(d[~fore]), self.deviation(d[fore])) if len(self.last) == self.HISTORY else (whole, whole)
        self.first = self.first or own
        self.last.append(own)
        mean = np.mean([self.first, *self.last], 0)
        off = [max(0.0, s - m) if self.reduce_only else abs(s - m) for s, m in zip(own, mean, strict=True)]
        low, high = (e - int(np.floor(o * self.std_factor + 0.5)) for e, o in zip((self.low, self.high), off, strict=True))
        high = max(0, high)
        return max(low, high), high

    def step(self, img: np.ndarray) -> tuple[np.ndarray, int, int]:
        """The frame to keep, and the errors of background and foreground."""
        level, value = self._prepared(img)
        if self.reference is None:
            self.reference, self.previous, self.level, low, high, out = value.copy(), value.copy(), level.copy(), self.low, self.high, value
        else:
            background = self.background(level)
            low, high = self._errors(level, value, background)
            near = np.abs(value.astype(np.int64) - self.reference) <= np.where(level > background, high, low)
            if not self.reduce_only:
                near &= self.level >> 13 == level >> 13
            self.reference = np.where(near, self.reference, value)
            out = self.reference
            if self.average:
                self.held.add(value)
                self.held.reset(~near, value)
                out = np.where(near, self.held.mean(), value).astype(img.dtype)
            self.previous, self.level = out.copy(), level.copy()
        return np.concatenate([out.astype(img.dtype), img[len(out) :]]), low, high


class Downsampler(Fold):
    """Adaptive decimation: keeps the maximum image since the last kept frame, when frames change or `factor` have passed."""

    HISTORY = 96
    SCALARS, IMAGES = ("i", "last", "ts", "diffs"), ("previous", "maximum")

    def __init__(self, factor: int, factor_std: float = 0.5, lossy_height: int | None = None):
        self.factor, self.part, self.lossy_height = factor, min(max(int(factor_std * self.HISTORY), 0), self.HISTORY - 1), lossy_height
        self.i, self.last, self.ts = 0, -1, None
        self.previous = self.maximum = None
        self.diffs: list[float] = []

    def step(self, img: np.ndarray, ts: int) -> np.ndarray | None:
        if self.ts is not None and ts <= self.ts:
            return None
        self.ts = ts
        rows = slice(0, self.lossy_height)
        if self.factor <= 1:
            return img.copy()
        self.maximum = img.copy() if self.maximum is None else np.concatenate([np.maximum(self.maximum[rows], img[rows]), img[len(img[rows]) :]])
        emit, i = False, self.i
        if self.previous is None:
            emit = True
        else:
            d = np.abs(img[rows].astype(np.float64) - self.previous[rows]).ravel()
            d = float(d.std(ddof=1)) if len(d) > 1 else 0.0
            if len(self.diffs) < self.HISTORY:
                emit = i % self.factor == 0
                self.diffs.append(d)
            else:
                mean, std = float(np.mean(self.diffs)), float(np.std(self.diffs, ddof=1))
                q = sorted(self.diffs[-self.HISTORY :])[self.part]
                nothing = d < mean - 0.5 * std and i - self.last < 2 * self.factor
                emit = (d > q or i - self.last >= self.factor) and not nothing
                if d < mean + 10 * std:
                    self.diffs = [*self.diffs[1:], d]
        self.previous, self.i = img.copy(), i + 1
        if emit:
            out, self.maximum, self.last = self.maximum, None, i
            return out
        return None


class SteadyDownsampler(Downsampler):
    """The variant that goes by the spread of the differences: a movie whose deviation is under a tenth of its mean is steady,
    and gives only every factor-th frame, unless a frame differs by two deviations. The first ten differences are a warm-up."""

    WARM_UP, STEADY = 10, 0.1

    def step(self, img: np.ndarray, ts: int) -> np.ndarray | None:
        if self.ts is not None and ts <= self.ts:
            return None
        self.ts = ts
        if self.factor <= 1:
            return img.copy()
        rows, i = slice(0, self.lossy_height), self.i
        self.i += 1
        if self.previous is None:
            self.previous, self.maximum, self.last = img.copy(), None, 0
            return img.copy()
        d = np.abs(img[rows].astype(np.float64) - self.previous[rows]).ravel()
        d = float(d.std(ddof=1)) if len(d) > 1 else 0.0
        self.previous = img.copy()
        self.maximum = img.copy() if self.maximum is None else np.concatenate([np.maximum(self.maximum[rows], img[rows]), img[len(img[rows]) :]])
        due = i % self.factor == 0
        if len(self.diffs) < self.WARM_UP:
            self.diffs.append(d)
            emit = due
        else:
            mean, std = float(np.mean(self.diffs)), float(np.std(self.diffs, ddof=1))
            nothing = std < self.STEADY * mean and d < mean + 2 * std
            emit = due or (not nothing and d > mean + 0.5 * std)
            if due or mean - std < d < mean + 5 * std:
                self.diffs = [*self.diffs[-(self.HISTORY - 1) :], d]
        if not emit:
            return None
        out, self.maximum, self.last = self.maximum, None, i
        return out


class RunningAverage(Fold):
    """Whole-number mean of each pixel's last n frames; a reset pixel has had one value all the time.

    Frames are kept as they came, by the number of the step modulo n (`slots`): a step adds its frame to the sum and takes off the one
    that it replaces, as far as that counts since the pixel's last reset."""

    SCALARS, IMAGES = ("t",), ("total", "since", "value")

    def __init__(self, n: int):
        self.n, self.t, self.slots = n, 0, {}
        self.total = self.since = self.value = None

    def add(self, img: np.ndarray) -> None:
        if self.total is None:
            self.total, self.since, self.value = (np.zeros(img.shape, np.int64) for _ in range(3))
        at = self.t % self.n
        if self.t >= self.n:
            self.total -= np.where(self.t - self.n >= self.since, self.slots[at], self.value)
        self.slots[at] = img.copy()
        self.total += img
        self.t += 1

    def reset(self, where: np.ndarray, value: np.ndarray) -> None:
        self.since[where], self.value[where] = self.t, value[where]
        self.total[where] = min(self.t, self.n) * value[where].astype(np.int64)

    def mean(self) -> np.ndarray:
        return self.total // min(self.t, self.n)


LOSSY = "movie_id {}, pos int, h int, w int, px binary, low_error int, high_error int, min_t int, times binary"
SAMPLED = "movie_id {}, pos int, ts_ns long, h int, w int, px binary"
#: The columns of LOSSY, in order.
_LOSSY = ["movie_id", "pos", "h", "w", "px", "low_error", "high_error", "min_t", "times"]


def image_of(r) -> np.ndarray:
    return np.frombuffer(r.px, "<u2").reshape(r.h, r.w)


def _lossy_row(fold: Loss, r) -> tuple:
    out, low, high = fold.step(image_of(r))
    return r.movie_id, r.pos, r.h, r.w, out.astype("<u2").tobytes(), low, high, fold.min_t, None if fold.times is None else fold.times.astype("u1").tobytes()


def _sampled_row(fold: Downsampler, r) -> tuple | None:
    out = fold.step(image_of(r), r.ts_ns)
    return None if out is None else (r.movie_id, r.pos, r.ts_ns, r.h, r.w, out.astype("<u2").tobytes())


def _lossy_rows(fold: Loss, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([_lossy_row(fold, r) for r in pdf.sort_values("pos").itertuples(index=False)], columns=_LOSSY)


def by_movie(frames: DataFrame, make: Callable[[], object], row: Callable[[object, object], tuple | None], schema: str) -> DataFrame:
    """A new fold for each movie; row(fold, frame) gives a row or None. Frames come in the order of their positions."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, out = make(), []
        for batch in batches:
            for r in batch.to_pandas().itertuples(index=False):
                if (own := row(fold, r)) is not None:
                    out.append(own)
                if len(out) == BATCH:
                    yield _batch(out, target)
                    out = []
        if out:
            yield _batch(out, target)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return frames.repartition("movie_id").sortWithinPartitions("movie_id", "pos").groupBy("movie_id").applyInArrow(run, schema)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


def lossy(frames: DataFrame, **options) -> DataFrame:
    """frames (movie_id, pos, h, w, px) with bounded errors, and the errors of each frame; options as of Loss."""
    return by_movie(frames, lambda: Loss(**options), _lossy_row, LOSSY.format(dict(frames.dtypes)["movie_id"]))


def downsample(frames: DataFrame, factor: int, steady: bool = False, **options) -> DataFrame:
    """frames (movie_id, pos, ts_ns, h, w, px) that the adaptive decimation keeps; steady: by its second variant."""
    fold = SteadyDownsampler if steady else Downsampler
    return by_movie(frames, lambda: fold(factor, **options), _sampled_row, SAMPLED.format(dict(frames.dtypes)["movie_id"]))


def lossy_stream(frames: DataFrame, **options) -> DataFrame:
    """As `lossy`, over a stream, with the column late; options of Loss, and `patience` and `wait` as of ordered.follow."""
    return ordered.follow(frames, lambda o: Loss(**o), _lossy_row, LOSSY, options)


def downsample_stream(frames: DataFrame, factor: int, steady: bool = False, **options) -> DataFrame:
    """As `downsample`, over a stream, with the column late."""
    kind = SteadyDownsampler if steady else Downsampler
    return ordered.follow(frames, lambda o: kind(factor, **o), _sampled_row, SAMPLED, options)
