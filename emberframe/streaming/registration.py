"""Registration of a movie's frames by translation, and motion correction with the result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from emberframe.functions.images import gaussian, translate
from emberframe.streaming import folds, ordered


class NotConverged(RuntimeError):
    pass


def _sample(img: np.ndarray, tx: float, ty: float) -> tuple[np.ndarray, np.ndarray]:
    """img at (x + tx, y + ty), bilinear, and where that is inside."""
    h, w = img.shape
    x, y = np.arange(w) + tx, np.arange(h) + ty
    ok = ((x >= 0) & (x <= w - 1))[None, :] & ((y >= 0) & (y <= h - 1))[:, None]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(0, w - 2)), np.minimum(y.astype(int), max(0, h - 2))
    a, b = (x - x0)[None, :], (y - y0)[:, None]
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    out = (img[y0][:, x0] * (1 - b) + img[y1][:, x0] * b) * (1 - a) + (img[y0][:, x1] * (1 - b) + img[y1][:, x1] * b) * a
    return out, ok


def ecc_translation(template: np.ndarray, img: np.ndarray, start: tuple[float, float] = (0.0, 0.0), steps: int = 500, eps: float = 1e-3, mask: np.ndarray | None = None) -> tuple[float, float, float]:
    """(x, y, correlation): the shift at which img correlates best with template, by forward additive steps that maximise
    the enhanced correlation coefficient. mask: the pixels of img that take part."""
    t, i = template.astype(float), img.astype(float)
    gy, gx = np.gradient(i)
    p, last = np.array(start, float), -2.0
    rho = -1.0
    for _ in range(steps):
        (w, ok), (wx, _), (wy, _) = _sample(i, *p), _sample(gx, *p), _sample(gy, *p)
        if mask is not None:
            ok = ok & (_sample(mask.astype(float), *p)[0] >= 0.5)
        if ok.sum() < 9:
            raise NotConverged("no overlap is left")
        iw, tz, g = w[ok] - w[ok].mean(), t[ok] - t[ok].mean(), np.stack([wx[ok], wy[ok]])
        norm = np.linalg.norm(iw) * np.linalg.norm(tz)
        hess = g @ g.T
        if not norm or abs(np.linalg.det(hess)) < 1e-12:
            raise NotConverged("an image is flat")
        rho = float(tz @ iw / norm)
        if abs(rho - last) < eps:
            return float(p[0]), float(p[1]), rho
        last = rho
        ip, tp = g @ iw, g @ tz
        hi = np.linalg.solve(hess, ip)
        top, bottom = iw @ iw - ip @ hi, tz @ iw - tp @ hi
        if bottom <= 0:
            raise NotConverged("the images do not correlate")
        p = p + np.linalg.solve(hess, g @ (top / bottom * tz - iw))
        if not np.isfinite(p).all() or abs(p).max() > max(t.shape):
            raise NotConverged("the shift runs away")
    return float(p[0]), float(p[1]), rho


class Registrator(folds.Fold):
    """Follows a movie: shift and confidence of each frame against a reference, with up to five tries a frame.

    mask (h, w): where it is not 0, pixels take part; pre_process: what is done to a frame before all else. With a median below 1, what
    is above the greater of both images' values of that rank is cut in both, wherever one of them is above it. A try that does not
    converge lowers the median by 0.01, a success sets it to 1."""

    SCALARS, IMAGES = ("warp", "base", "found", "threshold", "median"), ("reference",)
    #: Confidences from which the threshold of a new reference follows.
    FIRST = 21

    def __init__(self, factor: float = 1.0, sigma: float = 1.0, median: float = 1.0, mask: np.ndarray | None = None, pre_process=None):
        self.factor, self.sigma, self.median, self.pre_process = factor, sigma, median, pre_process
        self.mask = None if mask is None else self._centre(np.asarray(mask)) > 0
        self.reference = self.threshold = None
        self.warp, self.base = (0.0, 0.0), (0.0, 0.0)
        self.found: list[tuple[float, float, float]] = []

    def _centre(self, img: np.ndarray) -> np.ndarray:
        h, w = img.shape
        ch, cw = int(h * self.factor), int(w * self.factor)
        return img[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw]

    def _crop(self, img: np.ndarray) -> np.ndarray:
        own = self._centre(self.pre_process(img) if self.pre_process is not None else img).astype(np.float32)
        return gaussian(own, self.sigma).astype(float) if self.sigma > 0 else own.astype(float)

    @staticmethod
    def _scaled(img: np.ndarray) -> np.ndarray:
        span = img.max() - img.min()
        return (img - img.min()) / span if span else img * 0

    def _ranked(self, img: np.ndarray) -> float:
        """The least value, in whole numbers, up to which there is the median's share of the pixels that take part."""
        values = np.sort((img if self.mask is None else img[self.mask]).astype(np.int64).ravel())
        return float(values[max(0, int(np.floor(len(values) * self.median + 0.5)) - 1)]) if len(values) else 0.0

    def _add(self, found: tuple[float, float, float]) -> None:
        """Remembers the first ones, and the last."""
        self.found = [*self.found[: self.FIRST - 1], found] if len(self.found) >= self.FIRST else [*self.found, found]

    def step(self, img: np.ndarray) -> tuple[float, float, float]:
        own = self._crop(img)
        if self.reference is None:
            self.reference = own
            self.found.append((0.0, 0.0, 1.0))
            return self.found[-1]
        for _ in range(5):
            one, two = self.reference, own
            if self.median < 1:
                most = max(self._ranked(one), self._ranked(two))
                above = (one > most) | (two > most)
                one, two = np.where(above, most, one), np.where(above, most, two)
            try:
                x, y, rho = ecc_translation(self._scaled(one), self._scaled(two), self.warp, mask=self.mask)
                self.median = 1.0 if self.median < 1 else self.median
                break
            except NotConverged:
                self.median -= 0.01
        else:
            self._add(self.found[-1])
            return tuple(self.found[-1])
        self.warp = (x, y)
        out = (self.base[0] + x, self.base[1] + y, rho)
        self._add(out)
        rhos = [r for *_, r in self.found]
        if self.threshold is not None or len(rhos) >= self.FIRST:
            self.threshold = min(rhos) - 2 * float(np.std(rhos)) if self.threshold is None else self.threshold
            if rho < self.threshold:
                self.reference, self.base, self.warp = translate(own, -x, -y), (0.0, 0.0), (0.0, 0.0)
        return out


REGISTERED = "movie_id {}, pos int, dx double, dy double, confidence double"


def _registered_row(fold: Registrator, r) -> tuple:
    return (r.movie_id, r.pos, *map(float, fold.step(folds.image_of(r))))


def register(frames: DataFrame, **options) -> DataFrame:
    """movie_id, pos, dx, dy, confidence. A movie is a fold; movies run in parallel. Options as of Registrator."""
    return folds.by_movie(frames, lambda: Registrator(**options), _registered_row, REGISTERED.format(dict(frames.dtypes)["movie_id"]))


def register_stream(frames: DataFrame, **options) -> DataFrame:
    """The same over a stream, with the column late; also `patience` and `wait` as of ordered.follow."""
    return ordered.follow(frames, lambda o: Registrator(**o), _registered_row, REGISTERED, options)
