"""NumPy kernels over one frame, and their form over packed frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a batch that leaves a kernel.
ROWS = 1 << 16


def translate(img: np.ndarray, dx: float, dy: float, strategy: str = "", background: float = 0) -> np.ndarray:
    """Content moves by (dx, dy): bilinear inside, cut towards zero. Outside: '' or 'noborder' keeps the input, 'constant' or
    'background' puts a value, 'nearest' the nearest edge pixel, 'wrap' the period's bilinear value."""
    if strategy not in ("", "noborder", "constant", "background", "wrap", "nearest"):
        raise ValueError(f"unknown strategy {strategy!r}")
    h, w = img.shape
    px = (np.arange(w) - np.float32(dx)).astype(np.float32)
    py = (np.arange(h) - np.float32(dy)).astype(np.float32)
    outside = ((px < 0) | (px >= w))[None, :] | ((py < 0) | (py >= h))[:, None]
    x, y = (px % w, py % h) if strategy == "wrap" else (np.clip(px, 0, w - 1e-3), np.clip(py, 0, h - 1e-3))
    x0, y0 = np.minimum(x.astype(int), w - 1), np.minimum(y.astype(int), h - 1)
    x1, y1 = (x0 + 1) % w if strategy == "wrap" else np.minimum(x0 + 1, w - 1), (y0 + 1) % h if strategy == "wrap" else np.minimum(y0 + 1, h - 1)
    a, b = (x - x0).astype(np.float64)[None, :], (y - y0).astype(np.float64)[:, None]
    v = img.astype(np.float64)
    left = v[y0][:, x0] * (1 - b) + v[y1][:, x0] * b
    right = v[y0][:, x1] * (1 - b) + v[y1][:, x1] * b
    out = left * (1 - a) + right * a
    out = out != 0 if img.dtype == bool else out.astype(img.dtype)
    if strategy in ("", "noborder"):
        out = np.where(outside, img, out)
    elif strategy in ("constant", "background"):
        out = np.where(outside, np.asarray(background).astype(img.dtype), out)
    elif strategy == "nearest":
        cx, cy = np.clip(px, 0, w - 1).astype(int), np.clip(py, 0, h - 1).astype(int)
        out = np.where(outside, img[cy][:, cx], out)
    return out.astype(img.dtype)


def gaussian(img: np.ndarray, sigma: float, dtype=np.float32) -> np.ndarray:
    """Weights in bounds are normalised anew at the edges. Sums by row and by column, as the kernel is a product."""
    r = max(1, int(2 * sigma))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2.0 * sigma * sigma))

    def along(a, axis):
        out = np.zeros_like(a)
        n = a.shape[axis]
        for i, weight in enumerate(k):
            d = i - r
            if abs(d) < n:
                to, of = [slice(None)] * 2, [slice(None)] * 2
                to[axis], of[axis] = slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))
                out[tuple(to)] += weight * a[tuple(of)]
        return out

    one = along(along(np.ones(img.shape), 0), 1)
    return (along(along(img.astype(np.float32).astype(np.float64), 0), 1) / one).astype(dtype)


def _window(img: np.ndarray, y: int, x: int, r: int) -> np.ndarray:
    return np.sort(img[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].ravel())


def median3(img: np.ndarray) -> np.ndarray:
    h, w = img.shape
    out = img.copy()
    if h > 2 and w > 2:
        out[1:-1, 1:-1] = np.median(np.stack([img[a : h - 2 + a, b : w - 2 + b] for a in range(3) for b in range(3)]), 0)
    for edge in (0, h - 1):
        out[edge, 1:-1] = np.median(np.stack([img[edge, a : w - 2 + a] for a in range(3)]), 0)
        out[edge, 0], out[edge, -1] = min(img[edge, :2]), min(img[edge, -2:])
    for edge in (0, w - 1):
        out[1:-1, edge] = np.median(np.stack([img[a : h - 2 + a, edge] for a in range(3)]), 0)
    return out


def bad_pixels(img: np.ndarray, k: float = 5.0) -> list[tuple[int, int]]:
    """(y, x) of bad pixels of a frame."""
    if not img.size:
        return []
    own = img.astype(np.float64)
    m = np.partition(own.ravel(), own.size // 2)[own.size // 2]
    floor = max(0, m - int(k * np.sqrt(np.mean((own - m) ** 2))))
    around = np.lib.stride_tricks.sliding_window_view(np.pad(own, 2, constant_values=np.inf), (5, 5))
    out = []
    for top in range(0, len(own), 64):  # some rows at a time bound the memory; what is out of bounds sorts last
        v = np.sort(around[top : top + 64].reshape(-1, 25), 1)
        n = np.isfinite(v).sum(1)
        med = v[np.arange(len(v)), n // 2]
        at = np.arange(25)
        inner = (at >= (n // 5)[:, None]) & (at < (4 * n // 5)[:, None])
        s = np.sqrt((np.where(inner, v - med[:, None], 0) ** 2).sum(1) / np.maximum(1, inner.sum(1)))
        px = own[top : top + 64].ravel()
        (bad,) = np.nonzero((px < med - k * s) | (px > med + k * s) | (px < floor))
        out += [(top + int(i) // img.shape[1], int(i) % img.shape[1]) for i in bad]
    return out


def correct_bad_pixels(img: np.ndarray, bad: list[tuple[int, int]]) -> np.ndarray:
    """Bad pixels become the median of their 3x3 in the input; then nothing is below the median less two deviations."""
    out = img.copy()
    for y, x in bad:
        v = _window(img, y, x, 1)
        out[y, x] = v[len(v) // 2]
    flat = np.sort(img.ravel()).astype(np.float64)
    m = flat[len(flat) // 2]
    floor = m - int(2 * np.sqrt(np.mean((flat - m) ** 2)))
    return np.maximum(out, np.asarray(floor).astype(img.dtype)) if floor > 0 else out


def map_frames(frames: DataFrame, kernel: Callable[[np.ndarray, dict], np.ndarray], dtype: str = "<u2") -> DataFrame:
    """Frames (h, w, px BINARY, ...) with px through the kernel; the kernel also gets the row. One row is one frame."""

    def run(batches):
        for batch in batches:
            out = batch.copy()
            rows = batch.to_dict("records")
            out["px"] = [np.ascontiguousarray(kernel(np.frombuffer(r["px"], dtype).reshape(r["h"], r["w"]), r)).tobytes() for r in rows]
            yield out

    return frames.mapInPandas(run, frames.schema)


def _together(items: Iterable, size: Callable[[object], int]) -> Iterator[list]:
    """Items in lists of ROWS rows or more, so that small frames don't make a batch each."""
    held, n = [], 0
    for item in items:
        held.append(item)
        n += size(item)
        if n >= ROWS:
            yield held
            held, n = [], 0
    if held:
        yield held


def pixels_of(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], kind: str = "int") -> DataFrame:
    """frame, y, x, px of what the kernel makes of each packed frame (frame, h, w, px)."""

    def run(batches):
        for batch in batches:
            made = ((r.frame, kernel(np.frombuffer(r.px, "<u2").reshape(r.h, r.w))) for r in batch.itertuples(index=False))
            for some in _together(made, lambda own: own[1].size):
                places = [np.indices(out.shape).reshape(2, -1) for _, out in some]
                frame = np.repeat(np.array([f for f, _ in some]), [out.size for _, out in some])
                yield pd.DataFrame({"frame": frame, "y": np.concatenate([y for y, _ in places]), "x": np.concatenate([x for _, x in places]), "px": np.concatenate([out.ravel() for _, out in some])})

    return frames.mapInPandas(run, f"frame {dict(frames.dtypes)['frame']}, y int, x int, px {kind}")


def bad_pixels_of(frames: DataFrame, k: float = 5.0) -> DataFrame:
    """frame, y, x of the bad pixels of each packed frame."""

    def run(batches):
        for batch in batches:
            found = [(r.frame, y, x) for r in batch.itertuples(index=False) for y, x in bad_pixels(np.frombuffer(r.px, "<u2").reshape(r.h, r.w), k)]
            yield pd.DataFrame(found, columns=["frame", "y", "x"])

    return frames.mapInPandas(run, f"frame {dict(frames.dtypes)['frame']}, y int, x int")


def pack(frames: DataFrame, frame: str, values: str, w: int, scale: float, offset: float) -> DataFrame:
    """frame, h, w, px: an array column as packed 16-bit frames."""

    def run(batches):
        for batch in batches:
            own = [np.floor((np.asarray(v, np.float64) + offset) * scale).astype("<u2") for v in batch[values]]
            yield pd.DataFrame({"frame": batch[frame], "h": [len(v) // w for v in own], "w": w, "px": [v.tobytes() for v in own]})

    return frames.select(frame, values).mapInPandas(run, f"frame {dict(frames.dtypes)[frame]}, h int, w int, px binary")
