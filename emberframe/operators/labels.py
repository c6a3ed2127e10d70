"""Connected regions of frames, by a kernel over packed frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label(img: np.ndarray, background=0, compat: bool = False) -> np.ndarray:
    """Labels of regions of 4-neighbours of one value in a frame, from 1 in the raster order of their first pixels; 0 where the
    background is. compat: pixels above each other are linked whenever both are not background.

    Runs of each row are linked with the runs that they touch in the row above, by union of their least numbers."""
    img = np.asarray(img)
    h, w = img.shape
    fore = img != background
    begins, ends = fore.copy(), fore.copy()
    begins[:, 1:] &= ~fore[:, :-1] | (img[:, 1:] != img[:, :-1])
    ends[:, :-1] &= ~fore[:, 1:] | (img[:, 1:] != img[:, :-1])
    ys, starts = np.nonzero(begins)
    stops = np.nonzero(ends)[1] + 1
    value = img[ys, starts].tolist()
    root = list(range(len(ys)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1)).tolist()
    a, b = starts.tolist(), stops.tolist()
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if a[i] < b[j] and a[j] < b[i] and (compat or value[i] == value[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(ys))], np.int64)
    _, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w), np.int32)
    for y, s, e, n in zip(ys.tolist(), a, b, number.tolist(), strict=True):
        out[y, s:e] = n + 1
    return out


def _packed(pixels: DataFrame) -> DataFrame:
    """frame, px: a frame's pixels in raster order, one row a frame."""
    own = F.array_sort(F.collect_list(F.struct("y", "x", "px")))
    return pixels.groupBy("frame").agg(F.transform(own, lambda e: e["px"]).alias("px"))


def regions(pixels: DataFrame, w: int, h: int, threshold: int) -> DataFrame:
    """frame, label, first_x, first_y, area of regions above threshold."""

    def run(batches):
        for batch in batches:
            out = []
            for frame, px in zip(batch["frame"], batch["px"], strict=True):
                flat = label(np.asarray(px).reshape(h, w) > threshold).ravel()
                ids, first, area = np.unique(flat, return_index=True, return_counts=True)
                keep = ids > 0
                out.append(pd.DataFrame({"frame": frame, "label": ids[keep], "first_x": first[keep] % w, "first_y": first[keep] // w, "area": area[keep]}))
            if out:
                yield pd.concat(out)

    kind = dict(pixels.dtypes)["frame"]
    return _packed(pixels).mapInPandas(run, f"frame {kind}, label int, first_x int, first_y int, area long")


def value_regions(pixels: DataFrame, w: int, h: int, background: int = 0, compat: bool = False) -> DataFrame:
    """frame, label, value, first_x, first_y, area of regions of one value; the value is that of a region's first pixel."""

    def run(batches):
        for batch in batches:
            for frame, px in zip(batch["frame"], batch["px"], strict=True):
                img = np.asarray(px).reshape(h, w)
                ids, first, area = np.unique(label(img, background, compat).ravel(), return_index=True, return_counts=True)
                keep = ids > 0
                yield pd.DataFrame({"frame": frame, "label": ids[keep], "value": img.ravel()[first[keep]], "first_x": first[keep] % w, "first_y": first[keep] // w, "area": area[keep]})

    return _packed(pixels).mapInPandas(run, f"frame {dict(pixels.dtypes)['frame']}, label int, value int, first_x int, first_y int, area long")


def largest(pixels: DataFrame, w: int, h: int, threshold: int, background: int, foreground: int) -> DataFrame:
    """frame, y, x, px: the largest region, of equals the first, in one value and the rest in another."""

    def run(batches):
        ys, xs = np.divmod(np.arange(w * h), w)
        for batch in batches:
            out = []
            for frame, px in zip(batch["frame"], batch["px"], strict=True):
                flat = label(np.asarray(px).reshape(h, w) > threshold).ravel()
                area = np.bincount(flat)
                area[0] = 0
                value = np.where(flat == area.argmax(), foreground, background) if area.any() else np.full(w * h, background)
                out.append(pd.DataFrame({"frame": frame, "y": ys, "x": xs, "px": value}))
            if out:
                yield pd.concat(out)

    kind = dict(pixels.dtypes)["frame"]
    return _packed(pixels).mapInPandas(run, f"frame {kind}, y int, x int, px int")
