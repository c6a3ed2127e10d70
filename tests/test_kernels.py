import math
import random

import numpy as np
import pytest

from emberframe.functions import images, polygons
from emberframe.operators import labels
from emberframe.streaming import folds


def test_label_equals_flood_fill():
    r = np.random.default_rng(1)
    for p in (0.2, 0.5, 0.6, 0.8):
        for _ in range(40):
            m = r.random((r.integers(1, 14), r.integers(1, 14))) < p
            want, n = np.zeros(m.shape, int), 0
            for y, x in np.argwhere(m):
                if not want[y, x]:
                    n += 1
                    stack = [(y, x)]
                    while stack:
                        a, b = stack.pop()
                        if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not want[a, b]:
                            want[a, b] = n
                            stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
            assert (labels.label(m) == want).all()


def test_translate():
    img = np.arange(12, dtype=np.uint16).reshape(3, 4)
    assert (images.translate(img, 1, 0, "nearest")[:, 1:] == img[:, :-1]).all()
    assert (images.translate(img, 1, 0, "constant", 9)[:, 0] == 9).all()
    assert (images.translate(img, 4, 3, "wrap") == img).all()
    assert (images.translate(img, 1, 0) [:, 0] == img[:, 0]).all()
    assert images.translate(img, 0.5, 0, "nearest")[0, 1] == 0  # halfway between 0 and 1, cut
    assert images.translate(img.astype(float), 0.25, 0.5, "nearest")[1, 1] == pytest.approx(0.5 * (0.75 * 5 + 0.25 * 4) + 0.5 * (0.75 * 1 + 0.25 * 0))
    with pytest.raises(ValueError):
        images.translate(img, 0, 0, "other")


def test_gaussian_and_medians_equal_their_definitions():
    r = np.random.default_rng(2)
    img = r.integers(0, 9000, (7, 9)).astype(np.uint16)
    s, rad = 1.2, 2
    out, med = images.gaussian(img, s), images.median3(img)
    for y in range(7):
        for x in range(9):
            taps = [(math.exp(-((a - y) ** 2 + (b - x) ** 2) / (2 * s * s)), int(img[a, b])) for a in range(7) for b in range(9) if abs(a - y) <= rad and abs(b - x) <= rad]
            assert out[y, x] == pytest.approx(sum(k * v for k, v in taps) / sum(k for k, _ in taps), rel=1e-5)
            if 0 < y < 6 and 0 < x < 8:
                assert med[y, x] == sorted(img[y - 1 : y + 2, x - 1 : x + 2].ravel())[4]
    assert med[0, 0] == min(img[0, :2]) and med[0, 3] == sorted(img[0, 2:5])[1] and med[3, 8] == sorted(img[2:5, 8])[1]
    img[3, 3] = 60000
    assert (3, 3) in images.bad_pixels(img) and images.correct_bad_pixels(img, [(3, 3)])[3, 3] < 60000


P = [[0, 0], [1, 0], [1.2, 0.2], [1.8, 0.1], [5, 5], [3.2, 5], [0, 9]]


def test_polygons():
    hull = polygons.convex_hull(P)
    assert tuple(hull[0]) == (0, 9) and (hull[0] == hull[-1]).all()
    for x, y in P:
        cross = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(hull, hull[1:], strict=False)]
        assert all(c >= -1e-9 for c in cross) or all(c <= 1e-9 for c in cross)
    box = polygons.minimum_area_box([[0, 0], [4, 0], [4, 2], [0, 2]])
    assert (box["cx"], box["cy"], box["width"], box["height"]) == pytest.approx((2, 1, 2, 4))
    turned = [[math.cos(0.3) * x - math.sin(0.3) * y, math.sin(0.3) * x + math.cos(0.3) * y] for x, y in [[0, 0], [4, 0], [4, 2], [0, 2]]]
    box = polygons.minimum_area_box(turned)
    assert (box["width"], box["height"]) == pytest.approx((2, 4))
    few = polygons.simplify_to(P, 4)
    assert len(few) == 4 and (few[0] == P[0]).all() and (few[-1] == P[-1]).all()
    a, b = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float), np.array([[10, 0], [18, 0], [18, 8], [10, 8]], float)
    assert (polygons.interpolate(a, b, 0) == a).all() and (polygons.interpolate(a, b, 1) == b).all()
    half = polygons.interpolate(a, b, 0.5)
    assert half.min(0) == pytest.approx([5, 0]) and half.max(0) == pytest.approx([11, 6])


def test_fill_and_trace_round_trip():
    img = np.zeros((20, 30), np.int32)
    shape = [(3, 3), (20, 3), (20, 12), (3, 12)]
    drawn = polygons.draw(img, shape, 5)
    assert (drawn == 5).sum() == 18 * 10
    ring = polygons.extract_polygon(drawn, 5)
    assert {tuple(map(int, p)) for p in ring} == {(3, 3), (20, 3), (20, 12), (3, 12)}
    assert (polygons.draw(img, ring[:-1], 5) == drawn).all()
    assert polygons.fill_pixels([(2, 2)], 30, 20) == [(2, 2)] and len(polygons.fill_pixels([(0, 0), (9, 3)], 30, 20)) == 10
    assert len(polygons.extract_polygon(polygons.draw(img, [(7, 7)], 1), 1)) == 3
    assert polygons.fill_pixels([], 5, 5) == []


def movie(n=130, seed=3):
    r = np.random.default_rng(seed)
    base = (r.random((12, 16)) * 1000).astype(np.float64)
    out = []
    for i in range(n):
        img = base + r.normal(0, 0.7, base.shape)
        if i % 37 == 20:
            img[3:6, 3:6] += 400
        out.append(np.clip(img, 0, 8191).astype(np.uint16))
    return out


def test_loss_is_bounded():
    for average in (0, 8):
        fold, seen = folds.Loss(3, 3, 0.0, average), []
        for img in movie():
            out, low, high = fold.step(img)
            seen.append(out)
            assert (low, high) == (3, 3)
            assert np.abs(out.astype(int) - img).max() <= (3 if not average else 6)
        assert sum((a == b).mean() for a, b in zip(seen, seen[1:], strict=False)) / len(seen) > (0.9 if not average else 0.5)


def test_downsampler():
    fold, kept = folds.Downsampler(10, 0.9), []
    frames = movie(400)
    for i, img in enumerate(frames):
        if (out := fold.step(img, i)) is not None:
            kept.append((i, out))
    assert fold.step(frames[0], 5) is None  # an earlier time
    at = [i for i, _ in kept]
    assert at[:9] == list(range(0, 90, 10)) and 40 <= len(at) < 250
    for (a, _), (b, img) in zip(kept, kept[1:], strict=False):
        assert (img == np.max(frames[a + 1 : b + 1], 0)).all()


def test_batch_equals_stream(spark, tmp_path):
    rows = [(m, i, i * 1000, 12, 16, bytearray(img.tobytes())) for m in ("a", "b") for i, img in enumerate(movie(30, ord(m)))]
    df = spark.createDataFrame(rows, "movie_id string, pos int, ts_ns long, h int, w int, px binary")
    want = sorted((r.movie_id, r.pos, bytes(r.px), r.low_error) for r in folds.lossy(df, average=4).collect())
    for k in range(3):
        df.where(f"pos div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = folds.lossy_stream(stream, average=4).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.movie_id, r.pos, bytes(r.px), r.low_error) for r in spark.table("kept").collect()) == want
    assert len(want) == 60 and folds.downsample(df, 5).count() == 12


def test_frames_keep_their_order():
    r = random.Random(1)
    import pandas as pd

    rows = [("a", i, 2, 2, np.full((2, 2), i, np.uint16).tobytes()) for i in range(20)]
    r.shuffle(rows)
    out = folds._lossy_rows(folds.Loss(), pd.DataFrame(rows, columns=["movie_id", "pos", "h", "w", "px"]))
    assert list(out.pos) == list(range(20))


def test_steady_downsampler_and_running_average():
    fold, frames = folds.SteadyDownsampler(10), movie(200)
    at = [i for i, img in enumerate(frames) if fold.step(img, i) is not None]
    assert set(range(0, 200, 10)) <= set(at) and len(at) < 120
    avg, r = folds.RunningAverage(3), np.random.default_rng(1)
    seen = []
    for k in range(8):
        img = r.integers(0, 99, (2, 2))
        avg.add(img)
        seen.append(img.copy())
        if k == 4:
            avg.reset(np.array([[True, False], [False, False]]), np.full((2, 2), 7))
            for old in seen:
                old[0, 0] = 7
        assert (avg.mean() == sum(seen[-3:]) // len(seen[-3:])).all()


def test_murmur(spark):
    from emberframe.functions.hashing import hash_bytes, murmur64

    assert len({hash_bytes(b"x" * n) for n in range(40)}) == 40 and hash_bytes(b"") == hash_bytes(b"") < 1 << 64
    rows = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary").select(murmur64("b").alias("h")).collect()
    assert int(rows[0].h) == hash_bytes(b"abc") and rows[1].h is None


def test_unzip(spark, tmp_path):
    import zipfile

    from emberframe.sources.archives import unzip

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("d/two.bin", b"22")
    (tmp_path / "b.txt").write_text("no archive")
    assert sorted((r.name, bytes(r.content)) for r in unzip(spark, str(tmp_path)).collect()) == [("d/two.bin", b"22"), ("one.txt", b"1")]
