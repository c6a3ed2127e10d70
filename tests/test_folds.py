"""The folds against plain versions, value by value, on the given frames."""

import hashlib

import numpy as np
import pytest

from emberframe.plans import kernels, registry
from emberframe.streaming import folds, registration

SF = "/root/testdata/sf0.001"


def movies(spark):
    out: dict = {}
    for r in kernels._frames(spark, SF).orderBy("movie_id", "pos").collect():
        out.setdefault(r.movie_id, []).append(np.frombuffer(r.px, "<u2").reshape(r.h, r.w))
    return out


def plain_loss(frames, high_error, low_error, std_factor, average=0, rows=8, calibrate=None, local_min=False, one_sided=False):
    """Pixel by pixel, with lists."""
    h, w = frames[0].shape
    history, first, ref, prev, level, least, sums = [], None, None, None, None, None, {}
    for img in frames:
        own = [[int(v) for v in r] for r in img.tolist()]
        value = [r[:] for r in own]
        if calibrate:
            value[:rows] = calibrate(img[:rows]).astype(int).tolist()
        if local_min:
            now = min(min(r) for r in value[:rows])
            least = now if least is None else min(least, now)
            value[:rows] = [[max(0, v - least) for v in r] for r in value[:rows]]
        out = [r[:] for r in value]
        if ref is None:
            ref = {(y, x): value[y][x] for y in range(rows) for x in range(w)}
            low, high = low_error, high_error
        else:
            bins: dict = {}
            for r in own[:rows]:
                for v in r:
                    bins[v >> 2] = bins.get(v >> 2, 0) + 1
            bg = min((-n, b) for b, n in bins.items())[1] * 4 + 1

            def dev(where):
                d = [abs(value[y][x] - prev[y, x]) for y in range(rows) for x in range(w) if where(own[y][x])]
                return (sum(d) ** 2 - sum(v * v for v in d)) ** 0.5 / len(d) if d else 0.0

            pair = (dev(lambda v: v <= bg), dev(lambda v: v > bg)) if len(history) >= 40 else (dev(lambda v: True),) * 2
            first = first or pair
            history = [*history, pair][-40:]
            mean = [(first[k] + sum(p[k] for p in history)) / (1 + len(history)) for k in (0, 1)]
            off = [max(0, pair[k] - mean[k]) if one_sided else abs(pair[k] - mean[k]) for k in (0, 1)]
            high = max(0, high_error - int(off[1] * std_factor + 0.5))
            low = max(high, low_error - int(off[0] * std_factor + 0.5))
            for y in range(rows):
                for x in range(w):
                    v, past = value[y][x], sums.setdefault((y, x), [])
                    past.append(v)
                    same = one_sided or level[y, x] >> 13 == own[y][x] >> 13
                    if abs(v - ref[y, x]) <= (high if own[y][x] > bg else low) and same:
                        out[y][x] = sum(past[-average:]) // len(past[-average:]) if average else ref[y, x]
                    else:
                        ref[y, x] = v
                        sums[y, x] = [v] * len(past)
        prev = {(y, x): out[y][x] for y in range(rows) for x in range(w)}
        level = {(y, x): own[y][x] for y in range(rows) for x in range(w)}
        yield np.array(out), low, high, least


@pytest.mark.parametrize("query, options", [
    ("z1_lossy", {"average": 8}), ("z2_lossy_with_camera", {"average": 4, "rows": 6, "calibrate": kernels.half, "local_min": True}), ("z3_add_loss", {"one_sided": True}),
])
def test_losses_equal_plain_ones(spark, query, options):
    errors = (150, 300) if query.startswith("z2") else (300, 600)
    want = {(m, i, hashlib.md5(o.astype("<u2").tobytes()).hexdigest(), low, high) for m, own in movies(spark).items() for i, (o, low, high, _) in enumerate(plain_loss(own, *errors, 0.5, **options))}
    assert {(r.movie_id, r.pos, r.px_md5, r.low_error, r.high_error) for r in registry.queries()[query](spark, SF).collect()} == want
    assert len({x[3] for x in want}) > 3


def test_history_is_the_first_and_the_last_forty():
    r = np.random.default_rng(8)
    frames = [(r.integers(0, 1000, (6, 6)) + (i > 60) * r.integers(0, 300, (6, 6))).astype(np.uint16) for i in range(120)]
    fold = folds.Loss(20, 60, 1.0)
    got = [fold.step(f)[1:] for f in frames]
    assert got == [(low, high) for _, low, high, _ in plain_loss(frames, 20, 60, 1.0, rows=6)]


def test_integration_time_starts_a_pixel_anew():
    a = np.full((4, 4), 100, np.uint16)
    b = a + 1
    b[0, 0] = 100 | (1 << 13)
    fold = folds.Loss(60000, 60000, 0.0)
    fold.step(a)
    out = fold.step(b)[0]
    assert out[1, 1] == 100 and out[0, 0] == 100 | (1 << 13)
    fold = folds.Loss(60000, 60000, 0.0, reduce_only=True)
    fold.step(a)
    assert fold.step(b)[0][0, 0] == 100


def plain_downsample(frames, factor, part):
    """(position, image) that are kept."""
    diffs, previous, top, last, out = [], None, None, -1, []
    for i, img in enumerate(frames):
        top = img if top is None else np.maximum(top, img)
        keep = previous is None
        if previous is not None:
            d = np.abs(img.astype(float) - previous).ravel()
            d = float(((d * d).sum() - d.sum() ** 2 / len(d)) / (len(d) - 1)) ** 0.5
            if len(diffs) < 96:
                keep = i % factor == 0
                diffs.append(d)
            else:
                mean = sum(diffs) / 96
                std = (sum((x - mean) ** 2 for x in diffs) / 95) ** 0.5
                nothing = d < mean - 0.5 * std and i - last < 2 * factor
                keep = (d > sorted(diffs)[part] or i - last >= factor) and not nothing
                if d < mean + 10 * std:
                    diffs = [*diffs[1:], d]
        previous = img
        if keep:
            out.append((i, top))
            top, last = None, i
    return out


def test_downsampler_equals_a_plain_one(spark):
    r = np.random.default_rng(4)
    base = r.integers(0, 4000, (8, 8))
    frames = [(base + r.integers(0, 40 + (i // 50 % 3) * 60, (8, 8))).astype(np.uint16) for i in range(500)]
    rows = [("m", i, i * 20, 8, 8, bytearray(f.tobytes())) for i, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "movie_id string, pos int, ts_ns long, h int, w int, px binary").repartition(5)
    got = {r.pos: np.frombuffer(r.px, "<u2").reshape(8, 8) for r in folds.downsample(df, 7, factor_std=0.8).collect()}
    want = dict(plain_downsample(frames, 7, int(0.8 * 96)))
    assert got.keys() == want.keys() and 71 < len(want) < 500 and all((got[k] == want[k]).all() for k in want)


def test_downsampling_query_equals_a_plain_one(spark):
    want = {(m, i, hashlib.md5(o.astype("<u2").tobytes()).hexdigest()) for m, own in movies(spark).items() for i, o in plain_downsample(own, 5, 48)}
    assert {(r.movie_id, r.pos, r.px_md5) for r in registry.queries()["z5_downsample"](spark, SF).collect()} == want


def shapes(n=12):
    y, x = np.mgrid[0:48, 0:64]
    return [(2000 + 1500 * np.exp(-((x - 20 - k) ** 2 + (y - 20) ** 2) / 60.0) + 800 * np.exp(-((x - 40 - k) ** 2 + (y - 30) ** 2) / 30.0)).astype(np.uint16) for k in range(n)]


def test_registration_finds_shifts_in_batches_and_streams(spark, tmp_path):
    rows = [("m", i, 48, 64, bytearray(f.tobytes())) for i, f in enumerate(shapes())]
    df = spark.createDataFrame(rows, "movie_id string, pos int, h int, w int, px binary")
    got = {r.pos: (r.dx, r.dy) for r in registration.register(df).collect()}
    assert all(abs(got[i][0] - i) < 0.1 and abs(got[i][1]) < 0.1 for i in range(12))
    for k in range(3):
        df.where(f"pos div 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = registration.register_stream(stream).writeStream.format("memory").queryName("registered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.pos: (r.dx, r.dy) for r in spark.table("registered").collect()} == got


def test_registration_with_a_mask_ignores_what_it_hides():
    frames = shapes(6)
    r = np.random.default_rng(1)
    for f in frames:
        f[40:, :] = r.integers(0, 8000, (8, 64))
    mask = np.ones((48, 64))
    mask[38:] = 0
    fold = registration.Registrator(mask=mask, pre_process=lambda img: img.astype(np.float32) / 2)
    found = [fold.step(f) for f in frames]
    assert all(abs(dx - i) < 0.1 and abs(dy) < 0.1 for i, (dx, dy, _) in enumerate(found))


def plain_steady(frames, factor):
    """(position, image) that the variant for steady movies keeps."""
    diffs, top, out = [], None, [(0, frames[0])]
    for i in range(1, len(frames)):
        d = np.abs(frames[i].astype(float) - frames[i - 1]).ravel()
        d = float(((d * d).sum() - d.sum() ** 2 / len(d)) / (len(d) - 1)) ** 0.5
        top = frames[i] if top is None else np.maximum(top, frames[i])
        keep = i % factor == 0
        if len(diffs) < 10:
            diffs.append(d)
        else:
            mean = sum(diffs) / len(diffs)
            std = (sum((x - mean) ** 2 for x in diffs) / (len(diffs) - 1)) ** 0.5
            steady = std / mean < 0.1 and d < mean + 2 * std
            if keep or mean - std < d < mean + 5 * std:
                diffs = [*diffs, d][-96:]
            keep = keep or (not steady and d > mean + 0.5 * std)
        if keep:
            out.append((i, top))
            top = None
    return out


def test_steady_query_equals_a_plain_one(spark):
    want = {(m, i, hashlib.md5(o.astype("<u2").tobytes()).hexdigest()) for m, own in movies(spark).items() for i, o in plain_steady(own, 5)}
    assert {(r.movie_id, r.pos, r.px_md5) for r in registry.queries()["z6_downsample_steady"](spark, SF).collect()} == want
    r = np.random.default_rng(4)
    frames = [(r.integers(0, 40 + (i // 50 % 3) * 60, (8, 8)) + 100).astype(np.uint16) for i in range(400)]
    fold = folds.SteadyDownsampler(7)
    got = {i: o for i, f in enumerate(frames) if (o := fold.step(f, i)) is not None}
    want = dict(plain_steady(frames, 7))
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
