"""Polygons as runs, calibrations as tables, islands by ranges, traced outlines: against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.functions import polygons as pg
from emberframe.operators import calibration, raster, reading
from emberframe.operators import frames as fr
from emberframe.operators import series as sr
from emberframe.sources import saver

POLYGONS = "movie_id int, poly_id int, pts array<struct<x:double,y:double>>"


def shapes(n=60, seed=3):
    r = random.Random(seed)
    out = [[], [(3.0, 3.0)], [(1.0, 2.0), (9.4, 7.5)], [(2.0, 2.0)] * 4, [(-5.0, -5.0), (30.0, -2.0), (12.0, 40.0)], [(4.0, 4.0), (8.0, 4.0), (8.0, 4.0)]]
    return out + [[(float(r.choice([r.uniform(-4, 24), r.randrange(20), r.randrange(20) + 0.5])), float(r.choice([r.uniform(-4, 24), r.randrange(20)]))) for _ in range(r.randrange(3, 12))] for _ in range(n)]


def test_runs_cover_what_filling_covers(spark):
    own = shapes()
    df = spark.createDataFrame([(i % 3, i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(own)] + [(0, 999, None)], POLYGONS)
    got = {}
    for r in raster.covered(df, 20, 16).collect():
        assert (r.y, r.x) not in got.setdefault(r.poly_id, set())
        got[r.poly_id].add((r.y, r.x))
    for i, p in enumerate(own):
        assert sorted(got.get(i, ())) == pg.fill_pixels(p, 20, 16), p
    counts = {r.poly_id: r.n for r in raster.pixel_counts(df, 20, 16).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    plan = raster.spans(df, 20, 16)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_values_of_frames_in_regions(spark):
    own, r = shapes(20), np.random.default_rng(1)
    df = spark.createDataFrame([(i % 3, i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(own)], POLYGONS)
    images = r.integers(0, 8192, (7, 16, 20))
    px = spark.createDataFrame([(f % 3, f, y, x, int(images[f, y, x])) for f in range(7) for y in range(16) for x in range(20)], "movie_id int, frame int, y int, x int, px int")
    got = {(x.frame, x.poly_id): (x.n, round(x.mean, 6), x.max) for x in raster.region_values(px, df, 20, 16).collect()}
    want = {}
    for f in range(7):
        for i, p in enumerate(own):
            v = [int(images[f, y, x]) for y, x in pg.fill_pixels(p, 20, 16)]
            if i % 3 == f % 3 and v:
                want[f, i] = (len(v), round(sum(v) / len(v), 6), max(v))
    assert got == want and len(want) > 20


def test_calibrations_go_both_ways(spark):
    r = np.random.default_rng(2)
    tables, rows = {}, []
    for movie, ti, n in [("a", 0, 8192), ("a", 1, 3), ("b", 0, 40), ("b", 1, 1)]:
        dl = np.sort(r.choice(8192, n, replace=False))
        t = np.cumsum(r.random(n) + 0.01)
        tables[movie, ti] = (dl, t)
        rows += [(movie, ti, int(a), float(b)) for a, b in zip(dl, t, strict=True)]
    rows += [("b", 0, int(tables["b", 0][0][5]), 1e9), ("b", 0, None, 5.0), ("b", 0, 4, None), ("b", 0, 5, float("nan"))]
    lookup = calibration.lookups(spark.createDataFrame(rows, "movie_id string, ti int, dl int, t double"))
    px = [(m, ti << 13 | int(v)) for m, ti in [*tables, ("c", 0)] for v in [0, 8191, *r.integers(0, 8192, 40), *tables.get((m, ti), ([], []))[0][:20]]]
    out = calibration.to_levels(calibration.of_pixels(spark.createDataFrame(px, "movie_id string, px int"), lookup), lookup).collect()
    assert len(out) == len(px)
    for x in out:
        if x.movie_id == "c":
            assert x.temperature is None and x.level is None
            continue
        dl, t = tables[x.movie_id, x.ti]
        assert x.temperature == pytest.approx(np.interp(x.dl, dl, t)) and x.level == int(np.floor(np.interp(x.temperature, t, dl) + 0.5))
        if dl[0] <= x.dl <= dl[-1]:
            assert x.level == x.dl
    warm = calibration.to_temperatures(spark.createDataFrame([("b", 0, 100)], "movie_id string, ti int, dl int"), lookup, inv_emissivity=F.lit(1.25)).first()
    assert warm.temperature == pytest.approx(np.interp(125, *tables["b", 0]))
    falling = calibration.lookups(spark.createDataFrame([("a", 0, 1, 5.0), ("a", 0, 2, 4.0)], "movie_id string, ti int, dl int, t double"))
    with pytest.raises(Exception, match="increase"):
        falling.collect()
    assert calibration.of_pixels(spark.createDataFrame([], "movie_id string, px int"), lookup).count() == 0


@pytest.mark.parametrize("width", [None, 5, 16])
def test_averages_with_resets(spark, width):
    r = random.Random(4)
    rows = [(m, i, r.randrange(100), r.choice([True, False, False, False, None])) for m in ("a", "b") for i in range(70)]
    df = spark.createDataFrame(rows, "movie_id string, pos int, v long, reset boolean").repartition(3)
    got = {(x.movie_id, x.pos): x.mean for x in fr.running_average_with_resets(df, 5, "v", F.col("reset"), width=width).collect()}
    for m in ("a", "b"):
        held = []
        for _, i, v, reset in [x for x in rows if x[0] == m]:
            held = [*held, v][-5:]
            if reset:
                held = [v] * len(held)
            assert got[m, i] == sum(held) // len(held)
    assert len(got) == 140
    marked = {(x.movie_id, x.pos): x.island for x in fr.islands(df, ["movie_id"], "pos", F.col("reset"), width).collect()}
    assert marked == {(m, i): sum(bool(x[3]) for x in rows if x[0] == m and x[1] <= i) for m, i, *_ in rows}
    with pytest.raises(ValueError):
        fr.running_average_with_resets(df, 5, "v", F.col("reset"), width=4)


def test_times_of_split_vectors(spark):
    nan = float("nan")
    vectors = {"a": [1.0, 2.0, 3.0, nan, 2.0, 3.0, 3.0], "b": [2.0, 2.5, 9.0], "c": [nan, 2.0, 4.0]}
    df = spark.createDataFrame([(k, i, t) for k, v in vectors.items() for i, t in enumerate(v)], "series_id string, pos int, t double")
    for width in (None, 2):
        assert sorted(x.t for x in sr.extract_times(df, order="pos", width=width).collect()) == [1.0, 2.0, 2.5, 3.0, 3.0, 4.0, 9.0]
        inner = sr.extract_times(df, sr.Strategy.INTERSECTION, order="pos", width=width)
        assert sorted(x.t for x in inner.collect()) == [2.0, 2.5, 3.0, 3.0]


def traced(img, value):
    """The outline as it is told: around each pixel clockwise from where the walk came from, to the next border pixel; then points within lines go,
    but for the first and the last."""
    h, w = img.shape
    inside = lambda x, y: 0 <= x < w and 0 <= y < h and img[y, x] == value
    edge = lambda x, y: inside(x, y) and not all(inside(x + a, y + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    ys, xs = np.nonzero(img == value)
    if not len(ys):
        return []
    start = at = (int(xs[0]), int(ys[0]))
    came, out = (start[0] - 1, start[1]), [start]
    around = [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]
    while True:
        k = around.index((came[0] - at[0], came[1] - at[1]))
        for step in range(1, 9):
            d = around[(k + step) % 8]
            if edge(at[0] + d[0], at[1] + d[1]):
                came, at = at, (at[0] + d[0], at[1] + d[1])
                break
        else:
            return [start] * 3
        out.append(at)
        if at == start:
            break
    if len(out) <= 3:
        return out
    kept = [out[0]]
    for i in range(1, len(out) - 1):
        (a, b), (x, y), (c, d) = out[i - 1 : i + 2]
        if not (x == a == c or y == b == d):
            kept.append(out[i])
    return [*kept, out[-1]]


def test_outlines_equal_the_plain_rule():
    r = np.random.default_rng(6)
    images = [np.array(a) for a in ([[0, 1, 0], [0, 1, 0], [1, 1, 1]], [[1, 1, 1]], [[1], [1]], [[1]], [[0, 0], [0, 0]])]
    images += [(r.random((r.integers(1, 9), r.integers(1, 9))) < p).astype(int) for p in (0.3, 0.5, 0.7, 0.9) for _ in range(100)]
    for img in images:
        assert [tuple(map(int, p)) for p in pg.extract_polygon(img, 1)] == traced(img, 1), img
    assert [tuple(p) for p in pg.extract_polygon(images[0], 1)][0] == (1, 0)
    both = np.array([[2, 2, 0, 5], [2, 0, 0, 5]])
    assert {int(k): [tuple(map(int, p)) for p in v] for k, v in pg.extract_polygons(both).items()} == {2: traced(both, 2), 5: traced(both, 5)}


def test_bad_pixels_of_a_part_of_a_movie(spark):
    r = np.random.default_rng(3)
    movie = r.integers(990, 1010, (6, 12, 12)).astype("<u2")
    movie[:, 4, 5] = 60_000
    df = saver.from_array(spark, "m", movie)
    hcc = saver.from_array(spark, "h", movie, attrs=[{"ImageHeaderLength": 5}] * 6)
    options = reading.ReadOptions(correct_bad=True)
    for own in (df, df.where("pos >= 3")):
        assert all(np.frombuffer(x.px, "<u2").max() < 1020 for x in reading.read_frames(own, options).collect())
    whole = reading.bad_pixels_by_movie(df)
    assert [4 * 12 + 5 in x.bad for x in whole.collect()] == [True]
    calm = df.where("pos = 2").withColumn("px", F.lit(np.full((12, 12), 1000, "<u2").tobytes()))
    mixed = reading.read_frames(calm.unionByName(df.where("pos > 2")), options, bad=whole).collect()
    assert len(mixed) == 4 and all(np.frombuffer(x.px, "<u2").max() < 1020 for x in mixed)
    assert all(np.frombuffer(x.px, "<u2").max() == 60_000 for x in reading.read_frames(hcc, options).collect())


def test_a_calibration_of_tables_is_the_same_for_columns_and_images(spark):
    r = np.random.default_rng(9)
    tables = {k: (np.sort(r.choice(8192, 30, replace=False)), np.cumsum(r.random(30) * 30 + 1)) for k in (0, 2)}
    own = calibration.TableCalibration(tables, files=["a.cal"])
    img = np.stack([r.integers(0, 8192, 50), r.integers(0, 8192, 50) | 2 << 13]).astype("<u2")
    df = spark.createDataFrame([(int(v),) for v in img.ravel()], "px int")
    ti, dl, e = F.shiftright("px", 13), F.col("px").bitwiseAND(F.lit(8191)), F.lit(1.1)
    got = df.select("px", own.to_temp(dl, ti, e).alias("t")).select("px", "t", own.to_dl(F.col("t"), ti, e).alias("back")).collect()
    assert [x.t for x in got] == pytest.approx(own.apply_float(img, 1.1).ravel().tolist(), rel=1e-6)
    assert (own.apply(img) == np.floor(own.apply_float(img) + 0.5)).all()
    for x in got:
        levels = tables[x.px >> 13][0]
        if levels[0] <= (x.px & 8191) * 1.1 <= levels[-1]:
            assert x.back == x.px & 8191
    assert reading.features(own) == {"calibrations": ["Digital Level", "Temperature"], "emissivity": True, "files": ["a.cal"]}
    listed = calibration.catalog(spark, {"m": own, "none": None})
    assert listed.where("name = 'levels_2'").first()["values"] == tables[2][0].tolist() and listed.count() == 4
    lookup = calibration.lookups(spark.createDataFrame([("m", k, int(a), float(b)) for k, (x, y) in tables.items() for a, b in zip(x, y, strict=True)], "movie_id string, ti int, dl int, t double"))
    assert (calibration.TableCalibration.of_movie(lookup, "m").apply(img) == own.apply(img)).all()
    with pytest.raises(reading.CalibrationNotFound):
        own.apply(np.array([[1 << 13]], "<u2"))
    with pytest.raises(ValueError):
        calibration.TableCalibration({0: ([1, 2], [5.0, 5.0])})
    frames = saver.from_array(spark, "m", np.tile(img, (1, 6, 1)))
    warm = reading.read_frames(frames, reading.ReadOptions(calibration=own)).first()
    assert (np.frombuffer(warm.px, "<u2").reshape(12, 50) == own.apply(np.tile(img, (6, 1)))).all()


def test_runs_of_a_polygon_need_no_shuffle_and_no_window(spark):
    df = spark.createDataFrame([(0, i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(shapes(5))], POLYGONS)
    plan = raster.spans(df, 20, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    far = [[(-70000.0, -3.0), (90000.0, 7.0), (5.0, 60000.0)], [(-9.0, -9.0), (-3.0, 40.0), (-1.0, 2.0)], [(3.0, -5.0), (3.0, -1.0), (9.0, -2.0)]]
    df = spark.createDataFrame([(0, i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(far)], POLYGONS)
    got = sorted((r.poly_id, r.y, x) for r in raster.spans(df, 20, 16).collect() for x in range(r.a, r.b + 1))
    assert got == [(i, y, x) for i, p in enumerate(far) for y, x in pg.fill_pixels(p, 20, 16)]


def test_regions_meet_frames_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(raster, "CELL_FRAMES", 2)
    monkeypatch.setattr(raster, "CELL_POLYGONS", 3)
    own = shapes(14)
    df = spark.createDataFrame([(i % 2 if i else None, i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(own)], POLYGONS)
    r = np.random.default_rng(1)
    rows = [(f % 2, f, y, x, None if r.random() < 0.3 or f == 2 else float(r.integers(0, 99))) for f in range(9) for y in range(16) for x in range(20) if r.random() < 0.5]
    rows += [(None, 7, 1, 1, 5.0), (5, 70, 1, 1, 5.0), (1, 3, -1, 0, 1.0), *rows[:200]]  # also pixels twice, outside, of no movie, of one without regions
    px = spark.createDataFrame(rows, "movie_id int, frame int, y int, x int, px double")
    out = raster.region_values(px, df, 20, 16)
    plain = px.join(raster.covered(df, 20, 16, by=("movie_id",)), ["movie_id", "y", "x"]).groupBy("movie_id", "frame", "poly_id").agg(F.count("*").alias("n"), F.avg("px").alias("mean"), F.max("px").alias("max"))
    assert out.schema.simpleString() == plain.schema.simpleString()
    told = lambda t: sorted((x.movie_id, x.frame, x.poly_id, x.n, None if x.mean is None else round(x.mean, 9), x.max) for x in t.collect())
    assert told(out) == told(plain) and len(told(out)) > 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # pairs come out of the meeting: no shuffle and no aggregate over them
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("Exchange") and "Aggregate" not in plan[: plan.index("FlatMapCoGroupsInArrow")]


def test_a_pair_of_series_is_dealt_by_ranges(spark):
    r = random.Random(5)
    both = [[(float(t), float(r.randrange(99))) for t in sorted(r.sample(range(300), 60))] for _ in range(2)]
    a, b = (spark.createDataFrame(x, "t double, v double") for x in both)
    for strategy in (sr.Strategy.UNION, sr.Strategy.INTERSECTION | sr.Strategy.INTERPOLATION, sr.Strategy.PAD_0 | sr.Strategy.INTERPOLATION):
        whole = sorted(map(tuple, sr.resample_pair(a, b, strategy).collect()))
        assert [sorted(map(tuple, sr.resample_pair(a, b, strategy, width).collect())) for width in (7.0, 1000.0)] == [whole, whole] and len(whole) > 60
