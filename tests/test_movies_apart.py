"""Windows over pixels keep movies apart; exploded and packed forms of a stencil agree; ranges of a series join up."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.functions import hashing, images
from emberframe.operators import frames as fr
from emberframe.operators import series as sr
from emberframe.plans import tables

SF = "/root/testdata/sf0.001"


def two_movies(spark):
    r = random.Random(3)
    rows = [(m, f, y, x, r.randrange(1000)) for m in (1, 2) for f in range(5) for y in range(3) for x in range(2)]
    return spark.createDataFrame(rows, "movie_id long, frame long, y int, x int, px int")


@pytest.mark.parametrize("verb", [
    lambda p, by: fr.frame_differences(p, by), lambda p, by: fr.running_average(p, 3, by), lambda p, by: fr.split_deviation(p, fr.background(p, by), by),
])
def test_two_movies_do_not_mix(spark, verb):
    both = two_movies(spark)
    got = sorted(map(tuple, verb(both, ("movie_id",)).collect()))
    want = sorted((m, *x) for m in (1, 2) for x in map(tuple, verb(both.where(F.col("movie_id") == m).drop("movie_id"), ()).collect()))
    assert got == want


def test_exploded_stencils_equal_packed_ones(spark):
    pixels, packed = tables.pixels(spark, SF), tables.packed(spark, SF)
    a = {(r.frame, r.y, r.x): r.px for r in images.pixels_of(packed, images.median3).collect()}
    assert a == {(r.frame, r.y, r.x): r.px for r in fr.median3(pixels, 8, 8).collect()}
    bad = {(r.frame, r.y, r.x) for r in images.bad_pixels_of(packed, 1.5).collect()}
    assert bad and bad == {(r.frame, r.y, r.x) for r in fr.bad_pixels(pixels, 1.5).collect()}
    g = {(r.frame, r.y, r.x): r.px for r in images.pixels_of(packed, lambda i: images.gaussian(i, 0.75, np.float64), "double").collect()}
    want = {(r.frame, r.y, r.x): r.value for r in fr.gaussian(pixels, 0.75).collect()}
    assert g.keys() == want.keys() and all(abs(g[k] - want[k]) < 1e-6 for k in g)


def test_bad_pixels_of_a_whole_frame_take_little_time():
    import time

    img = np.random.default_rng(1).integers(0, 1000, (512, 640)).astype("<u2")
    img[100, 200] = 60000
    began = time.time()
    assert (100, 200) in images.bad_pixels(img, 5.0)
    assert time.time() - began < 20


def test_hash_of_many_equals_one_by_one():
    r = random.Random(5)
    rows = [r.randbytes(r.choice([0, 1, 7, 8, 9, 16, 63, 200, 5000])) for _ in range(200)]
    assert hashing.hash_many(rows).tolist() == [hashing.hash_bytes(x) for x in rows]
    assert hashing.hash_many([]).tolist() == []


def test_ranges_of_a_series_join_up(spark):
    r = random.Random(7)
    samples = spark.createDataFrame([(s, float(t), r.random()) for s in ("a", "b") for t in sorted(r.sample(range(5000), 40))] + [("c", 5.0, 1.0)], "series_id string, t double, v double")
    times = spark.createDataFrame([(s, t * 13.5) for s in ("a", "b", "c") for t in range(-5, 400)], "series_id string, t double")
    whole = sorted(map(tuple, sr.resample(samples, times).collect()))
    for width in (10.0, 333.0, 1e9):
        assert sorted(map(tuple, sr.resample(samples, times, width=width).collect())) == whole
