"""Folds over streams: frames out of order across triggers, late ones, what is written to the state."""

import numpy as np
import pytest

from emberframe.streaming import folds, ordered, registration

COLUMNS = "movie_id string, pos int, ts_ns long, h int, w int, px binary"


def frames_of(spark, n, seed=1, movies=("a", "b")):
    r = np.random.default_rng(seed)
    out = []
    for m in movies:
        base = r.integers(1000, 1400, (8, 9))
        for i in range(n):
            img = (base + r.integers(0, 9, base.shape) + (60 if i % 11 == 5 else 0)).astype("<u2")
            out.append((m, i, i * 1000, 8, 9, bytearray(img.tobytes())))
    return spark.createDataFrame(out, COLUMNS)


def streamed(spark, tmp_path, df, triggers, make, name, **trigger):
    for k, condition in enumerate(triggers):
        df.where(condition).orderBy("pos").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:02d}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(**(trigger or {"availableNow": True})).start()
    return q


def rows(table, *columns):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in (r[c] for c in columns)) for r in table.collect())


@pytest.mark.parametrize("kind", ["lossy", "adaptive", "steady"])
def test_frames_out_of_order_give_the_batch_result(spark, tmp_path, kind):
    df = frames_of(spark, 40)
    options = {"average": 4, "subtract_min": True, "local_min": True} if kind == "lossy" else {}
    batch, stream = {
        "lossy": (lambda d: folds.lossy(d, **options), lambda d: folds.lossy_stream(d, **options)),
        "adaptive": (lambda d: folds.downsample(d, 5), lambda d: folds.downsample_stream(d, 5)),
        "steady": (lambda d: folds.downsample(d, 5, steady=True), lambda d: folds.downsample_stream(d, 5, steady=True)),
    }[kind]
    triggers = ["pos between 5 and 9", "pos < 3", "pos in (3, 20, 21)", "pos = 4", "pos between 10 and 19", "pos > 21"]
    q = streamed(spark, tmp_path, df, triggers, stream, f"kept_{kind}")
    q.awaitTermination()
    want, got = batch(df), spark.table(f"kept_{kind}")
    columns = ["movie_id", "pos", "px", *(["low_error", "high_error", "min_t"] if kind == "lossy" else ["ts_ns"])]
    assert rows(got, *columns) == rows(want, *columns) and got.count() > 8
    assert {r.late for r in got.collect()} == {0}


def test_late_frames_are_counted_and_gaps_given_up(spark, tmp_path):
    df = frames_of(spark, 30, movies=("a",))
    # 4 is missing until its turn is given up: more than three frames wait then
    q = streamed(spark, tmp_path, df, ["pos < 4", "pos in (5, 6)", "pos in (6, 7)", "pos in (8, 9)", "pos in (4, 2)", "pos >= 10"], lambda d: folds.lossy_stream(d, patience=3), "late")
    q.awaitTermination()
    got = {r.pos: r.late for r in spark.table("late").collect()}
    assert sorted(got) == [i for i in range(30) if i != 4]
    assert got[3] == 0 and got[9] == 1 and got[29] == 3  # 6 came twice, 4 and 2 too late
    want = folds.lossy(df.where("pos != 4"))
    assert rows(spark.table("late"), "pos", "px") == rows(want, "pos", "px")


def test_a_gap_ends_by_time(spark, tmp_path):
    df = frames_of(spark, 8, movies=("a",))
    q = streamed(spark, tmp_path, df, ["pos < 3", "pos > 3"], lambda d: folds.lossy_stream(d, wait=1.0), "timed", processingTime="200 milliseconds")
    try:
        for _ in range(150):
            if spark.table("timed").count() == 7 or not q.isActive:
                break
            q.awaitTermination(0.3)
        assert rows(spark.table("timed"), "pos") == [(i,) for i in range(8) if i != 3]
    finally:
        q.stop()


def test_only_new_frames_are_written_to_the_state():
    class State:
        def __init__(self):
            self.held, self.written = {}, []

        def getValue(self, key):
            return self.held[key]

        def updateValue(self, key, value):
            self.held[key] = value
            self.written.append(key)

    plain, own, state, r = folds.RunningAverage(4), folds.RunningAverage(4), State(), np.random.default_rng(1)
    own.slots = ordered._Slots(state)
    for k in range(12):
        img, where = r.integers(0, 99, (5, 5)).astype("<u2"), r.random((5, 5)) < 0.2
        state.written.clear()
        for a in (plain, own):
            a.add(img)
            a.reset(where, img)
        assert state.written == [(k % 4,)] and (plain.mean() == own.mean()).all()
        again = folds.RunningAverage(4)  # as in the next trigger
        again.restore(own.scalars(), own.images())
        again.slots, own = own.slots, again


def test_a_registrators_state_does_not_grow():
    fold, y, x = registration.Registrator(), *np.mgrid[0:32, 0:40]
    for k in range(60):
        fold.step((2000 + 1500 * np.exp(-((x - 20 - k % 3) ** 2 + (y - 16) ** 2) / 60.0)).astype(np.uint16))
    assert len(fold.found) == fold.FIRST and fold.threshold is not None


def test_median_is_cut_in_both_images_and_restored():
    fold = registration.Registrator(median=0.9, sigma=0)
    y, x = np.mgrid[0:48, 0:64]
    frame = lambda k: (2000 + 1500 * np.exp(-((x - 20 - k) ** 2 + (y - 20) ** 2) / 60.0) + 800 * np.exp(-((x - 40 - k) ** 2 + (y - 30) ** 2) / 30.0)).astype(np.uint16)
    fold.step(frame(0))
    dx, dy, _ = fold.step(frame(1))
    assert abs(dx - 1) < 0.3 and abs(dy) < 0.3 and fold.median == 1
    own = registration.Registrator(median=0.5, mask=np.tile([1, 0], (4, 4)))
    img = np.tile(np.array([1.0, 100.0]), (4, 4)) * np.arange(1, 5)[:, None]
    assert own._ranked(img) == 2  # half of 1, 2, 3, 4, each four times, in the mask
    flat = registration.Registrator(median=0.9)
    for _ in range(2):
        flat.step(np.full((20, 20), 5, np.uint16))
    assert flat.median == pytest.approx(0.85) and flat.found[-1] == (0.0, 0.0, 1.0)


def test_a_registrator_finds_what_a_search_finds():
    y, x = np.mgrid[0:40, 0:52]
    frame = lambda a, b: 2000 + 1500 * np.exp(-((x - 18 - a) ** 2 + (y - 18 - b) ** 2) / 60.0) + 800 * np.exp(-((x - 34 - a) ** 2 + (y - 26 - b) ** 2) / 30.0)
    moves = [(0, 0), (0.6, -0.3), (1.3, -0.5), (1.9, -1.2), (2.4, -1.5)]
    frames = [np.floor(frame(a, b)).astype(np.uint16) for a, b in moves]
    fold = registration.Registrator(sigma=0)
    found = [fold.step(f) for f in frames]

    def shifted(img, dx, dy):
        """img at (x + dx, y + dy), and the part that is inside."""
        rows = np.stack([np.interp(np.arange(52) + dx, np.arange(52), r, np.nan, np.nan) for r in img.astype(float)])
        return np.stack([np.interp(np.arange(40) + dy, np.arange(40), c, np.nan, np.nan) for c in rows.T]).T

    for f, (dx, dy, rho) in zip(frames, found, strict=True):
        best = (-1.0, 0.0, 0.0)
        for a in np.arange(-0.4, 3.0, 0.1):
            for b in np.arange(-2.0, 0.5, 0.1):
                moved = shifted(f, a, b)
                ok = np.isfinite(moved)
                best = max(best, (float(np.corrcoef(moved[ok], frames[0][ok])[0, 1]), a, b))
        assert abs(dx - best[1]) < 0.25 and abs(dy - best[2]) < 0.25 and rho == pytest.approx(best[0], abs=0.01)
