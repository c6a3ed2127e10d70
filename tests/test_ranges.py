"""The movie source: conditions pushed, indices, planning without opening files, segments, files that grow."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import frames as fr
from emberframe.sources import datasource, formats, ranges, saver
from test_sources import files


@pytest.fixture
def images():
    r = np.random.default_rng(7)
    return [r.integers(0, 8192, (12, 16)).astype("<u2") for _ in range(200)]


def counted(log):
    """An opener that says what it reads."""
    log = str(log)

    def opener(path):
        from emberframe.sources.datasource import ChunkReader

        own = ChunkReader(path)

        def read(at, n):
            out = own(at, n)
            with open(log, "a") as f:
                f.write(f"{os.path.basename(path)} {at} {len(out)}\n")
            return out

        read.size = own.size
        return read

    return opener


def reads(log):
    out = [line.split() for line in log.read_text().splitlines()] if log.exists() else []
    log.write_text("")
    return [(name, int(at), int(n)) for name, at, n in out]


@pytest.fixture
def movies(tmp_path, images):
    folder = tmp_path / "movies"
    folder.mkdir()
    for k in range(3):
        data = formats.pcr_header(16, 12, 200, 50) + b"".join(i.tobytes() for i in images)
        (folder / f"m{k}.pcr").write_bytes(formats.with_trailer(data, {"a": b"1"}, [{"i": str(i).encode()} for i in range(200)], [i * 1000 for i in range(200)]))
    return folder


def test_conditions_are_pushed_and_only_those_bytes_are_read(spark, movies, tmp_path, images):
    log = tmp_path / "log"
    every = datasource.from_files(spark, str(movies), opener=counted(log))
    for condition, want in [
        ("pos = 5", {5}), ("pos in (3, 150)", {3, 150}), ("pos between 10 and 12", {10, 11, 12}), ("pos < 2", {0, 1}), ("pos >= 198", {198, 199}), ("ts_ns = 7000", {7}),
        ("ts_ns > 196000 and pos != 198", {197, 199}), ("pos > 5 and pos < 5", set()), ("pos = 1000", set()), ("ts_ns in (4000, 4001)", {4}), ("pos = 3 and ts_ns < 10", set()),
    ]:
        one = every.where(condition).where(F.col("movie_id").endswith("m1.pcr"))
        got = one.collect()
        assert {r.pos for r in got} == want and all(bytes(r.px) == images[r.pos].tobytes() and r.movie_id.endswith("m1.pcr") and bytes(r.attrs["i"]) == str(r.pos).encode() for r in got), condition
        own = reads(log)
        assert {name for name, *_ in own} <= {"m1.pcr"}
        pixels = sum(n for _, at, n in own if at >= formats.PCR_SIZE and at + n <= formats.PCR_SIZE + 200 * 384)
        assert pixels == 384 * len(want) or "!=" in condition, condition
    plan = every.where("pos = 5 and movie_id like '%m1.pcr'")._jdf.queryExecution().toString()
    assert "Filter (" not in plan.split("== Physical Plan ==")[1]
    assert {r.pos for r in fr.at_position(every, -1, 200).collect()} == {199} and len(fr.slice_frames(every, 200, 20, 30, 5).collect()) == 6


def test_attributes_read_no_pixel(spark, movies, tmp_path):
    log = tmp_path / "log"
    got = datasource.from_files(spark, str(movies), columns=["movie_id", "pos", "attrs"], opener=counted(log)).where("pos >= 100").collect()
    assert len(got) == 300 and all(bytes(r.attrs["i"]) == str(r.pos).encode() for r in got) and got[0].asDict().keys() == {"movie_id", "pos", "attrs"}
    assert not [x for x in reads(log) if x[1] >= ranges.HEAD and x[1] < formats.PCR_SIZE + 200 * 384]
    with pytest.raises(ValueError):
        datasource.MovieReader({"path": "x"}, type("S", (), {"fields": [type("F", (), {"name": "other"})]}))


def test_unequal_frames_go_by_their_index(spark, tmp_path, images):
    frames, log = saver.from_array(spark, "long", np.array(images), attrs=[{"i": i} for i in range(200)]), tmp_path / "log"
    datasource.to_files(frames, str(tmp_path / "out"))
    path = tmp_path / "out" / "long.bin"
    own = ranges.MovieFile((read := datasource.ChunkReader(str(path))), read.size)
    assert len(own.attributes()[ranges.POSITIONS]) == 1600 and len(own.attributes()[ranges.ATTRIBUTE_POSITIONS]) == 32
    (row,) = datasource.from_files(spark, str(path), opener=counted(log)).where("pos = 150").collect()
    assert bytes(row.px) == images[150].tobytes() and bytes(row.attrs["i"]) == b"150" and row.ts_ns == 150 * 20_000_000
    starts = own.positions()
    assert [x for x in reads(log) if ranges.HEAD <= x[1] < starts[-1]] == [("long.bin", starts[150], starts[151] - starts[150])]
    # without an index: a walk, or an index beside the file
    plain = tmp_path / "plain" / "z.bin"
    plain.parent.mkdir()
    plain.write_bytes(formats.zstd_movie(images, list(range(200))))
    want = [(i, i, im.tobytes()) for i, im in enumerate(images)]
    key = lambda df: sorted((r.pos, r.ts_ns, bytes(r.px)) for r in df.collect())
    assert key(datasource.from_files(spark, str(plain))) == want
    assert datasource.index_movies(spark, f"{plain.parent}/*.bin", str(tmp_path / "index")) == 1 and datasource.index_movies(spark, str(path), str(tmp_path / "index")) == 0
    assert key(datasource.from_files(spark, str(plain), opener=counted(log), index=str(tmp_path / "index")).where("pos in (7, 199)")) == [want[7], want[199]]
    assert sum(n < 20 for _, _, n in reads(log)) <= 2
    cut = tmp_path / "cut.bin"
    cut.write_bytes(plain.read_bytes()[:-5])
    with pytest.raises(Exception, match="ends within a frame"):
        datasource.from_files(spark, str(cut)).collect()


def test_pieces_cover_every_frame_once(spark, tmp_path, images, monkeypatch):
    for name, data in files(images[:6]).items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    reader = datasource.MovieReader({"path": str(tmp_path)})
    whole = {(r["movie_id"], r["pos"], r["px"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()}
    monkeypatch.setattr(datasource, "OPEN_BYTES", 0)
    for size in (37, 400, 1500):
        monkeypatch.setattr(datasource, "PART_BYTES", size)
        rows = [(r["movie_id"], r["pos"], r["px"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert len(rows) == len(whole) and set(rows) == whole


def test_planning_opens_no_file(tmp_path, monkeypatch):
    for k in range(10_000):
        (tmp_path / f"m{k}.pcr").touch()

    def fail(path):
        raise AssertionError("opened")

    monkeypatch.setattr(datasource, "ChunkReader", fail)
    parts = datasource.MovieReader({"path": str(tmp_path)}).partitions()
    assert sum(len(p.pieces) for p in parts) == 10_000 and 250 < len(parts) < 400
    one = datasource.PushingReader({"path": str(tmp_path)})
    assert list(one.pushFilters([datasource.EqualTo(("movie_id",), f"{tmp_path}/m77.pcr"), datasource.GreaterThan(("h",), 3)])) == [datasource.GreaterThan(("h",), 3)]
    assert [p[0] for s in one.partitions() for p in s.pieces] == [f"{tmp_path}/m77.pcr"]


def test_a_movie_from_many_tasks(spark, tmp_path, images):
    frames = saver.from_array(spark, "m", np.array(images), attrs=[{"i": i} for i in range(200)]).unionByName(saver.from_array(spark, "k", np.array(images[:3])))
    datasource.to_files(frames.repartition(5), str(tmp_path), codec="pcr", **{"attr.toto": "2"})
    assert sorted(os.listdir(tmp_path)) == ["k.pcr", "m.pcr"]
    data = (tmp_path / "m.pcr").read_bytes()
    attrs, per_frame, times, size = formats.read_trailer(data)
    assert attrs["toto"] == b"2" and [m["i"] for m in per_frame] == [str(i).encode() for i in range(200)] and times == [i * 20_000_000 for i in range(200)]
    assert all((img == images[i]).all() for i, _, img, _ in formats.frames(data[: len(data) - size]))
    # several segments of one movie, joined by the commit itself
    parts = frames.where("movie_id = 'm'").repartitionByRange(4, "pos").sortWithinPartitions("pos")
    assert parts.rdd.getNumPartitions() == 4
    parts.write.format("movie").mode("overwrite").option("codec", "pcr").option("attr.toto", "2").save(str(tmp_path))
    assert (tmp_path / "m.pcr").read_bytes() == data and sorted(os.listdir(tmp_path)) == ["k.pcr", "m.pcr"]
    with pytest.raises(Exception, match="same positions|order of their positions"):
        frames.where("movie_id = 'm'").repartition(3).sortWithinPartitions("pos").write.format("movie").mode("overwrite").save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["k.pcr", "m.pcr"]


def test_a_failed_task_leaves_nothing(spark, tmp_path, images):
    frames = saver.from_array(spark, "m", np.array(images))
    bad = frames.withColumn("px", F.when(F.col("pos") == 150, F.lit(b"short")).otherwise(F.col("px")))
    for write in (lambda: datasource.to_files(bad, str(tmp_path / "out")), lambda: bad.sortWithinPartitions("pos").coalesce(1).write.format("movie").mode("append").save(str(tmp_path / "out"))):
        with pytest.raises(Exception, match="2 bytes a pixel"):
            write()
        assert os.listdir(tmp_path / "out") == []


def test_a_task_holds_a_frame_of_a_long_movie(tmp_path):
    import tracemalloc

    class Row:
        movie_id, h, w, attrs = "m", 64, 64, {"k": bytearray(b"v")}

        def __init__(self, pos):
            self.pos, self.ts_ns, self.px = pos, pos, os.urandom(8192)

    writer = datasource.MovieWriter({"path": str(tmp_path)}, False)
    peaks = []
    for n in (200, 4000):
        tracemalloc.start()
        done = writer.write(Row(i) for i in range(n))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert done.segments[0]["last"] == n - 1
    assert peaks[1] < peaks[0] + 300_000  # of 33 MB
    writer.commit([done])
    assert len(formats.read_trailer((tmp_path / "m.bin").read_bytes())[2]) == 4000


def test_conversion_of_what_is_missing(spark, tmp_path, movies):
    target = tmp_path / "out"
    saver.convert(spark, f"{movies}/m0.pcr", str(target))
    before = os.stat(target / "m0.bin").st_mtime_ns
    saver.convert(spark, str(movies), str(target), missing_only=True)
    assert sorted(os.listdir(target)) == ["m0.bin", "m1.bin", "m2.bin"] and os.stat(target / "m0.bin").st_mtime_ns == before
    saver.convert(spark, f"{movies}/m0.pcr", str(target), missing_only=True)
    assert datasource.from_files(spark, str(target)).count() == 600


def test_movies_that_grow(spark, tmp_path, images):
    live, out, state = tmp_path / "live", tmp_path / "out", tmp_path / "state"
    live.mkdir()
    stamped = [i.tobytes() for i in images[:9]]
    path = live / "a.pcr"

    def run():
        q = datasource.follow(spark, str(live)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(once=True).start()
        q.awaitTermination()

    def seen():
        return sorted((os.path.basename(r.movie_id), r.pos, bytes(r.px)) for r in spark.read.parquet(str(out)).collect())

    path.write_bytes(formats.pcr_header(16, 12, 0, 50) + b"".join(stamped[:3]) + stamped[3][:100])
    run()
    assert seen() == [("a.pcr", i, stamped[i]) for i in range(3)]
    with open(path, "ab") as f:
        f.write(stamped[3][100:] + b"".join(stamped[4:6]))
    (live / "b.pcr").write_bytes(formats.pcr_header(16, 12, 0, 50)[:500])
    run()
    assert seen() == [("a.pcr", i, stamped[i]) for i in range(6)]
    with open(path, "ab") as f:  # the end of the movie, with a trailer
        f.write(b"".join(stamped[6:]) + formats.write_trailer({}, [{} for _ in range(9)], list(range(9))))
    (live / "b.pcr").write_bytes(formats.pcr_header(16, 12, 0, 50) + stamped[0])
    (live / "c.bin").write_bytes(formats.with_trailer(formats.zstd_movie(images[:2], [5, 6]), {}, [{}, {}], [5, 6]))
    run()
    run()
    assert seen() == [*(("a.pcr", i, stamped[i]) for i in range(9)), ("b.pcr", 0, stamped[0]), *(("c.bin", i, images[i].tobytes()) for i in range(2))]
    reader = datasource.MovieStream({"path": str(live)})
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions({str(path): 10**9}, reader.latestOffset())


def test_times_of_growing_movies(tmp_path):
    data = formats.pcr_header(4, 3, 0, 50, 32) + b"".join(bytes(24) + struct.pack("<q", 100 + i) for i in range(3))
    (tmp_path / "a.pcr").write_bytes(data)
    for stamps, want in (("true", [100, 101, 102]), ("false", [0, 20_000_000, 40_000_000])):
        own = datasource.MovieStream({"path": str(tmp_path), "stamps": stamps})
        assert [t for p in own.partitions({}, own.latestOffset()) for b in own.read(p) for t in b.column("ts_ns").to_pylist()] == want
