"""Movies through the data source, the saver's life, and attributes of files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import reading
from emberframe.sources import attributes, datasource, formats, loaders, movies, saver
from test_sources import files


@pytest.fixture
def images():
    r = np.random.default_rng(7)
    return [r.integers(0, 8192, (12, 16)).astype("<u2") for _ in range(6)]


def test_ranges_equal_whole_files(spark, tmp_path, images, monkeypatch):
    for name, data in files(images).items():
        (tmp_path / f"{name}.bin").write_bytes(formats.with_trailer(data, {"a": b"1"}, [{"i": str(k).encode()} for k in range(6)], [k * 11 for k in range(6)]) if name == "WEST" else data)
    want = sorted((r.movie_id.split("/")[-1], r.pos, r.ts_ns, bytes(r.px), sorted((r.attrs or {}).items())) for r in movies.read_frames(spark, str(tmp_path)).collect())
    key = lambda rows: sorted((r.movie_id.split("/")[-1], r.pos, r.ts_ns, bytes(r.px), sorted((r.attrs or {}).items())) for r in rows)
    assert key(datasource.from_files(spark, str(tmp_path)).collect()) == want
    some = datasource.from_files(spark, f"{tmp_path}/*.bin", first=2, last=4, movie="*ST.bin")
    assert key(some.collect()) == [x for x in want if x[0] == "WEST.bin" and 2 <= x[1] <= 4]
    monkeypatch.setattr(datasource, "PART_BYTES", 800)
    monkeypatch.setattr(datasource, "OPEN_BYTES", 0)
    parts = datasource.MovieReader({"path": str(tmp_path)}).partitions()
    assert max(sum(end - begin for *_, begin, end in p.pieces) for p in parts) <= 800 and len(parts) > 12
    rows = [r for p in parts for b in datasource.MovieReader({"path": str(tmp_path)}).read(p) for r in b.to_pylist()]
    assert sorted((r["movie_id"].split("/")[-1], r["pos"], r["ts_ns"], r["px"], sorted(r["attrs"])) for r in rows) == want


def test_damaged_files_and_registered_loaders(spark, tmp_path, images):
    made = files(images)
    (tmp_path / "short.bin").write_bytes(made["ZSTD"][:-5])
    (tmp_path / "good.bin").write_bytes(made["ZSTD"])
    (tmp_path / "own.bin").write_bytes(b"MINE" + bytes(8))
    loaders.register_loader("mine", lambda head, size: head[:4] == b"MINE", lambda data: iter([(0, 5, np.ones((1, 4), "<u2"), {})]))
    try:
        got = {r.movie_id.split("/")[-1]: (r.format, r.readable) for r in movies.read_movies(spark, str(tmp_path)).collect()}
        assert got == {"short.bin": ("ZSTD", False), "good.bin": ("ZSTD", True), "own.bin": ("mine", True)}
        (row,) = movies.read_frames(spark, str(tmp_path / "own.bin")).collect()
        assert (row.ts_ns, row.w) == (5, 4)
    finally:
        loaders._LOADERS.pop(0)


def test_laboratory_movies_and_data_types():
    head = bytearray(formats.pcr_header(640, 512, 1, 50))
    head[36:40] = (7).to_bytes(4, "little")  # a wrong transfer size
    m = formats.sniff(bytes(head).ljust(4096, b"\0"), 1024 + 640 * 512 * 2)
    assert (m.format, m.stride, m.n) == ("PCR", 640 * 512 * 2, 1)
    h = np.zeros(1, formats.HCC_DTYPE)
    h["ImageHeaderLength"], h["Width"], h["Height"], h["CalibrationMode"] = 600, 4, 4, 2
    m = formats.sniff(b"TC" + h.tobytes()[2:].ljust(700, b"\0"), 632)
    assert (m.attrs["DataType"], m.attrs["DataUnit"]) == (b"RT", b"Radiometric Temperature (C)")


def test_the_life_of_a_saver(spark, tmp_path):
    r = np.random.default_rng(3)
    movie = (r.random((30, 8, 8)) * 50 + 1000).astype(np.uint16)
    a, b = saver.from_array(spark, "m", movie[:20], attrs=[{"k": i} for i in range(20)]), saver.from_array(spark, "m", movie[20:], list(range(400_000_000, 600_000_000, 20_000_000)))
    own = saver.Saver(str(tmp_path), attrs={"toto": b"2"}, compressionLevel=5)
    own.add(a)
    own.add(b)
    assert own.is_open()
    own.close()
    assert not own.is_open()
    with pytest.raises(ValueError):
        own.add(a)
    back = datasource.from_files(spark, str(tmp_path / "m.bin")).orderBy("pos").collect()
    assert [bytes(x.px) for x in back] == [i.tobytes() for i in movie] and [x.ts_ns for x in back] == [i * 20_000_000 for i in range(30)] and bytes(back[3].attrs["k"]) == b"3"
    assert formats.read_trailer((tmp_path / "m.bin").read_bytes())[0]["toto"] == b"2"
    with pytest.raises(Exception, match="exists|Exists|m.bin"):
        with saver.Saver(str(tmp_path)) as again:
            again.add(b)
    with saver.Saver(str(tmp_path), mode="ignore") as again:
        again.add(b)
    assert datasource.from_files(spark, str(tmp_path / "m.bin")).count() == 30
    with saver.Saver(str(tmp_path), mode="overwrite", codec="zstd") as lossy:
        lossy.set_parameter("lowValueError", 60)
        lossy.set_parameter("highValueError", 60)
        lossy.set_parameter("stdFactor", 0)
        lossy.set_parameter("subtractMin", 1)
        lossy.set_parameter("runningAverage", 0)
        lossy.add_lossy(a)
    back = datasource.from_files(spark, str(tmp_path / "m.bin")).orderBy("pos").collect()
    least = int(movie[0].min())
    assert len(back) == 20 and all(bytes(x.px) == (movie[0] - least).tobytes() for x in back)
    assert bytes(back[0].attrs["GlobalBackgroundError"]) == b"60" and bytes(back[5].attrs["ForegroundError"]) == b"60" and bytes(back[5].attrs["MIN_T"]) == str(least).encode()
    saver.convert(spark, str(tmp_path / "m.bin"), str(tmp_path / "out"), "pcr", 2, 5)
    assert [x.pos for x in datasource.from_files(spark, str(tmp_path / "out")).orderBy("pos").collect()] == list(range(5))


def test_attributes_are_set_discarded_and_flushed(spark):
    own = attributes.FileAttributes(b"movie")
    assert own.is_open() and own.frame_count() == 0 and own.flush() == b"movie"
    own.attributes = {"toto": 2, "tutu": "tata"}
    own.timestamps = [1, 2, 3]
    own.set_frame_attributes(1, {"x": b"y"})
    own.set_time(2, 9)
    data = own.close()
    again = attributes.FileAttributes(data)
    assert again.attributes == {"toto": b"2", "tutu": b"tata"} and again.timestamps == [1, 2, 9] and again.frame_attributes(1) == {"x": b"y"}
    again.attributes = {}
    again.discard()
    assert again.attributes["toto"] == b"2" and again.flush() == data
    with pytest.raises(IndexError):
        again.frame_attributes(3)
    files_ = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"plain"))], "path string, content binary")
    changes = spark.createDataFrame([("a", {"toto": bytearray(b"7")})], "path string, attrs map<string,binary>")
    got = {r.path: bytes(r.content) for r in attributes.with_attributes(files_, changes).collect()}
    assert formats.read_trailer(got["a"])[0] == {"toto": b"7", "tutu": b"tata"} and got["b"] == b"plain"


def test_raw_values_and_features(spark):
    df = saver.from_array(spark, "m", np.arange(24, dtype=np.uint16).reshape(2, 3, 4) * 1000)
    assert sorted((r.pos, r.value) for r in reading.raw_values(df, 1, 2).collect()) == [(0, 6000), (1, 18000)]
    assert reading.raw_values(df, 5, 0).count() == 0

    class Half(reading.Calibration):
        to_temp = to_dl = lambda self, v, ti, e: v

        def apply(self, img, inv_emissivity=1.0):
            return img // 2

        def tables(self):
            return {"half": np.array([0.5])}

    assert reading.table_names(Half()) == ["half"] and reading.table(Half(), "half")[0] == 0.5 and reading.table_names(None) == []
    assert reading.features(Half()) == {"calibrations": ["Digital Level", "Temperature"], "emissivity": False, "files": []}
    with pytest.raises(reading.CalibrationNotFound):
        reading.table(None, "half")
    assert [r.s for r in spark.createDataFrame([(8191,), (8190,), (8191 + 8192,)], "v int").select(reading.saturated(F.col("v")).alias("s")).collect()] == [True, False, True]


def test_matrices_stop_and_check_their_rows():
    assert movies.matrix_of("# c\n\n1 2\n3,4\n\n5 6\n") == [[1, 2], [3, 4]]
    assert movies.matrix_of("\0" * 256 + "1 2\n") == [[1, 2]]
    with pytest.raises(ValueError):
        movies.matrix_of("1 2\n3\n")
