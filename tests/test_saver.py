import numpy as np
import pytest

from emberframe.operators import frames as fr
from emberframe.sources import formats, loaders, saver


def test_arrays_to_files_and_back(spark):
    r = np.random.default_rng(3)
    movie = r.integers(0, 8192, (7, 5, 6)).astype(np.uint16)
    df = saver.from_array(spark, "m", movie, list(range(0, 70, 10)), [{"k": i} for i in range(7)])
    for codec in ("zstd", "pcr"):
        (row,) = saver.encode_movies(df, codec, attrs={"toto": b"2"}).collect()
        data = bytes(row.content)
        attrs, per_frame, times, size = formats.read_trailer(data)
        assert (attrs, per_frame[3], times) == ({"toto": b"2"}, {"k": b"3"}, list(range(0, 70, 10)))
        assert all((img == movie[i]).all() for i, _, img, _ in formats.frames(data[: len(data) - size]))
    assert saver.from_array(spark, "m", movie[0]).count() == 1
    for bad in (movie[0, 0], movie[None]):
        with pytest.raises(ValueError):
            saver.from_array(spark, "m", bad)
    out = saver.export_range(df, 7, 4, 9)
    assert sorted(x.pos for x in out.collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        saver.export_range(df, 7, 7)


def test_parameters():
    assert saver.parameters(GOP=3)["GOP"] == 3
    for bad in ({"other": 1}, {"runningAverage": 65}):
        with pytest.raises(ValueError):
            saver.parameters(**bad)


def test_loaders():
    loaders.register_loader("own", lambda head, size: head[:3] == b"OWN", lambda data: iter([(0, 0, np.zeros((1, 1)), {})]))
    assert loaders.find_loader(b"OWN1", 4) == "own" and len(list(loaders.load(b"OWN1"))) == 1
    assert loaders.find_loader(b"\0\0\0\0ftyp", 8) == "H264" and loaders.find_loader(b"?", 1) is None


def test_slices(spark):
    df = spark.createDataFrame([(p,) for p in range(20)], "pos int")
    got = lambda *a: sorted(r.pos for r in fr.slice_frames(df, 20, *a).collect())
    assert got() == list(range(20)) and got(3, 0, 5) == [3, 8, 13, 18] and got(-4, -1) == [16, 17, 18] and got(5, 5) == []
    assert [r.pos for r in fr.at_position(df, -1, 20).collect()] == [19] and [r.pos for r in fr.at_position(df, 3, 20).collect()] == [3]
    for bad in (20, -21):
        with pytest.raises(IndexError):
            fr.at_position(df, bad, 20)
    assert [r.pos for r in fr.at_positions(df, [7, 2, 2]).orderBy("nr").collect()] == [7, 2, 2]
