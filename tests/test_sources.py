import struct

import numpy as np
import pytest

from emberframe.sources import formats, movies


@pytest.fixture
def images():
    r = np.random.default_rng(7)
    return [r.integers(0, 8192, (12, 16)).astype("<u2") for _ in range(6)]


def files(images):
    raw = b"".join(i.tobytes() for i in images)
    stamped = b"".join(i.tobytes() + struct.pack("<q", 1_000_000_000_000 + k * 20_000_000) for k, i in enumerate(images))
    head = np.zeros(1, formats.HCC_DTYPE)
    hcc = b""
    for k, i in enumerate(images):
        head["ImageHeaderLength"], head["Width"], head["Height"], head["AcquisitionFrameRate"], head["FWPosition"] = 600, 16, 12, 50_000, [0, 1, 2, 0, 1, 2][k]
        h = bytearray(head.tobytes().ljust(600, b"\0"))
        h[:2] = b"TC"
        hcc += bytes(h) + i.tobytes()
    west = bytes([2, 1, 0]).ljust(128, b"\0") + struct.pack("<11q", 5, 25, 6, 0, 1, 1, 0, 3, 1, 16, 12).ljust(128, b"\0") + raw
    return {
        "PCR": formats.pcr_header(16, 12, 6, 50) + raw, "PCR_TIMES": formats.pcr_header(16, 12, 6, 50, 16 * 12 * 2 + 8) + stamped,
        "PCR_ENCAPSULATED": b"\x00" * 133 + formats.pcr_header(16, 12, 6, 50) + raw, "WEST": west, "ZSTD": formats.zstd_movie(images, [k * 7 for k in range(6)]), "HCC": hcc,
    }


def test_every_format_reads_back(spark, tmp_path, images):
    made = files(images)
    for name, data in made.items():
        more = formats.with_trailer(data, {"toto": b"2"}, [{"i": str(k).encode()} for k in range(6)], [k * 11 for k in range(6)]) if name == "WEST" else data
        (tmp_path / f"{name}.bin").write_bytes(more)
    (tmp_path / "bad.bin").write_bytes(b"nothing of the kind")
    table = {r.movie_id.split("/")[-1][:-4]: r for r in movies.read_movies(spark, str(tmp_path)).collect()}
    assert {k: table[k].format for k in made} == {k: "PCR" if k == "PCR_TIMES" else k for k in made}
    assert not table["bad"].readable and all((table[k].n_frames, table[k].width, table[k].height) == (6, 16, 12) for k in made)
    (tmp_path / "bad.bin").unlink()
    rows = movies.read_frames(spark, str(tmp_path)).collect()
    assert len(rows) == 36
    for r in rows:
        assert bytes(r.px) == images[r.pos].tobytes()
    times = {n: [r.ts_ns for r in sorted(rows, key=lambda r: r.pos) if r.movie_id.endswith(f"/{n}.bin")] for n in made}
    assert times["PCR"] == [k * 20_000_000 for k in range(6)] and times["PCR_TIMES"][1] - times["PCR_TIMES"][0] == 20_000_000
    assert times["ZSTD"] == [k * 7 for k in range(6)] and times["WEST"] == [k * 11 for k in range(6)] and times["HCC"][1] == 20_000_000
    assert [bytes(r.attrs["FWPosition"]).decode() for r in sorted(rows, key=lambda r: r.pos) if r.movie_id.endswith("HCC.bin")] == ["0", "1", "2", "0", "1", "2"]
    assert bytes(table["WEST"].attrs["toto"]) == b"2"


def test_trailer_compresses_long_values():
    values = {str(n): bytes(n % 251 for _ in range(n)) for n in (0, 999, 1000, 5000)} | {"random": np.random.default_rng(1).bytes(1500)}
    data = formats.with_trailer(b"movie", values, [{}, {"a": b"1"}], [3, 4])
    assert formats.read_trailer(data)[:3] == (values, [{}, {"a": b"1"}], [3, 4])
    assert len(data) < 5000 and formats.with_trailer(data, {}, [], [])[:5] == b"movie"
    assert formats.read_trailer(b"no trailer") == ({}, [], [], 0)


def test_headers_are_put_right(images):
    wrong = formats.pcr_header(99, 5, 1, 0) + b"".join(i.tobytes() for i in images)
    m = formats.sniff(formats.correct_pcr(wrong, 16, 12, 25)[:4096], len(wrong))
    assert (m.width, m.height, m.n, m.frequency) == (16, 12, 6, 25)
    hot = formats.set_black_body(files(images)["HCC"], 42.5)
    assert {float(a["ExternalBlackBodyTemperature"]) for *_, a in formats.frames(hot)} == {42.5}
    with pytest.raises(ValueError):
        list(formats.frames(b"garbage"))


def test_text_tables(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# c\n1 2 3\nC x\n4 5 6\n")
    assert [r.v for r in movies.read_matrix(spark, str(tmp_path / "m.txt")).orderBy("row", "col").collect()] == [1, 2, 3, 4, 5, 6]
    t = spark.createDataFrame([(0, 0.5, -1.0, 0.9), (1, 1.0, 2.0, 0.8)], "pos int, dx double, dy double, confidence double")
    movies.write_translations(t, str(tmp_path / "reg"))
    assert sorted(map(tuple, movies.read_translations(spark, str(tmp_path / "reg")).collect())) == [(0, 0.5, -1.0, 0.9), (1, 1.0, 2.0, 0.8)]
