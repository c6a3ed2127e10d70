"""Attributes of files as tables, and changes that move the ends of files only."""

import os

import numpy as np
import pytest

from emberframe.sources import attributes, formats, metadata, saver


def trailer_of(path):
    return formats.read_trailer(path.read_bytes())


def test_only_the_end_of_a_long_file_moves(spark, tmp_path):
    path, n = tmp_path / "long.pcr", 50 << 30
    tail = formats.write_trailer({"a": b"1", "b": b"2"}, [{"i": b"0"}], [7])
    with open(path, "wb") as f:
        f.write(formats.pcr_header(640, 512, 1000, 50))
        f.truncate(n)
        f.seek(n)
        f.write(tail)
    changes = spark.createDataFrame([(str(path), {"a": bytearray(b"x" * 50), "b": None, "c": bytearray(b"3")})], "path string, attrs map<string,binary>")
    (row,) = metadata.write_attributes(changes).collect()
    assert row.bytes < 300 and os.stat(path).st_blocks * 512 < 1 << 20
    with open(path, "rb") as f:
        f.seek(n)
        assert formats.read_trailer(f.read()) == ({"a": b"x" * 50, "c": b"3"}, [{"i": b"0"}], [7], row.bytes)
    assert {(r.key, bytes(r.value)) for r in metadata.read_attributes(spark, str(path)).collect()} == {("a", b"x" * 50), ("c", b"3")}


def test_changes_of_many_files(spark, tmp_path):
    for k in range(5):
        data = formats.pcr_header(4, 3, 1, 50) + bytes(24)
        (tmp_path / f"m{k}.pcr").write_bytes(formats.with_trailer(data, {"k": str(k).encode(), "long": b"y" * 5000}, [{"f": b"1"}], [3]) if k else data)
    rows = [(str(tmp_path / f"m{k}.pcr"), {"new": bytearray(b"n")}) for k in range(4)] + [(str(tmp_path / "m1.pcr"), {"k": None, "long": bytearray(b"short")})]
    done = {os.path.basename(r.path): r.bytes for r in metadata.write_attributes(spark.createDataFrame(rows, "path string, attrs map<string,binary>")).collect()}
    assert sorted(done) == ["m0.pcr", "m1.pcr", "m2.pcr", "m3.pcr"]
    assert trailer_of(tmp_path / "m0.pcr")[:3] == ({"new": b"n"}, [], [])
    assert trailer_of(tmp_path / "m1.pcr")[:3] == ({"long": b"short", "new": b"n"}, [{"f": b"1"}], [3])
    assert trailer_of(tmp_path / "m2.pcr")[0] == {"k": b"2", "long": b"y" * 5000, "new": b"n"} and trailer_of(tmp_path / "m4.pcr")[0] == {"k": b"4", "long": b"y" * 5000}
    again = metadata.write_attributes(spark.createDataFrame(rows, "path string, attrs map<string,binary>")).collect()
    assert {r.bytes for r in again} == {0}
    assert sorted(os.listdir(tmp_path)) == [f"m{k}.pcr" for k in range(5)]


def test_a_lost_task_is_gone_on_from(tmp_path, monkeypatch):
    path = tmp_path / "m.pcr"
    path.write_bytes(formats.with_trailer(formats.pcr_header(4, 3, 1, 50) + bytes(24), {"a": b"1"}, [{}], [3]))

    def lost(own):
        with open(own, "r+b") as f:  # after the old trailer is gone
            f.truncate(1024 + 24 + 5)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        real, calls = metadata._applied, []
        m.setattr(metadata, "_applied", lambda own: lost(own) if calls or calls.append(own) else None)
        with pytest.raises(RuntimeError):
            metadata.change_file(str(path), {"b": b"2"})
        assert real is not metadata._applied
    assert os.path.exists(f"{path}.tail")
    metadata.change_file(str(path), {"c": b"3"})
    assert trailer_of(path)[:3] == ({"a": b"1", "b": b"2", "c": b"3"}, [{}], [3]) and os.listdir(tmp_path) == ["m.pcr"]


def test_a_table_is_merged_by_file_and_key(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame([(p, k, None if v is None else bytearray(v)) for p, k, v in x], metadata.ATTRIBUTES)
    assert metadata.current(spark, folder).count() == 0
    metadata.upsert(rows(("f", "a", b"1"), ("f", "b", b"2"), ("g", "a", b"3")), folder)
    metadata.upsert(rows(("f", "a", b"9"), ("f", "b", None), ("h", "a", b"4"), ("g", "z", None)), folder)
    os.makedirs(f"{folder}/v7")  # a version that was not finished
    assert sorted((r.path, r.key, bytes(r.value)) for r in metadata.current(spark, folder).collect()) == [("f", "a", b"9"), ("g", "a", b"3"), ("h", "a", b"4")]


def test_texts_have_no_zero_bytes(spark):
    df = spark.createDataFrame([({"a": bytearray("é\0b\0".encode()), "b": None},)], "attrs map<string,binary>")
    assert attributes.strings(df).first().attrs == {"a": "éb", "b": None}
    made = saver.from_array(spark, "m", np.zeros((1, 2, 2)), attrs=[{"a": b"x\0"}])
    assert attributes.strings(made).first().attrs == {"a": "x"}
