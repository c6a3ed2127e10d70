"""Encoding and decoding on rows that repeat, have no id, or come from a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from emberframe.llm import bpe
from emberframe.llm.common import sha256

HARD = [(None, "ab cd"), (None, "xy zw"), (1, "alpha"), (1, "gamma"), (1, "alpha"), (1, None), (2, ""), (3, "y" * 5000), (4, "  a\n\n b  c's 中文 😀")]


def expected(texts):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.ranks(bpe.vocabulary()), special_tokens={})
    out = []
    for i, t in texts:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()), sha256((t or "").encode())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 5, len(HARD)])
def test_rows_that_repeat_or_have_no_id(spark, tmp_path, partitions):
    spark.createDataFrame(HARD, "doc_id long, text string").repartition(partitions).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(map(tuple, bpe.report(docs).collect()), key=repr) == expected(HARD)
    ids = bpe.encode(docs)
    assert sorted(bytes(r.bytes) for r in bpe.decode(ids).collect()) == sorted((t or "").encode() for _, t in HARD)


def test_one_row_files_and_string_ids(spark, tmp_path):
    for k, t in enumerate(["ab cd", "xy zw", "ab cd"]):
        spark.createDataFrame([(None, t)], "doc_id string, text string").coalesce(1).write.parquet(str(tmp_path / str(k)))
    docs = spark.read.parquet(*[str(tmp_path / str(k)) for k in range(3)])
    assert sorted(map(tuple, bpe.report(docs).collect()), key=repr) == expected([(None, "ab cd"), (None, "xy zw"), (None, "ab cd")])


def test_documents_that_come_from_a_shuffle_in_small_chunks(spark, monkeypatch):
    r = random.Random(3)
    docs = [(i % 7, " ".join(r.choice(["the", "cat", "Zürich", "x1", "\n"]) for _ in range(r.randint(0, 60)))) for i in range(120)]
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 300)
    monkeypatch.setattr(bpe, "BLOCK", 40)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6, F.rand())
    assert sorted(map(tuple, bpe.report(df).collect()), key=repr) == expected(docs)


def test_other_patterns_lose_nothing(spark):
    texts = ["hello there world", " a  b ", "", None, "x\ty"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pattern in (r"\S+\s*|\s+", r"(\w)|\W", r"."):
        own = docs if pattern != "." else docs.where("doc_id != 99")
        back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(own, split_pattern=pattern)).collect()}
        assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
