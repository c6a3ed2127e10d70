"""The pipeline against a plain version of each stage, each on the input that the stage before left."""

import corpus_pipeline as cp
from emberframe.llm import bpe, decontaminate, lines, quality
from emberframe.llm.common import read, sha256

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    import duckdb
    import pandas as pd

    from tests_llm_brute import _groups, similarities

    docs = read(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    benchmark = [r.text for r in read(spark, SF, "benchmark").collect()]
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"] and cp.ORACLE_SQL is None
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = spark.createDataFrame(stage(spark, docs, SF).toPandas()) if name != "bpe" else stage(spark, docs, SF)
        got = {r.doc_id: r for r in after.collect()}
        if name != "bpe":
            assert after.columns == docs.columns
        if name == "quality":
            assert all(labels[i] == 1 for i in got if i in labels) and all(labels[i] == 0 for i in before.keys() - got.keys() if i in labels)
            assert all(got[i].text == before[i].text for i in got)
        elif name == "line_dedup":
            con = duckdb.connect()
            con.register("documents", pd.DataFrame([(i, r.text) for i, r in before.items()], columns=["doc_id", "text"]))
            assert {(i, sha256(r.text.encode())) for i, r in got.items()} == {(r[0], r[3]) for r in con.execute(lines.SQL).fetchall()}
        elif name == "near_dedup":
            sims = similarities([(i, r.text) for i, r in before.items()])
            texts = {r.text for r in before.values()}
            loose = _groups(list(texts), lambda a, b: sims[(a, b)] >= 0.76)
            kept = {r.text for r in got.values()}
            assert len(kept) == len(got) and all(sims[(a, b)] < 0.84 for a in kept for b in kept if a < b)
            assert {loose[t] for t in kept} == set(loose.values()) and len(got) < len(before)
            assert all(min(i for i, r in before.items() if loose[r.text] == loose[x.text]) <= k for k, x in got.items())
        elif name == "decontaminate":
            spans = set().union(*(decontaminate.windows(t) for t in benchmark))
            hit = {i for i, r in before.items() for n in {w.count(b" ") + 1 for w in spans} for k in range(len(decontaminate.words(r.text)) - n + 1) if b" ".join(decontaminate.words(r.text)[k : k + n]) in spans}
            assert got.keys() == before.keys() - hit and hit
        else:
            import tiktoken

            enc = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.ranks(bpe.vocabulary()), special_tokens={})
            for i, r in before.items():
                ids = enc.encode_ordinary(r.text)
                assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()), sha256(r.text.encode()))
        docs = after
    assert {tuple(r) for r in cp.run(spark, SF).collect()} == {tuple(r) for r in docs.collect()}
    assert quality.LEAST_TAIL == 0.5


def test_odd_tables_go_through_all_stages(spark, tmp_path):
    plain = "the river runs slowly past the old mill and the quiet village where nobody has lived for many long years now"
    rows = [(1, plain, "en", "a", 0, "x"), (1, plain, "en", "a", 0, "y"), (None, plain, None, None, None, None), (None, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, ""), (3, None, None, None, None, "z"),
            (4, plain + " indeed", "en", "b", 0, "x"), (5, "word " * 60_000, "en", "b", 0, "x"), (5, "another text under the same id", "en", "b", 0, "x"), (6, "a b c d e f g h i j k l", "en", "b", 0, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "b c d e f g h i j k"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in cp.run(spark, str(tmp_path)).collect())
    assert got == [(False, 1), (False, 2), (False, 5), (False, 5)]
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
        df.where("false").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
