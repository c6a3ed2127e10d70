import random

import numpy as np
from pyspark.sql import functions as F

from emberframe.llm import quality, toxicity

DOCS = "doc_id long, text string, score string, keep int"


def corpus(n=400):
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "te") for b in ("ra", "so", "vi", "wu", "zo", "pe")]
    docs, labels = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(5, 80))]
        junk, bad = r.random() < 0.3, r.random() < 0.3
        if bad:
            for _ in range(2):
                own.insert(r.randrange(len(own)), r.choice(["vile", "dreck"]))
        docs.append((i, " ".join(w.upper() + "!!" for w in own) if junk else " ".join(own) + ".", "clash", 0))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    docs += [(1000, None, "", 0), (1001, "", "", 0), (1002, "ka lo. " * 30_000, "", 0), (1003, "ka lo. dreck " * 700, "", 0), (3, docs[3][1], "", 0), (None, "ka", "", 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), dict((d[0], d[1]) for d in docs), {i: x for i, *x in labels}


def test_quality_keeps_clean_and_drops_junk(spark):
    docs, labels, _, truth = frames(spark)
    rows = quality.score(docs, labels, max_rows=300).collect()
    assert len(rows) == docs.count()
    assert np.mean([r.keep == bool(truth[r.doc_id][0]) for r in rows if r.doc_id in truth]) > 0.97
    kept = quality.select(docs, labels, max_rows=300)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in rows if r.keep)


def test_quality_thresholds_are_ordered():
    r = random.Random(7)
    rows = []
    for _ in range(600):
        g = r.randrange(4)
        rows.append((" ".join(r.choice(["low", "mid", "high", "top"][max(0, g - 1) : g + 1]) for _ in range(12)), g))
    w, t, grades = quality.fit(rows)
    assert grades == [0, 1, 2, 3] and list(t) == sorted(t) and len(t) == 3
    _, expected, tail = quality._grade(["low " * 12, "mid " * 12, "top " * 12], (w, t, grades), {})
    assert expected[0] < expected[1] < expected[2] and tail[0] < tail[2]


def test_without_labels_all_is_kept(spark):
    docs, labels, *_ = frames(spark)
    none = labels.where("false")
    assert quality.select(docs, none).count() == docs.count()
    assert {r.score for r in toxicity.score(docs, none).collect()} == {next(iter({r.score for r in toxicity.score(docs, none).limit(1).collect()}))}
    empty = docs.where("false")
    assert quality.score(empty, labels).count() == 0 and toxicity.report(empty, labels).count() == 0


def test_chain_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    e, change = r.normal(size=(7, 1)), np.exp(r.normal(size=(2, 2)))
    p, alone, none = toxicity.chain_marginals([e[:, 0], e[:1, 0], np.empty(0)], change)
    total, by = 0.0, np.zeros(7)
    for k in range(2**7):
        y = [(k >> i) & 1 for i in range(7)]
        w = np.exp(sum(e[i, 0] for i in range(7) if y[i])) * np.prod([change[y[i], y[i + 1]] for i in range(6)])
        total += w
        by += w * np.array(y)
    assert np.allclose(p, by / total) and np.allclose(alone, 1 / (1 + np.exp(-e[0]))) and len(none) == 0


def test_a_long_chain_is_not_cut():
    r = np.random.default_rng(2)
    change = np.array([[1.0, 1e-6], [1e-6, 1.0]])  # states last for very long
    e = r.normal(size=5000) * 1e-3
    e[0] = 9.0
    long, short = toxicity.chain_marginals([e, e[:3]], change)
    log_fore, log_back = np.zeros((5000, 2)), np.zeros((5000, 2))
    log_fore[0] = 0, e[0]
    for t in range(1, 5000):
        for j in (0, 1):
            log_fore[t, j] = np.logaddexp(log_fore[t - 1, 0] + np.log(change[0, j]), log_fore[t - 1, 1] + np.log(change[1, j])) + e[t] * j
    for t in range(4998, -1, -1):
        for i in (0, 1):
            log_back[t, i] = np.logaddexp(np.log(change[i, 0]) + log_back[t + 1, 0], np.log(change[i, 1]) + e[t + 1] + log_back[t + 1, 1])
    both = log_fore + log_back
    assert np.allclose(long, 1 / (1 + np.exp(both[:, 0] - both[:, 1]))) and long[3000] > 0.9


def test_spans_where_lower_case_is_longer(spark):
    docs, labels, *_ = frames(spark)
    odd = spark.createDataFrame([(5000, "İİ ka vile dreck lo", "", 0)], DOCS)
    (row,) = toxicity.score(docs.unionByName(odd), labels).where("doc_id = 5000").collect()
    assert [(s.start, s.end) for s in row.spans] == [(6, 16)]


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(i, "x" * 100) for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 30)], "doc_id long, toxic int")
    from emberframe.llm.labelled import sample

    assert len(sample(docs, labels, "toxic", 1000)) == 29
    assert len(sample(docs, labels, "toxic", 7)) == 7
    few = sample(docs, labels, "toxic", 1000, most_chars=350)
    assert 3 <= len(few) <= 4 and sum(len(t) for t, _ in few) <= 350


def test_toxicity_on_held_out_rows(spark):
    docs, labels, text, truth = frames(spark)
    rows = toxicity.report(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and all(r.predicted == truth[r.doc_id][1] for r in held)
    assert all(0 <= r.score <= 1 for r in rows)
    spans = {r.doc_id: r.spans for r in toxicity.score(docs, labels).where(F.col("doc_id").isNotNull()).collect()}
    words = {text[i][s.start : s.end] for i, own in spans.items() for s in own}
    assert {w.lower() for x in words for w in x.split()} <= {"vile", "dreck"} or {"vile", "dreck"} <= {x.lower() for x in words}
    assert len(spans[1003]) >= 1 and "dreck" in text[1003][spans[1003][0].start : spans[1003][0].end] and spans[1000] == spans[1002] == []


def test_labels_that_repeat_and_texts_that_repeat(spark):
    docs, labels, *_ = frames(spark)
    twice = docs.unionByName(docs.where("doc_id = 7").withColumn("text", F.lit("another text of seven")))
    more = labels.unionByName(labels.where("doc_id < 20"))
    assert quality.score(twice, more).count() == twice.count() and toxicity.report(twice, more).count() == twice.count()


def test_one_long_text_keeps_no_other_out(spark):
    import pytest
    from emberframe.llm import labelled

    for long_id in range(12):
        rows = [(i, "x" * (1001 if i == long_id else 60)) for i in range(50)]
        docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
        found = labelled.sample(docs, labels, "toxic", 100, most_chars=1000)
        assert len(found) == 16 and all(len(t) == 60 for t, _ in found)
    assert len(labelled.sample(docs, labels, "toxic", 100, most_chars=5000)) == 50
    with pytest.raises(ValueError, match="no labelled text"):
        labelled.sample(docs, labels, "toxic", 100, most_chars=50)
    assert labelled.sample(docs.where("false"), labels, "toxic", 100) == []
