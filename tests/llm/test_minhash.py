import random

from emberframe.llm import minhash
from emberframe.llm.common import Scratch
from emberframe.llm.components import components
from tests_llm_brute import check_classes, similarities

DOCS = "doc_id long, text string, key string, rep int"


def test_classes_equal_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        own = [r.choice(vocab) for _ in range(r.randint(40, 160))]
        for c in range(r.choice([1, 1, 2, 5])):
            if c:
                own = list(own)
                for _ in range(r.choice([0, 1, 2, 9])):
                    own[r.randrange(len(own))] = r.choice(vocab)
            texts.append(" ".join(own))
    texts += [None, "", " \n ", "one two", "One  two", "x", "ab " * 30_000, "ab " * 30_000 + "c"]
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = [(i, texts[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs] + [(0, docs[0][1], "clash", 0), (None, "one two", "", 0)], DOCS)
    rows = minhash.classes(df).collect()
    assert len(rows) == len(docs) + 2
    got = {x.doc_id: x.class_id for x in rows}
    assert got.pop(None) == got[next(i for i, t in docs if t == "one two")]
    assert check_classes(docs, got) > 15
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(got.values()))


def test_a_document_id_with_several_texts_loses_none(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (9, "t"), (9, "t"), (None, "only here"), (None, "only here"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((x.doc_id, x.text) for x in minhash.deduplicate(df).collect()), key=repr)
    assert kept == sorted([(1, a), (5, b), (9, "t"), (None, "only here")], key=repr)
    found = sorted(((x.doc_id, x.class_id) for x in minhash.classes(df).collect()), key=repr)
    assert found == sorted([(1, 1), (5, 1), (5, 5), (7, 5), (9, 9), (9, 9), (None, None), (None, None), (None, 1)], key=repr)


def test_document_frequency_decides(spark):
    """Two pairs that differ in as many words: one shares a passage that many texts have, the other words of its own."""
    r = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    fresh = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]
    docs = [" ".join(passage + fresh(200)) for _ in range(150)]
    docs += [" ".join(passage + fresh(9)) for _ in range(2)]
    docs += [" ".join(own + fresh(9)) for own in [fresh(60)] for _ in range(2)]
    rows = list(enumerate(docs))
    got = {x.doc_id: x.class_id for x in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), 0.6).collect()}
    assert got[152] == got[153] and got[150] != got[151]
    sims = similarities(rows)
    assert sims[tuple(sorted(docs[150:152]))] < 0.55 and sims[tuple(sorted(docs[152:154]))] > 0.65


def test_copies_do_not_lower_their_own_likeness(spark):
    """A third of all texts are edited copies of one, each at a plain likeness of about 0.86 to it; all are found."""
    r = random.Random(9)
    word = lambda: f"x{r.randrange(10**9)}"
    base = [word() for _ in range(200)]
    docs = [" ".join(word() for _ in range(200)) for _ in range(600)]
    docs.append(" ".join(base))
    for _ in range(300):
        own = list(base)
        for _ in range(3):
            own[r.randrange(200)] = word()
        docs.append(" ".join(own))
    got = [x.class_id for x in minhash.classes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).where("doc_id >= 600").collect()]
    assert got == [600] * 301


def test_large_groups_in_tiles_equal_pairs(spark, monkeypatch):
    from emberframe.llm import components as cc

    r = random.Random(8)
    base = [f"u{i}" for i in range(90)]
    docs = []
    for i in range(150):
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            own[r.randrange(len(own))] = f"x{r.randrange(999)}"
        docs.append((i, " ".join(own + ["tail"] * (i % 3))))
    docs += [(200 + i, " ".join(f"y{r.randrange(10**6)}" for _ in range(90))) for i in range(250)]
    monkeypatch.setattr(cc, "PAIRS_UP_TO", 4)
    monkeypatch.setattr(cc, "TILE", 16)
    got = {x.doc_id: x.class_id for x in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    check_classes(docs, got)


def test_tiles_leave_out_what_is_one_class(spark, monkeypatch):
    from emberframe.llm import components as cc

    monkeypatch.setattr(cc, "TILE", 8)
    rows = [(1, i, 0) for i in range(100)] + [(1, 200, 200)] + [(1, 300 + i, 300) for i in range(20)] + [(2, i, i) for i in range(10)]
    dealt = cc.tiles_of(spark.createDataFrame(rows, "bucket long, rep long, own long")).collect()
    by: dict = {}
    for x in dealt:
        by.setdefault((x.bucket, x.tile), []).append(x)
    met = {(b, *sorted((x.rep, y.rep))) for (b, _), own in by.items() for x in own for y in own if x.own != y.own and (x.side, y.side) in ((0, 1), (1, 0), (2, 2))}
    want = {(b, *sorted((r, t))) for b, r, o in rows for c, t, p in rows if b == c and o != p}
    assert met == want
    assert sum(x.rep < 100 and x.bucket == 1 for x in dealt) <= 100 * 5


def test_no_rows(spark):
    assert minhash.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 90)] + [(5000, 5001), (5001, 5000), (7, 7)]
    r.shuffle(links)
    rows = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()
    got = {x.node: x.component for x in rows}
    assert len(got) == len(rows)
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(90)}, 5000: 5000, 5001: 5000}
