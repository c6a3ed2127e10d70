"""The Jaccard join, fill-in-the-middle and hard negatives against plain versions, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import infill, jaccard, mining
from emberframe.llm.common import Scratch

DOCS = "doc_id long, text string, id string, n int, key int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


# --- op11


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_join(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"w{r.randrange(1000)}"
    return " ".join(out)


def some_texts(seed):
    """Texts of all sizes with near copies at every distance, shared passages and a group of copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(60)}"
    passage = " ".join(word() for _ in range(60))
    out = []
    for n in [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 30, 60, 150]:
        for _ in range(3):
            base = [word() for _ in range(n)]
            out += [" ".join(base), " ".join([*base, word()]), " ".join(base[:-1]), edited(r, base, 1), edited(r, base, max(1, n // 40))]
            if n > 20:
                out += [passage + " " + " ".join(base), " ".join(base[: n // 2]) + " " + passage]
    big = [word() for _ in range(300)]
    out += [edited(r, big, k % 6) for k in range(40)] + [" ".join(big)] * 30
    r.shuffle(out)
    return out


@pytest.mark.parametrize("light", [None, 0, 6, 12])
def test_join_against_all_pairs(spark, light, monkeypatch):
    if light is not None:
        monkeypatch.setattr(jaccard, "light_up_to", lambda sizes: light)
    rows = list(enumerate(some_texts(light or 1)))
    got = jaccard.report(docs_of(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_join(rows)


def test_join_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (9, "one  TWO"), (4, "other text"), (None, "one two"), (None, None), (5, "É à"), (6, "é à"), (7, "a\x1cb\x85c"), (8, "a b\x85c"), (10, "x y z " * 30_000)]
    assert sorted(map(tuple, jaccard.report(docs_of(spark, rows)).collect()), key=repr) == plain_join(rows)
    assert jaccard.report(docs_of(spark, [])).collect() == []


def test_large_lists_go_by_tiles(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, edited(r, words, 1 + i % 4)) for i in range(90)]
    assert sorted(map(tuple, jaccard.report(docs_of(spark, rows)).collect()), key=repr) == plain_join(rows)


def test_boundary_follows_the_cost():
    assert jaccard.light_up_to({500: 1000}) == 0
    few, many = jaccard.light_up_to({n: 100 for n in range(1, 60)}), jaccard.light_up_to({n: 1000 for n in range(1, 6)})
    assert 4 <= few <= 12 and many >= 5
    for s in range(1, 40):
        for t in jaccard.partners(s):
            c = jaccard.shared_of(s, t)
            assert 100 * c >= 80 * (s + t - c) and 100 * (c - 1) < 80 * (s + t - c + 1)


def test_packed_elements_come_back():
    x = np.unique(np.random.default_rng(1).integers(1 << jaccard.BITS, size=1000, dtype=np.uint64))
    assert (jaccard.unpacked(jaccard.packed(x)) == x).all() and len(jaccard.unpacked(b"")) == 0


def test_parities_bound_what_two_sets_share():
    r = np.random.default_rng(5)
    for n in (1, 3, 500, 2047, 2048, 3000, 4100, 9000, 20_000):
        x = np.unique(r.integers(1 << jaccard.BITS, size=n, dtype=np.uint64))
        for kept in (0.0, 0.5, 0.79, 0.9, 1.0):
            for more in (0.0, 0.1, 0.24):
                y = np.unique(np.concatenate([x[r.random(len(x)) < kept], r.integers(1 << jaccard.BITS, size=int(n * more) + 1, dtype=np.uint64)]))
                if not min(len(x), len(y)) * 100 >= max(len(x), len(y)) * 80:
                    continue
                p, q = jaccard.parities(x), jaccard.parities(y)
                size = min(len(p), len(q))
                assert max(len(p), len(q)) <= 2 * size
                may = jaccard._may_share(np.array([len(x)]), np.array([len(y)]), jaccard._folded([p], size), jaccard._folded([q], size))[0]
                both = len(np.intersect1d(x, y))
                assert may or not jaccard.linked_sizes(both, len(x), len(y))
                if both < 0.5 * len(x) and n > 100:
                    assert not may


def test_long_texts_that_share_a_passage(spark):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(5000)}"
    passage = " ".join(word() for _ in range(50))
    base = [word() for _ in range(6000)]
    rows = [(i, passage + " " + " ".join(word() for _ in range(r.choice([300, 2500, 5000])))) for i in range(45)]
    rows += [(100 + i, passage + " " + " ".join(base[: 6000 - 400 * i])) for i in range(4)] + [(200, edited(r, base, 40)), (201, edited(r, base, 900))]
    assert sorted(map(tuple, jaccard.report(docs_of(spark, rows)).collect()), key=repr) == plain_join(rows)


# --- op12


def plain_infill(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    h = [int(sha(f"42:{doc_id}")[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 or doc_id is None:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_infill_against_strings(spark):
    r = random.Random(3)
    alphabet = "ab <>PSM\n\t\x0b\x1c\xa0é€😀中"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(60)))) for i in range(400)]
    rows += [(None, "a b c"), (7, None), (7, ""), (8, "<<P>"), (11, "<P" * 9), (12, "é x " * 60_000), (12, " "), (7, "a b")]
    got = [tuple(x) for x in infill.report(docs_of(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted((plain_infill(*x) for x in rows), key=repr)
    assert {x[2] for x in got} == {"plain", "spm", "psm"}
    assert infill.report(docs_of(spark, [])).collect() == []


def test_infill_gives_texts_back(spark):
    rows = [(i, f"día {i} <S <P ends M> 😀 {'x ' * (i % 7)}") for i in range(60)]
    out = infill.transformed(docs_of(spark, rows), seed=7, rate=100, spm=50)
    assert {r.form for r in out.collect()} == {"psm", "spm"}
    assert sorted(map(tuple, out.select("doc_id", infill.restored()).collect())) == rows


def test_exceptions_turn_cuts_both_ways():
    text = "aé€😀 b中"
    index, at = infill.Exceptions(text.encode()), [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert len(index.bytes) == 4
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == at and index.to_points(np.array(at)).tolist() == list(range(len(text) + 1))


# --- op13


def test_strassen_is_exact():
    r = np.random.default_rng(2)
    for m, k, n in [(1, 1, 1), (33, 70, 90), (64, 64, 64), (100, 37, 129), (5, 200, 200), (70, 0, 70)]:
        a, b = r.integers(-(1 << 27), 1 << 27, (m, k)), r.integers(-(1 << 27), 1 << 27, (n, k))
        assert (mining.strassen(a, b) == a @ b.T).all()
    a = np.full((80, 80), 1 << 28)
    assert (mining.strassen(a, a) == 80 << 56).all()  # intermediate sums do not fit


def plain_negatives(rows):
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(e)))) for e in v])
        own[i] = min(x, own.get(i, x))
    score = lambda a, b: sum(x * y for x, y in zip(own[a][1], own[b][1], strict=False))
    out = []
    for a in own:
        if a % 50 == 0:
            by = sorted((-score(a, b), b) for b in own if b != a)
            for s, p in [x for x in by if own[x[1]][0] == own[a][0]][:5]:
                hard = [x for x in by if own[x[1]][0] != own[a][0] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
                out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(hard)]
    return sorted(out)


def embeddings_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2) for i, label, v in rows], "vec_id long, embedding array<float>, label int, i int, anchor_id int")


@pytest.mark.parametrize("seed", range(3))
def test_negatives_against_all_pairs(spark, seed, monkeypatch):
    for name, v in (("ANCHORS", 5), ("CANDIDATES", 150), ("TILE", 40), ("LEAF", 4)):
        monkeypatch.setattr(mining, name, v)
    r = np.random.default_rng(seed)
    rows = [(i, int(r.integers(3)), [float(x) for x in r.integers(0, 5, r.integers(7, 10)) / 8 - 0.1]) for i in range(400)]
    rows += [(i, 1, [0.5] * 8) for i in range(400, 640)]  # copies, with ties everywhere
    rows += [(700, None, [0.1]), (None, 1, [0.1]), (750, 1, None), (800, 1, [0.1, None]), (850, 1, [float("nan")]), (900, 1, [float("inf")]), (950, 1, []), (50, 2, [0.5] * 8), (50, 2, [0.5] * 8), (1000, 9, [0.3] * 8), (-50, 1, [0.4] * 8)]
    got = mining.report(embeddings_of(spark, rows).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_negatives_of_nothing(spark):
    assert mining.report(embeddings_of(spark, [])).collect() == []
    assert mining.report(embeddings_of(spark, [(50, 1, [0.5]), (1, 2, [0.4])])).collect() == []
    assert mining.report(embeddings_of(spark, [(51, 1, [0.5]), (1, 1, [0.4])])).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        mining.report(embeddings_of(spark, [(50, 1, [1e15]), (1, 1, [1e15])])).collect()


def test_shares_are_exact():
    for s in [*range(-205, 205), 10**17, -(10**17)]:
        assert int(mining.share(np.array(s), 95)) == 95 * s // 100 and int(mining.share(np.array(s), 50, up=True)) == -(-50 * s // 100)


def test_heaps_merge():
    r = random.Random(1)
    rows = [(r.randrange(9), i) for i in range(50)]
    a, b = mining.Heaps(1, 4), mining.Heaps(1, 4)
    for h, own in ((a, rows[:20]), (b, rows[20:])):
        for at in range(0, len(own), 7):
            h.add(slice(0, 1), np.array([[s for s, _ in own[at : at + 7]]]), np.array([i for _, i in own[at : at + 7]]))
    a.merge(slice(0, 1), b.scores, b.ids)
    assert list(zip(a.scores[0].tolist(), a.ids[0].tolist(), strict=True)) == sorted(rows, key=lambda x: (-x[0], x[1]))[:4]


def test_components_need_no_links(spark):
    from emberframe.llm.components import components

    links = spark.createDataFrame([], "a long, b long")
    assert components(links, Scratch(spark)).where(F.col("node") >= 0).collect() == []
