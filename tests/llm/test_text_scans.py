import random
import re

import pytest

from emberframe.llm import bpe, decontaminate, secrets
from emberframe.llm.common import sha256

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PIECES = ["password", "PassWd", "secret", "token", "api_key", "_key", "=", ":", " ", '"', "'", "abcdefghijkl", "0123456789abcdef", "AKIA", "AKIAABCDEFGHIJKLMN", "é", "ß\n", "-", "==", "x", "😀"]
DOCS = "doc_id long, text string, n_words string, extra int"


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def odd_texts(seed, n):
    r = random.Random(seed)
    return [None, "", " ", "\n\n", "a"] + ["".join(r.choice(PIECES) for _ in range(r.randint(1, 14))) for _ in range(n)] + ["x " * 40_000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(1, "", "clash", 1)], DOCS)


def test_secret_spans_equal_each_rules_own_expression(spark):
    texts = odd_texts(1, 3000)
    for t in texts:
        assert [x for x in secrets.spans_of(t or "") if x[2] in secrets.BASE] == base_spans(t or "")
    rows = secrets.report(frame(spark, texts)).collect()
    assert len(rows) == len(texts) + 1
    by_id = {r.doc_id: r for r in rows if r.doc_id != 1}
    for i, t in enumerate(texts):
        if i != 1:
            want = base_spans(t or "")
            assert by_id[i].n_assign == sum(k == "assign" for *_, k in want)
            assert by_id[i].base_sha256 == sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode())


def test_further_rules():
    t = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9 + " ghp_short"
    assert [x[2] for x in secrets.spans_of(t)] == ["pem", "github"]


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.ranks(bpe.vocabulary()), special_tokens={})
    r = random.Random(2)
    odd = ["".join(r.choice("aeé ßth\n\t xyz!!中😀's  ") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    texts = [None, "", "a", "y" * 3000, "  a", "a   b \n  c", " \n x"] + odd
    got = {r.doc_id: r for r in bpe.report(frame(spark, texts)).collect() if r.doc_id != 1}
    ids = {r.doc_id: r.ids for r in bpe.encode(frame(spark, texts)).collect() if r.doc_id != 1}
    for i, t in enumerate(texts):
        if i != 1:
            want = enc.encode_ordinary(t or "")
            assert list(ids[i]) == want
            assert got[i].n_tokens == len(want)
            assert got[i].ids_sha256 == sha256(" ".join(map(str, want)).encode())
            assert got[i].decoded_sha256 == sha256((t or "").encode())
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(frame(spark, texts))).collect() if r.doc_id != 1}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts) if i != 1)


def test_bpe_of_no_rows(spark):
    assert bpe.report(spark.createDataFrame([], DOCS)).count() == 0


def test_bpe_of_repeated_rows(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    once = sorted(map(tuple, bpe.report(docs).collect()))
    assert sorted(map(tuple, bpe.report(docs.union(docs)).collect())) == sorted(once * 2)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_decontaminate_equals_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(6)] + ["É", "Ünd"]
    def text(n):
        return "".join(r.choice(vocab) + r.choice([" ", ", ", ".\n", "-"]) for _ in range(n))
    items = [(0, text(30)), (1, text(4)), (2, None), (3, ""), (4, text(10)), (5, "only"), (5, "Only!"), (6, text(11))]
    texts = [None, "", "..", "only"] + [text(r.randint(1, 60)) for _ in range(60)] + [f"{text(5)} {items[k][1].upper().replace('É', 'É')} {text(5)}" for k in (0, 1, 4, 6)]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 40):
        before, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, block_bytes
        try:
            got = {x.doc_id: x for x in decontaminate.report(docs, bench).collect() if x.doc_id != 1}
            kept = {x.doc_id for x in decontaminate.decontaminate(docs, bench).collect()}
        finally:
            decontaminate.BLOCK_BYTES = before
        for i, t in enumerate(texts):
            if i == 1:
                continue
            w, hit, found = WORDS.findall(lower(t)), set(), set()
            for item, it in items:
                own = WORDS.findall(lower(it))
                n = min(10, len(own))
                for k in range(len(own) - n + 1 if own else 0):
                    for j in range(len(w) - n + 1):
                        if w[j : j + n] == own[k : k + n]:
                            hit.update(range(j, j + n))
                            found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, got[i].contaminated) == (len(w), len(hit), bool(hit)), t
            assert got[i].n_items == len(found) and got[i].items_sha256 == sha256(",".join(sorted(found)).encode())
            assert (i in kept) == (not hit)


def test_offsets_point_at_the_original_text(spark):
    docs = spark.createDataFrame([(7, "Äh, X: one TWO-three. end")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    (row,) = decontaminate.hits(docs, bench).collect()
    assert [row.spans[0].start, row.spans[0].end] == [7, 20] and "Äh, X: one TWO-three. end"[7:20] == "one TWO-three"


def test_rows_stay_apart_however_many_blocks(spark):
    docs = spark.createDataFrame([(None, "x a b c d"), (None, "a b"), (1, "c d a b"), (1, "none of them"), (1, "c d a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "d a")], "item_id long, text string")
    found = []
    for block_bytes in (decontaminate.BLOCK_BYTES, 3):
        before, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, block_bytes
        try:
            found.append(sorted(map(repr, decontaminate.hits(docs, bench).collect())))
        finally:
            decontaminate.BLOCK_BYTES = before
    assert len(found[0]) == 6 and found[0] == found[1]


def test_no_rows_give_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert secrets.report(none).count() == 0 and decontaminate.report(none, items).count() == 0 and decontaminate.decontaminate(none, items).count() == 0
    some = frame(spark, ["one two three", None])
    for bench in (items.where("false"), spark.createDataFrame([(None, None), (2, "")], "item_id long, text string")):
        assert [r.n_hit for r in decontaminate.report(some, bench).collect()] == [0, 0, 0] and decontaminate.decontaminate(some, bench).count() == 3


def test_an_item_without_an_id_is_an_empty_string(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "b"), (7, "c")], "item_id long, text string")
    (row,) = decontaminate.hits(docs, bench).collect()
    assert row["items"] == ["", "7"]


@pytest.mark.parametrize("block_bytes, chunk", [(1 << 22, 1 << 25), (60, 1 << 25), (60, 100)])
def test_spans_of_random_texts(spark, monkeypatch, block_bytes, chunk):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontaminate, "CHUNK_CHARS", chunk)
    r = random.Random(11)
    text = lambda n: "".join(r.choice(["a", "B", "é", "Ü1", "中文", "c"]) + r.choice([" ", ", ", "\n", "-", "…", " 😀 "]) for _ in range(n))
    items = [text(n) for n in (1, 3, 12, 14)] + [None, ""]
    texts = [text(r.randrange(50)) + (items[r.randrange(4)] if r.random() < 0.5 else "") + text(r.randrange(20)) for _ in range(80)] + [None, "", "a", "x " * 60_000 + items[2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x.doc_id: x.spans for x in decontaminate.report(docs, bench).collect()}
    for i, t in enumerate(texts):
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        w, hit = [lower(t[a:b]) for a, b in at], set()
        for it in items:
            own = WORDS.findall(lower(it))
            n = min(10, len(own))
            for k in range(len(own) - n + 1 if own else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == own[k : k + n]:
                        hit.update(range(j, j + n))
        runs = []
        for j in sorted(hit):
            if runs and runs[-1][1] == j - 1:
                runs[-1][1] = j
            else:
                runs.append([j, j])
        assert got[i] == ",".join(f"{at[a][0]}:{at[b][1]}" for a, b in runs)
