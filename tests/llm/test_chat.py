import hashlib
import random

from pyspark.sql import functions as F

from emberframe.llm import chat

ROWS = "conv_id long, turn long, role string, text string, score int, leaf string"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_report_reads_every_turn_back(spark):
    r = random.Random(1)
    odd = ["<|im_start|>", "<|im_end|>\n", "\\", "<\\|", "</s>", "[INST]", "é", "\n", "😀", "<", "|", " ok", "%0A", "%"]
    rows = []
    for c in range(12):
        for t in range([1, 2, 3, 5, 8, 70][c % 6]):
            role = r.choice(["user", "assistant", "system", "a\nb%0A<|", None])
            rows.append((c, t * 3, role, r.choice([None, "", "".join(r.choice(odd) for _ in range(9))]), 1, "clash"))
    rows += [(None, 0, "user", "x", 1, ""), (99, 0, "user", "tie", 1, ""), (99, 0, "user", "tie", 1, "")]
    r.shuffle(rows)
    got = {x.conv_id: x for x in chat.report(spark.createDataFrame(rows, ROWS)).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]", 0, ""), (-1, 1, "assistant", "</s>[INST] ok [/INST]", 0, "")]
    want = {}
    for x in sorted(rows, key=lambda x: (x[1], x[2] or "", x[3] or "")):
        want.setdefault(x[0], []).append((x[2] or "", x[3] or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns), c
        assert got[c].turns_sha256 == digest("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), digest(said))


def test_no_conversations_but_the_fixed_one(spark):
    assert [x.conv_id for x in chat.report(spark.createDataFrame([], ROWS)).collect()] == [-1]


def test_paths_equal_brute_force_and_branches_are_ranked(spark):
    r = random.Random(2)
    nodes = []
    for tree in range(6):
        for n in range(40 if tree else 1):
            nodes.append((tree, n, r.randrange(n) if n and r.random() < 0.97 else None, "user", f"{n}", r.random(), 0))
    nodes += [(7, 1, 2, "user", "", 0.0, 0), (7, 2, 1, "user", "", 0.0, 0), (7, 3, 1, "user", "below a cycle", 0.0, 0), (7, 4, 99, "user", "orphan", 0.0, 0)]
    df = spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, role string, text string, score double, tree int")
    parent = {(t, n): p for t, n, p, *_ in nodes}
    score = {(t, n): x[3] if False else x[2] for (t, n, *x) in [(a, b, c, d, f) for a, b, c, d, _, f, _ in nodes]}
    want = {}
    for (t, n) in parent:
        if any(p == n and u == t for (u, _), p in parent.items()):
            continue
        path, at = [n], parent[t, n]
        while at is not None and (t, at) in parent and len(path) < 100:
            path.append(at)
            at = parent[t, at]
        if len(path) < 100:
            want[t, n] = path
    got = {}
    for x in chat.paths(df).collect():
        got.setdefault((x.tree_id, int(x.leaf)), {})[x.up] = int(x.node)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    best = chat.conversations(df, branches=2).collect()
    for t in range(6):
        means = sorted((-sum(score[t, n] for n in p) / len(p) for (u, _), p in want.items() if u == t))[:2]
        mine = sorted((-x.score for x in best if x.tree_id == t))
        assert all(abs(a - b) < 1e-9 for a, b in zip(means, mine, strict=True))
    one = next(x for x in chat.conversations(df).where(F.col("tree_id") == 1).collect() if x.rank == 1)
    path = want[1, int(one.leaf)]
    assert one.formatted == "".join(f"<|im_start|>user\n{n}<|im_end|>\n" for n in reversed(path))
