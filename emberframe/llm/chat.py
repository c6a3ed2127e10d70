"""Chat formatting of reply trees, with DataFrame functions only.

Nodes (tree_id, node_id, parent_id, role, text, score) become root-to-leaf paths by iterative self-joins: jumps of 1, 2, 4, ...
replies are joined with themselves, and each leaf's path is then filled in by joining it with the jumps from the longest to
the shortest. So a chain of n replies takes about 2 log2(n) joins, keyed by tree and node, and rows as many as the paths
have turns. The branches of a tree are ranked by mean score, and each chosen path is formatted as one conversation.

The template is `<|im_start|>role\\ntext<|im_end|>\\n`. Within texts a backslash is doubled and `<|` becomes `<\\|`; within roles
%, line feeds and `<|` are percent-encoded. Both are undone when a conversation is read back. The loss mask covers the
texts of assistants.

A null text, role or score is empty or zero. Rows with a null tree_id are one tree. A node whose parent isn't there is a
root. Nodes on a cycle or below one have no root and are in no path. Of nodes with equal tree_id and node_id all are kept:
each is a turn in every path that comes by. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_text(c: Column) -> Column:
    return _replace(c, ("\\", "\\\\"), ("<|", "<\\|"))


def unescape_text(c: Column) -> Column:
    return _replace(c, ("<\\|", "<|"), ("\\\\", "\\"))


def escape_role(c: Column) -> Column:
    return _replace(c, ("%", "%25"), ("\n", "%0A"), ("<|", "%3C|"))


def unescape_role(c: Column) -> Column:
    return _replace(c, ("%3C|", "<|"), ("%0A", "\n"), ("%25", "%"))


def paths(nodes: DataFrame) -> DataFrame:
    """tree, tree_id, leaf, node, up (replies between node and leaf) for every root-to-leaf path."""
    scratch = Scratch(nodes.sparkSession)
    tree = F.coalesce(F.col("tree_id").cast("string"), F.lit("\0"))
    n = scratch.put(
        nodes.select(tree.alias("tree"), "tree_id", F.col("node_id").cast("string").alias("node"), F.col("parent_id").cast("string").alias("parent")).distinct(), "nodes"
    )
    known = n.select("tree", F.col("node").alias("parent")).distinct()
    jump = n.where("parent is not null").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up_to"))
    longest = n.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while len(jumps) < int(longest).bit_length():
        jumps.append(scratch.put(jump, f"jump{len(jumps)}"))
        if jumps[-1].isEmpty():
            break
        far = jumps[-1].select("tree", F.col("node").alias("up_to"), F.col("up_to").alias("far"))
        jump = jumps[-1].join(far, ["tree", "up_to"]).select("tree", "node", F.col("far").alias("up_to"))
    rooted = n.join(jumps[0].select("tree", "node"), ["tree", "node"], "left_anti") if jumps else n
    above = n.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    out = n.join(above, ["tree", "node"], "left_anti").select("tree", "tree_id", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")).distinct()
    for k in reversed(range(len(jumps))):
        both = F.array(F.struct("node", "up"), F.struct(F.col("up_to").alias("node"), (F.col("up") + F.lit(2**k)).cast("int").alias("up")))
        out = out.join(jumps[k], ["tree", "node"], "left").select("tree", "tree_id", "leaf", F.explode(F.filter(both, lambda x: x["node"].isNotNull())).alias("x")).select("tree", "tree_id", "leaf", "x.*")
    ends = rooted.select("tree", "node").distinct().join(out, ["tree", "node"]).select("tree", "leaf").distinct()
    return out.join(ends, ["tree", "leaf"])


def conversations(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """tree_id, leaf, rank, score, formatted, loss (start, end in code points of the formatted text).

    branches: how many of a tree's branches are kept, from the best; None keeps all."""
    own = nodes.select(
        F.coalesce(F.col("tree_id").cast("string"), F.lit("\0")).alias("tree"), F.col("node_id").cast("string").alias("node"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    turn = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit("\n"))
    turns = paths(nodes).join(own, ["tree", "node"]).select(
        "tree_id", "leaf", "score", F.struct((-F.col("up")).alias("at"), "role", "text", turn.alias("head"), escape_text(F.col("text")).alias("body")).alias("turn")
    )
    whole = turns.groupBy("tree_id", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.avg("score").alias("score"))
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf")
    ranks = whole.select("tree_id", "leaf", "score", F.row_number().over(best).alias("rank"))
    if branches is not None:
        ranks = ranks.where(F.col("rank") <= branches)
    ranks = ranks.select(F.col("tree_id").alias("t"), F.col("leaf").alias("l"), "rank", F.col("score").alias("mean"))
    whole = whole.join(ranks, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).select("tree_id", "leaf", "rank", F.col("mean").alias("score"), "turns")
    shown = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    folded = F.aggregate(
        "turns", start,
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + F.lit(len(TAIL))).alias("at"),
            F.when(t["role"] == ASSISTANT, F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))))
            .otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return whole.select("tree_id", "leaf", "rank", "score", shown.alias("formatted"), folded.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array of (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(HEAD) + 1))
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape_role(F.substring_index(body(x), "\n", 1)).alias("role"),
            unescape_text(F.substr(x, F.lit(len(HEAD) + 2) + F.length(F.substring_index(body(x), "\n", 1)))).alias("text"),
        ),
    )


def report(rows: DataFrame) -> DataFrame:
    """The digest columns of op10, of (conv_id, turn, role, text) and of conversation -1: each turn replies to the one before."""
    roles = F.array(F.lit("user"), F.lit(ASSISTANT))
    more = rows.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.get(roles, F.col("id").cast("int")).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    every = rows.select("conv_id", "turn", "role", "text").unionByName(more)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    nodes = every.select(F.col("conv_id").alias("tree_id"), number.alias("node_id"), "role", "text", F.lit(0.0).alias("score")).withColumn(
        "parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    )
    back = conversations(nodes).select("tree_id", "formatted", "loss", read_back(F.col("formatted")).alias("turns"))
    said = F.transform("loss", lambda s: unescape_text(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(F.array_join(said, "")).cast("long").alias("loss_chars"), F.sha2(F.array_join(said, ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB's form of `report`.
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, x.turn, x.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, '{ASSISTANT}')) x(turn, role)
), f AS (
  SELECT *, {len(HEAD) + 1 + len(TAIL)} + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<|', '%3C|')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS size FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
