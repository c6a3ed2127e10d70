"""Connected components of a table of links, by rounds of star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the least node it is linked with) of links (a, b). Nodes without a link to another are not returned.

    Each round links every node's greater neighbours to its least one (large stars), then its lesser ones (small stars).
    Rounds end when no link changes; their number grows with the logarithm of the longest chain. Only links shuffle: a node
    with many of them is a group that is reduced before the shuffle, and joined back by a join that Spark can split."""
    edges = scratch.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        after = scratch.put(small, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = after
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now


#: Buckets of more members than this are compared in tiles of members, not in written pairs.
PAIRS_UP_TO, TILE = 32, 256


def shared(banded: DataFrame) -> DataFrame:
    """Of (rep, bucket), the buckets of several: with their number of members and their hub, the member whose buckets are
    fullest. In a group of near copies that is one close to what they were copied from."""
    full = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    own = banded.join(full, "bucket")
    weight = own.groupBy("rep").agg(F.sum("n").alias("weight"))
    own = own.join(weight, "rep")
    hub = own.groupBy("bucket").agg(F.max("weight").alias("most"))
    first = own.join(hub, "bucket").where("weight = most").groupBy("bucket").agg(F.min("rep").alias("hub"))
    return own.select("bucket", "rep", "n").join(first, "bucket")


def linked(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, tile: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Classes (node, component) of what meets in buckets: members as from `shared`; verify keeps the true pairs of (a, b).

    First all members against their bucket's hub; verified pairs become classes. Then, in each bucket, the members whose
    classes still differ are compared: in small buckets as pairs; in others by tile, which gets rows of members by
    (bucket, i, j) with their class (`own`) and returns links enough to join the classes that have a true pair there. So
    every two that meet are compared or in one class, without all pairs of a large group being written."""
    stars = members.where("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = scratch.put(verify(stars), "links")
    class_of = components(links, scratch)
    named = members.select("bucket", "rep", "n").join(class_of.select(F.col("node").alias("rep"), "component"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("own"))
    several = named.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low != high").select("bucket")
    named = scratch.put(named.join(several, "bucket", "left_semi"), "named")
    small = named if tile is None else named.where(F.col("n") <= PAIRS_UP_TO)
    cross = small.join(small.select("bucket", F.col("rep").alias("other"), F.col("own").alias("theirs")), "bucket").where("rep < other and own != theirs")
    more = scratch.put(verify(cross.select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct()), "more")
    every = links.select("a", "b").unionByName(more.select("a", "b"))
    if tile is not None:
        every = every.unionByName(scratch.put(tile(tiles_of(named.where(F.col("n") > PAIRS_UP_TO))), "tiled").select("a", "b"))
    return components(every, scratch)


def tiles_of(members: DataFrame) -> DataFrame:
    """bucket, tile, side (0: one, 1: other, 2: both), rep, own of members (bucket, rep, own).

    A bucket's classes of TILE members or more are cut into chunks of about so many, the others are mixed in chunks. A tile is
    two chunks, but never two of one class. So a member is dealt as often as there are chunks that may hold a class that isn't its
    own: once for a stray text beside a large class, however large that is."""
    sizes = members.groupBy("bucket", "own").agg(F.count("*").alias("size"))
    alone = F.when(F.col("size") >= TILE, F.col("own"))  # null: mixed
    group = members.join(sizes, ["bucket", "own"]).select("bucket", "rep", "own", alone.alias("group"))
    chunks = sizes.select("bucket", alone.alias("group"), "size").groupBy("bucket", "group").agg(F.ceil(F.sum("size") / TILE).cast("int").alias("k"))
    dealt = group.join(chunks.withColumnRenamed("bucket", "b").withColumnRenamed("group", "g"), (F.col("bucket") == F.col("b")) & F.col("group").eqNullSafe(F.col("g")))
    dealt = dealt.select("bucket", "rep", "own", F.xxhash64("group", F.pmod(F.xxhash64("rep"), F.col("k"))).alias("chunk"))
    each = chunks.select("bucket", "group", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select("bucket", "group", F.xxhash64("group", F.col("i").cast("long")).alias("chunk"))
    other = each.select("bucket", F.col("group").alias("theirs"), F.col("chunk").alias("with"))
    pairs = each.join(other, "bucket").where("chunk <= with and (group is null or theirs is null or group != theirs)")
    sides = F.when(F.col("chunk") == F.col("with"), F.array(F.struct("chunk", F.lit(2).alias("side")))).otherwise(
        F.array(F.struct("chunk", F.lit(0).alias("side")), F.struct(F.col("with").alias("chunk"), F.lit(1).alias("side")))
    )
    ends = pairs.select("bucket", F.xxhash64("chunk", "with").alias("tile"), F.explode(sides).alias("x")).select("bucket", "tile", "x.chunk", "x.side")
    return dealt.join(ends, ["bucket", "chunk"]).select("bucket", "tile", "side", "rep", "own")
