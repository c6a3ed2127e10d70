"""The exact similarity join of documents by sets of shingles: a size-aware join, light sets by subsets, heavy ones by lists.

Words are runs of characters other than ASCII white space, A-Z in lower case. A document's set has its distinct shingles of
WIDTH words, or all its words as one where there are fewer; two sets are linked if 100 x their intersection is at least
PERCENT x their union. So two sets of s and t elements are linked if they share `shared_of(s, t)` elements.

Equal texts are one set. Sets are light up to a size and heavy beyond it:

* light sets list all their subsets of exactly `shared_of(s, t)` elements, for each size t that a partner may have; of those of
  s and of t elements that list the same subset for (s, t), each is linked with each, and so with the least of them, which is the only link written;
* heavy sets look for partners in the inverted lists of their elements. In a common order of all elements, sets that are linked
  share one of the first n - ceil(n PERCENT / 100) + 1 of both, so that only these have lists. The order puts first what few
  documents have, by a sketch of the number of documents over the whole corpus: however rough this is, the result is exact.
  Lists also hold the light sets that may be partners of heavy ones. Of lists of the same sets one is scanned. All that meet in a list are compared or are in one class
  already (components.linked), without all pairs of a long list being written; before elements are compared, PARITIES bits of each set bound what two can share.

The size up to which sets are light is the one of least cost: the rows of subsets against those of lists, of which each costs
SCAN times as much, as it goes through several joins; both follow from the number of sets of each size.

Elements are hashes of BITS bits; that two different ones of two documents of 20,000 words coincide has a chance of 1 in 700,000.

A null text is empty; empty ones are linked with nothing. Every row has a result, those with equal doc_id too, each by its own text.
A component is named by its least doc_id, nulls not counting; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, by_batch
from emberframe.llm.components import components, linked, shared
from emberframe.llm.minhash import KEPT, _keyed, _mix, shingles

PERCENT = 80
BITS, SKETCH_BITS, PARITIES = 48, 18, 1 << 10
#: Cost of a row of a list, in rows of subsets; sizes beyond MOST_LIGHT are heavy at any cost, as subsets grow as a power of the size.
SCAN, MOST_LIGHT = 8, 24
#: Different elements of a tile that are compared at once.
STEP = 20_000


def shared_of(s: int, t: int) -> int:
    """Elements that sets of these sizes share at least, if they are linked."""
    return -(-PERCENT * (s + t) // (100 + PERCENT))


def partners(s: int) -> range:
    """Sizes of sets that can be linked with one of s elements."""
    return range(-(-PERCENT * s // 100), 100 * s // PERCENT + 1)


def listed(n: int) -> int:
    """Elements of a set of n that have lists."""
    return n - -(-PERCENT * n // 100) + 1


def light_up_to(sizes: dict[int, int]) -> int:
    """The size of least cost, of the number of sets of each size."""
    subsets = {n: sum(math.comb(n, shared_of(n, t)) for t in partners(n) if shared_of(n, t) <= n) for n in range(1, MOST_LIGHT + 1)}

    def cost(x: int) -> int:
        lists = sum(k * listed(n) for n, k in sizes.items() if n >= least_listed(x))
        return sum(sizes.get(n, 0) * subsets[n] for n in range(1, x + 1)) + SCAN * lists

    return min(range(MOST_LIGHT + 1), key=cost)


def least_listed(light: int) -> int:
    """The least size that can be linked with a heavy set."""
    return max(1, partners(light + 1)[0])


# --- sets


def elements(text: str, cache: dict) -> np.ndarray:
    """The set of a text as sorted hashes."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: ASCII only
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    return np.unique(shingles(hashes) >> np.uint64(64 - BITS))


class _Hashes(dict):
    def __missing__(self, word: bytes):
        import xxhash

        if len(self) > KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def parities(x: np.ndarray) -> bytes:
    """A bit for each of PARITIES places or, for long sets, of a power of two times as many: whether an odd number of elements has it.
    Sets of s and t elements whose bits differ in d places share (s + t - d) / 2 at most, as each such place has an element that is
    in one of them only. Both halves of the bits together, as parities, are the bits for half as many places."""
    n = PARITIES << max(0, (len(x) // (2 * PARITIES)).bit_length())
    return np.packbits(np.bincount((x & np.uint64(n - 1)).astype(np.intp), minlength=n) & 1).tobytes()


def packed(x: np.ndarray) -> bytes:
    """The steps between elements, by places of their bytes."""
    return np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[: BITS // 8].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    places = np.frombuffer(data, np.uint8).reshape(BITS // 8, -1)
    steps = np.zeros((places.shape[1], 8), np.uint8)
    steps[:, : BITS // 8] = places.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _measured(docs: DataFrame) -> DataFrame:
    """key, n, elements, parities of each distinct text, and a number for it."""

    def run(batches):
        cache = _Hashes()
        for batch in batches:
            found = [elements(t, cache) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) for x in found], pa.int64()), pa.array([packed(x) for x in found], pa.binary()), pa.array([parities(x) for x in found], pa.binary())], ["key", "n", "elements", "parities"])

    sets = by_batch(_keyed(docs).select("key", "text"), run, "key binary, n long, elements binary, parities binary")
    return sets.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "elements", "parities")]).withColumn("id", F.monotonically_increasing_id())


def _place(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.intp)


def documents_of(sets: DataFrame) -> np.ndarray:
    """The sketch: how many sets have an element of each place. Of fixed size."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            counts += np.bincount(_place(np.concatenate([unpacked(x) for x in batch.column("elements").to_pylist()])), minlength=len(counts))
        (own,) = np.nonzero(counts)
        for at in range(0, len(own), 50_000):
            some = own[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["place", "n"])

    found = by_batch(sets.select("elements"), run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out


# --- heavy sets


def lists(sets: DataFrame, often: np.ndarray, least: int) -> DataFrame:
    """rep, bucket (an element): the lists that sets of at least that size are in."""

    def run(batches):
        for batch in batches:
            some = []
            for data in batch.column("elements").to_pylist():
                x = unpacked(data)
                some.append(x[np.lexsort((x, often[_place(x)]))[: listed(len(x))]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(some, pa.list_(pa.int64()))], ["rep", "lists"])

    return by_batch(sets.where(F.col("n") >= least).select("id", "elements"), run, "rep long, lists array<long>").select("rep", F.explode("lists").alias("bucket"))


def several(banded: DataFrame, scratch: Scratch) -> DataFrame:
    """Of lists (rep, bucket) those of more than one set, and of lists of the same sets one: passages that documents share have as many
    lists as elements. Which sets a list has is told by 128 bits."""
    own = scratch.put(banded.join(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket").select("bucket", "rep"), "several")
    told = own.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    return own.join(told.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def _alike(s: Column, t: Column) -> Column:
    """Whether sets of these sizes can be linked."""
    return F.least(s, t) * 100 >= F.greatest(s, t) * PERCENT


def _may_share(s: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may be linked, by their parities (words in the last axis)."""
    apart = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    return (s + t - apart) // 2 >= -(-PERCENT * (s + t) // (100 + PERCENT))


def _folded(parts: list[bytes], size: int) -> np.ndarray:
    """Parities as words, of so many bytes each; all have that or twice as many."""
    out = np.empty((len(parts), size), np.uint8)
    for k, p in enumerate(parts):
        own = np.frombuffer(p, np.uint8)
        out[k] = own if len(own) == size else own[:size] ^ own[size:]
    return out.view(np.uint64)


def _likely(batches):
    """Of pairs (a, b, sizes, parities, keys) those that may share enough by their parities."""
    for batch in batches:
        s, t = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        x, y = (batch.column(c).to_pylist() for c in ("parities_a", "parities_b"))
        size = np.minimum(np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y)))
        keep = np.zeros(len(s), bool)
        for own in np.unique(size).tolist():  # sizes of sets that can be linked differ by less than 2
            at = np.flatnonzero(size == own)
            keep[at] = _may_share(s[at], t[at], _folded([x[k] for k in at], own), _folded([y[k] for k in at], own))
        yield batch.select(["a", "b", "key_a", "key_b"]).filter(pa.array(keep, pa.bool_()))


def linked_sizes(both, s, t):
    return 100 * both >= PERCENT * (s + t - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity of those pairs that are linked."""

    def run(batches):
        for batch in batches:
            a, b, s = [], [], []
            for i, j, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = unpacked(x), unpacked(y)
                every = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((every[1:] == every[:-1]).sum())
                if linked_sizes(both, len(x), len(y)):
                    a.append(i)
                    b.append(j)
                    s.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    named = lambda c, *of: sets.select(F.col("id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in of])
    whole = lambda c: sets.select(F.col("key").alias(f"key_{c}"), F.col("elements").alias(f"of_{c}"))
    can = pairs.hint("merge").join(named("a", "n"), "a").hint("merge").join(named("b", "n"), "b").where(_alike(F.col("n_a"), F.col("n_b")))
    can = can.hint("merge").join(named("a", "key", "parities"), "a").hint("merge").join(named("b", "key", "parities"), "b")
    can = by_batch(can, _likely, "a long, b long, key_a binary, key_b binary")
    both = can.hint("merge").join(whole("a"), "key_a").select("a", "b", "key_b", "of_a").hint("merge").join(whole("b"), "key_b").select("a", "b", "of_a", "of_b")
    return by_batch(both, run, "a long, b long, similarity double")


def _tiled(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of tiles, as many as join the classes that have a linked pair there. Of a tile's members only those come with their
    elements that by their parities may be linked with one of another class there."""

    def likely(key, t):
        n, own, parts = t.column("n").to_numpy(), t.column("own").to_numpy(), t.column("parities").to_pylist()
        side, size = t.column("side").to_numpy(), np.fromiter(map(len, parts), np.int64, len(parts))
        keep = np.zeros(len(n), bool)
        for least in np.unique(size).tolist():  # pairs of which the shorter one has so many bytes; the other has them or twice as many
            here = np.flatnonzero((size == least) | (size == 2 * least))
            x, left, right = _folded([parts[k] for k in here], least), side[here] != 1, side[here] != 0
            for at in range(0, len(here), 64):
                some = np.arange(at, min(at + 64, len(here)))[left[at : at + 64]]
                i, j = here[some][:, None], here[right][None, :]
                near = _may_share(n[i], n[j], x[some][:, None], x[right][None, :]) & (own[i] != own[j]) & (np.minimum(size[i], size[j]) == least)
                keep[here[some]] |= near.any(1)
                keep[here[right]] |= near.any(0)
        return t.select(["bucket", "tile", "side", "rep", "own", "key"]).filter(pa.array(keep))

    def run(key, t):
        ids, own, side = (t.column(c).to_pylist() for c in ("rep", "own", "side"))
        found = [unpacked(x) for x in t.column("elements").to_pylist()]
        left, right = [k for k, s in enumerate(side) if s in (0, 2)], [k for k, s in enumerate(side) if s in (1, 2)]
        every, at = np.unique(np.concatenate(found), return_inverse=True)
        cuts = np.split(at, np.cumsum([len(x) for x in found])[:-1])
        both = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24
        for start in range(0, len(every), STEP):
            a, b = (np.zeros((len(s), STEP), np.float32) for s in (left, right))
            for m, s in ((a, left), (b, right)):
                for row, k in enumerate(s):
                    i, j = np.searchsorted(cuts[k], [start, start + STEP])
                    m[row, cuts[k][i:j] - start] = 1
            both += a @ b.T
        n = np.array([len(x) for x in found])
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        out = []
        for p, q in np.argwhere(linked_sizes(both.astype(np.int64), n[left][:, None], n[right][None, :])).tolist():
            i, j = left[p], right[q]
            u, v = find(own[i]), find(own[j])
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    told = tiles.hint("merge").join(sets.select(F.col("id").alias("rep"), "key", "n", "parities"), "rep").select("bucket", "tile", "side", "rep", "own", "key", "n", "parities")
    keyed = told.groupBy("bucket", "tile").applyInArrow(likely, "bucket long, tile long, side int, rep long, own long, key binary")
    own = keyed.hint("merge").join(sets.select("key", "elements"), "key").select("bucket", "tile", "side", "rep", "own", "elements")
    return own.groupBy("bucket", "tile").applyInArrow(run, "a long, b long")


# --- light sets


def subsets(sets: DataFrame, light: int) -> DataFrame:
    """id, n, s, t, high, low: the subsets that sets of at most that size list, by 128 bits, for pairs of sizes s <= t."""
    parts_of = {n: [(min(n, t), max(n, t), np.array(list(itertools.combinations(range(n), shared_of(n, t))))) for t in partners(n) if shared_of(n, t) <= n] for n in range(1, light + 1)}

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, n, data in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "elements")), strict=True):
                x = unpacked(data)
                for s, t, parts in parts_of[n]:
                    own = _mix(x)[parts]
                    two = [np.zeros(len(parts), np.uint64), np.ones(len(parts), np.uint64)]
                    with np.errstate(over="ignore"):
                        for k in range(own.shape[1]):
                            two = [_mix(h * np.uint64(0x9E3779B97F4A7C15) + own[:, k]) for h in two]
                    for column, v in zip(out, ([i] * len(parts), [n] * len(parts), [s] * len(parts), [t] * len(parts), two[0].view(np.int64), two[1].view(np.int64)), strict=True):
                        column.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "n", "s", "t", "high", "low"])

    return by_batch(sets.where(F.col("n").between(1, light)).select("id", "n", "elements"), run, "id long, n long, s long, t long, high long, low long")


def _light(sets: DataFrame, light: int, scratch: Scratch) -> DataFrame:
    """a, b: each light set with the least one that lists the same subset, where sets of both sizes do."""
    by = ["s", "t", "high", "low"]
    own = scratch.put(subsets(sets, light), "subsets")
    hubs = own.groupBy(*by).agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.min("n").alias("least"), F.max("n").alias("most"))
    hubs = hubs.where("hub < last and least = s and most = t").select(*by, "hub")
    return own.join(hubs, by).where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def classes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (the least id of its component) of those sets that are linked with another."""
    light = light_up_to({r.n: r.k for r in sets.where(F.col("n").between(1, MOST_LIGHT * 2)).groupBy("n").agg(F.count("*").alias("k")).collect()})
    banded = scratch.put(lists(sets, documents_of(sets), least_listed(light)), "lists")
    members = scratch.put(shared(several(banded, scratch)), "members")
    scratch.drop(banded)
    heavy = linked(members, lambda pairs: _verified(pairs, sets), scratch, lambda tiles: _tiled(tiles, sets))
    if not light:
        return heavy.select(F.col("node").alias("id"), "component")
    every = heavy.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(_light(sets, light, scratch))
    return components(every, scratch).select(F.col("node").alias("id"), "component")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession)
    sets = scratch.put(_measured(docs), "sets", "key")
    class_of = classes(sets, scratch)
    named = sets.select("id", "key", "n").join(class_of, "id", "left").select("key", "n", F.coalesce("component", "id").alias("component"))
    named = scratch.put(named, "named")
    rows = _keyed(docs).select("doc_id", "key")
    least = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(named, "key").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = named.join(least, "component").select("key", "n", "component_id")
    return rows.join(whole, "key").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """The columns of op11."""
    return joined(docs)


#: For tables without repeated doc_ids.
SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), each AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
    SELECT a.doc_id AS p, b.doc_id AS q, a.n AS m, b.n AS n, count(*) AS shared
    FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY ALL
), links AS (
    SELECT p, q FROM pairs WHERE 100 * shared >= 80 * (m + n - shared)
), ends AS (
    SELECT p AS a, q AS b FROM links UNION ALL SELECT q, p FROM links
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = sets.doc_id
"""
