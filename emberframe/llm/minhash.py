"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's words are its lower-cased runs of non-space characters; its features are shingles of five words (all words at once
where there are fewer), each with the weight (1 + ln tf) x idf, idf = ln(1 + texts / document frequency).

Document frequencies are counted over all distinct texts, but likely copies of one text count once, as else a group of copies
would raise the frequency of what it shares and so lower its own likeness: each text has COARSE keys, of two least shingles
each, goes by the one that most texts have, and of those that go by one key the one with the least digest counts. The counts
are a sketch of two rows of 2^IDF_BITS counters, whatever the size of the corpus. Of a counter its row's mean load is taken
off, and the lesser of both rows counts; the standard error is the square root of that load (on 250,000 texts with 10^8
shingles: 28). Shingles in less than RARE of the texts weigh alike.

SAMPLES consistent samples make BANDS bands. Equal texts become one representative, with its features in a table that is dealt
by digest, so that joins of features don't move them again. Representatives that meet in a band's bucket are candidates,
verified by weighted Jaccard similarity of their full features:
1. in each bucket, all members against the bucket's hub; verified pairs become classes;
2. in each bucket, the members whose classes differ: as pairs in small buckets, in large ones by tiles of members, which are
   compared by a matrix product and return only as many links as join their classes. Members of one class are not compared.
So every pair that meets in a bucket is verified or in one class already, without all pairs of a large group being written.

A null or empty text has no words; texts without words are equal to each other. Every row has a class, rows with equal or null
doc_id too; a class is named by its least doc_id, null where it has none. Other columns are ignored by `classes` and kept by
`deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, by_batch, texts
from emberframe.llm.components import linked, shared

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
IDF_BITS = 17
RARE = 1 / 1024
COARSE = 4
#: Different words that a task remembers at most.
KEPT = 250_000
#: The bucket of texts without words.
_NO_WORDS = 0

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


def word_hashes(text: str, cache: dict) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A hash of each run of WIDTH words, or of all words."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - WIDTH + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(WIDTH, len(hashes))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
            out ^= out >> np.uint64(29)
    return _mix(out)


def _tables():
    r = np.random.default_rng(20240501)
    size = 1 << 12
    gamma = lambda: -np.log(r.random(size) * r.random(size) + 1e-12)
    return gamma().astype(np.float32), np.log(gamma()).astype(np.float32), r.random(size).astype(np.float32), r.integers(1 << 62, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sampled(x: np.ndarray, weights: np.ndarray, tables) -> np.ndarray:
    """SAMPLES consistent weighted samples of the set x: hashes of (element, level)."""
    gamma, log_gamma, uniform, odd = tables
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    low = np.uint64(0xFFF)
    rows = np.arange(SAMPLES)
    log_w = np.log(weights).astype(np.float32)
    for at in range(0, len(x), 2048):
        own = x[at : at + 2048]
        with np.errstate(over="ignore"):
            h = own * odd[:, None]
        r = gamma[(h >> np.uint64(52)).astype(np.intp)]
        beta = uniform[((h >> np.uint64(28)) & low).astype(np.intp)]
        level = np.floor(log_w[at : at + 2048] / r + beta)
        cost = log_gamma[((h >> np.uint64(40)) & low).astype(np.intp)] - r * (level - beta + np.float32(1))
        k = cost.argmin(1)
        least = cost[rows, k]
        better = least < best
        best = np.where(better, least, best)
        out = np.where(better, _mix(own[k] + level[rows, k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out)
    return out


def _banded(samples: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX1
    for i in range(ROWS):
        out = _mix(out ^ samples.reshape(BANDS, ROWS)[:, i])
    return out.view(np.int64)


def features(text: str, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, as 32 bits of their hashes in order, and how often each comes."""
    return np.unique((shingles(word_hashes(text, cache)) >> np.uint64(32)).astype(np.uint32), return_counts=True)


def packed(x: np.ndarray, tf: np.ndarray) -> bytes:
    """The steps between shingles by places of their bytes, and the frequencies over one."""
    steps = np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    (many,) = np.nonzero(tf > 1)
    return np.array([len(x)], "<u4").tobytes() + steps.tobytes() + np.concatenate([many, tf[many]]).astype("<u4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    steps = np.frombuffer(data, np.uint8, 4 * n, 4).reshape(4, n)
    x = np.cumsum(np.ascontiguousarray(steps.T).view("<u4").ravel(), dtype=np.uint32)
    rest = np.frombuffer(data, "<u4", offset=4 + 4 * n)
    tf = np.ones(n, np.int64)
    tf[rest[: len(rest) // 2]] = rest[len(rest) // 2 :]
    return x, tf


def coarse(x: np.ndarray) -> np.ndarray:
    """Keys that texts of much the same shingles are likely to share: of the least shingles of two ranges each, or, where a
    range is empty, of the next one that isn't."""
    if not len(x):
        return np.empty(0, np.int64)
    starts = (np.arange(2 * COARSE, dtype=np.uint64) * np.uint64((1 << 32) // (2 * COARSE))).astype(np.uint32)
    least = x[np.searchsorted(x, starts) % len(x)].astype(np.uint64)
    with np.errstate(over="ignore"):
        return _mix(((least[0::2] << np.uint64(32)) | least[1::2]) + np.arange(COARSE, dtype=np.uint64) * _MIX1).view(np.int64)


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's counter in both rows of the sketch."""
    shift = np.uint32(32 - IDF_BITS)
    with np.errstate(over="ignore"):
        return (x >> shift).astype(np.intp), ((x * np.uint32(0x9E3779B1)) >> shift).astype(np.intp)


class Idf:
    """Weights of shingles from the sketch of document frequencies; of fixed size."""

    def __init__(self, n: int, rows: np.ndarray):
        load = (rows.sum(1, keepdims=True) - rows) / (rows.shape[1] - 1)
        self.n, self.rows = max(1, n), (rows - load).astype(np.float32)

    def frequencies(self, x: np.ndarray) -> np.ndarray:
        a, b = _places(x)
        return np.maximum(np.minimum(self.rows[0][a], self.rows[1][b]), max(1.0, self.n * RARE))

    def weights(self, x: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return (1 + np.log(tf)) * np.log1p(self.n / self.frequencies(x))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key (a digest of the text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def _measured(docs: DataFrame) -> DataFrame:
    """key, features, coarse of each distinct text."""

    def run(batches):
        cache = _WordHashes()
        for batch in batches:
            found = [features(t, cache) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([packed(*f) for f in found], pa.binary()), pa.array([coarse(x) for x, _ in found], pa.list_(pa.int64()))], ["key", "features", "coarse"])

    return by_batch(_keyed(docs).select("key", "text"), run, "key binary, features binary, coarse array<long>").groupBy("key").agg(F.first("features").alias("features"), F.first("coarse").alias("coarse"))


def _count(batches):
    counts = np.zeros((2, 1 << IDF_BITS), np.int64)
    for batch in batches:
        every = [unpacked(data)[0] for data in batch.column("features").to_pylist()]
        for row, at in zip(counts, _places(np.concatenate(every)), strict=True):
            row += np.bincount(at, minlength=len(row))
    flat = counts.ravel()
    (own,) = np.nonzero(flat)
    for at in range(0, len(own), 50_000):
        some = own[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(flat[some])], ["place", "n"])


def idf(reps: DataFrame) -> Idf:
    """From (key, features, coarse): over those that count for their likely copies too."""
    each = reps.select("key", F.explode("coarse").alias("c"))
    often = each.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
    by = each.join(often, "c").groupBy("key").agg(F.max(F.struct("n", "c")).alias("x")).select("key", F.col("x.c").alias("c"))
    led = by.join(by.groupBy("c").agg(F.min("key").alias("lead")), "c").where("key != lead").select("key")  # not the ones that count
    leaders = reps.select("key", "features").join(led.hint("merge"), "key", "left_anti")
    n = reps.count() - led.count()
    found = by_batch(leaders.select("features"), _count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    rows = np.zeros(2 << IDF_BITS)
    rows[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return Idf(n, rows.reshape(2, -1))


def signatures(reps: DataFrame, table: Idf) -> DataFrame:
    """rep, bands of (key, features)."""

    def run(batches):
        tables = _tables()
        for batch in batches:
            bands = []
            for data in batch.column("features").to_pylist():
                x, tf = unpacked(data)
                bands.append(_banded(sampled(_mix(x.astype(np.uint64)), table.weights(x, tf), tables)) if len(x) else np.array([_NO_WORDS], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(bands, pa.list_(pa.int64()))], ["rep", "bands"])

    return by_batch(reps.select("key", "features"), run, "rep binary, bands array<long>")


def likeness(a: bytes, b: bytes, table: Idf) -> float:
    """Weighted Jaccard similarity of packed features; 0 where their totals alone put it below SIMILARITY."""
    (x, s), (y, t) = unpacked(a), unpacked(b)
    u, v = table.weights(x, s), table.weights(y, t)
    total = float(u.sum() + v.sum())
    if min(u.sum(), v.sum()) < SIMILARITY * max(u.sum(), v.sum()) * (1 - 1e-9):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    both = float(np.minimum(u[same], v[at[same]]).sum())
    return both / (total - both) if total > both else 1.0


def _verified(pairs: DataFrame, reps: DataFrame, table: Idf, similarity: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            s = [likeness(a, b, table) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array([x >= similarity for x in s], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["a", "b", "similarity"]).filter(keep)

    left = pairs.hint("merge").join(reps.select(F.col("key").alias("a"), F.col("features").alias("fa")), "a")
    both = left.hint("merge").join(reps.select(F.col("key").alias("b"), F.col("features").alias("fb")), "b").select("a", "b", "fa", "fb")
    return by_batch(both, run, "a binary, b binary, similarity double")


def _levels(data: bytes, table: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Weighted features as a plain set: an element for each count of a shingle, weighing what that count adds."""
    x, tf = unpacked(data)
    of = np.repeat(np.arange(len(x)), tf)
    level = np.arange(len(of)) - np.repeat(np.cumsum(tf) - tf, tf) + 1
    gain = 1 + np.log(level) - np.where(level > 1, 1 + np.log(np.maximum(level - 1, 1)), 0.0)
    return (x[of].astype(np.uint64) << np.uint64(32)) | level.astype(np.uint64), gain * table.weights(x, np.ones(len(x)))[of]


def _tiled(tiles: DataFrame, reps: DataFrame, table: Idf, similarity: float) -> DataFrame:
    def run(key, batch):
        rows = batch.to_pylist()
        sets = [_levels(r["features"], table) for r in rows]
        left = [k for k, r in enumerate(rows) if r["side"] != 1]
        right = [k for k, r in enumerate(rows) if r["side"] != 0]
        every, number = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)
        weight = np.zeros(len(every))
        weight[number] = np.concatenate([w for _, w in sets])
        cuts = np.split(number, np.cumsum([len(x) for x, _ in sets])[:-1])
        both = np.zeros((len(left), len(right)))
        for at in range(0, len(every), 20_000):  # a slice of the elements at a time bounds the matrices
            a, b = (np.zeros((len(side), min(20_000, len(every) - at)), np.float64) for side in (left, right))
            for m, side in ((a, left), (b, right)):
                for row, k in enumerate(side):
                    own = cuts[k][(cuts[k] >= at) & (cuts[k] < at + 20_000)] - at
                    m[row, own] = 1
            both += (a * weight[at : at + 20_000]) @ b.T
        total = np.array([w.sum() for _, w in sets])
        near = both >= similarity * (total[left][:, None] + total[right][None, :] - both) * (1 - 1e-12)
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        out = []
        for p, q in np.argwhere(near).tolist():
            r, s = rows[left[p]], rows[right[q]]
            u, v = find(r["own"]), find(s["own"])
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((min(r["rep"], s["rep"]), max(r["rep"], s["rep"])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    own = tiles.hint("merge").join(reps.select(F.col("key").alias("rep"), "features"), "rep").select("bucket", "tile", "side", "rep", "own", "features")
    return own.groupBy("bucket", "tile").applyInArrow(run, "a binary, b binary")


def _named(docs: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """key, class (the least key of its class) of every distinct text."""
    reps = scratch.put(_measured(docs), "reps", "key")
    table = idf(reps)
    banded = scratch.put(signatures(reps, table).select("rep", F.explode("bands").alias("bucket")), "banded")
    members = scratch.put(shared(banded), "members")
    scratch.drop(banded)
    class_of = linked(members, lambda pairs: _verified(pairs, reps, table, similarity), scratch, lambda tiles: _tiled(tiles, reps, table, similarity))
    return scratch.put(reps.select("key").join(class_of.select(F.col("node").alias("key"), "component"), "key", "left").select("key", F.coalesce("component", "key").alias("class")), "named")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) of every row."""
    scratch = Scratch(docs.sparkSession)
    named = _named(docs, similarity, scratch)
    rows = _keyed(docs).select("doc_id", "key")
    least = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(named, "key").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(named.join(least, "class").select("key", "class_id"), "key").select("doc_id", "class_id")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with all its columns: that of the least doc_id (nulls last), of several texts under it that of the
    least digest, of rows that are equal in both any one."""
    scratch = Scratch(docs.sparkSession)
    named = _named(docs, similarity, scratch)
    rows = _keyed(docs).groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "n")).alias("x")
    kept = rows.groupBy("key").agg(first).select("key", "x").join(named, "key").groupBy("class").agg(F.min("x").alias("x"))
    kept = scratch.put(kept.select(F.col("x.doc_id").alias("_doc"), F.col("x.key").alias("_key"), F.col("x.n").alias("_n")), "kept")
    keyed = docs.withColumn("_own", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    on = F.col("_own").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if kept.where("_n > 1").isEmpty():
        return keyed.join(kept, on, "left_semi").select(*columns)
    once = keyed.join(kept.where("_n = 1"), on, "left_semi").select(*columns)
    return once.unionByName(keyed.join(kept.where("_n > 1"), on, "left_semi").dropDuplicates(["doc_id", "_own"]).select(*columns))
