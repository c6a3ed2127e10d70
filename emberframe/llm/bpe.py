"""Byte-level BPE encoding and decoding over the distinct words of the corpus.

Texts are cut into pre-tokens by the tokenizer's pattern, once. A chunk of neighbouring rows of a task explodes into its
distinct pre-tokens, numbered in the chunk, and into streams of those numbers, in order: the positions. Both are written to
one table, dealt by chunk: what a task wrote is committed once, so a chunk's number (the task's partition and the chunk's
place in it) is unique however often rows repeat, and streams and vocabulary always come from the same pass. Pre-tokens
shuffle by a hash of their bytes, packed by bucket, so that each distinct one is encoded once, and its ids go back to the
chunks that hold it, where the streams, which don't move, are put together again by position.

Decoding joins ids with the table of token bytes. That table has as many rows as the vocabulary, whatever the corpus; it is
broadcast as one row of an array, which each id indexes, so that neither side shuffles or explodes.

A null text is empty: no ids, the digest of no bytes. Rows with equal or null doc_id are encoded each. Texts of any length
are encoded whole. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, by_batch, ident, parts, sha256, texts

#: Characters of a chunk at most, but for one longer text.
CHUNK_CHARS = 24_000_000
#: Distinct pre-tokens whose ids a task keeps at most.
KEPT = 500_000
#: Buckets of pre-tokens for each partition.
BUCKETS = 4
#: Pre-tokens of a block of streams at most, but for one longer text.
BLOCK = 1 << 20
#: Numbers below this take one byte of a stream, those of the next range two.
_ONE, _TWO = 192, 192 + 63 * 256


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank is merged, the first of equals, until none is left."""
    if word in table:
        return [table[word]]
    pieces = [word[i : i + 1] for i in range(len(word))]
    if len(pieces) > 200:
        return _encode_long(pieces, table)
    while len(pieces) > 1:
        best, at = None, -1
        for i in range(len(pieces) - 1):
            r = table.get(pieces[i] + pieces[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return [table[p] for p in pieces]


def _encode_long(pieces: list[bytes], table: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for pre-tokens of any length."""
    import heapq

    n = len(pieces)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, pieces[i] + pieces[i + 1]) for i in range(n - 1) if (r := table.get(pieces[i] + pieces[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or pieces[i] + pieces[j] != both:
            continue
        pieces[i], alive[j], after[i] = both, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := table.get(pieces[a] + pieces[after[a]])) is not None:
                heapq.heappush(heap, (r, a, pieces[a] + pieces[after[a]]))
    return [table[p] for p, x in zip(pieces, alive, strict=True) if x]


class _Numbers(dict):
    """Pre-tokens by number, in the order in which they first come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Pieces(dict):
    """Numbers of the pre-tokens of a space and what follows it up to the next space.

    A space before anything but white space always begins a pre-token, so such pieces are cut by themselves, and each
    distinct one once a chunk.
    """

    def __init__(self, number: _Numbers, cut):
        super().__init__()
        self.number, self.cut = number, cut

    def __missing__(self, piece):
        if not piece or piece[0].isspace():
            raise ValueError
        self[piece] = found = [self.number[w] for w in self.cut(" " + piece)]
        return found


def _stream(text: str, pieces: _Pieces, by_spaces: bool = True) -> np.ndarray:
    """by_spaces: a space before anything but white space begins a pre-token, which holds for the given pattern only."""
    number, cut = pieces.number, pieces.cut
    if not by_spaces:
        return np.array([number[m] for m in cut(text)], np.uint32)
    first, *rest = text.split(" ")
    try:
        return np.array([number[w] for w in cut(first)] + list(chain.from_iterable(map(pieces.__getitem__, rest))), np.uint32)
    except ValueError:  # white space meets white space
        return np.array([number[w] for w in cut(text)], np.uint32)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers of one, two or five bytes, by places of the bytes, deflated."""
    small = numbers < _ONE
    middle = ~small & (numbers < _TWO)
    first = np.where(small, numbers, np.where(middle, _ONE + ((numbers - np.uint32(_ONE)) >> 8), 255)).astype(np.uint8)
    second = ((numbers[middle] - _ONE) & 255).astype(np.uint8)
    rest = numbers[~small & ~middle].astype("<u4").view(np.uint8).reshape(-1, 4).T
    head = np.array([len(first), len(second)], "<u4").tobytes()
    return zlib.compress(head + first.tobytes() + second.tobytes() + rest.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    flat = zlib.decompress(data)
    n, m = np.frombuffer(flat, "<u4", 2).tolist()
    first = np.frombuffer(flat, np.uint8, n, 8).astype(np.uint32)
    second = np.frombuffer(flat, np.uint8, m, 8 + n)
    rest = np.frombuffer(flat, np.uint8, offset=8 + n + m).reshape(4, -1)
    middle = (first >= _ONE) & (first < 255)
    out = first.copy()
    out[middle] = _ONE + ((first[middle] - _ONE) << 8) + second
    out[first == 255] = np.ascontiguousarray(rest.T).view("<u4").ravel()
    return out


def _cut(split_pattern: str, buckets: int, kind: pa.DataType):
    """Rows of a chunk: one for each block of texts, with their streams, and one for each bucket of its distinct pre-tokens,
    with their numbers, lengths and bytes."""
    names = ["chunk", "bucket", "numbers", "lengths", "words", "doc_ids"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(kind)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def vocabulary_of(chunk: int, number: _Numbers):
        data = [w.encode("utf-8", "replace") for w in number]
        bucket = np.fromiter(map(zlib.crc32, data), np.int64, len(data)) % buckets
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        out = []
        for own in np.split(order, at[1:]) if len(order) else []:
            some = [data[i] for i in own.tolist()]
            out.append((chunk, int(bucket[own[0]]), _pack(np.diff(own, prepend=0).astype(np.uint32)), _pack(np.fromiter(map(len, some), np.uint32, len(some))), zlib.compress(b"".join(some), 6), None))
        for i in range(0, len(out), 256):
            yield batch_of(out[i : i + 256])

    def run(batches):
        import regex
        from pyspark import TaskContext

        finder, by_spaces = regex.compile(split_pattern), split_pattern == pattern()
        cut = finder.findall if by_spaces else lambda t: [m[0] for m in finder.finditer(t)]  # noqa: E731  groups of others don't matter
        task = TaskContext.get()
        chunk, size = (task.partitionId() if task else 0) << 32, 0
        pieces = _Pieces(_Numbers(), cut)
        ids: list = []
        streams: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), texts(batch), strict=True):
                if size and size + len(text) > CHUNK_CHARS:
                    if ids:
                        yield batch_of([_block(chunk, ids, streams)])
                    yield from vocabulary_of(chunk, pieces.number)
                    chunk, size, ids, streams, held = chunk + 1, 0, [], [], 0
                    pieces = _Pieces(_Numbers(), cut)
                ids.append(doc_id.as_py())
                streams.append(_stream(text, pieces, by_spaces))
                size += len(text)
                held += len(streams[-1])
                if held >= BLOCK:
                    yield batch_of([_block(chunk, ids, streams)])
                    ids, streams, held = [], [], 0
        if ids:
            yield batch_of([_block(chunk, ids, streams)])
        yield from vocabulary_of(chunk, pieces.number)

    return run


def _block(chunk: int, ids: list, streams: list[np.ndarray]) -> tuple:
    return chunk, None, None, _pack(np.fromiter(map(len, streams), np.uint32, len(streams))), _pack(np.concatenate(streams)), ids


def _encode(path: str):
    """Rows (chunk, numbers, lengths, words, bucket) come sorted by bucket; each distinct pre-token of a bucket is encoded once."""

    def run(batches):
        table, bucket = ranks(path), None
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            counts, out = [], []
            for b, lengths, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lengths", "words")), strict=True):
                if b != bucket or len(known) > KEPT:
                    bucket, known = b, {}
                data, at, own = zlib.decompress(words), 0, []
                for n in _unpack(lengths).tolist():
                    w = data[at : at + n]
                    at += n
                    if (ids := known.get(w)) is None:
                        ids = known[w] = encode_word(w, table)
                    own.append(ids)
                counts.append(_pack(np.fromiter(map(len, own), np.uint32, len(own))))
                out.append(list(chain.from_iterable(own)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("numbers"), pa.array(counts, pa.binary()), pa.array(out, pa.list_(pa.int32()))], ["chunk", "numbers", "counts", "ids"])

    return run


def _parts_of(values: pa.ChunkedArray):
    """The items of each row of a column of lists."""
    for chunk in values.chunks:
        at = chunk.offsets.to_numpy()
        for a, b in zip(at, at[1:], strict=False):
            yield chunk.values.slice(a, b - a)


def _of_pretokens(words: pa.Table, value: str, make):
    """make(parts, counts) of each row of words, by number of the pre-token."""
    known: list = []
    where = []
    for numbers, counts, own in zip(words.column("numbers").to_pylist(), words.column("counts").to_pylist(), _parts_of(words.column(value)), strict=True):
        where.append(np.cumsum(_unpack(numbers), dtype=np.int64))
        known += make(own, _unpack(counts))
    out: list = [None] * len(known)
    for n, x in zip(np.concatenate(where).tolist() if where else [], known, strict=True):
        out[n] = x
    return out


def _split(own: pa.Array, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(own.to_numpy(), np.cumsum(counts)[:-1])


def _joined(own: pa.Array, counts: np.ndarray) -> list[bytes]:
    """Token bytes by pre-token: the bytes lie one after the other already."""
    at = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, own.offset * 4) if len(own) else np.zeros(1, np.int32)
    ends = at[np.cumsum(counts)].tolist()
    data = own.buffers()[2].to_pybytes()[at[0] : ends[-1]] if len(own) and own.buffers()[2] else b""
    return [data[a - at[0] : b - at[0]] for a, b in zip([int(at[0]), *ends], ends, strict=False)]


def _texts_of(streams: pa.Table):
    """doc_id and numbers of the pre-tokens of each text."""
    for ids, lengths, words in zip(*(streams.column(c).to_pylist() for c in ("doc_ids", "lengths", "words")), strict=True):
        yield from zip(ids, np.split(_unpack(words), np.cumsum(_unpack(lengths))[:-1]), strict=True)


def _digests(kind: pa.DataType):
    def run(key, words, streams):
        ids = _of_pretokens(words, "ids", _split)
        length = np.array([len(x) for x in ids], np.int64)
        shown = [" ".join(map(str, x.tolist())) for x in ids]
        plain = _of_pretokens(words, "bytes", _joined)
        doc_ids, n, a, b = [], [], [], []
        for doc_id, numbers in _texts_of(streams):
            own = numbers.tolist()
            doc_ids.append(doc_id)
            n.append(int(length[numbers].sum()) if own else 0)
            a.append(sha256(" ".join([shown[i] for i in own]).encode()))
            b.append(sha256(b"".join([plain[i] for i in own])))
        return pa.table({"doc_id": pa.array(doc_ids, kind), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return run


def _ids(kind: pa.DataType):
    def run(key, words, streams):
        ids = _of_pretokens(words, "ids", _split)
        doc_ids, out = [], []
        for doc_id, numbers in _texts_of(streams):
            doc_ids.append(doc_id)
            own = numbers.tolist()
            out.append(np.concatenate([ids[i] for i in own]).astype(np.int32) if own else np.empty(0, np.int32))
        return pa.table({"doc_id": pa.array(doc_ids, kind), "ids": pa.array(out, pa.list_(pa.int32()))})

    return run


def _by_chunk(docs: DataFrame, path: str, split_pattern: str, digests: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    base, n = ident(docs, "doc_id", "text"), parts(docs)
    kind, arrow = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    cut = by_batch(base, _cut(split_pattern, BUCKETS * n, arrow), f"chunk long, bucket int, numbers binary, lengths binary, words binary, doc_ids array<{kind}>")
    table = Scratch(docs.sparkSession).put(cut, "cut", "chunk")
    words = table.where("bucket is not null").select("chunk", "bucket", "numbers", "lengths", "words").repartition(n, "bucket").sortWithinPartitions("bucket")
    encoded = by_batch(words, _encode(path), "chunk long, numbers binary, counts binary, ids array<int>").repartition(n, "chunk")
    streams = table.where("bucket is null").select("chunk", "lengths", "words", "doc_ids").groupBy("chunk")
    if digests:
        encoded = _with_bytes(encoded, path).select("chunk", "numbers", "counts", "ids", "bytes")
        return encoded.groupBy("chunk").cogroup(streams).applyInArrow(_digests(arrow), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return encoded.groupBy("chunk").cogroup(streams).applyInArrow(_ids(arrow), f"doc_id {kind}, ids array<int>")


def encode(docs: DataFrame, path: str | None = None, split_pattern: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of every whole text, each pre-token encoded by itself, without special tokens. What a pattern of one's
    own does not match has no ids; texts are then cut as a whole, not by spaces."""
    return _by_chunk(docs, path or vocabulary(), split_pattern or pattern(), False)


def token_bytes(spark, path: str | None = None) -> DataFrame:
    """One row: an array of the bytes of each token, by id. Ids that the vocabulary leaves out have none."""
    table = ranks(path or vocabulary())
    by_id: list = [None] * (max(table.values()) + 1)
    for b, i in table.items():
        by_id[i] = b
    return spark.createDataFrame(pa.table({"token_bytes": pa.array([by_id], pa.list_(pa.binary()))}))


def _with_bytes(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the bytes of each of its ids: a join with the table of token bytes."""
    joined = encoded.crossJoin(F.broadcast(token_bytes(encoded.sparkSession, path)))  # one row
    return joined.withColumn("bytes", F.transform("ids", lambda i: F.get("token_bytes", i))).drop("token_bytes")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, bytes of (doc_id, ids): ids joined with the table of token bytes, concatenated in order. Null ids are empty."""
    own = _with_bytes(encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), path or vocabulary())
    return own.select("doc_id", concatenated(F.col("bytes")).alias("bytes"))


def concatenated(pieces: Column) -> Column:
    return F.unhex(F.array_join(F.transform(pieces, F.hex), ""))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of op8: encoded, and decoded again from the ids."""
    return _by_chunk(docs, vocabulary(), pattern(), True)


__all__ = ["decode", "encode", "encode_word", "report", "token_bytes"]
