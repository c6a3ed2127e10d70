"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the benchmark's items.

Texts and items are normalised alike: A-Z lower-cased, words are runs of digits, letters and non-ASCII characters. A
window is `width` consecutive words of an item, or the whole item where it has fewer words. Windows of all items go into
one automaton, with a space on each side so that only whole words match; every text is scanned once, and hits are mapped
back to word numbers and to character offsets of the original text.

The automaton is built from the benchmark alone, which does not grow with the corpus. It takes windows of BLOCK_BYTES at most,
which also bounds its nodes. A larger benchmark makes several blocks of items, each a broadcast of its own: a task holds texts of
CHUNK_CHARS together and takes one block after the other over them, with one automaton at a time. So the corpus is read once, whatever the
size of the benchmark, the driver holds one block, and a task one automaton (some 200 MB for 4 MB of windows) and its texts.

Null texts and items are empty: no words, no windows, never contaminated. Items with the same id count once; an item without an
id is listed as an empty string. Rows with equal or null doc_id are kept as they are. No rows give no rows, and an empty
benchmark hits nothing. Other columns of `docs` are carried through by `decontaminate` only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import by_batch, ident, texts

#: Bytes of windows in one automaton; code points of texts that several automata are taken over.
BLOCK_BYTES, CHUNK_CHARS = 4 << 20, 32 << 20
WIDTH = 10

#: A-Z to a-z; everything that no word holds to a space.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

SPAN = "array<struct<start:int,end:int>>"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def windows(text: str, width: int = WIDTH) -> set[bytes]:
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def _blocks(benchmark: DataFrame, width: int) -> list:
    """Broadcast lists of items (id, text), whose windows have BLOCK_BYTES together."""
    spread = benchmark.sparkSession.sparkContext.broadcast
    blocks, items, size = [], [], 0
    for item_id, text in ident(benchmark, "item_id", "text").toLocalIterator():
        own = sum(map(len, windows(text or "", width)))
        if size and size + own > BLOCK_BYTES:
            blocks.append(spread(items))
            items, size = [], 0
        items.append(("" if item_id is None else str(item_id), text or ""))
        size += own
    return [*blocks, spread(items)]


def _automaton(items: list[tuple[str, str]], width: int):
    """Windows with the number of their words and the ids of their items; None if there are none."""
    import ahocorasick

    found: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for w in windows(text, width):
            found.setdefault(w, set()).add(item_id)
    a = ahocorasick.Automaton()
    for w, ids in found.items():
        a.add_word(f" {w.decode('utf-8', 'replace')} ", (w.count(b" ") + 1, ids))
    if found:
        a.make_automaton()
    return a if found else None


_ASCII_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _word_offsets(text: str, wanted: list[list[int]]) -> list[dict]:
    """Character offsets in the original text of ranges of words."""
    at = [m.span() for m in _ASCII_WORDS.finditer(text)]
    return [{"start": at[a][0], "end": at[b][1]} for a, b in wanted]


def _chunks(batches, several: bool) -> Iterator[list]:
    """Batches as they come, or for several automata so many together as have CHUNK_CHARS."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(map(len, texts(batch))) if several else CHUNK_CHARS
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _normal(text: str) -> str:
    return (b" " + b" ".join(words(text)) + b" ").decode("utf-8", "replace")


def _scanned(batches, blocks: list, width: int, one, merge) -> Iterator[tuple]:
    """Each batch with what `one` makes of each text (automaton, normalised text), `merge`d over the automata."""
    automaton = _automaton(blocks[0].value, width) if len(blocks) == 1 else None
    for chunk in _chunks(batches, len(blocks) > 1):
        norms = [[_normal(t) for t in texts(batch)] for batch in chunk]
        found = [[merge(None, None) for _ in own] for own in norms]
        for block in blocks:
            a = automaton if len(blocks) == 1 else _automaton(block.value, width)
            for own, results in zip(norms, found, strict=True) if a is not None else ():
                for k, norm in enumerate(own):
                    results[k] = merge(results[k], one(a, norm))
        yield from zip(chunk, norms, found, strict=True)


def _hits_of(automaton, norm: str) -> tuple[list, set]:
    """Ranges (first, last) of words that are hit, and the items."""
    ranges, items = [], set()
    at, number = 0, 0  # words that have ended before `at`
    for end, (n, own) in automaton.iter(norm):
        number += norm.count(" ", at, end)
        at = end
        ranges.append((number - n, number - 1))
        items.update(own)
    return ranges, items


def _both(a, b):
    return ([], set()) if a is None else (a[0] + b[0], a[1] | b[1])


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, word_ranges (merged, end exclusive), items (sorted ids as strings), spans (characters)."""
    blocks = _blocks(benchmark, width)

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch, norms, found in _scanned(batches, blocks, width, _hits_of, _both):
            ranges, spans = [], []
            for text, (own, _) in zip(texts(batch), found, strict=True):
                merged: list[list[int]] = []
                for a, b in sorted(own):
                    if merged and a <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                ranges.append([{"start": a, "end": b + 1} for a, b in merged])
                spans.append(_word_offsets(text, merged) if merged else [])
            n_words = [norm.count(" ") - 1 if len(norm) > 2 else 0 for norm in norms]
            out = [pa.array(n_words, pa.int64()), pa.array(ranges, span), pa.array([sorted(items) for _, items in found], pa.list_(pa.string())), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["doc_id", "n_words", "word_ranges", "items", "spans"])

    return by_batch(ident(docs, "doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, word_ranges {SPAN}, items array<string>, spans {SPAN}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark."""
    blocks = _blocks(benchmark, width)

    def run(batches):
        one, merge = (lambda a, norm: next(a.iter(norm), None) is not None), (lambda a, b: bool(a or b))
        for batch, _, found in _scanned(batches, blocks, width, one, merge):
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return by_batch(docs, run, docs.schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of op9, and spans: start:end of the hit passages in code points of the original text, comma-joined."""
    h = hits(docs, benchmark)
    n_hit = F.aggregate("word_ranges", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return h.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
#: DuckDB's form of `report`: windows of documents and items joined as strings.
SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {_WORDS} FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT item, w, least({WIDTH}, len(w)) AS n, unnest(range(1, greatest(1, len(w) - {WIDTH} + 1) + 1)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
said AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, k, n, item FROM said JOIN windows USING (win, n)),
places AS (SELECT DISTINCT r, unnest(range(k, k + n)) AS place FROM hit),
placed AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
islands AS (SELECT r, min(place) AS low, max(place) AS high FROM (SELECT r, place, place - row_number() OVER (PARTITION BY r ORDER BY place) AS island FROM places) GROUP BY r, island),
lengths AS (SELECT r, list_transform(w, lambda x: length(x)) AS wide, list_transform(string_split_regex(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: length(x)) AS gaps FROM d SEMI JOIN islands USING (r)),
said_at AS (SELECT r, low, list_sum(gaps[1:low]) + coalesce(list_sum(wide[1:low - 1]), 0) AS a, list_sum(gaps[1:high]) + list_sum(wide[1:high]) AS b FROM islands JOIN lengths USING (r)),
spans AS (SELECT r, string_agg(a::BIGINT::VARCHAR || ':' || b::BIGINT::VARCHAR, ',' ORDER BY low) AS spans FROM said_at GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN placed USING (r) LEFT JOIN named USING (r) LEFT JOIN spans USING (r)
"""

__all__ = ["SQL", "decontaminate", "hits", "report", "windows", "words"]
