"""Fill-in-the-middle: texts cut into prefix, middle and suffix at token borders, in an order that the model is to learn.

A token is a run of other characters with the white space before it; white space at the end is a token of its own. White space
is ASCII. Texts are worked on as UTF-8 bytes: all borders come from one look at the bytes. For code points there is a
sparse index of the exceptions only: where a character of several bytes is, and how many bytes it has in excess; between
two of them code points and bytes differ by a constant, so that a cut is turned into the other kind by one binary search.

The cuts and the form of a document go by a hash of the seed and its doc_id. Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm`
<S>suffix<P>prefix<M>middle, `plain` the text itself; a text that holds a mark stays plain, hence outputs can be read back.

A null text is empty, and an empty text is plain. Rows with equal doc_id are cut by the same numbers. A row without doc_id has
no numbers and stays plain. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import by_batch

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def ends(data: bytes) -> np.ndarray:
    """The byte at which each token ends."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    after = np.append(space[1:], True)
    if len(space):
        after[-1] = True
        space[-1] = False  # the last byte ends a token, whatever it is
    return np.flatnonzero(~space & after) + 1


class Exceptions:
    """Code points and bytes of a UTF-8 text, by its characters of several bytes."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        (self.bytes,) = np.nonzero(raw >= 0xC0)
        lead = raw[self.bytes]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])  # of all before the i-th exception
        self.points = self.bytes - self.excess[:-1]

    def to_points(self, at):
        """Code points before each of these bytes, which are borders of characters."""
        return at - self.excess[np.searchsorted(self.bytes, at)]

    def to_bytes(self, at):
        """Bytes before each of these code points."""
        return at + self.excess[np.searchsorted(self.points, at)]


def numbers(seed: int, doc_id: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(data: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, code points of prefix and middle, output of a text."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    stops = ends(data)
    n = len(stops)
    if doc_id is None or not data or p in data or s in data or m in data:
        return n, "plain", None, None, data
    h1, h2, h3, h4 = numbers(seed, doc_id)
    if h3 % 100 >= rate:
        return n, "plain", None, None, data
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (int(stops[k - 1]) if k else 0 for k in (a, b))
    points = Exceptions(data).to_points(np.array([i, j]))
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm else ("psm", (p, prefix, s, suffix, m, middle))
    return n, form, int(points[0]), int(points[1] - points[0]), b"".join(parts)


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output: of 100 documents `rate` are cut, and of 100 of these `spm` are in that form."""

    def run(batches):
        for batch in batches:
            ids, data = batch.column("doc_id").to_pylist(), batch.column("text")
            found = [cut(bytes(data[i].as_buffer()), doc_id, seed, rate, spm) for i, doc_id in enumerate(ids)]
            n, form, first, second, out = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), run, OUTPUT)


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The exact text, from an output and its form only."""
    out = F.col(output)
    after = lambda c, mark: F.substr(c, F.locate(mark, c) + F.lit(len(mark)))
    before = lambda c, mark: F.substring_index(c, mark, 1)
    psm = F.concat(before(after(out, PREFIX), SUFFIX), after(after(out, SUFFIX), MIDDLE), before(after(out, SUFFIX), MIDDLE))
    spm = F.concat(before(after(out, PREFIX), MIDDLE), after(after(out, PREFIX), MIDDLE), before(after(out, SUFFIX), PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def report(docs: DataFrame) -> DataFrame:
    """The columns of op12."""
    return transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = r"""
WITH given AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents
), cut AS (
    SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
           CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM given
), formed AS (
    SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
           CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), pieces AS (
    SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
