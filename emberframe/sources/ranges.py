"""Any range of a movie's frames, from as few bytes of its file as it takes.

A file is read by pieces: its head, its end, then of the trailer and of the frames only what a range of positions needs, in
blocks of BLOCK bytes. Where frames are is known from their size, or for frames of unequal size from an index: the attribute
`positions` of the trailer, an index beside the file (`index_movies`), or else a walk over the heads of the frames."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

from emberframe.sources import formats

HEAD, BLOCK = 4096, 4 << 20
#: In the trailer: where frames begin in the file, and where the attributes of each EVERY-th frame begin after those of the movie.
POSITIONS, ATTRIBUTE_POSITIONS, EVERY = "positions", "attributes.positions", 64
#: What is kept of a frame's index: time, bytes of the frame, bytes of its attributes.
INDEX = np.dtype([("ts", "<i8"), ("size", "<u4"), ("attrs", "<u4")])
_END = len(formats.TRAILER)


class Frame(NamedTuple):
    pos: int
    ts_ns: int
    px: bytes | None
    attrs: dict[str, bytes] | None


class Blocks:
    """Small reads one after the other, out of blocks."""

    def __init__(self, read: Callable[[int, int], bytes], block: int = BLOCK):
        self.read, self.block, self.at, self.held = read, block, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.read(at, max(n, self.block))
        return self.held[at - self.at : at - self.at + n]


class Maps:
    """Maps of attributes that follow each other in a trailer."""

    def __init__(self, read: Callable[[int, int], bytes], at: int):
        self.read, self.at = read, at

    def _number(self) -> int:
        raw = self.read(self.at, 8)
        if len(raw) < 8:
            raise EOFError("the trailer ends within its attributes")
        self.at += 8
        return struct.unpack("<Q", raw)[0]

    def _text(self) -> bytes:
        n = self._number()
        size = n & ((1 << 63) - 1)
        raw = self.read(self.at, size)
        self.at += size
        if n >> 63:
            import zstandard

            return zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=struct.unpack_from("<Q", raw)[0])
        return raw

    def next(self) -> dict[str, bytes]:
        return {self._text().decode("utf-8", "replace"): self._text() for _ in range(self._number())}

    def skip(self) -> None:
        for _ in range(2 * self._number()):
            n = self._number()
            self.at += n & ((1 << 63) - 1)


class MovieFile:
    """read(at, n) gives any piece of a file of `size` bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, positions: np.ndarray | None = None):
        self.read, self.size = read, size
        end = read(max(0, size - _END - 16), _END + 16)
        self.trailer, self.n_times = 0, 0
        if end[-_END:] == formats.TRAILER and len(end) == _END + 16:
            n, own = struct.unpack("<QQ", end[:16])
            if _END + 24 <= own <= size and n <= own // 8:
                self.trailer, self.n_times = own, n
        self.head = read(0, HEAD)
        self.movie = formats.sniff(self.head, size - self.trailer)
        self._given, self._attrs, self._maps_at, self._positions = positions, None, 0, None
        self._found = [self.movie.start] if self.movie else []
        #: Whether a PCR frame ends with its time; None: found out.
        self.stamps: bool | None = None

    def attributes(self) -> dict[str, bytes]:
        """Those of the movie."""
        if self._attrs is None:
            maps = Maps(Blocks(self.read, 1 << 16), self.size - self.trailer)
            self._attrs = maps.next() if self.trailer else {}
            self._maps_at = maps.at
        return self._attrs

    # --- where frames are

    def _starts(self, frame: int | None = None, byte: int | None = None) -> np.ndarray:
        """Where frames of unequal size begin, and where the last one ends: all, by the index; without one those that a walk finds
        up to this frame or byte."""
        if self._positions is None:
            raw = self.attributes().get(POSITIONS, b"") if self._given is None else self._given.astype("<i8").tobytes()
            if len(raw) == 8 * self.movie.n:
                self._positions = np.append(np.frombuffer(raw, "<i8").astype(np.int64), self.size - self.trailer)
        if self._positions is not None:
            return self._positions
        end = self.size - self.trailer
        while len(self._found) <= self.movie.n and (frame is None or len(self._found) <= frame + 1) and (byte is None or self._found[-1] < byte) and self._found[-1] < end:
            raw = self.read(self._found[-1] + 8, 4)
            if len(raw) < 4:
                raise EOFError(f"the movie ends within a frame, at {end}")
            self._found.append(self._found[-1] + 12 + struct.unpack("<I", raw)[0])
        return np.array(self._found, np.int64)

    def positions(self) -> np.ndarray:
        """Where each frame of unequal size begins, as the index has it."""
        return self._starts()[:-1]

    def within(self, begin: int, end: int) -> tuple[int, int]:
        """The frames (first, after the last) that begin at these bytes."""
        m = self.movie
        if m.stride:
            first, last = (min(m.n, max(0, -(-(x - m.start) // m.stride))) for x in (begin, end))
            return first, last
        starts = self._starts(byte=end)[:-1]
        first, last = np.searchsorted(starts, [begin, end])
        return int(first), int(last)

    # --- times

    def times(self, chosen: np.ndarray) -> np.ndarray:
        """Of these frames, in increasing order: those of the trailer, of the format, or of the frequency."""
        known = int(np.searchsorted(chosen, self.n_times))
        out = np.zeros(len(chosen), np.int64)
        if known:
            first, last = int(chosen[0]), int(chosen[known - 1]) + 1
            every = self.read(self.size - _END - 16 - 8 * self.n_times + 8 * first, 8 * (last - first))
            out[:known] = np.frombuffer(every, "<i8")[chosen[:known] - first]
        if known < len(chosen):
            out[known:] = self._own_times(chosen[known:])
        return out

    def _own_times(self, chosen: np.ndarray) -> np.ndarray:
        m = self.movie
        if m.format == "ZSTD":
            starts = self._starts(int(chosen[-1]))
            return np.array([struct.unpack("<q", self._piece(int(starts[i]), 8))[0] for i in chosen], np.int64)
        if m.format == "HCC":
            return np.trunc(chosen * (1e12 / m.frequency if m.frequency else 0.0)).astype(np.int64)
        if m.format.startswith("PCR") and m.stride >= 8 and self.stamps is not False:
            if self.stamps:
                return np.array([self._stamp(i) for i in chosen.tolist()], np.int64)
            ends = [self._stamp(i) for i in sorted({0, min(1, m.n - 1), m.n - 1})]
            if all(a < b for a, b in zip(ends, ends[1:], strict=False)) and ends[0] >= 0 and ends[-1] < 1 << 62:
                own = [self._stamp(i) for i in chosen.tolist()]
                if all(a < b for a, b in zip(own, own[1:], strict=False)):
                    return np.array(formats.in_nanoseconds([*ends, *own])[len(ends) :], np.int64)
        return np.trunc(chosen * (1e9 / (m.frequency if m.frequency > 0 else 50))).astype(np.int64)

    def _stamp(self, i: int) -> int:
        return struct.unpack("<q", self._piece(self.movie.start + (i + 1) * self.movie.stride - 8, 8))[0]

    # --- frames

    def _piece(self, at: int, n: int) -> bytes:
        out = self.read(at, n)
        if len(out) < n:
            raise EOFError(f"the movie ends within a frame, at {at + len(out)}")
        return out

    def _maps(self, chosen: list[int]) -> Iterator[dict[str, bytes]]:
        """The trailer's attributes of these frames, in order."""
        if not self.n_times or not chosen or chosen[0] >= self.n_times:
            yield from ({} for _ in chosen)
            return
        known = np.frombuffer(self.attributes().get(ATTRIBUTE_POSITIONS, b""), "<i8")
        maps, at = Maps(Blocks(self.read), self._maps_at), 0
        for i in chosen:
            if i >= self.n_times:
                yield {}
                continue
            if i // EVERY < len(known) and i // EVERY > at // EVERY:
                at = i // EVERY * EVERY
                maps.at = self._maps_at + int(known[at // EVERY])
            while at < i:
                maps.skip()
                at += 1
            yield maps.next()
            at += 1

    def frames(self, chosen: list[int], pixels: bool = True, attrs: bool = True, times: np.ndarray | None = None) -> Iterator[Frame]:
        """These frames, in increasing order: runs of them are read in blocks, and nothing of their pixels if these are not wanted."""
        m = self.movie
        if not chosen:
            return
        if times is None:
            times = self.times(np.array(chosen))
        maps = self._maps(chosen) if attrs else iter(lambda: None, 0)
        own = self._images(chosen) if pixels else self._headers(chosen) if attrs and m.format == "HCC" else ((None, {}) for _ in chosen)
        for i, ts, (px, of_format), more in zip(chosen, times.tolist(), own, maps, strict=False):
            yield Frame(i, ts, px, of_format | more if attrs else None)

    def _headers(self, chosen: list[int]) -> Iterator[tuple[None, dict[str, bytes]]]:
        for i in chosen:
            yield None, _hcc(self._piece(self.movie.start + i * self.movie.stride, formats.HCC_DTYPE.itemsize))

    def _images(self, chosen: list[int]) -> Iterator[tuple[bytes, dict[str, bytes]]]:
        import zstandard

        m, size = self.movie, 2 * self.movie.width * self.movie.height
        if m.stride:
            begin, end = (lambda i: m.start + i * m.stride), (lambda i: m.start + i * m.stride + (size if not m.format == "HCC" else m.stride))
        else:
            starts = self._starts(chosen[-1])
            begin, end = (lambda i: int(starts[i])), (lambda i: int(starts[i + 1]))
        at = 0
        while at < len(chosen):
            upto = at + 1  # a run of frames that follow each other, of a block
            while upto < len(chosen) and chosen[upto] == chosen[upto - 1] + 1 and end(chosen[upto]) - begin(chosen[at]) <= BLOCK:
                upto += 1
            low = begin(chosen[at])
            block = memoryview(self._piece(low, end(chosen[upto - 1]) - low))
            for i in chosen[at:upto]:
                raw = block[begin(i) - low : end(i) - low]
                if m.format == "ZSTD":
                    (n,) = struct.unpack("<I", raw[8:12])
                    if len(raw) < 12 + n:
                        raise EOFError(f"the movie ends within a frame, at {low + len(block)}")
                    yield zstandard.ZstdDecompressor().decompress(raw[12 : 12 + n], max_output_size=size), {}
                elif m.format == "HCC":
                    length = int(np.frombuffer(raw[: formats.HCC_DTYPE.itemsize], formats.HCC_DTYPE, 1)[0]["ImageHeaderLength"])
                    yield bytes(raw[length : length + size]), _hcc(bytes(raw))
                else:
                    yield bytes(raw), {}
            at = upto


def _hcc(raw: bytes) -> dict[str, bytes]:
    h = np.frombuffer(raw[: formats.HCC_DTYPE.itemsize], formats.HCC_DTYPE, 1)[0]
    return {k: str(h[k].item()).encode() for k in formats.HCC_FIELDS} | {"Header": raw[: formats.HCC_DTYPE.itemsize]}
