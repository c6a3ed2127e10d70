"""Attributes of a movie's file: of the movie, of its frames, and times; read, changed, and written back or discarded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.sources import formats


def _bytes(attrs: dict) -> dict[str, bytes]:
    return {k: v if isinstance(v, bytes) else str(v).encode() for k, v in attrs.items()}


class FileAttributes:
    """Of the bytes of a file. Changes stay here until flush() or close() gives the file with them; discard() forgets them."""

    def __init__(self, data: bytes = b""):
        self.data, self.opened = data, True
        self._read()

    def _read(self) -> None:
        self._attrs, self._per_frame, self._times, self._size = formats.read_trailer(self.data)
        self.changed = False

    def is_open(self) -> bool:
        return self.opened

    def frame_count(self) -> int:
        return len(self._times)

    @property
    def attributes(self) -> dict[str, bytes]:
        return dict(self._attrs)

    @attributes.setter
    def attributes(self, attrs: dict) -> None:
        self._attrs, self.changed = _bytes(attrs), True

    @property
    def timestamps(self) -> list[int]:
        return list(self._times)

    @timestamps.setter
    def timestamps(self, times: Sequence[int]) -> None:
        """As many frames as times; new frames have no attributes."""
        self._times = [int(t) for t in times]
        self._per_frame = (self._per_frame + [{}] * len(self._times))[: len(self._times)]
        self.changed = True

    def set_time(self, frame: int, time: int) -> None:
        self._times[self._checked(frame)] = int(time)
        self.changed = True

    def frame_attributes(self, frame: int) -> dict[str, bytes]:
        return dict(self._per_frame[self._checked(frame)])

    def set_frame_attributes(self, frame: int, attrs: dict) -> None:
        self._per_frame[self._checked(frame)] = _bytes(attrs)
        self.changed = True

    def _checked(self, frame: int) -> int:
        if not 0 <= frame < len(self._times):
            raise IndexError(f"no frame {frame} among {len(self._times)}")
        return frame

    def discard(self) -> None:
        self._read()

    def flush(self) -> bytes:
        """The file as it is to be; as it was where nothing has changed."""
        if self.changed:
            self.data = formats.with_trailer(self.data, self._attrs, self._per_frame, self._times)
            self._read()
        return self.data

    def close(self) -> bytes:
        out = self.flush() if self.opened else self.data
        self.opened = False
        return out

    def __enter__(self) -> FileAttributes:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def with_attributes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (path, content) with the attributes (path, attrs map<string,binary>) of their path added to, or put in place of, their own."""
    def run(content: bytes, attrs: dict | None) -> bytes:
        own = FileAttributes(bytes(content))
        own.attributes = own.attributes | {k: bytes(v) for k, v in (attrs or {}).items()}
        return own.flush()

    def each(batches):
        for batch in batches:
            yield batch[["path"]].assign(content=[run(c, dict(a) if a is not None else None) if a is not None else bytes(c) for c, a in zip(batch["content"], batch["attrs"], strict=True)])

    return files.select("path", "content").join(changes.select("path", "attrs"), "path", "left").mapInPandas(each, "path string, content binary")


def strings(attrs: DataFrame, column: str = "attrs") -> DataFrame:
    """attrs with the values of a map of bytes as text, without zero bytes."""
    return attrs.withColumn(column, F.transform_values(column, lambda _, v: F.translate(F.decode(v, "UTF-8"), "\0", "")))
