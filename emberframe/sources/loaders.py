"""Loaders of further formats: the last registered one is asked first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from emberframe.sources import formats

Frames = Iterator[tuple[int, int, np.ndarray, dict[str, bytes]]]
_LOADERS: list[tuple[str, Callable[[bytes, int], bool], Callable[[bytes], Frames]]] = []


def register_loader(name: str, probe: Callable[[bytes, int], bool], load: Callable[[bytes], Frames]) -> None:
    """probe gets the first bytes and the size of a file; load gives (pos, ts_ns, image, attributes)."""
    _LOADERS.insert(0, (name, probe, load))


def registered() -> list:
    """The loaders as they are now; queries take them along to the workers."""
    return list(_LOADERS)


def find_loader(head: bytes, size: int, own: list | None = None) -> str | None:
    """The name of the loader for a file, registered or built in."""
    for name, probe, _ in _LOADERS if own is None else own:
        if probe(head, size):
            return name
    m = formats.sniff(head, size)
    return m.format if m else None


def load(data: bytes, own: list | None = None) -> Frames:
    for _, probe, load_own in _LOADERS if own is None else own:
        if probe(data[:4096], len(data)):
            return load_own(data)
    return formats.frames(data)
