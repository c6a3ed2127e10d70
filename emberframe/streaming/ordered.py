"""Folds over streams of frames in the order of their positions, with typed state.

The state of a movie is small and is written by its parts: scalars as one value, the few images that a fold holds, the frames of its
history one by one, and the frames that wait for an earlier one. So a trigger writes the images and what is new, not all that
the fold has seen. State is kept by Spark's transformWithState, which needs the RocksDB state store: `follow` sets
spark.sql.streaming.stateStore.providerClass for the session."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packed(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def unpacked(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


class _Slots:
    """Frames of a history in the state: each is read when it is asked for, and written when it is set."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, at: int) -> np.ndarray:
        return unpacked(bytes(self.state.getValue((at,))[0]))

    def __setitem__(self, at: int, img: np.ndarray) -> None:
        self.state.updateValue((at,), (packed(img),))


class InOrder(StatefulProcessor):
    """One fold a movie. Frames go to it by increasing position without gaps: what comes before its turn waits, in the state; what comes
    after it, or twice, is counted as late and left out. A gap is given up when more than `patience` frames wait, or when some have
    waited for `wait` milliseconds."""

    def __init__(self, make: Callable, row: Callable, columns: list[str], patience: int, wait: int | None):
        self.make, self.row, self.columns, self.patience, self.wait = make, row, columns, patience, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "next int, late long, waiting int, scalars string")
        self.images = handle.getMapState("images", "name string", "image binary")
        self.history = handle.getMapState("history", "slot int", "image binary")
        self.waiting = handle.getMapState("waiting", "pos int", "ts_ns long, h int, w int, px binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._worked(key, pd.concat(list(rows)), timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._worked(key, None, timerValues, True)

    def _worked(self, key, given: pd.DataFrame | None, timers, give_up: bool) -> Iterator[pd.DataFrame]:
        turn, late, held, scalars = self.turn.get() if self.turn.exists() else (0, 0, 0, "")
        fold = self._fold(scalars)
        new = {}
        for r in given.itertuples(index=False) if given is not None else ():
            if r.pos < turn or r.pos in new or held and self.waiting.containsKey((r.pos,)):
                late += 1
            else:
                new[r.pos] = (int(getattr(r, "ts_ns", 0)), int(r.h), int(r.w), bytes(r.px))
        out = []
        while True:
            if turn in new:
                own = new.pop(turn)
            elif held and self.waiting.containsKey((turn,)):
                own = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
                held -= 1
            elif new or held:
                if not give_up and len(new) + held <= self.patience:
                    break
                turn = min([*new, *(k[0] for k in self.waiting.keys())]) if held else min(new)
                continue
            else:
                break
            if (one := self.row(fold, _Frame(key[0], int(turn), *own))) is not None:
                out.append((*one, late))
            turn += 1
        for pos, own in new.items():
            self.waiting.updateValue((int(pos),), own)
        held += len(new)
        self._keep(fold, int(turn), int(late), int(held))
        if self.wait is not None:
            for t in list(self.handle.listTimers()):
                if not held:
                    self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if held and not list(self.handle.listTimers()):
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait)
        yield pd.DataFrame(out, columns=self.columns)

    def _fold(self, scalars: str):
        fold = self.make()
        average = getattr(fold, "held", None)
        if average is not None:
            average.slots = _Slots(self.history)
        if scalars:
            images = {k[0]: unpacked(bytes(v[0])) for k, v in self.images.iterator()}
            own, of_average = json.loads(scalars)
            fold.restore(own, {k: v for k, v in images.items() if not k.startswith("held.")})
            if average is not None:
                average.restore(of_average, {k[5:]: v for k, v in images.items() if k.startswith("held.")})
        return fold

    def _keep(self, fold, turn: int, late: int, held: int) -> None:
        average = getattr(fold, "held", None)
        self.turn.update((turn, late, held, json.dumps([fold.scalars(), average.scalars() if average is not None else None], default=float)))
        images = fold.images() | ({f"held.{k}": v for k, v in average.images().items()} if average is not None else {})
        for k, v in images.items():
            self.images.updateValue((k,), (packed(v),))
        if self.images.exists():
            for gone in [k[0] for k in self.images.keys() if k[0] not in images]:
                self.images.removeKey((gone,))

    def close(self) -> None:
        pass


class _Frame:
    def __init__(self, movie_id, pos: int, ts_ns: int, h: int, w: int, px: bytes):
        self.movie_id, self.pos, self.ts_ns, self.h, self.w, self.px = movie_id, pos, ts_ns, h, w, px


def follow(frames: DataFrame, make: Callable[[dict], object], row: Callable, schema: str, options: dict) -> DataFrame:
    """The rows that row(fold, frame) gives, and late: frames of the movie so far that came too late. `patience`: how many frames
    may wait for an earlier one; `wait`: seconds after which it is given up."""
    options = dict(options)
    patience, wait = int(options.pop("patience", 256)), options.pop("wait", None)
    frames.sparkSession.conf.set(PROVIDER, ROCKSDB)
    target = StructType.fromDDL(schema.format(dict(frames.dtypes)["movie_id"]) + ", late long")
    processor = InOrder(lambda: make(options), row, target.names, patience, None if wait is None else int(wait * 1000))
    own = frames.select(*[c for c in ("movie_id", "pos", "ts_ns", "h", "w", "px") if c in frames.columns])
    return own.groupBy("movie_id").transformWithStateInPandas(processor, target, "append", "none" if wait is None else "processingTime")
