"""Movies as a data source of Spark, to read, to follow while they grow, and to write.

    datasource.from_files(spark, "s3://bucket/movies/*.pcr").where("pos between 100 and 199")
    datasource.follow(spark, "/data/live")
    datasource.to_files(frames, "/data/movies", codec="zstd")

Reading. The driver lists files and their sizes, and opens none: files are cut by bytes into pieces of PART_BYTES, small ones are
packed together, and a task gives the frames that begin in its pieces (ranges.MovieFile). Conditions on `pos`, `movie_id` and
`ts_ns` are pushed into the source: files that they exclude are not opened, frames that they exclude are not read, and where
they leave few frames of a file, its pieces are one. Only the columns of the schema are made: without `px` no pixel is read.

Options: `path`; `first`, `last`: positions; `movie`: a pattern of paths; `index`: a folder with indices (index_movies); `unless`: a folder,
movies of whose files' names are left out; `pushdown`: whether conditions are pushed, which Spark allows
only with spark.sql.python.filterPushdown.enabled (from_files sets both); `loaders`, `opener`: as from_files passes them. Files that are no
movie are an error of the task that reads them. Stores are those that pyarrow opens, or what an opener reads.

Times that are written after each frame are taken if the first, second and last one say that they are times; a piece whose own times
don't increase has those of the frequency.

Writing: see MovieWriter."""

from __future__ import annotations

import base64
import fnmatch
import json
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from emberframe.sources import formats, ranges

FRAMES = "movie_id string, pos int, ts_ns long, h int, w int, px binary, attrs map<string,binary>"
ARROW = pa.schema([("movie_id", pa.string()), ("pos", pa.int32()), ("ts_ns", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("px", pa.binary()), ("attrs", pa.map_(pa.string(), pa.binary()))])
PART_BYTES = 128 << 20
#: What opening a file costs, in bytes, when small files are packed.
OPEN_BYTES = 4 << 20
#: So many frames of a file at most are few: they are taken for MOST_FRAME bytes each at planning.
FEW, MOST_FRAME = 64, 1 << 20
#: Rows and bytes of a batch at most.
BATCH, BATCH_BYTES = 512, 16 << 20
SUFFIX = {"zstd": ".bin", "pcr": ".pcr"}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def store_of(path: str):
    """The file system and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> list[tuple[str, int]]:
    """Files and their sizes: of a folder, of a pattern in a folder, or the file itself. One call of the store; no file is opened."""
    from pyarrow import fs

    store, own = store_of(path)
    folder, _, name = own.rpartition("/")
    prefix = path[: len(path) - len(own)]
    if any(c in name for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(folder or ".")) if fnmatch.fnmatch(f.base_name, name)]
    else:
        (info,) = store.get_file_info([own])
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(own)) if not f.base_name.startswith((".", "_"))]
    return sorted((prefix + f.path, f.size) for f in found if f.is_file)


def files_of(path: str) -> list[str]:
    return [p for p, _ in listed(path)]


class ChunkReader:
    """Reads any piece of a file, without holding more of it."""

    def __init__(self, path: str):
        store, own = store_of(path)
        self.file = store.open_input_file(own)
        self.size = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at)


def _stem(path: str) -> str:
    return os.path.splitext(path.rsplit("/", 1)[-1])[0]


def _unpickled(text: str | None, default):
    from pyspark import cloudpickle

    return default if not text else cloudpickle.loads(base64.b64decode(text))


def _pickled(x) -> str:
    from pyspark import cloudpickle

    return base64.b64encode(cloudpickle.dumps(x)).decode()


@dataclass
class Split(InputPartition):
    """Pieces (path, size, begin, end) of files; a frame is of the piece in which its first byte is."""

    pieces: list


@dataclass
class Wanted:
    """The frames that are asked for."""

    first: int = 0
    last: int = (1 << 31) - 1
    only: set | None = None
    times: list = field(default_factory=list)  # of (comparison, ns)
    movies: list = field(default_factory=list)  # of (comparison, text)

    def take(self, f: Filter) -> bool:
        """Whether a condition can be answered here in full; then it is."""
        (column, *inner), value = f.attribute if hasattr(f, "attribute") else ("", "x"), getattr(f, "value", None)
        if inner or column not in ("pos", "ts_ns", "movie_id"):
            return False
        if isinstance(f, IsNotNull):
            return True
        if value is None or isinstance(f, In) and any(v is None for v in value):
            return False
        kind = type(f)
        if column == "movie_id":
            if kind in _TEXTS:
                self.movies.append((kind.__name__, value))
            return kind in _TEXTS
        if kind not in _NUMBERS:
            return False
        if column == "ts_ns":
            self.times.append((kind.__name__, value))
        elif kind is In:
            self.only = set(value) if self.only is None else self.only & set(value)
        else:
            if kind is not LessThan and kind is not LessThanOrEqual:
                self.first = max(self.first, value + (kind is GreaterThan))
            if kind is not GreaterThan and kind is not GreaterThanOrEqual:
                self.last = min(self.last, value - (kind is LessThan))
        return True

    def most(self) -> int:
        """Frames of a file at most."""
        return max(0, min(self.last - self.first + 1, len(self.only) if self.only is not None else 1 << 31))

    def has_movie(self, path: str) -> bool:
        return all(_TEXT_TESTS[kind](path, v) for kind, v in self.movies)

    def positions(self, first: int, last: int) -> np.ndarray:
        """Of the positions first to last - 1."""
        a, b = max(first, self.first), min(last - 1, self.last)
        return np.arange(a, b + 1) if self.only is None else np.array(sorted(i for i in self.only if a <= i <= b), np.int64)

    def at(self, times: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([_NUMBER_TESTS[kind](times, v) for kind, v in self.times]) if self.times else np.ones(len(times), bool)


_NUMBERS = (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)
_TEXTS = (EqualTo, EqualNullSafe, In, StringStartsWith, StringEndsWith, StringContains)
_NUMBER_TESTS: dict[str, Callable] = {
    "EqualTo": np.equal, "EqualNullSafe": np.equal, "GreaterThan": np.greater, "GreaterThanOrEqual": np.greater_equal, "LessThan": np.less, "LessThanOrEqual": np.less_equal,
    "In": lambda x, v: np.isin(x, np.array(v, np.int64)),
}
_TEXT_TESTS: dict[str, Callable] = {
    "EqualTo": str.__eq__, "EqualNullSafe": str.__eq__, "In": lambda x, v: x in v, "StringStartsWith": str.startswith, "StringEndsWith": str.endswith, "StringContains": str.__contains__,
}


class MovieSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "movie"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown") == "true" else MovieReader
        return kind(self.options, schema)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MovieStream(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MovieWriter(self.options, overwrite)


class _Pieces:
    """What readers of tables and of streams share: the frames of pieces."""

    def __init__(self, options: dict, schema=None):
        self.path, self.movie, self.index, self.unless = (options.get(k) for k in ("path", "movie", "index", "unless"))
        self.columns = [f.name for f in schema.fields] if schema is not None else ARROW.names
        if odd := set(self.columns) - set(ARROW.names):
            raise ValueError(f"no such columns of a movie: {sorted(odd)}")
        self.opener, self.loaders = options.get("opener"), options.get("loaders")
        self.wanted = Wanted(int(options.get("first", 0)), int(options.get("last", (1 << 31) - 1)))

    def _files(self) -> list[tuple[str, int]]:
        gone = set()
        if self.unless:
            try:
                gone = {_stem(p) for p in files_of(self.unless)}
            except FileNotFoundError:
                pass
        return [(p, n) for p, n in listed(self.path) if (not self.movie or fnmatch.fnmatch(p, self.movie)) and self.wanted.has_movie(p) and _stem(p) not in gone]

    def _open(self, path: str) -> tuple[Callable[[int, int], bytes], int]:
        read = _unpickled(self.opener, ChunkReader)(path)
        return read, read.size

    def _indexed(self, path: str) -> np.ndarray | None:
        if not self.index:
            return None
        try:
            return np.frombuffer((read := ChunkReader(f"{self.index}/{_index_name(path)}"))(0, read.size), "<i8")
        except FileNotFoundError:
            return None

    def _frames(self, piece: tuple[str, int, int, int]) -> Iterator[tuple]:
        path, size, begin, end = piece
        read, now = self._open(path)
        for _, probe, load in _unpickled(self.loaders, []):
            if probe(read(0, ranges.HEAD), now):
                yield from self._loaded(path, load, read(0, now)) if begin == 0 else ()
                return
        own = ranges.MovieFile(read, now, self._indexed(path))
        if not self._movie(path, own):
            return
        m = own.movie
        chosen = self.wanted.positions(*self._between(own, begin, end))
        times = None
        if len(chosen) and (self.wanted.times or "ts_ns" in self.columns):
            times = own.times(chosen)
            keep = self.wanted.at(times)
            chosen, times = chosen[keep], times[keep]
        elif len(chosen):
            times = np.zeros(len(chosen), np.int64)
        for f in own.frames(chosen.tolist(), "px" in self.columns, "attrs" in self.columns, times):
            yield path, f.pos, f.ts_ns, m.height, m.width, f.px, None if f.attrs is None else list(f.attrs.items())

    def _movie(self, path: str, own: ranges.MovieFile) -> bool:
        """Whether there are frames to take."""
        if own.movie is None or not own.movie.n:
            raise ValueError(f"{path} is not a movie that can be decoded here")
        return True

    def _between(self, own: ranges.MovieFile, begin: int, end: int) -> tuple[int, int]:
        return own.within(begin, end)

    def _loaded(self, path: str, load: Callable, data: bytes) -> Iterator[tuple]:
        _, per_frame, times, size = formats.read_trailer(data)
        for pos, ts, img, attrs in load(data[: len(data) - size]):
            ts = times[pos] if pos < len(times) else ts
            if len(self.wanted.positions(pos, pos + 1)) and self.wanted.at(np.array([ts]))[0]:
                yield path, pos, ts, *img.shape, np.ascontiguousarray(img, "<u2").tobytes(), list((attrs | (per_frame[pos] if pos < len(per_frame) else {})).items())

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for piece in part.pieces:
            for row in self._frames(piece):
                rows.append(row)
                held += len(row[5] or b"")
                if len(rows) == BATCH or held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        own = dict(zip(ARROW.names, zip(*rows, strict=True), strict=True))
        target = pa.schema([ARROW.field(c) for c in self.columns])
        return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) for f in target], schema=target)


class MovieReader(_Pieces, DataSourceReader):
    def partitions(self) -> list[Split]:
        out: list[Split] = []
        held, weight, most = [], 0, self.wanted.most()
        for path, size in self._files() if most else []:
            cut = size if most <= FEW else PART_BYTES
            for begin in range(0, max(size, 1), max(cut, 1)):
                own = (path, size, begin, min(size, begin + cut))
                cost = OPEN_BYTES + min(own[3] - begin, most * MOST_FRAME)
                if held and weight + cost > PART_BYTES + OPEN_BYTES:
                    out.append(Split(held))
                    held, weight = [], 0
                held.append(own)
                weight += cost
        return [*out, Split(held)]


class PushingReader(MovieReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f


def _index_name(path: str) -> str:
    import hashlib

    return hashlib.sha256(path.encode()).hexdigest()[:32] + ".index"


# --- movies that grow


class MovieStream(_Pieces, DataSourceStreamReader):
    """New frames of the files of a folder: an offset is the size of each file, so the driver opens none here either.

    A frame comes in the trigger in which its last byte is there, once. What a file's head says of the number of frames counts only
    when the file has a trailer, i.e. is complete; until then it is as many as have been written whole. Files with frames of unequal size come
    as a whole when they have a trailer. New files are taken as they appear; a file that gets shorter is an error. With the option
    `stamps` the last 8 bytes of a PCR frame are its time; otherwise times are those of the frequency, or of a trailer that is there."""

    def __init__(self, options: dict, schema=None):
        super().__init__(options, schema)
        self.stamps = options.get("stamps") == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(self._files())

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out: list[Split] = []
        for path, size in sorted(end.items()):
            begin = start.get(path, 0)
            if size < begin:
                raise ValueError(f"{path} has become shorter")
            out += [Split([(path, size, a, min(size, a + PART_BYTES))]) for a in range(begin, size, PART_BYTES)]
        return out or [Split([])]

    def _movie(self, path: str, own: ranges.MovieFile) -> bool:
        if own.movie is None and own.size < ranges.HEAD:
            return False  # less than a head
        if own.movie and own.movie.stride:  # what is there, whatever the head says so far
            limit = (own.size - own.trailer - own.movie.start) // own.movie.stride
            own.movie.n = max(0, min(limit, own.movie.n) if own.trailer else limit)
        own.stamps = self.stamps
        return super()._movie(path, own) if own.movie is None or own.movie.n else False

    def _between(self, own: ranges.MovieFile, begin: int, end: int) -> tuple[int, int]:
        m = own.movie
        if not m.stride:  # whole, in the piece where its trailer ends
            return (0, m.n) if own.trailer and begin < own.size <= end else (0, 0)
        first, last = (min(m.n, max(0, (x - m.start) // m.stride)) for x in (begin, end))
        return first, last

    def commit(self, end: dict) -> None:
        pass


# --- writing


@dataclass
class Written(WriterCommitMessage):
    segments: list  # of dicts


class MovieWriter(DataSourceWriter):
    """Each movie becomes a file of the folder, from as many tasks as hold frames of it.

    A task writes the frames of a movie that it gets, which are in order, as a segment: encoded frames one after the other, an
    index of their times and sizes, and their attributes. What it holds is one frame. The commit checks that segments follow each
    other, joins them in order into a file with head, trailer and index, by blocks, and moves that to its name. All but
    that is in a folder of the job, which goes at the end in any case: a failed task leaves nothing.

    append: movies whose file is there already are an error, or are left out with the option ifExists = ignore; overwrite: they are
    replaced. With the option `join` = later the commit leaves segments and a list of them, for to_files to join on the cluster."""

    def __init__(self, options: dict, overwrite: bool):
        import uuid

        self.path, self.codec, self.frequency = options["path"].rstrip("/"), options.get("codec", "zstd"), int(options.get("frequency", 50))
        self.level, self.overwrite, self.ignore = int(options.get("level", 3)), overwrite, options.get("ifexists", options.get("ifExists")) == "ignore"
        self.attrs = {k.removeprefix("attr."): v.encode() for k, v in options.items() if k.startswith("attr.")}
        if self.codec not in SUFFIX:
            raise ValueError(f"no such codec here: {self.codec}")
        self.job = options.get("job") or uuid.uuid4().hex
        self.temporary, self.later = f"{self.path}/_segments-{self.job}", options.get("join") == "later"

    def target(self, movie_id: str) -> str:
        name = movie_id.rsplit("/", 1)[-1]
        return f"{self.path}/{name if '.' in name else name + SUFFIX[self.codec]}"

    def write(self, rows: Iterator) -> Written:
        made, movie, segment = [], object(), None
        try:
            for r in rows:
                if r.movie_id != movie:
                    if segment:
                        made.append(segment.close())
                    movie, segment = r.movie_id, self._segment(r)
                if segment:
                    segment.add(r)
            if segment:
                made.append(segment.close())
        except BaseException:
            if segment:
                segment.discard()
            raise
        return Written(made)

    def _segment(self, r) -> _Segment | None:
        from pyarrow import fs

        store, own = store_of(self.target(r.movie_id))
        if not self.overwrite and store.get_file_info([own])[0].type != fs.FileType.NotFound:
            if self.ignore:
                return None
            raise FileExistsError(own)
        return _Segment(self, r.movie_id, r.h, r.w)

    def commit(self, messages: list) -> None:
        movies: dict[str, list[dict]] = {}
        for m in messages:
            for s in m.segments if m else []:
                movies.setdefault(s["movie"], []).append(s)
        for own in movies.values():
            own.sort(key=lambda s: s["first"])
            if any(a["last"] >= b["first"] for a, b in zip(own, own[1:], strict=False)):
                self.abort(messages)
                raise ValueError("tasks wrote the same positions of a movie; the frames of a task are to be a range of it, in order")
            if len({(s["h"], s["w"]) for s in own}) > 1:
                self.abort(messages)
                raise ValueError("images of a movie are of one size")
        if self.later:
            store, own = store_of(f"{self.temporary}/list")
            store.create_dir(own.rpartition("/")[0], recursive=True)
            with store.open_output_stream(own) as f:
                f.write("".join(json.dumps(x) + "\n" for x in movies.values()).encode())
            return
        for own in movies.values():
            self.join(own)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Removes what belongs to the job."""
        from pyarrow import fs

        store, own = store_of(self.temporary)
        if store.get_file_info([own])[0].type != fs.FileType.NotFound:
            store.delete_dir(own)

    def join(self, segments: list[dict]) -> None:
        """One file of the segments of a movie. Of it this holds a block, and 16 bytes a frame."""
        store, temporary = store_of(f"{self.temporary}/{segments[0]['name']}.whole")
        _, own = store_of(self.target(segments[0]["movie"]))
        index = np.concatenate([np.frombuffer((read := ChunkReader(s["path"] + ".index"))(0, read.size), ranges.INDEX) for s in segments])
        with store.open_output_stream(temporary) as out:
            head = formats.head_of(self.codec, segments[0]["h"], segments[0]["w"], len(index), self.frequency)
            out.write(head)
            _copied(out, [s["path"] + ".frames" for s in segments])
            attrs = dict(self.attrs)
            ends = np.cumsum(index["attrs"], dtype=np.int64)
            attrs[ranges.ATTRIBUTE_POSITIONS] = (ends - index["attrs"])[:: ranges.EVERY].astype("<i8").tobytes()
            if self.codec == "zstd":
                attrs[ranges.POSITIONS] = (len(head) + np.cumsum(index["size"], dtype=np.int64) - index["size"]).astype("<i8").tobytes()
            first = formats.mapping(attrs)
            out.write(first)
            _copied(out, [s["path"] + ".attrs" for s in segments])
            out.write(index["ts"].astype("<i8").tobytes())
            body = len(first) + int(ends[-1]) + 8 * len(index) + 8
            out.write(struct.pack("<QQ", len(index), body + 8 + len(formats.TRAILER)) + formats.TRAILER)
        store.move(temporary, own)


def _copied(out, paths: list[str]) -> None:
    for path in paths:
        read = ChunkReader(path)
        for at in range(0, read.size, ranges.BLOCK):
            out.write(read(at, ranges.BLOCK))


class _Segment:
    def __init__(self, writer: MovieWriter, movie_id: str, h: int, w: int):
        import uuid

        self.name, self.codec, self.shape, self.movie = uuid.uuid4().hex, writer.codec, (h, w), movie_id
        self.path, self.first, self.last = f"{writer.temporary}/{self.name}", None, None
        store, own = store_of(self.path)
        store.create_dir(own.rpartition("/")[0], recursive=True)
        self.frames, self.index, self.attrs = (store.open_output_stream(f"{own}.{kind}") for kind in ("frames", "index", "attrs"))
        if self.codec == "zstd":
            import zstandard

            self.compress = zstandard.ZstdCompressor(writer.level).compress

    def add(self, r) -> None:
        if (r.h, r.w) != self.shape:
            raise ValueError("images of a movie are of one size")
        if self.last is not None and r.pos <= self.last:
            raise ValueError("frames of a movie come in the order of their positions")
        self.first, self.last = r.pos if self.first is None else self.first, r.pos
        if len(raw := bytes(r.px)) != 2 * r.h * r.w:
            raise ValueError("an image has 2 bytes a pixel")
        if self.codec == "zstd":
            z = self.compress(raw)
            raw = struct.pack("<qI", r.ts_ns, len(z)) + z
        attrs = formats.mapping({k: bytes(v) for k, v in (r.attrs or {}).items()})
        self.frames.write(raw)
        self.attrs.write(attrs)
        self.index.write(np.array([(r.ts_ns, len(raw), len(attrs))], ranges.INDEX).tobytes())

    def close(self) -> dict:
        for f in (self.frames, self.index, self.attrs):
            f.close()
        return {"movie": self.movie, "name": self.name, "path": self.path, "first": self.first, "last": self.last, "h": self.shape[0], "w": self.shape[1]}

    def discard(self) -> None:
        store, own = store_of(self.path)
        for f, kind in ((self.frames, "frames"), (self.index, "index"), (self.attrs, "attrs")):
            f.close()
            store.delete_file(f"{own}.{kind}")


def to_files(frames: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Writes each movie of frames as a file of the folder. Frames are dealt by ranges of movie and position, so a long movie is the
    work of many tasks; then the segments of each movie are joined, movies in parallel."""
    import uuid

    spark, job = frames.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(MovieSource)
    own = frames.select("movie_id", "pos", "ts_ns", "h", "w", "px", "attrs").repartitionByRange("movie_id", "pos").sortWithinPartitions("movie_id", "pos")
    given = {str(k): str(v) for k, v in options.items()}
    own.write.format("movie").mode(mode).options(**given, join="later", job=job).save(path)
    writer = MovieWriter(given | {"path": path, "job": job}, mode == "overwrite")
    try:

        def joined(batches):
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    writer.join(json.loads(line))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        movies = spark.read.text(f"{writer.temporary}/list")
        movies.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 10_000)), F.xxhash64("value")).mapInArrow(joined, "n long").agg(F.sum("n")).collect()
    finally:
        writer.abort([])


def from_files(spark, path: str, columns: list[str] | None = None, opener: Callable | None = None, **options) -> DataFrame:
    """Frames of the movies at path; options as of the source. columns: only these, in order, e.g. without px. opener: called with
    a path, gives a callable (at, n) -> bytes with a `size`, for stores of one's own. Registered loaders are asked before the
    formats that are known here; these read files whole."""
    from emberframe.sources import loaders

    spark.dataSource.register(MovieSource)
    spark.conf.set(PUSHDOWN, "true")
    return _with(spark.read.format("movie"), columns, opener, loaders.registered()).options(pushdown="true", **options).load(path)


def follow(spark, path: str, columns: list[str] | None = None, opener: Callable | None = None, **options) -> DataFrame:
    """A stream of the frames that movies at path get, see MovieStream."""
    spark.dataSource.register(MovieSource)
    return _with(spark.readStream.format("movie"), columns, opener, []).options(**options).load(path)


def _with(reader, columns, opener, loaders):
    kinds = dict(x.split(" ", 1) for x in FRAMES.split(", "))
    if columns:
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    given = ({"opener": _pickled(opener)} if opener else {}) | ({"loaders": _pickled(loaders)} if loaders else {})
    return reader.options(**given)


def index_movies(spark, path: str, folder: str) -> int:
    """Writes an index for each movie of unequal frames that has none, into a folder to be given as the option `index`; returns how
    many. One pass over the heads of the frames; files are dealt to tasks."""
    paths = spark.createDataFrame(pa.table({"path": pa.array(files_of(path), pa.string())}))

    def run(batches):
        for batch in batches:
            n = 0
            for p in batch.column(0).to_pylist():
                read = ChunkReader(p)
                own = ranges.MovieFile(read, read.size)
                if own.movie and own.movie.n and not own.movie.stride and len(own.attributes().get(ranges.POSITIONS, b"")) != 8 * own.movie.n:
                    store, to = store_of(f"{folder}/{_index_name(p)}")
                    store.create_dir(to.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(to + ".tmp") as f:
                        f.write(own.positions().astype("<i8").tobytes())
                    store.move(to + ".tmp", to)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return paths.repartition(max(1, paths.count() // 8)).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
