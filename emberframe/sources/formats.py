"""Movie files as bytes: sniffing, decoding, encoding. No Spark here."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the formats.
PCR_SIZE, BIN_SIZE, ENCAPSULATED_AT = 1024, 128, 133
TRAILER = b"H264ATTRIBUTES"
#: Width, height and frequency of the laboratory's movies; sides of a PCR movie, plain and encapsulated, are below MOST_PIXELS.
LAB, MOST_PIXELS = (640, 512, 50), (2000, 1000)
#: What the pixels of an HCC movie are, and their unit, by calibration mode.
HCC_DATA = {0: ("Raw0", "DL"), 1: ("NUC", "DL"), 2: ("RT", "Radiometric Temperature (C)"), 3: ("IBR", "W/(m2 sr)"), 4: ("IBI", "W/(m2 sr)"), 5: ("Raw", "DL")}
COMPRESS_FROM = 1000
#: Offset and type of the header fields of an HCC frame.
HCC_FIELDS = {
    "ImageHeaderLength": (4, "<u2"), "FrameID": (8, "<u4"), "DataOffset": (12, "<f4"), "DataExp": (16, "i1"), "ExposureTime": (24, "<u4"), "CalibrationMode": (28, "u1"),
    "BPRApplied": (29, "u1"), "FrameBufferMode": (30, "u1"), "CalibrationBlockIndex": (31, "u1"), "Width": (32, "<u2"), "Height": (34, "<u2"), "OffsetX": (36, "<u2"), "OffsetY": (38, "<u2"),
    "ReverseX": (40, "u1"), "ReverseY": (41, "u1"), "TestImageSelector": (42, "u1"), "SensorWellDepth": (43, "u1"), "AcquisitionFrameRate": (44, "<u4"), "TriggerDelay": (48, "<f4"),
    "TriggerMode": (52, "u1"), "TriggerSource": (53, "u1"), "IntegrationMode": (54, "u1"), "AveragingNumber": (56, "u1"), "ExposureAuto": (59, "u1"), "AECResponseTime": (60, "<f4"),
    "AECImageFraction": (64, "<f4"), "AECTargetWellFilling": (68, "<f4"), "FWMode": (75, "u1"), "FWSpeedSetpoint": (76, "<u2"), "FWSpeed": (78, "<u2"), "POSIXTime": (100, "<u4"),
    "SubSecondTime": (104, "<u4"), "TimeSource": (108, "u1"), "GPSModeIndicator": (111, "u1"), "GPSLongitude": (112, "<i4"), "GPSLatitude": (116, "<i4"), "GPSAltitude": (120, "<i4"),
    "FWEncoderAtExposureStart": (124, "<u2"), "FWEncoderAtExposureEnd": (126, "<u2"), "FWPosition": (128, "u1"), "ICUPosition": (129, "u1"), "NDFilterPosition": (130, "u1"),
    "EHDRIExposureIndex": (131, "u1"), "FrameFlag": (132, "u1"), "PostProcessed": (133, "u1"), "SensorTemperatureRaw": (134, "<u2"), "AlarmVector": (136, "<u4"),
    "ExternalBlackBodyTemperature": (156, "<f4"), "TemperatureSensor": (160, "<i2"), "TemperatureInternalLens": (164, "<i2"), "TemperatureExternalLens": (166, "<i2"),
    "TemperatureInternalCalibrationUnit": (168, "<i2"), "TemperatureExternalThermistor": (180, "<i2"), "TemperatureFilterWheel": (182, "<i2"), "TemperatureCompressor": (184, "<i2"), "TemperatureColdFinger": (186, "<i2"),
}
HCC_DTYPE = np.dtype({"names": list(HCC_FIELDS), "formats": [t for _, t in HCC_FIELDS.values()], "offsets": [o for o, _ in HCC_FIELDS.values()], "itemsize": 264})


@dataclass
class Movie:
    format: str
    width: int
    height: int
    n: int
    start: int  # of the first frame
    stride: int  # from frame to frame
    frequency: int = 0
    date: int = 0
    attrs: dict[str, bytes] = field(default_factory=dict)


def _pcr(head: bytes, at: int) -> tuple[int, ...]:
    return struct.unpack_from("<12i", head, at)


def _bin(head: bytes) -> tuple[int, int, int, tuple[int, ...]]:
    return head[0], head[1], head[2], struct.unpack_from("<11q", head, BIN_SIZE)


def sniff(head: bytes, size: int) -> Movie | None:
    """The movie that a file of `size` bytes with this head is, or None. Codecs are named, not decoded (n = 0)."""
    if head[4:8] == b"ftyp":
        return Movie("H264", 0, 0, 0, 0, 0)
    if len(head) >= PCR_SIZE:
        for name, at in (("PCR", 0), ("PCR_ENCAPSULATED", ENCAPSULATED_AT)):
            if len(head) >= at + 48:
                _, count, x, y, _, bits, _, frequency, _, transfer, *_ = _pcr(head, at)
                lab = not at and (bits, x, y, frequency) == (16, *LAB)  # whatever their transfer size says
                transfer = 2 * x * y if lab else transfer
                if bits == 16 and 0 < x < MOST_PIXELS[at > 0] and 0 < y < MOST_PIXELS[at > 0] and abs(transfer - x * y * 2) < 2000:
                    start = PCR_SIZE + at
                    n = count if at or lab else (size - start) // max(1, transfer)
                    return Movie(name, x, y, min(n, (size - start) // max(1, transfer)), start, transfer, frequency)
    if len(head) >= 2 * BIN_SIZE:
        version, triggers, compression, (date, rate, samples, *_, x, y) = _bin(head)
        if version < 10 and compression == 0 and triggers == 1 and 0 < x < 1000 and 0 < y < 1000 and 0 < rate < 1000:
            return Movie("WEST", x, y, min(samples, (size - 2 * BIN_SIZE) // (2 * x * y)), 2 * BIN_SIZE, 2 * x * y, rate, date)
        if version == 1 and 1 <= compression <= 3 and triggers == 1 and 0 < x < 3000 and 0 < y < 3000 and 0 < rate < 1000:
            return Movie("ZSTD", x, y, samples, 2 * BIN_SIZE, 0, rate, date)
    if b"H.265" in head[:1000] or b"matroska" in head[:1000] or head[:2] == b"G@":
        return Movie("H264", 0, 0, 0, 0, 0)
    if head[:2] == b"TC" and len(head) >= HCC_DTYPE.itemsize:
        h = np.frombuffer(head, HCC_DTYPE, 1)[0]
        length, x, y = int(h["ImageHeaderLength"]), int(h["Width"]), int(h["Height"])
        if length <= 6000 and x and y:
            n = size // (length + 2 * x * y)
            kind, unit = HCC_DATA.get(int(h["CalibrationMode"]), ("", ""))
            own = {"Type": "HCC", "Size": str(n), "DataType": kind, "DataUnit": unit}
            return Movie("HCC", x, y, n, 0, length + 2 * x * y, int(h["AcquisitionFrameRate"]), attrs={k: v.encode() for k, v in own.items()})
    return None


def in_nanoseconds(times: list[int]) -> list[int]:
    """Milliseconds or nanoseconds to nanoseconds, without a trigger's 32 s."""
    if not times:
        return times
    if 28_000 < times[0] < 32_000 or all(abs(t - times[0]) < 1e9 and abs(t) < 1e9 for t in times) and len(times) > 1 and times[-1] - times[0] < 1e9 and times[0] < 1e9:
        times = [t * 1_000_000 for t in times]
    return [t - 32_000_000_000 for t in times] if 28e9 < times[0] < 32e9 else times


def frames(data: bytes) -> Iterator[tuple[int, int, np.ndarray, dict[str, bytes]]]:
    """(pos, ts_ns, image, attributes) of a movie; ValueError for what isn't one."""
    m = sniff(data[:4096], len(data))
    if m is None or m.format == "H264":
        raise ValueError("not a movie that can be decoded here")
    return frames_between(lambda at, n: data[at : at + n], m, 0, m.n - 1)


def frames_between(read: Callable[[int, int], bytes], m: Movie, first: int, last: int) -> Iterator[tuple[int, int, np.ndarray, dict[str, bytes]]]:
    """Frames first to last of a movie of which read(offset, size) gives any piece. A piece that ends early is an EOFError."""
    size = 2 * m.width * m.height

    def piece(at: int, n: int) -> bytes:
        out = read(at, n)
        if len(out) < n:
            raise EOFError(f"the movie ends within a frame, at {at + len(out)}")
        return out

    def image(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<u2", m.width * m.height).reshape(m.height, m.width)

    if m.format == "ZSTD":
        import zstandard

        at = m.start
        for i in range(last + 1):
            ts, n = struct.unpack("<qI", piece(at, 12))
            if i >= first:
                yield i, ts, image(zstandard.ZstdDecompressor().decompress(piece(at + 12, n), max_output_size=size)), {}
            at += 12 + n
        return
    if m.format == "HCC":
        step = 1e12 / m.frequency if m.frequency else 0.0
        for i in range(first, last + 1):
            raw = piece(m.start + i * m.stride, m.stride)
            h = np.frombuffer(raw, HCC_DTYPE, 1)[0]
            attrs = {k: str(h[k].item()).encode() for k in HCC_FIELDS} | {"Header": raw[: HCC_DTYPE.itemsize]}
            yield i, int(i * step), image(raw[int(h["ImageHeaderLength"]) :]), attrs
        return

    def stamp(i: int) -> int:
        return struct.unpack("<q", piece(m.start + (i + 1) * m.stride - 8, 8))[0]

    times: list[int] = []
    if m.format.startswith("PCR") and m.stride >= 8 and m.n:
        own, ends = [stamp(i) for i in range(first, last + 1)], [stamp(i) for i in sorted({0, min(1, m.n - 1), m.n - 1})]
        if all(a < b for x in (own, ends) for a, b in zip(x, x[1:], strict=False)) and ends[0] >= 0 and ends[-1] < 1 << 62:
            times = in_nanoseconds([*ends, *own])[len(ends) :]
    step = 1e9 / (m.frequency if m.frequency > 0 else 50)
    for i in range(first, last + 1):
        yield i, times[i - first] if times else int(i * step), image(piece(m.start + i * m.stride, size)), {}


def movie_of(images: list[np.ndarray], times: list[int], codec: str, frequency: int = 50, level: int = 3) -> bytes:
    """A movie's file without a trailer, by codec ("zstd" or "pcr")."""
    if codec == "zstd":
        return zstd_movie(images, times, frequency, level)
    h, w = images[0].shape
    return pcr_header(w, h, len(images), frequency) + b"".join(np.ascontiguousarray(i, "<u2").tobytes() for i in images)


def pcr_header(w: int, h: int, n: int, frequency: int, stride: int | None = None) -> bytes:
    return struct.pack("<12i", 0, n, w, h, 0, 16, 0, frequency, 0, stride or 2 * w * h, w, h).ljust(PCR_SIZE, b"\0")


def correct_pcr(data: bytes, w: int, h: int, frequency: int) -> bytes:
    """With the header's sizes and frequency put right."""
    out = bytearray(data)
    for word, v in ((2, w), (3, h), (5, 16), (7, frequency), (8, 1), (9, 2 * w * h), (10, w), (11, h)):
        struct.pack_into("<i", out, 4 * word, v)
    return bytes(out)


def zstd_header(w: int, h: int, n: int, rate: int = 50) -> bytes:
    return bytes([1, 1, 1]).ljust(BIN_SIZE, b"\0") + struct.pack("<11q", 0, rate, n, 0, 1, 1, 0, 3, 1, w, h).ljust(BIN_SIZE, b"\0")


def head_of(codec: str, h: int, w: int, n: int, frequency: int = 50) -> bytes:
    """What comes before the frames."""
    return zstd_header(w, h, n, frequency) if codec == "zstd" else pcr_header(w, h, n, frequency)


def zstd_movie(images: list[np.ndarray], times: list[int], rate: int = 50, level: int = 3) -> bytes:
    import zstandard

    h, w = images[0].shape
    out = [zstd_header(w, h, len(images), rate)]
    z = zstandard.ZstdCompressor(level)
    for img, t in zip(images, times, strict=True):
        raw = z.compress(np.ascontiguousarray(img, "<u2").tobytes())
        out += [struct.pack("<qI", t, len(raw)), raw]
    return b"".join(out)


def set_black_body(data: bytes, temperature: float) -> bytes:
    """An HCC movie with another external black-body temperature in every frame."""
    m = sniff(data[:4096], len(data))
    if m is None or m.format != "HCC":
        raise ValueError("not an HCC movie")
    out = bytearray(data)
    for i in range(m.n):
        struct.pack_into("<f", out, i * m.stride + HCC_FIELDS["ExternalBlackBodyTemperature"][0], temperature)
    return bytes(out)


# --- the trailer of attributes


def _text(x: bytes) -> bytes:
    if len(x) >= COMPRESS_FROM:
        import zstandard

        z = zstandard.ZstdCompressor().compress(x)
        if len(z) < len(x):
            return struct.pack("<QQ", (len(z) + 8) | 1 << 63, len(x)) + z
    return struct.pack("<Q", len(x)) + x


def mapping(m: dict[str, bytes]) -> bytes:
    return struct.pack("<Q", len(m)) + b"".join(_text(k.encode()) + _text(v) for k, v in sorted(m.items()))


def write_trailer(attrs: dict[str, bytes], per_frame: list[dict[str, bytes]], times: list[int]) -> bytes:
    body = mapping(attrs) + b"".join(map(mapping, per_frame)) + struct.pack(f"<{len(times)}q", *times) + struct.pack("<Q", len(times))
    return body + struct.pack("<Q", len(body) + 8 + len(TRAILER)) + TRAILER


def read_trailer(data: bytes) -> tuple[dict[str, bytes], list[dict[str, bytes]], list[int], int]:
    """(attributes, attributes of the frames, times, size of the trailer); all empty without one."""
    end = len(TRAILER)
    if data[-end:] != TRAILER or len(data) < end + 16:
        return {}, [], [], 0
    (size,) = struct.unpack_from("<Q", data, len(data) - end - 8)
    if not end + 16 <= size <= len(data):
        return {}, [], [], 0
    own, at = data[len(data) - size :], 0

    def text() -> bytes:
        nonlocal at
        (n,) = struct.unpack_from("<Q", own, at)
        packed, n = n >> 63, n & ((1 << 63) - 1)
        raw = own[at + 8 : at + 8 + n]
        at += 8 + n
        if packed:
            import zstandard

            return zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=struct.unpack_from("<Q", raw)[0])
        return raw

    def pairs() -> dict[str, bytes]:
        nonlocal at
        (n,) = struct.unpack_from("<Q", own, at)
        at += 8
        return {text().decode("utf-8", "replace"): text() for _ in range(n)}

    attrs = pairs()
    (n,) = struct.unpack_from("<Q", own, size - end - 16)
    per_frame = [pairs() for _ in range(n)]
    return attrs, per_frame, list(struct.unpack_from(f"<{n}q", own, at)), size


def with_trailer(data: bytes, attrs: dict[str, bytes], per_frame: list[dict[str, bytes]], times: list[int]) -> bytes:
    return data[: len(data) - read_trailer(data)[3]] + write_trailer(attrs, per_frame, times)
