"""Media columns: ISO media containers.

``to_media`` stores a payload losslessly as 8-bit mono PCM in an ISO base media file: file type box, movie box with one track and its
sample tables, media data. ``describe`` walks the nested boxes of any such file, decodes the sample tables and gives, for each track,
codec, duration and the byte ranges of all keyframes without touching the payload; ``read_samples`` follows the chunk and size tables to
the stored bytes.

Defined cases: null text is empty; an empty text is one unit of padding; bytes that are no container, whose boxes are cut short, or whose
tables claim what the file can't hold raise a ValueError before memory is taken, and give null in ``describe_column``; a track without a
list of keyframes has each sample as one; a file without a track has an empty list; equal texts give equal files (no clock is stored); repeated
rows get a row each; texts are stored whole whatever their length (64-bit sizes and offsets where needed).
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a stored unit (one sample of the container: 576 PCM samples of 8 bits).
UNIT = 576
RATE = 8000
#: Units in a chunk; the first unit of each chunk is marked as a keyframe.
CHUNK_UNITS = 64

# Boxes that hold boxes.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta"}


def padded(text: str | None) -> bytes:
    """The text's bytes, with bytes 255 up to a positive multiple of UNIT."""
    b = (text or "").encode("utf-8", "replace")
    return b + b"\xff" * ((-len(b)) % UNIT if b else UNIT)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def to_media(payload: bytes) -> bytes:
    """An ISO media file with the payload, whose length is a positive multiple of UNIT, as 8-bit samples."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be whole units")
    units = len(payload) // UNIT
    frames = units * UNIT
    chunks = -(-units // CHUNK_UNITS)
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    wide = 1 if frames >= 1 << 32 else 0
    time = ">QQIQ" if wide else ">IIII"
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, CHUNK_UNITS)] if units % CHUNK_UNITS == 0 else [(1, CHUNK_UNITS), (chunks, units % CHUNK_UNITS)] if chunks > 1 else [(1, units)]

    def movie(start: int) -> bytes:
        offsets = start + np.arange(chunks, dtype=np.int64) * CHUNK_UNITS * UNIT
        far = int(offsets[-1]) >= 1 << 32
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", first, n, 1) for first, n in runs]),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * CHUNK_UNITS + 1).astype(">u4").tobytes()),
            _full(b"co64" if far else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if far else ">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(time, 0, 0, RATE, frames), struct.pack(">HH", 0x55C4, 0), version=wide),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, frames), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _UNITY, bytes(8), version=wide, flags=3)
        head = _full(b"mvhd", struct.pack(time, 0, 0, RATE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2), version=wide)
        return _box(b"moov", head, _box(b"trak", track, media))

    data_head = 8 if len(payload) + 8 < 1 << 32 else 16
    start = len(kind) + len(movie(0)) + data_head
    start = len(kind) + len(movie(start)) + data_head
    return kind + movie(start) + _box(b"mdat", payload)


def walk(media: bytes) -> Iterator[tuple[tuple, int, int]]:
    """(path, first byte of the body, byte after it) of every box, in file order, outer boxes first. Boxes may be nested to any depth."""
    open_ = [((), 0, len(media))]  # what is left of each box that is open
    while open_:
        path, start, stop = open_.pop()
        if start == stop:
            continue
        if stop - start < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", media, start)
        head = 8
        if size == 1:
            if stop - start < 16:
                raise ValueError("a box is cut short")
            size, head = struct.unpack_from(">Q", media, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise ValueError("a box is cut short")
        open_.append((path, start + size, stop))
        here = (*path, kind) if len(path) < 8 else path  # nothing of use lies deeper, and a path of any depth would cost its square
        yield here, start + head, start + size
        if kind in _NESTED:
            open_.append((here, start + head, start + size))


def _table(media: bytes, at: int, stop: int, dtype: np.dtype | str, skip: int = 0) -> np.ndarray:
    """The entries of a counted table; the count must fit in the box."""
    n = struct.unpack_from(">I", media, at + 4 + skip)[0]
    if at + 8 + skip + n * np.dtype(dtype).itemsize > stop:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(media, dtype, n, at + 8 + skip)


_TIMES = np.dtype([("n", ">u4"), ("delta", ">u4")])
_RUNS = np.dtype([("first", ">u4"), ("n", ">u4"), ("entry", ">u4")])


def _samples(t: dict, size: int) -> None:
    """Byte offsets and sizes of a track's samples from its tables, whose counts must agree with each other and with the file's size."""
    first = np.append(t["runs"]["first"].astype(np.int64), len(t["chunks"]) + 1)
    if len(first) > 1 and (first[0] != 1 or (np.diff(first) < 0).any()):
        raise ValueError("runs of chunks are out of order")
    if int((t["runs"]["n"].astype(np.int64) * np.diff(first)).sum()) != t["n_samples"]:
        raise ValueError("chunks and samples disagree")
    if isinstance(t["sizes"], int):
        if t["n_samples"] * max(1, t["sizes"]) > size:
            raise ValueError("more samples than bytes")
        t["sizes"] = np.full(t["n_samples"], t["sizes"], np.int64)
    elif t["n_samples"] > size:
        raise ValueError("more samples than bytes")
    per_chunk = np.repeat(t["runs"]["n"].astype(np.int64), np.diff(first))
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
    before = np.cumsum(t["sizes"]) - t["sizes"]
    head = np.minimum(np.cumsum(per_chunk) - per_chunk, max(0, len(before) - 1))
    t["offsets"] = t["chunks"][chunk] + before - (before[head][chunk] if len(before) else 0)
    keys = t.setdefault("keys", np.arange(t["n_samples"]))
    if len(keys) and not (0 <= keys.min() and keys.max() < t["n_samples"]):
        raise ValueError("a keyframe is no sample")
    if len(t["sizes"]) and (t["offsets"].min() < 0 or t["offsets"].max() > size or int((t["offsets"] + t["sizes"]).max()) > size):
        raise ValueError("a sample lies outside the file")


def tracks(media: bytes) -> list[dict]:
    """Codec, times and sample tables of each track, from the boxes alone."""
    found: list[dict] = []
    for path, a, z in walk(media):
        kind = path[-1]
        if path == (b"moov", b"trak"):
            found.append({})
        if not found or path[:2] != (b"moov", b"trak") or z - a < 8:
            continue
        t = found[-1]
        if kind == b"mdhd":
            t["scale"], t["duration"] = struct.unpack_from(">IQ" if media[a] else ">II", media, a + (20 if media[a] else 12))
        elif kind == b"hdlr":
            t["handler"] = media[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = media[a + 12 : a + 16].decode("latin-1")
        elif kind == b"stts":
            t["times"] = _table(media, a, z, _TIMES)
        elif kind == b"stsc":
            t["runs"] = _table(media, a, z, _RUNS)
        elif kind == b"stsz":
            same, t["n_samples"] = struct.unpack_from(">II", media, a + 4)
            t["sizes"] = same if same else _table(media, a, z, ">u4", 4).astype(np.int64)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(media, a, z, ">u8" if kind == b"co64" else ">u4").astype(np.int64)
        elif kind == b"stss":
            t["keys"] = _table(media, a, z, ">u4").astype(np.int64) - 1
    for t in found:
        _samples(t, len(media))
    return found


def describe(media: bytes) -> list[dict]:
    """Of each track: codec, handler, timescale, duration, n_samples, all keyframes as [offset, length] pairs, and the length of the longest sample."""
    out = []
    for t in tracks(media):
        ranges = np.stack([t["offsets"][t["keys"]], t["sizes"][t["keys"]]], 1)
        duration = int((t["times"]["n"].astype(np.int64) * t["times"]["delta"]).sum())
        out.append({"codec": t["codec"].strip(), "handler": t["handler"], "timescale": t["scale"], "duration": duration, "n_samples": len(t["sizes"]), "keyframes": ranges.tolist(), "max_sample": int(t["sizes"].max(initial=0))})
    return out


def read_samples(media: bytes, track: int = 0) -> bytes:
    """The stored bytes of one track, in order."""
    t = tracks(media)[track]
    return b"".join(media[o : o + n] for o, n in zip(t["offsets"].tolist(), t["sizes"].tolist()))


def media_column(text: Column) -> Column:
    """The container of each text, as binary."""

    @F.pandas_udf("binary")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: to_media(padded(t)), na_action=None)

    return stored(text)


_TRACK = "struct<codec:string,handler:string,timescale:bigint,duration:bigint,n_samples:bigint,max_sample:bigint,keyframes:array<struct<offset:bigint,length:bigint>>>"


def describe_column(media: Column) -> Column:
    """An array of the tracks of each container; null where the bytes are null or can't be read."""

    @F.pandas_udf(f"array<{_TRACK}>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            rows = []
            for m in b:
                try:
                    rows.append([d | {"keyframes": [{"offset": o, "length": n} for o, n in d["keyframes"]]} for d in describe(bytes(m))])
                except (ValueError, TypeError, KeyError, IndexError, OverflowError, struct.error):
                    rows.append(None)
            yield pd.Series(rows, dtype=object)

    return described(media)


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for docs(doc_id, text), from the stored bytes read back.

    feature is the JSON of the one track's description, all keyframe ranges included.
    """

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m in b:
                back = read_samples(m)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), json.dumps(describe(m)[0], sort_keys=True)))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", n.alias("n_bytes"), digests(media_column(F.col("text"))).alias("d")).select("doc_id", "n_bytes", "d.*")
