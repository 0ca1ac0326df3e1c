"""Media columns: ISO base media containers, written around 8-bit samples and read back by their boxes alone."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import map_columns

#: Boxes that hold boxes and nothing else.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"moof", b"traf", b"mvex", b"udta"}
#: Files nest about eight boxes; deeper ones are malformed.
_DEEPEST = 64
_UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes, timescale: int = 8000, chunk: int = 4096) -> bytes:
    """A container with one sound track whose 8-bit samples are the payload's bytes, `chunk` samples to a chunk. It
    depends on the arguments alone: no times, no random ids."""
    n = len(payload)
    n_chunks = -(-n // chunk)
    wide = n + 4096 + 8 * n_chunks >= 1 << 32

    def movie(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, timescale << 16))
        runs = [(1, chunk, 1)] if n >= chunk else []
        if n % chunk:
            runs.append((n_chunks, n % chunk, 1))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", 1, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", n_chunks), *(struct.pack(">Q" if wide else ">I", first + k * chunk) for k in range(n_chunks))),
        )
        data = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, timescale, n, 0x55C4, 0), version=1),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), data, table),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">QQII", 0, 0, 1, 0), struct.pack(">Q8xhhHH", n, 0, 0, 0x100, 0), _UNITY, bytes(8), version=1, flags=7), media)
        head = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, timescale, n), struct.pack(">IH10x", 0x10000, 0x100), _UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", head, track)

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    first = len(kind) + len(movie(0)) + (16 if n + 8 >= 1 << 32 else 8)
    return kind + movie(first) + _box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of its content) of each box in order; ValueError where one does not fit."""
    while start < end:
        if end - start < 8:
            raise ValueError("cut box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("cut box header")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, start + head, start + size
        start += size


@dataclass
class Track:
    """What the sample tables of one track say. keyframes: (offset, length) byte ranges of sync samples, adjacent ones
    joined; samples: the same of all samples in decoding order."""

    handler: str
    codec: str
    timescale: int
    duration: int
    n_samples: int
    n_keyframes: int
    keyframes: list[tuple[int, int]]
    samples: list[tuple[int, int]]


def _joined(ranges: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for offset, length in ranges:
        if out and sum(out[-1]) == offset:
            out[-1] = (out[-1][0], out[-1][1] + length)
        elif length:
            out.append((offset, length))
    return out


def read_container(container: bytes) -> list[Track]:
    """The tracks of a container: nested boxes are walked and sample tables decoded, payloads are not touched. ValueError
    for fragmented files (samples that moof boxes tell of are not decoded) and for boxes nested without end."""
    data = memoryview(container)
    tracks: list[dict] = []

    def walk(start: int, end: int, depth: int = 0) -> None:
        if depth > _DEEPEST:
            raise ValueError(f"boxes nested deeper than {_DEEPEST}")
        for kind, a, b in boxes(data, start, end):
            if kind == b"moof":
                raise ValueError("fragmented container")
            if kind == b"trak":
                tracks.append({})
            if kind in _NESTED:
                walk(a, b, depth + 1)
            elif tracks:
                tracks[-1][kind] = (a, b)

    walk(0, len(data))
    return [_track(data, t) for t in tracks]


def _numbers(data: memoryview, at: tuple[int, int], skip: int, width: int, form: str = "I") -> list[tuple]:
    """Rows of a counted table that starts `skip` bytes into a box; width numbers to a row."""
    (n,) = struct.unpack_from(">I", data, at[0] + skip)
    size = width * struct.calcsize(">" + form)
    if at[0] + skip + 4 + n * size > at[1]:
        raise ValueError("cut sample table")
    return list(struct.iter_unpack(f">{width}{form}", data[at[0] + skip + 4 : at[0] + skip + 4 + n * size]))


def _track(data: memoryview, box: dict) -> Track:
    a, _ = box[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    handler = bytes(data[box[b"hdlr"][0] + 8 : box[b"hdlr"][0] + 12]).decode("latin-1")
    codec = next((k.decode("latin-1") for k, _, _ in boxes(data, box[b"stsd"][0] + 8, box[b"stsd"][1])), "")
    fixed, n = struct.unpack_from(">II", data, box[b"stsz"][0] + 4)
    sizes = None if fixed else [x for (x,) in _numbers(data, box[b"stsz"], 8, 1)]
    chunks = [x for (x,) in (_numbers(data, box[b"co64"], 4, 1, "Q") if b"co64" in box else _numbers(data, box[b"stco"], 4, 1))]
    runs = _numbers(data, box[b"stsc"], 4, 3)
    sync = {x for (x,) in _numbers(data, box[b"stss"], 4, 1)} if b"stss" in box else None

    def extents() -> Iterator[tuple[int, int, int]]:
        """(first sample, samples, offset) of each chunk."""
        sample, run = 1, -1
        for k, offset in enumerate(chunks, 1):
            while run + 1 < len(runs) and runs[run + 1][0] <= k:
                run += 1
            count = min(runs[run][1], n - sample + 1)
            yield sample, count, offset
            sample += count

    def spans(wanted: set[int] | None) -> Iterator[tuple[int, int]]:
        for first, count, offset in extents():
            if wanted is None and sizes is None:
                yield offset, count * fixed
                continue
            for s in range(first, first + count):
                size = sizes[s - 1] if sizes else fixed
                if wanted is None or s in wanted:
                    yield offset, size
                offset += size

    every = _joined(spans(None))
    if any(offset + length > len(data) for offset, length in every):
        raise ValueError("samples outside the container")
    return Track(handler, codec, timescale, duration, n, n if sync is None else len(sync), every if sync is None else _joined(spans(sync)), every)


def payload_of(container: bytes, track: Track) -> bytes:
    """The stored bytes of all samples."""
    return b"".join(container[offset : offset + length] for offset, length in track.samples)


def padded(text: str | None, unit: int = 64) -> bytes:
    """The text as UTF-8 with bytes 0 up to a positive multiple of the unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media (binary): each whole text, padded, in a container. Null is the empty text (one unit of zeros).
    Extra columns stay; a column named media is replaced."""

    def factory():
        def run(texts):
            return (pa.array([write_container(padded(t)) for t in texts.to_pylist()], pa.binary()),)

        return run

    return map_columns(docs, [text], "media binary", factory)


def describe(frame: DataFrame) -> DataFrame:
    """frame(media) with codec, timescale, duration, n_samples, n_keyframes, keyframes (array of byte ranges), payload_bytes,
    payload_sha256, tail_crc32 (unsigned, of the last 64 payload bytes) of the first track, tracks (array: handler and the
    same of each track in the file's order), media_bytes and media_sha256 of the stored form, and error. Null, empty,
    malformed or fragmented media give an error text and nulls for what is inside; nothing raises. Extra columns stay;
    columns named like a result are replaced."""
    inside = "codec string, timescale long, duration long, n_samples long, n_keyframes long, keyframes array<struct<offset: bigint, length: bigint>>, payload_bytes long, payload_sha256 string, tail_crc32 long"
    outputs = f"{inside}, tracks array<struct<handler string, {inside}>>, media_bytes long, media_sha256 string, error string"
    ranges = pa.list_(pa.struct([pa.field("offset", pa.int64()), pa.field("length", pa.int64())]))
    told = {"codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "n_samples": pa.int64(), "n_keyframes": pa.int64(), "keyframes": ranges, "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64()}
    types = (*told.values(), pa.list_(pa.struct([pa.field("handler", pa.string()), *(pa.field(k, t) for k, t in told.items())])), pa.int64(), pa.string(), pa.string())

    def track_of(data: bytes, track: Track) -> dict:
        inner = payload_of(data, track)
        ranged = [{"offset": o, "length": n} for o, n in track.keyframes]
        return dict(zip(("handler", *told), (track.handler, track.codec, track.timescale, track.duration, track.n_samples, track.n_keyframes, ranged, len(inner), hashlib.sha256(inner).hexdigest(), zlib.crc32(inner[-64:])), strict=True))

    def factory():
        def one(raw):
            data = bytes(raw or b"")
            stored = (len(data), hashlib.sha256(data).hexdigest())
            try:
                tracks = [track_of(data, t) for t in read_container(data)]
                first = tracks[0]
            except (ValueError, KeyError, IndexError, struct.error) as e:
                return (None,) * (len(told) + 1) + stored + (f"{type(e).__name__}: {e}",)
            return (*(first[k] for k in told), tracks) + stored + (None,)

        def run(media):
            rows = [one(x.as_py()) for x in media]
            return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]

        return run

    return map_columns(frame, ["media"], outputs, factory)
