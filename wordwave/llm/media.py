"""Media columns in ISO base media files (ISO/IEC 14496-12).

A payload is stored as 8-bit unsigned PCM samples in a file of nested boxes;
reading walks the boxes and decodes the sample tables, and never the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, session_for

FRAME = 64  # bytes of a sample table entry
FRAMES_PER_CHUNK = 64
KEYFRAME_EVERY = 16
RATE = 8000  # 8-bit samples a second
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes) -> bytes:
    """Appends bytes 0 up to a positive multiple of FRAME."""
    return payload + b"\0" * (FRAME - len(payload) % FRAME if len(payload) % FRAME or not payload else 0)


def write_media(payload: bytes) -> bytes:
    """An ISO media file whose frames hold ``payload`` (a positive multiple of FRAME bytes)."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    to_chunk = [(1, FRAMES_PER_CHUNK if chunks > 1 else last, 1)] + ([(chunks, last, 1)] if chunks > 1 and last != FRAMES_PER_CHUNK else [])
    keys = range(1, frames + 1, KEYFRAME_EVERY)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    samples = len(payload)

    def moov(base: int) -> bytes:
        step = FRAMES_PER_CHUNK * FRAME
        entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        wide = base + samples > 0xFFFFFFFF
        offsets = _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *range(base, base + chunks * step, step)))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(f">I{3 * len(to_chunk)}I", len(to_chunk), *(x for row in to_chunk for x in row))),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            offsets,
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, samples & 0xFFFFFFFF, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, samples & 0xFFFFFFFF, 0, 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, samples & 0xFFFFFFFF, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    base = len(head) + len(moov(0)) + (8 if samples + 8 <= 0xFFFFFFFF else 16)
    size = struct.pack(">I4s", samples + 8, b"mdat") if samples + 8 <= 0xFFFFFFFF else struct.pack(">I4sQ", 1, b"mdat", samples + 16)
    return head + moov(base) + size + payload


def walk(data: memoryview, at: int, end: int, path: str = ""):
    """(path, begin of the body, end) of every box, containers before their children."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit")
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, body, at + size
        if kind in _CONTAINERS:
            yield from walk(data, body, at + size, here)
        at += size


def read_media(media: bytes) -> dict:
    """Codec, timing and the byte ranges of frames and keyframes of the first track; the payload is not touched.

    Fragmented files (movie fragments) are not read: their frames stand outside of the sample tables.
    """
    data = memoryview(media)
    tables: dict[str, tuple[int, int]] = {}
    for path, begin, end in walk(data, 0, len(data)):
        tables.setdefault(path, (begin, end))
    table = "/moov/trak/mdia/minf/stbl/"
    read = lambda name, form, skip=4: struct.unpack_from(form, data, tables[name][0] + skip)
    rate, duration = read("/moov/trak/mdia/mdhd", ">II", 12)
    codec = bytes(data[tables[table + "stsd"][0] + 12 :][:4]).decode("latin-1")
    size, frames = read(table + "stsz", ">II")
    sizes = [size] * frames if size else list(read(table + "stsz", f">{frames}I", 12))
    (n,) = read(table + "stsc", ">I")
    to_chunk = [read(table + "stsc", ">III", 8 + 12 * i) for i in range(n)]
    wide = table + "co64" in tables
    name = table + ("co64" if wide else "stco")
    (chunks,) = read(name, ">I")
    offsets = read(name, f">{chunks}{'Q' if wide else 'I'}", 8)
    begins, k, row = [], 0, 0
    for c, at in enumerate(offsets, 1):
        while row + 1 < n and to_chunk[row + 1][0] <= c:
            row += 1
        for _ in range(to_chunk[row][1]):
            begins.append(at)
            at += sizes[k]
            k += 1
    if k != frames:
        raise ValueError("chunks and sizes disagree")
    (m,) = read(table + "stss", ">I") if table + "stss" in tables else (frames,)
    keys = read(table + "stss", f">{m}I", 8) if table + "stss" in tables else range(1, frames + 1)
    return {
        "codec": codec.strip(),
        "rate": rate,
        "duration": duration,
        "frames": frames,
        "ranges": [(b, b + s) for b, s in zip(begins, sizes, strict=True)],
        "keyframes": [(begins[i - 1], begins[i - 1] + sizes[i - 1]) for i in keys],
    }


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


MEDIA_SCHEMA = "media binary, n_bytes long"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_s double, n_frames long, n_keyframes long, keyframes array<struct<begin:long,end:long>>, feature string"


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, as an ISO media file.

    Null and empty texts store one frame of zero bytes (n_bytes 0); repeated
    rows and null ids are kept; other columns are ignored; an empty table gives
    an empty result.  One pass without a shuffle.
    """
    session_for(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"))

    def over(batch):
        raw = batch.column(1).to_pylist()
        yield {"doc_id": batch.column(0), "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "media": pa.array([write_media(pad(x)) for x in raw], pa.binary())}

    return arrow_map(rows, over, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Features of the media column of :func:`with_media`, all read back from the stored file."""

    def over(batch):
        rows = []
        for item in batch.column(2).to_pylist():
            found = read_media(item)
            payload = b"".join(item[a:b] for a, b in merged(found["ranges"]))
            keys = found["keyframes"]
            rows.append(
                {
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-FRAME:]),
                    "media_bytes": len(item),
                    "media_sha256": hashlib.sha256(item).hexdigest(),
                    "codec": found["codec"],
                    "duration_s": found["duration"] / found["rate"],
                    "n_frames": found["frames"],
                    "n_keyframes": len(keys),
                    "keyframes": [{"begin": a, "end": b} for a, b in keys],
                    "feature": f"{found['codec']}:{found['rate']}:{found['duration']}:{found['frames']}:{len(keys)}:{keys[0][0]}-{keys[-1][1]}",
                }
            )
        schema = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_frames", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("feature", pa.string())])
        columns = pa.RecordBatch.from_pylist(rows, schema)
        yield {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | {n: columns.column(i) for i, n in enumerate(columns.schema.names)}

    return arrow_map(media, over, f"doc_id long, n_bytes long, {FEATURES}")
