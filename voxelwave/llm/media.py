"""Operator 3: media columns in the ISO base media format.

``pack`` stores payload bytes as samples of an intra-only 8-bit grey video track (24 x 24 pixels: 576 bytes a sample);
``describe`` walks the nested boxes of any such file, decodes the sample tables and gives codec, duration and the byte ranges
of the keyframes without touching the payload; ``sample_bytes`` reads stored samples back through those tables. Fragmented files
(``pack`` writes them too) have their samples in the track runs of movie fragments; those follow the ones of the tables.

Cases: a null text is an empty one; an empty payload is one sample of bytes 255. A file that is cut short, has boxes that
overrun their parents, fields that overrun their boxes or no media track gives a row with ``error`` set and nulls, never a failed
task. Of several video tracks the first counts, without one the first track. Repeated rows repeat; ids of any type, null ones
too, are kept. An empty table gives an empty table. Extra columns are ignored, whatever they are called. Rows are handled one at
a time, so memory is bounded by the largest file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from voxelwave.llm.rows import pick
from voxelwave.runtime import ship

SIDE = 24
SAMPLE = SIDE * SIDE
TIMESCALE = 25
#: Fixed values of the format: box types that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf")
#: Fixed values of the format: a sample's flag that it is no keyframe, and the fields of fragment headers and runs by flag.
NOT_SYNC = 0x10000
TFHD = ((0x1, "Q", "base"), (0x2, "I", "entry"), (0x8, "I", "duration"), (0x10, "I", "size"), (0x20, "I", "flags"))
TRUN = ((0x100, "I", "duration"), (0x200, "I", "size"), (0x400, "I", "flags"), (0x800, "i", "shift"))
BASE_IS_MOOF = 0x20000
#: Fixed value of the format: the identity transformation matrix.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    pass


# ---------------------------------------------------------------- writing


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pack(payload: bytes, gop: int = 12, fragmented: bool = False) -> bytes:
    """A file whose samples are the payload's blocks of 576 bytes; each ``gop``-th sample is marked as a keyframe.

    A fragmented file has a movie fragment for each ``gop`` samples.
    """
    n = len(payload) // SAMPLE
    if not n or len(payload) % SAMPLE:
        raise MediaError("payload must be a positive multiple of the sample size")
    whole = 0 if fragmented else n
    keys = range(1, whole + 1, gop)
    entry = _box(
        b"raw ",
        struct.pack(">6xH", 1),
        struct.pack(">16xHHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1),
        bytes(32),
        struct.pack(">Hh", 8, -1),
    )

    def moov(at: int) -> bytes:
        tables = [
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, whole, 1) if whole else bytes(4)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, whole, 1) if whole else bytes(4)),
            _full(b"stsz", struct.pack(">II", SAMPLE if whole else 0, whole)),
            _full(b"stco", struct.pack(">II", 1, at) if whole else bytes(4)) if at < 1 << 32 else _full(b"co64", struct.pack(">IQ", 1, at)),
        ]
        stbl = _box(b"stbl", *tables)
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, whole, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, whole, 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, whole, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        mvex = _box(b"mvex", _full(b"trex", struct.pack(">IIIII", 1, 1, 1, SAMPLE, NOT_SYNC))) if fragmented else b""
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia), mvex)

    def fragment(k: int, part: bytes) -> bytes:
        def moof(shift: int) -> bytes:
            run = _full(b"trun", struct.pack(">IiI", len(part) // SAMPLE, shift, 0), flags=0x5)
            return _box(b"moof", _full(b"mfhd", struct.pack(">I", k + 1)), _box(b"traf", _full(b"tfhd", struct.pack(">I", 1), flags=BASE_IS_MOOF), run))

        return moof(len(moof(0)) + 8) + _box(b"mdat", part)

    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso5" if fragmented else b"iso2")
    if fragmented:
        step = gop * SAMPLE
        return b"".join((head, moov(0), *(fragment(k, payload[a : a + step]) for k, a in enumerate(range(0, len(payload), step)))))
    at = len(head) + len(moov(0)) + 8
    data = struct.pack(">I4s", len(payload) + 8, b"mdat") if len(payload) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    return b"".join((head, moov(at + len(data) - 8), data, payload))


# ---------------------------------------------------------------- reading


def boxes(view: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Type, start, body start and end of the boxes in a range."""
    at = start
    while at < end:
        if end - at < 8:
            raise MediaError("cut box header")
        size, kind = struct.unpack_from(">I4s", view, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise MediaError("cut box header")
            (size,) = struct.unpack_from(">Q", view, body)
            body += 8
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if size < body - at or at + size > end:
            raise MediaError(f"box {kind!r} overruns its parent")
        yield kind, at, body, at + size
        at += size


@dataclass
class Track:
    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, tuple[int, int]] = field(default_factory=dict)
    #: Samples of fragments: byte ranges, and the places of keyframes among them.
    samples: list[tuple[int, int]] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)


def _read(view: memoryview, form: str, at: int, end: int) -> tuple:
    """Numbers that lie within their box."""
    if at + struct.calcsize(form) > end:
        raise MediaError("cut box")
    return struct.unpack_from(form, view, at)


def _optional(view: memoryview, fields: tuple, flags: int, at: int, end: int) -> tuple[dict[str, int], int]:
    """Fields that are there if their flag is set, and where they end."""
    out = {}
    for flag, code, name in fields:
        if flags & flag:
            (out[name],) = _read(view, f">{code}", at, end)
            at += struct.calcsize(f">{code}")
    return out, at


def _fragment(view: memoryview, moof: int, start: int, end: int, found: list[Track], defaults: dict[int, dict[str, int]]) -> None:
    """Samples of a movie fragment go to their tracks."""
    previous = moof
    for kind, _, a, b in boxes(view, start, end):
        if kind != b"traf":
            continue
        head, track, following = {}, None, previous
        for kind, _, c, d in boxes(view, a, b):
            if kind == b"tfhd":
                flags, number = _read(view, ">II", c, d)
                flags &= 0xFFFFFF
                own, _ = _optional(view, TFHD, flags, c + 8, d)
                track = next((t for t in found if t.number == number), None)
                head = defaults.get(number, {}) | own
                # without a base of its own a fragment's data start at the movie fragment, or follow those of the track before
                following = own.get("base", moof if flags & BASE_IS_MOOF else previous)
                head["base"] = following
            elif kind == b"trun" and track is not None:
                flags, count = _read(view, ">II", c, d)
                flags &= 0xFFFFFF
                at = c + 8
                if flags & 0x1:
                    (shift,) = _read(view, ">i", at, d)
                    following, at = head["base"] + shift, at + 4
                first = None
                if flags & 0x4:
                    (first,) = _read(view, ">I", at, d)
                    at += 4
                width = sum(4 for f, _, _ in TRUN if flags & f)
                if at + count * width > d or (not width and count * max(1, head.get("size", 0)) > len(view)):
                    raise MediaError("cut box")
                for k in range(count):
                    one, at = _optional(view, TRUN, flags, at, d)
                    one = head | one
                    if not one.get("flags", 0) & NOT_SYNC if k or first is None else not first & NOT_SYNC:
                        track.keys.append(len(track.samples))
                    track.samples.append((following, one.get("size", 0)))
                    track.duration += one.get("duration", 0)
                    following += one.get("size", 0)
        previous = following


def tracks(data: bytes) -> list[Track]:
    """All tracks with the places of their tables and the samples of their fragments. Payload boxes are skipped by their size."""
    view, found = memoryview(data), []
    defaults: dict[int, dict[str, int]] = {}
    fragments = []

    def walk(start: int, end: int, depth: int, inside: bool) -> None:
        if depth > 16:
            raise MediaError("boxes nest too deeply")
        for kind, at, a, b in boxes(view, start, end):
            if kind == b"trak":
                found.append(Track())
                walk(a, b, depth + 1, True)
            elif kind == b"moof":
                fragments.append((at, a, b))
            elif kind in CONTAINERS:
                walk(a, b, depth + 1, inside)
            elif kind == b"trex":
                number, entry, duration, size, flags = _read(view, ">IIIII", a + 4, b)
                defaults[number] = {"entry": entry, "duration": duration, "size": size, "flags": flags}
            elif inside and kind == b"tkhd":
                wide = _read(view, ">B", a, b)[0]
                (found[-1].number,) = _read(view, ">I", a + (20 if wide else 12), b)
            elif inside and kind == b"mdhd":
                wide = _read(view, ">B", a, b)[0]
                _, _, found[-1].timescale, found[-1].duration = _read(view, ">QQIQ" if wide else ">IIII", a + 4, b)
            elif inside and kind == b"hdlr":
                found[-1].handler = _read(view, ">4s", a + 8, b)[0].decode("latin-1")
            elif inside and kind == b"stsd":
                found[-1].codec = _read(view, ">4s", a + 12, b)[0].decode("latin-1")
            elif inside and kind in (b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss"):
                found[-1].tables[kind] = (a + 4, b)

    walk(0, len(data), 0, False)
    for track in found:
        if not track.duration and b"stts" in track.tables:
            a, end = track.tables[b"stts"]
            (count,) = _numbers(data, a, end, 1, "I")
            flat = _numbers(data, a + 4, end, 2 * count, "I")
            track.duration = sum(n * d for n, d in zip(flat[::2], flat[1::2]))
    for moof, a, b in fragments:
        _fragment(view, moof, a, b, found, defaults)
    return found


def _numbers(data: bytes, at: int, end: int, count: int, code: str) -> tuple[int, ...]:
    size = count * struct.calcsize(f">{code}")
    if at + size > end:
        raise MediaError("cut table")
    return struct.unpack_from(f">{count}{code}", data, at)


def _sizes(data: bytes, t: dict[bytes, tuple[int, int]]) -> tuple[int, ...]:
    """Sample sizes, from the plain or the compact table."""
    if b"stsz" in t:
        a, end = t[b"stsz"]
        fixed, n = _numbers(data, a, end, 2, "I")
        if fixed and n > len(data):
            raise MediaError("more samples than bytes")
        return (fixed,) * n if fixed else _numbers(data, a + 8, end, n, "I")
    a, end = t[b"stz2"]
    bits, n = _numbers(data, a, end, 2, "I")
    if bits == 4:
        pairs = _numbers(data, a + 8, end, (n + 1) // 2, "B")
        return tuple(v for p in pairs for v in (p >> 4, p & 15))[:n]
    if bits not in (8, 16):
        raise MediaError("unknown sample size field")
    return _numbers(data, a + 8, end, n, "B" if bits == 8 else "H")


def sample_ranges(data: bytes, track: Track) -> tuple[list[tuple[int, int]], list[int]]:
    """Byte ranges (start, size) of all samples, and the indices of the keyframes."""
    t = track.tables
    if b"stsc" not in t or not {b"stsz", b"stz2"} & set(t) or not {b"stco", b"co64"} & set(t):
        raise MediaError("sample tables are missing")
    sizes = _sizes(data, t)
    n = len(sizes)
    wide = b"co64" in t
    a, end = t[b"co64" if wide else b"stco"]
    (count,) = _numbers(data, a, end, 1, "I")
    chunks = _numbers(data, a + 4, end, count, "Q" if wide else "I")
    a, end = t[b"stsc"]
    (count,) = _numbers(data, a, end, 1, "I")
    flat = _numbers(data, a + 4, end, 3 * count, "I")
    runs = [*zip(flat[::3], flat[1::3]), (len(chunks) + 1, 0)]
    out: list[tuple[int, int]] = []
    for (first, per), (following, _) in zip(runs, runs[1:]):
        for at in chunks[max(0, first - 1) : following - 1]:
            for _ in range(per):
                if len(out) == n:
                    break
                out.append((at, sizes[len(out)]))
                at += out[-1][1]
    if len(out) != n or any(not 0 <= at <= at + size <= len(data) for at, size in out + track.samples):
        raise MediaError("samples lie outside the file")
    later = [n + k for k in track.keys]
    if b"stss" not in t:
        return out + track.samples, [*range(n), *later]
    a, end = t[b"stss"]
    (count,) = _numbers(data, a, end, 1, "I")
    keys = [k - 1 for k in _numbers(data, a + 4, end, count, "I")]
    if any(not 0 <= k < n for k in keys):
        raise MediaError("keyframe out of range")
    return out + track.samples, keys + later


def describe(data: bytes) -> dict:
    """codec, handler, duration_s, n_samples, keyframes: from headers and sample tables alone."""
    found = [t for t in tracks(data) if t.tables]
    if not found:
        raise MediaError("no media track")
    track = next((t for t in found if t.handler == "vide"), found[0])
    ranges, keys = sample_ranges(data, track)
    return {
        "codec": track.codec,
        "handler": track.handler,
        "duration_s": track.duration / track.timescale if track.timescale else 0.0,
        "n_samples": len(ranges),
        "keyframes": [ranges[k] for k in keys],
    }


def sample_bytes(data: bytes) -> bytes:
    found = [t for t in tracks(data) if t.tables]
    if not found:
        raise MediaError("no media track")
    view = memoryview(data)
    return b"".join(view[a : a + n] for a, n in sample_ranges(data, found[0])[0])


# ---------------------------------------------------------------- columns

MEDIA_SCHEMA = "codec string, handler string, duration_s double, n_samples long, keyframes array<struct<start:long,size:long>>, error string"


def media_columns(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id and what the container says of each media file; null or broken files have ``error``. Narrow: no shuffle."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column(1):
                row = dict.fromkeys(("codec", "handler", "duration_s", "n_samples", "keyframes", "error"))
                try:
                    if not raw.is_valid:
                        raise MediaError("null")
                    row |= describe(raw.as_buffer().to_pybytes())
                    row["keyframes"] = [{"start": a, "size": n} for a, n in row["keyframes"]]
                except MediaError as e:
                    row["error"] = str(e)
                out.append(row)
            kinds = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), ("error", pa.string())])
            cols = pa.array(out, kinds).flatten()
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *(f.name for f in kinds)])

    kind = df.schema[id_col].dataType.simpleString()
    return pick(df, id_col, media_col).toDF("id", "media").mapInArrow(run, f"id {kind}, {MEDIA_SCHEMA}")


def feature_string(info: dict) -> str:
    """What a media column's row comes to: codec, duration, samples, keyframes, first and last keyframe range, digest of all ranges."""
    keys = info["keyframes"]
    spans = ",".join(f"{a}+{n}" for a, n in keys)
    ends = f"{keys[0][0]}+{keys[0][1]};{keys[-1][0]}+{keys[-1][1]}" if keys else "-;-"
    return f"{info['codec'].strip()};{info['duration_s']:.2f}s;{info['n_samples']};{len(keys)};{ends};{hashlib.sha256(spans.encode()).hexdigest()[:16]}"


def store_and_read(df: DataFrame) -> DataFrame:
    """Each whole text packed, read back through its sample tables, and described."""
    ship(df.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                stored = pack(raw + b"\xff" * (-len(raw) % SAMPLE if raw else SAMPLE))
                payload = sample_bytes(stored)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_string(describe(stored))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return pick(df, "doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
