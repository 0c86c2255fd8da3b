"""Media columns: ISO media containers written, walked and read back without decoding any payload.

`mux` stores a payload as one track of 8-bit unsigned PCM: units of UNIT bytes are the samples, CHUNK units make
a chunk, and the first unit of each chunk is a sync sample. `probe` walks the nested boxes of any such file and
decodes the sample tables (stsd, stts, stsc, stsz, stco/co64, stss) into codec, duration and byte ranges;
`read_track` cuts the stored payload out of the ranges.

Defined results: a null or empty text stores UNIT zero bytes; a null media value has null features; a malformed
container has the reason in `error` and null features; repeated rows give repeated rows; other columns that are
asked for pass through; an empty table gives an empty one. A very long text is one container in the memory of its task;
Spark itself holds no value of 2 GiB or more, and a text whose container would be one fails with its error.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.llm.common import ready

UNIT, CHUNK, RATE = 64, 16, 8000
#: Boxes that hold only boxes.
NESTED = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"])
LARGE = (1 << 32) - 16
PROBED = "codec string, timescale long, duration long, samples long, keyframes array<struct<offset:long,length:long>>, error string"


class Malformed(ValueError):
    """A container that cannot be walked."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(body: bytes) -> bytes:
    """The body with zero bytes up to a positive multiple of UNIT."""
    return body + bytes(max(1, -(-len(body) // UNIT)) * UNIT - len(body))


def mux(payload: bytes) -> bytes:
    """A container of one audio track over a payload whose length is a positive multiple of UNIT."""
    n = len(payload) // UNIT
    chunks = -(-n // CHUNK)
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    big = len(payload) > LARGE
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if big else struct.pack(">I4s", len(payload) + 8, b"mdat")
    offsets = len(ftyp) + len(head) + np.arange(chunks, dtype=np.int64) * (UNIT * CHUNK)
    span = n * UNIT
    wide = span >= 1 << 32
    times = struct.pack(">QQIQ", 0, 0, RATE, span) if wide else struct.pack(">IIII", 0, 0, RATE, span)
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    tail = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, tail, 1)]
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    large = offsets[-1] >= 1 << 32
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, UNIT)),
        _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * CHUNK + 1).astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        _full(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if large else ">u4").tobytes()),
    )
    version = int(wide)
    tkhd = struct.pack(">QQIIQ", 0, 0, 1, 0, span) if wide else struct.pack(">IIIII", 0, 0, 1, 0, span)
    track = _box(
        b"trak",
        _full(b"tkhd", tkhd, bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), unity, bytes(8), version=version, flags=7),
        _box(
            b"mdia",
            _full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=version),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            _box(
                b"minf",
                _full(b"smhd", bytes(4)),
                _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))),
                table,
            ),
        ),
    )
    mvhd = _full(
        b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2), version=version
    )
    return b"".join([ftyp, head, payload, _box(b"moov", mvhd, track)])


def boxes(data, start: int = 0, end: int | None = None):
    """(kind, body start, body end) of each box in a range, in order."""
    end = len(data) if end is None else end
    at = start
    while at < end:
        if at + 8 > end:
            raise Malformed("box header cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise Malformed("box header cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"box {kind!r} has a bad size")
        yield kind, at + head, at + size
        at += size


def tracks(data) -> list[dict]:
    """The leaf boxes of each track, by kind."""
    found: list[dict] = []

    def walk(start, end, track):
        for kind, a, b in boxes(data, start, end):
            if kind == b"trak":
                found.append({})
                walk(a, b, found[-1])
            elif kind in NESTED:
                walk(a, b, track)
            elif track is not None:
                track.setdefault(kind, (a, b))

    walk(0, len(data), None)
    return found


def _table(data, track, kind, dtype, fields, skip=8):
    """The rows of a counted table."""
    a, b = track[kind]
    if a + skip > b:
        raise Malformed(f"table {kind!r} cut off")
    n = struct.unpack_from(">I", data, a + skip - 4)[0]
    width = np.dtype(dtype).itemsize * fields
    if a + skip + n * width > b:
        raise Malformed(f"table {kind!r} cut off")
    rows = np.frombuffer(data, dtype, n * fields, a + skip).astype(np.int64)
    return rows.reshape(n, fields) if fields > 1 else rows


def layout(data, track: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset and size of every sample, and which are sync samples."""
    if b"stsz" not in track or b"stsc" not in track or not {b"stco", b"co64"} & track.keys():
        raise Malformed("a sample table is missing")
    a, _ = track[b"stsz"]
    uniform, n = struct.unpack_from(">II", data, a + 4)
    sizes = np.full(n, uniform, np.int64) if uniform else _table(data, track, b"stsz", ">u4", 1, 12)
    where = _table(data, track, b"co64", ">u8", 1) if b"co64" in track else _table(data, track, b"stco", ">u4", 1)
    runs = _table(data, track, b"stsc", ">u4", 3)
    if n == 0:
        return np.zeros(0, np.int64), sizes, np.zeros(0, bool)
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise Malformed("bad sample-to-chunk table")
    reach = np.diff(np.append(runs[:, 0], len(where) + 1))
    if (reach < 0).any():
        raise Malformed("bad sample-to-chunk table")
    each = np.repeat(runs[:, 1], reach)
    chunk = np.repeat(np.arange(len(each)), each)[:n]
    if len(chunk) < n:
        raise Malformed("fewer chunk places than samples")
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, np.arange(len(each)))
    offsets = where[chunk] + before - before[np.minimum(first, n - 1)][chunk]
    sync = np.ones(n, bool)
    if b"stss" in track:
        listed = _table(data, track, b"stss", ">u4", 1) - 1
        if len(listed) and (listed.min() < 0 or listed.max() >= n):
            raise Malformed("bad sync sample")
        sync[:] = False
        sync[listed] = True
    if (offsets + sizes > len(data)).any():
        raise Malformed("a sample lies beyond the file")
    return offsets, sizes, sync


def probe(data: bytes) -> dict:
    """Codec, time scale, duration and keyframe byte ranges of the first track."""
    try:
        found = tracks(data)
        if not found:
            raise Malformed("no track")
        track = found[0]
        if b"mdhd" not in track or b"stsd" not in track:
            raise Malformed("no media header or sample description")
        a, b = track[b"mdhd"]
        scale, span = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
        a, b = track[b"stsd"]
        if a + 16 > b:
            raise Malformed("no sample entry")
        offsets, sizes, sync = layout(data, track)
    except (Malformed, struct.error) as e:
        return {"error": str(e)}
    return {
        "codec": data[a + 12 : a + 16].decode("latin-1"),
        "timescale": scale,
        "duration": span,
        "samples": len(sizes),
        "ranges": (offsets, sizes),
        "keyframes": (offsets[sync], sizes[sync]),
        "error": None,
    }


def read_track(data: bytes, ranges: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The stored bytes of a track's samples, adjoining ranges read at once."""
    offsets, sizes = ranges
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts = offsets[np.append(0, breaks)]
    ends = (offsets + sizes)[np.append(breaks - 1, len(offsets) - 1)]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes and the media column of every row."""
    ready(docs.sparkSession)
    source = docs.select(*keep, F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "utf-8").alias("_body"))
    fields = docs.select(*keep).schema.add("n_bytes", "long").add("media", "binary")

    def write(batches):
        from attestia.llm import media
        from attestia.llm.common import small_batches

        for batch in small_batches(batches):
            bodies = batch.column(batch.num_columns - 1).to_pylist()
            files = [media.mux(media.pad(x)) for x in bodies]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(x) for x in bodies], pa.int64()), pa.array(files, pa.binary())],
                [*batch.schema.names[:-1], "n_bytes", "media"],
            )

    return source.mapInArrow(write, fields)


def probed(stored: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with codec, duration and keyframe byte ranges of a media column."""
    ready(stored.sparkSession)
    fields = stored.sparkSession.createDataFrame([], PROBED).schema
    fields = type(fields)(stored.select(*keep).schema.fields + fields.fields)
    ranged = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def read(batches):
        from attestia.llm import media as m
        from attestia.llm.common import small_batches

        for batch in small_batches(batches):
            found = [{} if x is None else m.probe(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            keys = [
                None if "keyframes" not in f else [{"offset": a, "length": b} for a, b in zip(*[x.tolist() for x in f["keyframes"]], strict=True)]
                for f in found
            ]
            plain = [pa.array([f.get(c) for f in found], t) for c, t in (("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()))]
            errors = pa.array([f.get("error") for f in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *plain, pa.array(keys, ranged), errors],
                [*batch.schema.names[:-1], "codec", "timescale", "duration", "samples", "keyframes", "error"],
            )

    return stored.select(*keep, media).mapInArrow(read, fields)


def digests(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """What the stored bytes hold, read back: payload and file digests and a feature string."""
    import_fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    fields = stored.sparkSession.createDataFrame([], import_fields).schema
    fields = type(fields)(stored.select(*keep).schema.fields + fields.fields)

    def read(batches):
        import hashlib
        import zlib

        from attestia.llm import media as m
        from attestia.llm.common import small_batches

        for batch in small_batches(batches):
            rows = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                found = m.probe(data)
                if found["error"]:
                    raise m.Malformed(found["error"])
                body = m.read_track(data, found["ranges"])
                at, size = found["keyframes"]
                feature = (
                    f"{found['codec'].strip()};{found['duration']}/{found['timescale']};{found['samples']} samples;"
                    f"{len(at)} keyframes;{at[0]}+{size[0]}..{at[-1]}+{size[-1]}"
                )
                digest = hashlib.sha256
                rows.append((len(body), digest(body).hexdigest(), zlib.crc32(body[-m.UNIT :]), len(data), digest(data).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                [*batch.schema.names[:-1], "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return stored.select(*keep, "media").mapInArrow(read, fields)
