import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestia.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(body):
    payload = media.pad(body)
    data = media.mux(payload)
    found = media.probe(data)
    assert found["error"] is None and found["codec"] == "raw "
    assert media.read_track(data, found["ranges"]) == payload
    assert found["samples"] * media.UNIT == len(payload) == found["duration"]
    at, size = found["keyframes"]
    assert len(at) == -(-found["samples"] // media.CHUNK) and set(size.tolist()) == {media.UNIT}


def test_malformed_files_have_an_error():
    good = media.mux(media.pad(b"abc"))
    for bad in (b"", b"xyz", good[:-5], b"\0\0\0\x08free", good.replace(b"stsc", b"xxxx"), good.replace(b"stsz", b"free")):
        assert media.probe(bad)["error"]


def test_sizes_by_table_large_boxes_and_missing_sync_table():
    """A hand-made track: a 64-bit mdat, three samples of different sizes in two chunks, every sample sync."""
    full, box = media._full, media._box
    body = b"aaabbbbcc"
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body) + 4)
    base = 16
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(70))),
        full(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 1, 1)),
        full(b"stsz", struct.pack(">II", 0, 3), struct.pack(">III", 3, 4, 2)),
        full(b"co64", struct.pack(">I", 2), struct.pack(">QQ", base, base + 11)),
    )
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQ", 0, 0, 90000, 450000), bytes(4), version=1), box(b"minf", table))
    data = head + body[:7] + b"...." + body[7:] + box(b"moov", box(b"trak", mdia))
    found = media.probe(data)
    assert (found["codec"], found["timescale"], found["duration"]) == ("avc1", 90000, 450000)
    assert media.read_track(data, found["ranges"]) == body
    assert [x.tolist() for x in found["keyframes"]] == [[base, base + 3, base + 11], [3, 4, 2]]


def test_query_values(spark):
    texts = [None, "", "a", "é" * 700, "a", "x" * 64]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = sorted(media.digests(media.store(docs)).collect())
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        body = (t or "").encode()
        payload = body + bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        assert (r.n_bytes, r.payload_bytes) == (len(body), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[2][1:] == rows[4][1:]
    assert media.digests(media.store(docs.limit(0))).count() == 0


def test_probed_columns(spark):
    stored = spark.createDataFrame([(1, bytearray(media.mux(bytes(64 * 40)))), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    a, b, c = sorted(media.probed(stored).collect())
    assert (a.codec, a.timescale, a.duration, a.samples, len(a.keyframes), a.error) == ("raw ", 8000, 2560, 40, 3, None)
    assert b.codec is None and b.error is None
    assert c.codec is None and c.error


def test_many_random_payloads():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1024, 1025, 70000):
        payload = media.pad(rng.bytes(n))
        data = media.mux(payload)
        assert media.read_track(data, media.probe(data)["ranges"]) == payload


@pytest.mark.parametrize("cut", range(0, 600, 37))
def test_any_cut_is_reported(cut):
    data = media.mux(media.pad(b"x" * 100))
    if cut < len(data):
        assert media.probe(data[:cut])["error"]
