import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lumiform.llm import tiff


@pytest.mark.parametrize("n", [0, 1, 2, 63, 300, 5000, 30000])
@pytest.mark.parametrize("symbols", [1, 3, 256])
def test_codecs(n, symbols):
    data = bytes(random.Random(n).choices(range(symbols), k=n))
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("code", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (32, 16), (64, 256)])
def test_pages(code, predictor, tile):
    for n in (64, 640, 64 * 700):
        data = bytes(random.Random(n).choices(range(256), k=n))
        ((page, facts, samples, error),) = tiff.read_pages(tiff.write_page(data, 64, code, predictor, tile))
        assert (page, error, samples.tobytes(), facts["width"]) == (0, None, data, 64)


def test_codecs_on_bytes_written_by_hand():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    # clear, A, B, the first new word (AB), that word and its first letter (ABA), end
    codes = "100000000" "001000001" "001000010" "100000010" "100000100" "100000001"
    assert tiff.lzw_decode(int(codes.ljust(56, "0"), 2).to_bytes(7, "big")) == b"ABABABA"


def entry(tag, value, kind=4, count=1):
    return struct.pack("<HHII", tag, kind, count, value)


def file_of(body, *entries):
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(entries)) + b"".join(entries) + bytes(4)


def page_of(data):
    ((_, _, samples, error),) = tiff.read_pages(data)
    return samples, error


def test_samples_of_less_than_a_byte():
    bits = file_of(b"\x02\xa5\x80\x3f", entry(256, 10), entry(257, 2), entry(258, 1), entry(259, 32773), entry(273, 8), entry(279, 4), entry(278, 9))
    assert page_of(bits)[1] == "a strip or tile is too short"
    bits = file_of(b"\x03\xa5\x80\x3f\x40", entry(256, 10), entry(257, 2), entry(258, 1), entry(259, 32773), entry(273, 8), entry(279, 5), entry(278, 9))
    assert page_of(bits)[0][:, :, 0].tolist() == [[1, 0, 1, 0, 0, 1, 0, 1, 1, 0], [0, 0, 1, 1, 1, 1, 1, 1, 0, 1]]
    four = file_of(b"\x12\x30", entry(256, 3), entry(257, 1), entry(258, 4), entry(273, 8), entry(279, 2), entry(317, 2))
    assert page_of(four)[0].ravel().tolist() == [1, 3, 6]


def test_fill_order_two_turns_bytes():
    one = file_of(b"\x01\x80", entry(256, 8), entry(257, 2), entry(258, 1), entry(266, 2), entry(273, 8), entry(279, 2))
    assert page_of(one)[0][:, :, 0].tolist() == [[1, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 1]]
    packed = bytes(int(f"{b:08b}"[::-1], 2) for b in b"\x01\xa5\x80")
    two = file_of(packed, entry(256, 10), entry(257, 1), entry(258, 1), entry(259, 32773), entry(266, 2), entry(273, 8), entry(279, 3))
    assert page_of(two)[0].ravel().tolist() == [1, 0, 1, 0, 0, 1, 0, 1, 1, 0]
    assert page_of(file_of(b"\0", entry(256, 8), entry(257, 1), entry(266, 3), entry(273, 8), entry(279, 1)))[1] == "fill order 3 is unknown"


def test_samples_come_lowest_byte_first_and_of_their_kind(spark):
    little = file_of(struct.pack("<hhh", -1, 2, 300), entry(256, 3), entry(257, 1), entry(258, 16), entry(273, 8), entry(279, 6), entry(339, 2))
    big = b"MM" + struct.pack(">HI", 42, 14) + struct.pack(">hhh", -1, 2, 300) + struct.pack(">H", 6)
    big += b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in ((256, 3), (257, 1), (258, 16), (273, 8), (279, 6), (339, 2))) + bytes(4)
    floats = file_of(struct.pack("<ff", 1.5, float("nan")), entry(256, 2), entry(257, 1), entry(258, 32), entry(273, 8), entry(279, 8), entry(339, 3))
    rows = tiff.decode_pages(spark.createDataFrame([(1, bytearray(little)), (2, bytearray(big)), (3, bytearray(floats))], "doc_id long, media binary"), "doc_id", "media").orderBy("doc_id").collect()
    assert bytes(rows[0].pixels) == bytes(rows[1].pixels) == struct.pack("<hhh", -1, 2, 300)
    assert [(r.byte_order, r.sample_format, r.fill_order, r.bits) for r in rows] == [("II", 2, 1, 16), ("MM", 2, 1, 16), ("II", 3, 1, 32)]
    assert rows[0].feature == rows[1].feature and rows[0].feature.startswith(f"3x1x1:{301 * 1000 // 3}:") and rows[2].feature.startswith("2x1x1:750:")
    assert page_of(file_of(b"\0", entry(256, 1), entry(257, 1), entry(258, 8), entry(273, 8), entry(279, 1), entry(339, 3)))[1]


def test_floating_point_predictor():
    values = np.array([[1.5, -2.25, 1e10], [0.0, 3.25, 7.0]], np.float32)
    rows = [np.diff(np.frombuffer(r.astype(">f4").tobytes(), np.uint8).reshape(3, 4).T.ravel(), prepend=np.uint8(0)).astype(np.uint8).tobytes() for r in values]
    data = file_of(b"".join(rows), entry(256, 3), entry(257, 2), entry(258, 32), entry(273, 8), entry(279, 24), entry(317, 3), entry(339, 3))
    assert (page_of(data)[0].view("<f4")[:, :, 0] == values).all()


@pytest.mark.parametrize("wrong", [entry(278, 0), entry(256, 4_000_000_000) + entry(257, 4_000_000_000), entry(256, 0, 4, 0), entry(258, 7), entry(317, 3), entry(257, 50_000)])
def test_headers_that_lie_give_an_error(wrong):
    entries = {e[:2]: e for e in (entry(256, 8), entry(257, 8), entry(258, 8), entry(273, 8), entry(277, 1), entry(278, 8), entry(279, 64))}
    entries |= {wrong[i : i + 2]: wrong[i : i + 12] for i in range(0, len(wrong), 12)}
    assert page_of(file_of(bytes(64), *entries.values()))[1]


def test_deflated_bombs_stop_at_what_the_page_needs():
    assert len(tiff.inflate(zlib.compress(bytes(50_000_000)), 100)) == 100


def big_endian_two_pages():
    """Two big-endian pages: 16-bit samples with a predictor, and three planes apart."""
    first = np.array([[1, 5, 2], [7, 7, 65535]], ">u2")
    diff = np.diff(first.astype(np.uint16), axis=1, prepend=np.uint16(0)).astype(">u2")
    planes = [bytes(range(p, p + 4)) for p in (0, 10, 20)]
    body = zlib.compress(diff.tobytes()) + b"".join(planes)
    at = 8 + len(body)
    n = len(zlib.compress(diff.tobytes()))

    def directory(fields, where, following):
        return struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, c) + (v if isinstance(v, bytes) else struct.pack(">I", v) if k == 4 else struct.pack(">HH", v, 0)) for t, k, c, v in fields) + struct.pack(">I", following)

    one = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 8), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, n), (317, 3, 1, 2)]
    two_at = at + 2 + 12 * len(one) + 4
    extra = two_at + 2 + 12 * 8 + 4
    two = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 3, extra.to_bytes(4, "big")), (259, 3, 1, 1), (273, 4, 3, extra + 6), (277, 3, 1, 3), (279, 4, 3, extra + 18), (284, 3, 1, 2)]
    tail = struct.pack(">HHH", 8, 8, 8) + struct.pack(">III", 8 + n, 8 + n + 4, 8 + n + 8) + struct.pack(">III", 4, 4, 4)
    return b"MM" + struct.pack(">HI", 42, at) + body + directory(one, at, two_at) + directory(two, two_at, at) + tail, first, planes


def test_byte_order_depth_planes_and_a_looping_chain():
    data, first, planes = big_endian_two_pages()
    pages = list(tiff.read_pages(data))
    assert [p[3] for p in pages] == [None, None]
    assert (pages[0][2][:, :, 0] == first).all() and [pages[1][2][:, :, i].tobytes() for i in range(3)] == planes


@pytest.mark.parametrize("damage", [b"", b"not a tiff", b"II*\0\xff\xff\xff\x7f", tiff.write_page(bytes(640), 64)[:60], tiff.write_page(bytes(640), 64)[:-6]])
def test_damage_is_told(damage):
    assert [p[3] is not None for p in tiff.read_pages(damage)] == [True]


def plain_feature(payload):
    """The feature of a page of 64 columns, cell by cell."""
    h, w = len(payload) // 64, 64
    mean = sum(payload) / (h * w)
    bits = ""
    for i in range(8):
        for j in range(8):
            cell = [payload[y * 64 + x] for y in range(i * h // 8, max((i + 1) * h // 8, i * h // 8 + 1)) for x in range(j * 8, j * 8 + 8)]
            bits += "1" if sum(cell) * h * w > sum(payload) * len(cell) else "0"
    return f"64x{h}x1:{int(mean * 1000 + 1e-9)}:{int(bits, 2):016x}"


def test_query(spark, sf):
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = tiff.op1_tiff(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = tiff.stored_as(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), plain_feature(payload))


def test_forms_do_not_depend_on_length():
    for n in (64, 6400, 640000):
        assert {zlib.crc32(i.to_bytes(2, "big") * (n // 2)) % len(tiff.FORMS) for i in range(400)} == set(range(len(tiff.FORMS)))
    for form in range(len(tiff.FORMS)):
        payload = next(p for p in (bytes(range(1 + i)) * 64 * 70 for i in range(200)) if zlib.crc32(p) % len(tiff.FORMS) == form)
        assert page_of(tiff.stored_as(payload))[0].tobytes() == payload


def test_nulls_empties_repeats_and_clashes(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "x" * 70000, 3)], "doc_id long, text string, media int")
    pages = tiff.decode_pages(tiff.encode_texts(df), "doc_id", "media").collect()
    assert sorted((r.doc_id or 0, len(r.pixels)) for r in pages) == [(0, 64), (1, 64), (1, 64), (2, 70016)]
    assert tiff.decode_pages(tiff.encode_texts(df.limit(0)), "doc_id", "media").count() == 0
    broken = spark.createDataFrame([(5, bytearray(b"oops")), (6, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.error is None, r.pixels) for r in tiff.decode_pages(broken, "doc_id", "media").collect()] == [(5, False, None)]
