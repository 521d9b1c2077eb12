import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm import media


def area(image, height, width):
    """Each target cell's mean by exact overlaps."""
    h, w = image.shape[:2]
    out = np.zeros((height, width, *image.shape[2:]))
    for y in range(height):
        for x in range(width):
            y0, y1, x0, x1 = y * h / height, (y + 1) * h / height, x * w / width, (x + 1) * w / width
            for i in range(h):
                for j in range(w):
                    part = max(0, min(i + 1, y1) - max(i, y0)) * max(0, min(j + 1, x1) - max(j, x0))
                    out[y, x] += part * image[i, j] / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize("shape,to", [((5, 7), (3, 4)), ((4, 4), (4, 4)), ((2, 3), (5, 9)), ((6, 5, 3), (2, 3))])
def test_resize_is_the_mean_of_areas(shape, to):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert np.allclose(media.resize_area(image, *to), area(image, *to))


def test_netpbm_kinds():
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(b"P2 # c\n4 3\n255\n" + b" ".join(b"%d" % v for v in gray.ravel())) == gray).all()
    assert (media.decode(media.encode_pgm(gray)) == gray).all()
    assert (media.decode(b"P1\n3 2\n101\n0 1 0") == [[1, 0, 1], [0, 1, 0]]).all()
    assert (media.decode(b"P4\n3 2\n\xa0\x40") == [[1, 0, 1], [0, 1, 0]]).all()
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (media.decode(b"P6\n4 2\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P3\n4 2\n255\n" + b" ".join(b"%d" % v for v in rgb.ravel())) == rgb).all()
    assert (media.decode(b"P5\n2 1\n1000\n\x01\x00\x00\x02") == [[256, 2]]).all()
    for bad in (b"", b"P5\n4 4\n255\nxx", b"P9 1 1 1", b"BM"):
        with pytest.raises(ValueError):
            media.decode(bad)


HOSTILE = [
    b"P5 99999999999 99999999999 255\n", b"P5 999999999 999999999 255\nx", b"P2 1 1 255 99999999999999999999", b"P2 2 1 9 3 10", b"P1 2 2 1 7 0 1", b"P2 1 1 255 -3", b"P2 1 1 255 x",
    b"P5 0 0 255\n", b"P5 0 4 255\n", b"P4 0 1\n", b"P5\n1 1\n255", b"P5 1 1 99\n\xff", b"P6 1 1 70000\nxxx", b"P3 1 1 255 1 2", b"P4 9 9\n\0", b"P5 " + b"9" * 5000 + b" 1 255\n",
]


def damaged_bmps():
    whole = bytearray(media.encode_bmp(np.full((4, 5, 3), 9, np.uint8)))
    for at, value in ((10, b"\xff\xff\xff\xff"), (18, b"\xff\xff\xff\x7f"), (22, b"\xff\xff\xff\x7f"), (22, b"\0\0\0\0"), (22, b"\0\0\0\x80"), (28, b"\x08\0"), (28, b"\x01\0")):
        out = bytearray(whole)
        out[at : at + len(value)] = value
        yield bytes(out)
    yield bytes(whole[:60])


@pytest.mark.parametrize("data", [*HOSTILE, *damaged_bmps()])
def test_hostile_headers_are_refused(data):
    with pytest.raises((ValueError, OverflowError)):
        media.decode(data)


def test_hostile_images_are_error_rows(spark):
    bad = [*HOSTILE, *damaged_bmps()]
    good = media.encode_pgm(np.full((3, 3), 5, np.uint8))
    rows = media.media_tiles(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([*bad, good])], "k int, m binary").repartition(2), "k", "m").orderBy("k").collect()
    assert len(rows) == len(bad) + 1 and all(r["error"] and r["npy"] is None and r["height"] is None for r in rows[:-1]) and rows[-1]["error"] is None and rows[-1]["height"] == 3


@given(st.binary(max_size=60))
def test_any_bytes_are_decoded_or_refused(junk):
    for head in (b"", b"P1 ", b"P2 2 2 9 ", b"P5 2 2 255\n", b"P6 1 1 255 ", b"BM"):
        try:
            assert media.decode(head + junk).size
        except ValueError:
            pass


def plain_feature(text):
    """The difference hash of a text's payload, 64 samples a row, from exact areas."""
    raw = (text or "").encode()
    raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    cells = np.round(area(np.frombuffer(raw, np.uint8).reshape(-1, 64), 8, 9), 6)
    return f"{int(''.join(str(int(cells[y, x + 1] > cells[y, x])) for y in range(8) for x in range(8)), 2):016x}"


@given(st.text(max_size=900))
def test_feature_against_exact_areas(text):
    payload, _ = media.payload_of(text)
    assert media.difference_hash(media.decode(media.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64)))) == plain_feature(text)


def test_bmp_round_trip():
    rgb = np.random.default_rng(2).integers(0, 256, (5, 3, 3)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()


@given(st.text(max_size=200))
def test_payload(text):
    payload, n = media.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == text.encode() and not any(payload[n:]) and len(payload) - max(n, 1) < 64


def test_text_media(edge, empty):
    rows = media.text_media(edge).collect()
    assert len(rows) == edge.count() and media.text_media(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    for r in rows:
        payload, n = media.payload_of(texts[r["doc_id"]])
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(r["feature"]) == 16
        if n < 2000:
            assert r["feature"] == plain_feature(texts[r["doc_id"]])
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]] or "", r[1:]) == r[1:]


def test_tiles(spark):
    rgb = np.full((20, 30, 3), 7, np.uint8)
    rows = media.media_tiles(spark.createDataFrame([(1, bytearray(media.encode_bmp(rgb))), (2, None), (3, bytearray(b"junk"))], "k int, m binary"), "k", "m", 4).orderBy("k").collect()
    tile = np.load(io.BytesIO(rows[0]["npy"]))
    assert tile.shape == (4, 4, 3) and (tile == 7).all() and rows[0]["error"] is None and rows[0]["dhash"] == "0" * 16
    assert rows[1]["error"] and rows[2]["error"] and rows[1]["npy"] is None
