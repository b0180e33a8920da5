import hashlib
import io
import zlib

import numpy as np

from tallyweave.llm import media

from .rows import documents, empty

RNG = np.random.default_rng(2)


def image(h, w, c=3, dtype=np.uint8):
    return RNG.integers(0, np.iinfo(dtype).max, (h, w, c), endpoint=True).astype(dtype)


def test_netpbm_kinds_round_trip():
    for c in (1, 3):
        for dtype in (np.uint8, np.uint16):
            x = image(5, 7, c, dtype)
            assert (media.decode(media.encode_netpbm(x)) == x).all()
    x = image(3, 4, 1)
    text = b"P2 # grey\n4 3\n# depth\n255\n" + b" ".join(str(v).encode() for v in x.ravel())
    assert (media.decode(text) == x).all()
    bits = RNG.integers(0, 2, (3, 10))
    plain = b"P1\n10 3\n" + b"\n".join(" ".join(map(str, r)).encode() for r in bits)
    packed = b"P4\n10 3\n" + np.packbits(bits.astype(np.uint8), axis=1).tobytes()
    assert (media.decode(plain)[:, :, 0] == (1 - bits) * 255).all() and (media.decode(packed) == media.decode(plain)).all()


def test_bmp_round_trip_and_odd_headers():
    for w in range(1, 9):
        x = image(4, w)
        raw = media.encode_bmp(x)
        assert (media.decode(raw) == x).all()
        top_down = bytearray(raw)
        top_down[22:26] = (-4).to_bytes(4, "little", signed=True)
        assert (media.decode(bytes(top_down)) == x[::-1]).all()
    for bad in (None, b"", b"BM", raw[:60], b"P6\n9 9\n255\n12", b"P6 x", b"P9\n1 1\n255\n1234", b"GIF89a..", b"P5\n0 0\n255\n    "):
        assert media.decode(bad) is None


def test_area_resize_is_the_mean_of_areas():
    x = image(12, 18, 3).astype(np.float64)
    assert np.allclose(media.area_resize(x, 4, 6), x.reshape(4, 3, 6, 3, 3).mean((1, 3)))
    fine = np.repeat(np.repeat(x, 7, 0), 5, 1)  # cut pixels: each is 7 x 5 cells
    assert np.allclose(media.area_resize(x, 7, 5), fine.reshape(7, 12, 5, 18, 3).mean((1, 3)))
    assert np.allclose(media.area_resize(x[:1, :1], 8, 9), x[0, 0])


def test_difference_hash_ignores_size_and_brightness():
    y, x = np.mgrid[0:80, 0:90]
    a = (128 + 60 * np.sin(x / 9) * np.cos(y / 13)).astype(np.uint8)[:, :, None]
    assert media.difference_hash(a) == media.difference_hash(a + 40)
    assert (media.difference_hash(a) ^ media.difference_hash(np.repeat(np.repeat(a, 2, 0), 2, 1))).bit_count() == 0


def test_tiles_of_a_table(spark):
    x = image(40, 30)
    rows = [(1, media.encode_bmp(x), "a"), (2, media.encode_netpbm(x), "b"), (3, b"no image", None), (4, None, "d"), (4, None, "d")]
    got = {r.id: r for r in media.tiles(spark.createDataFrame(rows, "id long, content binary, path string"), side=8).collect()}
    assert got[1].tile == got[2].tile and got[1].dhash == got[2].dhash and (got[1].height, got[1].width, got[1].channels) == (40, 30, 3)
    assert np.load(io.BytesIO(got[1].tile)).shape == (8, 8, 3)
    assert got[3].tile is None and got[3].path is None and got[4].dhash is None


def test_texts_come_back_whole(spark):
    docs = documents(spark)
    got = media.text_media(docs).collect()
    want = sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=str)
    rows = sorted(got, key=lambda r: str((r.doc_id, next(b for d, b in want if d == r.doc_id and len(b) == r.n_bytes))))
    assert len(got) == len(want)
    for (doc_id, body), r in zip(want, rows):
        payload = body + b" " * ((-len(body)) % 192 if body else 192)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc_id, len(body), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert media.decode(r.media).tobytes() == payload and (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert {r.format for r in got} == {"bmp", "ppm"}
    assert media.text_media(empty(spark)).count() == 0


def test_strips_change_nothing(monkeypatch):
    image = np.random.default_rng(1).integers(0, 256, (1000, 64, 3)).astype(np.uint8)
    whole = {(h, w): media.area_resize(image, h, w) for h, w in ((8, 9), (16, 16), (7, 64))}
    for strip in (1, 7, 64, 999, 1000):
        monkeypatch.setattr(media, "STRIP", strip)
        for (h, w), want in whole.items():
            assert np.allclose(media.area_resize(image, h, w), want, rtol=1e-9)
    edges = np.linspace(0, 1000, 9)
    brute = [sum(image[i].astype(float) * max(0, min(i + 1, b) - max(i, a)) for i in range(1000)) / (b - a) for a, b in zip(edges, edges[1:])]
    assert np.allclose(media.area_resize(image, 8, 64), np.stack(brute))
