import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbatlas.llm import media as m

rng = np.random.default_rng(3)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.booleans(), st.integers(0, 2**32 - 1))
def test_formats_round_trip(h, w, colour, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w), dtype=np.uint8)
    assert (m.decode(m.encode_netpbm(image)) == image).all()
    assert (m.decode(m.encode_bmp(image)) == (image if colour else image[:, :, None])).all()


def test_other_netpbm():
    assert m.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert m.decode(b"P4 3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert m.decode(b"P2 2 1 15 15 0\n").tolist() == [[255, 0]]
    assert m.decode(b"P3 1 1 255 1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert m.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    for bad in (b"P6 2 2 255\nxx", b"nothing", b"P5 x"):
        with pytest.raises(ValueError):
            m.decode(bad)


def test_area_resize_is_the_box_average():
    image = rng.integers(0, 256, (12, 20)).astype(float)
    assert np.allclose(m.area_resize(image, 3, 5), image.reshape(3, 4, 5, 4).mean((1, 3)))
    fine = np.repeat(np.repeat(image, 7, 0), 9, 1)
    assert np.allclose(m.area_resize(image, 7, 9), fine.reshape(7, 12, 9, 20).mean((1, 3)))
    assert np.allclose(m.area_resize(np.full((1, 1), 7.0), 9, 9), 7)


def test_tiles_and_hashes(spark, odd):
    image = rng.integers(0, 256, (70, 40), dtype=np.uint8)
    tiles = list(m.npy_tiles(image))
    assert len(tiles) == 6 and all((np.load(io.BytesIO(d)) == image[y * 32 : y * 32 + 32, x * 32 : x * 32 + 32]).all() for y, x, d in tiles)
    assert len(m.difference_hash(image)) == 32 and m.difference_hash(image) != m.difference_hash(image[::-1])
    stored = m.store_texts(odd)
    cut = m.media_tiles(stored).where("doc_id = 10").orderBy("tile_row").collect()
    whole = np.concatenate([np.load(io.BytesIO(r.npy)) for r in cut])
    assert whole.tobytes().rstrip(b" ").decode().startswith(odd.where("doc_id = 10").first()["text"][:50])


def test_contract_rows(spark, odd, repeated, none, odd_texts):
    out = {r.doc_id: r for r in m.media_features(m.store_texts(odd)).collect()}
    for k, t in enumerate(odd_texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = out[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        form = b"P6\n8 %d\n255\n" % (len(payload) // 24) + payload
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
    assert out[6].feature == out[7].feature and out[0].feature == out[1].feature
    assert m.media_features(m.store_texts(repeated)).count() == 6 and m.media_features(m.store_texts(none)).count() == 0


def test_report_holds_stored_tiles(spark, odd, repeated, none, odd_texts, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in m.query(spark, str(tmp_path)).collect()}
    assert len(out) == len(odd_texts)
    for k, t in enumerate(odd_texts):
        data = (t or "").encode()
        image = m.text_image(data + b" " * (-len(data) % 192 if data else 192))
        tiles = [b"%d,%d,%s," % (y, x, m.difference_hash(image[y * 32 : y * 32 + 32]).encode()) + npy for y, x, npy in m.npy_tiles(image)]
        total = 0
        for tile in tiles:
            total ^= int(hashlib.sha256(tile).hexdigest(), 16)
        assert out[k].n_tiles == len(tiles) and out[k].n_bytes == len(data)
        assert out[k].tiles_digest == f"{total:064x}"
    stored = sorted(str(r) for r in m.media_features(m.store_texts(repeated)).collect())
    assert sorted(str(r) for r in m.media_report(repeated).drop("n_tiles", "tiles_digest").collect()) == stored
    assert m.media_report(repeated).where("n_tiles is null").count() == 0 and m.media_report(none).count() == 0
