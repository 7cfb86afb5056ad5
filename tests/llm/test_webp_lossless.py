import hashlib
import zlib

import numpy as np
import pytest

from deltaweave.llm import webp_lossless as w


def image(h, wide, colours=None, seed=0):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.integers(0, 256, (colours, 4), np.uint8)[rng.integers(0, colours, (h, wide))]
    return rng.integers(0, 256, (h, wide, 4), np.uint8)


@pytest.mark.parametrize("size", [(1, 1), (1, 16), (7, 5), (40, 33)])
def test_flat_round_trip(size):
    img = image(*size)
    assert (w.decode(w.encode(img)) == img).all()


@pytest.mark.parametrize("flags", [dict(), dict(cache_bits=4), dict(references=True), dict(cache_bits=7, references=True)])
@pytest.mark.parametrize("colours", [1, 3, 40, None])
def test_codes_cache_and_references(flags, colours):
    img = image(23, 17, colours, seed=3)
    assert (w.decode(w.encode(img, flat=False, **flags)) == img).all()


def test_references_shrink_repeats():
    img = np.tile(image(4, 16), (30, 1, 1))
    data = w.encode(img, flat=False, references=True)
    assert (w.decode(data) == img).all() and len(data) < img.size / 4


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    img = image(9, 11, 30, seed=mode)
    modes = np.full((3, 3), mode, np.uint8)
    assert (w.decode(w.encode(img, transforms=((w.PREDICTOR, modes, 2),))) == img).all()


def test_all_transforms_together():
    img = image(12, 13, 90, seed=5)
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 256, (3, 4, 4), np.uint8)
    modes = rng.integers(0, 14, (3, 4)).astype(np.uint8)
    for order in (((w.CROSS_COLOUR, elements, 2), (w.PREDICTOR, modes, 2), (w.SUBTRACT_GREEN,)), ((w.SUBTRACT_GREEN,), (w.PREDICTOR, modes, 2)), ((w.CROSS_COLOUR, elements, 2),)):
        assert (w.decode(w.encode(img, transforms=order, cache_bits=3, references=True)) == img).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 9, 16, 17, 200])
def test_palette(colours):
    img = image(10, 19, colours, seed=colours)
    assert (w.decode(w.encode(img, transforms=((w.PALETTE,),))) == img).all()


def test_long_payload_is_several_files():
    payload = np.random.default_rng(0).integers(0, 256, 64 * (w.MAX_SIDE + 3), np.uint8).tobytes()
    images = w.load_images(w.store_bytes(payload))
    assert len(images) == 2 and w.samples_of(images) == payload


def test_texts_round_trip_and_shrink():
    import duckdb

    rng = np.random.default_rng(3)
    texts = [t.encode() for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    odd = [b"", b"ab" * 5000, bytes(range(256)) * 40, rng.integers(0, 256, 5000, np.uint8).tobytes(), rng.integers(0, 17, 70_000, np.uint8).tobytes(), b"0123456789" * 700, b"x" * 100_000, "é漢\U0001f600".encode() * 9000]
    odd.append(b"".join(bytes([i % 251]) * (i % 700) for i in range(1200)))  # copies of all lengths
    total = stored = 0
    for raw in texts + odd:
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = w.store_bytes(payload)
        assert w.samples_of(w.load_images(media)) == payload and media == w.store_bytes(payload)
        if raw in texts:
            total, stored = total + len(payload), stored + len(media)
    assert stored < 0.55 * total


def test_the_fast_reader_equals_the_general_one(monkeypatch):
    """The same files, read element by element."""
    texts = [b"the quick brown fox jumps over the lazy dog; " * 40 + bytes(range(200)), b"a b c d e f g h i j k l m n o p q r s t u v w x y z " * 9]
    media = [w.store_bytes(t + b"\0" * (-len(t) % 64)) for t in texts]
    fast = [w.decode(m) for m in media]
    monkeypatch.setattr(w, "_green", None)
    read = w.Prefix.__init__

    def never_single(self, lengths):
        read(self, lengths)
        if self.single is not None:
            self.one, self.single = self.single, None
            self.read = lambda bits: self.one

    monkeypatch.setattr(w.Prefix, "__init__", never_single)
    for m, f in zip(media, fast):
        assert (w.decode(m) == f).all()


def test_op8_equals_plain_bytes(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 200_000, "a"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in w.load_media(w.store_texts(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert got[i].n_bytes == len(raw) and bytes(got[i].samples) == padded
    assert got[2].media == got[6].media and got[2].feature == got[6].feature
    assert w.load_media(w.store_texts(df.limit(0))).count() == 0


def test_op8_digests(spark, sf):
    out = {r.doc_id: r for r in w.op8_webp_lossless(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs[:50]:
        raw = (d.text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = out[d.doc_id]
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(padded))
