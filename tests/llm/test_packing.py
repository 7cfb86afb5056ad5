import random
import zlib
from array import array

import public_tokenizers
import pytest

from deltaweave.llm import harmonic_packing as h


def test_encoder_equals_tokenizer():
    e = h.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.merge is not None
    texts = ["", "a", "don't I'LL  x\n\n", " leading", "a\x1cb", "<|endoftext|> a", "日本 é", "x" * 4000, "12 345", "tab\t\tend  "]
    texts += ["".join(random.Random(i).choices("abc éßñ 0129.,!'\n\t<|>", k=200)) for i in range(40)]
    for t in texts:
        assert list(array("I", e(t))) == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 100, 127, 128, 1500, 2047, 2048, 2049, 9999])
def test_cut_covers(n):
    pieces = h.cut(n, 2048, 0.03, 127)
    assert sum(pieces) == n and max(pieces) <= 2048


def check(rows, texts, capacity=2048):
    e = h.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, t in texts.items():
        own = sorted(by_doc[d], key=lambda r: r.start)
        ids = e(t or "") + array("I", [1]).tobytes()
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert all(r.doc_tokens == len(ids) // 4 and len(r.ids) == 4 * r.length for r in own)
        at = 0
        for r in own:
            assert r.start == at
            at += r.length
    used = padded = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        used += at
        padded += at if at & (at - 1) == 0 else capacity
    return used, padded


def test_pieces_and_sequences(spark):
    texts = {0: None, 1: "", 2: "a b", 3: "word " * 3000, 4: "same", 5: "same", 6: "é" * 500}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, length int, ids string")
    check(h.pack(df).collect(), texts)
    assert h.pack(df.limit(0)).count() == 0
    assert h.pack(spark.createDataFrame([(None, "a")], "doc_id long, text string")).first().doc_id is None


def test_little_padding_and_crc(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = h.pack(docs.coalesce(1)).collect()
    used, padded = check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert padded < 1.03 * used
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in h.op10_harmonic_packing(spark, sf).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(bytes(r.ids)) for r in rows)
