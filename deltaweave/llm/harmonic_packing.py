"""Harmonic packing of documents into fixed-length training sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of more than C/(k+1) and at most
C/k tokens, and every bin of class k takes exactly k of them. A class needs no knowledge of other
bins, so each worker packs its own rows in one pass over its input, without a shuffle.

A document may be cut. Whole capacities are cut off first. What is left goes whole into its class if k such
pieces waste at most `slack` of a bin; otherwise the largest power of two that fits is cut off (it fills its
class's bins exactly) and the rest is looked at again. A worker's unfinished bins are emptied at
its end and their pieces packed first-fit-decreasing.

Memory of a worker: the open bins (at most one per class) and one Arrow batch. A lost executor's
partition is packed again from its input to the same sequences, as nothing depends on time or
on other partitions: the sequence id is the partition's number and a counter.

Defined cases: a null or empty text is the closing id alone (one piece of length 1); repeated rows are
packed once per row; a null id stays null; an empty table gives no rows; columns other than
the two named ones are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.common import table

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

#: Letters and digits of Latin text; texts with other characters go to the tokenizer whole.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_PRETOKENS = re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile(r"[^\t\n\r -~ -ɏ]|<\|endoftext\|>")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes and ranks, if merging by smallest id is the same as merging in the file's order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, letters = model["vocab"], byte_alphabet()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or any(vocab.get(c, 256) > 255 for c in letters):
        return None
    ranks = {c: vocab[c] for c in letters} | {a + b: 256 + i for i, (a, b) in enumerate(pairs)}
    return {bytes(letters[c] for c in token): i for token, i in ranks.items()}


class Encoder(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE never merges over a pre-token's end, so ids are kept by pre-token, `most` of them; later
    ones are encoded each time. Single pre-tokens are merged by rank, which gives the tokenizer's ids at a fraction of
    a call's cost; texts with unusual characters go through the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        ranks = ranked(path)
        self.merge = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece)).tobytes() if self.merge else self.whole(piece)
        if len(self) < self.most:
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _PRETOKENS.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(length: int, capacity: int, slack: float, least_cut: int) -> list[int]:
    """Lengths of a document's pieces, in order."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        power = 1 << (rest.bit_length() - 1)
        if rest <= least_cut or power == rest or capacity - k * rest <= slack * capacity:
            pieces.append(rest)
            break
        pieces.append(power)
        rest -= power
    return pieces


class Packer:
    """Bins of one worker. `add` and `finish` give finished bins: lists of pieces whose first field is the length."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple] | None:
        k = self.capacity // piece[0]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            return self.open.pop(k)
        return None

    def finish(self) -> list[list[tuple]]:
        rest = sorted((p for b in self.open.values() for p in b), key=lambda p: -p[0])
        self.open = {}
        bins: list[list[tuple]] = []
        room: list[int] = []
        for p in rest:
            at = next((i for i, r in enumerate(room) if r >= p[0]), None)
            if at is None:
                bins.append([p])
                room.append(self.capacity - p[0])
            else:
                bins[at].append(p)
                room[at] -= p[0]
        return bins


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None, slack: float = 0.03, least_cut: int = 127) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset. ids: the piece's token ids, 4 bytes each."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(capacity)
        base, done = TaskContext.get().partitionId() << 40, 0
        out: list[tuple] = []
        size = 0

        def place(bin_: list[tuple]) -> int:
            nonlocal done
            at = 0
            for length, doc, start, ids, total in bin_:
                out.append((doc, start, length, ids, total, base + done, at))
                at += length
            done += 1
            return 4 * at

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (encode(text) if text else b"") + end
                    total, start = len(ids) // 4, 0
                    for n in cut(total, capacity, slack, least_cut):
                        full = packer.add((n, doc, start, ids[4 * start : 4 * (start + n)], total))
                        if full:
                            size += place(full)
                        start += n
                        if size > 4_000_000:  # within a document too: a very long one leaves piece by piece
                            yield flush()
                            size = 0
        for bin_ in packer.finish():
            place(bin_)
        yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
