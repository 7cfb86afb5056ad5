"""Media columns: lossless WebP (VP8L), read and written with numpy.

`decode` reads any VP8L stream: prefix codes (simple and normal, several groups through an entropy image),
back-references, colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. `encode` writes streams with each of these features.

Bytes are stored as samples of the green channel of images `WIDE` wide and at most `MAX_SIDE` high; a longer payload is a run of
complete files, one after the other. For each image the writer compares the measured cost of literals under a prefix code of
their own counts with that of literals and back-references to the last place of the same four bytes, and takes the cheaper;
samples of at most 16 values are packed through a palette. Predictor, cross-colour and cache aren't tried for texts: neighbouring
bytes of a text don't predict each other by value, and a cache of one-channel pixels repeats what the prefix code does. Equal
texts have equal files. Streams whose pixels lie in the green channel alone are read through a table of all bit
places, a chunk at a time; others element by element. Rows are independent; a worker holds one document at a time.

Defined cases: null and empty texts are one block of 64 zero bytes with n_bytes 0; repeated rows give equal
values; an empty table gives no rows; columns other than the two named ones are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.common import table

MAX_SIDE = 16384
WIDE = 64
#: Bytes of a stream whose bit places are looked up at once, tokens skipped by one step of a walk (as a power of two), and longest
#: codes of the writer for texts.
CHUNK, STEP_BITS, MOST_BITS = 1 << 14, 4, 12
U64 = np.uint64
_EIGHT = np.arange(8, dtype=np.uint64)
#: Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
DISTANCE_MAP = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)
#: Channel places in a pixel.
R, G, B, A = range(4)


class Bits:
    """Reads a stream's bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.n < n:
            chunk = self.data[self.at : self.at + 6]
            self.held |= int.from_bytes(chunk, "little") << self.n
            self.at += 6
            self.n += 48

    def take(self, n: int) -> int:
        self.fill(n)
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return out

    def place(self) -> int:
        """Bits read so far."""
        return 8 * self.at - self.n

    def seek(self, place: int) -> None:
        self.at, self.held, self.n = place // 8, 0, 0
        self.take(place % 8)


class Prefix:
    """A canonical prefix code as a lookup by the next `most` bits: symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.flat = len(used) == 256 and bool((lengths[:256] == 8).all())
        self.single = int(used[0]) if len(used) == 1 else None if len(used) else 0
        self.most, self._list = 0, None
        if self.single is not None:
            self.table = np.array([self.single << 4], np.int32)
            return
        self.most = int(lengths.max())
        self.table = np.zeros(1 << self.most, np.int32)
        used, codes = codes_of(lengths)
        for symbol, length, code in zip(used.tolist(), lengths[used].tolist(), codes[used].tolist()):
            self.table[code :: 1 << length] = symbol << 4 | length

    @property
    def list(self) -> list[int]:
        if self._list is None:
            self._list = self.table.tolist()
        return self._list

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        bits.fill(self.most)
        e = self.list[bits.held & ((1 << self.most) - 1)]
        bits.held >>= e & 15
        bits.n -= e & 15
        return e >> 4


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used symbols, and by symbol the code with its bits in stream order."""
    sizes = lengths.astype(np.int64)
    used = np.flatnonzero(sizes)
    order = used[np.argsort(sizes[used], kind="stable")]
    own = sizes[order]
    # A code is the sum of the shares of those before it, in units of its own length.
    before = np.cumsum(np.append(0, 1 << (15 - own)))[:-1] >> (15 - own)
    codes = np.zeros(len(sizes), np.int64)
    codes[order] = (_REVERSED[before & 255].astype(np.int64) << 8 | _REVERSED[before >> 8]) >> (16 - own)
    return used, codes


def read_code(bits: Bits, size: int) -> Prefix:
    lengths = np.zeros(size, np.uint8)
    if bits.take(1):
        two = bits.take(1)
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return Prefix(lengths)
    order = np.zeros(19, np.uint8)
    for i in range(4 + bits.take(4)):
        order[CODE_LENGTH_ORDER[i]] = bits.take(3)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    code, at, before = Prefix(order), 0, 8
    if code.single is not None and code.single < 16:  # all lengths are equal and take no bits
        lengths[: min(left, size)] = code.single
        return Prefix(lengths)
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
        else:
            value = before if s == 16 else 0
            n = 3 + bits.take(2) if s == 16 else 3 + bits.take(3) if s == 17 else 11 + bits.take(7)
            lengths[at : at + n] = value
            at += n
    return Prefix(lengths)


def _prefixed(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: (height, width, 4)."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    groups_at, side, n_groups = None, 0, 1
    if main and bits.take(1):
        side = bits.take(3) + 2
        meta = read_pixels(bits, (width + (1 << side) - 1) >> side, (height + (1 << side) - 1) >> side, False)
        groups_at = (meta[..., R].astype(int) << 8) | meta[..., G]
        n_groups = int(groups_at.max()) + 1
    groups = [[read_code(bits, n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(n_groups)]
    n = width * height
    if n_groups == 1 and not cache_bits and all(c.flat for c in groups[0][:4]):
        return _literals(bits, n).reshape(height, width, 4)
    if n_groups == 1 and not cache_bits and all(c.single is not None for c in groups[0][1:4]):
        out = np.empty((n, 4), np.uint8)
        out[:] = [groups[0][1].single, 0, groups[0][2].single, groups[0][3].single]
        out[:, G] = _green(bits, n, width, groups[0][0], groups[0][4])
        return out.reshape(height, width, 4)
    out = np.zeros(n, np.uint32)  # argb
    cache = [0] * (1 << cache_bits) if cache_bits else None
    at, seen = 0, 0
    codes = groups[0]
    while at < n:
        if groups_at is not None:
            codes = groups[groups_at[at // width >> side, at % width >> side]]
        s = codes[0].read(bits)
        if s < 256:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _prefixed(s - 256, bits)
            far = _prefixed(codes[4].read(bits), bits)
            if far > 120:
                far -= 120
            else:
                dx, dy = DISTANCE_MAP[far - 1]
                far = max(1, dx + dy * width)
            for i in range(at, min(at + length, n)):
                out[i] = out[i - far]
            at = min(at + length, n)
        else:
            out[at] = cache[s - 280]
            at += 1
        if cache is not None:
            for p in out[seen:at].tolist():
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            seen = at
    return np.stack([(out >> k & 255).astype(np.uint8) for k in (16, 8, 0, 24)], -1).reshape(height, width, 4)


def _green(bits: Bits, n: int, width: int, code: Prefix, distances: Prefix) -> np.ndarray:
    """n samples of a stream with one coded channel.

    For a chunk of the stream each bit place gets the token that would begin there and so the place of the next one; steps of
    `STEP` tokens are composed, followed, and filled in again. Literals and copies of the places met are then laid out at once, and copies
    made in their order.
    """
    data = bits.data + bytes(16)
    out = np.zeros(n, np.uint8)
    p, made = bits.place(), 0
    while made < n:
        first = p >> 3
        raw = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - 16 - first) + 15, first).astype(np.uint64)
        w = raw[:-7].copy()
        for k in range(1, 8):
            w |= raw[k : len(raw) - 7 + k] << U64(8 * k)  # 64 bits from each byte on
        at_bit = lambda places: w[places >> 3] >> (places & 7).astype(U64)
        rows = len(w) - 8  # tokens that begin there lie in the windows whole
        entry = code.table[((w[:rows, None] >> _EIGHT) & U64((1 << code.most) - 1)).ravel()]
        follow = np.arange(8 * rows, dtype=np.int64) + (entry & 15)
        copies = np.flatnonzero(entry >= 4096)
        length, far, ends = _copy_tokens(at_bit, copies + (entry[copies] & 15), (entry[copies] >> 4) - 256, distances)
        follow[copies] = ends
        limit = 8 * rows
        steps = [np.append(np.minimum(follow, limit), limit)]
        while len(steps) < STEP_BITS + 1:
            steps.append(steps[-1][steps[-1]])
        # At most as many tokens as samples are missing; each step of the walk skips 2 ** STEP_BITS of them.
        start, met, jump = p - 8 * first, [], steps[-1].item
        while start < limit and (len(met) << STEP_BITS) < n - made:
            met.append(start)
            start = jump(start)
        places = np.array(met, np.int64)[:, None]
        for step in steps[-2::-1]:
            places = np.stack([places, step[places]], -1).reshape(len(met), -1)
        places = places.ravel()
        places = places[places < limit]
        symbol = entry[places] >> 4
        is_copy = symbol >= 256
        size = np.ones(len(places), np.int64)
        which = np.searchsorted(copies, places[is_copy])
        size[is_copy] = length[which]
        ends = made + np.cumsum(size)
        keep = int(np.searchsorted(ends, n)) + 1  # tokens up to the last sample
        places, symbol, is_copy, ends, size = places[:keep], symbol[:keep], is_copy[:keep], ends[:keep], size[:keep]
        out[ends[~is_copy] - 1] = symbol[~is_copy]
        for end, m, back in zip(ends[is_copy].tolist(), size[is_copy].tolist(), far[which].tolist()):
            if back > 120:
                back -= 120
            else:
                dx, dy = DISTANCE_MAP[back - 1]
                back = max(1, dx + dy * width)
            lo, end = end - m, min(end, n)
            if back >= m:
                out[lo:end] = out[lo - back : end - back]
            else:
                out[lo:end] = np.resize(out[lo - back : lo], end - lo)
        made = min(int(ends[-1]), n)
        p = 8 * first + int(follow[places[-1]])
    bits.seek(p)
    return out


def _copy_tokens(at_bit, places: np.ndarray, symbols: np.ndarray, distances: Prefix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, distance values and end places of copies whose length symbols end at the places."""
    length, places = _values(symbols, places, at_bit)
    entry = distances.table[at_bit(places) & U64((1 << distances.most) - 1)]
    far, places = _values(entry >> 4, places + (entry & 15), at_bit)
    return length, far, places


def _values(symbols: np.ndarray, places: np.ndarray, at_bit) -> tuple[np.ndarray, np.ndarray]:
    """Values of prefix symbols whose extra bits begin at the places, and where those end."""
    symbols = symbols.astype(np.int64)
    extra = np.where(symbols < 4, 0, (symbols - 2) >> 1)
    value = ((2 + (symbols & 1)) << extra) + (at_bit(places) & ((U64(1) << extra.astype(U64)) - U64(1))).astype(np.int64) + 1
    return np.where(symbols < 4, symbols + 1, value), places + extra


def _literals(bits: Bits, n: int) -> np.ndarray:
    """n pixels whose samples are 8-bit codes in the order green, red, blue, alpha."""
    place = bits.place()
    raw = np.frombuffer(bits.data, np.uint8, 4 * n + 1, place // 8) if place % 8 else np.frombuffer(bits.data, np.uint8, 4 * n, place // 8)
    k = place % 8
    got = (raw[:-1] >> k | raw[1:] << (8 - k)) if k else raw
    bits.seek(place + 32 * n)
    return _REVERSED[got].reshape(n, 4)[:, [1, 0, 2, 3]]


def _mean(a, b):
    return (a + b) >> 1


def unpredict(img: np.ndarray, modes: np.ndarray, side: int) -> np.ndarray:
    h, w, _ = img.shape
    out = img.astype(np.int32)
    out[0, 0, A] = (out[0, 0, A] + 255) & 255
    out[0] = np.cumsum(out[0], 0) & 255
    for y in range(1, h):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        for x in range(1, w):
            left, top, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
            right = out[y - 1, x + 1] if x + 1 < w else out[y, 0]
            out[y, x] = (out[y, x] + predict(int(modes[y >> side, x >> side]), left, top, right, corner)) & 255
    return out.astype(np.uint8)


def predict(mode: int, left, top, right, corner):
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255], np.int32)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode <= 9:
        return _mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = _mean(left, top)
    half = mean - corner
    return np.clip(mean + np.sign(half) * (np.abs(half) // 2), 0, 255)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def cross_colour(img: np.ndarray, elements: np.ndarray, side: int, sign: int) -> np.ndarray:
    """sign 1 undoes the transform, -1 applies it."""
    h, w, _ = img.shape
    e = elements[np.arange(h)[:, None] >> side, np.arange(w)[None] >> side]
    red, green, blue = (img[..., c].astype(np.int32) for c in (R, G, B))
    delta = lambda t, c: _signed(t) * _signed(c) >> 5
    new = (red + sign * delta(e[..., B], green)) & 255
    plain = new if sign == 1 else red
    blue = (blue + sign * (delta(e[..., G], green) + delta(e[..., R], plain))) & 255
    return np.stack([new, green, blue, img[..., A]], -1).astype(np.uint8)


def _pack_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels of one file: (height, width, 4), red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    steps, w = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            side = bits.take(3) + 2
            steps.append((kind, read_pixels(bits, (w + (1 << side) - 1) >> side, (height + (1 << side) - 1) >> side, False), side, w))
        elif kind == PALETTE:
            n = bits.take(8) + 1
            colours = np.cumsum(read_pixels(bits, n, 1, False)[0].astype(np.int64), 0).astype(np.uint8)
            steps.append((kind, colours, _pack_bits(n), w))
            w = (w + (1 << _pack_bits(n)) - 1) >> _pack_bits(n)
        else:
            steps.append((kind, None, 0, w))
    img = read_pixels(bits, w, height, True)
    for kind, own, side, w in reversed(steps):
        if kind == PREDICTOR:
            img = unpredict(img, own[..., G], side)
        elif kind == CROSS_COLOUR:
            img = cross_colour(img, own, side, 1)
        elif kind == SUBTRACT_GREEN:
            img = img.copy()
            img[..., R] += img[..., G]
            img[..., B] += img[..., G]
        else:
            each = 8 >> side
            places = np.arange(w)
            index = img[:, places >> side, G] >> ((places & ((1 << side) - 1)) * each) & ((1 << each) - 1)
            img = np.vstack([own, np.zeros((256 - len(own), 4), np.uint8)])[index]
    return img


class Writer:
    """Bits, lowest first; whole bytes leave as they fill."""

    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.held |= value << self.n
        self.n += n
        if self.n >= 512:
            self.out += (self.held & ((1 << 512) - 1)).to_bytes(64, "little")
            self.held >>= 512
            self.n -= 512

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Many values of at most 32 bits each."""
        part = 1 << 16
        for lo in range(0, len(values), part):
            size = sizes[lo : lo + part].astype(np.int64)
            ends = np.cumsum(size)
            total = int(ends[-1])
            each = np.arange(total) - np.repeat(ends - size, size)
            ones = np.repeat(values[lo : lo + part].astype(np.int64), size) >> each & 1
            lead = np.unpackbits(np.frombuffer(self.held.to_bytes(64, "little"), np.uint8), bitorder="little")[: self.n]
            whole = np.packbits(np.concatenate([lead, ones.astype(np.uint8)]), bitorder="little").tobytes()
            total += self.n
            self.out += whole[: total // 8]
            self.n = total % 8
            self.held = whole[-1] if self.n else 0

    def data(self) -> bytes:
        return bytes(self.out) + self.held.to_bytes(-(-self.n // 8), "little")


def lengths_of(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of a prefix code for these counts, none over `most`."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts).tolist()
    if len(used) <= 1:
        out[used] = 1
        return out
    own, floor = counts[used].tolist(), 1
    while True:
        heap = [(max(c, floor), i) for i, c in enumerate(own)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for i in range(len(used), len(parent)):
            a, x = heapq.heappop(heap)
            b, y = heap[0]
            parent[x] = parent[y] = i
            heapq.heapreplace(heap, (a + b, i))
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= most:
            out[used] = depth[: len(used)]
            return out
        floor *= 2


def put_code(to: Writer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code; gives each symbol's number of bits and bits."""
    used, values = codes_of(lengths)
    bits = lengths.astype(np.int64)
    if len(used) == 1:
        bits = np.zeros_like(bits)  # a code of one symbol takes no bits
    if len(used) <= 2 and (not len(used) or used.max() < 256):
        symbols = used.tolist() or [0]
        to.put(1 | len(symbols) - 1 << 1 | 1 << 2, 3)
        for s in symbols:
            to.put(s, 8)
        return bits, values
    to.put(0, 1)
    if len(used) == 256 and (lengths[:256] == 8).all():  # one length for all: its own code takes no bits
        to.put(8, 4)
        for s in CODE_LENGTH_ORDER[:12]:
            to.put(int(s == 8), 3)
        if len(lengths) > 256:
            to.put(1, 1)
            to.put(3, 3)
            to.put(254, 8)
        else:
            to.put(0, 1)
        return bits, values
    # Lengths of used symbols as they are, runs of unused ones as one symbol each.
    items: list[tuple[int, int, int]] = []
    at = 0
    for symbol in [*used.tolist(), len(lengths)]:
        gap = symbol - at
        while gap >= 3:
            n = min(gap, 138)
            items.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            gap -= n
        items += [(0, 0, 0)] * gap
        if symbol < len(lengths):
            items.append((int(lengths[symbol]), 0, 0))
        at = symbol + 1
    own = lengths_of(np.bincount([i[0] for i in items], minlength=19), 7)
    if np.count_nonzero(own) == 1:
        own[0 if own[0] == 0 else 1] = 1
    to.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        to.put(int(own[s]), 3)
    to.put(0, 1)
    codes, sizes = codes_of(own)[1].tolist(), own.tolist()
    for n, extra, size in items:
        to.put(codes[n] | extra << sizes[n], sizes[n] + size)
    return bits, values


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, number of extra bits and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, high - 1, v & ((1 << (high - 1)) - 1)


def put_pixels(to: Writer, img: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    h, w, _ = img.shape
    px = img.reshape(-1, 4).astype(np.int64)
    argb = (px[:, A] << 24 | px[:, R] << 16 | px[:, G] << 8 | px[:, B]).tolist()
    items: list[tuple] = []
    cache: dict[int, int] = {}
    last: dict[int, int] = {}
    i = 0
    while i < len(argb):
        p, run = argb[i], 0
        if references and p in last:
            far = i - last[p]
            while i + run < len(argb) and run < 4096 and argb[i + run] == argb[i + run - far]:
                run += 1
        slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if run >= 3:
            items.append(("run", run, far + 120))
        elif cache_bits and cache.get(slot) == p:
            items.append(("cache", slot))
        else:
            items.append(("literal", *px[i].tolist()))
        for q in argb[i : i + max(run if run >= 3 else 1, 1)]:
            last[q] = i
            if cache_bits:
                cache[(CACHE_FACTOR * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
            i += 1
    to.put(int(cache_bits > 0), 1)
    if cache_bits:
        to.put(cache_bits, 4)
    if main:
        to.put(0, 1)
    counts = [np.zeros(n, np.int64) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for kind, *x in items:
        if kind == "literal":
            for c, v in zip((1, 0, 2, 3), x):
                counts[c][v] += 1
        elif kind == "cache":
            counts[0][280 + x[0]] += 1
        else:
            counts[0][256 + _prefix_of(x[0])[0]] += 1
            counts[4][_prefix_of(x[1])[0]] += 1
    codes = [list(zip(*(x.tolist() for x in put_code(to, lengths_of(c, 15))))) for c in counts]
    for kind, *x in items:
        if kind == "literal":
            for c, v in zip((0, 1, 2, 3), (x[G], x[R], x[B], x[A])):
                to.put(codes[c][v][1], codes[c][v][0])
        elif kind == "cache":
            to.put(codes[0][280 + x[0]][1], codes[0][280 + x[0]][0])
        else:
            for c, base, v in ((0, 256, x[0]), (4, 0, x[1])):
                s, n, extra = _prefix_of(v)
                to.put(codes[c][base + s][1], codes[c][base + s][0])
                to.put(extra, n)


def _header(width: int, height: int) -> Writer:
    to = Writer()
    for value, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        to.put(value, n)
    return to


def _flat_codes(to: Writer) -> Writer:
    """No transform, no cache, one group of 8-bit codes."""
    to.put(0, 3)
    for size in (280, 256, 256, 256):
        lengths = np.zeros(size, np.uint8)
        lengths[:256] = 8
        put_code(to, lengths)
    put_code(to, np.zeros(40, np.uint8))
    return to


def _file(stream: bytes) -> bytes:
    stream = b"\x2f" + stream
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


_FLAT: dict[tuple[int, int], tuple[bytes, int]] = {}


def encode(img: np.ndarray, *, transforms: tuple = (), cache_bits: int = 0, references: bool = False, flat: bool = True) -> bytes:
    """A file of these pixels (height, width, 4). transforms: (kind, what it needs) in the order of writing: (PREDICTOR, modes, side), (CROSS_COLOUR, elements, side), (SUBTRACT_GREEN,), (PALETTE,)."""
    h, w, _ = img.shape
    if flat and not transforms and not cache_bits and not references:
        if (w, h) not in _FLAT:
            if len(_FLAT) > 20_000:
                _FLAT.clear()
            to = _flat_codes(_header(w, h))
            _FLAT[w, h] = to.data(), len(to.out) * 8 + to.n
        held, n = _FLAT[w, h]
        k = n % 8
        data = _REVERSED[img.reshape(-1, 4)[:, [1, 0, 2, 3]].ravel()]
        if k:
            out = np.zeros(len(data) + 1, np.uint8)
            out[:-1] = data << k
            out[1:] |= data >> (8 - k)
        else:
            out = data
        head = bytearray(held)
        if k:
            out[0] |= head.pop()
        return _file(bytes(head) + out.tobytes())
    to, src = _header(w, h), img
    for kind, *own in transforms:
        to.put(1, 1)
        to.put(kind, 2)
        if kind == SUBTRACT_GREEN:
            src = src.copy()
            src[..., R] -= src[..., G]
            src[..., B] -= src[..., G]
        elif kind == CROSS_COLOUR:
            elements, side = own
            to.put(side - 2, 3)
            put_pixels(to, elements, False)
            src = cross_colour(src, elements, side, -1)
        elif kind == PREDICTOR:
            modes, side = own
            to.put(side - 2, 3)
            put_pixels(to, np.stack([np.zeros_like(modes), modes, np.zeros_like(modes), np.full_like(modes, 255)], -1), False)
            src = _residuals(src, modes, side)
        else:
            colours, index = np.unique(src.reshape(-1, 4), axis=0, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            to.put(len(colours) - 1, 8)
            put_pixels(to, np.diff(colours.astype(np.int64), axis=0, prepend=0).astype(np.uint8)[None], False)
            bits, index = _pack_bits(len(colours)), index.reshape(src.shape[:2])
            wide = (src.shape[1] + (1 << bits) - 1) >> bits
            packed = np.zeros((src.shape[0], wide), np.int64)
            for x in range(src.shape[1]):
                packed[:, x >> bits] |= index[:, x] << ((x & ((1 << bits) - 1)) * (8 >> bits))
            src = np.stack([np.zeros_like(packed), packed, np.zeros_like(packed), np.full_like(packed, 255)], -1).astype(np.uint8)
    to.put(0, 1)
    put_pixels(to, src, True, cache_bits, references)
    return _file(to.data())


def _residuals(img: np.ndarray, modes: np.ndarray, side: int) -> np.ndarray:
    h, w, _ = img.shape
    src, out = img.astype(np.int32), np.zeros_like(img, np.int32)
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = src[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                guess = src[y - 1, 0]
            else:
                guess = predict(int(modes[y >> side, x >> side]), src[y, x - 1], src[y - 1, x], src[y - 1, x + 1] if x + 1 < w else src[y, 0], src[y - 1, x - 1])
            out[y, x] = (src[y, x] - guess) & 255
    return out.astype(np.uint8)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, numbers of extra bits and extra bits of many lengths or distances."""
    v = values - 1
    high = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 0)
    small = v < 4
    size = np.where(small, 0, np.maximum(high - 1, 0))
    symbol = np.where(small, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1))
    return symbol, size, v & ((1 << size) - 1)


def _copies(b: np.ndarray, least: int = 7, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of back-references, taken greedily from the left.

    Each place looks at the last one with the same four bytes; as long as that distance stays the same, the match goes on.
    """
    n = len(b)
    if n < 8:
        return (np.empty(0, np.int64),) * 3
    x = b.astype(np.uint32)
    key = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    # By a 16-bit hash of the key, which numpy sorts by radix; only equal keys count.
    order = np.argsort((key * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16), kind="stable")
    ranked = key[order]
    far = np.zeros(n - 3, np.int64)
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    far[order[again]] = order[again] - order[again - 1]
    ends = np.flatnonzero(np.append(far[1:] != far[:-1], True))
    last = ends[np.searchsorted(ends, np.arange(n - 3))]
    length = last - np.arange(n - 3) + 4
    begin = np.flatnonzero((far > 0) & (length >= least))
    starts, at = [], 0
    picked = []
    for i, (p, m) in enumerate(zip(begin.tolist(), length[begin].tolist())):
        if p >= at:
            starts.append(i)
            picked.append(min(m, most))
            at = p + picked[-1]
    begin = begin[starts]
    return begin, np.array(picked, np.int64), far[begin]


def _bits(counts: np.ndarray) -> float:
    """Bits that the counts' own code needs at least."""
    c = counts[counts > 0].astype(np.float64)
    return float((c * np.log2(c.sum() / c)).sum())


def encode_samples(samples: np.ndarray, width: int = WIDE) -> bytes:
    """A file whose green channel holds the samples, by the cheapest of the writer's ways."""
    n = len(samples)
    counts = np.bincount(samples, minlength=280)
    if np.count_nonzero(counts) <= 16:
        img = np.zeros((n // width, width, 4), np.uint8)
        img[..., G], img[..., A] = samples.reshape(-1, width), 255
        return encode(img, transforms=((PALETTE,),), references=True)
    symbols, values, sizes = samples.astype(np.int64), None, None
    starts, lengths, fars = _copies(samples)
    fars_counts = np.zeros(40, np.int64)
    if len(starts):
        edge = np.zeros(n + 1, np.int64)
        edge[starts] += 1
        np.add.at(edge, starts + lengths, -1)
        token = np.cumsum(edge[:-1]) == 0
        token[starts] = True
        own, own_size, own_extra = _prefixes(lengths)
        to, to_size, to_extra = _prefixes(fars + 120)
        all_symbols = symbols.copy()
        all_symbols[starts] = 256 + own
        counts2, fars2 = np.bincount(all_symbols[token], minlength=280), np.bincount(to, minlength=40)
        if _bits(counts2) + _bits(fars2) + float(own_size.sum() + to_size.sum()) + 120 < _bits(counts):
            counts, fars_counts = counts2, fars2
            symbols = all_symbols[token]
            at = np.flatnonzero(symbols >= 256)
            values, sizes = (own_extra, to, to_extra), (own_size, to_size)
    to_ = _header(width, n // width)
    to_.put(0, 3)  # no transform, no cache, one group
    green, far_code = lengths_of(counts, MOST_BITS), lengths_of(fars_counts, MOST_BITS)
    codes = put_code(to_, green)
    for single in (0, 0, 255):  # red, blue and alpha: a code of one symbol
        to_.put(0b101 | single << 3, 11)
    far_bits, far_values = put_code(to_, far_code)
    bits, value = codes[0][symbols], codes[1][symbols]
    if values is not None:  # a copy's extra bits, distance code and its extra bits follow its symbol
        first = np.zeros((len(symbols), 3), np.int64)
        length = np.zeros((len(symbols), 3), np.int64)
        first[:, 0], length[:, 0] = value, bits
        first[at, 0] |= values[0] << bits[at]
        length[at, 0] += sizes[0]
        first[at, 1], length[at, 1] = far_values[values[1]], far_bits[values[1]]
        first[at, 2], length[at, 2] = values[2], sizes[1]
        value, bits = first.ravel(), length.ravel()
        some = bits > 0
        value, bits = value[some], bits[some]
    to_.put_all(value, bits)
    return _file(to_.data())


def store_bytes(payload: bytes) -> bytes:
    """Files, one after the other, that hold a payload of whole 64-byte blocks."""
    samples, most = np.frombuffer(payload, np.uint8), WIDE * MAX_SIDE
    return b"".join(encode_samples(samples[i : i + most]) for i in range(0, len(samples), most))


def samples_of(images: list[np.ndarray]) -> bytes:
    """The payload that the images hold."""
    return b"".join(i[..., G].tobytes() for i in images)


def load_images(media: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(decode(media[at : at + n]))
        at += n
    return out


def features(images: list[np.ndarray]) -> str:
    """Size, each channel's sum and number of values, and the sum of steps between neighbours."""
    px = np.concatenate([i.reshape(-1, 4) for i in images])
    sums = ",".join(str(int(x)) for x in px.sum(0, dtype=np.int64))
    kinds = ",".join(str(int(np.count_nonzero(np.bincount(px[:, c], minlength=256)))) for c in range(4))
    steps = int(np.abs(np.diff(px.ravel().astype(np.int16))).sum(dtype=np.int64))
    return f"{images[0].shape[1]}x{sum(i.shape[0] for i in images)};sums={sums};kinds={kinds};steps={steps}"


def _mapped(df: DataFrame, f, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                rows = [f(*r) for r in zip(*(c.to_pylist() for c in batch.slice(lo, 128).columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, padded to blocks, in lossless images."""

    def one(doc, text):
        raw = (text or "").encode()
        return doc, len(raw), store_bytes(raw + b"\0" * (-len(raw) % block if raw else block))

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return _mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), one, schema, "doc_id long, n_bytes long, media binary")


def load_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, samples (the green channel of the pixel arrays), feature: read back from the stored files."""

    def one(doc, n, media):
        images = load_images(media)
        return doc, n, media, samples_of(images), features(images)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("samples", pa.binary()), ("feature", pa.string())])
    return _mapped(stored.select("doc_id", "n_bytes", "media"), one, schema, "doc_id long, n_bytes long, media binary, samples binary, feature string")


def op8_webp_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = load_media(store_texts(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, octet_length(samples) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
