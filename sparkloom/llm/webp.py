"""Lossless WebP: a decoder of the whole format, an encoder of byte samples, and columns of both.

The decoder reads prefix codes (simple and normal, with meta codes), back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Where there is one group of codes, every bit is looked
up, as an array, as if a pixel began there, and a walk from the first bit on says where pixels do. With meta codes the place in the image says
which codes hold, so their tokens are read one by one. Back-references and the colour cache both name an earlier pixel, whatever
its colour; all are followed by doubling. The predictor goes over the image in slanting lines of pixels that don't depend on each other.

The encoder stores bytes as grey 8-bit samples, 64 to a row, behind a subtract-green transform: literals and back-references
to the last place with the same hash of `LEAST_MATCH` bytes, if those are the same, both in prefix codes made for the image. Where they
pay, by an estimate, there is one more transform: a palette for at most 16 different bytes, which packs several samples into a pixel, or the predictor (left or
up). The other means of the format can't pay for grey samples: their colour is one number, which its own prefix code names. A payload over
64 x 16384 bytes becomes several images one after the other.

Null and empty inputs: `store_texts` counts a null text as empty, whose payload is 64 zero bytes; `decode_media` gives
nulls for a null, broken or too large image, and says in `error` what is wrong. Equal texts give equal values.
"""

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import blocks, kernels

#: Fixed values of the format: the order of the code-length codes' lengths, and the largest side.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
SIDE = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Near pixels by distance code: by how far they are, then by how far sideways, the left one first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))

WIDTH = 64
UNIT = 64
#: decode_media hands on its rows when it has so many bytes of pixels, and takes images of so many pixels at most unless it is told otherwise.
PIXEL_BYTES, MAX_PIXELS = 64 << 20, 1 << 24
#: Bytes of a back-reference at least, and at most (the format's bound); the greatest distance whose code the format has.
LEAST_MATCH, MOST_MATCH, MOST_DISTANCE = 6, 4096, (1 << 20) - 120
#: Bits of a prefix code that the encoder makes, and bits of a stream that the decoder looks up at once.
CODE_BITS, SEGMENT = 10, 1 << 17
#: Bits that the predictor must save, about: those of its own image; and the rows from which its gain is estimated.
PREDICTOR_BITS, ESTIMATED_ROWS = 64, 16
#: Bits that a pixel or a back-reference has at most, and more.
TOKEN_BITS = 64

_reverse = sum(((np.arange(1 << 15) >> k) & 1) << (14 - k) for k in range(15))
_near = np.array(NEAR)
_each = np.arange(SEGMENT + TOKEN_BITS)


class Broken(ValueError):
    """The bytes aren't a lossless WebP image."""


class Bits:
    """Bits of bytes, the lowest first."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data, "little") if len(data) < 4096 else None, len(data) * 8, 0
        self.data = data

    def peek(self, n: int) -> int:
        if self.value is not None:
            return (self.value >> self.at) & ((1 << n) - 1)
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + (n >> 3) + 2], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def fixed(self, n: int, k: int) -> np.ndarray:
        """n numbers of k bits (at most 8) each, the highest bit first."""
        if self.at + n * k > self.size:
            raise Broken("the data end too early")
        flags = np.unpackbits(np.frombuffer(self.data, np.uint8)[self.at >> 3 : (self.at + n * k + 7) >> 3], bitorder="little")
        flags = flags[self.at & 7 : (self.at & 7) + n * k].reshape(n, k)
        self.at += n * k
        return np.packbits(flags, axis=1)[:, 0] >> (8 - k)

    def read(self, n: int) -> int:
        found = self.peek(n)
        self.at += n
        if self.at > self.size:
            raise Broken("the data end too early")
        return found


class Code:
    """A canonical prefix code, from the length of each symbol (0: not used)."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise Broken("a prefix code has no symbol")
        own = lengths[used]
        order = np.lexsort((used, own))
        self.symbols, self.sizes = used[order], own[order].astype(np.int64)
        self.uniform = int(own[0]) if (own == own[0]).all() else None
        self.only, self.longest, self.table = None, int(own.max()), None
        if len(used) == 1:
            self.uniform, self.only, self.longest = 0, int(used[0]), 0
        elif int((1 << (self.longest - self.sizes)).sum()) != 1 << self.longest:
            raise Broken("a prefix code isn't complete")

    def lookup(self) -> np.ndarray:
        """Symbol << 4 | length for the next `longest` bits."""
        if self.only is not None:
            return np.array([self.only << 4])
        return np.repeat(self.symbols << 4 | self.sizes, 1 << (self.longest - self.sizes))[_reverse[: 1 << self.longest] >> (15 - self.longest)]


class Reader:
    """Symbols by a prefix code out of bits."""

    def __init__(self, lengths: np.ndarray):
        self.code = Code(lengths)

    def read(self, bits: Bits) -> int:
        if self.code.only is not None:
            return self.code.only
        if self.code.table is None:
            self.code.table = self.code.lookup().tolist()
        found = self.code.table[bits.peek(self.code.longest)]
        bits.at += found & 15
        if bits.at > bits.size:
            raise Broken("the data end too early")
        return found >> 4


@functools.lru_cache(1024)
def single(symbol: int, size: int) -> Reader:
    """The code of one symbol."""
    return Reader((np.arange(size) == symbol).astype(np.int64))


@functools.lru_cache(1024)
def code_of_lengths(count: int, packed: int) -> Reader:
    """The code of a code's lengths, from the first `count` of its own lengths in three bits each."""
    own = np.zeros(19, np.int64)
    own[LENGTH_ORDER[:count]] = packed >> 3 * np.arange(count) & 7
    return Reader(own)


def read_code(bits: Bits, size: int) -> Reader:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise Broken("a symbol is out of range")
        if not two:
            return single(symbols[0], size)
        lengths[symbols] = 1
        return Reader(lengths)
    count = 4 + bits.read(4)
    of_lengths, left = code_of_lengths(count, bits.read(3 * count)), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    k = of_lengths.code.uniform
    if k and of_lengths.code.symbols.max() < 16:  # no repeats: as many lengths, of k bits each
        n = min(left, size)
        lengths[:n] = of_lengths.code.symbols[bits.fixed(n, k)]
        return Reader(lengths)
    at, before = 0, 8
    while at < size and left > 0:
        left -= 1
        n = of_lengths.read(bits)
        if n < 16:
            lengths[at] = n
            before, at = n or before, at + 1
        else:
            times, value = (3 + bits.read(2), before) if n == 16 else (3 + bits.read(3), 0) if n == 17 else (11 + bits.read(7), 0)
            if at + times > size:
                raise Broken("too many code lengths")
            lengths[at : at + times] = value
            at += times
    return Reader(lengths)


def read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """The pixels of an entropy-coded image, as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Broken("the colour cache is too large")
    groups, block = None, 0
    if top and bits.read(1):
        block = bits.read(3) + 2
        groups = (read_pixels(bits, -(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF
    n_groups, n = 1 if groups is None else int(groups.max()) + 1, width * height
    if 5 * n_groups > bits.size - bits.at:  # a code has several bits
        raise Broken("the data end too early")
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    codes = [[read_code(bits, size) for size in sizes] for _ in range(n_groups)]
    if groups is None:
        own = [c.code for c in codes[0]]
        if own[0].only is not None and own[0].only < 256 and not any(c.longest for c in own[1:4]):
            return np.full(n, own[3].only << 24 | own[1].only << 16 | own[0].only << 8 | own[2].only, "<u4")
        return resolve(*scan_tokens(bits, own, n), width, n, cache_bits)
    return resolve(*walk_tokens(bits, codes, groups.tolist(), block, width, n), width, n, cache_bits)


def walk_tokens(bits: Bits, codes: list[list[Reader]], groups: list[int], block: int, width: int, n: int) -> tuple[np.ndarray, ...]:
    """The tokens of n pixels whose codes depend on their place: symbol, size, distance code, and colour of a literal."""
    raw = np.frombuffer(bits.data + bytes(16), np.uint8)
    eight = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,)).tolist()  # eight bytes from each byte on
    tables = [[(r.code.lookup().tolist(), (1 << r.code.longest) - 1) for r in group] for group in codes]
    across, at, end, done, found = -(-width >> block), bits.at, bits.size, 0, []
    while done < n:
        y, x = divmod(done, width)
        green, red, blue, alpha, far = tables[groups[(y >> block) * across + (x >> block)]]
        window = eight[at >> 3] >> (at & 7)  # 57 bits at least
        code = green[0][window & green[1]]
        symbol, used = code >> 4, code & 15
        if symbol < 256:
            code = red[0][window >> used & red[1]]
            used += code & 15
            colour = symbol << 8 | code >> 4 << 16
            code = blue[0][window >> used & blue[1]]
            used += code & 15
            colour |= code >> 4
            at += used
            code = alpha[0][eight[at >> 3] >> (at & 7) & alpha[1]]
            at += code & 15
            found.append((symbol, 1, 0, colour | code >> 4 << 24))
            done += 1
        elif symbol < 280:
            size, used = extended(window, symbol - 256, used)
            at += used
            window = eight[at >> 3] >> (at & 7)
            code = far[0][window & far[1]]
            back, used = extended(window, code >> 4, code & 15)
            at += used
            found.append((symbol, size, back, 0))
            done += size
        else:
            found.append((symbol, 1, 0, 0))
            at, done = at + used, done + 1
        if at > end:
            raise Broken("the data end too early")
    bits.at = at
    symbol, size, back, colour = np.array(found, np.int64).T
    return symbol, size, back, colour


def extended(window: int, code: int, used: int) -> tuple[int, int]:
    """The value of a length or distance code whose extra bits come behind `used` bits of the window, and how many are used then."""
    if code < 4:
        return code + 1, used
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + (window >> used & ((1 << extra) - 1)) + 1, used + extra


def distance(code: np.ndarray, width: int) -> np.ndarray:
    """How many pixels back the distances of back-references go."""
    near = _near[np.clip(code, 1, 120) - 1]
    return np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * width))


def resolve(symbol: np.ndarray, size: np.ndarray, far: np.ndarray, colour: np.ndarray, width: int, n: int, cache_bits: int) -> np.ndarray:
    """n pixels, as ARGB numbers, from tokens: each pixel points to the earlier one whose colour it has, and pointers are followed by doubling."""
    place = np.cumsum(size) - size
    if place[-1] + size[-1] != n:
        raise Broken("a back-reference leaves the image")
    out, literal, copy = np.zeros(n, "<u4"), symbol < 256, (symbol >= 256) & (symbol < 280)
    out[place[literal]] = colour[literal]
    if literal.all():
        return out
    source = np.arange(n)
    if copy.any():
        back, size, first = distance(far[copy], width), size[copy], place[copy]
        if (back > first).any():
            raise Broken("a back-reference leaves the image")
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        source[at] = at - np.repeat(back, size)
    if (symbol >= 280).any():
        at = place[symbol >= 280]
        slot = np.zeros(n, np.int64)
        slot[place[literal]] = slot_of(colour[literal], cache_bits)
        slot[at] = symbol[symbol >= 280] - 280
        # A slot that has had no colour holds 0, as if that were written there. A copy has the slot of its origin.
        origin = follow(source)
        cached = np.zeros(n, bool)
        cached[at] = True
        written = np.flatnonzero(~cached[origin])
        first = np.full(1 << cache_bits, n)
        np.minimum.at(first, slot[origin[written]], written)
        empty = at[first[slot[at]] > at]
        slot[empty], cached[empty] = 0, False
        slot = slot[origin]
        order = np.argsort(slot, kind="stable")
        before = np.zeros(n, np.int64)
        before[order[1:]] = order[:-1]
        at = at[cached[at]]
        source[at] = before[at]  # the last pixel before it that went into its slot
    source = follow(source)
    return out[source]


def slot_of(colour: np.ndarray, cache_bits: int) -> np.ndarray:
    return (0x1E35A7BD * colour & 0xFFFFFFFF) >> (32 - cache_bits)


def follow(source: np.ndarray) -> np.ndarray:
    """Where pointers to earlier places end up."""
    while True:  # each time, all go twice as far
        now = source[source]
        if (now == source).all():
            return now
        source = now


def extended_each(window: np.ndarray, at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of length or distance codes whose extra bits begin at the given places, and where those end."""
    extra = np.maximum(code - 2, 0) >> 1
    return np.where(code < 4, code, ((2 + (code & 1)) << extra) + (window[at] & ((1 << extra) - 1))) + 1, at + extra


def scan_tokens(bits: Bits, codes: list[Code], n: int) -> tuple[np.ndarray, ...]:
    """The tokens of n pixels in one group of codes: symbol, size, distance code, and colour of a literal."""
    tables, masks = [c.lookup() for c in codes], [(1 << c.longest) - 1 for c in codes]
    data, done, found = np.frombuffer(bits.data, np.uint8), 0, []
    while done < n:
        first = bits.at >> 3
        most = SEGMENT // 8 + 12  # a token and the last window go over the segment's end, and over that of the data
        own = data[first : first + most].astype(np.int64)
        if len(own) < most:
            own = np.append(own, np.zeros(min(12, most - len(own)), np.int64))
        window = ((own[:-3] | own[1:-2] << 8 | own[2:-1] << 16 | own[3:] << 24)[:, None] >> np.arange(8)).ravel()  # the bits from each bit on, 25 at least
        m = len(window) - TOKEN_BITS
        known = tables[0].take(window[:m] & masks[0])
        behind, planes = known & 15, [np.full(1, c.only) for c in codes[1:4]]
        behind += _each[:m]
        copies, cached = np.flatnonzero((known >= 256 << 4) & (known < 280 << 4)), known >= 280 << 4
        plain_end = behind[cached]
        size, at = extended_each(window, behind[copies], (known[copies] >> 4) - 256)
        code = tables[4][window[at] & masks[4]]
        far, end = extended_each(window, at + (code & 15), code >> 4)
        for k in (1, 2, 3):
            if masks[k]:
                code = tables[k][window[behind] & masks[k]]
                behind += code & 15
                planes[k - 1] = code >> 4
        behind[copies], behind[cached] = end, plain_end
        # The walk takes eight steps at a time. At m, behind the segment, it stays.
        one = np.append(behind, m)
        np.minimum(one, m, out=one)
        two = one.take(one)
        four = two.take(two)
        eight, at, each = four.take(four).data, bits.at & 7, []
        for _ in range(n - done):
            each.append(at)
            at = eight[at]
            if at >= m:
                break
        starts = np.array(each)
        for jump in (four, two, one):
            starts = np.stack([starts, jump.take(starts)], axis=1).ravel()
        starts = starts[starts < m]
        symbol = known[starts] >> 4
        own_size, own_far, copy = np.ones(len(starts), np.int64), np.zeros(len(starts), np.int64), np.flatnonzero((symbol >= 256) & (symbol < 280))
        place = np.searchsorted(copies, starts[copy])
        own_size[copy], own_far[copy] = size[place], far[place]
        total = done + np.cumsum(own_size)
        some = int(np.searchsorted(total, n)) + 1  # what follows the last pixel isn't of this image
        starts, symbol, own_size, own_far = starts[:some], symbol[:some], own_size[:some], own_far[:some]
        done = int(total[len(starts) - 1])
        bits.at = (first << 3) + int(behind[starts[-1]])
        if bits.at > bits.size:
            raise Broken("the data end too early")
        red, blue, alpha = (p[starts] if len(p) > 1 else p for p in planes)
        found.append((symbol, own_size, own_far, alpha << 24 | red << 16 | (symbol & 255) << 8 | blue))
    symbol, size, far, colour = map(np.concatenate, zip(*found, strict=True))
    return symbol, size, far, colour


def channels(argb: np.ndarray) -> np.ndarray:
    """ARGB numbers as rows of alpha, red, green, blue."""
    return np.ascontiguousarray(argb, "<u4")[..., None].view(np.uint8)[..., ::-1]


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, left: np.ndarray, up: np.ndarray, up_left: np.ndarray, up_right: np.ndarray) -> np.ndarray:
    """The prediction of pixels from their four neighbours (alpha, red, green, blue each)."""
    if mode == 1:
        return left
    if mode == 2:
        return up
    if mode == 3:
        return up_right
    if mode == 4:
        return up_left
    if mode == 5:
        return average(average(left, up_right), up)
    if mode == 6:
        return average(left, up_left)
    if mode == 7:
        return average(left, up)
    if mode == 8:
        return average(up_left, up)
    if mode == 9:
        return average(up, up_right)
    if mode == 10:
        return average(average(left, up_left), average(up, up_right))
    if mode == 11:
        nearer = np.abs(up - up_left).sum(axis=-1) < np.abs(left - up_left).sum(axis=-1)
        return np.where(nearer[..., None], left, up)
    if mode == 12:
        return np.clip(left + up - up_left, 0, 255)
    if mode == 13:
        mean = average(left, up)
        return np.clip(mean + np.trunc((mean - up_left) / 2).astype(np.int64), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)


def invert_predictor(image: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = image.shape
    out = image.astype(np.int64)
    out[0, 0, 0] += 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    if (modes == 1).all():
        out[:, 0] = np.cumsum(out[:, 0], axis=0)
        out[1:] = np.cumsum(out[1:], axis=1)
        return out.astype(np.uint8)
    if (modes == 2).all():
        return np.cumsum(out, axis=0).astype(np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], axis=0) & 255
    flat, across = out.reshape(-1, 4), -(-width >> block)
    # Pixels with the same x + 2 y depend only on those of smaller sums: left, above, and one further along above.
    for line in range(3, width + 2 * height - 2):
        y = np.arange(max(1, (line - width + 2) // 2), min(height - 1, (line - 1) // 2) + 1)
        x = line - 2 * y
        at = y * width + x
        near = flat[at - 1], flat[at - width], flat[at - width - 1], flat[at - width + 1]
        own = modes[(y >> block) * across + (x >> block)]
        guess = np.empty((len(at), 4), np.int64)
        for mode in np.unique(own).tolist():
            some = own == mode
            guess[some] = predicted(mode, *(v[some] for v in near))
        flat[at] = (flat[at] + guess) & 255
    return out.astype(np.uint8)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int8).astype(np.int64)


def invert_cross_colour(image: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = image.shape
    across = -(-width >> block)
    own = factors[(np.arange(height)[:, None] >> block) * across + (np.arange(width)[None, :] >> block)]
    _, red_to_blue, green_to_blue, green_to_red = np.moveaxis(signed(channels(own)), -1, 0)
    out = image.copy()
    green = signed(image[..., 2])
    out[..., 1] = (image[..., 1] + (green_to_red * green >> 5)) & 255
    out[..., 3] = (image[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * signed(out[..., 1]) >> 5)) & 255
    return out


def decode_chunk(data: bytes, max_pixels: int = SIDE * SIDE) -> np.ndarray:
    """Height x width x 4 samples (alpha, red, green, blue) of a VP8L chunk's data. An image of more pixels than max_pixels counts as broken."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise Broken("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if width * height > max_pixels:
        raise Broken(f"{width} x {height} are more than {max_pixels} pixels")
    bits.read(1)
    if bits.read(3):
        raise Broken("unknown version")
    todo: list[tuple] = []
    own_width = width
    while bits.read(1):
        kind = bits.read(2)
        if any(t[0] == kind for t in todo):
            raise Broken("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            todo.append((kind, read_pixels(bits, -(-own_width >> block), -(-height >> block), False), block, own_width))
        elif kind == SUBTRACT_GREEN:
            todo.append((kind,))
        else:
            size = bits.read(8) + 1
            colours = np.cumsum(channels(read_pixels(bits, size, 1, False)), axis=0, dtype=np.uint8)
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            todo.append((kind, colours, pack, own_width))
            own_width = -(-own_width >> pack)
    image = channels(read_pixels(bits, own_width, height, True)).reshape(height, own_width, 4).copy()
    for kind, *how in reversed(todo):
        if kind == PREDICTOR:
            image = invert_predictor(image, (how[0] >> 8) & 15, how[1])
        elif kind == CROSS_COLOUR:
            image = invert_cross_colour(image, how[0], how[1])
        elif kind == SUBTRACT_GREEN:
            image[..., 1] += image[..., 2]
            image[..., 3] += image[..., 2]
        else:
            colours, pack, full = how
            each = 8 >> pack
            x = np.arange(full)
            index = (image[:, x >> pack, 2] >> ((x & ((1 << pack) - 1)) * each)) & ((1 << each) - 1)
            image = np.concatenate([colours, np.zeros((256, 4), np.uint8)])[index]
    return image


def chunks(data: bytes) -> Iterator[bytes]:
    """The lossless chunks of one or more WebP files, one after the other."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise Broken("not a WebP file")
        end, k, found = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 12, False
        if end > len(data):
            raise Broken("the data end too early")
        while k + 8 <= end:
            size = int.from_bytes(data[k + 4 : k + 8], "little")
            if data[k : k + 4] == b"VP8L":
                found = True
                yield data[k + 8 : k + 8 + size]
            k += 8 + size + (size & 1)
        if not found:
            raise Broken("no lossless image")
        at = end


def decode(data: bytes) -> list[np.ndarray]:
    """The images of the given bytes, each height x width x 4 (alpha, red, green, blue)."""
    return [decode_chunk(c) for c in chunks(data)]


def shares(samples: np.ndarray) -> float:
    """About how many bits the samples take in a prefix code of their own."""
    often = np.bincount(samples, minlength=256)
    often = often[often > 0]
    return float(len(samples) * np.log2(len(samples)) - (often * np.log2(often)).sum())


def number_bits(*pairs: tuple[int, int]) -> np.ndarray:
    """Numbers of the given widths, the lowest bits first."""
    value, at = 0, 0
    for x, n in pairs:
        value |= x << at
        at += n
    return np.unpackbits(np.frombuffer(value.to_bytes(at // 8 + 1, "little"), np.uint8), bitorder="little")[:at]


def simple_code(symbol: int) -> list[tuple[int, int]]:
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def code_lengths(often: np.ndarray, most: int = CODE_BITS) -> np.ndarray:
    """Lengths of a prefix code for symbols that occur so often (0: not used): Huffman's, of flattened counts if it is too long."""
    used = np.flatnonzero(often)
    used = used[np.argsort(often[used], kind="stable")]
    n, out = len(used), np.zeros(len(often), np.int64)
    counts = often[used].tolist()
    while n > 1:
        weight, parent, leaf, inner = list(counts), [0] * (2 * n - 1), 0, n
        for new in range(n, 2 * n - 1):  # leaves and inner nodes both come in rising order
            total = 0
            for _ in range(2):
                if leaf < n and (inner == new or weight[leaf] <= weight[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                parent[k] = new
                total += weight[k]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            out[used] = depth[:n]
            return out
        counts = [(c + 1) // 2 for c in counts]
    out[used] = 1
    return out


def code_bits(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a prefix code is written; for each symbol its bits, the first one lowest, and how many."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return number_bits(*simple_code(int(used[0]) if len(used) else 0)), np.zeros_like(lengths), np.zeros_like(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    share = 1 << (15 - lengths[order])
    code = np.zeros_like(lengths)
    code[order] = _reverse[np.cumsum(share) - share]
    return np.concatenate([_four_bit_lengths, _four_bits[lengths].ravel()]), code, lengths


# Lengths below 16 in four bits each; red, blue and alpha that never change.
_four_bit_lengths = number_bits((0, 1), (15, 4), *((4 if s < 16 else 0, 3) for s in LENGTH_ORDER), (0, 1))
_plain_codes = {a: number_bits(*simple_code(0), *simple_code(0), *simple_code(a)) for a in (0, 255)}
_four_bits = (np.arange(16)[:, None] >> np.arange(3, -1, -1) & 1).astype(np.uint8)


def prefix_value(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of each length or distance, its extra bits, and how many."""
    w = v - 1
    top = np.frexp(np.maximum(w, 1))[1].astype(np.int64) - 1  # the place of the highest bit
    extra = np.where(v > 4, top - 1, 0)
    return np.where(v > 4, 2 * top + (w >> np.maximum(top - 1, 0) & 1), w), w & ((1 << extra) - 1), extra


def matches(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, sizes and distances of back-references that don't overlap, in order."""
    m = len(samples) - 7
    key = np.ndarray((m,), "<u8", np.ascontiguousarray(samples), strides=(1,)) << np.uint64(64 - 8 * LEAST_MATCH)
    order = np.argsort((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    far = np.zeros(m + 2, np.int64)
    far[1:-1][order[1:][same]] = (order[1:] - order[:-1])[same]
    far[far > MOST_DISTANCE] = 0
    edge = np.flatnonzero(far[1:] != far[:-1])
    # A run of places with one distance is one back-reference. It begins where those before it end.
    start, end, far = edge[:-1], edge[1:] + LEAST_MATCH - 1, far[1:][edge[:-1]]
    start, end, far = start[far > 0], end[far > 0], far[far > 0]
    if len(start):
        start = np.maximum(start, np.append(0, np.maximum.accumulate(end)[:-1]))
    long = end - start >= LEAST_MATCH
    start, end, far = start[long], end[long], far[long]
    pieces = -(-(end - start) // MOST_MATCH)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, end, far = np.repeat(start, pieces) + k * MOST_MATCH, np.repeat(end, pieces), np.repeat(far, pieces)
    return start, np.minimum(end - start, MOST_MATCH), far


@functools.lru_cache(1024)
def _top(height: int, mode: int) -> np.ndarray:
    """What precedes an image without a palette. mode: of the predictor for the whole image, or 0 for none."""
    size = (0x2F, 8), (WIDTH - 1, 14), (height - 1, 14), (0, 1), (0, 3), (1, 1), (SUBTRACT_GREEN, 2)
    plain = [p for v in (0, 0, 255, 0) for p in simple_code(v)]
    predictor = [(1, 1), (PREDICTOR, 2), (7, 3), (0, 1), *simple_code(mode), *plain] if mode else []
    return number_bits(*size, *predictor, (0, 1), (0, 1), (0, 1))


def _palette_top(height: int, values: np.ndarray) -> np.ndarray:
    """What precedes an image of places in a palette of the given samples, which rise."""
    size = number_bits((0x2F, 8), (WIDTH - 1, 14), (height - 1, 14), (0, 1), (0, 3), (1, 1), (SUBTRACT_GREEN, 2), (1, 1), (PALETTE, 2), (len(values) - 1, 8), (0, 1))
    steps = np.diff(values, prepend=0)
    head, code, length = code_bits(code_lengths(np.bincount(steps, minlength=280)))
    none = simple_code(0)
    # Red and blue never change; alpha is 255 at first, and its steps are 0: the simple code of two symbols.
    others = number_bits(*none, *none, (1, 1), (1, 1), (1, 1), (0, 8), (255, 8), *none)
    body = [number_bits((int(code[v]), int(length[v])), (int(k == 0), 1)) for k, v in enumerate(steps.tolist())]
    return np.concatenate([size, head, others, *body, number_bits((0, 1), (0, 1), (0, 1))])


def packed_by_palette(samples: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in the palette, as many to a pixel as the format has for its size."""
    pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    place = np.searchsorted(values, samples).reshape(-1, 1 << pack)
    return (place << np.arange(1 << pack) * (8 >> pack)).sum(axis=1).astype(np.uint8)


def residuals(samples: np.ndarray, mode: int) -> np.ndarray:
    """What the predictor of the left (1) or upper (2) neighbour leaves. The first row has only a left one, the first column only an upper one."""
    rows = samples.reshape(-1, WIDTH)
    out = np.diff(rows, axis=2 - mode, prepend=np.zeros_like(rows[:, :1] if mode == 1 else rows[:1]))
    out[0] = np.diff(rows[0], prepend=np.uint8(0))
    out[1:, 0] = np.diff(rows[:, 0])
    return out.ravel()


def encode_grey(samples: np.ndarray) -> bytes:
    """A WebP file of WIDTH samples a row."""
    height = len(samples) // WIDTH
    values = np.flatnonzero(np.bincount(samples, minlength=256))
    alpha = 255
    if len(values) <= 16:
        top, samples = _palette_top(height, values), packed_by_palette(samples, values)
    else:
        some, mode = samples[: WIDTH * ESTIMATED_ROWS], 0
        least = shares(some) - PREDICTOR_BITS
        for other in (1, 2):
            bits = shares(residuals(some, other))
            if bits < least:
                least, mode = bits, other
        if mode:
            samples, alpha = residuals(samples, mode), 0
        top = _top(height, mode)
    start, size, far = matches(samples)
    cover = np.zeros(len(samples) + 1, np.int8)
    cover[start] += 1
    cover[start + size] -= 1
    literal = np.flatnonzero(np.cumsum(cover[:-1], dtype=np.int8) == 0)
    order = np.argsort(np.concatenate([literal, start]), kind="stable")
    (size_code, far_code), (size_more, far_more), (size_extra, far_extra) = (x.reshape(2, -1) for x in prefix_value(np.concatenate([size, far + 120])))
    symbol = np.concatenate([samples[literal].astype(np.int64), 256 + size_code])[order]
    copies = np.flatnonzero(symbol >= 256)
    head, code, length = code_bits(code_lengths(np.bincount(symbol, minlength=280)))
    far_head, far_bits, far_length = code_bits(code_lengths(np.bincount(far_code, minlength=40)))
    value, width = np.zeros((len(symbol), 4), np.int64), np.zeros((len(symbol), 4), np.int64)
    value[:, 0], width[:, 0] = code[symbol], length[symbol]
    value[copies, 1:] = np.stack([size_more, far_bits[far_code], far_more], axis=1)
    width[copies, 1:] = np.stack([size_extra, far_length[far_code], far_extra], axis=1)
    some = np.flatnonzero(width.ravel())
    value, width = value.ravel()[some], width.ravel()[some]
    bit = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    body = (np.repeat(value, width) >> bit & 1).astype(np.uint8)
    data = np.packbits(np.concatenate([top, head, _plain_codes[alpha], far_head, body]), bitorder="little").tobytes()
    pad = len(data) & 1
    return b"RIFF" + (12 + len(data) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * pad


def encode_bytes(payload: bytes) -> bytes:
    """Bytes, a positive multiple of WIDTH, as one or more WebP files of grey samples."""
    samples = np.frombuffer(payload, np.uint8)
    return b"".join(encode_grey(samples[a : a + WIDTH * SIDE]) for a in range(0, len(samples), WIDTH * SIDE))


def decode_bytes(media: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The samples of all images, and their sides."""
    images = decode(media)
    return b"".join(np.ascontiguousarray(x[..., 2]).tobytes() for x in images), [x.shape[1::-1] for x in images]


def feature(samples: np.ndarray, sides: list[tuple[int, int]]) -> str:
    """Sides, mean, standard deviation and entropy of the samples."""
    n = np.bincount(samples, minlength=256)
    p = n[n > 0] / len(samples)
    values = np.arange(256)
    mean = float((n * values).sum() / len(samples))
    spread = float(max(0.0, (n * values**2).sum() / len(samples) - mean**2)) ** 0.5
    return f"{'+'.join(f'{w}x{h}' for w, h in sides)} mean {mean:.4f} deviation {spread:.4f} entropy {float(-(p * np.log2(p)).sum()):.4f}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's UTF-8 bytes, padded with zero bytes to a positive multiple of UNIT, as WebP. No exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.steps(batches):
            data, off = kernels.flat(batch.column("text"))
            size = np.diff(off)
            media = []
            for a, n in zip(off[:-1].tolist(), size.tolist(), strict=True):
                media.append(encode_bytes(data[a : a + n].tobytes().ljust(max(UNIT, -(-n // UNIT) * UNIT), b"\0")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """What op7 returns, from the stored bytes. No exchange."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, out = batch.column("media").to_pylist(), []
            for x in media:
                payload, sides = decode_bytes(x)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), feature(np.frombuffer(payload, np.uint8), sides)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c) for c in zip(*out, strict=True))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def decode_media(table: DataFrame, key: str, column: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """key, width, height, pixels (alpha, red, green, blue bytes, row by row), error, image: a row for each image in a binary column.

    image counts a value's images from 0. A null, empty or broken value has one row without an image, and so has, in place of the
    images from there on, one in which an image has more than max_pixels pixels. A column that is called like the key has
    underscores behind its name. No exchange.
    """
    own, media = blocks.columns([key, column])
    kept = table.select(own, media.cast("binary").alias(blocks.fresh("media", [key])))
    names = [key, *(blocks.fresh(c, [key]) for c in ("width", "height", "pixels", "error", "image"))]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int32())

    def rows_of(keys: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        place, *columns = zip(*out, strict=True) if out else [()] * 6
        return pa.RecordBatch.from_arrays([keys.take(pa.array(place, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                x, i = batch.column(1)[k].as_py(), 0
                try:
                    for c in chunks(x or b""):
                        image = decode_chunk(c, max_pixels)
                        out.append((k, image.shape[1], image.shape[0], image.tobytes(), None, i))
                        i, size = i + 1, size + image.nbytes
                        if size >= PIXEL_BYTES:
                            yield rows_of(batch.column(0), out)
                            out, size = [], 0
                    if not i:
                        out.append((k, None, None, None, None if x is None else "empty", None))
                except (ValueError, IndexError, OverflowError) as e:  # whatever a stream that isn't one leads to
                    out.append((k, None, None, None, str(e) or "broken", None))
            yield rows_of(batch.column(0), out)

    schema = T.StructType([T.StructField(key, kept.schema[key].dataType), *(T.StructField(c, t()) for c, t in zip(names[1:], (T.IntegerType, T.IntegerType, T.BinaryType, T.StringType, T.IntegerType), strict=True))])
    return kept.mapInArrow(run, schema)
