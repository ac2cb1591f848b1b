"""Lossless WebP (VP8L): a decoder for all of it, and an encoder for 8-bit grey strips.

``decode_argb`` reads any VP8L image: prefix codes and their groups, back-references, the colour cache, and the four
transforms (predictor, cross-colour, subtract-green, palette). ``decode_strips`` reads many images at once: images
whose red, blue and alpha have one value each (grey and palette images) advance in step, one symbol of every image at
a time, by table lookup; others go to decode_argb one by one. ``encode_strips`` writes grey strips at once, with
back-references to whole 16-pixel cells and one of three forms a strip: grey, grey with left prediction, or palette."""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

#: Pixels in a row, and rows in a strip at most.
WIDTH, ROWS = 64, 64
CELL = 16
_LIMIT = 11  # longest prefix code that the encoder writes

# Fixed values of the format.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Offsets of the short distance codes: nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
PREDICTOR, CROSS, GREEN, PALETTE = range(4)


# ---- prefix codes ------------------------------------------------------------------------------------------------


def code_lengths(freq: list[int], limit: int) -> list[int]:
    """Lengths of a complete prefix code; a single symbol gets length 1."""
    some = [k for k, f in enumerate(freq) if f]
    out = [0] * len(freq)
    if len(some) == 1:
        out[some[0]] = 1
        return out
    weight = [freq[k] for k in some]
    while True:
        heap = [(w, k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(some))
        new = len(some)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = [0] * new
        for k in range(new - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(some)]) <= limit:
            for k, s in enumerate(some):
                out[s] = depth[k]
            return out
        weight = [(w + 1) // 2 for w in weight]


@lru_cache(maxsize=32)
def _reversal(bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, dtype=np.int64)
    for k in range(bits):
        out |= ((np.arange(1 << bits) >> k) & 1) << (bits - 1 - k)
    return out


def tables(lengths: np.ndarray, bits: int) -> np.ndarray:
    """Lookup tables (a row an image) of complete codes: next ``bits`` bits -> symbol * 16 + length."""
    n, size = lengths.shape
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    own = np.take_along_axis(lengths, order, axis=1)
    fill = np.where(own > 0, 1 << (bits - np.minimum(own, bits)), 0)
    if (fill.sum(axis=1) != 1 << bits).any():
        raise ValueError("prefix code is not complete")
    flat = np.repeat((order * 16 + own).ravel(), fill.ravel()).reshape(n, 1 << bits)
    return flat[:, _reversal(bits)].astype(np.int32)


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes by row, first bit lowest."""
    n, size = lengths.shape
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    own = np.take_along_axis(lengths, order, axis=1)
    step = np.where(own > 0, 1 << (15 - own), 0)
    start = np.cumsum(step, axis=1) - step  # as 15-bit codes, first bit highest
    value = np.where(own > 0, _reversal(15)[np.minimum(start, 32767)], 0)
    out = np.zeros_like(lengths)
    np.put_along_axis(out, order, value, axis=1)
    return out


@lru_cache(maxsize=64)
def _small_table(lengths: tuple[int, ...]) -> tuple[list[int], int]:
    some = [k for k, n in enumerate(lengths) if n]
    if len(some) == 1:
        return [some[0] * 16], 0
    bits = max(lengths)
    return tables(np.array([lengths]), bits)[0].tolist(), bits


# ---- reading headers ---------------------------------------------------------------------------------------------


class Bits:
    """Bits of a byte string, first bit lowest."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        self.base, self.value = -1, 0

    def window(self) -> int:
        """The next 40 bits or more."""
        byte = self.at >> 3
        if not 0 <= byte - self.base <= 24 or self.base < 0:
            self.base, self.value = byte, int.from_bytes(self.data[byte : byte + 32], "little")
        return self.value >> (self.at - 8 * self.base)

    def read(self, n: int) -> int:
        out = self.window() & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: tuple[list[int], int]) -> int:
        entry = table[0][self.window() & ((1 << table[1]) - 1)]
        self.at += entry & 15
        return entry >> 4

    def value_of(self, code: int) -> int:
        if code < 4:
            return code + 1
        extra = (code - 2) >> 1
        return ((2 + (code & 1)) << extra) + self.read(extra) + 1


def read_code(bits: Bits, size: int) -> list[int]:
    """Code lengths of an alphabet; a lone symbol has length 1."""
    out = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        out[bits.read(8 if wide else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return out
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[ORDER[k]] = bits.read(3)
    table = _small_table(tuple(own))
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(table)
        if s < 16:
            out[at] = s
            at += 1
            before = s or before
        else:
            n = (3 + bits.read(2)) if s == 16 else (3 + bits.read(3)) if s == 17 else (11 + bits.read(7))
            if at + n > size:
                raise ValueError("code lengths run over")
            if s == 16:
                out[at : at + n] = [before] * n
            at += n
    return out


# ---- one image, all of the format --------------------------------------------------------------------------------


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _entropy_coded(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, group_bits, choice = 1, 0, None
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        image = _entropy_coded(bits, _blocks(width, group_bits), _blocks(height, group_bits), False)
        choice = (image >> 8) & 0xFFFF
        groups = int(choice.max()) + 1
        choice = choice.reshape(_blocks(height, group_bits), -1).tolist()
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    own = [[_small_table(tuple(read_code(bits, s))) for s in sizes] for _ in range(groups)]
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    out: list[int] = []
    total, group = width * height, own[0]
    while len(out) < total:
        if choice is not None:
            y, x = divmod(len(out), width)
            group = own[choice[y >> group_bits][x >> group_bits]]
        s = bits.symbol(group[0])
        if s < 256:
            red, blue = bits.symbol(group[1]), bits.symbol(group[2])
            new = [bits.symbol(group[3]) << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = bits.value_of(s - 256)
            far = bits.value_of(bits.symbol(group[4]))
            if far <= 120:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            else:
                far -= 120
            if far > len(out):
                raise ValueError("back-reference before the first pixel")
            length = min(length, total - len(out))
            start = len(out) - far
            new = [out[start + k % far] for k in range(length)]
        else:
            new = [cache[s - 280]]
        out += new
        if cache_bits:
            for p in new:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
    return np.array(out, dtype=np.int64)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], axis=-1)


def _packed(c: np.ndarray) -> np.ndarray:
    c = c & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, left: list[int], top: list[int], corner: list[int], right: list[int]) -> list[int]:
    average = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return average(average(left, right), top)
        case 6:
            return average(left, corner)
        case 7:
            return average(left, top)
        case 8:
            return average(corner, top)
        case 9:
            return average(top, right)
        case 10:
            return average(average(left, corner), average(top, right))
        case 11:
            by_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
            by_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
            return left if by_left < by_top else top
        case 12:
            return [clamp(a + t - c) for a, t, c in zip(left, top, corner, strict=True)]
        case 13:
            mean = average(left, top)
            return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]
    return [255, 0, 0, 0]


def _unpredict(argb: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    modes = ((modes >> 8) & 15).reshape(_blocks(height, bits), -1)
    residual = _channels(argb).reshape(height, width, 4)
    if (modes == 1).all():  # each row from its left, the first column from above
        residual[0, 0, 0] += 255
        residual[:, 0] = residual[:, 0].cumsum(axis=0)
        return _packed(residual.cumsum(axis=1)).reshape(-1)
    rows = residual.tolist()
    modes = modes.tolist()
    for y in range(height):
        for x in range(width):
            if x == 0 and y == 0:
                p = [255, 0, 0, 0]
            elif y == 0:
                p = rows[0][x - 1]
            elif x == 0:
                p = rows[y - 1][0]
            else:
                right = rows[y - 1][x + 1] if x + 1 < width else rows[y][0]
                p = _predicted(modes[y >> bits][x >> bits], rows[y][x - 1], rows[y - 1][x], rows[y - 1][x - 1], right)
            rows[y][x] = [(a + b) & 255 for a, b in zip(rows[y][x], p, strict=True)]
    return _packed(np.array(rows)).reshape(-1)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255) - ((x & 128) << 1)


def _uncross(argb: np.ndarray, width: int, height: int, factors: np.ndarray, bits: int) -> np.ndarray:
    of = np.arange(width)[None, :] >> bits, np.arange(height)[:, None] >> bits
    f = _channels(factors).reshape(_blocks(height, bits), -1, 4)[of[1], of[0]].reshape(-1, 4)
    c = _channels(argb)
    red_to_blue, green_to_blue, green_to_red = (_signed(f[:, k]) for k in (1, 2, 3))
    green = _signed(c[:, 2])
    c[:, 1] += green_to_red * green >> 5
    c[:, 3] += (green_to_blue * green >> 5) + (red_to_blue * _signed(c[:, 1]) >> 5)
    return _packed(c)


def _unpalette(argb: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    bundle = _bundle(len(colours))
    index = ((argb >> 8) & 255).reshape(height, _blocks(width, bundle))
    each = 8 >> bundle
    index = (index[:, :, None] >> (np.arange(1 << bundle) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    return np.concatenate([colours, np.zeros(256, dtype=colours.dtype)])[index].reshape(-1)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _header(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return width, height


def _transforms(bits: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    found, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            own = bits.read(3) + 2
            found.append((kind, width, _entropy_coded(bits, _blocks(width, own), _blocks(height, own), False), own))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _packed(_channels(_entropy_coded(bits, n, 1, False)).cumsum(axis=0))
            found.append((kind, width, colours, 0))
            width = _blocks(width, _bundle(n))
        else:
            found.append((kind, width, None, 0))
    return found, width


def _inverted(argb: np.ndarray, height: int, transforms: list[tuple]) -> np.ndarray:
    for kind, width, data, own in reversed(transforms):
        if kind == PREDICTOR:
            argb = _unpredict(argb, width, height, data, own)
        elif kind == CROSS:
            argb = _uncross(argb, width, height, data, own)
        elif kind == GREEN:
            c = _channels(argb)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            argb = _packed(c)
        else:
            argb = _unpalette(argb, width, height, data)
    return argb


def decode_argb(data: bytes) -> np.ndarray:
    """Height x width pixels, each alpha, red, green, blue."""
    bits = Bits(data)
    width, height = _header(bits)
    transforms, coded = _transforms(bits, width, height)
    argb = _inverted(_entropy_coded(bits, coded, height, True), height, transforms)
    return _channels(argb).reshape(height, width, 4).astype(np.uint8)


# ---- many images in step -----------------------------------------------------------------------------------------


class _Plan:
    """What stands before an image's pixels, if only its green code and back-references vary."""

    def __init__(self, data: bytes) -> None:
        bits = self.bits = Bits(data)
        self.width, self.height = _header(bits)
        self.transforms, self.coded = _transforms(bits, self.width, self.height)
        self.simple = not bits.read(1) and not bits.read(1)
        if self.simple:
            self.green = read_code(bits, 280)
            rest = [read_code(bits, 256) for _ in range(3)]
            self.far = read_code(bits, 40)
            self.simple = all(sum(map(bool, r)) == 1 for r in rest) and sum(map(bool, self.green)) > 1 and not any(t[0] == CROSS for t in self.transforms)
            if self.simple:
                self.red, self.blue, self.alpha = (r.index(1) for r in rest)


def decode_strips(images: list[bytes]) -> list[np.ndarray]:
    """The green samples (height x width) of each image; grey images have no others."""
    plans = [_Plan(d) for d in images]
    out: list[np.ndarray | None] = [None] * len(images)
    by_bits: dict[int, list[int]] = {}
    for k, p in enumerate(plans):
        if p.simple:
            by_bits.setdefault(max(_LIMIT, max(p.green)), []).append(k)
        else:
            out[k] = decode_argb(images[k])[:, :, 2]
    for bits, own in by_bits.items():
        most = max(1, (1 << 23) >> bits)
        for at in range(0, len(own), most):
            part = own[at : at + most]
            for k, green in zip(part, _in_step([images[k] for k in part], [plans[k] for k in part], bits), strict=True):
                p = plans[k]
                kinds = [t[0] for t in p.transforms]
                if kinds == [GREEN] and p.red == p.blue == 0:
                    out[k] = green.reshape(p.height, p.width)
                elif kinds == [GREEN, PREDICTOR] and p.red == p.blue == 0 and p.alpha == 0 and (p.transforms[1][2] >> 8 & 15 == 1).all():
                    rows = green.reshape(p.height, p.width).copy()
                    rows[:, 0] = rows[:, 0].cumsum(dtype=np.uint8)
                    out[k] = rows.cumsum(axis=1, dtype=np.uint8)
                else:
                    argb = p.alpha << 24 | p.red << 16 | green.astype(np.int64) << 8 | p.blue
                    argb = _inverted(argb, p.height, p.transforms)
                    out[k] = (argb >> 8 & 255).astype(np.uint8).reshape(p.height, p.width)
    return out


def _in_step(images: list[bytes], plans: list[_Plan], bits: int) -> list[np.ndarray]:
    n = len(images)
    table = tables(np.array([p.green for p in plans]), bits).reshape(-1)
    lone = np.array([sum(map(bool, p.far)) == 1 for p in plans])
    far_lengths = np.array([p.far for p in plans])
    only = far_lengths.argmax(axis=1)
    far_bits = max(1, int(far_lengths.max()))
    far_lengths[lone | (far_lengths.sum(axis=1) == 0)] = 0
    far_lengths[(far_lengths.sum(axis=1) == 0), :2] = 1  # unread
    far_table = tables(far_lengths, far_bits).reshape(-1)
    data = np.frombuffer(b"".join(images) + bytes(8), dtype=np.uint8)
    window = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        window |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    first = np.cumsum([0, *map(len, images)])[:-1]
    place = first * 8 + np.array([p.bits.at for p in plans])
    size = np.array([p.coded * p.height for p in plans])
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    lane, to, end, width = np.arange(n), start.copy(), start + size, np.array([p.coded for p in plans])
    base, mask = lane << bits, np.uint32((1 << bits) - 1)

    def read(at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (window[at >> 3] >> (at & 7).astype(np.uint32) & ((1 << count) - 1).astype(np.uint32)).astype(np.int64)

    def value(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.maximum((code - 2) >> 1, 0)
        # at most 18 bits: always inside one window
        return np.where(code < 4, code, (2 + (code & 1) << extra) + read(at, extra)) + 1, at + extra

    while len(lane):
        entry = table[base + (window[place >> 3] >> (place & 7).astype(np.uint32) & mask)]
        symbol = entry >> 4
        place = place + (entry & 15)
        far = symbol >= 256
        if far.any():
            at = np.flatnonzero(far)
            here = np.flatnonzero(~far)
            out[to[here]] = symbol[here]
            to[here] += 1
            length, p = value(symbol[at] - 256, place[at])
            own = lane[at]
            found = far_table[(own << far_bits) + read(p, np.full(len(at), far_bits))]
            code = np.where(lone[own], only[own], found >> 4)
            p = p + np.where(lone[own], 0, found & 15)
            distance, place[at] = value(code, p)
            short = distance <= 120
            if short.any():
                near = np.array(NEAR)[np.minimum(distance, 120) - 1]
                distance = np.where(short, np.maximum(1, near[:, 0] + near[:, 1] * width[own]), distance - 120)
            else:
                distance = distance - 120
            if (distance > to[at] - start[own]).any():
                raise ValueError("back-reference before the first pixel")
            length = np.minimum(length, end[at] - to[at])
            step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            source = np.repeat(to[at] - distance, length) + step % np.repeat(distance, length)
            out[np.repeat(to[at], length) + step] = out[source]
            to[at] += length
        else:
            out[to] = symbol
            to += 1
        done = to >= end
        if done.any():
            stay = ~done
            lane, to, end, base, place = lane[stay], to[stay], end[stay], base[stay], place[stay]
    return [out[a : a + s] for a, s in zip(start.tolist(), size.tolist(), strict=True)]


# ---- encoder -----------------------------------------------------------------------------------------------------

#: A complete code for code lengths: 13 of four bits, 6 of five.
_LENGTH_CODE = np.array([4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5, 4, 4])
_LENGTH_BITS = codes(_LENGTH_CODE[None])[0].tolist()


class _Out:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def lone(self, symbol: int) -> None:
        self.put(1, 1), self.put(0, 1)
        wide = symbol > 1
        self.put(wide, 1), self.put(symbol, 8 if wide else 1)

    def code(self, lengths: list[int]) -> None:
        """A prefix code; a code of one symbol is written as such."""
        some = [k for k, n in enumerate(lengths) if n]
        if len(some) == 1 and some[0] < 256:
            self.lone(some[0])
            return
        if not some:
            self.lone(0)
            return
        value, n = 0, 1
        value |= 15 << n
        n += 4
        for k in ORDER:
            value |= int(_LENGTH_CODE[k]) << n
            n += 3
        n += 1  # all symbols follow
        at = 0
        for k in [*some, len(lengths)]:
            gap = k - at
            while gap > 2:
                if gap <= 10:
                    value |= (_LENGTH_BITS[17] | (gap - 3) << 4) << n
                    n, gap = n + 7, 0
                else:
                    run = min(gap, 138)
                    value |= (_LENGTH_BITS[18] | (run - 11) << 4) << n
                    n, gap = n + 11, gap - run
            while gap:
                value |= _LENGTH_BITS[0] << n
                n, gap = n + 4, gap - 1
            if k < len(lengths):
                own = lengths[k]
                value |= _LENGTH_BITS[own] << n
                n += int(_LENGTH_CODE[own])
            at = k + 1
        self.put(value, n)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, extra bits, how many) of values from 1."""
    d = value - 1
    high = np.floor(np.log2(np.maximum(d, 1))).astype(np.int64)
    second = (d >> np.maximum(high - 1, 0)) & 1
    small = d < 4
    extra = np.where(small, 0, high - 1)
    return np.where(small, d, 2 * high + second), np.where(small, 0, d & ((1 << extra) - 1)), extra


def _cells(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each 16-sample cell, how far back in its strip the same 16 samples stand first (0: nowhere before)."""
    n = len(data)
    h = np.concatenate([data.astype(np.uint64), np.zeros(CELL, dtype=np.uint64)])
    factor, span = 0x9E3779B97F4A7C15, 1
    while span < CELL:
        moved = h[span:] if span else h
        h = h[: len(moved)] * np.uint64(factor) + moved
        factor, span = factor * factor & (2**64 - 1), span * 2
    h = h[:n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    room = np.maximum(2 ** np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) * 2, 64)
    base = np.cumsum(room) - room
    strip = np.repeat(np.arange(len(size)), size)
    slot = base[strip] + ((h >> np.uint64(40)).astype(np.int64) & (room[strip] - 1))
    whole = np.arange(n) + CELL <= (start + size)[strip]
    seen = np.full(int(room.sum()), -1, dtype=np.int64)
    at = np.flatnonzero(whole)[::-1]
    seen[slot[at]] = at  # the first place wins
    q = np.arange(0, n, CELL)
    before = seen[slot[q]]
    good = (before >= 0) & (before < q)
    same = (data[np.maximum(before, 0)[:, None] + np.arange(CELL)] == data.reshape(-1, CELL)).all(axis=1)
    return np.where(good & same, q - before, 0)


def encode_strips(strips: list[np.ndarray]) -> list[bytes]:
    """VP8L images of grey strips (rows x WIDTH bytes), each a function of its own samples only."""
    height = np.array([len(s) for s in strips])
    size = height * WIDTH
    start = np.cumsum(size) - size
    data = np.concatenate([s.reshape(-1) for s in strips])
    strip = np.repeat(np.arange(len(strips)), size)
    counts = np.bincount(strip * 256 + data, minlength=256 * len(strips)).reshape(-1, 256)
    # left prediction: rows from their left, the first column from above
    before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    column = np.flatnonzero(np.arange(len(data)) % WIDTH == 0)
    above = np.where(column - WIDTH >= start[strip[column]], data[np.maximum(column - WIDTH, 0)], 0)
    before[column] = above
    residual = data - before
    counts_left = np.bincount(strip * 256 + residual, minlength=256 * len(strips)).reshape(-1, 256)

    def entropy(c: np.ndarray) -> np.ndarray:
        p = c / np.maximum(c.sum(axis=1, keepdims=True), 1)
        return -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)

    n_colours = (counts > 0).sum(axis=1)
    palette = n_colours <= 16
    left = ~palette & (np.round(entropy(counts_left), 6) < 0.9 * np.round(entropy(counts), 6))
    rows, heads, alpha = [], [], []
    for k, (lo, n, by_colour, by_left) in enumerate(zip(start.tolist(), size.tolist(), palette.tolist(), left.tolist(), strict=True)):
        o = _image_head(WIDTH, int(height[k]))
        if by_colour:
            rows.append(_palette(data[lo : lo + n], o))
        else:
            rows.append((residual if by_left else data)[lo : lo + n])
            o.put(1, 1), o.put(GREEN, 2)
            if by_left:
                o.put(1, 1), o.put(PREDICTOR, 2), o.put(4, 3), o.put(0, 1)  # one mode, 1, for blocks of 64 x 64
                for s in (1, 0, 0, 0, 0):
                    o.lone(s)
        o.put(0, 1)
        heads.append(o)
        alpha.append(0 if by_left or by_colour else 255)
    return _coded(rows, heads, alpha)


def _image_head(width: int, height: int) -> _Out:
    o = _Out()
    o.put(0x2F, 8), o.put(width - 1, 14), o.put(height - 1, 14), o.put(0, 4)
    return o


def _palette(samples: np.ndarray, o: _Out) -> np.ndarray:
    """Writes the palette of grey samples and returns their packed indexes."""
    colours, index = np.unique(samples, return_inverse=True)
    o.put(1, 1), o.put(PALETTE, 2), o.put(len(colours) - 1, 8)
    o.put(0, 1)  # the palette's own image: differences of grey colours, no cache
    steps = np.diff(colours.astype(np.int64), prepend=0) & 255
    lengths = code_lengths(np.bincount(steps, minlength=280).tolist(), _LIMIT)
    alphas = np.array([255] + [0] * (len(colours) - 1))
    a_lengths = code_lengths(np.bincount(alphas, minlength=256).tolist(), _LIMIT)
    for c in (lengths, lengths[:256], lengths[:256], a_lengths, []):
        o.code(c) if c else o.lone(0)
    bits, a_bits = codes(np.array([lengths]))[0], codes(np.array([a_lengths]))[0]
    one, a_one = sum(map(bool, lengths)) == 1, sum(map(bool, a_lengths)) == 1
    for s, a in zip(steps.tolist(), alphas.tolist(), strict=True):
        for _ in range(0 if one else 3):
            o.put(int(bits[s]), lengths[s])
        if not a_one:
            o.put(int(a_bits[a]), a_lengths[a])
    bundle = _bundle(len(colours))
    each = 8 >> bundle
    index = index.reshape(-1, 1 << bundle) << (np.arange(1 << bundle) * each)
    return index.sum(axis=1).astype(np.uint8)


def _coded(rows: list[np.ndarray], heads: list[_Out], alpha: list[int]) -> list[bytes]:
    """Images whose green samples are ``rows``, red and blue 0, behind their heads."""
    n = len(rows)
    size = np.array([len(r) for r in rows])
    whole = -(-size // CELL) * CELL  # cells are looked for in padded rows; a padded cell is never a copy
    start = np.cumsum(whole) - whole
    data = np.zeros(int(whole.sum()), dtype=np.uint8)
    for r, a in zip(rows, start, strict=True):
        data[a : a + len(r)] = r
    strip = np.repeat(np.arange(n), whole)
    inside = np.arange(len(data)) - start[strip] < size[strip]
    back = _cells(data, start, whole)
    back[~inside[CELL - 1 :: CELL]] = 0
    cell_strip = strip[::CELL]
    # runs of cells with one distance, at most 4096 samples
    k = np.arange(len(back))
    begins = (back > 0) & ((np.concatenate([[0], back[:-1]]) != back) | (np.concatenate([[-1], cell_strip[:-1]]) != cell_strip))
    run_of = np.cumsum(begins) - 1
    begin_at = np.flatnonzero(begins)
    if len(begin_at):
        into = k - begin_at[np.maximum(run_of, 0)]
        begins |= (back > 0) & (into % (4096 // CELL) == 0)
        begin_at = np.flatnonzero(begins)
        run_of = np.cumsum(begins) - 1
        cells = np.bincount(run_of[back > 0], minlength=len(begin_at))
    else:
        cells = np.zeros(0, dtype=np.int64)
    literal = np.flatnonzero(np.repeat(back == 0, CELL) & inside)
    key = strip[literal] * 280 + data[literal]
    len_code, len_extra, len_bits = _prefix(cells * CELL)
    far_code, far_extra, far_bits = _prefix(back[begin_at] + 120)
    run_strip = cell_strip[begin_at]

    green = np.bincount(key, minlength=280 * n)
    green += np.bincount(run_strip * 280 + 256 + len_code, minlength=280 * n)
    far = np.bincount(run_strip * 40 + far_code, minlength=40 * n).reshape(n, 40)
    green_lengths = np.array([code_lengths(f, _LIMIT) for f in green.reshape(n, 280).tolist()])
    far_lengths = np.array([code_lengths(f, _LIMIT) if any(f) else f for f in far.tolist()])
    green_codes, far_codes = codes(green_lengths), codes(far_lengths)
    for o, g, f, a in zip(heads, green_lengths.tolist(), far_lengths.tolist(), alpha, strict=True):
        o.put(0, 2)  # no colour cache, one group of codes
        o.code(g)
        o.lone(0), o.lone(0), o.lone(a)
        o.code(f)
    one_green, one_far = (green_lengths > 0).sum(axis=1) == 1, (far_lengths > 0).sum(axis=1) == 1
    one_green &= green_lengths[:, :256].any(axis=1)  # a lone length code can't be written as a lone symbol
    green_lengths[one_green] = 0
    far_lengths[one_far] = 0

    # items: a literal, or a copy's length, its extra bits, its distance and those of it
    items = np.zeros(len(data), dtype=np.int8)
    items[literal] = 1
    items[begin_at * CELL] = 4
    at = np.cumsum(items, dtype=np.int64)
    ends = at[start + whole - 1]
    at -= items
    value, bits = np.zeros(int(ends[-1]), dtype=np.int64), np.zeros(int(ends[-1]), dtype=np.int64)
    entry = (green_codes << 4 | green_lengths).ravel()[key]
    where = at[literal]
    value[where], bits[where] = entry >> 4, entry & 15
    where = at[begin_at * CELL]
    value[where], bits[where] = green_codes[run_strip, 256 + len_code], green_lengths[run_strip, 256 + len_code]
    value[where + 1], bits[where + 1] = len_extra, len_bits
    value[where + 2], bits[where + 2] = far_codes[run_strip, far_code], far_lengths[run_strip, far_code]
    value[where + 3], bits[where + 3] = far_extra, far_bits
    n_items = np.diff(ends, prepend=0)
    place = np.cumsum(bits)
    done = np.concatenate([[0], place])[ends]  # bits up to each strip's end
    place -= bits
    body = np.diff(done, prepend=0)
    head = np.array([o.n for o in heads])
    n_bytes = (head + body + 7) // 8
    first = np.cumsum(n_bytes) - n_bytes
    place += np.repeat(first * 8 + head - (done - body), n_items)
    value <<= place & 7
    place >>= 3
    out = np.bincount(place, value & 255, minlength=int(n_bytes.sum()) + 4)
    for k in (1, 2):  # no item has more than 15 bits
        out[k:] += np.bincount(place, value >> (8 * k) & 255, minlength=len(out))[: len(out) - k]
    stream = out[: int(n_bytes.sum())].astype(np.uint8)
    for o, a in zip(heads, first.tolist(), strict=True):
        own = np.frombuffer(o.value.to_bytes((o.n + 7) // 8, "little"), dtype=np.uint8)
        stream[a : a + len(own)] |= own
    raw = stream.tobytes()
    return [raw[a : a + b] for a, b in zip(first.tolist(), n_bytes.tolist(), strict=True)]


# ---- container ---------------------------------------------------------------------------------------------------


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def webp_file(strips: list[tuple[int, int, bytes]]) -> bytes:
    """A WebP file of one image, or of strips (width, height, VP8L) one under the other as frames that stay."""
    if len(strips) == 1:
        body = _chunk(b"VP8L", strips[0][2])
    else:
        width, height = strips[0][0], sum(h for _, h, _ in strips)
        three = lambda v: struct.pack("<I", v)[:3]
        parts = [_chunk(b"VP8X", b"\x02\0\0\0" + three(width - 1) + three(height - 1)), _chunk(b"ANIM", bytes(6))]
        y = 0
        for w, h, data in strips:  # not blended, not disposed of
            parts.append(_chunk(b"ANMF", three(0) + three(y // 2) + three(w - 1) + three(h - 1) + three(0) + b"\x02" + _chunk(b"VP8L", data)))
            y += h
        body = b"".join(parts)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def webp_images(data: bytes) -> list[bytes]:
    """The VP8L images of a file, in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")

    def chunks(at: int, end: int):
        while at + 8 <= end:
            size = struct.unpack_from("<I", data, at + 4)[0]
            yield data[at : at + 4], at + 8, at + 8 + size
            at += 8 + size + (size & 1)

    out = []
    for name, lo, hi in chunks(12, len(data)):
        if name == b"VP8L":
            out.append(data[lo:hi])
        elif name == b"ANMF":
            out += [data[a:b] for inner, a, b in chunks(lo + 16, hi) if inner == b"VP8L"]
    return out
