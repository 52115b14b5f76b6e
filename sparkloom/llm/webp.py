"""Lossless WebP columns: the decoder for the whole lossless format; the encoder is in webp_encode.

The decoder reads prefix codes (simple and normal, in groups by an entropy image), back-references with the plane
distances, and the colour cache; it then inverts the predictor, cross-colour, subtract-green and palette transforms and
gives pixels as an array (height, width, 4) of red, green, blue and alpha. What the codes tell is found at many places
at once; small images, and those of many groups of codes, are read symbol by symbol.

Payloads are three bytes a pixel, 64 pixels a row. A payload of more than 16384 rows is stored as images one after the
other.

Cases: null and empty text is one row of spaces. Equal texts give equal values. Bytes that are no lossless WebP raise
ValueError in `decode`; `pixels` gives null for them and for null. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_parts
from .webp_encode import LENGTH_ORDER, PLANE, UNIT, encode, encode_all, reversals, same_before

SPAN = 1 << 14  # bytes of codes that are read at once
FEW, MOST_GROUPS = 128, 4  # images of fewer pixels or of more groups of codes are read symbol by symbol
PLANE_X, PLANE_Y = np.array(PLANE).T


class Bits:
    """Reads bits, the lowest of each byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        first = at >> 3
        return int.from_bytes(self.data[first : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


class Prefix:
    """A canonical prefix code; a code of one symbol takes no bits."""

    def __init__(self, alphabet: int, used: list[int], sizes: list[int]):
        """used: the symbols in ascending order, sizes: how many bits each takes."""
        self.list: list[tuple[int, int]] | None = None
        self.alphabet = alphabet
        if len(used) < 2:
            self.only, self.most = used[0] if used else 0, 0
            self.symbols, self.sizes = np.array([self.only], np.int32), np.zeros(1, np.int32)
            return
        held = np.array(sizes, np.int32)
        order = held.argsort(kind="stable")
        self.only = None
        self.symbols, self.sizes = np.array(used, np.int32)[order], held[order]
        self.most = int(self.sizes[-1])
        if int((1 << (15 - self.sizes)).sum()) != 1 << 15:
            raise ValueError("a prefix code is not complete")

    @property
    def lengths(self) -> list[int]:
        out = np.zeros(self.alphabet, np.int32)
        out[self.symbols] = np.maximum(self.sizes, 1)
        return out.tolist()

    def table(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(size, symbol) of the code that the next `bits` bits begin with, by their value as a number read lowest bit first."""
        times = 1 << (bits - self.sizes)
        order = reversals(bits)
        return np.repeat(self.sizes, times)[order], np.repeat(self.symbols, times)[order]

    def both(self, bits: int) -> np.ndarray:
        """16 * symbol + size, in the order of `table`."""
        return (self.symbols << 4 | self.sizes).repeat(1 << (bits - self.sizes)).take(reversals(bits))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.list is None:
            sizes, symbols = self.table(self.most)
            self.list = list(zip(sizes.tolist(), symbols.tolist(), strict=True))
        at = bits.at
        first = at >> 3
        n, s = self.list[int.from_bytes(bits.data[first : first + 3], "little") >> (at & 7) & ((1 << self.most) - 1)]
        bits.at = at + n
        if bits.at > bits.end:
            raise ValueError("the image ends early")
        return s


def length_table(told: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """(size, symbol) of the code of code lengths by the next bits, and the mask of these."""
    used = sorted(x for x in told if x[0])
    if len(used) < 2:
        return [(0, used[0][1] if used else 0)], 0
    most = used[-1][0]
    table, at, turned = [(0, 0)] * (1 << most), 0, reversals(most).tolist()
    for n, s in used:
        if at >> most:
            at += 1
            break
        table[turned[at] :: 1 << n] = [(n, s)] * (1 << (most - n))
        at += 1 << (most - n)
    if at != 1 << most:
        raise ValueError("a prefix code is not complete")
    return table, (1 << most) - 1


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = sorted({s for s in ([first, bits.read(8)] if two else [first]) if s < alphabet})
        return Prefix(alphabet, symbols, [1] * len(symbols))
    n = 4 + bits.read(4)
    told = bits.read(3 * n)
    table, mask = length_table([(told >> 3 * k & 7, LENGTH_ORDER[k]) for k in range(n)])
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if left > alphabet:
        raise ValueError("too many code lengths")
    at, before, window, held, place = 0, 8, 0, 0, bits.at
    used, sizes = [], []
    for _ in range(left):
        if at >= alphabet:
            break
        if held < 14:  # no code length takes more
            place -= held
            window, held = int.from_bytes(bits.data[place >> 3 : (place >> 3) + 32], "little") >> (place & 7), 249
            place += held
        n, s = table[window & mask]
        if s < 16:
            window >>= n
            held -= n
            if s:
                used.append(at)
                sizes.append(s)
                before = s
            at += 1
        else:
            more, times, value = (2, 3, before) if s == 16 else (3, 3, 0) if s == 17 else (7, 11, 0)
            times += window >> n & ((1 << more) - 1)
            window >>= n + more
            held -= n + more
            if at + times > alphabet:
                raise ValueError("code lengths run over")
            if value:
                used.extend(range(at, at + times))
                sizes.extend([value] * times)
            at += times
    bits.at = place - held
    if bits.at > bits.end:
        raise ValueError("the image ends early")
    return Prefix(alphabet, used, sizes)


def _extra(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def literals(bits: Bits, codes: tuple[Prefix, Prefix, Prefix], total: int) -> np.ndarray:
    """(3, total) symbols of three codes that take turns.

    Where a pixel ends is found for each place of SPAN bits at once, as if one began there; then the pixels are followed.
    """
    most = max(1, *(c.most for c in codes))
    tables = [codes[0].table(most)]
    tables += [tables[0] if c.lengths[:256] == codes[0].lengths[:256] else c.table(most) for c in codes[1:]]
    data = np.frombuffer(bits.data, np.uint8)
    out, done = np.empty((3, total), np.uint32), 0
    if not any(c.most for c in codes):
        out[:] = [[c.only] for c in codes]
        return out
    while done < total:
        first = bits.at >> 3
        here = np.zeros(min(SPAN, len(data) - first) + 9, np.uint32)
        here[: len(data) - first] = data[first : first + len(here)]
        held = here[:-2] | here[1:-1] << np.uint32(8) | here[2:] << np.uint32(16)
        next_bits = (held[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << most) - 1)).reshape(-1)
        n = len(next_bits) - 48  # a pixel has 45 bits at most
        size = [tables[0][0][next_bits]]
        size += [size[0] if t is tables[0] else t[0][next_bits] for t in tables[1:]]
        place = np.arange(n, dtype=np.int32)
        second = place + size[0][:n]
        third = second + size[1][second]
        follow = memoryview(third + size[2][third])
        at, starts = bits.at & 7, []
        for _ in range(total - done):
            if at >= n:
                break
            starts.append(at)
            at = follow[at]
        if not starts:
            raise ValueError("the image ends early")
        starts = np.array(starts)
        to = done + len(starts)
        for k, where in enumerate((starts, second[starts], third[starts])):
            out[k, done:to] = tables[k][1][next_bits[where]]
        done = to
        bits.at = (first << 3) + at
        if bits.at > bits.end:
            raise ValueError("the image ends early")
    return out


EXTRA_BITS = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(40)])
EXTRA_FROM = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)])


class Places:
    """What each place of a piece of bits is for one group of codes, as if a pixel began there."""

    def __init__(self, codes: list[Prefix], window: np.ndarray, n: int):
        most = max(1, *(c.most for c in codes))
        self.codes, self.window = codes, window
        now = (window & np.uint32((1 << most) - 1)).astype(np.intp)
        told = codes[0].both(most).take(now[:n])
        self.symbol = told >> 4
        end = self.first = (told & 15) + np.arange(n, dtype=np.int32)
        # what each place is for the other codes of colours, where these take bits
        self.told = [None if c.only is not None else c.both(most).take(now) for c in codes[1:4]]
        self.now, self.far = now, codes[4].both(most)
        self.after = [end]
        for told in self.told:
            if told is not None:
                end = end + (told & 15).take(end)
            self.after.append(end)
        self.end = end.copy()
        far = (self.symbol >= 256).nonzero()[0]
        self.end[far] = self.first[far]
        far = far[self.symbol[far] < 280]
        if len(far):
            self.end[far] = self.repeats(far, False)[2]

    def colours(self, starts: np.ndarray, green: np.ndarray) -> np.ndarray:
        """The colours of literals that begin there."""
        out = (green & 255).astype(np.uint32) << np.uint32(8)
        for k, (shift, told) in enumerate(zip((16, 0, 24), self.told, strict=True)):
            value = np.uint32(self.codes[k + 1].only) if told is None else (told.take(self.after[k].take(starts)) >> 4).astype(np.uint32)
            out |= value << np.uint32(shift)
        return out

    def extra(self, places: np.ndarray, n: np.ndarray) -> np.ndarray:
        # the window has seventeen bits for sure
        return (self.window.take(places) & 0xFFFF | (self.window.take(places + 16).astype(np.int64) & 0xFFFF) << 16) & ((1 << n) - 1)

    def repeats(self, where: np.ndarray, whole: bool = True) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
        """Lengths and distance codes of the repetitions that begin there, and where these end."""
        length, place = self.symbol.take(where) - 256, self.first.take(where)
        more = EXTRA_BITS.take(length)
        after = place + more
        far = self.far.take(self.now.take(after))
        begin, far = after + (far & 15), far >> 4
        further = EXTRA_BITS.take(far)
        end = begin + further
        if not whole:
            return None, None, end
        return EXTRA_FROM.take(length) + self.extra(place, more), EXTRA_FROM.take(far) + self.extra(begin, further), end


def symbols(bits: Bits, codes: list[list[Prefix]], group_of: np.ndarray | None, total: int) -> tuple[np.ndarray, ...]:
    """(symbol of green, literal's colour, pixels, distance code) of all that is told, in order.

    As with literals, the next place is found for all places of SPAN bits at once, for each group of codes.
    """
    data, done, found = np.frombuffer(bits.data, np.uint8), 0, []
    while done < total:
        first = bits.at >> 3
        here = np.zeros(min(SPAN, len(data) - first) + 16, np.uint32)
        here[: len(data) - first] = data[first : first + len(here)]
        held = here[:-2] | here[1:-1] << np.uint32(8) | here[2:] << np.uint32(16)
        window = (held[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)
        n = len(window) - 80  # a pixel has 60 bits at most
        places = [Places(own, window, n) for own in codes]
        at, starts = bits.at & 7, []
        if group_of is None:
            # two pixels at a step; places from n on stay where they are
            follow = np.concatenate([places[0].end, np.arange(n, n + 80, dtype=np.int32)])
            two, add = memoryview(follow.take(places[0].end)), starts.append
            try:
                for _ in range((total - done + 1) >> 1):
                    add(at)
                    at = two[at]
            except IndexError:
                starts.pop()
            starts = np.array(starts, np.int64)
            both = np.empty(2 * len(starts), np.int64)
            both[::2], both[1::2] = starts, follow.take(starts)
            starts = both[: total - done]
            if len(starts) and starts[-1] >= n:
                starts = starts[:-1]
            at = int(follow[starts[-1]]) if len(starts) else at
            groups = None
        else:
            follow, jumps, pixel, groups = [memoryview(p.end) for p in places], [], done, []
            for p in places:
                pixels, far = np.ones(n, np.int64), np.flatnonzero((p.symbol >= 256) & (p.symbol < 280))
                pixels[far] = p.repeats(far)[0]
                jumps.append(memoryview(pixels))
            while pixel < total and at < n:
                g = group_of[pixel]
                starts.append(at)
                groups.append(g)
                pixel += jumps[g][at]
                at = follow[g][at]
            starts, groups = np.array(starts, np.int64), np.array(groups, np.int8)
        if not len(starts):
            raise ValueError("the image ends early")
        symbol, colour = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.uint32)
        pixels, distance = np.ones(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for g, p in enumerate(places):
            mine = slice(None) if groups is None else np.flatnonzero(groups == g)
            where = starts[mine]
            told = p.symbol[where]
            symbol[mine], colour[mine] = told, p.colours(where, told)
            far = ((told >= 256) & (told < 280)).nonzero()[0]
            if len(far):
                to = far if groups is None else mine[far]
                pixels[to], distance[to], _ = p.repeats(where[far])
        reached = np.cumsum(pixels)
        n_told = int(np.searchsorted(reached, total - done)) + 1
        if n_told < len(starts):
            at = int(starts[n_told])
        found.append((symbol[:n_told], colour[:n_told], pixels[:n_told], distance[:n_told]))
        done += int(reached[min(n_told, len(starts)) - 1])
        bits.at = (first << 3) + at
        if bits.at > bits.end:
            raise ValueError("the image ends early")
    if done > total:
        raise ValueError("a back-reference leaves the image")
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def settle(source: np.ndarray) -> np.ndarray:
    """Where each pixel comes from in the end."""
    while (further := source.take(source)).tobytes() != source.tobytes():
        source = further
    return source


def told_pixels(told: tuple[np.ndarray, ...], width: int, total: int, cache_bits: int) -> np.ndarray | None:
    """Pixels of what was told; None if an entry of the cache is used before it is set."""
    symbol, colour, pixels, code = told
    at = np.cumsum(pixels) - pixels
    out, source = np.zeros(total, np.uint32), np.arange(total)
    plain = symbol < 256
    out[at[plain]] = colour[plain]
    far = np.flatnonzero((symbol >= 256) & (symbol < 280))
    if len(far):
        near = np.minimum(code[far], 120) - 1
        distance = np.where(code[far] > 120, code[far] - 120, np.maximum(1, PLANE_X[near] + PLANE_Y[near] * width))
        if (distance > at[far]).any():
            raise ValueError("a back-reference leaves the image")
        sizes = pixels[far]
        place = np.arange(int(sizes.sum())) + np.repeat(at[far] - np.cumsum(sizes) + sizes, sizes)
        source[place] = place - np.repeat(distance, sizes)
        source = settle(source)
    kept = np.flatnonzero(symbol >= 280)
    if len(kept):
        # an entry holds the last pixel of its hash, and a copy has the hash of what it is a copy of
        key = (np.uint32(0x1E35A7BD) * out >> np.uint32(32 - cache_bits)).astype(np.uint16)
        key[at[kept]] = symbol[kept] - 280
        before = same_before(key[source])[at[kept]]
        if (before < 0).any():
            return None
        source[at[kept]] = before
        source = settle(source)
    return out[source] if len(far) or len(kept) else out


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as 32-bit numbers alpha, red, green, blue, before any transform is undone."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_of, groups, tile = None, 1, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        which = read_image(bits, (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False)
        group_of = (which >> 8 & 0xFFFF).reshape((height + (1 << tile) - 1) >> tile, -1)
        groups = int(group_of.max()) + 1
    codes = [[read_prefix(bits, n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, _ = codes[0]
    if groups == 1 and not cache_bits and alpha.only is not None and int(green.symbols.max()) < 256:
        g, r, b = literals(bits, (green, red, blue), total)
        return np.uint32(alpha.only << 24) | r << np.uint32(16) | g << np.uint32(8) | b
    start = bits.at
    if total >= FEW and groups <= MOST_GROUPS:
        which = None if groups == 1 else np.repeat(np.repeat(group_of, 1 << tile, axis=0), 1 << tile, axis=1)[:height, :width].ravel().tolist()
        got = told_pixels(symbols(bits, codes, which, total), width, total, cache_bits)
        if got is not None:
            return got
        bits.at = start
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else []
    at = 0

    def keep(pixel: int) -> None:
        if cache_bits:
            cache[(0x1E35A7BD * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while at < total:
        own = codes[int(group_of[at // width >> tile, at % width >> tile])] if group_of is not None else codes[0]
        s = own[0].read(bits)
        if s < 256:
            r = own[1].read(bits)
            b = own[2].read(bits)
            a = own[3].read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            keep(out[at])
            at += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            code = _extra(bits, own[4].read(bits))
            if code > 120:
                distance = code - 120
            else:
                x, y = PLANE[code - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[at] = out[at - distance]
                keep(out[at])
                at += 1
        else:
            out[at] = cache[s - 280]
            keep(out[at])
            at += 1
    return np.array(out, np.uint32)


def _split(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def undo_predictor(channels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """channels: (height, width, 4) differences in the order alpha, red, green, blue."""
    height, width, _ = channels.shape
    out = channels.copy()
    half = lambda a, b: (a + b) >> 1
    clamp = lambda v: np.clip(v, 0, 255)
    out[0, 0] = (out[0, 0] + np.array([255, 0, 0, 0])) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        above = out[y - 1]
        out[y, 0] = (out[y, 0] + above[0]) & 255
        row = modes[y >> tile]
        x = 1
        while x < width:
            mode = int(row[x >> tile])
            end = min(width, ((x >> tile) + 1) << tile)
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):  # what doesn't depend on the pixel to the left
                if mode in (0, 14, 15):
                    guess = np.array([255, 0, 0, 0])
                else:
                    t = above[x:end]
                    tl = above[x - 1 : end - 1]
                    tr = np.concatenate([above[x + 1 : end + 1], out[y, :1]])[: end - x] if end == width else above[x + 1 : end + 1]
                    guess = {2: t, 3: tr, 4: tl}.get(mode)
                    if guess is None:
                        guess = half(tl, t) if mode == 8 else half(t, tr)
                out[y, x:end] = (out[y, x:end] + guess) & 255
            elif mode == 1:
                out[y, x:end] = (np.cumsum(out[y, x:end], axis=0) + out[y, x - 1]) & 255
            else:
                for i in range(x, end):
                    left, t, tl = out[y, i - 1], above[i], above[i - 1]
                    tr = above[i + 1] if i + 1 < width else out[y, 0]
                    if mode == 5:
                        guess = half(half(left, tr), t)
                    elif mode == 6:
                        guess = half(left, tl)
                    elif mode == 7:
                        guess = half(left, t)
                    elif mode == 10:
                        guess = half(half(left, tl), half(t, tr))
                    elif mode == 11:
                        guess = left if np.abs(t - tl).sum() < np.abs(left - tl).sum() else t
                    elif mode == 12:
                        guess = clamp(left + t - tl)
                    else:
                        mean = half(left, t)
                        diff = mean - tl
                        guess = clamp(mean + np.where(diff < 0, -(-diff // 2), diff // 2))
                    out[y, i] = (out[y, i] + guess) & 255
            x = end
    return out


def undo_cross_colour(channels: np.ndarray, elements: np.ndarray, tile: int) -> np.ndarray:
    height, width, _ = channels.shape
    per = np.repeat(np.repeat(elements, 1 << tile, axis=0), 1 << tile, axis=1)[:height, :width]
    signed = lambda v: ((v & 255) ^ 128) - 128
    green = signed(channels[..., 2])
    out = channels.copy()
    red_to_blue, green_to_blue, green_to_red = signed(per[..., 1]), signed(per[..., 2]), signed(per[..., 3])
    out[..., 1] = (channels[..., 1] + (green_to_red * green >> 5)) & 255
    out[..., 3] = (channels[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * signed(out[..., 1]) >> 5)) & 255
    return out


def decode_one(data: bytes) -> np.ndarray:
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP container")
    at = 12
    while at + 8 <= len(data) and data[at : at + 4] != b"VP8L":
        at += 8 + (n := struct.unpack_from("<I", data, at + 4)[0]) + (n & 1)
    if at + 8 > len(data):
        raise ValueError("no lossless image")
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    full, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [u[0] for u in undo]:
            raise ValueError("a transform is there twice")
        if kind in (0, 1):
            tile = bits.read(3) + 2
            cols, rows = (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            undo.append((kind, tile, _split(read_image(bits, cols, rows, False)).reshape(rows, cols, 4)))
        elif kind == 2:
            undo.append((kind, 0, None))
        else:
            n = bits.read(8) + 1
            palette = np.cumsum(_split(read_image(bits, n, 1, False)), axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, pack, (palette, width)))
            width = (width + (1 << pack) - 1) >> pack
    pixels = read_image(bits, width, height, True)
    if not undo:
        out = pixels.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]
        if not has_alpha:
            out[..., 3] = 255
        return out
    channels = _split(pixels).reshape(height, width, 4)
    for kind, tile, extra in reversed(undo):
        if kind == 0:
            channels = undo_predictor(channels, extra[..., 2] & 15, tile)
        elif kind == 1:
            channels = undo_cross_colour(channels, extra, tile)
        elif kind == 2:
            channels = channels.copy()
            channels[..., 1] = (channels[..., 1] + channels[..., 2]) & 255
            channels[..., 3] = (channels[..., 3] + channels[..., 2]) & 255
        else:
            palette, wide = extra
            index = channels[..., 2]
            if tile:
                each = 8 >> tile
                index = np.stack([index >> (k * each) & ((1 << each) - 1) for k in range(1 << tile)], axis=-1).reshape(height, -1)[:, :wide]
            table = np.zeros((256, 4), np.int32)
            table[: len(palette)] = palette
            channels = table[index]
    out = channels[..., [1, 2, 3, 0]].astype(np.uint8)
    if not has_alpha:
        out[..., 3] = 255
    return out[:, :full]


def containers(data: bytes):
    at = 0
    while at < len(data):
        if len(data) < at + 8:
            raise ValueError("no WebP container")
        size = 8 + struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + size]
        at += size + (size & 1)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of an image, or of images of one width that lie one after the other."""
    found = [decode_one(x) for x in containers(data)]
    if not found:
        raise ValueError("no WebP container")
    return found[0] if len(found) == 1 else np.concatenate(found)


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


def bounded(parts: list[memoryview]):
    """Lists of the texts one after the other, of half a megabyte in all or of one text."""
    held, size = [], 0
    for part in parts:
        if held and size + len(part) > 1 << 19:
            yield held
            held, size = [], 0
        held.append(bytes(part))
        size += len(part)
    if held:
        yield held


def feature(pixels: np.ndarray) -> str:
    """Sums of the channels, and of the differences between neighbours of a row."""
    rgb = pixels[..., :3].astype(np.int32)
    sums = rgb.reshape(-1, 3).sum(axis=0)
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(str(int(v)) for v in sums) + f";{int(np.abs(np.diff(rgb, axis=1)).sum())}"


def pixels(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns kept, then height, width and the pixels as bytes, four for each; null where there is no image."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keep).schema), "height int, width int, pixels binary"])
    where = len(keep)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                rows = []
                for blob in b.column(where).to_pylist():
                    try:
                        got = decode(blob) if blob else None
                    except (ValueError, IndexError):
                        got = None
                    rows.append((None, None, None) if got is None else (got.shape[0], got.shape[1], got.tobytes()))
                arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(where)), *arrays], names=[*keep, "height", "width", "pixels"])

    return media.select(*keep, column).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every text of documents as lossless WebP, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def row(text: bytes, media: bytes) -> tuple:
        got = decode(media)
        back = np.ascontiguousarray(got[..., :3]).tobytes()
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(got)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for texts in bounded(byte_parts(b.column(1))):
                    rows += [row(*x) for x in zip(texts, encode_all([padded(t) for t in texts]), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields))], names=["doc_id", *(n for n, _ in fields)])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
