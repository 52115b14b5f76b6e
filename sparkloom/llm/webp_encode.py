"""The writer of lossless WebP: many byte payloads at once, each coded by itself.

For each image it weighs pixels as they are, subtract-green, the predictor (one of 14 modes for each tile of 16), the
cross-colour transform, both together and a palette (packed where there are few colours). The pixels left over are
written as literals, back-references with plane distances and entries of a colour cache, by prefix codes made for each
image, in two groups by an entropy image where blocks of 64 rows differ. Each choice is the one of the fewest estimated bits,
in whole numbers, so that it doesn't depend on the other payloads.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH, UNIT, MOST_ROWS = 64, 192, 16384
LONGEST = 11  # bits of the encoder's codes
BATCH = 1 << 17  # bytes of payloads that are written at once
BIT = 256  # costs are in parts of a bit
TILE = 4  # bits of the side of a tile of the predictor and cross-colour transforms
BLOCK = 6  # bits of the side of a tile of the entropy image
CACHES = (7, 9)  # bits of the colour caches that are tried
SYMBOL_COST, CODE_COST = 7 * BIT, 30 * BIT  # what a symbol and a code take in the header, about
LEAST = 6  # repetitions and caches are written where they save one bit in 64, as literals alone are read faster
# fixed values of the format: the order in which code length codes are stored
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
# fixed values of the format: (x, y) offsets of the 120 short distance codes
PLANE = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


_reversals: dict[int, np.ndarray] = {}


def reversals(bits: int) -> np.ndarray:
    """Each number of so many bits with their order turned around."""
    if bits not in _reversals:
        out = np.zeros(1 << bits, np.intp)
        for k in range(bits):
            out |= (np.arange(1 << bits) >> k & 1) << (bits - 1 - k)
        _reversals[bits] = out
    return _reversals[bits]


_logs: list[np.ndarray] = []


def count_logs() -> np.ndarray:
    """n * log2(n) in parts of a bit, for all counts of an image."""
    if not _logs:
        n = np.arange((WIDTH * MOST_ROWS) + 1, dtype=np.float64)
        _logs.append(np.round(BIT * n * np.log2(np.maximum(n, 1))).astype(np.int64))
    return _logs[0]


def histogram_cost(counts: np.ndarray) -> np.ndarray:
    """Bits of the symbols of each row of counts, and of their code."""
    logs = count_logs()
    return logs[counts.sum(axis=1)] - logs[counts].sum(axis=1) + SYMBOL_COST * (counts > 0).sum(axis=1) + CODE_COST


def channel_cost(px: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Bits of each image's pixels as literals; px is (rows, pixels, 3) of uint8, owner the image of each row."""
    base = (owner * 768)[:, None] + np.tile(np.arange(0, 768, 256), px.shape[1])
    counts = np.bincount((base + px.reshape(len(px), -1)).ravel(), minlength=768 * n)
    return histogram_cost(counts.reshape(3 * n, 256)).reshape(n, 3).sum(axis=1)


def mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


def guesses(px: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(14, rows, width, 3) what each mode of the predictor expects, edges of images apart."""
    left, above, corner, right = (np.zeros_like(px) for _ in range(4))
    left[:, 1:] = px[:, :-1]
    above[1:] = px[:-1]
    above[first] = 0  # a choice doesn't depend on the image before
    corner[:, 1:] = above[:, :-1]
    right[:, :-1] = above[:, 1:]
    right[:, -1] = px[:, 0]
    wide_left, wide_above, wide_corner = (x.astype(np.int16) for x in (left, above, corner))
    from_left, from_above = (np.abs(x - wide_corner) for x in (wide_above, wide_left))
    nearer = np.repeat(sum(from_left[..., c] for c in range(3)) < sum(from_above[..., c] for c in range(3)), 3, axis=1).reshape(px.shape)
    half = mean(left, above)
    diff = half - wide_corner
    out = [np.zeros_like(px), left, above, right, corner, mean(mean(left, right), above), mean(left, corner), half, mean(corner, above), mean(above, right)]
    out += [mean(mean(left, corner), mean(above, right)), np.where(nearer, left, above)]
    out += [np.clip(wide_left + wide_above - wide_corner, 0, 255).astype(np.uint8)]
    out += [np.clip(half + np.where(diff < 0, -(-diff >> 1), diff >> 1), 0, 255).astype(np.uint8)]
    return np.stack(out)


def tile_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(tile rows, tile columns) sums; values is (rows, width) or (rows, width, 3)."""
    rows = values.reshape(len(values), WIDTH >> TILE, -1).sum(axis=2, dtype=np.uint16 if values.dtype == np.uint8 else np.int64)
    return np.add.reduceat(rows.astype(np.int64), starts, axis=0)


def small(px: np.ndarray) -> np.ndarray:
    """Differences as distances from zero."""
    return np.minimum(px, 0 - px)


def predicted(px: np.ndarray, first: np.ndarray, starts: np.ndarray, tile_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences from what the best mode of each tile expects, and the modes."""
    expected = guesses(px, first)
    modes = np.argmin(np.stack([tile_sums(small(px - g), starts) for g in expected]), axis=0)
    cut = expected.reshape(len(expected), len(px), WIDTH >> TILE, -1)
    guess = cut[modes[tile_of], np.arange(len(px))[:, None], np.arange(WIDTH >> TILE)].reshape(px.shape)
    guess[:, 0] = expected[2][:, 0]
    guess[first] = expected[1][first]
    return px - guess, modes


def cross_coloured(px: np.ndarray, starts: np.ndarray, tile_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What green and red don't tell of red and blue, and (tile rows, tile columns, 3): red to blue, green to blue, green to red."""
    shape = (len(px), WIDTH >> TILE, 1 << TILE)
    red, green, blue = (px[..., c].view(np.int8).astype(np.int16).reshape(shape) for c in range(3))

    def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # whole numbers below 2^24 in each row of a tile
        return np.add.reduceat(np.einsum("hci,hci->hc", a.astype(np.float32), b.astype(np.float32)).astype(np.int64), starts, axis=0)

    def sizes(v: np.ndarray) -> np.ndarray:
        return tile_sums(small(v.astype(np.uint8)), starts)

    def factor(of: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = np.maximum(1, products(by, by))
        f = np.clip((32 * products(of, by) + square // 2) // square, -128, 127)
        left = of - (f[tile_of].astype(np.int16)[..., None] * by >> 5)
        worse = sizes(left) >= sizes(of)
        return np.where(worse, 0, f), np.where(worse[tile_of][..., None], of, left)

    to_red, red_left = factor(red, green)
    to_blue, blue_left = factor(blue, green)
    red_to_blue, blue_left = factor(blue_left.astype(np.int8).astype(np.int16), red)
    out = px.copy()
    out[..., 0], out[..., 2] = (x.astype(np.uint8).reshape(-1, WIDTH) for x in (red_left, blue_left))
    return out, np.stack([red_to_blue, to_blue, to_red], axis=-1)


def no_green(px: np.ndarray) -> np.ndarray:
    out = px.copy()
    out[..., 0] -= px[..., 1]
    out[..., 2] -= px[..., 1]
    return out


def argb(px: np.ndarray, alpha: int) -> np.ndarray:
    wide = px.astype(np.uint32)
    return (wide[..., 0] << 16 | wide[..., 1] << 8 | wide[..., 2] | np.uint32(alpha << 24)).reshape(-1)


def same_before(keys: np.ndarray) -> np.ndarray:
    """The place before each one with an equal key, -1 without; keys are of uint16."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    same = np.flatnonzero(held[1:] == held[:-1])
    out = np.full(len(keys), -1, np.int64)
    out[order[same + 1]] = order[same]
    return out


def palettes(px: np.ndarray, first: np.ndarray, owner: np.ndarray, best: np.ndarray) -> dict[int, tuple[int, np.ndarray, np.ndarray, int]]:
    """image -> (bits, palette, indices, bits of packing), for images of 256 colours at most that may take fewer bits so."""
    n, rows = len(first), np.append(first, len(px))
    # an image has no fewer colours than hashes of colours
    before = same_before((argb(px, 0) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)).reshape(-1, WIDTH)
    few = np.bincount(owner, (before < (first[owner] * WIDTH)[:, None]).sum(axis=1), n) <= 256
    out = {}
    own = np.flatnonzero(few[owner])
    if not len(own):
        return out
    keys, inverse, counts = np.unique((owner[own][:, None] << 24 | argb(px[own], 0).reshape(-1, WIDTH)).ravel(), return_inverse=True, return_counts=True)
    of = np.searchsorted(keys >> 24, np.arange(n + 1))
    logs, size = count_logs(), np.append(0, np.cumsum(np.where(few, np.diff(rows) * WIDTH, 0)))
    about = logs[np.diff(size)] - np.diff(np.append(0, np.cumsum(logs[counts]))[of]) + 16 * BIT * np.diff(of)
    for i in np.flatnonzero(few & (np.diff(of) <= 256) & ((about < best) | (np.diff(of) <= 16))).tolist():
        colours = (keys[of[i] : of[i + 1]] & 0xFFFFFF).astype(np.uint32)
        index = (inverse[size[i] : size[i + 1]] - of[i]).reshape(-1, WIDTH)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        if pack:
            each = 8 >> pack
            index = (index.reshape(len(index), -1, 1 << pack) << np.arange(0, 8, each)).sum(axis=2)
        parts = np.stack([colours >> np.uint32(s) & np.uint32(255) for s in (16, 8, 0)], axis=-1).astype(np.uint8)
        parts[1:] -= parts[:-1].copy()
        cost = int(histogram_cost(np.bincount(index.ravel(), minlength=256)[None])[0] + channel_cost(parts[None], np.zeros(1, np.int64), 1)[0])
        steps = argb(parts, 0)
        steps[0] |= np.uint32(255 << 24)
        out[i] = cost, steps, (index.ravel().astype(np.uint32) << np.uint32(8)) | np.uint32(255 << 24), pack
    return out


class Streams:
    """Images within images, in the order in which they are stored."""

    def __init__(self):
        self.pixels: list[np.ndarray] = []
        self.widths: list[int] = []
        self.heads: list[tuple[int, int]] = []
        self.images: list[int] = []
        self.main: list[bool] = []

    def add(self, image: int, pixels: np.ndarray, width: int, head: tuple[int, int], main: bool = False) -> None:
        self.pixels.append(pixels)
        self.widths.append(width)
        self.heads.append(head)
        self.images.append(image)
        self.main.append(main)


def images(parts: list) -> list[bytes]:
    n = len(parts)
    heights = np.array([len(p) // UNIT for p in parts])
    first = np.cumsum(heights) - heights
    px = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WIDTH, 3)
    owner = np.repeat(np.arange(n), heights)
    tile_rows = (heights + (1 << TILE) - 1) >> TILE
    tile_first = np.cumsum(tile_rows) - tile_rows
    tile_of = tile_first[owner] + ((np.arange(len(px)) - first[owner]) >> TILE)
    starts = np.searchsorted(tile_of, np.arange(tile_rows.sum()))
    tiles = tile_rows * (WIDTH >> TILE)
    rest, modes = predicted(px, first, starts, tile_of)
    crossed, elements = cross_coloured(px, starts, tile_of)
    rest_crossed, rest_elements = cross_coloured(rest, starts, tile_of)
    forms = [px, no_green(px), rest, no_green(rest), crossed, rest_crossed]
    costs = np.stack([channel_cost(x, owner, n) for x in forms])
    costs[[2, 3, 5]] += (3 * tiles + 60) * BIT
    costs[[4, 5]] += (12 * tiles + 100) * BIT
    best = np.argmin(costs, axis=0)
    found = palettes(px, first, owner, costs.min(axis=0))
    numbers: dict[int, np.ndarray] = {}
    streams = Streams()
    for i in range(n):
        kind = int(best[i])
        if i in found and found[i][0] < costs[kind, i]:
            _, steps, index, pack = found[i]
            streams.add(i, steps, len(steps), (0b111 | (len(steps) - 1) << 3, 11))
            streams.add(i, index, WIDTH >> pack, (0, 1), True)
            continue
        if kind not in numbers:
            numbers[kind] = argb(forms[kind], 0 if kind in (2, 3, 5) else 255)
        cut = slice(int(tile_first[i]), int(tile_first[i] + tile_rows[i]))
        if kind in (2, 3, 5):
            mode = modes[cut].astype(np.uint32).ravel()
            streams.add(i, mode << np.uint32(8) | np.uint32(255 << 24), WIDTH >> TILE, (0b001 | (TILE - 2) << 3, 6))
        if kind in (4, 5):
            of = (elements if kind == 4 else rest_elements)[cut]
            streams.add(i, argb((of & 255).astype(np.uint8), 255), WIDTH >> TILE, (0b011 | (TILE - 2) << 3, 6))
        head = (0b0101, 4) if kind in (1, 3) else (0, 1)  # subtract green, no more transforms
        streams.add(i, numbers[kind][first[i] * WIDTH : (first[i] + heights[i]) * WIDTH], WIDTH, head, True)
    return stored(streams, heights)


def extras(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix symbol of lengths and distances, and how many bits of what number follow it."""
    low = value - 1
    top = np.frexp(np.maximum(low, 1).astype(np.float64))[1] - 1
    n = np.where(low < 4, 0, top - 1)
    return np.where(low < 4, low, 2 * top + (low >> np.maximum(top - 1, 0) & 1)), n, np.where(low < 4, 0, low & ((1 << n) - 1))


_plane_codes: dict[int, np.ndarray] = {}


def distance_codes(distance: np.ndarray, widths: np.ndarray) -> np.ndarray:
    out = distance + 120
    for width in np.unique(widths).tolist():
        if width not in _plane_codes:
            near = np.zeros(8 * width + 9, np.int64)
            for code in range(len(PLANE), 0, -1):
                x, y = PLANE[code - 1]
                near[max(1, x + y * width)] = code
            _plane_codes[width] = near
        near = _plane_codes[width]
        at = np.flatnonzero((widths == width) & (distance < len(near)))
        code = near[distance[at]]
        out[at] = np.where(code > 0, code, out[at])
    return out


def matches(px: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and distance of a repetition that begins at each pixel, 0 where there is none; ends: of the pixel's stream."""
    n = len(px)
    after = np.append(px[1:], np.uint32(0))
    key = ((px * np.uint32(0x9E3779B1) ^ after * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(np.uint16)
    at = np.arange(n)
    before = same_before(key)
    ok = (before >= 0) & (ends[before] == ends) & (px[before] == px) & (after[before] == after) & (at + 1 < ends) & (at - before < (1 << 20) - 120)
    distance = np.where(ok, at - before, 0)
    # along a run of one distance the repetition is one; only its last pair is followed further
    last = np.flatnonzero(ok & (np.append(distance[1:], 0) != distance))
    length = np.full(len(last), 2)
    live = np.arange(len(last))
    for k in range(2, 64):
        to = last[live] + k
        live, to = live[to < ends[last[live]]], to[to < ends[last[live]]]
        live = live[px[to] == px[to - distance[last[live]]]]
        if not len(live):
            break
        length[live] = k + 1
    out = np.zeros(n, np.int64)
    if len(last):
        of = np.searchsorted(last, np.flatnonzero(ok))
        place = np.flatnonzero(ok)
        out[place] = np.minimum(length[of] + last[of] - place, 4096)
    return out, distance


def depths(weights: list[int], most: int) -> list[int]:
    """Lengths of a prefix code, for two weights or more in ascending order."""
    n = len(weights)
    while True:
        a = list(weights)
        a[0] += a[1]
        root, leaf = 0, 2
        for new in range(1, n - 1):
            if leaf >= n or a[root] < a[leaf]:
                a[new] = a[root]
                a[root] = new
                root += 1
            else:
                a[new] = a[leaf]
                leaf += 1
            if leaf >= n or (root < new and a[root] < a[leaf]):
                a[new] += a[root]
                a[root] = new
                root += 1
            else:
                a[new] += a[leaf]
                leaf += 1
        a[n - 2] = 0
        for k in range(n - 3, -1, -1):
            a[k] = a[a[k]] + 1
        inner, free, depth = a[: n - 1], 1, 0
        a = []
        while free:
            used = inner.count(depth)
            a += [depth] * (free - used)
            free, depth = 2 * used, depth + 1
        a.reverse()
        if a[0] <= most:
            return a
        weights = [(w + 1) // 2 for w in weights]


def prefix_codes(counts: np.ndarray, begin: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Length and value (lowest bit first) of the code of each symbol; begin: where each alphabet begins, and the end of all.

    The only symbol of an alphabet takes no bits.
    """
    used = np.flatnonzero(counts)
    code = np.searchsorted(begin, used, side="right") - 1
    order = np.lexsort((used, counts[used], code))
    cuts = np.searchsorted(code, np.arange(len(begin))).tolist()
    weights, found = counts[used[order]].tolist(), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        found += [0] * (b - a) if b - a < 2 else depths(weights[a:b], most)
    length = np.zeros(len(counts), np.int64)
    length[used[order]] = found
    order = np.lexsort((used, length[used], code))
    to = used[order]
    step = 1 << (most - length[to])
    start = np.cumsum(step) - step
    start -= start[np.array(cuts)[code]]
    value = np.zeros(len(counts), np.int64)
    value[to] = reversals(most)[np.minimum(start, (1 << most) - 1)]
    value[to[length[to] == 0]] = 0
    return length, value


def length_tokens(lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, symbol, bits that follow, their number) that tell the lengths of alphabets laid one after the other."""
    cut = np.ones(len(lengths), bool)
    cut[1:] = lengths[1:] != lengths[:-1]
    cut[begin[:-1]] = True
    at = np.flatnonzero(cut)
    run, value = np.diff(np.append(at, len(lengths))), lengths[at]
    alphabet = np.searchsorted(begin, at, side="right") - 1
    zero = value == 0
    head = np.where(zero, 0, 1)
    left = run - head
    full = np.where(zero, 138, 6)
    whole, rest = left // full, left % full
    tail = np.where(rest >= 3, 1, rest)
    total = head + whole + tail
    of = np.repeat(np.arange(len(at)), total)
    k = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total) - head[of]
    amount = np.where((k >= 0) & (k < whole[of]), full[of], np.where((k >= 0) & (rest[of] >= 3), rest[of], 1))
    z = zero[of]
    symbol = np.where(amount == 1, value[of], np.where(~z, 16, np.where(amount > 10, 18, 17)))
    bits = np.select([symbol == 16, symbol == 17, symbol == 18], [2, 3, 7], 0)
    return alphabet[of], symbol, bits, np.where(symbol == 18, amount - 11, np.where(symbol >= 16, amount - 3, 0))


def grouped(green: np.ndarray, red: np.ndarray, blue: np.ndarray, block: np.ndarray) -> np.ndarray | None:
    """A group, 0 or 1, for each block of an image, if codes for two groups are shorter than for one."""
    n = int(block[-1]) + 1
    wide = int(green.max()) + 1
    keys = [(green, wide), (red, 256), (blue, 256)]
    tables = [np.bincount(block[s >= 0] * size + s[s >= 0], minlength=n * size).reshape(n, size) for s, size in keys]
    which = (np.arange(n) >= n // 2).astype(np.int64)
    one = sum(int(histogram_cost(t.sum(axis=0)[None])[0]) for t in tables)
    for _ in range(3):
        bits = np.zeros((n, 2), np.int64)
        for t in tables:
            both = np.stack([t[which == g].sum(axis=0) for g in (0, 1)])
            logs = np.round(BIT * (np.log2(2 * both.sum(axis=1, keepdims=True) + both.shape[1]) - np.log2(2 * both + 1))).astype(np.int64)
            bits += t @ logs.T
        now = (bits[:, 1] < bits[:, 0]).astype(np.int64)
        if (now == which).all() or now.min() == now.max():
            break
        which = now
    two = sum(int(histogram_cost(np.stack([t[which == g].sum(axis=0) for g in (0, 1)])).sum()) for t in tables)
    return which if two + (n + 120) * BIT < one else None


def stored(streams: Streams, heights: np.ndarray) -> list[bytes]:
    """The images whose streams these are."""
    px = np.concatenate(streams.pixels)
    sizes = np.array([len(p) for p in streams.pixels])
    n = len(sizes)
    to = np.cumsum(sizes)
    first = to - sizes
    widths = np.array(streams.widths)
    sid = np.repeat(np.arange(n), sizes)
    alpha, red, green, blue = ((px >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (24, 16, 8, 0))

    def cost(keys: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        return histogram_cost(np.bincount(of * size + keys, minlength=n * size).reshape(n, size))

    # which pixels begin a repetition that takes fewer bits than they would
    length, distance = matches(px, to[sid])
    by_itself = cost(green, sid, 256) + cost(red, sid, 256) + cost(blue, sid, 256) + CODE_COST
    literal = by_itself // sizes
    at = np.flatnonzero(length)
    at = at[length[at] * literal[sid[at]] > (11 + np.frexp(distance[at].astype(np.float64))[1]) * BIT]
    # from one to the next that begins where it ends or later
    later = np.zeros(len(px) + 1, np.int64)
    later[at + 1] = 1
    follow, k, kept = memoryview(np.cumsum(later)[at + length[at]]), 0, []
    while k < len(follow):
        kept.append(k)
        k = follow[k]
    at = at[kept] if kept else at[:0]
    take = np.zeros(len(px), bool)
    take[at] = True
    within = np.zeros(len(px) + 1, np.int8)
    within[at + 1] += 1
    within[at + length[at]] -= 1
    begins = np.flatnonzero(np.cumsum(within[:-1], dtype=np.int8) == 0)
    jump = take[begins]
    moved = begins[jump]
    far = extras(length[moved]), extras(distance_codes(distance[moved], widths[sid[moved]]))
    # whether repetitions take fewer bits than all pixels by themselves
    symbol = green[begins]
    symbol[jump] = 256 + far[0][0]
    plain = begins[~jump]
    told = cost(symbol, sid[begins], 280) + cost(red[plain], sid[plain], 256) + cost(blue[plain], sid[plain], 256)
    more = cost(far[1][0], sid[moved], 40) + np.bincount(sid[moved], far[0][1] + far[1][1], n).astype(np.int64) * BIT
    repeats = told + more < by_itself - (by_itself >> LEAST)
    starts = np.zeros(len(px), bool)
    starts[begins] = True
    where = np.flatnonzero(starts | ~repeats[sid])
    of = sid[where]
    jumps = take[where] & repeats[of]
    kept = repeats[sid[moved]]
    far = tuple(tuple(x[kept] for x in part) for part in far)
    moved = where[jumps]
    # how many bits of a colour cache are cheapest
    single = np.flatnonzero(~jumps)
    at, of_single = where[single], of[single]
    symbol = green[where]
    symbol[jumps] = 256 + far[0][0]
    least, cache, hits = np.where(repeats, told, by_itself - CODE_COST), np.zeros(n, np.int64), {}
    least -= least >> LEAST
    for c in CACHES:
        key = px * np.uint32(0x1E35A7BD) >> np.uint32(32 - c)
        before = same_before(key.astype(np.uint16))[at]
        hit = (px[before] == px[at]) & (before >= 0) & (sid[before] == of_single)
        found = symbol.copy()
        found[single[hit]] = 280 + key[at[hit]]
        plain = at[~hit]
        now = cost(found, of, 280 + (1 << c)) + cost(red[plain], sid[plain], 256) + cost(blue[plain], sid[plain], 256)
        cache[now < least] = c
        least, hits[c] = np.minimum(now, least), found
    for c, found in hits.items():
        symbol = np.where(cache[of] == c, found, symbol)
    hit = symbol >= 280
    plain = ~(hit | jumps)
    lit = where[plain]
    literals = red[lit], blue[lit], alpha[lit]

    # groups of codes, by an entropy image
    groups, group, entropy = np.ones(n, np.int64), np.zeros(len(where), np.int64), {}
    cuts = np.searchsorted(of, np.arange(n + 1)).tolist()
    for s in np.flatnonzero((sizes > widths << BLOCK) & np.array(streams.main)).tolist():
        mine = slice(cuts[s], cuts[s + 1])
        block = (where[mine] - first[s]) // int(widths[s]) >> BLOCK
        which = grouped(symbol[mine], np.where(plain[mine], red[where[mine]], -1), np.where(plain[mine], blue[where[mine]], -1), block)
        if which is not None:
            entropy[s] = np.zeros((int(heights[streams.images[s]]) + (1 << BLOCK) - 1) >> BLOCK, np.int64)
            entropy[s][: len(which)] = which
            groups[s], group[mine] = 2, which[block]
    return packed(streams, heights, of, group, groups, entropy, cache, symbol, plain, literals, jumps, far)


def packed(streams: Streams, heights: np.ndarray, of, group, groups, entropy, cache, symbol, plain, literals, jumps, far) -> list[bytes]:
    """The files; of is the stream of each symbol, literals and far are what follows the plain ones and the jumps."""
    n, n_images = len(groups), len(heights)
    first_code = 5 * (np.cumsum(groups) - groups)
    stream_of = np.repeat(np.arange(n), 5 * groups)
    # alphabets of each group: green, red, blue, alpha, distance
    alphabets = np.tile([0, 256, 256, 256, 40], int(groups.sum()))
    alphabets[::5] = (280 + np.where(cache > 0, 1 << cache, 0))[stream_of[::5]]
    begin = np.append(0, np.cumsum(alphabets))
    mine = first_code[of] + 5 * group
    at_green = begin[mine] + symbol
    at_literals = [begin[mine[plain] + 1 + k] + v for k, v in enumerate(literals)]
    (length_code, length_bits, length_extra), (distance_code, distance_bits, distance_extra) = far
    at_distance = begin[mine[jumps] + 4] + distance_code
    counts = np.bincount(np.concatenate([at_green, *at_literals, at_distance]), minlength=int(begin[-1]))
    used = np.add.reduceat(counts > 0, begin[:-1], dtype=np.int64)
    single = np.flatnonzero(counts)
    single = single[used[(code := np.searchsorted(begin, single, side="right") - 1)] == 1]
    code = np.searchsorted(begin, single, side="right") - 1
    long = single - begin[code] > 255  # a code of one symbol is told by eight bits; such a one gets a second symbol
    counts[begin[code[long]]] = 1
    used[code[long]] = 2
    only = np.zeros(len(alphabets), np.int64)
    only[code] = single - begin[code]
    sizes, codes = prefix_codes(counts, begin, LONGEST)
    # the body: the bits of each symbol and what follows it
    bits, number = sizes[at_green], codes[at_green]
    for where, pieces in ((plain, [(sizes[at], codes[at]) for at in at_literals]), (jumps, [(length_bits, length_extra), (sizes[at_distance], codes[at_distance]), (distance_bits, distance_extra)])):
        held, value = bits[where], number[where]
        for size, v in pieces:
            value |= v.astype(np.int64) << held
            held = held + size
        bits[where], number[where] = held, value
    # the header: for each code its symbol, or the code of its lengths and these
    full, simple = np.flatnonzero(used > 1), np.flatnonzero(used <= 1)
    alphabet, token, extra_bits, extra = length_tokens(sizes[np.repeat(used > 1, alphabets)], np.append(0, np.cumsum(alphabets[full])))
    inner = np.bincount(alphabet * 19 + token, minlength=19 * len(full))
    inner_sizes, inner_codes = prefix_codes(inner, np.arange(len(full) + 1) * 19, 7)
    tell, there = inner_sizes.reshape(-1, 19).copy(), inner.reshape(-1, 19) > 0
    alone = there.sum(axis=1) == 1
    tell[alone] = there[alone]
    tell = tell[:, LENGTH_ORDER]
    at = alphabet * 19 + token
    heads = []
    for s in range(n):
        image = streams.images[s]
        if s == 0 or streams.images[s - 1] != image:
            heads.append((s, 0x2F | (WIDTH - 1) << 8 | (int(heights[image]) - 1) << 22, 40))  # no alpha, version 0
        heads.append((s, *streams.heads[s]))
        heads.append((s, 1 | int(cache[s]) << 1, 5) if cache[s] else (s, 0, 1))
        if s in entropy:
            heads.append((s, 1 | (BLOCK - 2) << 1, 4))
            # no cache; green has the symbols 0 and 1 of a bit each, the other codes one symbol
            heads += [(s, (0b11 | 1 << 4) << 1, 13), (s, 0b0001, 4), (s, 0b0001, 4), (s, 0b101 | 255 << 3, 11), (s, 0b0001, 4)]
            heads += [(s, int(g), 1) for g in entropy[s]]
        elif streams.main[s]:
            heads.append((s, 0, 1))
    head_of, head_number, head_bits = np.array(heads, np.int64).T
    # all of it in order, each item by the code that it is of: a stream's head before its codes, its body after them
    pieces = [
        (head_of, 8 * first_code[head_of] - 2, head_bits, head_number),
        (stream_of[simple], 8 * simple, np.where(only[simple] > 1, 11, 4), np.where(only[simple] > 1, 0b101, 0b0001) | only[simple] << 3),
        (stream_of[full], 8 * full, np.full(len(full), 35), 15 << 1 | (tell[:, :10] << (5 + 3 * np.arange(10))).sum(axis=1)),
        (stream_of[full], 8 * full + 1, np.full(len(full), 28), (tell[:, 10:] << (3 * np.arange(9))).sum(axis=1)),
        (stream_of[full[alphabet]], 8 * full[alphabet] + 2, inner_sizes[at] + extra_bits, inner_codes[at] | extra << inner_sizes[at]),
        (of, 8 * (first_code + 5 * groups - 1)[of] + 4, bits, number),
    ]
    stream, key, bits, number = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(key, kind="stable")
    bits, number, image = bits[order], number[order].astype(np.uint64), np.array(streams.images)[stream[order]]
    # each image begins at a word of its own
    end = np.cumsum(bits)
    cuts = np.searchsorted(image, np.arange(n_images + 1))
    reached = np.append(0, end)[cuts]
    total = np.diff(reached)
    words = (total + 63) >> 6
    base = np.cumsum(words) - words
    place = end - bits + ((base << 6) - reached[:-1])[image]
    shift = (place & 63).astype(np.uint64)
    low, high = number << shift, number >> np.uint64(1) >> (np.uint64(63) - shift)
    word = place >> 6
    new = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    out[word[new]] = np.bitwise_or.reduceat(low, new)
    over = np.flatnonzero(high)  # one item at most goes on into a word
    out[word[over] + 1] |= high[over]
    held, files = memoryview(out.view(np.uint8)), []
    for at, size in zip((8 * base).tolist(), ((total + 7) >> 3).tolist(), strict=True):
        pad = size & 1
        files.append(b"RIFF" + struct.pack("<I", 12 + size + pad) + b"WEBPVP8L" + struct.pack("<I", size) + bytes(held[at : at + size]) + b"\0" * pad)
    return files


def encode_all(payloads: list) -> list[bytes]:
    """Each of the payloads, of a multiple of 192 bytes, as lossless WebP."""
    parts = [(k, p[at : at + UNIT * MOST_ROWS]) for k, p in enumerate(payloads) for at in range(0, len(p), UNIT * MOST_ROWS)]
    out: list[list[bytes]] = [[] for _ in payloads]
    at = 0
    while at < len(parts):
        to, held = at, 0
        while to < len(parts) and (to == at or held + len(parts[to][1]) <= BATCH):
            held += len(parts[to][1])
            to += 1
        for (k, _), image in zip(parts[at:to], images([p for _, p in parts[at:to]]), strict=True):
            out[k].append(image)
        at = to
    return [b"".join(x) for x in out]


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]
