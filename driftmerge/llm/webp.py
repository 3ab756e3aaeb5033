"""Lossless WebP pictures: a decoder of the whole bit stream, and an encoder that picks for each picture the parts it gains by.

Decoding reads prefix codes (simple and run-coded ones, with one group or an entropy image), literals, back-references and the
colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Pixels are ARGB numbers while a
stream is read, and come out as an array of height x width x 4 bytes in the order R, G, B, A.
"""

from __future__ import annotations

import functools
import struct
from array import array

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
MAX_SIDE = 1 << 14
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_SYMBOLS, DISTANCE_SYMBOLS = 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

#: Codes that we write are at most this long, so that tables of them are small; the format allows 15 bits.
LONGEST = 11
#: How much longer than the best code the usual one for text may make a picture.
USUAL = 1.15


class WebPError(ValueError):
    """Bytes that are no lossless WebP."""


# Prefix codes.


def _tree_depths(weights: list[int]) -> list[int]:
    """Depths of the leaves of an optimal tree over weights in ascending order; merged weights ascend too, so two queues do."""
    n = len(weights)
    merged, parent = [0] * (n - 1), [0] * (2 * n - 1)
    leaf = node = 0
    for made in range(n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (node >= made or weights[leaf] <= merged[node]):
                total += weights[leaf]
                parent[leaf] = n + made
                leaf += 1
            else:
                total += merged[node]
                parent[n + node] = n + made
                node += 1
        merged[made] = total
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return depth[:n]


def code_lengths(counts: np.ndarray, most: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code for the symbols that occur, none longer than ``most``; 0 for the others."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64)
    most = max(most, len(used).bit_length())  # many symbols need longer codes
    while True:
        order = np.argsort(weight, kind="stable")
        lengths = _tree_depths(weight[order].tolist())
        if lengths[0] <= most:
            out[used[order]] = lengths
            return out
        weight = np.maximum(weight, 2 * weight.min() + 1)  # flatter


@functools.cache
def _reversed(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in the other order."""
    n = np.arange(1 << bits)
    out = np.zeros(1 << bits, np.int64)
    for i in range(bits):
        out |= (n >> i & 1) << (bits - 1 - i)
    return out


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that have a code, shorter codes first, and the places that each takes up in a table of the longest code's bits."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, 1 << (lengths[used[-1]] - lengths[used])


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, with its first bit lowest, as streams hold them."""
    codes = np.zeros(len(lengths), np.int64)
    used, places = _in_order(lengths)
    codes[used] = _reversed(int(lengths[used[-1]]))[np.cumsum(places) - places]
    return codes


class Table:
    """Look-up of a code by its next bits: entries are symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        self.summed: dict[int, list[int]] = {}
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.mask, self.array = 0, np.array([int(used[0]) << 4 if len(used) else 0])
            return
        used, places = _in_order(lengths)
        bits = int(lengths[used[-1]])
        if int(places.sum()) != 1 << bits:
            raise WebPError("a prefix code that isn't complete")
        self.mask, self.array = (1 << bits) - 1, np.repeat(used << 4 | lengths[used], places)[_reversed(bits)]

    @functools.cached_property
    def entries(self) -> memoryview:
        return memoryview(np.ascontiguousarray(self.array, np.int64))


@functools.lru_cache(maxsize=256)
def _table(lengths: tuple[int, ...]) -> Table:
    return Table(np.array(lengths, np.int64))


# Reading.


class Bits:
    """Bits of a stream, first ones lowest. ``window[i]`` has the 64 bits from byte i on; beyond the end there are zeros."""

    def __init__(self, data: bytes):
        self.size = 8 * len(data)
        padded = np.zeros(len(data) + 16, np.uint64)
        padded[: len(data)] = np.frombuffer(data, np.uint8)
        window = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            window |= padded[i : i + len(window)] << np.uint64(8 * i)
        self.words = window
        self.window = memoryview(window)
        self.whole = int.from_bytes(data, "little")
        self.at = 0

    def read(self, n: int) -> int:
        """Up to 57 bits."""
        if self.at + n > self.size:
            raise WebPError("the stream ends too early")
        out = self.window[self.at >> 3] >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: Table) -> int:
        entry = table.entries[self.window[min(self.at, self.size) >> 3] >> (self.at & 7) & table.mask]
        self.at += entry & 15
        return entry >> 4


#: Codes that were read: by alphabet and the first 64 bits, the bits that hold the whole code, how many they are, and its table.
_codes: dict[tuple[int, int], tuple[int, int, Table]] = {}
_CODES = 1024


def _read_table(bits: Bits, size: int) -> Table:
    """The next code; pictures of like texts hold the same codes, so those that were read lately aren't read again."""
    begin = bits.at
    rest = bits.whole >> begin
    key = size, rest & 0xFFFFFFFFFFFFFFFF
    held, n, table = _codes.get(key, (0, 0, None))
    if table is not None and rest & ((1 << n) - 1) == held and begin + n <= bits.size:
        bits.at += n
        return table
    table = _read_new_table(bits, size)
    if len(_codes) >= _CODES:
        _codes.clear()
    n = bits.at - begin
    _codes[key] = rest & ((1 << n) - 1), n, table
    return table


def _read_new_table(bits: Bits, size: int) -> Table:
    if bits.read(1):  # one or two symbols
        two = bits.read(1)
        found = {bits.read(8 if bits.read(1) else 1), *([bits.read(8)] if two else [])}
        if max(found) >= size:
            raise WebPError("a symbol beyond its alphabet")
        lengths = [0] * (max(found) + 1)
        for symbol in found:
            lengths[symbol] = 1
        return _table(tuple(lengths))
    first = np.zeros(19, np.int64)
    n = bits.read(4) + 4
    lengths = bits.read(3 * n)
    for i in range(n):
        first[CODE_LENGTH_ORDER[i]] = lengths >> 3 * i & 7
    table = Table(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    held: list[int] = []
    last, window, at, entries, mask = 8, bits.window, bits.at, table.entries, table.mask
    while len(held) < size and left:
        left -= 1
        if at > bits.size:
            raise WebPError("the stream ends too early")
        w = window[at >> 3] >> (at & 7)
        entry = entries[w & mask]
        n, s = entry & 15, entry >> 4
        at += n
        if s < 16:
            held.append(s)
            last = s or last
        elif s == 16:
            held += [last] * (3 + (w >> n & 3))
            at += 2
        elif s == 17:
            held += [0] * (3 + (w >> n & 7))
            at += 3
        else:
            held += [0] * (11 + (w >> n & 127))
            at += 7
    bits.at = at
    if len(held) > size:
        raise WebPError("code lengths beyond the alphabet")
    return _table(tuple(held))


def _prefix_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _reference(bits: Bits, symbol: int, distance: Table, width: int) -> tuple[int, int]:
    """Length and distance of a reference whose length's symbol is read."""
    length = _prefix_value(bits, symbol)
    code = _prefix_value(bits, bits.symbol(distance))
    if code > len(NEAR):
        return length, code - len(NEAR)
    x, y = NEAR[code - 1]
    return length, max(1, x + y * width)


def _summed(table: Table, shift: int) -> list[int]:
    """A table's entries as symbol << shift + 6 | length."""
    found = table.summed.get(shift)
    if found is None:
        found = table.summed[shift] = (table.array >> 4 << shift + 6 | table.array & 15).tolist()
    return found


class Stream:
    """An entropy-coded image whose codes are read and whose pixels aren't yet."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.bits, self.width, self.height, self.total = bits, width, height, width * height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise WebPError("a colour cache of more than 11 bits")
        self.groups, self.shift, self.across = None, 0, 0
        n_groups = 1
        if main and bits.read(1):
            self.shift = bits.read(3) + 2
            self.across = -(-width >> self.shift)
            self.groups = [p >> 8 & 0xFFFF for p in Stream(bits, self.across, -(-height >> self.shift), False).pixels()]
            n_groups = max(self.groups) + 1
        alphabets = (256 + LENGTH_SYMBOLS + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, DISTANCE_SYMBOLS)
        self.codes = [[_read_table(bits, n) for n in alphabets] for _ in range(n_groups)]
        #: With one group and one alpha value, pixels that aren't references can be read together with those of other streams.
        self.plain = self.groups is None and not self.codes[0][3].mask

    def pixels(self, first: np.ndarray | None = None) -> array:
        """All pixels as ARGB numbers; ``first`` are those that read_together() has read already."""
        bits, width, total, groups, shift, across, codes = self.bits, self.width, self.total, self.groups, self.shift, self.across, self.codes
        out = array("I")
        if first is not None:
            out.frombytes(first.astype(np.uint32).tobytes())
        cache_size = 1 << self.cache_bits if self.cache_bits else 0
        cache, cached, back = [0] * cache_size, 0, 32 - self.cache_bits  # pixels from ``cached`` on aren't in the cache yet
        green, red, blue, alpha, distance = codes[0]
        window, size = bits.window, bits.size
        g_table, g_mask, r_table, r_mask, b_table, b_mask, a_table, a_mask = green.entries, green.mask, red.entries, red.mask, blue.entries, blue.mask, alpha.entries, alpha.mask
        n, at = len(out), bits.at
        # A literal's entries add up: colours above 6 bits of length.
        plain = self.plain and total - n > LONG
        if plain:
            gs, rs, bs = _summed(green, 8), _summed(red, 16), _summed(blue, 0)
            opaque, limit, append = a_table[0] >> 4 << 30, 256 << 14, out.append
        while n < total:
            if plain:
                try:
                    for n in range(n, total):  # noqa: B020
                        w = window[at >> 3] >> (at & 7)
                        e = gs[w & g_mask]
                        if e >= limit:
                            break
                        e += rs[w >> (e & 63) & r_mask]
                        e += bs[w >> (e & 63) & b_mask]
                        at += e & 63
                        append((e | opaque) >> 6)
                    else:
                        break
                except IndexError:
                    raise WebPError("the stream ends too early") from None
            if groups is not None:
                green, red, blue, alpha, distance = codes[groups[(n // width >> shift) * across + (n % width >> shift)]]
                g_table, g_mask, r_table, r_mask, b_table, b_mask, a_table, a_mask = green.entries, green.mask, red.entries, red.mask, blue.entries, blue.mask, alpha.entries, alpha.mask
            if at > size:
                raise WebPError("the stream ends too early")
            w = window[at >> 3] >> (at & 7)
            g = g_table[w & g_mask]
            bits_used = g & 15
            g >>= 4
            if g < 256:
                r = r_table[w >> bits_used & r_mask]
                bits_used += r & 15
                b = b_table[w >> bits_used & b_mask]
                bits_used += b & 15
                at += bits_used
                a = a_table[window[at >> 3] >> (at & 7) & a_mask] if a_mask else a_table[0]
                at += a & 15
                out.append(a >> 4 << 24 | r >> 4 << 16 | g << 8 | b >> 4)
                n += 1
            elif g < 256 + LENGTH_SYMBOLS:
                bits.at = at + bits_used
                length, code = _reference(bits, g - 256, distance, width)
                at = bits.at
                if code > n or n + length > total:
                    raise WebPError("a back-reference outside the picture")
                if code >= length:
                    out += out[n - code : n - code + length]
                else:
                    out += (out[n - code :] * (length // code + 1))[:length]
                n += length
            else:
                at += bits_used
                for p in out[cached:]:
                    cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> back] = p
                cached = n
                out.append(cache[g - 256 - LENGTH_SYMBOLS])
                n += 1
        bits.at = at
        if at > size:
            raise WebPError("the stream ends too early")
        return out


#: Pixels from which on a stream that is read alone has tables of its own made; fewer streams than FEW are read one by one.
LONG, FEW = 1024, 32
#: Streams that have ended are put aside after so many steps.
STEPS = 16


def read_together(streams: list[Stream]) -> list[np.ndarray | None]:
    """The first pixels of each stream, mostly all; None for streams that have to be read alone.

    One pixel, cache index or reference of every stream is read at a time. A stream's place in its bits moves on, so pixels()
    goes on from there.
    """
    found: list[np.ndarray | None] = [None] * len(streams)
    which = [i for i, s in enumerate(streams) if s.plain]
    if len(which) < FEW:
        return found
    chosen = [streams[i] for i in which]
    number: dict[int, int] = {}
    kinds: list[np.ndarray] = []

    def begins(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the k-th tables of the streams begin among all, and their masks."""
        at = []
        for s in chosen:
            table = s.codes[0][k]
            if id(table) not in number:
                number[id(table)] = sum(map(len, kinds[-1:])) + (starts[-1] if starts else 0)
                starts.append(number[id(table)])
                kinds.append(table.array)
            at.append(number[id(table)])
        return np.array(at), np.array([s.codes[0][k].mask for s in chosen])

    starts: list[int] = []
    (g_at, g_mask), (r_at, r_mask), (b_at, b_mask) = begins(0), begins(1), begins(2)
    entries = np.concatenate(kinds)
    sizes = np.array([len(s.bits.words) for s in chosen])
    word = (np.concatenate([s.bits.words for s in chosen]) & np.uint64((1 << 56) - 1)).view(np.int64)
    base, last = np.cumsum(sizes) - sizes, np.array([s.bits.size for s in chosen])
    at, total = np.array([s.bits.at for s in chosen]), np.array([s.total for s in chosen])
    opaque = np.array([s.codes[0][3].entries[0] >> 4 << 24 for s in chosen])
    cache_bits = np.array([s.cache_bits for s in chosen])
    cache_at, back = np.cumsum(1 << cache_bits) - (1 << cache_bits), 32 - cache_bits
    cache, cached = np.zeros(int((1 << cache_bits).sum()), np.int64), bool(cache_bits.any())
    begin = np.cumsum(total + 1) - (total + 1)  # a place more for each, which streams that have ended write to
    to, out = begin, np.zeros(int((total + 1).sum()), np.int64)
    row, pos = np.arange(len(chosen)), np.zeros(len(chosen), np.int64)
    stop, ends = pos.copy(), at.copy()  # pixels read, and the place after them
    step = 0
    while True:
        if step % STEPS == 0:
            live = pos < total
            ends[row], stop[row] = at, pos
            if not live.all():
                row, pos, at, base, last, to, total, opaque, cache_at, back, g_at, g_mask, r_at, r_mask, b_at, b_mask = (x[live] for x in (row, pos, at, base, last, to, total, opaque, cache_at, back, g_at, g_mask, r_at, r_mask, b_at, b_mask))
            if len(row) < FEW:
                break
        step += 1
        w = word[base + np.minimum(at, last) // 8] >> (at & 7)
        g = entries[g_at + (w & g_mask)]
        w >>= g & 15
        r = entries[r_at + (w & r_mask)]
        w >>= r & 15
        b = entries[b_at + (w & b_mask)]
        moved = (g & 15) + (r & 15) + (b & 15)
        colour = opaque | r >> 4 << 16 | g >> 4 << 8 | b >> 4
        live = pos < total
        references = ()
        if (g >= 256 << 4).any():
            hit = np.flatnonzero(g >= 256 + LENGTH_SYMBOLS << 4)
            colour[hit] = cache[cache_at[hit] + (g[hit] >> 4) - 256 - LENGTH_SYMBOLS]
            moved[hit] = g[hit] & 15
            copied = (g >= 256 << 4) & (g < 256 + LENGTH_SYMBOLS << 4) & live
            references = np.flatnonzero(copied).tolist()
            live &= ~copied
        out[to + pos] = colour
        if cached:
            cache[(cache_at + ((colour * CACHE_FACTOR & 0xFFFFFFFF) >> back))[live]] = colour[live]
        at = at + np.where(live, moved, 0)
        pos = pos + live
        for k in references:
            s = chosen[row[k]]
            s.bits.at = int(at[k]) + int(g[k] & 15)
            length, code = _reference(s.bits, int(g[k] >> 4) - 256, s.codes[0][4], s.width)
            n = int(pos[k])
            if code > n or n + length > total[k]:
                raise WebPError("a back-reference outside the picture")
            here = int(to[k]) + n
            source = out[here - code : here]
            out[here : here + length] = source[:length] if code >= length else np.tile(source, length // code + 1)[:length]
            if cached:
                copy = out[here : here + length]
                cache[cache_at[k] + ((copy * CACHE_FACTOR & 0xFFFFFFFF) >> back[k])] = copy  # the last of a slot stays
            at[k], pos[k] = s.bits.at, n + length
    if (ends > np.array([s.bits.size for s in chosen])).any():
        raise WebPError("the stream ends too early")
    for k, i in enumerate(which):
        streams[i].bits.at = int(ends[k])
        found[i] = out[begin[k] : begin[k] + stop[k]]
    return found


# Transforms, on arrays of height x width x 4 bytes in the order B, G, R, A.


def _array(pixels: array, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint32).view(np.uint8).reshape(height, width, 4)


def _average(a, b):
    return (a.astype(np.int64) + b) >> 1


def _select(left, top, corner):
    horizontal, vertical = np.abs(top.astype(np.int64) - corner).sum(-1), np.abs(left.astype(np.int64) - corner).sum(-1)
    return np.where((horizontal < vertical)[..., None], left, top)


def _predicted(mode: int, left, top, right, corner):
    """Predictions of pixels from the left, top, top-right and top-left ones (int64, any shape ending in 4)."""
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
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case 13:
            half = _average(left, top)
            gap = half - corner
            return np.clip(half + np.where(gap < 0, -(-gap // 2), gap // 2), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)


def _around(rows: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top, top-right and top-left of row y's pixels; the last pixel's top-right is the row's own first."""
    top = rows[y - 1].astype(np.int64)
    right = np.concatenate([top[1:], rows[y, :1].astype(np.int64)])
    corner = np.concatenate([top[:1], top[:-1]])
    return top, right, corner


def _undo_predictor(residual: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width, _ = residual.shape
    out = residual.copy()
    out[0, 0, 3:] += np.uint8(255)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        out[y, 0] += out[y - 1, 0]
        top, right, corner = _around(out, y)
        for block in range(-(-width >> shift)):
            mode, x0, x1 = int(modes[y >> shift, block]), max(1, block << shift), min(width, (block + 1) << shift)
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:  # nothing of this row but its first pixel
                cut = slice(x0, x1)
                out[y, cut] += _predicted(mode, top[cut], top[cut], right[cut], corner[cut]).astype(np.uint8)
                continue
            if mode == 1:
                out[y, x0 - 1 : x1] = np.cumsum(out[y, x0 - 1 : x1], axis=0, dtype=np.uint8)
                continue
            for x in range(x0, x1):
                out[y, x] += _predicted(mode, out[y, x - 1].astype(np.int64), top[x], right[x], corner[x]).astype(np.uint8)
    return out


def _predictor_residual(pixels: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width, _ = pixels.shape
    out = pixels.copy()
    out[0, 1:] -= pixels[0, :-1]
    out[0, 0, 3:] -= np.uint8(255)
    for y in range(1, height):
        out[y, 0] -= pixels[y - 1, 0]
        top, right, corner = _around(pixels, y)
        left = np.concatenate([top[:1], pixels[y, :-1].astype(np.int64)])
        for block in range(-(-width >> shift)):
            cut = slice(max(1, block << shift), min(width, (block + 1) << shift))
            out[y, cut] -= _predicted(int(modes[y >> shift, block]), left[cut], top[cut], right[cut], corner[cut]).astype(np.uint8)
    return out


def _cross(pixels: np.ndarray, factors: np.ndarray, shift: int, undo: bool) -> np.ndarray:
    """factors: blocks x 4 bytes of green-to-red, green-to-blue, red-to-blue."""
    height, width, _ = pixels.shape
    out = pixels.copy()
    by = np.repeat(np.repeat(factors, 1 << shift, 0)[:height], 1 << shift, 1)[:, :width].view(np.int8).astype(np.int64)
    delta = lambda factor, colour: (factor * colour.view(np.int8).astype(np.int64) >> 5).astype(np.uint8)
    green, sign = np.ascontiguousarray(pixels[..., 1]), 1 if undo else -1
    red = pixels[..., 2] + (delta(by[..., 0], green) if undo else -delta(by[..., 0], green))
    true_red = np.ascontiguousarray(red if undo else pixels[..., 2])
    shift_blue = delta(by[..., 1], green) + delta(by[..., 2], true_red)
    out[..., 2] = red
    out[..., 0] = pixels[..., 0] + (shift_blue if sign > 0 else -shift_blue)
    return out


def _packing(colours: int) -> int:
    """How many bits the width shrinks by when so few colours share a byte."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(packed: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    shift = _packing(len(table))
    index = packed[..., 1]
    if shift:
        per = 8 >> shift
        index = (index[..., None] >> (np.arange(1 << shift) * per).astype(np.uint8)) & np.uint8((1 << per) - 1)
        index = index.reshape(len(packed), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


class Picture:
    """A picture whose header and transforms are read, and the stream of its pixels."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            raise WebPError("no WebP file")
        at = 12
        while data[at : at + 4] not in (b"VP8L", b""):
            at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] != b"VP8L" or at + 8 + size > len(data):
            raise WebPError("no lossless picture")
        bits = Bits(data[at + 8 : at + 8 + size])
        if bits.read(8) != SIGNATURE:
            raise WebPError("no lossless picture")
        width, height = bits.read(14) + 1, bits.read(14) + 1
        self.alpha = bits.read(1)
        if bits.read(3):
            raise WebPError("an unknown version")
        self.undo, across = [], width
        while bits.read(1):
            kind = bits.read(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                shift = bits.read(3) + 2
                w, h = -(-across >> shift), -(-height >> shift)
                self.undo.append((kind, _array(Stream(bits, w, h, False).pixels(), w, h), shift))
            elif kind == PALETTE:
                n = bits.read(8) + 1
                table = np.cumsum(_array(Stream(bits, n, 1, False).pixels(), n, 1)[0], axis=0, dtype=np.uint8)
                self.undo.append((kind, table, across))
                across = -(-across >> _packing(n))
            else:
                self.undo.append((kind, None, 0))
        self.stream = Stream(bits, across, height, True)

    def finished(self, first: np.ndarray | None = None) -> np.ndarray:
        """height x width x 4 bytes, R, G, B, A; ``first`` as in Stream.pixels."""
        pixels = _array(self.stream.pixels(first), self.stream.width, self.stream.height)
        for kind, what, shift in reversed(self.undo):
            if kind == PREDICTOR:
                pixels = _undo_predictor(pixels, what[..., 1] & 15, shift)
            elif kind == CROSS_COLOUR:
                pixels = _cross(pixels, what, shift, True)
            elif kind == PALETTE:
                pixels = _undo_palette(pixels, what, shift)
            else:
                pixels = pixels.copy()
                pixels[..., 0] += pixels[..., 1]
                pixels[..., 2] += pixels[..., 1]
        out = pixels[..., [2, 1, 0, 3]]
        if not self.alpha:
            out[..., 3] = 255
        return out


def decode(data: bytes) -> np.ndarray:
    """Pixels of one picture: height x width x 4 bytes, R, G, B, A."""
    return Picture(data).finished()


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of several pictures; the same as decode() of each, but they are read together."""
    held = [Picture(f) for f in files]
    first = read_together([p.stream for p in held])
    return [p.finished(f) for p, f in zip(held, first, strict=True)]


def pictures(data: bytes) -> list[bytes]:
    """The files of a series, one after another."""
    out, at = [], 0
    while at < len(data):
        size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        size += size & 1
        out.append(data[at : at + size])
        at += size
    return out


# Writing.


class Writer:
    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: tuple[list[int], list[int]] = ([], [])

    def put(self, value: int, n: int) -> None:
        self.few[0].append(value)
        self.few[1].append(n)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of up to 57 bits each."""
        if self.few[0]:
            few, self.few = self.few, ([], [])
            self.many(np.array(few[0], np.uint64), np.array(few[1], np.int64))
        self.values.append(values.astype(np.uint64))
        self.sizes.append(sizes.astype(np.int64))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        self.many(np.zeros(0), np.zeros(0))
        return np.concatenate(self.values), np.concatenate(self.sizes)


def packed_bits(streams: list[list[tuple[np.ndarray, np.ndarray]]]) -> list[bytes]:
    """Bytes of each stream; a stream is a list of values with their numbers of bits, 57 at most."""
    values = np.concatenate([v for stream in streams for v, _ in stream])
    sizes = np.concatenate([n for stream in streams for _, n in stream])
    of = np.repeat(np.arange(len(streams)), [sum(len(n) for _, n in stream) for stream in streams])
    values, sizes, of = values[sizes > 0], sizes[sizes > 0], of[sizes > 0]
    total = np.bincount(of, sizes, len(streams)).astype(np.int64)
    begin = np.cumsum(total // 64 + 2) - (total // 64 + 2)  # in words, each stream's own
    at = np.cumsum(sizes) - sizes
    at += (64 * begin - (np.cumsum(total) - total))[of]
    words = np.zeros(int((total // 64 + 2).sum()), np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.add.reduceat(values << shift, first)  # bits of one word don't overlap
    over = np.flatnonzero((at & 63) + sizes > 64)
    words[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
    data = words.tobytes()
    return [data[8 * b : 8 * b + -(-n // 8)] for b, n in zip(begin.tolist(), total.tolist(), strict=True)]


@functools.cache
def usual_lengths(size: int) -> tuple[np.ndarray, np.ndarray]:
    """A code for bytes of ordinary text, and how many bits a symbol of it takes; symbols from 256 on are rare.

    Counts are by a rule: space, small letters about as often as in English, marks and line ends, all else.
    """
    counts = np.ones(size)
    for kind, n in ((range(128, 192), 4), (range(65, 91), 8), (range(48, 58), 4), (b".,\n", 60), (b"\xc3", 20), (range(97, 123), 15), (b"kv", 45), (b"bfgpwy", 75), (b"cdhlmu", 130), (b"ainorst", 290), (b"e", 430), (b" ", 700)):
        counts[list(kind)] = n
    lengths = code_lengths((counts * 4).astype(np.int64))
    return lengths, lengths.astype(float)


def chosen_lengths(counts: np.ndarray) -> np.ndarray:
    """The usual code if it is hardly longer than what the counts allow at best, else one of their own."""
    total = counts.sum()
    if total < 64 or len(counts) > 256 + LENGTH_SYMBOLS:
        return code_lengths(counts)
    used = counts[counts > 0]
    least = float((used * np.log2(total / used)).sum()) + 5.0 * len(used)  # bits of the symbols, and of the code itself
    lengths, bits = usual_lengths(len(counts))
    return lengths if float(counts @ bits) <= USUAL * least else code_lengths(counts)


@functools.lru_cache(maxsize=64)
def _written(lengths: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What writing a code puts into the stream (values and sizes), and the bits and number of bits of each symbol."""
    out = Writer()
    codes, sizes = _write_code(out, np.frombuffer(lengths, np.int64))
    return *out.tokens(), codes.astype(np.uint64), sizes


def _write_code(out: Writer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code; the bits and number of bits of each symbol."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and used.max(initial=0) < 256:
        out.put(1, 1)
        out.put(max(0, len(used) - 1), 1)
        out.put(1, 1)
        for s in used.tolist() or [0]:
            out.put(s, 8)
        codes, sizes = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        if len(used) == 2:
            codes[used[1]] = 1
            sizes[used] = 1
        return codes, sizes
    lengths = lengths.copy()
    if len(used) == 1:  # a lone symbol of two bytes: coded with a neighbour that never comes
        lengths[used[0] - 1] = 1
    last = int(np.flatnonzero(lengths)[-1]) + 1
    begins = np.concatenate([[0], np.flatnonzero(lengths[1:last] != lengths[: last - 1]) + 1])
    run, value = np.diff(begins, append=last), lengths[begins]
    if ((value == 0) & (run > 138)).any():  # as several
        begins = np.concatenate([np.arange(x, x + n, 138) if v == 0 else [x] for x, n, v in zip(begins.tolist(), run.tolist(), value.tolist(), strict=True)])
        run, value = np.diff(begins, append=last), lengths[begins]
    zeros, many = (value == 0) & (run >= 3), run >= 11
    times = np.where(zeros, 1, run)
    symbols = np.repeat(np.where(zeros, np.where(many, 18, 17), value), times)
    extras = np.repeat(np.where(zeros, run - np.where(many, 11, 3), 0), times)
    widths = np.repeat(np.where(zeros, np.where(many, 7, 3), 0), times)
    short = code_lengths(np.bincount(symbols, minlength=19), 7)
    if np.count_nonzero(short) == 1:
        short[0 if short[0] == 0 else 1] = 1
    codes = canonical(short)
    out.put(0, 1)
    out.put(19 - 4, 4)
    held = short.tolist()
    for s in CODE_LENGTH_ORDER:
        out.put(held[s], 3)
    size = max(2, len(symbols))
    width = next(k for k in range(8) if size - 2 < 1 << (2 + 2 * k))
    out.put(1, 1)
    out.put(width, 3)
    out.put(size - 2, 2 + 2 * width)
    out.many(codes[symbols] | extras << short[symbols], short[symbols] + widths)
    if len(symbols) < 2:
        out.put(int(codes[0 if lengths[0] == 0 else symbols[0]]), int(short[symbols[0]]))
    return canonical(lengths), lengths


def _prefixed(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number for lengths or distances from 1 on."""
    n = n.astype(np.int64) - 1
    high = np.where(n > 0, np.floor(np.log2(np.maximum(n, 1) + 0.5)).astype(np.int64), 0)
    extra = np.where(n < 4, 0, high - 1)
    symbol = np.where(n < 4, n, 2 * high + (n >> np.maximum(high - 1, 0) & 1))
    return symbol, n & ((1 << extra) - 1), extra


#: Pixels that a reference copies, and words of them that are sought.
LEAST_RUN, LONGEST_RUN = 4, 4096
#: A reference goes back so far at most.
FARTHEST = (1 << 20) - len(NEAR)


def repeats(argb: np.ndarray, of: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of runs that equal what is nearest before in their image, in order and apart; of: each pixel's image."""
    n = len(argb) - LEAST_RUN + 1
    if n < 2:
        return []
    key = np.zeros(n, np.uint64)
    for i in range(LEAST_RUN):
        key = (key ^ argb[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    place = np.uint64((1 << n.bit_length()) - 1)
    key = np.sort(key & ~place | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero((key[1:] ^ key[:-1]) <= place)
    here, there = (key[same + 1] & place).astype(np.int64), (key[same] & place).astype(np.int64)
    right = (of[here + LEAST_RUN - 1] == of[there]) & (here - there <= FARTHEST)
    for i in range(LEAST_RUN):
        right &= argb[here + i] == argb[there + i]
    distance = np.zeros(n + 1, np.int64)
    distance[here[right]] = (here - there)[right]
    starts = np.flatnonzero(np.diff(distance, prepend=0))
    kept, end = [], 0
    for a, b, d in zip(starts[:-1].tolist(), starts[1:].tolist(), distance[starts].tolist(), strict=False):
        if not d:
            continue
        a, b = max(a, end), b + LEAST_RUN - 1
        kept += [(x, min(LONGEST_RUN, b - x), d) for x in range(a, b, LONGEST_RUN) if b - x >= LEAST_RUN]
        end = kept[-1][0] + kept[-1][1] if kept else 0
    return kept


@functools.lru_cache(maxsize=16)
def _near_codes(width: int) -> dict[int, int]:
    """Codes of the distances to near pixels."""
    return {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}


def _slots(argb: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Each pixel's slot in a cache of so many bits."""
    return ((argb.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> (32 - bits).astype(np.uint64)).astype(np.int64)


def _cache_hits(argb: np.ndarray, slot: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each pixel, whether the cache has it: the pixel before it in its image's slot is the same colour."""
    n = max(1, len(argb))
    order = np.sort(((of << 11) + slot) * n + np.arange(len(argb)))
    at, group = order % n, order // n
    hit = np.zeros(len(argb), bool)
    hit[at[1:][(group[1:] == group[:-1]) & (argb[at[1:]] == argb[at[:-1]])]] = True
    return hit


class Image:
    """Pixels that one group of codes is written for."""

    def __init__(self, argb: np.ndarray, width: int, main: bool = False, cache_bits: int = 0, references: bool = False):
        self.argb, self.width, self.main, self.cache_bits, self.references = argb, width, main, cache_bits, references


def _tokens(images: list[Image]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """What each image puts into its stream: values with their numbers of bits. All are counted and coded together."""
    sizes = np.array([len(x.argb) for x in images])
    argb, of = np.concatenate([x.argb for x in images]), np.repeat(np.arange(len(images)), sizes)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    colour = argb.astype(np.int64)
    green, red, blue, alpha = colour >> 8 & 255, colour >> 16 & 255, colour & 255, colour >> 24
    literal, found = np.ones(len(argb), bool), []
    allowed = np.repeat([x.references for x in images], sizes)
    if allowed.any():
        at = np.flatnonzero(allowed)
        found = [(int(at[a]), n, d) for a, n, d in repeats(argb[at], of[at])]
        for start, length, _ in found:
            literal[start : start + length] = False
    token, plain, symbol = literal.copy(), literal, green.copy()
    cache_bits = np.array([x.cache_bits for x in images])
    if cache_bits.any():
        at = np.flatnonzero(cache_bits[of] > 0)
        slot = _slots(argb[at], cache_bits[of[at]])
        hit = _cache_hits(argb[at], slot, of[at]) & literal[at]
        symbol[at[hit]] = 256 + LENGTH_SYMBOLS + slot[hit]
        plain = literal.copy()
        plain[at[hit]] = False
    distance_counts = np.zeros((len(images), DISTANCE_SYMBOLS), np.int64)
    if found:
        starts = np.array([r[0] for r in found], np.int64)
        length_symbol, length_extra, length_bits = _prefixed(np.array([r[1] for r in found], np.int64))
        distance_symbol, distance_extra, distance_bits = _prefixed(np.array([_near_codes(images[i].width).get(d, d + len(NEAR)) for (_, _, d), i in zip(found, of[starts].tolist(), strict=True)], np.int64))
        symbol[starts] = 256 + length_symbol
        token[starts] = True
        np.add.at(distance_counts, (of[starts], distance_symbol), 1)
    alphabet = 256 + LENGTH_SYMBOLS + np.where(cache_bits > 0, 1 << cache_bits, 0)
    begin = np.cumsum(alphabet) - alphabet
    green_counts = np.bincount((begin[of] + symbol)[token], minlength=int(alphabet.sum()))
    some = of[plain] << 8
    ends_counts = np.bincount(np.concatenate([some + red[plain], some + blue[plain]]), minlength=len(images) << 8).reshape(-1, 256)  # one code for both channels
    alpha_counts = np.bincount(some + alpha[plain], minlength=len(images) << 8).reshape(-1, 256)
    green_code, green_size = np.zeros(len(green_counts), np.uint64), np.zeros(len(green_counts), np.int64)
    (ends_code, ends_size), (alpha_code, alpha_size) = ((np.zeros((len(images), 256), np.uint64), np.zeros((len(images), 256), np.int64)) for _ in range(2))
    distance_code, distance_size = np.zeros(distance_counts.shape, np.uint64), np.zeros(distance_counts.shape, np.int64)
    heads = []
    for i, image in enumerate(images):
        cut = slice(begin[i], begin[i] + alphabet[i])
        out = Writer()
        out.put(image.cache_bits > 0, 1)
        if image.cache_bits:
            out.put(image.cache_bits, 4)
        if image.main:
            out.put(0, 1)
        g, e = _written(chosen_lengths(green_counts[cut]).tobytes()), _written(chosen_lengths(ends_counts[i]).tobytes())
        a, d = _written(_few_lengths(alpha_counts[i]).tobytes()), _written(_few_lengths(distance_counts[i]).tobytes())
        green_code[cut], green_size[cut] = g[2:]
        ends_code[i], ends_size[i] = e[2:]
        alpha_code[i], alpha_size[i] = a[2:]
        distance_code[i], distance_size[i] = d[2:]
        heads.append([out.tokens(), *(x[:2] for x in (g, e, e, a, d))])
    values, n = green_code[begin[of] + symbol], green_size[begin[of] + symbol]
    v, bits = values[plain], n[plain]
    for code, size, channel in ((ends_code, ends_size, red), (ends_code, ends_size, blue), *([(alpha_code, alpha_size, alpha)] if alpha_size.any() else [])):
        at = some + channel[plain]
        v |= code.ravel()[at] << bits.astype(np.uint64)
        bits = bits + size.ravel()[at]
    values[plain], n[plain] = v, bits
    if found:
        v, bits = values[starts], n[starts]
        for code, size in ((length_extra, length_bits), (distance_code[of[starts], distance_symbol], distance_size[of[starts], distance_symbol]), (distance_extra, distance_bits)):
            v |= code.astype(np.uint64) << bits.astype(np.uint64)
            bits = bits + size
        values[starts], n[starts] = v, bits
    n[~token] = 0
    return [[*head, (values[a:b], n[a:b])] for head, a, b in zip(heads, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


@functools.cache
def _lone(size: int, symbol: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[symbol] = 1
    return out


def _few_lengths(counts: np.ndarray) -> np.ndarray:
    """code_lengths(), quicker for no symbol or one."""
    used = np.flatnonzero(counts)
    return code_lengths(counts) if len(used) != 1 else _lone(len(counts), int(used[0]))


def _argb(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels).view(np.uint32).ravel()


def _parts(pixels: np.ndarray, palette: bool = True, cache_bits: int = 0, references: bool = True, subtract_green: bool = False, modes: np.ndarray | None = None, factors: np.ndarray | None = None, shift: int = 4) -> list[Writer | Image]:
    """A picture's stream as numbers and images; as encode()."""
    height, width, _ = pixels.shape
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise WebPError("a picture has sides of 1 to 16384 pixels")
    parts: list[Writer | Image] = [Writer()]

    def put(*pairs: tuple[int, int]) -> None:
        if isinstance(parts[-1], Image):
            parts.append(Writer())
        for value, n in pairs:
            parts[-1].put(int(value), n)

    put((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (bool((pixels[..., 3] != 255).any()), 1), (0, 3))
    work = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]])

    def blocks(array: np.ndarray, kind: int) -> None:
        put((1, 1), (kind, 2), (shift - 2, 3))
        parts.append(Image(_argb(array), array.shape[1]))

    if palette:
        colours, index = np.unique(_argb(work), return_inverse=True)
        if len(colours) <= 256:
            put((1, 1), (PALETTE, 2), (len(colours) - 1, 8))
            table = colours.view(np.uint8).reshape(-1, 4)
            parts.append(Image(_argb(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)), len(colours)))
            squeeze = _packing(len(colours))
            index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % (1 << squeeze))))
            index = (index.reshape(height, -1, 1 << squeeze) << (np.arange(1 << squeeze) * (8 >> squeeze))).sum(-1)
            work = np.zeros((*index.shape, 4), np.uint8)
            work[..., 1], work[..., 3] = index, 255
            modes = factors = None
            subtract_green = False
    if modes is not None:
        image = np.zeros((*modes.shape, 4), np.uint8)
        image[..., 1], image[..., 3] = modes, 255
        blocks(image, PREDICTOR)
        work = _predictor_residual(work, modes, shift)
    if factors is not None:
        image = np.concatenate([factors.astype(np.uint8), np.full((*factors.shape[:2], 1), 255, np.uint8)], -1)
        blocks(image, CROSS_COLOUR)
        work = _cross(work, image, shift, False)
    if subtract_green:
        put((1, 1), (SUBTRACT_GREEN, 2))
        work = _without_green(work)
    put((0, 1))
    parts.append(Image(_argb(work), work.shape[1], True, cache_bits, references))
    return parts


def _without_green(pixels: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    out[..., 0] -= pixels[..., 1]
    out[..., 2] -= pixels[..., 1]
    return out


def _files(held: list[list[Writer | Image]]) -> list[bytes]:
    images = iter(_tokens([x for parts in held for x in parts if isinstance(x, Image)]))
    streams = [[t for x in parts for t in (next(images) if isinstance(x, Image) else [x.tokens()])] for parts in held]
    out = []
    for body in packed_bits(streams):
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        out.append(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    return out


def encode(pixels: np.ndarray, palette: bool = True, cache_bits: int = 0, references: bool = True, subtract_green: bool = False, modes: np.ndarray | None = None, factors: np.ndarray | None = None, shift: int = 4) -> bytes:
    """A picture of height x width x 4 bytes (R, G, B, A) as a file.

    palette: use one if there are 256 colours at most. modes and factors: the predictor's mode and the cross-colour factors
    (green-to-red, green-to-blue, red-to-blue) for each block of 2 ** shift pixels' side.
    """
    return _files([_parts(pixels, palette, cache_bits, references, subtract_green, modes, factors, shift)])[0]


# Choosing: what encode() is told, by estimates of the bits that each way takes.

#: Estimates are whole numbers of so many parts of a bit, so that they don't depend on the pictures that are looked at together.
PARTS = 1024
#: A symbol that occurs takes about so many bits in the code itself.
SYMBOL_BITS = 5
#: Predictors are tried where the difference to a neighbour takes at most so many hundredths of what the best other way does.
PROMISING = 110
#: A cache is used where it takes at most so many hundredths of what the best way without one does; its code is long to write and read.
PAYS = 97
#: Side of the blocks that have a predictor, as a power of two.
BLOCK = 4

_logs = np.zeros(1, np.int64)


def _n_log_n(n: np.ndarray) -> np.ndarray:
    global _logs
    if (most := int(n.max(initial=0))) >= len(_logs):
        x = np.arange(2 * most + 1)
        _logs = np.rint(x * np.log2(np.maximum(x, 1)) * PARTS).astype(np.int64)
    return _logs[n]


def _bits(counts: np.ndarray) -> np.ndarray:
    """Estimate for each row of counts."""
    return _n_log_n(counts.sum(-1)) - _n_log_n(counts).sum(-1) + SYMBOL_BITS * PARTS * (counts > 0).sum(-1)


def _channel_bits(bgra: np.ndarray, of: np.ndarray, n: int, where: np.ndarray | None = None) -> np.ndarray:
    """Estimate for the colours of pixels (rows of B, G, R, A) that are coded as literals."""
    b, g, r = ((of << 8) + bgra[:, c] for c in range(3))
    if where is not None:
        b, g, r = b[where], g[where], r[where]
    green = np.bincount(g, minlength=n << 8).reshape(n, 256)
    ends = np.bincount(np.concatenate([b, r]), minlength=n << 8).reshape(n, 256)
    return _bits(green) + _bits(ends)


def _summed_by(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _magnitude_bits() -> np.ndarray:
    """About the bits that a difference takes, by its size."""
    x = np.abs(np.arange(256).astype(np.uint8).view(np.int8).astype(np.int64))
    return np.rint(2 * np.log2(1 + x) * PARTS).astype(np.int64)


_MAGNITUDE = _magnitude_bits()


def predictors(bgra: np.ndarray) -> np.ndarray:
    """Mode of each block: the one whose differences are the smallest."""
    height, width, _ = bgra.shape
    rows, columns = -(-height >> BLOCK), -(-width >> BLOCK)
    cost = np.zeros((14, rows, columns), np.int64)
    for mode in range(14):
        each = _MAGNITUDE[_predictor_residual(bgra, np.full((rows, columns), mode), BLOCK)].sum(-1)
        each = np.pad(each, ((0, -height % (1 << BLOCK)), (0, -width % (1 << BLOCK))))
        cost[mode] = each.reshape(rows, 1 << BLOCK, columns, 1 << BLOCK).sum((1, 3))
    return cost.argmin(0).astype(np.uint8)


def cross_factors(bgra: np.ndarray) -> np.ndarray:
    """Factors of each block by least squares: green to red, green to blue, then red to what is left of blue."""
    height, width, _ = bgra.shape
    rows, columns = -(-height >> BLOCK), -(-width >> BLOCK)
    wide = np.pad(bgra, ((0, -height % (1 << BLOCK)), (0, -width % (1 << BLOCK)), (0, 0))).view(np.int8).astype(np.int64)
    b, g, r = (wide[..., c].reshape(rows, 1 << BLOCK, columns, 1 << BLOCK) for c in range(3))
    fit = lambda x, y: np.clip(np.rint(32 * (x * y).sum((1, 3)) / np.maximum((x * x).sum((1, 3)), 1)), -128, 127).astype(np.int64)
    to_red, to_blue = fit(g, r), fit(g, b)
    rest = b - (to_blue[:, None, :, None] * g >> 5)
    return np.stack([to_red, to_blue, fit(r, rest)], -1).astype(np.int8).view(np.uint8)


def _predicting(pixels: np.ndarray) -> tuple[int, dict]:
    """Estimate of the best way with predictors, and what encode() is told then."""
    bgra = np.ascontiguousarray(pixels[..., [2, 1, 0, 3]])
    modes = predictors(bgra)
    rest = _predictor_residual(bgra, modes, BLOCK)
    factors = cross_factors(rest)
    image = np.concatenate([factors, np.full((*factors.shape[:2], 1), 255, np.uint8)], -1)
    block_bits = int(_channel_bits(image.reshape(-1, 4), np.zeros(modes.size, np.int64), 1)[0])
    mode_bits = int(_bits(np.bincount(modes.ravel(), minlength=16)[None])[0])
    ways = ((rest, 0, {}), (_without_green(rest), 0, {"subtract_green": True}), (_cross(rest, image, BLOCK, False), block_bits, {"factors": factors}))
    of = np.zeros(bgra.shape[0] * bgra.shape[1], np.int64)
    bits = [int(_channel_bits(x.reshape(-1, 4), of, 1)[0]) + more for x, more, _ in ways]
    best = bits.index(min(bits))
    return bits[best] + mode_bits, {"palette": False, "modes": modes, "shift": BLOCK} | ways[best][2]


def chosen(pictures: list[np.ndarray]) -> list[dict]:
    """What encode() is told for each picture; a picture's choice doesn't depend on the others."""
    n, sizes = len(pictures), np.array([p.shape[0] * p.shape[1] for p in pictures])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(n), sizes)
    bgra = np.concatenate([p.reshape(-1, 4) for p in pictures])[:, [2, 1, 0, 3]]
    argb = _argb(bgra)
    direct = _channel_bits(bgra, of, n)
    green = _channel_bits(_without_green(bgra), of, n)
    # A palette: the colours' differences, and the indexes.
    keys, many = np.unique(of << 32 | argb, return_counts=True)
    owner = keys >> 32
    colours = np.bincount(owner, minlength=n)
    table = _argb_bytes(keys)
    before = np.zeros_like(table)
    before[1:] = np.where((owner[1:] == owner[:-1])[:, None], table[:-1], 0)
    of_colours = np.concatenate([[0], np.cumsum(colours)])
    indexes = _n_log_n(sizes) - _summed_by(_n_log_n(many), of_colours) + SYMBOL_BITS * PARTS * colours
    palette = np.where(colours <= 256, _channel_bits(table - before, owner, n) + indexes, np.iinfo(np.int64).max)
    palette[colours <= 16] = 0  # several pixels share a byte
    # A cache of a slot for every two to four colours: more of them make the code longer than they save.
    bits = np.clip(np.ceil(np.log2(np.maximum(colours, 2))).astype(np.int64) - 2, 1, 11)
    slot = _slots(argb, bits[of])
    hit = _cache_hits(argb, slot, of)
    begin = np.concatenate([[0], np.cumsum(1 << bits)])
    slots = np.bincount((begin[of] + slot)[hit], minlength=int(begin[-1]))
    b, g, r = ((of << 8) + bgra[:, c] for c in range(3))
    greens = np.bincount(g[~hit], minlength=n << 8).reshape(n, 256)
    ends = np.bincount(np.concatenate([b[~hit], r[~hit]]), minlength=n << 8).reshape(n, 256)
    cache = _n_log_n(sizes) - _n_log_n(greens).sum(-1) - _summed_by(_n_log_n(slots), begin) + SYMBOL_BITS * PARTS * ((greens > 0).sum(-1) + _summed_by((slots > 0).astype(np.int64), begin)) + _bits(ends)
    best = np.minimum(np.minimum(direct, green), palette)
    caching = 100 * cache <= PAYS * best
    best = np.where(caching, cache, best)
    # Differences to the pixel before and to the one above.
    width = np.repeat([p.shape[1] for p in pictures], sizes)
    inside = np.arange(len(argb)) - edges[of]
    near = np.full(n, np.iinfo(np.int64).max)
    for back in (np.ones_like(width), width):
        other = np.where((inside >= back)[:, None], bgra[np.maximum(np.arange(len(argb)) - back, 0)], 0)
        rest = bgra - other
        near = np.minimum(near, np.minimum(_channel_bits(rest, of, n), _channel_bits(_without_green(rest), of, n)))
    out = []
    for i, picture in enumerate(pictures):
        way: dict = {"palette": False}
        if not caching[i] and palette[i] == best[i]:
            way = {"palette": True}
        elif caching[i]:
            way = {"palette": False, "cache_bits": int(bits[i])}
        elif green[i] == best[i] and green[i] < direct[i]:
            way = {"palette": False, "subtract_green": True}
        if best[i] and 100 * near[i] <= PROMISING * best[i]:
            least, how = _predicting(picture)
            way = how if least < best[i] else way
        out.append(way)
    return out


def _argb_bytes(numbers: np.ndarray) -> np.ndarray:
    """B, G, R, A of each number."""
    return np.ascontiguousarray(numbers & 0xFFFFFFFF).astype(np.uint32).view(np.uint8).reshape(-1, 4)


def encode_all(pictures: list[np.ndarray]) -> list[bytes]:
    """Files of several pictures, each made in the way that seems the shortest; they are looked at and written together."""
    if not pictures:
        return []
    return _files([_parts(p, **how) for p, how in zip(pictures, chosen(pictures), strict=True)])
