"""Progressive JPEG in numpy: payloads as coefficients, scans accumulated into arrays, full-resolution RGB tensors.

Batches of images are coded and decoded together. Every entropy-coded segment (restart interval) of every image of a
batch is one lane; all lanes advance by one symbol at a time, so numpy's cost per call is spread over many lanes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from padlens.llm.common import slices, texts_of

#: Bytes of a unit: two 32 x 16 pixel macroblocks of 4:2:0 hold twelve blocks of 48 coefficients.
UNIT, USED = 576, 48
#: Units in a row of an image at least, blocks (interleaved: macroblocks) of a restart interval, added to a byte so that no
#: coefficient is zero after a shift by one bit.
ROW, RESTART, BIAS = 32, 16, 2

# Fixed values of the JPEG standard: the zigzag order as (row, column) runs along the anti-diagonals.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
# Huffman tables of the stored files, symbols by code length. DC: sizes. AC: run in the high, size in the low
# four bits; size 0 ends a band for 2^run blocks, 0xF0 skips sixteen zeros.
DC_TABLE = {2: [5, 6], 3: [0, 4, 7], 4: [3], 5: [2], 6: [1], 7: [8], 8: [9], 9: [10], 10: [11]}
AC_TABLE = {1: [0x06], 2: [0x05], 3: [0x07], 5: [0x04, 0x08], 6: [0x40], 8: [0x03, 0x02, 0x01, 0x00], 10: [0x10, 0x20, 0x30, 0x09, 0x0A, 0x50, 0xF0]}


@dataclass
class Huffman:
    """Codes by symbol, and symbol and length by the next sixteen bits."""

    lengths: list[int]  # symbols of each code length 1..16
    symbols: list[int]
    code: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)
    look: np.ndarray = field(init=False)  # length << 8 | symbol; 0 where no code fits

    def __post_init__(self):
        self.code, self.size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        self.look = np.zeros(1 << 16, np.int64)
        code, at = 0, 0
        for n, count in enumerate(self.lengths, 1):
            for s in self.symbols[at : at + count]:
                self.code[s], self.size[s] = code, n
                self.look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
                code += 1
            at += count
            code <<= 1

    @classmethod
    def of(cls, table: dict[int, list[int]]) -> Huffman:
        return cls([len(table.get(n, ())) for n in range(1, 17)], [s for n in sorted(table) for s in table[n]])


_DC, _AC = Huffman.of(DC_TABLE), Huffman.of(AC_TABLE)
#: Scans of a stored file: components, spectral band, and successive-approximation bits (high, low).
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 47, 0, 1), ((2,), 1, 47, 0, 1), ((0,), 6, 47, 0, 1)] + [
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 47, 1, 0),
    ((1,), 1, 47, 1, 0),
    ((2,), 1, 47, 1, 0),
]


@dataclass
class Frame:
    """Size of an image in pixels and the block grids of its components; `base` is its first block in a batch."""

    height: int
    width: int
    sampling: list[tuple[int, int]]
    base: int = 0

    def __post_init__(self):
        self.h, self.v = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        self.mcus = (-(-self.height // (8 * self.v)), -(-self.width // (8 * self.h)))
        self.grid = [(self.mcus[0] * v, self.mcus[1] * h) for h, v in self.sampling]
        self.first = np.concatenate([[0], np.cumsum([a * b for a, b in self.grid])]).tolist()

    def plan(self, components: tuple[int, ...], restart: int) -> Plan:
        return _plan(self.height, self.width, tuple(self.sampling), components, restart)


@dataclass(frozen=True)
class Plan:
    """A scan over a frame: its blocks in order, the blocks in one unit of its restart interval, the first block and the
    number of blocks of each segment, and the component (within the scan) of each block."""

    order: np.ndarray
    unit: int
    first: np.ndarray
    n: np.ndarray
    lane: np.ndarray
    component: np.ndarray


@lru_cache(1024)
def _plan(height: int, width: int, sampling: tuple[tuple[int, int], ...], components: tuple[int, ...], restart: int) -> Plan:
    frame = Frame(height, width, list(sampling))
    if len(components) == 1:
        c, (h, v) = components[0], sampling[components[0]]
        rows = -(-(-(-height * v // frame.v)) // 8)
        columns = -(-(-(-width * h // frame.h)) // 8)
        order, unit = (frame.first[c] + np.arange(rows)[:, None] * frame.grid[c][1] + np.arange(columns)).ravel(), 1
        per = np.zeros(1, np.int64)
    else:
        parts = []
        for c in components:
            h, v = sampling[c]
            index = frame.first[c] + np.arange(frame.grid[c][0] * frame.grid[c][1]).reshape(frame.mcus[0], v, frame.mcus[1], h)
            parts.append(index.transpose(0, 2, 1, 3).reshape(frame.mcus[0] * frame.mcus[1], h * v))
        joined = np.concatenate(parts, axis=1)
        order, unit = joined.ravel(), joined.shape[1]
        per = np.repeat(np.arange(len(components)), [p.shape[1] for p in parts])
    step = restart * unit or len(order)
    first = np.arange(-(-len(order) // step)) * step
    return Plan(order, unit, first, np.minimum(step, len(order) - first), np.arange(len(order)) // step, np.tile(per, len(order) // len(per)))


def frame_of(units: int) -> Frame:
    """The frame that holds a payload of so many units; a last row may be part empty."""
    columns = min(units, max(ROW, -(-units // 4000)))
    return Frame(16 * -(-units // columns), 32 * columns, [(2, 2), (1, 1), (1, 1)])


def _write_bits(codes: np.ndarray, sizes: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes one after the other, each filled up with ones, and the n + 1 offsets. lane: of each code, rising."""
    n = int(lane[-1]) + 1
    end = np.cumsum(sizes)
    last = np.append(np.flatnonzero(lane[1:] != lane[:-1]), len(lane) - 1)  # every lane has a code
    bits = np.diff(end[last], prepend=0)
    fill = -bits % 8
    starts = np.concatenate([[0], np.cumsum(bits + fill)])
    at = end - sizes + np.repeat(starts[:-1] - (end[last] - bits), np.diff(last, prepend=-1))
    total = int(starts[-1]) // 32 + 2
    out = np.zeros(total, np.uint64)
    ones = (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1)
    for place, code, size in ((at, codes, sizes), (starts[1:] - fill, ones, fill)):
        word = place >> 5
        wide = code << ((64 - size - (place & 31)) & 63).astype(np.uint64)  # a code of no bits is 0
        begin = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out[word[begin]] += np.add.reduceat(wide >> np.uint64(32), begin)
        out[word[begin] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), begin)
    return out.astype(">u4").view(np.uint8)[: int(starts[-1]) // 8], starts // 8


#: Values that the tables below hold a code for.
RANGE = 1024


def _value_codes(table: Huffman) -> tuple[np.ndarray, np.ndarray]:
    """Code with extra bits, and length, of each value from -RANGE to RANGE, with no zeros before it."""
    value = np.arange(-RANGE, RANGE + 1)
    size = np.frexp(np.abs(value).astype(np.float64))[1].astype(np.int64)
    extra = np.where(value < 0, value + (np.int64(1) << size) - 1, value).astype(np.uint64)
    return table.code[size] << size.astype(np.uint64) | extra, table.size[size] + size


_DC_CODES, _AC_CODES = _value_codes(_DC), _value_codes(_AC)


def _header(frame: Frame, payload: int) -> bytes:
    def part(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    components = b"".join(struct.pack("BBB", i + 1, h << 4 | v, 0) for i, (h, v) in enumerate(frame.sampling))
    tables = b"".join(bytes([kind, *t.lengths, *t.symbols]) for kind, t in ((0x00, _DC), (0x10, _AC)))
    return b"".join(
        [b"\xff\xd8", part(0xFE, b"payload %d" % payload), part(0xDB, bytes([0] + [1] * 64))]
        + [part(0xC2, struct.pack(">BHHB", 8, frame.height, frame.width, 3) + components), part(0xC4, tables), part(0xDD, struct.pack(">H", RESTART))]
    )


def _scan_header(components: tuple[int, ...], ss: int, se: int, ah: int, al: int) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([ss, se, ah << 4 | al])
    return struct.pack(">BBH", 0xFF, 0xDA, len(body) + 2) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, whose length is a positive multiple of UNIT, as one progressive JPEG file.

    A byte plus BIAS is one of the first 48 coefficients of a block, in zigzag order, quantised by one; blocks come in
    scan order of the macroblocks. Blocks beyond the payload are zero.
    """
    frames, base = [], 0
    for p in payloads:
        frames.append(frame_of(len(p) // UNIT))
        frames[-1].base = base
        base += frames[-1].first[-1]
    coefficients = np.zeros((base, 64), np.int32)
    for p, f in zip(payloads, frames):
        where = f.plan((0, 1, 2), RESTART).order
        data = np.frombuffer(p, np.uint8).reshape(-1, USED)
        coefficients[f.base + where[: len(data)], :USED] = data
        coefficients[f.base + where[: len(data)], :USED] += BIAS
    written: list[list[bytes]] = [[_header(f, len(p))] for p, f in zip(payloads, frames)]
    for scan in SCRIPT:
        components, ss, se, ah, al = scan
        plans = [f.plan(components, RESTART) for f in frames]
        lanes = np.concatenate([[0], np.cumsum([len(x.n) for x in plans])]).tolist()
        block = np.concatenate([x.order + f.base for x, f in zip(plans, frames)])
        lane = np.concatenate([x.lane + k for x, k in zip(plans, lanes)])
        if ss == 0 and not ah:  # differences of the shifted DC coefficients, by component within a lane
            component, value = np.concatenate([x.component for x in plans]), coefficients[block, 0] >> al
            by = np.argsort(component, kind="stable")
            key, sorted_ = lane[by] * 4 + component[by], value[by]
            previous = np.concatenate([[0], sorted_[:-1]])
            previous[np.concatenate([[True], key[1:] != key[:-1]])] = 0
            difference = np.empty(len(value), np.int64)
            difference[by] = sorted_ - previous
            codes, sizes, of = _DC_CODES[0][difference + RANGE], _DC_CODES[1][difference + RANGE], lane
        elif ss == 0:
            codes, sizes, of = (coefficients[block, 0] >> al & 1).astype(np.uint64), np.ones(len(block), np.int64), lane
        elif not ah:  # a block is whole or empty, and an empty one has a band end of its own
            part = coefficients[block, ss : se + 1] >> al
            empty = part[:, 0] == 0
            part += RANGE
            codes, sizes = _AC_CODES[0][part], _AC_CODES[1][part]
            codes[empty] = 0
            sizes[empty] = 0
            codes[empty, 0], sizes[empty, 0] = _AC.code[0], _AC.size[0]
            codes, sizes, of = codes.ravel(), sizes.ravel(), np.repeat(lane, se - ss + 1)
        else:  # no new coefficient: one band end for all blocks of a lane, then a bit for each coefficient
            part = coefficients[block, ss : se + 1]
            count = np.concatenate([x.n for x in plans])
            run = np.frexp(count.astype(np.float64))[1] - 1
            head = _AC.code[run << 4] << run.astype(np.uint64) | (count - (1 << run)).astype(np.uint64)
            first = np.concatenate([[True], lane[1:] != lane[:-1]])
            codes = np.zeros((len(block), se - ss + 2), np.uint64)
            sizes = np.zeros((len(block), se - ss + 2), np.int64)
            codes[:, 1:], sizes[:, 1:] = part >> al & 1, part != 0
            codes[first, 0], sizes[first, 0] = head, _AC.size[run << 4] + run
            codes, sizes, of = codes.ravel(), sizes.ravel(), np.repeat(lane, se - ss + 2)
        data, starts = _write_bits(codes, sizes, of)
        raw = data.tobytes()
        head = _scan_header(*scan)
        for out, a, b in zip(written, lanes, lanes[1:]):
            out.append(head)
            for k in range(a, b):
                out.append(raw[starts[k] : starts[k + 1]].replace(b"\xff", b"\xff\x00"))
                if k + 1 < b:
                    out.append(bytes([0xFF, 0xD0 + (k - a) % 8]))
    return [b"".join([*out, b"\xff\xd9"]) for out in written]


@dataclass
class Lanes:
    """Segments of one kind of scan: where their bits begin, their blocks, band and tables; scan by scan, joined once."""

    scans: list[tuple] = field(default_factory=list)  # first marker, first byte, plan, first block, band (ss, se, al), tables

    def join(self, clean: np.ndarray, marks: np.ndarray) -> None:
        """From scans to arrays by segment (order, component and a DC table: by block)."""
        mark, begin, plans, base, band, table = zip(*self.scans)
        segments, sizes = np.array([len(p.n) for p in plans]), np.array([len(p.order) for p in plans])
        head = np.cumsum(segments) - segments
        within = np.arange(segments.sum()) - np.repeat(head, segments)
        start = marks[np.maximum(np.repeat(mark, segments) + within - 1, 0)] + 2  # behind the marker before
        start[head] = begin
        self.bit = clean[start] * 8
        self.at = np.concatenate([p.first for p in plans]) + np.repeat(np.cumsum(sizes) - sizes, segments)
        self.n = np.concatenate([p.n for p in plans])
        self.band = np.repeat(np.array(band), segments, axis=0)
        self.order = np.concatenate([p.order for p in plans]) + np.repeat(base, sizes)
        if self.band[0, 0] == 0:
            wide = np.zeros((len(sizes), 4), np.int64)
            for row, t in zip(wide, table):
                row[: len(t)] = t
            self.component = np.concatenate([p.component for p in plans])
            self.table = wide[np.repeat(np.arange(len(sizes)), sizes), self.component]
        else:
            self.table = np.repeat([t[0] for t in table], segments)


@lru_cache(256)
def _frame_of_header(body: bytes) -> tuple[Frame, bytes, bytes]:
    """Frame, ids and quantisation slots of the components."""
    _, height, width, n = struct.unpack(">BHHB", body[:6])
    parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
    if n not in (1, 3) or body[0] != 8 or not height or not width:
        raise ValueError("not an 8-bit image of one or three components")
    return Frame(height, width, [(p[1] >> 4, p[1] & 15) for p in parts]), bytes(p[0] for p in parts), bytes(p[2] for p in parts)


@lru_cache(4096)
def _scan_of_header(ids: bytes, trail: tuple[bytes, ...]) -> tuple[tuple[int, ...], bytes, tuple[int, int, int], str, int]:
    """Components, table slots, band (ss, se, al), kind and turn of the last of the scan headers in trail.

    A scan's turn comes after those of all scans before it that share a component and a part of the band.
    """
    parsed, turns = [], []
    for body in trail:
        n = body[0]
        components = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
        ss, se = body[1 + 2 * n], body[2 + 2 * n]
        met = [t for t, (c, a, b) in zip(turns, parsed) if set(c) & set(components) and a <= se and b >= ss]
        parsed.append((components, ss, se))
        turns.append(1 + max(met, default=-1))
    approximation = trail[-1][3 + 2 * n]
    slots = bytes(w >> 4 if ss == 0 else 0x10 | w & 15 for w in trail[-1][2 : 2 + 2 * n : 2])
    return components, slots, (ss, se, approximation & 15), ("dc" if ss == 0 else "ac") + ("+" if approximation >> 4 else ""), turns[-1]


@lru_cache(256)
def _tables_of_header(body: bytes) -> list[tuple[int, bytes]]:
    """Slot and definition of each Huffman table."""
    out = []
    while body:
        key = body[: 17 + sum(body[1:17])]
        out.append((key[0], key[1:]))
        body = body[len(key) :]
    return out


def _parse(data: bytes, base: int, marks: np.ndarray, out: dict, tables: dict[bytes, int], start: int) -> tuple[Frame, np.ndarray, int]:
    """Headers of one file; its segments go to `out` by (turn, kind). marks: markers within the batch; tables: the batch's
    Huffman tables by definition. Gives the frame, the quantisation table by component, and the payload's length."""
    at, restart, length, frame = 2, 0, -1, None
    quant: dict[int, np.ndarray] = {}
    huffman: dict[int, int] = {}
    trail: tuple[bytes, ...] = ()
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDA:
            trail += (body,)
            components, slots, band, kind, turn = _scan_of_header(ids, trail)
            plan = frame.plan(components, restart)
            mark = bisect_left(marks, start + at)
            to = out.get((turn, kind))
            if to is None:
                to = out[turn, kind] = Lanes()
            to.scans.append((mark, start + at, plan, base, band, [huffman.get(x, 0) for x in slots]))
            at = marks[mark + len(plan.n) - 1] - start
        elif marker == 0xFE and body.startswith(b"payload "):
            length = int(body[8:])
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC2:
            shape, ids, of = _frame_of_header(body)
            frame = copy(shape)
            frame.base = base
        elif marker in (0xC0, 0xC1):
            raise ValueError("not a progressive file")
        elif marker == 0xC4:
            for slot, key in _tables_of_header(body):
                huffman[slot] = tables.setdefault(key, len(tables))
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
    if frame is None or at >= len(data) or data[:2] != b"\xff\xd8":
        raise ValueError("not a whole file")
    return frame, np.stack([quant[q] for q in of]), length


@lru_cache(256)
def _looks(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next sixteen bits: length << 8 | symbol of the code, and for codes that hold a value within these bits
    length with it << 20 | zeros before << 16 | value + 2^15; 0 where that isn't so."""
    look = Huffman(list(key[:16]), list(key[16:])).look
    peek = np.arange(1 << 16)
    used, run, size = look >> 8, look >> 4 & 15, look & 15
    whole = used + size
    value = _extend(peek >> np.maximum(16 - whole, 0) & (1 << size) - 1, size)
    return look, np.where((size > 0) & (whole <= 16), whole << 20 | run << 16 | value + (1 << 15), 0)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


class Reader:
    """Bits of a batch, from the seven bytes at any byte offset as one number."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.full(16, 255, np.uint8)])
        self.wide = (np.ndarray((len(data) + 8,), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(8)).view(np.int64)

    def peek(self, bit: np.ndarray) -> np.ndarray:
        """The sixteen bits from each bit offset."""
        return self.wide[bit >> 3] >> 40 - (bit & 7) & 0xFFFF

    def bits(self, bit: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The n bits from each bit offset, 16 at most; n may be 0."""
        return self.wide[bit >> 3] >> 56 - (bit & 7) - n & (1 << n) - 1


def _dc(lanes: Lanes, read: Reader, look: np.ndarray, coefficients: np.ndarray) -> None:
    bit, at, n = lanes.bit, lanes.at, lanes.n
    order, component, table, al = lanes.order, lanes.component, lanes.table, lanes.band[:, 2]
    difference = np.zeros(len(order), np.int64)
    live = np.arange(len(bit))
    for k in range(int(n.max())):
        live = live[n[live] > k]
        place = at[live] + k
        found = look[table[place], read.peek(bit[live])]
        size, used = found & 255, found >> 8
        difference[place] = _extend(read.bits(bit[live] + used, size), size)
        bit[live] += used + size
    lane = np.repeat(np.arange(len(n)), n)
    key = lane * 4 + component
    by = np.argsort(key, kind="stable")
    run = np.cumsum(difference[by])
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
    before = np.repeat(run[first] - difference[by][first], np.diff(np.append(first, len(by))))
    coefficients[order[by], 0] = (run - before) << al[lane[by]]


def _dc_more(lanes: Lanes, read: Reader, coefficients: np.ndarray) -> None:
    bit, n, order = lanes.bit, lanes.n, lanes.order
    al = np.repeat(lanes.band[:, 2], n)
    within = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    coefficients[order, 0] |= (read.bits(np.repeat(bit, n) + within, 1) << al).astype(coefficients.dtype)


def _ac(lanes: Lanes, read: Reader, look: np.ndarray, fast: np.ndarray, coefficients: np.ndarray) -> None:
    """First scan of a band: one symbol of every lane at a time."""
    order, bit, at, n, table = lanes.order, lanes.bit, lanes.at, lanes.n, lanes.table
    ss, se, al = lanes.band.T
    end, k = at + n, ss.copy()
    flat = coefficients.reshape(-1)
    one = table[0] if (table == table[0]).all() else None
    base = order[at] * 64
    while len(bit):
        peek = read.peek(bit)
        found = fast[one][peek] if one is not None else fast[table, peek]
        if found.all():  # each lane reads a value
            bit += found >> 20
            k += found >> 16 & 15
            flat[base + k] = (found & 0xFFFF) - (1 << 15) << al
            k += 1
            over = k > se
        else:
            found = look[one][peek] if one is not None else look[table, peek]
            used, run, size = found >> 8, found >> 4 & 15, found & 15
            zero = size == 0
            bits = np.where(zero, np.where(run < 15, run, 0), size)
            extra = read.bits(bit + used, bits)
            bit += used + bits
            k += run
            value = _extend(extra, size) << al
            some = ~zero
            flat[base[some] + k[some]] = value[some]
            ends = zero & (run < 15)
            at = np.where(ends, at + (1 << run) + extra - 1, at)
            k += 1
            over = (k > se) | ends
        if over.any():
            at = at + over
            k = np.where(over, ss, k)
            live = at < end
            if not live.all():
                bit, at, end, k, ss, se, al, table = (v[live] for v in (bit, at, end, k, ss, se, al, table))
            base = order[at] * 64


def _ac_more(lanes: Lanes, read: Reader, single: np.ndarray, look: np.ndarray, coefficients: np.ndarray) -> None:
    """Later scan of a band: a bit for each coefficient that is not zero, and new ones of size one. single: each bit.

    A lane reads a symbol, then goes on by one coefficient at a time to the place of the new one; where the band
    ends for a run of blocks, all their bits are read at once.
    """
    order, bit, at, n, table = lanes.order, lanes.bit, lanes.at, lanes.n, lanes.table
    ss, se, al = lanes.band.T
    end, k = at + n, ss.copy()
    flat = coefficients.reshape(-1)

    def correct(where: np.ndarray, old: np.ndarray, bits: np.ndarray, low: np.ndarray) -> None:
        """Adds the bit to what stands at each place, away from zero."""
        low = low.astype(old.dtype)
        step = (single[bits] & (np.abs(old) >> low & 1 == 0)).astype(old.dtype) << low
        flat[where] = old + np.where(old < 0, -step, step)

    while len(bit):
        found = look[table, read.peek(bit)]
        used, run, size = found >> 8, found >> 4 & 15, found & 15
        ends = (size == 0) & (run < 15)
        bits = np.where(ends, run, np.where(size > 0, 1, 0))
        extra = read.bits(bit + used, bits)
        bit = bit + used + bits
        new = np.where(size > 0, np.where(extra > 0, 1, -1), 0)
        left = run.copy()
        going = np.flatnonzero(~ends)
        while len(going):  # to the place of the new coefficient, or past sixteen zeros
            where = order[at[going]] * 64 + k[going]
            value = flat[where]
            old = value != 0
            if old.any():
                correct(where[old], value[old], bit[going[old]], al[going[old]])
                bit[going[old]] += 1
            stop = ~old & (left[going] == 0)
            put = stop & (new[going] != 0)
            flat[where[put]] = new[going[put]] << al[going[put]]
            left[going] -= ~old & ~stop
            k[going] += 1
            going = going[~stop & (k[going] <= se[going])]
        full = ~ends & (k > se)
        closing = np.flatnonzero(ends)
        if len(closing):
            count = (1 << run[closing]) + extra[closing]
            count = np.minimum(count, end[closing] - at[closing])
            lane = np.repeat(closing, count)
            block = at[lane] + np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
            low, high = int(ss[closing].min()), int(se[closing].max())
            value = coefficients[order[block], low : high + 1]
            column = np.arange(low, high + 1)
            member = value != 0
            begin = np.where(block == at[lane], k[lane], ss[lane])
            if (begin > low).any() or (se[closing] < high).any():
                member &= (column >= begin[:, None]) & (column <= se[lane][:, None])
            each = member.sum(1)  # bits of each block, one after the other within a lane
            total = np.bincount(lane, each, len(bit)).astype(np.int64)
            of = np.repeat(lane, each)
            first = np.cumsum(total) - total
            where = np.flatnonzero(member)
            row, place = where // len(column), where % len(column) + low
            correct(order[block][row] * 64 + place, value.ravel()[where], (bit - first)[of] + np.arange(len(of)), al[of])
            bit = bit + total
            at[closing] += count
        at = at + full
        k = np.where(full | ends, ss, k)
        live = at < end
        if not live.all():
            bit, at, end, k, ss, se, al, table = (v[live] for v in (bit, at, end, k, ss, se, al, table))


def coefficients_of(files: list[bytes]) -> tuple[np.ndarray, list[Frame], list[np.ndarray], list[int]]:
    """Coefficients (block, zigzag place) of all files, accumulated scan by scan, with frames, tables and payload lengths.

    Raises one of BROKEN if a file is not a whole progressive one.
    """
    data = np.frombuffer(b"".join([*files, b"\0\0"]), np.uint8)
    marked = np.flatnonzero(data[:-1] == 255)
    following = data[marked + 1]
    marks = marked[(following != 0) & (following != 255)]
    stuffed = marked[following == 0] + 1
    keep = np.ones(len(data), bool)
    keep[stuffed] = False
    clean = np.concatenate([[0], np.cumsum(keep)])
    kept = data[keep]
    read = Reader(kept)
    turns: dict[tuple[int, str], Lanes] = {}
    tables: dict[bytes, int] = {}
    frames, quants, lengths, base, start, places = [], [], [], 0, 0, marks.tolist()
    for f in files:
        frame, quant, length = _parse(f, base, places, turns, tables, start)
        frames.append(frame)
        quants.append(quant)
        lengths.append(length)
        base, start = base + frame.first[-1], start + len(f)
    look, fast = (np.stack(x) for x in zip(*map(_looks, tables)))
    single = np.unpackbits(kept).view(bool) if any(kind == "ac+" for _, kind in turns) else None
    coefficients = np.zeros((base, 64), np.int32)
    for turn, kind in sorted(turns):
        lanes = turns[turn, kind]
        lanes.join(clean, marks)
        if kind == "dc":
            _dc(lanes, read, look, coefficients)
        elif kind == "dc+":
            _dc_more(lanes, read, coefficients)
        elif kind == "ac":
            _ac(lanes, read, look, fast, coefficients)
        else:
            _ac_more(lanes, read, single, look, coefficients)
    return coefficients, frames, quants, lengths


#: What coefficients_of() raises for a null, empty or truncated file, or one that is no progressive JPEG.
BROKEN = (TypeError, ValueError, IndexError, KeyError, UnboundLocalError, AttributeError, struct.error)


def _inverse() -> np.ndarray:
    """From coefficients in zigzag order to pixels: one 64 x 64 matrix."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, 0.125**0.5, 0.5)
    return np.stack([np.outer(one[r], one[c]).ravel() for r, c in ZIGZAG]).astype(np.float32)


_INVERSE = _inverse()


def tensors(coefficients: np.ndarray, frames: list[Frame], quants: list[np.ndarray]) -> list[np.ndarray]:
    """Full-resolution RGB of each image, height x width x 3: inverse transform, chroma repeated to full size, conversion.

    Images of one shape and table go through together.
    """
    alike: dict[tuple, list[int]] = {}
    for i, (f, q) in enumerate(zip(frames, quants)):
        alike.setdefault((f.height, f.width, tuple(f.sampling), q.tobytes()), []).append(i)
    out: list[np.ndarray] = [np.zeros(0)] * len(frames)
    for members in alike.values():
        frame, quant, m = frames[members[0]], quants[members[0]], len(members)
        base = np.array([frames[i].base for i in members])
        planes = []
        for c, ((rows, columns), (h, v)) in enumerate(zip(frame.grid, frame.sampling)):
            block = (base + frame.first[c])[:, None] + np.arange(rows * columns)
            pixels = (coefficients[block.ravel()].astype(np.float32) * quant[c]) @ _INVERSE
            pixels += np.float32(128)
            np.clip(pixels, 0, 255, out=pixels)
            plane = pixels.reshape(m, rows, columns, 8, 8).transpose(0, 1, 3, 2, 4)
            down, across = frame.v // v, frame.h // h
            if down > 1 or across > 1:
                plane = np.broadcast_to(plane[:, :, :, None, :, :, None], (m, rows, 8, down, columns, 8, across))
            planes.append(plane.reshape(m, 8 * rows * down, 8 * columns * across)[:, : frame.height, : frame.width])
        rgb = np.empty((m, frame.height, frame.width, 3), np.uint8)
        if len(planes) == 1:
            rgb[...] = np.rint(planes[0])[..., None]
        else:
            y, b, r = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
            # The conversion of the file interchange format.
            for k, x in enumerate((y + np.float32(1.402) * r, y - np.float32(0.344136) * b - np.float32(0.714136) * r, y + np.float32(1.772) * b)):
                np.clip(x, 0, 255, out=x)
                rgb[..., k] = np.rint(x, out=x)
        for i, image in zip(members, rgb):
            out[i] = image
    return out


def payload_of(coefficients: np.ndarray, frame: Frame, length: int) -> bytes:
    """The payload that encode() stored."""
    where = frame.plan((0, 1, 2), RESTART).order
    part = coefficients[frame.base + where[: length // USED], :USED] - BIAS
    return part.astype(np.uint8).tobytes()


def padded(raw: bytes) -> bytes:
    """Filled up with bytes 255 to a positive multiple of UNIT."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def store(docs: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, media`: each text of docs(doc_id, text) as one progressive JPEG file. Null is an empty text.

    Repeated rows are stored each, equal texts alike; no rows give no rows; a null doc_id stays null; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch)]
            media = encode([padded(r) for r in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame, tensor: bool = True) -> DataFrame:
    """Columns of media(doc_id, n_bytes, media) and `payload, height, width, feature, tensor`.

    Any progressive 8-bit file with Huffman coding and one or three components is read; payload is null where a file
    has no payload length. feature names the size, the sums of the three channels and the tensor's crc32. tensor
    holds the RGB bytes row by row, or null if not asked for. For a file that is null, empty, truncated or of another
    kind all five are null; its neighbours are read. Repeated rows come back each, files of any length are read whole,
    no rows give no rows.
    """
    nothing = (None,) * 5

    def read(files: list[bytes]) -> list[tuple]:
        coefficients, frames, quants, lengths = coefficients_of(files)
        out = []
        for f, n, x in zip(frames, lengths, tensors(coefficients, frames, quants)):
            sums = x.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
            feature = f"{f.height}x{f.width}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(x):08x}"
            out.append((payload_of(coefficients, f, n) if n >= 0 else None, f.height, f.width, feature, x.tobytes() if tensor else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20, "media"):
            files = batch.column("media").to_pylist()
            try:
                rows = read(files)
            except BROKEN:  # one by one, so that a broken file costs no other
                rows = []
                for f in files:
                    try:
                        rows += read([f])
                    except BROKEN:
                        rows.append(nothing)
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            found = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "payload", "height", "width", "feature", "tensor"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, height int, width int, feature string, tensor binary")
