"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

An id is coded in nibbles, highest first. For each nibble three adaptive distributions over its sixteen values predict it: from the
nibbles so far alone (order 0), with the id before (order 1) and with the two ids before (order 2). A
distribution moves towards what it sees, fast while it is young. The three are mixed with weights that depend on how often the two
contexts have been seen and that follow how well each order predicted; a range coder codes the nibble with the mixture. All arithmetic
is on integers, so any machine decodes alike, and the mixture's sixteen parts together stay below 2^16, so that ``token_kernel`` can work on four of them at once. Each block starts from blank tables and carries the CRC-32 of its
ids, hence blocks are coded and decoded in lockstep, one lane of the arrays a block.

Block: ``FXB3``, nibbles an id (1 byte), ids (4 bytes), CRC-32 of the ids as little-endian 32-bit integers (4 bytes), code.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 4096, 384
SLOT_BITS = 12
_MAGIC = b"FXB3"
_HEAD = struct.Struct("<4sBII")
#: A distribution's parts, 2048 in all at first; how fast it moves (a shift) by how often it was used. They never come to more than 2048 + 16 * (2^4 - 1).
_PARTS, _SHIFT = 2048, np.array([1, 2, 2, 3, 3, 3, 4], np.uint16)
#: Weights are of a whole, move by a share of 2^-RATE, and the mixture takes them in units of SHARES a whole.
_WHOLE, _RATE, _LEAST, _SHARES = 1 << 16, 4, 1 << 9, 28
_INVERSE = np.concatenate([[0], _WHOLE // np.arange(1, _PARTS + 16 * 16)]).astype(np.int64)
#: Of the orders, by how often (never, once, more often) the contexts of orders 1 and 2 were seen.
_START = np.array([[_WHOLE - 2 * _LEAST, _LEAST, _LEAST], [_WHOLE // 2, _LEAST, _WHOLE // 2], [_WHOLE // 4, _LEAST, 3 * _WHOLE // 4], [_WHOLE // 2, _WHOLE // 2, _LEAST], [_WHOLE // 4, _WHOLE // 4, _WHOLE // 2], [_WHOLE // 8, _WHOLE // 8, 3 * _WHOLE // 4], [_WHOLE // 4, 3 * _WHOLE // 4, _LEAST], [_WHOLE // 8, 3 * _WHOLE // 8, _WHOLE // 2], [_WHOLE // 8, _WHOLE // 4, 5 * _WHOLE // 8]], np.int64)
_U = np.uint64
_TOP, _LOW, _MASK = _U(1 << 40), _U(1 << 24), _U((1 << 48) - 1)


class _Lanes:
    """The models of all lanes; a step works on the first ``k``, which are still active."""

    def __init__(self, n: int, nibbles: int):
        self.parts = [np.full((n << SLOT_BITS, 16), _PARTS // 16, np.uint16) for _ in range(3)]
        self.used = [np.zeros(n << SLOT_BITS, np.uint8) for _ in range(3)]
        self.weights = np.tile(_START, (n * nibbles, 1))
        self.base, self.row, self.nibbles = np.arange(n) << SLOT_BITS, np.arange(n), nibbles
        self.one = np.zeros(n, np.int64)
        self.two = np.zeros(n, np.int64)

    def begin(self, k: int) -> None:
        self.k, self.node = k, np.ones(k, np.int64)
        near = self.one[:k] * 0x2545F491 + 0x1B873593 & 0x7FFFFFFF
        self.contexts = (0, near, near * 0x5BD1E995 + self.two[:k] * 0x27D4EB2F & 0x7FFFFFFF)

    def predict(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Of nibble ``at``: the mixed parts of its values and their running sums."""
        k, spread = self.k, self.node * 0x9E3779B1
        self.slots = [self.base[:k] + ((spread ^ c) * 0x85EBCA6B >> 15 & (1 << SLOT_BITS) - 1) for c in self.contexts]
        self.age = [u.take(s) for u, s in zip(self.used, self.slots, strict=True)]
        self.own = [p.take(s, axis=0) for p, s in zip(self.parts, self.slots, strict=True)]
        place = np.minimum(self.age[1], 2) * 3 + np.minimum(self.age[2], 2)
        self.at = (self.row[:k] * self.nibbles + at) * 9 + place
        self.w = self.weights.take(self.at, axis=0)
        share = (self.w * _SHARES >> 16).astype(np.int32)
        mixed = self.own[0] * share[:, :1]
        mixed += self.own[1] * share[:, 1:2]
        mixed += self.own[2] * share[:, 2:]
        mixed += 1
        return mixed, np.cumsum(mixed, axis=1)

    def update(self, value: np.ndarray) -> None:
        rows = self.row[: self.k]
        seen = np.stack([p[rows, value] for p in self.own], 1).astype(np.int64)
        mean = ((seen * self.w).sum(1) >> 16) + 1
        due = (self.w * seen >> 8) * _INVERSE.take(mean)[:, None] >> 8
        self.weights[self.at] = np.clip(self.w + (due - self.w >> _RATE), _LEAST, _WHOLE)
        for parts, used, slots, age, own in zip(self.parts, self.used, self.slots, self.age, self.own, strict=True):
            shift = _SHIFT.take(age)
            own -= own >> shift[:, None]
            own[rows, value] += np.uint16(_PARTS) >> shift
            parts[slots] = own
            used[slots] = np.minimum(age + 1, len(_SHIFT) - 1)
        self.node = self.node * 16 + value

    def end(self, ids: np.ndarray) -> None:
        self.two[: self.k] = self.one[: self.k]
        self.one[: self.k] = ids


def _active(lengths: np.ndarray) -> np.ndarray:
    """How many lanes (longest first) still have an id at each step."""
    return np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right") if len(lengths) else np.zeros(0, int)


def _narrow(lo: np.ndarray, size: np.ndarray, mixed: np.ndarray, sums: np.ndarray, value: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval (first number, size) of a value within each lane's interval."""
    unit, part = size // sums[:, -1].astype(_U), mixed[rows, value]
    return lo + unit * (sums[rows, value] - part).astype(_U), unit * part.astype(_U)


def _ready(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lanes whose first byte is settled, or whose interval is small and is then cut at a border to settle it."""
    settled = (lo ^ (lo + size)) < _TOP
    tight = ~settled & (size < _LOW)
    if tight.any():
        size[tight] = (_U(0) - lo[tight]) & (_LOW - _U(1))
    return settled | tight


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    out: list[bytes] = []
    for i in range(0, len(blocks), LANES):
        out += _encode(blocks[i : i + LANES])
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    blocks = [np.asarray(b, np.uint32) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    nibbles = max(1, -(-max((int(b.max()).bit_length() for b in blocks if len(b)), default=1) // 4))
    n, steps = len(blocks), int(lengths[0]) if blocks else 0
    ids = np.zeros((steps, n), np.int64)
    for lane, i in enumerate(order):
        ids[: len(blocks[i]), lane] = blocks[i]
    m = _Lanes(n, nibbles)
    lo, size = np.zeros(n, _U), np.full(n, _MASK, _U)
    code, at = np.zeros((n, steps * 3 + 64), np.uint8), np.zeros(n, np.int64)
    for t, k in enumerate(_active(lengths)):
        m.begin(k)
        rows = m.row[:k]
        for place in range(nibbles):
            mixed, sums = m.predict(place)
            value = ids[t, :k] >> 4 * (nibbles - 1 - place) & 15
            lo[:k], size[:k] = _narrow(lo[:k], size[:k], mixed, sums, value, rows)
            m.update(value)
            while len(who := np.flatnonzero(_ready(lo[:k], size[:k]))):
                if int(at[:k].max()) + 8 >= code.shape[1]:
                    code = np.concatenate([code, np.zeros_like(code)], 1)
                code[who, at[who]] = lo[who] >> _U(40)
                at[who] += 1
                lo[who] = lo[who] << _U(8) & _MASK
                size[who] <<= _U(8)
        m.end(ids[t, :k])
    out: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        # the shortest number within the interval, as bytes from the highest down
        tail = b""
        if len(blocks[i]):
            for bits in (40, 32, 24, 16, 8, 0):
                number = (int(lo[lane]) + (1 << bits) - 1) >> bits << bits
                if number < int(lo[lane]) + int(size[lane]) and number < 1 << 48:
                    tail = number.to_bytes(6, "big")[: 6 - bits // 8]
                    break
        head = _HEAD.pack(_MAGIC, nibbles, len(blocks[i]), zlib.crc32(blocks[i].astype("<u4").tobytes()))
        out[i] = head + code[lane, : at[lane]].tobytes() + tail
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; ValueError if one is damaged."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    by_width: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if len(b) < _HEAD.size or b[:4] != _MAGIC or not 1 <= b[4] <= 8:
            raise ValueError("not a block of token ids")
        by_width.setdefault(b[4], []).append(i)
    for nibbles, members in by_width.items():
        for j in range(0, len(members), LANES):
            part = members[j : j + LANES]
            for i, ids in zip(part, _decode([blocks[i] for i in part], nibbles), strict=True):
                out[i] = ids
    return out


def _decode(blocks: list[bytes], nibbles: int) -> list[np.ndarray]:
    heads = [_HEAD.unpack_from(b) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][2])
    lengths = np.array([heads[i][2] for i in order])
    n, steps = len(blocks), int(lengths[0])
    room = max(len(b) for b in blocks) - _HEAD.size + 8
    if steps > room * 8 * 4096:
        raise ValueError("a block's length does not fit its code")
    code = np.zeros((n, room), np.uint8)
    for lane, i in enumerate(order):
        raw = np.frombuffer(blocks[i], np.uint8, offset=_HEAD.size)
        code[lane, : len(raw)] = raw
    x = np.zeros(n, _U)
    for byte in range(6):
        x = x << _U(8) | code[:, byte].astype(_U)
    at = np.full(n, 6, np.int64)
    ids = np.zeros((steps, n), np.int64)
    m = _Lanes(n, nibbles)
    lo, size = np.zeros(n, _U), np.full(n, _MASK, _U)
    for t, k in enumerate(_active(lengths)):
        m.begin(k)
        rows = m.row[:k]
        for place in range(nibbles):
            mixed, sums = m.predict(place)
            aim = (x[:k] - lo[:k]) // (size[:k] // sums[:, -1].astype(_U))
            value = np.minimum((sums <= np.minimum(aim, _MASK).astype(np.int64)[:, None]).sum(1), 15)
            lo[:k], size[:k] = _narrow(lo[:k], size[:k], mixed, sums, value, rows)
            m.update(value)
            while len(who := np.flatnonzero(_ready(lo[:k], size[:k]))):
                x[who] = x[who] << _U(8) & _MASK | code[who, np.minimum(at[who], room - 1)].astype(_U)
                at[who] += 1
                lo[who] = lo[who] << _U(8) & _MASK
                size[who] <<= _U(8)
        ids[t, :k] = m.node - (1 << 4 * nibbles)
        m.end(ids[t, :k])
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for lane, i in enumerate(order):
        got = ids[: lengths[lane], lane].astype(np.uint32)
        if zlib.crc32(got.astype("<u4").tobytes()) != heads[i][3]:
            raise ValueError("checksum of a block of token ids does not fit")
        out[i] = got
    return out
