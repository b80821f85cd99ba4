"""Adaptive context-mixing range coder for token ids, in blocks that reset the model.

A block cuts its ids into lanes of equal length which are coded side by side: at each step every
lane codes its next id with the model as it stood before the step, then the model learns all of
them. So numpy works on whole lanes while the model still adapts id by id.

For each id there are up to three decisions. Is it the id last seen after the same two ids? The
chance mixes, in the logistic domain with learned weights, the record of order-2 predictions of
that confidence, the order-1 prediction's record for or against it, and the order-0 frequency of
the predicted id, in octaves. If not: is it the id last seen after the same one id? Mixed likewise. If not:
the id itself, by adaptive order-0 frequencies of the ids that the block has.

All arithmetic that both sides must share is on integers; the two tables that come from exp and
log are rounded, and their checksum is part of each block. Each lane is a range coder with 60 bits
of state and digits of 20 bits, carries settled at the end.

Block: header (magic, lanes, steps, ids, alphabet, checksums), number of digits, the ids that occur, digits
as the lanes ask for them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"BCM3"
HEADER = struct.Struct("<4sIIIIIIII")
DIGIT, LOW20 = np.uint64(20), np.uint64((1 << 20) - 1)
#: A span below SMALL takes digits in after a step. The three decisions of a step narrow it by 9, 9 and 21 bits at most.
KEEP, START = np.uint64(40), np.uint64(1 << 60)
SMALL, LOW40 = np.uint64(1 << 40), np.uint64((1 << 40) - 1)
FIRST = 3
MOST_TOTAL = 1 << 22
LANES, STEPS = 8192, 128
#: Ids after which a block closes; a longer document is a block by itself.
BLOCK_IDS = LANES * STEPS

#: ln(p / (1 - p)) in 1/256 for p in 1/4096, and back to p in 1/65536.
_P = (np.arange(4096) + 0.5) / 4096
STRETCH = np.clip(np.rint(np.log(_P / (1 - _P)) * 256), -2047, 2047).astype(np.int32)
SQUASH = np.clip(np.rint(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 128, 65536 - 128).astype(np.uint64)
TABLES = zlib.crc32(STRETCH.astype("<i8").tobytes() + SQUASH.astype("<i8").tobytes())

#: Octaves of an id's order-0 frequency: below 1/1024, from there on by twos, from 1/16 on; the chance each stands for.
OCTAVES = 8
OWN = STRETCH[[2, 5, 11, 22, 45, 90, 181, 362]]

#: The next confidence after a miss (0 to 15), and after a hit (16 to 31), where a table's entry has it: above the id.
MORE = np.array([c >> 1 for c in range(16)] + [min(c + 1, 15) for c in range(16)], dtype=np.int32) << 16


class Mixer:
    """Chances from three stretched inputs with a set of weights for each confidence c. The inputs hang on classes
    (c, s among others, and an octave), so chances stand in a table of joint classes that is made anew for each step; a decision
    costs a look-up there, and two counts to learn."""

    def __init__(self, others: int):
        self.shape = 16, others, OCTAVES
        self.size = 16 * others * OCTAVES
        self.w = np.full((3, 16), 65536 // 3 + 8192, dtype=np.int64)
        self.hits, self.all = np.ones((16, others), dtype=np.int64), np.full((16, others), 2, dtype=np.int64)

    def mix(self) -> np.ndarray:
        """The chance of a hit in each joint class, in 1/65536."""
        self.by_c = STRETCH[(self.hits.sum(1) << 12) // self.all.sum(1)].astype(np.int64)
        self.by_s = STRETCH[(self.hits.sum(0) << 12) // self.all.sum(0)].astype(np.int64)
        known = ((self.w[0] * self.by_c)[:, None] + self.w[1][:, None] * self.by_s).astype(np.int32)
        dot = (known[:, :, None] + (self.w[2].astype(np.int32)[:, None] * OWN)[:, None]) >> 16
        self.p = SQUASH.take(dot.ravel() + 2047, mode="clip")
        return self.p

    def learn(self, n: np.ndarray, hit: np.ndarray) -> None:
        """n: decisions in each joint class; hit: those that hit."""
        err = ((hit << 16) - n * self.p.view(np.int64)).reshape(self.shape)
        of = err.sum(2)
        n, hit = n.reshape(self.shape).sum(2), hit.reshape(self.shape).sum(2)
        each = np.maximum(n.sum(1), 1)
        self.w += np.stack([of.sum(1) * self.by_c, of @ self.by_s, err.sum(1) @ OWN]) // each >> 9
        self.w = np.maximum(np.minimum(self.w, 1 << 18), -(1 << 18))
        self.hits += hit
        self.all += n


class Model:
    """What encoder and decoder know after the same ids, which are numbered from 0 to alphabet - 1."""

    def __init__(self, alphabet: int, slots: bool):
        self.alphabet = alphabet
        self.bits = max(12, alphabet.bit_length() + 4)
        self.count = np.ones(alphabet, dtype=np.int64)
        self.fresh = np.zeros(alphabet, dtype=np.int64)
        self.steps, self.slots = 0, slots
        self.octaves = (1 << self.bits) >> np.arange(10, 3, -1)
        self._sum()
        # entries: confidence above 16 bits of the id
        self.next1, self.next2 = np.zeros(alphabet, dtype=np.int32), np.zeros(1 << 18, dtype=np.int32)
        self.mix2, self.mix1 = Mixer(32), Mixer(1)

    def _sum(self) -> None:
        """Frequencies of 1 or more that sum up to 1 << bits or less; slot: the id in whose part of the sum a number lies."""
        freq = 1 + self.count * ((1 << self.bits) - self.alphabet) // int(self.count.sum())
        self.octave = np.searchsorted(self.octaves, freq, side="right").astype(np.int32)
        if self.slots:
            self.slot = np.repeat(np.arange(self.alphabet), freq)
        self.freq = freq.view(np.uint64)
        self.cum = (np.cumsum(freq) - freq).view(np.uint64)

    def at(self, a: np.ndarray, b: np.ndarray) -> None:
        """Looks up the predictions after ids a, b."""
        self.k1 = b
        self.k2 = ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 8) & 0x3FFFF
        self.v1, self.v2 = self.next1.take(b, mode="clip"), self.next2.take(self.k2, mode="clip")
        self.p1, self.p2 = self.v1 & 0xFFFF, self.v2 & 0xFFFF

    def chance2(self) -> np.ndarray:
        """Of the id last seen after two ids; the other class says what order 1 holds, and whether it agrees."""
        self.side = ((self.v1 >> 16) << 3) + ((self.p1 == self.p2).view(np.int8) * np.int32(128))
        joint = ((self.v2 >> 16) << 8) + self.side + self.octave.take(self.p2, mode="clip")
        self.joint2 = joint.astype(np.int64)
        return self.mix2.mix().take(self.joint2, mode="clip")

    def chance1(self, on: np.ndarray) -> np.ndarray:
        """Of the id last seen after one id, for the places that are left: none where order 2 said the same."""
        self.p1_on = self.p1.take(on, mode="clip")
        self.joint1 = (self.side.take(on, mode="clip") + self.octave.take(self.p1_on, mode="clip")).astype(np.int64)
        known = np.zeros(2 * self.mix1.size, dtype=np.uint64)
        known[: self.mix1.size] = self.mix1.mix()
        return known.take(self.joint1, mode="clip")

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, rest: np.ndarray) -> None:
        """Every decision counts. Order-0 counts are taken in every step, and from the sixteenth on their table is made anew every fourth."""
        for mix, joint, hit in ((self.mix2, self.joint2, hit2), (self.mix1, self.joint1, hit1)):
            n = np.bincount(joint, minlength=mix.size)[: mix.size]
            mix.learn(n, np.bincount(joint.take(np.flatnonzero(hit), mode="clip"), minlength=mix.size))
        ids = ids.astype(np.int32)
        for table, k, v, p in ((self.next2, self.k2, self.v2, self.p2), (self.next1, self.k1, self.v1, self.p1)):
            c = v >> 16
            kept = (1 - c) >> 31  # all ones where the confidence is above 1
            table[k] = (ids ^ ((p ^ ids) & kept)) | MORE.take(c + (p == ids).view(np.int8) * np.int32(16), mode="clip")
        self.fresh += np.bincount(rest, minlength=self.alphabet)
        self.steps += 1
        if self.steps < 16 or self.steps % 4 == 0:
            self.count += 3 * self.fresh
            self.fresh[:] = 0
            while int(self.count.sum()) > MOST_TOTAL:
                self.count = (self.count + 1) >> 1
            self._sum()


def _pack20(digits: np.ndarray) -> bytes:
    """Digits of 20 bits one after the other, two in five bytes."""
    d = np.append(digits, np.zeros(len(digits) % 2, digits.dtype)).astype(np.uint64)
    return ((d[::2] << DIGIT) | d[1::2]).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpack20(raw: bytes, n: int) -> np.ndarray:
    wide = np.zeros((-(-n // 2), 8), np.uint8)
    wide[:, 3:] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    pairs = wide.view(">u8").ravel().astype(np.uint64)
    return np.stack([pairs >> DIGIT, pairs & LOW20], 1).ravel()[:n]


def _shape(n: int) -> tuple[int, int]:
    """lanes, steps: lanes are full but for the last."""
    steps = max(1, -(-n // LANES), min(n, STEPS))
    return -(-n // steps), steps


def encode(ids: np.ndarray, alphabet: int) -> bytes:
    """A block of ids, each below alphabet, which is at most 65536; ValueError if one is not."""
    n = len(ids)
    lanes, steps = _shape(n)
    occurs = np.bincount(ids, minlength=alphabet) > 0
    if len(occurs) > alphabet:
        raise ValueError("id beyond the alphabet")
    present = zlib.compress(np.packbits(occurs).tobytes(), 6)
    grid = np.zeros(lanes * steps, dtype=np.uint16)
    grid[:n] = (np.cumsum(occurs) - 1).astype(np.uint16).take(ids, mode="clip")
    grid = grid.reshape(lanes, steps).T.copy()  # a row for each step
    last = n - (lanes - 1) * steps
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, START)
    out_lane, out_digit = [], []
    model = Model(int(occurs.sum()), False) if n else None
    bits = np.uint64(model.bits) if n else None
    prev = [np.zeros(lanes, dtype=np.int64)] * 2
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        if not m:
            break
        x = grid[t, :m].astype(np.int64)
        model.at(prev[0][:m], prev[1][:m])
        hit2 = model.p2 == x
        missed = (~hit2).astype(np.uint64)
        now = span[:m]
        bound = (now >> np.uint64(16)) * model.chance2()
        low[:m] += bound * missed
        span[:m] = bound + (now - bound - bound) * missed
        on = np.flatnonzero(missed)
        y, lo, now = x.take(on, mode="clip"), low.take(on, mode="clip"), span.take(on, mode="clip")
        bound = (now >> np.uint64(16)) * model.chance1(on)
        hit1 = model.p1_on == y
        missed = (~hit1).astype(np.uint64)
        lo += bound * missed
        now = bound + (now - bound - bound) * missed
        rest = np.flatnonzero(missed)
        s, r = y.take(rest, mode="clip"), now.take(rest, mode="clip") >> bits
        lo[rest] += r * model.cum.take(s, mode="clip")
        now[rest] = r * model.freq.take(s, mode="clip")
        low[on], span[on] = lo, now
        model.learn(x, hit2, hit1, s)
        prev = [prev[1], x]
        while len(small := np.flatnonzero(span < SMALL)):
            lo = low.take(small, mode="clip")
            out_lane.append(small.astype(np.uint16))
            out_digit.append((lo >> KEEP).astype(np.uint32))
            low[small] = (lo & LOW40) << DIGIT
            span[small] = span.take(small, mode="clip") << DIGIT
    every = np.arange(lanes, dtype=np.uint16)
    asked = sum(map(len, out_lane))  # settled while ids were coded: as many the decoder asks for, each FIRST digits later
    for _ in range(FIRST):
        out_lane.append(every)
        out_digit.append((low >> KEEP).astype(np.uint32))
        low = (low & LOW40) << DIGIT
    stream = np.zeros(0, np.uint32)
    if n:
        lane = np.concatenate(out_lane)
        order = np.argsort(lane, kind="stable")  # a radix sort
        digit = np.concatenate(out_digit)[order]
        while len(over := np.flatnonzero(digit > LOW20)):
            digit[over] &= np.uint32(LOW20)
            digit[over - 1] += np.uint32(1)
        counts = np.bincount(lane, minlength=lanes)
        first = (np.cumsum(counts) - counts)[:, None] + np.arange(FIRST)
        later = np.ones(len(digit), bool)
        later[first] = False
        stream = np.empty(len(digit), np.uint32)
        stream[: FIRST * lanes] = digit[first].ravel()
        stream[FIRST * lanes + order[order < asked]] = digit[later]
    body = struct.pack("<I", len(present)) + present + _pack20(stream)
    head = HEADER.pack(MAGIC, lanes, steps, n, alphabet, TABLES, zlib.crc32(ids.astype("<u4").tobytes()), len(stream), 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if any checksum fails."""
    if len(block) < HEADER.size:
        raise ValueError("block cut short")
    magic, lanes, steps, n, alphabet, tables, ids_crc, digits, crc = HEADER.unpack_from(block)
    body = block[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body, zlib.crc32(block[: HEADER.size - 4])) != crc:
        raise ValueError("block damaged")
    if tables != TABLES:
        raise ValueError("block written with other rounding tables")
    if not n:
        return np.zeros(0, dtype=np.int64)
    size = struct.unpack_from("<I", body)[0]
    present = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(body[4 : 4 + size]), np.uint8), count=alphabet))
    stream = _unpack20(body[4 + size :], digits)
    at = FIRST * lanes
    first = stream[:at].reshape(lanes, FIRST)
    value = (first[:, 0] << KEEP) | (first[:, 1] << DIGIT) | first[:, 2]
    span = np.full(lanes, START)
    model = Model(len(present), True)
    bits = np.uint64(model.bits)
    grid = np.zeros((steps, lanes), dtype=np.uint16)
    last = n - (lanes - 1) * steps
    prev = [np.zeros(lanes, dtype=np.int64)] * 2
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        if not m:
            break
        model.at(prev[0][:m], prev[1][:m])
        now, held = span[:m], value[:m]
        bound = (now >> np.uint64(16)) * model.chance2()
        hit2 = held < bound
        missed = (~hit2).astype(np.uint64)
        value[:m] -= bound * missed
        span[:m] = bound + (now - bound - bound) * missed
        x = model.p2.astype(np.int64)  # right where order 2 hit, and overwritten elsewhere
        on = np.flatnonzero(missed)
        held, now = value.take(on, mode="clip"), span.take(on, mode="clip")
        bound = (now >> np.uint64(16)) * model.chance1(on)
        hit1 = held < bound
        missed = (~hit1).astype(np.uint64)
        held -= bound * missed
        now = bound + (now - bound - bound) * missed
        y = model.p1_on.astype(np.int64)
        rest = np.flatnonzero(missed)
        v, r = held.take(rest, mode="clip"), now.take(rest, mode="clip") >> bits
        # a quotient of floats may be off by one: where that leaves the id's part, the exact one follows
        s = model.slot.take((v.view(np.int64) / r.view(np.int64)).astype(np.int64), mode="clip")
        left, width = v - r * model.cum.take(s, mode="clip"), r * model.freq.take(s, mode="clip")
        if len(off := np.flatnonzero(left >= width)):
            s[off] = again = model.slot.take((v[off] // r[off]).view(np.int64), mode="clip")
            left[off], width[off] = v[off] - r[off] * model.cum[again], r[off] * model.freq[again]
        held[rest], now[rest], y[rest] = left, width, s
        value[on], span[on], x[on] = held, now, y
        model.learn(x, hit2, hit1, s)
        grid[t, :m] = x
        prev = [prev[1], x]
        while len(small := np.flatnonzero(span < SMALL)):
            value[small] = (value.take(small, mode="clip") << DIGIT) | stream[at : at + len(small)]
            span[small] = span.take(small, mode="clip") << DIGIT
            at += len(small)
    ids = present.take(grid.T.ravel()[:n], mode="clip")
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids do not match their checksum")
    return ids
