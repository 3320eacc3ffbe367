"""Adaptive context-mixing range coder for token ids.

A block codes its ids in lanes that advance together, one id each a step, so
that a step's arithmetic runs over whole arrays. All lanes share one model that
starts empty in each block and learns after each step what the step coded.

An id is coded as one of three events: it is the guess of the order-2 context
(the two ids before it), or that of the order-1 context, or neither; then its
place in the adaptive order-0 frequencies follows, and both narrow the range at
once. The events' probabilities mix three opinions in the stretched domain, with
weights trained on-line: how often guesses of this confidence of order 2 and of
order 1 held, and how often any guess held. Confidences and agreement have few
values, so the mixer works on a table of states. Only the four basic operations
and square roots are used on floats, which give the same result on every
machine, so a block decodes anywhere.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"PFT3"
LANES, STEPS = 16384, 192
_U = np.uint64
_FLOOR = _U(1 << 32)
_EVENT_BITS = 12
_EVENTS = 1 << _EVENT_BITS
_CTX_BITS = 18
_LEVELS = 8  # confidences

_STATES = _LEVELS * _LEVELS * 2
_STATE = np.arange(_STATES)
_C2, _C1, _SAME = _STATE >> 4, (_STATE >> 1) & 7, (_STATE & 1).astype(bool)


def _stretch(p: np.ndarray) -> np.ndarray:
    return (2 * p - 1) / (2 * np.sqrt(p * (1 - p)))


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * x / np.sqrt(1 + x * x)


def _total(x: np.ndarray) -> float:
    return float(np.cumsum(x)[-1])  # one order of addition everywhere


class _Mixer:
    """Probability of an event in each state, from counts by confidence and trained weights."""

    def __init__(self) -> None:
        self.hits2, self.seen2 = np.full(_LEVELS, 0.5), np.ones(_LEVELS)
        self.hits1, self.seen1 = np.full(_LEVELS, 0.5), np.ones(_LEVELS)
        self.hits, self.seen = 0.5, 1.0
        self.weights = np.array([[0.5, 0.3, 0.1], [0.5, 0.3, 0.1]])
        self.refresh()

    def refresh(self) -> None:
        edge = lambda h, n: np.minimum(np.maximum(h / n, 1 / 4096), 4095 / 4096)
        s2, s1 = _stretch(edge(self.hits2, self.seen2))[_C2], _stretch(edge(self.hits1, self.seen1))[_C1]
        s0 = _stretch(edge(np.full(1, self.hits), np.full(1, self.seen)))[0]
        self.inputs = s2, s1, np.full(_STATES, s0)
        w = self.weights[_SAME.astype(int)]
        self.p = np.minimum(np.maximum(_squash(w[:, 0] * s2 + w[:, 1] * s1 + w[:, 2] * s0), 1 / 512), 511 / 512)

    def learn(self, n: np.ndarray, hits: np.ndarray) -> None:
        """n, hits: by state, how often it was met and the event happened."""
        total = _total(n)
        if not total:
            return
        error = (hits - n * self.p) / total
        for same in (0, 1):
            own = _SAME == bool(same)
            for i, x in enumerate(self.inputs):
                self.weights[same, i] += 0.5 * _total((error * x / (1 + x * x))[own])
        self.hits2 += np.bincount(_C2, hits, _LEVELS)
        self.seen2 += np.bincount(_C2, n, _LEVELS)
        self.hits1 += np.bincount(_C1, hits, _LEVELS)
        self.seen1 += np.bincount(_C1, n, _LEVELS)
        self.hits += _total(hits)
        self.seen += total
        self.refresh()


def _mask(which: np.ndarray) -> np.ndarray:
    """All bits where ``which`` holds, none elsewhere."""
    return np.negative(which.view(np.int8)).astype(np.int32)


class _Model:
    def __init__(self, size: int) -> None:
        self.size, self.zero_bits = size, 18 if size <= 1 << 17 else 20
        if size > 1 << 19:
            raise ValueError("a vocabulary of more than 2**19 ids")
        self.order1, self.order2 = np.zeros(size, np.int32), np.zeros(1 << _CTX_BITS, np.int32)  # guess << 3 | confidence
        self.first, self.second = _Mixer(), _Mixer()
        self.counts = np.zeros(size, np.int64)
        self.coded: list[tuple[np.ndarray, np.ndarray]] = []  # ids, and their events and states, since the last lesson
        self.step = self.lesson = 1
        self._zero()
        self._events()

    def _zero(self) -> None:
        """Order-0 ranges in proportion to the counts, none empty, that fill 2**zero_bits."""
        run, total = np.cumsum(self.counts), 1 << self.zero_bits
        if run[-1]:
            ends = np.arange(1, self.size + 1) + run * (total - self.size) // run[-1]
        else:
            ends = np.arange(1, self.size + 1) * total // self.size
        self.width = np.diff(ends, prepend=0)
        self.zero = ((ends - self.width) << 32 | self.width).astype(_U)  # begin and width of each id's
        self.places: np.ndarray | None = None

    def at(self, value: np.ndarray) -> np.ndarray:
        """The id whose order-0 range holds each value."""
        if self.places is None:
            self.places = np.repeat(np.arange(self.size, dtype=np.int32), self.width)
        return self.places[value]

    def _events(self) -> None:
        """Where the three events of each state begin and how wide they are, out of 2**12."""
        f2 = np.maximum(1, (self.first.p * (_EVENTS - 2)).astype(np.int64))
        f1 = np.where(_SAME, 0, np.maximum(1, ((_EVENTS - f2) * self.second.p).astype(np.int64)))
        f1 = np.minimum(f1, _EVENTS - f2 - 1)
        self.bounds = f2 << 16 | (f2 + f1)
        self.events = np.concatenate([f2, f2 << 16 | f1, (f2 + f1) << 16 | (_EVENTS - f2 - f1)]).astype(_U)

    def guess(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """(order-2 context, its cell, the order-1 cell, both guesses, state) after the ids ``two``, ``one``."""
        ctx = ((one.view(np.uint32) * np.uint32(0x9E3779B1) + two.view(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - _CTX_BITS)).astype(np.intp)
        cell2, cell1 = self.order2.take(ctx, mode="clip"), self.order1.take(one, mode="clip")
        g2, g1 = cell2 >> 3, cell1 >> 3
        state = ((cell2 & 7) << 4) + ((cell1 & 7) << 1)
        state += g1 == g2
        return ctx, cell2, cell1, g2, g1, state

    def coded_as(self, x: np.ndarray, g2: np.ndarray, g1: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """(whether the order-2 guess held, whether that of order 1, event and state in one number, begin and width of the range out of 2**(12 + zero_bits))."""
        held2, held1 = x == g2, x == g1
        other = ~held2
        event = other.view(np.int8) + (other & ~held1).view(np.int8)
        cell = (state + (event.astype(np.int32) << 7)).astype(np.intp)
        own, zero = self.events.take(cell, mode="clip"), self.zero.take(x, mode="clip")
        zero ^= (zero ^ _U(1 << self.zero_bits)) & np.negative((event < 2).view(np.int8)).astype(np.int64).view(_U)  # a guess takes all of its event
        size = own & _U(0xFFFF)
        return held2, held1, cell, (own >> _U(16) << _U(self.zero_bits)) + (zero >> _U(32)) * size, (zero & _U(0xFFFFFFFF)) * size

    def learn(self, x: np.ndarray, one: np.ndarray, guessed: tuple[np.ndarray, ...], held2: np.ndarray, held1: np.ndarray, cell: np.ndarray) -> None:
        known = x << 3
        for table, at, was, hit in ((self.order2, guessed[0], guessed[1], held2), (self.order1, one, guessed[2], held1)):
            sure = was & 7
            new = was - (((sure + 1) >> 1) & _mask(~hit))
            new += hit & (sure < _LEVELS - 1)
            new ^= (new ^ known) & _mask(~hit & (sure == 0))  # a guess without confidence that failed
            table[at] = new
        self.coded.append((x, cell))
        if self.step == self.lesson:
            self.study()
            self.lesson += max(1, self.step // 5)
        self.step += 1

    def study(self) -> None:
        """Train the mixers and count ids for order 0; lessons come ever less often."""
        x, cell = (np.concatenate(c) for c in zip(*self.coded, strict=True))
        self.coded.clear()
        n = np.bincount(cell, minlength=3 * _STATES).reshape(3, -1).astype(float)
        self.first.learn(n[0] + n[1] + n[2], n[0])
        apart = np.where(_SAME, 0.0, 1.0)
        self.second.learn((n[1] + n[2]) * apart, n[1] * apart)
        self._events()
        self.counts += np.bincount(x[cell >= 2 * _STATES], minlength=self.size)
        self._zero()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray, size: int) -> bytes:
    """One block of ids below ``size``.

    A lane holds 64 bits of range and gives out 32 at a time: a step takes at
    most 32 of them, so there is at most one word a step. A carry out of a lane's
    64 bits is added to the word before, and words that overflow are settled last.
    """
    n = len(ids)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(size)
    bits = _U(_EVENT_BITS + model.zero_bits)
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    room = steps + 2
    out = np.zeros(lanes * room, _U)
    begin = np.arange(lanes) * room + 1  # a word in front of each lane's own, which never gets a carry
    at = begin.copy()
    one = two = np.zeros(lanes, np.int32)
    for x in grid:
        guessed = model.guess(one, two)
        held2, held1, cell, start, width = model.coded_as(x, *guessed[3:])
        part = rng >> bits
        moved = low + part * start
        carry = np.flatnonzero(moved < low)
        if len(carry):
            out[at[carry] - 1] += _U(1)
        low, rng = moved, part * width
        due = np.flatnonzero(rng < _FLOOR)
        if len(due):
            own, place = low[due], at[due]
            out[place] = own >> _U(32)
            at[due] = place + 1
            low[due] = own << _U(32)
            rng[due] <<= _U(32)
        model.learn(x, one, guessed, held2, held1, cell)
        one, two = x, one
    last = low + (_FLOOR - _U(1))
    out[at[last < low] - 1] += _U(1)
    out[at] = last >> _U(32)
    at += 1
    while len(over := np.flatnonzero(out >> _U(32))):  # carries run on to the word before
        out[over] &= _FLOOR - _U(1)
        out[over - 1] += _U(1)
    used = at - begin
    wide = 2 if used.max() < 1 << 16 else 4
    words = out.reshape(lanes, room)[:, 1:]
    body = used.astype(f"<u{wide}").tobytes() + words[np.arange(room - 1) < used[:, None]].astype("<u4").tobytes()
    head = MAGIC + np.array([n, size, wide, zlib.crc32(np.asarray(ids, "<u4").tobytes()), zlib.crc32(body)], "<u4").tobytes()
    return head + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if a checksum does not hold."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, size, wide, crc, body_crc = (int(x) for x in np.frombuffer(block, "<u4", 5, 4))
    if zlib.crc32(block[24:]) != body_crc:
        raise ValueError("a block is damaged")
    lanes, steps = _shape(n)
    used = np.frombuffer(block, f"<u{wide}", lanes, 24).astype(np.int64)
    flat = np.frombuffer(block, "<u4", int(used.sum()), 24 + wide * lanes)
    # two words of zeros follow each lane's own, since a lane reads 64 bits ahead
    at = np.cumsum(used + 2) - used - 2
    words = np.zeros(len(flat) + 2 * lanes, np.uint32)
    words[np.arange(len(flat)) + 2 * np.repeat(np.arange(lanes), used)] = flat
    code = words[at].astype(_U) << _U(32) | words[at + 1]
    at += 2
    model = _Model(size)
    zero_bits, bits = _U(model.zero_bits), _U(_EVENT_BITS + model.zero_bits)
    most = _U((1 << int(bits)) - 1)
    rng = np.full(lanes, (1 << 64) - 1, _U)
    grid = np.zeros((steps, lanes), np.int32)
    one = two = np.zeros(lanes, np.int32)
    for i in range(steps):
        guessed = model.guess(one, two)
        g2, g1, state = guessed[3:]
        part = rng >> bits
        value = np.minimum(code // part, most).view(np.int64)  # code: how far into the range
        told, bounds = value >> model.zero_bits, model.bounds.take(state, mode="clip")
        x = g1 ^ ((g1 ^ g2) & _mask(told < bounds >> 16))
        begin = bounds & 0xFFFF
        rest = np.flatnonzero(told >= begin)
        if len(rest):
            begin = begin[rest]
            x[rest] = model.at((value[rest] - (begin << model.zero_bits)).astype(np.uint32) // (_EVENTS - begin).astype(np.uint32))
        held2, held1, cell, start, width = model.coded_as(x, g2, g1, state)
        code -= part * start
        rng = part * width
        due = np.flatnonzero(rng < _FLOOR)
        if len(due):
            place = at[due]
            code[due] = code[due] << _U(32) | words[place]
            at[due] = place + 1
            rng[due] <<= _U(32)
        model.learn(x, one, guessed, held2, held1, cell)
        grid[i] = x
        one, two = x, one
    ids = grid.T.ravel()[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block does not decode to what was coded")
    return ids
