"""Adaptive context-mixing range coder for token ids; many blocks advance in step, one numpy lane each.

A block lists its different ids (its alphabet); a symbol is a place in that list. Every block starts from the same empty model and
is coded symbol by symbol:

1. Is it the one that the two before it (order 2) last led to, or where those are new, the one before it (order 1)? The
   probability comes from three adaptive predictions, by the confidence of order 2, by that of order 1 and by the latest
   outcomes (order 0), mixed in the logistic domain with weights that the block learns.
2. If not, it is coded by its frequency in the block so far (order 0), summed up anew every ``_RENEW`` symbols.

All arithmetic is on integers, so that every machine decodes what any other has written.
"""

from __future__ import annotations

import math

import numpy as np

#: Ids that a block holds at most, blocks that are coded at a time, and slots (as a power of two) of an order's predictions.
BLOCK, LANES, SLOTS = 8192, 1024, 10
_RENEW = 256
_U = np.uint64
_WORD, _MASK = _U(32), _U(0xFFFFFFFF)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], np.int32)
_STRETCH = np.array([min(2047, max(-2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)
_LATEST = 64  # predictions by the latest outcomes; those by confidence and agreement are 32 an order


class _Writer:
    """Range coder of all lanes; a carry runs back into words already written."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 2 ** 64 - 1, _U)
        self.words, self.count = np.zeros((lanes, 1024), np.uint32), np.zeros(lanes, np.int64)

    def _put(self, at: np.ndarray) -> None:
        place, low = self.count[at], self.low[at]
        if int(place.max(initial=0)) >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        self.words[at, place] = low >> _WORD
        self.count[at] = place + 1
        self.low[at] = low << _WORD

    def narrow(self, n: int, start: np.ndarray, width: np.ndarray) -> None:
        low = self.low[:n]
        low += start
        wrapped = low < start
        if wrapped.any():
            for lane in np.flatnonzero(wrapped):
                place = self.count[lane] - 1
                while self.words[lane, place] == 0xFFFFFFFF:
                    self.words[lane, place] = 0
                    place -= 1
                self.words[lane, place] += 1
        self.range[:n] = width
        small = np.flatnonzero(width <= _MASK)
        if len(small):
            self.range[small] = width[small] << _WORD
            self._put(small)

    def payloads(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(2):
            self._put(every)
        return [self.words[i, :n].astype("<u4").tobytes() for i, n in enumerate(self.count)]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        self.words = np.zeros((len(payloads), max(len(p) for p in payloads) // 4 + 4), np.uint32)
        for i, p in enumerate(payloads):
            self.words[i, : len(p) // 4] = np.frombuffer(p, "<u4")
        self.code = (self.words[:, 0].astype(_U) << _WORD) | self.words[:, 1]
        self.range, self.count = np.full(len(payloads), 2 ** 64 - 1, _U), np.full(len(payloads), 2)

    def narrow(self, n: int, start: np.ndarray, width: np.ndarray) -> None:
        code = self.code[:n]
        code -= start
        self.range[:n] = width
        small = np.flatnonzero(width <= _MASK)
        if len(small):
            self.range[small] = width[small] << _WORD
            place = self.count[small]
            code[small] = (code[small] << _WORD) | self.words[small, np.minimum(place, self.words.shape[1] - 1)]
            self.count[small] = place + 1


class _Model:
    """Model of all lanes: symbols that orders 2 and 1 lead to, predictions of a hit and their weights, frequencies of order 0."""

    def __init__(self, sizes: np.ndarray):
        lanes, self.most = len(sizes), int(sizes.max(initial=1))
        self.led = np.zeros(2 * lanes << SLOTS, np.int32)  # symbol in 13 bits, above them the confidence
        self.slots = (np.arange(2 * lanes, dtype=np.int32) << SLOTS).reshape(2, lanes)
        self.chance = np.full(lanes * (_LATEST + 64), 1 << 15, np.int32)
        self.own = (np.arange(lanes) * (_LATEST + 64) + np.array([[_LATEST], [_LATEST + 32], [0]])).astype(np.int32)
        self.weight = np.full((3, lanes), 24_000, np.int32)
        self.latest = np.zeros(lanes, np.int32)
        self.often = (np.arange(self.most) < sizes[:, None]).astype(np.int32)
        self.sums = np.zeros((lanes, self.most + 1), np.int32)
        self.rows = np.arange(lanes) * (self.most + 1)

    def renew(self, n: int) -> None:
        np.cumsum(self.often[:n], axis=1, out=self.sums[:n, 1:])
        np.minimum(np.maximum(self.weight, -(1 << 18), out=self.weight), 1 << 18, out=self.weight)

    def expect(self, n: int, last: np.ndarray, before: np.ndarray):
        """(slots, symbols and confidences of both orders, guess); the guess is that of order 2 where it has one."""
        slot = np.empty((2, n), np.int32)
        np.multiply(last, 40503, out=slot[1])
        np.add(slot[1], before * 30011, out=slot[0])
        slot &= 0xFFFF
        slot >>= 16 - SLOTS
        slot += self.slots[:, :n]
        held = self.led.take(slot)
        known, sure = held & 0x1FFF, held >> 13
        return slot, known, sure, known[1] + (known[0] - known[1]) * (sure[0] > 0)

    def chances(self, n: int, known, sure):
        """(what was asked, its predictions and their stretched form, mixed chance of a hit in 4096)."""
        own = self.own[:, :n].copy()
        sure += sure
        sure += known[0] == known[1]
        own[:2] += sure
        own[2] += self.latest[:n]
        held = self.chance.take(own)
        inputs = _STRETCH.take(held >> 4)
        mixed = self.weight[:, :n] * inputs
        total = ((mixed[0] + mixed[1] + mixed[2]) >> 16) + 2047
        return own, held, inputs, _SQUASH.take(total, mode="clip")

    def outcome(self, n: int, asked, hit) -> None:
        own, held, inputs, chance = asked
        hit = hit.astype(np.int32)
        inputs *= ((hit << 12) - chance) * 10
        inputs += 0x8000
        inputs >>= 16
        self.weight[:, :n] += inputs
        self.chance[own] = held + (((hit << 16) - hit - held) >> 4)
        self.latest[:n] = ((self.latest[:n] << 1) | hit) & (_LATEST - 1)

    def learn(self, slot, known, sure, value) -> None:
        """An order leads to the latest symbol; its confidence is how often it did so in a row."""
        sure >>= 1
        sure *= known == value
        sure += 1
        np.minimum(sure, 15, out=sure)
        sure <<= 13
        sure |= value
        self.led[slot] = sure

    def totals(self, miss: np.ndarray):
        base = self.rows[miss]
        return base, self.sums.reshape(-1).take(base + self.most).astype(_U)

    def find(self, base, goal):
        """The symbol whose share of the last sums holds ``goal``."""
        sums, at, last, step = self.sums.reshape(-1), base.copy(), base + self.most - 1, 1 << (self.most.bit_length() - 1)
        while step:
            ahead = np.minimum(at + step, last)
            at += (ahead - at) * (sums.take(ahead) <= goal)
            step >>= 1
        return at - base

    def share(self, miss, base, symbol):
        """(start, size) of the symbols by order 0; they are counted."""
        sums, at = self.sums.reshape(-1), base + symbol
        start = sums.take(at)
        self.often.reshape(-1)[miss * self.most + symbol] += 1
        return start.astype(_U), (sums.take(at + 1) - start).astype(_U)


def _run(coder, lengths: np.ndarray, sizes: np.ndarray, symbols: np.ndarray | None) -> np.ndarray:
    """Code (``symbols`` given) or decode all lanes; ``lengths`` falls from lane to lane, ``sizes`` are those of the alphabets."""
    lanes, steps = len(lengths), int(lengths.max(initial=0))
    out = np.zeros((steps, lanes), np.int32) if symbols is None else symbols
    model = _Model(sizes)
    last = before = np.zeros(lanes, np.int32)
    running = lanes - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
    for step in range(steps):
        n = int(running[step])
        if step % _RENEW == 0 or step == _RENEW // 4:
            model.renew(n)
        last, before = last[:n], before[:n]
        slot, known, sure, guess = model.expect(n, last, before)
        asked = model.chances(n, known, sure)
        whole = coder.range[:n]
        width = (whole >> _U(12)) * asked[-1].astype(_U)  # a hit takes the first part of the interval, order 0 the rest
        start = np.zeros(n, _U)
        hit = coder.code[:n] < width if symbols is None else symbols[step, :n] == guess
        miss = np.flatnonzero(~hit)
        if len(miss):
            base, total = model.totals(miss)
            begin = width[miss]
            unit = (whole[miss] - begin) // total
            if symbols is None:
                guess[miss] = symbol = model.find(base, ((coder.code[miss] - begin) // unit).astype(np.int64))
            else:
                symbol = symbols[step, miss]
            low, size = model.share(miss, base, symbol)
            start[miss], width[miss] = begin + unit * low, unit * size
        if symbols is None:
            out[step, :n] = guess
        value = out[step, :n]
        coder.narrow(n, start, width)
        model.outcome(n, asked, hit)
        model.learn(slot, known, sure, value)
        last, before = value, last
    return out


def encode(blocks: list[np.ndarray]) -> list[tuple[np.ndarray, bytes]]:
    """(alphabet, payload) of each block: its different ids in rising order, and the coded ids."""
    out: list = [None] * len(blocks)
    for part in _lanes([len(b) for b in blocks]):
        lengths = np.array([len(blocks[i]) for i in part])
        symbols, alphabets = np.zeros((int(lengths.max(initial=0)), len(part)), np.int32), []
        for lane, i in enumerate(part):
            alphabet, symbols[: lengths[lane], lane] = np.unique(blocks[i], return_inverse=True)
            alphabets.append(alphabet)
        coder = _Writer(len(part))
        _run(coder, lengths, np.array([len(a) for a in alphabets]), symbols)
        for i, *found in zip(part, alphabets, coder.payloads()):
            out[i] = tuple(found)
    return out


def decode(coded: list[tuple[np.ndarray, bytes]], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(coded)
    for part in _lanes(lengths):
        alphabets, payloads = zip(*(coded[i] for i in part))
        got = _run(_Reader(payloads), np.array([lengths[i] for i in part]), np.array([len(a) for a in alphabets]), None)
        for lane, i in enumerate(part):
            out[i] = alphabets[lane][got[: lengths[i], lane]]
    return out


def _lanes(lengths):
    """Blocks in falling order of length, some at a time."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for begin in range(0, len(order), LANES):
        yield order[begin: begin + LANES]
