"""An adaptive context-mixing range coder for token ids, many independent streams at a time.

A block of ids is laid out in lanes, runs of consecutive ids that are coded in step: step t codes the
t-th id of every lane with what all lanes of the block held before it. Each lane has a coder and a
stream of its own, each block a model of its own, so blocks of one shape go through numpy together.

Every id is coded in one step of the coder by three predictions:

* order 2: the id that last followed the two ids before it, with a count of how often it did;
* order 1: likewise for the one id before it;
* order 0: all ids of the block so far, as often as they came, and a share for ids not met yet,
  which are then coded evenly.

How likely the candidates of order 2 and 1 are is mixed in the logistic domain: the state of each
order, and how common order 0 holds the candidate, add evidence whose weights are trained on every
coded id. All arithmetic is of integers, so that every machine decodes what another one coded.
"""

from __future__ import annotations

import math

import numpy as np

LANES = 64
TABLE_BITS = 15
TOTAL_BITS = 28
SETTLED = np.uint64(1 << 48)
LEAST_RANGE = np.uint64(1 << 40)
WORD = np.uint64(16)
# Logits have 8 fractional bits and 4 more while they are trained.
FINE = 4
SCALE = 1 << 8
MOST_LOGIT = 8 * SCALE
#: Probabilities of logits from -8 to 8, in 16 bits.
SQUASH = np.array(
    [round(65536 / (1 + math.exp(-x / SCALE))) for x in range(-MOST_LOGIT, MOST_LOGIT + 1)], np.int64
)
MOST_SECOND = 65536 - 1024
MOST_FIRST = 65536 - 4096
RATE = 6
#: Bits of a count: how common order 0 holds an id.
COMMON = np.array([n.bit_length() for n in range(1 << 16)], np.int64)
# Where the weights of the two decisions stand in a block's table: order 2, order 1, order 0.
_SECOND, _FIRST = (0, 32, 64), (96, 112, 144)
WEIGHTS = 176


class Streams:
    """One carry-less range coder per lane; 16-bit words."""

    def __init__(self, lanes: int, words: np.ndarray | None = None, firsts: np.ndarray | None = None):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, ~np.uint64(0))
        self.at = np.zeros(lanes, np.int64)
        self.decoding = words is not None
        if self.decoding:
            # what a stream lacks at its end is read as zeros, hence the room behind the last
            self.words = np.append(words, np.zeros(8, np.uint16)).astype(np.uint64)
            self.at += firsts[:-1]
            self.ends = firsts[1:]
            self.code = np.zeros(lanes, np.uint64)
            for _ in range(4):
                self.code = (self.code << WORD) | self._next(slice(None))
        else:
            self.out = np.zeros((lanes, 64), np.uint16)

    def _next(self, lanes) -> np.ndarray:
        at = self.at[lanes]
        word = np.where(at < self.ends[lanes], self.words[np.minimum(at, len(self.words) - 1)], np.uint64(0))
        self.at[lanes] = at + 1
        return word

    def narrow(self, lanes, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """Take [start, start + size) of the range in units, then move out what is settled."""
        low = self.low[lanes] + start * unit
        span = size * unit
        self.low[lanes], self.range[lanes] = low, span
        where = np.arange(len(self.low)) if isinstance(lanes, slice) else lanes
        while True:
            settled = (low ^ (low + span)) < SETTLED
            moved = settled | (span < LEAST_RANGE)
            if not moved.any():
                return
            where, low, span, settled = where[moved], low[moved], span[moved], settled[moved]
            span = np.where(settled, span, -low & (LEAST_RANGE - np.uint64(1)))
            if self.decoding:
                self.code[where] = (self.code[where] << WORD) | self._next(where)
            else:
                at = self.at[where]
                if at.max() >= self.out.shape[1]:
                    self.out = np.pad(self.out, ((0, 0), (0, self.out.shape[1])))
                self.out[where, at] = low >> np.uint64(48)
                self.at[where] = at + 1
            low, span = low << WORD, span << WORD
            self.low[where], self.range[where] = low, span

    def unit(self, lanes, bits: int) -> np.ndarray:
        return self.range[lanes] >> np.uint64(bits)

    def target(self, lanes, unit: np.ndarray, bits: int) -> np.ndarray:
        """Which unit of the range the stream points at."""
        return np.minimum((self.code[lanes] - self.low[lanes]) // unit, np.uint64((1 << bits) - 1)).astype(np.int64)

    def finished(self) -> list[np.ndarray]:
        """The words of each lane; two more tell its last range apart."""
        tail = self.low + np.uint64((1 << 32) - 1)
        words = self.out
        return [
            np.append(words[k, :n], [t >> 48, t >> 32 & 0xFFFF]).astype("<u2")
            for k, (n, t) in enumerate(zip(self.at.tolist(), tail.tolist()))
        ]


class Model:
    """The predictions of ``blocks`` blocks with ``lanes`` lanes each, for ids below ``ids``."""

    def __init__(self, blocks: int, lanes: int, ids: int):
        self.blocks, self.ids = blocks, ids
        self.block = np.repeat(np.arange(blocks), lanes)
        self.own_ids = self.block * (ids + 1)
        self.own_weights = self.block * WEIGHTS
        self.own_entries = self.block << TABLE_BITS
        # id and how often it was right, of each context
        self.second = np.zeros(blocks << TABLE_BITS, np.int32)
        self.first = np.zeros(blocks << TABLE_BITS, np.int32)
        self.weights = np.zeros(blocks * WEIGHTS, np.int64)
        self.counts = np.zeros(blocks * ids, np.int32)
        self.below = np.zeros(blocks * (ids + 1), np.int32)
        self.sorted = np.zeros((blocks, 0), np.int32)
        self.seen = self.new = 0
        self.last = np.zeros(blocks * lanes, np.int64)
        self.before = np.zeros(blocks * lanes, np.int64)
        self.waiting: list[np.ndarray] = []

    def refresh(self, decoding: bool) -> None:
        """Order 0 takes in the ids coded since it last did."""
        if not self.waiting:
            return
        some = np.concatenate([w.reshape(self.blocks, -1) for w in self.waiting], axis=1)
        self.waiting = []
        keys = (some + np.arange(self.blocks)[:, None] * self.ids).ravel()
        self.counts += np.bincount(keys, minlength=len(self.counts)).astype(np.int32)
        counts = self.counts.reshape(self.blocks, self.ids)
        np.cumsum(counts, axis=1, out=self.below.reshape(self.blocks, -1)[:, 1:])
        self.seen += some.shape[1]
        # the share of new ids: as many as there were different ones in the mean block
        self.new = max(1, int(np.count_nonzero(counts) // self.blocks))
        if decoding:
            self.sorted = np.repeat(np.tile(np.arange(self.ids, dtype=np.int32), self.blocks), self.counts).reshape(
                self.blocks, -1
            )

    def predict(self) -> None:
        """Candidates of order 2 and 1 and the shares of the range that they get."""
        mixed = self.last * 0x9E3779B1 ^ (self.before * 0x85EBCA6B + 0x27D4EB2F)
        self.at2 = self.own_entries + ((mixed ^ (mixed >> 17)) & ((1 << TABLE_BITS) - 1))
        mixed = self.last * 0x9E3779B1
        self.at1 = self.own_entries + ((mixed ^ (mixed >> 15)) & ((1 << TABLE_BITS) - 1))
        entry2, entry1 = self.second.take(self.at2), self.first.take(self.at1)
        self.guess2, self.guess1 = entry2 >> 4, entry1 >> 4
        self.sure2, self.sure1 = entry2 & 15, entry1 & 15
        same = self.guess2 == self.guess1
        own = self.own_weights
        of1 = self.sure1 * 2 + same
        self.used2 = (
            own + (self.sure2 * 2 + same),
            own + (of1 + _SECOND[1]),
            own + (self._common(self.guess2) + _SECOND[2]),
        )
        self.used1 = (
            own + (self.sure2 + _FIRST[0]),
            own + (of1 + _FIRST[1]),
            own + (self._common(self.guess1) + _FIRST[2]),
        )
        self.p2 = self._probability(self.used2)
        self.p1 = self._probability(self.used1)
        self.has2 = self.sure2 > 0
        self.has1 = (self.sure1 > 0) & ~(same & self.has2)
        whole = 1 << TOTAL_BITS
        self.share2 = np.where(self.has2, np.minimum(self.p2, MOST_SECOND) << (TOTAL_BITS - 16), 0)
        rest = whole - self.share2
        self.share1 = np.where(self.has1, (rest * np.minimum(self.p1, MOST_FIRST)) >> 16, 0)
        self.rest = rest - self.share1

    def count(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the ids that order 0 holds are below, and how many are equal."""
        where = self.own_ids + ids
        below = self.below.take(where).astype(np.int64)
        return below, self.below.take(where + 1) - below

    def _common(self, ids: np.ndarray) -> np.ndarray:
        return COMMON.take(self.count(ids)[1])

    def _probability(self, used: tuple[np.ndarray, ...]) -> np.ndarray:
        logit = sum(self.weights.take(u) for u in used) >> FINE
        return SQUASH.take(np.clip(logit + MOST_LOGIT, 0, 2 * MOST_LOGIT))

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, train: bool) -> None:
        """The coded ids go into the two tables and, with ``train``, into the weights."""
        if train:
            self._train(self.used2, self.has2, hit2, self.p2)
            self._train(self.used1, self.has1 & ~hit2, hit1, self.p1)
        self._remember(self.second, self.at2, ids, self.guess2, self.sure2)
        self._remember(self.first, self.at1, ids, self.guess1, self.sure1)
        self.before, self.last = self.last, ids
        self.waiting.append(ids)

    def _train(self, used: tuple[np.ndarray, ...], tried: np.ndarray, hit: np.ndarray, p: np.ndarray) -> None:
        where = np.flatnonzero(tried)
        if not len(where):
            return
        error = (hit[where].astype(np.int64) << 16) - p[where]
        # sums of integers below 2 ** 53 are exact in doubles
        for u in used:
            self.weights += np.bincount(u[where], error, len(self.weights)).astype(np.int64) >> RATE

    @staticmethod
    def _remember(table: np.ndarray, at: np.ndarray, ids: np.ndarray, guess: np.ndarray, sure: np.ndarray) -> None:
        right = guess == ids
        kept = np.where(right, np.minimum(sure + 1, 15), sure >> 1)
        table[at] = np.where(right | (kept > 0), guess << 4 | kept, ids << 4 | 1)


def _refreshes(step: int) -> bool:
    return step & (step - 1) == 0 if step < 64 else step % 64 == 0


def _trains(step: int) -> bool:
    return step < 64 or step % 4 == 0


def _run(blocks: int, lanes: int, steps: int, ids: int, streams: Streams, given: np.ndarray | None) -> np.ndarray:
    """Code the ids ``given`` as (steps, blocks * lanes), or decode and return them."""
    model, everything = Model(blocks, lanes, ids), slice(None)
    bits = max(1, (ids - 1).bit_length())
    out = np.zeros((steps, blocks * lanes), np.int64)
    for step in range(steps):
        if _refreshes(step):
            model.refresh(given is None)
        model.predict()
        unit = streams.unit(everything, TOTAL_BITS)
        seen, tops = model.seen, model.share2 + model.share1
        total = seen + model.new if seen else 1
        if given is None:
            target = streams.target(everything, unit, TOTAL_BITS)
            hit2 = target < model.share2
            hit1 = ~hit2 & (target < tops)
            place = np.maximum(((target - tops + 1) * total - 1) // model.rest, 0)
            known = ~hit2 & ~hit1 & (place < seen)
            x = np.where(hit2, model.guess2, np.where(hit1, model.guess1, 0)).astype(np.int64)
            if seen:
                x = np.where(known, model.sorted[model.block, np.minimum(place, seen - 1)], x)
        else:
            x = given[step]
            hit2 = model.has2 & (model.guess2 == x)
            hit1 = ~hit2 & model.has1 & (model.guess1 == x)
        below, count = model.count(x)
        if given is not None:
            known = ~hit2 & ~hit1 & (count > 0)
        novel = ~(hit2 | hit1 | known)
        below[novel], count[novel] = seen, total - seen
        start = tops + model.rest * below // total
        end = tops + model.rest * (below + count) // total
        np.copyto(start, model.share2, where=hit1)
        np.copyto(end, tops, where=hit1)
        np.copyto(start, 0, where=hit2)
        np.copyto(end, model.share2, where=hit2)
        streams.narrow(everything, start.astype(np.uint64), (end - start).astype(np.uint64), unit)
        some = np.flatnonzero(novel)
        if len(some):
            unit = streams.unit(some, bits)
            if given is None:
                x[some] = streams.target(some, unit, bits)
            streams.narrow(some, x[some].astype(np.uint64), np.ones(len(some), np.uint64), unit)
        out[step] = x
        model.update(x, hit2, hit1, _trains(step))
    return out


def shape_of(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of ``n`` ids."""
    lanes = max(1, min(LANES, n // LANES))
    return lanes, -(-n // lanes)


def compress(rows: np.ndarray, ids: int) -> list[list[np.ndarray]]:
    """The streams of each lane for every row, blocks of one length with ids below ``ids``."""
    blocks, n = rows.shape
    lanes, steps = shape_of(n)
    padded = np.zeros((blocks, lanes * steps), np.int64)
    padded[:, :n] = rows
    given = np.ascontiguousarray(padded.reshape(blocks * lanes, steps).T)
    streams = Streams(blocks * lanes)
    _run(blocks, lanes, steps, ids, streams, given)
    words = streams.finished()
    return [words[k * lanes : (k + 1) * lanes] for k in range(blocks)]


def expand(words: np.ndarray, lengths: np.ndarray, n: int, ids: int) -> np.ndarray:
    """The rows back from the words of all lanes and how many each lane has."""
    lanes, steps = shape_of(n)
    blocks = len(lengths) // lanes
    firsts = np.concatenate(([0], np.cumsum(lengths)))
    out = _run(blocks, lanes, steps, ids, Streams(blocks * lanes, words, firsts), None)
    return out.T.reshape(blocks, lanes * steps)[:, :n]
