"""Substring terms in texts: an automaton of many terms as flat integer arrays, one pass over the bytes of a batch.

A match of UTF-8 bytes is a match of characters, so states move by bytes: the trie is built level by level, failure links
and the complete transition table follow in the same order. A batch of texts is one stream, with a byte that no term
has between texts; the stream is cut into lanes that are read in step, each from as many bytes before its own as the longest
term can reach back, so one very long text is as fast as many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a stream that are read at once, and for terms of over 64 bytes (lanes start with as many bytes before); states are kept for these only.
SEGMENT, LONGEST_SEGMENT = 1 << 18, 1 << 22
#: Bytes that end a run of lower-case ASCII letters and digits.
BORDER = np.array([not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
#: Texts whose hits are held at a time, and their bytes (or one text).
ROWS, PART = 1000, 1 << 20


class Automaton:
    """``terms`` are distinct and not empty; hits are their places in the list."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        sizes = np.array([len(r) for r in raw], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        self.longest = int(sizes.max()) if len(raw) else 1
        self.segment = min(LONGEST_SEGMENT, max(SEGMENT, self.longest << 12))
        self.sizes = sizes
        self.classes = np.zeros(256, np.uint8)
        used = np.unique(data)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        data = self.classes[data].astype(np.int64)
        levels, here, count = [], np.zeros(len(raw), np.int64), 1  # here: the state of each term so far
        for d in range(self.longest):
            live = np.flatnonzero(sizes > d)
            pairs, place = np.unique(here[live] * self.width + data[at[live] + d], return_inverse=True)
            here[live] = count + place
            levels.append((count, pairs // self.width, pairs % self.width))
            count += len(pairs)
        self.own = np.full(count, -1, np.int64)
        self.own[here] = np.arange(len(raw))
        move, fail, self.next = np.zeros((count, self.width), np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64)
        for d, (first, parent, symbol) in enumerate(levels):
            states = np.arange(first, first + len(parent))
            if d:
                fail[states] = move[fail[parent], symbol]
            move[parent, symbol] = states
            move[states] = move[fail[states]]
            # the nearest shorter term that ends where the state ends
            self.next[states] = np.where(self.own[fail[states]] >= 0, fail[states], self.next[fail[states]])
        self.move = move.reshape(-1)
        self.ends = (self.own >= 0) | (self.next > 0)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, term) of the texts ``data[offsets[i]:offsets[i + 1]]``, ordered."""
        found = [np.zeros(0, np.int64)]
        for first, starts, stream, _ in self._streams(data, offsets):
            for a in range(0, len(stream), self.segment):
                place, state = self._read(stream, a, min(len(stream), a + self.segment))
                found.append(np.unique((first + np.searchsorted(starts, place, side="right") - 1) * len(self.own) + state))
        pairs = np.unique(np.concatenate(found))
        text, state = pairs // len(self.own), pairs % len(self.own)
        out = [np.zeros(0, np.int64)]
        while len(state):
            full = self.own[state] >= 0
            out.append(text[full] * len(self.own) + self.own[state[full]])
            text, state = text[self.next[state] > 0], self.next[state][self.next[state] > 0]
        pairs = np.unique(np.concatenate(out))
        return pairs // len(self.own), pairs % len(self.own)

    def bounded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`hits` of the terms that stand between bytes that are no lower-case ASCII letters or digits, or at an end of a text."""
        found = [np.zeros(0, np.int64)]
        for first, starts, stream, border in self._streams(data, offsets):
            for a in range(0, len(stream), self.segment):
                place, state = self._read(stream, a, min(len(stream), a + self.segment))
                free = border[place + 1]  # a text has a byte behind it
                place, state = place[free], state[free]
                while len(state):
                    term = self.own[state]
                    before = place - self.sizes[term]
                    met = (term >= 0) & ((before < 0) | border[before])
                    found.append(np.unique((first + np.searchsorted(starts, place[met], side="right") - 1) * len(self.own) + term[met]))
                    more = self.next[state] > 0
                    place, state = place[more], self.next[state][more]
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.own), pairs % len(self.own)

    def _streams(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """As many texts at a time as have a segment's bytes (or one that has more), one byte of class 0 behind each: number of the first,
        where they start, the classes of their bytes, and which bytes are borders."""
        a, n = 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + self.segment, side="right")) - 1)
            at = offsets[a : b + 1] - offsets[a]
            behind = at[1:] + np.arange(b - a)
            inside = np.ones(int(at[-1]) + b - a, bool)
            inside[behind] = False
            raw = data[offsets[a] : offsets[b]].tobytes()  # an index of bytes would become one of 8 bytes each
            stream, border = np.zeros(len(inside), np.uint8), np.ones(len(inside), bool)
            stream[inside] = np.frombuffer(raw.translate(self.classes.tobytes()), np.uint8)
            border[inside] = np.frombuffer(raw.translate(BORDER.tobytes()), bool)
            yield a, at[:-1] + np.arange(b - a), stream, border
            a = b

    def _read(self, stream: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``stream[a:b]`` where a term ends, and the states there."""
        back = self.longest - 1
        lanes = max(1, min(isqrt(b - a), (b - a) // (4 * self.longest)))
        size = -(-(b - a) // lanes)
        held = np.zeros(back + lanes * size, np.uint8)
        reach = min(back, a)
        held[back - reach : back + b - a] = stream[a - reach : b]
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(held, (back + size, lanes), (1, size)))
        state, states = np.zeros(lanes, np.int64), np.zeros((size, lanes), np.int32)
        for i, symbols in enumerate(steps):
            state = self.move[state * self.width + symbols]
            if i >= back:
                states[i - back] = state
            state = state.astype(np.int64)
        step, lane = np.nonzero(self.ends[states])
        place = a + lane * size + step
        inside = place < b
        return place[inside], states[step[inside], lane[inside]].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Tiers:
    """The terms of one library: hits of a selection come before those of its context."""

    def __init__(self, terms: list[str]):
        """Lower-cased terms in order; equal ones and empty ones (which any text has) may occur, nulls match nothing."""
        distinct = sorted({t for t in terms if t})
        number = {t: i for i, t in enumerate(distinct)}
        self.always = np.array([i for i, t in enumerate(terms) if t == ""], np.int64)
        listed = sorted((number[t], i) for i, t in enumerate(terms) if t)
        self.entry = np.array([i for _, i in listed], np.int64)
        self.at = np.searchsorted(np.array([n for n, _ in listed], np.int64), np.arange(len(distinct) + 1))
        self.automaton = Automaton(distinct)

    def hits(self, selected: pa.Array, context: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tier, place of the term) of each term of each row, once and in the better tier."""
        size = len(self.at)
        chosen, around = (row * size + term for row, term in (self.automaton.hits(*text_bytes(c)) for c in (selected, context)))
        around = np.setdiff1d(around, chosen, assume_unique=True)
        pairs, tier = np.concatenate([chosen, around]), np.repeat([0, 1], [len(chosen), len(around)])
        row, term = pairs // size, pairs % size
        n = self.at[term + 1] - self.at[term]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows = np.arange(len(selected))
        row = np.concatenate([np.repeat(row, n), np.repeat(rows, len(self.always))])
        tier = np.concatenate([np.repeat(tier, n), np.zeros(len(rows) * len(self.always), np.int64)])
        return row, tier, np.concatenate([self.entry[np.repeat(self.at[term], n) + inner], np.tile(self.always, len(rows))])


def first_hits(row: np.ndarray, tier: np.ndarray, entry: np.ndarray, rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of each row by (tier, entry), ``most`` at most, and the rows' offsets."""
    order = np.lexsort((entry, tier, row))
    row, entry = row[order], entry[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < most
    return entry[keep], np.searchsorted(row[keep], np.arange(rows + 1))


def slices(batch: pa.RecordBatch, texts: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``ROWS`` rows and ``PART`` bytes of its columns ``texts``, or of one row that has more."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts))
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART, side="right"))
        b = max(a + 1, min(a + ROWS, b))
        yield batch.slice(a, b - a)
        a = b


def by_value(column: pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    """Each value of a column with its rows, nulls left out."""
    codes = column.dictionary_encode()
    index = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)
    for i, value in enumerate(codes.dictionary.to_pylist()):
        yield value, np.flatnonzero(index == i)
