"""Induced suffix sorting of a shard, with queues of suffixes and common prefixes that spill to disk.

The scheme of SA-IS (Nong, Zhang and Chan, 2009) in the external form of eSAIS
(Bingmann, Fischer and Osipov, 2013): suffixes whose type turns from L to S are
sorted first; the order of the L suffixes is induced from theirs, and that of the
S suffixes from the L suffixes. The priority queue of suffix tuples is a queue
for each first symbol, since tuples of one symbol arrive in order. A tuple is a
position and how many symbols it has in common with the one before it in its
queue: one more than its inducer with the inducer of that one, which is the least
of the values in between (Fischer, 2011). Queues write blocks to a temporary file
beyond ``MEMORY`` tuples and are read back piece by piece; text, types and marks
of a shard beyond it lie in mapped files. The seeds are sorted on names of the
pieces between them, by doubling; only the first ``depth`` symbols count, so there
is no further recursion.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that the queues of a shard hold in memory before blocks go to disk, and tuples taken from a queue at once.
MEMORY, PIECE = 8_000_000, 1 << 17
#: More than any common prefix.
NONE_YET = 1 << 30


def _array(n: int, dtype) -> np.ndarray:
    """Zeros, in a mapped temporary file if there are many."""
    if n <= MEMORY:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile(prefix="suffix-array-") as file:
        return np.memmap(file, dtype, "w+", shape=n)


class _Queues:
    """Queues of (position, common prefix with the one before) blocks, one for each symbol."""

    def __init__(self, symbols: int):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.held = 0
        self.file = None

    def push(self, symbol: int, block: np.ndarray, common: np.ndarray) -> None:
        if not len(block):
            return
        pair = np.stack([block, common]).astype(np.int32)
        if self.held + len(block) > MEMORY:
            self.file = self.file or tempfile.TemporaryFile(prefix="suffix-queue-")
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(pair.tobytes())
            self.blocks[symbol].append((at, len(block)))
        else:
            self.held += len(block)
            self.blocks[symbol].append(pair)

    def take(self, symbol: int, last: bool = False) -> np.ndarray | None:
        """The next blocks that wait under a symbol, or the last ones, about ``PIECE`` tuples; they leave the queue."""
        found, out, size = self.blocks[symbol], [], 0
        if not found:
            return None
        order = range(len(found) - 1, -1, -1) if last else range(len(found))
        for i in order:
            x = found[i]
            if isinstance(x, tuple):
                self.file.seek(x[0])
                x = np.frombuffer(self.file.read(8 * x[1]), np.int32).reshape(2, -1)
            else:
                self.held -= x.shape[1]
            out.append(x)
            size += x.shape[1]
            if size >= PIECE:
                break
        if last:
            del found[len(found) - len(out):]
            out.reverse()
        else:
            del found[:len(out)]
        return np.concatenate(out, axis=1)

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Inducer:
    """Pushes the suffixes one position before those of a sorted sequence, with their common prefixes."""

    def __init__(self, text: np.ndarray, queues: _Queues, symbols: int):
        self.text, self.queues = text, queues
        #: Least common prefix since the last suffix that went to each queue, and whether there is one.
        self.least, self.started = np.full(symbols, NONE_YET, np.int64), np.zeros(symbols, bool)

    def read(self, block: np.ndarray, common: np.ndarray, chosen: np.ndarray) -> None:
        """The next suffixes of the sequence, each with its common prefix with the one before, and which of them induce."""
        at = np.flatnonzero(chosen)
        if not len(at):
            np.minimum(self.least, common.min(), out=self.least)
            return
        symbol = self.text[block[at] - 1]
        order = np.argsort(symbol, kind="stable")
        symbol, at = symbol[order], at[order]
        head = np.r_[True, symbol[1:] != symbol[:-1]]
        begin = np.r_[0, at[:-1] + 1]
        begin[head] = 0
        ranged = np.r_[common, NONE_YET]
        value = np.minimum.reduceat(ranged, np.stack([begin, at + 1], 1).reshape(-1))[::2].astype(np.int64)
        cuts = np.flatnonzero(head)
        own = symbol[cuts].astype(np.int64)
        value[cuts] = np.minimum(value[cuts], self.least[own])
        value += 1
        value[cuts[~self.started[own]]] = 0  # the first of its symbol
        ends = [*cuts[1:].tolist(), len(at)]
        for k, a, b in zip(own.tolist(), cuts.tolist(), ends, strict=True):
            self.queues.push(k, block[at[a:b]] - 1, value[a:b])
        rest = np.minimum.accumulate(ranged[::-1])[::-1]
        np.minimum(self.least, common.min(), out=self.least)
        self.least[own] = rest[at[np.array(ends) - 1] + 1]
        self.started[own] = True


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S); the last one is."""
    ends = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    rising = np.r_[text[ends[:-1]] < text[ends[:-1] + 1], True]
    return np.repeat(rising, np.diff(np.r_[-1, ends]))


def _words(text: np.ndarray) -> np.ndarray:
    """For each place, and the one after the end, the seven symbols from there on, nine bits each, as one number; zeros follow the end."""
    out = _array(len(text) + 1, np.uint64)
    for a in range(0, len(text), PIECE):
        piece = text[a: a + PIECE + 6].astype(np.uint64)
        word = out[a: min(a + PIECE, len(text))]
        for k in range(7):
            word <<= np.uint64(9)
            word[: max(0, len(piece) - k)] |= piece[k: k + len(word)]
    return out


def _refined(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tells apart, by a key, the entries that share a rank; gives those that still do. A rank is the number of smaller entries."""
    order = np.lexsort((key, rank[open_]))
    own, key = open_[order], key[order]
    old = rank[own]
    at = np.arange(len(own))
    group = np.r_[True, old[1:] != old[:-1]]
    head = group.copy()
    head[1:] |= key[1:] != key[:-1]
    rank[own] = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
    return own[~(head & np.r_[head[1:], True])]


def _sorted_seeds(words: np.ndarray, seeds: np.ndarray, depth: int) -> np.ndarray:
    """The seeds in the order of the first ``depth`` symbols of their suffixes."""
    length = np.diff(np.r_[seeds, len(words) - 1]) + 1  # a piece reaches to the first symbol of the next
    length[-1] = 1
    rank, open_ = np.zeros(len(seeds), np.int64), np.arange(len(seeds))
    for at in range(0, min(int(length.max()), depth + 7), 7):
        # a piece that has ended comes after those that go on (its last symbol is of type S)
        left = length[open_] - at
        word = np.full(len(open_), 1 << 63, np.uint64)
        some = left > 0
        short = np.clip(7 - left[some], 0, 7).astype(np.uint64) * np.uint64(9)
        word[some] = words[seeds[open_[some]] + at] | ((np.uint64(1) << short) - np.uint64(1))
        open_ = _refined(rank, open_, word)
        if not len(open_):
            break
    step = 1
    while len(open_) and step < depth:  # a name stands for two symbols at least
        after = np.where(open_ + step < len(seeds), rank[np.minimum(open_ + step, len(seeds) - 1)], -1)
        open_ = _refined(rank, open_, after)
        step *= 2
    return seeds[np.argsort(rank, kind="stable")]


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many of the first ``depth`` symbols the suffixes at two different places have in common, pair by pair.

    No pair goes on past the end: zeros follow it, and something else follows any other 0.
    """
    out, open_ = np.full(len(a), depth, np.int64), np.arange(len(a))
    bounds = np.uint64(1) << np.arange(9, 63, 9, dtype=np.uint64)
    for k in range(0, depth, 7):
        differ = words[a] ^ words[b]
        ended = differ != 0
        out[open_[ended]] = k + 6 - np.searchsorted(bounds, differ[ended], side="right")
        open_, a, b = open_[~ended], a[~ended] + 7, b[~ended] + 7
        if not len(open_):
            break
    return np.minimum(out, depth)


def sorted_suffixes(text: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, common prefix with the position before) in falling order of the first ``depth`` symbols of their suffixes.

    ``text`` holds symbols 0 to 256 and ends with 0; 0 occurs nowhere else but
    between pieces, never twice in a row. The end comes after every symbol, and the
    suffix of the last 0 is left out. Common prefixes are right up to ``depth``.
    """
    rising = _types(text)
    seed = np.zeros(len(text), bool)
    seed[1:] = rising[1:] & ~rising[:-1]
    seed[-1] = True
    words = _words(text)
    seeds = _sorted_seeds(words, np.flatnonzero(seed), depth)
    del seed
    between = np.r_[0, _common(words, seeds[1:], seeds[:-1], depth)]
    symbols = int(text.max()) + 1
    first = text[seeds]
    begin = np.searchsorted(first, np.arange(symbols))
    finish = np.searchsorted(first, np.arange(symbols), side="right")

    def seam(a: int, b: int) -> int:
        return int(_common(words, np.array([a]), np.array([b]), depth)[0])

    queue, falling = _Queues(symbols), _Queues(symbols)
    inducer = _Inducer(text, queue, symbols)
    for c in range(symbols):
        last = None
        while (taken := queue.take(c)) is not None:
            block, common = taken
            falling.push(c, block, common)
            inducer.read(block, common, (block > 0) & ~rising[block - 1])
            last = int(block[-1])
        block, common = seeds[begin[c]:finish[c]], between[begin[c]:finish[c]].copy()
        if len(block):
            common[0] = 0 if last is None else seam(last, int(block[0]))
            inducer.read(block, common, (block > 0) & ~rising[block - 1])
    queue.close()
    del seeds, between, first
    queue = _Queues(symbols)
    inducer = _Inducer(text, queue, symbols)
    for c in range(symbols - 1, -1, -1):
        last, carried = None, None
        while (taken := queue.take(c)) is not None:
            block, common = taken
            yield block, common
            inducer.read(block, common, (block > 0) & rising[block - 1])
            last = int(block[-1])
        # the L suffixes from the largest down, each with what it has in common with the larger one
        while (taken := falling.take(c, last=True)) is not None:
            block, common = taken[0][::-1], taken[1][::-1]
            if carried is None:
                carried = 0 if last is None else seam(last, int(block[0]))
            common, carried = np.r_[carried, common[:-1]], int(common[-1])
            yield block, common
            inducer.read(block, common, (block > 0) & rising[block - 1])
    queue.close()
    falling.close()


def repeated(chunks: list[bytes], starts: list[int], window: int) -> list[np.ndarray]:
    """For each chunk, which of its first ``starts`` windows begins elsewhere in the shard too."""
    lengths = np.array([len(c) for c in chunks])
    base = np.cumsum(np.r_[0, lengths[:-1] + 1])
    text = _array(int(lengths.sum()) + len(chunks), np.int16)
    for b, c in zip(base.tolist(), chunks, strict=True):
        text[b: b + len(c)] = np.frombuffer(c, np.uint8)
        text[b: b + len(c)] += 1
    hit, before = _array(len(text), bool), -1
    for block, common in sorted_suffixes(text, window):
        long = np.flatnonzero(common >= window)
        hit[block[long]] = True
        hit[np.where(long > 0, block[long - 1], before)] = True
        before = int(block[-1])
    return [np.array(hit[b: b + n]) for b, n in zip(base.tolist(), starts, strict=True)]
