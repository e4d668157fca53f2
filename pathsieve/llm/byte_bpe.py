"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries of pre-tokens are found without a regular expression. Every code
point gets a class (letter, number, white space, other; the apostrophe of a
contraction and the white space before a word by what follows), and each class
is a function on the eight states of a small automaton. Functions compose
associatively, so a batch of texts is cut into equal blocks whose functions are
composed side by side; a scan over the blocks' functions gives each block's
first state, and a second pass marks the boundaries. The slices are merged pair
by pair, all unknown slices of a step together, and remembered. A long slice has
a heap of its pairs instead, so that it takes n log n time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathsieve.llm.common import bounded_steps, small_batches, table

#: Bytes that a worker's cache of pre-tokens takes before it starts anew, what an entry takes besides its text, and the longest pre-token it keeps.
CACHE_BYTES, ENTRY_BYTES, KEPT_CHARS = 40_000_000, 220, 256
#: Bytes of the longest pre-token that is merged together with others; a longer one has a heap of its own.
TOGETHER_BYTES = 256
#: Code points per block of the scan.
BLOCK = 128

# classes of code points
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
# symbols: what a position means to the automaton
S_OTHER, S_LETTER, S_NUMBER, S_SHORT, S_LONG, S_GAP, S_LAST_GAP, S_PREFIX = range(8)
# states: the pre-token that is open after a position
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, AFTER_PREFIX, ONE_MORE, TWO_MORE = range(8)
#: Letters after an apostrophe that make a pre-token with it: 's 't 'm 'd and 're 've 'll (fixed values of the pattern).
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, boundary before) by symbol and state; symbols from 8 up begin a text."""
    fresh = {S_OTHER: IN_OTHERS, S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_SHORT: ONE_MORE, S_LONG: TWO_MORE, S_GAP: IN_GAP, S_LAST_GAP: CLOSED, S_PREFIX: AFTER_PREFIX}
    go, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol, state in fresh.items():
        go[symbol], go[symbol + 8] = state, state
    for state, symbols in ((IN_LETTERS, [S_LETTER]), (IN_NUMBERS, [S_NUMBER]), (IN_OTHERS, [S_OTHER, S_SHORT, S_LONG]), (IN_GAP, [S_GAP])):
        cut[symbols, state] = False
        go[symbols, state] = state
    cut[:8, AFTER_PREFIX] = False
    go[[S_OTHER, S_SHORT, S_LONG], AFTER_PREFIX] = IN_OTHERS
    cut[:8, [ONE_MORE, TWO_MORE]] = False
    go[:8, ONE_MORE], go[:8, TWO_MORE] = CLOSED, ONE_MORE
    return go, cut


GO, CUT = _automaton()


def code_point_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own Unicode tables have it."""
    import tiktoken

    bytes_only = {bytes([i]): i for i in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        encoding = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
        for first in range(0, 0x110000, 0x8000):
            points = [c for c in range(first, first + 0x8000) if not 0xD800 <= c < 0xE000]
            found = encoding.encode_ordinary("".join(map(chr, points)))
            out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    out[ord(" ")] = BLANK
    return out


def symbols_of(points: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The automaton's symbol at each code point of texts that begin at ``starts``."""
    n = len(points)
    kind = classes[points]
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    last[-1] = True
    gap = kind >= SPACE
    gap_next = np.ones(n, bool)
    gap_next[:-1] = gap[1:]
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_LAST_GAP, S_PREFIX], np.uint8)[kind]
    symbols[gap & (gap_next | last)] = S_GAP
    quotes = np.flatnonzero((points == ord("'")) & ~last)
    if len(quotes):
        first = points[quotes + 1]
        short = np.isin(first, [ord(c) for c in ONE_LETTER])
        symbols[quotes[short]] = S_SHORT
        rest = quotes[~short & ~last[quotes + 1]]
        one, two = points[rest + 1], points[rest + 2]
        long = np.zeros(len(rest), bool)
        for a, b in TWO_LETTERS:
            long |= (one == ord(a)) & (two == ord(b))
        symbols[rest[long]] = S_LONG
    symbols[starts] += 8
    return symbols


def boundaries(symbols: np.ndarray) -> np.ndarray:
    """Positions where a pre-token begins."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat = GO.reshape(-1)
    # the function of each block, composed position by position for all blocks at once
    whole = np.tile(np.arange(8, dtype=np.intp), (blocks, 1))
    for row in grid:
        whole = flat[(row.astype(np.intp) * 8)[:, None] + whole].astype(np.intp)
    # inclusive scan over the blocks by doubling: composition is associative
    step = 1
    while step < blocks:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        step *= 2
    state = np.zeros(blocks, np.intp)
    state[1:] = whole[:-1, CLOSED]
    cuts = np.empty((BLOCK, blocks), bool)
    cut = CUT.reshape(-1)
    for i, row in enumerate(grid):
        at = row.astype(np.intp) * 8 + state
        cuts[i] = cut[at]
        state = flat[at].astype(np.intp)
    return np.flatnonzero(cuts.T.reshape(-1)[:n])


class PairMerger:
    """Merges the byte pairs of many pre-tokens together."""

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray):
        self.byte_ids, self.keys, self.ranks = byte_ids, keys, ranks
        self.table: dict[int, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": {}}

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> PairMerger:
        """Of the ranks of a .tiktoken file."""
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array(sorted(pairs), np.int64)
        return cls(np.array([ranks[bytes([i])] for i in range(256)], np.int64), keys, np.array([pairs[k] for k in keys.tolist()], np.int64))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], 1 << 40)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        if max(map(len, words), default=0) <= TOGETHER_BYTES:
            return self._merge_together(words)
        short = iter(self._merge_together([w for w in words if len(w) <= TOGETHER_BYTES]))
        return [next(short) if len(w) <= TOGETHER_BYTES else self._merge_long(w) for w in words]

    def _merge_long(self, word: bytes) -> bytes:
        """Ids of one word; its pairs wait in a heap by rank, then place, and its parts are a linked list."""
        if not self.table:
            self.table = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        rank_of, n = self.table.get, len(word)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        # the rank of the pair that begins at each place; what the heap says of another rank is out of date
        pair = [rank_of(a << 32 | b, -1) for a, b in zip(ids, ids[1:])] + [-1]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if pair[i] != rank:
                continue
            gone = right[i]
            after = right[gone]
            ids[i], ids[gone], pair[gone], right[i] = rank, -1, -1, after
            pair[i] = -1
            if after < n:
                left[after] = i
                pair[i] = rank_of(rank << 32 | ids[after], -1)
                if pair[i] >= 0:
                    heapq.heappush(heap, pair[i] << 32 | i)
            before = left[i]
            if before >= 0:
                pair[before] = rank_of(ids[before] << 32 | rank, -1)
                if pair[before] >= 0:
                    heapq.heappush(heap, pair[before] << 32 | before)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _merge_together(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            rank = np.full(len(ids), 1 << 40, np.int64)
            inside = word[:-1] == word[1:]
            where = np.flatnonzero(inside)
            rank[where] = self._rank(ids[where], ids[where + 1])
            starts = np.flatnonzero(np.r_[True, ~inside])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(ids)])
            open_words = least < 1 << 40
            keep = np.repeat(open_words, lengths)
            if not open_words.all():
                done_ids.append(ids[~keep])
                done_words.append(word[~keep])
                ids, word, rank = ids[keep], word[keep], rank[keep]
                least, lengths = least[open_words], lengths[open_words]
                if not len(ids):
                    break
            # every place of the word's lowest pair, from the left without overlap
            hit = rank == np.repeat(least, lengths)
            run = np.flatnonzero(hit)
            first = np.r_[True, (np.diff(run) > 1) | (word[run[1:]] != word[run[:-1]])] if len(run) else np.zeros(0, bool)
            begin = run[np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))]
            run = run[(run - begin) % 2 == 0]
            ids[run] = rank[run]
            rest = np.ones(len(ids), bool)
            rest[run + 1] = False
            ids, word = ids[rest], word[rest]
        if not done_ids:
            return [b""] * len(words)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        ids, ends = ids[order].astype("<u4"), np.cumsum(np.bincount(word, minlength=len(words)))
        raw = ids.tobytes()
        return [raw[4 * (a):4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class ByteBpe:
    """Codec for a .tiktoken file; made once, by whoever has the file, and sent to the workers without its cache."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merger = PairMerger.of(ranks)
        self.classes = code_point_classes()
        self.pieces = {i: b for b, i in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "cached": 0}

    def slices(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each text."""
        full = "".join(texts)
        out: list[list[str]] = [[] for _ in texts]
        if not full:
            return out
        points = np.frombuffer(full.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        filled = np.flatnonzero(lengths)
        starts = (ends - lengths)[filled]
        cuts = boundaries(symbols_of(points, starts, self.classes))
        places = cuts.tolist()
        words = [full[a:b] for a, b in zip(places, [*places[1:], len(full)], strict=True)]
        of_text = [*np.searchsorted(cuts, starts).tolist(), len(words)]
        for k, i in enumerate(filled.tolist()):
            out[i] = words[of_text[k]:of_text[k + 1]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cache = self.cache
        if self.cached > CACHE_BYTES:
            cache.clear()
            self.cached = 0
        split = self.slices(texts)
        missing = list({w for words in split for w in words if w not in cache})
        long = []
        if missing:
            made = self.merger.merge([w.encode() for w in missing])
            cache.update(zip(missing, made, strict=True))
            self.cached += ENTRY_BYTES * len(missing) + sum(map(len, missing)) + sum(map(len, made))
            long = [w for w in missing if len(w) > KEPT_CHARS]
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for w in long:
            self.cached -= ENTRY_BYTES + len(w) + len(cache.pop(w))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """First byte of each id in the decoded text, and the text's length."""
        return np.cumsum([0, *(len(self.pieces[i]) for i in np.frombuffer(ids, "<u4").tolist())])


def codec(spark: SparkSession, vocabulary: str) -> Broadcast:
    """The codec of a .tiktoken file, a name of the public tokenizers or a path, for all workers: about 3 MB, whatever is encoded."""
    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return spark.sparkContext.broadcast(ByteBpe(vocabulary))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", offsets: str | None = None, round_trip: str | None = None) -> DataFrame:
    """``df`` with the ids of every whole text (array<int>), and optionally each id's first byte, and whether they decode to the text.

    No row is shuffled, and encoding and decoding are one pass. A null or empty
    text has no ids; rows repeat as they do in ``df``; a column of ``df`` named
    like a new one is replaced.
    """
    from pyspark.sql import types as T

    small_batches(df.sparkSession)
    ints = T.ArrayType(T.IntegerType())
    new = {ids: ints} | ({offsets: ints} if offsets else {}) | ({round_trip: T.BooleanType()} if round_trip else {})
    kept = [c for c in df.columns if c not in new]
    shared = codec(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in bounded_steps(texts):
                made = own.encode(texts[a:b])
                columns = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in made], pa.list_(pa.int32()))]
                if offsets:
                    columns.append(pa.array([own.offsets(x)[:-1].astype(np.int32) for x in made], pa.list_(pa.int32())))
                if round_trip:
                    columns.append(pa.array([own.decode(x) == t.encode() for x, t in zip(made, texts[a:b], strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *columns], [*kept, *new])

    # the text goes along as a last column, whether or not it is kept
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(k, kind) for k, kind in new.items())])
    return df.select(*kept, F.col(text).cast("string").alias("_text_")).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for; null ids give null. An id outside the vocabulary is an error."""
    from pyspark.sql import types as T

    kept = [c for c in df.columns if c != out]
    small_batches(df.sparkSession)
    shared = codec(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            made = [None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], [*kept, out])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.BinaryType())])
    return df.select(*kept, F.col(ids).alias("_ids_")).mapInArrow(run, schema)


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the encoding of each whole text and its way back, as digests.

    Encoding and decoding run in one pass over a batch, so that ids need not
    leave the task.
    """
    shared = codec(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for a, b in bounded_steps(texts):
                rows += [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(own.decode(x)).hexdigest()) for x in own.encode(texts[a:b])]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")
