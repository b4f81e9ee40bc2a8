"""Byte-level BPE encoding and decoding.

Pre-tokenisation is one pass over arrays of code points. Every character gets a class; a class is
a transition function on a small set of states (which run the character before it belongs to).
Functions compose associatively, so the states of a whole batch come from a blocked scan: compose
inside blocks, scan the blocks by doubling, apply. A table of (state, class) then tells where a
piece begins. Pieces go through a cached pair merge; every token keeps its byte offset.

Defined results: a null text encodes to no tokens, and so does an empty one; decoding gives back
exactly the text's UTF-8 bytes; null ids decode to null, and so do ids outside the vocabulary.
Repeated rows are encoded alike; further columns are kept as they are.
"""

from __future__ import annotations

import base64
import gc
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.shared import fresh

VOCABULARY = "byte_bpe_50k.tiktoken"
BATCH_CHARS = 1 << 18        # characters scanned at once; a longer text is scanned alone
GENERATION = 100_000         # pieces per cache generation; two generations are held
NONE = 1 << 30               # rank of a pair that is not in the vocabulary
BLOCK = 128                  # characters composed into one function

# Classes of characters. The last six look one or two characters ahead.
LETTER, NUMBER, OTHER, SPACE, WHITE, SHORT, LONG, LAST_SPACE, LAST_WHITE, END = range(10)
# The run that the character before belongs to. HALF and FULL are inside 've and 's.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, FULL, HALF, CLOSED = range(9)
# Code points with the White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, before looking ahead."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER)
                         for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = WHITE
    table[32] = SPACE
    return table


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, piece begins here), both indexed by class * states + state before."""
    step = np.empty((10, 9), np.uint8)
    step[LETTER] = IN_LETTERS
    step[LETTER, HALF], step[LETTER, FULL] = FULL, CLOSED
    step[NUMBER], step[OTHER], step[END] = IN_NUMBERS, IN_OTHER, START
    step[SPACE] = step[WHITE] = step[LAST_WHITE] = IN_WHITE
    step[LAST_SPACE] = AFTER_SPACE
    step[SHORT], step[LONG] = FULL, HALF
    step[SHORT, [IN_OTHER, AFTER_SPACE]] = step[LONG, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
    begins = np.ones((10, 9), bool)
    begins[LETTER, [IN_LETTERS, AFTER_SPACE, HALF, FULL]] = False
    begins[NUMBER, [IN_NUMBERS, AFTER_SPACE]] = False
    for kind in (OTHER, SHORT, LONG):
        begins[kind, [IN_OTHER, AFTER_SPACE]] = False
    begins[[SPACE, WHITE], IN_WHITE] = False
    return step.ravel(), begins.ravel()


def _states_before(kinds: np.ndarray) -> np.ndarray:
    """The state before every character, by a blocked associative scan of transition functions."""
    step, _ = _machine()
    n = len(kinds)
    blocks = -(-n // BLOCK)
    rows = np.full(blocks * BLOCK, END, np.uint8)
    rows[:n] = kinds
    base = np.ascontiguousarray(rows.reshape(blocks, BLOCK).T).astype(np.intp) * 9
    whole = np.tile(np.arange(9, dtype=np.uint8), (blocks, 1))     # each block's function
    for at in base:
        whole = step[at[:, None] + whole]
    hop = 1
    while hop < blocks:                                            # prefix compositions by doubling
        whole[hop:] = np.take_along_axis(whole[hop:], whole[:-hop].astype(np.intp), axis=1)
        hop *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = whole[:-1, START]
    out = np.empty((BLOCK, blocks), np.uint8)
    for j, at in enumerate(base):
        out[j] = state
        state = step[at + state]
    return out.T.ravel()[:n]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as UTF-8 with one zero byte after each; where pieces begin in it, the byte after
    the last text included; and the piece number at which each text ends."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kinds = _classes()[points]
    kinds[ends] = END
    size = len(points)
    after = np.full(size + 2, END, np.uint8)
    after[:size] = kinds
    solid = ~np.isin(after[1:-1], (SPACE, WHITE, END))
    spaces, whites = (kinds == SPACE) & solid, (kinds == WHITE) & solid
    marks = np.flatnonzero(points == 39)
    if len(marks):
        ahead = np.zeros(size + 2, np.uint32)
        ahead[:size] = points
        one, two = ahead[marks + 1], ahead[marks + 2]
        kinds[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | (
            (one == ord("l")) & (two == ord("l")))
        kinds[marks[pairs]] = LONG
        kinds[ends] = END
    kinds[spaces], kinds[whites] = LAST_SPACE, LAST_WHITE
    begin = _machine()[1][kinds.astype(np.intp) * 9 + _states_before(kinds)]
    begin[ends] = True
    width = (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
    offset = np.cumsum(width) - width
    starts = np.flatnonzero(begin)
    closing = np.searchsorted(starts, ends)
    return joined.encode("utf-8", "surrogatepass"), offset[starts], closing


class Vocabulary:
    """Ranks of byte strings, with the pair merge and its cache."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        self.bytes = [b""] * size
        for word, rank in self.ranks.items():
            self.bytes[rank] = word
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, size)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.two = [NONE] * 65536            # rank of every pair of bytes
        for word, rank in self.ranks.items():
            if len(word) == 2:
                self.two[word[0] << 8 | word[1]] = rank
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    def piece(self, word: bytes) -> tuple[int, ...]:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self.merge(word)
            if len(self.young) >= GENERATION:
                self.old, self.young = self.young, {}
            if len(word) <= 64:
                self.young[word] = ids
        return ids

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Join the pair of lowest rank, leftmost first, until none is in the vocabulary."""
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        if len(word) > 100:
            return self._merge_long(word)
        get = self.ranks.get
        edges = list(range(len(word) + 1))                    # part i is word[edges[i]:edges[i+1]]
        pairs = [self.two[a << 8 | b] for a, b in zip(word, word[1:])]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            del edges[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(word[edges[i]:edges[i + 2]], NONE)
            if i:
                pairs[i - 1] = get(word[edges[i - 1]:edges[i + 1]], NONE)
        return tuple([self.ranks[word[a:b]] for a, b in zip(edges, edges[1:])])

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges with a heap and a linked list: n log n for a piece of any length."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))              # part i is word[i:end[i]]; 0 marks a swallowed one
        before = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = ranks.get(word[i:end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:end[i]]])
            i = end[i]
        return tuple(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def encode_batch(texts: list[str], book: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts in a row, each token's byte offset in its own text, tokens per text)."""
    all_ids, all_offsets, all_counts = [], [], []
    for some in _chunks(texts):
        raw, starts, closing = boundaries(some)
        edges = starts.tolist()
        words = [raw[a:b] for a, b in zip(edges, edges[1:] + [len(raw)])]
        stops = closing.tolist()
        for at in stops:
            words[at] = b""                                   # the byte between two texts
        young = book.young
        found = []
        for word in words:
            ids = young.get(word)
            if ids is None:
                ids = book.piece(word) if word else ()
                young = book.young
            found.append(ids)
        ids = np.fromiter(chain.from_iterable(found), np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        before = np.concatenate(([0], np.cumsum(sizes)))
        counts = np.diff(before[closing], prepend=0)
        length = book.lengths[ids]
        place = np.cumsum(length) - length
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        origin = np.concatenate((place, [0]))[first]
        all_offsets.append(place - np.repeat(origin, counts))
        all_ids.append(ids)
        all_counts.append(counts)
    if not all_ids:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(all_ids), np.concatenate(all_offsets), np.concatenate(all_counts)


def decode_batch(ids: pa.ListArray, offsets: pa.ListArray, book: Vocabulary) -> pa.Array:
    """Bytes of each row's tokens, gathered from the flat vocabulary to their offsets."""
    size = len(ids)
    counts = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
    flat, at = ids.flatten(), offsets.flatten()
    if len(flat) != len(at):
        raise ValueError("every row needs as many offsets as ids")
    tokens = np.asarray(pc.fill_null(flat, -1), np.int64)
    row = np.repeat(np.arange(size), counts)
    known = (tokens >= 0) & (tokens < len(book.lengths))
    tokens = np.where(known, tokens, 0)
    length = book.lengths[tokens]
    bad = np.zeros(size, bool)
    bad[row[~known | (length == 0)]] = True
    bad |= np.asarray(pc.is_null(ids))
    total = np.cumsum(length)
    stops = np.concatenate(([0], np.cumsum(counts)))
    edges = np.concatenate(([0], total))[stops]
    place = np.asarray(pc.fill_null(at, 0), np.int64)
    first = np.repeat(stops[:-1], counts)
    target = place - place[first] + np.repeat(edges[:-1], counts)
    whole = (book.flat[np.repeat(book.places[tokens] - target, length) + np.arange(edges[-1])]
             if len(tokens) else np.zeros(0, np.uint8))
    made = pa.Array.from_buffers(pa.large_binary(), size, [
        None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(whole))])
    return pc.if_else(pa.array(~bad), made, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def encoder(path: str):
    """Column function: text to struct(ids, offsets)."""
    kind = "struct<ids: array<int>, offsets: array<int>>"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        book = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            gc.disable()                       # many small tuples, none of them in a cycle
            try:
                ids, offsets, counts = encode_batch(texts, book)
            finally:
                gc.enable()
            edges = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(edges, pa.array(v.astype(np.int32)))
                 for v in (ids, offsets)], ["ids", "offsets"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def decoder(path: str):
    """Column function: (ids, offsets) to bytes."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        book = vocabulary(path)
        for ids, offsets in batches:
            yield decode_batch(ids, offsets, book)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]],
                           "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")


def encode(df: DataFrame, text: str = "text", ids: str = "ids", offsets: str = "offsets",
           path: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text`` and each token's byte offset in it."""
    both = fresh(df, "_encoded")
    coded = df.withColumn(both, encoder(path or public_tokenizers.path(VOCABULARY))(
        F.col(f"`{text}`").cast("string")))
    return coded.withColumns({ids: F.col(both)["ids"], offsets: F.col(both)["offsets"]}).drop(both)


def decoded(ids: Column, offsets: Column, path: str | None = None) -> Column:
    """The bytes that ``ids`` stand for. A slice of both arrays decodes that stretch of the text."""
    return decoder(path or public_tokenizers.path(VOCABULARY))(ids, offsets)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents with their ids decoded."""
    return df.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), F.col("offsets")), 256).alias("decoded_sha256"))
