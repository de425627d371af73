"""Encoding texts by a public byte-level BPE vocabulary, without a regular expression.

The UTF-8 buffer of an Arrow batch is looked at as a whole: each code point gets a class (letter, number, space, other)
from a table and, from the code points behind it, a symbol (the last space before a word, the begin of a contraction).
Each symbol is a transition function over the eight states of an automaton; composing functions is associative, so the
state before every code point comes from a scan: functions are composed along all blocks side by side, then over the
blocks, and the states are run through once more. Symbol and state tell whether a piece begins. Pieces are hashed from
prefix sums, equal ones are merged once through a bounded cache of pair merges, and the ids are gathered back in order.
Byte offsets of the tokens are kept, so every encoding can be decoded and held against its text.

Defined results: null and empty texts have an empty list; blank texts have the ids of their blanks; repeated rows are
encoded each; a text of any length is encoded whole (one beyond PART bytes is first cut at blanks that always part two
tokens); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary is read (on the driver; its bytes go to the executors).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes looked at together; pieces kept in the cache of merges before it starts anew.
PART, CACHE = 1 << 20, 200_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
OTHER_SYMBOL = 2
#: Characters of class space beyond the separators of Unicode.
SPACES = "\t\n\x0b\x0c\r\x85"
#: What follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    of = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    table = np.fromiter((of.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[[ord(c) for c in SPACES]] = SPACE
    return table


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER and of its inverse, modulo 2**64."""
    up, down = np.full(n, MULTIPLIER, np.uint64), np.full(n, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


#: Symbols: a code point by class, an apostrophe before a contraction of one or two letters, a space before another space
#: or the end, the last blank before something else, any other last space. From FRESH on: the same at a text's begin.
ONE, TWO, MORE, BLANK, LAST, FRESH = 3, 4, 5, 6, 7, 8
#: States: within letters, numbers, others, spaces; behind a blank that joins; one or two letters of a contraction to come;
#: behind a contraction.
IN_SPACE, JOINED, C1, C2, BEHIND = 3, 4, 5, 6, 7
#: Code points that a block of the scan covers.
SCAN = 256


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """State after each (symbol, state), and whether a piece begins there."""
    to, begins = np.zeros((2 * FRESH, 8), np.uint8), np.ones((2 * FRESH, 8), bool)
    for sym in range(FRESH):
        for state in range(8):
            go, new = {MORE: IN_SPACE, BLANK: JOINED, LAST: IN_SPACE, ONE: C1, TWO: C2}.get(sym, sym), True
            if sym == LETTER and state in (C1, C2):
                go, new = (BEHIND if state == C1 else C1), False
            elif sym in (LETTER, NUMBER):
                new = state not in (sym, JOINED)
            elif sym in (OTHER_SYMBOL, ONE, TWO) and state in (OTHER_SYMBOL, JOINED):
                go, new = OTHER_SYMBOL, False
            elif sym == MORE:
                new = state != IN_SPACE
            to[sym, state], begins[sym, state] = go, new
        to[FRESH + sym] = to[sym, BEHIND]
    return to, begins


def states(symbols: np.ndarray) -> np.ndarray:
    """The state before every symbol, by an associative scan over the symbols' transition functions."""
    to, _ = automaton()
    n = len(symbols)
    if n <= SCAN:
        out = np.empty(n, np.uint8)
        state = BEHIND
        for i, sym in enumerate(symbols.tolist()):
            out[i] = state
            state = to[sym, state]
        return out
    blocks = -(-n // SCAN)
    grid = np.full(blocks * SCAN, FRESH, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, SCAN).T)
    flat = to.ravel()
    total = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
    for row in grid:  # the function of each block
        total = flat[(row[:, None].astype(np.intp) << 3) + total]
    reach = total.copy()
    k = 1
    while k < blocks:  # of all blocks up to each
        reach[k:] = np.take_along_axis(reach[k:], reach[:-k].astype(np.intp), 1)
        k *= 2
    state = np.append(np.uint8(BEHIND), reach[:-1, BEHIND])
    out = np.empty((SCAN, blocks), np.uint8)
    for j, row in enumerate(grid):
        out[j] = state
        state = flat[(row.astype(np.intp) << 3) + state]
    return out.T.reshape(-1)[:n]


def boundaries(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte positions in the UTF-8 buffer at which pieces begin; starts: first byte of each text that is not empty."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    cls = classes()[cp]
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, starts)] = True
    first[n] = True
    symbol = np.where(cls == OTHER, OTHER_SYMBOL, cls).astype(np.uint8)
    space = cls == SPACE
    last = space & ~first[1:]
    last[:-1] &= ~space[1:]
    symbol[space] = MORE
    symbol[last] = np.where(cp[last] == 0x20, BLANK, LAST)
    tick = np.flatnonzero(cp == 0x27)
    for c in CONTRACTIONS:
        own = tick[tick + len(c) < n]
        hit = np.ones(len(own), bool)
        for k, ch in enumerate(c, 1):
            hit &= (cp[own + k] == ord(ch)) & ~first[own + k]
        symbol[own[hit]] = ONE if len(c) == 1 else TWO
    symbol[first[:n]] += FRESH
    return at[automaton()[1][symbol, states(symbol)]]


class Encoder:
    """Pair merging by the ranks of a vocabulary, with a bounded cache of pieces."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.cache: dict[bytes, list[int]] = {}

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens one after another, and the begin and length of each by id."""
        if not hasattr(self, "_bytes"):
            order = sorted(self.ranks.items(), key=lambda x: x[1])
            length = np.zeros(order[-1][1] + 1, np.int64)
            length[[i for _, i in order]] = [len(t) for t, _ in order]
            self._bytes = np.frombuffer(b"".join(t for t, _ in order), np.uint8), np.cumsum(length) - length, length
        return self._bytes

    def merge_pairs(self, piece: bytes) -> list[int]:
        """The pair of lowest rank is merged, again and again, the first of equals first: candidate pairs wait in a heap,
        parts are a linked list, so a piece of n bytes takes n log n steps."""
        rank, n = self.ranks.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at i; -1: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:  # one of the two has been merged since
                continue
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece(self, b: bytes) -> list[int]:
        ids = self.cache.get(b)
        if ids is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            ids = self.ranks.get(b)
            ids = self.cache[b] = [ids] if ids is not None else self.merge_pairs(b)
        return ids

    def part(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts in data, and the number of ids of each; starts: byte of each text's begin, in order."""
        ends = np.append(starts[1:], len(data))
        counts = np.zeros(len(starts), np.int64)
        some = ends > starts
        if not some.any():
            return np.zeros(0, np.int32), counts
        buf = np.frombuffer(data, np.uint8)
        lo = boundaries(buf, starts[some])
        hi = np.append(lo[1:], len(buf))
        up, down = powers(PART * 2) if len(buf) < PART * 2 else powers.__wrapped__(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
        key = (total[hi] - total[lo]) * down[lo]
        code, _ = pd.factorize(key)
        kinds = int(code.max()) + 1
        rep = np.zeros(kinds, np.int64)
        rep[code[::-1]] = np.arange(len(code))[::-1]
        own, other = self._unlike(buf, lo, hi, rep[code])
        if len(own):  # equal hashes of unlike pieces
            code = code.copy()
            code[own] = np.arange(kinds, kinds + len(own))
            rep = np.append(rep, own)
        ids = [self.piece(data[a:b]) for a, b in zip(lo[rep].tolist(), hi[rep].tolist())]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        off = np.cumsum(size) - size
        per = size[code]
        done = np.cumsum(per)
        out = flat[np.repeat(off[code] - (done - per), per) + np.arange(int(done[-1]))]
        upto = np.append(0, done)
        first = np.searchsorted(lo, starts)
        last = np.searchsorted(lo, ends)
        counts = upto[last] - upto[first]
        return out, counts

    @staticmethod
    def _unlike(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces whose bytes aren't those of the piece that stands for them."""
        size = hi - lo
        bad = size != (hi - lo)[rep]
        shift = np.repeat(lo[rep] - lo, size)
        where = np.arange(len(buf)) + shift
        differ = buf != buf[np.minimum(where, len(buf) - 1)]
        if differ.any():
            bad |= np.add.reduceat(differ, lo) > 0
        own = np.flatnonzero(bad)
        return own, rep[own]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts of a column one after another, and the number of ids of each."""
        column = column.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = column.buffers()[2]
        raw = memoryview(data) if data is not None else memoryview(b"")
        ids, counts = [], np.zeros(len(column), np.int64)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(off, off[i] + PART, "right")) - 1)
            whole = bytes(raw[off[i] : off[j]])
            if j == i + 1 and len(whole) > PART:
                for piece in _cut(whole):
                    got, n = self.part(piece, np.zeros(1, np.int64))
                    ids.append(got)
                    counts[i] += n[0]
            else:
                got, n = self.part(whole, off[i:j] - off[i])
                ids.append(got)
                counts[i:j] = n
            i = j
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts


def _cut(text: bytes) -> Iterator[bytes]:
    """text in parts of about PART bytes, cut before a single blank between two ASCII letters or digits."""
    i = 0
    while len(text) - i > PART:
        j = i + PART
        while (j := text.find(b" ", j)) >= 0 and not (text[j - 1 : j].isalnum() and text[j + 1 : j + 2].isalnum()):
            j += 1
        if j < 0:
            break
        yield text[i:j]
        i = j
    yield text[i:]


_encoders: dict[int, Encoder] = {}


def _mapper(vocabulary, key: str, text: str, build: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = vocabulary.value
        if (mark := hash(data)) not in _encoders:
            _encoders.clear()
            _encoders[mark] = Encoder(data)
        for b in batches:
            ids, counts = _encoders[mark].texts(b.column(b.schema.get_field_index(text)))
            yield build(_encoders[mark], b, ids, counts)

    return run


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each text, without special tokens."""

    def build(_, b, ids, counts):
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([b.column(0), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(_mapper(_vocabulary(df, vocabulary), key, text, build), f"`{key}` {kind}, ids array<int>")


def encode_with_offsets(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids, ends): the ids of each text and the byte of its UTF-8 form at which each token ends."""

    def build(enc, b, ids, counts):
        stop = np.append(0, np.cumsum(enc.token_bytes()[2][ids]))
        last = np.cumsum(counts)
        ends = stop[1:] - np.repeat(stop[last - counts], counts)
        edges = pa.array(np.append(0, last).astype(np.int32))
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(ends, pa.int64()))], [key, "ids", "ends"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(_mapper(_vocabulary(df, vocabulary), key, text, build), f"`{key}` {kind}, ids array<int>, ends array<long>")


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without the text, with n_tokens."""
    keep = [c for c in df.columns if c != text]

    def build(_, b, ids, counts):
        return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long"])
    return df.select(*keep, text).mapInArrow(_mapper(_vocabulary(df, vocabulary), "", text, build), schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, n_bytes, restored): whether the tokens' bytes at their offsets give the text again."""

    def build(enc, b, ids, counts):
        data, start, length = enc.token_bytes()
        texts = b.column(1).cast(pa.large_string()).fill_null("")
        size = length[ids]
        stop = np.cumsum(size)  # offset of each token's end
        got = data[np.repeat(start[ids] - (stop - size), size) + np.arange(int(size.sum()))].tobytes()
        ends = np.append(0, stop)[np.cumsum(counts)]
        begins = np.append(0, ends[:-1])
        same = [got[i:j] == t.as_buffer().to_pybytes() for i, j, t in zip(begins.tolist(), ends.tolist(), texts)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(same)], [key, "n_tokens", "n_bytes", "restored"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(_mapper(_vocabulary(df, vocabulary), key, text, build), f"`{key}` {kind}, n_tokens long, n_bytes long, restored boolean")
