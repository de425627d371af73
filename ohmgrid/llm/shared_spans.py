"""Long exact spans shared between texts, by recompression.

Rounds name runs and pairs of symbols: an equal pair gets the same name in every text and every task, because a name is
mixed from the names of its parts, so no dictionary has to travel. In each round a symbol is marked left or right by its
name, and a left one merges with a right one behind it; short runs of one symbol merge first. Symbols longer than the
round's bound wait. Whether a boundary stays depends on a bounded stretch around it only, so inside a span that two texts
share all boundaries further than CONTEXT from its ends are the same in both.

Every stretch of LENGTH characters has one key: of the boundaries at least CONTEXT from its ends, which are the same in
every text that holds the stretch, the one whose neighbouring symbols have the smallest name; the key is the KEY
characters around it. One boundary is the key of a short range of stretches, so a text has about one key for each three
dozen characters. A Spark round groups the keys of all texts by their names; only stretches whose own key stands in two
unlike texts are hashed, to 128 bits, and equal ones are the shared spans. Exact copies are one class from the start (by
length and a 128-bit digest), represented by its lowest doc_id.

Links are taken from the sets of documents that hold one stretch; sets and classes of more than PAIRS_UPTO members are
written as pairs with their first member only, and members() and classes() give every member of each set and class.

Defined results: null texts and those shorter than LENGTH share nothing; positions count code points of the text as
stored; rows without doc_id are left out; a doc_id that occurs again counts as one document; exact copies share their
whole text; very long texts are processed whole; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmgrid.llm.tokenizer import powers
from ohmgrid.session import BROADCAST_BYTES, join_dimension, materialize

LENGTH = 200
#: Longest symbol that may still merge, by round.
ROUNDS = (1, 2, 3, 4)
#: A run round looks three bounds far, a pair round one, the names beside a boundary two of the last.
CONTEXT = sum(4 * b for b in ROUNDS) + 2 * ROUNDS[-1]
WINDOW = LENGTH - 2 * CONTEXT
KEY = LENGTH - WINDOW
#: Code points looked at together.
PART = 1 << 20
#: Sets and groups of copies of up to this many documents are written as all their pairs (half a million at most).
PAIRS_UPTO = 1000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(13)
    return x


def boundaries(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the last round's symbols, and their names; first: whether a text begins at a code point."""
    n = len(cp)
    name, at = _mix(cp + np.uint32(0x9E3779B9)), np.arange(n, dtype=np.int64)
    head = first[:n].copy()
    for r, bound in enumerate(ROUNDS):
        end = np.append(at[1:], n)
        short = (end - at) <= bound
        # runs of one symbol, of 2 * bound characters at most
        same = np.zeros(len(at), bool)
        same[1:] = (name[1:] == name[:-1]) & short[1:] & ~head[1:]
        if same.any():
            begin = np.flatnonzero(~same)
            count = np.diff(np.append(begin, len(at)))
            many = count > 1
            b, k = begin[many], count[many]
            fits = end[b + k - 1] - at[b] <= 2 * bound
            b, k = b[fits], k[fits]
            name[b] = _mix(name[b] * np.uint32(0x27D4EB2F) + k.astype(np.uint32))
            keep = ~same
            loose = begin[many][~fits]
            if len(loose):
                size = count[many][~fits]
                keep[np.repeat(loose, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = True
            name, at, head = name[keep], at[keep], head[keep]
            end = np.append(at[1:], n)
            short = (end - at) <= bound
        # pairs of a left and a right symbol
        left = (name * np.uint32(0x9E3779B1 + 2 * r)) >> np.uint32(31) != 0
        pair = np.flatnonzero(left[:-1] & ~left[1:] & short[:-1] & short[1:] & ~head[1:])
        name[pair] = _mix(name[pair] * np.uint32(0x165667B1) + (name[pair + 1] ^ np.uint32(0x2545F491)))
        keep = np.ones(len(at), bool)
        keep[pair + 1] = False
        name, at, head = name[keep], at[keep], head[keep]
    return at, name


def _nearest_smaller(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest smaller one on the left (equal counts) and right, within the text and WINDOW."""
    out = []
    for way, edge in ((-1, low), (1, high)):
        found = edge.copy()
        live = np.arange(len(h))
        k = 0
        while len(live):
            k += 1
            j = live + way * k
            inside = (j >= 0) & (j < len(h))
            j, live = j[inside], live[inside]
            near = (np.abs(at[j] - at[live]) <= WINDOW) & ((at[j] - edge[live]) * way < 0)
            j, live = j[near], live[near]
            less = (h[j] <= h[live]) if way == -1 else (h[j] < h[live])
            found[live[less]] = at[j[less]]
            live = live[~less]
        out.append(found)
    return out[0], out[1]


def anchors(cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries that are the key of a stretch, the numbers of their texts, and the first and last begin of the
    stretches whose key they are."""
    first = np.zeros(len(cp) + 1, bool)
    first[starts] = True
    at, name = boundaries(cp, first)
    text = np.searchsorted(starts, at, "right") - 1
    inner = ~first[at]
    h = np.zeros(len(at), np.uint32)
    h[1:] = _mix(name[:-1] * np.uint32(0x9E3779B1) + name[1:])
    at, text, h = at[inner], text[inner], h[inner]
    if not len(at):
        return at, text, at, at
    left, right = _nearest_smaller(h, at, starts[text] - 1, (starts + sizes)[text])
    low = np.maximum(np.maximum(left + 1, at - WINDOW), starts[text] + CONTEXT)
    high = np.minimum(np.minimum(right - 1, (starts + sizes)[text] - CONTEXT) - WINDOW, at)
    keep = low <= high
    return at[keep], text[keep], low[keep] - CONTEXT, high[keep] - CONTEXT


def _hashes(cp: np.ndarray, begin: np.ndarray, size: int, salt: int) -> np.ndarray:
    """64-bit hashes of cp[begin : begin + size]."""
    up, down = powers(2 * PART) if len(cp) < 2 * PART else powers.__wrapped__(len(cp) + 1)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_spread(cp, salt) * up[: len(cp)], out=total[1:])
    h = (total[begin + size] - total[begin]) * down[begin]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _spread(cp: np.ndarray, salt: int) -> np.ndarray:
    x = (cp.astype(np.uint64) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts from..to of a column with their code points, begins and sizes, about PART code points at a time."""
    texts = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = memoryview(texts.buffers()[2]) if texts.buffers()[2] is not None else memoryview(b"")
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + PART, "right")) - 1)
        data = bytes(raw[off[i] : off[j]])
        buf = np.frombuffer(data, np.uint8)
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        upto = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
        edge = upto[off[i : j + 1] - off[i]]
        yield i, j, cp, edge[:-1], np.diff(edge)
        i = j


def _reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, key, place): every key with its begin and, in the lower 16 bits, how far before it the
    first and the last stretch begin whose key it is."""
    for b in batches:
        doc = b.column(0)
        for i, _, cp, starts, sizes in _parts(b.column(1)):
            some = np.flatnonzero(sizes > 0)
            if not len(some):
                continue
            at, text, low, high = anchors(cp, starts[some], sizes[some])
            begin = at - CONTEXT
            place = (begin - starts[some][text] << 16) + (begin - low << 8) + (begin - high)
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(i + some[text])), pa.array(_hashes(cp, begin, KEY, 1)), pa.array(place)], ["doc_id", "key", "place"])


def _stretches(batches: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, at) to (doc_id, place, h1, h2): each stretch of LENGTH characters whose key is one of those at the
    places at, once for equal stretches of a text. every: again wherever an equal one begins more than LENGTH behind
    the one before. place: its first begin, and in the upper half how far behind it the last such begin lies; whatever
    lies between is covered, so runs and periods are one row for each of their phases."""
    for b in batches:
        doc, lists = b.column(0), b.column(2)
        for i, j, cp, starts, sizes in _parts(b.column(1)):
            own = lists.slice(i, j - i)
            p = own.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(j - i), own.value_lengths().to_numpy(zero_copy_only=False))
            low, high = (p >> 16) - (p >> 8 & 255) + starts[of], (p >> 16) - (p & 255) + starts[of]
            n = high - low + 1
            s = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            text = np.repeat(of, n) + i
            if not len(s):
                continue
            h1, h2 = _hashes(cp, s, LENGTH, 2), _hashes(cp, s, LENGTH, 3)
            order = np.lexsort((s, h2, h1, text))
            again = np.zeros(len(s), bool)
            a, c = order[1:], order[:-1]
            again[a] = (text[a] == text[c]) & (h1[a] == h1[c]) & (h2[a] == h2[c])
            if every:
                again[a] &= s[a] - s[c] <= LENGTH
            head = np.flatnonzero(~again[order])
            last = np.empty(len(s), np.int64)
            last[order[head]] = s[order[np.append(head[1:], len(s)) - 1]]
            keep = np.flatnonzero(~again)
            place = (s - starts[text - i] + (last - s << 32))[keep]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(text[keep])), pa.array(place), pa.array(h1[keep]), pa.array(h2[keep])], ["doc_id", "place", "h1", "h2"])


def _all_or_star(member: DataFrame, by: str) -> DataFrame:
    """(a, b) of the members (by, doc_id, first, n) of each group: all pairs up to PAIRS_UPTO, else those with the first."""
    small = member.filter(f"n <= {PAIRS_UPTO}")
    every = small.select(by, F.col("doc_id").alias("a")).join(small.select(by, F.col("doc_id").alias("b")), by).filter("a < b").select("a", "b")
    return every.unionByName(member.filter(f"n > {PAIRS_UPTO} AND doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")))


class SharedSpans:
    """The stages over one table (doc_id, text); each stage is written once into the shared folder."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(f"doc_id IS NOT NULL AND length(text) >= {LENGTH}")
        digests = self.docs.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest")).distinct()
        first = digests.groupBy("chars", "digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
        #: every document of a class of more than one with the class's first one
        self.copies = materialize(digests.join(first, ["chars", "digest"]).select("doc_id", "digest", "first", "n"), "copies")
        again = self.copies.filter("doc_id <> first").select("doc_id", "digest")
        self.own = join_dimension(self.docs.withColumn("digest", F.md5("text")), again, ["doc_id", "digest"], row_bytes=96, how="left_anti").select("doc_id", "text")

    def hits(self) -> DataFrame:
        """(doc_id, at): the places of those keys of each class's first document that stand in another one as well."""
        keys = materialize(self.own.mapInArrow(_reveal, "doc_id long, key long, place long"), "keys")
        shared = materialize(keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("key"), "shared")
        return materialize(join_dimension(keys, shared, "key").groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias("at")), "hits")

    def stretches(self, every: bool = False) -> DataFrame:
        """(doc_id, place, h1, h2) of the first documents of the classes with a shared key; see _stretches()."""
        hits = self.hits()
        size = hits.agg(F.sum(F.size("at") * 8 + 64)).first()[0] or 0
        texts = self.own.join(F.broadcast(hits) if size <= BROADCAST_BYTES else hits, "doc_id")
        return texts.select("doc_id", "text", "at").mapInArrow(partial(_stretches, every=every), "doc_id long, place long, h1 long, h2 long")

    def members(self) -> DataFrame:
        """(set_id, doc_id, first, n): the first documents of all classes that hold one stretch, once for equal sets."""
        w = self.stretches()
        groups = w.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("set"))
        sets = materialize(groups.filter("a <> b").groupBy("a", "b", "n", "set").agg(F.min(F.struct("h1", "h2")).alias("h")), "sets")
        two = sets.filter("n = 2").select(F.xxhash64("a", "b").alias("set_id"), F.explode(F.array("a", "b")).alias("doc_id"), F.col("a").alias("first"), "n")
        more = sets.filter("n > 2").select("h.h1", "h.h2", F.col("a").alias("first"), "n")
        if more.isEmpty():
            return two
        held = join_dimension(w.select("h1", "h2", "doc_id"), more, ["h1", "h2"]).select(F.xxhash64("h1", "h2").alias("set_id"), "doc_id", "first", "n").distinct()
        return two.unionByName(held)

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b): two documents that share a span."""
        links = _all_or_star(materialize(self.members(), "members"), "set_id").distinct()
        copies = self.copies.select("first", "doc_id", "n")
        for side in ("a", "b"):
            own = copies.filter(f"n <= {PAIRS_UPTO}").select(F.col("first").alias(side), F.col("doc_id").alias("copy"))
            links = links.join(own, side, "left").withColumn(side, F.coalesce("copy", side)).drop("copy")
        every = links.select("a", "b").unionByName(_all_or_star(copies.withColumn("class", F.col("first")), "class"))
        return every.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).filter("doc_id_a <> doc_id_b").distinct()

    def classes(self) -> DataFrame:
        """(doc_id, class_id, copies): every document with the lowest doc_id of its exact copies and their number."""
        own = self.docs.select("doc_id", F.md5("text").alias("digest")).distinct()
        out = own.join(self.copies, ["doc_id", "digest"], "left")
        return out.select("doc_id", F.coalesce("first", "doc_id").alias("class_id"), F.coalesce("n", F.lit(1)).alias("copies"))

    def spans(self) -> DataFrame:
        """(doc_id, start, length): the longest stretches of each text all of whose parts other documents have too."""
        w = self.stretches(every=True).withColumn("h2", F.shiftright("h2", 32).cast("int"))  # 96 bits tell stretches apart here
        shared = w.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("h1", "h2")
        hit = w.join(shared, ["h1", "h2"], "left_semi").select("doc_id", "place")
        hit = hit.groupBy("doc_id").agg(F.collect_list("place").alias("places")).select("doc_id", F.explode("places").alias("place"))  # one row a text and task is moved
        start = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        hit = hit.select("doc_id", start.alias("start"), (start + F.shiftright("place", 32).cast("int")).alias("last"))
        at = Window.partitionBy("doc_id").orderBy("start")
        before = F.max("last").over(at.rowsBetween(Window.unboundedPreceding, -1))
        begin = F.when(F.col("start") - before <= LENGTH, 0).otherwise(1)
        island = hit.withColumn("begin", begin).withColumn("island", F.sum("begin").over(at))
        found = island.groupBy("doc_id", "island").agg(F.min("start").alias("start"), (F.max("last") + LENGTH - F.min("start")).alias("length")).drop("island")
        own = found.join(self.copies.select("doc_id"), "doc_id", "left_anti")
        whole = self.docs.join(self.copies.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(0).alias("start"), F.length("text").alias("length")).distinct()
        return own.unionByName(whole)

    def portions(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars, portion) of every document of at least LENGTH characters."""
        by = self.spans().groupBy("doc_id").agg(F.sum("length").alias("shared_chars"))
        n = self.docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
        out = n.join(by, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
        return out.withColumn("portion", F.col("shared_chars") / F.col("n_chars"))
