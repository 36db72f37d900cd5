"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A document's words are hashed and every run of five is a shingle.  For each benchmark item size, windows of that many
words get a 64-bit SimHash, each shingle voting with its multiplicity; the votes are differences of running sums.  The
items of each size are indexed by blocks of their fingerprints' bits: two fingerprints within ``RADIUS`` bits are within
``RADIUS // BLOCKS`` bits in one of the blocks at least (else they would differ in more), so looking up each block's
value and all its neighbours finds all of them; of unlike fingerprints it lets one in twenty-five through.  The multiset
Jaccard similarity of window and item then decides.

A fingerprint can be farther off than the radius at a similarity of 0.8 to 0.9 (one pair in two hundred).  Such items are not lost: a window
that shares enough with an item shares some of its rarest shingles, so the items that hold those are verified too.

Windows are only fingerprinted where they can matter: a similarity of s asks for 2s/(1+s) of a window's shingles to be
shingles of some item of the window's size, and a running count tells which windows have so many.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorine.llm.common import numbered

WORDS, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 the distance of 64-bit fingerprints averages 9.7 with a deviation of 2.9.  The blocks have 16 bits each.
RADIUS, BLOCKS = 15, 4
#: Up to so many items of a size are compared one by one, which finds the same as their index.
SCAN = 512
#: Words of the items that one broadcast holds; a larger benchmark goes through the documents block by block.
WORDS_A_BLOCK = 4_000_000
#: Windows that are looked up together.
LOOKUP = 256
WORD = re.compile(r"\w+")
PRIME = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = out * PRIME + words[i : n + i]
    return mix(out)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at ``starts``: row by row BLOCKS numbers of 16 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=votes[1:])
    return np.packbits(2 * (votes[starts + size] - votes[starts]) > size, axis=1).view(np.uint16)


def similarity(a: Counter, b: Counter) -> float:
    """Multiset Jaccard."""
    common = sum((a & b).values())
    return common / max(sum(a.values()) + sum(b.values()) - common, 1)


def neighbours(bits: int = 16, reach: int = RADIUS // BLOCKS) -> np.ndarray:
    """All differences of at most ``reach`` bits."""
    every = np.arange(1 << bits, dtype=np.uint16)
    return every[np.bitwise_count(every) <= reach]


class Blocks:
    """Fingerprints by the values of their blocks: for each block the items in the order of its values."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.order, self.first, self.near = [], [], None
        if len(prints) > SCAN:
            self.order = [np.argsort(prints[:, b], kind="stable").astype(np.int32) for b in range(BLOCKS)]
            self.first = [np.concatenate([[0], np.cumsum(np.bincount(prints[:, b], minlength=1 << 16))]).astype(np.int32) for b in range(BLOCKS)]
            self.near = neighbours()

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all pairs with a block in reach, once for each such block."""
        if self.near is None:
            return np.divmod(np.arange(len(queries) * len(self.prints)), len(self.prints))
        rows, items = [], []
        for b in range(BLOCKS):
            values = (queries[:, b, None] ^ self.near[None, :]).ravel()
            start = self.first[b][values]
            count = self.first[b][1:][values] - start
            there = np.flatnonzero(count)
            start, count = start[there], count[there]
            rows.append(np.repeat(there // len(self.near), count))
            items.append(self.order[b][np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())])
        return np.concatenate(rows), np.concatenate(items)

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose fingerprints are within RADIUS bits: all there are, each once, in order."""
        q, i = self.candidates(queries)
        whole = [np.ascontiguousarray(x).view(np.uint64).ravel() for x in (queries, self.prints)]
        close = np.bitwise_count(whole[0][q] ^ whole[1][i]) <= RADIUS
        return np.divmod(np.unique(q[close].astype(np.int64) * len(self.prints) + i[close]), len(self.prints))


class Sized:
    """Items of one number of shingles, by their places among all: fingerprints in Blocks, and the items of each shingle."""

    def __init__(self, size: int, places: np.ndarray, made: list[np.ndarray]):
        self.size, self.places = size, places
        self.counters = [Counter(s.tolist()) for s in made]
        self.blocks = Blocks(np.array([fingerprints(s, np.zeros(1, np.int64), size)[0] for s in made]))
        pairs = np.unique(np.stack([np.concatenate(made), np.repeat(np.arange(len(made)), size).astype(np.uint64)], 1), axis=0)
        self.known, first = np.unique(pairs[:, 0], return_index=True)
        self.first, self.items = np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)

    def sharing(self, window: np.ndarray, need: float) -> set[int]:
        """All items that can share ``need`` of a window's shingles: those that hold one of its rarest, as many as it may lack and one more."""
        at = np.minimum(np.searchsorted(self.known, window), len(self.known) - 1)
        many = np.where(self.known[at] == window, self.first[at + 1] - self.first[at], 0)
        rarest = np.argsort(many, kind="stable")[: int(len(window) - need + 1e-9) + 1]
        return {int(i) for p in rarest[many[rarest] > 0] for i in self.items[self.first[at[p]] : self.first[at[p] + 1]]}


class Items:
    """Items of one shingle length: their shingles, the sizes of the items that hold each, and the items by size."""

    def __init__(self, k: int, items: list[tuple[int, np.ndarray]]):
        self.k = k
        made = [shingles(w, k) for _, w in items]
        self.ids = [i for i, _ in items]
        size_of = np.array([len(s) for s in made])
        pairs = np.unique(np.stack([np.concatenate(made), np.repeat(size_of, size_of).astype(np.uint64)], 1), axis=0)
        self.known, first = np.unique(pairs[:, 0], return_index=True)
        self.first, self.sizes = np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - FILTER_BITS)] = True
        self.by_size = {int(n): Sized(int(n), own, [made[i] for i in own]) for n in np.unique(size_of) for own in [np.flatnonzero(size_of == n)]}


class Index:
    """The items, by shingle length: five words, or all of an item that has fewer."""

    def __init__(self, items: list[tuple[int, str]]):
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, t in items:
            w = word_hashes(t or "")
            if len(w):
                by.setdefault(min(WORDS, len(w)), []).append((i, w))
        self.groups = [Items(k, found) for k, found in sorted(by.items())]

    def hits(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity): the most similar window of each item found in a document, of equal ones the first."""
        best: dict[int, tuple[float, int, int]] = {}
        for group in self.groups:
            s = shingles(words, group.k)
            at = np.flatnonzero(group.filter[s >> np.uint64(64 - FILTER_BITS)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(group.known, s[at]), len(group.known) - 1)
            own = group.known[place] == s[at]
            at, place = at[own], place[own]
            if not len(at):
                continue
            # Positions by the size of the items that hold their shingle.
            many = group.first[place + 1] - group.first[place]
            sizes = group.sizes[np.repeat(group.first[place] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
            order = np.argsort(sizes, kind="stable")
            at, sizes = np.repeat(at, many)[order], sizes[order]
            for positions in np.split(at, np.flatnonzero(np.diff(sizes)) + 1):
                size = int(sizes[0])
                sizes = sizes[len(positions) :]
                width = min(size, len(s))  # a document shorter than the item is one window
                need = 2 * SIMILARITY / (1 + SIMILARITY) * size if width == size else SIMILARITY * size
                if len(positions) < need - 1e-9:
                    continue
                count = np.zeros(len(s) + 1, np.int64)
                count[positions + 1] = 1
                np.cumsum(count, out=count)
                starts = np.flatnonzero(count[width:] - count[:-width] >= need - 1e-9)
                for a in range(0, len(starts), LOOKUP):
                    self._verify(s, starts[a : a + LOOKUP], width, need, group, group.by_size[size], best)
        return [(i, a, n, round(sim, 6)) for i, (sim, a, n) in sorted(best.items())]

    @staticmethod
    def _verify(s: np.ndarray, starts: np.ndarray, width: int, need: float, group: Items, own: Sized, best: dict) -> None:
        low = int(starts[0])
        prints = fingerprints(s[low : int(starts[-1]) + width], starts - low, width)
        rows, items = own.blocks.within(prints)
        near: list[set[int]] = [set() for _ in starts]
        for r, i in zip(rows.tolist(), items.tolist()):
            near[r].add(i)
        for r, start in enumerate(starts.tolist()):
            window = s[start : start + width]
            counted = None
            for i in sorted(near[r] | own.sharing(window, need)):
                item = group.ids[own.places[i]]
                if item in best and best[item][0] == 1.0:
                    continue
                counted = Counter(window.tolist()) if counted is None else counted
                sim = similarity(counted, own.counters[i])
                if sim >= SIMILARITY and (item not in best or sim > best[item][0]):
                    best[item] = (sim, start, width + group.k - 1)


def _indexes(items: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of WORDS_A_BLOCK words on average; a block is what the driver and a broadcast hold."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    words = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a word has two bytes at least
    blocks = max(1, -(-words // (2 * WORDS_A_BLOCK)))
    for b in range(blocks):
        yield Index([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id").collect()])


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) of every document and item it holds a window like.

    Clean documents give no row, nor do null or empty texts and items; repeated rows each give theirs; of equally
    similar windows the first counts; very long texts are read whole; further columns are dropped.
    """
    kind, out = dict(docs.dtypes)[id_col], None
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def batches(stream: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in stream:
                rows, keep = [], []
                for i in range(batch.num_rows):
                    for hit in index.hits(word_hashes(batch.column(1)[i].as_py() or "")):
                        keep.append(i)
                        rows.append(hit)
                columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *columns], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        found = wanted.mapInArrow(batches, f"doc_id {kind}, item_id bigint, first_word bigint, n_words bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that hold no item.

    Null and empty texts hold none and stay; repeated rows each stay or go; very long texts are read whole; items
    without a text or an id rule nothing out; empty tables give and rule out nothing.
    """
    names = docs.columns
    for index in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def batches(stream: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in stream:
                texts = batch.column(names.index("text"))
                yield batch.filter(pa.array([not index.hits(word_hashes(texts[i].as_py() or "")) for i in range(batch.num_rows)], pa.bool_()))

        docs = numbered(docs).mapInArrow(batches, docs.schema)
    return docs
