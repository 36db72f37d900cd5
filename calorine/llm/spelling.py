"""Spelling variants: words one edit apart, by merging subtrees of an errata trie.

Two words are near if one inserted, deleted or replaced code point parts them.  They then run together to a node of a trie and
have the same rest after the edit.  At each node of a heavy path the light subtrees (all but the largest) are merged: with
their first character replaced, into the heavy subtree and into one another, small to large; with it skipped, into the node
itself; and the heavy subtree with its first character skipped meets the light ones.  Terminals that coincide are near words.  Only light
subtrees are walked, so a word is met at a logarithm of nodes.

The words are too many for one trie, so they are dealt to rooms.  A room is responsible for pairs of lengths (m, m) and
(m, m + 1) that part at a place from ``low`` to ``high``: such words share their first ``low`` and last ``m - high`` characters, which
are the room's key.  A room beyond ``ROOM`` characters is halved by its range of places, until all fit; with one place left, at most two
characters of the key's words differ, so every room does fit.  Each pair parts at one place, so it is found in one room.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorine.llm.common import Steps, cleaning, only

RUN = re.compile("[a-zÀ-ÿ]+")
#: One spelling in so many of a document's loses a character.
ERRATA = 199
#: Least code points and occurrences of a word; how much commoner a form must be.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Characters of a room's words without what they share, and words that a task counts before it hands them on.
ROOM, COUNTED = 150_000, 300_000
KEY = ["m", "low", "high", "head", "tail"]


def spelled(text: str, doc_id: str) -> dict[str, int]:
    """The words of a text, as they are spelled in this document, with how often."""
    counts: dict[str, int] = {}
    for run in RUN.findall(text.encode().lower().decode()):  # of bytes, only A-Z are lower-cased
        if len(run) >= LEAST_LENGTH:
            counts[run] = counts.get(run, 0) + 1
    start, out = zlib.crc32(f"{doc_id}:".encode()), {}
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if h % ERRATA == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] = out.get(run, 0) + n
    return out


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all documents; counted in the tasks first."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in stream:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                for word, n in spelled(text, batch.column(0)[i].as_py() or "").items() if text else ():
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    def rows(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = only(docs, "doc_id", "text").select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(batches, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _room(words: DataFrame, m: Column, low: Column, high: Column) -> DataFrame:
    """Words (word, n, ...) in the room of lengths m and m + 1 and places from low to high: its key, the word without what it shares, n."""
    rest = F.greatest(m - high, F.lit(0))  # characters that the room's words share at their ends
    size = F.length("word")
    cut = lambda start, count: F.col("word").substr(start.cast("int"), count.cast("int"))
    return words.select(m.cast("int").alias("m"), low.cast("int").alias("low"), high.cast("int").alias("high"), cut(F.lit(1), low).alias("head"), cut(size - rest + 1, rest).alias("tail"), cut(low + 1, size - rest - low).alias("mid"), "n")


def _halves(words: DataFrame, m: Column, low: Column, high: Column) -> DataFrame:
    middle = F.floor((low + high) / 2).cast("int")
    return _room(words, m, low, middle).unionByName(_room(words, m, middle, high))


def rooms(words: DataFrame, steps: Steps, room: int = ROOM) -> DataFrame:
    """The words in rooms of at most ``room`` characters, unless a room has but one place left."""
    size = F.length("word")
    dealt = words.withColumn("m", F.explode(F.array(size, size - 1))).where(F.col("m") >= F.least(size, F.lit(LEAST_LENGTH)))
    m = F.col("m")
    made = steps.write(_halves(dealt, m, F.lit(0), m + 1))
    fit = None
    while True:
        big = made.groupBy(KEY).agg(F.sum(F.length("mid") + 1).alias("chars")).where(F.col("chars") > room).where("high - low > 1").select(KEY)
        big = steps.write(big)
        with cleaning(words.sparkSession):
            done = big.isEmpty()
        if done:
            steps.drop(big)
            return made if fit is None else fit.unionByName(made)
        good = made.join(big, KEY, "left_anti")
        fit = steps.write(good if fit is None else fit.unionByName(good))
        again = made.join(big, KEY).withColumn("word", F.concat("head", "mid", "tail"))
        made = steps.write(_halves(again, F.col("m"), F.col("low"), F.col("high")))


class Node:
    """Of a trie: children by character, the words that end here, and how many words are below."""

    __slots__ = ("kids", "ends", "size")

    def __init__(self):
        self.kids: dict[str, Node] = {}
        self.ends: tuple[int, ...] = ()
        self.size = 0


def trie(words: list[str]) -> Node:
    root = Node()
    for i, word in enumerate(words):
        at = root
        at.size += 1
        for c in word:
            kid = at.kids.get(c)
            if kid is None:
                kid = at.kids[c] = Node()
            at = kid
            at.size += 1
        at.ends = (i,)
    return root


def coincide(a: Node, b: Node, but: str = "") -> Iterator[tuple[int, int]]:
    """Pairs of words with the same rest below two nodes; ``but``: a character not to be followed from them."""
    stack = [(a, b, but)]
    while stack:
        a, b, but = stack.pop()
        for i in a.ends:
            for j in b.ends:
                yield i, j
        few, many = (a.kids, b.kids) if len(a.kids) <= len(b.kids) else (b.kids, a.kids)
        for c in few:
            if c in many and c != but:
                stack.append((a.kids[c], b.kids[c], ""))


def merged(into: Node | None, a: Node) -> Node:
    """An errata subtree with the words of another; the smaller goes into the larger, and ``a`` itself stays as it is."""
    copy = Node()
    stack = [(copy, a)]
    while stack:
        new, old = stack.pop()
        new.ends, new.size = old.ends, old.size
        for c, kid in old.kids.items():
            new.kids[c] = Node()
            stack.append((new.kids[c], kid))
    if into is None:
        return copy
    large, small = (into, copy) if into.size >= copy.size else (copy, into)
    todo = [(large, small)]
    while todo:
        x, y = todo.pop()
        x.ends, x.size = x.ends + y.ends, x.size + y.size
        for c, kid in y.kids.items():
            if c in x.kids:
                todo.append((x.kids[c], kid))
            else:
                x.kids[c] = kid
    return large


def near_pairs(words: list[str], length: int, places: int) -> Iterator[tuple[int, int]]:
    """Pairs of distinct words of ``length`` or one more, the first not longer, that are one edit apart and part before ``places``."""
    stack = [(trie(words), 0)]
    while stack:
        x, depth = stack.pop()
        if depth >= places or x.size < 2:
            continue
        heavy = max(x.kids, key=lambda c: (x.kids[c].size, c))
        light = sorted((c for c in x.kids if c != heavy), key=lambda c: (x.kids[c].size, c))
        top, errata = x.kids[heavy], None
        for c in light:
            kid = x.kids[c]
            for other in (top, errata):  # c replaced
                if other is not None:
                    yield from ((i, j) for i, j in coincide(kid, other) if len(words[i]) == length)
            if c != light[-1]:
                errata = merged(errata, kid)
            yield from ((j, i) for i, j in coincide(kid, x, c))  # c skipped
            if c in top.kids:  # the heavy character skipped
                yield from ((j, i) for i, j in coincide(top.kids[c], kid))
        yield from ((j, i) for i in top.ends for j in x.ends)
        stack.extend((kid, depth + 1) for kid in x.kids.values())


def _near(dealt: DataFrame) -> DataFrame:
    """(word, near, best_n, best): of each room and word the near words found there, and the commonest of them."""

    def of(key: tuple, mids: list[str], ns: list[int], out: list[tuple]) -> None:
        m, low, high, head, tail = key
        found: dict[int, list] = {}
        for pair in near_pairs(mids, m - low - max(m - high, 0), high - low):
            for i, j in (pair, pair[::-1]):
                own = found.setdefault(i, [0, 0, ""])
                own[0] += 1
                if own[1] < ns[j] or own[1] == ns[j] and mids[j] < own[2]:
                    own[1:] = ns[j], mids[j]
        out += [(head + mids[i] + tail, near, n, head + best + tail) for i, (near, n, best) in found.items()]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mids, ns, out = None, [], [], []
        for batch in stream:
            for *row, mid, n in zip(*(c.to_pylist() for c in batch.columns)):
                if row != key:
                    if len(mids) > 1:
                        of(tuple(key), mids, ns, out)
                    key, mids, ns = row, [], []
                mids.append(mid)
                ns.append(n)
            if len(out) > 10_000:
                yield rows(out)
                out = []
        if len(mids) > 1:
            of(tuple(key), mids, ns, out)
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["word", "near", "best_n", "best"])

    ordered = dealt.select(*KEY, "mid", "n").repartition(*KEY).sortWithinPartitions(*KEY)
    return ordered.mapInArrow(batches, "word string, near bigint, best_n bigint, best string")


def _roots(forms: DataFrame, steps: Steps) -> DataFrame:
    """(word, root): forms (word, root) followed to the last; each turn doubles the way, and a form is ``TIMES`` as common as its word."""
    while True:
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.write(forms.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        steps.drop(forms)
        with cleaning(longer.sparkSession):
            done = longer.where("went").isEmpty()
        forms = longer.drop("went")
        if done:
            return forms


def variants(docs: DataFrame, least: int = LEAST_COUNT, times: int = TIMES, room: int = ROOM) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    Words are the runs of a-z, A-Z (lower-cased) and U+00C0 to U+00FF in whole texts, as ``spelled``, of at least LEAST_LENGTH code
    points and ``least`` occurrences.  The form is the near word of the largest n (of ties the first in code-point order), if that
    is at least ``times`` the word's n; the root is where forms lead.  Null and empty texts have no words; a null doc_id spells as an
    empty one; repeated rows each count; very long runs are words like others; an empty table gives no rows; further columns are dropped.
    """
    steps = Steps(docs.sparkSession, "spelling")
    words = steps.write(word_counts(docs, least))
    dealt = rooms(words, steps, room)
    best = F.min(F.struct(F.negative("best_n").alias("rank"), F.col("best").alias("word"))).alias("b")
    near = steps.write(_near(dealt).groupBy("word").agg(F.sum("near").alias("n_near"), best))
    steps.drop(*[f for f, _ in steps.written if f is not words and f is not near])
    held = F.negative("b.rank") >= F.col("n") * times
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(held, F.col("b.word")).alias("form"), F.when(held, F.negative("b.rank")).alias("form_n"))
    joined = steps.write(joined)
    steps.drop(words, near)
    forms = steps.write(joined.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    found = steps.write(joined.join(_roots(forms, steps), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    steps.drop(*[f for f, _ in steps.written if f is not found])
    return found
