"""Exact Jaccard self-join on word shingles, by prefix filters under several global token orders.

If two sets have a Jaccard similarity of t, they share ``o >= t*n`` tokens of either, so under *any* order of all tokens
the first l of those are within the first ``n - o + l`` tokens of each.  So the prefixes of ``n - ceil(t*n) + l(n)`` tokens
have l in common, where l is the smaller of both sets' ``l(n)``, or o if that is less.  Documents meet in the buckets of
their prefix tokens under the first order; a pair goes on only if its prefixes under every further order have that many
in common too, and only then are the whole sets compared.

Tokens are 64-bit hashes.  All orders put tokens that many documents share last and the rest first, each order by a
hash of its own, so that common passages seldom make buckets.  How common a token is comes from a sketch of counters
over all documents.  An order only steers the work: whatever tokens it holds to be common, the result is the same.

A token among a set's first ``l(n) - 1`` that meets no other prefix is in no similar set.  A set with more such lone
tokens than it may miss in a partner of given size can't be similar to it; so heavily edited copies drop out unread.

Groups of copies are not spelled out in pairs, and a text travels once for a room, not once for a pair.  Equal sets are
one node.  The members of a bucket form the group of its pivot, the member with the fewest lone tokens, so that the
buckets of one passage make one group.  A group is dealt to rooms of bounded size.  First each room, with the pivot,
finds the links among its own members: the filters and the comparison are matrix products over the room's tokens.  What
that links is one component.  Groups of several rooms have a second round: members outside the pivot's component meet
all others, room by room, so that no link between components is lost, while the pivot's own component, a hot group's
bulk, never meets itself again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorine.llm.common import Steps, cleaning, cut, numbered, partitions
from calorine.llm.components import connected_components

#: Seeds of the token orders.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: The sketch has a counter for each 1/16 of a document, in bounds; COUNTERS of them travel in one piece.  At its upper bound
#: it still tells tokens apart that are more frequent than thrice the square root of the tokens for each counter.
LEAST_BITS, MOST_BITS, COUNTERS = 16, 24, 1 << 16
#: Tokens that are counted together.
COUNT_CHUNK = 1_000_000
#: Buckets go by the upper 40 bits of a token, which shuffle in fewer bytes; a chance meeting is seen through later.
BUCKET_SHIFT = 24
#: Members and tokens of a room, about.
ROOM, ROOM_TOKENS = 512, 1 << 20
#: Bits for each id of the filter that keeps texts without a candidate from being shuffled, and the most that it has.
MARKS, MOST_MARKS = 16, 1 << 26
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of fewer words, of the whole sequence; empty without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone are lowered, and only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = hashes[: len(hashes) - k + 1].copy()
    for i in range(1, k):
        out = out * PRIME + hashes[i : len(hashes) - k + 1 + i]
    return np.unique(mix(out + np.uint64(k)))


def least_common(n, percent: int):
    """l(n): the share of a set that a partner of its size may lack, and a little more."""
    return n * (100 - percent) // (100 + percent) + 3


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + least_common(n, percent))


class Orders:
    """The global orders: hash orders with the common tokens moved to the end.

    counts: a power of two of counters, each of the tokens with certain upper bits.  weights: 0, or more the commoner.
    """

    def __init__(self, counts: np.ndarray):
        usual = float(np.median(counts)) if len(counts) else 0.0
        bound = usual + 3 * usual**0.5 + 2
        self.shift = np.uint64(65 - len(counts).bit_length())
        self.weights = np.where(counts > bound, 1 + 1000 * np.log2(np.maximum(counts, 1) / bound), 0).clip(0, 65_535).astype(np.uint16)

    def prefix(self, tokens: np.ndarray, size: int, o: int) -> np.ndarray:
        """The first ``size`` tokens of a set under order ``o``, in that order."""
        weight = self.weights[tokens >> self.shift]
        key = mix(tokens ^ np.uint64(ORDERS[o]))
        plain = np.flatnonzero(weight == 0)
        if len(plain) >= size:
            chosen = plain if len(plain) == size else plain[np.argpartition(key[plain], size - 1)[:size]] if size else plain[:0]
            return tokens[chosen[np.argsort(key[chosen])]]
        return tokens[np.lexsort((key, weight))[:size]]


def _signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def power(n: int, least: int, most: int) -> int:
    """The least power of two from ``n`` on, in bounds."""
    return min(max(1 << max(n - 1, 0).bit_length(), least), most)


def _measure(docs: DataFrame, k: int, counters: int) -> DataFrame:
    """One row a document (doc_id, n, signature), and each task's sketch in pieces (piece, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())])
    shift = np.uint64(65 - counters.bit_length())

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = np.zeros(counters, np.uint32), [], 0

        def counted() -> None:
            nonlocal held, size
            if held:
                at, n = np.unique((np.concatenate(held) >> shift).astype(np.uint32), return_counts=True)
                sketch[at] += n.astype(np.uint32)
            held, size = [], 0

        for batch in stream:
            sizes, signatures = [], []
            for i in range(batch.num_rows):
                tokens = shingle_set(batch.column(1)[i].as_py(), k)
                sizes.append(len(tokens))
                signatures.append(_signature(tokens))
                held.append(tokens)
                size += len(tokens)
                if size >= COUNT_CHUNK:
                    counted()
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        counted()
        pieces = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(sketch.reshape(-1, min(COUNTERS, counters))) if p.any()]
        m = len(pieces)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([i for i, _ in pieces], pa.int32()), pa.array([b for _, b in pieces], pa.binary())], schema=schema)

    return docs.mapInArrow(batches, "doc_id bigint, n bigint, signature binary, piece int, counts binary")


def _sketch(measured: DataFrame, counters: int) -> np.ndarray:
    """The tasks' sketches added up; 2**MOST_BITS counters at most reach the driver."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in stream:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(raw), np.uint32)
                total[i] = total[i] + part if i in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(t.tobytes(), 1) for t in total.values()], pa.binary())], ["piece", "counts"])

    pieces = measured.where("piece IS NOT NULL").select("piece", "counts").repartition("piece").mapInArrow(batches, "piece int, counts binary").collect()
    out = np.zeros((max(1, counters // COUNTERS), min(COUNTERS, counters)), np.uint32)
    for r in pieces:
        out[r["piece"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return out.ravel()


def _prefixes(docs: DataFrame, orders, k: int, percent: int) -> DataFrame:
    """(doc_id, signature, n, tokens): each document's prefix under the first order."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = orders.value
        for batch in stream:
            sizes, signatures, found = [], [], []
            for i in range(batch.num_rows):
                tokens = shingle_set(batch.column(1)[i].as_py(), k)
                sizes.append(len(tokens))
                signatures.append(_signature(tokens))
                found.append((known.prefix(tokens, prefix_size(len(tokens), percent), 0) >> np.uint64(BUCKET_SHIFT)).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int64()), lists], ["doc_id", "signature", "n", "tokens"])

    return docs.mapInArrow(batches, "doc_id bigint, signature binary, n bigint, tokens array<bigint>")


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of the ids: MARKS bits for each id, MOST_MARKS at most.

    It only saves shuffling: a text whose bit is set by chance is dropped by the join that follows.
    """
    bits = power(MARKS * ids.count(), 1 << 16, MOST_MARKS)
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.floor(bit / 32).cast("int").alias("word"), (bit % 32).cast("int").alias("place"))
    with cleaning(ids.sparkSession):
        words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _hit(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the hashes' bits are marked."""
    bits = hashes % np.int64(32 * len(marks))  # as pmod: Python's remainder is never negative
    return (marks[bits >> 5] >> (bits & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def _marked(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """(id, text) of the documents whose bit is marked."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield batch.select([0, 1]).filter(pa.array(_hit(shared.value, batch.column(2).to_numpy())))

    return docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id").alias("hash")).where("id IS NOT NULL").mapInArrow(batches, "id bigint, text string")


def overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, width: int = 2048) -> np.ndarray:
    """How many tokens the sets ``rows`` share with the sets ``cols``: a product of incidence matrices, ``width`` tokens at a time."""
    out = np.zeros((len(rows), len(cols)), np.float32)
    used = np.unique(np.concatenate([rows, cols]))
    owner = np.repeat(used, [len(sets[i]) for i in used])
    _, token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in used)]), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[token]
    owner, token = owner[keep], (np.cumsum(shared) - 1)[token[keep]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(token, (low, low + width))
        incidence = np.zeros((len(sets), width), np.float32)
        incidence[owner[a:b], token[a:b] - low] = 1
        out += incidence[rows] @ incidence[cols].T
    return out.astype(np.int64)


class Room:
    """Sets that meet, with their components so far; ``links`` holds the pairs found that join components."""

    def __init__(self, ids: list[int], components: list[int], sets: list[np.ndarray], orders: Orders, percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.prefixes = [[orders.prefix(s, prefix_size(len(s), percent), o) for s in sets] for o in range(len(ORDERS))]
        self.component = np.unique(np.array(components, np.int64), return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def compare(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Join what is similar among the sets ``rows`` and ``cols``: a pair is compared if every order's prefixes meet."""
        if not len(rows) or not len(cols):
            return
        m, n = self.sizes[rows][:, None], self.sizes[cols][None, :]
        overlap = -(-self.percent * (m + n) // (100 + self.percent))
        least = np.minimum(least_common(np.minimum(m, n), self.percent), overlap)
        open_ = (self.component[rows][:, None] != self.component[cols][None, :]) & (overlap <= np.minimum(m, n))
        for prefixes in self.prefixes:
            if not open_.any():
                return
            r, c = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            grid = np.ix_(r, c)
            open_[grid] &= overlaps(prefixes, rows[r], cols[c]) >= least[grid]
        r, c = np.nonzero(open_)
        if not len(r):
            return
        (i, r), (j, c) = np.unique(r, return_inverse=True), np.unique(c, return_inverse=True)
        if len(r) > 4 * (len(i) + len(j)):
            common = overlaps(self.sets, rows[i], cols[j])[r, c]
        else:
            common = np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(rows[i[r]], cols[j[c]])])
        x, y = rows[i[r]], cols[j[c]]
        similar = 100 * common >= self.percent * (self.sizes[x] + self.sizes[y] - common)
        for a, b in zip(x[similar].tolist(), y[similar].tolist()):
            if self.component[a] != self.component[b]:
                self.component[self.component == self.component[b]] = self.component[a]
                self.links.append((self.ids[a], self.ids[b]))


def _links(met: DataFrame, docs: DataFrame, orders, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components, found in rooms.

    met: room (pivot, i, j), id, component, side.  Where a room has members of side 0 and 1 alone, the former are
    compared with the latter; where all are of side 0, with each other; a member of side -1 is the pivot, which is
    compared with all before those that it is not similar to are compared with all.  Texts are shuffled, once for each
    room, since they shrink in a shuffle and hashes don't.
    """
    texts = _marked(docs, _marks(met.select("id").distinct()))
    n = partitions(docs.sparkSession)
    rows = texts.join(met, "id").select("pivot", "i", "j", "side", "id", "component", "text")
    rows = rows.repartition(n, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "side", "id")

    def found(sides: list[int], ids: list[int], components: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        room, side, every = Room(ids, components, sets, orders.value, percent), np.array(sides), np.arange(len(ids))
        if side[0] < 0:
            room.compare(every[:1], every[1:])
            room.compare(np.flatnonzero(room.component != room.component[0]), every)
        elif side[-1] > 0:
            room.compare(np.flatnonzero(side == 0), np.flatnonzero(side > 0))
        else:
            room.compare(every, every)
        return room.links

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [], [])

        def close() -> pa.RecordBatch:
            links = found(*held) if held[0] else []
            for column in held:
                column.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], ["a", "b"])

        for batch in stream:
            for row in range(batch.num_rows):
                pivot, i, j, side, own, component, text = (c[row].as_py() for c in batch.columns)
                if at != (pivot, i, j):
                    yield close()
                    at = (pivot, i, j)
                tokens = shingle_set(text, k)
                if held[1] and held[1][-1] == own and np.array_equal(held[3][-1], tokens):
                    continue  # a repeated row
                for column, value in zip(held, (side, own, component, tokens)):
                    column.append(value)
        yield close()

    return rows.mapInArrow(batches, "a bigint, b bigint")


def _rooms(count, tokens):
    """Rooms for so many members with so many tokens in all: one at least."""
    return F.greatest(F.ceil(count / F.lit(ROOM)), F.ceil(tokens / F.lit(ROOM_TOKENS)), F.lit(1)).cast("int")


def _groups(docs: DataFrame, orders, k: int, percent: int, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """The nodes (signature, node), and the groups (pivot, node, n) in which similar ones are together."""
    prefixes = _prefixes(docs.where("doc_id IS NOT NULL"), orders, k, percent).where("n > 0")
    prefixes = steps.write(prefixes.groupBy("signature").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    least = lambda n: F.floor(n * (100 - percent) / F.lit(100 + percent)) + 3  # noqa: E731  least_common
    tokens = prefixes.select("node", "n", F.posexplode("tokens").alias("place", "token"))
    tokens = tokens.select("token", "node", "n", (F.col("place") < least(F.col("n")) - 1).alias("lead"))
    # Counts are written out, and so are pivots and rooms below: a join of two plain inputs is one whose hot keys can be split.
    several = steps.write(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("token"))
    met = steps.write(tokens.join(several, "token"))
    # A set that meets others in fewer tokens than its smallest possible partner asks for is done with.
    fewest = F.ceil(percent * F.col("n") / F.lit(100))
    enough = F.least(least(fewest), F.ceil(percent * (F.col("n") + fewest) / F.lit(100 + percent)))
    stats = met.groupBy("node", "n").agg(F.count(F.lit(1)).alias("shared"), F.count_if("lead").alias("leads")).where(F.col("shared") >= enough)
    lone = steps.write(stats.select("node", (F.least(least(F.col("n")) - 1, F.col("n")) - F.col("leads")).alias("lone")))
    left = steps.write(met.join(lone, "node").select("token", "node", "n", "lone"))
    pivots = left.groupBy("token").agg(F.min(F.struct("lone", "node")).alias("c"), F.count(F.lit(1)).alias("size"))
    pivots = steps.write(pivots.where("size > 1").select("token", F.col("c.node").alias("pivot")))
    groups = steps.write(left.join(pivots, "token").select("pivot", "node", "n").distinct())
    nodes = steps.write(prefixes.select("signature", "node"))
    steps.drop(prefixes, several, met, lone, left, pivots)
    return nodes, groups


def _second_round(groups: DataFrame, rooms: DataFrame, component: DataFrame, steps: Steps) -> DataFrame:
    """The rooms in which members outside their pivot's component meet all others, of groups of several rooms."""
    large = groups.join(rooms.where("rooms > 1"), "pivot").select("pivot", "node", "n")
    placed = steps.write(large.join(component, "node", "left").select("pivot", "node", "n", F.coalesce("component", "node").alias("component")))
    own = steps.write(placed.where("node = pivot").select("pivot", F.col("component").alias("main")))
    placed_ = steps.write(placed.join(own, "pivot").withColumn("outer", F.col("component") != F.col("main")).drop("main"))
    size = lambda own: _rooms(F.count_if(own), F.sum(F.when(own, F.col("n")).otherwise(0)))
    plan = placed_.groupBy("pivot").agg(size(F.col("outer")).alias("o"), size(~F.col("outer")).alias("m"), F.count_if("outer").alias("some")).where("some > 0").drop("some")
    plan = steps.write(plan)
    steps.drop(placed, own)
    # Outer members are dealt to the blocks 0 to o-1, the others to o to o+m-1; block i meets itself and those beyond it.
    hash_ = F.xxhash64("node")
    block = F.when(F.col("outer"), F.pmod(hash_, F.col("o"))).otherwise(F.col("o") + F.pmod(hash_, F.col("m"))).cast("int")
    dealt = placed_.join(plan, "pivot").withColumn("block", block)
    first = F.transform(F.sequence(F.lit(0), F.least(F.col("block"), F.col("o") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), (i != F.col("block")).cast("int").alias("side")))
    then = F.when(F.col("outer"), F.transform(F.sequence(F.col("block"), F.col("o") + F.col("m") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    rooms = dealt.select("pivot", "node", "component", F.explode(F.array_distinct(F.concat(first, F.coalesce(then, F.array().cast("array<struct<i:int,j:int,side:int>>"))))).alias("r"))
    out = steps.write(rooms.select("pivot", "r.i", "r.j", F.col("node").alias("id"), "component", "r.side"))
    steps.drop(placed_, plan)
    return out


def join_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    A document links to others of Jaccard similarity ``percent``/100 or more; ``component_id`` is the smallest doc_id
    that links reach.  Documents without words (null, empty or blank texts) link with nothing.  Repeated rows each
    give a row, judged by their texts; a null doc_id links with nothing and has a null component; an empty table gives
    no rows; very long texts are taken whole; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    steps = Steps(spark, "ngram_join")
    counters = power(16 * docs.count(), 1 << LEAST_BITS, 1 << MOST_BITS)
    measured = steps.write(_measure(docs, k, counters))
    with cleaning(spark):
        orders = spark.sparkContext.broadcast(Orders(_sketch(measured, counters)))
    nodes, groups = _groups(docs, orders, k, percent, steps)

    rooms = steps.write(groups.groupBy("pivot").agg(_rooms(F.count(F.lit(1)), F.sum("n")).alias("rooms")))
    dealt = groups.join(rooms, "pivot")
    hub = dealt.where("node = pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("i"), "node", F.lit(-1).alias("side"))
    rest = dealt.where("node <> pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("rooms")).cast("int").alias("i"), "node", F.lit(0).alias("side"))
    met = steps.write(hub.unionByName(rest).select("pivot", "i", F.col("i").alias("j"), F.col("node").alias("id"), F.col("node").alias("component"), "side"))
    links = steps.write(_links(met, docs, orders, k, percent))
    steps.drop(met)
    component = connected_components(links, steps)
    if not rooms.where("rooms > 1").isEmpty():
        met = _second_round(groups, rooms, component, steps)
        more = steps.write(_links(met, docs, orders, k, percent))
        steps.drop(met, component)
        component = connected_components(links.unionByName(more), steps)
        steps.drop(more)
    steps.drop(groups, rooms, links)

    named = steps.write(nodes.join(component, "node", "left").select("signature", F.coalesce("component", "node").alias("component")))
    steps.drop(nodes, component)
    out = measured.where("piece IS NULL").select("doc_id", "n", "signature").join(named, "signature", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose doc_id is not in ``dropped``; null ids stay.

    Only rows whose id's bit is marked are shuffled to meet the dropped ids.
    """
    dropped = cut(dropped.select("doc_id").distinct())
    marks = docs.sparkSession.sparkContext.broadcast(_marks(dropped.select(F.col("doc_id").alias("id"))))
    rows, width, own = numbered(docs), len(docs.columns), f"c{docs.columns.index('doc_id')}"

    def half(marked: bool):
        def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                hit = _hit(marks.value, batch.column(width).to_numpy())
                yield batch.select(list(range(width))).filter(pa.array(hit == marked))

        return batches

    hashed = rows.withColumn("hash", F.xxhash64(F.col(own).cast("long")))
    clear, marked = (hashed.mapInArrow(half(m), rows.schema) for m in (False, True))
    kept = clear.unionByName(marked.join(dropped.withColumnRenamed("doc_id", own), own, "left_anti").select(*rows.columns))
    return kept.toDF(*docs.columns)
