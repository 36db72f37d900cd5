"""Near-duplicate vectors by hierarchical navigable small-world graphs, one a shard.

Equal vectors become one node that carries their number.  Nodes are dealt to shards by hash; each shard's task builds
a graph of its own, and every node is looked up in every shard's graph, in blocks, so that a link needs no luck with
the sharding.  Searches run in lockstep: one NumPy step expands a candidate of each query of a block.

A search's beam widens while its results still reach the threshold at the beam's end (there may be more behind); a query
that still has too many is compared with the whole shard.  The beam to begin with widens until audits pass: each graph is
asked for queries planted just inside the threshold of its own vectors, so that an audit holds links however rare they
are, and some queries of each block are compared with the whole shard.  Every link is verified by its cosine in double
precision.  Links aren't spelled out beyond their task: a meeting of block and shard returns each node's number of links
and a star for each of its components.
"""

from __future__ import annotations

import logging
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorine.llm.common import Steps
from calorine.llm.components import connected_components

#: Shards at least, nodes and bytes that one takes before there are more; nodes of a block of queries.
SHARDS, SHARD_NODES, SHARD_BYTES, BLOCK_NODES = 8, 50_000, 64 << 20, 8_192
#: Tasks at least: with few shards, each goes to several lanes, among which the blocks are dealt.
LANES = 48
#: Neighbours of a node on the upper levels and on the ground; the beam while building and at first while searching.
M, M_GROUND, BUILD_BEAM, BEAM = 12, 24, 48, 32
#: Widest beam; beyond it a query is compared with the whole shard.
MOST_BEAM = 256
#: Queries planted in a shard, queries of a block that the audit compares with the whole shard, and the share of links it asks for.
PLANTED, AUDITED, RECALL = 128, 64, 0.98
LOCKSTEP = 512
#: Single precision may be off by this much; the verification decides.
SLACK = 1e-3


class Graph:
    """A graph over unit vectors (float32)."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.vectors = vectors
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(np.int64), 6)
        order = rng.permutation(n)
        self.links = [np.full((n, M_GROUND if level == 0 else M), -1, np.int32) for level in range(int(self.levels.max(initial=0)) + 1)]
        self.entry = -1
        self._build(order)

    def _build(self, order: np.ndarray) -> None:
        """Insert in batches that double up to LOCKSTEP; within a batch all nodes see each other."""
        at = 0
        while at < len(order):
            batch = order[at : at + max(1, min(LOCKSTEP, at))]
            starts = None
            if self.entry >= 0:
                starts = np.full(len(batch), self.entry, np.int64)
            top = len(self.links) - 1
            for level in range(top, -1, -1):
                here = self.levels[batch] >= level
                found_ids = np.full((len(batch), BUILD_BEAM), -1, np.int64)
                found_sims = np.full((len(batch), BUILD_BEAM), -np.inf, np.float32)
                if starts is not None and self.levels[self.entry] >= level:
                    beam = np.where(here, BUILD_BEAM, 1)
                    for width in np.unique(beam):
                        rows = np.flatnonzero(beam == width)
                        ids, sims = self.search_level(self.vectors[batch[rows]], starts[rows], level, int(width))
                        found_ids[rows, :width], found_sims[rows, :width] = ids, sims
                    starts = np.where(found_ids[:, 0] >= 0, found_ids[:, 0], starts)
                rows = np.flatnonzero(here)
                if len(rows):
                    self._connect(batch[rows], found_ids[rows], found_sims[rows], level)
            best = batch[np.argmax(self.levels[batch])]
            if self.entry < 0 or self.levels[best] > self.levels[self.entry]:
                self.entry = int(best)
            at += len(batch)

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, level: int) -> None:
        width = self.links[level].shape[1]
        among = self.vectors[nodes] @ self.vectors[nodes].T
        np.fill_diagonal(among, -np.inf)
        k = min(BUILD_BEAM // 2, len(nodes))
        near = np.argpartition(-among, k - 1, axis=1)[:, :k]
        ids = np.concatenate([ids, np.where(np.isfinite(np.take_along_axis(among, near, 1)), nodes[near], -1)], axis=1)
        sims = np.concatenate([sims, np.take_along_axis(among, near, 1)], axis=1)
        chosen = self._diverse(ids, sims, M)
        self.links[level][nodes, : chosen.shape[1]] = chosen
        # Back links: each neighbour keeps a diverse choice of its old and new ones.
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        unique, first, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, count)
        while True:  # a hub's new links come in several helpings
            fresh = np.full((len(unique), width), -1, np.int64)
            use = rank < width
            fresh[np.repeat(np.arange(len(unique)), count)[use], rank[use]] = source[use]
            merged = np.concatenate([self.links[level][unique].astype(np.int64), fresh], axis=1)
            merged = self._unique(merged)
            sim = np.einsum("ij,ikj->ik", self.vectors[unique], self.vectors[merged])
            sim[merged < 0] = -np.inf
            self.links[level][unique] = self._diverse(merged, sim, width)
            rank = rank - width
            if not (rank >= 0).any():
                return
            keep = rank >= 0
            row = np.repeat(np.arange(len(unique)), count)[keep]
            source, rank = source[keep], rank[keep]
            kept, row = np.unique(row, return_inverse=True)
            unique, count = unique[kept], np.bincount(row)

    @staticmethod
    def _unique(ids: np.ndarray) -> np.ndarray:
        """Each row's ids once, the rest -1."""
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        return ids

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` ids a row: the nearest first, passing over those nearer to a chosen one than to the node;
        free places go to the nearest of the passed over."""
        order = np.argsort(-sims, axis=1)[:, : 3 * width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        vectors = self.vectors[ids]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        n, c = ids.shape
        chosen, count = np.zeros((n, c), bool), np.zeros(n, np.int64)
        for j in range(c):
            ok = (ids[:, j] >= 0) & (count < width) & ~((between[:, j, :] > sims[:, j, None]) & chosen).any(1)
            chosen[:, j] = ok
            count += ok
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1)[:, :width]
        out = np.full((n, width), -1, np.int32)
        out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
        return out

    def search_level(self, queries: np.ndarray, starts: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam of each query, best first; -1 where there are fewer.

        One step expands the best candidate not yet expanded of each query still at work.
        """
        n, links = len(queries), self.links[level]
        ids, sims, done = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32), np.ones((n, beam), bool)
        ids[:, 0], done[:, 0] = starts, False
        sims[:, 0] = np.einsum("ij,ij->i", queries, self.vectors[starts])
        seen = np.zeros((n, len(self.vectors)), bool)
        seen[np.arange(n), starts] = True
        active = np.arange(n)
        while len(active):
            open_ = ~done[active]
            first = np.argmax(open_, axis=1)
            live = open_[np.arange(len(active)), first]
            active, first = active[live], first[live]
            if not len(active):
                break
            done[active, first] = True
            near = links[ids[active, first]].astype(np.int64)
            rows = active[:, None]
            fresh = (near >= 0) & ~seen[rows, near]
            seen[rows, np.where(near >= 0, near, ids[rows, 0])] = True
            sim = np.einsum("ij,ikj->ik", queries[active], self.vectors[near])
            sim = np.where(fresh, sim, -np.inf).astype(np.float32)
            all_sims = np.concatenate([sims[active], sim], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1), order, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), order, 1)
            sims[active] = np.take_along_axis(all_sims, order, 1)
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.full(len(queries), self.entry, np.int64)
        for level in range(int(self.levels[self.entry]), 0, -1):
            starts = self.search_level(queries, starts, level, 1)[0][:, 0]
        return self.search_level(queries, starts, 0, min(beam, len(self.vectors)))

    def pack(self) -> bytes:
        """All but the vectors, which travel with the nodes."""
        return pickle.dumps((self.levels.astype(np.int8), self.links, self.entry))

    @classmethod
    def unpack(cls, raw: bytes, vectors: np.ndarray) -> Graph:
        graph = cls.__new__(cls)
        graph.vectors = vectors
        graph.levels, graph.links, graph.entry = pickle.loads(raw)
        return graph


def pack_rows(rows: np.ndarray) -> bytes:
    """Rows as bytes, in single precision where that loses nothing."""
    single = rows.astype(np.float32)
    return b"f" + single.tobytes() if (single == rows).all() else b"d" + rows.astype(np.float64).tobytes()


def unpack_rows(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=1).reshape(-1, dim)


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


class Search:
    """Links at ``threshold`` of queries to a graph's nodes, with a beam that passes its audits.

    ``audited`` and ``found`` count the true links that audits held and those of them that searches found.
    """

    def __init__(self, graph: Graph, threshold: float, seed: int = 3):
        self.graph, self.threshold, self.beam = graph, threshold, BEAM
        self.rng = np.random.default_rng(seed)
        self.audited = self.found = 0
        size, dim = graph.vectors.shape
        own = graph.vectors[self.rng.permutation(size)[:PLANTED]]
        # Planted queries: a quarter of the way from the threshold to the vector itself, in any direction.
        across = self.rng.normal(size=own.shape)
        across -= (across * own).sum(1, keepdims=True) * own
        cosine = threshold + (1 - threshold) / 4 if dim > 1 else 1.0
        across *= (1 - cosine**2) ** 0.5 / np.maximum(np.sqrt((across * across).sum(1, keepdims=True)), 1e-12)
        self.audit((cosine * own + across).astype(np.float32))

    def audit(self, queries: np.ndarray) -> bool:
        """Widen the beam until the queries' links are found; whether it was wide enough already."""
        truth = queries @ self.graph.vectors.T >= self.threshold
        before = self.beam
        while True:
            found = np.zeros_like(truth)
            for r, c in self.hits(queries):
                found[r, c] = True
            hit = int((found & truth).sum())
            if hit >= RECALL * truth.sum() or self.beam >= len(self.graph.vectors):
                break
            self.beam *= 2
        self.audited, self.found = self.audited + int(truth.sum()), self.found + hit
        return self.beam == before

    def hits(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of the pairs found at the threshold less SLACK or more, some queries at a time."""
        least, size = self.threshold - SLACK, len(self.graph.vectors)
        todo, width = np.arange(len(queries)), self.beam
        while len(todo) and width <= max(MOST_BEAM, self.beam):
            left = []
            step = max(16, LOCKSTEP * BEAM // width)
            for a in range(0, len(todo), step):
                part = todo[a : a + step]
                ids, sims = self.graph.search(queries[part], width)
                hit = (sims >= least) & (ids >= 0)
                full = hit[:, -1] & (width < size)  # links up to the beam's end: there may be more
                hit &= ~full[:, None]
                r, c = np.nonzero(hit)
                yield part[r], ids[r, c]
                left.append(part[full])
            todo, width = np.concatenate(left), width * 2
        for a in range(0, len(todo), 256):
            part = todo[a : a + 256]
            r, c = np.nonzero(queries[part] @ self.graph.vectors.T >= least)
            yield part[r], c

    def links(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``hits`` of a block, after an audit of some of its queries."""
        self.audit(queries[self.rng.permutation(len(queries))[:AUDITED]])
        return self.hits(queries)


def join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after the links (a, b): each label is a member's index, a root's its own."""
    while True:
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return labels
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def meeting(search: Search, raw: np.ndarray, ids: np.ndarray, copies: np.ndarray, query_raw: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each query, counting copies; nodes and their components' smallest nodes) of a block and a shard.

    raw, query_raw: unit vectors in double precision, which decide near the threshold.
    """
    n, links = len(query_ids), np.zeros(len(query_ids), np.int64)
    labels = np.arange(n + len(ids))
    queries = query_raw.astype(np.float32)
    for q, c in search.links(queries):
        sure = query_ids[q] != ids[c]
        q, c = q[sure], c[sure]
        keep = np.zeros(len(q), bool)
        for a in range(0, len(q), 100_000):
            i, j = q[a : a + 100_000], c[a : a + 100_000]
            keep[a : a + 100_000] = np.einsum("ij,ij->i", query_raw[i], raw[j]) >= search.threshold
        q, c = q[keep], c[keep]
        np.add.at(links, q, copies[c])
        labels = join(labels, q, n + c)
    every = np.concatenate([query_ids, ids])
    least = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, every)
    star = least[labels]
    linked = star != every
    return links, every[linked], star[linked]


def _usable(v, id_):
    """Whether a vector can link: it has an id, components, none of them null or non-finite, and one that isn't 0."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return id_.isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """All rows (vec_id, vector, usable); an unusable vector is null."""
    v, id_ = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")), F.col(f"`{id_col}`").cast("long")
    rows = vectors.select(id_.alias("vec_id"), F.coalesce(_usable(v, id_), F.lit(False)).alias("usable"), v.alias("vector"))
    return rows.select("vec_id", "usable", F.when(F.col("usable"), F.col("vector")).alias("vector"))


def link_vectors(nodes: DataFrame, threshold: float, steps: Steps) -> DataFrame:
    """What the meetings of blocks and shards found among ``nodes`` (node, vector, copies): (kind, a, b).

    kind 0: node a has b links in one shard, counting copies; kind 1: nodes a and b are of one component; kind 2: an
    audit held a links and found b.
    """
    n = nodes.count()
    widest = nodes.agg(F.max(F.size("vector"))).first()[0] or 1
    shards = max(SHARDS, -(-n // SHARD_NODES), -(-n * widest * 4 // SHARD_BYTES))
    blocks = max(1, -(-n // BLOCK_NODES))
    lanes = max(1, min(LANES // shards, blocks))  # a lane without a block would load its graph for nothing
    # Vectors of different lengths never meet: the length is part of each key.
    keyed = nodes.select("node", "vector", "copies", F.size("vector").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.hash("node"), F.lit(blocks)).cast("int").alias("block"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(group["vector"].tolist(), np.float64)
        graph = Graph(unit(raw).astype(np.float32))
        packed = {c: [group[c].to_numpy(np.int64).tobytes()] for c in ("node", "copies")}
        return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "shard": [int(group["shard"].iloc[0])], **packed, "raw": [pack_rows(raw)], "graph": [graph.pack()]})

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(group["vector"].tolist(), np.float64)
        return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "block": [int(group["block"].iloc[0])], "node": [group["node"].to_numpy(np.int64).tobytes()], "raw": [pack_rows(raw)]})

    graphs = steps.write(keyed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, node binary, copies binary, raw binary, graph binary"))
    queries = steps.write(keyed.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, node binary, raw binary"))
    # A shard goes to each of its lanes once, and every block to one lane of every shard; the graph comes first there.
    none = F.lit(None).cast("binary")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    sent = graphs.select("dim", "shard", every(lanes).alias("lane"), F.lit(-1).alias("block"), "node", "copies", "raw", "graph")
    asked = queries.select("dim", every(shards).alias("shard"), F.pmod("block", F.lit(lanes)).alias("lane"), "block", "node", none.alias("copies"), "raw", none.alias("graph"))
    met = sent.unionByName(asked).repartition(min(3 * shards * lanes, 10_000), "dim", "shard", "lane").sortWithinPartitions("dim", "shard", "lane", "block")

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, shard = None, None, ()

        def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

        for batch in stream:
            for row in range(batch.num_rows):
                dim, number, lane, block, node, copies, raw, graph = (c[row].as_py() for c in batch.columns)
                ids, raw = np.frombuffer(node, np.int64), unit(unpack_rows(raw, dim))
                if block < 0:
                    at, found, shard = (dim, number, lane), Search(Graph.unpack(graph, raw.astype(np.float32)), threshold), (raw, ids, np.frombuffer(copies, np.int64))
                elif at == (dim, number, lane):  # a length may have fewer shards
                    links, a, b = meeting(found, *shard, raw, ids)
                    yield rows(0, ids[links > 0], links[links > 0])
                    yield rows(1, a, b)
                    yield rows(2, np.array([found.audited]), np.array([found.found]))
                    found.audited = found.found = 0

    out = steps.write(met.mapInArrow(search, "kind int, a bigint, b bigint"))
    steps.drop(graphs, queries)
    return out


def audit_recall(found: DataFrame) -> float:
    """The share of the audited links that were found in all meetings; a warning is logged below RECALL."""
    held, hit = found.where("kind = 2").agg(F.sum("a"), F.sum("b")).first()
    recall = (hit or 0) / held if held else 1.0
    if recall < RECALL:
        logging.getLogger(__name__).warning("vector near-dedup: audits found %.4f of the links", recall)
    return recall


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row.

    ``n_links`` counts the other vectors of cosine ``threshold`` or more that were found, ``component_id`` is the
    smallest vec_id that links reach, and that vector is kept; ``audit_recall`` is the share of links that the audits of this run found, the same for
all rows.  Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing and are kept, as are rows with a null vec_id (their component is null).
    Repeated rows each give a row and count as vectors of their own; vectors of different lengths never link; an empty
    table gives no rows; further columns are ignored.
    """
    steps = Steps(vectors.sparkSession, "vector_dedup")
    digest = [F.xxhash64("vector").alias("d1"), F.xxhash64(F.lit(1), "vector").alias("d2")]  # 128 bits stand for the vector
    rows = _rows(vectors, id_col, vector_col)
    nodes = steps.write(rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    found = link_vectors(nodes, threshold, steps)
    recall = audit_recall(found)
    counted = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    component = connected_components(found.where("kind = 1").select("a", "b"), steps)
    facts = nodes.select("node", "copies", *digest).join(counted, "node", "left").join(component, "node", "left")
    facts = steps.write(facts.select("d1", "d2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    steps.drop(nodes, found, component)
    linked = rows.where("usable").select("vec_id", *digest).join(facts, ["d1", "d2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"))
