"""Toxicity by multiple-instance learning.

A document is a bag of sentences and is toxic when any sentence is: with sentence scores p, the document's score is
the noisy-or 1 - prod(1 - p).  Only documents carry labels; the sentence model (a logistic one over words and their
beginnings) is trained through the noisy-or, and afterwards tells which sentences offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorine.llm.common import Steps, cleaning, numbered

#: Labelled documents, and bytes of their texts, that a model is fitted on, about (chosen by their ids' hash): the bound of all
#: that reaches the driver and of the model, since each feature occurs in MIN_DOCS documents of the sample.
MAX_DOCS, MAX_BYTES = 20_000, 256 << 20
#: Toxic documents in which a feature must occur.
MIN_DOCS = 4
#: Least likelihood-ratio statistic of a feature.
MIN_GAIN = 15.0
#: Lengths of the word beginnings that are features beside the word itself: for inflected words.
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
CACHE_WORDS = 150_000


def word_features(word: str) -> list[str]:
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in STEMS if len(word) >= n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that have a word; one empty span for a text without any."""
    found = [m.span() for m in SENTENCE.finditer(text) if WORD.search(m[0])]
    return found or [(0, 0)]


@dataclass
class Model:
    """A sentence's log-odds are ``bias`` plus the weights of its distinct features."""

    bias: float = -8.0
    weights: dict[str, float] = field(default_factory=dict)


class _Words(dict):
    """word -> indices of its features; most words have none."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(i for f in word_features(word) if (i := self.index.get(f)) is not None)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


def _instances(text: str, words: _Words) -> tuple[list[tuple[int, int]], list[tuple[int, list[int]]]]:
    """The sentences, and for those with known features (sentence, distinct feature indices)."""
    spans = sentences(text)
    lower = text.lower()
    if len(lower) != len(text):  # some letters grow: sentence by sentence then
        parts = [text[a:b].lower() for a, b in spans]
    else:
        if not any(map(words.__getitem__, WORD.findall(lower))):
            return spans, []
        parts = [lower[a:b] for a, b in spans]
    out = []
    for k, part in enumerate(parts):
        found = {i for w in WORD.findall(part) for i in words[w]}
        if found:
            out.append((k, sorted(found)))
    return spans, out


def _features(sample: DataFrame) -> list[str]:
    """Features by how much commoner they are in toxic documents; document counts over the whole sample."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in stream:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}:
                    counts.setdefault(f, [0, 0])[toxic] += 1
            if len(counts) > 100_000:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    def rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["feature", "clean", "toxic"])

    counts = sample.select("text", F.col("toxic").cast("int")).mapInArrow(batches, "feature string, clean bigint, toxic bigint")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = sample.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_clean = totals["toxic"] or 0, (totals["n"] or 0) - (totals["toxic"] or 0)
    if not n_toxic:
        return []
    p, q = F.col("toxic") / n_toxic, F.col("clean") / max(n_clean, 1)
    # The likelihood-ratio statistic of the feature's rate in toxic documents against its rate in all.
    share = n_toxic / max(n_toxic + n_clean, 1)
    both = F.col("toxic") + F.col("clean")
    gain = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0))
    ranked = counts.where((F.col("toxic") >= MIN_DOCS) & (p > 2 * q)).withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN)
    return [r["feature"] for r in ranked.select("feature").orderBy("feature").collect()]


def _train(bags: list[tuple[int, int, list[tuple[int, list[int]]]]], k: int, steps: int = 600, penalty: float = 2e-5) -> tuple[float, np.ndarray]:
    """Weights by Adam on the documents' log-likelihood under the noisy-or.

    bags: (label, sentences, [(sentence, feature indices)]).  A sentence without features scores sigmoid(bias).
    """
    y = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] - len(b[2]) for b in bags], float)
    doc = np.array([d for d, b in enumerate(bags) for _ in b[2]], np.int64)
    cols = np.array([i for b in bags for _, f in b[2] for i in f], np.int64)
    row = np.repeat(np.arange(len(doc)), [len(f) for b in bags for _, f in b[2]]) if len(doc) else np.zeros(0, np.int64)
    n, w, bias = len(bags), np.zeros(k), -6.0
    m1, m2, rate = np.zeros(k + 1), np.zeros(k + 1), 0.1
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, w[cols], len(doc))
        survive = plain * softplus(bias) + np.bincount(doc, softplus(z), n)  # -log(1 - P)
        toxic = -np.expm1(-survive)
        pull = 1 - y / np.maximum(toxic, 1e-9)  # of the loss by a sentence's log-odds, over its p: y=0: 1; y=1: -(1-P)/P
        p = 1 / (1 + np.exp(-z))
        by_sentence = pull[doc] * p / n
        gradient = np.append(np.bincount(cols, by_sentence[row], k) + penalty * w, by_sentence.sum() + (pull * plain).sum() / (1 + np.exp(-bias)) / n)
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        move = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:k], min(bias - move[k], -2.0)
    return float(bias), w


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    """Train on the labelled documents whose crc32(doc_id as text) mod 4 is not 2: about ``max_docs`` of them and ``max_bytes`` of text at most.

    The bounds are kept by a threshold on the ids' hash.  Null labels are left out; of several labels of one document
    the largest counts; null and empty texts are documents without words; repeated rows each count.  Without toxic
    labels, and of empty tables, every sentence gets a small score.
    """
    steps = Steps(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    with cleaning(docs.sparkSession):
        n = known.count()
    part = int(1e6 * min(1, max_docs / max(n, 1)))
    # About max_docs rows of two numbers: a proven bound for the broadcast.
    found = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(known.where(place < part)), "doc_id").select("text", F.least(F.col("toxic"), F.lit(1)).alias("toxic"), place.alias("place"))
    sample = steps.write(found)
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        sample = sample.where(F.col("place") < int(part * max_bytes / size))
    model = _fitted(sample)
    steps.drop(*[f for f, _ in steps.written])
    return model


def _fitted(sample: DataFrame) -> Model:
    """The model of a bounded sample (text, toxic)."""
    with cleaning(sample.sparkSession):
        names = _features(sample)
    if not names:
        return Model()
    shared = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(shared.value)
        for batch in stream:
            made = [_instances(t or "", words) for t in batch.column(0).to_pylist()]
            found = pa.array([[f for _, f in inst] for _, inst in made], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(s) for s, _ in made], pa.int32()), found], ["toxic", "n", "found"])

    rows = sample.select("text", "toxic").mapInArrow(batches, "toxic int, n int, found array<array<int>>").collect()
    bias, weights = _train([(r["toxic"], r["n"], list(enumerate(r["found"]))) for r in rows], len(names))
    return Model(bias, {f: float(w) for f, w in zip(names, weights) if w})


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def _scorer(model: Model):
    """A function that gives (score, sentences, the worst one's span and score) of a text."""
    names = list(model.weights)
    weights = np.array([model.weights[f] for f in names])
    words = _Words({f: i for i, f in enumerate(names)})
    base = float(np.logaddexp(0, model.bias))

    def score_of(text: str | None) -> tuple[float, int, int, int, float]:
        spans, found = _instances(text or "", words)
        survive, worst, top = base * (len(spans) - len(found)), spans[0], model.bias
        for k, f in found:
            z = model.bias + float(weights[f].sum())
            survive += float(np.logaddexp(0, z))
            if z > top:
                worst, top = spans[k], z
        return float(-np.expm1(-survive)), len(spans), *worst, float(1 / (1 + np.exp(-top)))

    return score_of


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_sentences, worst_start, worst_end, worst_score): each row's score and its worst sentence.

    Null and empty texts, and such without words, count as one empty sentence; of equally bad sentences the first
    counts; very long texts are read whole; repeated rows each give a row; further columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _scorer(shared.value)
        for batch in stream:
            rows = [score_of(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], ["doc_id", "score", "n_sentences", "worst_start", "worst_end", "worst_score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(batches, f"doc_id {kind}, score double, n_sentences bigint, worst_start bigint, worst_end bigint, worst_score double")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose score is below the threshold; as ``score`` otherwise."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _scorer(shared.value)
        for batch in stream:
            yield batch.filter(pa.array([score_of(batch.column(at)[i].as_py())[0] < THRESHOLD for i in range(batch.num_rows)], pa.bool_()))

    return numbered(docs).mapInArrow(batches, docs.schema)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the offending sentence of every document."""
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_end", "worst_score")
