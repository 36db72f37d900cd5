"""Language identification by a bidirectional gated recurrent network over bytes.

A text is lower-cased and becomes a stream of codes: a code for each letter a to z, one for each byte from 0x80 on, and one
for any run of other bytes.  The stream is cut into windows; in each, one gated recurrent network reads forwards and one
backwards, and every position gets the languages' probabilities from both states.  A document's probabilities are the mean
over all its positions that are letters, of all its windows.  The network is trained in numpy by backpropagation through
time, each position with the language of its document.

Gates use x / (1 + |x|) in place of the hyperbolic tangent, and (1 + that) / 2 as the logistic function: an eighth of the time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorine.llm.common import cleaning, only

#: Bounds of the fit: languages (the commonest ones), about so many documents of each (chosen by their ids' hash), windows of each document.
MAX_LANGS, DOCS_A_LANG, WINDOWS_A_DOC = 64, 400, 8
#: Positions of a window, windows that are read at once, states of a direction.
WINDOW, LANES, STATES = 64, 2048, 8
AT_ONCE = 4 << 20
CODES = 27 + 128
STEPS, BATCH = 400, 256
UNKNOWN = "und"


def code_table() -> np.ndarray:
    """Byte -> code: 0 for what is neither a letter a to z nor a byte from 0x80 on."""
    table = np.zeros(256, np.uint8)
    table[97:123], table[128:] = np.arange(1, 27), np.arange(27, CODES)
    return table


TABLE, ASCII_LETTER = code_table(), re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def windows(text: str) -> np.ndarray:
    """(windows, WINDOW) codes of the whole text; the last window is filled up with 0.  An empty text has none."""
    codes = TABLE[np.frombuffer(text.lower().encode(), np.uint8)]
    if len(codes):
        codes = codes[(codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)]
    out = np.zeros((-(-len(codes) // WINDOW), WINDOW), np.uint8)
    out.ravel()[: len(codes)] = codes
    return out


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * soft(x)


@dataclass
class Model:
    """w: (direction, gate, code, state) of the input, u: (direction, gate, state, state), o: (direction, language, state), b: (language).

    Gates: 0 keeps the old state, 1 lets it into the proposal, 2 is the proposal.
    """

    langs: list[str] = field(default_factory=list)
    w: np.ndarray | None = None
    u: np.ndarray | None = None
    o: np.ndarray | None = None
    b: np.ndarray | None = None

    @staticmethod
    def fresh(langs: list[str], states: int = STATES, seed: int = 12) -> Model:
        rng, k = np.random.default_rng(seed), len(langs)
        draw = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        return Model(langs, draw(0.5, 2, 3, CODES, states), draw(0.5, 2, 3, states, states), draw(0.3, 2, k, states), np.zeros(k, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.u, self.o, self.b]


def read(w: np.ndarray, u: np.ndarray, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (time, lane, state) after each of the codes (time, lane).  ``trace`` gets what the way back needs."""
    time, lanes = codes.shape
    h = np.zeros((lanes, u.shape[-1]), np.float32)
    out = np.empty((time, *h.shape), np.float32)
    for t in range(time):
        c = codes[t]
        keep = gate(np.take(w[0], c, axis=0) + h @ u[0])
        let = gate(np.take(w[1], c, axis=0) + h @ u[1])
        inner = h @ u[2]
        new = soft(np.take(w[2], c, axis=0) + let * inner)
        if trace is not None:
            trace.append((h, keep, let, inner, new))
        h = new + keep * (h - new)
        out[t] = h
    return out


def unread(u: np.ndarray, codes: np.ndarray, trace: list, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of (w, u) through time.  pull: the loss's gradient by each state of ``read``."""
    time, lanes, states = pull.shape
    slopes, du = np.empty((3, time, lanes, states), np.float32), np.zeros_like(u)
    carried = np.zeros((lanes, states), np.float32)
    steep = lambda g: 0.5 * (1 - np.abs(2 * g - 1)) ** 2
    for t in reversed(range(time)):
        h, keep, let, inner, new = trace[t]
        d = pull[t] + carried
        proposal = d * (1 - keep) * (1 - np.abs(new)) ** 2
        a = slopes[:, t]
        a[0], a[1], a[2] = d * (h - new) * steep(keep), proposal * inner * steep(let), proposal
        into = (a[0], a[1], proposal * let)
        carried = d * keep + sum(g @ u[i].T for i, g in enumerate(into))
        for i, g in enumerate(into):
            du[i] += h.T @ g
    # A code's weights gather the slopes of all positions that hold it.
    order = np.argsort(codes.ravel(), kind="stable")
    there, first = np.unique(codes.ravel()[order], return_index=True)
    dw = np.zeros((3, CODES, states), np.float32)
    dw[:, there] = np.add.reduceat(slopes.reshape(3, -1, states)[:, order], first, axis=1)
    return dw, du


def label(model: Model, codes: np.ndarray, traces: list | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Probabilities (language, time, lane) of every position of the codes (time, lane), and each direction's states."""
    turned = (codes, codes[::-1])
    traces = [None, None] if traces is None else traces
    states = [read(model.w[i], model.u[i], turned[i], traces[i]) for i in range(2)]
    flat = [s.reshape(-1, s.shape[-1]).T for s in (states[0], states[1][::-1])]
    odds = model.o[0] @ flat[0] + model.o[1] @ flat[1] + model.b[:, None]
    odds = np.exp(odds - odds.max(0))
    return (odds / odds.sum(0)).reshape(len(model.langs), *codes.shape), states


def train(langs: list[str], rows: np.ndarray, lang: np.ndarray, steps: int = STEPS, seed: int = 12) -> Model:
    """Adam on the positions' cross-entropy.  rows: windows of codes; lang: the number of each one's language.

    Languages are drawn alike often, however many windows they have.
    """
    model, rng = Model.fresh(langs, seed=seed), np.random.default_rng(seed)
    own = [np.flatnonzero(lang == k) for k in range(len(langs))]
    own = [o for o in own if len(o)]
    m1, m2 = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()]
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(o, max(1, BATCH // len(own))) for o in own])
        codes, traces = np.ascontiguousarray(rows[picked].T), [[], []]
        p, states = label(model, codes, traces)
        p[lang[picked], :, np.arange(len(picked))] -= 1
        p *= (codes != 0) / max(np.count_nonzero(codes), 1)
        flat = p.reshape(len(langs), -1).astype(np.float32)
        seen = (states[0], states[1][::-1])
        do = np.stack([flat @ s.reshape(-1, s.shape[-1]) for s in seen])
        pulls = [(flat.T @ model.o[i]).reshape(states[i].shape) for i in range(2)]
        back = [unread(model.u[i], (codes, codes[::-1])[i], traces[i], (pulls[0], pulls[1][::-1])[i]) for i in range(2)]
        gradients = [np.stack([b[0] for b in back]), np.stack([b[1] for b in back]), do, flat.sum(1)]
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for part, g, a, b in zip(model.parts(), gradients, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            part -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, max_langs: int = MAX_LANGS, docs_a_lang: int = DOCS_A_LANG, steps: int = STEPS) -> Model:
    """Train on documents with a language whose crc32(doc_id as text) mod 4 is not 2.

    The bounds: the ``max_langs`` commonest languages, about ``docs_a_lang`` documents of each by their ids' hash, and
    ``WINDOWS_A_DOC`` windows of each, spread evenly over its text.  Null languages and texts without a letter teach nothing;
    repeated rows each count.  Without any such document the model knows no language.
    """
    known = only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    with cleaning(docs.sparkSession):
        counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not counts:
        return Model()
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(1e6 * min(1.0, docs_a_lang / r["n"])))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = known.where(place < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0)))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = []
            for text in (batch.column(1)[i].as_py() for i in range(batch.num_rows)):
                rows = windows(text) if has_letter(text) else np.zeros((0, WINDOW), np.uint8)
                spread = np.linspace(0, len(rows), min(len(rows), WINDOWS_A_DOC), endpoint=False).astype(int)
                made.append(rows[spread].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], ["place", "lang", "codes"])

    made = sample.select(place.alias("place"), "text", "lang").mapInArrow(batches, f"place bigint, lang {dict(docs.dtypes)['lang']}, codes binary")
    with cleaning(docs.sparkSession):
        found = [r for r in made.collect() if r["codes"]]
    if not found:
        return Model()
    found.sort(key=lambda r: (r["place"], str(r["lang"]), bytes(r["codes"])))
    langs = sorted({r["lang"] for r in found})
    rows = [np.frombuffer(r["codes"], np.uint8).reshape(-1, WINDOW) for r in found]
    return train(langs, np.concatenate(rows), np.repeat([langs.index(r["lang"]) for r in found], [len(r) for r in rows]), steps)


def pooled(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the sums of its letters' probabilities (text, language), how many letters each language labels, and the letters."""
    k = len(model.langs)
    sums, labelled, letters = np.zeros((len(texts), k)), np.zeros((len(texts), k)), np.zeros(len(texts))
    made = [(i, windows(t)) for i, t in enumerate(texts) if t and has_letter(t)]
    if not made or not k:
        return sums, labelled, letters
    owner = np.repeat([i for i, _ in made], [len(r) for _, r in made])
    rows = np.concatenate([r for _, r in made])
    for at in range(0, len(rows), LANES):
        codes = np.ascontiguousarray(rows[at : at + LANES].T)
        p, _ = label(model, codes)
        real = codes != 0
        np.add.at(letters, owner[at : at + LANES], real.sum(0))
        top = (p == p.max(0)) & real
        p *= real
        np.add.at(sums, owner[at : at + LANES], p.sum(1, dtype=np.float64).T)
        np.add.at(labelled, owner[at : at + LANES], top.sum(1).T)
    return sums, labelled, letters


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about AT_ONCE bytes of text: what is in work at once."""
    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1):
        size += n
        if size >= AT_ONCE or i == len(texts):
            yield at, i
            at, size = i, 0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, letters, agreeing) of every document.

    score: the mean probability of the language named, over all the document's letters (its bytes that are letters a to z or
    not ASCII); agreeing: the share of them whose own label it is.  Of equal probabilities the language first in order is named.
    A null or empty text, and one without a letter, is ``und`` with score 0, as is any text if no language was learned.  Very
    long texts are read whole, window by window; repeated rows each give a row; an empty table gives none; further columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_LANGS

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in stream:
            named, score, count, agreeing = [], [], [], []
            for at, end in portions(batch.column(1)):
                sums, labelled, letters = pooled(model, batch.column(1)[at:end].to_pylist())
                for s, own, n in zip(sums, labelled, letters):
                    best = int(s.argmax()) if n else None
                    named.append(UNKNOWN if best is None else str(model.langs[best]))
                    score.append(0.0 if best is None else round(float(s[best] / n), 6))
                    count.append(int(n))
                    agreeing.append(0.0 if best is None else round(float(own[best] / n), 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(agreeing, pa.float64())], ["doc_id", "lang_pred", "score", "letters", "agreeing"])

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double, letters bigint, agreeing double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "letters", "agreeing")
