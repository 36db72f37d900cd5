"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expressions.  Every code point has a class in one table; a class with a little
lookahead becomes a symbol of a small automaton, a symbol is a function from states to states, and such functions
compose associatively.  So a long text is cut into blocks whose composed functions are found side by side in NumPy, a
scan over the blocks gives the state at each block's start, and a second pass marks where tokens begin.  The slices
between those marks go to a cached pair merge.

The pattern that the automaton recognises, in its alternatives' order: the endings 's 't 're 've 'm 'll 'd; letters,
numbers, or other characters, each with an optional space before; white space up to but without the last character
before a non-space; white space.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of code points.
LETTER, NUMBER, SPACE, BLANK, APOSTROPHE, OTHER, END = range(7)
# Symbols: classes with what the next characters say.
S_LETTER, S_NUMBER, S_OTHER, S_ENDING2, S_ENDING3, S_JOINED, S_SINGLE, S_RUN, S_END = range(9)
# States after a character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_JOINED, IN_RUN, ONE_LEFT, TWO_LEFT = range(8)
N_SYMBOLS, N_STATES = 9, 8
#: White space beyond ASCII's (the Unicode property White_Space).
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Code points that one call of the scan takes; a longer text goes through in windows.
WINDOW = 1 << 20
BLOCK = 128
#: Pieces that the merge cache holds before it starts anew, and bytes of the longest piece it keeps.
CACHE_PIECES, CACHE_BYTES = 300_000, 64


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    category = unicodedata.category
    for c in range(0x110000):
        kind = category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE_SPACE)] = BLANK
    table[0x20], table[0x27] = SPACE, APOSTROPHE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token begins at this character)."""
    if symbol == S_END:
        return FRESH, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if symbol in (S_LETTER, S_NUMBER, S_OTHER, S_ENDING2, S_ENDING3):
        run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS}.get(symbol, IN_OTHER)
        if state in (run, AFTER_JOINED):
            return run, False
        return {S_ENDING2: ONE_LEFT, S_ENDING3: TWO_LEFT}.get(symbol, run), True
    if symbol == S_JOINED:
        return AFTER_JOINED, True
    if symbol == S_SINGLE:
        return FRESH, True
    return IN_RUN, state != IN_RUN


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transitions and starts by state and symbol; the closure of the symbols' functions under composition.

    functions[f] maps states; then_symbol[f, s] is f followed by symbol s; then[f, g] is f followed by g.
    """
    step = np.array([[_step(q, s)[0] for s in range(N_SYMBOLS)] for q in range(N_STATES)], np.uint8)
    begins = np.array([[_step(q, s)[1] for s in range(N_SYMBOLS)] for q in range(N_STATES)], bool)
    ids = {tuple(range(N_STATES)): 0}  # the identity first
    todo = list(ids)
    while todo:
        f = todo.pop()
        for s in range(N_SYMBOLS):
            g = tuple(int(step[q, s]) for q in f)
            if g not in ids:
                ids[g] = len(ids)
                todo.append(g)
    functions = np.array(list(ids), np.uint8)
    then_symbol = np.array([[ids[tuple(int(step[q, s]) for q in f)] for s in range(N_SYMBOLS)] for f in ids], np.uint16)
    then = np.array([[ids[tuple(g[q] for q in f)] for g in ids] for f in ids], np.uint16)
    return step, begins, functions, then_symbol, then


def symbols(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbol of each code point; past the last one the text is taken to end."""
    after = np.append(classes[1:], np.uint8(END))
    out = np.take(np.array([S_LETTER, S_NUMBER, S_JOINED, S_SINGLE, S_OTHER, S_OTHER, S_END], np.uint8), classes)
    blank = (classes == SPACE) | (classes == BLANK)
    out[blank & ((after == SPACE) | (after == BLANK) | (after == END))] = S_RUN
    at = np.flatnonzero(classes == APOSTROPHE)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        e, l = ord("e"), ord("l")
        three = (((one == ord("r")) | (one == ord("v"))) & (two == e)) | ((one == l) & (two == l))
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = S_ENDING2
        out[at[three]] = S_ENDING3
    return out


def token_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Indices at which tokens begin; the scan over composed transition functions."""
    step, begins, functions, then_symbol, then = _tables()
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, S_END, np.uint8)
    padded[:n] = symbols(points, classes)
    lanes = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)  # one lane a block
    # Each block's function, all blocks side by side.
    flat, total = then_symbol.ravel(), np.zeros(blocks, np.uint16)
    for row in lanes:
        total = flat[total.astype(np.int32) * N_SYMBOLS + row]
    # Inclusive scan by doubling; composition is associative.
    m, flat, width = len(functions), then.ravel(), 1
    while width < blocks:
        total = np.concatenate([total[:width], flat[total[:-width].astype(np.int64) * m + total[width:]]])
        width *= 2
    state = np.concatenate([np.array([FRESH], np.uint8), functions[total[:-1], FRESH]])
    marks = np.empty((BLOCK, blocks), bool)
    flat_step, flat_begins = step.ravel(), begins.ravel()
    for j, row in enumerate(lanes):
        at = state * np.uint8(N_SYMBOLS) + row
        marks[j] = flat_begins[at]
        state = flat_step[at]
    return np.flatnonzero(np.ascontiguousarray(marks.T).ravel()[:n])


class Merger(dict):
    """Bytes of a pre-token -> its ids as little-endian 32-bit integers; merges once and remembers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    return _merge_short(piece, ranks) if len(piece) <= CACHE_BYTES else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Parts and their pairs' ranks in lists; a merge changes two ranks."""
    never, get = len(ranks), ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == never:
            break
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], never)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], never)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A heap of pairs over a linked list: n log n for the longest runs."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n  # end[i] is 0 once i has merged away
        if j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _slices(text: str, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Pre-tokens of texts joined by one character each, at ``ends``; their indices' starts in code points."""
    points, raw = _points(text), text.encode()
    classes = np.take(code_point_classes(), points)
    classes[ends] = END
    starts = token_starts(points, classes)
    bounds = np.append(starts, len(points))
    if len(raw) != len(points):
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        bounds = np.concatenate([[0], np.cumsum(width)])[bounds]
    cuts = bounds.tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])], starts


def _encode_long(text: str, merger: Merger) -> bytes:
    """One long text in windows.  A token's start is as good as a text's, so each window begins at the last start seen."""
    out, at = [], 0
    while at < len(text):
        width = WINDOW
        while True:
            part = text[at : at + width + 3]
            pieces, starts = _slices(part, np.zeros(0, np.int64))
            if at + len(part) >= len(text):
                return b"".join([*out, *map(merger.__getitem__, pieces)])
            # Starts this close to the cut may change with what follows.
            sure = int(np.searchsorted(starts, len(part) - 3))
            if sure > 1:
                break
            width *= 2  # one token fills the window
        out += map(merger.__getitem__, pieces[: sure - 1])
        at += int(starts[sure - 1])
    return b"".join(out)


def encode_texts(texts: Iterable[str | None], merger: Merger) -> Iterator[bytes]:
    """Packed ids of each text, in order; a null text is empty.  Short texts share one scan."""
    batch: list[str] = []
    held = 0

    def flush() -> Iterator[bytes]:
        joined = "\n".join([*batch, ""])
        ends = np.cumsum([len(t) + 1 for t in batch]) - 1
        pieces, starts = _slices(joined, ends)
        packed = list(map(merger.__getitem__, pieces))
        a = 0
        for b in np.searchsorted(starts, ends).tolist():  # each text's end is a token of its own
            yield b"".join(packed[a:b])
            a = b + 1

    for text in texts:
        text = text or ""
        if batch and held + len(text) > WINDOW:
            yield from flush()
            batch, held = [], 0
        if len(text) > WINDOW:
            yield _encode_long(text, merger)
            continue
        batch.append(text)
        held += len(text) + 1
    if batch:
        yield from flush()


class Decoder:
    """Ids -> bytes by one gather over the vocabulary's bytes laid end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token begins in the decoded text."""
        lengths = self.lengths[ids]
        return np.cumsum(lengths) - lengths

    def __call__(self, ids: np.ndarray) -> bytes:
        out = []
        for a in range(0, len(ids), WINDOW):
            part = ids[a : a + WINDOW]
            lengths = self.lengths[part]
            shift = self.places[part] - (np.cumsum(lengths) - lengths)
            out.append(self.raw[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].tobytes())
        return b"".join(out)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base-64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _arrow(df: DataFrame, ranks: dict[bytes, int], schema: str, row, text_col: str, id_col: str) -> DataFrame:
    """Each row's (id, ids, merger, decoder) through ``row``; ranks are a vocabulary file, a bound of a few MB."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, decoder = Merger(shared.value), Decoder(shared.value)
        for batch in stream:
            keys, values = batch.column(0), batch.column(1)
            texts = (values[i].as_py() for i in range(len(values)))
            rows = [row(np.frombuffer(ids, "<u4"), decoder) for ids in encode_texts(texts, merger)]
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(row.types)]], [id_col, *names])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(batches, f"`{id_col}` {kind}, {schema}")


class _Encoded:
    types = (pa.list_(pa.int32()), pa.list_(pa.int32()))

    def __call__(self, ids: np.ndarray, decoder: Decoder):
        return ids.astype(np.int32), decoder.offsets(ids).astype(np.int32)


class _Digest:
    types = (pa.int64(), pa.string(), pa.string())

    def __call__(self, ids: np.ndarray, decoder: Decoder):
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoder(ids)).hexdigest()


def encode(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<int>): each token's id and the byte at which it begins.

    Null and empty texts give empty arrays; rows repeat as they do in the input; further columns are dropped.
    """
    return _arrow(df, ranks, "ids array<int>, offsets array<int>", _Encoded(), text_col, id_col)


def decode(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, raw binary): the bytes that the ids stand for; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in stream:
            raw = [None if not x.is_valid else decoder(np.asarray(x.values, np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "raw"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, ids_col).mapInArrow(batches, f"`{id_col}` {kind}, raw binary")


def round_trip(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, in one pass.

    Null texts count as empty ones: no tokens and the digests of no bytes.  Very long texts are encoded whole; repeated
    rows, and rows without an id, each give a row; further columns are dropped; an empty table gives no rows.
    """
    return _arrow(df, ranks, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _Digest(), text_col, id_col)
