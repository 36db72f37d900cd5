"""BPE, token counts, toxicity, n-gram join, decontamination and the pipeline against brute force and exact round trips."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402

from calorine.llm import bpe, decontaminate, ngram_join, token_counts, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'stmdrevlE  \n\t1٣é漢😀.,!-　\xa0\x00"), max_size=40), max_size=6))
def test_encoding_equals_the_library(texts):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merger, decoder = bpe.Merger(ranks), bpe.Decoder(ranks)
    for text, packed in zip(texts, bpe.encode_texts(texts, merger), strict=True):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert decoder(ids) == text.encode()


def test_every_seventh_code_point(ranks, reference):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = [f"a{chr(c)}a 1{chr(c)}1" for c in points]
    for text, packed in zip(texts, bpe.encode_texts(texts, bpe.Merger(ranks)), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)


def test_windows_and_long_runs(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 64)
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab'sre  \n1é.", k=rng.randrange(400))) for _ in range(300)] + ["a" * 3000, " " * 2000 + "x", "'" * 500]
    for text, packed in zip(texts, bpe.encode_texts(texts, bpe.Merger(ranks)), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)


def test_scan_is_associative():
    *_, then_symbol, then = bpe._tables()
    rng = np.random.default_rng(0)
    f, g, h = rng.integers(0, len(then), (3, 500))
    assert (then[then[f, g], h] == then[f, then[g, h]]).all()


def test_encode_decode_tables(spark, ranks, reference):
    rows = [(1, "Hello 'there's  x\n", "en"), (2, None, "en"), (2, "", None), (None, "é" * 50, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(df, ranks)
    got = encoded.collect()
    assert sorted(len(r.ids) for r in got) == [0, 0, *sorted(len(reference.encode_ordinary(t)) for _, t, _ in rows if t)]
    for r in got:
        assert r.offsets == list(np.cumsum([0, *(len(reference.decode_single_token_bytes(i)) for i in r.ids)])[:-1])
    assert sorted(bytes(r.raw) for r in bpe.decode(encoded, ranks).collect()) == sorted((t or "").encode() for _, t, _ in rows)
    (first,) = (r for r in bpe.round_trip(df, ranks).collect() if r.doc_id == 1)
    ids = reference.encode_ordinary(rows[0][1])
    assert (first.n_tokens, first.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert first.decoded_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), ranks).count() == 0


def plain_count(word, scores, byte):
    """Best segmentation by trying them all."""
    text = token_counts.MARK + word
    best = None
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        score, n = 0.0, 0
        for a, b in zip(ends, ends[1:]):
            piece = text[a:b]
            if piece in scores:
                score, n = score + scores[piece], n + 1
            elif len(piece) == 1:
                size = len(piece.encode())
                score, n = score + size * byte, n + size
            else:
                break
        else:
            if best is None or score > best[0] + 1e-12 or abs(score - best[0]) <= 1e-12 and n < best[1]:
                best = (score, n)
    return best[1]


def test_token_counts_against_all_segmentations():
    rng = random.Random(5)
    pieces = {"".join(rng.choices("▁abc", k=rng.randrange(1, 4))) for _ in range(30)} - {"c"}
    scores = {p: -math.log(i + 2.7) for i, p in enumerate(sorted(pieces))}
    trie = token_counts.Trie(scores)
    for word in ["".join(rng.choices("abcé", k=rng.randrange(1, 8))) for _ in range(200)]:
        assert trie.count(word) == plain_count(word, scores, trie.byte)


def test_token_counts_table(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_NODES", 3)
    scores = {"▁": -1.0, "a": -1.5, "▁a": -2.0}
    df = spark.createDataFrame([(1, "a aa\n a"), (2, None), (3, " "), (1, "b" * 12_000), (None, "é")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_tokens) for r in token_counts.token_counts(df, scores).collect())
    assert got == [(0, 0), (0, 0), (1, 3), (1, 12_001), (3, 4)]
    assert token_counts.token_counts(df.limit(0), scores).count() == 0


def make_docs(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, common = [], " ".join(rng.choices(vocabulary, k=25))
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            base = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
        else:
            own = rng.choices(vocabulary, k=rng.randrange(1, words))
            texts.append(" ".join(own) + (" " + common if kind < 0.75 else ""))
    return [(i * 3, t.upper() if i % 5 == 0 else t) for i, t in enumerate(texts)]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = tuple((t or "").encode().lower().split())
        sets[i] = frozenset(w[j : j + k] for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([w] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60), (4, 1, 80), (5, 2, 85)])
def test_ngram_join_against_all_pairs(spark, seed, k, percent):
    rows = make_docs(seed, 220)
    rows += [(10_000, None), (10_001, ""), (10_002, "  \n"), (10_003, "one two"), (10_004, "ONE two"), (10_005, "é È")]
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, percent)


def near_copies(seed, n):
    """Copies of one text with one to eight words replaced, some of them once more, and a passage that many texts hold."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for _ in range(n):
        words = (rng.choice(texts) if rng.random() < 0.3 else " ".join(base)).split()
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = rng.choice(("b5", "of", f"r{rng.randrange(500)}"))
        texts.append(" ".join(words[: rng.randrange(100, 121)]))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10_000)}" for _ in range(rng.randrange(0, 12))) for _ in range(n)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "k", "percent", "meeting"), [(1, 4, 85, 1000), (2, 5, 80, 3), (3, 4, 85, 3)])
def test_ngram_join_in_groups_of_copies(spark, monkeypatch, seed, k, percent, meeting):
    monkeypatch.setattr(ngram_join, "ROOM", meeting)
    rows = near_copies(seed, 110)
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, percent)


def test_ngram_join_ships_texts_in_proportion_to_a_group(spark, monkeypatch):
    """Groups of edited copies: a text goes to few rooms however large its group, and no pair is written out."""
    shipped = []
    whole = ngram_join._links

    def counted(met, *rest):
        shipped.append(met.count())
        return whole(met, *rest)

    monkeypatch.setattr(ngram_join, "_links", counted)
    each = {}
    for n in (200, 800):
        rows = near_copies(7, n)[: 2 * n]
        shipped.clear()
        ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80)
        each[n] = sum(shipped) / len(rows)
    assert each[200] < 6 and each[800] < 6


def test_ngram_join_of_very_long_and_tied_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(4000)}" for _ in range(60_000)]
    close = list(words)
    close[30_000:30_100] = [f"x{i}" for i in range(100)]
    far = words[:30_000]
    rows = [(5, " ".join(words)), (3, " ".join(close)), (9, " ".join(far)), (7, " ".join(words)), (1, "x")]
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 3, 3: 3, 7: 3, 9: 9, 1: 1}


def test_sketches_of_any_size_give_the_same(spark, monkeypatch):
    rows = near_copies(4, 60)
    want = brute_components(rows, 4, 85)
    for bits in (2, 20):
        monkeypatch.setattr(ngram_join, "LEAST_BITS", bits)
        monkeypatch.setattr(ngram_join, "MOST_BITS", bits)
        got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_overlaps_are_set_sizes():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in rng.integers(0, 50, 30)]
    got = ngram_join.overlaps(sets, np.array([3, 1, 7]), np.arange(30), width=7)
    assert (got == [[len(np.intersect1d(sets[i], s)) for s in sets] for i in (3, 1, 7)]).all()


def test_ngram_join_edges(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")]
    got = ngram_join.join_components(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, token string"), 4, 85).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]
    assert ngram_join.join_components(spark.createDataFrame([], "doc_id long, text string"), 4, 85).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_prefixes_share_enough(percent):
    """Similar sets share l prefix tokens under every order, and no leading token of one that no other prefix holds."""
    rng = np.random.default_rng(3)
    orders = ngram_join.Orders(rng.choice([1, 2, 50, 90], 1 << 22))
    tested = 0
    for _ in range(2000):
        n = int(rng.integers(1, 200))
        every = np.unique(ngram_join.mix(rng.integers(0, 2**63, n).astype(np.uint64)))
        a, b = (np.sort(every[rng.random(len(every)) > rng.random() * 0.2]) for _ in range(2))
        common = len(np.intersect1d(a, b))
        if not len(a) or not len(b) or 100 * common < percent * (len(a) + len(b) - common):
            continue
        tested += 1
        least = ngram_join.least_common(min(len(a), len(b)), percent)
        for o in range(3):
            p, q = (orders.prefix(x, ngram_join.prefix_size(len(x), percent), o) for x in (a, b))
            assert len(np.intersect1d(p, q)) >= min(least, common)
            lead = p[: ngram_join.least_common(len(a), percent) - 1]
            assert not set(lead[~np.isin(lead, q)].tolist()) & set(b.tolist())
    assert tested > 300


def test_decontamination_finds_items_and_spares_the_rest(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(15, 60)))) for i in range(40)] + [(90, "x1 x2 x3"), (91, None), (92, "")]
    docs, want = [], {}
    for d in range(200):
        words = rng.choices(vocabulary, k=rng.randrange(0, 300))
        if d % 4 == 0:
            item, text = items[rng.randrange(40)]
            at = rng.randrange(len(words) + 1)
            part = text.upper().replace(" ", ", ").split()
            words[at:at] = part if d % 8 else part[: int(len(part) * 0.4)]
            if d % 8:
                want[d] = item
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "zz x1 X2 x3 yy"), (903, items[0][1].rsplit(" ", 1)[0])]
    want |= {902: 90, 903: 0}
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_id for r in found} == want
    assert all(0.8 <= r.similarity <= 1 for r in found)
    kept = decontaminate.clean(spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - set(want)
    assert kept.columns == ["doc_id", "text", "item_id"]


def test_decontamination_against_every_window():
    """All windows of each item's size, compared by multiset Jaccard."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((12, 20, 30, 30))]
    index = decontaminate.Index(items)
    from collections import Counter

    for _ in range(60):
        words = rng.choices(vocabulary, k=80)
        part = rng.choice(items)[1].split()
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = rng.choice(vocabulary)
        words[20:20] = part
        hashes = decontaminate.word_hashes(" ".join(words))
        want = {}
        for i, t in items:
            own = decontaminate.shingles(decontaminate.word_hashes(t)).tolist()
            every = decontaminate.shingles(hashes).tolist()
            best = max(decontaminate.similarity(Counter(every[a : a + len(own)]), Counter(own)) for a in range(len(every) - len(own) + 1))
            if best >= 0.8:
                want[i] = round(best, 6)
        assert {h[0]: h[3] for h in index.hits(hashes)} == want


def edited(rng, item, vocabulary, edits):
    words = list(item)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


def test_blocks_find_all_within_the_radius_and_little_else():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 16, (3000, decontaminate.BLOCKS)).astype(np.uint16)
    index = decontaminate.Blocks(items)
    flips = np.zeros((500, 64), np.uint8)
    for i, row in enumerate(flips):
        row[rng.choice(64, i % (decontaminate.RADIUS + 3), replace=False)] = 1
    queries = items[:500] ^ np.packbits(flips, axis=1).view(np.uint16)
    q, i = index.candidates(queries)
    assert len(q) < 0.05 * len(queries) * len(items)
    distance = np.bitwise_count(queries[:, None, :] ^ items[None, :, :]).sum(2)
    assert set(zip(*(x.tolist() for x in index.within(queries)))) == set(zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS))))


def test_index_beats_comparing_all_fingerprints():
    import time

    rng = np.random.default_rng(2)
    items, queries = (rng.integers(0, 1 << 16, (n, decontaminate.BLOCKS)).astype(np.uint16) for n in (20_000, 256))
    index = decontaminate.Blocks(items)

    def scan():
        return np.nonzero(np.bitwise_count(queries.view(np.uint64).ravel()[:, None] ^ items.view(np.uint64).ravel()[None, :]) <= decontaminate.RADIUS)

    took = {}
    for name, f in (("index", lambda: index.within(queries)), ("scan", scan)):
        times = []
        for _ in range(5):
            start = time.process_time()
            found = f()
            times.append(time.process_time() - start)
        took[name] = min(times), list(zip(*(x.tolist() for x in found)))
    assert took["index"][1] == took["scan"][1] and took["index"][0] < took["scan"][0]


@pytest.mark.parametrize("scan", [0, 10_000])
def test_no_similar_window_is_lost(monkeypatch, scan):
    """Windows whose multiset similarity is 0.8 or more are found all, also where the fingerprints are beyond the radius."""
    monkeypatch.setattr(decontaminate, "SCAN", scan)
    monkeypatch.setattr(decontaminate, "RADIUS", 8)  # so that many are beyond it
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [rng.choices(vocabulary, k=rng.randrange(20, 40)) for _ in range(600)]
    items += [edited(rng, item, vocabulary, 1) for item in items[:200]]  # items like one another
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    counted = [decontaminate.Counter(decontaminate.shingles(decontaminate.word_hashes(" ".join(w))).tolist()) for w in items]
    far = total = 0
    for i, item in enumerate(items):
        hashes = decontaminate.word_hashes(" ".join(edited(rng, item, vocabulary, rng.randrange(1, 3))))
        own = decontaminate.shingles(hashes)
        want = {j for j, c in enumerate(counted) if sum(c.values()) == len(own) and decontaminate.similarity(decontaminate.Counter(own.tolist()), c) >= 0.8}
        assert want <= {h[0] for h in index.hits(hashes)}
        if i in want:
            total += 1
            x, y = (decontaminate.fingerprints(s, np.zeros(1, np.int64), len(own))[0] for s in (own, decontaminate.shingles(decontaminate.word_hashes(" ".join(item)))))
            far += int(np.bitwise_count(x ^ y).sum()) > decontaminate.RADIUS
    assert total > 50 and far > 10


def test_decontamination_ties_long_texts_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(20)]
    docs = [(1, "a b c " + items[3][1] + " d e f " + items[3][1]), (2, " ".join(rng.choices(vocabulary, k=60_000)) + " " + items[7][1] + " x"), (3, "x " * 50_000)]
    tables = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(3, items[3][1])], "item_id long, text string")]
    got = sorted((r.doc_id, r.item_id, r.first_word) for r in decontaminate.find(*tables).collect())
    assert got == [(1, 3, 3), (2, 7, 60_000)]
    monkeypatch.setattr(decontaminate, "WORDS_A_BLOCK", 500)
    assert sorted((r.doc_id, r.item_id, r.first_word) for r in decontaminate.find(*tables).distinct().collect()) == got
    assert [r.doc_id for r in decontaminate.clean(*tables).collect()] == [3]


def toxic_tables(spark, n=600):
    rng = random.Random(9)
    plain, bad = [f"word{i}" for i in range(200)], ["nasty", "vilest", "vilesten"]
    docs, labels = [], []
    for d in range(n):
        lines = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randrange(1, 8))]
        y = int(d % 5 == 0)
        if y:
            at = rng.randrange(len(lines))
            lines[at] += " " + rng.choice(bad)
        docs.append((d, ". ".join(lines), "xx", "s", 0))
        labels.append((d, 1, y))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.judge(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    for r in rows:
        if r.predicted and r.toxic:
            assert any(w in r.text[r.worst_start : r.worst_end] for w in ("nasty", "viles"))


def plain_score(text, model):
    """The noisy-or over sentences, sentence by sentence and word by word."""
    import math
    import re

    survive, seen = 1.0, 0
    for m in re.finditer(r"[^.!?\n]+[.!?]*", text or ""):
        words = re.findall(r"\w+", m[0].lower())
        if words:
            seen += 1
            found = {f for w in words for f in [f"w:{w}", *(f"{n}:{w[:n]}" for n in (4, 5, 6, 7) if len(w) >= n)]}
            survive *= 1 - 1 / (1 + math.exp(-model.bias - sum(model.weights.get(f, 0) for f in found)))
    return 1 - survive * (1 if seen else 1 - 1 / (1 + math.exp(-model.bias)))


def test_toxicity_against_a_plain_noisy_or(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    rng = random.Random(2)
    texts = [r.text for r in docs.collect()] + [None, "", " ..!\n", "nasty\nVILEST! word1 nasty. İ nasty", ". ".join(rng.choice(("word1 word2", "nasty word3", "a vilest")) for _ in range(20_000))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.judge(table, model).collect():
        assert abs(r.score - plain_score(texts[r.doc_id], model)) < 1e-9
        assert r.predicted == int(r.score >= 0.3)
    kept = toxicity.clean(table.withColumns({"score": F.lit(1), "n_sentences": F.lit("x"), "a.b": F.lit(2)}), model)
    assert kept.columns == ["doc_id", "text", "score", "n_sentences", "a.b"]
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if plain_score(t, model) < 0.3}


def test_toxicity_sample_is_bounded(spark):
    docs, labels = toxic_tables(spark, 1200)
    whole = sum(len(r.text) for r in docs.collect())
    half = toxicity.fit(docs, labels, max_bytes=whole // 3)
    few = toxicity.fit(docs, labels, max_docs=300)
    for model in (half, few):
        assert model.weights and model != toxicity.fit(docs, labels)


def test_toxicity_edges(spark):
    docs, labels = toxic_tables(spark, 200)
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "İ nasty thing!"), (2, "...")], "doc_id long, text string")
    got = toxicity.judge(odd, model).collect()
    assert len(got) == 4
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert toxicity.fit(docs, labels.limit(0)).weights == {}
    assert toxicity.judge(docs.limit(0), model).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, nulls).weights == {}


def test_held_out_rows_never_teach(spark):
    docs, labels = toxic_tables(spark, 300)
    flipped = labels.withColumn("toxic", F.expr("CASE WHEN pmod(crc32(cast(doc_id AS string)), 4) = 2 THEN 1 - toxic ELSE toxic END"))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_noisy_or_gradient():
    """A step along the gradient agrees with finite differences: the loss falls and the weight of the telling word rises."""
    bags = [(1, 3, [(0, [0])]), (0, 3, [(1, [1])]), (1, 2, [(0, [0, 1])]), (0, 2, [])]
    bias, w = toxicity._train(bags, 2)
    assert w[0] > 3 > w[1]
    assert bias <= -2
