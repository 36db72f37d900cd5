"""Ball k-means, the language network and spelling variants against brute force, gradients and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from calorine.llm import ball_kmeans, language_id, queries, spelling

D = "/root/testdata/sf0.001"


def brute_kmeans(vectors, k, rounds, dims, seed="1"):
    """vectors: (id, components), those that count."""
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors]
    centres = [v for _, _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, v) for i, v in whole if i is not None)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for t in range(rounds + 1):
        at = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in whole]
        if t < rounds:
            for c in set(at):
                own = [v for (_, v), a in zip(whole, at) if a == c]
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    inertia = Counter()
    for (_, v), a in zip(whole, at):
        inertia[a] += far(v, centres[a])
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, a, far(v, centres[a]), inertia[a], sum(inertia.values()), sha[a]) for (i, v), a in zip(whole, at)), key=repr)


@pytest.mark.parametrize("k", [1, 5, 16, 300])
def test_kmeans_against_all_distances(spark, k):
    rng = np.random.default_rng(k)
    spots = rng.normal(size=(6, 4))
    rows = [(i, [float(x) for x in spots[rng.integers(6)] + 0.05 * rng.normal(size=4)], 1, "c") for i in range(200)]
    rows += [(300 + i, [0.5, 0.5, 0.0, float(i % 2)], 1, "c") for i in range(40)]  # ties and copies
    rows += [(7, rows[7][1], 2, "c"), (None, [0.25, -0.0, 1e-40, -1e-40], 1, "c")]
    odd = [(900, None, 1, "c"), (901, [], 1, "c"), (902, [1.0, 2.0, 3.0], 1, "c"), (903, [1.0, None, 3.0, 4.0], 1, "c"), (904, [1.0, float("nan"), 3.0, 4.0], 1, "c"), (905, [1.0, float("inf"), 3.0, 4.0], 1, "c"), (906, [0.0] * 5, 1, "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster int, v string")
    got = ball_kmeans.cluster(df, k=k, dims=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_kmeans([r[:2] for r in rows], k, 3, 4)


def test_kmeans_balls_compare_less_and_the_same():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (16, 64))
    points = np.concatenate([c + rng.integers(-20, 20, (50, 64)) for c in centres])
    points = np.concatenate([points, (centres[:8] + centres[8:]) // 2, centres])
    at, best, _ = ball_kmeans.nearest(points, centres)
    start = rng.integers(0, 16, len(points)).astype(np.int32)
    for a in (start, at):
        moved, distance, made = ball_kmeans.moved(points, a, centres)
        assert (moved == at).all() and (distance == best).all()
    assert made < 3 * len(points)


def test_kmeans_edges(spark):
    shape = "vec_id long, embedding array<float>"
    assert ball_kmeans.cluster(spark.createDataFrame([], shape), dims=2).count() == 0
    assert ball_kmeans.cluster(spark.createDataFrame([(None, [1.0, 2.0])], shape), dims=2).count() == 0
    huge = ball_kmeans.cluster(spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], shape), k=2, dims=2)
    assert {r.vec_id for r in huge.collect()} == {1, 2, 3} and all(r.distance >= 0 and r.inertia >= r.cluster_inertia for r in huge.collect())


def test_network_gradients():
    rng = np.random.default_rng(0)
    model = language_id.Model.fresh(["a", "b", "c"], states=3)
    codes = rng.integers(0, 5, (7, 4)).astype(np.uint8)
    w, u = model.w[0].astype(np.float64), model.u[0].astype(np.float64)
    pull = rng.normal(size=(7, 4, 3))

    def loss(w, u):
        h, total = np.zeros((4, 3)), 0.0
        for t in range(7):
            keep, let = (language_id.gate(w[g][codes[t]] + h @ u[g]) for g in range(2))
            new = language_id.soft(w[2][codes[t]] + let * (h @ u[2]))
            h = new + keep * (h - new)
            total += (h * pull[t]).sum()
        return total

    trace = []
    language_id.read(model.w[0], model.u[0], codes, trace)
    dw, du = language_id.unread(model.u[0], codes, trace, pull.astype(np.float32))
    for part, got in ((w, dw), (u, du)):
        for _ in range(40):
            at = tuple(rng.integers(0, min(n, 5)) for n in part.shape)
            kept = part[at]
            part[at] = kept + 1e-5
            up = loss(w, u)
            part[at] = kept - 1e-5
            down = loss(w, u)
            part[at] = kept
            assert abs((up - down) / 2e-5 - got[at]) < 1e-2 * (1 + abs(got[at]))


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    tested = [r for r in rows if r.lang and r.text and language_id.has_letter(r.text) and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(tested) > 100 and all(got[r.doc_id].held_out for r in tested) and sum(r.held_out for r in got.values()) < 0.4 * len(rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 and 0 <= r.agreeing <= 1 for r in got.values())


def test_language_edges(spark):
    shape = "doc_id long, text string, lang string, source string, score double"
    words = {"xx": "zul mor tak bren", "yy": "aeia ouio eaue ioao"}
    rows = [(i, " ".join(random.Random(i).choices(words[g].split(), k=60)), g, g, 0.0) for i in range(120) for g in (("xx", "yy")[i % 2],)]
    train = spark.createDataFrame(rows, shape)
    model = language_id.fit(train, steps=120)
    assert model.langs == ["xx", "yy"]
    long = "aeia ouio " * 30_000
    odd = [(1, None), (2, ""), (3, " 12 $% \n"), (4, "½ ² _ 5"), (5, "é"), (6, long), (7, "TAK ZUL mor bren tak zul"), (7, "TAK ZUL mor bren tak zul"), (None, "ouio eaue ioao ouio"), (9, "zul tak " * 40 + "aeia")]
    got = language_id.predict(spark.createDataFrame([(i, t, "xx", "s", 0.0) for i, t in odd], shape), model).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and [by[i].score for i in (1, 2, 3, 4)] == [0.0] * 4
    assert by[5].lang_pred in ("xx", "yy") and by[6].lang_pred == "yy" and by[6].letters == 240_000 and by[7].lang_pred == "xx" and by[None].lang_pred == "yy" and by[None].held_out is False and by[9].lang_pred == "xx"
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 7}) == 1
    assert language_id.predict(train.limit(0), model).count() == 0
    for unlearned in (train.limit(0), train.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"), spark.createDataFrame([(3, "12", "xx", "", 0.0)], shape)):
        model = language_id.fit(unlearned)
        assert model.langs == [] and [r.lang_pred for r in language_id.predict(train.limit(2), model).collect()] == ["und"] * 2


def test_language_and_score_use_the_text_alone(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = language_id.fit(docs, steps=60)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    other = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'fr' AS lang", "'x' AS source")
    assert {r.doc_id - 1000: (r.lang_pred, r.score) for r in language_id.predict(other, model).collect()} == plain


def brute_pairs(words):
    """Near pairs by edits, shorter or smaller word first."""
    out = set()
    for a in words:
        for k in range(len(a)):
            if a[:k] + a[k + 1 :] in words:
                out.add((a[:k] + a[k + 1 :], a))
        for b in words:
            if len(a) == len(b) and a < b and sum(x != y for x, y in zip(a, b)) == 1:
                out.add((a, b))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_trie_finds_every_pair_once(seed):
    rng = random.Random(seed)
    n, letters = rng.randint(1, 7), "abcé"[: rng.randint(1, 4)]
    words = list({"".join(rng.choice(letters) for _ in range(rng.choice((n, n + 1)))) for _ in range(rng.randint(2, 70))})
    got = [(words[i], words[j]) for i, j in spelling.near_pairs(words, n, n + 1)]
    got = [tuple(sorted(p)) if len(p[0]) == len(p[1]) else p for p in got]
    assert len(got) == len(set(got)) and set(got) == {p for p in brute_pairs(set(words)) if len(p[0]) == n}


def brute_variants(docs, least=5, times=5):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                at = h % len(run)
                counts[run if h % 199 else run[:at] + run[at + 1 :]] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    near = {w: [] for w in words}
    for a, b in brute_pairs(set(words)):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


@pytest.mark.parametrize("room", [150_000, 40, 1])
def test_variants_against_brute_force(spark, room):
    rng = random.Random(5)
    base = ["attention", "ÉTAGÈRE", "mississippi", "aaaaaa", "banana", "Straße×÷", "zzzzzzzzzzzzzzzz"]
    docs = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.3:
                k, how = rng.randrange(len(w)), rng.randrange(3)
                w = w[:k] + rng.choice(("", "a", "é", "S")) + w[k + (how > 0) :]
            words.append(w)
        docs.append((i, rng.choice((" ", "-", "\n", "1")).join(words), "w", 1))
    docs += [(0, docs[0][1], "w", 1), (1, docs[1][1], "w", 1), (None, docs[2][1], "w", 1), (900, None, "w", 1), (901, "", "w", 1), (902, "12 ½", "w", 1)] + [(910 + i, "x" * 3000 + " " + "x" * 2999 + "y", "w", 1) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n int")
    got = spelling.variants(df, room=room).collect()
    want = brute_variants([d[:2] for d in docs])
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == want
    assert any(f for _, f, *_ in want) and any(near > 3 for *_, near, _ in want)


def test_roots_follow_long_chains(spark):
    text = " ".join(w for n, w in enumerate(["abcdefgh", "abcdefg", "abcdef"]) for _ in range(5 ** (n + 1)))
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame([(11, text)], "doc_id long, text string")).collect()}
    want = {w: (f or None, root) for w, f, root, *_ in brute_variants([(11, text)])}
    assert got == want and got["abcdefgh"] == ("abcdefg", "abcdef")
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op13_spelling_variants"])
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in cursor.description)
    want = sorted((tuple(dict(zip([d[0] for d in cursor.description], r))[c] for c in names) for r in cursor.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, D)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want and sorted(df.columns) == names


def test_vector_dedup_tells_the_recall_of_its_audits(spark):
    from calorine.llm import vector_dedup

    rng = np.random.default_rng(9)
    base = rng.normal(size=(200, 8))
    rows = [(i, [float(x) for x in base[i % 200] + 0.02 * rng.normal(size=8)]) for i in range(800)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len({r.audit_recall for r in got}) == 1 and 0.98 <= got[0].audit_recall <= 1
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
