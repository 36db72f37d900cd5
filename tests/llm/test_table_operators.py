"""URL rules, sharding, archives, HTML text and vector near-dedup against brute force and round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorine.llm import components, html_text, sharding, url_filter, vector_dedup, warc

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


@pytest.mark.parametrize("seed", [1, 2])
def test_url_rules_against_every_rule(spark, seed):
    rng = random.Random(seed)
    hosts = ["com", "org", "a.com", "b.a.com", "example.org", "x.example.org", "notexample.org", "EXAMPLE.org", ""]
    paths = ["", "/", "/d", "/de/", "/de/x", "/en/1", "/en/12", "/es", "/es/", "/é/", "/de/x/y"]
    rules = {(rng.choice(hosts[:6]), rng.choice(paths)): rng.choice(("allow", "block")) for _ in range(25)}
    rules = [(v, h, p) for (h, p), v in rules.items()] if seed == 1 else RULES
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=://x/de/', '#/es/'])}" for _ in range(400)]
    urls += [None, "", "no scheme/de/", "://", "a://b://c/de/", "http://com/de/" + "x" * 20_000, "http://a.com./de/", "http://com/de/\U0010ffffx", "http://a.com\U0010ffff/de/", "http://.com/de/"]
    urls += [f"http://{'.'.join(rng.choice('abc') for _ in range(n))}.a.com/de/" for n in range(1, 40)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules), room=7).collect()}
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, "http://org/"), (1, "http://org/"), (None, "http://org/")], "page_id long, url string")
    assert sorted(r.verdict for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, [("block", "org", "/"), ("allow", "org", "/")])).collect()) == ["block"] * 3
    assert [r.verdict for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, []), default="block").collect()] == ["block"] * 3
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, RULES)).count() == 0
    plan = url_filter.judge_urls(pages, url_filter.rule_table(spark, RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    rows = sharding.hilbert_table(spark, dims, bits).orderBy("cell").toPandas()
    code = rows["code"].to_numpy()
    points = np.stack([code >> bits * (dims - 1 - i) & (1 << bits) - 1 for i in range(dims)], 1)
    assert sorted(rows["cell"]) == list(range(1 << dims * bits))
    assert (np.abs(np.diff(points, axis=0)).sum(1) == 1).all()


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SALTED", 10)
    rows = [(i, "héllo" * (i % 50), f"l{i % 3}" if i % 7 else None, f"s{i % 11}" if i % 3 else "hot") for i in range(1003)]
    rows += [(5, None, None, None), (None, "x", "l", "s"), (5, None, None, None), (7777, "y" * 300_000, "l", "s")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, shard string").repartition(7)
    got = sharding.assign_shards(docs, 24).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 8, __import__("zlib").crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.assign_shards(docs.limit(0), 24).count() == 0
    few = sharding.assign_shards(docs.limit(3), 24).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)


def hilbert_index(point, bits):
    """A point's place on the curve, by turning and mirroring the cube from the highest bit down."""
    x = list(point)
    q = 1 << bits - 1
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & q - 1
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << bits - 1
    while q > 1:
        t ^= q - 1 if x[-1] & q else 0
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_shards_follow_the_curve(spark):
    """In the order of shard and slot, no row is before another of a smaller place on the curve."""
    import math

    rng = random.Random(4)
    rows = [(i, "x" * rng.choice((0, 3, 20, 500, 70_000 if i % 40 == 0 else 90)), rng.choice(("en", "de", "fr", None)), rng.choice([f"s{j:02}" for j in range(40)] + ["hot"] * 30)) for i in range(900)]
    rows += [(None, "x", "en", "hot"), (5, "x", "en", "hot"), (5, "x", "en", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = sharding.assign_shards(docs, 24).collect()
    names = sorted({r[2] or "" for r in rows})
    langs = {v: i * 16 // len(names) for i, v in enumerate(names)}  # few names are spread over the axis
    seen = sorted(r[3] for r in rows)
    source = {v: seen.index(v) * 16 // len(rows) for v in set(seen)}
    cells: dict = {}
    for i, text, lang, s in rows:
        size = len(text) + 8
        cells.setdefault((i, size), []).append(hilbert_index((langs[lang or ""], source[s], min(15, int(math.log2(size / 8 + 1)))), 4))
    order = [cells[r.doc_id, r.size].pop() for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    starts = [-(-k * len(rows) // 24) for k in range(25)]
    assert [sum(r.shard == k for r in got) for k in range(24)] == [b - a for a, b in zip(starts, starts[1:])]


def test_shards_prune_by_a_dimension_of_four_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    shards = sharding.assign_shards(docs, 24).join(docs.select("doc_id", "lang", "source"), "doc_id")
    for c, most in (("lang", 12), ("source", 12)):
        spans = shards.groupBy("shard").agg(F.min(c).alias("low"), F.max(c).alias("high")).collect()
        names = [r[0] for r in docs.select(c).distinct().collect()]
        assert np.mean([sum(s.low <= n <= s.high for s in spans) for n in names]) <= most


def test_shard_files_prune(spark, tmp_path):
    """Files' least and greatest values: a filter on a language or a source opens little more than the shards that hold it."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(3)
    langs, sources = [f"l{i:02}" for i in range(12)], [f"s{i:02}" for i in range(9)]
    rows = [(i, "x" * rng.randrange(400), rng.choice(langs), rng.choice(sources), "a", 1) for i in range(4000)]
    rows += [(None, "null id", "l00", "s00", "a", 1), (7, "again", "l01", "s01", "a", 1), (7, "again", "l01", "s01", "a", 1), (8, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot string, `a.b` int")
    sharding.write_shards(docs, 24, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(repr, back.drop("shard").collect())) == sorted(map(repr, docs.collect()))
    spans = {}
    for f in glob.glob(f"{tmp_path}/s/shard=*/*.parquet"):
        table = pq.read_table(f, columns=["lang", "source"]).to_pydict()
        spans[f] = {c: (min(v for v in table[c] if v), max(v for v in table[c] if v), set(table[c])) for c in ("lang", "source")}
    assert len(spans) == 24
    for c, values in (("lang", langs), ("source", sources)):
        opened = np.mean([sum(s[c][0] <= v <= s[c][1] for s in spans.values()) for v in values])
        holding = np.mean([sum(v in s[c][2] for s in spans.values()) for v in values])
        assert opened <= 1.25 * holding and opened < 12
    assert docs.limit(0).count() == 0
    sharding.write_shards(docs.limit(0), 24, str(tmp_path / "e"))
    clash = docs.withColumn("shard", F.lit("x"))
    sharding.write_shards(clash, 3, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("shard = 'x'").count() == len(rows)


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 2_000)
    rng = random.Random(1)
    pages = [(i, f"http://h/{i} é\n", rng.choice(["", "same\r\n\r\nWARC/1.1 body", "x" * rng.randrange(3000), "ünï" * 50])) for i in range(120)]
    pages += [(500, None, None), (501, "", ""), (2**62 + 5, "u", "same\r\n\r\nWARC/1.1 body"), (-3, "u", "minus"), (7, "again", "same\r\n\r\nWARC/1.1 body")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    got = warc.archive(df, str(tmp_path / "a")).collect()
    largest: dict = {}
    for i, _, h in pages:
        largest[h or ""] = max(i, largest.get(h or "", i))
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        last = largest[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == last else "revisit", None if i == last else last))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    small = warc.archive(df, str(tmp_path / "b"), least_bytes=10**6).collect()
    assert {r.record_type for r in small} == {"response"}


def test_archive_edges(spark, tmp_path):
    df = spark.createDataFrame([(None, "u", "x"), (1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive(df, str(tmp_path / "a")).collect()}
    assert got == {None: ("response", None), 1: ("revisit", 2), 2: ("response", None)}
    assert warc.archive(df.limit(0), str(tmp_path / "b")).count() == 0


def test_arc_versions():
    body = b"HTTP/1.1 200 OK\r\n\r\nx\n\ny"
    one = warc.arc_opening(1) + warc.arc_record(1, "http://a", body) + warc.arc_record(1, "http://b", b"")
    two = warc.arc_opening(2) + warc.arc_record(2, "http://c", body)
    records = [r for r in warc.parse_arc(one + two) if not r.opens]
    assert [(r.url, r.body) for r in records] == [("http://a", body), ("http://b", b""), ("http://c", body)]
    with pytest.raises(ValueError):
        list(warc.parse_arc(one + warc.arc_record(2, "http://c", body)))
    with pytest.raises(ValueError):
        list(warc.parse_arc(two[:-3]))
    for pid in (0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(pid, "3-c000/7")) == pid


def test_pages_of_the_archive_s_own_scheme(spark, tmp_path):
    """A page whose url begins like a version block's, even with a body like one, is a page."""
    body = warc.arc_opening(2).split(b"\n", 1)[1].decode()
    pages = [(1, "filedesc://x", body), (2, "filedesc://calorine.arc", "a"), (3, "http://h", body), (4, "filedesc://", None)]
    got = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a")).collect()
    assert sorted((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [
        (1, "filedesc://x", len(body), "revisit", 3), (2, "filedesc://calorine.arc", 1, "response", None), (3, "http://h", len(body), "response", None), (4, "filedesc://", 0, "response", None)
    ]


@pytest.mark.parametrize("most", [0, 100])
def test_identifiers_are_unique_and_referred_to(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "SEGMENT", 500)
    rows = [(i % 30, "u", f"body {i % 7}") for i in range(90)] + [(None, "u", "body 1"), (None, "v", None), (29, "u", "body 1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_arc(pages, str(tmp_path / "arc"))
    warc.write_warc(str(tmp_path / "arc"), str(tmp_path / "warc"), spark, most_broadcast=most)
    kinds: dict = {}
    for r in warc._files(spark, str(tmp_path / "warc")).collect():
        for headers, _ in warc.parse_warc(warc._inflate(bytes(r.content))):
            assert headers["warc-record-id"] not in kinds
            kinds[headers["warc-record-id"]] = (headers["warc-type"], headers.get("warc-refers-to"), headers.get("warc-payload-digest"))
    assert sum(k != "warcinfo" for k, _, _ in kinds.values()) == len(rows)
    for kind, target, digest in kinds.values():
        if kind == "revisit":
            assert kinds[target][0] == "response" and kinds[target][2] == digest


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<article class=post><header><h1>The  title &amp; more</h1></header><p><b>First<br>line &#8212; of&nbsp;text.<p>Short.</p>
<div class="advert">Buy now</div><p>A longer paragraph with a <a href="/x">link</a> in it<script>no()</script> and more.</p><!-- <p>no</p> -->
<form><p>Name</p><input><button>Send</button></form><section id="comments"><h2>Comments</h2><p>I liked reading this a lot, thank you very much for it.</p></section></article>
<aside class="sidebar"><p>Other things to read in the side bar of this page.</p></aside><footer>&copy; somebody</footer></body></html>"""


def test_main_text():
    want = "The title & more\n\nFirst line — of text.\n\nShort.\n\nA longer paragraph with a link in it and more."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.upper().replace("&AMP;", "&amp;").replace("&NBSP;", "&nbsp;")) == want.upper()
    unclosed = PAGE.replace("</article>", "").replace("</body></html>", "")
    assert html_text.main_text(unclosed) == want


def test_names_of_wrappers_and_subjects():
    body = "<article class='legal'><h1>One two</h1><p>Three four five six seven.</p></article>"
    page = f"<body class='widget'><div class='page has-sidebar with-comments'>{body}<div class='comments'><article><p>So true, I say, so true.</p></article></div></div>"
    assert html_text.main_text(page) == "One two\n\nThree four five six seven."


def test_tree_fits_its_table():
    rows, labels = html_text.labelled_rows()
    assert np.mean([html_text.classify(html_text.tree(), r) == y for r, y in zip(rows, labels)]) > 0.99
    assert html_text.features(html_text.blocks("<p>one two <a href=x>three</a></p><p>four</p>"))[0][:6] == (3.0, 1 / 3, 0.0, 0.0, 1.0, 0.0)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>", "a<b>c</b>", "<a href='x>y", "</div></div>", "<div " + "a" * 5000, "&#xZZ; &bogus; &#0;", "<p>" * 5000 + "x"])
def test_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "u", "", "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, *[len(html_text.main_text(PAGE))] * 2]
    assert html_text.extract(df.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(200)] + [(None, 5), (7, None), (9, 9)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def clustered(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    return np.concatenate([centres[rng.integers(0, len(centres), n // 2)] + rng.normal(size=(n // 2, dim)) * 0.12, rng.normal(size=(n - n // 2, dim)), centres[:1] + rng.normal(size=(n // 4, dim)) * 0.03])


def test_graph_recall():
    vectors = vector_dedup.unit(clustered(1, 1500))
    graph = vector_dedup.Graph(vectors[:1000].astype(np.float32))
    search = vector_dedup.Search(graph, 0.95)
    found = {pair for q, c in search.links(vectors.astype(np.float32)) for pair in zip(q.tolist(), c.tolist())}
    truth = set(zip(*np.nonzero(vectors @ vectors[:1000].T >= 0.95)))
    assert len(truth & found) >= 0.98 * len(truth)


def test_audits_hold_links_however_rare():
    """Two thousand unlike vectors and twenty links: the audits hold links, and the links are found."""
    rng = np.random.default_rng(5)
    shard = vector_dedup.unit(rng.normal(size=(2000, 32)))
    block = vector_dedup.unit(np.concatenate([shard[:20] + rng.normal(size=(20, 32)) * 0.03, rng.normal(size=(1980, 32))]))
    assert (block @ shard.T >= 0.95).sum() == 20
    search = vector_dedup.Search(vector_dedup.Graph(shard.astype(np.float32)), 0.95)
    assert search.audited >= vector_dedup.PLANTED and search.found >= 0.98 * search.audited
    links, a, b = vector_dedup.meeting(search, shard, np.arange(2000), np.full(2000, 3), block, np.arange(5000, 7000))
    assert links.sum() == 60 and sorted(zip(a.tolist(), b.tolist())) == [(5000 + i, i) for i in range(20)]


def test_a_great_group_of_near_copies_is_counted_whole():
    rng = np.random.default_rng(6)
    shard = vector_dedup.unit(np.concatenate([np.ones((1500, 16)) + rng.normal(size=(1500, 16)) * 0.02, rng.normal(size=(500, 16))]))
    search = vector_dedup.Search(vector_dedup.Graph(shard.astype(np.float32)), 0.95)
    links, a, b = vector_dedup.meeting(search, shard, np.arange(2000), np.ones(2000, np.int64), shard, np.arange(2000))
    near = shard @ shard.T >= 0.95
    assert (links[:1500] == near[:1500].sum(1) - 1).all()
    assert len(a) <= 2 * 2000  # stars, not pairs


def test_vector_dedup_against_all_pairs(spark):
    vectors = clustered(3, 500).round(3)
    rows = [(i * 2, v.tolist()) for i, v in enumerate(vectors)] + [(5000 + i, vectors[0].tolist()) for i in range(30)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [float("inf")] + [1.0] * 15), (9004, []), (9005, vectors[0].tolist()[:8]), (9006, [None] * 16)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, node string, copies int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df, 0.95).collect()}
    u = vector_dedup.unit(np.array([v for _, v in rows]))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    want = {rows[i][0]: (int(near[i].sum()), rows[label[i]][0], bool(label[i] == i)) for i in range(len(rows))}
    links = sum(w[0] for w in want.values())
    assert sum(min(got[i][0], w[0]) for i, w in want.items()) >= 0.98 * links
    assert sum(got[i] == w for i, w in want.items()) >= 0.98 * len(want)
    assert {i: got[i] for i, _ in odd} == {i: (0, i, True) for i, _ in odd}


def test_lengths_that_overflow_or_vanish(spark):
    df = spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e200, 1.0]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 1e308])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df, 0.95).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5)}


def test_vector_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, r.kept) for r in vector_dedup.near_duplicates(df, 0.95).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("None", 0, True)]
    assert vector_dedup.near_duplicates(df.limit(0), 0.95).count() == 0
