"""The pipeline's stages against brute force on small tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from calorine.llm import bpe, toxicity  # noqa: E402
from tests.llm.test_text_operators import DOCS, brute_components, make_docs  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    items = [(i, " ".join(f"item{i}x{j}" for j in range(20))) for i in range(5)]
    docs = make_docs(11, 160)
    rows, labels = [], []
    for n, (i, t) in enumerate(docs):
        if n % 9 == 0:
            t += " vile. " + rng.choice(["vile stuff", "some vilest"])
        if n % 13 == 0:
            t += ". " + items[n % 5][1]
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(n % 9 == 0)))
    rows += [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "nobody knows my name at all", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, tables):
    d, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontaminate", "byte_bpe"]
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, d)
    assert clean.columns == columns
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.judge(docs, model).where("predicted = 1").collect()}
    assert 10 < len(bad) < 30
    assert rows_of(clean) == [r for r in rows_of(docs) if r[0] not in bad]
    clean = clean.cache()

    unique = stages["ngram_join"](spark, clean, d)
    assert unique.columns == columns
    kept = brute_components([(r.doc_id, r.text) for r in clean.collect() if r.doc_id is not None], 5, 80)
    want = [r for r in rows_of(clean) if r[0] is None or kept[r[0]][1] == r[0]]
    assert len(want) < clean.count()
    assert rows_of(unique) == want
    unique = unique.cache()

    pure = stages["decontaminate"](spark, unique, d)
    assert pure.columns == columns
    shingles = lambda t: Counter(zip(*(t.lower().replace(".", " ").split()[i:] for i in range(5))))
    hit = {r.doc_id for r in unique.collect() for _, t in items if r.text and sum((shingles(r.text) & shingles(t)).values()) == len(shingles(t))}
    assert hit
    assert rows_of(pure) == [r for r in rows_of(unique) if r[0] not in hit]

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    ids = {r.doc_id: encoding.encode_ordinary(r.text or "") for r in pure.collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in pure.collect()}
    want = sorted(((i, len(x), digest(np.array(x, "<u4").tobytes()), digest(texts[i])) for i, x in ids.items()), key=repr)
    assert rows_of(stages["byte_bpe"](spark, pure, d)) == want
    assert rows_of(corpus_pipeline.run(spark, d)) == want
    assert rows_of(entry.queries()["pipeline"](spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_empty(spark, tables):
    d, _ = tables
    none = spark.read.parquet(f"{d}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).count() == 0


def test_clashing_columns(spark, tables):
    """Columns named like the operators' own, or like nothing else, pass through every stage but the last."""
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    names = ["score", "n_sentences", "worst_start", "token", "hash", "signature", "c0", "item_id", "n_tokens", "a.b"]
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names])
    path = f"{d}/wide"
    wide.write.mode("overwrite").parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        wide = spark.read.parquet(path)
        made = stage(spark, wide, d)
        if name == "byte_bpe":
            assert made.count() == wide.count()
        else:
            assert made.columns == wide.columns
            rows = made.collect()
            assert 0 < len(rows) <= 60 and all(r["a.b"] == f"a.b:{r.doc_id}" and r.score == f"score:{r.doc_id}" for r in rows if r.doc_id is not None)
