"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calorine.llm import ball_kmeans, bpe, decontaminate, html_text, language_id, ngram_join, sharding, spelling, token_counts, toxicity, url_filter, vector_dedup, warc
from calorine.llm.common import delete_at_exit, read_table, scratch

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_file(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), bpe.load_ranks(tokenizer_file("byte_bpe_50k.tiktoken")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.95)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), token_counts.load_scores(tokenizer_file("piece_bpe_32k.model")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    found = warc.archive(read_table(spark, sf_dir, "pages"), folder)
    delete_at_exit(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), 24)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_embedding_dedup": op2_embedding_dedup, "op3_token_counts": op3_token_counts, "op4_url_filter": op4_url_filter, "op5_toxicity": op5_toxicity, "op6_ngram_join": op6_ngram_join, "op7_arc_to_warc": op7_arc_to_warc, "op8_decontaminate": op8_decontaminate, "op9_hilbert_shards": op9_hilbert_shards, "op10_html_text": op10_html_text, "op11_ball_kmeans": op11_ball_kmeans, "op12_language_id": op12_language_id, "op13_spelling_variants": op13_spelling_variants}

OP4_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
         FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""



def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """Components as rows; the rounds are written out, since their number is fixed."""
    parts = [
        """kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS (SELECT vec_id, unnest(range(64)) AS i, CAST(floor(64 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT """
        + f"{k}), m0 AS (SELECT c, i, x FROM seeds JOIN p USING (vec_id))"
    ]
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT vec_id, c, sum((p.x - m.x) * (p.x - m.x)) AS d FROM p JOIN m{t} m USING (i) GROUP BY vec_id, c), a{t} AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{t} GROUP BY vec_id)")
        if t < rounds:
            parts.append(f"n{t} AS (SELECT c, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{t} JOIN p USING (vec_id) GROUP BY c, i), m{t + 1} AS (SELECT m.c, m.i, coalesce(n.x, m.x) AS x FROM m{t} m LEFT JOIN n{t} n USING (c, i))")
    parts.append(f"shas AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM m{rounds} GROUP BY c), sums AS (SELECT c, sum(d) AS s FROM a{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, sha AS centroid_sha256 FROM a{rounds} JOIN sums USING (c) JOIN shas USING (c)"


OP11_SQL = _op11_sql()

OP13_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))),
 lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS h FROM own, crcs),
spelled AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk(word, root) AS (SELECT word, word FROM words UNION ALL SELECT w.word, f.form FROM walk w JOIN found f ON f.word = w.root WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.root FROM walk w JOIN found f ON f.word = w.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)
"""

ORACLE_SQL = {"op4_url_filter": OP4_SQL, "op11_ball_kmeans": OP11_SQL, "op13_spelling_variants": OP13_SQL}
