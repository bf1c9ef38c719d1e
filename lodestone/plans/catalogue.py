"""Registered queries of the retrieval engine and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.ranking import parse_agg
from lodestone.functions.vectors import cosine, hashed_words
from lodestone.operators import documents as doc_ops
from lodestone.operators.retrieval import bm25, corpus_size, knn, listed_postings, postings, rrf
from lodestone.plans.materialize import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that DuckDB checks it by."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- vector search

_VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_SIM = "round(list_dot_product(q.e, v.e) / greatest(sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)), 1e-12), 12)"


def _vector_hits(spark: SparkSession, sf_dir: str, where: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return knn(vectors, e.where(where).select(F.col("vec_id").alias("qid"), "embedding"), k)


@query(f"WITH {_VECTORS} SELECT v.vec_id AS chunk_id, round({_SIM}, 6) AS similarity FROM v q, v WHERE q.vec_id = 0 ORDER BY {_SIM} DESC, v.vec_id LIMIT 10")
def knn_top10(spark, sf_dir):
    """The ten chunks nearest to one vector."""
    return _vector_hits(spark, sf_dir, "vec_id = 0", 10).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_VECTORS}, s AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, {_SIM} AS similarity FROM v q, v WHERE q.vec_id % 50 = 0)
SELECT qid, chunk_id, round(similarity, 6) AS similarity, rn::INT AS vec_rank FROM
(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, chunk_id) AS rn FROM s) WHERE rn <= 5""")
def knn_batch_top5(spark, sf_dir):
    """Five nearest for each query of a batch."""
    return _vector_hits(spark, sf_dir, "vec_id % 50 = 0", 5).select("qid", "chunk_id", F.round("similarity", 6).alias("similarity"), "vec_rank")


@query(SQL["knn_batch_top5"].replace("% 50 = 0", "% 20 = 0"))
def knn_batch20_top5(spark, sf_dir):
    """Five nearest for each vector whose id is divisible by 20."""
    return _vector_hits(spark, sf_dir, "vec_id % 20 = 0", 5).select("qid", "chunk_id", F.round("similarity", 6).alias("similarity"), "vec_rank")


_HITS = f"""WITH {_VECTORS}, s AS (SELECT v.vec_id, v.label, {_SIM} AS sim FROM v q, v WHERE q.vec_id = 0),
h AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rk FROM s QUALIFY rk <= 200),
d AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, rk) AS i FROM h)"""
_STRATEGIES = {
    "max": "max(sim)",
    "topk:3": "sum(sim) FILTER (WHERE i <= 3) / least(count(*), 3)",
    "softmax:0.05": "sum(sim * exp((sim - top) / 0.05)) / sum(exp((sim - top) / 0.05))",
    "decay": "sum(sim / pow(2, i - 1))",
    "count:0.2": "(count(*) FILTER (WHERE sim >= 0.2))::DOUBLE",
}


def _strategy(spec: str):
    def run(spark, sf_dir):
        hits = _vector_hits(spark, sf_dir, "vec_id = 0", 200).withColumnRenamed("similarity", "score").withColumnRenamed("vec_rank", "fused_rank")
        owner = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"))
        got = doc_ops.by_document(hits.join(owner, "chunk_id"), spec)
        return got.select("document_id", F.round("score", 6).alias("score"), "first_rank", "best_chunk", "hits")

    name = "agg_" + spec.split(":")[0]
    run.__doc__ = f"Chunk scores to document scores by {spec}."
    QUERIES[name] = run
    SQL[name] = f"{_HITS} SELECT label AS document_id, round({_STRATEGIES[spec]}, 6) AS score, min(rk)::INT AS first_rank, min(vec_id) FILTER (WHERE i = 1) AS best_chunk, count(*) AS hits FROM (SELECT *, max(sim) OVER (PARTITION BY label) AS top FROM d) GROUP BY label"


for _spec in _STRATEGIES:
    parse_agg(_spec)
    _strategy(_spec)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents),
s AS (SELECT doc_id, ('0x' || sha256(word)[1:2])::INT % 32 AS slot, count(*) AS n FROM w GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS len, max(n) AS top, count(*) AS slots FROM s GROUP BY ALL)
SELECT doc_id, slots::INT AS slots, round(top / len, 6) AS largest, round(len * len, 0)::BIGINT AS squared FROM l""")
def hash_embed(spark, sf_dir):
    """The hashed-words embedding of each document, by its largest component, used slots and squared length before scaling."""
    d = table(spark, sf_dir, "documents")
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    e = d.select("doc_id", hashed_words(F.col("text")).alias("e"), words.alias("n")).where("n > 0")
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)  # the words over the length
    return e.select("doc_id", F.size(F.filter("e", lambda x: x > 0)).alias("slots"), F.round(F.array_max("e"), 6).alias("largest"), F.round(F.pow(F.col("n") / total, 2), 0).cast("long").alias("squared"))


# ---------------------------------------------------------------- full text

_TERMS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')"


@query("""SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+')) AS term FROM benchmark)
WHERE length(term) > 1 GROUP BY ALL""")
def tokenize_terms(spark, sf_dir):
    """The words of each query, repeats counted."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(tx.query_terms(F.col("text"))).alias("term"))
    return q.groupBy("qid", "term").agg(F.count("*").alias("times"))


@query(f"WITH p AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term")
def term_stats(spark, sf_dir):
    """In how many documents each term occurs, and how often."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return postings(d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_BM25 = f"""p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM (SELECT doc_id, {_TERMS} AS t FROM documents)) GROUP BY doc_id, term),
c AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT doc_id, any_value(len) AS len FROM p GROUP BY doc_id)),
t AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest(string_split_regex(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) WHERE length(term) > 1 GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, c),
b AS (SELECT qid, doc_id AS chunk_id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS bm25 FROM t JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, chunk_id) AS fts_rank FROM b)"""


def stored_postings(chunks: DataFrame) -> DataFrame:
    """The postings of (chunk_id, text), written once: counts, document frequencies and hits read them."""
    return cut(listed_postings(chunks), "postings")


def _text_hits(spark, sf_dir, k):
    index = stored_postings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return bm25(index, queries, k, *corpus_size(index))


@query(f"WITH {_BM25} SELECT qid, chunk_id, round(bm25, 6) AS bm25, fts_rank::INT AS fts_rank FROM f WHERE fts_rank <= 10")
def bm25_top10(spark, sf_dir):
    """The ten best documents of each query by BM25."""
    return _text_hits(spark, sf_dir, 10).select("qid", "chunk_id", F.round("bm25", 6).alias("bm25"), "fts_rank")


_EMBEDDED = """
e AS (SELECT kind, id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY kind, id)) AS x FROM
  (SELECT kind, id, ('0x' || sha256(word)[1:2])::INT % 32 AS slot, count(*) AS n FROM
    (SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents
     UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) FROM benchmark) GROUP BY ALL)),
s AS (SELECT q.id AS qid, d.id AS chunk_id, round(sum(q.x * d.x), 9) AS similarity FROM e q JOIN e d ON q.slot = d.slot WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, chunk_id) AS vec_rank FROM s)"""
_FUSED = f"""{_BM25}, {_EMBEDDED},
u AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, vec_rank, fts_rank, coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + fts_rank), 0) AS score
  FROM (SELECT * FROM k WHERE vec_rank <= 200) a FULL JOIN (SELECT * FROM f WHERE fts_rank <= 200) b ON a.qid = b.qid AND a.chunk_id = b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_rank NULLS LAST, fts_rank) AS fused_rank FROM u)"""


def _fused_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    q = table(spark, sf_dir, "benchmark")
    vectors = d.select(F.col("doc_id").alias("chunk_id"), hashed_words(F.col("text")).alias("embedding"))
    found = knn(vectors, q.select(F.col("item_id").alias("qid"), hashed_words(F.col("text")).alias("embedding")), 200)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 9)), "chunk_id")
    return rrf(found.withColumn("vec_rank", F.row_number().over(order)), _text_hits(spark, sf_dir, 200))


@query(f"WITH {_FUSED} SELECT qid, chunk_id, round(score, 9) AS score, fused_rank::INT AS fused_rank FROM r WHERE fused_rank <= 20")
def rrf_fuse(spark, sf_dir):
    """Vector and full-text hits fused by reciprocal ranks."""
    return _fused_hits(spark, sf_dir).where("fused_rank <= 20").select("qid", "chunk_id", F.round("score", 9).alias("score"), "fused_rank")


@query(f"""WITH {_FUSED}, g AS (SELECT qid, source AS document_id, max(score) AS score, min(fused_rank) AS first_rank, arg_max(chunk_id, (score, -fused_rank)) AS best_chunk FROM r JOIN documents ON doc_id = chunk_id GROUP BY ALL)
SELECT qid, document_id, round(score, 9) AS score, best_chunk, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first_rank) AS rk FROM g) WHERE rk <= 10""")
def hybrid_search_top10(spark, sf_dir):
    """Hybrid search over documents as chunks and their sources as documents."""
    owner = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"))
    got = doc_ops.by_document(_fused_hits(spark, sf_dir).join(owner, "chunk_id"), "max")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "first_rank")
    return got.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("qid", "document_id", F.round("score", 9).alias("score"), "best_chunk", "rank")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search_top10(spark, sf_dir)


def queries() -> dict:
    from lodestone.plans import catalogue_models, catalogue_streams, catalogue_tables  # noqa: F401  register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from lodestone.plans import catalogue_models, catalogue_streams, catalogue_tables  # noqa: F401  register their queries

    return dict(SQL)
