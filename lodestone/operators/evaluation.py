"""Measures of retrieval and of text segmentation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.likeness import fidelity
from lodestone.functions.text import locate, normalize
from lodestone.operators.retrieval import QUERY_BLOCK

#: Queries, and components of their vectors, that go to a pool's tasks at once; scores that a task keeps.
POOL_BLOCK, SENT_BLOCK, POOLED_SCORES = 32_768, 1 << 22, 4_000_000


def mean_reciprocal_rank(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., queries, mrr) of (by..., rank); a null rank counts as not found."""
    return ranks.groupBy(*by).agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 3).alias("mrr"))


def missed(ranks: DataFrame) -> DataFrame:
    return ranks.where(F.col("rank").isNull() | (F.col("rank") > 1))


def rank_agreement(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by..., common, agreement): the share of pairs of common items that both orders (item, rank) put the same way; 1 without pairs."""
    both = a.select(*by, "item", F.col("rank").alias("x")).join(b.select(*by, "item", F.col("rank").alias("y")), [*by, "item"])
    lists = both.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("o"))
    later = lambda o, p, i: F.slice(o, i + 2, F.size(o))
    good = F.aggregate(F.transform("o", lambda p, i: F.size(F.filter(later(F.col("o"), p, i), lambda q: q["y"] > p["y"]))), F.lit(0), lambda s, v: s + v)
    pairs = F.size("o") * (F.size("o") - 1) / 2
    return lists.select(*by, F.size("o").alias("common"), F.when(pairs > 0, good / pairs).otherwise(F.lit(1.0)).alias("agreement"))


def boundary_f1(a: Column, b: Column, within: int = 200) -> Column:
    """The harmonic mean of the shares of each list's cuts that have a cut of the other within so many characters."""
    share = lambda x, y: F.when(F.size(x) > 0, F.size(F.filter(x, lambda c: F.exists(y, lambda d: F.abs(c - d) <= within))) / F.size(x)).otherwise(F.lit(0.0))
    p, r = share(a, b), share(b, a)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def anchor_metrics(positions: Column) -> Column:
    """struct(anchors, found, hit_rate, in_order_rate) of positions in a text, -1 for an anchor that isn't there."""
    found = F.filter(positions, lambda p: p >= 0)
    kept = F.aggregate(found, F.struct(F.lit(-1).alias("top"), F.lit(0).alias("n")), lambda s, p: F.struct(F.greatest(s["top"], p).alias("top"), (s["n"] + F.when(p > s["top"], 1).otherwise(0)).alias("n")), lambda s: s["n"])
    rate = lambda n, of: F.when(of > 0, F.round(n / of, 3)).otherwise(F.lit(0.0))
    return F.struct(F.size(positions).alias("anchors"), F.size(found).alias("found"), rate(F.size(found), F.size(positions)).alias("hit_rate"), rate(kept, F.size(found)).alias("in_order_rate"))


def rewrite_report(rewrites: DataFrame, key: str) -> DataFrame:
    """(key, n_chunks, length_ratio, fidelity, anchors) of texts that a model rewrote as chunks: (key, text, chunks).

    The chunks joined are compared with the text; anchors, see anchor_metrics(), are where the first eight words of each
    chunk stand in it.  Blank chunks have no words and aren't counted as anchors.
    """
    text = F.coalesce("text", F.lit(""))
    chunks = F.coalesce("chunks", F.array().cast("array<string>"))
    joined = normalize(F.array_join(chunks, " "))
    said = F.filter(F.transform(chunks, normalize), lambda c: F.length(c) > 0)
    eight = F.transform(said, lambda c: F.substring_index(c, " ", 8))
    made = rewrites.select(key, text.alias("text"), F.size(chunks).alias("n_chunks"), joined.alias("joined"), eight.alias("eight"))
    found = F.transform("eight", lambda a: locate(a, F.col("text")))
    ratio = F.round(F.length("joined") / F.greatest(F.length("text"), F.lit(1)), 3)
    return made.select(key, "n_chunks", ratio.alias("length_ratio"), fidelity(F.col("text"), F.col("joined")).alias("fidelity"), anchor_metrics(found).alias("anchors"))


def pair_means(vectors: DataFrame, by: str, similarity: Column) -> DataFrame:
    """(a, b, mean) over `by` of a similarity of columns x and y, for each pair of views a < b of (by, view, vec)."""
    x = vectors.select(by, F.col("view").alias("a"), F.col("vec").alias("x"))
    y = vectors.select(by, F.col("view").alias("b"), F.col("vec").alias("y"))
    return x.join(y, by).where("a < b").groupBy("a", "b").agg(F.round(F.avg(similarity), 3).alias("mean"))


def pool_scores(queries: DataFrame, pool: DataFrame, similarity: Column) -> DataFrame:
    """(qid, document_id, score): each document's best similarity of its vectors in a pool, -1 for a document without any.

    queries is (qid, x), pool (document_id, y) with a null y for documents without vectors.  Blocks of QUERY_BLOCK
    queries at most go to the pool's tasks.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    part = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    pairs = reduce(DataFrame.union, [pool.join(F.broadcast(queries.where(part == i)), F.lit(True)) for i in range(blocks)])
    return pairs.groupBy("qid", "document_id").agg(F.coalesce(F.max(F.when(F.col("y").isNotNull(), similarity)), F.lit(-1.0)).alias("score"))


def _pooled(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(qid, document_id, score): the best cosine of this task for each query and document, null without any, POOLED_SCORES at a time."""
    qids, dims = shared.value
    kind, best = None, {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for document, scores in best.items():
            yield pa.RecordBatch.from_arrays([qids, pa.array([document] * len(qids), kind), pa.array(scores, mask=np.isneginf(scores))], names=["qid", "document_id", "score"])
        best.clear()

    for batch in batches:
        kind = batch.schema.field(0).type
        coded = batch.column(0).dictionary_encode()
        codes, documents = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), [*coded.dictionary.to_pylist(), None]
        sizes = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        for code in np.unique(codes):
            if documents[code] not in best:
                if (len(best) + 1) * len(qids) > POOLED_SCORES:
                    yield from flushed()
                best[documents[code]] = np.full(len(qids), -np.inf)
            scores = best[documents[code]]
            for dim, (at, queries, lengths) in dims.items():
                mine = np.flatnonzero((codes == code) & (sizes == dim))
                for i in range(0, len(mine), 2048):
                    y = batch.column(1).take(pa.array(mine[i : i + 2048])).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mine[i : i + 2048]), dim)
                    own = np.sqrt((y * y).sum(1))
                    for j in range(0, len(at), 512):
                        found = queries[j : j + 512] @ y.T / np.maximum(lengths[j : j + 512, None] * own, 1e-12)
                        here = at[j : j + 512]
                        scores[here] = np.maximum(scores[here], found.max(1))
    yield from flushed()


def pool_cosines(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """pool_scores() by the cosine of x and y: one matrix product for each block of queries and vectors of a document.

    Vectors that are null, hold a null or are of another length have no cosine.  The pool is read once for each block of
    POOL_BLOCK queries at most and never shuffled; each task returns its best of each query and document.
    """
    spark = queries.sparkSession
    whole = lambda c: F.when(~F.exists(c, lambda v: v.isNull()), F.col(c).cast("array<double>"))
    asked, rows = queries.select("qid", whole("x").alias("x")), pool.select("document_id", whole("y").alias("y"))
    count, sent = asked.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("x"), F.lit(0)).cast("long")), F.lit(0))).first()
    blocks = max(1, -(-count // POOL_BLOCK), -(-sent // SENT_BLOCK))
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("document_id", pool.schema["document_id"].dataType), T.StructField("score", T.DoubleType())])
    found = spark.createDataFrame([], schema)
    for i in range(blocks):
        table = (asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else asked).toArrow().combine_chunks()
        if not len(table):
            continue
        x = table["x"].combine_chunks()
        sizes = x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        dims = {}
        for d in np.unique(sizes[sizes >= 0]).tolist():
            at = np.flatnonzero(sizes == d)
            vectors = x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
            dims[d] = (at, vectors, np.sqrt((vectors * vectors).sum(1)))
        shared = spark.sparkContext.broadcast((table["qid"].combine_chunks(), dims))
        found = found.unionByName(rows.mapInArrow(partial(_pooled, shared=shared), schema))
    return found.groupBy("qid", "document_id").agg(F.coalesce(F.max("score"), F.lit(-1.0)).alias("score"))


def stage_rollup(calls: DataFrame) -> DataFrame:
    """(stage, calls, mean_s, mean_tokens_s, mean_tokens) of (stage, seconds, tokens); nulls are left out of means."""
    return calls.groupBy("stage").agg(F.count("*").alias("calls"), F.round(F.avg("seconds"), 3).alias("mean_s"), F.round(F.avg(F.col("tokens") / F.col("seconds")), 3).alias("mean_tokens_s"), F.round(F.avg("tokens"), 3).alias("mean_tokens"))


def variant_rollup(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(variant, n, valid, means of metrics) sorted by variant."""
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("int")).alias("valid"), *[F.round(F.avg(m), 3).alias(m) for m in metrics]).orderBy("variant")


def tag_frequency(tags: DataFrame, most: int = 40) -> DataFrame:
    """The most frequent values of (tag), ties by name."""
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def latency(calls: DataFrame) -> DataFrame:
    return calls.agg(F.round(F.avg("seconds"), 3).alias("mean_s"), F.max("seconds").alias("max_s"))


def figure_labels(text: Column) -> Column:
    """How many different figures a text names."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\bfig(?:ure)?\.?\s*(\d+)"), F.lit(1))))


def yes_probability(log_yes: Column, log_no: Column) -> Column:
    """p(yes) / (p(yes) + p(no)) from log probabilities, a missing one counting as 0."""
    yes, no = (F.coalesce(F.exp(c), F.lit(0.0)) for c in (log_yes, log_no))
    return F.when(yes + no > 0, yes / (yes + no)).otherwise(F.lit(0.0))


def richest_file(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, file_id, n): each document's file with most chunks, ties to the smaller id."""
    counted = files.join(chunks.groupBy("file_id").agg(F.count("*").alias("n")), "file_id").select("document_id", "file_id", "n")
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("n"), "file_id"))).where("r = 1").drop("r")


def sample_by_length(docs: DataFrame, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """A seeded choice of documents (key, pages): so many short (6 pages at most), medium (7 to 14) and long ones."""
    bucket = F.when(F.col("pages") <= 6, "short").when(F.col("pages") <= 14, "medium").otherwise("long")
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("key", F.lit(seed)), "key")
    ranked = docs.withColumn("bucket", bucket).withColumn("r", F.row_number().over(order))
    limits = F.create_map(*[x for k, n in quotas.items() for x in (F.lit(k), F.lit(n))])
    return ranked.where(F.col("r") <= F.coalesce(limits[F.col("bucket")], F.lit(0))).drop("r")
