"""Measures how well retrieval finds the documents that a set of passages was taken from.

    python -m jobs.retrieval_report DOCUMENTS QUERIES OUTPUT [--config jobs/retrieval_report.json]

Each passage of QUERIES is searched in DOCUMENTS by word statistics (text), by embedding (vector) and by both
(hybrid).  The truth of a passage is the document with the smallest id that holds it word for word; passages that
no document holds are searched, too, but don't count in the measures.  The job writes

    OUTPUT/results/mode=M    qid, rank, doc_id, score, truth: the first `keep` results and the truth, wherever it ranks
    OUTPUT/summary/mode=M    queries, found, first, mrr: how many have a truth, find it, find it first; mean reciprocal rank

A truth that isn't among the first `depth` has no rank and no score.  Partitions of the configured modes are
replaced as a whole by dynamic partition overwrite, those of other modes stay; a rerun gives the same rows.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line
from lodestone.errors import UsageError
from lodestone.functions.vectors import get_embedder
from lodestone.operators.evaluation import mean_reciprocal_rank
from lodestone.operators.passages import holders
from lodestone.operators.retrieval import bm25, corpus_size, knn, listed_postings, rrf
from lodestone.plans.materialize import cut, release

log = logging.getLogger("jobs.retrieval_report")
MODES = ("text", "vector", "hybrid")


@dataclass(frozen=True)
class ReportConfig:
    modes: tuple[str, ...] = MODES
    #: Results that are looked through for the truth, and that are kept.
    depth: int = 200
    keep: int = 10
    embedder: str = "hashed-words"
    id_column: str = "doc_id"
    text_column: str = "text"
    query_id_column: str = "item_id"
    query_column: str = "text"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def searched(docs: DataFrame, asked: DataFrame, config: ReportConfig) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """({mode: (qid, doc_id, rank, score)}, tables to release) of docs (doc_id, text) and asked (qid, query)."""
    found: dict[str, DataFrame] = {}
    made: list[DataFrame] = []
    text = vector = None
    if {"text", "hybrid"} & set(config.modes):
        index = cut(listed_postings(docs.select(F.col("doc_id").alias("chunk_id"), "text").where("text is not null")), "report-postings")
        text = cut(bm25(index, asked, config.depth, *corpus_size(index)), "report-text")
        found["text"] = text.select("qid", F.col("chunk_id").alias("doc_id"), F.col("fts_rank").alias("rank"), F.col("bm25").alias("score"))
        made += [index, text]
    if {"vector", "hybrid"} & set(config.modes):
        embed = get_embedder(config.embedder)
        near = knn(docs.select(F.col("doc_id").alias("chunk_id"), embed(F.col("text")).alias("embedding")), asked.select("qid", embed(F.col("query")).alias("embedding")), config.depth)
        # nine digits: beyond these the order of summation shows
        order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "chunk_id")
        near = near.withColumn("similarity", F.round("similarity", 9)).withColumn("vec_rank", F.row_number().over(order))
        vector = cut(near, "report-vector")
        found["vector"] = vector.select("qid", F.col("chunk_id").alias("doc_id"), F.col("vec_rank").alias("rank"), F.col("similarity").alias("score"))
        made.append(vector)
    if "hybrid" in config.modes:
        both = rrf(vector, text).where(F.col("fused_rank") <= config.depth)
        found["hybrid"] = both.select("qid", F.col("chunk_id").alias("doc_id"), F.col("fused_rank").alias("rank"), "score")
    return {m: found[m] for m in config.modes}, made


def run(spark: SparkSession, documents: str, queries: str, output: str, config: ReportConfig = ReportConfig()) -> dict[str, int]:
    """Writes results and summary and returns the numbers of rows read and written."""
    unknown = sorted(set(config.modes) - set(MODES))
    if unknown or not config.modes or not 1 <= config.keep <= config.depth:
        raise UsageError(f"unknown modes {unknown}" if unknown else "a mode, and keep from 1 to depth, are needed")
    # Rows without an id are left out; of several texts of an id the largest counts, so that ids are unique.
    unique = lambda path, id_, text, name, as_: spark.read.parquet(path).select(F.col(_quoted(id_)).cast("long").alias(name), F.col(_quoted(text)).alias(as_)).where(F.col(name).isNotNull()).groupBy(name).agg(F.max(as_).alias(as_))
    docs = cut(unique(documents, config.id_column, config.text_column, "doc_id", "text"), "report-documents")
    asked = cut(unique(queries, config.query_id_column, config.query_column, "qid", "query"), "report-queries")
    counts = {"documents": docs.count(), "queries": asked.count()}
    log.info("read %d documents of %s and %d queries of %s", counts["documents"], documents, counts["queries"], queries)
    found, made = searched(docs, asked, config)
    truth = cut(holders(docs, asked.select("qid", F.col("query").alias("passage"))).groupBy("qid").agg(F.min("doc_id").alias("doc_id")), "report-truth")
    rows: DataFrame | None = None
    for mode, hits in found.items():
        own = hits.join(truth.withColumn("truth", F.lit(True)), ["qid", "doc_id"], "full_outer").withColumn("truth", F.coalesce("truth", F.lit(False)))
        own = own.where((F.col("rank") <= config.keep) | F.col("truth")).select("qid", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "truth", F.lit(mode).alias("mode"))
        rows = own if rows is None else rows.unionByName(own)
    save = lambda df, name: df.write.partitionBy("mode").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{output}/{name}")
    save(rows.hint("rebalance", "mode"), "results")
    written = results(spark, output).where(F.col("mode").isin(list(config.modes)))
    ranked = written.where("truth")
    shares = ranked.groupBy("mode").agg(F.count("rank").alias("found"), F.count(F.when(F.col("rank") == 1, 1)).alias("first"))
    save(mean_reciprocal_rank(ranked, ["mode"]).join(shares, "mode").coalesce(1), "summary")
    counts["results"] = written.count()
    for r in summary(spark, output).orderBy("mode").collect():  # a row for each mode
        log.info("%s: %d of %d found, %d first, mean reciprocal rank %.3f", r["mode"], r["found"], r["queries"], r["first"], r["mrr"])
    log.info("wrote %d results and a summary of %d modes to %s", counts["results"], len(config.modes), output)
    release(docs, asked, truth, *made)
    return counts


def results(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("qid long, rank int, doc_id long, score double, truth boolean, mode string").parquet(f"{output}/results")


def summary(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("queries long, mrr double, found long, first long, mode string").parquet(f"{output}/summary")


if __name__ == "__main__":
    where = {"documents": "Parquet table of documents", "queries": "Parquet table of passages", "output": "folder of the report"}
    sys.exit(command_line("retrieval_report", "Measures retrieval by passages of known documents.", where, ReportConfig, run))
