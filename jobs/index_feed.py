"""Keeps a full-text index up to date with a folder of document files that only grows.

    python -m jobs.index_feed SOURCE OUTPUT CHECKPOINT [--config jobs/index_feed.json]

Each run takes the Parquet files that SOURCE (a folder or a glob) got since the last run, in micro-batches of a file
stream whose checkpoint remembers what was taken, and ends when no file is left.  A batch writes

    OUTPUT/postings/batch=N/bucket=B    term, doc_id, tf, len: what BM25 reads, by a hash of the term
    OUTPUT/documents/batch=N            doc_id, the kept columns, n_terms: which batch holds a document's newest version

by dynamic partition overwrite.  A batch that broke off is run again by Spark with the same number and files, so it
replaces its own partitions.  Documents are written last: until then the version before stays the current one.

A document that arrives again replaces its older version in current().  Within a batch the row of the newest file
counts, of equally new ones the one with the largest text.  Rows without an id are left out and counted in the log;
a null or empty text is a document without terms, which takes an older version's terms away.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line
from lodestone.errors import UsageError
from lodestone.functions.text import index_terms
from lodestone.operators.retrieval import bucket_of, postings

log = logging.getLogger("jobs.index_feed")
#: Repeated ids of a batch that are broadcast at most; with more the joins are left to Spark.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class FeedConfig:
    id_column: str = "doc_id"
    text_column: str = "text"
    #: Columns that stand beside each document.
    keep: tuple[str, ...] = ("lang", "source")
    #: Files of a micro-batch, at most.
    files_per_batch: int = 256


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def newest(rows: DataFrame) -> DataFrame:
    """rows (doc_id, modified, text, kept) with one row for each doc_id: of the newest file, then of the largest text.

    Only the rows of ids that stand more than once are shuffled by id, and these are reduced in each task before.
    """
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    n = again.count()
    if not n:
        return rows.drop("modified")
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    one = F.max_by(F.struct("text", "kept"), F.struct("modified", F.coalesce("text", F.lit("")), F.to_json("kept"))).alias("row")
    chosen = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("doc_id", "row.text", "row.kept")
    return rows.join(again, "doc_id", "left_anti").select("doc_id", "text", "kept").unionByName(chosen)


def add_batch(batch: DataFrame, number: int, output: str, config: FeedConfig) -> dict[str, int]:
    """Writes the postings and documents of one batch and returns what was read and written."""
    spark = batch.sparkSession
    rows, ids = batch.agg(F.count("*"), F.count("doc_id")).first()
    counts = {"rows": rows, "without_id": rows - ids, "documents": 0, "postings": 0}
    if ids:
        known = newest(batch.where("doc_id is not null"))
        terms = postings(known.select(F.col("doc_id").alias("chunk_id"), "text").where("text is not null"))
        terms = terms.select("term", F.col("chunk_id").alias("doc_id"), "tf", F.col("len").cast("int").alias("len"), bucket_of(F.col("term")).alias("bucket"), F.lit(number).cast("long").alias("batch"))
        terms.hint("rebalance", "bucket").write.partitionBy("batch", "bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{output}/postings")
        documents = known.select("doc_id", "kept.*", F.coalesce(F.size(index_terms(F.col("text"))), F.lit(0)).alias("n_terms"), F.lit(number).cast("long").alias("batch"))
        documents.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{output}/documents")
        counts["documents"], n_terms = spark.read.parquet(f"{output}/documents/batch={number}").agg(F.count("*"), F.sum("n_terms")).first()
        if n_terms:
            counts["postings"] = spark.read.parquet(f"{output}/postings/batch={number}").count()
    log.info("batch %d: read %d rows (%d without an id); wrote %d documents and %d postings to %s", number, *counts.values(), output)
    return counts


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: FeedConfig = FeedConfig()) -> dict[str, int]:
    """Takes what is new in source, waits for the stream to end, and returns the totals of this run."""
    try:
        schema = spark.read.parquet(source).schema  # of a file's footer
    except AnalysisException as e:
        raise UsageError(f"no Parquet files at {source}") from e
    missing = [c for c in (config.id_column, config.text_column, *config.keep) if c not in schema.names]
    if missing:
        raise UsageError(f"{source} lacks the columns {', '.join(missing)}")
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(source)
    kept = F.struct(*[F.col(_quoted(c)) for c in config.keep]) if config.keep else F.struct(F.lit(None).cast("string").alias("none"))
    rows = arrived.select(F.col(_quoted(config.id_column)).cast("long").alias("doc_id"), F.col("_metadata.file_modification_time").alias("modified"), F.col(_quoted(config.text_column)).alias("text"), kept.alias("kept"))
    total = {"batches": 0, "rows": 0, "without_id": 0, "documents": 0, "postings": 0}

    def take(batch: DataFrame, number: int) -> None:
        counts = add_batch(batch, number, output, config)
        total["batches"] += 1
        for name, n in counts.items():
            total[name] += n

    log.info("reading new files of %s, checkpoint %s", source, checkpoint)
    stream = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    log.info("done: %s", ", ".join(f"{n} {k}" for k, n in total.items()))
    return total


def documents(spark: SparkSession, output: str) -> DataFrame:
    """(doc_id, batch, kept columns, n_terms): each document's newest version.  An error while no document was taken."""
    try:
        stored = spark.read.parquet(f"{output}/documents")
    except AnalysisException as e:
        raise UsageError(f"no document was indexed at {output} yet") from e
    return stored.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by(F.struct(*[_quoted(c) for c in stored.columns if c not in ("doc_id", "batch")]), "batch").alias("row")).select("doc_id", "batch", "row.*")


def current(spark: SparkSession, output: str) -> DataFrame:
    """(bucket, term, doc_id, tf, len) of each document's newest version, as bm25() reads it."""
    stored = spark.read.schema("term string, doc_id long, tf long, len int, batch long, bucket int").parquet(f"{output}/postings")
    return stored.join(documents(spark, output).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").select("bucket", "term", "doc_id", "tf", "len")


if __name__ == "__main__":
    where = {"source": "folder or glob of Parquet files", "output": "folder of the index", "checkpoint": "folder of the stream's checkpoint"}
    sys.exit(command_line("index_feed", "Adds new document files to a full-text index.", where, FeedConfig, run))
