"""Registered queries that replay tables as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators.retrieval import bm25, corpus_size, frequencies
from lodestone.plans.catalogue import _BM25, query, stored_postings, table
from lodestone.plans.index import Index
from lodestone.plans.materialize import cut, shared_dir
from lodestone.streaming.ingest import ingest
from lodestone.streaming.live import file_arrivals, live


@query("""WITH t AS (SELECT conv_id, turn, text, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS ts FROM conversations)
SELECT 'c' || conv_id AS key, count(*) AS files, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS without_text, coalesce(sum(len(ts)), 0)::BIGINT AS words, len(list_distinct(flatten(list(ts)))) AS terms FROM t GROUP BY conv_id""")
def index_conversations(spark, sf_dir):
    """An index of conversations, a document each with a file for each turn, taken from a stream: files and words by document.

    The stream ends and is started again, which takes nothing twice.
    """
    place = f"{shared_dir(spark)}/conversations-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "conversations").schema
    for _ in range(2):  # a glob, as a stream reads folders and globs, and the table may be one file
        turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/conversations.parque[t]")
        key = F.concat(F.lit("c"), "conv_id")
        rows = turns.select(key.alias("key"), key.alias("title"), F.concat_ws("/", key, "turn").alias("path"), F.sha2("text", 256).alias("fingerprint"), "text")
        index = Index(spark, place, create=True, parts=16)
        ingest(index, rows, F.when(F.trim("text") != "", F.col("text")), "turns", f"{place}/stream").awaitTermination()
    files, documents = index.table("files"), index.table("documents")
    words = index.table("postings").join(index.table("chunks").select("chunk_id", "file_id"), "chunk_id").join(files.select("file_id", "document_id"), "file_id")
    words = words.groupBy("document_id").agg(F.sum("tf").alias("words"), F.count_distinct("term").alias("terms"))
    counted = files.groupBy("document_id").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "no_text").alias("without_text"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return documents.join(counted, "document_id").join(words, "document_id", "left").select("key", "files", "without_text", zero("words"), zero("terms"))


@query(f"""WITH {_BM25}, n AS (SELECT item_id // 10 AS lot, max(item_id) AS qid FROM benchmark GROUP BY ALL)
SELECT md5(trim(text)) AS asked, fts_rank::INT AS rank, chunk_id AS doc_id FROM n JOIN benchmark ON item_id = qid JOIN f USING (qid) WHERE fts_rank <= 5""")
def live_replay(spark, sf_dir):
    """Lots of ten queries typed one after the other into a live session: each lot's last is answered, with its five best documents."""
    index = stored_postings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    size, counts = corpus_size(index), cut(frequencies(index), "frequencies")
    place = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    typed = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 10).alias("lot"), F.col("item_id").alias("n"), F.col("text").alias("query"))
    typed.repartition("lot").write.partitionBy("lot").json(f"{place}/in")  # a lot is one file, and so one micro-batch

    def search(asked):
        hits = bm25(index, asked, 5, *size, counts).join(asked, "qid")
        return hits.select("qid", F.col("fts_rank").alias("rank"), F.concat_ws("\t", F.md5("query"), "fts_rank", "chunk_id").alias("line"))

    said: list[str] = []  # five lines for each lot
    arrivals = file_arrivals(spark, f"{place}/in", "n long, query string, lot long", 1)
    live(arrivals, search, said.extend, ["n"], checkpoint=f"{place}/checkpoint", once=True).awaitTermination()
    lines = [line.split("\t") for line in said if line]
    return spark.createDataFrame([(a, int(r), int(d)) for a, r, d in lines], "asked string, rank int, doc_id long")
