"""The jobs as queries over the given tables, and their SQL.

Each runs its job twice into one new folder of the shared folder, leaves the files there, and returns what the
second run left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_feed, retrieval_report
from lodestone.plans.catalogue import _FUSED, _TERMS
from lodestone.plans.materialize import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-text index of documents with the kept columns of each document."""
    out = _folder(spark, "job1")
    for _ in range(2):  # a glob, as a stream reads folders and globs, and the table may be one file
        index_feed.run(spark, f"{sf_dir}/documents.parque[t]", f"{out}/index", f"{out}/checkpoint")
    return index_feed.current(spark, f"{out}/index").join(index_feed.documents(spark, f"{out}/index"), "doc_id").select("doc_id", "lang", "source", "n_terms", "term", "tf", "len")


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the benchmark passages in each mode of search, with the mode's summary."""
    out = _folder(spark, "job2")
    for _ in range(2):
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    rows = retrieval_report.results(spark, out).join(F.broadcast(retrieval_report.summary(spark, out)), "mode")  # a row for each mode
    return rows.select("mode", "qid", "rank", "doc_id", F.round("score", 6).alias("score"), "truth", "queries", "found", "first", "mrr")


SQL = {
    "job1_index_feed": f"""WITH t AS (SELECT doc_id, lang, source, {_TERMS} AS ts FROM documents)
SELECT doc_id, lang, source, len(ts)::INT AS n_terms, term, count(*) AS tf, len(ts)::INT AS len FROM (SELECT *, unnest(ts) AS term FROM t) GROUP BY ALL""",
    "job2_retrieval_report": f"""WITH {_FUSED},
h AS (SELECT 'text' AS mode, qid, chunk_id AS doc_id, fts_rank AS rank, bm25 AS score FROM f WHERE fts_rank <= 200
UNION ALL SELECT 'vector', qid, chunk_id, vec_rank, similarity FROM k WHERE vec_rank <= 200
UNION ALL SELECT 'hybrid', qid, chunk_id, fused_rank, score FROM r WHERE fused_rank <= 200),
y AS (SELECT item_id AS qid, min(doc_id) AS doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id),
z AS (SELECT mode, y.qid, y.doc_id, h.rank, h.score FROM y CROSS JOIN (SELECT unnest(['text', 'vector', 'hybrid']) AS mode) m LEFT JOIN h USING (mode, qid, doc_id)),
a AS (SELECT mode, qid, rank, doc_id, score, true AS truth FROM z UNION ALL SELECT mode, qid, rank, doc_id, score, false FROM h ANTI JOIN y USING (qid, doc_id) WHERE rank <= 10),
summed AS (SELECT mode, count(*) AS queries, count(rank) AS found, count(*) FILTER (WHERE rank = 1) AS first, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 3) AS mrr FROM z GROUP BY mode)
SELECT mode, qid, rank::INT AS rank, doc_id, round(score, 6) AS score, truth, queries, found, first, mrr FROM a JOIN summed USING (mode)""",
}


def queries() -> dict:
    return {f.__name__: f for f in (job1_index_feed, job2_retrieval_report)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
