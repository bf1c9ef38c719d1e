"""The pipeline's first stage where no document has a language label."""

from __future__ import annotations

import corpus_pipeline as cp
from pyspark.sql import functions as F


def test_documents_without_any_label_keep_their_texts(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    got = cp.language(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.lang) for r in got.collect()) == [(d, None) for d, *_ in rows if d not in (76, 77, 78, 80)]
