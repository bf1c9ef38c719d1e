"""From raw documents to token ids: language, near duplicates, repeated passages, source mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared
folder and gives the next stage a scan of it.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, minhash, mixing, substrings
from lodestone.llm.rows import fresh, packed, unpacked
from lodestone.plans.materialize import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (or without a text); a null lang becomes the predicted one.

    If no document has a lang, there is nothing to predict from, and lang stays null.  Rows that repeat stay or go
    together; an empty table gives no rows; columns of any name keep their values.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(langid.has_letter(F.col("text")))
    named = langid.identify(docs.select(packed(docs, "text"), F.col("text")), model).where("lang_pred <> 'und'")
    return named.select(*unpacked(docs.columns, text=F.col("text"), lang=F.coalesce("row.lang", "lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group at 5-word shingles and similarity 0.8.

    Null, empty and blank texts are in no group and stay.  Of rows that repeat one stays.  An empty table gives no
    rows; columns of any name keep their values.
    """
    return minhash.keep_one(docs, minhash.NearDuplicates(shingle_words=5, percent=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of repeated windows of 35 words; a document of which nothing is left goes.

    Texts of which nothing is removed keep their bytes, null and empty ones included.  n_chars, where docs has it,
    is counted anew for changed texts.  All other columns, whatever their names, keep their values.
    """
    missing = fresh("missing", docs.columns)
    cleaned = substrings.remove_repeats(docs.withColumn(missing, F.col("text").isNull()), want=("n_removed", "kept_text"))
    changed = F.col("n_removed") > 0
    kept = cleaned.where("n_removed = 0 or length(kept_text) > 0").withColumn("kept_text", F.col("kept_text").cast("string"))
    replaced = {"text": F.when(~F.col("row").getField(missing), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(changed, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*unpacked(docs.columns, **replaced))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture of sources needs it, at most twice.

    A null source is a source of its own.  Texts without words are taken with the whole copies of their source only.
    Equal rows are drawn one by one.  An empty table gives no rows; columns of any name keep their values.
    """
    return mixing.mix_sources(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digest of the bytes that they decode to.

    Null and empty texts have no ids.  Rows that repeat are each encoded.  The result has doc_id and source, and no
    other column of docs.  An empty table gives no rows.
    """
    shared = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode(docs.select("doc_id", "source", "text"), shared, keep_text=False, want=("n_tokens", "ids", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mixing", source_mixture),
    ("byte-level BPE", encoding),
]

#: Connected components, windows over word sequences and the tokenizer aren't expressible in one SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
