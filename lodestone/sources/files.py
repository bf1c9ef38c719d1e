"""Directories of texts and PDFs as documents with attachments."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import UsageError

SUFFIXES = ("txt", "md", "pdf")


def fingerprint(modified: Column, length: Column) -> Column:
    return F.concat_ws(":", F.unix_micros(modified), length)


#: What Spark's reader of whole files gives.
FILES = "path string, modificationTime timestamp, length long, content binary"


def _documents(files: DataFrame, base: str, content: bool) -> DataFrame:
    """The rows of scan_directory() of whole files."""
    columns = ["path", "modificationTime", "length", *(["content"] if content else [])]
    plain = base.split("://", 1)[-1].removeprefix("file:")
    key = F.substring_index(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), plain + "/", -1)
    rows = files.select(*columns).withColumn("key", key)
    suffix = F.lower(F.regexp_extract("key", r"\.([^./]+)$", 1))
    rows = rows.where(suffix.isin(*SUFFIXES) & ~F.col("key").rlike(r"(^|/)\."))
    kind = F.when(suffix == "pdf", "application/pdf").otherwise("text/plain")
    return rows.select("key", F.substring_index("key", "/", -1).alias("title"), F.col("key").alias("path"), fingerprint(F.col("modificationTime"), F.col("length")).alias("fingerprint"), kind.alias("content_type"), (F.col("content") if content else F.lit(None).cast("binary")).alias("content"))


def scan_directory(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(key, title, path, fingerprint, content_type, content) of the .txt, .md and .pdf files below root.

    The key is the path below root; files with a part that starts with a dot are left out, and files of no bytes, which
    Spark's reader doesn't give.  Null content without `content`: a listing reads no file.
    """
    base = root.rstrip("/")
    return _documents(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base), base, content)


def directory_arrivals(spark: SparkSession, root: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the rows of scan_directory(), of files as they arrive, some at a time if asked.  A path comes once."""
    base = root.rstrip("/")
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True)
    return _documents((reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(base), base, True)


def content_sha(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def extract_text(content: Column, path: Column, content_type: Column, pdf: Callable[[bytes], str | None] | None = None, sidecar: Column | None = None, errors: bool = False) -> Column:
    """The text of a file: UTF-8 with replacement for texts, a plug-in (or the sidecar) for PDFs; blank or unknown is null.

    With `errors` a struct (text, error): a file on which the plug-in fails has its message there and no text (unless
    the sidecar has one); without, such a file ends the job.
    """
    is_pdf = (content_type == "application/pdf") | F.lower(path).endswith(".pdf")
    is_text = F.lower(path).rlike(r"\.(txt|md)$")
    text = F.when(is_text & ~F.coalesce(is_pdf, F.lit(False)), F.make_valid_utf8(content.cast("string")))
    error = F.lit(None).cast("string")
    if pdf is not None:

        @F.pandas_udf("text string, error string")
        def pages(blobs: pd.Series) -> pd.DataFrame:
            rows = []
            for blob in blobs:
                try:
                    rows.append((None if blob is None else pdf(bytes(blob)), None))
                except Exception as e:  # noqa: BLE001  the file is reported as failed, the others go on
                    if not errors:
                        raise
                    rows.append((None, f"{type(e).__name__}: {e}"[:500]))
            return pd.DataFrame(rows, columns=["text", "error"])

        read = pages(F.when(is_pdf, content))
        text, error = F.when(is_pdf, read["text"]).otherwise(text), F.when(is_pdf, read["error"])
    blank = lambda c: F.when(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) == "", None).otherwise(c)
    out = F.coalesce(blank(text), F.when(is_pdf, blank(sidecar))) if sidecar is not None else blank(text)
    return F.struct(out.alias("text"), F.when(out.isNull(), error).alias("error")) if errors else out


def ocr_targets(files: DataFrame) -> DataFrame:
    """PDFs without text, which an OCR plug-in should read."""
    return files.where((F.col("status") == "no_text") & F.lower("path").endswith(".pdf"))


def run_ocr(targets: DataFrame, read: Callable[[bytes], str | None]) -> DataFrame:
    """(path, sha, text, ok) of targets (path, content): one call for each file, a failure being a row that isn't ok."""

    def each(batches):
        for batch in batches:
            texts = []
            for blob in batch["content"]:
                try:
                    texts.append(read(bytes(blob)))
                except Exception:  # noqa: BLE001  the file is reported as failed
                    texts.append(None)
            yield pd.DataFrame({"path": batch["path"], "sha": batch["sha"], "text": texts, "ok": [t is not None for t in texts]})

    return targets.select("path", content_sha(F.col("content")).alias("sha"), "content").mapInPandas(each, "path string, sha string, text string, ok boolean")


def make_source(spark: SparkSession, root: str, kind: str = "auto", content: bool = True) -> DataFrame:
    """The documents below root: a library where its database is found (or asked for), else a directory of files."""
    from lodestone.sources import library

    if kind not in ("auto", "library", "plaindir"):
        raise UsageError(f"no source {kind!r}; there are auto, library and plaindir")
    if kind == "library" or kind == "auto" and library.present(root):
        return library.scan_library(spark, root)
    return scan_directory(spark, root, content)


def read_results(spark: SparkSession, path: str, schema: str, stage: str | None = None) -> DataFrame:
    """JSON lines with malformed ones left out, of one stage if asked."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("stage") == stage) if stage else rows


def done_keys(results: DataFrame) -> DataFrame:
    return results.select("ckpt").where("ckpt is not null").distinct()


def remaining(work: DataFrame, results: DataFrame) -> DataFrame:
    """The work (ckpt, ...) that no result names."""
    return work.join(done_keys(results), "ckpt", "left_anti")


def read_tag_counts(spark: SparkSession, path: str) -> DataFrame:
    """(tag, count) of tab-separated lines whose second field is a number; of tags equal in lower case the last counts."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("n"))
    rows = rows.where((F.size("f") >= 2) & F.col("f")[1].rlike(r"^\d+$"))
    return rows.groupBy(F.lower(F.trim(F.col("f")[0])).alias("tag")).agg(F.max_by(F.col("f")[1].cast("long"), "n").alias("count"))
