"""Recognised texts of scanned PDFs, kept by the digest of the file's content, so they outlive renames and copies.

The store is a folder of two Parquet tables that only grow: `texts` (sha, text, ok) and `paths` (path, sha) of the files
that were asked for.  A fill appends what it has done after every round, so one that breaks off loses a round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.index import Index
from lodestone.plans.materialize import cut, release
from lodestone.sources.files import content_sha, ocr_targets, run_ocr

SCHEMAS = {"texts": "sha string, text string, ok boolean", "paths": "path string, sha string"}


def is_pdf(path: Column, content_type: Column) -> Column:
    return F.coalesce(content_type == "application/pdf", F.lit(False)) | F.coalesce(F.lower(path).endswith(".pdf"), F.lit(False))


class OcrStore:
    """The store at a path (any file system that Spark reaches); a path that holds nothing yet is an empty store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def texts(self) -> DataFrame:
        """(sha, text, ok), a row for each content; of several attempts one that succeeded."""
        best = F.max(F.struct("ok", "text")).alias("best")
        return self._rows("texts").groupBy("sha").agg(best).select("sha", "best.text", "best.ok")

    def recognised(self) -> DataFrame:
        """(path) of the files asked for whose content has a text that isn't blank."""
        found = self.texts().where("ok").where(F.col("text").rlike(r"(?U)\S")).select("sha")
        return self._rows("paths").join(found, "sha", "left_semi").select("path").distinct()

    def fill(self, files: DataFrame, read: Callable[[bytes], str | None], per_round: int = 1000) -> dict[str, int]:
        """Recognises the contents of files (path, content) that the store has no text of; returns counts of files.

        Equal contents are read once.  `done` counts files whose content has been recognised, now or before, `failed`
        the others; a failure is tried again by the next fill.  Rounds of about per_round contents are appended one by
        one.  A row without content fails and leaves nothing.
        """
        # one file of each content is read; a path of null is a place like others
        place = F.coalesce("path", F.lit("")).alias("place")
        asked = cut(files.select("path", place, "content", content_sha(F.col("content")).alias("sha")), "ocr-asked")
        known = self.texts().where("ok").select("sha")
        todo = asked.where("sha is not null").groupBy("sha").agg(F.min("place").alias("place")).join(known, "sha", "left_anti")
        todo = cut(todo, "ocr-todo")
        new = asked.where("sha is not null").select("path", "sha").distinct()
        self._append("paths", new.join(self._rows("paths"), ["path", "sha"], "left_anti"))
        rounds = max(1, -(-todo.count() // per_round))
        for k in range(rounds):
            mine = todo.where(F.pmod(F.xxhash64("sha"), F.lit(rounds)) == k)
            made = run_ocr(asked.join(mine, ["sha", "place"], "left_semi").dropDuplicates(["sha"]), read)
            self._append("texts", made.select("sha", "text", "ok"))
        ok = self.texts().where("ok").select("sha", F.lit(True).alias("ok"))
        counts = {r["ok"]: r["n"] for r in asked.select("path", "sha").join(ok, "sha", "left").groupBy(F.coalesce("ok", F.lit(False)).alias("ok")).agg(F.count("*").alias("n")).collect()}
        release(asked, todo)
        return {"done": counts.get(True, 0), "failed": counts.get(False, 0)}

    def attach(self, files: DataFrame) -> DataFrame:
        """files (path, content_type, content, ...) with `sidecar`, the stored text of a PDF, if any.

        The content of a file that has one is null, so no plug-in reads it again: only files without text get here.
        Files that aren't PDFs, or have no content, have keys of their own, so that no key gathers them.
        """
        own = F.concat(F.lit("path:"), F.coalesce("path", F.lit("")))
        sha = F.when(is_pdf(F.col("path"), F.col("content_type")), content_sha(F.col("content")))
        texts = self.texts().where("ok").select(F.col("sha").alias("__sha"), F.col("text").alias("sidecar"))
        out = files.withColumn("__sha", F.coalesce(sha, own)).join(texts, "__sha", "left").drop("__sha")
        return out.withColumn("content", F.when(F.col("sidecar").isNull(), F.col("content")))


def ocr_missing(index: Index, source: DataFrame, store: OcrStore, read: Callable[[bytes], str | None], per_round: int = 1000) -> dict[str, int]:
    """Recognises the PDFs that an index lists as without text; returns counts, see fill().

    source is (path, content, ...) as for sync().  A file that it doesn't have any more is counted as failed.
    """
    targets = ocr_targets(index.table("files")).select("path")
    here = cut(source.select("path", "content").join(targets, "path", "left_semi"), "ocr-files")
    gone = targets.join(here.select("path"), "path", "left_anti").count()
    counts = store.fill(here, read, per_round)
    release(here)
    return counts | {"failed": counts["failed"] + gone}
