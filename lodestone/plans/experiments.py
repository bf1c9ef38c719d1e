"""Append-only results of experiments: a record for each piece of work, resumed where a run broke off."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import EnvironmentFailure
from lodestone.plans.materialize import cut, release

_RAW = "ckpt string, fingerprint string, ts double, error string, raw string"
_BAD = "__unfit"


class Results:
    """JSON lines (ckpt, fingerprint, ts, error, result) at a path of any file system; fields are those of `result`.

    Spark publishes the lines of a task once, whatever attempts it takes, so a record isn't doubled by lost executors.
    """

    def __init__(self, spark: SparkSession, path: str, fields: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fields = T.StructType.fromDDL(fields)
        self.schema = T.StructType.fromDDL("ckpt string, fingerprint string, ts double, error string").add("result", self.fields)

    def records(self) -> DataFrame:
        """All records; broken lines are left out."""
        try:
            return self.spark.read.schema(self.schema).option("mode", "DROPMALFORMED").json(self.path).where("ckpt is not null")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        """The newest record of each ckpt; of two of one time that without an error."""
        order = F.struct("ts", F.col("error").isNull())
        newest = self.records().groupBy("ckpt").agg(F.max_by(F.struct("fingerprint", "ts", "error", "result"), order).alias("r"))
        return newest.select("ckpt", "r.*")

    def remaining(self, work: DataFrame) -> DataFrame:
        """The work (ckpt, fingerprint, ...) whose newest record isn't a result of the same fingerprint; equal ckpts once."""
        done = self.latest().where("error is null").select("ckpt", F.col("fingerprint").alias("__then"), F.lit(True).alias("__done"))
        left = work.where("ckpt is not null").join(done, "ckpt", "left")
        return left.where(F.col("__done").isNull() | ~F.col("fingerprint").eqNullSafe(F.col("__then"))).drop("__then", "__done").dropDuplicates(["ckpt"])

    def run(self, work: DataFrame, process: Callable[[dict], dict], per_round: int = 1000, rounds: int | None = None) -> dict[str, int]:
        """Processes what remains of work (ckpt, fingerprint, ...) and returns how much was done, failed and is left.

        process(row) gives the fields of a result.  A row on which it raises, or whose result doesn't fit the fields,
        has a record with the error and is tried again by the next run; EnvironmentFailure ends this one.  Rounds of
        about per_round rows are appended one by one, so a run that breaks off loses its last round at most; with
        `rounds` it ends after so many.
        """
        todo = cut(self.remaining(work), "experiment")
        n = todo.count()
        lots = max(1, -(-n // per_round))
        counts = {"done": 0, "failed": 0, "left": n}
        for k in range(lots if rounds is None else min(rounds, lots)):
            mine = todo.where(F.pmod(F.xxhash64("ckpt"), F.lit(lots)) == k)
            made = cut(self._processed(mine, process), "experiment-round")  # counted and appended, but processed once
            self._append(made)
            for r in made.groupBy(F.col("error").isNull().alias("ok")).agg(F.count("*").alias("n")).collect():
                counts["done" if r["ok"] else "failed"] += r["n"]
                counts["left"] -= r["n"]
            release(made)
        release(todo)
        return counts

    def _append(self, made: DataFrame) -> None:
        made.write.mode("append").json(self.path)

    def _processed(self, rows: DataFrame, process: Callable[[dict], dict]) -> DataFrame:
        read = T.StructType([*self.fields.fields, T.StructField(_BAD, T.StringType())])
        got = rows.mapInPandas(lambda batches: _tried(batches, process), _RAW)
        got = got.withColumn("__r", F.from_json("raw", read, {"columnNameOfCorruptRecord": _BAD}))
        unfit = F.col("error").isNull() & F.col(f"__r.{_BAD}").isNotNull()
        error = F.when(unfit, F.concat(F.lit("the result doesn't fit: "), F.substring("raw", 1, 200))).otherwise(F.col("error"))
        result = F.struct(*[F.col(f"__r.`{f.name}`").alias(f.name) for f in self.fields])
        return got.select("ckpt", "fingerprint", "ts", error.alias("error"), F.when(error.isNull(), result).alias("result"))


def _tried(batches: Iterator[pd.DataFrame], process: Callable[[dict], dict]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
            raw = error = None
            try:
                raw = json.dumps(process(row))
            except EnvironmentFailure:
                raise
            except Exception as e:  # noqa: BLE001  the row is recorded as failed, the others go on
                error = f"{type(e).__name__}: {e}"[:500]
            out.append((row["ckpt"], row["fingerprint"], time.time(), error, raw))
        yield pd.DataFrame(out, columns=["ckpt", "fingerprint", "ts", "error", "raw"])
