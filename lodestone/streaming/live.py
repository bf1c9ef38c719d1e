"""Live queries: a stream of lines is answered block by block, the newest line of each micro-batch only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest(batch: DataFrame, order: list[str]) -> DataFrame:
    """The last row in order; what came before it in the batch was overtaken."""
    return batch.orderBy(*[F.desc(c) for c in order]).limit(1)


def answer(batch: DataFrame, search: Callable[[DataFrame], DataFrame], order: list[str], text: str = "query") -> list[str]:
    """The block of lines for the newest query of a batch: its result lines and an empty line.

    An empty query gives an empty block; a failed search gives a line that says so and leaves the session running.
    """
    rows = newest(batch, order).select(F.lit(0).cast("long").alias("qid"), F.trim(F.col(text)).alias("query")).collect()
    if not rows:
        return []
    if not rows[0]["query"]:
        return [""]
    try:
        asked = batch.sparkSession.createDataFrame([(0, rows[0]["query"])], "qid long, query string")
        found = [r["line"] for r in search(asked).orderBy("rank").collect()]
    except Exception as e:  # noqa: BLE001  the session goes on with the next query
        found = [f"error: {e}"]
    return [*found, ""]


def live(stream: DataFrame, search: Callable[[DataFrame], DataFrame], emit: Callable[[list[str]], None], order: list[str], text: str = "query", checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Starts answering a streaming DataFrame of lines; search(queries) returns (qid, rank, line), emit takes a block."""

    def block(batch: DataFrame, _: int) -> None:
        lines = answer(batch, search, order, text)
        if lines:
            emit(lines)

    writer = stream.writeStream.foreachBatch(block)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def file_arrivals(spark, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the JSON lines of files that arrive in a folder, some files at a time if asked."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(path)
