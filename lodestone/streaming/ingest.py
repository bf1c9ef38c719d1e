"""Indexing a directory as its files arrive, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.index import Index


def ingest(index: Index, arrivals: DataFrame, text: Column, name: str, checkpoint: str, once: bool = True, **settings) -> StreamingQuery:
    """Starts taking a stream of files (key, title, path, fingerprint[, meta, content ...]) into the index.

    Each micro-batch is one commit of the index, which has the batch's number under the stream's name.  A batch that
    broke off before its commit is taken anew, and one that broke off after it isn't taken twice, so nothing is lost
    or repeated.  A file of a known path replaces the one before; nothing is removed.  With `once` the stream ends
    when no new file is left; a name belongs to one checkpoint.
    """

    def take(batch: DataFrame, number: int) -> None:
        index.add(batch, text, name, number, **settings)

    writer = arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
