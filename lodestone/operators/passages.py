"""Which documents hold a passage word for word, found by a few of its words before the texts are compared."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import slices
from lodestone.operators.retrieval import QUERY_BLOCK

#: Words of an anchor, and passages and their bytes that are sent to the tasks at most; with more there is a join.
ANCHOR, BROADCAST_ANCHORS, BROADCAST_BYTES = 3, 200_000, 1 << 26


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))


def _places(words: Column, first: int, skip: int) -> Column:
    """Where ANCHOR words in a row start (from 1), from the word `first` on, without the last `skip` words."""
    last = F.size(words) - ANCHOR - skip + 1
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def _anchors(words: Column, first: int, skip: int) -> Column:
    return F.transform(_places(words, first, skip), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(ANCHOR)]))


def _holding(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(qid, doc_id) of (doc_id, text) and the shared (qid, passage, anchor): texts that have a passage's anchor are compared with it."""
    asked = shared.value
    coded = asked["anchor"].combine_chunks().flatten().dictionary_encode()
    words, n = coded.dictionary, len(coded.dictionary)
    x, y, z = coded.indices.to_numpy().astype(np.int64).reshape(-1, ANCHOR).T
    keys = (x * n + y) * n + z
    order = np.argsort(keys, kind="stable")
    keys, passages = keys[order], [p.encode() for p in asked["passage"].to_pylist()]
    for batch in batches:
        start = 0
        for part in slices(batch.column(1)):
            lists = pc.ascii_split_whitespace(part)
            row = pc.list_parent_indices(lists).to_numpy()
            code = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=words), -1).to_numpy().astype(np.int64)
            x, y, z = code[:-2], code[1:-1], code[2:]
            at = np.flatnonzero((x >= 0) & (y >= 0) & (z >= 0) & (row[:-2] == row[2:]))
            key = (x[at] * n + y[at]) * n + z[at]
            first, last = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            pairs = {(int(r), int(p)) for r, a, b in zip(row[at], first, last, strict=True) for p in order[a:b]}
            texts = {r: part[r].as_py().encode() for r in {r for r, _ in pairs}}
            held = sorted((r, p) for r, p in pairs if passages[p] in texts[r])
            rows, hit = (pa.array([h[i] for h in held], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([asked["qid"].combine_chunks().take(hit), batch.column(0).take(pc.add(rows, start))], names=["qid", "doc_id"])
            start += len(part)


def holders(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents (doc_id, text) and passages (qid, passage): each document that contains the passage.

    All words of a passage but its first and last stand in such a document as whole words, so three of them in a row
    (the longest three) name candidates, and these texts alone are compared: in one pass over the texts, to which the
    passages are sent, or by a join on a hash of the three words where the passages are too many for that.  A passage too short for that is
    compared with every text, QUERY_BLOCK passages at a time.  Null and empty texts and passages hold nothing and
    are held by nothing; a repeated (qid, passage) or doc_id gives its pair once.
    """
    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    asked = passages.select("qid", "passage").where(F.length("passage") > 0).distinct().withColumn("words", _words(F.col("passage")))
    inner = F.size("words") - 2
    long, short = asked.where(inner >= ANCHOR), asked.where(inner < ANCHOR).drop("words")
    sizes = F.transform(_places(F.col("words"), 2, 1), lambda i: reduce(lambda a, b: a + b, (F.length(F.element_at("words", i + k)) for k in range(ANCHOR))))
    chosen = long.select("qid", "passage", "words", F.array_position(sizes, F.array_max(sizes)).cast("int").alias("at"))
    chosen = chosen.select("qid", "passage", F.slice("words", F.col("at") + 1, ANCHOR).alias("anchor"))
    many, size = chosen.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()
    if many <= BROADCAST_ANCHORS and size <= BROADCAST_BYTES:
        shared = documents.sparkSession.sparkContext.broadcast(chosen.toArrow().combine_chunks())
        made = T.StructType().add("qid", passages.schema["qid"].dataType).add("doc_id", documents.schema["doc_id"].dataType)
        found = texts.mapInArrow(partial(_holding, shared=shared), made)
    else:
        anchors = chosen.select(F.xxhash64(*[F.col("anchor")[k] for k in range(ANCHOR)]).alias("anchor"), "qid")
        split = texts.select("doc_id", _words(F.col("text")).alias("words"))  # a column of its own, so words are found once
        places = split.select("doc_id", F.explode(F.array_distinct(_anchors(F.col("words"), 1, 0))).alias("anchor"))
        pairs = places.join(anchors, "anchor").select("doc_id", "qid").distinct()
        found = texts.join(pairs, "doc_id").join(chosen.select("qid", "passage"), "qid").where(F.contains("text", "passage")).select("qid", "doc_id")
    n = short.count()
    blocks = -(-n // QUERY_BLOCK)
    for i in range(blocks):
        part = short.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        found = found.unionByName(texts.join(F.broadcast(part), F.contains(F.col("text"), F.col("passage"))).select("qid", "doc_id"))
    return found.distinct()
