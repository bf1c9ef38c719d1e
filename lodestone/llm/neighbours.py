"""Approximate nearest neighbours by additive quantisation, with exact reranking.

A vector is the sum of one codeword from each of several full-dimensional codebooks.  The codebooks are trained
on the residuals of a bounded sample; every vector is then encoded by beam search, which keeps the best partial
sums from book to book.  The index stores the codes and a norm ratio.  A query turns into a table of its inner
products with all codewords, so that a candidate's score is a few lookups; the best of each index group are scored
again on the original vectors in double precision.

Neither index nor vectors are shuffled: a block of QUERY_ROWS queries goes to the tasks, each of which reads its part
of the index in groups of GROUP_ROWS rows, scores the best of each group exactly and returns its k best of each query.
Blocks are answered in waves of WAVE, so plans stay small.  Every query meets every code, which is the part that
grows with the product of both tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.rows import trimmed
from lodestone.plans.materialize import cut

GROUP_ROWS = 16_384
QUERY_ROWS = 4_096
WAVE = 32
RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class AdditiveQuantiser:
    books: int = 24
    words: int = 64
    beam: int = 8
    #: Vectors that training reads at most, chosen by a hash of their id.
    sample: int = 10_000
    rounds: int = 8
    #: Candidates of each index group that are scored exactly, at least; and all whose looked-up score is less than
    #: so many standard errors below the k-th best, so that a dense group of almost equal vectors is ranked exactly.
    rerank: int = 600
    errors: float = 2.5
    seed: int = 7


def train(x: np.ndarray, q: AdditiveQuantiser) -> np.ndarray:
    """Codebooks [books, words, dimensions]: k-means on what the books before leave."""
    rng = np.random.default_rng(q.seed)
    rest = x.astype(np.float32).copy()
    books = np.zeros((q.books, q.words, x.shape[1]), np.float32)
    if not len(x):
        return books
    for b in range(q.books):
        centre = rest[rng.choice(len(rest), q.words, replace=len(rest) < q.words)].copy()
        for _ in range(q.rounds):
            near = ((centre * centre).sum(1) - 2 * rest @ centre.T).argmin(1)
            member = (near == np.arange(q.words)[:, None]).astype(np.float32)
            count, total = member.sum(1), member @ rest
            centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        near = ((centre * centre).sum(1) - 2 * rest @ centre.T).argmin(1)
        books[b] = centre
        rest -= centre[near]
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes [rows, books] by beam search: the error of each partial sum follows from inner products alone."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d)
    gram = flat @ flat.T
    own = np.diag(gram)
    out = np.zeros((len(x), m), np.uint8)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024].astype(np.float32)
        dots = part @ flat.T
        n = len(part)
        codes = np.zeros((n, 1, 0), np.int64)
        error = np.zeros((n, 1), np.float32)
        for b in range(m):
            here = slice(b * k, (b + 1) * k)
            cost = error[:, :, None] + (own[here] - 2 * dots[:, here])[:, None, :]
            for j in range(b):
                cost = cost + 2 * gram[j * k + codes[:, :, j], here]
            flat_cost = cost.reshape(n, -1)
            keep = min(beam, flat_cost.shape[1])
            best = np.argpartition(flat_cost, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(flat_cost, best, 1)
            parent = best // k
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), (best % k)[:, :, None]], 2)
        out[at : at + n] = codes[np.arange(n), error.argmin(1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(books.shape[0]))


def _matrix(column: pa.Array, d: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)


def _index(batches: Iterator[pa.RecordBatch], shared: Broadcast, beam: int) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, vector, codes, ratio, rest): the factor that gives the decoded sum the vector's length along it, and the square of what the sum misses."""
    books = shared.value
    for batch in batches:
        x = _matrix(batch.column(1), books.shape[2], np.float64)
        codes = encode(x, books, beam)
        made = decode(codes, books).astype(np.float64)
        along = (x * made).sum(1)
        ratio = np.where(along > 0, (x * x).sum(1) / np.where(along > 0, along, 1), 1.0)
        left = ((x - made * ratio[:, None]) ** 2).sum(1)
        blobs = pa.array([c.tobytes() for c in codes], pa.binary())
        norms = [pa.array(v.astype(np.float32)) for v in (ratio, left)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs, *norms], names=["id", "vector", "codes", "ratio", "rest"])


class _Best:
    """The k best candidates of each query of a block, while the index goes by in groups of rows."""

    def __init__(self, asked: np.ndarray, queries: np.ndarray, books: np.ndarray, q: AdditiveQuantiser, k: int):
        self.m, words, self.d = books.shape
        self.asked, self.queries, self.q, self.k = asked, queries, q, k
        self.tables = (queries.astype(np.float32) @ books.reshape(self.m * words, self.d).T).reshape(len(queries), self.m, words)
        self.lengths = np.sqrt((queries * queries).sum(1))
        self.found = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)

    def add(self, group: pa.Table) -> None:
        """Looks up the scores of a group, and scores the best of it exactly."""
        group = group.combine_chunks()
        column = lambda c: group[c].combine_chunks() if isinstance(group[c], pa.ChunkedArray) else group[c]
        ids, vectors = group["id"].to_numpy(), _matrix(column("vector"), self.d, np.float64)
        codes = np.frombuffer(b"".join(group["codes"].to_pylist()), np.uint8).reshape(-1, self.m)
        ratio = group["ratio"].to_numpy()
        take, kth = min(self.q.rerank + 1, len(ids)), min(self.k, len(ids) - 1)
        margin = self.q.errors * np.sqrt(group["rest"].to_numpy().mean() / self.d) * self.lengths
        for at in range(0, len(self.queries), 64):
            score = np.zeros((len(self.queries[at : at + 64]), len(ids)), np.float32)
            for b in range(self.m):
                score += self.tables[at : at + 64, b][:, codes[:, b]]
            score *= ratio
            ranked = -np.partition(-score, sorted({take - 1, kth}), axis=1)
            bounds = np.minimum(ranked[:, take - 1], ranked[:, kth] - margin[at : at + 64])
            for row, bound in enumerate(bounds):
                near = np.flatnonzero(score[row] >= bound)
                near = near[ids[near] != self.asked[at + row]]
                exact = (vectors[near] * self.queries[at + row]).sum(1)
                before = self.found[at + row]
                every, scores = np.concatenate([before[0], ids[near]]), np.concatenate([before[1], exact])
                order = np.lexsort((every, -scores))[: self.k]
                self.found[at + row] = every[order], scores[order]


def _search(batches: Iterator[pa.RecordBatch], shared: Broadcast, q: AdditiveQuantiser, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score): the k best of this task's part of the index for each query of a block."""
    books, asked, queries = shared.value
    best = _Best(asked, queries, books, q, k)
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, len(batch), GROUP_ROWS):
            waiting.append(batch.slice(at, GROUP_ROWS))
            if sum(map(len, waiting)) >= GROUP_ROWS:
                best.add(pa.Table.from_batches(waiting))
                waiting = []
    if sum(map(len, waiting)):
        best.add(pa.Table.from_batches(waiting))
    sizes = [len(ids) for ids, _ in best.found]
    if sum(sizes):
        columns = [np.repeat(asked, sizes), *(np.concatenate([f[i] for f in best.found]) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: an id, and a vector of the most frequent length without null or non-finite components, not all zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    length = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(F.size("vector") == (length["n"] if length else 0)).where(F.coalesce(fine, F.lit(False))).where(F.exists("vector", lambda v: v != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, q: AdditiveQuantiser = AdditiveQuantiser(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of the largest inner product, ties to the smaller id.

    A query is not its own neighbour: candidates with the query's id are left out.  Of exactly equal vectors only
    the k + 1 of the smallest ids enter the index, as no other can be a result.  With fewer candidates than k all
    are returned; empty tables give no rows.  Rows that repeat an id and a vector count once; of the vectors that
    repeat a query's id the smallest asks.
    """
    spark = vectors.sparkSession
    base = cut(usable(vectors, id_col, vector_col).dropDuplicates(["id", "vector"]), "ann-vectors")
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, q.sample / n)
    chance = F.pmod(F.xxhash64("id", F.lit(q.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = base.where(chance < share).select("id", "vector").toArrow().sort_by("id")["vector"].combine_chunks()
    d = len(base.first()["vector"])
    books = train(_matrix(sample, d, np.float64), q)
    shared = spark.sparkContext.broadcast(books)
    among = Window.partitionBy("vector").orderBy("id")
    distinct = base.withColumn("same", F.row_number().over(among)).where(F.col("same") <= k + 1).drop("same")
    index = cut(distinct.mapInArrow(partial(_index, shared=shared, beam=q.beam), "id long, vector array<double>, codes binary, ratio float, rest float"), "ann-index")
    shared.unpersist()

    asked = usable(queries, id_col, vector_col).select(F.col("id").alias("qid"), F.col("vector").alias("query")).where(F.size("query") == d)
    asked = asked.groupBy("qid").agg(F.min("query").alias("query"))
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-asked.count() // QUERY_ROWS))))), "ann-queries")
    blocks = asked.agg(F.max("block")).first()[0]
    parts = []
    for wave in range(0, -1 if blocks is None else blocks + 1, WAVE):
        sent, found = [], []
        for block in range(wave, min(wave + WAVE, blocks + 1)):
            table = asked.where(F.col("block") == block).toArrow().sort_by("qid")
            if len(table):
                sent.append(spark.sparkContext.broadcast((books, table["qid"].to_numpy(), _matrix(table["query"].combine_chunks(), d, np.float64))))
                found.append(index.mapInArrow(partial(trimmed(_search), shared=sent[-1], q=q, k=k), RESULT))
        parts.append(cut(reduce(DataFrame.union, found, spark.createDataFrame([], RESULT)), "ann-found"))
        for s in sent:
            s.unpersist()
    found = reduce(DataFrame.union, parts, spark.createDataFrame([], RESULT))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_additive_quantisation_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of each embedding whose id is divisible by 20."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.where("vec_id % 20 = 0"))
