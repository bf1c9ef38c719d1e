"""A quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

A word falls into one of WORD_ROWS hash buckets.  Its vector is the bucket's sparse random index vector plus the
sum of the index vectors that stood near it in the training texts, brought to unit length.  A word also has a
shape (how much of it is capitals, digits, signs, and its length), a shape an index vector of its own.  A
document's input is the mean of its word vectors, rare words weighing more, the mean of its shape vectors, and a
few numbers about its length and repetition.  The network's output is divided by a temperature fitted on rows held
back from its training, which makes its probabilities calibrated.

Word vectors and the frequencies that weigh them come from all training texts, labelled or not.  The network alone is
trained on a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.hashing import U64, hashed_texts, mix, texts_of
from lodestone.llm.rows import beside, column, trimmed
from lodestone.plans.materialize import cut, release

WORD_ROWS = 1 << 15
WORD_DIM = 64
SHAPE_DIM = 48
SHAPES = 1024
#: Words to either side whose index vectors a word's context takes in.
REACH = 2
INPUTS = WORD_DIM + SHAPE_DIM + 8


@dataclass(frozen=True)
class QualityTraining:
    #: Labelled rows read at most, chosen by a hash of their id.
    sample: int = 6000
    hidden: int = 32
    epochs: int = 60
    rate: float = 0.003
    decay: float = 1e-4
    seed: int = 5


def index_vectors(rows: int, dim: int, salt: int) -> np.ndarray:
    """Sparse ternary vectors: 8 places of each row hold +1 or -1."""
    out = np.zeros((rows, dim), np.float32)
    for j in range(8):
        h = mix(np.arange(rows, dtype=U64) * U64(16) + U64(j) + U64(salt << 32))
        out[np.arange(rows), (h >> U64(8)) % U64(dim)] += np.where(h & U64(1), 1, -1)
    return out


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number below SHAPES for each word from its counts of capitals, digits, signs and bytes."""
    sums = []
    for kind in ((data >= 65) & (data <= 90), (data >= 48) & (data <= 57), (data < 128) & ~(((data | 32) >= 97) & ((data | 32) <= 122)) & ~((data >= 48) & (data <= 57))):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind, out=total[1:])
        sums.append(total[ends] - total[starts])
    n = ends - starts
    some = lambda c: np.where(c == 0, 0, np.where(c == 1, 1, np.where(c < n, 2, 3)))
    long = np.minimum(np.log2(n).astype(np.int64), 7)
    signs = np.minimum(sums[2], 3)
    return (((some(sums[0]) * 4 + some(sums[1])) * 4 + signs) * 8 + long) * 2 + (sums[2] == n)


def _runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word buckets, shapes, word offsets)."""
    data, places = texts_of(column)
    for row, words, offsets, starts, ends in hashed_texts(column, lower=True, spans=True):
        n = len(offsets) - 1
        yield row, (words & U64(WORD_ROWS - 1)).astype(np.int64), _shapes(data[places[row] : places[row + n]], starts, ends), offsets


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, count, context): sums over this task's texts."""
    index = np.zeros((WORD_ROWS + 1, WORD_DIM), np.int8)  # the last row for where a text ends
    index[:-1] = index_vectors(WORD_ROWS, WORD_DIM, 1)
    total, count = np.zeros((WORD_ROWS, WORD_DIM), np.float32), np.zeros(WORD_ROWS, np.int64)
    for batch in batches:
        for _, words, _, offsets in _runs(batch.column(0)):
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            count += np.bincount(words, minlength=WORD_ROWS)
            for i in range(0, len(words), 1 << 14):
                at = np.arange(i, min(i + (1 << 14), len(words)))
                near = np.zeros((len(at), WORD_DIM), np.int8)
                for step in (*range(-REACH, 0), *range(1, REACH + 1)):
                    other = np.clip(at + step, 0, len(words) - 1)
                    near += index[np.where((other == at + step) & (owner[other] == owner[at]), words[other], WORD_ROWS)]
                order = np.argsort(words[at], kind="stable")
                found, starts = np.unique(words[at][order], return_index=True)
                total[found] += np.add.reduceat(near[order].astype(np.float32), starts, axis=0)
    seen = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), pa.ListArray.from_arrays(np.arange(len(seen) + 1, dtype=np.int32) * WORD_DIM, pa.array(total[seen].reshape(-1)))], names=["bucket", "n", "context"])


def inputs(column: pa.Array, words_table: np.ndarray, shape_table: np.ndarray) -> np.ndarray:
    """[rows, INPUTS] for a binary column of texts; a text without words has zeros."""
    out = np.zeros((len(column), INPUTS), np.float32)
    for row, words, shapes, offsets in _runs(column):
        n = np.diff(offsets)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        starts = offsets[:-1][some]
        count = n[some][:, None].astype(np.float32)
        here = row + some
        pooled = np.add.reduceat(words_table[words], starts, axis=0) / count
        out[here, :WORD_DIM] = pooled
        out[here, WORD_DIM : WORD_DIM + SHAPE_DIM] = np.add.reduceat(shape_table[shapes], starts, axis=0) / count
        same = np.zeros((len(words), 2), np.float32)
        for step in (1, 2):
            same[step:, step - 1] = words[step:] == words[:-step]
        first = np.zeros(len(words), np.float32)
        owner = np.repeat(np.arange(len(n)), n)
        first[np.unique(owner * WORD_ROWS + words, return_index=True)[1]] = 1
        extra = np.add.reduceat(np.concatenate([same, first[:, None]], 1), starts, axis=0) / count
        out[here, -8:-5] = extra
        out[here, -5] = np.log1p(count[:, 0])
        out[here, -4] = np.sqrt((pooled**2).sum(1))
        out[here, -3] = np.sqrt((out[here, WORD_DIM : WORD_DIM + SHAPE_DIM] ** 2).sum(1))
        out[here, -2] = extra[:, 2] * np.log1p(count[:, 0])
        out[here, -1] = 1
    return out


class QualityModel:
    """Tables of word and shape vectors, the network's weights, the scaling of its inputs, and its temperature."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray):
        self.words, self.shapes = words, shapes
        self.mean, self.scale = np.zeros(INPUTS, np.float32), np.ones(INPUTS, np.float32)
        self.w1, self.b1 = np.zeros((INPUTS, 1), np.float32), np.zeros(1, np.float32)
        self.w2, self.b2 = np.zeros(1, np.float32), np.float32(0)
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, t: QualityTraining) -> None:
        """Adam on the logistic loss; every fifth row is held back, the best epoch on these is kept and its temperature fitted."""
        rng = np.random.default_rng(t.seed)
        order = rng.permutation(len(x))
        back, fit = order[::5], np.setdiff1d(order, order[::5])
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        weights = [rng.normal(0, (2 / INPUTS) ** 0.5, (INPUTS, t.hidden)).astype(np.float32), np.zeros(t.hidden, np.float32), rng.normal(0, t.hidden**-0.5, t.hidden).astype(np.float32), np.zeros(1, np.float32)]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        best, step = (np.inf, weights), 0
        for _ in range(t.epochs):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
                h = np.maximum(z[at] @ weights[0] + weights[1], 0)
                error = (1 / (1 + np.exp(-(h @ weights[2] + weights[3]))) - y[at]) / len(at)
                into = np.outer(error, weights[2]) * (h > 0)
                step += 1
                for i, g in enumerate((z[at].T @ into + t.decay * weights[0], into.sum(0), h.T @ error, error.sum(keepdims=True))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    weights[i] = weights[i] - (t.rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            logit = np.maximum(z[back] @ weights[0] + weights[1], 0) @ weights[2] + weights[3]
            loss = np.logaddexp(0, np.where(y[back] > 0, -logit, logit)).mean()
            if loss < best[0]:
                best = (loss, list(weights))
        self.w1, self.b1, self.w2, self.b2 = best[1]
        logit = self.logits(x[back])
        self.temperature = min(np.exp(np.linspace(-1.5, 2, 71)), key=lambda s: np.logaddexp(0, np.where(y[back] > 0, -logit, logit) / s).mean())


def _features(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = inputs(batch.column(2), *shared.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * INPUTS, pa.array(x.reshape(-1)))], names=["id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, t: QualityTraining = QualityTraining(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", corpus: DataFrame | None = None) -> QualityModel:
    """A model of the documents that labels names.  Labels other than 0 and 1 are left out; a document with both counts as 1.

    Contexts and frequencies of words come from all of corpus, labelled or not (docs if it isn't given).

    With labels of one kind only, or none, the model returns that kind's share for every text.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, t.sample / max(1, known.count()))
    chance = F.pmod(F.xxhash64("id", F.lit(t.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(chance < share)  # about t.sample rows, so it may be broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "id")
    sample = cut(sample.select("id", "label", "text"), "quality-sample")
    every = (docs if corpus is None else corpus).select(F.col(text_col).cast("binary").alias("text"))
    parts = every.mapInArrow(_contexts, "bucket long, n long, context array<float>")
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("context")[i]) for i in range(WORD_DIM)]).alias("context"))
    found = sums.toArrow()  # WORD_ROWS rows at most
    words, n = index_vectors(WORD_ROWS, WORD_DIM, 1), np.zeros(WORD_ROWS)
    if len(found):
        at = found["bucket"].to_numpy()
        context = found["context"].combine_chunks().flatten().to_numpy().reshape(-1, WORD_DIM)
        n[at] = found["n"].to_numpy()
        words[at] += context / np.maximum(1e-9, np.sqrt((context**2).sum(1, keepdims=True))) * np.sqrt(8.0)
    words /= np.maximum(1e-9, np.sqrt((words**2).sum(1, keepdims=True)))
    words *= (1e-3 / (1e-3 + n / max(1.0, n.sum())))[:, None]
    model = QualityModel(words.astype(np.float32), index_vectors(SHAPES, SHAPE_DIM, 2))
    shared = spark.sparkContext.broadcast((model.words, model.shapes))
    rows = sample.mapInArrow(partial(_features, shared=shared), "id long, label int, x array<float>").toArrow().sort_by("id")
    y = rows["label"].to_numpy().astype(np.float32) if len(rows) else np.zeros(0, np.float32)
    if len(rows) >= 20 and 0 < y.mean() < 1:
        model.train(rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, INPUTS), y, t)
    else:
        model.b2 = np.float32(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    release(sample)
    return model


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        p = model.probabilities(inputs(batch.column(batch.num_columns - 1), model.words, model.shapes))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The columns of docs, without the text, with a score from 0 to 1; null and empty texts are scored as texts without words.

    Rows that repeat get one score each; a column `score` of docs is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text_col, "score")]
    return beside(docs, rest, column(text_col).cast("binary"), partial(trimmed(_score), shared=shared), "score double")


def op5_random_indexing_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of each document, learned from labels of those whose crc32(doc_id) mod 5 is not 0."""
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out, "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = fit(docs, labels, corpus=docs.where("not coalesce(held_out, false)"))
    return score(docs, model).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
