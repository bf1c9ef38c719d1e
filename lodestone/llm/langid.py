"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language; an unseen word falls back to its character 4-grams,
and where none of these is known to 3-, 2- and 1-grams.  A text's language is the one with the largest sum over
its words.  The model is fitted on a bounded sample of labelled rows (all rows of a language that has no more
than sample_docs), which bounds its tables: they hold every word and n-gram of the sample, by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.rows import column, extended, packed, trimmed, unpacked

LETTER = regex.compile(r"\p{L}")
_EDGE = regex.compile(r"^[\W\d_]+|[\W\d_]+$")
ORDERS = (4, 3, 2, 1)
#: Words whose scores a Python worker keeps at hand; beyond these it starts anew.
CACHE = 150_000


@dataclass(frozen=True)
class LanguageModelBounds:
    #: Labelled documents of a language that the fit reads at most, chosen by a hash of their id and text.
    sample_docs: int = 1500


def _word(raw: bytes) -> str:
    return _EDGE.sub("", raw.decode("utf-8", "replace").lower())


def _key(word: str) -> int:
    """What Spark's xxhash64 gives for the word, as an unsigned number."""
    return xxhash.xxh64_intdigest(word.encode(), 42)


class BackoffModel:
    """Sorted hashes of words and of n-grams, and a table of log frequencies for each (a column for each language)."""

    def __init__(self, languages: list[str], words: np.ndarray, word_table: np.ndarray, grams: np.ndarray, gram_table: np.ndarray):
        self.languages, self.words, self.word_table, self.grams, self.gram_table = languages, words, word_table, grams, gram_table

    @staticmethod
    def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, whether they are known) of keys."""
        if not len(known):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    def scores(self, raw: list[bytes]) -> np.ndarray:
        """Log scores by word and language: of the word itself, else the mean of its longest known n-grams; zeros for a word that says nothing."""
        words = [_word(w) for w in raw]
        out = np.zeros((len(words), len(self.languages)), np.float32)
        at, known = self._find(self.words, np.fromiter(map(_key, words), np.uint64, len(words)))
        known &= np.fromiter(map(bool, words), bool, len(words))
        out[known] = self.word_table[at[known]]
        left = [i for i in np.flatnonzero(~known).tolist() if words[i]]
        for n in ORDERS:
            if not left:
                break
            padded = [f" {words[i]} " for i in left]
            sizes = np.array([max(0, len(p) - n + 1) for p in padded])
            keys = np.fromiter((_key(p[j : j + n]) for p in padded for j in range(len(p) - n + 1)), np.uint64, int(sizes.sum()))
            at, found = self._find(self.grams, keys)
            owner = np.repeat(np.arange(len(left)), sizes)[found]
            count = np.bincount(owner, minlength=len(left))
            some = np.flatnonzero(count)
            if len(some):
                starts = np.searchsorted(owner, some)
                out[np.array(left)[some]] = np.add.reduceat(self.gram_table[at[found]], starts, axis=0) / count[some, None]
            left = [i for i, c in zip(left, count.tolist(), strict=True) if not c]
        return out


class _Rows(dict):
    """Word to row number; new words wait until fill() scores them together."""

    def __init__(self, model: BackoffModel):
        self.model, self.waiting, self.done = model, [], 0
        self.table = np.zeros((1 << 16, len(model.languages)), np.float32)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = self.done + len(self.waiting)
        self.waiting.append(word)
        return at

    def fill(self) -> None:
        if not self.waiting:
            return
        end = self.done + len(self.waiting)
        if end > len(self.table):
            grown = np.zeros((max(end, 2 * len(self.table)), self.table.shape[1]), np.float32)
            grown[: self.done] = self.table[: self.done]
            self.table = grown
        for i in range(0, len(self.waiting), 1 << 14):
            part = self.waiting[i : i + (1 << 14)]
            self.table[self.done + i : self.done + i + len(part)] = self.model.scores(part)
        self.done, self.waiting = end, []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, count); n is 0 for words."""
    total: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        keys = list(total)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys]), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "n", "gram", "c"])
        total.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = Counter(text.as_buffer().to_pybytes().split() if text.is_valid else ())
            for raw, c in words.items():
                word = _word(raw)
                if word:
                    total[lang, 0, word] += c
                    padded = f" {word} "
                    for n in ORDERS:
                        for i in range(len(padded) - n + 1):
                            if n > 1 or padded[i] != " ":
                                total[lang, n, padded[i : i + n]] += c
            if len(total) > 200_000:
                yield flushed()
    if total:
        yield flushed()


def fit(labelled: DataFrame, bounds: LanguageModelBounds = LanguageModelBounds(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BackoffModel:
    """The model of the rows whose language is not null.  Reruns choose the same sample.

    Null and empty texts teach nothing.  Rows that repeat count as often as they stand.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    sizes = sorted(((r["c"], r["l"]) for r in rows.groupBy(F.col(lang_col).cast("string").alias("l")).agg(F.count("*").alias("c")).collect()), key=lambda x: x[1])  # one row for each language
    languages = [lang for _, lang in sizes]
    none = np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32)
    if not languages:
        return BackoffModel([], *none, *none)
    chance = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[x for c, lang in sizes for x in (F.lit(lang), F.lit(bounds.sample_docs / c))])[F.col(lang_col).cast("string")]
    sample = rows.where(chance < share).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    counts = sample.mapInArrow(trimmed(_count), "lang string, n int, gram string, c long").groupBy("lang", "n", F.xxhash64("gram").alias("key")).agg(F.sum("c").alias("c"))
    found = counts.toArrow()  # bounded by the sample
    n, keys, c = found["n"].to_numpy(), found["key"].to_numpy().view(np.uint64), found["c"].to_numpy()
    at = {name: i for i, name in enumerate(languages)}
    lang = np.array([at[x] for x in found["lang"].to_pylist()], np.int64)

    def tabled(orders: list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = [none]
        for order in orders:  # words, and the n-grams of each length, are distributions of their own
            mine = n == order
            own, place = np.unique(keys[mine], return_inverse=True)
            times = np.zeros((len(own), len(languages)))
            np.add.at(times, (place, lang[mine]), c[mine])
            parts.append((own, np.log((times + 0.5) / (times.sum(0) + 0.5 * (len(own) + 1))).astype(np.float32)))
        every = np.concatenate([p[0] for p in parts])
        order = np.argsort(every)
        return every[order], np.concatenate([p[1] for p in parts])[order]

    return BackoffModel(languages, *tabled([0]), *tabled(list(ORDERS)))


@F.pandas_udf(T.BooleanType())
def has_letter(texts: pd.Series) -> pd.Series:
    """Whether a text has a letter; false for null."""
    return texts.map(lambda t: t is not None and LETTER.search(t) is not None).astype(bool)


def _identify(batches: Iterator[pa.RecordBatch], shared: Broadcast, keep: int) -> Iterator[pa.RecordBatch]:
    model = shared.value
    rows = _Rows(model)
    for batch in batches:
        at: list[np.ndarray | None] = []
        for text in batch.column(batch.num_columns - 1):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if not model.languages or not LETTER.search(raw.decode("utf-8", "replace")):
                at.append(None)
                continue
            words = raw.split()
            at.append(np.fromiter(map(rows.__getitem__, words), np.int32, len(words)))
        rows.fill()
        names, scores = [], []
        for found in at:
            if found is None:
                names.append("und")
                scores.append(0.0)
                continue
            mine = rows.table[found]
            total = mine.sum(0, dtype=np.float64)
            total = (total - total.max()) / max(1.0, np.count_nonzero(mine[:, 0]) / 10)
            names.append(model.languages[int(total.argmax())])
            scores.append(float(1 / np.exp(total).sum()))
        if len(rows) > CACHE:
            rows = _Rows(model)
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:keep], "lang_pred", "score"])


def identify(docs: DataFrame, model: BackoffModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The columns of docs with lang_pred and score (columns of these names are replaced), without its text if that isn't kept.

    The language is `und` with score 0 if the text is null, empty or has no letter, or if the model knows no
    language.  Ties go to the language that sorts first.  A score is the best language's share of the softmax of
    the sums, flattened for long texts; it lies between 0 and 1.  Rows that repeat get the same answer each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", text_col)]
    rows = docs.select(packed(docs, *[c for c in docs.columns if c not in rest]), column(text_col).cast("binary").alias("in"))
    kept = rows if keep_text else rows.select("row")
    out = rows.mapInArrow(partial(trimmed(_identify), shared=shared, keep=len(kept.columns)), extended(kept, "lang_pred string, score double"))
    order = [c for c in docs.columns if c in rest or keep_text and c == text_col]
    return out.select(*unpacked(order, **({text_col: F.col("in").cast("string")} if keep_text else {})), "lang_pred", "score")


def op10_word_backoff_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"))
    model = fit(docs.where("not coalesce(held_out, false)"))
    return identify(docs.select("doc_id", "held_out", "text"), model, keep_text=False)

