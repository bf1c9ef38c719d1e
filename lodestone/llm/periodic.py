"""Periodic runs of words, by heavy/light lag counting.

A run of period q has many words that equal the word q further on, so a lag is looked at only if a text has enough
such matches.  Matches of all lags are counted without comparing all pairs: those of a frequent word by the
autocorrelation of its places (one Fourier transform each, exact after rounding), those of a rare word by the
differences of its places.  For a lag with enough matches, every q-th word is compared first; only where several of
these match in a row are the islands of consecutive matches measured.

Texts are worked on in parts of about a megabyte, so memory is bounded by that and by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words as wd
from lodestone.llm.rows import beside, column, trimmed

#: Place differences, or compared places, that are held at once.
HELD = 1 << 20
MADE = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


@dataclass(frozen=True)
class RunRule:
    #: Words of a run, and periods in it, at least (two periods or more, so that a run's smallest period divides its others).
    words: int = 6
    periods: int = 4

    def __post_init__(self):
        if self.periods < 2 or self.words < 1:
            raise ValueError("a run has at least one word and two periods")


def is_frequent(times: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the differences of so many places cost more than a Fourier transform over n words."""
    return times.astype(np.float64) ** 2 > 8 * n * np.log2(n + 2)


def lag_matches(word: np.ndarray, sizes: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each text in turn, the number of places i with word[i] = word[i + q], for q from 0 (left 0) to its limit.

    word has codes that no two texts share.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start, base = np.cumsum(sizes) - sizes, np.cumsum(limit + 1) - (limit + 1)
    found = np.zeros(int((limit + 1).sum()), np.int64)
    times = np.bincount(word)
    order = np.argsort(word, kind="stable")
    code, text = word[order], owner[order]
    heavy = is_frequent(times[code], sizes[text])
    place, code, text = order[~heavy], code[~heavy], text[~heavy]
    at, step, held, n_held = np.arange(len(place)), 0, [], 0
    while len(at):  # the step-th next place of the same word, for all words at once
        step += 1
        at = at[at + step < len(place)]
        gap = place[at + step] - place[at]
        near = (code[at + step] == code[at]) & (gap <= limit[text[at]])
        at, gap = at[near], gap[near]
        held.append(base[text[at]] + gap)
        n_held += len(at)
        if n_held > HELD or not len(at):
            keys = np.concatenate(held)
            found += np.bincount(keys, minlength=len(found))
            held, n_held = [], 0
    place = order[heavy]
    edges = np.flatnonzero(np.diff(word[place], prepend=-1))
    power: np.ndarray | None = None
    for i, one in enumerate(np.split(place, edges[1:]) if len(edges) else []):
        d = owner[one[0]]
        width = 1 << int(sizes[d] + limit[d]).bit_length()
        signal = np.zeros(width)
        signal[one - start[d]] = 1
        spectrum = np.abs(np.fft.rfft(signal)) ** 2
        power = spectrum if power is None else power + spectrum
        if i + 1 == len(edges) or owner[place[edges[i + 1]]] != d:  # the text's last frequent word
            lags = np.rint(np.fft.irfft(power, width)[: limit[d] + 1]).astype(np.int64)
            lags[0] = 0
            found[base[d] : base[d] + limit[d] + 1] += lags
            power = None
    return found


def _regions(word: np.ndarray, start: np.ndarray, size: np.ndarray, lag: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which pair, from, to): places between which a pair of text and lag may have an island of `row` lags or more.

    Such an island holds `row` multiples of the lag one after the other, so only multiples are compared.
    """
    count = (size - 1) // lag
    pair = np.repeat(np.arange(len(lag)), count)
    j = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    place = start[pair] + j * lag[pair]
    same = word[place] == word[place + lag[pair]]
    edge = np.flatnonzero(np.diff(same, prepend=False) | (np.diff(pair, prepend=-1) != 0))
    if not len(edge):
        return pair, pair, pair
    stop = np.append(edge[1:], len(same))
    chosen = same[edge] & (stop - edge >= row)
    first, last, pair = j[edge[chosen]], j[stop[chosen] - 1], pair[edge[chosen]]
    q = lag[pair]
    return pair, np.maximum(0, (first - 1) * q + 1), np.minimum(size[pair] - q, (last + 1) * q)


def find_runs(word: np.ndarray, sizes: np.ndarray, rule: RunRule = RunRule()) -> list[dict[tuple[int, int], int]]:
    """For each text, its runs as {(start, length): period}; word has codes that no two texts share."""
    sizes = np.asarray(sizes, np.int64)
    limit = sizes // rule.periods
    start = np.cumsum(sizes) - sizes
    runs: list[dict[tuple[int, int], int]] = [{} for _ in sizes]
    if not len(word):
        return runs
    matches = lag_matches(word, sizes, limit)
    text = np.repeat(np.arange(len(sizes)), limit + 1)
    lag = np.arange(len(text)) - np.repeat(np.cumsum(limit + 1) - (limit + 1), limit + 1)
    least = np.maximum(np.maximum(rule.words - lag, (rule.periods - 1) * lag), 1)
    enough = (lag > 0) & (matches >= least)
    text, lag, least = text[enough], lag[enough], least[enough]
    cost = np.cumsum(sizes[text] // lag)
    at = 0
    while at < len(lag):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + HELD, "right")))
        mine = slice(at, stop)
        for pair, low, high in zip(*_regions(word, start[text[mine]], sizes[text[mine]], lag[mine], rule.periods - 1), strict=True):
            d, q = int(text[at + pair]), int(lag[at + pair])
            low, high = int(low + start[d]), int(high + start[d])
            same = np.zeros(high - low + 2, np.int8)
            same[1:-1] = word[low:high] == word[low + q : high + q]
            turn = np.diff(same)
            begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                if e - b >= least[at + pair]:
                    runs[d].setdefault((low - int(start[d]) + b, e - b + q), q)  # lags ascend: the smallest period stays
        at = stop
    return runs


def _find(batches: Iterator[pa.RecordBatch], rule: RunRule) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        at = 0
        for texts in wd.parts(batch.column(1)):
            values, sizes = wd.words(texts)
            ends = np.cumsum(sizes)
            runs = find_runs(wd.codes(values, sizes), sizes, rule)
            covered, listed = np.zeros(len(values) + 1, np.int64), []
            for d, of in enumerate(runs):
                for (first, length), period in of.items():
                    covered[ends[d] - sizes[d] + first + period] += 1
                    covered[ends[d] - sizes[d] + first + length] -= 1
                listed.append([{"start": s, "length": n, "period": q} for (s, n), q in sorted(of.items(), key=lambda r: (r[0][0], r[1]))])
            keep = np.cumsum(covered[:-1]) == 0
            edges = np.concatenate([[0], np.cumsum(wd.totals(keep, sizes))]).astype(np.int32)
            left = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), values.filter(pa.array(keep))), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(listed, kind), left], names=["row", "n_words", "runs", "collapsed_text"])
            at += len(texts)


def periodic_runs(docs: DataFrame, rule: RunRule = RunRule(), text_col: str = "text") -> DataFrame:
    """The columns of docs, without its text, with n_words, runs and collapsed_text (columns of these names are replaced).

    A run is a stretch of words with smallest period q, of rule.words words and rule.periods periods at least, that no
    neighbouring word extends; runs are in order of start, then period.  collapsed_text has the words that no run
    contains after its first period, joined by one space.  Null, empty and blank texts have no words, no runs and an
    empty collapsed_text.  Rows that repeat get the same answer each; an empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "runs", "collapsed_text")]
    return beside(docs, rest, column(text_col).cast("binary"), partial(trimmed(_find), rule=rule), MADE)


def longest(runs: Column) -> Column:
    """The run of greatest length, of these the one that starts first, then the smallest period; null if there is none."""
    order = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    first = F.array_min(F.transform(runs, order))
    return F.struct(first["s"].alias("start"), (-first["l"]).alias("length"), first["p"].alias("period"))


def with_repeats(text: Column, key: Column) -> Column:
    """The text, or for one key in ten its words from some place on made periodic; a null key changes nothing.

    With h the CRC-32 of the key in decimal, g = h / 10 and n words: if h % 10 = 0, each word i >= a = g % n becomes
    word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    found = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))

    def edited(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + F.pmod(i - a, p) + 1).cast("int")))), " ")

    # A single-element array names the words, so they are found once.
    return F.when((h % 10 == 0) & (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")) > 0), F.transform(F.array(found), edited)[0]).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of each document, some documents being made periodic first (with_repeats).

    A null text has no words; a null doc_id leaves its text as it is; equal rows are answered alike.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    top = longest(F.col("runs"))
    shown = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[top[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(shown.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
