"""Quality rules: a decision list learned from labelled statistics of texts, applied as ordered Spark conditions.

The list names low quality.  A rule is a conjunction of thresholds on statistics that a reader can check.  Rules are
made one after the other (sequential covering): one grows on two thirds of the labelled rows by the condition with
the largest information gain until it covers no good text, is pruned on the other third by dropping conditions from
its end, and takes the rows that it covers away from the next ones.  A rule that is not precise enough on the rows it
was not grown on ends the list; rules that in the end save no errors are dropped.  All that no rule names is kept.

Statistics are counted in parts of about a megabyte of text, so memory is bounded by that and the longest text.  The
list is fitted on a bounded number of labelled rows; every text is counted and judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import words as wd
from lodestone.llm.rows import beside, column, trimmed
from lodestone.plans.materialize import cut, release

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may name, each a ratio that doesn't grow with the text, but for the first.
FEATURES = ["words", "word_length", "symbols_per_word", "marks_per_word", "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "words_per_line", "capital_share", "digit_share", "short_word_share", "long_word_share", "sentence_line_share"]
SYMBOLS, CAPITALS, DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS)
SHORT, LONG = 3, 15


def _flags() -> np.ndarray:
    table = np.zeros((5, 256), bool)
    for row, chars in enumerate((SYMBOLS, CAPITALS, DIGITS, MARKS, b"\x20\x09\x0a\x0b\x0c\x0d")):
        table[row, list(chars)] = True
    return table


def repeat_words(code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text, its words in windows of three words that stand in it twice or more, all their places counted.

    code has numbers that no two texts share.
    """
    if len(code) < 3:
        return np.zeros(len(sizes), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(owner[2:] == owner[:-2])
    pair = np.unique(code[at] * (code.max() + 1) + code[at + 1], return_inverse=True)[1].reshape(-1)
    _, place, count = np.unique(pair * (code.max() + 1) + code[at + 2], return_inverse=True, return_counts=True)
    twice = at[count[place.reshape(-1)] > 1]
    inside = np.zeros(len(code), bool)
    for step in range(3):
        inside[twice + step] = True
    return wd.totals(inside, sizes)


def _distinct(code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its distinct codes and the count of the commonest; codes ascend from text to text."""
    times = np.bincount(code)
    owner = np.zeros(len(times), np.int64)
    owner[code] = np.repeat(np.arange(len(sizes)), sizes)
    top = np.zeros(len(sizes), np.int64)
    np.maximum.at(top, owner, times)
    return np.bincount(owner, minlength=len(sizes)), top


def measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of a binary array of texts: a row for each text, columns as in COUNTS and FEATURES."""
    values, sizes = wd.words(texts)
    code = wd.codes(values, sizes)
    symbols, capitals, digits, marks, blanks = wd.characters(texts, _flags())
    lines, n_lines = wd.lines(texts)
    distinct_lines, _ = _distinct(wd.codes(lines, n_lines), n_lines)
    ended = pc.match_substring_regex(lines, r"[.!?:;\"')\]][ \t\v\f\r]*$").to_numpy(zero_copy_only=False)
    length = pc.utf8_length(values).to_numpy(zero_copy_only=False)
    chars = pc.utf8_length(texts.view(pa.string())).to_numpy(zero_copy_only=False) - blanks
    distinct, top = _distinct(code, sizes)
    repeats = repeat_words(code, sizes)
    counts = np.stack([sizes, chars, symbols, n_lines - distinct_lines, repeats], 1).astype(np.int64)
    n, line, letters = np.maximum(sizes, 1), np.maximum(n_lines, 1), np.maximum(chars, 1)
    ratios = [sizes, chars / n, symbols / n, marks / n, counts[:, 3] / line, repeats / n, distinct / n, top / n, sizes / line, capitals / letters, digits / letters, wd.totals(length <= SHORT, sizes) / n, wd.totals(length >= LONG, sizes) / n, wd.totals(ended, n_lines) / line]
    return counts, np.stack(ratios, 1).astype(np.float64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in wd.parts(batch.column(1)):
            counts, features = measure(texts)
            kept = batch.column(0).slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([kept, *map(pa.array, counts.T.copy()), *map(pa.array, features.T.copy())], names=["row", *COUNTS, *FEATURES])
            at += len(texts)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs, without its text, with COUNTS (long) and FEATURES (double); columns of these names are replaced.

    n_words: words; word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_dup_lines: lines with a word
    that equal an earlier line; n_repeat_words: words in 3-word windows that stand twice or more.  All are 0 for null,
    empty and blank texts.  Rows that repeat get the same numbers each.
    """
    made = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)])
    rest = [c for c in docs.columns if c not in (text_col, *COUNTS, *FEATURES)]
    return beside(docs, rest, column(text_col).cast("binary"), trimmed(_measured), made)


@dataclass(frozen=True)
class RuleTraining:
    #: Labelled rows that the fit reads at most (about), chosen by a hash of their id.
    sample: int = 6000
    #: Share of bad texts among those a rule covers, at least, on the rows it was not grown on.
    precision: float = 0.9
    #: Bad texts of those rows that a rule must cover, at least, and conditions of a rule, at most.
    least: int = 3
    conditions: int = 4
    #: Splits tried for one rule before the list ends, and the errors that one condition must save.
    tries: int = 3
    price: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        at = x[:, FEATURES.index(self.feature)]
        return at > self.threshold if self.above else at <= self.threshold

    def column(self) -> Column:
        c = column(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), bool))


def _best(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The condition with the largest information gain for bad rows; ties go to the first feature and smallest threshold."""
    all_bad, best, found = int(bad.sum()), 1e-9, None
    before = np.log2(all_bad / len(bad))
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], np.cumsum(bad[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        for above in (False, True):
            hit = all_bad - b[cuts] if above else b[cuts]
            size = len(v) - 1 - cuts if above else cuts + 1
            gain = np.where(hit > 0, hit * (np.log2(np.maximum(hit, 1) / size) - before), 0)
            at = int(gain.argmax())
            if gain[at] > best:
                best, found = gain[at], Condition(name, above, float((v[cuts[at]] + v[cuts[at] + 1]) / 2))
    return found


def grow(x: np.ndarray, bad: np.ndarray, t: RuleTraining) -> Rule:
    """Conditions added one by one until no good row is covered."""
    rule: Rule = ()
    while bad.any() and not bad.all() and len(rule) < t.conditions:
        one = _best(x, bad)
        if one is None:
            break
        rule, inside = (*rule, one), one.holds(x)
        x, bad = x[inside], bad[inside]
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (bad - good) / all of the rows covered; the shortest of equal ones."""
    worth = []
    for n in range(1, len(rule) + 1):
        inside = covers(rule[:n], x)
        hit, size = int(bad[inside].sum()), int(inside.sum())
        worth.append((2 * hit - size) / size if size else -1.0)
    return rule[: int(np.argmax(worth)) + 1] if worth else rule


def learn(x: np.ndarray, bad: np.ndarray, t: RuleTraining = RuleTraining()) -> list[Rule]:
    """The ordered rules for bad rows, of features x (a column for each of FEATURES).  Without bad rows there are none."""
    rng = np.random.default_rng(t.seed)
    rules: list[Rule] = []
    left = np.arange(len(x))
    failed = 0
    while failed < t.tries and bad[left].any():
        # both kinds are dealt two to one between growing and pruning
        lot = np.zeros(len(left), bool)
        for kind in (True, False):
            of = np.flatnonzero(bad[left] == kind)
            lot[rng.permutation(of)[: (2 * len(of) + 2) // 3]] = True
        growing, back = left[lot], left[~lot]
        rule = grow(x[growing], bad[growing], t)
        if rule:
            rule = prune(rule, x[back], bad[back])
        inside = covers(rule, x[back])
        hit = int(bad[back][inside].sum())
        if not rule or hit < t.least or hit < t.precision * inside.sum():
            failed += 1
            continue
        rules.append(rule)
        left, failed = left[~covers(rule, x[left])], 0
    return simplified(rules, x, bad, t)


def simplified(rules: list[Rule], x: np.ndarray, bad: np.ndarray, t: RuleTraining) -> list[Rule]:
    """The rules without those that don't save t.price errors for each of their conditions, the last first."""
    errors = lambda of: int((reduce(np.logical_or, (covers(r, x) for r in of), np.zeros(len(x), bool)) != bad).sum())
    for rule in reversed(list(rules)):
        others = [r for r in rules if r is not rule]
        if errors(others) <= errors(rules) + t.price * len(rule):
            rules = others
    return rules


@dataclass(frozen=True)
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def fired(self) -> Column:
        """The number (from 1) of the first rule that holds; null if none does."""
        out = F.lit(None).cast("int")
        for n, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(n)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join([*(f"{n}. drop if {' and '.join(map(str, r))}" for n, r in enumerate(self.rules, 1)), "otherwise keep"])


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, t: RuleTraining = RuleTraining(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DecisionList:
    """The list learned from the documents that labels names and that don't fail the base rules.

    Labels other than 0 and 1 and null ids are left out; a document with both labels counts as good.  Without
    labelled rows of both kinds the list is empty and keeps all.  Reruns choose the same rows and learn the same list.
    """
    known = labels.where(column(label_col).isin(0, 1) & column(id_col).isNotNull())
    known = known.groupBy(column(id_col).alias("id")).agg((F.max(column(label_col)) == 0).alias("bad"))
    share = min(1.0, t.sample / max(1, known.count()))
    chance = F.pmod(F.xxhash64("id", F.lit(t.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(chance < share)  # about t.sample rows, so it may be broadcast
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = cut(statistics(rows).where(~base_failed()).select("id", "bad", *FEATURES), "rule-sample")
    found = sample.toArrow().sort_by([(n, "ascending") for n in ("id", "bad", *FEATURES)])
    release(sample)
    x = np.stack([found[f].to_numpy() for f in FEATURES], 1)
    return DecisionList(learn(x, found["bad"].to_numpy(zero_copy_only=False).astype(bool), t))


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """statistics() of docs with base_failed, rule (the number of the first rule that holds, or null) and kept.

    Columns of docs of these names are replaced.  Null, empty and blank texts fail the base rules.
    """
    counted = statistics(docs.drop("base_failed", "rule", "kept"), text_col)
    return counted.withColumn("base_failed", base_failed()).withColumn("rule", rules.fired()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op11_learned_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The base rules and the learned decision list over all documents, learned from labels of those whose crc32(doc_id) mod 5 is not 0."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out.alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    judged = judge(docs, fit(docs, labels))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "rule", "held_out")
