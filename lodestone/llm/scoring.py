"""Scoring texts with a causal self-attention language model on subword ids, trained in numpy.

A text is the subword ids of its lower-cased words, by a public tokenizer, and one end.  The model reads the ids so
far and gives the probability of the next one, by a two-level softmax over all ids that training texts have; ids
that none has share one outcome evenly.  So a text's score is the log10 probability of its ids and its end.

Windows of WINDOW ids overlap by OVERLAP; the first window of a text scores all its ids, later ones those after the
overlap, so each is scored once.  Windows are stacked into batches under one causal mask.

The corpus is tokenized once into blocks (texts of some MB with a vocabulary of their own, words by 64-bit hashes).
In each round every block is learned from alone, from the same start, by the windows of one lot; the mean of the
blocks' weights is the next round's start.  After as many rounds as there are lots every window of the training
texts was learned from once.  A block's part doesn't depend on the task or place that it falls to.  The unigram
base scores come from word counts: vocabularies are counted in parts by hash, and a block gets its words' counts back.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import read_ranks
from lodestone.llm.hashing import U64, mix
from lodestone.llm.rows import column, trimmed
from lodestone.llm.words import words
from lodestone.plans.materialize import cut, release

#: Slots that are outcomes of the first level, slots of a cluster, and slots (the most frequent) with vectors of their own.
HEAD, CLUSTER, TRAINED = 128, 512, 8192
WINDOW, OVERLAP = 32, 4
STEP = WINDOW - OVERLAP
#: Weights that Adam takes at once.
PIECE = 16_384
#: Windows that are scored at once.
SCORED = 128
#: Texts and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 10_000, 8 << 20


@dataclass(frozen=True)
class Training:
    dim: int = 24
    #: The windows of the training texts are dealt into so many lots, and each round learns from one of them: all are learned from.
    rounds: int = 2
    batch: int = 64
    rate: float = 0.01
    seed: int = 3


class Attention:
    """One causal attention layer over subword slots, a feed-forward step, and a two-level softmax over all slots.

    The first HEAD slots are outcomes of their own, all later ones lie in clusters of CLUSTER slots: the first level
    chooses a slot or a cluster, the second a slot of the cluster.  Slots from TRAINED on have no vectors of their
    own: as inputs they share one, as outcomes they have their share of the counts of their cluster.
    """

    def __init__(self, counts: np.ndarray, t: Training):
        rng = np.random.default_rng(t.seed)
        d, self.slots, self.row, self.kept = t.dim, len(counts), None, {}
        small = lambda *shape: rng.normal(0, d**-0.5, shape).astype(np.float32)
        self.head = min(HEAD, self.slots)
        self.clusters = -(-(self.slots - self.head) // CLUSTER)
        self.own = min(self.slots, HEAD + -(-(TRAINED - HEAD) // CLUSTER) * CLUSTER)
        smooth = counts + 0.5
        edges = np.minimum(self.head + np.arange(self.clusters + 1) * CLUSTER, self.slots)
        sums = np.array([smooth[a:b].sum() for a, b in pairwise(edges.tolist())])
        first = np.log(np.concatenate([smooth[: self.head], sums]) / smooth.sum())
        inside = np.concatenate([np.log(smooth[a:b] / smooth[a:b].sum()) for a, b in pairwise(edges.tolist())] or [np.zeros(0)])
        self.fixed = inside[self.own - self.head :].astype(np.float32)
        self.p = {
            "now": small(self.own + 2, d) * 0.5,
            "last": small(self.own + 2, d) * 0.5,
            "place": small(WINDOW, d) * 0.1,
            "qkv": small(d, 3 * d),
            "o": small(d, d) * 0.5,
            "m1": small(d, 2 * d),
            "m2": small(2 * d, d) * 0.3,
            "first": small(self.head + self.clusters, d) * 0.1,
            "first_bias": first.astype(np.float32),
            "inside": small(self.own - self.head, d) * 0.1,
            "inside_bias": inside[: self.own - self.head].astype(np.float32),
        }
        self.scale = np.float32(d**-0.5)
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.seen = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([w.reshape(-1) for w in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, w in self.p.items():
            self.p[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def inputs(self, slots: np.ndarray) -> np.ndarray:
        """Input rows of slots: their own, one for all without, and BEGIN (slot -1)."""
        rows = np.where(slots < 0, self.own + 1, np.minimum(slots, self.own))
        return rows if self.row is None else self.row[rows]

    def only(self, slots: np.ndarray) -> dict[str, np.ndarray]:
        """Leave the input rows of these slots alone, as a row without gradients never moves; returns all rows for put()."""
        full = {name: self.p[name] for name in ("now", "last")}
        seen = np.flatnonzero(np.bincount(slots + 1)) - 1
        rows = np.flatnonzero(np.bincount(self.inputs(seen), minlength=self.own + 2))
        self.row = np.zeros(self.own + 2, np.int32)
        self.row[rows] = np.arange(len(rows))
        self.rows = rows
        for name, w in full.items():
            self.p[name] = w[rows]
        return full

    def put(self, full: dict[str, np.ndarray]) -> None:
        """Put the rows that only() left back among all."""
        for name, w in full.items():
            w[self.rows] = self.p[name]
            self.p[name] = w
        self.row = None

    def _forward(self, now: np.ndarray, last: np.ndarray) -> tuple:
        """Of all positions behind each other; queries, keys, values and shares by window, shares not divided by their sums."""
        p = self.p
        d = p["o"].shape[0]
        x = p["now"].take(now, 0)
        x += p["last"].take(last, 0)
        x += p["place"]
        x = x.reshape(-1, d)
        qkv = (x @ self._projection()).reshape(*now.shape, 3 * d)
        q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
        s = np.matmul(q, k.transpose(0, 2, 1))
        np.exp(s, out=s)
        s *= self.seen
        total = s.reshape(-1, WINDOW) @ np.ones(WINDOW, s.dtype)
        if not _fits(total):
            np.matmul(q, k.transpose(0, 2, 1), out=s)
            s += self.mask
            s -= s.max(2, keepdims=True)
            total = _exponentials(s.reshape(-1, WINDOW))
        r = 1 / total[:, None]
        mixed = np.matmul(s, v).reshape(-1, d)
        mixed *= r
        y = mixed @ p["o"]
        y += x
        z = y @ p["m1"]
        np.maximum(z, np.zeros_like(z), out=z)  # an array, as numpy is slower with a scalar
        h = z @ p["m2"]
        h += y
        return x, q, k, v, s, r, mixed, y, z, h

    def _projection(self) -> np.ndarray:
        """To queries, keys and values, queries scaled."""
        w = self.p["qkv"].copy()
        w[:, : len(w)] *= self.scale
        return w

    def _outcomes(self, h: np.ndarray, target: np.ndarray, learn: bool = False) -> tuple:
        """Natural log probabilities of the targets, and with learn the gradients of their negative sum."""
        p = self.p
        d = h.shape[1]
        cluster = np.maximum(target - self.head, -1) // CLUSTER
        outcome = np.where(cluster < 0, target, self.head + cluster)
        one = np.ones((len(h), d + 1), h.dtype)  # the last column meets the biases
        one[:, :d] = h
        logp, dh, g = _choose(one, self._joined("first"), outcome, learn)
        grads = None
        if learn:
            grads = {"first": g[:, :d], "first_bias": g[:, d], "inside": np.zeros_like(p["inside"]), "inside_bias": np.zeros_like(p["inside_bias"])}
        tail = np.flatnonzero(cluster >= 0)
        if not len(tail):
            return logp, dh, grads
        of = cluster[tail].astype(np.int16)
        order = np.argsort(of, kind="stable")
        tail, of = tail[order], of[order]
        item, one, more = target[tail] - self.head, one.take(tail, 0), np.zeros((len(tail), d), h.dtype)
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        part, joined = np.empty(len(tail), h.dtype), self._joined("inside")
        for i, j in pairwise(cuts):
            a = int(of[i]) * CLUSTER
            b = min(a + CLUSTER, self.slots - self.head)
            if a >= self.own - self.head:
                part[i:j] = self.fixed[item[i:j] - (self.own - self.head)]
                continue
            part[i:j], dpart, g = _choose(one[i:j], joined[a:b], item[i:j] - a, learn)
            if learn:
                more[i:j], grads["inside"][a:b], grads["inside_bias"][a:b] = dpart, g[:, :d], g[:, d]
        logp[tail] += part
        if learn:
            dh[tail] += more
        return logp, dh, grads

    def freeze(self) -> None:
        """Weights stay as they are from now on."""
        self.kept = {name: self._joined(name) for name in ("first", "inside")}

    def _joined(self, name: str) -> np.ndarray:
        """The vectors of outcomes, their biases as the last column."""
        if name in self.kept:
            return self.kept[name]
        w, bias = self.p[name], self.p[f"{name}_bias"]
        joined = np.empty((len(w), w.shape[1] + 1), w.dtype)
        joined[:, :-1], joined[:, -1] = w, bias
        return joined

    @np.errstate(over="ignore", invalid="ignore")
    def score(self, now: np.ndarray, last: np.ndarray, target: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Log probabilities of the counted positions of a batch of windows."""
        here = np.flatnonzero(counted)
        return self._outcomes(self._forward(now, last)[-1].take(here, 0), target.reshape(-1).take(here))[0]

    @np.errstate(over="ignore", invalid="ignore")
    def gradients(self, now: np.ndarray, last: np.ndarray, target: np.ndarray, counted: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, q, k, v, s, r, mixed, y, z, h = self._forward(now, last)
        here = np.flatnonzero(counted)
        _, part, grads = self._outcomes(h.take(here, 0), target.reshape(-1).take(here), learn=True)
        d = h.shape[1]
        dh = np.zeros_like(h)
        dh[here] = part
        dz = dh @ p["m2"].T
        dz *= z > 0
        grads["m2"], grads["m1"] = z.T @ dh, y.T @ dz
        dy = dz @ p["m1"].T
        dy += dh
        grads["o"] = mixed.T @ dy
        dmixed = dy @ p["o"].T
        dmixed *= r
        each = np.einsum("ij,ij->i", dmixed, mixed).reshape(*now.shape, 1)
        dmixed = dmixed.reshape(*now.shape, d)
        ds = np.matmul(dmixed, v.transpose(0, 2, 1))
        ds -= each
        ds *= s
        dqkv = np.empty((*now.shape, 3 * d), h.dtype)
        np.matmul(ds, k, out=dqkv[..., :d])
        np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., d : 2 * d])
        np.matmul(s.transpose(0, 2, 1), dmixed, out=dqkv[..., 2 * d :])
        dqkv = dqkv.reshape(-1, 3 * d)
        dx = dqkv @ self._projection().T
        dx += dy
        grads["qkv"] = x.T @ dqkv
        grads["qkv"][:, :d] *= self.scale
        grads["place"] = dx.reshape(*now.shape, d).sum(0)
        pairs = dx if d % 2 else dx.view(np.result_type(dx, np.complex64))  # two numbers are added as one complex number
        for name, rows in (("now", now), ("last", last)):
            rows = rows.reshape(-1).astype(np.int16)  # sorted by radix
            order = np.argsort(rows, kind="stable")
            rows = rows.take(order)
            starts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
            grads[name] = np.zeros_like(p[name])
            grads[name][rows.take(starts)] = np.add.reduceat(pairs.take(order, 0), starts, axis=0).view(dx.dtype)
        return grads


def _fits(total: np.ndarray) -> bool:
    """Whether sums of exponentials neither overflowed nor vanished."""
    return not len(total) or (1e-25 < total.min() and total.max() < 1e25)


def _exponentials(e: np.ndarray) -> np.ndarray:
    """Makes e its exponentials and returns their sum by row."""
    np.exp(e, out=e)
    return e @ np.ones(e.shape[1], e.dtype)


def _choose(one: np.ndarray, w: np.ndarray, outcome: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Log probabilities of one outcome for each row, and with learn the gradients of their negative sum by the inputs, and by w and its biases.

    Sums divide the narrow side of each product.
    """
    at = np.arange(len(one)) * len(w) + outcome
    e = one @ w.T
    flat = e.reshape(-1)
    logp, total = flat.take(at), _exponentials(e)
    if not _fits(total):
        np.matmul(one, w.T, out=e)
        e -= e.max(1, keepdims=True)
        logp, total = flat.take(at), _exponentials(e)
    logp -= np.log(total)
    if not learn:
        return logp, None, None
    flat[at] -= total
    r = (1 / total)[:, None]
    dh = e @ w[:, :-1]
    dh *= r
    return logp, dh, e.T @ (one * r)


class Adam:
    """m and v are held as 10 and 100 times the means, and renewed in pieces that stay in a CPU's cache."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.m, self.v = ({k: np.zeros(w.size, w.dtype) for k, w in model.p.items()} for _ in range(2))
        self.spare = np.empty(PIECE, np.float32)

    def apply(self, grads: dict[str, np.ndarray], n: int, share: float = 1.0) -> None:
        """One step by the mean gradient of n outcomes, at `share` of the full rate."""
        self.step += 1
        rate = np.float32(self.rate * share * min(1.0, self.step / 20) * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step))
        for k, w in self.model.p.items():
            flat, whole = w.reshape(-1), grads[k].reshape(-1)
            for a in range(0, len(flat), PIECE):
                part = slice(a, a + PIECE)
                m, v, g = self.m[k][part], self.v[k][part], whole[part]
                to = self.spare[: len(g)]
                g *= np.float32(1 / n)
                m *= 0.9
                m += g
                g *= g
                v *= 0.99
                v += g
                np.sqrt(v, out=to)
                to += 1e-5
                np.divide(m, to, out=to)
                to *= rate
                flat[part] -= to


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many ids (end included): each window's text, first position in the text, and first scored place in the window."""
    count = np.maximum(1, -(-(sizes - OVERLAP) // STEP))
    text = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, k * STEP, np.where(k > 0, OVERLAP, 0)


BLOCK = "ids binary, held binary, sizes binary, tokens binary, keys binary, trained binary, pieces binary, piece_sizes binary"
#: White space that can stand within a word.
ODD = re.compile(r"[^\S ]")


def _subwords(vocab: list[bytes], tokenizer: tiktoken.Encoding, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, each with a space before it, behind each other, and how many each word has; widths: the bytes of each id.

    No match of the pattern goes on behind a word without white space when a space follows, so words are encoded in one text.
    """
    text = b" ".join([b"", *vocab])
    try:
        whole = not ODD.search(text.decode())
    except UnicodeDecodeError:
        whole = False
    if whole:
        ids = np.array(tokenizer.encode_ordinary(text.decode()) if vocab else [], np.int32)
        ends, stops = np.cumsum(widths[ids]), np.cumsum(np.fromiter(map(len, vocab), np.int64, len(vocab)) + 1)
        upto = np.searchsorted(ends, stops) + 1
        return ids, np.diff(upto, prepend=0).astype(np.int32)
    pieces = [tokenizer.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in vocab]
    lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
    return np.fromiter((x for p in pieces for x in p), np.int32, int(lengths.sum())), lengths


def _blocks(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(id, held, text) to one row for each block: word numbers of its texts, and of its vocabulary, in order of 64-bit hashes, these, training counts and subword ids."""
    ranks, pattern = shared.value
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    widths[list(ranks.values())] = [len(x) for x in ranks]
    tokenizer = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for batch in batches:
        ids, held, texts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), pc.fill_null(batch.column(2), b"")
        ends, row = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while row < len(texts):
            start = row
            row = min(start + BLOCK_ROWS, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK_BYTES)) + 1, len(texts))
            found, sizes = words(pc.ascii_lower(texts.slice(start, row - start).view(pa.string())))
            numbered = found.dictionary_encode()  # numbers are in the order of first places
            vocab = numbered.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, len(vocab))
            order = np.argsort(keys)
            place = np.empty(len(vocab), np.int32)
            place[order] = np.arange(len(vocab), dtype=np.int32)
            flat = place[numbered.indices.to_numpy(zero_copy_only=False)]
            learned = np.repeat(~held[start:row], sizes)
            trained = np.bincount(flat[learned], minlength=len(vocab)).astype(np.int32)
            flat_pieces, lengths = _subwords(vocab[order].tolist(), tokenizer, widths)
            own = ids.slice(start, row - start)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in (own.fill_null(0).to_numpy(), np.stack([held[start:row], own.is_null().to_numpy(zero_copy_only=False)]).astype(np.uint8), sizes.astype(np.int32), flat, keys[order], trained, flat_pieces, lengths)],
                names=[x.split()[0] for x in BLOCK.split(", ")],
            )


def _ints(value: pa.Scalar, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


class Slots:
    """The outcomes: each id that training texts have, and the end of a text, from the most frequent on, then one for all other ids."""

    def __init__(self, counts: np.ndarray):
        """counts has the occurrences of each id and, last, of the end."""
        order = np.argsort(-counts, kind="stable")
        seen = order[counts[order] > 0]
        unseen = len(counts) - len(seen)
        self.of = np.full(len(counts), len(seen), np.int32)
        self.of[seen] = np.arange(len(seen))
        self.end = int(self.of[-1])
        self.counts = np.append(counts[seen], np.zeros(min(unseen, 1)))
        self.rare = len(seen) if unseen else -1
        self.share = -math.log(max(unseen, 1))


class Block:
    """One row of the block table; with slots, its texts as sequences of them."""

    def __init__(self, row: dict[str, pa.Scalar], slots: Slots | None = None):
        self.ids = _ints(row["ids"], np.int64)
        self.held, self.no_id = _ints(row["held"], np.uint8).reshape(2, -1).astype(bool)
        self.words, self.tokens = _ints(row["sizes"]).astype(np.int64), _ints(row["tokens"])
        self.pieces, self.lengths = _ints(row["pieces"]), _ints(row["piece_sizes"]).astype(np.int64)
        if slots is not None:
            self._sequences(slots)

    def _sequences(self, slots: Slots) -> None:
        """target: the slots of all texts behind each other, each with its end; now and last: the slots one and two before, -1 before a text."""
        starts = np.cumsum(self.lengths) - self.lengths
        per = self.lengths[self.tokens]
        done = np.cumsum(per)
        flat = self.pieces[np.repeat(starts[self.tokens] - done + per, per) + np.arange(int(per.sum()))]
        upto = np.concatenate([[0], done])
        word_ends = np.cumsum(self.words)
        self.sizes = upto[word_ends] - upto[word_ends - self.words] + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        ends = self.starts + self.sizes - 1
        self.target = np.full(int(self.sizes.sum()), slots.end, np.int32)
        inner = np.ones(len(self.target), bool)
        inner[ends] = False
        self.target[inner] = slots.of[flat]
        self.now, self.last = (np.full(len(self.target), -1, np.int32) for _ in range(2))
        self.now[1:] = self.target[:-1]
        self.now[self.starts] = -1
        self.last[1:] = self.now[:-1]
        self.last[self.starts] = -1

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return windows(self.sizes)

    def batches(self, model: Attention, chosen: np.ndarray | None, size: int) -> Iterator[tuple]:
        """(now, last, target, counted, flat positions) of some or all windows."""
        now, last = model.inputs(self.now), model.inputs(self.last)
        text, begin, scored = self.windows()
        first, left, place = self.starts[text] + begin, self.sizes[text] - begin, np.arange(WINDOW)
        pick = np.arange(len(text)) if chosen is None else chosen
        for i in range(0, len(pick), size):
            w = pick[i : i + size]
            left_w = left[w][:, None]
            at = first[w][:, None] + np.minimum(place, left_w - 1)
            yield now[at], last[at], self.target[at], (place < left_w) & (place >= scored[w][:, None]), at


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(len(batch)):
            yield {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, n): occurrences in training words; piece -1 counts the training texts."""
    for row in _each(batches):
        held, _ = _ints(row["held"], np.uint8).reshape(2, -1)
        pieces, trained = _ints(row["pieces"]), np.repeat(_ints(row["trained"]), _ints(row["piece_sizes"]))
        n = np.bincount(pieces, weights=trained) if len(pieces) else np.zeros(0)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(n[seen], (held == 0).sum()).astype(np.int64))], names=["piece", "n"])


def _parts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(block, keys, trained) to a row for each part of a block's vocabulary: words whose hashes begin with the same bits."""
    for batch in batches:
        for block, row in zip(batch.column(0).to_pylist(), _each(iter([batch])), strict=True):
            keys, trained = _ints(row["keys"], np.uint64), _ints(row["trained"])
            part, starts = np.unique(keys >> U64(64 - bits) if bits else keys * U64(0), return_index=True)
            cuts = [*starts.tolist(), len(keys)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int64)), pa.array(np.full(len(part), block)), *(pa.array([x[a:b].tobytes() for a, b in pairwise(cuts)], pa.binary()) for x in (keys, trained))],
                names=["part", "block", "keys", "trained"],
            )


COUNTS = "part long, block long, counts binary, v long, n long"


def _count(table: pa.Table) -> pa.Table:
    """One part of all vocabularies, with the training counts of its words; in the first row how many of them have some, and their sum."""
    keys = np.concatenate([_ints(x, np.uint64) for x in table["keys"]])
    _, word = np.unique(keys, return_inverse=True)
    total = np.bincount(word, weights=np.concatenate([_ints(x) for x in table["trained"]])).astype(np.int64)
    cuts = np.cumsum([0, *(len(x.as_buffer()) // 8 for x in table["keys"])]).tolist()
    first = np.arange(len(table)) == 0
    return pa.table({"part": table["part"], "block": table["block"], "counts": pa.array([total[word[a:b]].tobytes() for a, b in pairwise(cuts)], pa.binary()), "v": pa.array(first * int((total > 0).sum())), "n": pa.array(first * int(total.sum()))})


def train_block(b: Block, slots: Slots, start: np.ndarray | None, t: Training, turn: int) -> tuple[int, np.ndarray | None]:
    """(windows, weights): what a block's training windows of a round's lot make of the start."""
    text, begin, _ = b.windows()
    lot = mix(mix(b.ids.astype(U64)[text]) + begin.astype(U64)) % U64(t.rounds)
    mine, learned = np.flatnonzero(~b.held[text] & (lot == U64(turn))), np.repeat(~b.held, b.sizes)
    if not len(mine):
        return 0, None
    model = Attention(slots.counts, t)
    if start is not None:
        model.load(start)
    full = model.only(b.now[learned])  # what stands two before an id stands one before its own follower
    adam, rng, done = Adam(model, t.rate), np.random.default_rng(t.seed + turn), 0
    for now, last, target, counted, _ in b.batches(model, rng.permutation(mine), t.batch):
        n = int(counted.sum())
        adam.apply(model.gradients(now, last, target, counted), max(1, n), 1 - 0.9 * (turn + done / len(mine)) / t.rounds)
        done += len(now)
    model.put(full)
    return len(mine), model.flat()


def _train(batches: Iterator[pa.RecordBatch], shared: Broadcast, t: Training, turn: int) -> Iterator[pa.RecordBatch]:
    """(weight, weights): the mean of what this task's blocks learn in a round, by their windows."""
    slots, start = shared.value
    seen, total = 0, None
    for row in _each(batches):
        n, weights = train_block(Block(row, slots), slots, start, t, turn)
        if n:
            total = n * weights.astype(np.float64) + (0 if total is None else total)
            seen += n
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([(total / seen).astype(np.float32)], pa.list_(pa.float32()))], names=["weight", "weights"])


def _mean(table: pa.Table) -> pa.Table:
    w = table["weight"].to_numpy()
    total = np.zeros(len(table["weights"][0]))
    for i in range(len(w)):
        total += w[i] * table["weights"][i].values.to_numpy()
    return pa.table({"weight": pa.array([w.sum()]), "weights": pa.array([(total / w.sum()).astype(np.float32)], pa.list_(pa.float32()))})


def _by_heap(table: pa.Table) -> pa.Table:
    return _mean(table)


def score_block(b: Block, slots: Slots, model: Attention) -> np.ndarray:
    """The natural log probability of each text of a block."""
    each = np.empty(len(b.target))
    for now, last, target, counted, at in b.batches(model, None, SCORED):
        each[at[counted]] = model.score(now, last, target, counted)
    each[b.target == slots.rare] += slots.share
    return np.bincount(np.repeat(np.arange(len(b.sizes)), b.sizes), weights=each, minlength=len(b.sizes))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast, t: Training, n: int, v: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the training counts of their vocabulary to one row for each text."""
    slots, weights, end_count = shared.value
    model = Attention(slots.counts, t)
    if weights is not None:
        model.load(weights)
    model.freeze()
    log = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    for row in _each(batches):
        b = Block(row, slots)
        count = np.zeros(len(b.lengths), np.int64)
        if row["known"].is_valid:
            count = np.concatenate([_ints(x, np.int64) for x in row["known"].values.field("counts")])
        owner = np.repeat(np.arange(len(b.words)), b.words)
        base = np.bincount(owner, weights=log(count)[b.tokens], minlength=len(b.words)) + log(end_count)
        met = np.bincount(owner, weights=count[b.tokens] > 0, minlength=len(b.words)) + (end_count > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.ids, mask=b.no_id), pa.array(b.held), pa.array(b.words + 1), pa.array(met.astype(np.int64)), pa.array(base), pa.array(score_block(b, slots, model) / math.log(10))],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )


def score_texts(docs: DataFrame, ranks_path: str, pattern: str, t: Training = Training(), id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Rows whose held_col is true are scored but not learned from (null counts as false).  A null or empty text is its
    end alone.  Rows that repeat are each counted and scored; null ids are kept.  With no training rows all counts
    are 0 and the model is its start.  An empty table gives no rows.  What is broadcast is bounded by the tokenizer's
    vocabulary; the counts of words are joined.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    rows = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(held_col), F.lit(False)).alias("held"), column(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(partial(trimmed(_blocks), shared=spark.sparkContext.broadcast((ranks, pattern))), BLOCK)
    blocks = cut(made.withColumn("block", F.monotonically_increasing_id()), "lm-blocks", compression="zstd", group_rows=1)
    names = [n for x in BLOCK.split(", ") if (n := x.split()[0]) not in ("keys", "trained")]  # what is read again and again

    found = blocks.select("held", "trained", "pieces", "piece_sizes").mapInArrow(_piece_counts, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the vocabulary at most
    counts = np.zeros(max(ranks.values()) + 2)
    counts[found["piece"].to_numpy()] = found["n"].to_numpy()  # -1, the end, is the last
    slots, ends = Slots(counts), int(counts[-1])

    weights = None
    heaps = math.isqrt(max(1, blocks.rdd.getNumPartitions())) + 1
    for turn in range(t.rounds):
        shared = spark.sparkContext.broadcast((slots, weights))
        parts = blocks.select(*names).mapInArrow(partial(trimmed(_train), shared=shared, t=t, turn=turn), "weight double, weights array<float>")
        parts = parts.withColumn("heap", F.pmod(F.spark_partition_id(), F.lit(heaps))).groupBy("heap").applyInArrow(_by_heap, "weight double, weights array<float>").toArrow()
        if len(parts):
            weights = _mean(parts)["weights"][0].values.to_numpy()
        shared.unpersist()

    bits = (blocks.count() // 2).bit_length()  # as many parts as blocks at most, so a part has the words of a few
    parts = blocks.select("block", "keys", "trained").mapInArrow(partial(_parts, bits=bits), "part long, block long, keys binary, trained binary")
    total = cut(parts.groupBy("part").applyInArrow(_count, COUNTS), "lm-counts", compression="zstd")
    v, n = total.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = total.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("known"))
    shared = spark.sparkContext.broadcast((slots, weights, ends))
    ready = blocks.join(known, "block", "left").select(*names, "known")
    out = cut(ready.mapInArrow(partial(trimmed(_score), shared=shared, t=t, n=int(n) + ends, v=int(v) + (ends > 0)), RESULT), "lm-scores")
    release(blocks, total)
    return out.withColumn("train_tokens", F.lit(int(n) + ends).cast("long"))


def op3_attention_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Unigram and attention-model scores of each document, learned from those whose crc32(doc_id) mod 5 is not 1."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("held_out"))
    scored = score_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
