"""Removal of repeated word sequences through a compacted, sparse de Bruijn graph.

A window of `width` words is removed if its words also start anywhere else.  Instead of comparing all windows:

1. Anchors: of the word k-mers of each window the one with the smallest hash is an anchor (about 7 words in 100
   are the start of one).  Equal windows have equal anchors.  Anchors are the graph's nodes; the words from one
   anchor to the end of the next are an edge, as are the words from a text's start to the end of its first anchor
   and from its last anchor to its end.
2. Compaction: a node is repeated if it occurs twice.  Where all occurrences of a node continue by one edge, and
   all occurrences of the node behind come by it, the path doesn't branch; Spark aggregates and joins find these
   edges.  Every occurrence of a node of such a path runs through the whole path, so all windows inside are
   repeated.
3. Verification at the coordinates in the source texts: every path found in a text, and every other window with a
   repeated anchor (where copies begin, end or differ), is named by a 128-bit digest of its words themselves, and
   counts only if another place has the same.  Should a path's words occur nowhere else (its hashes collided), all
   windows are verified one by one instead.

Windows inside a non-branching path are so everywhere or nowhere, so steps 2 and 3 never miss each other's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.hashing import U64, _power_tables, as_long, hashed_texts, mix, texts_of, window_hashes
from lodestone.llm.rows import column, extended, packed, trimmed
from lodestone.plans.materialize import cut, release


@dataclass(frozen=True)
class Repeats:
    #: Words of a window, and of an anchor.
    width: int = 35
    anchor: int = 8
    #: Whether paths stand for their windows; otherwise each window with a repeated anchor is verified by itself.
    paths: bool = True
    #: Parts into which the places of one window are dealt, as very many texts may share a passage.
    salt: int = 8


def _argmins(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values the position of the smallest, the first of equal ones."""
    view = np.lib.stride_tricks.sliding_window_view(values, width)
    return np.concatenate([view[i : i + 65536].argmin(1) + np.arange(i, min(i + 65536, len(view))) for i in range(0, len(view), 65536)])


def _chosen(words: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hashes of all k-mers, the anchor position of each window) of one text of at least p.width words."""
    kmers = window_hashes(words, p.anchor)
    return kmers, _argmins(mix(kmers ^ U64(0x5851F42D4C957F2D)), p.width - p.anchor + 1)


def _edges(words: np.ndarray, at: np.ndarray, p: Repeats) -> np.ndarray:
    """Hashes of the edges before, between and behind the anchors at the positions `at`."""
    up, down = _power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    start = np.concatenate([[0], at])
    end = np.concatenate([at + p.anchor, [len(words)]])
    kind = np.zeros(len(start), U64)
    kind[0], kind[-1] = 1, 2
    return mix(mix((total[end] - total[start]) * down[start] + (end - start).astype(U64)) + kind)


ANCHORS = "c0 long, c1 long, w long, nodes array<long>, edges array<long>"


def _anchors(batches: Iterator[pa.RecordBatch], p: Repeats) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c0, c1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        _, first, counts = np.unique(np.stack([c0, c1], 1), axis=0, return_index=True, return_counts=True)
        first_order = np.argsort(first)
        rows, weights = first[first_order], counts[first_order]
        texts = batch.column(2).take(pa.array(rows))
        for row, words, offsets, _, _ in hashed_texts(texts):
            out: list[tuple] = []
            for i in np.flatnonzero(np.diff(offsets) >= p.width).tolist():
                own = words[offsets[i] : offsets[i + 1]]
                kmers, chosen = _chosen(own, p)
                at = np.unique(chosen)
                out.append((rows[row + i], weights[row + i], kmers[at], _edges(own, at, p)))
            if out:
                index = np.array([o[0] for o in out])
                lists = lambda x: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32), pa.array(as_long(np.concatenate(x))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c0[index]), pa.array(c1[index]), pa.array([int(o[1]) for o in out], pa.int64()), lists([o[2] for o in out]), lists([o[3] for o in out])],
                    names=["c0", "c1", "w", "nodes", "edges"],
                )


def _segments(words: int, at: np.ndarray, index: np.ndarray, into: np.ndarray, onward: np.ndarray, p: Repeats) -> list[tuple[int, int]]:
    """Runs of words [a, b) that non-branching repeated paths cover; index, into and onward describe the repeated anchors."""
    begin, end = at[index].copy(), at[index] + p.anchor
    begin[(index == 0) & into] = 0
    end[(index == len(at) - 1) & onward] = words
    joined = (np.diff(index) == 1) & onward[:-1] & into[1:]
    cuts = np.flatnonzero(~joined) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(index)]]) - 1
    return [(int(begin[a]), int(end[b])) for a, b in zip(first, last, strict=True)]


def _cleaned(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[bytes, bytes]:
    """(kept words joined by a space, the text without the removed words and the white space before them)."""
    raw = text.tobytes()
    keep = np.flatnonzero(~gone)
    joined = b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
    if not gone.any():
        return joined, raw
    before = np.concatenate([[0], ends[:-1]])
    kept = b"".join([raw[a:b] for a, b in zip(before[keep].tolist(), ends[keep].tolist(), strict=True)])
    return joined, (kept + raw[ends[-1] :]).strip(b" \t\n\v\f\r") if len(keep) else b""


def _digests(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """Two numbers for each span [a, b) of words, from the bytes of its words joined by a space."""
    if not spans:
        return [np.zeros(0, np.int64)] * 2
    raw = text.tobytes()
    words = b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)]).tolist()
    found = np.frombuffer(b"".join([hashlib.blake2b(words[at[a] : at[b] - 1], digest_size=16).digest() for a, b in spans]), np.int64).reshape(-1, 2)
    return [found[:, 0], found[:, 1]]


LISTS = {"at": np.int32, "h0": np.int64, "h1": np.int64, "solid": np.int32, "s0": np.int64, "s1": np.int64}


OUT = ["n_words", "n_removed", "kept_sha256", "kept_text"]
OUT_TYPES = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.binary()}


def _first_pass(batches: Iterator[pa.RecordBatch], p: Repeats, want: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns: rest..., flags (i, into, onward), text.  Removes what paths cover and lists the windows to verify."""
    for batch in batches:
        texts, flags = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
        data, places = texts_of(texts)
        f = flags.flatten() if not flags.null_count else flags.drop_null().flatten()
        sizes = np.diff(flags.offsets.to_numpy())
        if flags.null_count:
            sizes = np.where(flags.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
        flag_at = np.concatenate([[0], np.cumsum(sizes)])
        index, into, onward = (f.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        for row, words, offsets, starts, ends in hashed_texts(texts, spans=True):
            made: dict[str, list] = {n: [] for n in (*want, *LISTS, "again")}
            base = places[row]
            for i in range(len(offsets) - 1):
                a, b = offsets[i], offsets[i + 1]
                shift = places[row + i] - base
                lo, hi = flag_at[row + i], flag_at[row + i + 1]
                gone = np.zeros(b - a, bool)
                at = np.zeros(0, np.int64)
                solid: list[tuple[int, int]] = []
                if hi > lo:
                    kmers, chosen = _chosen(words[a:b], p)
                    anchors = np.unique(chosen)
                    order = np.argsort(index[lo:hi])
                    inside = np.zeros(len(chosen), bool)
                    if p.paths:
                        solid = [(x, y) for x, y in _segments(b - a, anchors, index[lo:hi][order].astype(np.int64), into[lo:hi][order], onward[lo:hi][order], p) if y - x >= p.width]
                    for x, y in solid:
                        gone[x:y] = True
                        inside[x : y - p.width + 1] = True
                    repeated = np.zeros(len(kmers), bool)
                    repeated[anchors[index[lo:hi]]] = True
                    at = np.flatnonzero(repeated[chosen] & ~inside)
                text, own = data[places[row + i] : places[row + i + 1]], (starts[a:b] - shift, ends[a:b] - shift)
                _finish(made, want, text, *own, gone, bool(len(at)))
                h0, h1 = _digests(text, *own, [(x, x + p.width) for x in at.tolist()])
                s0, s1 = _digests(text, *own, solid)
                for name, value in (("at", at), ("h0", h0), ("h1", h1), ("solid", [z for span in solid for z in span]), ("s0", s0), ("s1", s1)):
                    made[name].append(value)
                made["again"].append(text.tobytes() if len(at) else None)
            n = len(offsets) - 1
            lists = lambda x, t: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32), pa.array(np.concatenate([np.asarray(v, t) for v in x]) if x else np.zeros(0, t)))
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(row, n) for c in batch.columns[:-2]), *(pa.array(made[w], OUT_TYPES[w]) for w in want), *(lists(made[k], t) for k, t in LISTS.items()), pa.array(made["again"], pa.binary())],
                names=[*batch.schema.names[:-2], *want, *LISTS, "again"],
            )


def _finish(made: dict[str, list], want: list[str], text: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray, later: bool) -> None:
    joined, kept = (b"", b"") if later else _cleaned(text, starts, ends, gone)
    values = {"n_words": len(gone), "n_removed": int(gone.sum()), "kept_sha256": None if later else hashlib.sha256(joined).hexdigest(), "kept_text": None if later else kept}
    for w in want:
        made[w].append(values[w])


def _second_pass(batches: Iterator[pa.RecordBatch], p: Repeats, want: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns: rest..., solid, found, text: the final result of texts whose windows were verified."""
    for batch in batches:
        texts, found, solids = (batch.column(batch.num_columns - i) for i in (1, 2, 3))
        data, places = texts_of(texts)
        for row, _, offsets, starts, ends in hashed_texts(texts, spans=True):
            made: dict[str, list] = {n: [] for n in want}
            for i in range(len(offsets) - 1):
                a, b = offsets[i], offsets[i + 1]
                shift = places[row + i] - places[row]
                gone = np.zeros(b - a, bool)
                solid = solids[row + i].as_py() or []
                for x, y in zip(solid[::2], solid[1::2], strict=True):
                    gone[x:y] = True
                for x in found[row + i].as_py() or []:
                    gone[x : x + p.width] = True
                _finish(made, want, data[places[row + i] : places[row + i + 1]], starts[a:b] - shift, ends[a:b] - shift, gone, False)
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays([*(c.slice(row, n) for c in batch.columns[:-3]), *(pa.array(made[w], OUT_TYPES[w]) for w in want)], names=[*batch.schema.names[:-3], *want])


def _classes(text: Column) -> list[Column]:
    """128 bits that name a text: copies share them."""
    return [F.xxhash64(text).alias("c0"), F.xxhash64(F.lit(6), text).alias("c1")]


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), text_col: str = "text", want: tuple[str, ...] = ("n_words", "n_removed", "kept_sha256")) -> DataFrame:
    """(row, *want) for each row of docs, row being the struct of all its columns but the text.

    n_words and n_removed count words; kept_sha256 is the digest of the kept words joined by one space; kept_text
    (binary) is the text without the removed words.  A null text counts as empty.  A text of fewer than `width`
    words keeps all.  Rows that repeat a text are copies of each other, so all their windows are repeated.
    """
    want = [w for w in OUT if w in want]
    text = F.coalesce(column(text_col).cast("binary"), F.lit(b""))
    keyed = docs.select(packed(docs, text_col), *_classes(text), text.alias("text"))
    alone = keyed.select("row")

    feats = keyed.select("c0", "c1", "text").mapInArrow(partial(trimmed(_anchors), p=p), ANCHORS).withColumn("r", F.monotonically_increasing_id())
    feats = cut(feats, "repeats-anchors")  # r is fixed from here on
    anchors = feats.select("r", "w", "edges", F.posexplode("nodes").alias("i", "node"))
    nodes = (
        anchors.select("node", "w", F.col("edges")[F.col("i")].alias("e_in"), F.col("edges")[F.col("i") + 1].alias("e_out"))
        .groupBy("node")
        .agg(F.sum("w").alias("c"), F.min("e_in").alias("a"), F.max("e_in").alias("b"), F.min("e_out").alias("x"), F.max("e_out").alias("y"))
        .where("c > 1")
        .select("node", (F.col("a") == F.col("b")).alias("into"), (F.col("x") == F.col("y")).alias("onward"))
    )
    flagged = feats.select("r", F.posexplode("nodes").alias("i", "node")).join(nodes, "node").groupBy("r").agg(F.collect_list(F.struct("i", "into", "onward")).alias("flags"))
    flagged = cut(flagged.join(feats.select("r", "c0", "c1"), "r").drop("r").dropDuplicates(["c0", "c1"]), "repeats-flags")

    kinds = {"n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string", "kept_text": "binary"}
    made = ", ".join(f"{w} {kinds[w]}" for w in want)
    lists = ", ".join(f"{k} array<{'int' if t is np.int32 else 'long'}>" for k, t in LISTS.items())
    first = keyed.join(flagged, ["c0", "c1"], "left").select("row", "c0", "c1", "flags", "text")
    first = first.select("row", "flags", "text").mapInArrow(partial(trimmed(_first_pass), p=p, want=want), extended(alone, f"{made}, {lists}, again binary"))
    first = cut(first.withColumn("number", F.monotonically_increasing_id()), "repeats-first", compression="zstd")  # number is fixed from here on
    release(feats, flagged)
    spans = first.select(F.explode(F.arrays_zip("s0", "s1")).alias("z")).groupBy("z.s0", "z.s1").agg(F.count("*").alias("n"))
    if spans.where("n = 1").limit(1).count():
        release(first)
        return remove_repeats(docs, replace(p, paths=False), text_col, tuple(want))
    open_rows = first.where("again is not null")
    windows = open_rows.select("number", F.explode(F.arrays_zip("at", "h0", "h1")).alias("z")).select("number", "z.at", "z.h0", "z.h1")
    twice = windows.groupBy("h0", "h1").agg(F.count("*").alias("n")).where("n > 1").select("h0", "h1", F.explode(F.sequence(F.lit(0), F.lit(p.salt - 1))).alias("part"))
    w, t = windows.alias("w"), twice.alias("t")
    part = F.pmod(F.xxhash64("w.number", "w.at"), F.lit(p.salt)).cast("int")
    same = (F.col("w.h0") == F.col("t.h0")) & (F.col("w.h1") == F.col("t.h1")) & (part == F.col("t.part"))
    found = w.join(t, same).groupBy("w.number").agg(F.collect_list("w.at").alias("found"))
    second = open_rows.select("row", "number", "solid", "again").join(found, "number", "left").select("row", "solid", "found", "again")
    second = second.mapInArrow(partial(trimmed(_second_pass), p=p, want=want), extended(alone, made))
    return first.where("again is null").select("row", *want).union(second)


def op6_debruijn_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of each document that repeated windows of 35 words cover, and a digest of the words kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
