"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Each text becomes the set of its distinct k-word shingles.  Equal sets are one class from the start, so copies
cost nothing further.  A class gets a SuperMinHash signature (each element walks its own permutation of the lanes
level by level, and walking stops once every lane is filled), whose lanes are cut into bands.  Classes that share
a band are compared in three steps, each confirmed on full shingle sets:

1. every member of a band's bucket with the bucket's hub, the member that shares most buckets with others: in a
   family of edited copies this is the text nearest to all.  What a member has and the hub lacks, or the reverse,
   is kept as its difference;
2. two members of one hub share a number of shingles that follows from their differences alone, so a similar pair
   must have a certain number of differences in common.  Members meet by their rarest differences (as many as a
   similar pair can't all miss), and are compared with the member of fewest differences that they meet;
3. what is still apart and meets so, if positions leave enough differences to share, is compared pair by pair.

Members that one component already holds are not compared again, which changes no component.  Edited copies that
are not similar rarely have a rare difference in common, so a bucket of them costs about its size and not its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.hashing import U64, as_long, hashed_texts, mix, shingle_hashes
from lodestone.llm.rows import column, fresh, quoted, trimmed
from lodestone.plans.components import connected_components
from lodestone.plans.materialize import cut, release

_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_STEP = U64(0x9E3779B97F4A7C15)
#: Levels whose swaps are traced back; beyond these the few elements left get explicit permutations.
_TRACED = 6


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters.  With 32 bands of 4 lanes, a pair of similarity 0.8 shares no band once in 2e7 pairs."""

    shingle_words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4

    @property
    def lanes(self) -> int:
        return self.bands * self.rows


def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int, lanes: int) -> np.ndarray:
    """Signatures [sets, lanes] of many sets at once; a lane's value is (level, random rank) as one integer.

    An element's level-j value can only go to the lane that its permutation holds at j; lanes filled at a level
    can't be lowered by later ones.  A set leaves the loop as soon as all its lanes are filled.  A set without
    elements keeps the largest value in all lanes.
    """
    signature = np.full((sets, lanes), _EMPTY, U64)
    flat = signature.reshape(-1)
    e, o = elements, owner.astype(np.int64)
    history: list[np.ndarray] = []
    perm = None
    for level in range(lanes):
        if not len(e):
            break
        rank = mix(e + U64((int(_STEP) * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)) >> U64(8)
        draw = mix(e + U64((int(_STEP) * (2 * level + 2)) & 0xFFFFFFFFFFFFFFFF)) >> U64(32)
        k = (level + ((draw * U64(lanes - level)) >> U64(32)).astype(np.int64)).astype(np.int16)
        if perm is None and level < _TRACED:
            lane = k.astype(np.int64)
            for i in range(level - 1, -1, -1):
                lane[lane == history[i]] = i
            history.append(k)
        else:
            at = np.arange(len(e))
            if perm is None:
                perm = np.tile(np.arange(lanes, dtype=np.int16), (len(e), 1))
                for i, past in enumerate(history):
                    kept = perm[at, past].copy()
                    perm[at, past] = perm[:, i]
                    perm[:, i] = kept
            lane = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, level]
        np.minimum.at(flat, o * lanes + lane, rank | (U64(level) << U64(56)))
        open_sets = (signature == _EMPTY).any(1)
        stay = open_sets[o]
        if not stay.all():
            e, o = e[stay], o[stay]
            history = [h[stay] for h in history]
            perm = None if perm is None else perm[stay]
    return signature


def _distinct(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each run."""
    runs = [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return (np.concatenate(runs) if runs else shingles[:0]), np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)


def _digests(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, 2), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[i] = np.frombuffer(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest(), np.int64)
    return out


FEATURES = "id long, n_shingles long, d0 long, d1 long, bands array<long>"


def _features(batches: Iterator[pa.RecordBatch], p: NearDuplicates) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, words, offsets, _, _ in hashed_texts(batch.column(1), lower=True):
            sets, off = _distinct(*shingle_hashes(words, offsets, p.shingle_words))
            n = np.diff(off)
            signature = superminhash(sets, np.repeat(np.arange(len(n)), n), len(n), p.lanes)
            bands = np.zeros((len(n), p.bands), U64)
            for r in range(p.rows):
                bands = mix(bands ^ signature[:, r :: p.rows]) + _STEP
            bands = mix(bands + np.arange(p.bands, dtype=U64))
            digest = _digests(sets, off)
            lists = lambda x: pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1], pa.array(as_long(x).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, len(n)), pa.array(n.astype(np.int64)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists(bands)],
                names=["id", "n_shingles", "d0", "d1", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], p: NearDuplicates) -> Iterator[pa.RecordBatch]:
    """Full shingle sets; a row whose set isn't the one asked for (its id is not unique) gives none."""
    for batch in batches:
        ids, want = batch.column(0), np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
        for row, words, offsets, _, _ in hashed_texts(batch.column(1), lower=True):
            sets, off = _distinct(*shingle_hashes(words, offsets, p.shingle_words))
            same = (_digests(sets, off) == want[row : row + len(off) - 1]).all(1)
            blobs = [sets[a:b].tobytes() for a, b, s in zip(off[:-1].tolist(), off[1:].tolist(), same.tolist(), strict=True) if s]
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(same)).filter(pa.array(same)), pa.array(blobs, pa.binary())], names=["rep", "members"])


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(rep, hub, alone, members of rep, members of hub) to (rep, hub, linked, w, differences): the differences, and their part in the number that a similar pair shares; both null if rep is alone with the hub.

    With M shingles of a hub of H that a member lacks, and D that only the member has, two members x and y share
    H - Mx - My + c, c being their common differences.  They are similar if 2 (100 + percent) c >= wx + wy.
    """
    for batch in batches:
        linked, w, found = [], [], []
        for alone, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = np.concatenate([x, y])
            order = both.argsort(kind="stable")
            both, own = both[order], order < len(x)
            twice = both[1:] == both[:-1]
            single = np.ones(len(both), bool)
            single[1:] &= ~twice
            single[:-1] &= ~twice
            shared = int(twice.sum())
            linked.append(100 * shared >= percent * (len(both) - shared))
            more = int((single & own).sum())
            w.append(None if alone else 200 * (len(y) - shared) + 2 * percent * more - (100 - percent) * len(y))
            found.append(None if alone else as_long(both[single]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(w, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["rep", "hub", "linked", "w", "differences"]
        )


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= percent * (len(both) - shared))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    left = pairs.join(sets.select(F.col("rep").alias(a), F.col("members").alias("x")), a)
    return left.join(sets.select(F.col("rep").alias(b), F.col("members").alias("y")), b)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    full = _with_sets(pairs, sets, "a", "b")
    return full.select("a", "b", "x", "y").mapInArrow(partial(trimmed(_confirmed), percent=percent), "a long, b long")


def _placed(rows: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the component of a column, which is the node itself where no link has it."""
    return rows.join(parts.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _meetings(compared: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(hub, e, rep, w, n, left): members by the differences e by which a similar one of another component must meet them.

    Of n differences that other components have too, ordered from the rarest, `left` remain from e on.  A member
    that needs m in common meets every similar one by its first n - m + 1; what it needs at least follows from the
    smallest w of the hub's members (of those outside the hub's component, for one inside).
    """
    rows = _placed(_placed(compared.where("differences is not null"), parts, "rep", "part"), parts, "hub", "main")
    rows = rows.withColumn("outside", F.col("part") != F.col("main"))
    least = rows.groupBy("hub").agg(F.min("w").alias("least"), F.min(F.when(F.col("outside"), F.col("w"))).alias("least_outside")).where("least_outside is not null")
    rows = rows.join(least, "hub")
    of = F.col("w") + F.when(F.col("outside"), F.col("least")).otherwise(F.col("least_outside"))
    rows = rows.withColumn("need", F.greatest(F.lit(1), F.ceil(of / (2.0 * (100 + percent))))).where("need <= size(differences)")
    each = rows.select("hub", "rep", "part", "w", "need", F.explode("differences").alias("e"))
    common = each.groupBy("hub", "e").agg(F.count("*").alias("c"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("hub", "e", "c")
    shared = each.join(common, ["hub", "e"])
    own = Window.partitionBy("hub", "rep")
    ordered = shared.withColumn("n", F.count("*").over(own)).where("n >= need").withColumn("i", F.row_number().over(own.orderBy("c", "e")))
    return ordered.where("i <= n - need + 1").select("hub", "e", "rep", "w", "n", (F.col("n") - F.col("i") + 1).alias("left"))


def _may_be_similar(x: str, y: str, percent: int) -> Column:
    return 2 * (100 + percent) * F.least(f"{x}.left", f"{y}.left") >= F.col(f"{x}.w") + F.col(f"{y}.w")


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.rep", f"{y}.rep").alias("a"), F.greatest(f"{x}.rep", f"{y}.rep").alias("b")]


def _led(meetings: DataFrame, percent: int) -> DataFrame:
    """(a, b): members and the one of fewest differences that they meet by each of theirs."""
    first = meetings.groupBy("hub", "e").agg(F.count("*").alias("c"), F.min(F.struct("n", "rep", "w", "left")).alias("lead")).where("c > 1").select("hub", "e", "lead.*")
    x, y = meetings.alias("x"), first.alias("y")
    near = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.rep") != F.col("y.rep")) & _may_be_similar("x", "y", percent)
    return x.join(y, near).select(*_pairs("x", "y")).distinct()


def _remaining(meetings: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that meet, those outside the meeting's largest component with all."""
    placed = _placed(meetings, parts, "rep", "part")
    shares = placed.groupBy("hub", "e", "part").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("hub", "e").agg(F.max(F.struct("c", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("hub", "e", F.col("top.part").alias("main"))
    rows = cut(placed.join(mixed, ["hub", "e"]), "minhash-apart")
    x, y = rows.where("part <> main").alias("x"), rows.alias("y")
    near = (
        (F.col("x.hub") == F.col("y.hub"))
        & (F.col("x.e") == F.col("y.e"))
        & (F.col("x.part") != F.col("y.part"))
        & ((F.col("y.part") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        & _may_be_similar("x", "y", percent)
    )
    return x.join(y, near).select(*_pairs("x", "y")).distinct()


def near_duplicates(docs: DataFrame, p: NearDuplicates = NearDuplicates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, class_size, links) for each row of docs.

    component_id is the smallest id that links reach, the row's own included; class_size counts the rows with an
    equal shingle set; links counts the confirmed links of the row's class to other classes (at least those that
    join its component).  Texts that are null, empty or blank have no shingles and link with nothing: their
    component is their own id.  Rows with a null id keep a null component unless an equal set has an id.  Rows
    that repeat an id are one node: what any of their texts links to is in one component.  Other columns of docs,
    whatever their names, are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    features = cut(texts.mapInArrow(partial(trimmed(_features), p=p), FEATURES), "minhash-features")
    classes = (
        features.where("n_shingles > 0 and id is not null")
        .groupBy("d0", "d1")
        .agg(F.min("id").alias("rep"), F.count("*").alias("class_size"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    classes = cut(classes, "minhash-classes")
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    live = cut(buckets.join(sizes, "key"), "minhash-buckets")
    fame = live.groupBy("rep").agg(F.sum("c").alias("fame"))
    hubs = live.join(fame, "rep").groupBy("key").agg(F.max(F.struct("fame", (-F.col("rep")).alias("neg"))).alias("top")).select("key", (-F.col("top.neg")).alias("hub"))
    stars = live.join(hubs, "key").where("rep <> hub").select("rep", "hub").distinct()
    members = stars.groupBy("hub").agg((F.count("*") == 1).alias("alone"))
    stars = cut(stars.join(members, "hub"), "minhash-stars")
    wanted = fame.select("rep").join(classes.select("rep", "d0", "d1"), "rep")
    sets = cut(
        texts.join(wanted.select(F.col("rep").alias("id"), "d0", "d1"), "id").select("id", "text", "d0", "d1").mapInArrow(partial(trimmed(_sets), p=p), "rep long, members binary").dropDuplicates(["rep", "members"]),
        "minhash-sets",
    )
    compared = _with_sets(stars, sets, "rep", "hub").select("rep", "hub", "alone", "x", "y")
    compared = cut(compared.mapInArrow(partial(trimmed(_compared), percent=p.percent), "rep long, hub long, linked boolean, w long, differences array<long>"), "minhash-compared")
    release(live)
    near = compared.where("linked").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    parts = cut(connected_components(near), "minhash-parts")
    meetings = cut(_meetings(compared, parts, p.percent), "minhash-meetings")
    done = cut(_led(meetings, p.percent), "minhash-led")
    links = cut(near.union(_verify(done, sets, p.percent)).distinct(), "minhash-links")
    parts = cut(connected_components(links), "minhash-parts")
    rest = _remaining(meetings, parts, p.percent).join(done, ["a", "b"], "left_anti")
    links = cut(links.union(_verify(rest, sets, p.percent)), "minhash-all-links")
    release(sets, compared, meetings)
    found = connected_components(links).withColumnRenamed("node", "rep")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    named = classes.select("d0", "d1", "rep", "class_size").join(found, "rep", "left").join(degree, "rep", "left")
    named = named.select("d0", "d1", "class_size", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    out = features.select("id", "n_shingles", "d0", "d1").join(named, ["d0", "d1"], "left")
    empty = F.col("n_shingles") == 0
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(empty, F.col("id")).otherwise(F.col("component")).alias("component_id"),
        F.when(empty, F.lit(1)).otherwise(F.coalesce("class_size", F.lit(1))).cast("long").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def keep_one(docs: DataFrame, p: NearDuplicates = NearDuplicates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the one of the smallest id.

    If ids are null or repeated, rows get numbers of their own and the first row of a group stays.  Documents
    without words (null, empty and blank texts) are in no group and stay.  An empty table gives no rows.  Columns
    of any name keep their values.
    """
    ids = docs.select(F.col(id_col).alias("i")).groupBy("i").agg(F.count("*").alias("c"))
    if ids.where("i is null or c > 1").limit(1).count():
        number = fresh("row", docs.columns)
        numbered = cut(docs.withColumn(number, F.monotonically_increasing_id()), "minhash-numbered")
        return keep_one(numbered, p, number, text_col).drop(number)
    groups = near_duplicates(docs.select(id_col, text_col), p, id_col, text_col)
    drop = groups.where(column(id_col) != F.col("component_id")).select(id_col)
    return docs.join(drop, id_col, "left_anti").select(*map(quoted, docs.columns))


def op1_superminhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate component of each document at 4-word shingles and similarity 0.8."""
    groups = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), NearDuplicates(shingle_words=4))
    return groups.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
