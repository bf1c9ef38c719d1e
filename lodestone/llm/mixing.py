"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target number of words; whole copies of its documents that the target certainly needs are
allocated first.  The rest is a sample of a fixed number of documents with unequal probabilities: a document is
included with a probability in proportion to its size, so chosen that the sample is expected to have the words that
are still needed; documents whose probability reaches 1 are taken for certain.  The others are ranked by their
random odds divided by their inclusion odds, and the sample's number of them is taken from the smallest ratio on.

The ranking of a source is never gathered: ratios fall into buckets, bucket counts locate the bucket in which the
last one taken lies, and only that bucket is ordered.  What remains is one cut-off for each source, by which any
scan of the documents decides alone.  Equal rows are counted once, and numbered, so each has a random number of
its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.rows import column, packed
from lodestone.plans.materialize import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of a source's ranking.  A bucket of the largest source is what one task orders.
BUCKETS = 1 << 12
#: Sources whose table of cut-offs is broadcast; with more, the join is left to Spark.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Mixture:
    #: Weights of the sources in code point order (null last), repeated as needed.
    weights: tuple[int, ...] = (3, 1, 2)
    #: Words of the mixture, in percent of the words of all sources.
    percent: int = 150
    #: Most copies of a document, and the most of its size that a source's target may reach.
    most: int = 2
    seed: int = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), column(source)), F.lit("n"))


def _uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) that depends on the row's values and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, m: Mixture) -> DataFrame:
    """(src, source_size, target, whole, share): targets by weight, none above most x its size, the excess shared again.

    sizes has (src, source_size), one row for each source.  The level at which the excess is used up follows from
    running sums over the sources in the order in which they reach their limit.
    """
    order = Window.orderBy(F.when(F.col("src") == "n", 1).otherwise(0), "src")
    picks = F.array(*[F.lit(float(w)) for w in m.weights])
    weighed = sizes.withColumn("w", F.element_at(picks, ((F.row_number().over(order) - 1) % len(m.weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * float(m.most)).withColumn("ratio", F.col("limit") / F.col("w"))
    below = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * (m.percent / 100.0) - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    levelled = weighed.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    levelled = levelled.withColumn("at", F.coalesce(F.first(fits, ignorenulls=True).over(Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))))
    out = levelled.withColumn("target", F.least("limit", F.col("at") * F.col("w")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("whole", F.least(F.floor(copies + 1e-12), F.lit(m.most)).cast("long"))
    return out.select("src", "source_size", "target", "whole", F.greatest(F.lit(0.0), copies - F.col("whole")).alias("share"))


KEY = ["id", "src", "size", "h"]


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, src, size, h): rows that agree in these are equal in all columns that can be hashed."""
    hashed = [column(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return docs.select(column(id_col).alias("id"), _source_key(source_col).alias("src"), word_count(column(text_col)).alias("size"), F.xxhash64(*hashed).alias("h"), *more)


def _units(groups: DataFrame, m: Mixture) -> DataFrame:
    """Each of the `rows` equal rows of a group, numbered by k, with its random number u."""
    each = groups.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.withColumn("u", _uniform(m.seed, *KEY, "k"))


def _chances(groups: DataFrame, goals: DataFrame) -> DataFrame:
    """(src, rate, number): inclusion probabilities are size x rate, at 1 most, and the sample has so many documents below 1.

    Sizes are counted first.  With all sizes above s taken for certain, the rate follows from the words and the
    squared sizes of the others; the largest s whose own probability is then no more than 1 gives the rate.
    """
    sizes = groups.where("size > 0").groupBy("src", "size").agg(F.sum("rows").alias("n")).withColumn("x", F.col("size").cast("double"))
    above = Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = F.col("target") - F.col("whole") * F.col("source_size")
    rated = sizes.join(goals, "src").withColumn("rate", F.greatest(F.lit(0.0), need - F.coalesce(F.sum(F.col("n") * F.col("x")).over(above), F.lit(0.0))) / F.sum(F.col("n") * F.col("x") * F.col("x")).over(upto))
    rate = rated.where(F.col("rate") * F.col("x") <= 1).groupBy("src").agg(F.max(F.struct("size", "rate")).alias("r")).select("src", "r.rate")
    placed = sizes.join(rate, "src").withColumn("p", F.col("rate") * F.col("x"))
    count = placed.where("p < 1").groupBy("src").agg(F.first("rate").alias("rate"), F.sum(F.col("n") * F.col("p")).alias("expected"), F.sum("n").alias("open"))
    number = F.least(F.col("open"), F.round("expected").cast("long"))
    return count.select("src", F.when(F.col("expected") > 0, F.col("rate") * number / F.col("expected")).otherwise(F.lit(0.0)).alias("rate"), number.alias("number"))


def _ranked(units: DataFrame, goals: DataFrame) -> DataFrame:
    """units with their source's goal, inclusion probability p, bounded ratio r (the odds ratio q as q / (1 + q)) and its bucket."""
    few = goals.count() <= BROADCAST_SOURCES
    joined = units.join(F.broadcast(goals) if few else goals, "src").withColumn("p", F.least(F.lit(1.0), F.col("size") * F.col("rate")))
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1), (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    ranked = joined.withColumn("q", odds).withColumn("r", F.col("q") / (1 + F.col("q")))
    return ranked.withColumn("bucket", F.floor(F.col("r") * BUCKETS).cast("int"))


def cut_offs(groups: DataFrame, m: Mixture) -> DataFrame:
    """(src, source_size, target, whole, rate, at_bucket, last): by these, whole copies and the sample are decided.

    groups has (id, src, size, h, rows).  A document is sampled if its probability is 1, its bucket is below
    at_bucket, or its bucket is at_bucket and (r, id, size, h, k) is not after last.
    """
    goals = targets(groups.groupBy("src").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), m).drop("share")
    goals = cut(goals, "mixing-targets")
    goals = cut(goals.join(_chances(groups, goals), "src", "left").fillna({"rate": 0.0, "number": 0}), "mixing-chances")
    ranked = _ranked(_units(groups, m), goals).where("r is not null")
    counts = ranked.groupBy("src", "bucket").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(goals.select("src", "number"), "src").withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    crossing = placed.where((F.col("before") <= F.col("number")) & (F.col("before") + F.col("c") > F.col("number"))).select("src", F.col("bucket").alias("at_bucket"), "before")
    crossing = cut(crossing, "mixing-buckets")
    few = crossing.count() <= BROADCAST_SOURCES
    inside = ranked.join(F.broadcast(crossing) if few else crossing, "src").where("bucket = at_bucket")
    place = F.row_number().over(Window.partitionBy("src").orderBy("r", *KEY, "k"))
    last = inside.withColumn("place", place).where(F.col("before") + F.col("place") <= F.col("number")).groupBy("src").agg(F.max(F.struct("r", "id", "size", "h", "k")).alias("last"))
    return cut(goals.join(crossing.drop("before"), "src", "left").join(last, "src", "left"), "mixing-cuts")


def _decided(ranked: DataFrame) -> DataFrame:
    here = F.struct("r", "id", "size", "h", "k")
    ahead = F.col("at_bucket").isNull() | (F.col("bucket") < F.col("at_bucket")) | ((F.col("bucket") == F.col("at_bucket")) & F.coalesce(here <= F.col("last"), F.lit(False)))
    sampled = (F.col("p") >= 1) | (F.col("r").isNotNull() & ahead)
    return ranked.withColumn("copies", F.col("whole") + F.when(sampled, 1).otherwise(0))


def _groups(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return cut(_keyed(docs, id_col, source_col, text_col).groupBy(*KEY).agg(F.count("*").alias("rows")), "mixing-rows")


def mixing_plan(docs: DataFrame, m: Mixture = Mixture(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source key, size, source_size, target, copies) for each row of docs.

    Copies run from 0 to `most`.  Null or blank texts have size 0 and take what their source's whole copies give
    them, which is no word.  A null source is a source of its own, the last.  Equal rows are drawn one by one.
    An empty table gives no rows.
    """
    groups = _groups(docs, id_col, source_col, text_col)
    return _decided(_ranked(_units(groups, m), cut_offs(groups, m))).select("id", "src", "size", "source_size", "target", "copies")


def mix_sources(docs: DataFrame, m: Mixture = Mixture(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as many times as the mixture takes it; what a row gets is as in mixing_plan.

    Texts are neither shuffled nor sorted, but for those of equal rows, of which one stands for all.
    """
    groups = _groups(docs, id_col, source_col, text_col)
    cuts = cut_offs(groups, m)
    repeated = groups.where("rows > 1")
    rows = _keyed(docs, id_col, source_col, text_col, packed(docs))
    alike = None
    if repeated.limit(1).count():
        share = _decided(_ranked(_units(repeated, m), cuts)).groupBy(*KEY).agg(F.sum("copies").alias("copies"))
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in KEY]
        alike = rows.alias("x").join(share.alias("y"), same).groupBy(*[F.col(f"x.{c}") for c in KEY]).agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
        rows = rows.alias("x").join(repeated.alias("y"), same, "left_anti")
    single = _decided(_ranked(rows.withColumn("k", F.lit(1).cast("long")).withColumn("u", _uniform(m.seed, *KEY, "k")), cuts)).select("row", "copies")
    every = single if alike is None else single.union(alike.select("row", "copies"))
    return every.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op8_pareto_source_mixing(spark, sf_dir: str) -> DataFrame:
    """What a mixture of 150% of all words takes of each document."""
    plan = mixing_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").alias("copies"))
