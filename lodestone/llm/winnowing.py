"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of GRAM characters is hashed; of each WINDOW consecutive hashes the smallest is marked, the rightmost
of equal ones.  Two texts that share any passage of WINDOW + GRAM - 1 characters share a mark.  A mark is one
bigint: 32 bits of the hash above, and 2**31 - 1 - position below, so that the smallest mark of a window is the
rightmost of the smallest hashes and positions stay known.  Window minima come from doubling steps
(log2(WINDOW) passes over the array), so the work is linear in the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 16
WINDOW = 32
#: Shared passages of so many characters are found for certain.
GUARANTEE = GRAM + WINDOW - 1
_LOW, _HIGH = 0x7FFFFFFF, 0x7FFFFFFF80000000
#: Starts of grams in a piece of the text.
PIECE = 32
#: Rows that a task orders to find each document's neighbour, and the fan-out of the boundary search.
ROWS_PER_RANGE = 2000
FANOUT = 64


def _packed(text: Column) -> Column:
    """Hash and position of every gram.  The text is cut into overlapping pieces of PIECE starts, within which a gram is found at once."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{1,%d})).{1,%d}" % (PIECE + GRAM - 1, PIECE)), F.lit(1))

    def grams(piece: Column, j: Column) -> Column:
        count = F.least(F.lit(PIECE), F.length(piece) - (GRAM - 1))
        high = F.lit(_LOW).cast("long") - j * PIECE  # the low half of the piece's first mark
        lows = F.sequence(high, high - count + 1, F.lit(-1).cast("long"))
        packed = F.transform(lows, lambda low, i: F.xxhash64(F.substring(piece, i + 1, F.lit(GRAM))).bitwiseAND(F.lit(_HIGH)).bitwiseOR(low))
        return F.when(count > 0, packed).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(pieces, grams))


def marks(text: Column) -> Column:
    """The marks of a text in order of position.  A text shorter than GRAM has one mark, of the whole text; an empty or null text none."""
    steps = F.array(*[F.lit(1 << i) for i in range(WINDOW.bit_length() - 1)])
    lower = lambda acc, s: F.zip_with(acc, F.slice(acc, s + 1, F.size(acc)), lambda x, y: F.least(x, y))
    whole = lambda acc: F.array_distinct(F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - (WINDOW - 1))))
    long = F.aggregate(steps, _packed(text), lower, whole)
    none = F.array().cast("array<bigint>")
    short = F.array(F.xxhash64(text).bitwiseAND(F.lit(_HIGH)).bitwiseOR(F.lit(_LOW).cast("long")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).when(F.length(text) < GRAM, short).otherwise(long)


def position(mark: Column) -> Column:
    return F.lit(_LOW).cast("long") - mark.bitwiseAND(F.lit(_LOW).cast("long"))


def hashes(mark_array: Column) -> Column:
    return F.array_distinct(F.transform(mark_array, lambda x: F.shiftright(x, 31)))


def as_string(mark_array: Column) -> Column:
    """The hashes of the marks in order of position, in hexadecimal."""
    return F.array_join(F.transform(mark_array, lambda x: F.hex(F.shiftright(x, 31))), " ")


def likeness(a: Column, b: Column) -> Column:
    """The share of common hashes among all hashes of two hash sets; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def edited_marks(original: Column, text: Column, kept: Column) -> Column:
    """The marks of a text whose first `kept` characters are those of another text with the marks `original`.

    Marks up to the last window inside the kept part agree, so only what follows is hashed.
    """
    last = kept - GUARANTEE
    start = F.greatest(F.lit(0), last - WINDOW + 2)
    tail = F.transform(marks(F.substring(text, start + 1, F.length(text))), lambda x: x - start)
    old = F.filter(original, lambda x: position(x) <= last)
    new = F.filter(tail, lambda x: position(x) > last)
    return F.when(last < 0, marks(text)).otherwise(F.concat(old, new))


def _range_index(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most value, by a search of a few levels."""
    if len(bounds) <= FANOUT:
        return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= value)) if bounds else F.lit(0)
    width = -(-len(bounds) // FANOUT)
    coarse = _range_index(value, bounds[width::width])
    every = F.lit(bounds).cast("array<bigint>")
    part = F.slice(every, coarse * width + 1, width) if width <= FANOUT else every
    return coarse * width + F.size(F.filter(part, lambda b: b <= value))


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: Column) -> DataFrame:
    """docs with, as next_<column>, the columns of the next row by descending id (after the last: the first).

    Rows are dealt into id ranges of about ROWS_PER_RANGE rows; the first row of a range is also sent to the
    range before it, so that each range finds all neighbours alone and the rows are shuffled once.  Rows that
    repeat an id follow each other in the order of `tie`; null ids come last.
    """
    keyed = docs.withColumn("__tie", tie)
    n = docs.select(id_col).count()
    parts = min(FANOUT * FANOUT, n // ROWS_PER_RANGE + 1)
    bounds: list = []
    if parts > 1:
        found = docs.select(id_col).agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 20 * parts).alias("p")).first()["p"]
        bounds = sorted(set(found or []))
    ranged = keyed.withColumn("__range", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(_range_index(F.col(id_col), bounds)))
    heads = ranged.groupBy("__range").agg(F.max(F.struct(F.col(id_col).alias("i"), F.col("__tie").alias("t"))).alias("__head"))
    up = Window.orderBy("__range")  # one row for each range
    heads = heads.withColumn("__to", F.coalesce(F.lead("__range").over(up), F.first("__range").over(up)))
    joined = ranged.join(F.broadcast(heads), "__range")
    first = (F.col(id_col).eqNullSafe(F.col("__head.i"))) & (F.col("__tie") == F.col("__head.t"))
    own = F.struct(F.col("__range").alias("r"), F.lit(False).alias("extra"))
    also = F.struct(F.col("__to").alias("r"), F.lit(True).alias("extra"))
    dealt = joined.withColumn("__at", F.explode(F.when(first, F.array(own, also)).otherwise(F.array(own))))
    order = Window.partitionBy("__at.r").orderBy("__at.extra", F.col(id_col).desc_nulls_last(), F.col("__tie").desc())
    led = dealt.select(*docs.columns, "__at", "__tie", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("not __at.extra").drop("__at", "__tie")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, marks) for each row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("marks", marks(F.col("text")))


def op2_winnowing_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its text with the last third replaced from the next document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("marks", marks(F.col("text"))), "id", ["text", "marks"], F.xxhash64("text"))
    moved = F.floor(F.length("text") / 3).cast("int")
    parts = pairs.withColumn("n_chars", F.length("text")).withColumn("kept", F.col("n_chars") - moved)
    parts = parts.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("kept")), F.substring("next_text", F.lit(1), moved)))
    parts = parts.withColumn("edited_marks", edited_marks(F.col("marks"), F.col("edited"), F.col("kept")))
    return parts.select(
        F.col("id").alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("marks")).alias("fingerprint"),
        as_string(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(hashes(F.col("marks")), hashes(F.col("edited_marks"))).alias("near_edited"),
        likeness(hashes(F.col("marks")), hashes(F.col("next_marks"))).alias("near_next"),
    )
