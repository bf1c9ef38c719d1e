"""Text functions as columns.  All are built-in expressions but fold(), which needs Unicode decomposition."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters below U+0250 whose decomposition is one letter and marks, with that letter: accents go without a UDF.
_ACCENTED = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])}

#: Bytes of texts that a function of batches takes at once.
SLICE_BYTES = 1 << 21


def fold_text(text: str) -> str:
    """Decomposed, without marks, lower case, single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.lower().split())


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in parts of so many bytes, or one longer text; one empty part if there are none."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts) or not len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield texts.slice(start, stop - start)
        if not len(texts):
            return
        start = stop


@F.arrow_udf(T.StringType())
def fold(texts: pa.Array) -> pa.Array:
    """fold_text() of each text; only the texts of one slice are Python strings at once."""
    return pa.concat_arrays([pa.array([None if t is None else fold_text(t) for t in part.to_pylist()], pa.string()) for part in slices(texts)])


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks; other characters stay."""
    return F.translate(text, "".join(_ACCENTED), "".join(_ACCENTED.values()))


def normalize(text: Column) -> Column:
    """Every run of white space (Unicode's) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def locate(anchor: Column, text: Column, start: int = 0) -> Column:
    """Zero-based position of the anchor at or after start, exact before case-insensitive; -1 if absent or the anchor is empty."""
    here = lambda a, t: F.nullif(F.position(a, t, F.lit(start + 1)), F.lit(0))
    found = F.coalesce(here(anchor, text), here(F.lower(anchor), F.lower(text)), F.lit(0)) - 1
    return F.when(F.length(anchor) == 0, F.lit(-1)).otherwise(found)


def query_terms(query: Column) -> Column:
    """The words of a query that full-text search looks for: letters and digits, two characters or more, repeats kept."""
    words = F.split(F.regexp_replace(query, r"[^\p{L}\p{N}]+", " "), " ")
    return F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: F.lower(strip_accents(w)))


def index_terms(text: Column) -> Column:
    """The words of a text as full-text search indexes them."""
    return F.regexp_extract_all(F.lower(strip_accents(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def joined_terms(text: Column) -> Column:
    """The words of index_terms() with spaces between and around them."""
    return F.regexp_replace(F.lower(strip_accents(text)), r"[^\p{L}\p{N}]+", " ")


def unless_ascii(text: Column, joined: Column) -> Column:
    """A text of ASCII characters as it is, for ascii_joined(), another one joined by Spark."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(joined)


def ascii_joined(texts: pa.Array, also: bytes = b"") -> pa.Array:
    """Of texts without nulls the ASCII letters in lower case, digits and `also` as they are, other ASCII characters as spaces.

    Characters beyond ASCII stay, so a text that was joined already stays as it is.
    """
    table = bytes(c if c > 127 or c in also else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    data = pa.py_buffer((b"" if data is None else data.to_pybytes()).translate(table))
    return pa.StringArray.from_buffers(len(texts), offsets, data, None, 0, texts.offset)


def year_of(date: Column) -> Column:
    """The first four-digit number, as a string."""
    return F.nullif(F.regexp_extract(date, r"\b(\d{4})\b", 1), F.lit(""))


def scrub(text: Column) -> Column:
    """Tabs and line ends as spaces, for one-line output."""
    return F.trim(F.regexp_replace(text, r"[\t\n\r]+", " "))


def clamp(weight: Column) -> Column:
    """A weight between 0 and 1; what is no number is 0."""
    return F.coalesce(F.least(F.greatest(weight.try_cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def sha_prefix(value: Column, digits: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, digits)


def surname(folded: Column) -> Column:
    return F.trim(F.substring_index(folded, ",", 1))


def given_words(folded: Column) -> Column:
    """The words of the part after the comma, dots as spaces."""
    rest = F.regexp_extract(folded, r"^[^,]*,(.*)$", 1)
    return F.filter(F.split(F.regexp_replace(rest, r"\.", " "), r"\s+"), lambda w: F.length(w) > 0)


def given_compatible(a: Column, b: Column) -> Column:
    """Whether given names agree word by word as far as both go, an initial standing for a name; nothing agrees with all."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.arrays_zip(F.slice(a, F.lit(1), n).alias("x"), F.slice(b, F.lit(1), n).alias("y"))
    return F.forall(pairs, lambda p: F.startswith(p["x"], p["y"]) | F.startswith(p["y"], p["x"]))


def flip_name(name: Column) -> Column:
    """`First Middle Last` as `Last, First Middle`; a name with a comma or of one word stays."""
    return F.when(F.contains(name, F.lit(",")), name).otherwise(F.regexp_replace(F.trim(name), r"^(.*\S)\s+(\S+)$", "$2, $1"))


def prefixed_query(text: Column, model: str) -> Column:
    """The query as an embedding model expects it: some want a task prefix."""
    templates = {  # fixed values
        "qwen3-embedding": "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: %s",
    }
    for prefix, template in templates.items():
        if model.startswith(prefix):
            return F.format_string(template, text)
    return text


def strip_variants(line: str) -> tuple[str, list[str]] | None:
    """A vocabulary line `tag # = variant (note), variant` as (tag, variants); None for a blank or comment line."""
    head, _, tail = line.partition("#")
    tag = head.strip()
    if not tag:
        return None
    tail = tail.strip()
    if not tail.startswith("="):
        return tag, []
    return tag, [v for v in (re.sub(r"\([^)]*\)", "", x).strip() for x in tail[1:].split(",")) if v]
