"""Search results as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import scrub


def tsv_line() -> Column:
    """`score<TAB>title<TAB>path;path` with four decimals."""
    return F.concat_ws("\t", F.format_string("%.4f", F.col("score")), scrub(F.col("title")), F.array_join("paths", ";"))


def json_line(columns: list[str]) -> Column:
    """A JSON object with the score to six decimals; null, empty and unknown values are left out."""
    fields = [F.round("score", 6).alias("score"), F.col("title")]
    for name, column, empty in (("paths", "paths", "array"), ("key", "key", ""), ("meta", "meta", "map"), ("best_chunk", "best_text", ""), ("kind", "kind", ""), ("doc_type", "doc_type", ""), ("tags", "tags", "array"), ("authors", "authors", "array"), ("duplicate_keys", "duplicate_keys", "array")):
        if column in columns:
            value = F.col(column)
            fields.append((F.when(F.size(value) > 0, value) if empty in ("array", "map") else value).alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def lines(results: DataFrame, as_json: bool = False) -> DataFrame:
    """(qid, rank, line) in order."""
    line = json_line(results.columns) if as_json else tsv_line()
    return results.select("qid", "rank", line.alias("line")).orderBy("qid", "rank")


def markdown_table(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(rows + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.collect()])
