"""A bibliographic library kept as an entity-attribute-value database.

The relational work is in DataFrames over the library's tables; open_tables() reads these from the SQLite file of a
library directory on the driver (a personal library, not a corpus).
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import EnvironmentFailure
from lodestone.functions.text import year_of

DATABASE = "zotero.sqlite"
#: Tables read, with their columns.
TABLES = {
    "items": "itemID long, itemTypeID long, key string",
    "itemTypes": "itemTypeID long, typeName string",
    "fields": "fieldID long, fieldName string",
    "itemData": "itemID long, fieldID long, valueID long",
    "itemDataValues": "valueID long, value string",
    "creators": "creatorID long, firstName string, lastName string, fieldMode int",
    "itemCreators": "itemID long, creatorID long, orderIndex int",
    "itemAttachments": "itemID long, parentItemID long, linkMode int, contentType string, path string",
    "deletedItems": "itemID long",
}
NOT_DOCUMENTS = ("attachment", "note", "annotation")


def present(root: str) -> bool:
    return os.path.exists(os.path.join(root.removeprefix("file://"), DATABASE))


def open_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The library's tables, read-only; a missing or locked database is an EnvironmentFailure."""
    path = os.path.join(root.removeprefix("file://"), DATABASE)
    try:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5)
        db.execute("SELECT count(*) FROM items").fetchone()
        names = {t: ", ".join(c.split()[0] for c in columns.split(", ")) for t, columns in TABLES.items()}
        return {t: spark.createDataFrame(db.execute(f"SELECT {names[t]} FROM {t}").fetchall(), TABLES[t]) for t in TABLES}
    except sqlite3.Error as e:
        raise EnvironmentFailure(f"cannot read {path}: {e}") from e


def items(t: Mapping[str, DataFrame]) -> DataFrame:
    """(itemID, key, typeName, title, date, doi) of bibliographic items that are not deleted."""
    wanted = t["fields"].where(F.col("fieldName").isin("title", "date", "DOI"))
    values = t["itemData"].join(wanted, "fieldID").join(t["itemDataValues"], "valueID")
    pivot = values.groupBy("itemID").pivot("fieldName", ["title", "date", "DOI"]).agg(F.first("value"))
    kept = t["items"].join(t["itemTypes"].where(~F.col("typeName").isin(*NOT_DOCUMENTS)), "itemTypeID").join(t["deletedItems"], "itemID", "left_anti")
    return kept.join(pivot, "itemID", "left").select("itemID", "key", "typeName", "title", "date", F.col("DOI").alias("doi"))


def creators(t: Mapping[str, DataFrame]) -> DataFrame:
    """(itemID, names): `Last, First` (institutions by last name alone), in order, each once."""
    name = F.when(F.col("fieldMode") == 1, F.col("lastName")).otherwise(F.concat("lastName", F.lit(", "), "firstName"))
    rows = t["itemCreators"].join(t["creators"], "creatorID").select("itemID", "orderIndex", name.alias("name")).where("name is not null")
    ordered = F.array_sort(F.collect_list(F.struct("orderIndex", "name")))
    return rows.groupBy("itemID").agg(F.array_distinct(F.transform(ordered, lambda x: x["name"])).alias("names"))


def attachments(t: Mapping[str, DataFrame]) -> DataFrame:
    """(itemID, parentItemID, key, path) of stored PDFs that are not deleted."""
    rows = t["itemAttachments"].where((F.col("contentType") == "application/pdf") & F.col("linkMode").isin(0, 1) & F.col("path").startswith("storage:"))
    rows = rows.join(t["items"].select("itemID", "key"), "itemID").join(t["deletedItems"], "itemID", "left_anti")
    return rows.select("itemID", "parentItemID", "key", F.concat(F.lit("storage/"), "key", F.lit("/"), F.substring("path", F.lit(9), F.length("path"))).alias("path"))


def abstracts(t: Mapping[str, DataFrame]) -> DataFrame:
    """(key, abstract)."""
    values = t["itemData"].join(t["fields"].where("fieldName = 'abstractNote'"), "fieldID").join(t["itemDataValues"], "valueID")
    return t["items"].join(values, "itemID").select("key", F.col("value").alias("abstract"))


def documents(t: Mapping[str, DataFrame]) -> DataFrame:
    """(key, title, meta, path): a row for each attachment of an item, and for each standalone PDF."""
    bib, names, files = items(t), creators(t), attachments(t)
    own = bib.join(names, "itemID", "left").join(files.select(F.col("parentItemID").alias("itemID"), "path"), "itemID")
    meta = F.map_filter(
        F.create_map(F.lit("type"), F.col("typeName"), F.lit("creators"), F.array_join("names", "; "), F.lit("year"), year_of(F.col("date")), F.lit("doi"), F.col("doi")),
        lambda _, v: v.isNotNull() & (v != ""),
    )
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("[untitled "), "typeName", F.lit(" "), "key", F.lit("]")))
    with_parent = own.select("key", title.alias("title"), meta.alias("meta"), "path")
    alone = files.where("parentItemID is null").select("key", F.substring_index("path", "/", -1).alias("title"), F.create_map(F.lit("type"), F.lit("attachment")).alias("meta"), "path")
    return with_parent.unionByName(alone)


def scan_library(spark: SparkSession, root: str) -> DataFrame:
    """(key, title, meta, path, fingerprint, content_type, content); attachments without a file are left out."""
    from lodestone.sources.files import scan_directory

    found = scan_directory(spark, root)
    docs = documents(open_tables(spark, root))
    return docs.join(found.select("path", "fingerprint", "content_type", "content"), "path")
