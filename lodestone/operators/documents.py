"""From chunk hits to documents: grouping, facets, duplicates, hydration, reranking, and the whole search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import UsageError
from lodestone.functions.ranking import parse_agg
from lodestone.functions.text import fold, fold_text, strip_accents
from lodestone.operators.retrieval import bm25, corpus_size, knn, listed_postings, rrf

#: Chunks asked for: FACTOR times the results wanted, at least LEAST, and LEAST_FILTERED if a facet filter follows.
FACTOR, LEAST, LEAST_FILTERED = 10, 200, 2000
RERANK_HEAD, RERANK_K = 20, 60
YEAR_FACTOR = 0.4


def chunks_wanted(n: int, filtered: bool) -> int:
    k = max(FACTOR * n, LEAST)
    return max(k, LEAST_FILTERED) if filtered else k


def by_document(hits: DataFrame, spec: str = "max") -> DataFrame:
    """(qid, document_id, score, first_rank, best_chunk, hits) of hits (qid, document_id, chunk_id, score, fused_rank).

    The best chunk has the largest score, the first in rank among equal ones.
    """
    strategy = parse_agg(spec)
    grouped = hits.groupBy("qid", "document_id").agg(
        F.sort_array(F.collect_list("score"), asc=False).alias("scores"),
        F.min("fused_rank").alias("first_rank"),
        F.max_by("chunk_id", F.struct("score", (-F.col("fused_rank")).alias("r"))).alias("best_chunk"),
        F.count("*").alias("hits"),
    )
    return grouped.select("qid", "document_id", strategy(F.col("scores")).alias("score"), "first_rank", "best_chunk", "hits")


def filter_documents(documents: DataFrame, doc_tags: DataFrame, doc_authors: DataFrame, tags: list[list[str]] = (), authors: list[list[str]] = (), types: list[str] | None = None) -> DataFrame | None:
    """The document_ids that have any term of each group; None if no group is given (no filter), no row if nothing matches."""
    if not tags and not authors and types is None:
        return None
    allowed = documents.select("document_id", "doc_type") if types is None else documents.select("document_id", "doc_type").where(F.col("doc_type").isin(list(types)))
    for table, column, groups in ((doc_tags, "tag", tags), (doc_authors, "author", authors)):
        for group in groups:
            allowed = allowed.join(table.where(F.col(column).isin(list(group))).select("document_id"), "document_id", "left_semi")
    return allowed.select("document_id")


def facet_multiplier(facets: Column, tags: Column, authors: Column, creators: Column, doc_type: Column) -> Column:
    """The product of (1 - weight) over the facets that a document doesn't match.

    facets is array<struct<terms array<string>, weight double, kind string>>.  Tags and authors match by any common
    term, types by equality.  A document without authors matches an author facet if a term's surname occurs in its
    creators, which are folded; case and accents of the terms don't matter there.  Null arrays are empty.
    """
    empty = F.array().cast("array<string>")
    own_tags, own_authors = F.coalesce(tags, empty), F.coalesce(authors, empty)

    def matched(f: Column) -> Column:
        named = F.arrays_overlap(f["terms"], own_authors)
        in_creators = F.exists(f["terms"], lambda t: F.contains(F.coalesce(creators, F.lit("")), F.lower(strip_accents(F.trim(F.substring_index(t, ",", 1))))))
        author = F.when(F.size(own_authors) > 0, named).otherwise(in_creators)
        return F.when(f["kind"] == "tag", F.arrays_overlap(f["terms"], own_tags)).when(f["kind"] == "author", author).otherwise(F.coalesce(F.array_contains(f["terms"], doc_type), F.lit(False)))

    return F.aggregate(F.coalesce(facets, F.array().cast("array<struct<terms:array<string>,weight:double,kind:string>>")), F.lit(1.0), lambda m, f: F.when(matched(f), m).otherwise(m * (1 - f["weight"])))


def year_factor(year: Column, lowest: Column, highest: Column) -> Column:
    """0.4 if a bound is set and the year lies outside or is no number, else 1.  A bound or year of 0 is none."""
    number, lowest, highest = (F.nullif(c.try_cast("int"), F.lit(0)) for c in (year, lowest, highest))
    outside = number.isNull() | F.coalesce(number < lowest, F.lit(False)) | F.coalesce(number > highest, F.lit(False))
    return F.when((lowest.isNotNull() | highest.isNotNull()) & outside, F.lit(YEAR_FACTOR)).otherwise(F.lit(1.0))


def collapse_duplicates(results: DataFrame) -> DataFrame:
    """results (qid, rank, title_key, year, key, paths, ...) with one row for each (title_key, year) of a query.

    The best-ranked row stays, with duplicate_keys (the others' keys by rank) and all paths in that order.
    """
    group = ["qid", "title_key", F.coalesce("year", F.lit(""))]
    w = Window.partitionBy(*group).orderBy("rank")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = results.withColumn("__n", F.row_number().over(w)).withColumn("__keys", F.collect_list("key").over(every)).withColumn("__paths", F.collect_list("paths").over(every))
    out = out.where("__n = 1").withColumn("duplicate_keys", F.slice("__keys", F.lit(2), F.size("__keys"))).withColumn("paths", F.array_distinct(F.flatten("__paths")))
    return out.drop("__n", "__keys", "__paths")


def valid_ranking(ranking: Column, n: Column) -> Column:
    """A proposed order of 0 .. n-1 without what is out of range or repeated, the missing ones behind."""
    wanted = F.array_distinct(F.filter(ranking, lambda i: i.isNotNull() & (i >= 0) & (i < n)))
    return F.when(n > 0, F.array_union(wanted, F.sequence(F.lit(0), n.cast("int") - 1))).otherwise(F.array().cast("array<int>"))


def rerank(results: DataFrame, rankings: DataFrame, head: int = RERANK_HEAD) -> DataFrame:
    """results (qid, rank, score, ...) with the first `head` of each query fused with a proposed order.

    rankings is (qid, ranking array<int>) over zero-based positions.  A head row's score is 1/(60 + its position)
    plus 1/(60 + its place in the ranking); the tail is scaled below the head's lowest score, in its order.  A query
    whose ranking is missing or names no position of the head, or with fewer than two results, stays as it is.
    """
    sized = results.withColumn("__p", F.col("rank") - 1).withColumn("__all", F.count("*").over(Window.partitionBy("qid")))
    asked = sized.join(rankings.select("qid", "ranking"), "qid", "left")
    n = F.least(F.col("__all"), F.lit(head))
    place = F.array_position(valid_ranking(F.col("ranking"), n), F.col("__p").cast("int")) - 1
    changed = F.coalesce(F.exists("ranking", lambda i: (i >= 0) & (i < n)), F.lit(False)) & (F.col("__all") > 1)
    in_head = F.col("__p") < head
    fused = F.lit(1.0) / (RERANK_K + F.col("__p")) + F.lit(1.0) / (RERANK_K + place)
    scored = asked.withColumn("__s", F.when(in_head, fused))
    floor = F.min("__s").over(Window.partitionBy("qid"))
    tail = floor * (1 - (F.col("__p") - head + 1) / (F.col("__all") - head + 1))
    scored = scored.withColumn("score", F.when(changed, F.when(in_head, F.col("__s")).otherwise(tail)).otherwise(F.col("score")))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "__p")
    return scored.withColumn("rank", F.row_number().over(order)).drop("__p", "__all", "__s", "ranking")


@dataclass
class IndexTables:
    """The tables of an index that a search reads."""

    documents: DataFrame  # document_id, key, title, meta map<string,string>, doc_type
    files: DataFrame  # file_id, document_id, path, fingerprint, status
    chunks: DataFrame  # chunk_id, file_id, seq, text, kind
    vectors: DataFrame  # chunk_id, embedding
    doc_tags: DataFrame  # document_id, tag
    doc_authors: DataFrame  # document_id, author, seq
    postings: DataFrame | None = None  # bucket, term, chunk_id, tf, len; or chunk_id, len, terms, tfs
    size: tuple[int, int] | None = None  # chunks with any word, and words, of the postings


def hydrate(results: DataFrame, t: IndexTables) -> DataFrame:
    """results with key, title, meta, doc_type, paths, tags, authors and the best chunk's text and kind."""
    wanted = results.select("document_id").distinct()
    gathered = lambda table, value: table.join(wanted, "document_id", "left_semi").groupBy("document_id").agg(value)
    paths = gathered(t.files, F.array_sort(F.collect_list("path")).alias("paths"))
    tags = gathered(t.doc_tags, F.array_sort(F.collect_list("tag")).alias("tags"))
    authors = gathered(t.doc_authors, F.transform(F.array_sort(F.collect_list(F.struct("seq", "author"))), lambda a: a["author"]).alias("authors"))
    out = results.join(t.documents, "document_id")
    for extra in (paths, tags, authors):
        out = out.join(extra, "document_id", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(F.col(c), empty) for c in ("paths", "tags", "authors")})
    best = t.chunks.select(F.col("chunk_id").alias("best_chunk"), F.col("text").alias("best_text"), F.coalesce("kind", F.lit("body")).alias("kind"))
    return out.join(best, "best_chunk", "left")


def search(
    t: IndexTables,
    queries: DataFrame,
    embed: Callable[[Column], Column],
    n: int = 10,
    agg: str = "max",
    hybrid: bool = True,
    dedup: bool = True,
    tags: list[list[str]] = (),
    authors: list[list[str]] = (),
    types: list[str] | None = None,
    facets: DataFrame | None = None,
    rankings: Callable[[DataFrame], DataFrame] | None = None,
    prefilter: bool = False,
) -> DataFrame:
    """The n best documents for each row of queries (qid, query).

    Vector search, with hybrid fused with BM25; the facet filter applies to the hits found (with prefilter to the
    chunks before); chunk scores become document scores by `agg`; facets (qid, facets, year_from, year_to) multiply
    them; documents of equal title and year collapse; rankings(shortlist) may return (qid, ranking) to rerank by.
    """
    parse_agg(agg)
    if n < 1:
        raise UsageError("n must be at least 1")
    allowed = filter_documents(t.documents, t.doc_tags, t.doc_authors, tags, authors, types)
    k = chunks_wanted(n, allowed is not None and not prefilter)
    owner = t.chunks.join(t.files.select("file_id", "document_id"), "file_id").select("chunk_id", "document_id")
    vectors, words = t.vectors, t.postings if t.postings is not None else listed_postings(t.chunks)
    size = t.size if t.size is not None and t.postings is not None else corpus_size(words)
    if allowed is not None and prefilter:
        inside = owner.join(allowed, "document_id", "left_semi").select("chunk_id")
        vectors, words = vectors.join(inside, "chunk_id", "left_semi"), words.join(inside, "chunk_id", "left_semi")
    found = knn(vectors, queries.select("qid", embed(F.col("query")).alias("embedding")), k)
    if hybrid:
        hits = rrf(found, bm25(words, queries, k, *size))
    else:
        hits = found.withColumn("score", F.col("similarity")).withColumn("fused_rank", F.col("vec_rank"))
    hits = hits.join(owner, "chunk_id")
    if allowed is not None:
        hits = hits.join(allowed, "document_id", "left_semi")
    results = hydrate(by_document(hits, agg), t)
    if facets is not None:
        results = results.join(facets, "qid", "left")
        creators = fold(F.coalesce(F.col("meta")["creators"], F.lit("")))
        factor = facet_multiplier(F.col("facets"), F.col("tags"), F.col("authors"), creators, F.col("doc_type")) * year_factor(F.col("meta")["year"], F.col("year_from"), F.col("year_to"))
        results = results.withColumn("score", F.col("score") * factor).drop("facets", "year_from", "year_to")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "first_rank")
    results = results.withColumn("rank", F.row_number().over(order))
    if dedup:
        results = results.withColumn("title_key", fold(F.col("title"))).withColumn("year", F.col("meta")["year"])
        results = collapse_duplicates(results).drop("title_key", "year")
        results = results.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    if rankings is not None:
        shortlist = results.where(F.col("rank") <= max(n, RERANK_HEAD))
        results = rerank(shortlist, rankings(shortlist))
    return results.where(F.col("rank") <= n)


def fold_terms(terms: list[str]) -> list[str]:
    return [fold_text(x) for x in terms]
