"""What a language model adds to documents while they are indexed: chunks of figures and views, summary, tags, type.

Each kind of call is one distributed pass with a row for each call, so a document of many pages is asked about by many
tasks.  Tags and types are resolved through the catalog: known names by a join, only new ones in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.answers import VIEWS, Model, ask
from lodestone.functions.text import fold
from lodestone.operators.catalog import Catalog, canonical, is_generic, proposed_tags, resolve, resolve_doc_type, tagging_summary
from lodestone.operators.chunking import renumber_page
from lodestone.plans.materialize import cut, release

#: Pages of a call and of a document, characters of a text and of an excerpt that a prompt shows.
PAGES_A_CALL, PAGES, CONTEXT, EXCERPT = 8, 64, 180_000, 4000
#: Names of the vocabulary that a prompt shows, the most used ones.
SHOWN = 500

FIGURES_ASK = "Describe each figure, plot, table and diagram on these page images (pages {first} to {last} of a document): what it shows and what follows from it, with its page.\n\nTITLE: {title}"
VIEWS_ASK = "Describe this document in four short texts: notable (what is unusual in it), main_ideas, methods, why_cite (when one would cite it).\n\nTEXT:\n{text}"
TAGS_ASK = "Propose at most five topic tags for this document, from the vocabulary where one fits.\n\nVOCABULARY:\n{vocabulary}\n\nTITLE: {title}\n\nSUMMARY:\n{summary}"
TYPE_ASK = "Name the type of this document in one or two words, from the vocabulary where one fits.\n\nVOCABULARY:\n{vocabulary}\n\nHINT: {hint}\n\nTITLE: {title}\n\nBEGINNING:\n{text}"


@dataclass
class Enriched:
    """`files` (file_id, document_id, pending, extra, summary, doc_type), `tags` (document_id, tag), the catalog after them, and tables to release()."""

    files: DataFrame
    tags: DataFrame
    catalog: Catalog
    tables: tuple[DataFrame, ...]


@dataclass(frozen=True)
class Enricher:
    """render(content) gives the page images of a PDF; embed makes vectors of new names; adjudicate decides near names."""

    model: Model
    render: Callable[[bytes], Iterable[bytes]] | None = None
    embed: Callable[[Column], Column] | None = None
    adjudicate: Callable[[str, str, list[str]], str | None] | None = None

    def run(self, texts: DataFrame, scans: DataFrame, c: Catalog) -> Enriched:
        """Enriches the first file (by path) of each document of texts (file_id, document_id, path, title, text, hint).

        scans (path, content) are the files with pages to look at; of these only chosen ones are read.  A file on which a call fails is pending and gets nothing;
        an answer that doesn't fit adds nothing.
        """
        first = texts.groupBy("document_id").agg(F.min_by("file_id", "path").alias("file_id"))
        # Texts are read where they lie and never shuffled or copied as long as the files to leave out are few; these are stored, so that their size is known.
        others = cut(texts.select("file_id").join(first.select("file_id"), "file_id", "left_anti"), "enrich-others")
        plain = texts.join(others, "file_id", "left_anti")
        tables = [others]

        def asked(*args, **named) -> DataFrame:
            tables.append(ask(*args, **named))
            return tables[-1]

        title = F.coalesce("title", F.lit(""))
        viewed = asked(plain, ["file_id"], "views", self.model, _filled(VIEWS_ASK, text=F.substring("text", 1, CONTEXT)))
        seen = plain.drop("text").join(viewed.select("file_id", F.col("answer").alias("views"), F.col("failure").alias("f_views")), "file_id")
        figures = self._figures(plain, scans, asked)

        pending = F.col("f_views").isNotNull() | F.coalesce("f_figures", F.lit(False))
        so_far = cut(seen.join(figures, "file_id", "left").withColumn("pending", pending), "enrich-views")
        tables.append(so_far)
        is_going = ~F.col("pending") & F.col("views").isNotNull()
        going = so_far.where(is_going)
        stopped = cut(so_far.where(~is_going).select("file_id"), "enrich-stopped")
        tables.append(stopped)
        going_texts = plain.join(stopped, "file_id", "left_anti")
        tag_names, type_names = _names(c, "tag"), _names(c, "doctype")
        shown = lambda names: F.lit("\n".join(names) or "(empty)")
        tagged = asked(going, ["file_id"], "tags", self.model, _filled(TAGS_ASK, vocabulary=shown(tag_names), title=title, summary=tagging_summary(F.col("views"))))
        about = {"title": title, "text": F.substring("text", 1, EXCERPT)}
        typed = asked(going_texts, ["file_id"], "doc_type", self.model, _filled(TYPE_ASK, vocabulary=shown(type_names), hint=F.coalesce(F.nullif("hint", F.lit("")), F.lit("unknown")), **about))
        typed = typed.select("file_id", F.col("answer.doc_type").alias("proposed"), F.col("failure").alias("f_type"))
        unclear = going_texts.join(typed.where("f_type is null").where(is_generic(F.col("proposed"))), "file_id", "left_semi")
        if type_names:
            forced = asked(unclear, ["file_id"], "doc_type", self.model, _filled(TYPE_ASK, vocabulary=shown(type_names), hint=F.lit("choose the closest type of the vocabulary"), **about), choices=type_names)
            typed = typed.join(forced.select("file_id", F.col("answer.doc_type").alias("forced"), F.col("failure").alias("f_forced")), "file_id", "left")
        else:
            typed = typed.withColumns({"forced": F.lit(None).cast("string"), "f_forced": F.lit(None).cast("string")})
        raw = tagged.select("file_id", proposed_tags(F.col("answer.tags")).alias("raw_tags"), F.col("failure").alias("f_tags"))
        every = so_far.join(raw, "file_id", "left").join(typed, "file_id", "left")
        failed = F.col("pending") | F.coalesce("f_tags", "f_type", "f_forced").isNotNull()
        every = every.withColumn("pending", failed).withColumn("raw_type", resolve_doc_type(F.col("proposed"), F.col("forced"), F.lit(len(type_names))))
        every = cut(every, "enrich-answers")

        good = every.where("not pending")
        mentions = good.select("document_id", F.lit("tag").alias("kind"), F.explode("raw_tags").alias("term")).unionByName(good.select("document_id", F.lit("doctype").alias("kind"), F.col("raw_type").alias("term")))
        mentions = mentions.where(F.length(fold(F.col("term"))) > 0)
        named, after = resolve_mentions(mentions, c, self.embed, self.adjudicate)
        types = named.where("kind = 'doctype'").select("document_id", F.col("name").alias("doc_type"))
        head = F.concat(F.lit("["), title, F.lit("] "))
        view = lambda v: F.struct(F.lit("view").alias("kind"), F.concat(head, F.lit(f"[{v}] "), F.trim(F.col("views")[v])).alias("text"))
        views = F.filter(F.array(*[F.when(F.length(F.trim(F.col("views")[v])) > 0, view(v)) for v in VIEWS]), lambda x: x.isNotNull())
        extra = F.when(F.col("pending"), None).otherwise(F.concat(F.coalesce("figures", F.array().cast("array<struct<kind:string,text:string>>")), F.when(F.col("views").isNotNull(), views).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))))
        summary = F.when(~F.col("pending"), F.nullif(F.trim(F.col("views.main_ideas")), F.lit("")))
        files = every.join(types, "document_id", "left").select("file_id", "document_id", "pending", extra.alias("extra"), summary.alias("summary"), "doc_type")
        tags = named.where("kind = 'tag'").select("document_id", F.col("name").alias("tag")).distinct()
        release(*tables)
        return Enriched(files, tags, after, (every, named))

    def _figures(self, chosen: DataFrame, scans: DataFrame, asked: Callable[..., DataFrame]) -> DataFrame:
        """(file_id, figures, f_figures): the figure chunks of each file by page, and whether one of its calls failed."""
        titles = chosen.select("file_id", "path", F.coalesce("title", F.lit("")).alias("title"))
        scans = titles.join(scans.where("content is not null"), "path").select("file_id", "title", "content")
        if self.render is None:
            return titles.where("false").select("file_id", F.array().cast("array<struct<kind:string,text:string>>").alias("figures"), F.lit(False).alias("f_figures"))
        render = self.render
        pages = lambda of: of.mapInPandas(lambda batches: page_batches(batches, render), "file_id long, title string, start int, images array<binary>")
        prompt = _filled(FIGURES_ASK, first=F.col("start") + 1, last=F.col("start") + F.size("images"), title=F.col("title"))
        again = lambda failed: pages(scans.join(failed.select("file_id").distinct(), "file_id", "left_semi"))
        got = asked(pages(scans), ["file_id", "start"], "figures", self.model, prompt, F.col("images"), again=again)
        found = got.select("file_id", "start", F.posexplode("answer.figures").alias("pos", "figure"))
        page = renumber_page(F.col("figure.page"), F.col("start"), F.lit(PAGES_A_CALL))
        text = F.trim("figure.description")
        found = found.where(F.length(text) > 0).select("file_id", F.struct("start", "pos", page.alias("page"), text.alias("text")).alias("figure"))
        listed = found.groupBy("file_id").agg(F.array_sort(F.collect_list("figure")).alias("listed"))  # PAGES pages at most
        said = lambda f, head: F.struct(F.lit("figure").alias("kind"), F.concat(head, F.lit("[figure p."), f["page"].cast("string"), F.lit("] "), f["text"]).alias("text"))
        failed = got.groupBy("file_id").agg(F.max(F.col("failure").isNotNull()).alias("f_figures"))
        head = F.concat(F.lit("["), F.col("title"), F.lit("] "))
        out = failed.join(listed, "file_id", "left").join(titles, "file_id")
        return out.select("file_id", F.transform(F.coalesce("listed", F.array().cast("array<struct<start:int,pos:int,page:int,text:string>>")), lambda f: said(f, head)).alias("figures"), "f_figures")


def page_batches(batches: Iterator[pd.DataFrame], render: Callable[[bytes], Iterable[bytes]]) -> Iterator[pd.DataFrame]:
    """(file_id, title, start, images): PAGES_A_CALL pages in a row, PAGES of a document; a document that can't be drawn has none from there on."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            start = 0
            try:
                for images in batched(islice(render(bytes(row.content)), PAGES), PAGES_A_CALL):
                    yield pd.DataFrame({"file_id": [row.file_id], "title": [row.title], "start": pd.Series([start], dtype="int32"), "images": [list(images)]})
                    start += len(images)
            except (GeneratorExit, KeyboardInterrupt):
                raise
            except Exception:  # noqa: BLE001  whatever a plug-in raises
                continue


def _filled(template: str, **values: Column) -> Column:
    """A template with columns in its braces; a null value makes it null."""
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(values[piece].cast("string") if i % 2 else F.lit(piece))
    return F.concat(*parts)


def _names(c: Catalog, kind: str) -> list[str]:
    """The SHOWN most used names of a kind."""
    return [r["name"] for r in c.entities.where(F.col("kind") == kind).orderBy(F.desc("usage"), "name").limit(SHOWN).collect()]


def resolve_mentions(mentions: DataFrame, c: Catalog, embed: Callable[[Column], Column] | None = None, adjudicate: Callable[[str, str, list[str]], str | None] | None = None) -> tuple[DataFrame, Catalog]:
    """mentions (kind, term, ...) with the `name` of their entity, and the catalog with their usage counted.

    Known names and aliases are found by joins.  Of the unknown terms each counts once, in the order of their folded
    spelling, for which resolve() decides: alike to a known one, or new.
    """
    known = canonical(mentions.withColumn("__folded", fold(F.col("term"))), c)
    new = known.where("name is null").select("kind", F.col("__folded").alias("term")).distinct()
    vec = F.lit(None).cast("array<double>") if embed is None else embed(F.col("term")).cast("array<double>")
    decided, after = resolve(new.withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy("term"))).withColumn("vec", vec), c, adjudicate)
    decided = decided.select("kind", F.col("term").alias("__folded"), F.col("name").alias("__new"))
    named = known.join(decided, ["kind", "__folded"], "left").withColumn("name", F.coalesce("name", "__new"))
    named = cut(named.drop("__folded", "__new", "folded"), "enrich-names")
    counts = named.groupBy("kind", "name").agg(F.count("*").alias("__n"))
    before = c.entities.select("kind", "name", F.col("usage").alias("__before"))
    entities = after.entities.select("kind", "name").join(before, ["kind", "name"], "left").join(counts, ["kind", "name"], "left")
    entities = entities.select("kind", "name", (F.coalesce("__before", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("long").alias("usage"))
    # kinds that had no new term are left as they were
    return named, Catalog(entities, after.aliases, after.vectors, c.merges)
