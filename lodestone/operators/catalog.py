"""The entity catalog: names of tags, authors and document types, their aliases, and a queue of merges to review.

Lookups are joins.  Resolution creates entities, and what a mention resolves to depends on those before it, so the
mentions of one kind are folded in order by one task (a kind is one group; catalogs are vocabularies, not corpora).
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.errors import UsageError
from lodestone.functions.nearest import Best, unit
from lodestone.functions.text import fold, fold_text, given_compatible, given_words, strip_variants, surname

KINDS = ("tag", "author", "doctype")
#: Similarity from which a new term is an alias, and from which an adjudicator is asked.
AUTO, GRAY = 0.97, 0.80
#: Terms, and components of their vectors, that are sent to the tasks at once; more are answered block by block.
TERM_BLOCK, SENT_BLOCK = 32_768, 1 << 22
_NEAREST = "term string, name string, similarity double"
#: Spelling ratio of names from which a merge is proposed.
FUZZY = 0.84
# Document types that say nothing, and what else a query may call its documents.
GENERIC = frozenset({"misc", "miscellaneous", "other", "document", "documents", "text", "file", "general", "unknown", "n/a", "none"})
GENERIC_IN_QUERIES = GENERIC | {"paper", "papers", "article", "articles", "publication", "publications", "work", "works", "study", "studies"}

ENTITIES = "kind string, name string, usage long"
ALIASES = "kind string, alias string, name string"
VECTORS = "kind string, name string, vec array<double>"
MERGES = "id long, kind string, keep_name string, drop_name string, rationale string, status string"


@dataclass
class Catalog:
    """The four tables."""

    entities: DataFrame
    aliases: DataFrame
    vectors: DataFrame
    merges: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(*(spark.createDataFrame([], s) for s in (ENTITIES, ALIASES, VECTORS, MERGES)))


# ---------------------------------------------------------------- lookups


def canonical(terms: DataFrame, c: Catalog) -> DataFrame:
    """terms (kind, term, ...) with `name`: the entity of that folded name, else of that alias, else null."""
    folded = terms.withColumn("folded", fold(F.col("term")))
    exact = c.entities.select("kind", F.col("name").alias("folded"), F.col("name").alias("exact"))
    alias = c.aliases.select("kind", F.col("alias").alias("folded"), F.col("name").alias("by_alias"))
    return folded.join(exact, ["kind", "folded"], "left").join(alias, ["kind", "folded"], "left").withColumn("name", F.coalesce("exact", "by_alias")).drop("exact", "by_alias")


def term_groups(terms: DataFrame, c: Catalog) -> DataFrame:
    """terms with `group`: the canonical name and all its aliases; for an unknown term its folded self."""
    spellings = c.aliases.groupBy("kind", "name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    found = canonical(terms, c).join(spellings, ["kind", "name"], "left")
    known = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return found.withColumn("group", F.when(F.col("name").isNull(), F.array("folded")).otherwise(known)).drop("aliases")


def listing(c: Catalog, kind: str) -> DataFrame:
    """(usage, name, aliases string) of a kind, the most used first."""
    spellings = c.aliases.where(F.col("kind") == kind).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("alias")), ", ").alias("aliases"))
    return c.entities.where(F.col("kind") == kind).join(spellings, "name", "left").select("usage", "name", F.coalesce("aliases", F.lit("")).alias("aliases")).orderBy(F.desc("usage"), "name")


def _best(batches: Iterator[pa.RecordBatch], shared: Broadcast, n: int) -> Iterator[pa.RecordBatch]:
    """(term, name, similarity): the n best names of this task for each asked vector, kept while the batches go by."""
    asked = shared.value
    best = {dim: Best(queries, n) for dim, (_, queries) in asked.items()}
    for batch in batches:
        names, sizes = batch.column(0).to_numpy(zero_copy_only=False).astype(str), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim, kept in best.items():
            mine = np.flatnonzero(sizes == dim)
            if len(mine):
                kept.add(names[mine], _unit(batch.column(1).take(pa.array(mine)), dim))
    for dim, (terms, _) in asked.items():
        scores, names = best[dim].result()
        for a in range(0, len(terms), 8192):
            part = scores[a : a + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(terms[a : a + 8192], part.shape[1]), pa.string()), pa.array(names[a : a + 8192].reshape(-1).tolist(), pa.string()), pa.array(part.reshape(-1), from_pandas=True)], names=["term", "name", "similarity"])


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    return unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def nearest(terms: DataFrame, vectors: DataFrame, n: int = 5) -> DataFrame:
    """(term, name, similarity, rank): the n entities nearest to each term's vector, ties to the name that sorts first.

    terms is (term, vec), the asked side; vectors the vocabulary of one kind.  Every term meets every entity whose
    vector is as long: entities are read once for each block of TERM_BLOCK terms and never shuffled, and each task
    returns n rows a term.
    """
    spark = terms.sparkSession
    rows = vectors.where("name is not null and size(vec) > 0").select("name", F.col("vec").cast("array<double>"))
    asked = terms.where("size(vec) > 0").select(F.col("term").cast("string"), F.col("vec").cast("array<double>"))
    count, sent = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("vec").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-count // TERM_BLOCK), -(-sent // SENT_BLOCK))
    found = spark.createDataFrame([], _NEAREST)
    for i in range(blocks):
        table = (asked.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i) if blocks > 1 else asked).toArrow().combine_chunks()
        if not len(table):
            continue
        names, vecs = table["term"].to_numpy(), table["vec"].combine_chunks()
        sizes = vecs.value_lengths().to_numpy()
        parts = {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}
        shared = spark.sparkContext.broadcast({d: (names[at], _unit(vecs.take(pa.array(at)), d)) for d, at in parts.items()})
        found = found.unionByName(rows.mapInArrow(partial(_best, shared=shared, n=n), _NEAREST))
    order = Window.partitionBy("term").orderBy(F.desc("similarity"), "name")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def band(exact: Column, similarity: Column) -> Column:
    """What resolution would do with a term: exact, auto (alias), gray (adjudicate) or new."""
    return F.when(exact, "exact").when(similarity >= AUTO, "auto").when(similarity >= GRAY, "gray").otherwise("new")


def banding(terms: DataFrame, c: Catalog, kind: str = "tag") -> DataFrame:
    """terms (term, vec, count) with band, the nearest entity and its similarity."""
    known = canonical(terms.withColumn("kind", F.lit(kind)), c).select("term", "vec", "count", F.col("name").isNotNull().alias("known"))
    near = nearest(terms, c.vectors.where(F.col("kind") == kind), 1).select("term", F.col("name").alias("nearest"), "similarity")
    return known.join(near, "term", "left").withColumn("band", band(F.col("known"), F.coalesce("similarity", F.lit(0.0)))).drop("known", "vec")


def band_histogram(banded: DataFrame) -> DataFrame:
    """(band, terms, occurrences, share): terms and their occurrences by band."""
    sums = banded.groupBy("band").agg(F.count("*").alias("terms"), F.sum("count").alias("occurrences"))
    every = Window.partitionBy()
    return sums.withColumn("share", F.round(F.col("occurrences") / F.sum("occurrences").over(every), 4))


def near_thresholds(banded: DataFrame, within: float = 0.015) -> DataFrame:
    """The terms whose similarity lies close to a band's edge."""
    return banded.where((F.abs(F.col("similarity") - AUTO) <= within) | (F.abs(F.col("similarity") - GRAY) <= within))


def compatible_authors(asked: DataFrame, authors: DataFrame) -> DataFrame:
    """(asked, name, usage): authors of the same folded surname whose given names agree."""
    keyed = lambda t, c, p: t.withColumn(f"{p}f", fold(F.col(c))).withColumn("surname", surname(F.col(f"{p}f"))).withColumn(f"{p}given", given_words(F.col(f"{p}f")))
    pairs = keyed(asked, "asked", "a_").join(keyed(authors, "name", "b_"), "surname")
    return pairs.where(given_compatible(F.col("a_given"), F.col("b_given"))).select("asked", "name", "usage")


# ---------------------------------------------------------------- resolution


def split_author(name: str) -> tuple[str, list[str]]:
    last, _, given = fold_text(name).partition(",")
    return last.strip(), given.replace(".", " ").split()


def names_agree(a: list[str], b: list[str]) -> bool:
    return all(x.startswith(y) or y.startswith(x) for x, y in zip(a, b, strict=False))


def ratio(a: str, b: str) -> float:
    """The likeness of two names as `last given`, folded and without dots."""
    flat = lambda name: " ".join([(s := split_author(name))[0], *s[1]]).strip()
    return difflib.SequenceMatcher(None, flat(a), flat(b)).ratio()


@dataclass
class State:
    """One kind's entities while mentions are folded in: name to usage (in order of creation), alias to name, vectors."""

    kind: str
    usage: dict[str, int] = field(default_factory=dict)
    alias: dict[str, str] = field(default_factory=dict)
    vectors: dict[str, list[float]] = field(default_factory=dict)
    merges: list[tuple[str, str, str]] = field(default_factory=list)
    #: Merges that already wait for review.
    pending: set[tuple[str, str]] = field(default_factory=set)

    def find(self, folded: str) -> str | None:
        return folded if folded in self.usage else self.alias.get(folded)

    def ordered(self) -> list[str]:
        return sorted(self.usage, key=lambda n: (-self.usage[n], n))

    def add_alias(self, name: str, alias: str) -> None:
        if alias != name and alias not in self.usage:
            self.alias.setdefault(alias, name)

    def propose(self, keep: str, drop: str, why: str) -> None:
        if keep != drop and (keep, drop) not in self.pending:
            self.pending.add((keep, drop))
            self.merges.append((keep, drop, why))

    def closest(self, name: str) -> tuple[float, str]:
        """The name most alike and its ratio, the most used one of equals."""
        return max(((ratio(name, n), n) for n in self.ordered()), key=lambda x: x[0], default=(0.0, ""))

    def resolve_term(self, raw: str, vec: list[float] | None, adjudicate: Callable[[str, str, list[str]], str | None] | None = None, candidates: list[str] | None = None) -> str:
        """The entity a term belongs to: by name or alias, by similarity, by decision, or a new one.

        Of candidates, if given, only those are compared; they hold every entity that could be chosen.
        """
        term = fold_text(raw)
        if not term:
            raise UsageError(f"empty {self.kind} name")
        name = self.find(term)
        if name is None and vec is not None and self.vectors:
            found = ((n, self.vectors[n]) for n in candidates if n in self.vectors) if candidates is not None else self.vectors.items()
            near = sorted(((_cosine(vec, v), n) for n, v in found if len(v) == len(vec)), key=lambda x: (-x[0], x[1]))[:5]
            if near and near[0][0] >= AUTO:
                name = near[0][1]
            elif near and near[0][0] >= GRAY and adjudicate is not None:
                choice = adjudicate(self.kind, term, [n for similarity, n in near if similarity >= GRAY])
                name = self.find(fold_text(choice)) if choice else None
            if name is not None:
                self.add_alias(name, term)
        if name is None:
            name = term
            self.usage[name] = 0
            if vec is not None:
                self.vectors[name] = list(vec)
        self.usage[name] += 1
        return name

    def resolve_author(self, raw: str) -> str:
        """The author a name belongs to; a fuller given name becomes canonical, a close spelling proposes a merge."""
        raw = " ".join(raw.split())
        if not raw:
            raise UsageError("empty author name")
        name = raw if raw in self.usage else self.alias.get(raw)
        last, given = split_author(raw)
        if name is None:
            for other in self.ordered():
                other_last, other_given = split_author(other)
                if other_last == last and names_agree(given, other_given):
                    name = other
                    if sum(map(len, given)) > sum(map(len, other_given)):
                        self.usage[raw] = self.usage.pop(other)
                        self.alias = {a: raw if n == other else n for a, n in self.alias.items()} | {other: raw}
                        name = raw
                    else:
                        self.add_alias(other, raw)
                    break
        if name is None:
            close = self.closest(raw)
            self.usage[raw] = 0
            name = raw
            if close[0] >= FUZZY:
                self.propose(close[1], raw, f"spelling {close[0]:.2f}")
        self.usage[name] += 1
        return name

    def lookup_author(self, raw: str) -> str | None:
        """Read-only: by name or alias, as `First Last`, by compatible given names, or by the closest spelling."""
        flipped = raw if "," in raw or " " not in raw.strip() else ", ".join(reversed(raw.strip().rsplit(" ", 1)))
        for spelling in (raw, flipped):
            if spelling in self.usage or spelling in self.alias:
                return spelling if spelling in self.usage else self.alias[spelling]
        last, given = split_author(flipped)
        for other in self.ordered():
            other_last, other_given = split_author(other)
            if other_last == last and names_agree(given, other_given):
                return other
        close = self.closest(flipped)
        return close[1] if close[0] >= FUZZY else None

    def apply_merge(self, keep: str, drop: str) -> None:
        if keep in self.usage and drop in self.usage:
            self.usage[keep] += self.usage.pop(drop)
            self.vectors.pop(drop, None)
            self.alias = {a: keep if n == drop else n for a, n in self.alias.items()} | {drop: keep}


def _cosine(a: list[float], b: list[float]) -> float:
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    return dot / max((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 1e-12)


class Near:
    """Finds the entities that a mention could be compared with, for a block of mentions at once.

    Entities' unit vectors lie in arrays that grow, one for each length.  The products of a block with all entities
    before it and with itself are made together; `least` less MARGIN is what a candidate reaches, and of these the
    five best and their equals are named, so that the exact comparison sees what it would choose of all.
    """

    BLOCK, MARGIN, MOST = 512, 1e-9, 5

    def __init__(self, least: float):
        self.least = least - self.MARGIN
        self.names: dict[int, list[str]] = {}
        self.units: dict[int, np.ndarray] = {}

    def add(self, name: str, vec: list[float]) -> None:
        names = self.names.setdefault(len(vec), [])
        units = self.units.setdefault(len(vec), np.empty((1024, len(vec))))
        if len(names) == len(units):
            units = self.units[len(vec)] = np.concatenate([units, np.empty_like(units)])
        units[len(names)] = unit(np.asarray(vec, np.float64)[None])[0]
        names.append(name)

    def before(self, vectors: list) -> list[list[tuple[float, str]]]:
        """For each vector (or None) of a block the (product, name) of entities so far that reach `least`."""
        found: list[list[tuple[float, str]]] = [[] for _ in vectors]
        for dim, names in self.names.items():
            mine = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
            if not mine:
                continue
            asked = unit(np.array([vectors[i] for i in mine], np.float64))
            for a in range(0, len(names), 4096):
                products = asked @ self.units[dim][a : min(a + 4096, len(names))].T
                for row, column in zip(*np.nonzero(products >= self.least), strict=True):
                    found[mine[row]].append((float(products[row, column]), names[a + column]))
        return found

    def candidates(self, vec: list[float], before: list[tuple[float, str]], since: dict[int, int]) -> list[str]:
        """The names to compare: of those before the block and of those that came in it."""
        dim = len(vec)
        names, start = self.names.get(dim, []), since.get(dim, 0)
        found = list(before)
        if len(names) > start:
            products = self.units[dim][start : len(names)] @ unit(np.asarray(vec, np.float64)[None])[0]
            found += [(float(products[j]), names[start + j]) for j in np.flatnonzero(products >= self.least)]
        if len(found) > self.MOST:
            edge = sorted((p for p, _ in found), reverse=True)[self.MOST - 1] - self.MARGIN
            found = [x for x in found if x[0] >= edge]
        return [n for _, n in found]


def _resolved(state: State, rows: list, adjudicate: Callable | None) -> Iterator[str | None]:
    """The names of mentions in their order, None for blank terms."""
    near = Near(AUTO if adjudicate is None else GRAY)
    for name, vec in state.vectors.items():
        near.add(name, vec)
    for at in range(0, len(rows), Near.BLOCK):
        block = rows[at : at + Near.BLOCK]
        terms = [fold_text(r.term) if (r.term or "").strip() else None for r in block]
        vectors = [None if r.vec is None or t is None or state.find(t) is not None else r.vec for r, t in zip(block, terms, strict=True)]
        before, since = near.before(vectors), {d: len(n) for d, n in near.names.items()}
        for row, term, earlier in zip(block, terms, before, strict=True):
            if term is None:
                yield None
                continue
            vec = None if row.vec is None else row.vec.tolist()
            new = vec is not None and state.find(term) is None
            name = state.resolve_term(row.term, vec, adjudicate, near.candidates(vec, earlier, since) if new else [])
            if new and name == term and name in state.vectors:
                near.add(name, vec)
            yield name


_FOLDED = "what string, kind string, name string, other string, number long, vec array<double>"


def _fold(key: tuple, mentions: pd.DataFrame, known: pd.DataFrame, adjudicate: Callable | None) -> pd.DataFrame:
    state = State(key[0])
    for row in known.sort_values("pos").itertuples():
        if row.what == "entity":
            state.usage[row.name_] = int(row.number)
        elif row.what == "alias":
            state.alias[row.other] = row.name_
        elif row.what == "merge":
            state.pending.add((row.name_, row.other))
        elif row.what == "vector":
            state.vectors[row.name_] = list(row.vec)
    rows = list(mentions.sort_values("pos").itertuples())
    if key[0] == "author":
        names = (state.resolve_author(r.term) if (r.term or "").strip() else None for r in rows)
    else:
        names = _resolved(state, rows, adjudicate)
    out = [("mention", key[0], name, r.term, int(r.pos), None) for r, name in zip(rows, names, strict=True)]
    out += [("entity", key[0], n, None, u, None) for n, u in state.usage.items()]
    out += [("alias", key[0], n, a, 0, None) for a, n in state.alias.items()]
    out += [("vector", key[0], n, None, 0, v) for n, v in state.vectors.items()]
    out += [("merge", key[0], keep, drop, i, None) for i, (keep, drop, _) in enumerate(state.merges)]
    return pd.DataFrame(out, columns=["what", "kind", "name", "other", "number", "vec"])


def resolve(mentions: DataFrame, c: Catalog, adjudicate: Callable[[str, str, list[str]], str | None] | None = None) -> tuple[DataFrame, Catalog]:
    """Resolves mentions (kind, term, pos, vec) in the order of pos: (kind, term, pos, name), and the catalog after them.

    Null and blank terms have no name.  Merges that already wait for review are not proposed again.
    """
    from lodestone.plans.materialize import cut

    none = F.lit(None).cast("string")
    novec = F.lit(None).cast("array<double>")
    known = (
        c.entities.select(F.lit("entity").alias("what"), "kind", F.col("name").alias("name_"), none.alias("other"), F.col("usage").alias("number"), novec.alias("vec"), F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("usage"), "name")).alias("pos"))
        .unionByName(c.aliases.select(F.lit("alias").alias("what"), "kind", F.col("name").alias("name_"), F.col("alias").alias("other"), F.lit(0).cast("long").alias("number"), novec.alias("vec"), F.lit(0).alias("pos")))
        .unionByName(c.vectors.select(F.lit("vector").alias("what"), "kind", F.col("name").alias("name_"), none.alias("other"), F.lit(0).cast("long").alias("number"), "vec", F.lit(0).alias("pos")))
        .unionByName(c.merges.where("status = 'pending'").select(F.lit("merge").alias("what"), "kind", F.col("keep_name").alias("name_"), F.col("drop_name").alias("other"), F.lit(0).cast("long").alias("number"), novec.alias("vec"), F.lit(0).alias("pos")))
    )
    asked = mentions.select("kind", "term", "pos", "vec")
    folded = cut(asked.groupBy("kind").cogroup(known.groupBy("kind")).applyInPandas(_with(adjudicate), _FOLDED), "catalog")
    of = lambda what: folded.where(F.col("what") == what)
    merges = of("merge").select(F.col("number").alias("id"), "kind", F.col("name").alias("keep_name"), F.col("other").alias("drop_name"), F.lit("spelling").alias("rationale"), F.lit("pending").alias("status"))
    offset = F.coalesce(F.lit(c.merges.agg(F.max("id")).first()[0]), F.lit(-1)) + 1
    after = Catalog(
        of("entity").select("kind", "name", F.col("number").alias("usage")),
        of("alias").select("kind", F.col("other").alias("alias"), "name"),
        of("vector").select("kind", "name", "vec"),
        c.merges.unionByName(merges.withColumn("id", F.col("id") + offset)),
    )
    return of("mention").select("kind", F.col("other").alias("term"), F.col("number").alias("pos"), "name"), after


def _with(adjudicate: Callable | None) -> Callable:
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not key:
            return pd.DataFrame(columns=["what", "kind", "name", "other", "number", "vec"])
        return partial(_fold, adjudicate=adjudicate)(key, left, right)

    return run


def review(c: Catalog, merge_id: int, approve: bool) -> Catalog:
    """The catalog after a decision: an approved merge gives the dropped entity's usage and aliases to the kept one."""
    row = c.merges.where((F.col("id") == merge_id) & (F.col("status") == "pending")).first()
    if row is None:
        return c
    status = F.when(F.col("id") == merge_id, F.lit("approved" if approve else "rejected")).otherwise(F.col("status"))
    merges = c.merges.withColumn("status", status)
    if not approve:
        return Catalog(c.entities, c.aliases, c.vectors, merges)
    mine = (F.col("kind") == row["kind"]) & (F.col("name") == row["drop_name"])
    moved = F.when(mine, F.lit(row["keep_name"])).otherwise(F.col("name"))
    entities = c.entities.withColumn("name", moved).groupBy("kind", "name").agg(F.sum("usage").alias("usage"))
    aliases = c.aliases.withColumn("name", moved).unionByName(c.entities.where(mine).select("kind", F.col("name").alias("alias"), F.lit(row["keep_name"]).alias("name")))
    return Catalog(entities, aliases.dropDuplicates(["kind", "alias"]), c.vectors.where(~mine), merges)


def seed(c: Catalog, lines: DataFrame, kind: str = "tag", embed: Callable[[Column], Column] | None = None) -> Catalog:
    """The catalog with a vocabulary's tags (usage 0 if new) and variants as aliases; seeding again changes nothing.

    lines is (value), in the order of its rows.  A name that the catalog knows, as an entity or an alias, stays what it
    is; a new one is what it first occurs as.  With embed, a function from a text column to an array<double> column,
    new tags get vectors.
    """

    @F.pandas_udf("struct<tag: string, variants: array<string>>")
    def parsed(values: pd.Series) -> pd.DataFrame:
        rows = [strip_variants(v or "") or (None, []) for v in values]
        return pd.DataFrame({"tag": [fold_text(t) if t else None for t, _ in rows], "variants": [[fold_text(x) for x in v] for _, v in rows]})

    read = lines.select(F.monotonically_increasing_id().alias("n"), parsed("value").alias("p")).select("n", "p.tag", "p.variants").where("length(tag) > 0")
    named = read.select("n", "tag", F.posexplode(F.array_union(F.array("tag"), "variants")).alias("j", "name")).where("length(name) > 0")
    known = c.entities.select("kind", "name").union(c.aliases.select("kind", "alias")).where(F.col("kind") == kind).select("name")
    first = named.groupBy("name").agg(F.min(F.struct("n", "j", "tag")).alias("first")).select("name", "first.j", "first.tag").join(known, "name", "left_anti")
    entities = first.where("j = 0").select(F.lit(kind).alias("kind"), "name", F.lit(0).cast("long").alias("usage"))
    new = first.where("j > 0").select(F.lit(kind).alias("kind"), F.col("name").alias("alias"), F.col("tag").alias("name"))
    of = c.aliases.where(F.col("kind") == kind).unionByName(new).select(F.col("alias").alias("name"), F.col("name").alias("__of"))
    aliases = new.join(of, "name", "left").select("kind", "alias", F.coalesce("__of", "name").alias("name"))
    vectors = c.vectors if embed is None else c.vectors.unionByName(entities.select("kind", "name", embed(F.col("name")).alias("vec")))
    return Catalog(c.entities.unionByName(entities), c.aliases.unionByName(aliases), vectors, c.merges)


def lookup_authors(names: list[str], c: Catalog) -> dict[str, list[str]]:
    """For each asked name the spellings of the author that it means: by name or alias, as `First Last`, by compatible given names, by the closest spelling; else itself.

    Authors are compared where they lie; one row for each asked name comes back.  Nothing is created.
    """
    flipped = {n: n if "," in n or " " not in n.strip() else ", ".join(reversed(n.strip().rsplit(" ", 1))) for n in names}

    @F.pandas_udf("struct<grade: int, ratio: double>")
    def graded(asked: pd.Series, name: pd.Series, spellings: pd.Series) -> pd.DataFrame:
        out = []
        for a, n, s in zip(asked, name, spellings, strict=True):
            f, known = flipped[a], {n, *s}
            (last, given), (other, theirs) = split_author(f), split_author(n)
            alike = ratio(f, n)
            grade = 3 if a in known or f in known else 2 if last == other and names_agree(given, theirs) else 1 if alike >= FUZZY else 0
            out.append((grade, alike if grade == 1 else 0.0))
        return pd.DataFrame(out, columns=["grade", "ratio"])

    if not names:
        return {}
    spellings = c.aliases.where("kind = 'author'").groupBy("name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    authors = c.entities.where("kind = 'author'").join(spellings, "name", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    pairs = authors.withColumn("asked", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn("g", graded("asked", "name", "aliases")).where("g.grade > 0")
    order = Window.partitionBy("asked").orderBy(F.desc("g.grade"), F.desc("g.ratio"), F.desc("usage"), "name")
    best = pairs.withColumn("r", F.row_number().over(order)).where("r = 1").select("asked", F.array_union(F.array("name"), "aliases").alias("group")).collect()
    found = {r["asked"]: r["group"] for r in best}
    return {n: found.get(n, [n]) for n in names}


def is_generic(doc_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(doc_type)).isin(sorted(GENERIC)), F.lit(True))


def resolve_doc_type(proposed: Column, forced: Column, vocabulary_size: Column) -> Column:
    """The proposed type; if it is generic and there is a vocabulary the forced choice; null if that is generic too."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    chosen = F.when(is_generic(proposed) & (vocabulary_size > 0), clean(forced)).otherwise(clean(proposed))
    return F.when(~is_generic(chosen), chosen)


def proposed_tags(raw: Column, most: int = 5) -> Column:
    """At most five tags: trimmed, lower case, distinct in order."""
    clean = F.filter(F.transform(raw, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (F.length(t) > 0))
    return F.slice(F.array_distinct(clean), 1, most)


def constrained_tags(raw: Column, vocabulary: Column) -> Column:
    return F.filter(raw, lambda t: F.array_contains(vocabulary, F.lower(F.trim(t))))


def tagging_summary(views: Column) -> Column:
    """The views that tagging reads, one in a line; missing ones are empty lines."""
    return F.concat_ws("\n", *[F.coalesce(views[v], F.lit("")) for v in ("main_ideas", "notable", "methods")])
