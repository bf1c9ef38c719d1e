from __future__ import annotations

import pytest

from lodestone.operators import catalog as cat


def state():
    s = cat.State("tag")
    s.resolve_term("MOCVD", [1.0, 0.0])
    return s


def test_bands():
    s = state()
    assert s.resolve_term("MOVPE", [0.99, 0.14]) == "mocvd" and s.alias["movpe"] == "mocvd"
    assert s.resolve_term("chemical vapor deposition", [0.85, 0.53]) == "chemical vapor deposition"
    assert s.resolve_term("photoluminescence", [0.0, 1.0]) == "photoluminescence"
    assert s.resolve_term("  mocvd ", None) == "mocvd" and s.usage["mocvd"] == 3


def test_adjudication():
    s = state()
    asked = []
    pick = lambda kind, term, names: asked.append((kind, term, names)) or "mocvd"
    assert s.resolve_term("chemical vapor deposition", [0.85, 0.53], pick) == "mocvd"
    assert asked == [("tag", "chemical vapor deposition", ["mocvd"])]
    assert state().resolve_term("vapor", [0.85, 0.53], lambda *_: "invented") == "vapor"


def test_authors():
    s = cat.State("author")
    assert s.resolve_author("King, A.") == "King, A."
    assert s.resolve_author("King, Ada B.") == "King, Ada B." and s.alias["King, A."] == "King, Ada B."
    assert s.resolve_author("King, A.") == "King, Ada B." and s.usage == {"King, Ada B.": 3}
    assert s.resolve_author("King, Bea") == "King, Bea"
    assert s.resolve_author("Kinng, Ada B.") == "Kinng, Ada B." and s.merges[0][:2] == ("King, Ada B.", "Kinng, Ada B.")
    assert s.lookup_author("Ada King") == "King, Ada B." and s.lookup_author("Nobody, X") is None
    s.apply_merge("King, Ada B.", "Kinng, Ada B.")
    assert s.usage["King, Ada B."] == 4 and s.alias["Kinng, Ada B."] == "King, Ada B."


def test_resolution_follows_the_order_and_feeds_the_catalog(spark):
    rows = [("tag", "MOCVD", 0, [1.0, 0.0]), ("tag", "movpe", 1, [0.99, 0.14]), ("tag", "light", 2, [0.0, 1.0]), ("author", "King, A.", 3, None), ("author", "King, Ada", 4, None)]
    mentions = spark.createDataFrame(rows, "kind string, term string, pos long, vec array<double>")
    found, after = cat.resolve(mentions, cat.Catalog.empty(spark))
    assert {(r.term, r.name) for r in found.collect()} == {("MOCVD", "mocvd"), ("movpe", "mocvd"), ("light", "light"), ("King, A.", "King, A."), ("King, Ada", "King, Ada")}
    again, later = cat.resolve(mentions.where("pos = 1"), after)
    assert again.first().name == "mocvd" and later.entities.where("name = 'mocvd'").first().usage == 3
    groups = cat.term_groups(spark.createDataFrame([("tag", "MOVPE"), ("tag", "new")], "kind string, term string"), after).collect()
    assert {r.term: r.group for r in groups} == {"MOVPE": ["mocvd", "movpe"], "new": ["new"]}


def test_merge_queue_and_seeding(spark):
    c = cat.seed(cat.Catalog.empty(spark), spark.createDataFrame([("a # = x (note), Y",), ("b",), ("# none",)], "value string"))
    c = cat.seed(c, spark.createDataFrame([("a # = x",)], "value string"))
    assert sorted((r.name, r.usage) for r in c.entities.collect()) == [("a", 0), ("b", 0)]
    assert sorted((r.alias, r.name) for r in c.aliases.collect()) == [("x", "a"), ("y", "a")]
    c.merges = spark.createDataFrame([(0, "tag", "a", "b", "why", "pending")], cat.MERGES)
    done = cat.review(c, 0, approve=True)
    assert [(r.usage, r.name, r.aliases) for r in cat.listing(done, "tag").collect()] == [(0, "a", "b, x, y")]
    assert cat.review(c, 0, approve=False).merges.first().status == "rejected" and cat.review(c, 9, True) is c


@pytest.mark.parametrize("proposed, forced, size, want", [("Review ", "book", 3, "review"), ("misc", "Book", 3, "book"), ("misc", "other", 3, None), ("", "x", 0, None)])
def test_doc_types(spark, proposed, forced, size, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(cat.resolve_doc_type(F.lit(proposed), F.lit(forced), F.lit(size)).alias("t")).first().t == want


def test_pending_merges_and_blank_names(spark):
    c = cat.Catalog.empty(spark)
    c.entities = spark.createDataFrame([("author", "King, Ada B.", 3)], cat.ENTITIES)
    c.merges = spark.createDataFrame([(4, "author", "King, Ada B.", "Kinng, Ada B.", "why", "pending")], cat.MERGES)
    rows = [("author", "Kinng, Ada B.", 0, None), ("author", " ", 1, None), ("author", "Kingg, Ada B.", 2, None)]
    found, after = cat.resolve(spark.createDataFrame(rows, "kind string, term string, pos long, vec array<double>"), c)
    assert [(r.pos, r.name) for r in found.orderBy("pos").collect()] == [(0, "Kinng, Ada B."), (1, None), (2, "Kingg, Ada B.")]
    assert sorted((r.id, r.drop_name) for r in after.merges.collect()) == [(4, "Kinng, Ada B."), (5, "Kingg, Ada B.")]


def test_seeding_leaves_known_names(spark):
    from pyspark.sql import functions as F

    c = cat.Catalog.empty(spark)
    c.entities = spark.createDataFrame([("tag", "a", 2), ("tag", "d", 1)], cat.ENTITIES)
    c.aliases = spark.createDataFrame([("tag", "x", "a")], cat.ALIASES)
    lines = spark.createDataFrame([("x # = z",), ("b # = d, y",), ("y",), ("e",)], "value string").coalesce(1)
    got = cat.seed(c, lines, embed=lambda t: F.array(F.length(t).cast("double")))
    assert sorted((r.name, r.usage) for r in got.entities.collect()) == [("a", 2), ("b", 0), ("d", 1), ("e", 0)]
    assert sorted((r.alias, r.name) for r in got.aliases.collect()) == [("x", "a"), ("y", "b"), ("z", "a")]
    assert sorted(r.name for r in got.vectors.collect()) == ["b", "e"]
