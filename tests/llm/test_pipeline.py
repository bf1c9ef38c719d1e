from __future__ import annotations

import corpus_pipeline as cp

from lodestone.llm.substrings import remove_repeats


def test_stages_and_run(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    named = cp.language(spark, docs, sf)
    assert named.columns == docs.columns and ids(named) == [d for d, *_ in rows if d not in (76, 77, 78, 80)]
    single = cp.near_duplicates(spark, named, sf)
    assert single.columns == docs.columns and not set(ids(single)) & {61, 62, 66, 67, 70} and {60, 3} <= set(ids(single))
    clean = cp.repeated_passages(spark, single, sf)
    assert clean.columns == docs.columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    assert kept[0] == before[0] and len(kept[72].split()) == 90
    result = cp.run(spark, sf)
    assert result.count() >= len(kept) and {"doc_id", "n_tokens", "ids"} <= set(result.columns)


def test_repeated_and_null_ids_keep_one_of_each_group(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "quite another text than the first"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text or "" for r in cp.near_duplicates(spark, docs, "").collect()) == ["", "a b c d e f g", "quite another text than the first"]


def test_copies_of_a_row_are_repeats(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, " ".join(f"v{i}" for i in range(40)))], "doc_id long, text string")
    assert sorted((r.row.doc_id, r.n_removed) for r in remove_repeats(docs).collect()) == [(1, 40), (1, 40), (2, 0)]
