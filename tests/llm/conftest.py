"""A small table with what is awkward: nulls, empty and long texts, copies, near copies, shared passages, odd columns."""

from __future__ import annotations

import random

import pytest


def made_documents() -> list[tuple]:
    rng = random.Random(4)
    vocabulary = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(300)] for lang, s in {"en": ["th", "er", "on", "an"], "fr": ["eau", "é", "ou", "le"], "de": ["ung", "sch", "ü", "ein"]}.items()}
    words = lambda lang, n: [rng.choice(vocabulary[lang]) for _ in range(n)]
    rows: list[tuple] = []
    passage = words("en", 60)
    for i in range(60):
        lang = ["en", "fr", "de"][i % 3]
        rows.append((i, " ".join(words(lang, rng.randint(30, 200))), lang, f"s{i % 4}"))
    near = words("en", 120)
    for i in range(60, 66):  # edited copies of one text
        copy = list(near)
        copy[10 + i % 6 * 15] = "edited"
        rows.append((i, "  ".join(copy), "en", "s0"))
    for i in range(66, 72):  # exact copies, one in capitals
        rows.append((i, (rows[3][1].upper() if i == 70 else rows[3][1]), "en", "s1"))
    for i in range(72, 76):  # a passage that several texts share
        rows.append((i, " ".join([*words("en", 50), *passage, *words("en", 40)]), "en", None))
    rows += [(76, None, "en", "s2"), (77, "", None, "s2"), (78, " \t\n", "fr", "s2"), (79, "one", "en", "s2"), (80, "123 456 !!", "en", "s3"), (81, "un deux", None, "s3")]
    rows += [(82, " ".join(words("de", 20_000)), "de", "s0"), (83, "x" * 5000, "en", "s0"), (84, " ".join(["again"] * 400), "en", "s1"), (85, "🙂 ﬁn\x1c\x85 ß é", "fr", "s1")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_documents()


def write(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = "text, doc_id, lang, source, length(text) AS n_chars, 1 AS id, 2 AS size, 'x' AS row, 'y' AS src, 3 AS bucket, 4 AS label, 'z' AS lang_pred"
    docs.selectExpr(*odd.split(", ")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if r[0] % 3 == 2 else 1, 0) for r in rows if r[0] < 60], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vectors += [(300 + i, vectors[20][1]) for i in range(30)]  # copies of a query's vector
    vectors += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [1.0] * 5), (480, [None] + [1.0] * 7)]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory, rows):
    return write(spark, tmp_path_factory.mktemp("sf"), rows)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)
