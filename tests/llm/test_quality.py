"""What the word vectors of op 5 are made of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodestone.llm import quality as ql


def buckets(texts):
    return np.concatenate([words for _, words, _, _ in ql._runs(pa.array([t.encode() for t in texts]))])


def test_word_vectors_and_weights_come_from_all_training_texts(spark):
    texts = [f"alpha beta w{i}" for i in range(30)] + ["common other common"] * 200 + [f"held back{i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    model = ql.fit(docs, labels, ql.QualityTraining(epochs=1), corpus=docs.where("doc_id < 230"))
    n = np.bincount(buckets(texts[:230]), minlength=ql.WORD_ROWS)
    assert np.allclose(np.linalg.norm(model.words, axis=1), 1e-3 / (1e-3 + n / n.sum()), rtol=1e-3)
    common, other = buckets(["common other"])
    index = ql.index_vectors(ql.WORD_ROWS, ql.WORD_DIM, 1)
    context = 400.0 * (index[other] + index[common])  # each of 200 texts has it beside "other" twice and beside itself
    want = index[common] + context / np.linalg.norm(context) * np.sqrt(8.0)
    assert np.allclose(model.words[common] / np.linalg.norm(model.words[common]), want / np.linalg.norm(want), atol=1e-3)
