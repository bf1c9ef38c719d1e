"""Registered queries of what a language model adds, with models that answer by rule from the whole texts they are given."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from lodestone.functions.answers import ask
from lodestone.operators.evaluation import rewrite_report
from lodestone.plans.catalogue import query, table
from lodestone.plans.enrich import Enricher
from lodestone.plans.experiments import Results
from lodestone.plans.index import Index
from lodestone.plans.materialize import shared_dir

_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _first_words(prompt: str, images: list[bytes], temperature: float, schema: dict) -> dict:
    """Tags are the first three words; by its number a text gets a good answer, one on the second try, a misfit, or none."""
    number, _, text = prompt.partition("\n")
    words, case = _WORD.findall(text), int(number) % 5
    if case == 3:
        raise ValueError("no answer")
    good = json.dumps({"tags": words[:3]})
    if case == 1 and temperature == 0:
        good = good[:-1]
    return {"text": json.dumps({"tags": number}) if case == 2 else good, "in_tokens": len(words), "out_tokens": 4, "generating": 2.0}


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, doc_id % 5 AS c FROM documents)
SELECT doc_id, CASE WHEN c NOT IN (2, 3) THEN array_to_string(w[1:3], ' ') END AS tags, CASE WHEN c IN (1, 2) THEN 2 ELSE 1 END::INT AS attempts,
CASE WHEN c IN (1, 2) THEN 2 * len(w) WHEN c <> 3 THEN len(w) END::BIGINT AS in_tokens, CASE WHEN c <> 3 THEN 2.0::DOUBLE END AS tokens_per_second, CASE WHEN c = 3 THEN 'ValueError: no answer' END AS failure FROM t""")
def structured_answers(spark, sf_dir):
    """Structured answers about all documents, good, malformed, misfitting and failed: what was read of them, and their cost."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    prompt = F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    got = ask(d, ["doc_id"], "tags", _first_words, prompt)
    return got.select("doc_id", F.array_join("answer.tags", " ").alias("tags"), "attempts", "in_tokens", "tokens_per_second", "failure")


def _by_size(prompt: str, images: list[bytes], temperature: float, schema: dict) -> str:
    """Views, tags and types by the number of words that a prompt shows."""
    asked = set(schema["properties"])
    if "tags" in asked:
        n = int(prompt.rsplit("SUMMARY:\n", 1)[1].split(" ", 1)[0])
        return json.dumps({"tags": [" Text ", "text", f"{len(str(n))} digits", ""]})
    if "doc_type" in asked:
        n = len(_WORD.findall(prompt.split("BEGINNING:\n", 1)[1]))
        return json.dumps({"doc_type": "Note" if n < 50 else "Report" if n < 300 else "misc"})
    n = len(_WORD.findall(prompt.split("TEXT:\n", 1)[1]))
    return json.dumps({"notable": " ", "main_ideas": f"{n} words", "methods": "" if n < 100 else "many words", "why_cite": "size"})


@query("""WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text[1:180000], ''), '[^\\x20\\x09-\\x0D]+')) AS n, len(regexp_extract_all(coalesce(text[1:4000], ''), '[^\\x20\\x09-\\x0D]+')) AS m FROM documents)
SELECT doc_id::VARCHAR AS key, CASE WHEN n > 0 THEN n || ' words' END AS summary, CASE WHEN n = 0 OR m >= 300 THEN NULL WHEN m < 50 THEN 'note' ELSE 'report' END AS doc_type,
CASE WHEN n > 0 THEN len(n::VARCHAR) || ' digits;text' ELSE '' END AS tags, CASE WHEN n = 0 THEN 0 WHEN n < 100 THEN 2 ELSE 3 END::BIGINT AS views FROM t""")
def enriched_documents(spark, sf_dir):
    """An index of all documents with summaries, types, tags and views made while indexing."""
    d = table(spark, sf_dir, "documents")
    index = Index(spark, f"{shared_dir(spark)}/enriched-{uuid.uuid4().hex}", create=True, parts=16)
    key = F.col("doc_id").cast("string")
    rows = d.select(key.alias("key"), key.alias("title"), F.concat(key, F.lit(".txt")).alias("path"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("fingerprint"), "text")
    index.sync(rows, F.col("text"), enrich=Enricher(_by_size))
    views = index.table("chunks").where("kind = 'view'").join(index.table("files").select("file_id", "document_id"), "file_id").groupBy("document_id").agg(F.count("*").alias("views"))
    tags = index.table("doc_tags").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ";").alias("tags"))
    documents = index.table("documents").join(tags, "document_id", "left").join(views, "document_id", "left")
    return documents.select("key", "summary", "doc_type", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("views", F.lit(0)).cast("long").alias("views"))


@query("""WITH t AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
s AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS whole, array_to_string(w[1:(2 * len(w)) // 3], ' ') AS kept FROM t)
SELECT item_id, 2 AS n_chunks, round(length(kept)::DOUBLE / greatest(length(whole), 1), 3) AS length_ratio,
CASE WHEN whole = '' THEN 1.0 ELSE round(2.0 * length(kept) / (length(whole) + length(kept)), 4) END::DOUBLE AS fidelity, ((n >= 2)::INT + (n >= 3)::INT)::INT AS cuts FROM s""")
def rewrite_fidelity(spark, sf_dir):
    """How much of each benchmark passage a rewriting keeps that cuts off the last third and gives the rest as two chunks."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    kept = F.floor(2 * F.size("words") / 3).cast("int")
    half = F.ceil(kept / 2).cast("int")
    chunks = F.array(F.array_join(F.slice("words", F.lit(1), half), " "), F.array_join(F.slice("words", half + 1, kept - half), " "))
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("words")).select("item_id", F.array_join("words", " ").alias("text"), chunks.alias("chunks"))
    return rewrite_report(rows, "item_id").select("item_id", "n_chunks", "length_ratio", "fidelity", F.col("anchors.found").alias("cuts"))


def _counted(row: dict) -> dict:
    """Words of a turn; every seventh turn, from the third, fails."""
    if row["turn"] % 7 == 3:
        raise ValueError("no result")
    return {"words": len(_WORD.findall(row["text"] or ""))}


@query("""SELECT 'c' || conv_id || '/' || turn AS ckpt, CASE WHEN turn % 7 <> 3 THEN len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) END::INT AS words,
CASE WHEN turn % 7 = 3 THEN 'ValueError: no result' END AS error, (CASE WHEN turn % 7 = 3 THEN 2 ELSE 1 END)::BIGINT AS records FROM conversations""")
def experiment_resumed(spark, sf_dir):
    """An experiment over all turns of conversations, run twice: done once, what failed in the first run tried again."""
    d = table(spark, sf_dir, "conversations")
    ckpt = F.concat(F.lit("c"), F.col("conv_id"), F.lit("/"), F.col("turn"))
    work = d.select(ckpt.alias("ckpt"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("fingerprint"), "turn", "text")
    results = Results(spark, f"{shared_dir(spark)}/experiment-{uuid.uuid4().hex}", "words int")
    for _ in range(2):
        results.run(work, _counted, per_round=1_000_000)
    times = results.records().groupBy("ckpt").agg(F.count("*").alias("records"))
    return results.latest().join(times, "ckpt").select("ckpt", "result.words", "error", "records")
