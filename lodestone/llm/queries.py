"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestone.llm.bpe import op4_duckdb_byte_bpe
from lodestone.llm.decisions import op11_learned_quality_rules
from lodestone.llm.langid import op10_word_backoff_language_id
from lodestone.llm.minhash import op1_superminhash_near_dedup
from lodestone.llm.mixing import op8_pareto_source_mixing
from lodestone.llm.neighbours import op7_additive_quantisation_ann
from lodestone.llm.periodic import op12_periodic_runs
from lodestone.llm.quality import op5_random_indexing_quality
from lodestone.llm.scoring import op3_attention_lm_scoring
from lodestone.llm.sharding import op9_feistel_sharding
from lodestone.llm.substrings import op6_debruijn_substring_dedup
from lodestone.llm.winnowing import op2_winnowing_fingerprints

QUERIES = [
    op1_superminhash_near_dedup,
    op2_winnowing_fingerprints,
    op3_attention_lm_scoring,
    op4_duckdb_byte_bpe,
    op5_random_indexing_quality,
    op6_debruijn_substring_dedup,
    op7_additive_quantisation_ann,
    op8_pareto_source_mixing,
    op9_feistel_sharding,
    op10_word_backoff_language_id,
    op11_learned_quality_rules,
    op12_periodic_runs,
]


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in [*QUERIES, pipeline]}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What SQL can state in full.  The other queries depend on hashes of this library or on trained models.
SQL = {
    "op1_superminhash_near_dedup": f"""WITH RECURSIVE
w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
pair AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(d, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT d, b FROM reach JOIN pair ON a = r),
c AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.d = w.doc_id""",
    "op6_debruijn_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM w, unnest(range(1, len(ws) - 33)) t(i) WHERE len(ws) >= 35),
r AS (SELECT s FROM x GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM x SEMI JOIN r USING (s) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
sha256(coalesce(array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(coalesce(gone, []), i)], ' '), '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)""",
    # CRC-32 bit by bit: a byte is mixed in, then (at -1) the register shifts by one.
    "op12_periodic_runs": f"""WITH k AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws,
xor(4294967295, list_reduce(flatten([[4294967295], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])])::BIGINT[], lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) AS h FROM documents),
m AS (SELECT *, len(ws) AS n, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM k),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] FOR i IN range(n)] ELSE ws END AS ws FROM m),
w AS (SELECT doc_id, n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
e AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
f AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
o AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM f GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, l, min(q) AS p FROM o GROUP BY doc_id, s, l),
c AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM r),
t AS (SELECT doc_id, count(*) AS n_runs, min((-l, s, p)) AS top, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS shown FROM r GROUP BY doc_id),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top[2] AS start, -top[1] AS length, top[3] AS period, 1000 * -top[1] // top[3] AS exponent_milli,
sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
