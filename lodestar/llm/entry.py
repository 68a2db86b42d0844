"""The queries of this folder's operators, each over its whole table, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, knn, langid, lm, packing, pii, prefix_trie, ranked_search, secret_scan, simhash, suffix_dedup, toxicity
from .common import fold, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.learn(docs.where(fold("doc_id", 5) != 0))
    return langid.identify(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key in spark.lodestar.pii.key; without one, under a new key that nobody keeps."""
    key = spark.conf.get("spark.lodestar.pii.key", None) or secrets.token_hex(32)
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, *secret_scan.fitted(docs))


def op6_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.voronoi_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, test = table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~test)
    return toxicity.score(docs, model).select("doc_id", test.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), "toxic")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.scores(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0, public_tokenizers.path(WORD_BPE))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_language_id, op4_pii, op5_secret_scan, op6_voronoi_topk, op7_simhash, op8_prefix_bpe, op9_toxicity, op10_exact_dedup, op11_ranked_search, op12_prefix_trie, op13_lm_scoring)}

ORACLES = {
    "op1_suffix_dedup": r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, unnest(generate_series(1, octet_length(b) - 99)) AS p FROM docs WHERE octet_length(b) >= 100),
windows AS (SELECT s.doc_id, s.p, md5(b[s.p:s.p + 99]) AS w FROM starts s JOIN docs USING (doc_id)),
judged AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1 AS again FROM windows),
runs AS (SELECT doc_id, p, sum(CASE WHEN p > prev + 100 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
         FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM judged WHERE again)),
spans AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS prev, row_number() OVER (PARTITION BY doc_id ORDER BY lo DESC) AS back FROM spans),
left_over AS (SELECT e.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed,
                     string_agg(hex(b[prev:lo - 1]) || CASE WHEN back = 1 THEN hex(b[hi:octet_length(b)]) ELSE '' END, '' ORDER BY lo) AS kept
              FROM edges e JOIN docs USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM docs d LEFT JOIN left_over l ON d.doc_id = l.doc_id""",
    "op6_voronoi_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)""",
    "op11_ranked_search": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
stats AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM docs WHERE len(t) > 0),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, stats GROUP BY term, nn),
parts AS (SELECT term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))) AS part FROM postings JOIN weights USING (term), stats),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0) WHERE rank <= 10""",
    "op12_prefix_trie": """
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
convs AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, c - c % 5 AS head, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 9 AS h FROM convs, tab),
turns AS (SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
anew AS (SELECT heads.c, p, x FROM heads JOIN turns ON turns.c = head AND p <= h UNION ALL SELECT heads.c, p, x FROM heads JOIN turns ON turns.c = heads.c AND p > h),
listed AS (SELECT heads.c, coalesce(list(x ORDER BY p) FILTER (WHERE x IS NOT NULL), []) AS xs FROM heads LEFT JOIN anew ON anew.c = heads.c GROUP BY 1),
prefixes AS (SELECT c, d, xs[:d] AS k, d = len(xs) AS ends FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM listed)),
nodes AS (SELECT k, d, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(k[-1].t) END AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS sha, bool_and(ends) AS leaf FROM prefixes GROUP BY k, d),
below AS (SELECT p.k, p.d, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves, count(*) FILTER (WHERE n.d = p.d + 1) AS children FROM nodes n JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.d GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, children AS n_children, leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, n.sha AS ends_sha256
FROM nodes n JOIN below ON below.k = n.k AND below.d = n.d LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.k = n.k[:-2]""",
}
