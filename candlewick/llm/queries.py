"""The registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, counts, html_text, jaccard, mixing, multi_index, pii, token_store, topk, toxicity
from .common import at_end, shared_folder, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), toxicity.offsets("spans").alias("spans"))


def op2_token_store(spark, sf_dir):
    path = shared_folder(spark) + "/tokens"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    at_end(spark, path)
    return token_store.digests(spark, path)


def op3_mixing(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.span_digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op5_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_token_counts(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_multi_index(spark, sf_dir):
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_html_text(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_store, op3_mixing, op4_pii, op5_topk, op6_jaccard, op7_bpe, op8_token_counts, op9_multi_index, op10_html_text, pipeline)}

ORACLE = {
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
        g AS (
            SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
                ELSE list_distinct([array_to_string(t[i:i + 2], ' ') FOR i IN range(1, len(t) - 1)]) END AS s FROM w),
        u AS (SELECT doc_id, unnest(s) AS h FROM g),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y WHERE 100 * n >= 90 * (len(a.s) + len(b.s) - n)),
        c AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x)
        SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, min(c.y) AS component_id FROM g JOIN c ON c.x = g.doc_id GROUP BY ALL""",
    "op9_multi_index": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
        c AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
        m AS (SELECT x, min(y) AS y FROM c GROUP BY x)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.y AS component_id, m.y = e.vec_id AS kept
        FROM embeddings e JOIN m ON m.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id""",
}
