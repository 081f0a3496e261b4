"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as RT
from .documents import EMB_SQL, chunks, rec
from ..sources.tables import TABLES
from .registry import query

CENTROIDS = """
e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
             generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, pos, avg(v) AS cv FROM e GROUP BY label, pos),
cn AS (SELECT label, sqrt(sum(cv * cv)) AS n FROM c GROUP BY label),
en AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY vec_id),
d AS (SELECT c.label AS query_id, e.vec_id AS id, sum(c.cv * e.v) AS dot
      FROM c JOIN e ON e.pos = c.pos GROUP BY c.label, e.vec_id),
s AS (SELECT d.query_id, d.id, round(d.dot / (cn.n * en.n), 12) AS sim
      FROM d JOIN cn ON cn.label = d.query_id JOIN en ON en.vec_id = d.id)"""


def centroids(t):
    """Query vectors: the mean embedding of each label (bounded by the
    number of labels; at most 64 rows per label are collected)."""
    ex = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    c = ex.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("cv"))
    g = c.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "cv"))).alias("s"))
    return g.select(F.col("label").alias("query_id"),
                    F.transform("s", lambda x: x["cv"]).alias("embedding"))


@query("vector_topk", f"""
WITH {CENTROIDS}
SELECT query_id, id, sim, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank
  FROM s) r WHERE rank <= 5""")
def vector_topk(t):
    """T10 + O5 + J12: exact cosine top-5 of the embedding table for every
    label centroid (query set broadcast after a size check)."""
    corpus = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return RT.topk(corpus, centroids(t), k=5)


CHUNK_EMB = """,
chunk_emb AS (""" + EMB_SQL.format(key="id", text="content",
                                     src="(SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR) AS id, content FROM chunks)") + """),
q_emb AS (""" + EMB_SQL.format(key="item_id", text="text", src="benchmark") + """),
sims AS (SELECT q.item_id AS query_id, c.id,
                round(list_dot_product(q.embedding, c.embedding)
                      / (sqrt(list_dot_product(q.embedding, q.embedding))
                         * sqrt(list_dot_product(c.embedding, c.embedding))), 12) AS sim
         FROM q_emb q, chunk_emb c WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank
           FROM sims)"""


def chunk_corpus(t):
    c = chunks(t)
    return c.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"),
                             F.col("chunk_index").cast("string")).alias("id"), "content")


def chunk_hits(t, k, min_sim=None):
    # chunked once: the texts of the hits are looked up in the stored chunks
    corpus = chunk_corpus(t).checkpoint()
    emb = RT.embed(corpus, ["id"], "content")
    q = RT.embed(t.benchmark.select(F.col("item_id").alias("query_id"), "text"),
                 ["query_id"], "text")
    return corpus, RT.topk(emb, q, k=k, min_sim=min_sim)


@query("rag_prompt", rec(f"""
SELECT q.item_id AS query_id,
       '{RT.RAG_INSTRUCTION}'
       || chr(10) || chr(10) || 'Question: ' || q.text || chr(10) || chr(10) || 'Context:' || chr(10)
       || coalesce(h.context, '(no context retrieved)') AS prompt
FROM benchmark q LEFT JOIN (
  SELECT r.query_id, string_agg(c.content, chr(10) || '---' || chr(10) ORDER BY r.rank) AS context
  FROM ranked r JOIN (SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR) AS id, content
                      FROM chunks) c ON c.id = r.id
  WHERE r.rank <= 5 GROUP BY r.query_id) h ON h.query_id = q.item_id""", extra=CHUNK_EMB))
def rag_prompt(t):
    """T12 + A7: benchmark items as questions, top-5 document chunks as the
    context of each answer prompt."""
    corpus, hits = chunk_hits(t, 5)
    questions = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return RT.rag_prompts(questions, hits, corpus)


@query("vector_threshold", rec("""
SELECT query_id, id, sim, rank FROM (
  SELECT query_id, id, sim,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank
  FROM sims WHERE sim >= 0.3) r WHERE rank <= 8""", extra=CHUNK_EMB))
def vector_threshold(t):
    """Chunks with similarity >= 0.3 to each question, best 8."""
    return chunk_hits(t, 8, min_sim=0.3)[1]


@query("vector_topk_approx")
def vector_topk_approx(t):
    """Top-5 for the label centroids by coarse cells and coded residuals, with recall
    against T10 and the share of the corpus that was scored exactly."""
    corpus = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    q = centroids(t)
    approx = RT.topk_approx(corpus, q, k=5)
    recall = RT.recall_vs_exact(approx, RT.topk(corpus, q, k=5))
    rows = corpus.agg(F.count(F.lit(1)).alias("corpus_rows"))           # one row
    return approx.join(recall, "query_id", "left").crossJoin(F.broadcast(rows)).select(
        "query_id", "id", "sim", "rank", "recall",
        F.coalesce(F.col("candidates") / F.col("corpus_rows"), F.lit(1.0)).alias("candidate_share"))


@query("schema_search", "WITH " + """
cat AS (SELECT table_name || '.' || column_name AS id,
               table_name || '.' || column_name || ' ' || replace(column_name, '_', ' ') AS description
        FROM information_schema.columns WHERE table_name IN (""" + ", ".join(f"'{n}'" for n in TABLES) + """)),
c_emb AS (""" + EMB_SQL.format(key="id", text="description", src="cat") + """),
q_emb AS (""" + EMB_SQL.format(key="conv_id, turn", text="text", src="conversations") + """),
s AS (SELECT q.conv_id || '-' || q.turn AS query_id, c.id,
             round(list_dot_product(q.embedding, c.embedding)
                   / (sqrt(list_dot_product(q.embedding, q.embedding))
                      * sqrt(list_dot_product(c.embedding, c.embedding))), 12) AS sim
      FROM q_emb q, c_emb c WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL)
SELECT query_id, id, sim, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank
  FROM s WHERE sim >= 0.3) r WHERE rank <= 8""")
def schema_search(t):
    """The catalog columns that fit each conversation turn (similarity at least 0.3,
    best 8)."""
    catalog = RT.schema_catalog({n: getattr(t, n) for n in TABLES})
    asked = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"),
                                   F.col("text").alias("question"))
    return RT.schema_search(catalog, asked)
