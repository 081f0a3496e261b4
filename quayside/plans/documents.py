"""Document pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import retrieval as RT
from ..sources.tables import spread
from .registry import query

# The test documents have no blank lines: a single newline separates
# paragraphs there (the separator is a parameter of the chunker).
SEP = "\n"
WS = " || ".join(f"chr({ord(c)})" for c in D.STRIP_CHARS)


def chunks_sql(limit: int = D.MAX_CHARS) -> str:
    """DuckDB twin of the chunker: a recursive fold over each document's
    paragraphs, then the chunk list unnested with its index."""
    L = limit
    return f"""
p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})),
                                 lambda x: x <> '') AS ps FROM documents),
f AS (
  SELECT doc_id, 1 AS i, ps, CAST([] AS VARCHAR[]) AS chunks, '' AS buf FROM p
  UNION ALL
  SELECT doc_id, i + 1, ps,
    CASE WHEN length(ps[i]) > {L} THEN list_concat(
              CASE WHEN buf <> '' THEN list_append(chunks, buf) ELSE chunks END,
              list_transform(range(0, CAST(ceil(length(ps[i]) / {L}) AS BIGINT)),
                             lambda j: substring(ps[i], CAST(j * {L} + 1 AS BIGINT), {L})))
         WHEN buf = '' THEN chunks
         WHEN length(buf) + 2 + length(ps[i]) > {L} THEN list_append(chunks, buf)
         ELSE chunks END,
    CASE WHEN length(ps[i]) > {L} THEN ''
         WHEN buf = '' THEN ps[i]
         WHEN length(buf) + 2 + length(ps[i]) > {L} THEN ps[i]
         ELSE buf || chr(10) || chr(10) || ps[i] END
  FROM f WHERE i <= len(ps)),
packed AS (SELECT doc_id, CASE WHEN buf <> '' THEN list_append(chunks, buf) ELSE chunks END AS cs
           FROM f WHERE i = len(ps) + 1),
chunks AS (SELECT doc_id, CAST(unnest(generate_series(0, len(cs) - 1)) AS INTEGER) AS chunk_index,
                  unnest(cs) AS content FROM packed)"""


def rec(body: str, limit: int = D.MAX_CHARS, extra: str = "") -> str:
    return "WITH RECURSIVE " + chunks_sql(limit) + extra + "\n" + body


POLICIES = """,
policies AS (SELECT c.doc_id AS filename, c.chunk_index, c.content,
                    CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id)
                         THEN 'ingested' ELSE 'pending' END AS status
             FROM chunks c)"""


def chunks(t, limit: int = D.MAX_CHARS):
    docs = spread(t.documents.select("doc_id", "text"))
    return D.chunk_documents(docs, key="doc_id", text="text", sep=SEP, limit=limit)


def policies(t):
    """Chunk table: chunks of documents labelled in an earlier pass count as
    ingested, the rest are pending."""
    c = chunks(t).withColumnRenamed("doc_id", "filename")
    known = t.labels.select(F.col("doc_id").alias("filename"), F.lit(True).alias("_k")).distinct()
    j = c.join(known, "filename", "left")
    return j.select("filename", "chunk_index", "content",
                    F.when(F.col("_k"), "ingested").otherwise("pending").alias("status"))


@query("paragraphs", f"""
SELECT doc_id, CAST(unnest(generate_series(0, len(ps) - 1)) AS INTEGER) AS para_index,
       unnest(ps) AS paragraph
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})),
                                 lambda x: x <> '') AS ps FROM documents) p""")
def paragraphs(t):
    """T4: paragraph split, trimmed, empties dropped, numbered from 0."""
    return spread(t.documents.select("doc_id", "text")).select(
        "doc_id", F.posexplode(D.paragraphs(F.col("text"), SEP))
                              .alias("para_index", "paragraph"))


@query("chunk_documents", rec("SELECT doc_id, chunk_index, content FROM chunks"))
def chunk_documents(t):
    """T5 + T6: greedy packing into chunks of <= 6000 characters, numbered from 0."""
    return chunks(t)


@query("chunk_documents_800", rec("SELECT doc_id, chunk_index, content FROM chunks", 800))
def chunk_documents_800(t):
    """T5 at an 800-character limit (exercises the long-paragraph slicing)."""
    return chunks(t, 800)


@query("doc_status", rec("""
SELECT filename, CAST(sum(n * done) AS BIGINT) AS chunks_ingested, CAST(sum(n) AS BIGINT) AS total_chunks,
       list_extract(['pending', 'ingested'], CAST(1 + min(done) AS BIGINT)) AS doc_status
FROM (SELECT filename, CAST(status <> 'pending' AS INTEGER) AS done, count(*) AS n
      FROM policies GROUP BY filename, status) g
GROUP BY filename""", extra=POLICIES))
def doc_status(t):
    """T8 + A2 + A4: per-document chunk status."""
    return D.doc_status(policies(t))


@query("ingest_totals", rec("""
SELECT coalesce(max(n) FILTER (status = 'ingested'), 0) AS chunks_ingested,
       coalesce(max(n) FILTER (status = 'pending'), 0) AS chunks_pending,
       coalesce(CAST(sum(n) AS BIGINT), 0) AS total_chunks
FROM (SELECT status, count(*) AS n FROM policies GROUP BY status) g""", extra=POLICIES))
def ingest_totals(t):
    """A3: overall chunk counts."""
    return D.ingest_totals(policies(t))


@query("register_chunks", rec("""
SELECT c.doc_id AS filename, c.chunk_index, c.content, 'pending' AS status FROM chunks c
WHERE NOT EXISTS (SELECT 1 FROM policies p WHERE p.filename = c.doc_id AND p.chunk_index = c.chunk_index
                  AND p.status = 'ingested')""", extra=POLICIES))
def register_chunks(t):
    """T7 + S8: chunks of a new run registered as pending unless the
    (filename, chunk_index) key is already on file."""
    on_file = policies(t).filter(F.col("status") == "ingested")
    batch = chunks(t).withColumnRenamed("doc_id", "filename")
    return D.register_chunks(on_file, batch).select("filename", "chunk_index", "content", "status")


EMB_SQL = """
SELECT {key}, CASE WHEN nrm > 0 THEN list_transform(cnt, lambda c: c / nrm) END AS embedding FROM (
  SELECT {key}, cnt, sqrt(list_sum(list_transform(cnt, lambda c: c * c))) AS nrm FROM (
    SELECT {key}, list_transform(range(64), lambda b: CAST(len(list_filter(bs, lambda x: x = b)) AS DOUBLE)) AS cnt
    FROM (SELECT {key}, list_transform(
                 list_filter(regexp_split_to_array(lower({text}), '[^0-9a-z]+'), lambda w: w <> ''),
                 lambda w: CAST(('0x' || substr(md5(w), 1, 4)) AS INTEGER) % 64) AS bs
          FROM {src}) a) b) c"""


@query("embed_chunks", rec(EMB_SQL.format(key="filename, chunk_index", text="content",
                                          src="(SELECT * FROM policies WHERE status = 'pending')"),
                           extra=POLICIES))
def embed_chunks(t):
    """Embed the pending chunks only (hashed bag of tokens, 64 dims)."""
    pend = policies(t).filter(F.col("status") == "pending")
    return RT.embed(pend, ["filename", "chunk_index"], "content")


@query("mark_ingested", rec("SELECT p.filename, p.chunk_index, p.status AS status_before, "
                            "CASE WHEN e.embedding IS NOT NULL THEN 'ingested' ELSE p.status END AS status "
                            "FROM policies p LEFT JOIN (" + EMB_SQL.format(
                                key="filename, chunk_index", text="content",
                                src="(SELECT * FROM policies WHERE status = 'pending')")
                            + ") e ON e.filename = p.filename AND e.chunk_index = p.chunk_index",
                            extra=POLICIES))
def mark_ingested(t):
    """T9, whole step: register -> embed the pending chunks -> mark them ingested."""
    known = policies(t).checkpoint()          # chunked once; both halves read the stored rows
    pend = known.filter(F.col("status") == "pending")
    vectors = RT.embed(pend, ["filename", "chunk_index"], "content")
    before = known.select("filename", "chunk_index", "status", F.col("status").alias("status_before"))
    return D.mark_ingested(before, vectors).select("filename", "chunk_index", "status_before", "status")


@query("html_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>\\n]*>', '', 'g') AS text FROM pages")
def html_strip_tags(t):
    """Crude tag strip fallback."""
    return t.pages.select("page_id", D.strip_tags(F.col("html")).alias("text"))


@query("html_text")
def html_text(t):
    """HTML to text with the standard-library parser inside the tasks."""
    return D.html_text(spread(t.pages.select("page_id", "html"))).select("page_id", "text")
