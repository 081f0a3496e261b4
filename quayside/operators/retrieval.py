"""Embedding and similarity retrieval.

* ``embed``: hashed bag-of-tokens in one pass with no shuffle: an
  Arrow-batched pandas UDF tokenises each text, buckets each distinct token
  once per task by MD5 and counts with numpy.  A real model plugs in through
  ``model=`` (any pandas UDF from text to vector) instead.
* ``topk``: exact cosine top-k per query.  The query vectors are stored as tiles of
  bounded size; each task scores blocks of its corpus rows against one tile at a time
  (Arrow batches via ``mapInPandas``), keeps a running list of the k best rows per query and
  passes on that, never query x corpus pairs.  The path is the same for any number of queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import DIM, TOKEN_RE
from ..session import ensure_checkpoint_dir

TILE_QUERIES = 1000                     # query vectors scored at once
BLOCK_ROWS = 1024                       # corpus rows scored at once
#: Coarse cells at most, rows a cell that they are trained on, rounds of training, levels of
#: a residual's code on either side of zero, and queries that set the number of probes.
MAX_CELLS, SAMPLE_PER_CELL, KMEANS_ROUNDS, LEVELS, SAMPLE_QUERIES = 4096, 50, 10, 127, 200
HELD_TILES = 16                         # tiles that a task keeps in memory
HELD_BYTES = 16 << 20                   # corpus vectors that a task scores against every tile at once
HELD_ROWS = 1 << 21                     # rows in a task's running lists before they are passed on
# The answer-prompt instruction; retrieved texts are joined
# with a line holding "---" (see ``rag_prompts``).
RAG_INSTRUCTION = ("Answer the question using only the context below. If the context does not "
                   "contain the answer, say so.")


def _hashed_embedder(dim: int):
    """Arrow-batched embedder: tokenise (lower-case, runs of [0-9a-z]),
    bucket each distinct token once by MD5 (a per-task cache: the
    vocabulary is far smaller than the token stream), count with
    ``np.bincount`` and L2-normalise."""
    import hashlib
    import re

    split = re.compile(TOKEN_RE)

    @F.pandas_udf("array<double>")
    def embed_text(texts: pd.Series) -> pd.Series:
        cache: dict[str, int] = {}
        out = []
        for txt in texts:
            if txt is None:
                out.append(None)
                continue
            toks = split.findall(txt.lower())
            if not toks:
                out.append(None)
                continue
            b = np.empty(len(toks), dtype=np.int64)
            for i, w in enumerate(toks):
                v = cache.get(w)
                if v is None:
                    if len(cache) > 1_000_000:
                        cache.clear()
                    v = cache[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim
                b[i] = v
            c = np.bincount(b, minlength=dim).astype(np.float64)
            out.append(c / np.sqrt((c * c).sum()))
        return pd.Series(out, dtype=object)
    return embed_text


def embed(df: DataFrame, key: list[str], text_col: str, dim: int = DIM,
          out_col: str = "embedding", model=None, keep: list[str] | None = None) -> DataFrame:
    """One L2-normalised ``array<double>`` per row of ``df`` (by ``key``),
    computed in a single pass with no shuffle.  Rows without any token get a
    NULL vector.  ``model`` may be any pandas UDF from text to vector."""
    fn = model if model is not None else _hashed_embedder(dim)
    return df.select(*key, *(keep or []), fn(F.col(text_col)).alias(out_col))


def query_tiles(queries: DataFrame, qid_col: str, qvec_col: str, family_col: str | None,
                tile: int = TILE_QUERIES) -> list[str]:
    """Write the query vectors (unit length, NULL and zero vectors left out) as tiles of
    at most ``tile`` rows to the shared checkpoint folder, each a Parquet file of its
    own; the driver keeps the file names only.  Rows are sorted by family, so a tile
    holds few of them."""
    spark = queries.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/queries-{uuid.uuid4().hex}"
    q = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).cast("array<double>").alias("v"),
                       (F.col(family_col) if family_col else F.lit("")).cast("string").alias("family"))
    q = q.filter(F.col("v").isNotNull()).sortWithinPartitions("family")
    q.write.option("maxRecordsPerFile", tile).parquet(path)
    return sorted(spark.read.parquet(path).inputFiles())


def _read_tile(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    t = pq.read_table(name, filesystem=store)
    m = np.array(t.column("v").to_pylist(), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1) if len(m) else np.zeros(0)
    keep = norm > 0
    ids = np.array(t.column("query_id").to_pylist(), dtype=object)[keep]
    fam = np.array(t.column("family").to_pylist(), dtype=object)[keep]
    return ids, fam, (m[keep] / norm[keep, None] if len(m) else m)


def _blocks(batches: Iterator[pd.DataFrame]):
    """Lists of corpus blocks (unit vectors, ids, families; ordered by id), each list of at most
    about HELD_BYTES of vectors; NULL and zero vectors are left out."""
    held, size = [], 0
    for pdf in batches:
        pdf = pdf[pdf["v"].notna()]
        for at in range(0, len(pdf), BLOCK_ROWS):
            part = pdf.iloc[at:at + BLOCK_ROWS]
            m = np.vstack(part["v"].to_numpy()).astype(np.float64, copy=False)
            norm = np.linalg.norm(m, axis=1)
            part, m = part[norm > 0], m[norm > 0] / norm[norm > 0, None]
            if not len(part):
                continue
            by_id = np.argsort(part["id"].to_numpy(), kind="stable")
            held.append((m[by_id], part["id"].to_numpy()[by_id], part["family"].to_numpy()[by_id]))
            size += m.nbytes
            if size >= HELD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _merged(best: tuple | None, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple:
    """The k best (ids, sims) of a running list and of new rows, per query: by similarity,
    then by id."""
    if best is not None:
        ids, sims = np.concatenate([best[0], ids], axis=1), np.concatenate([best[1], sims], axis=1)
    by_id = np.argsort(ids, axis=1, kind="stable")
    sims = np.take_along_axis(sims, by_id, 1)
    first = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(np.take_along_axis(ids, by_id, 1), first, 1), np.take_along_axis(sims, first, 1)


def _partial_topk(tiles: list[str], k: int, min_sim: float | None):
    """Per task: score corpus blocks against one tile of queries at a time, and keep a running
    list of the k best rows per query (ties at the k-th place by id) over all blocks.  A
    task passes on k rows per query; lists of more than HELD_ROWS rows together are passed
    on early, so memory is bounded for any number of queries."""

    def rows_of(lists: dict[str, tuple], ids_of: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for path, (ids, sims) in lists.items():
            row, col = np.nonzero(sims > -np.inf if min_sim is None else sims >= min_sim)
            if len(row):
                yield pd.DataFrame({"query_id": ids_of[path][row], "id": ids[row, col], "sim": sims[row, col]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, tuple] = {}
        lists: dict[str, tuple] = {}
        ids_of: dict[str, np.ndarray] = {}
        for blocks in _blocks(batches):
            for path in tiles:
                if path not in loaded:
                    if len(loaded) >= HELD_TILES:
                        loaded.clear()
                    loaded[path] = _read_tile(path)
                q_ids, q_family, q = loaded[path]
                for m, ids, family in blocks:
                    if set(family).isdisjoint(q_family):
                        continue
                    # rounded to 12 places so that equal vectors tie exactly
                    sims = np.round(q @ m.T, 12)
                    sims[q_family[:, None] != family[None, :]] = -np.inf
                    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    lists[path] = _merged(lists.get(path), ids[best], np.take_along_axis(sims, best, 1), k)
                    ids_of[path] = q_ids
                if sum(x[1].size for x in lists.values()) > HELD_ROWS:
                    yield from rows_of(lists, ids_of)
                    lists, ids_of = {}, {}
        yield from rows_of(lists, ids_of)
    return run


def topk(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id",
         vec_col: str = "embedding", qid_col: str = "query_id", qvec_col: str = "embedding",
         min_sim: float | None = None, family: tuple[str, str] | None = None) -> DataFrame:
    """Exact cosine top-k of ``corpus`` for every query, as
    (query_id, id, sim, rank).  Order: similarity desc, then id.  ``family`` names a
    column of the corpus and one of the queries that must be equal.

    One path for any number of queries: they are stored as tiles, every task scores its
    corpus rows tile by tile, and k rows per query and task go to the final ranking."""
    id_type = dict(corpus.dtypes)[id_col]
    qid_type = dict(queries.dtypes)[qid_col]
    tiles = query_tiles(queries, qid_col, qvec_col, family[1] if family else None)
    rows = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"),
                         (F.col(family[0]) if family else F.lit("")).cast("string").alias("family"))
    out = rows.mapInPandas(_partial_topk(tiles, k, min_sim),
                           f"query_id {qid_type}, id {id_type}, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rag_prompts(questions: DataFrame, hits: DataFrame, chunks: DataFrame,
                qid_col: str = "query_id", qtext_col: str = "question",
                chunk_id: str = "id", chunk_text: str = "content") -> DataFrame:
    """T12 + A7: per question, the retrieved texts in rank order joined by
    ``\\n---\\n`` inside the answer prompt.  An empty retrieval gives a
    'no context' prompt (the reference's concatenation would be NULL).
    Each group holds at most k rows."""
    h = hits.join(chunks.select(F.col(chunk_id).alias("id"), F.col(chunk_text).alias("_txt")), "id")
    ctx = h.groupBy(qid_col).agg(F.expr(
        "string_agg(_txt, '\\n---\\n') WITHIN GROUP (ORDER BY rank)").alias("context"))
    q = questions.select(F.col(qid_col), F.col(qtext_col).alias("_q")).join(ctx, qid_col, "left")
    prompt = F.concat(
        F.lit(RAG_INSTRUCTION + "\n\nQuestion: "), F.col("_q"),
        F.lit("\n\nContext:\n"), F.coalesce(F.col("context"), F.lit("(no context retrieved)")))
    return q.select(qid_col, prompt.alias("prompt"))


def _unit_rows(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    """(name, v): unit vectors; NULL and zero vectors are left out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias(name), v.alias("v"), norm.alias("n")) \
        .filter("n > 0").select(name, F.transform("v", lambda x: x / F.col("n")).alias("v"))


def train_cells(rows: DataFrame, n: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Centres of coarse cells (k-means on the directions of a sample), and the step of the
    residuals' codes.  There are about sqrt(n) cells, at most MAX_CELLS; the sample has at
    most SAMPLE_PER_CELL rows a cell, those with the smallest hash of their id."""
    cells = int(min(MAX_CELLS, max(1, round(np.sqrt(n)))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CELL * cells).select("v").toPandas()["v"]
    m = np.vstack(sample.to_numpy())
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(KMEANS_ROUNDS):
        of = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    rest = np.abs(m - centres[(m @ centres.T).argmax(1)])
    return centres, max(float(np.quantile(rest, 0.999)) / LEVELS, 1e-12)


def _encode(centres: np.ndarray, step: float):
    """(id, cell, code): the nearest centre, and one byte per dimension for the residual."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.vstack(pdf["v"].to_numpy())
                cell = (m @ centres.T).argmax(1)
                code = np.clip(np.round((m - centres[cell]) / step), -LEVELS, LEVELS).astype(np.int8)
                yield pd.DataFrame({"id": pdf["id"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in code]})
    return run


def _scan_codes(tiles: list[str], centres: np.ndarray, step: float, probes: int, depth: int):
    """Per task: the ``depth`` rows with the best coded similarity per query, among the
    rows in the query's ``probes`` nearest cells, kept as a running list over all blocks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        # one byte a dimension: a partition's codes are an eighth of its vectors
        ids = np.concatenate([b["id"].to_numpy() for b in parts])
        cell = np.concatenate([b["cell"].to_numpy() for b in parts])
        code = np.frombuffer(b"".join(c for b in parts for c in b["code"]), np.int8).reshape(len(ids), -1)
        for path in tiles:
            q_ids, _, q = _read_tile(path)
            if not len(q_ids):
                continue
            coarse = q @ centres.T
            rank = np.argsort(np.argsort(-coarse, axis=1, kind="stable"), axis=1)
            best, value = np.full((len(q), 0), -1), np.zeros((len(q), 0))
            for at in range(0, len(ids), BLOCK_ROWS):
                here = cell[at:at + BLOCK_ROWS]
                sims = coarse[:, here] + q @ (code[at:at + BLOCK_ROWS].astype(np.float64) * step).T
                sims[rank[:, here] >= probes] = -np.inf
                value = np.concatenate([value, sims], axis=1)
                best = np.concatenate([best, np.broadcast_to(np.arange(at, at + len(here)), sims.shape)], axis=1)
                if value.shape[1] > depth:
                    keep = np.argpartition(-value, depth - 1, axis=1)[:, :depth]
                    value, best = np.take_along_axis(value, keep, 1), np.take_along_axis(best, keep, 1)
            row, col = np.nonzero(value > -np.inf)
            if len(row):
                yield pd.DataFrame({"query_id": q_ids[row], "id": ids[best[row, col]], "coded": value[row, col]})
    return run


def _needed_probes(exact: DataFrame, codes: DataFrame, asked: DataFrame, centres: np.ndarray, target: float) -> int:
    """Fewest cells that hold the share ``target`` of the sample queries' exact hits."""
    rows = exact.join(codes.select("id", "cell"), "id").join(asked, "query_id").select("cell", "v").toPandas()
    if not len(rows):
        return len(centres)
    coarse = np.vstack(rows["v"].to_numpy()) @ centres.T
    own = np.take_along_axis(coarse, rows["cell"].to_numpy()[:, None].astype(np.int64), 1)
    rank = np.sort((coarse > own).sum(1))
    return int(rank[min(len(rank) - 1, int(np.ceil(target * len(rank))) - 1)]) + 1


def topk_approx(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id",
                vec_col: str = "embedding", qid_col: str = "query_id",
                qvec_col: str = "embedding", target: float = 0.99, depth: int | None = None) -> DataFrame:
    """Approximate top-k: (query_id, id, sim, rank, candidates).

    Vectors lie in trained coarse cells, with a byte per dimension for the residual.  A
    query looks through the codes of its nearest cells, ``depth`` rows go on and are scored
    exactly (``candidates``: how many).  The number of cells looked through is the fewest
    that hold the share ``target`` of the exact hits of sample queries, vectors of the
    corpus that are answered by the exact search.  A query with fewer than k candidates
    is answered by the exact search, so none is lost."""
    spark = corpus.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    depth = depth or 24 * k
    rows, asked = _unit_rows(corpus, id_col, vec_col, "id"), _unit_rows(queries, qid_col, qvec_col, "query_id")
    n = rows.count()
    id_type, qid_type = dict(rows.dtypes)["id"], dict(asked.dtypes)["query_id"]
    if not n:
        return topk(corpus, queries, k, id_col, vec_col, qid_col, qvec_col).withColumn("candidates", F.lit(None).cast("long"))
    centres, step = train_cells(rows, n)
    rows.mapInPandas(_encode(centres, step), f"id {id_type}, cell int, code binary").write.parquet(folder)
    codes = spark.read.parquet(folder)
    sample = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE_QUERIES) \
        .select(F.col("id").alias("query_id"), F.col("v").alias("embedding"))
    # the sample's own vectors are hits at once and say nothing
    hits = topk(rows, sample, k + 1, "id", "v").filter(F.col("query_id") != F.col("id"))
    probes = _needed_probes(hits, codes, sample.withColumnRenamed("embedding", "v"), centres, target)
    tiles = query_tiles(asked, "query_id", "v", None)
    w = Window.partitionBy("query_id").orderBy(F.desc("coded"), F.asc("id"))
    picked = codes.mapInPandas(_scan_codes(tiles, centres, step, probes, depth),
                               f"query_id {qid_type}, id {id_type}, coded double") \
        .withColumn("place", F.row_number().over(w)).filter(F.col("place") <= depth).select("query_id", "id")
    dot = F.aggregate(F.zip_with("v", "qv", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = picked.join(rows, "id").join(asked.withColumnRenamed("v", "qv"), "query_id") \
        .select("query_id", "id", F.round(dot, 12).alias("sim"))
    by = Window.partitionBy("query_id")  # of at most ``depth`` rows
    found = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("sim"), F.asc("id")))) \
        .withColumn("candidates", F.count(F.lit(1)).over(by))
    enough = found.filter((F.col("rank") <= k) & (F.col("candidates") >= k))
    short = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("embedding")) \
        .join(enough.select("query_id").distinct(), "query_id", "left_anti")
    exact = topk(corpus, short, k, id_col, vec_col).withColumn("candidates", F.lit(None).cast("long"))
    return enough.select("query_id", "id", "sim", "rank", "candidates").unionByName(exact)


def recall_vs_exact(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact top-k hits the approximate search also returned, per query."""
    hit = exact.join(approx.select("query_id", "id", F.lit(1).alias("_h")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(
        (F.count("_h") / F.count(F.lit(1))).alias("recall"))


def schema_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, description) rows for the columns of the given tables."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, f.name, f"{n}.{f.name} {f.name.replace('_', ' ')}")
            for n, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, description string")


def schema_search(catalog: DataFrame, questions: DataFrame, min_sim: float = 0.3,
                  k: int = 8) -> DataFrame:
    """Catalog columns relevant to each question: T10 + O6 with the
    catalog as corpus (similarity >= 0.3, best 8)."""
    cat = catalog.select(F.concat_ws(".", "table_name", "column_name").alias("id"), "description")
    corpus = embed(cat, ["id"], "description")
    q = embed(questions, ["query_id"], "question")
    return topk(corpus, q, k=k, min_sim=min_sim)
