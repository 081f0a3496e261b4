"""Incremental document ingest as a Structured Streaming job.

The file source remembers, in its checkpoint, which files it has already
read, so a re-run picks up only new files ("known by name": a changed file
under a known name is not re-read, as in the reference).  Each micro-batch
is chunked and registered into the chunk table with insert-if-absent on
(filename, chunk_index), so replays after a failure do not duplicate rows.
``trigger(availableNow=True)`` processes everything present and stops.

Known by content (``ingest_versions``): a file that comes again under its name with other
content, in a later delivery, replaces its chunks.  The table of versions is only ever
added to: each micro-batch, or each scan of a folder, writes its files with their hash and
chunks into a folder of its own epoch, and a file's chunks are those of its latest epoch
(``current_chunks``).  A batch that is run again writes its epoch anew and compares with
earlier epochs only, so a failure at any point leaves every chunk once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators.relational import insert_if_absent

CHUNK_SCHEMA = "filename string, chunk_index int, title string, content string, status string"
VERSION_SCHEMA = CHUNK_SCHEMA + ", content_sha string"


def _html_or_text(df: DataFrame) -> DataFrame:
    """HTML files through the parser, other files unchanged."""
    is_html = F.lower(F.col("filename")).endswith(".html")
    html = D.html_text(df.filter(is_html), html_col="raw", out_col="text")
    other = df.filter(~is_html).withColumn("text", F.col("raw"))
    return html.unionByName(other)


def existing_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table at ``path`` on any file system that Spark reads, or S14: an empty
    one of the same schema if there is none yet."""
    try:
        return spark.read.schema(CHUNK_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHUNK_SCHEMA)


def ingest_stream(spark: SparkSession, path: str, checkpoint: str, out: str,
                  max_chars: int = D.MAX_CHARS, sep: str = D.PARA_SEP):
    """Start the ingest query and return it (already finished when
    ``availableNow`` has drained the folder; call ``awaitTermination``)."""
    src = (spark.readStream.format("text").option("wholetext", True)
           .option("pathGlobFilter", D.DOC_GLOBS).option("recursiveFileLookup", False)
           .load(path))
    docs = src.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("raw"))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        texts = _html_or_text(batch.withColumn(
            "title", F.regexp_replace("filename", r"\.[^.]*$", "")))
        chunks = texts.select("filename", "title", F.posexplode(
            D.pack(D.paragraphs(F.col("text"), sep), max_chars)).alias("chunk_index", "content"))
        chunks = chunks.select("filename", "chunk_index", "title", "content",
                               F.lit("pending").alias("status"))
        target = existing_chunks(spark, out)
        new = insert_if_absent(target, chunks, ["filename", "chunk_index"],
                               order=["title", "content"])
        new.write.mode("append").parquet(out)

    return (docs.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _versions(spark: SparkSession, out: str) -> DataFrame:
    """All rows of the table of versions, with their epoch; empty if there is none yet.
    Folders of epochs whose write did not end are not looked at: files get their names
    when the job commits."""
    try:
        return spark.read.schema(VERSION_SCHEMA + ", epoch bigint").parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSION_SCHEMA + ", epoch bigint")


def write_version(spark: SparkSession, files: DataFrame, out: str, epoch: int,
                  max_chars: int = D.MAX_CHARS, sep: str = D.PARA_SEP) -> None:
    """Store, as ``epoch``, those of ``files`` (filename, raw, seen, path) whose content is not
    what the latest earlier epoch holds.  Of several files of one name the one seen last
    counts (by time, then path).  A file without text leaves one row without a chunk, so its
    former chunks are no longer current; a NULL text is an empty one.  (Spark's file sources
    pass over files of no bytes at all: these change nothing.)"""
    latest = files.groupBy("filename").agg(F.max_by(F.coalesce("raw", F.lit("")), F.struct("seen", "path")).alias("raw"))
    now = latest.withColumn("content_sha", F.sha2("raw", 256))
    known = _versions(spark, out).filter(F.col("epoch") < epoch).groupBy("filename").agg(
        F.max_by("content_sha", "epoch").alias("known_sha"))
    changed = now.join(known, "filename", "left").filter(
        F.col("known_sha").isNull() | (F.col("known_sha") != F.col("content_sha"))).drop("known_sha")
    texts = _html_or_text(changed.withColumn("title", F.regexp_replace("filename", r"\.[^.]*$", "")))
    rows = texts.select("filename", "title", "content_sha", F.posexplode_outer(
        D.pack(D.paragraphs(F.col("text"), sep), max_chars)).alias("chunk_index", "content"))
    rows.select("filename", "chunk_index", "title", "content", F.lit("pending").alias("status"), "content_sha") \
        .write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each file's latest version."""
    rows = _versions(spark, out)
    last = rows.groupBy("filename").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["filename", "epoch"]).filter(F.col("chunk_index").isNotNull()).select(
        "filename", "chunk_index", "title", "content", "status", "content_sha", "epoch")


def ingest_versions(spark: SparkSession, path: str, checkpoint: str, out: str,
                    max_chars: int = D.MAX_CHARS, sep: str = D.PARA_SEP):
    """Start the stream that ingests by content and return it.  ``path`` is a folder, or a
    pattern of folders with one delivery each: a stream reads a path once, so a changed
    file comes in a new delivery.  Files changed in place: ``ingest_folder``."""
    src = (spark.readStream.format("text").option("wholetext", True)
           .option("pathGlobFilter", D.DOC_GLOBS).option("recursiveFileLookup", False).load(path))
    files = src.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("raw"),
                       F.col("_metadata.file_modification_time").alias("seen"),
                       F.col("_metadata.file_path").alias("path"))
    return (files.writeStream.foreachBatch(
        lambda batch, epoch: write_version(batch.sparkSession, batch, out, epoch, max_chars, sep))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def ingest_folder(spark: SparkSession, path: str, out: str, max_chars: int = D.MAX_CHARS,
                  sep: str = D.PARA_SEP) -> int:
    """One scan of a folder by content, files changed in place included, as the next epoch of
    ``out``; returns the epoch.  Not to be mixed with a stream that writes to ``out``."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=D.DOC_GLOBS, recursiveFileLookup=False).select(
        F.col("_metadata.file_name").alias("filename"), F.col("value").alias("raw"),
        F.col("_metadata.file_modification_time").alias("seen"), F.col("_metadata.file_path").alias("path"))
    last = _versions(spark, out).agg(F.max("epoch")).first()[0]
    epoch = 0 if last is None else last + 1
    write_version(spark, files, out, epoch, max_chars, sep)
    return epoch
