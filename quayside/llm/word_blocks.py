"""Documents as stored blocks of words: files in the shared folder, one per block.

A block holds whole documents with about ``BLOCK_WORDS`` words: document ids, words
per document, and every word as an index into the block's own sorted dictionary of
word hashes.  Later passes read blocks instead of texts; a block never changes, so a
pass that is repeated after a lost executor finds the same words in the same order.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import open_fs, stored
from .text_arrays import pack, rows_of_words, unpack

BLOCK_WORDS = 1 << 20
MANIFEST = "block long, path string, n_docs long, n_words long"


def write_file(uri: str, raw: bytes) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(raw)


def read_block(uri: str) -> dict[str, np.ndarray]:
    """Arrays of a block: id, null, tag, words (per document), dictionary, word."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return unpack(f.read())


def write_blocks(docs: DataFrame, folder: str, doc_id: Column, text: Column,
                 tag: Column, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Write all documents as blocks of about ``block_words``; returns the stored list of
    blocks.  ``tag`` is a small number that goes along with each document."""

    def write(batches):
        import pyarrow as pa
        part, held, count, done = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            nonlocal held, count, done
            ids, null, tags, counts, hashes = (np.concatenate(x) for x in zip(*held))
            dictionary, word = np.unique(hashes, return_inverse=True)
            uri = f"{folder}/block-{part:06d}-{done:05d}-{uuid.uuid4().hex}"
            write_file(uri, pack({"id": ids, "null": null, "tag": tags, "words": counts,
                                  "dictionary": np.diff(dictionary, prepend=np.uint64(0)),
                                  "word": word.astype(np.uint32)}))
            row = {"block": [(part << 24) + done], "path": [uri], "n_docs": [len(ids)],
                   "n_words": [len(hashes)]}
            held, count, done = [], 0, done + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tags = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for at, hashes, counts in rows_of_words(batch.column(1)):
                to = at + len(counts)
                held.append((ids[at:to], null[at:to], tags[at:to], counts.astype(np.int64), hashes))
                count += len(hashes) + len(counts)
                if count >= block_words:
                    yield flush()
        if held:
            yield flush()

    plain = docs.select(doc_id.cast("long").alias("i"), text.cast("string").alias("t"),
                        tag.cast("int").alias("g"))
    return stored(plain.mapInArrow(write, MANIFEST), "blocks")
