"""First-fit decreasing packing with a tournament tree (op9).

A document is cut into pieces of the sequence length and a rest.  Pieces fall into
random groups of bounded size; inside a group, first-fit decreasing takes the
pieces from longest to shortest and puts each into the first sequence with room.
The tree's leaves hold the room of each sequence and every inner node the larger
of its children, so the first sequence with room is found in log(n) steps.

Defined results: a NULL or empty text is the end id alone; repeated rows are packed
once each; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECE + ", sequence_id long, offset long"

#: Pieces that one task packs together, on average.
GROUP_PIECES = 4096


class RoomTree:
    """Tournament tree over the room left in up to ``n`` sequences."""

    def __init__(self, n: int, room: int):
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.room = [room] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(index, room before) of the first sequence with room; takes the room."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        before = room[at]
        index = at - self.leaves
        room[at] = before - length
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return index, before


def first_fit(lengths, capacity: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) per length; the lengths must be in falling order."""
    tree = RoomTree(len(lengths), capacity)
    sequences, offsets = [], []
    for length in lengths:
        index, before = tree.place(int(length))
        sequences.append(index)
        offsets.append(capacity - before)
    return sequences, offsets


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut every document's ids into pieces of at most ``capacity``."""

    def cut(batches):
        import pyarrow as pa

        from .tokens import loaded
        tok, end = loaded(tokenizer_path, blanks=False), struct.pack("<I", end_id)
        for batch in batches:
            found = []
            for i, raw in zip(batch.column(0).to_pylist(), tok.ids(batch.column(1))):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, capacity):
                    part = raw[4 * start:4 * (start + capacity)]
                    found.append((i, start, len(part) // 4, zlib.crc32(part), total))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64()) for c in zip(*found)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).alias("text")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048,
         group_pieces: int = GROUP_PIECES, doc_id: str = "doc_id",
         text: str = "text", seed: int = 17) -> DataFrame:
    """One row per piece with its sequence and its offset there.

    The pieces are stored first (digests only, no ids), so their number fixes the
    number of groups; the group is a hash of the stored row's position, so no key,
    however frequent, decides how many pieces a task gets.
    """
    spark = docs.sparkSession
    prepare(spark)
    cut = stored(pieces(docs, tokenizer_path, end_id, capacity, doc_id, text), "pieces")
    groups = max(1, cut.count() // group_pieces)
    dealt = cut.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)),
                                       F.lit(groups)))

    def fit(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True],
                              kind="stable")
        sequences, offsets = first_fit(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = [(int(key[0]) << 32) + s for s in sequences]
        pdf["offset"] = offsets
        return pdf.drop(columns="g")

    return dealt.groupBy("g").applyInPandas(fit, PACKED)
