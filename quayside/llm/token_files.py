"""Token-id files of independent zstandard frames with a trailing seek table (op6).

File layout: a skippable frame with the document ids (int64; a leading byte per id
tells NULL), one zstandard frame per document holding its ids as little-endian
uint32, and a skippable frame with the seek table: per frame the compressed size,
the decompressed size and the low 32 bits of the XXH64 of the ids, then the number
of frames, a descriptor byte and the closing magic number.  A reader fetches the
table from the end of the file and then only the frames it wants.

Defined results: a NULL or empty text gives only the end id; NULL ids come first;
rows that share an id are ordered by text, so equal rows are interchangeable; an
empty table gives no file and no row; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_fs, partitions, prepare, shared_folder, stored

# Fixed values of the seekable zstandard format.
SKIPPABLE_DIRECTORY = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

ID_ENTRY = struct.Struct("<?q")
SEEK_ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
SKIP_HEADER = struct.Struct("<II")


class FrameWriter:
    """Writes frames to a stream; the tables follow on ``close``."""

    def __init__(self, stream, level: int = 3):
        import xxhash
        import zstandard
        self.stream, self.xxh = stream, xxhash.xxh64_intdigest
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.seek, self.ids = bytearray(), bytearray()
        self.count = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.packer.compress(raw)
        self.stream.write(frame)
        self.seek += SEEK_ENTRY.pack(len(frame), len(raw), self.xxh(raw) & 0xFFFFFFFF)
        self.ids += ID_ENTRY.pack(doc_id is None, doc_id or 0)
        self.count += 1

    def close(self) -> None:
        self.stream.write(SKIP_HEADER.pack(SKIPPABLE_DIRECTORY, len(self.ids)))
        self.stream.write(bytes(self.ids))
        self.stream.write(SKIP_HEADER.pack(SKIPPABLE_SEEK_TABLE, len(self.seek) + FOOTER.size))
        self.stream.write(bytes(self.seek))
        self.stream.write(FOOTER.pack(self.count, HAS_CHECKSUMS, SEEKABLE_MAGIC))
        self.stream.close()


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        import xxhash
        import zstandard
        self.xxh, self.unpack = xxhash.xxh64_intdigest, zstandard.ZstdDecompressor().decompress
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flags, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError(f"{uri}: no seek table")
        table = size - FOOTER.size - count * SEEK_ENTRY.size
        self.entries = list(SEEK_ENTRY.iter_unpack(self.file.read_at(count * SEEK_ENTRY.size, table)))
        ids = table - SKIP_HEADER.size - count * ID_ENTRY.size
        self.ids = [None if null else i for null, i in
                    ID_ENTRY.iter_unpack(self.file.read_at(count * ID_ENTRY.size, ids))]
        self.offsets, at = [], 0
        for packed, _, _ in self.entries:
            self.offsets.append(at)
            at += packed

    def document(self, k: int) -> bytes:
        """Ids of the k-th document, checked against its checksum."""
        packed, plain, check = self.entries[k]
        raw = self.unpack(self.file.read_at(packed, self.offsets[k]), max_output_size=max(plain, 1))
        if len(raw) != plain or self.xxh(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: checksum differs")
        return raw


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0,
                      doc_id: str = "doc_id", text: str = "text",
                      folder: str | None = None) -> DataFrame:
    """Write all documents in ascending id order; returns one row per file.

    One file per range partition of the ids; the texts are shuffled once, and
    encoded where they are written.  A repeated task writes a new file; only
    files named in the stored manifest count.
    """
    spark = docs.sparkSession
    prepare(spark)
    root = folder or shared_folder(spark, "token-files")

    def write(batches):
        import pyarrow as pa

        from .tokens import loaded
        end, tok, out, n = struct.pack("<I", end_id), None, None, 0
        part = TaskContext.get().partitionId()
        uri = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                tok = loaded(tokenizer_path, blanks=True)
                fs, path = open_fs(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = FrameWriter(fs.open_output_stream(path, compression=None))
            for i, raw in zip(batch.column(0).to_pylist(), tok.ids(batch.column(1))):
                out.add(i, raw + end)
                n += len(raw) // 4 + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": pa.array([uri], pa.string()),
                "n_docs": pa.array([out.count], pa.int64()), "n_ids": pa.array([n], pa.int64())})

    plain = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    dealt = plain.repartitionByRange(partitions(spark), F.col("i").asc_nulls_first())
    return stored(dealt.sortWithinPartitions(F.col("i").asc_nulls_first(), "t")
                  .mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def read(batches):
        import pyarrow as pa

        def rows(found):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file, found = FrameReader(path), []
                for k, i in enumerate(file.ids):
                    raw = file.document(k)
                    found.append((i, start, len(raw) // 4, zlib.crc32(raw)))
                    start += len(raw) // 4
                    if len(found) == 4096:
                        yield rows(found)
                        found = []
                if found:
                    yield rows(found)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return (placed.repartition(partitions(spark), "path")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))
