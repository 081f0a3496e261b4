"""WARC archives: normalise whole-file gzip to one member per record (op4).

``write_monolithic`` writes the records of a table the way crawlers often leave them:
one gzip stream over a whole file.  ``normalise`` inflates each such file once, as a
stream, writes every record as a gzip member of its own, turns later copies of a
payload into revisit records, and writes a sidecar index of member offsets.
``read_records`` goes through the index and inflates one member at a time.

Defined results: a NULL html is an empty payload; a NULL url is an empty target; of
records with equal payloads of at least ``least`` bytes, that with the smallest page
id (NULL last, then file order) is the response; repeated rows are separate records;
an empty table gives no file and no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, partitions, prepare, shared_folder, stored

CHUNK = 1 << 20
#: Uncompressed bytes after which a new archive is begun.
FILE_BYTES = 16 << 20
#: Ways a payload digest is dealt out in joins, so that no digest fills one task.
SALTS = 16

RECORD = ("file string, ord int, page_id long, payload_bytes long, payload_digest string")
READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, file string, member_offset long, member_bytes long")


def header(fields: dict[str, object]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), "", ""]
    return "\r\n".join(lines).encode()


def record_id(file: str, ord_: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{ord_}')}>"


def response_fields(file: str, ord_: int, page_id, url: str, payload: int, digest: str) -> dict:
    return {"WARC-Type": "response", "WARC-Record-ID": record_id(file, ord_),
            "WARC-Target-URI": quote(url or "", safe="%/:=&?~#+!$,;'@()*[]"),
            "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": payload,
            "X-Page-ID": "" if page_id is None else page_id,
            "Content-Type": "text/html; charset=utf-8", "Content-Length": payload}


def write_monolithic(pages: DataFrame, folder: str, page_id: str = "page_id",
                     url: str = "url", html: str = "html") -> DataFrame:
    """Write every row as a response record of a whole-file gzip archive; returns one
    row per record.  A repeated task writes new files; only files named in a stored
    result count."""

    def write(batches):
        import pyarrow as pa
        part, out, packer, done, size, ord_ = TaskContext.get().partitionId(), None, None, [], 0, 0

        def close():
            out.write(packer.flush())
            out.close()
            cols = list(zip(*done))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            names = ["file", "ord", "page_id", "payload_bytes", "payload_digest"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                              names=names)

        for batch in batches:
            for pid, target, text in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    uri = f"{folder}/whole-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    fs, path = open_fs(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, done, size, ord_ = fs.open_output_stream(path, compression=None), [], 0, 0
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                payload = (text or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                head = header(response_fields(uri, ord_, pid, target, len(payload), digest))
                for piece in (head, payload, b"\r\n\r\n"):
                    out.write(packer.compress(piece))
                    size += len(piece)
                done.append((uri, ord_, pid, len(payload), digest))
                ord_ += 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = pages.select(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u"),
                        F.col(html).cast("string").alias("h"))
    return rows.mapInArrow(write, RECORD)


def verdicts(records: DataFrame, least: int = 100) -> DataFrame:
    """Add to each record ``first_ord``, ``first_file``, ``refers_to`` (of the response
    that it revisits, else NULL).  The first record of a digest is found by a partial
    aggregate; only digests seen twice are joined back, dealt over salts."""
    big = records.filter(F.col("payload_bytes") >= least)
    first = (big.groupBy("payload_digest", "payload_bytes")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.min(F.struct(F.col("page_id").isNull().alias("x"), "page_id", "file", "ord"))
                  .alias("first"))
             .filter("n > 1")
             .select("payload_digest", "payload_bytes", "first",
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = records.withColumn("salt", F.pmod(F.hash("file", "ord"), F.lit(SALTS)))
    joined = salted.join(first, ["payload_digest", "payload_bytes", "salt"], "left")
    later = F.col("first").isNotNull() & ~((F.col("first.file") == F.col("file"))
                                           & (F.col("first.ord") == F.col("ord")))
    return joined.select("file", "ord", "page_id",
                         F.when(later, F.col("first.file")).alias("first_file"),
                         F.when(later, F.col("first.ord")).alias("first_ord"),
                         F.when(later, F.col("first.page_id")).alias("refers_to"))


class RecordStream:
    """Records of one gzip stream: the header fields, then the block in chunks."""

    def __init__(self, stream):
        self.stream, self.inflate, self.buffer = stream, zlib.decompressobj(31), bytearray()

    def fill(self) -> bool:
        raw = self.inflate.unconsumed_tail or self.stream.read(CHUNK)
        if not raw:
            return False
        self.buffer += self.inflate.decompress(raw, 4 * CHUNK)
        while self.inflate.eof and self.inflate.unused_data:  # a next member follows
            rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            self.buffer += self.inflate.decompress(rest)
        return True

    def head(self) -> dict[str, str] | None:
        at = self.buffer.find(b"\r\n\r\n")
        while at < 0:
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a record header")
                return None
            at = self.buffer.find(b"\r\n\r\n")
        lines = bytes(self.buffer[:at]).decode().split("\r\n")
        del self.buffer[:at + 4]
        return dict(re.split(r":\s*", line, maxsplit=1) for line in lines[1:])

    def block(self, length: int):
        """Yield the block; also passes the two line ends after it."""
        while length:
            if not self.buffer and not self.fill():
                raise ValueError("archive ends inside a record block")
            piece = bytes(self.buffer[:length])
            del self.buffer[:len(piece)]
            length -= len(piece)
            if piece:
                yield piece
        while len(self.buffer) < 4 and self.fill():
            pass
        if self.buffer[:4] != b"\r\n\r\n":
            raise ValueError("a record does not end in two line ends")
        del self.buffer[:4]


def normalise_file(uri: str, revisits: dict[int, tuple[str, int, int | None]], target: str) -> int:
    """Rewrite one archive with a member per record, and write its index beside it.
    ``revisits``: by record number, (file, number, page id) of the response."""
    fs, path = open_fs(uri)
    out_fs, out_path = open_fs(target)
    out_fs.create_dir(out_path.rpartition("/")[0], recursive=True)
    at = ord_ = 0
    with fs.open_input_stream(path, compression=None) as source, \
            out_fs.open_output_stream(out_path, compression=None) as out, \
            out_fs.open_output_stream(f"{out_path}.idx", compression=None) as index:
        records = RecordStream(source)
        while (fields := records.head()) is not None:
            block = records.block(int(fields["Content-Length"]))
            known = revisits.get(ord_)
            if known:
                file, number, page = known
                fields |= {"WARC-Type": "revisit",
                           "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                           "WARC-Refers-To": record_id(file, number),
                           "X-Refers-To-Page-ID": "" if page is None else page,
                           "Content-Length": 0}
            packer, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
            size += out.write(packer.compress(header(fields)))
            for piece in block:
                if not known:
                    size += out.write(packer.compress(piece))
            size += out.write(packer.compress(b"\r\n\r\n"))
            size += out.write(packer.flush())
            index.write(json.dumps({"offset": at, "length": size, "id": fields["WARC-Record-ID"],
                                    "type": fields["WARC-Type"]}).encode() + b"\n")
            at, ord_ = at + size, ord_ + 1
    return ord_


def normalise(records: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive that ``records`` (with verdicts) names; one row per file."""

    def rewrite(pdf):
        import pandas as pd
        uri = pdf["file"].iloc[0]
        known = pdf[pdf["first_ord"].notna()]
        revisits = {int(o): (f, int(n), None if pd.isna(p) else int(p))
                    for o, f, n, p in zip(known["ord"], known["first_file"], known["first_ord"],
                                          known["refers_to"])}
        target = f"{folder}/{uri.rpartition('/')[2].split('.')[0]}-{uuid.uuid4().hex[:8]}.warc.gz"
        if normalise_file(uri, revisits, target) != len(pdf):
            raise ValueError(f"{uri}: its number of records differs from the list")
        return pd.DataFrame({"file": [target], "n_records": [len(pdf)]})

    # dealt by number: the list of records is short, the work is that of their payloads
    n = partitions(records.sparkSession)
    return records.repartition(n, "file").groupBy("file").applyInPandas(rewrite, "file string, n_records long")


def read_records(files: DataFrame) -> DataFrame:
    """Per record of normalised archives, read by its index entry: identity, type, and
    the payload's size and digest (recomputed for responses and compared)."""

    def read(batches):
        import pyarrow as pa
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
                 pa.int64(), pa.int64())
        names = [x.split()[0] for x in READ.split(", ")]
        number = lambda s: int(s) if s else None
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_stream(f"{path}.idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                file, rows = fs.open_input_file(path), []
                for e in entries:
                    member = RecordStream(pa.BufferReader(file.read_at(e["length"], e["offset"])))
                    fields, hashed, size = member.head(), hashlib.sha256(), 0
                    if fields["WARC-Record-ID"] != e["id"]:
                        raise ValueError(f"{uri}: index and record differ at {e['offset']}")
                    for piece in member.block(int(fields["Content-Length"])):
                        hashed.update(piece)
                        size += len(piece)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"][7:]
                    if kind == "response" and (digest, fields["X-Payload-Length"]) != (
                            hashed.hexdigest(), str(size)):
                        raise ValueError(f"{uri}: payload differs from its digest at {e['offset']}")
                    rows.append((number(fields["X-Page-ID"]), int(fields["X-Payload-Length"]),
                                 digest, kind, number(fields.get("X-Refers-To-Page-ID")), uri,
                                 e["offset"], e["length"]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    n = partitions(files.sparkSession)
    return files.select("file").repartition(n, "file").mapInArrow(read, READ)


def archive(pages: DataFrame, least: int = 100, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as whole-file archives, normalise them, and read them back."""
    spark = pages.sparkSession
    prepare(spark)
    root = folder or shared_folder(spark, "warc")
    records = stored(write_monolithic(pages, f"{root}/whole"), "warc-records")
    files = stored(normalise(verdicts(records, least), f"{root}/members"), "warc-files")
    return read_records(files)
