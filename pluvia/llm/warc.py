"""WARC archives with a Zstandard dictionary.

Each task writes its records to archives of its own in a shared folder. An archive begins with a skippable frame that
holds a dictionary trained on the archive's first records, and every record is a Zstandard frame of its own, so any
record can be read alone. Of records with equal payloads one is a response; the others are revisits without a payload.

A task that is run again writes new names; the manifest names the archives of the attempts that counted, and only those
are read. Memory: the records the dictionary is trained on, then one record at a time.

Defined results: a null html is an empty payload. Of rows with equal payloads the largest page_id is the response (a
null id loses); rows that repeat its id and payload are responses too. Null urls have no target header, and control
characters in urls are percent-encoded. Too few or too short records to train on give an archive without the leading
frame. An empty table gives no archives. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.operators.skew import skewed_left, skewed_lookup
from pluvia.session import Scratch

DICTIONARY_FRAME = 0x184D2A5D  # fixed: magic of the skippable frame that holds a .warc.zst dictionary
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, dictionary_bytes long, bytes long"
RECORDS = "page_id long, url string, record_id string, record_type string, refers_to string, payload binary"


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, data: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One WARC record; ``refers_to`` is the page id of the response that a revisit has the payload of."""
    digest = digest_of(data)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
    if not is_revisit:
        block += data
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """page_id, url, record_id, type, refers_to and payload of a record; raises if a response's digest is wrong."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    data = None
    if fields["WARC-Type"] == "response":
        data = block.partition(b"\r\n\r\n")[2]
        if fields["WARC-Payload-Digest"] != f"sha1:{digest_of(data)}":
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
    page = fields.get("X-Page-ID")
    return None if page is None else int(page), fields.get("WARC-Target-URI"), fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), data


def train(samples: list[bytes], most: int) -> zstandard.ZstdCompressionDict | None:
    size = min(most, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8) if size >= 1024 and len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """One archive; records wait until there are enough to train the dictionary on."""

    def __init__(self, path: str, sample_bytes: int, dictionary_bytes: int, level: int):
        self.files, at = pafs.FileSystem.from_uri(path.rsplit("/", 1)[0])
        self.files.create_dir(at, recursive=True)
        self.path, self.out = path, self.files.open_output_stream(f"{at}/{path.rsplit('/', 1)[1]}", compression=None)
        self.sample_bytes, self.dictionary_bytes, self.level = sample_bytes, dictionary_bytes, level
        self.waiting: list[bytes] = []
        self.held = self.records = self.dictionary = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def _begin(self) -> None:
        trained = train(self.waiting, self.dictionary_bytes)
        if trained:
            body = trained.as_bytes()
            self.dictionary = len(body)
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_checksum=True)
        for raw in self.waiting:
            self.out.write(self.compressor.compress(raw))
        self.waiting = []

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.compressor:
            self.out.write(self.compressor.compress(raw))
            return
        self.waiting.append(raw)
        self.held += len(raw)
        if self.held >= self.sample_bytes:
            self._begin()

    @property
    def size(self) -> int:
        return self.out.tell()

    def close(self) -> tuple:
        if not self.compressor:
            self._begin()
        size = self.size
        self.out.close()
        return self.path, self.records, self.dictionary, size


def frames(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one at a time."""
    rest = stream.read(8)
    known = None
    if len(rest) == 8 and struct.unpack("<I", rest[:4])[0] == DICTIONARY_FRAME:
        known = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", rest[4:])[0]))
        rest = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=known)
    while rest or (rest := stream.read(chunk)):
        one, parts = decompressor.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := stream.read(chunk)):
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def write_archives(
    pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 256 << 20, sample_bytes: int = 2 << 20,
    dictionary_bytes: int = 64 << 10, level: int = 6,
) -> DataFrame:
    """Write the pages to archives in ``folder`` (a URI that all executors reach) and return the manifest, lazily: the
    archives are written when the manifest is."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload(F.col("html")).alias("data"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("data")))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
    groups = Scratch(pages.sparkSession, "warc-groups").write(groups, "groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    placed = skewed_lookup(rows, groups, "digest", "copies", total).select("page_id", "url", "data", "response_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done, names = None, [], MANIFEST.replace(" string", "").replace(" long", "").split(", ")
        for batch in batches:
            for page_id, url, data, response_id in zip(*(batch.column(i) for i in range(4))):
                page_id, response_id = page_id.as_py(), response_id.as_py()
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst", sample_bytes, dictionary_bytes, level)
                writer.add(record(page_id, url.as_py(), data.as_py(), response_id, page_id != response_id, date))
                if writer.size >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)

    return placed.mapInArrow(run, MANIFEST)


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives, payloads of responses checked against their digests."""
    types = [pa.int64(), *[pa.string()] * 4, pa.binary()]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = pafs.FileSystem.from_uri(path)
                found, held = [], 0
                with files.open_input_stream(at, compression=None) as stream:
                    for raw in frames(stream):
                        found.append(parse(raw))
                        held += len(raw)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
                            found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    archives = manifest.select("archive")
    return archives.repartition(max(1, manifest.count())).mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page id) of each record.

    A revisit's payload is the one of the response it refers to; where that response isn't among the records, these
    columns are null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [d.as_py() for d in batch.column(4)]
            sizes = pa.array([None if d is None else len(d) for d in data], pa.int64())
            digests = pa.array([None if d is None else digest_of(d) for d in data], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sizes, digests], ["page_id", "record_id", "record_type", "target", "payload_bytes", "payload_digest"])

    scratch = Scratch(records.sparkSession, "warc-records")
    light = records.select("page_id", "record_id", "record_type", F.col("refers_to").alias("target"), "payload")
    light = scratch.write(light.mapInArrow(run, "page_id long, record_id string, record_type string, target string, payload_bytes long, payload_digest string"), "light")
    first = light.filter("record_type = 'response'")
    named = first.groupBy(F.col("record_id").alias("target")).agg(
        F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")
    )
    revisits = light.filter("record_type = 'revisit'").select("page_id", "record_type", "target")
    uses = revisits.groupBy("target").agg(F.count("*").alias("uses"))
    found = skewed_left(revisits, scratch.write(named.join(uses, "target"), "named"), ["target"], "uses", revisits.count())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(found.select(columns))
