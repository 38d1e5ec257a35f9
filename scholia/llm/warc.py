"""WARC archives in Zstandard: a writer, and a reader that trusts nothing it has not checked.

An archive is a file of frames: a leading skippable frame (magic 0x184D2A5D) with the
dictionary, raw or itself compressed, then one frame per record.  Spark's text sink writes
the frames of a partition one after the other, with an empty skippable frame as its line
separator, so archives are written under Spark's commit protocol and no task holds one
whole.  The reader takes archives from Spark's binaryFile source, loads the dictionary,
decodes frame by frame, and checks each record's version line, named fields, lengths and
digests; what does not hold is told in `problem`, never skipped.

Payloads of LEAST_REVISIT bytes on that are equal (by SHA-256 and length) are stored once:
the record with the largest id is `response`, the others are `revisit` records without a
payload.  Only groups of equal payloads are joined back to the rows: broadcast up to
MOST_BROADCAST of them, by a shuffle of written tables beyond, which Spark can split.

Defined results: a null payload counts as empty; a null id is the least of all; of repeated
rows one is the response and the others revisit it; an empty table writes no record, and an
archive of no bytes holds none; a damaged frame ends its archive with a row that has only
`archive`, `at` and `problem`; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import materialise, shared_dir

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: a skippable frame of no bytes, all ASCII: it parts the frames that the text sink writes.
EMPTY_FRAME = "P*M\x18\0\0\0\0"
LEAST_REVISIT = 1_000
#: bytes of a dictionary, and of an archive's first rows that it is trained on.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 2 << 20
#: groups of equal payloads that are broadcast, of about 100 bytes each.
MOST_BROADCAST = 100_000
#: bytes handed to the decoder at a time, and bytes of payloads held before they are handed on.
WINDOW, HELD = 1 << 16, 8 << 20

RECORD = (
    "archive string, at long, record_type string, record_id string, uri string, page_id string, refers_to string, payload_bytes long, "
    "payload_digest string, payload binary, problem string"
)


def digest32(hexdigest: str) -> str:
    """A digest field: SHA-1 in base 16 (the standard leaves the base to the writer)."""
    return f"sha1:{hexdigest}"


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """One WARC record; fields without a value are left out."""
    named = {**fields, "Content-Length": str(len(block)), "WARC-Block-Digest": digest32(hashlib.sha1(block).hexdigest())}
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in named.items() if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    """A field value cannot hold line breaks."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for records like the samples; None if they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def dictionary_frame(trained: zstandard.ZstdCompressionDict) -> bytes:
    raw = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url") -> DataFrame:
    """row, page_id, uri, payload, sha1, keep_id, keep_row of every row: the last two of the record it revisits, null for a response."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = materialise(rows.withColumns({"n": F.octet_length("payload"), "sha1": F.sha1("payload"), "sha": F.unhex(F.sha2("payload", 256))}), "warc-rows")
    large = rows.where(F.col("n") >= LEAST_REVISIT)
    place = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id"), F.col("row"))
    groups = large.groupBy("sha", "n").agg(F.count(F.lit(1)).alias("rows"), F.max(place).alias("keep")).where("rows > 1")
    kept = materialise(groups.select("sha", "n", F.col("keep.page_id").alias("keep_id"), F.col("keep.row").alias("keep_row")), "warc-groups")
    side = F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept
    told = rows.join(side, ["sha", "n"], "left")
    own = F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row"))
    return told.select("row", "page_id", "uri", "payload", "sha1", *[F.when(~own, F.col(c)).alias(c) for c in ("keep_id", "keep_row")])


def _record_id(name: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{row}')}>"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url") -> None:
    """Archives of the rows of pages, below path: a warcinfo record in each, then one record per row.  An archive holds what
    one task reads (spark.sql.files.maxPartitionBytes), so payloads are not shuffled for it."""
    marked = mark_revisits(pages, id_col, payload_col, uri_col)
    name = uuid.uuid4().hex

    def frames(batches):
        coder = None
        for b in batches:
            if coder is None:
                coder, first = start(b)
                yield from first
            at = 0
            while at < b.num_rows:  # a bounded share of the batch at a time
                out, held = [], 0
                while at < b.num_rows and held < HELD:
                    raw = one(*(b.column(k)[at].as_py() for k in range(b.num_columns)))
                    out.append(coder.compress(raw))
                    held += len(raw)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    def start(b):
        samples, held = [], 0
        for p in b.column("payload"):
            samples.append(p.as_py())
            held += len(samples[-1])
            if held > SAMPLE_BYTES:
                break
        trained = train_dictionary(samples)
        coder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        info = record({"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id(name + "/info", b.column("row")[0].as_py()), "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
        lead = [dictionary_frame(trained)] if trained else []
        return coder, [pa.RecordBatch.from_arrays([pa.array([*lead, coder.compress(info)], pa.binary())], names=["frame"])]

    def one(row, page_id, uri, payload, sha1, keep_id, keep_row) -> bytes:
        revisit = keep_row is not None
        fields = {
            "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(name, row), "WARC-Target-URI": uri,
            "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest32(sha1), "X-Page-ID": page_id,
        }
        if revisit:
            fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(name, keep_row), "X-Refers-To-Page-ID": keep_id}
        return record(fields, http_head(len(payload)) + (b"" if revisit else payload))

    texts = marked.select("row", F.col("page_id").cast("string"), "uri", "payload", "sha1", F.col("keep_id").cast("string"), "keep_row")
    out = texts.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string"))
    out.write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(path)


class Damaged(ValueError):
    """What a record or frame does not hold to."""


def _need(holds: bool, what: str) -> None:
    if not holds:
        raise Damaged(what)


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, if there is one, and the bytes read."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    _need(8 + size <= len(data), "dictionary is cut off")
    raw = bytes(data[8 : 8 + size])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), 8 + size


def frames_of(data: memoryview):
    """(place, decoded bytes) of each frame that is not skippable."""
    trained, at = load_dictionary(data)
    decoder = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(data):
        _need(at + 8 <= len(data), "frame is cut off")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic >> 4 == 0x184D2A5:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            _need(at <= len(data), "skippable frame is cut off")
            continue
        _need(magic == FRAME_MAGIC, "no frame begins here")
        begun, parts, one = at, [], decoder.decompressobj()
        try:
            told = zstandard.get_frame_parameters(bytes(data[at : at + 18])).content_size
            while not one.eof:
                _need(at < len(data), "frame is cut off")
                window = data[at : at + WINDOW]
                parts.append(one.decompress(window))
                at += len(window) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise Damaged(f"frame does not decode: {e}") from e
        whole = b"".join(parts)
        _need(told in (zstandard.CONTENTSIZE_UNKNOWN, len(whole)), "frame is not as long as it says")
        yield begun, whole


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the named fields by lower-case name."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        _need(bool(colon) and bool(name) and not name[0].isspace(), f"bad header line {line[:40]!r}")
        fields[name.lower()] = value.strip()
    return first, fields


def _length(fields: dict[str, str], what: str) -> int:
    n = fields.get("content-length", "")
    _need(n.isascii() and n.isdigit(), f"{what} has no length")
    return int(n)


def parse(raw: bytes) -> dict:
    """One record, checked: its fields, and the payload of a response."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    _need(bool(gap), "headers do not end")
    version, fields = headers(head)
    _need(re.fullmatch(r"WARC/1\.[01]", version) is not None, f"bad version {version[:20]!r}")
    kind = fields.get("warc-type")
    _need(bool(kind) and "warc-record-id" in fields, "a named field is missing")
    n = _length(fields, "record")
    _need(len(rest) == n + 4 and rest[n:] == b"\r\n\r\n", "record is not as long as it says")
    block = rest[:n]
    if "warc-block-digest" in fields:
        _need(fields["warc-block-digest"] == digest32(hashlib.sha1(block).hexdigest()), "block digest differs")
    told = {"record_type": kind, "record_id": fields["warc-record-id"], "uri": fields.get("warc-target-uri"), "page_id": fields.get("x-page-id"), "refers_to": fields.get("x-refers-to-page-id")}
    if kind not in ("response", "revisit"):
        return told
    http, gap, payload = block.partition(b"\r\n\r\n")
    _need(bool(gap) and http.startswith(b"HTTP/"), "no HTTP response")
    size = _length(headers(http)[1], "payload")
    digest = fields.get("warc-payload-digest", "")
    _need(digest.startswith("sha1:"), "payload digest is missing")
    if kind == "response":
        _need(len(payload) == size, "payload is not as long as it says")
        _need(digest == digest32(hashlib.sha1(payload).hexdigest()), "payload digest differs")
    else:
        _need("warc-refers-to" in fields and not payload, "revisit without what it refers to")
    return told | {"payload_bytes": size, "payload_digest": digest.removeprefix("sha1:"), "payload": payload if kind == "response" else None}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below path, with RECORD's columns: a revisit's payload is null, `problem` is null where all holds."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def batch(rows):
        return pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], kind) for c, kind in zip(names, kinds)})

    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")]

    def run(batches):
        for b in batches:
            for archive, content in zip(b.column("path"), b.column("content")):
                rows, held, at = [], 0, 0
                frames = frames_of(memoryview(content.as_buffer()))
                while True:
                    row = {"archive": archive.as_py(), "at": at}
                    try:
                        at, raw = next(frames)
                    except StopIteration:
                        break
                    except Damaged as e:  # where the next frame begins is not known
                        rows.append(row | {"problem": str(e)})
                        break
                    try:
                        rows.append(row | {"at": at} | parse(raw))
                    except Damaged as e:
                        rows.append(row | {"at": at, "problem": str(e)})
                    held += len(raw)
                    if held >= HELD:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url") -> DataFrame:
    """The records read back from archives of pages, written below the shared folder; a record that is not whole is an error."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, payload_col, uri_col)
    told = read_archives(spark, path)
    whole = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "archive", "at", "problem"))).otherwise(F.col("record_type"))
    kind = pages.schema[id_col].dataType
    return told.withColumn("record_type", whole).where(F.col("record_type").isin("response", "revisit")).withColumns(
        {"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
