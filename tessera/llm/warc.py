"""WARC archives of pages: one Zstandard frame a record, with a dictionary of the archive's own records in front."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import reach, scratch, sized, stored, table

#: Fixed values of the formats: skippable frame that holds a dictionary, record version, profile of a revisit.
DICTIONARY_FRAME, VERSION = 0x184D2A5D, "WARC/1.1"
SAME_DIGEST = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in an archive, of its dictionary, of the records that the dictionary is trained on; smallest
#: payload that is stored once only.
ARCHIVE, DICTIONARY, TRAINED, SHARED = 32 << 20, 64 << 10, 6 << 20, 1000
LEVEL = 6


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with the payload, or a revisit that names the page whose response has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": f"<urn:x-page:{page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe="%/:=&?~#+!$,;'@()*[]"),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
    }
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Profile": SAME_DIGEST, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}, http)


def dictionary(records: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict | None:
    """A Zstandard dictionary of an archive's records, whole ones spread over it up to TRAINED bytes; None if they are too
    few or too alike to train on."""
    if not records:
        return None
    step = max(1, -(-sum(map(len, records)) // TRAINED))
    samples = records[::step]
    while len(samples) < 16:
        samples = samples * 2
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def archive_bytes(records: list[bytes]) -> bytes:
    """The dictionary in a leading skippable frame, then a frame for each record."""
    trained = dictionary(records)
    out = []
    if trained is not None:
        raw = trained.as_bytes()
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        trained.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
    out += map(packer.compress, records)
    return b"".join(out)


def frames(data: bytes) -> Iterator[memoryview]:
    """The frames of an archive, found by their block headers, without decompression."""
    at, view = 0, memoryview(data)
    while at < len(data):
        start = at
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
        else:
            head = bytes(view[at : at + 18])
            at += zstandard.frame_header_size(head)
            last = 0
            while not last and at < len(data):
                block = int.from_bytes(view[at : at + 3], "little")
                last, kind = block & 1, block >> 1 & 3
                at += 3 + (1 if kind == 1 else block >> 3)
            at += 4 * zstandard.get_frame_parameters(head).has_checksum
        if at > len(data) or magic & 0xFFFFFFF0 != 0x184D2A50 and not last:
            raise ValueError("the archive ends within a frame")
        yield view[start:at]


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    unpacker = zstandard.ZstdDecompressor()
    for frame in frames(data):
        magic = int.from_bytes(frame[:4], "little")
        if magic == DICTIONARY_FRAME:
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame[8:])))
        elif magic & 0xFFFFFFF0 != 0x184D2A50:
            head, _, rest = unpacker.decompress(frame).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            if lines[0] != VERSION or rest[size:] != b"\r\n\r\n":
                raise ValueError(f"not a record of {VERSION}")
            yield fields, rest[:size]


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def revisits(pages: DataFrame, least: int = SHARED) -> DataFrame:
    """page_id, refers_to of the pages whose payload of at least `least` bytes another page's response has: of equal ones,
    that with the largest page_id. Digests are aggregated map-side; payloads aren't shuffled."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.where("page_id is not null").select("page_id", F.sha1(data).alias("sha"), F.octet_length(data).alias("size")).where(F.col("size") >= least)
    rows = stored(rows, "payloads")
    groups = rows.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(groups, ["sha", "size"]).where("page_id <> refers_to").select("page_id", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of pages(page_id, url, html) in a folder that all nodes share: archive, records, bytes.

    Null html is an empty payload. Payloads that pages repeat are stored once (revisits). Rows repeated with one page_id
    give a record each. A page with a null page_id is a response of its own. Pages of any length are whole; other columns
    don't count; no pages give no archives. Names hold the attempt, so that a late one can't touch another's files; each
    file appears whole, by a rename, and only files whose names a task returned are ever read."""
    reach(pages.sparkSession)
    side = stored(revisits(pages), "revisits")
    rows = pages.select("page_id", "url", "html").join(sized(side), "page_id", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, attempt, held, size, made = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), [], 0, 0
        store, root = _place(folder)
        store.create_dir(root, recursive=True)

        def flush() -> pd.DataFrame:
            name = f"{part:06d}-{made:05d}-{attempt}.warc.zst"
            info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
            data = archive_bytes([info, *held])
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(data)
            store.move(draft, f"{root}/{name}")
            return pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [len(held)], "bytes": [len(data)]})

        for pdf in batches:
            for page_id, url, html, other in zip(pdf.page_id.astype("Int64"), pdf.url, pdf.html, pdf.refers_to.astype("Int64"), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                held.append(page_record(None if pd.isna(page_id) else int(page_id), url, payload, None if pd.isna(other) else int(other), date))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return stored(rows.mapInPandas(write, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Per page record: page_id, url, payload_bytes, payload_digest (hex SHA-1 of the full payload), record_type,
    refers_to, archive. The payload of a response is hashed anew; a difference from its header is an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf.archive:
                store, path = _place(archive)
                with store.open_input_stream(path, compression=None) as source:
                    data = source.read()
                rows = []
                for fields, block in read_records(data):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    number = fields["WARC-Record-ID"][len("<urn:x-page:") : -1]
                    other = fields.get("WARC-Refers-To", "<urn:x-page:None>")[len("<urn:x-page:") : -1]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{archive}: page {number} isn't what was archived")
                    rows.append((None if number == "None" else int(number), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], None if other == "None" else int(other), archive))
                yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"
    return archives.select("archive").repartition(max(1, archives.count())).mapInPandas(read, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes pages and reads the archives back; what is done with odd rows is said at write_archives."""
    archives = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM w
"""
