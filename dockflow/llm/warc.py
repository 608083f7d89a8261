"""WARC archives of pages, every record a Zstandard frame of its own, with a shared dictionary in front.

Each file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record is compressed alone
with it, so any record can be read given the head of its file. Files are written by Spark's text writer, which commits
them task by task: a row holds a frame's bytes, and the line separator is an empty skippable frame, which readers
skip. So a lost executor only repeats its files, and any store that Spark writes to will do.

The dictionary is trained on a bounded sample of payloads: of about ``sample_pages`` with the smallest hash the first
``sample_bytes``. Every file carries it.

Payloads are the UTF-8 bytes of the page text (null: empty). Of records with equal payloads of ``revisit_bytes`` or more the
one with the largest id is the response and the others revisit it; should that id itself repeat, all its rows are
responses; null ids count as smallest, and where all ids are null, all are responses. Every row of the input
gives one record. A payload, however long, is one record, as its row is one row. Other columns, whatever their names, are left
aside. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.llm.shared import small_slices
from dockflow.session import settle

SAMPLE_PAGES = 512
SAMPLE_BYTES = 8_192
DICTIONARY_BYTES = 65_536
REVISIT_BYTES = 1_000
LEVEL = 6
#: Rows that go to Python at once, and bytes of payload of these that are made records at once.
BATCH_ROWS = 256
SLICE_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
_DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
_SKIP_MAGICS = {bytes([0x50 + i]) + b"\x2a\x4d\x18" for i in range(16)}
_EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def plan_records(df: DataFrame, id_column: str, payload: Column, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``-free plan: payload, its size and SHA-1, and the id it refers to if it is a revisit."""
    rows = df.select(
        F.col(id_column).cast("bigint").alias("page_id"), F.col("url").alias("url"), payload.alias("payload")
    ).withColumns({"payload_bytes": F.length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    key = ["payload_digest", "payload_bytes"]
    firsts = (
        rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy(*key)
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    )
    joined = rows.join(settle(firsts).drop("copies"), key, "left")
    refers = F.when(F.col("first_id") != F.coalesce("page_id", F.col("first_id") - 1), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def train_dictionary(
    df: DataFrame, payload: Column, size: int = DICTIONARY_BYTES, sample_pages: int = SAMPLE_PAGES,
    sample_bytes: int = SAMPLE_BYTES,
) -> bytes:
    """A Zstandard dictionary from a bounded sample of payloads; raw content where there is too little to train on."""
    import zstandard

    rows = df.select(payload.alias("payload"))
    n = rows.count()
    share = min(1.0, 4 * sample_pages / n) if n else 1.0
    order = F.xxhash64("payload")
    near = rows.where(F.shiftrightunsigned(order, 11) / 2.0**53 <= share)
    picked = near.select(order.alias("h"), F.substr("payload", F.lit(1), F.lit(sample_bytes)).alias("payload"))
    samples = [bytes(r["payload"]) for r in picked.distinct().orderBy("h").limit(sample_pages).collect() if r["payload"]]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One uncompressed WARC/1.1 record."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    head.append(("WARC-Payload-Length", str(len(payload))))
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    body = b""
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    else:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _uri(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """The columns of ``RECORD``; sizes and digests of responses are taken from the payload itself and must agree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = None
    size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    return (
        int(page) if page else None, size, digest, fields["WARC-Type"], int(refers) if refers else None,
        fields.get("WARC-Target-URI"), payload,
    )


def write_warc(
    df: DataFrame, path: str, id_column: str = "page_id", payload_column: str = "html",
    revisit_bytes: int = REVISIT_BYTES, level: int = LEVEL, date: str = DATE,
) -> None:
    """Write a folder of archives, one per task. ``df`` has the id, ``url`` and the payload as text."""
    payload = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    dictionary = train_dictionary(df, payload)
    plan = plan_records(df, id_column, payload, revisit_bytes)

    def compress(batches):
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known is not None:
            known.precompute_compress(level=level)
        tool = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        first = True
        for batch in small_slices(batches, "payload", SLICE_BYTES):
            frames = []
            if first and batch.num_rows:
                frames.append(_DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary)
                first = False
            for row in batch.to_pylist():
                frames.append(tool.compress(record_bytes(
                    row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"], date
                )))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    columns = plan.select("page_id", "url", "payload", "payload_digest", "refers_to")
    frames = columns.mapInArrow(compress, "frame binary")
    lines = frames.select(F.col("frame").cast("string").alias("value"))
    # whole pages: thousands of them in one Arrow batch, in every task at once, are a large part of an executor's memory
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_ROWS)
    try:
        lines.write.option("lineSep", _EMPTY_FRAME).text(path)
    finally:
        spark.conf.set(setting, before)


def frames_of(data: memoryview, known=None):
    """The frames of an archive, in order, each as bytes; skippable ones are left out."""
    import zstandard

    at = 0
    while at < len(data):
        if bytes(data[at : at + 4]) in _SKIP_MAGICS:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        start, about = at, zstandard.get_frame_parameters(data[at : at + 18])
        at += zstandard.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            block = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            at += 3 + (1 if kind == 1 else size)
        at += 4 * about.has_checksum
        yield bytes(data[start:at])


def read_archive(content: bytes | pa.Buffer):
    """The records of one archive file."""
    import zstandard

    data, known = memoryview(content), None
    if bytes(data[:4]) == _DICTIONARY_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])) if size else None
    tool = zstandard.ZstdDecompressor(dict_data=known)
    for frame in frames_of(data):
        yield parse_record(tool.decompress(frame))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder; ``payloads=False`` leaves the payload column null."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def read(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for record in read_archive(batch.column(0)[i].as_buffer()):
                    rows.append(record if payloads else (*record[:-1], None))
                    if len(rows) == 256:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    return files.mapInArrow(read, RECORD)
