"""Web archives whose records are compressed one by one with a dictionary made from them.

An archive is one binary value: a skippable frame that holds the Zstandard dictionary, then one frame
per record, so it can be stored as a ``.warc.zst`` file and each record can be read alone. Spark deals
out the pages; a task closes an archive when its records reach ``archive_bytes`` and starts another.
Archives are written as rows through Spark's own writer, hence to any store that Spark can reach.

Equal payloads are stored once: the page with the largest id holds the response, the other pages
are revisits of it. Only digests and ids are grouped and joined for that, never payloads.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import encoded, query, short_batches, table
from lectern.plans.scratch import settle

DICTIONARY_FRAME = 0x184D2A5D
_TRAINED = b"\x37\xa4\x30\xec"
_DATE = "2024-01-01T00:00:00Z"


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload a page with a larger id has."""
    same = pages.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_bytes)).select("page_id", "digest")
    top = same.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"))
    top = top.where("low < refers_to").drop("low")
    return same.join(top, "digest").where("page_id < refers_to").distinct()


def _record(kind: str, name: str, url: str, digest: str, refers: str | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    more = "" if refers is None else (
        f"WARC-Refers-To: <urn:page:{refers}>\r\n"
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    )
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Target-URI: {url}\r\n"
        f"WARC-Date: {_DATE}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}"
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def _dictionary(records: list[bytes], size: int):
    """A trained dictionary; the records' own beginning where there is too little to train on."""
    import zstandard

    total, step = sum(map(len, records)), 1
    step = max(1, -(-total // (60 * size)))  # samples of some sixty times the dictionary, over all records
    samples = [r[: 8 * size] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples)
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[: min(size, 4096)]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], dictionary_bytes: int, level: int = 3) -> bytes:
    """The records as one archive."""
    import zstandard

    trained = _dictionary(records, dictionary_bytes)
    held = trained.as_bytes()
    compressor = zstandard.ZstdCompressor(level=level, dict_data=trained)
    head = DICTIONARY_FRAME.to_bytes(4, "little") + len(held).to_bytes(4, "little") + held
    return head + b"".join(map(compressor.compress, records))


def _parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive."""
    import zstandard

    if int.from_bytes(data[:4], "little") != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary")
    end = 8 + int.from_bytes(data[4:8], "little")
    held = data[8:end]
    kind = zstandard.DICT_TYPE_FULLDICT if held[:4] == _TRAINED else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=kind))
    source = io.BufferedReader(reader.stream_reader(io.BytesIO(data[end:]), read_across_frames=True), 1 << 20)
    while source.readline():  # the version line
        fields = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name] = value.strip()
        block = source.read(int(fields["Content-Length"]))
        source.read(4)
        yield fields, block


def write_archives(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    archive_bytes: int = 32 << 20, dictionary_bytes: int = 64 << 10,
) -> DataFrame:
    """The written archives: ``archive`` (a name) and ``content``.

    A null html is an empty payload, a null url an empty one. Pages without an id are responses that
    nothing refers to. Rows that repeat an id and payload are records of the same kind. Further
    columns are not read. No page gives no archive.
    """
    short_batches(df.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    pages = df.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    again = revisits(pages, min_bytes)
    rows = pages.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = [], 0

        def close() -> pa.RecordBatch:
            data = archive(open_, dictionary_bytes)
            name = f"{hashlib.sha1(data).hexdigest()}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page, url, payload, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                kind = "response" if refers is None else "revisit"
                text = base64.b32encode(digest).decode()
                url = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)
                open_.append(_record(kind, "" if page is None else str(page), url, text, None if refers is None else str(refers), payload))
                held += len(open_[-1])
                if held >= archive_bytes:
                    yield close()
                    open_, held = [], 0
        if open_:
            yield close()

    return settle(rows.mapInArrow(run, "archive string, content binary"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    The digest of a response is compared with its payload; ``payload`` is null in revisits.
    """
    # an archive is tens of megabytes, so a partition of a written table holds a few of them
    number = re.compile(r"<urn:page:(-?\d+)>")
    schema = (
        "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ])
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for fields, block in _parsed(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                    page, refers = number.match(fields["WARC-Record-ID"]), number.match(fields.get("WARC-Refers-To", ""))
                    rows.append((
                        page and int(page[1]), fields["WARC-Target-URI"], payload if kind == "response" else None, size,
                        digest, kind, refers and int(refers[1]),
                    ))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return archives.select("content").mapInArrow(run, schema)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS n, h, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, CAST(i // 4 AS INT) * 5 + 1, 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM d
"""


@query(WARC_SQL)
def op9_warc(spark, sf):
    """Every page written to archives and read back."""
    rows = read_archives(write_archives(table(spark, sf, "pages")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
