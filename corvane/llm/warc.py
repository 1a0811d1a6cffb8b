"""WARC archives: one gzip member per record, and a sequential reader.

Writing: each task writes one archive into the shared folder under a name of
its own and reports the path; only reported archives are read, so a lost task
leaves at most an unread file.  Reading: a task inflates an archive step by
step, frames each record by its content length and verifies its digests as the
bytes pass; no record or archive is held whole unless its payload is asked for.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm import store
from corvane.llm.kernel import byte_blocks, tidy

#: Payloads under this size are never written as revisits.
LEAST_REVISIT = 100
#: Repeated payloads' digests that are broadcast (some 110 bytes each); beyond, pages are dealt by digest, those of one payload into SALTS parts.
BROADCAST_DIGESTS, SALTS = 200_000, 16
STEP = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType()
for _name, _type in (("record_id", T.StringType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("problem", T.StringType()), ("payload", T.BinaryType())):
    RECORD = RECORD.add(_name, _type)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def make_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    """The bytes of a record before compression; a revisit has the HTTP header only, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{_clean(record_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{_clean(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Framer:
    """Takes the inflated bytes of one member and gives its record."""

    def __init__(self, with_payload: bool):
        self.with_payload = with_payload
        self.pending, self.head, self.http = b"", None, None
        self.left, self.size, self.problem = 0, 0, None
        self.block_hash, self.payload_hash, self.payload = hashlib.sha256(), hashlib.sha256(), []

    @staticmethod
    def _fields(text: bytes) -> dict[str, str]:
        lines = text.decode("utf-8", "replace").split("\r\n")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}

    def feed(self, data: bytes) -> None:
        if self.head is None:
            self.pending += data
            at = self.pending.find(b"\r\n\r\n")
            if at < 0:
                return
            self.head, data, self.pending = self._fields(self.pending[:at]), self.pending[at + 4 :], b""
            length = self.head.get("content-length", "")
            if not self.head[""].startswith("WARC/") or not length.isdigit():
                self.problem = "bad header"
            self.left = int(length) if length.isdigit() else 0
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block_hash.update(block)
        if self.http is None:
            self.pending += block
            at = self.pending.find(b"\r\n\r\n")
            if at < 0:
                if rest:
                    self._tail(rest)
                return
            self.http, block, self.pending = self._fields(self.pending[:at]), self.pending[at + 4 :], b""
        self.size += len(block)
        self.payload_hash.update(block)
        if self.with_payload:
            self.payload.append(block)
        if rest:
            self._tail(rest)

    def _tail(self, rest: bytes) -> None:
        self.after = getattr(self, "after", b"") + rest[:8]

    def record(self) -> dict:
        head, http = self.head or {"": ""}, self.http or {}
        kind = head.get("warc-type", "")
        named = head.get("warc-payload-digest", "").removeprefix("sha256:")
        problem = self.problem
        if self.head is None or self.left or getattr(self, "after", b"") != b"\r\n\r\n":
            problem = problem or "bad length"
        elif head.get("warc-block-digest", "") != f"sha256:{self.block_hash.hexdigest()}":
            problem = problem or "bad block digest"
        digest, size = self.payload_hash.hexdigest(), self.size
        if kind == "revisit":  # the payload stands elsewhere; the HTTP header keeps its length
            digest, size = named, int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        elif digest != named:
            problem = problem or "bad payload digest"
        bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
        return {"record_id": bare(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": bare(head.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "problem": problem, "payload": b"".join(self.payload) if self.with_payload and kind != "revisit" else None}


def read_records(read: Callable[[int], bytes], with_payload: bool = True) -> Iterator[dict]:
    """The records of one archive, in order; ``read`` gives the next bytes. A damaged member is a row with its problem and ends the archive."""
    data = read(STEP)
    while data:
        inflate, framer = zlib.decompressobj(31), _Framer(with_payload)
        try:
            while True:
                framer.feed(inflate.decompress(data, STEP))
                if inflate.eof:
                    data = inflate.unused_data or read(STEP)
                    break
                data = inflate.unconsumed_tail or read(STEP)
                if not data:
                    framer.problem = "cut short"
                    break
        except zlib.error:
            framer.problem = "not gzip"
            data = b""
        yield framer.record()


def _writer(folder: str, schema: pa.Schema):
    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        name, stream, records = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            ids, urls, refers, digests = (batch.column(i).to_pylist() for i in range(4))
            for a, b, data, offsets in byte_blocks(batch.column(4), lower=False):
                if stream is None:
                    system.create_dir(path, recursive=True)
                    stream = system.open_output_stream(name)
                for i in range(a, b):
                    payload = data[offsets[i - a] : offsets[i - a + 1]].tobytes()
                    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
                    stream.write(squeeze.compress(make_record(ids[i], urls[i], payload, refers[i], digests[i])) + squeeze.flush())
                    records += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records])], schema=schema)

    return run


def _reader(folder: str, with_payload: bool, schema: pa.Schema):
    def run(batches):
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with system.open_input_stream(name) as stream:
                    for record in read_records(stream.read, with_payload):
                        held.append(record)
                        size += 1000 + len(record["payload"] or b"")
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes every row as a record; returns (path, records) of the archives.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the
    least id are responses, others revisit it (rows that repeat the least id are
    all responses; rows with a null id revisit unless no row has an id).  Null
    html is the empty payload; a null url is left out of its record; a null id
    is an empty record id.  Other columns play no part.
    """
    store.ship(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit(""))
    keyed = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("n"))
    first = keyed.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1 AND first IS NOT NULL")
    first = store.publish(first.select("digest", "first"), "repeated")
    if first.count() <= BROADCAST_DIGESTS:  # pages stay where they are
        dealt = keyed.join(F.broadcast(first), "digest", "left")
    else:
        salted = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    rows = dealt.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", refers.alias("refers"), "digest", "html")
    schema = T.StructType().add("path", T.StringType()).add("records", T.LongType())
    return store.publish(rows.mapInArrow(tidy(_writer(folder, to_arrow_schema(schema))), schema), "archives")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives, one row each; ``problem`` is null where framing and digests hold."""
    store.ship(archives.sparkSession)
    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInArrow(tidy(_reader(folder, with_payload, to_arrow_schema(RECORD))), RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = store.fresh_path(spark, "warc")
    records = read_archives(write_archives(pages, folder), folder, with_payload=False)
    kind = pages.schema["page_id"].dataType
    good = F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("record "), F.coalesce("record_id", F.lit("?")), F.lit(": "), F.col("problem"))))
    return records.select(F.when(F.col("record_id") != "", F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", good.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


_SQL = f"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS g FROM pages),
r AS (SELECT g, min(page_id) AS m FROM d WHERE n >= {LEAST_REVISIT} GROUP BY g)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN m IS NULL OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM d LEFT JOIN r USING (g)"""

QUERIES = {"op9_warc": query}
ORACLES = {"op9_warc": _SQL}
