"""WARC archives: a writer and a sequential reader (operator 8).

Archives hold one gzip member for each record.  The reader inflates them piece by
piece, frames each record's block by its content length and verifies the block and
payload digests.  Archives lie in the shared folder; a task writes under a
temporary name and moves the file when it is complete, and only the files that
successful tasks report are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .skew import attach

DATE = "1970-01-01T00:00:00Z"  # the table has no times; fixed, so that archives are reproducible
PIECE = 1 << 16
ROLL = 64 << 20
MAX_HEADER = 1 << 20


class WarcError(ValueError):
    """A broken archive: framing, compression, length or digest."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    """A header value without line breaks."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record, not compressed.  A revisit's block is the HTTP header alone."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Block-Digest: sha1:{digest_of(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"not a header line: {line[:80]!r}")
        out[name.decode("ascii", "replace").strip().lower()] = value.decode("utf-8", "surrogatepass").strip()
    return out


def _verify(head: dict[str, str], kind: str, data: bytes) -> None:
    """Compare a digest of the header with the data's; those of other algorithms than SHA-1 can't be."""
    algorithm, _, value = head.get(f"warc-{kind}-digest", "").partition(":")
    if algorithm.lower() == "sha1" and value.upper() != digest_of(data):
        raise WarcError(f"{kind} digest differs in {head.get('warc-record-id')}")


def read_records(stream, verify: bool = True, most_header: int = MAX_HEADER):
    """``(headers, payload)`` of each record of a stream with ``read(n)``, one member at a time.

    Records of every type are read.  The payload is what follows the HTTP header where
    the block holds HTTP, else the block; ``payload-length`` in the headers is the
    length that the HTTP header names (of a revisit's payload, which isn't there), else
    that of the payload.  A header longer than ``most_header`` counts as damage.
    """
    rest = b""
    while True:
        if not rest:
            rest = stream.read(PIECE)
            if not rest:
                return
        z, buffer, head, need = zlib.decompressobj(31), bytearray(), None, None
        while not z.eof:
            if not rest:
                rest = stream.read(PIECE)
                if not rest:
                    raise WarcError("the archive ends within a record")
            try:
                buffer += z.decompress(rest)
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            rest = z.unused_data if z.eof else b""
            if head is None:
                if (at := buffer.find(b"\r\n\r\n")) >= 0:
                    if not buffer.startswith(b"WARC/"):
                        raise WarcError("no WARC version line")
                    head = _headers(bytes(buffer[:at]))
                    del buffer[: at + 4]
                    if not head.get("content-length", "").isdigit():
                        raise WarcError("no content length")
                    need = int(head["content-length"])
                elif len(buffer) > most_header:
                    raise WarcError("header too long")
        if head is None or len(buffer) != need + 4 or buffer[need:] != b"\r\n\r\n":
            raise WarcError("the block doesn't have its content length")
        kind, payload, named = head.get("warc-type"), bytes(buffer[:need]), None
        if not kind:
            raise WarcError("no record type")
        if verify:
            _verify(head, "block", payload)
        if head.get("content-type", "").lower().startswith("application/http"):
            at = payload.find(b"\r\n\r\n")
            if at < 0:
                raise WarcError("no HTTP header")
            http, payload = _headers(payload[:at]), payload[at + 4 :]
            named = http.get("content-length")
        whole = kind != "revisit" and "warc-truncated" not in head
        if verify and whole:
            _verify(head, "payload", payload)
        if whole and named is not None and "x-page-id" in head and int(named) != len(payload):
            raise WarcError("payload length differs")
        head["payload-length"] = named if named is not None and not whole else str(len(payload))
        yield head, payload


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0, level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record below ``folder`` (a URI that all executors reach).

    Returns the archives: ``path``, ``records``, ``bytes``, ``header`` (length of the
    longest record header).  Of payloads that are
    equal and at least ``least_revisit`` bytes long, the one with the largest id is
    a response and the others revisit it; rows that repeat that id with the same
    payload are responses too.  Null payloads are empty.  A row without an id
    never is referred to, and is a response if no equal payload has an id.  Urls and
    payloads may have any length.  Payloads are equal if their SHA-256 and lengths are.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    rows = rows.withColumns({"_sha": F.unhex(F.sha2("_html", 256)), "_bytes": F.octet_length("_html")})
    # one row for each payload that occurs more than once, summed before the shuffle
    same = rows.filter(F.col("_bytes") >= least_revisit).groupBy("_sha", "_bytes").agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same = scratch.stash(same, "same")
    typed = attach(rows, same, ["_sha", "_bytes"], "_n", pages.count(), F.struct("_id", "_url")).withColumn("_refers", F.when(F.col("_top").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_top")), F.col("_top")))

    def write(frames):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, name, done = None, "", []

        def close():
            out.close()
            store.move(f"{base}/.{name}", f"{base}/{name}")

        for f in frames:  # Arrow batches: pandas would round ids beside nulls
            for key, url, html, refers in zip(*(f.column(c).to_pylist() for c in ("_id", "_url", "_html", "_refers")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/.{name}", compression=None)
                    done.append([f"{folder}/{name}", 0, 0, 0])
                revisit = refers is not None
                data = record(key, url, html.encode("utf-8", "surrogatepass"), refers, revisit)
                done[-1][3] = max(done[-1][3], data.find(b"\r\n\r\n") + 4)
                data = member(data, level)
                out.write(data)
                done[-1][1] += 1
                done[-1][2] += len(data)
                if done[-1][2] >= ROLL:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes", "header"), d, strict=True)) for d in done])

    slim = typed.select("_id", "_url", "_html", "_refers")
    return slim.mapInArrow(write, "path string, records long, bytes long, header long")


def _store(uri: str):
    """The Arrow file system of a URI and the path in it; Hadoop's names of S3 are known too."""
    from pyarrow import fs

    for name in ("s3a://", "s3n://"):
        if uri.startswith(name):
            uri = "s3://" + uri[len(name) :]
    return fs.FileSystem.from_uri(uri)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in ``path``, each archive read in sequence by one task.

    ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``, and ``payload`` (null for revisits) if asked for.  ``header``, if
    there, is the longest record header to expect.  Records of other writers have a null
    page id; of those without a payload digest it is computed.  A damaged archive
    raises :class:`WarcError`.
    """

    def read(frames):
        for f in frames:
            for path, longest in zip(f.column("path").to_pylist(), f.column("header").to_pylist(), strict=True):
                store, place = _store(path)
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for head, payload in read_records(stream, most_header=max(longest or 0, MAX_HEADER)):
                        revisit = head["warc-type"] == "revisit"
                        digest = head.get("warc-payload-digest", "").rpartition(":")[2] or (None if revisit else digest_of(payload))
                        number = lambda k, head=head: int(head[k]) if k in head else None
                        rows.append((number("x-page-id"), head.get("warc-target-uri"), number("payload-length"), digest, head["warc-type"], number("x-refers-to-page-id"), payload if payloads and not revisit else None))
                        held += len(payload) * payloads
                        if len(rows) >= 5000 or held > 32 << 20:
                            yield _frame(rows, payloads)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, payloads)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    # a task for each archive: the paths are few bytes, so they would else be read by one task
    longest = F.col("header") if "header" in archives.columns else F.lit(None)
    return archives.select("path", longest.cast("long").alias("header")).repartition(max(1, archives.count())).mapInArrow(read, schema)


def broken_revisits(records: DataFrame) -> DataFrame:
    """The revisits of ``records`` (as :func:`read_archives` gives them) to which no response with the same digest and length belongs."""
    key = ["refers_to", "payload_digest", "payload_bytes"]
    held = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *key[1:]).distinct()
    # a payload may have any number of revisits: those of the same one are summed up before they meet its response
    wanted = records.filter("record_type = 'revisit'").groupBy(*key).agg(F.count(F.lit(1)).alias("revisits"))
    return wanted.join(held, key, "left_anti")


def _frame(rows: list, payloads: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    columns = {k: pa.array(v, t) for (k, t), v in zip(kinds.items(), zip(*rows, strict=True), strict=True)}
    if not payloads:
        del columns["payload"]
    return pa.RecordBatch.from_pydict(columns)


def round_trip(pages: DataFrame, least_revisit: int = 0, **columns) -> DataFrame:
    """Write the pages to new archives in the shared folder and read them back, without payloads.

    An empty table gives no archive and an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    archives = scratch.stash(write_archives(pages, scratch.new_path(spark, "warc"), least_revisit, **columns), "archives")
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT), 1), '' ORDER BY i)
        FROM range(32) t(i)) AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""
