"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own.  The reader cuts archives into byte ranges; the task of a range
looks for the gzip magic, takes a candidate whose first bytes decode to a WARC header as a record, and owns the
records that start in its range.  A record that is damaged, cut off, or followed by anything but another member,
zero bytes and the end of the file is an error, or a row with one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, shared_path

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record(id_: object, url: str | None, payload: bytes, digest: str, refers_to: object | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the record with the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if id_ is not None:
        head.append(f"WARC-Record-ID: <urn:page:{id_}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, level: int = 4, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes an archive per task into ``folder`` and returns (file, records, bytes).

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is
    a response and the others are revisits. Null payloads are empty. A row without an id is a revisit, too, unless
    all rows with its payload have none; rows that repeat the smallest id are all responses. A file gets
    its name when it is complete, so a task that runs again replaces its own file.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha", F.octet_length("payload").alias("size")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("_sha"), "size", "first")
    d = rows.join(first, (F.col("sha") == F.col("_sha")) & (F.octet_length("payload") == F.col("size")), "left")
    d = d.select("id", "url", "payload", "sha", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to"))
    system, path = _open(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, path = _open(folder)
        name, n, size = f"part-{task.partitionId():05d}.warc.gz", 0, 0
        out = None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(f"{path}/_{name}-{task.taskAttemptId()}")
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(r["id"], r["url"], r["payload"], digest, r["refers_to"], date)) + z.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            system.move(f"{path}/_{name}-{task.taskAttemptId()}", f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return materialize(d.mapInArrow(run, "file string, records long, bytes long"), "warc-files")


class Damaged(ValueError):
    """Bytes of an archive that should be a record, and aren't."""


class _Ahead:
    """Reads of a file at any place, by blocks: small ones behind each other cost one request."""

    def __init__(self, f, length: int, block: int = 1 << 20):
        self.f, self.length, self.block, self.at, self.data = f, length, block, 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        n = max(min(n, self.length - at), 0)
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.at, self.data = at, self.f.read_at(min(max(n, self.block), self.length - at), at)
        return self.data[at - self.at : at - self.at + n]


#: So much of a candidate is decoded to tell a record from chance bytes: a record's header begins with this.
HEAD = b"WARC/"


def _starts_record(f, at: int, length: int) -> bool:
    """Whether a member starts at ``at`` whose first bytes are a WARC header's."""
    if at + 18 > length:
        return False
    z, got, end = zlib.decompressobj(31), b"", at
    try:
        while len(got) < len(HEAD) and end < length and not z.eof:
            data = f.read_at(min(1 << 10, length - end), end)
            end += len(data)
            got += z.decompress(data, len(HEAD) - len(got))
    except zlib.error:
        return False
    return got == HEAD


def _member(f, start: int, length: int) -> tuple[bytes, int]:
    """The decoded record that starts at ``start``, and its member's end."""
    z, at, got, step = zlib.decompressobj(31), start, [], 1 << 12
    try:
        while not z.eof:
            data = f.read_at(min(step, length - at), at) if at < length else b""
            if not data:
                raise Damaged(f"the file ends inside the record at byte {start}")
            got.append(z.decompress(data))
            at += len(data)
            step = min(4 * step, 1 << 20)
    except zlib.error as e:
        raise Damaged(f"the record at byte {start} can't be decoded: {e}") from e
    return b"".join(got), at - len(z.unused_data)


def _find(f, at: int, end: int, length: int) -> tuple[int, int]:
    """The next record's start from ``at`` on, if it is before ``end``, else ``end``; and how many bytes other than zero were passed."""
    passed, size = 0, 1 << 10
    while at < end:
        window = f.read_at(size, at)
        size = min(4 * size, 1 << 20)
        i = window.find(MAGIC)
        if 0 <= i and at + i < end and _starts_record(f, at + i, length):
            return at + i, passed + i - window.count(0, 0, i)
        step = i + 1 if i >= 0 else max(len(window) - 2, 1)
        step = min(step, end - at)
        passed += step - window.count(0, 0, step)
        at += step
    return end, passed


def members(f, start: int, end: int, length: int) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, None) of the records whose members start in [start, end); (offset, None, error) where one is damaged.

    What stands before the first record of a range belongs to the range before: between the records that a range owns and
    up to the next one nothing but zero bytes may stand.
    """
    if start == 0:
        at, passed = _find(f, 0, length, length)
        if passed or at == length:
            yield 0, None, "no record at the begin of the file"
    else:
        at, _ = _find(f, start, end, length)
    while at < end:
        try:
            raw, after = _member(f, at, length)
            yield at, raw, None
        except Damaged as e:
            yield at, None, str(e)
            after = at + 1  # the damage is told; what follows is looked for behind its magic
            at, _ = _find(f, after, length, length)
            continue
        at, passed = _find(f, after, length, length)
        if passed:
            yield after, None, f"{passed} bytes that are no record behind byte {after}"


def parse(raw: bytes) -> dict:
    """The fields of a record; one that contradicts itself (lengths, digest) or lacks a field is damaged."""
    try:
        return _parse(raw)
    except (KeyError, StopIteration, UnicodeDecodeError, IndexError, ValueError) as e:
        raise Damaged(f"the record is not as its header says: {e!r}") from e


def _fields(head: bytes) -> dict[str, str]:
    """The fields of a header behind its first line, by small name; the first of those that repeat."""
    out: dict[str, str] = {}
    for line in head.decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _unchunked(body: bytes) -> bytes | None:
    """A chunked body's bytes; none if it isn't one: archives often keep the bare bytes below such a header."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + n]
        if len(chunk) < n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(chunk)
        at = end + 4 + n
    return None


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("the block is shorter than its length")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    digest = digest.removeprefix("sha1:") if digest.startswith("sha1:") else None  # others are not told
    body, size = block, None
    if fields.get("content-type", "application/http" if block.startswith(b"HTTP/") else "").lower().startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        said = _fields(b"\r\n" + http.partition(b"\r\n")[2])
        chunked = said.get("transfer-encoding", "").lower() == "chunked"
        size = int(said["content-length"]) if "content-length" in said and not chunked else None
        if kind == "response":
            plain = _unchunked(body) if chunked else None
            # the digest is of the payload or, with many writers, of the chunks
            right = digest is None or digest in (_sha1(body), plain is not None and _sha1(plain))
            whole = size is None or len(body) == size
            if "warc-truncated" not in fields and not (right and whole):
                raise ValueError(f"length or digest of {fields.get('warc-record-id')}")
            body = body if plain is None else plain
    elif digest is not None and kind != "revisit" and "warc-truncated" not in fields and digest != _sha1(block):
        raise ValueError(f"digest of {fields.get('warc-record-id')}")
    if kind != "revisit":
        size, digest = len(body), _sha1(body)
    bare = lambda x: None if x is None else x.removeprefix("<").removesuffix(">").removeprefix("urn:page:")
    return {"record_id": bare(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": bare(fields.get("warc-refers-to")), "payload": None if kind == "revisit" else body}


def read(spark: SparkSession, folder: str, split_bytes: int = 16 << 20, payloads: bool = True, most_tasks: int = 20_000, errors: str = "raise", written: DataFrame | None = None) -> DataFrame:
    """Records of all archives in ``folder``: record_id, target_uri, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits).

    Records of every type are rows. A response's payload is its HTTP body, without the chunks of a chunked one and as long as it is where HTTP tells
    no length; that of other records (warcinfo, request, metadata, conversion, ...) their block, or what follows the HTTP header in it. payload_bytes and
    payload_digest are of the full payload; of a revisit, what its headers say or null. A record that says it is truncated isn't held against its
    lengths and digests. ``written`` is what ``write`` returned: a file that is missing or of another length, as one that was cut between two records, is an error, too.
    No record is passed over: one that is cut off, doesn't decode, or
    isn't as its header says, and bytes that belong to no record (zero bytes as padding may) are an error that names file and offset;
    with ``errors="rows"`` they are rows with an ``error`` and nulls, and reading goes on at the next record. An empty folder gives no rows,
    a file of no bytes none.
    """
    schema = "record_id string, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    said = None
    if written is not None:
        of = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(written.select("file", "bytes"), "file", "right")
        said = of.where("NOT length <=> bytes").select(F.concat_ws("", F.lit(f"{folder}/"), "file", F.lit(", byte "), F.coalesce("length", F.lit(0)).cast("string"), F.lit(": the file should have "), F.col("bytes").cast("string"), F.lit(" bytes")).alias("error"))
        if errors == "raise" and (bad := said.first()):
            raise Damaged(bad["error"])
    files = files.where("length > 0")
    splits = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, "length"))
    # rows are tiny, what they stand for is not: a number of partitions keeps them from being coalesced
    splits = splits.repartition(max(1, min(splits.count(), most_tasks)), "path", "start")
    arrow = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                system, path = _open(s["path"])
                with system.open_input_file(path) as opened:
                    f = _Ahead(opened, s["length"])
                    rows, size = [], 0
                    for at, raw, error in members(f, s["start"], s["end"], s["length"]):
                        try:
                            if error:
                                raise Damaged(error)
                            rows.append({"error": None} | parse(raw))
                        except Damaged as e:
                            said = f"{s['path']}, byte {at}: {e}"
                            if errors == "raise":
                                raise Damaged(said) from e
                            rows.append(dict.fromkeys(names) | {"error": said})
                        if not payloads:
                            rows[-1]["payload"] = None
                        size += len(raw or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, arrow)

    out = splits.mapInArrow(run, schema)
    if said is not None and errors == "rows":
        out = out.unionByName(said, allowMissingColumns=True)
    return out if errors == "rows" else out.drop("error")


def round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = True, split_bytes: int = 16 << 20, **how) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back, after holding the files' lengths against those written."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    written = write(pages, folder, **how)
    return read(pages.sparkSession, folder, split_bytes, payloads, written=written)
