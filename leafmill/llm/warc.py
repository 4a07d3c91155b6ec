"""WARC archives as a Spark data source, written and read by Python tasks.

Reading: ``partitions`` plans the archive files, small ones together; ``pushFilters`` takes over predicates on fields
of the record header. A task parses each record's header first, tests the predicates, and seeks over the block of a
record that fails, or whose payload the schema does not ask for. Compressed archives are one gzip member a record; the
writer notes a member's size in its header, so that the reader seeks to the next member and inflates no unwanted payload
(members without a note are inflated to be skipped). Writing: each task writes its rows to archives of bounded size in a
staging folder, and the commit moves them into place.

``register(spark)`` makes the format known as "warc". Columns: record_id, record_type, target_uri, date,
payload_digest, refers_to (string), payload_bytes (long: of the full payload; for revisits as their HTTP header tells,
null where it doesn't), payload (binary; null for revisits). A read may name any of these with ``.schema(...)``. What is no
record, or is cut off, ends the job; with the option ``damaged`` set to ``count`` it becomes a row of record_type
"damaged", and reading goes on at the next record.
"""

from __future__ import annotations

import base64
import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from leafmill.llm._shared import new_folder

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
FILE_BYTES = 256 << 20  #: an archive is closed once it is this large
PARTITION_BYTES = 64 << 20  #: files are read together up to this size
CHUNK = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def _store(path: str):
    """(pyarrow file system, path in it); plain paths and file: URIs are local."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---------------------------------------------------------------------------------------------- reading


@dataclass
class Archives(InputPartition):
    files: tuple[str, ...] = ()

    def __post_init__(self):
        super().__init__(self.files)


def _test(f: Filter):
    """(column, function of its value) of a filter on one column, or None where it isn't understood."""
    if isinstance(f, Not):
        inner = _test(f.child)
        # Three-valued: null stays null, which a filter rejects.
        return inner and (inner[0], lambda v, t=inner[1]: None if (r := t(v)) is None else not r)
    column = f.attribute[0] if len(f.attribute) == 1 else None
    if column is None:
        return None
    if isinstance(f, IsNull):
        return column, lambda v: v is None
    if isinstance(f, IsNotNull):
        return column, lambda v: v is not None
    want = f.value
    if isinstance(f, EqualNullSafe):
        return column, lambda v: v == want
    plain = {
        EqualTo: lambda v: v == want,
        In: lambda v: v in want,
        GreaterThan: lambda v: v > want,
        GreaterThanOrEqual: lambda v: v >= want,
        LessThan: lambda v: v < want,
        LessThanOrEqual: lambda v: v <= want,
        StringStartsWith: lambda v: v.startswith(want),
        StringEndsWith: lambda v: v.endswith(want),
        StringContains: lambda v: want in v,
    }.get(type(f))
    if plain is None or want is None or isinstance(f, In) and None in want:
        return None
    return column, lambda v: None if v is None else plain(v)


def _header(stream) -> dict[str, str]:
    """Fields up to the blank line, names lower-cased; folded lines are joined."""
    out: dict[str, str] = {}
    last = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a WARC header is cut off")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _skip(stream, n: int) -> None:
    if stream.seekable() and not isinstance(stream, gzip.GzipFile):
        stream.seek(n, io.SEEK_CUR)
        return
    while n > 0:
        if not (got := stream.read(min(n, CHUNK))):
            raise ValueError("a WARC record is cut off")
        n -= len(got)


#: Of the gzip header that the writer makes: magic, deflate, extra field; then the field's name and length.
_MEMBER = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 20) + b"SL" + struct.pack("<H", 16)
#: Bytes of a member beside its deflated ones: header, two sizes, checksum and length.
_AROUND = len(_MEMBER) + 16 + 8


def member(record: bytes) -> bytes:
    """A gzip member of one record, with its own size and the record's in the extra field."""
    deflate = zlib.compressobj(4, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(record) + deflate.flush()
    return _MEMBER + struct.pack("<QQ", _AROUND + len(body), len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Window(io.RawIOBase):
    """The next ``left`` bytes of a stream."""

    def __init__(self, raw, left: int):
        self.raw, self.left = raw, left

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.raw.read(min(len(into), self.left))
        into[: len(got)] = got
        self.left -= len(got)
        return len(got)


def _members(raw) -> Iterator[tuple[object, bool]]:
    """(stream, whether it holds one record) of the members of known size, and of all the rest from the first other one.

    A size is believed that is no smaller than an empty member, stays within the file and leads to its end or to another
    member; from a member with any other size on, the file is read in one stream.
    """
    at, end = 0, raw.seek(0, io.SEEK_END)
    while at < end:
        raw.seek(at)
        head = raw.read(len(_MEMBER) + 16)
        size = struct.unpack_from("<Q", head, len(_MEMBER))[0] if head.startswith(_MEMBER) and len(head) == len(_MEMBER) + 16 else 0
        known = _AROUND <= size <= end - at
        if known and size < end - at:
            raw.seek(at + size)
            known = raw.read(3) == _MEMBER[:3]
        raw.seek(at)
        if not known:
            yield gzip.GzipFile(fileobj=raw), False
            return
        yield gzip.GzipFile(fileobj=_Window(raw, size)), True
        at += size


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], count_damaged: bool = False):
        self.path, self.columns, self.count_damaged = path, columns, count_damaged
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            test = _test(f)
            if test and test[0] in FIELDS:
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        store, path = _store(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and "/_staging" not in x.path)
        out: list[Archives] = []
        group: list[str] = []
        size = 0
        for name, n in files:
            if group and size + n > PARTITION_BYTES:
                out.append(Archives(tuple(group)))
                group, size = [], 0
            group.append(name)
            size += n
        return [*out, *([Archives(tuple(group))] if group else [])] or [Archives()]

    def read(self, partition: Archives) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for name in partition.files:
            with store.open_input_file(name) as raw:
                if name.endswith(".gz"):
                    for stream, one in _members(io.BufferedReader(raw, CHUNK)):
                        yield from self.records(stream, one)
                else:
                    yield from self.records(io.BufferedReader(raw, CHUNK), False)

    def records(self, stream, one: bool = False) -> Iterator[tuple]:
        """Rows of the records in a stream, or of the ``one`` at its start."""
        lost = False
        while True:
            try:
                line = stream.readline()
                if not line:
                    return
                if not line.strip() or lost and not line.startswith(b"WARC/"):
                    continue
                lost = False
                row = self.record(line, stream, one)
            except (ValueError, EOFError, OSError, zlib.error) as error:
                if not self.count_damaged:
                    raise ValueError(f"damaged archive: {error}") from error
                if all(test({"record_type": "damaged"}.get(c)) for c, test in self.tests):
                    yield tuple("damaged" if c == "record_type" else None for c in self.columns)
                if not isinstance(error, ValueError) or one:
                    return
                lost = True
                continue
            if row is not None:
                yield row
            if one:
                return

    def record(self, line: bytes, stream, one: bool) -> tuple | None:
        """The row of the record that starts with ``line``, or None where a predicate fails."""
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _header(stream)
        length = int(head.get("content-length", 0))
        row = {c: head.get(field) for c, field in FIELDS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
        wanted = all(test(row[c]) for c, test in self.tests)
        if wanted and {"payload", "payload_bytes"} & set(self.columns):
            length -= self.block(stream, head, length, row)
        if not one:
            _skip(stream, length)
        return tuple(row.get(c) for c in self.columns) if wanted else None

    def block(self, stream, head: dict[str, str], length: int, row: dict) -> int:
        """Reads what is wanted of a record's block; bytes read."""
        used, told = 0, None
        if head.get("content-type", "").startswith("application/http"):
            while used < length and (line := stream.readline(length - used)):
                used += len(line)
                if line in (b"\r\n", b"\n"):
                    break
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    told = int(value)
        revisit = row["record_type"] == "revisit"
        row["payload_bytes"] = told if revisit else length - used
        if "payload" in self.columns and not revisit:
            row["payload"] = stream.read(length - used)
            if len(row["payload"]) < length - used:
                raise ValueError("a WARC record is cut off")
            used = length
        return used


# ---------------------------------------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...] = ()


def _field(value) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(c if ord(c) >= 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in str(value))


def record(row: dict) -> bytes:
    """The bytes of one response or revisit record."""
    kind = row.get("record_type") or "response"
    payload = row.get("payload") or b""
    size = row.get("payload_bytes")
    size = len(payload) if size is None else size
    head = [("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z"), ("WARC-Target-URI", row.get("target_uri"))]
    digest = row.get("payload_digest")
    if digest:
        head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row.get("refers_to"))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if kind == "revisit" else payload)
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {_field(v)}\r\n" for k, v in head if v is not None)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _info() -> bytes:
    body = b"software: leafmill\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return VERSION + b"\r\n" + head.encode() + body + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], compress: bool, overwrite: bool):
        self.path, self.columns, self.compress, self.overwrite = path, columns, compress, overwrite
        self.job = uuid.uuid4().hex

    def _open(self, store, root: str):
        name = f"{root}/_staging-{self.job}/archive-{uuid.uuid4().hex}.warc" + ".gz" * self.compress
        store.create_dir(name.rpartition("/")[0], recursive=True)
        return name, store.open_output_stream(name, compression=None)

    def write(self, iterator) -> Written:
        store, root = _store(self.path)
        pack = member if self.compress else (lambda b: b)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, out = self._open(store, root)
                        names.append(name)
                        out.write(pack(_info()))
                        size = 0
                    raw = pack(record(row))  # one member a record, so that archives can be read from any record on
                    out.write(raw)
                    size += len(raw)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        files = [f for m in messages if m for f in m.files]
        if self.overwrite:
            from pyarrow import fs

            for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")):
                    store.delete_file(x.path)
        store.create_dir(root, recursive=True)
        for f in files:
            store.move(f, f"{root}/{f.rpartition('/')[2]}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        staging = f"{root}/_staging-{self.job}"
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class WarcDataSource(DataSource):
    """Options: path; compression (gzip, the default, or none) of writes; damaged (fail, the default, or count) of reads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames(), self.options.get("damaged", "fail") == "count")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.fieldNames(), self.options.get("compression", "gzip") == "gzip", overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format "warc" known in this session and lets it take over filters."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---------------------------------------------------------------------------------------------- pages to archives


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: four groups of ten digits, 40 bits each, in built-in functions."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def group(i: int) -> list[Column]:
        bits = F.conv(F.substring(digest, 10 * i + 1, 10), 16, 10).cast("long")
        return [F.substring(alphabet, (F.shiftright(bits, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for j in range(8)]

    return F.concat(*[c for i in range(4) for c in group(i)])


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, revisit_bytes: int = 0) -> DataFrame:
    """A record a page, in the columns of the format: of equal payloads the smallest id's is the response.

    Payloads of fewer than ``revisit_bytes`` bytes are all responses. A null html is an empty payload, a null url no
    target. Rows that repeat the smallest id are responses too; rows with a null id are responses. Other columns are
    not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("target_uri"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    # Which rows revisit which: on ids and digests alone, so that payloads are dealt by id and no copy is hot.
    keys = rows.filter(F.col("id").isNotNull() & (F.col("payload_bytes") >= revisit_bytes)).select("id", "digest")
    first = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("_d"), "first")
    again = keys.join(first, F.col("digest") == F.col("_d")).filter("id <> first").select(F.col("id").alias("_id"), "_d", "first").distinct()
    met = rows.join(again, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_d")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("first").isNotNull()
    return met.select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        base32_of_hex(F.col("digest")).alias("payload_digest"),
        urn(F.col("first")).alias("refers_to"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_id_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    register(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_folder(spark, "warc")
    page_records(pages).write.format("warc").option("path", path).mode("append").save()
    fields = "record_id string, record_type string, payload_digest string, refers_to string, payload_bytes long"
    back = spark.read.format("warc").schema(fields).option("path", path).load().filter(F.col("record_type").isin("response", "revisit"))
    return back.select(page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id_of(F.col("refers_to")).alias("refers_to"))


#: SHA-1 is not a DuckDB function on blobs in every version; sha1(text) takes the UTF-8 bytes of the html.
_BITS = ", ".join(f"((CAST('0x' || substring(h, {10 * i + 1}, 10) AS BIGINT) >> {35 - 5 * j}) & 31)" for i in range(4) for j in range(8))
OP6_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h, list_aggregate(list_transform([{_BITS}], lambda b: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(b + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
