"""WARC archives: a Python data source that writes and reads them, each record a gzip member of its own.

The reader plans one partition per file, takes record-type and header predicates as pushed filters, and parses
headers first. A member says its length in an extra field of its gzip header (the `sl` field of the WARC specification), so
payloads that the query does not want are stepped over and not inflated. Plain files and gzip files without that field are read too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import join_classes, materialize, new_path, small_batches, table

END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "WARC-Payload-Length"}
SCHEMA = "record_type string, record_id string, uri string, digest string, refers_to string, payload_length long, payload binary"
#: A task's file is closed, and another begun, beyond so many bytes.
FILE_BYTES = 1 << 30
LEVEL = 4
#: Compressed bytes of a member that are inflated in search of the end of its headers, at a time.
PEEK = 2048


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def sha1_base32(column):
    """The bare upper-case base32 SHA-1 of a binary column."""

    @F.pandas_udf("string")
    def digest(payloads: pd.Series) -> pd.Series:
        return pd.Series([base32_sha1(x) for x in payloads], dtype=object)

    return digest(column)


def gzip_member(data: bytes) -> bytes:
    """One gzip member whose extra field `sl` holds its own length and that of the data (zeros, that is unknown, from 4 GiB on)."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 24 + len(body) + 8
    sizes = (length, len(data)) if max(length, len(data)) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *sizes) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, digest: str, size: int, refers_to: str | None, payload: bytes | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload or b'')}"]
    return gzip_member("\r\n".join(lines).encode("utf-8", "surrogatepass") + END + (payload or b"") + END)


class File(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


def filesystem(path: str):
    """A pyarrow filesystem and the path in it; URIs as pyarrow knows them (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not the start of a WARC record")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def fits(headers: dict[str, str], wanted: dict[str, set]) -> bool:
    return all(headers.get(HEADERS[c].lower()) in values for c, values in wanted.items())


def plain_records(f, wanted: dict[str, set], payloads: bool):
    """Headers and payloads of the records of an open plain file; the payload is None where it was stepped over."""
    while line := f.readline():
        if not line.strip():
            continue
        head = [line]
        while (line := f.readline()).strip():
            head.append(line)
        headers = headers_of(b"\r\n".join(x.rstrip(b"\r\n") for x in head))
        size, fit = int(headers.get("content-length", 0)), fits(headers, wanted)
        if fit and payloads:
            data = f.read(size)
            if len(data) < size:
                raise ValueError("a WARC record breaks off")
            yield headers, data
        else:
            f.seek(size, io.SEEK_CUR)
            if fit:
                yield headers, None


def member_length(f) -> int | None:
    """The length that the extra field of the member here states; None without one. The place in the file stays."""
    start = f.tell()
    head = f.read(12)
    length = None
    if len(head) == 12 and head[:2] == b"\x1f\x8b" and head[3] & 4:
        extra, at = f.read(int.from_bytes(head[10:12], "little")), 0
        while at + 4 <= len(extra):
            name, size = extra[at : at + 2], int.from_bytes(extra[at + 2 : at + 4], "little")
            if name == b"sl" and size == 8:
                length = int.from_bytes(extra[at + 4 : at + 8], "little") or None
            at += 4 + size
    f.seek(start)
    return length


def records(f, wanted: dict[str, set], payloads: bool):
    """Headers and payloads of the records of an open file, plain or gzip."""
    while True:
        start = f.tell()
        magic = f.read(2)
        f.seek(start)
        if not magic:
            return
        length = member_length(f) if magic == b"\x1f\x8b" else None
        if length is None:
            yield from plain_records(gzip.GzipFile(fileobj=f) if magic == b"\x1f\x8b" else f, wanted, payloads)
            return
        inflate, text, left = zlib.decompressobj(31), b"", length
        while END not in text:
            part = f.read(min(PEEK, left))
            if not part:
                raise ValueError("a WARC record breaks off")
            left -= len(part)
            text += inflate.decompress(part)
        head, _, data = text.partition(END)
        headers = headers_of(head)
        if fits(headers, wanted):
            if payloads:
                rest = f.read(left)
                data += inflate.decompress(rest) + inflate.flush()
                size = int(headers.get("content-length", 0))
                if len(rest) < left or len(data) < size or not inflate.eof:
                    raise ValueError("a WARC record breaks off")
                yield headers, data[:size]
            else:
                yield headers, None
        f.seek(start + length)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.names = options["path"], [x.name for x in schema.fields]
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS and name != "payload_length":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        hidden = lambda x: any(part.startswith(("_", ".")) for part in x.path[len(root) :].split("/"))
        files = [File(x.path, x.size) for x in found if x.is_file and x.size and not hidden(x)]
        return sorted(files, key=lambda x: -x.size) or [File("", 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = filesystem(self.path)
        names = {c: h.lower() for c, h in HEADERS.items()}
        types = {"payload": pa.binary(), "payload_length": pa.int64()}
        schema = pa.schema([(c, types.get(c, pa.string())) for c in self.names])
        rows, held = [], 0
        with system.open_input_file(partition.path) as raw, io.BufferedReader(raw, 1 << 20) as f:
            for headers, data in records(f, self.wanted, self.payloads):
                row = {c: headers.get(h) for c, h in names.items()} | {"payload": data}
                row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
                rows.append({c: row[c] for c in self.names})
                held += len(data or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Writes the column `record` (whole gzip members). Each attempt of a task has files of its own in _temporary; the commit moves those that count."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        system, root = filesystem(self.path)
        system.create_dir(f"{root}/_temporary", recursive=True)
        names, out = [], None
        for batch in iterator:
            for data in batch.column("record"):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = system.open_output_stream(f"{root}/_temporary/{names[-1]}", compression=None)
                out.write(data.as_py())
                if out.tell() > FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{root}/_temporary/{name}", f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*filesystem(self.path))

    @staticmethod
    def _clear(system, root):
        from pyarrow import fs

        if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")


class WarcSource(DataSource):
    """spark.read.format("warc").option("payloads", "false").load(path): one row per record."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def write(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """One record per row of pages (page_id, url, html). Of equal payloads the one with the largest page_id is the response.

    Null html is an empty payload, null url an empty URI; line ends in a URI become %0A and %0D. A null page_id counts as smaller
    than any other. Of rows with equal payload and largest page_id, the one with the largest URI is the response, and of
    rows that are equal in that too, any one; the others revisit it. An empty table gives an archive without records; other columns are not read.

    Digests and ids alone decide the roles. Payloads are compressed before they travel, and of equal ones only one a task does.
    """
    small_batches(spark)
    spark.dataSource.register(WarcSource)
    html = F.coalesce("html", F.lit("")).cast("binary")
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\n", "%0A"), "\r", "%0D")
    who = F.struct(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"))
    rows = pages.select(who.alias("who"), html.alias("html")).withColumn("sha1", F.sha1("html"))
    same = materialize(rows.groupBy("sha1", F.octet_length("html").alias("size"), "who").agg(F.count("*").alias("n")), "payloads")
    first = materialize(same.groupBy("sha1").agg(F.max("who").alias("first"), F.sum("n").alias("n_all"), F.count("*").alias("n_kinds")).where("n_all > 1"), "responses")
    n_kinds = first.agg(F.coalesce(F.sum("n_kinds"), F.lit(0))).first()[0]
    copies = join_classes(same, first, "sha1", "n_kinds", n_kinds)
    own = F.col("who").eqNullSafe(F.col("first")).cast("long")  # a null page_id equals another
    copies = copies.withColumn("own", own).where("n > own").select("sha1", "size", "who", "first", F.explode(F.sequence(F.col("own"), F.col("n") - 1)).alias("copy"))

    @F.pandas_udf("binary")
    def response(who: pd.DataFrame, payloads: pd.Series) -> pd.Series:
        out = []
        for page_id, uri_, data in zip(who.page_id.astype("Int64"), who.uri, payloads):
            digest = base32_sha1(data)
            out.append(record("response", urn(page_id, uri_, digest, 0), uri_, digest, len(data), None, data))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("binary")
    def revisit(who: pd.DataFrame, first: pd.DataFrame, sha1: pd.Series, size: pd.Series, copy: pd.Series) -> pd.Series:
        out = []
        for page_id, uri_, of_id, of_uri, sha, n, k in zip(who.page_id.astype("Int64"), who.uri, first.page_id.astype("Int64"), first.uri, sha1, size, copy):
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            out.append(record("revisit", urn(page_id, uri_, digest, k), uri_, digest, n, urn(of_id, of_uri, digest, 0), None))
        return pd.Series(out, dtype=object)

    responses = rows.select("sha1", "who", response("who", "html").alias("record")).groupBy("sha1").agg(F.max_by("record", "who").alias("record"))
    revisits = copies.select(revisit("who", "first", "sha1", "size", "copy").alias("record"))
    responses.select("record").unionByName(revisits).write.format("warc").mode("append").save(path)


def urn(page_id, uri: str, digest: str, copy: int) -> str:
    """Record ids are the same in every run; rows with one page_id have different ones."""
    number = "" if page_id is None or page_id is pd.NA else page_id
    return f"<urn:page:{number}:{hashlib.md5(f'{digest} {copy} {uri}'.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}>"


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark, table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d*):", 1).try_cast("long")

    response = read(spark, path).where("record_type = 'response'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "uri"
    )
    revisit = read(spark, path, payloads=False).where("record_type = 'revisit'").select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("digest", ":", -1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "uri"
    )
    return response.unionByName(revisit)
