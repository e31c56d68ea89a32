"""Web archives (WARC 1.1) as a Spark data source, written and read in Python.

``spark.dataSource.register(WarcDataSource)`` makes ``format("warc")`` known. A reader plans
partitions of whole files, small ones together. It parses the header of a record first, tests
the pushed filters on it, and goes on to the next record without decoding the payload if the
record is not wanted or the payload is not asked for. To push filters, the session needs
``spark.sql.python.filterPushdown.enabled``.

Each record is a gzip member of its own, as usual, whose extra field ``sl`` holds the member's
length, so that a reader can step over it. Members without that field, and plain files, are read
too. A writer's task writes under a temporary name; the commit on the driver renames the files
of the tasks that succeeded, so a lost executor leaves nothing that a reader sees.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
    StringStartsWith, WriterCommitMessage,
)

SCHEMA = ("record_id string, record_type string, target_uri string, payload_bytes bigint, "
          "payload_digest string, refers_to string, payload binary")
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type",
           "target_uri": "WARC-Target-URI", "payload_bytes": "X-Payload-Length",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
FILE_BYTES = 256 << 20       # a writer begins another file beyond this
PARTITION_BYTES = 64 << 20   # files up to this together are read by one task
BATCH_BYTES = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    """A header value is one line; a URI cannot hold line breaks, so they are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """Header and payload of a record; a revisit carries no payload."""
    payload = (row["payload"] or b"") if row["record_type"] != "revisit" else b""
    lines = ["WARC/1.1", f"WARC-Date: {_DATE}", "Content-Type: text/html; charset=utf-8"]
    lines += [f"{name}: {_clean(str(row[c]))}" for c, name in HEADERS.items()
              if row[c] is not None]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {_PROFILE}")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` has its compressed and its full length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x04\xff"
    lengths = (total, len(data)) if max(total, len(data)) < 1 << 32 else (0, 0)  # 0: not known
    extra = struct.pack("<H2sHII", 12, b"sl", 8, *lengths)
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    pairs = (x.partition(b":") for x in lines[1:] if x)
    return {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def header_values(header: dict[str, str]) -> dict:
    out = {c: header.get(name.lower()) for c, name in HEADERS.items()}
    length = out["payload_bytes"]
    out["payload_bytes"] = int(length if length is not None else header["content-length"])
    return out


def records(stream, wanted, with_payload: bool) -> Iterator[dict]:
    """The records of a file whose header is ``wanted``; payloads only where asked for."""
    start = stream.read(2)
    stream.seek(0)
    scan = _members if start == b"\x1f\x8b" else _plain
    for header, payload in scan(stream):
        values = header_values(header)
        if wanted(values):
            yield {**values, "payload": payload() if with_payload else None}


def _plain(stream):
    while True:
        at = stream.tell()
        block = b""
        while (end := block.find(b"\r\n\r\n")) < 0:
            more = stream.read(1024)
            if not more:
                return
            block += more
        header = parse_header(block[:end])
        begin, length = at + end + 4, int(header["content-length"])

        def payload(begin=begin, length=length):
            stream.seek(begin)
            return stream.read(length)

        yield header, payload
        stream.seek(begin + length + 4)


def _members(stream):
    size = stream.size() if hasattr(stream, "size") else stream.seek(0, io.SEEK_END)
    at = 0
    while at < size:
        stream.seek(at)
        raw = stream.read(4096)
        known = _member_length(raw)
        inflate = zlib.decompressobj(31)
        block = inflate.decompress(raw, 4096)
        while (end := block.find(b"\r\n\r\n")) < 0:
            more = inflate.unconsumed_tail or stream.read(4096)
            if not more or inflate.eof:
                raise ValueError("a member without a header")
            block += inflate.decompress(more, 4096)
        header = parse_header(block[:end])
        length = int(header["content-length"])
        state = [block[end + 4:], False]

        def rest(state=state, inflate=inflate, stream=stream):
            while not inflate.eof:
                more = inflate.unconsumed_tail or stream.read(1 << 16)
                if not more:
                    break
                state[0] += inflate.decompress(more)
            state[1] = True

        def payload(state=state, length=length, rest=rest):
            rest()
            return state[0][:length]

        yield header, payload
        if known:
            at += known
        else:
            if not state[1]:
                rest()
            at = stream.tell() - len(inflate.unused_data)


def _member_length(raw: bytes) -> int | None:
    if len(raw) > 24 and raw[3] & 4 and raw[12:14] == b"sl":
        return struct.unpack("<I", raw[16:20])[0]
    return None


_TESTS = {
    EqualTo: lambda v, x: v is not None and v == x, In: lambda v, x: v is not None and v in x,
    GreaterThan: lambda v, x: v is not None and v > x,
    GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x,
    LessThanOrEqual: lambda v, x: v is not None and v <= x,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x),
    IsNull: lambda v, x: v is None, IsNotNull: lambda v, x: v is not None,
}


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Filters on header fields are taken; the rest stay with Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, path = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found
                       if x.is_file and x.base_name.endswith((".warc", ".warc.gz")))
        out, held = [[]], 0
        for name, size in files:
            if out[-1] and held + size > PARTITION_BYTES:
                out.append([])
                held = 0
            out[-1].append(name)
            held += size
        return [Files(x) for x in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        system, _ = filesystem(self.path)
        wanted = lambda v: all(_TESTS[kind](v[c], x) for kind, c, x in self.tests)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                for record in records(stream, wanted, "payload" in target.names):
                    rows.append({c: record[c] for c in target.names})
                    held += 500 + len(record["payload"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=target)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=target)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        names, out, held = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or held > FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, held = system.open_output_stream(f"{path}/{names[-1]}.part"), 0
                    data = gzip_member(record_bytes(row))
                    out.write(data)
                    held += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages) -> None:
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(path))
               if x.is_file and x.base_name.endswith(".warc.gz")] if self.overwrite else []
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{path}/{name}.part", f"{path}/{name}")
        for name in old:
            system.delete_file(name)

    def abort(self, messages) -> None:
        system, path = filesystem(self.path)
        for message in messages:
            for name in message.names if message else []:
                system.delete_file(f"{path}/{name}.part")


class WarcDataSource(DataSource):
    """Rows of SCHEMA; a reader may be given fewer of its columns."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)
