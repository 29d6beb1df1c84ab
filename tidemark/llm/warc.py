"""Web archives: pages to legacy ARC files, ARC to WARC, and WARC files read back.

The converter reads ARC files of versions 1 and 2. The version block at a file's head names
the fields of the header lines that follow; each header line ends in the length of the
record, which says where the next one starts. From these it synthesises what WARC asks for:
record identifiers, ISO timestamps, record types, block and payload digests. Records whose
payload equals another's become revisits of it.

Files are written under names of their own for every attempt of a task and count only once a
finished task has reported them, so a lost executor leaves nothing but unread files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, run_per_file, scratch_path, shared_file_system

#: Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed when it holds this many bytes (uncompressed) or records.
FILE_BYTES = 64 << 20
FILE_RECORDS = 20_000
_ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def squeeze(data: bytes) -> bytes:
    """One gzip member without a timestamp."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# ---- ARC


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n\n".encode()
    middle = "text/plain" if version == 1 else "text/plain 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} {middle} {len(body)}\n".encode() + body


def arc_record(version: int, url: bytes, date: str, content: bytes, offset: int, name: str, mime: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    url = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url) or b"unknown:"
    middle = mime if version == 1 else f"{mime} 200 {digest(content)} - {offset} {name}"
    return b"\n" + url + f" {ip} {date} {middle} {len(content)}\n".encode() + content


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    content: bytes
    version: int


class _Lines:
    """A stream with a count of the bytes read."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def line(self) -> bytes:
        got = self.stream.readline()
        self.at += len(got)
        return got

    def exactly(self, n: int) -> bytes:
        got = self.stream.read(n)
        if len(got) != n:
            raise ValueError(f"{n} bytes declared, {len(got)} there")
        self.at += n
        return got


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records of an uncompressed ARC stream, the version block first.

    Header lines are read by the fields the version block names. A URL may hold blanks: the
    other fields are counted from the end of the line.
    """
    s = _Lines(stream)
    names, version = ARC_FIELDS[1].split(), 1
    while True:
        at = s.at
        line = s.line()
        if not line:
            return
        if not line.strip():
            continue
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if text.startswith("filedesc://"):
            # the version block's own line already has the fields of its version
            values = text.split(" ")
            body = s.exactly(int(values[-1]))
            head = body.decode("utf-8", "replace").split("\n")
            version = int(head[0].split(" ")[0])
            names = head[1].split() if len(head) > 1 and head[1].strip() else ARC_FIELDS[version].split()
            own = ARC_FIELDS[version].split()
            parts = text.rsplit(" ", len(own) - 1)
            yield ArcRecord(at, dict(zip(own, parts)), body, version)
            continue
        parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not a header line of version {version} at byte {at}: {text[:80]!r}")
        yield ArcRecord(at, dict(zip(names, parts)), s.exactly(int(parts[-1])), version)


# ---- WARC


def warc_date(archive_date: str) -> str:
    """ISO time of an archive date of 4 to 14 digits; what is missing is the earliest."""
    digits = re.sub(r"\D", "", archive_date)[:14]
    d = digits + "00000101000000"[len(digits) :] if len(digits) >= 4 else "19700101000000"
    month, day = (max(1, int(d[4:6])), max(1, int(d[6:8])))
    return f"{d[:4]}-{min(month, 12):02d}-{min(day, 31):02d}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, offset: int) -> str:
    """The same record gets the same identifier each time it is converted."""
    return f"<urn:uuid:{uuid.uuid5(_ID_SPACE, f'{file}#{offset}')}>"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its closing empty line, and payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = content.find(gap)
        if at >= 0:
            return content[: at + len(gap)], content[at + len(gap) :]
    return content, b""


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = field(repr=False)

    def dump(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in {**self.headers, "Content-Length": str(len(self.block))}.items())
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"


def arc_to_warc(record: ArcRecord, file: str, refers_to: dict[str, str] | None = None) -> WarcRecord:
    """The WARC record of an ARC record; with ``refers_to`` a revisit of the one it names."""
    fields = record.fields
    url, mime = fields["URL"], fields.get("Content-type", "application/octet-stream")
    headers = {"WARC-Type": "", "WARC-Record-ID": record_id(file, record.offset), "WARC-Date": warc_date(fields["Archive-date"]), "WARC-Target-URI": url}
    if url.startswith("filedesc://"):
        headers |= {"WARC-Type": "warcinfo", "WARC-Filename": url[11:], "Content-Type": "application/warc-fields"}
        del headers["WARC-Target-URI"]
        return WarcRecord(headers, f"software: tidemark\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {record.version}\r\n".encode())
    if (ip := fields.get("IP-address", "0.0.0.0")) != "0.0.0.0":
        headers["WARC-IP-Address"] = ip
    http, payload = split_http(record.content)
    headers |= {"WARC-Payload-Digest": "sha1:" + digest(payload)}
    if http:
        headers |= {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"}
    else:
        headers |= {"WARC-Type": "resource", "Content-Type": mime}
    block = record.content
    if refers_to is not None:
        headers |= {"WARC-Type": "revisit", "WARC-Profile": IDENTICAL, **refers_to}
        block = http
    headers["WARC-Block-Digest"] = "sha1:" + digest(block)
    return WarcRecord(headers, block)


def read_warc(stream) -> Iterator[WarcRecord]:
    s = _Lines(stream)
    while True:
        line = s.line()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record at byte {s.at - len(line)}: {line[:60]!r}")
        headers: dict[str, str] = {}
        while (h := s.line().rstrip(b"\r\n")) != b"":
            k, _, v = h.decode("utf-8", "replace").partition(":")
            headers[k] = v.strip()
        yield WarcRecord(headers, s.exactly(int(headers.pop("Content-Length"))))


# ---- on Spark


class _Writer:
    """Files of bounded size in a shared folder; a gzip member for each record."""

    def __init__(self, folder: str, ending: str):
        self.fs, self.path = shared_file_system(folder)
        self.ending, self.out, self.done = ending, None, []

    def open(self) -> str:
        self.name = f"{uuid.uuid4().hex}{self.ending}"
        self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.bytes = self.records = 0
        return self.name

    def put(self, data: bytes) -> None:
        self.out.write(squeeze(data))
        self.bytes += len(data)
        self.records += 1

    @property
    def full(self) -> bool:
        return self.bytes >= FILE_BYTES or self.records >= FILE_RECORDS

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append(self.name)
            self.out = None


def _folder(spark, name: str) -> str:
    path = scratch_path(spark, name)
    fs, inner = shared_file_system(path)
    fs.create_dir(inner, recursive=True)
    return path


def _open(folder: str, name: str):
    fs, path = shared_file_system(folder)
    return gzip.GzipFile(fileobj=io.BufferedReader(fs.open_input_file(f"{path}/{name}"), 1 << 20))


def write_arc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000", version: int | None = None) -> tuple[str, DataFrame]:
    """Writes the pages as ARC files; gives the folder and a table of the names in it.

    Content is an HTTP response whose ``X-Page-Id`` carries the id. Without ``version`` files
    of versions 1 and 2 alternate. A null html is an empty payload, a null url ``unknown:``.
    """
    folder = _folder(pages.sparkSession, "arc")

    def write(batches):
        w, kind = _Writer(folder, ".arc.gz"), version or 1
        for b in batches:
            for i, u, h in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html"))):
                if w.out is None:
                    w.open()
                    kind = version or 1 + len(w.done) % 2
                    w.put(arc_head(kind, w.name, date))
                payload = h or b""
                mark = "" if i is None else f"X-Page-Id: {i}\r\n"
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                w.put(arc_record(kind, u or b"", date, content, w.bytes, w.name))
                if w.full:
                    w.close()
        w.close()
        yield pa.RecordBatch.from_pydict({"file": w.done}, schema=pa.schema([("file", pa.string())]))

    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("binary").alias("url"), F.col(html).cast("binary").alias("html"))
    return folder, materialize(rows.mapInArrow(write, "file string"), "arc-files")


_META = {"file": pa.string(), "offset": pa.int64(), "url": pa.string(), "at": pa.string(), "id": pa.int64(), "size": pa.int64(), "sha": pa.string()}


def http_field(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1] if found else None


def scan_arc(folder: str, files: DataFrame) -> DataFrame:
    """A row for each page record of the files: where it is, its id, payload size and digest."""

    def scan(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                rows: dict[str, list] = {c: [] for c in _META}
                with _open(folder, name) as s:
                    for r in read_arc(s):
                        if r.fields["URL"].startswith("filedesc://"):
                            continue
                        head, payload = split_http(r.content)
                        mark = http_field(head, b"X-Page-Id")
                        for c, v in zip(_META, (name, r.offset, r.fields["URL"], r.fields["Archive-date"], None if mark is None else int(mark), len(payload), digest(payload))):
                            rows[c].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(list(_META.items())))

    return run_per_file(files, scan, "file string, offset long, url string, at string, id long, size long, sha string")


def convert(folder: str, files: DataFrame, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Converts ARC files to WARC files; gives their folder and a table of their names.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest id
    is kept whole and the others revisit it; among rows with that same id the last place in
    the files counts, and null ids come last. Smaller payloads are all kept whole. Repeated
    records are records of their own; an empty table of files gives an empty one.
    """
    spark = files.sparkSession
    out = _folder(spark, "warc")
    records = materialize(scan_arc(folder, files), "arc-records")
    place = F.struct("id", "file", "offset")
    whole = materialize(  # written, so that the join below has a shuffle of its own, which may be split
        records.filter(F.col("size") >= min_bytes)
        .groupBy("sha", "size")
        .agg(F.count("*").alias("n"), F.max_by(F.struct("id", "file", "offset", "url", "at"), place).alias("to"))
        .filter("n > 1")
        .select("sha", "size", "to"),
        "kept-whole",
    )
    same = (F.col("to.file") == F.col("file")) & (F.col("to.offset") == F.col("offset"))
    revisits = records.join(whole, ["sha", "size"]).filter(~same).select("file", F.struct("offset", "to").alias("x"))
    by_file = files.join(revisits.groupBy("file").agg(F.collect_list("x").alias("revisits")), "file", "left")  # bounded by a file's records

    def write(batches):
        for b in batches:
            for name, revisits in zip(b.column("file").to_pylist(), b.column("revisits").to_pylist()):
                to = {x["offset"]: x["to"] for x in revisits or []}
                w = _Writer(out, ".warc.gz")
                w.open()
                with _open(folder, name) as s:
                    for r in read_arc(s):
                        t = to.get(r.offset)
                        refers = t and {"WARC-Refers-To": record_id(t["file"], t["offset"]), "WARC-Refers-To-Target-URI": t["url"], "WARC-Refers-To-Date": warc_date(t["at"])}
                        w.put(arc_to_warc(r, name, refers).dump())
                w.close()
                yield pa.RecordBatch.from_pydict({"file": w.done}, schema=pa.schema([("file", pa.string())]))

    return out, materialize(run_per_file(by_file, write, "file string"), "warc-files")


_READ = {"id": pa.int64(), "size": pa.int64(), "sha": pa.string(), "type": pa.string(), "record": pa.string(), "refers": pa.string()}


def read_back(folder: str, files: DataFrame) -> DataFrame:
    """A row for each page record of WARC files; payloads are digested again where they are."""

    def read(batches):
        for b in batches:
            for name in b.column("file").to_pylist():
                rows: dict[str, list] = {c: [] for c in _READ}
                with _open(folder, name) as s:
                    for r in read_warc(s):
                        kind = r.headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        head, payload = split_http(r.block)
                        stated = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = len(payload)
                        if kind == "revisit":  # the header keeps the length of the payload left out
                            size = int(http_field(head, b"Content-Length") or 0)
                        elif digest(payload) != stated:
                            raise ValueError(f"{name}: {r.headers['WARC-Record-ID']} doesn't match its digest")
                        mark = http_field(head, b"X-Page-Id")
                        for c, v in zip(_READ, (None if mark is None else int(mark), size, stated, kind, r.headers["WARC-Record-ID"], r.headers.get("WARC-Refers-To"))):
                            rows[c].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(list(_READ.items())))

    return run_per_file(files, read, "id long, size long, sha string, type string, record string, refers string")


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages through ARC and WARC files and back: a row for each row of ``pages``.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``. Null
    and empty html are empty payloads, equal to each other. A null page_id is returned; it is
    revisited only where no equal payload has an id (``refers_to`` is then null). Repeated
    rows are records of their own, all but one of them revisits. Other columns aren't read;
    an empty table gives an empty result.
    """
    arc, arc_files = write_arc(pages, page_id, url, html)
    out, warc_files = convert(arc, arc_files, min_bytes)
    records = materialize(read_back(out, warc_files), "warc-records")
    whole = records.filter("type <> 'revisit'").select(F.col("record").alias("refers"), F.col("id").alias("refers_to"))
    return records.join(whole, "refers", "left").select(
        F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )
