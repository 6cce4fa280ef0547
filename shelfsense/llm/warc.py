"""WARC archives of pages: written and read record by record, one gzip member each.

Equal payloads are stored once: the row with the largest id is the response, the others revisit
it. Who revisits is found on digests alone; a payload is shuffled only where a filter of bounded
size could not tell, a revisit needs none. Every writing task names its files afresh and reports
them as rows, so the files of a task that was lost or run twice are in no manifest.

The reader goes through a file once: a member is inflated piece by piece, the header gives the
length of the block, the block is digested as it passes. It holds one piece, or one payload where
payloads are asked for. Files are opened with ``pyarrow.fs``, so ``folder`` is a path or URI that
it and all executors know.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, key_filter, may_contain, spread_join, stored, surely_lacks

#: Compressed size at which a task begins its next archive.
FILE_BYTES = 256 << 20
#: Bytes read and inflated at a time, and the longest header taken for one.
PIECE = 64 << 10
LONGEST_HEADER = 1 << 20
#: Records and payload bytes handed on together.
ROWS, ROW_BYTES = 4096, 4 << 20

# Fixed values of the format (ISO 28500, WARC 1.1).
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http;msgtype=response"


class Record(NamedTuple):
    """A record as read; ``problem`` is null where framing and digests hold."""

    record_type: str | None
    record_id: str | None
    refers_to: str | None
    target_uri: str | None
    payload_bytes: int | None
    payload_digest: str | None
    payload: bytes | None
    problem: str | None


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _name(row_id, digest: str) -> str:
    """URI of the record of a row: its id (nothing for a null one) and its payload's digest."""
    return f"<urn:page:{'' if row_id is None else quote(str(row_id), safe='')}:{digest}>"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    fields = [
        *fields,
        ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).digest())}"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"
    return squeeze.compress(text) + squeeze.flush()


def page_record(row_id, uri: str | None, payload: bytes, date: str) -> bytes:
    """A response record. Control characters and blanks of the URI are percent-encoded."""
    digest = base32_sha1(hashlib.sha1(payload).digest())
    return _captured("response", row_id, uri, len(payload), digest, date, [], payload)


def revisit_record(row_id, uri: str | None, size: int, digest: str, target, date: str) -> bytes:
    """A record without payload that points at the response of row ``target``."""
    seen = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(target, digest))]
    return _captured("revisit", row_id, uri, size, digest, date, seen, b"")


def _captured(kind, row_id, uri, size, digest, date, more, payload) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    if uri is not None:
        uri = "".join(quote(c) if c <= " " or c == "\x7f" else c for c in uri)
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", _name(row_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), *more,
        ("Content-Type", HTTP_RESPONSE),
    ]
    return _record(fields, head.encode() + payload)


def roles(pages: DataFrame, row_id: str, uri: str, html: str, at_least: int) -> tuple[DataFrame, DataFrame]:
    """All rows by payload digest, and of these the ones that revisit another (``target``)."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    rows = stored(
        pages.select(
            F.col(row_id).alias("row_id"), F.col(uri).cast("string").alias("uri"),
            F.unhex(F.sha2(body, 256)).alias("key"), F.unhex(F.sha1(body)).alias("sha1"),
            F.octet_length(body).cast("bigint").alias("size"),
        ),
        "payloads",
    )
    groups = (
        rows.where(F.col("size") >= at_least).groupBy("key")
        .agg(F.max("row_id").alias("target"), F.count(F.lit(1)).alias("held")).where("held > 1")
    )
    copies = spread_join(rows, stored(groups, "groups"), "key", "held", rows.count())
    return rows, stored(copies.where("target is not null and not row_id <=> target").drop("held"), "revisits")


def write_archives(
    pages: DataFrame, folder: str, row_id: str = "page_id", uri: str = "url", html: str = "html",
    date: str = "1970-01-01T00:00:00Z", at_least: int = 0, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages`` under ``folder``; ``path`` and ``records`` of the files.

    The payload is the text in UTF-8, a null one is empty. Of payloads that are equal and have
    ``at_least`` bytes the row with the largest id is the response; rows that repeat that id with
    that payload are responses as well. A null id is smaller than any other; where a group has no
    other, all its rows are responses. A null URI is left out of the header. Very long texts are
    one record each. An empty table gives no file; other columns are ignored. The writing is done
    when the returned rows are computed: store them once and read from what was stored.
    """
    rows, revisits = roles(pages, row_id, uri, html, at_least)
    width = filter_bits(revisits.count())
    bits = key_filter(revisits, "row_id", width)
    whole = pages.select(F.col(row_id).alias("row_id"), F.col(uri).cast("string").alias("uri"), F.col(html).alias("html"))
    responses = surely_lacks(whole, "row_id", bits, width)
    # What the filter passes are revisits, but for a few rows that are told apart by id and digest.
    mark = F.sha2(F.concat_ws("|", F.hex("key"), F.col("row_id").cast("string")), 256)
    doubtful = may_contain(rows, "row_id", bits, width).select("row_id", mark.alias("mark")).distinct()
    mistaken = stored(doubtful.join(revisits.select(mark.alias("mark")), "mark", "left_anti"), "mistaken")
    if not mistaken.isEmpty():
        width = filter_bits(mistaken.count())
        found = may_contain(whole, "row_id", key_filter(mistaken, "row_id", width), width)
        found = found.withColumn("key", F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)))
        responses = responses.union(
            found.withColumn("mark", mark).join(mistaken.select("mark"), "mark", "left_semi").select(whole.columns)
        )
    no_payload = {"sha1": F.lit(None).cast("binary"), "size": F.lit(None).cast("bigint"), "target": F.lit(None).cast(dict(revisits.dtypes)["target"])}
    records = responses.withColumns(no_payload).unionByName(revisits.drop("key").withColumn("html", F.lit(None).cast("string")))
    columns = ["row_id", "uri", "html", "sha1", "size", "target"]

    def work(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        out, path, written, made = None, None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if out is None:
                    system.create_dir(root, recursive=True)
                    path, written, made = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                    written += out.write(_record(
                        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                         ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                key, link, text, sha1, size, target = row
                if sha1 is None:
                    record = page_record(key, link, (text or "").encode(), date)
                else:
                    record = revisit_record(key, link, size, base32_sha1(sha1), target, date)
                written += out.write(record)
                made += 1
                if written >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [made], "bytes": [written]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [made], "bytes": [written]})

    return records.select(columns).mapInArrow(work, "path string, records bigint, bytes bigint")


class Members:
    """The gzip members of a file one after the other, inflated a piece at a time."""

    def __init__(self, stream):
        self.stream, self.packed, self.inflate = stream, b"", None

    def next(self) -> bool:
        """Begin the next member; false at the end of the file."""
        self.packed = self.packed or self.stream.read(PIECE)
        self.inflate = zlib.decompressobj(31)
        return bool(self.packed)

    def piece(self) -> bytes:
        """The member's next bytes, nothing at its end."""
        while not self.inflate.eof:
            out = self.inflate.decompress(self.packed, PIECE)
            self.packed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                return out
            if not self.packed and not self.inflate.eof:
                self.packed = self.stream.read(PIECE)
                if not self.packed:
                    raise ValueError("the file ends inside a member")
        return b""


def _header(members: Members, text: bytes, first: str) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) of the header that begins with ``text``, and what follows it."""
    while (end := text.find(b"\r\n\r\n")) < 0:
        piece = members.piece()
        if not piece or len(text) > LONGEST_HEADER:
            raise ValueError("a header has no end")
        text += piece
    lines = text[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"a header begins with {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, text[end + 4 :]


def _bare(field: str | None) -> str | None:
    return field[1:-1] if field and field[0] == "<" and field[-1] == ">" else field


def _pieces(members: Members, text: bytes, length: int) -> Iterator[bytes]:
    """The block of ``length`` bytes; then the record, and the member, must end."""
    while length:
        part, text = text[:length], text[length:]
        if part:
            length -= len(part)
            yield part
        if length:
            text = members.piece()
            if not text:
                raise ValueError(f"{length} bytes of a block are missing")
    while piece := members.piece():
        text += piece
        if len(text) > 4:
            break
    if text != b"\r\n\r\n":
        raise ValueError("a record goes on after its block")


def read_record(members: Members, payloads: bool) -> Record:
    """The record of the member just begun."""
    fields, text = _header(members, b"", "WARC/")
    if not fields.get("content-length", "").isdigit():
        raise ValueError("a record has no length")
    block, payload, size = hashlib.sha1(), hashlib.sha1(), 0
    http = fields.get("content-type", "").replace(" ", "") == HTTP_RESPONSE
    kept, head, inner = [], b"", None if http else {}
    for piece in _pieces(members, text, int(fields["content-length"])):
        block.update(piece)
        if inner is None:
            head += piece
            if b"\r\n\r\n" not in head:
                if len(head) > LONGEST_HEADER:
                    raise ValueError("a header has no end")
                continue
            inner, piece = _header(members, head, "HTTP/")
        payload.update(piece)
        size += len(piece)
        if payloads:
            kept.append(piece)
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    problem = None
    if (given := fields.get("warc-block-digest")) and given != f"sha1:{base32_sha1(block.digest())}":
        problem = "block digest differs"
    kind = fields.get("warc-type")
    if kind == "revisit":
        length = (inner or {}).get("content-length", "")
        size, digest = int(length) if length.isdigit() else None, said
    else:
        digest = base32_sha1(payload.digest())
        if said and said != digest:
            problem = "payload digest differs"
    return Record(
        kind, _bare(fields.get("warc-record-id")), _bare(fields.get("warc-refers-to")), fields.get("warc-target-uri"),
        size, digest, b"".join(kept) if payloads and kind != "revisit" else None, problem,
    )


def read_file(stream, payloads: bool = False) -> Iterator[Record]:
    """The records of an archive, in order. A record whose digests differ says so; where framing
    or compression is broken one last record tells, as nothing behind it can be trusted."""
    members = Members(stream)
    try:
        while members.next():
            yield read_record(members, payloads)
    except (ValueError, zlib.error) as broken:
        yield Record(*[None] * 7, f"{broken}"[:200])


def read_archives(files: DataFrame, folder: str, payloads: bool = False, strict: bool = True) -> DataFrame:
    """The records of the files in column ``path`` (opened like ``folder``), columns as in Record.

    ``strict`` fails on a record with a problem; otherwise it is a row. A file is read by one
    task; equal paths are read once. A revisit has the size and digest of the payload it points
    at. Null paths are left out, an empty list gives no rows, other columns are ignored.
    """
    files = files.select("path").where("path is not null").distinct()

    def work(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.string()]

        def packed(found):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), types)], list(Record._fields)
            )

        found, held = [], 0
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            with system.open_input_stream(path, compression=None) as stream:
                for record in read_file(stream, payloads):
                    if strict and record.problem:
                        raise ValueError(f"{path}: {record.problem}")
                    found.append(record)
                    held += len(record.payload or b"")
                    if len(found) >= ROWS or held >= ROW_BYTES:
                        yield packed(found)
                        found, held = [], 0
        if found:
            yield packed(found)

    schema = (
        "record_type string, record_id string, refers_to string, target_uri string, "
        "payload_bytes bigint, payload_digest string, payload binary, problem string"
    )
    return files.repartition(max(1, files.count())).mapInArrow(work, schema)


def row_of(name: str, kind: str):
    """The id inside a record's URI, as type ``kind``; null where it has none."""
    return F.expr(f"try_cast(url_decode(nullif(regexp_extract({name}, '^urn:page:(.*):[A-Z2-7]{{32}}$', 1), '')) as {kind})")
