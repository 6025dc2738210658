"""WARC archives: a writer with one gzip member per record, and a sequential, verifying reader.

Archives are ordinary files in a folder that all executors share, opened by its URI, so that any store
that Arrow knows will do. A table of pages is written in parallel, some archives per task; archives are
read in parallel and each from front to back, in blocks, whatever the size of a record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import saved
from verdigris.session import scratch_path

READ_BYTES = 1 << 16
LINE_BYTES = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class CorruptArchive(ValueError):
    """An archive that breaks its framing, ends early or does not have the digest that it claims."""


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Hadoop writes it."""
    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri))
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def digest(raw: bytes) -> str:
    return base32(hashlib.sha1(raw))


def base32(h) -> str:
    return base64.b32encode(h.digest()).decode()


# ---------------------------------------------------------------- writing
def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member: a response with its payload, or a revisit of page refers_to without it."""
    kind = "response" if refers_to is None else "revisit"
    head = http_head(len(payload))
    block = head + payload if refers_to is None else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:  # characters that would end a header line are escaped
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def with_roles(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: among equal payloads of least_bytes or more the largest page_id is the
    response and the others refer to it; smaller payloads and pages that have no known id to refer to
    are responses."""
    p = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).withColumn("key", F.sha2("html", 256))
    first = p.groupBy("key").agg(F.max("page_id").alias("response"))
    revisits = (F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response"))
    return p.join(first, "key").select("page_id", "url", "html", F.when(revisits, F.col("response")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, archive_bytes: int = 1 << 28,
) -> DataFrame:
    """Writes a record per row under folder; returns path, records and bytes of each archive.

    Null html is an empty payload. Repeated rows are records of their own: copies of the response are
    responses too. A row with a null id refers to an equal page with an id, if there is one. An empty
    table writes no archive. An archive is closed once it has archive_bytes. A task writes under a name of
    its own and renames, so that a repeated task leaves whole archives with the same records."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        disk, root = store(folder)
        disk.create_dir(root, recursive=True)
        done, out, n, size = [], None, 0, 0

        def close():
            name = f"part-{part:06d}-{len(done):04d}.warc.gz"
            out.close()
            disk.move(f"{root}/.{attempt}-{name}", f"{root}/{name}")
            done.append((f"{folder}/{name}", n, size))

        for batch in batches:
            for p, u, h, r in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    n, size = 0, 0
                    out = disk.open_output_stream(f"{root}/.{attempt}-part-{part:06d}-{len(done):04d}.warc.gz")
                ids = [None if i is None else int(i) for i in (p, r)]
                raw = record(ids[0], u, h.encode("utf-8", "surrogatepass"), ids[1])
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    roles = with_roles(pages, page_id, url, html, least_bytes)
    # ids travel as text: a nullable number would turn into a float in pandas
    texts = roles.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return saved(texts.mapInPandas(write, "path string, records long, bytes long"), "archives")


# ---------------------------------------------------------------- reading
class Members:
    """Bytes of a gzip file, one member after the other, decompressed block by block."""

    def __init__(self, stream):
        self.stream, self.raw, self.unpack, self.ready = stream, b"", None, b""

    def next(self) -> bool:
        """Goes to the next member; False at the end of the file. The one before must be used up."""
        if self.unpack is not None:
            if self.ready or self.more():
                raise CorruptArchive("a member goes on after its record")
            self.raw = self.unpack.unused_data
        self.raw = self.raw or self.stream.read(READ_BYTES)
        if not self.raw:
            return False
        self.unpack, self.ready = zlib.decompressobj(31), b""
        return True

    def more(self) -> bool:
        """Decompresses the next block, at most READ_BYTES of it; False at the member's end."""
        while not self.unpack.eof:
            raw = self.raw or self.unpack.unconsumed_tail or self.stream.read(READ_BYTES)
            self.raw = b""
            try:
                block = self.unpack.decompress(raw, READ_BYTES)
            except zlib.error as e:
                raise CorruptArchive(f"a member cannot be decompressed: {e}") from e
            if not raw and not block and not self.unpack.eof:
                raise CorruptArchive("the archive ends inside a record")
            if block:
                self.ready += block
                return True
        return False

    def line(self) -> bytes:
        while b"\r\n" not in self.ready:
            if len(self.ready) > LINE_BYTES or not self.more():
                raise CorruptArchive("a header line does not end")
        line, _, self.ready = self.ready.partition(b"\r\n")
        return line

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in blocks."""
        while n:
            if not self.ready and not self.more():
                raise CorruptArchive("a record is shorter than its length")
            block, self.ready = self.ready[:n], self.ready[n:]
            n -= len(block)
            yield block

    def headers(self) -> dict[str, str]:
        found = {}
        while line := self.line():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            found[name.lower()] = value.strip()
        return found


def records(stream, keep_payload: bool) -> Iterator[dict]:
    """Every record of an archive in order, its framing and digests verified."""
    members = Members(stream)
    while members.next():
        if not members.line().startswith(b"WARC/"):
            raise CorruptArchive("a member does not begin with a record")
        head = members.headers()
        length = int(head["content-length"])
        block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
        http, size, inside = b"", 0, False
        for part in members.take(length):
            block.update(part)
            if not inside:
                http += part
                end = http.find(b"\r\n\r\n")
                if end < 0:
                    if len(http) > LINE_BYTES:
                        raise CorruptArchive("an HTTP head does not end")
                    continue
                http, part, inside = http[:end], http[end + 4 :], True
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        if b"".join(members.take(4)) != b"\r\n\r\n":
            raise CorruptArchive("a record does not end where its length says")
        claimed = int(re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)[1])
        if head["warc-block-digest"] != f"sha1:{base32(block)}":
            raise CorruptArchive(f"the block digest of {head['warc-record-id']} is wrong")
        is_response = head["warc-type"] == "response"
        if is_response and (size != claimed or head["warc-payload-digest"] != f"sha1:{base32(payload)}"):
            raise CorruptArchive(f"the payload of {head['warc-record-id']} is wrong")
        yield {
            "page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": claimed,
            "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "record_type": head["warc-type"],
            "refers_to": _page(head.get("warc-refers-to")),
            "html": b"".join(kept).decode("utf-8", "surrogatepass") if keep_payload and is_response else None,
        }


def _page(uri: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return found[1] if found else None


READ_COLUMNS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string"


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of the archives whose paths are in column path; html of responses if it is wanted.

    A broken archive raises CorruptArchive: nothing is skipped. No paths, no rows. A task reads archives
    one after the other, block by block; without payloads its memory does not depend on record size."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                disk, place = store(path)
                with disk.open_input_stream(place) as stream:
                    rows, size = [], 0
                    for r in records(stream, keep_payload):
                        rows.append(r)
                        size += 500 + len(r["html"] or "")
                        if size > 1 << 24:
                            yield pd.DataFrame(rows)
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows)

    n = max(1, archives.count())
    found = archives.select("path").repartition(n).mapInPandas(read, READ_COLUMNS)
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_folder(df: DataFrame) -> str:
    return scratch_path(df.sparkSession, "warc")
