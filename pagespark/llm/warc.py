"""WARC archives: writing them as one gzip stream for each file, and the normaliser for such files.

A *monolithic* archive is one gzip stream over a whole file: no record can be read without all
before it. The normaliser inflates each such stream once, in pieces, and writes every record as a
gzip member of its own, with a sidecar index of their places (one line of JSON for each record:
offset, length, type, page, digest). While it rewrites, records whose payload an earlier page has
already become revisits that refer to it.

Pages move only in files: a task archives its pages as they are scanned, another task rewrites that
archive, others read the result back by its index. What is shuffled is a row of some 60 bytes for each
page: payload digest, size, and place. The smallest page of each digest is found by an aggregation
that combines before it moves.

Defined results: a null html is an empty payload; a null url is left out of the record. Equal
payloads of one page id: the first by (archive, place) is the response, the others refer to the same
id. A null page id sorts after all others and is written without an id. An empty table makes no
file and no row. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm import files, words
from pagespark.llm.store import kept, shared

#: Payload bytes after which a new archive begins.
ROLL_BYTES = 256 << 20
#: Payloads of at least so many bytes can be revisits.
LEAST_BYTES = 0
#: Bytes that are inflated at a time.
PIECE = 1 << 20
LEVEL = 4
#: A capture's time is not in the table.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page: int | None) -> str:
    return f"<urn:page:{'unknown' if page is None else page}>"


def record(kind: str, page: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as bytes; a revisit has no payload but says the digest and size of the full one."""
    block = _HTTP + payload
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of a stream that comes in pieces; one record is held at a time."""
    held, done = bytearray(), 0
    pieces = iter(pieces)

    def more() -> bool:
        nonlocal done
        piece = next(pieces, None)
        if piece is None:
            return False
        if done:
            del held[:done]
            done = 0
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", done)) < 0:
            if not more():
                if len(held) > done:
                    raise ValueError("the archive ends inside a record's head")
                return
        lines = held[done:end].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record begins here: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        skip, size = end + 4 - done, int(head["Content-Length"])
        while len(held) - done < skip + size + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        block = bytes(held[done + skip : done + skip + size])
        done += skip + size + 4
        yield head, block.split(b"\r\n\r\n", 1)[1]


def inflated(source) -> Iterator[bytes]:
    """A gzip file's content in pieces of bounded size, read once."""
    unzip = zlib.decompressobj(31)
    while data := source.read(PIECE):
        while data:
            yield unzip.decompress(data, PIECE)
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
    if rest := unzip.flush():
        yield rest


class _Archive:
    """A monolithic archive in writing."""

    def __init__(self, uri: str) -> None:
        self.uri, self.out, self.zip, self.size, self.rows = uri, files.writer(uri), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0

    def add(self, data: bytes) -> None:
        self.out.write(self.zip.compress(data))

    def close(self) -> None:
        self.out.write(self.zip.flush())
        self.out.close()


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, archive = TaskContext.get().partitionId(), None
        for batch in batches:
            for some in words.slices(batch, "html"):
                uris, places, sizes, digests = [], [], [], []
                pages = some["page_id"].to_pylist()
                for page, url, html in zip(pages, some["url"].to_pylist(), some["html"].to_pylist()):
                    if archive is None or archive.size >= roll:
                        if archive is not None:
                            archive.close()
                        archive = _Archive(files.new_name(folder, part, ".warc.gz"))
                    payload = (html or "").encode()
                    digest = payload_digest(payload)
                    archive.add(record("response", page, url, digest, len(payload), payload))
                    uris.append(archive.uri)
                    places.append(archive.rows)
                    sizes.append(len(payload))
                    digests.append(base64.b32decode(digest))
                    archive.size += len(payload)
                    archive.rows += 1
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(pages, pa.int64()), "uri": uris, "place": pa.array(places, pa.int64()), "size": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary())})
        if archive is not None:
            archive.close()

    return run


def write_monolithic(pages: DataFrame, roll: int = ROLL_BYTES) -> DataFrame:
    """Archive pages (page_id, url, html); returns the table of records: page_id, uri, place, size, digest."""
    folder = f"{shared(pages.sparkSession)}/monolithic"
    files.make_folder(folder)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return kept(rows.mapInArrow(_write(folder, roll), "page_id long, uri string, place long, size long, digest binary"))


def revisits(found: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """uri, place, refers_to of the records whose payload an earlier one has."""
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "uri", "place")
    large = found.where(F.col("size") >= least_bytes).select("digest", "size", "uri", "place", order.alias("this"))
    first = large.groupBy("digest", "size").agg(F.min("this").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = large.join(first, ["digest", "size"]).where("this <> first")
    return again.select("uri", "place", F.col("first.page_id").alias("refers_to"), F.lit(True).alias("again"))


def _rewrite(folder: str):
    """Rows (uri, place, refers_to) sorted so that an archive's come together: rewrite each archive."""

    def normal(uri: str, again: dict[int, int | None], part: int) -> tuple[str, int]:
        to = files.new_name(folder, part, ".warc.gz")
        at, index = 0, []
        with files.reader(uri) as source, files.writer(to) as out, files.writer(f"{to}.idx") as side:
            for place, (head, payload) in enumerate(records(inflated(source))):
                page = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload)
                kind = "revisit" if place in again else "response"
                one = record(kind, page, head.get("WARC-Target-URI"), digest, size, b"" if place in again else payload, again.get(place))
                zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = zipper.compress(one) + zipper.flush()
                out.write(member)
                index.append(json.dumps({"offset": at, "length": len(member), "type": kind, "page": page, "digest": digest}))
                at += len(member)
                if len(index) == 4096:
                    side.write(("\n".join(index) + "\n").encode())
                    index = []
            if index:
                side.write(("\n".join(index) + "\n").encode())
        return to, place + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, uri, again = TaskContext.get().partitionId(), None, {}

        def flush():
            to, n = normal(uri, again, part)
            return pa.RecordBatch.from_pydict({"uri": [to], "n": [n]})

        for batch in batches:
            for own, place, refers, is_again in zip(*(batch[c].to_pylist() for c in ("uri", "place", "refers_to", "again"))):
                if own != uri:
                    if uri is not None:
                        yield flush()
                    uri, again = own, {}
                if is_again:
                    again[place] = refers
        if uri is not None:
            yield flush()

    return run


def normalise(found: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Rewrite the archives that ``found`` (see ``write_monolithic``) names; returns their new places: uri, n."""
    spark = found.sparkSession
    folder = f"{shared(spark)}/members"
    files.make_folder(folder)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    archives = found.select("uri").distinct().select("uri", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("again"))
    todo = archives.unionByName(revisits(found, least_bytes)).repartition(n, "uri").sortWithinPartitions("uri", "place")
    return kept(todo.mapInArrow(_rewrite(folder), "uri string, n long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch["uri"].to_pylist():
            with files.reader(uri) as source, files.reader(f"{uri}.idx") as side:
                lines = side.read().decode().splitlines()
                for i in range(0, len(lines), 1024):
                    rows = [_one(source, json.loads(x)) for x in lines[i : i + 1024]]
                    pages, sizes, digests, kinds, refers = zip(*rows)
                    yield pa.RecordBatch.from_pydict({"page_id": pa.array(pages, pa.int64()), "payload_bytes": pa.array(sizes, pa.int64()), "payload_digest": digests, "record_type": kinds, "refers_to": pa.array(refers, pa.int64())})


def _one(source, entry: dict) -> tuple:
    """Read one member by its place and hold it against its own digest."""
    source.seek(entry["offset"])
    ((head, payload),) = records(iter([zlib.decompress(source.read(entry["length"]), 31)]))
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
    size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
    return (int(page) if page else None), size, digest, kind, (int(refers) if refers else None)


def read_members(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read by the sidecar index."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("uri").repartition(n, "uri").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
