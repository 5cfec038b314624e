"""WARC archives: writer with revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.llm.common import BROADCAST_ROWS, attach_groups, near, shared_dir, written

#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
#: An archive file is closed when it has so many bytes.
FILE_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION_LINE, MEMBER = re.compile(rb"WARC/1\.[0-9]\r\n"), re.compile(re.escape(MAGIC) + b"[\x00-\x1f]")
MARKS = re.compile(MEMBER.pattern + b"|" + VERSION_LINE.pattern)
#: A mark has fewer bytes than this.
MARK_BYTES = 16
#: The content of a gzip member of up to so many bytes is inflated once and held; a longer one is inflated again as it is read.
HELD_BYTES = 16 << 20
#: A longer block is more than a row can hold, so its record is set aside.
BLOCK_BYTES = 1 << 30
#: A gzip header ends, and content begins, within so many bytes.
GZIP_HEADER = 4 << 10
#: Files are read in pieces of so many bytes.
PIECE_BYTES = 4 << 20
RECORD_ID = "urn:episodelake:page:"
DATE = "2020-01-01T00:00:00Z"


# --- records ---------------------------------------------------------------


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class Item:
    """What lies at [start, end) of a file: a record, or a gap with the reason why it was set aside.

    Inside a gzip member of several records ``inside`` is the place in its
    content. ``end`` is -1 for a record found in a damaged member.
    """

    start: int
    end: int
    headers: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""
    inside: int = -1


class Rejected(ValueError):
    """A failed check, and the place from which the search for the next mark goes on."""

    def __init__(self, reason: str, resume: int):
        super().__init__(reason)
        self.resume = resume


class Source:
    """Bytes of known size behind ``read(start, end)``, with the last piece that was read at hand."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size, self.start, self.held = read, size, 0, b""

    def window(self, start: int, end: int) -> int:
        """Has [start, end) at hand, as far as it exists; where ``start`` is in ``held``."""
        end = min(end, self.size)
        if start < self.start or end > self.start + len(self.held):
            self.start, self.held = start, self.read(start, min(self.size, max(end, start + PIECE_BYTES)))
        return start - self.start

    def get(self, start: int, end: int) -> bytes:
        at = self.window(start, end)
        return self.held[at : at + end - start]

    def peek(self, start: int, end: int) -> bytes:
        """A few bytes, wherever they are, without another piece at hand."""
        return self.get(start, end) if self.start <= start and end <= self.start + len(self.held) else self.read(start, min(end, self.size))

    def mark(self, at: int, marks: re.Pattern[bytes]) -> int:
        """The next place from ``at`` on that looks like a gzip member or a version line, or the end."""
        while at < self.size:
            found = marks.search(self.held, self.window(at, at + MARK_BYTES))
            if found:
                return self.start + found.start()
            at = max(at + 1, self.start + len(self.held) - MARK_BYTES)
        return self.size

    def at_mark(self, at: int) -> bool:
        return at >= self.size or MARKS.match(self.peek(at, at + MARK_BYTES)) is not None

    def line_end(self, at: int) -> int:
        """Where the line that begins at ``at`` ends, however long it is, or -1."""
        size = MARK_BYTES
        while True:
            first = self.window(at, at + size)
            end = self.held.find(b"\r\n", first)
            if end >= 0:
                return self.start + end
            if self.start + len(self.held) >= self.size:
                return -1
            size = 2 * (len(self.held) - first)

    def forget(self, at: int) -> None:
        """Nothing before ``at`` will be asked for."""


class Inflated(Source):
    """The content of the gzip member at ``at``, of known size, inflated as it is read; holds what has not been forgotten."""

    def __init__(self, packed: Source, at: int, size: int):
        super().__init__(lambda a, b: b"", size)
        self.packed, self.at, self.unzip = packed, at, zlib.decompressobj(31)
        self.held = bytearray()

    def window(self, start: int, end: int) -> int:
        end = min(end, self.size)
        while self.start + len(self.held) < end:
            piece = self.unzip.unconsumed_tail
            if not piece:
                piece = self.packed.get(self.at, self.at + 65536)
                self.at += len(piece)
            try:
                self.held += self.unzip.decompress(piece, 1 << 20)
            except zlib.error:  # the size ends where the fault is
                break
        return start - self.start

    def get(self, start: int, end: int) -> bytes:
        return bytes(super().get(start, end))

    def peek(self, start: int, end: int) -> bytes:
        return self.get(start, end)

    def mark(self, at: int, marks: re.Pattern[bytes]) -> int:
        while at < self.size:
            first = self.window(at, at + 65536)
            found = marks.search(self.held, first)
            if found:
                return self.start + found.start()
            at = max(at + 1, self.start + len(self.held) - MARK_BYTES)
            self.forget(at)
        return self.size

    def forget(self, at: int) -> None:
        if at - self.start > 1 << 20:
            del self.held[: at - self.start]
            self.start = at


def of_bytes(data: bytes) -> Source:
    return Source(lambda a, b: data[a:b], len(data))


def parse_record(data: Source, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at ``at``; Rejected says which check failed.

    A search never comes back to headers that were read: it goes on at the line
    that is none, or behind a whole header block whose record failed, or behind
    the record if its frame leads to another mark. So its work is linear.
    """
    if not VERSION_LINE.match(data.peek(at, at + MARK_BYTES)):
        raise Rejected("no version line", at + 1)
    headers: dict[str, str] = {}
    line = data.line_end(at) + 2
    while True:
        end = data.line_end(line)
        if end < 0:  # no version line, which has an end, can begin behind here
            raise Rejected("headers do not end", line)
        if end == line:
            break
        name, colon, value = data.get(line, end).partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            raise Rejected("malformed header line", line)
        headers[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
        line = end + 2
    start = line + 2
    size = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", size):
        raise Rejected("no content length", start)
    end = start + int(size)
    if int(size) > BLOCK_BYTES:
        raise Rejected("block is too large", start)
    if end + 4 > data.size or data.peek(end, end + 4) != b"\r\n\r\n":
        raise Rejected("content length does not lead to a record's end", start)
    block = data.get(start, end)
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Rejected("block digest differs", end + 4 if data.at_mark(end + 4) else start)
    return headers, block, end + 4


def member_at(data: Source, at: int) -> tuple[Source, int, str]:
    """(content, end, fault) of the gzip member at ``at``; content up to the fault if there is one.

    The member is inflated to its end, so its fault is known before any of its
    records is taken; content of more than HELD_BYTES is not kept meanwhile. Its
    header ends within GZIP_HEADER bytes, which a false mark's may not.
    """
    unzip, parts, size, end, fault = zlib.decompressobj(31), [], 0, at, ""
    try:
        while not unzip.eof and not fault:
            piece = data.get(end, end + (65536 if size else GZIP_HEADER))
            if not piece or (end > at and not size):
                fault = "gzip member does not end"
            end += len(piece)
            while piece and not unzip.eof:
                parts.append(unzip.decompress(piece, 1 << 20))
                size += len(parts[-1])
                piece = unzip.unconsumed_tail
                if size > HELD_BYTES:
                    parts.clear()
    except zlib.error as e:
        fault = f"bad gzip member: {e}"
    content = of_bytes(b"".join(parts)) if size <= HELD_BYTES else Inflated(data, at, size)
    return content, end - len(unzip.unused_data) * (not fault), fault or ("" if size else "empty gzip member")


def salvage(data: bytes | Source, packed: bool = True) -> Iterator[Item]:
    """All good records of a file, compressed or plain, and its gaps.

    After a failed check the search goes on for the next gzip member or version
    line at which a whole record passes all checks; the bytes between are a gap.
    The same search runs over the content of a gzip member, so one bad record
    does not cost the others; of a damaged member only records that carry a
    digest and pass it are taken, and the search goes on for the next member.
    """
    data = data if isinstance(data, Source) else of_bytes(data)
    at, bad, reason, marks = 0, None, "", MARKS
    while at < data.size:
        data.forget(at)
        try:
            if packed and data.get(at, at + 3) == MAGIC:
                content, end, fault = member_at(data, at)
                if fault:
                    marks = MEMBER if content.peek(0, 7) == b"WARC/1." else marks
                    for x in salvage(content, packed=False):
                        if x.headers is not None and x.headers.get("warc-block-digest", "").startswith("sha256:"):
                            yield Item(at, -1, x.headers, x.block, inside=x.start)
                    raise Rejected(fault, at + 1)
                # what stands alone in its member has no place inside; a lone gap means that nothing in it is good
                inner = salvage(content, packed=False)
                first, second = next(inner), next(inner, None)
                if second is None and first.headers is None:
                    raise Rejected(first.reason, end if data.at_mark(end) else at + 1)
                several = chain([first, second], inner) if second else [first]
                found = (Item(at, end, x.headers, x.block, x.reason, x.start if second else -1) for x in several)
            else:
                headers, block, end = parse_record(data, at)
                found = [Item(at, end, headers, block)]
        except Rejected as e:
            if bad is None:
                bad, reason = at, str(e)
            at = data.mark(max(at + 1, e.resume), marks)
            continue
        if bad is not None:
            yield Item(bad, at, reason=reason)
            bad = None
        yield from found
        at, marks = end, MARKS
    if bad is not None:
        yield Item(bad, data.size, reason=reason)


# --- Spark -----------------------------------------------------------------


def plan_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((page_id, sha, refers_to) of pages that revisit another, (page_id, sha) of responses that stand in several rows), each once.

    Of equal payloads of LEAST_REVISIT bytes or more the smallest page_id is
    the response, the others revisit it, those without an id too; if none of
    them has an id, all are responses.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digests = written(pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("sha")))
    large = digests.where(F.col("payload_bytes") >= LEAST_REVISIT)
    groups = written(large.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first_id is not null"))
    found = attach_groups(large, groups, "sha", "copies", max(1, digests.count())).where("first_id is not null")
    per_id = found.groupBy("page_id", "sha").agg(F.first("first_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    per_id = written(per_id.withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first_id"))))
    return per_id.where("not is_first").select("page_id", "sha", F.col("first_id").alias("refers_to")), per_id.where("is_first and n > 1").select("page_id", "sha")


def responses_once(rows: DataFrame) -> DataFrame:
    """Of the equal payloads that one page_id has in several rows, the row of the least url stays a response, all others revisit it."""
    url = F.struct(F.col("url").isNull().alias("none"), "url")
    first = rows.groupBy("page_id", "sha").agg(F.min(url).alias("u"), F.first("payload").alias("payload"), F.first("size").alias("size")).withColumns({"url": F.col("u.url"), "refers_to": F.lit(None).cast(rows.schema["page_id"].dataType)})
    counts = rows.groupBy("page_id", "sha", "url").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    same = counts["page_id"].eqNullSafe(first["page_id"]) & (counts["sha"] == first["sha"]) & counts["url"].eqNullSafe(first["url"])
    rest = counts.join(first.select("page_id", "sha", "url", F.lit(1).alias("taken")), same, "left").select(*[counts[c] for c in counts.columns], "taken")
    # very many equal rows are dealt out again
    again = rest.withColumn("i", F.explode(F.expr("sequence(1, n)"))).where("i > coalesce(taken, 0)").repartition("i")
    columns = ["page_id", "url", "payload", "size", "sha", "refers_to"]
    return first.select(columns).unionByName(again.withColumns({"payload": F.lit(None).cast("binary"), "refers_to": F.col("page_id")}).select(columns))


def write_warc(pages: DataFrame, path: str) -> DataFrame:
    """Writes a gzip member for each row of (page_id, url, html) to files under ``path``; (file, records) of those written.

    ``path`` is on a file system that all executors reach through pyarrow. A
    task writes files of new names and returns them when they are closed, so a
    lost or repeated task leaves no half archive among the returned ones.
    """
    columns = [F.col("page_id"), (F.col("url") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")]
    slim = pages.select(*columns).withColumn("sha", F.sha2("payload", 256))
    revisits, repeated = plan_records(pages)
    # the payloads stay where they are while the revisits are few; beyond that both sides are shuffled
    few = revisits.count() <= BROADCAST_ROWS
    other = revisits.select(F.col("page_id").alias("revisit_id"), F.col("sha").alias("revisit_sha"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("sha") == F.col("revisit_sha"))
    rows = slim.join(F.broadcast(other) if few else other, same, "left").select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"), "sha", "refers_to"
    )
    if not repeated.isEmpty():
        several = near(repeated)
        rows = rows.join(several, ["page_id", "sha"], "left_anti").select(rows.columns).unionByName(responses_once(rows.join(several, ["page_id", "sha"], "left_semi")).select(rows.columns))

    def saved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(top)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"{top}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                member = gzip.compress(page_record(row), 4, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["file", "records"])

    return rows.mapInArrow(saved, "file string, records long")


def page_record(row: dict) -> bytes:
    """The WARC record of one page; a null payload makes it a revisit without a block."""
    block = row["payload"] or b""
    headers = [
        ("WARC-Type", "revisit" if row["refers_to"] is not None else "response"),
        ("WARC-Record-ID", f"<{RECORD_ID}{'' if row['page_id'] is None else row['page_id']}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "about:blank")),
        ("WARC-Payload-Digest", f"sha256:{row['sha']}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Length", str(row["size"])),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if row["refers_to"] is not None:
        headers += [("WARC-Refers-To", f"<{RECORD_ID}{row['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record(headers, block)


def open_source(path: str) -> Source:
    """A file of the shared store, read piece by piece."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    file = store.open_input_file(name)
    return Source(lambda a, b: file.read_at(b - a, a), file.size())


def read_warc(spark: SparkSession, files: str | list[str], payloads: bool = True, through_spark: bool = False) -> DataFrame:
    """Records and gaps of archive files.

    A task lists files by Spark and reads each through pyarrow, piece by piece,
    so a file may have any size and only one record is in memory at a time. A
    file is read from its start: where a reader begins in the middle, a record
    within a payload looks like one of the archive. For a store that pyarrow
    does not know, ``through_spark`` takes whole files (up to 2 GB) from Spark.

    Columns: file, start, end (bytes; of the gzip member; end is null for a
    record found in a damaged member, which lies in a gap), inside (place in a
    member that holds several things), kind ('record' or 'gap'), reason (of a
    gap), record_type, record_id, target_uri, payload_digest, payload_length,
    refers_to, payload (null for gaps, or without ``payloads``), payload_ok (the
    block has the payload's digest; null for revisits and gaps).
    """
    schema = (
        "file string, start long, end long, inside long, kind string, reason string, record_type string, record_id string, target_uri string, payload_digest string, "
        "payload_length long, refers_to string, payload binary, payload_ok boolean"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def row(path: str, x: Item) -> tuple:
        h = x.headers or {}
        digest, kind = h.get("warc-payload-digest", "").removeprefix("sha256:"), h.get("warc-type")
        full = x.headers is not None and kind != "revisit"
        length = h.get("warc-payload-length", "")
        return (
            path, x.start, x.end if x.end >= 0 else None, x.inside if x.inside >= 0 else None, "gap" if x.headers is None else "record", x.reason or None, kind, h.get("warc-record-id"),
            h.get("warc-target-uri"), digest or None, int(length) if length.isdigit() else len(x.block) if full else None, h.get("warc-refers-to"), x.block if full and payloads else None,
            (hashlib.sha256(x.block).hexdigest() == digest) if full and digest else None,
        )

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(dict.fromkeys(("end", "inside", "payload_length"), "Int64"))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, path in enumerate(batch["path"]):
                rows, size = [], 0
                for x in salvage(batch["content"][k] if through_spark else open_source(path)):
                    rows.append(row(path, x))
                    size += len(rows[-1][-2] or b"") + 500
                    if size >= PIECE_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                yield table(rows)

    return spark.read.format("binaryFile").load(files).select("path", *["content"] * through_spark).mapInPandas(parsed, schema)


def read_back(spark: SparkSession, top: str, closed: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the closed archives (file, records) under ``top``, complete or an error.

    The folder may hold files of tasks that were lost or ran twice; only
    returned ones count. Gaps and payloads of a wrong digest are written to the
    table ``<top>-gaps``; if there are any, or an archive gives another number
    of records than was written to it, ValueError names that table.
    """
    name = F.regexp_extract("file", "([^/]+)$", 1).alias("name")
    files = near(closed.select(name, F.col("records").alias("expected")))
    found = written(read_warc(spark, top, payloads).withColumn("name", name).join(files, "name", "left_semi"))
    lost = found.where("kind = 'gap' or not coalesce(payload_ok, true)").drop("payload")
    counts = found.where("kind = 'record'").groupBy("name").agg(F.count(F.lit(1)).alias("got"))
    short = files.join(counts, "name", "left").where("coalesce(got, 0) <> expected").count()
    if short or not lost.isEmpty():
        lost.write.parquet(f"{top}-gaps")
        raise ValueError(f"{short} archives do not hold what was written to them; the gaps are in {top}-gaps")
    return found.where("kind = 'record'")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to archives in the shared folder, reads them back and returns a row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to,
    target_uri. Null payloads are empty; a null page_id gives a record without
    id; rows that repeat a page_id are records of their own, and if that id is a
    payload's smallest, the row of the least url is the one response.
    An empty table gives no rows; a damaged archive is an error (``read_back``).
    """
    spark = pages.sparkSession
    top = shared_dir(spark)
    kind = dict(pages.dtypes)["page_id"]
    closed = written(write_warc(pages, top))
    if closed.isEmpty():
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, target_uri string")
    records = read_back(spark, top, closed)
    number = lambda c: F.nullif(F.regexp_extract(c, f"<{RECORD_ID}(.*)>", 1), F.lit("")).cast(kind)
    return records.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "target_uri"
    )
