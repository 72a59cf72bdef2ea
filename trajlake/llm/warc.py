"""WARC archives with a two-level capture index: compressed blocks of sorted keys under a sparse directory."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmap, bitmap_marked, bitmap_slot, fresh_path, map_batches, release, written

DATE = "2024-01-01T00:00:00Z"
REVISIT_FROM = 1000
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share; a bare path is local."""
    return pafs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (pafs.LocalFileSystem(), uri)


def surt(url: str | None) -> str:
    """The sort key of a capture: host reversed by its labels, then path and query; empty for a null or empty URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02x}", key + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the HTTP header, and with it the payload's length, but no payload."""
    name = "" if page_id is None else page_id
    target = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{sha1}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record; ValueError if it is cut off or malformed."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _packed(data: bytes, level: int = 3) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


class _Ranges:
    """Range reads with a bounded number of open files."""

    def __init__(self, most: int = 32):
        self.most, self.open = most, OrderedDict()

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            fs, path = open_store(uri)
            self.open[uri] = fs.open_input_file(path)
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        return self.open[uri].read_at(length, offset)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row to gzip-member archives under ``folder``; rows (key, page_id, file, offset, length).

    Of rows with equal payloads of at least 1000 bytes the one with the largest id is the response and the others revisit
    it; smaller payloads are all responses. Null payloads count as empty. Rows that repeat an id are each written; where
    such rows share the largest id of a group, each is a response. A null id never is the one referred to unless all are
    null, and then all are responses. A null URL has an empty key. Each task attempt writes files of its own name, so a lost or repeated
    attempt leaves unreferenced files, never wrong ones.
    """
    base = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("_payload"))
    base = base.withColumns({"_sha1": F.sha1("_payload"), "_size": F.octet_length("_payload").cast("long")})
    sized = base.where(F.col("_size") >= REVISIT_FROM).groupBy("_sha1").agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    groups = written(sized.where("_n > 1 and _top is not null").select(F.col("_sha1").alias("_gsha1"), "_top"), "warc-groups")
    # Two bitmaps of fixed size say which rows may belong to a group and which may be its response. Payloads of the latter only
    # take part in the join: revisits need none. A row of no group that both take wrongly is read again by itself.
    of_group, of_top = bitmap_slot(F.xxhash64("_sha1"), BITMAP_BITS), bitmap_slot(F.xxhash64("_sha1", "_id"), BITMAP_BITS)
    tops = groups.select(F.col("_gsha1").alias("_sha1"), F.col("_top").alias("_id"))
    grouped = F.col("_grouped") & (F.col("_size") >= REVISIT_FROM)
    told = bitmap_marked(bitmap_marked(base, bitmap(tops, of_group), of_group, "_grouped"), bitmap(tops, of_top), of_top, "_maybe_top")
    alone = told.where(~grouped).select("_id", "_url", "_payload", "_size", "_sha1", F.lit(None).cast("long").alias("_refers"), F.lit(False).alias("_lost"))
    joined = told.where(grouped).withColumn("_payload", F.when(F.col("_maybe_top"), F.col("_payload"))).join(groups, F.col("_sha1") == F.col("_gsha1"), "left")
    refers = F.when(~F.col("_id").eqNullSafe(F.col("_top")), F.col("_top"))
    joined = joined.select("_id", "_url", "_payload", "_size", "_sha1", refers.alias("_refers"), (F.col("_top").isNull() & F.col("_payload").isNull()).alias("_lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        out, name, at, made = None, "", 0, 0
        for batch in batches:
            rows = []
            for page, url, payload, size, sha1, refers_to, lost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lost:
                    rows.append((None, page, None, None, None, sha1))
                    continue
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at, made = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{made}.warc.gz", 0, made + 1
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = _packed(record(page, url, payload, size, sha1, refers_to))
                out.write(data)
                rows.append((surt(url), page, f"{folder}/{name}", at, len(data), None))
                at += len(data)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["key", "page_id", "file", "offset", "length", "lost"])
        if out is not None:
            out.close()

    schema = "key string, page_id long, file string, offset long, length long, lost string"
    captures = written(alone.unionByName(joined).transform(map_batches, run, schema), "warc-captures")
    release(groups)
    lost = captures.where("lost is not null").select("page_id", "lost").distinct()
    captures = captures.where("lost is null").drop("lost")
    if lost.isEmpty():
        return captures
    of_lost = lost.select(F.col("lost").alias("_sha1"), F.col("page_id").alias("_id"))
    near = bitmap_marked(base, bitmap(of_lost, of_top), of_top, "_near").where("_near")
    again = near.join(lost, (F.col("_sha1") == F.col("lost")) & F.col("_id").eqNullSafe(F.col("page_id")), "left_semi")
    again = again.select("_id", "_url", "_payload", "_size", "_sha1", F.lit(None).cast("long").alias("_refers"), F.lit(False).alias("_lost"))
    return captures.unionByName(written(again.transform(map_batches, run, schema), "warc-captures").drop("lost"))


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures by key, write them as compressed blocks under ``folder``; the sparse directory, a row per block.

    Lines are ``key page_id file offset length``, tab-separated. Ranges of (key, page_id) are dealt out, so a host with a
    third of all pages is split. Each index file ends with its own sparse directory, a compressed block of ``first_key last_key
    offset length lines``. Directory rows, one for each file: first_key, last_key, file, offset, length (of that block), lines.
    """
    keyed = captures.repartitionByRange(F.col("key"), F.col("page_id"), F.col("offset")).sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        name, at, out, blocks, lines = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.cdx.gz", 0, None, [], []

        def close_block() -> None:
            nonlocal at, out
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            data = _packed("\n".join("\t".join(x) for x in lines).encode(), 6)
            out.write(data)
            blocks.append((lines[0][0], lines[-1][0], str(at), str(len(data)), str(len(lines))))
            at += len(data)
            lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
                lines.append(["" if x is None else str(x) for x in row])
                if len(lines) == block_lines:
                    close_block()
        if lines:
            close_block()
        if out is not None:
            data = _packed("\n".join("\t".join(x) for x in blocks).encode(), 6)
            out.write(data)
            out.close()
            row = (blocks[0][0], blocks[-1][1], f"{folder}/{name}", at, len(data), sum(int(x[4]) for x in blocks))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], ["first_key", "last_key", "file", "offset", "length", "lines"])

    return written(keyed.transform(map_batches, run, "first_key string, last_key string, file string, offset long, length long, lines long"), "warc-directory")


def _lines(ranges: _Ranges, file: str, offset: int, length: int) -> list[list[str]]:
    return [x.split("\t") for x in _unpacked(ranges.read(file, offset, length)).decode().split("\n")]


class CaptureIndex:
    """Look-ups: bisect the list of index files (a row for each task that wrote the index), read the sparse directory of the
    file and bisect it, range-read the block that can hold the key, range-read the record.

    Directories and blocks that were read last are kept, so look-ups in the order of keys read each of them once.
    """

    def __init__(self, directory: list[tuple], kept: int = 4):
        self.rows = sorted((tuple(r) for r in directory), key=lambda r: (r[0], r[1]))
        self.last, self.ranges, self.kept = [r[1] for r in self.rows], _Ranges(), kept
        self.directories: OrderedDict[str, tuple[list, list]] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], dict[str, list]] = OrderedDict()

    def _directory(self, file: str, offset: int, length: int) -> tuple[list, list]:
        if file not in self.directories:
            rows = [(a, b, int(c), int(d)) for a, b, c, d, _ in _lines(self.ranges, file, offset, length)]
            self.directories[file] = (rows, [r[1] for r in rows])
            if len(self.directories) > self.kept:
                self.directories.popitem(last=False)
        return self.directories[file]

    def _block(self, file: str, offset: int, length: int) -> dict[str, list]:
        if (file, offset) not in self.blocks:
            by_key: dict[str, list] = {}
            for key, page, where, at, n in _lines(self.ranges, file, offset, length):
                by_key.setdefault(key, []).append((int(page) if page else None, where, int(at), int(n)))
            self.blocks[file, offset] = by_key
            if len(self.blocks) > self.kept:
                self.blocks.popitem(last=False)
        return self.blocks[file, offset]

    def captures(self, key: str, page_id: int | None = None, any_page: bool = True) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the records under a SURT key, of all pages or of one."""
        found = []
        for first, _, file, offset, length, _ in self.rows[bisect.bisect_left(self.last, key) :]:
            if first > key:
                break
            rows, last = self._directory(file, offset, length)
            for begin, _, at, n in rows[bisect.bisect_left(last, key) :]:
                if begin > key:
                    break
                found += [x[1:] for x in self._block(file, at, n).get(key, ()) if any_page or x[0] == page_id]
        return found

    def fetch(self, url: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
        return [parse(_unpacked(self.ranges.read(*x))) for x in self.captures(surt(url))]


def _ranges_of(found: list[tuple], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple]]]:
    """(file, offset, length, look-ups) of reads that join records of a file at most ``gap`` bytes apart, to ``most`` bytes."""
    own: list[tuple] = []
    begin = end = 0
    for x in sorted(found, key=lambda x: x[:2]):
        if own and (x[0] != own[0][0] or x[1] > end + gap or x[1] + x[2] - begin > most):
            yield own[0][0], begin, end - begin, own
            own = []
        if not own:
            begin = end = x[1]
        own.append(x)
        end = max(end, x[1] + x[2])
    if own:
        yield own[0][0], begin, end - begin, own


def look_up(directory: DataFrame, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url", keep_payload: bool = False, at_once: int = 4000, gap: int = 1 << 14) -> DataFrame:
    """For each row of ``wanted`` (id, URL) the records that the index holds of that page under that URL's key, read back from the archives: page_id,
    url, payload_bytes, payload_digest, record_type, refers_to, valid (a response's payload has the digest and length that its
    headers state), payload if asked for.

    Rows are sorted by key and looked up by bisection; the records of ``at_once`` look-ups are read in the order in which they
    lie, near ones together. Rows that repeat an id and a URL find all such captures each, once only if asked for once. Null ids
    and URLs find captures of null ids and URLs. What the index does not hold gives no row.
    """
    spark = directory.sparkSession
    rows_of = [tuple(r) for r in directory.toLocalIterator()]  # a row for each task that wrote the index
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean, payload binary"
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(rows_of)
        for batch in batches:
            asked = list(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True))
            for i in range(0, len(asked), at_once):
                found = [x for key, page in asked[i : i + at_once] for x in index.captures(key, page, False)]
                rows, size = [], 0
                for file, offset, length, own in _ranges_of(found, gap, 1 << 23):
                    data = index.ranges.read(file, offset, length)
                    for _, at, n in own:
                        fields, http, payload = parse(_unpacked(data[at - offset : at - offset + n]))
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        told, kind = int(http["Content-Length"]), fields["WARC-Type"]
                        valid = kind == "revisit" and not payload or hashlib.sha1(payload).hexdigest() == digest and len(payload) == told
                        page, to = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To", "")[10:-1]
                        rows.append((int(page) if page else None, fields.get("WARC-Target-URI"), told, digest, kind, int(to) if to else None, valid, payload if keep_payload else None))
                        size += len(payload) if keep_payload else 0
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(surt, batch.column(1).to_pylist()), pa.string()), batch.column(0)], ["key", "id"])

    keyed = wanted.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).transform(map_batches, key, "key string, id long").distinct()
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = keyed.repartitionByRange(tasks, "key", "id").sortWithinPartitions("key", "id").transform(map_batches, run, schema)
    return out if keep_payload else out.drop("payload")


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write and index archives in a folder of the shared store (a new one by default); the index's directory."""
    folder = folder or fresh_path(spark, "warc")
    return build_index(write_archives(pages, f"{folder}/archive", **columns), f"{folder}/index")
