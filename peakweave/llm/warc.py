"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The reader checks every record (gzip checksum, version line, lengths, digests of known algorithms).
After a failed check it searches for the next place where a whole record passes, goes on there, and logs
the bytes between as a quarantined gap. The same search goes through gzip members that hold more than one
record. A large plain archive is read by many tasks: a walk over its headers finds where records begin,
so a record quoted in a payload is not taken for one. A gzip archive is read by one task, unless the
caller knows that it quotes no gzip members.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import folder

SPLIT = 32 << 20  #: bytes of a plain archive that one task reads
STEP = 1 << 20  #: bytes read at once
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_END = b"\r\n\r\n"
_HELD = 32 << 20  #: a gzip member that is larger, packed or inflated, is inflated twice instead of held
_PIECE = 1 << 16  #: bytes of a gzip member inflated at once
_DIGESTS = ("sha1", "sha256", "sha512", "sha384", "sha224", "md5")

RECORD_SCHEMA = "file string, offset bigint, length bigint, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, quarantined string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, ident: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of the full payload and no body."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{ident}>"), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + _END


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, path: str, *, ident: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0, compress: bool = True, file_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row under path (a folder all executors share); returns the manifest: file, records, bytes.

    Of records with equal payloads of at least least_bytes bytes, the one with the largest identifier is
    the response and the others revisit it; equal (payload, identifier) rows count as equal identifiers,
    of which each is a response. A null payload is empty, a null url too. Tasks write under a temporary
    name and rename, and their names depend on the partition alone; a task that is run again first deletes
    what it wrote. path must be one that pyarrow's filesystems open too (local, HDFS, S3, GCS). An empty
    table makes an empty folder; other columns are ignored.
    """
    spark = pages.sparkSession
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(home)
    col = lambda c: F.col(f"`{c}`")
    body = F.encode(F.coalesce(col(payload), F.lit("")), "UTF-8") if dict(pages.dtypes)[payload] == "string" else F.coalesce(col(payload), F.lit(b""))
    rows = pages.select(col(ident).alias("id"), F.coalesce(col(uri), F.lit("")).alias("uri"), body.alias("payload")).withColumn("sha1", F.sha1("payload"))
    keep = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("id").alias("keep"))
    joined = rows.join(keep, "sha1", "left").withColumn("keep", F.when((F.octet_length("payload") >= least_bytes) & (F.col("id") < F.col("keep")), F.col("keep")).otherwise(F.lit(None)))
    joined = joined.select(F.col("id").cast("string").alias("id"), "uri", "payload", F.col("keep").cast("string").alias("keep"))
    suffix = ".warc.gz" if compress else ".warc"

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = _filesystem(path)
        from pyarrow import fs

        for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if old.base_name.startswith(f"part-{part:05d}-"):
                store.delete_file(old.path)
        out, name, done, n, size, number = None, "", [], 0, 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            final = f"{root}/part-{part:05d}-{number:04d}{suffix}"
            store.move(name, final)
            done.append((final, n, size))
            out = None

        for frame in frames:
            for i, u, p, k in zip(frame["id"], frame["uri"], frame["payload"], frame["keep"], strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, n, size = f"{root}/.writing-{uuid.uuid4().hex}", 0, 0
                    out = store.open_output_stream(name)
                revisit = k is not None and k == k
                data = record("revisit" if revisit else "response", str(i), u, p, digest32(p), k if revisit else None)
                data = gzip_member(data) if compress else data
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    close()
                    number += 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    manifest = joined.mapInPandas(write, "file string, records bigint, bytes bigint")
    at = folder(spark, "warc-manifest")
    manifest.write.parquet(at)
    return spark.read.schema(manifest.schema).parquet(at)


class _Window:
    """A file seen through a sliding buffer; memory holds what lies between the current record and the read position."""

    def __init__(self, handle, size: int, at: int):
        self.handle, self.size, self.base, self.data = handle, size, at, bytearray()

    def upto(self, stop: int) -> bytearray:
        """Bytes from base to at least stop, or the end of the file."""
        while self.base + len(self.data) < min(stop, self.size):
            self.handle.seek(self.base + len(self.data))
            more = self.handle.read(max(STEP, min(stop, self.size) - self.base - len(self.data)))
            if not more:
                break
            self.data += more
        return self.data

    def drop(self, to: int) -> None:
        """Let base be `to`; a place before it is read again."""
        if to < self.base:
            self.data.clear()
        del self.data[: to - self.base]
        self.base = to


class _Stream:
    """Pieces of bytes as a file that is read once from its start."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces = pieces

    def seek(self, at: int) -> None:
        pass

    def read(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n and (piece := next(self.pieces, None)) is not None:
            out += piece
        return bytes(out)


class _Bad(Exception):
    pass


def _digest_holds(stated: str, data: bytes) -> bool | None:
    """Whether data has the stated digest, in base 32, hex or base 64; None where none of a known algorithm is stated."""
    name, sep, value = stated.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip().rstrip("=")
    if not sep or name not in _DIGESTS:
        return None
    found = hashlib.new(name, data).digest()
    return value.upper() == base64.b32encode(found).decode().rstrip("=") or value.lower() == found.hex() or value == base64.b64encode(found).decode().rstrip("=")


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message, of other blocks all."""
    kind = fields.get("content-type", "application/http" if block.startswith(b"HTTP/") else "")
    return block.partition(_END)[2] if kind.lower().startswith("application/http") else block


def _unchunked(block: bytes) -> bytes | None:
    """The body of an HTTP message in chunks, put together; None where it isn't one."""
    head, _, body = block.partition(_END)
    if not re.search(rb"(?im)^transfer-encoding:.*chunked", head):
        return None
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at):
        if not (n := int(m[1], 16)):
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n + 2
    return None


def _payload_holds(fields: dict[str, str], block: bytes) -> bool | None:
    """Whether the payload has its digest; None where the record states none, or one of bytes that it doesn't hold."""
    if fields.get("warc-type") in ("revisit", "continuation") or "warc-truncated" in fields or "warc-segment-number" in fields:
        return None
    stated = fields.get("warc-payload-digest", "")
    holds = _digest_holds(stated, _payload(fields, block))
    if holds is False and (body := _unchunked(block)) is not None:
        holds = _digest_holds(stated, body)
    return holds


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one whole record; _Bad says which check failed."""
    if not data.startswith(_VERSION):
        raise _Bad("no version line")
    if (end := data.find(_END) + 4) < 4:
        raise _Bad("header without end")
    fields, k = {}, b""
    for line in data[: end - 4].split(b"\r\n")[1:]:
        if k and line[:1] in (b" ", b"\t"):
            fields[k] += " " + line.strip().decode("utf-8", "replace")
            continue
        k, sep, v = line.partition(b":")
        if not sep:
            raise _Bad("malformed header line")
        k = k.strip().lower().decode("latin-1")
        fields[k] = v.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal():
        raise _Bad("no content length")
    block = data[end : end + int(fields["content-length"])]
    if data[end + int(fields["content-length"]) :] != _END:
        raise _Bad("length differs from content length")
    if _digest_holds(fields.get("warc-block-digest", ""), block) is False:
        raise _Bad("block digest differs")
    return fields, block


def _inflated(window: _Window, at: int, end: list) -> Iterator[bytes]:
    """Pieces of the gzip member at `at`; then the offset after it and what is wrong with it go to end."""
    z, pos, wrong = zlib.decompressobj(31), at, ""
    while not z.eof and not wrong:
        if pos - at > _HELD:
            window.drop(pos)
        chunk = bytes(window.upto(pos + _PIECE)[pos - window.base : pos - window.base + _PIECE])
        pos += len(chunk)
        if not chunk:
            yield z.flush()
            wrong = "" if z.eof else "cut off"
        while chunk and not z.eof:
            before = z.copy()
            try:
                piece = z.decompress(chunk, STEP)
            except zlib.error as e:
                wrong, piece = "gzip: " + str(e)[:60], _sound(before, chunk)
            yield piece
            chunk = b"" if wrong else z.unconsumed_tail
    end += [pos - len(z.unused_data), wrong]


def _sound(z, chunk: bytes) -> bytes:
    """What z inflates of chunk before it fails."""
    out = []
    try:
        for i in range(len(chunk)):
            out.append(z.decompress(chunk[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _member(window: _Window, at: int) -> tuple[Iterator[tuple[dict | None, bytes, str]], int, str]:
    """Records and gaps in the gzip member at `at`, the offset after it, and what is wrong with the member.

    Of a member whose gzip data fail, only records that a digest confirms are returned, of one that is cut
    off all whole records.
    """
    if window.upto(at + 3)[at - window.base : at - window.base + 3] != _MAGIC:
        raise _Bad("no gzip header")
    out, total, end = [], 0, []
    for piece in _inflated(window, at, end):
        total += len(piece)
        if total <= _HELD:
            out.append(piece)
        else:
            out.clear()
    after, wrong = end
    source = io.BytesIO(b"".join(out)) if total <= _HELD else _Stream(_inflated(_Window(window.handle, window.size, at), at, []))

    def rows() -> Iterator[tuple[dict | None, bytes, str]]:
        for offset, n, fields, block, why in read_range(source, total, 0, total, False):
            if fields is None:
                if not wrong:
                    yield None, b"", why if n == total else f"bytes {offset} to {offset + n} of the inflated member: {why}"
            elif wrong in ("", "cut off") or _digest_holds(fields.get("warc-block-digest", ""), block) or _payload_holds(fields, block):
                yield fields, block, ""

    found, held = rows(), []
    for row in found:
        held.append(row)
        if row[0] is not None:
            return itertools.chain(held, found), after, wrong
    raise _Bad(wrong or (held[0][2] if held else "no version line"))


def _plain(window: _Window, at: int) -> tuple[Iterator[tuple[dict | None, bytes, str]], int, str]:
    """The uncompressed record at `at` and the offset after it."""
    stop, seen = at + _PIECE, 0
    while True:
        data, first = window.upto(stop), at - window.base
        if not re.compile(rb"WARC/1\.\d+[ \t]*\r\n").match(data, first):
            raise _Bad("no version line")
        if (end := data.find(_END, first + seen)) >= 0:
            break
        if window.base + len(data) >= window.size:
            raise _Bad("header without end")
        lines = bytes(data[first + seen :]).split(b"\r\n")[1:-1]
        if any(b":" not in line and line[:1] not in (b" ", b"\t") for line in lines):
            raise _Bad("malformed header line")
        seen, stop = max(seen, data.rfind(b"\r\n", first) - first), max(stop + STEP, at + 2 * (stop - at))
    found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", bytes(data[first:end]).replace(b"\r\n", b"\n"))
    if not found:
        raise _Bad("no content length")
    total = end + 4 - first + int(found[1]) + 4
    if at + total > window.size:
        raise _Bad("cut off")
    fields, block = _parse(bytes(window.upto(at + total)[first : first + total]))
    return iter([(fields, block, "")]), at + total, ""


def read_range(handle, size: int, start: int, stop: int, compressed: bool) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """(offset, length, fields, block, "") of records that begin in start .. stop-1; damage gives (offset, length, None, b"", reason).

    A gap is logged by the range in which the record before it begins (the first range for a gap at the
    file's start), so the ranges of a file together tell every byte once. A later range first searches
    silently for a record of its own. Records of one gzip member have its offset; the first has its length,
    the others 0. Records saved from a member that fails have length 0, and the member is logged as a gap.
    """
    take, mark = (_member, _MAGIC) if compressed else (_plain, _VERSION)
    window, at, reason = _Window(handle, size, start), start, ""
    ended = None if start else 0  # where the last own record ended
    while at < size:
        try:
            records, after, wrong = take(window, at)
        except _Bad as e:
            if ended is None and at >= stop:
                return
            if ended == at:
                reason = str(e)
            at = _next_mark(window, at, mark)
            continue
        if ended is not None and ended < at:
            yield ended, at - ended, None, b"", reason
        if at >= stop:
            return
        n = 0 if wrong else after - at
        for fields, block, why in records:
            yield at, n, fields, block, why
            n = 0
        if wrong:
            ended, reason = at, wrong
            at = _next_mark(window, at, mark)
        else:
            at = ended = after
            window.drop(at)
    if ended is not None and ended < size:
        yield ended, size - ended, None, b"", reason


def _next_mark(window: _Window, at: int, mark: bytes) -> int:
    """Offset of the next mark after `at`, or the file's end."""
    at += 1
    while True:
        window.drop(at)
        found = window.upto(at + STEP).find(mark, at - window.base)
        if found >= 0:
            return window.base + found
        end = window.base + len(window.data)
        if end >= window.size:
            return window.size
        at = max(at, end - len(mark) + 1)


def record_starts(handle, size: int, split: int) -> list[int]:
    """Where tasks may begin to read a plain archive: 0, and the first record that begins in each further piece of
    `split` bytes, found by a walk over the headers that skips the blocks. The walk ends at damage, so what follows
    is one task's."""
    window, out, at = _Window(handle, size, 0), [0], 0
    while at < size:
        window.drop(at)
        seen = 0
        while (end := window.data.find(_END, max(0, seen - 3))) < 0 and at + len(window.data) < size:
            seen = len(window.data)
            window.upto(at + seen + _PIECE)
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", bytes(window.data[: max(end, 0)]))
        if not window.data.startswith(_VERSION) or end < 0 or not found:
            break
        after = at + end + 4 + int(found[1])
        if after + 4 > size:
            break
        window.drop(after)
        if bytes(window.upto(after + 4)[:4]) != _END:
            break
        at = after + 4
        if at // split > out[-1] // split and at < size:
            out.append(at)
    return out


def read_archives(spark: SparkSession, path: str, *, split_bytes: int = SPLIT, split_gzip: bool = False) -> DataFrame:
    """Records of all .warc and .warc.gz files under path, and the gaps (rows with quarantined set), as RECORD_SCHEMA.

    payload is null for revisits; payload_bytes is then the length their HTTP head states. Spark lists
    the files; tasks open them by byte range and hold one record at a time. Plain archives are split where
    their records begin; gzip archives only with split_gzip, which searches for members and so is for archives
    whose payloads hold no gzip members of records. A folder without archives gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path).select("path", "length")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, length in zip(frame["path"], frame["length"], strict=True):
                if name.endswith(".gz"):
                    starts = list(range(0, max(length, 1), split_bytes)) if split_gzip else [0]
                else:
                    store, inner = _filesystem(name)
                    with store.open_input_file(inner) as handle:
                        starts = record_starts(handle, length, split_bytes)
                yield pd.DataFrame({"path": name, "length": length, "start": starts, "stop": [*starts[1:], length]})

    ranges = files.repartition(parts, "path").mapInPandas(cut, "path string, length bigint, start bigint, stop bigint").repartition(parts, "path", "start")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in RECORD_SCHEMA.split(",")]
        for frame in frames:
            for name, length, start, stop in zip(frame["path"], frame["length"], frame["start"], frame["stop"], strict=True):
                store, inner = _filesystem(name)
                rows, held = [], 0
                with store.open_input_file(inner) as handle:
                    for offset, n, fields, block, why in read_range(handle, length, start, stop, name.endswith(".gz")):
                        rows.append(_row(name, offset, n, fields, block, why))
                        held += len(block) + 200
                        if held > 8 * STEP:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return ranges.mapInPandas(read, RECORD_SCHEMA)


def _row(name: str, offset: int, n: int, fields: dict | None, block: bytes, why: str) -> tuple:
    if fields is None:
        return (name, offset, n, None, None, None, None, None, None, None, why)
    kind = fields.get("warc-type", "")
    revisit = kind == "revisit"
    if _payload_holds(fields, block) is False:
        return (name, offset, n, None, None, None, None, None, None, None, "payload digest differs")
    payload = _payload(fields, block)
    stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", block.partition(_END)[0].replace(b"\r\n", b"\n")) if revisit else None
    digest = fields.get("warc-payload-digest")
    ident = lambda k: (m[1] if (m := re.fullmatch(r"<urn:page:(.*)>", fields.get(k, ""))) else fields.get(k))
    size = int(stated[1]) if stated else len(payload)
    return (name, offset, n, kind, ident("warc-record-id"), fields.get("warc-target-uri"), ident("warc-refers-to"), digest and digest.removeprefix("sha1:"), size, None if revisit else payload, None)


def payload_of(column: Column) -> Column:
    return F.decode(column, "UTF-8")
