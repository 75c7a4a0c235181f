"""WARC archives with a two-level capture index.

Writing: rows with equal payloads are found by digest; the row with the largest ``page_id`` is written as a response
with its payload, the others as revisits that refer to it.  Each task writes one archive of gzip members, one a record,
into the shared folder, and returns a *capture* per record: the key, the archive and the byte range.

Index: captures are dealt by range of their key (the url with its host reversed, then the page) and sorted.  Each task
writes two files: ``.cdx``, the sorted capture lines in compressed blocks of ``BLOCK_LINES``, and ``.idx``, the sparse
directory, one line per block with its first key and byte range.  The list of parts (first key, path) is the only thing
the driver sees: one short row per task.

Reading: a lookup finds the part, then finds the block by binary search over the ``.idx`` file (it reads single lines
at byte offsets, so a directory of any size needs no memory), reads and unpacks that one block, and reads the record's
byte range from the archive.  Lookups are dealt and sorted by key as the index is, so a task reads a block about once.

Files are read and written with ``pyarrow.fs`` by URI, on any store it knows.  A file's name holds a random part, and
only names that a finished task returned are used: a task that is run again leaves an unused file, never a wrong one.

Defined cases: a null html is an empty payload; a null url is kept apart from an empty one; a null ``page_id`` never
counts as the largest unless all in its group are null; rows with equal payload and equal largest ``page_id`` are all
responses; repeated rows get a record each; an empty table gives no archive and no rows; other columns of the input
are not read, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import map_batches, materialise, shared_folder

#: Capture lines in a compressed block of the index.
BLOCK_LINES = 1000
#: Unpacked blocks, and open archives, that a reading task keeps.
KEPT_BLOCKS = 4
#: WARC-Date of every record: the table has no time of capture, and archives of equal rows are then equal.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

CAPTURES = "key string, record string, archive string, offset long, length long"
PARTS = "first_key string, path string, lines long, blocks long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "intact boolean")


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return pyarrow.fs.FileSystem.from_uri(uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: Column) -> Column:
    """The url with scheme and ``www.`` dropped and the host's labels reversed, so that a site's pages lie together."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?is)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)), r"^www\.", "")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    # white space and control characters would break the index's lines
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path),
                            r"[\x00-\x20\x7f]", "_")


def capture_key(url: Column, page_id: Column) -> Column:
    return F.concat_ws(" ", url_key(url), F.coalesce(page_id.cast("string"), F.lit("-")))


def classify(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``page_id, url, html, key, refers_to`` (null for responses).

    The digests of all rows are aggregated first (partially in each task); only groups of more than one row are joined
    back, and adaptive execution splits the join at a payload that very many rows share.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= min_payload
    shared = (rows.where(large).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    newest = F.when(large & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))
    return (rows.join(shared, "digest", "left")
            .select("page_id", "url", "html", capture_key(F.col("url"), F.col("page_id")).alias("key"),
                    newest.alias("refers_to")))


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """(record id, the record).  A revisit keeps digest and length of the payload it leaves out."""
    record = f"urn:uuid:{uuid.uuid4()}"
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if revisit else head + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{record}>", "WARC-Date": DATE,
              "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
              "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body)),
              "Page-Id": json.dumps(page_id)}
    if url is not None:
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if revisit:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>",
                   "Payload-Length": str(len(payload))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return record, b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, payload) of an unpacked record; the payload of a revisit is empty."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Write the archives under ``folder``; the captures, as a table in the shared folder."""
    schema = pa.schema([("key", pa.string()), ("record", pa.string()), ("archive", pa.string()),
                        ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offset, archive = None, 0, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, root = open_store(folder)
                archive = f"part-{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{root}/{archive}", compression=None)
            rows = [[] for _ in schema.names]
            for page_id, url, html, key, refers_to in zip(*(c for c in batch.columns)):
                record, raw = warc_record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())
                packed = gzip.compress(raw, 6, mtime=0)
                out.write(packed)
                for column, x in zip(rows, (key.as_py(), record, archive, offset, len(packed))):
                    column.append(x)
                offset += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
        if out is not None:
            out.close()

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    return materialise(map_batches(classify(pages, min_payload), write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write ``.cdx`` and ``.idx`` files under ``folder``; the parts (first key, path), as a small table."""
    schema = pa.schema([("first_key", pa.string()), ("path", pa.string()), ("lines", pa.int64()),
                        ("blocks", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name = f"part-{uuid.uuid4().hex}"
        cdx = idx = None
        block, first, offset, lines, blocks = [], None, 0, 0, 0

        def flush() -> None:
            nonlocal offset, blocks
            packed = zlib.compress("".join(block).encode(), 6)
            cdx.write(packed)
            idx.write(f"{block[0].split('\t', 1)[0]}\t{offset}\t{len(packed)}\n".encode())
            offset, blocks = offset + len(packed), blocks + 1
            block.clear()

        for batch in batches:
            for key, record, archive, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if cdx is None:
                    cdx, idx = (store.open_output_stream(f"{root}/{name}.{x}", compression=None) for x in ("cdx", "idx"))
                    first = key
                block.append(f"{key}\t{record}\t{archive}\t{at}\t{length}\n")
                lines += 1
                if len(block) >= block_lines:
                    flush()
        if cdx is not None:
            if block:
                flush()
            cdx.close()
            idx.close()
            yield pa.RecordBatch.from_pylist([{"first_key": first, "path": f"{root}/{name}", "lines": lines,
                                               "blocks": blocks}], schema=schema)

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    ordered = captures.repartitionByRange("key", "record").sortWithinPartitions("key", "record")
    return materialise(map_batches(ordered, write, PARTS), "parts")


class IndexReader:
    """Lookups in the index; reads directory lines, blocks and records by byte range."""

    def __init__(self, folder: str, parts: list[tuple[str, str]]):
        self.store, self.root = open_store(folder)
        self.parts = sorted(parts)
        self.first_keys = [key for key, _ in self.parts]
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], list[list[str]]] = OrderedDict()

    def _file(self, path: str) -> pa.NativeFile:
        if path not in self.files:
            self.files[path] = self.store.open_input_file(path)
            while len(self.files) > 4 * KEPT_BLOCKS:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(path)
        return self.files[path]

    def _line_at(self, path: str, place: int) -> tuple[int, list[str]]:
        """(start, fields) of the directory line that holds byte ``place``."""
        file, size = self._file(path), self._file(path).size()
        start = place
        while start > 0:
            step = min(256, start)
            found = file.read_at(step, start - step).rfind(b"\n")
            if found >= 0:
                start = start - step + found + 1
                break
            start -= step
        line, at = b"", start
        while at < size and b"\n" not in line:
            got = file.read_at(min(256, size - at), at)
            line, at = line + got, at + len(got)
        return start, line.partition(b"\n")[0].decode().split("\t")

    def _block_range(self, path: str, key: str) -> int:
        """Start of the last directory line whose key is below ``key`` (or of the first line): where captures with
        the key begin."""
        low, high, best = 0, self._file(path).size(), 0
        while low < high:
            middle = (low + high) // 2
            start, fields = self._line_at(path, middle)
            if fields[0] < key:
                best, low = start, start + sum(len(f.encode()) + 1 for f in fields)
            else:
                high = start
        return best

    def _block(self, part: str, line_start: int) -> tuple[list[list[str]], int]:
        """(capture lines, start of the next directory line)."""
        _, fields = self._line_at(f"{part}.idx", line_start)
        after = line_start + sum(len(f.encode()) + 1 for f in fields)
        at = (part, line_start)
        if at not in self.blocks:
            raw = self._file(f"{part}.cdx").read_at(int(fields[2]), int(fields[1]))
            self.blocks[at] = [line.split("\t") for line in zlib.decompress(raw).decode().split("\n")[:-1]]
            while len(self.blocks) > KEPT_BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(at)
        return self.blocks[at], after

    def captures(self, key: str) -> Iterator[list[str]]:
        """All captures with the key."""
        number = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while number < len(self.parts) and self.first_keys[number] <= key:
            part = self.parts[number][1]
            at, end = self._block_range(f"{part}.idx", key), self._file(f"{part}.idx").size()
            while at < end:
                lines, at = self._block(part, at)
                place = bisect.bisect_left(lines, [key])
                while place < len(lines) and lines[place][0] == key:
                    yield lines[place]
                    place += 1
                if place < len(lines):
                    break
            number += 1

    def record(self, archives: str, capture: list[str]) -> tuple[dict[str, str], bytes]:
        _, root = open_store(archives)
        raw = self._file(f"{root}/{capture[2]}").read_at(int(capture[4]), int(capture[3]))
        return parse_record(gzip.decompress(raw))


def read_captures(keys: DataFrame, archives: str, index: str, parts: DataFrame) -> DataFrame:
    """Look up each distinct key of ``keys`` (column ``key``) and read its records."""
    # one short row for each index task: the number of shuffle partitions bounds it
    listed = [(r["first_key"], r["path"]) for r in parts.select("first_key", "path").collect()]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("intact", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = IndexReader(index, listed), None
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                if key == last:
                    continue
                last = key
                for capture in reader.captures(key):
                    fields, payload = reader.record(archives, capture)
                    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    refers = fields["WARC-Refers-To"].removeprefix("<urn:page:").rstrip(">") if revisit else None
                    digest = named if revisit else sha1_base32(payload)
                    rows.append({"page_id": json.loads(fields["Page-Id"]), "url": fields.get("WARC-Target-URI"),
                                 "record_type": fields["WARC-Type"], "refers_to": int(refers) if revisit else None,
                                 "payload_bytes": int(fields["Payload-Length"]) if revisit else len(payload),
                                 "payload_digest": digest, "intact": digest == named})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # a stated number of parts: a key is short, but what it makes a task read is not, so parts must not be merged by size
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("key").repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return map_batches(ordered, read, RECORDS)


def archive_and_read(pages: DataFrame, min_payload: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives and the index, then look every page up again and read it back."""
    spark: SparkSession = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives", min_payload)
    parts = write_index(captures, f"{folder}/index")
    keys = pages.select(capture_key(F.col("url").cast("string"), F.col("page_id").cast("long")).alias("key"))
    return read_captures(keys, f"{folder}/archives", f"{folder}/index", parts)
