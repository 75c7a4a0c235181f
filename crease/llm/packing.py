"""Packing by power-of-two decomposition.

Each document (its ids and the closing id) is cut into whole sequences of ``max_length`` and, for the rest, one piece
per set bit of the rest's length, longest first.  Every piece is a sequence of its own: it holds ids of one document
only, its length is a power of two, and there is no padding at all.  A training run draws each batch from one *bucket*
(the pieces of one length): a piece's bucket is its ``length``, and ``bucket_row`` is its number there.  The numbers of a
task's pieces in a bucket have no gaps; :func:`write_buckets` writes a folder for each bucket.

Nothing is shuffled: the cut depends on the document alone, and numbers are counted by each task on its own, with the
task's partition in the upper bits.

Defined cases: a null or empty text has the closing id only, one piece of length 1; rows with equal or null ``doc_id``
are documents of their own, as ``sequence_id`` is given to pieces, not to ids; an empty table gives no pieces; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches
from .tokens import byte_encoder

MAX_LENGTH = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, bucket_row long"
#: Pieces that leave Python at once hold about this many bytes of ids.
BATCH_BYTES = 8 << 20


def decompose(n: int, max_length: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document with ``n`` ids."""
    pieces = [(start, max_length) for start in range(0, n - max_length + 1, max_length)]
    start, bit = len(pieces) * max_length, max_length >> 1
    while bit:
        if (n - start) & bit:
            pieces.append((start, bit))
            start += bit
        bit >>= 1
    return pieces


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], max_length: int = MAX_LENGTH,
         end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens, bucket_row, sequence_id, offset``.

    ``ids`` is binary, little-endian unsigned 32-bit; ``keep_ids=False`` leaves it null.  ``ranks_path``, ``pattern``
    and ``special`` name the byte-level BPE.  ``max_length`` must be a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket_row", pa.int64())])

    added = tuple(special.items())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(ranks_path, pattern, added)
        first, in_bucket = TaskContext.get().partitionId() << 33, Counter()
        for batch in batches:
            rows, held = [[] for _ in schema.names], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = encoder.encode(text.as_py() or "")
                tokens.append(end_id)
                n, ids = len(tokens), np.array(tokens, "<u4").tobytes()
                for start, length in decompose(n, max_length):
                    piece = ids[4 * start:4 * (start + length)]
                    for column, x in zip(rows, (doc_id, start, length, piece if keep_ids else None,
                                                zlib.crc32(piece), n, first + in_bucket[length])):
                        column.append(x)
                    in_bucket[length] += 1
                held += len(ids)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                    rows, held = [[] for _ in schema.names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = map_batches(read, cut, PIECES)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces with one folder per length, from which batches of equal length are drawn."""
    pieces.write.partitionBy("length").parquet(path)
