"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it into chunks at places that depend only on the bytes around them, so
documents that share a passage share the chunks inside it, wherever it stands.  Documents are dealt out by the smallest
hash of their chunks: copies and near copies, which mostly agree in it, meet in one task, where every distinct chunk is
encoded once.  The deal is by range of (smallest hash, doc_id), so a group of copies of any size is spread over as
many tasks as its share of the rows asks for; only then is a chunk encoded again, once per task.

A cut may fall inside a word, and the chunks' ids next to it are wrong then.  So every *join* of two chunks is encoded
anew: a window from the last blank before the cut to the first one after it, with a whole word of context on each side.
The ids of the context must be those that the chunks gave it; what stands between them replaces the chunks' own ids at
the join.  Where they differ, the window is widened, to the whole text at last, which is right by definition.  A chunk without
a blank is part of the window.  (The tokenizer drops white space, and no token reaches across it, so the first window
agrees.)  The result equals the encoding of the whole text.

Defined cases: a null or empty text has no ids and decodes to the empty text; a text without blanks is one window;
rows with equal ``doc_id`` are documents of their own; null ids stay null; an empty table gives no rows; other columns
of the input are not read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches
from .tokens import WordMemo, word_memo

#: A cut falls where the low bits of the rolling hash are 0, on average every 2**CUT_BITS bytes.
CUT_BITS = 10
#: Bytes the rolling hash looks back on (a power of two).
LOOK_BACK = 32
#: Bytes of encoded chunks that a task remembers; older ones go first, which changes no result.
CHUNK_MEMO_BYTES = 16 << 20
#: Characters of text that are encoded together.
TEXTS_CHARS = 1 << 20

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(raw: bytes, cut_bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of ``raw`` (UTF-8), the end of the text included; never inside a character."""
    if not raw:
        return []
    data = np.frombuffer(raw, np.uint8)
    rolled, width = _GEAR[data], 1
    while width < LOOK_BACK:  # the sum over the last LOOK_BACK bytes of gear << age, by doubling
        older = np.zeros_like(rolled)
        older[width:] = rolled[:-width] << np.uint32(width)
        rolled, width = rolled + older, 2 * width
    ends = np.flatnonzero(rolled >> np.uint32(32 - cut_bits) == 0) + 1
    ends = ends[ends < len(data)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    return [*ends.tolist(), len(data)]


def split_chunks(text: str, cut_bits: int = CUT_BITS) -> list[str]:
    raw = text.encode()
    ends = cut_points(raw, cut_bits)
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends)]


class Chunk:
    """A chunk's own encoding up to its cuts: its first and last words, which a cut may have gone through, and the ids and
    decoded form of those between."""

    __slots__ = ("head", "tail", "before", "after", "ids", "decoded", "edges")

    def __init__(self, words: list[str], memo: WordMemo):
        inner = words[1:-1]
        self.head, self.tail = words[0], words[-1]
        self.ids = b"".join(map(memo.ids.__getitem__, inner))
        self.decoded = b"".join(map(memo.decoded.__getitem__, inner))
        full = [word for word in inner if word]
        #: The words next to the edges, as context of the joins.
        self.after, self.before = (full[0], full[-1]) if full else ("", "")
        self.edges = memo.ids[self.head], memo.ids[self.tail]

    def size(self) -> int:
        return len(self.ids) + len(self.decoded)


class ChunkEncoder:
    """Encodes texts chunk by chunk; remembers chunks, and words inside them, for the task."""

    def __init__(self, path: str, cut_bits: int = CUT_BITS):
        self.words, self.cut_bits = word_memo(path), cut_bits
        self.chunks: OrderedDict[str, Chunk] = OrderedDict()
        self.held = 0
        self.encoded = 0  # chunks that were encoded, not found
        self.joins = self.repaired = self.widened = 0

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of each: 4 bytes an id, and UTF-8."""
        cut = [split_chunks(text, self.cut_bits) for text in texts]
        known = self._chunks(cut)
        parts = [self._parts(chunks, known) for chunks in cut]
        joined = self._joins({part for of_text in parts for part in of_text if isinstance(part, tuple)})
        out = []
        for text, of_text in zip(texts, parts):
            found = [joined[part] if isinstance(part, tuple) else (part.ids, part.decoded) for part in of_text]
            if None in found:  # a window whose context did not agree: the widest one
                ids = self.words.encode_apart([text])[0]
                found = [(ids, self.words.decode(ids))]
            out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])[:-1]))
        return out

    def _chunks(self, cut: list[list[str]]) -> dict[str, Chunk | None]:
        """The chunks' own encodings; none for a chunk without a blank."""
        memo = self.words
        met = dict.fromkeys(chunk for chunks in cut for chunk in chunks)
        new = {chunk: words for chunk in met if chunk not in self.chunks
               and len(words := chunk.replace("\n", " ").split(" ")) > 1}
        words = set().union(*(split[1:-1] for split in new.values()))
        edges = {word for split in new.values() for word in (split[0], split[-1])}
        memo.learn(words | edges)
        made = {chunk: Chunk(split, memo) for chunk, split in new.items()}
        for word in edges - words:  # pieces of words are not worth remembering
            memo.ids.pop(word, None)
            memo.decoded.pop(word, None)
        memo.trim(words)
        known = {chunk: made.get(chunk) or self.chunks.get(chunk) for chunk in met}
        for chunk, value in known.items():
            if chunk in made:
                self.encoded += 1
                self.chunks[chunk] = value
                self.held += len(chunk) + value.size()
            elif value is not None:
                self.chunks.move_to_end(chunk)
        while self.held > CHUNK_MEMO_BYTES:
            chunk, value = self.chunks.popitem(last=False)
            self.held -= len(chunk) + value.size()
        return known

    @staticmethod
    def _parts(chunks: list[str], known: dict[str, Chunk | None]) -> list[Chunk | tuple]:
        """A text as chunks and, between them, joins: (word before, text of the window, word after, the two chunks' own
        ids of that text)."""
        out: list[Chunk | tuple] = []
        before, window, own = "", "", b""
        for name in chunks:
            chunk = known[name]
            if chunk is None:  # no blank: the window goes on through the next join
                window, own = window + name, b""
                continue
            if window or chunk.head:
                out.append((before, window + chunk.head, chunk.after, own + chunk.edges[0]))
            out.append(chunk)
            before, window, own = chunk.before, chunk.tail, chunk.edges[1]
        if window:
            out.append((before, window, "", own))
        return out

    def _joins(self, joins: set[tuple]) -> dict[tuple, tuple[bytes, bytes] | None]:
        """The ids and decoded forms of the joins' windows, none where the context does not agree."""
        order = list(joins)
        context = {word for before, _, after, _ in order for word in (before, after)}
        memo = self.words
        memo.learn(context)
        out: dict[tuple, tuple[bytes, bytes] | None] = {}
        encoded = memo.encode_apart([f"{before} {window} {after}" for before, window, after, _ in order])
        for join, ids in zip(order, encoded):
            first, last = memo.ids[join[0]], memo.ids[join[2]]
            self.joins += 1
            if ids.startswith(first) and ids.endswith(last) and len(ids) >= len(first) + len(last):
                between = ids[len(first):len(ids) - len(last)]
                self.repaired += between != join[3]
                out[join] = between, memo.decode(between)
            else:
                self.widened += 1
                out[join] = None
        memo.trim(context)
        return out


ROUTED = "route long, doc_id long, text string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"


def route_by_content(docs: DataFrame) -> DataFrame:
    """``route``: the smallest chunk hash of each text (0 for none), beside ``doc_id`` and ``text``."""
    schema = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                ends = cut_points(raw)
                least.append(min((xxhash.xxh3_64_intdigest(raw[a:b]) >> 1 for a, b in zip([0, *ends], ends)), default=0))
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), *batch.columns], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), route, ROUTED)


def encode_documents(docs: DataFrame, tokenizer_path: str, keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded`` of each document; ``keep=False`` leaves the last
    two null."""
    routed = route_by_content(docs)
    dealt = routed.repartitionByRange("route", "doc_id").drop("route")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.string())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer_path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # some documents at a time: as many as hold about TEXTS_CHARS
                ids_of, texts, held = [], [], 0
                while at < batch.num_rows and held < TEXTS_CHARS:
                    ids_of.append(batch.column(0)[at].as_py())
                    texts.append(batch.column(1)[at].as_py() or "")
                    held, at = held + len(texts[-1]), at + 1
                # no reference cycles are made here, but enough objects for the collector to look at all of them again
                # and again, which took half of the time
                gc.disable()
                done = encoder.encode(texts)
                gc.enable()
                columns = (ids_of, [len(ids) // 4 for ids, _ in done],
                           [hashlib.sha256(ids).hexdigest() for ids, _ in done],
                           [hashlib.sha256(decoded).hexdigest() for _, decoded in done],
                           [ids if keep else None for ids, _ in done],
                           [decoded.decode() if keep else None for _, decoded in done])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return map_batches(dealt, encode, DIGESTS)
