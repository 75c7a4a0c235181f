"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct shingles of ``n_words`` words.  Its signature has ``CHUNKS * CHUNK_SYMBOLS``
symbols of 16 bits, each a min-hash of the set.  Two signatures that differ in at most ``CHUNKS * 2 - 1`` symbols have,
by the pigeonhole principle, a chunk that differs in one symbol at most.  So every chunk is indexed under each way of
leaving one symbol out, and an equality join on these keys finds *all* pairs within that distance, and most pairs a little
beyond it too.

Documents with equal sets form one class; only classes are compared.  Links are confirmed on full sets:

1. in every key's bucket the smallest id is paired with each other member (as many pairs as members);
2. confirmed links are joined to components;
3. buckets that hold more than one component are searched through.  Their members are sent signatures and *parity
   sketches* of their sets: the bits in which two sketches differ are no more than the shingles in which the sets
   differ, so a pair whose sketches differ in too many bits for the similarity cannot be linked, and is passed over.  Of
   the other pairs of different components, those are confirmed that would join the bucket's components, the closest
   first; at most as many as members.  This is repeated as long as it finds links;
4. every other pair of different components that the sketches and sizes leave open is then confirmed on full sets, in
   the first of the buckets that the two share.  Pairs inside a component could add nothing.

A bucket with more than ``BLOCK_ROWS`` members is dealt in blocks, each pair of blocks a unit of work of bounded size.  So a
group of near copies costs in proportion to its members, and no pair that meets in a bucket and could join two
components is left out.  A pair at similarity 0.8 meets in none with a probability of 4e-8.  The sketches say less of
sets of much more than ``SKETCH_BITS`` shingles; that costs time only.

Defined cases: a null or empty text, or one of white space only, has an empty set and is linked with nothing; a text
with fewer than ``n_words`` words has its whole sequence as its only shingle; rows with equal ``doc_id`` are one node
whose links are those of all its rows; rows with a null ``doc_id`` are linked with nothing, have a null component and
are kept; an empty table gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .storage import filter_by_ids, map_batches, materialise

N_WORDS = 2
#: Links: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
CHUNKS, CHUNK_SYMBOLS = 16, 6
BLOCK_ROWS = 512
SKETCH_BITS = 4_096
#: Words whose hashes a task remembers; it changes no result.
MEMO_WORDS = 300_000

SYMBOLS = CHUNKS * CHUNK_SYMBOLS
_random = np.random.default_rng(61)
_FACTORS = _random.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 divided by the golden ratio


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of 64-bit shingle hashes; remembers the hashes of words."""

    def __init__(self, n_words: int = N_WORDS):
        self.n_words, self.known = n_words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() changes A-Z only, and bytes.split() splits at \x20 and \x09-\x0D only
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MEMO_WORDS:
            known.clear()
        try:
            hashes = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in words]
        of_words = np.array(hashes, np.uint64)
        n = min(self.n_words, len(words))
        shingles = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            shingles = _mixed(shingles + of_words[i:len(words) - n + 1 + i])
        return np.unique(shingles)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4_096):
        part = shingles[at:at + 4_096]
        np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


SIGNED = "doc_id long, n_shingles long, set_hash binary, signature binary"


def sign_documents(docs: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """``doc_id, n_shingles, set_hash`` (128 bits) and ``signature``; null hash and signature for an empty set."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n_words)
        for batch in batches:
            sizes, hashes, signatures = [], [], []
            for text in batch.column(1):
                shingles = shingler(text.as_py())
                sizes.append(len(shingles))
                hashes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                signatures.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()),
                                              pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())],
                                             names=["doc_id", "n_shingles", "set_hash", "signature"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), sign, SIGNED)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Bit i is set if an odd number of shingles fall on it."""
    odd = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def _chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) keys: number c * CHUNK_SYMBOLS + p is chunk c without its symbol p.  The low bits hold that
    number, so keys of different kinds never meet."""
    chunks = signatures.reshape(-1, CHUNKS, CHUNK_SYMBOLS).astype(np.uint64)
    each = _mixed(chunks + (np.arange(1, CHUNK_SYMBOLS + 1, dtype=np.uint64) << np.uint64(20)))
    left = each.sum(axis=2, keepdims=True, dtype=np.uint64) - each
    keys = _mixed(left).reshape(-1, SYMBOLS)
    return (keys & ~np.uint64(127) | np.arange(SYMBOLS, dtype=np.uint64)).view(np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2_048):
            part = batch.slice(at, 2_048)
            keys = _chunk_keys(_symbols(part.column(1)))
            ids = np.repeat(part.column(0).to_numpy(), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])


UNIT = ("key long, id long, component long, signature binary, size long, sketch binary, block long, a long, b long")


class _Unit:
    """The members of one bucket, or of two blocks of one."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.table = table = pa.Table.from_batches(rows).combine_chunks()
        self.ids, self.component, self.size, self.block = (table[c].to_numpy()
                                                           for c in ("id", "component", "size", "block"))
        self.one_block = table["a"][0].as_py() == table["b"][0].as_py()
        self.kind = table["key"][0].as_py() & 127
        self.symbols = _symbols(table["signature"].combine_chunks())
        self.sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(self.ids), -1)

    def candidates(self, i: int, similarity: int) -> tuple[np.ndarray, np.ndarray]:
        """Later members of another component that meet member ``i`` here first, and whose size and sketch allow the
        similarity, with the least number of shingles in which the sets differ."""
        others = np.flatnonzero(self.component[i + 1:] != self.component[i]) + i + 1
        if not self.one_block:
            others = others[self.block[others] != self.block[i]]
        # the intersection is no larger than the smaller set, the union no smaller than the larger one
        least, most = np.minimum(self.size[others], self.size[i]), np.maximum(self.size[others], self.size[i])
        others = others[100 * least >= similarity * most]
        apart = np.bitwise_count(self.sketch[others] ^ self.sketch[i]).sum(axis=1, dtype=np.int64)
        # with d shingles apart, the intersection is half of the sizes' sum less d, the union half of the sum and d
        near = (100 + similarity) * apart <= (100 - similarity) * (self.size[others] + self.size[i])
        others, apart = others[near], apart[near]
        # the first key under which the two meet: the first chunk with one difference at most, without it
        by_chunk = (self.symbols[others] != self.symbols[i]).reshape(-1, CHUNKS, CHUNK_SYMBOLS)
        chunk = (by_chunk.sum(axis=2) <= 1).argmax(axis=1)
        place = by_chunk[np.arange(len(others)), chunk].argmax(axis=1)
        here = chunk * CHUNK_SYMBOLS + place == self.kind
        return others[here], apart[here]

    def joining(self, similarity: int) -> list[pa.RecordBatch]:
        """The candidate pairs, closest first, that would join components which those before them leave apart."""
        first, second, far = [], [], []
        for i in range(len(self.ids) - 1):
            others, apart = self.candidates(i, similarity)
            first.append(np.full(len(others), i))
            second.append(others)
            far.append(apart / (self.size[others] + self.size[i]))
        first, second, far = (np.concatenate(c) for c in (first, second, far))
        forest, found = Forest(), []
        for at in np.argsort(far, kind="stable").tolist():
            x, y = int(self.component[first[at]]), int(self.component[second[at]])
            if forest.root(x) != forest.root(y):
                forest.link(x, y)
                found.append((int(self.ids[first[at]]), int(self.ids[second[at]])))
        return _pairs(found)

    def with_candidates(self, similarity: int) -> list[pa.RecordBatch]:
        """The rows that are part of any candidate pair here."""
        part = np.zeros(len(self.ids), bool)
        for i in range(len(self.ids) - 1):
            others, _ = self.candidates(i, similarity)
            part[others] = True
            part[i] |= len(others) > 0
        return self.table.filter(pa.array(part)).to_batches() if part.any() else []

    def links(self, similarity: int) -> list[pa.RecordBatch]:
        """Links between members of different components, confirmed on full sets; as many as join them, not all."""
        sets = self.table["shingles"].combine_chunks()
        ends = np.cumsum([0, *sets.value_lengths().to_pylist()])
        _, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        has = np.zeros(int(flat.max(initial=-1)) + 1, bool)
        sizes, found = np.diff(ends), []
        for i in range(len(self.ids) - 1):
            others, _ = self.candidates(i, similarity)
            if not len(others):
                continue
            own = flat[ends[i]:ends[i + 1]]
            has[own] = True
            common = np.array([np.count_nonzero(has[flat[ends[j]:ends[j + 1]]]) for j in others])
            has[own] = False
            union = sizes[i] + sizes[others] - common
            for j in others[100 * common >= similarity * union].tolist():
                if self.component[j] != self.component[i]:
                    found.append((int(self.ids[i]), int(self.ids[j])))
                    self.component = np.where(self.component == self.component[j], self.component[i], self.component)
        return _pairs(found)


def _pairs(found: list[tuple[int, int]]) -> list[pa.RecordBatch]:
    if not found:
        return []
    return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])]


def _by_unit(work: Callable[[_Unit], list[pa.RecordBatch]]):
    """A task's function that does ``work`` on each unit of rows sorted by (key, a, b)."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("key", "a", "b")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(starts, starts[1:]):
                key = tuple(keys[start])
                if key != last:
                    if sum(r.num_rows for r in rows) > 1:
                        yield from work(_Unit(rows))
                    rows = []
                rows.append(batch.slice(start, end - start))
                last = key
        if sum(r.num_rows for r in rows) > 1:
            yield from work(_Unit(rows))

    return search


def _units(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, ids: DataFrame, n_words: int) -> DataFrame:
    """``set_hash, sketch`` of the documents with these ids (a written table, column ``doc_id``)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n_words)
        for batch in batches:
            sets = [shingler(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([parity_sketch(s) for s in sets], pa.binary())], names=["set_hash", "sketch"])

    return map_batches(filter_by_ids(_named(docs), ids, "doc_id"), sketch, "set_hash binary, sketch binary")


def shingle_sets(docs: DataFrame, ids: DataFrame, n_words: int) -> DataFrame:
    """``doc_id, shingles`` of the documents with these ids (a table of its own, column ``doc_id``)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingler(text.as_py()).view(np.int64) for text in part.column(1)]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
                lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists.cast(pa.list_(pa.int64()))],
                                                 names=["doc_id", "shingles"])

    return materialise(map_batches(filter_by_ids(_named(docs), ids, "doc_id"), sets, "doc_id long, shingles array<long>"),
                       "sets")


def confirm(pairs: DataFrame, docs: DataFrame, n_words: int = N_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  Sets are made of the documents in the pairs only."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    shingles = shingle_sets(docs, ids, n_words)
    side = [shingles.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab"]
    both = pairs.join(side[1], "b").join(side[0], "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return both.where(100 * common >= similarity * union).select("a", "b").distinct()


def _mixed_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members (key, id, n) of the buckets that hold more than one component, with their ``component``."""
    member = materialise(members.join(found, F.col("id") == F.col("node"), "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("component")), "members")
    mixed = (member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("key"))
    return materialise(member.join(mixed, "key"), "mixed")


def _dealt(opened: DataFrame, sketched: DataFrame, block_rows: int) -> DataFrame:
    """Members of mixed buckets as rows of units: a bucket's blocks in pairs."""
    shares = F.ceil(F.col("n") / F.lit(block_rows)).cast("long")
    return (opened.join(sketched, "id").withColumn("block", F.pmod(F.xxhash64("id", "key"), shares))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
            .select("key", "id", "component", "signature", "size", "sketch", "block",
                    F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")))


def near_documents(docs: DataFrame, n_words: int = N_WORDS, similarity: int = SIMILARITY,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text)."""
    signed = materialise(sign_documents(docs, n_words), "signed")
    classes = (signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
               .groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"),
                                        F.first("n_shingles").alias("size")))
    classes = materialise(classes, "classes")
    keys = map_batches(classes.select("id", "signature"), _index, "key long, id long").repartition("key")
    shared = keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = materialise(keys.join(shared, "key"), "buckets")
    stars = buckets.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = materialise(confirm(materialise(stars, "stars"), docs, n_words, similarity), "links")
    # rows of one id with different sets are one node
    found = connected_components(links)

    opened = _mixed_buckets(buckets.select("key", "id", "n"), found)
    ids = materialise(opened.select(F.col("id").alias("doc_id")).distinct(), "ids")
    sketched = materialise(classes.join(sketches(docs, ids, n_words).dropDuplicates(["set_hash"]), "set_hash")
                           .select("id", "signature", "size", "sketch"), "sketched")
    tried = None
    while True:
        joining = map_batches(_units(_dealt(opened, sketched, block_rows)),
                              _by_unit(lambda unit: unit.joining(similarity)), "a long, b long").distinct()
        new = materialise(joining if tried is None else joining.join(tried, ["a", "b"], "left_anti"), "joining")
        more = materialise(confirm(new, docs, n_words, similarity), "more")
        if more.isEmpty():
            break
        tried = new if tried is None else tried.unionByName(new)
        links = links.unionByName(more)
        found = connected_components(links)
        opened = _mixed_buckets(opened.select("key", "id", "n"), found)

    # of the pairs that are left, signatures and sketches say which rows have a partner where; those get their sets
    asked = materialise(map_batches(_units(_dealt(opened, sketched, block_rows)),
                                    _by_unit(lambda unit: unit.with_candidates(similarity)), UNIT), "asked")
    shingles = shingle_sets(docs, materialise(asked.select(F.col("id").alias("doc_id")).distinct(), "ids"), n_words)
    full = asked.join(shingles, F.col("id") == F.col("doc_id")).drop("doc_id")
    more = materialise(map_batches(_units(full), _by_unit(lambda unit: unit.links(similarity)),
                                   "a long, b long").distinct(), "more")
    found = connected_components(links.unionByName(more))

    ids = classes.select("set_hash", "id").join(found, F.col("id") == F.col("node"), "left").select(
        "set_hash", F.coalesce("component", "id").alias("component"))
    # most classes have one document that is linked with nothing: only the others are joined back
    several = signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(
        F.min("doc_id").alias("lo"), F.count("*").alias("n"))
    told = ids.join(several, "set_hash").where("n > 1 OR component <> lo").select("set_hash", "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (signed.join(told, "set_hash", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")))
