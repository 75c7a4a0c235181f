"""SentencePiece encoding and decoding by a table of each prefix's last token.

A BPE model encodes every prefix of a text to one sequence of tokens, and any beginning of an encoding is itself the
encoding of its text.  So it is enough to know, for each prefix, the *last* token of its encoding: an automaton gives the
tokens that end there, and just one of them is compatible with the last token of the shorter prefix it leaves.  Two tokens
are compatible if merging their joined text gives these two.  The ids are then recovered backwards from the end.
The cost is linear in the text for any input, with no queue of merges.

Compatibility is tested by taking the latest merges of both tokens back, one at a time, and looking at each step whether a
merge across their border would have come first.  This needs tokens whose parts were merged before them and whose rank
is their own.  Tokens without these (runs of blanks share one score in some vocabularies) are tested by merging the
joined text itself.  Answers are remembered.

Texts are first cut where no token of the vocabulary reaches across: before blanks that follow something else, and around
ASCII characters the vocabulary lacks.  The parts ("words") are remembered per worker; that changes no result.

Defined cases: a null or empty text has the begin and end ids only and decodes to the empty text; a text without blanks is
one word of any length; rows with equal ``doc_id`` are documents of their own; null ids stay null; an empty table gives
no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches

#: Fixed value: the character that stands for a blank in SentencePiece vocabularies.
BLANK = "▁"
#: Words after which a worker's memo starts a new generation, and the length up to which words are remembered.
MEMO_WORDS, MEMO_WORD_CHARS = 400_000, 48
#: Answers on pairs of tokens that a worker remembers.
MEMO_PAIRS = 4_000_000


class PieceModel:
    """The vocabulary of a SentencePiece BPE file with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.tokens = {names[i]: i for i in range(size)
                       if not (special[i] or model.is_byte(i) or model.is_unused(i))}
        probe = " É ﬁ  x\t"
        if len(self.byte_ids) != 256 or model.decode(model.encode(probe)) != probe or \
                model.encode_as_pieces("  x")[0][0] != BLANK:
            raise ValueError("only models with byte fallback, a blank put first and no normalisation are supported")
        #: What each id adds to a decoded text.
        self.bytes_of = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if model.is_byte(i)
                         else names[i].replace(BLANK, " ").encode() for i in range(size)]
        self.starts_blank = {i for name, i in self.tokens.items() if name.startswith(BLANK)}
        # the smaller its rank, the earlier a token is merged; equal scores share a rank and merge from the left
        scores = sorted({model.get_score(i) for i in self.tokens.values()}, reverse=True)
        place = {score: rank for rank, score in enumerate(scores)}
        self.rank = {i: place[model.get_score(i)] for i in self.tokens.values()}
        self._prepare()

    def _prepare(self) -> None:
        import ahocorasick
        for name in self.tokens:
            if any(c not in self.tokens for c in name) or any(b == BLANK != a for a, b in zip(name, name[1:])):
                raise ValueError("a token that holds an unknown character, or a blank after another one")
        #: (left, right) of each token that merging can reach, its last merge.
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in sorted(self.tokens.items(), key=lambda item: len(item[0])):
            found, last = self.merge(name)
            if found != [i]:
                continue  # no text ever holds it
            self.automaton.add_word(name, (i, len(name)))
            if last is not None:
                self.parts[i] = last
                self.merged[last] = i
        self.automaton.make_automaton()
        shared = {rank for rank, n in _counts(self.rank[i] for i in self.parts).items() if n > 1}
        #: Tokens that were merged after both of their parts, at a rank of their own.
        self.plain = {i for i in self.tokens.values() if i not in self.parts}
        for i in sorted(self.parts, key=lambda i: self.rank[i]):
            if self.rank[i] not in shared and all(
                    part in self.plain and (part not in self.parts or self.rank[part] < self.rank[i])
                    for part in self.parts[i]):
                self.plain.add(i)
        self.answers: dict[int, bool] = {}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in self.tokens and chr(c) != " ")
        self.cut = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else "")).findall

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """The plain definition, for texts of known characters: merge the pair of neighbours whose joined token has the
        smallest rank, the leftmost of these, as long as there is one.  The ids, and the last pair merged."""
        names, last = list(text), None
        while True:
            best = min(((self.rank[token], at) for at in range(len(names) - 1)
                        if (token := self.tokens.get(names[at] + names[at + 1])) is not None), default=None)
            if best is None:
                return [self.tokens[name] for name in names], last
            at = best[1]
            last = self.tokens[names[at]], self.tokens[names[at + 1]]
            names[at:at + 2] = [names[at] + names[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of the two tokens gives the two."""
        if left in self.plain and right in self.plain:
            return self._taken_back(left, right)
        text = self.bytes_of[left] + self.bytes_of[right]
        return self.merge(text.decode().replace(" ", BLANK))[0] == [left, right]

    def _taken_back(self, left: int, right: int) -> bool:
        rank, parts, limit = self.rank, self.parts, None
        while True:
            across = self.merged.get((left, right))
            # a merge across the border of rank below the limit would have come before the merge taken back last
            if across is not None and (limit is None or rank[across] < limit):
                return False
            left_rank = rank[left] if left in parts else -1
            right_rank = rank[right] if right in parts else -1
            if left_rank < 0 and right_rank < 0:
                return True
            if right_rank >= left_rank:  # of equal ranks the left one merges first, a pair across them before the right
                limit, right = right_rank + 1, parts[right][0]
            else:
                limit, left = left_rank, parts[left][1]

    def word_ids(self, word: str) -> bytes:
        """The ids of a word of known characters."""
        answers, compatible = self.answers, self.compatible
        if len(answers) > MEMO_PAIRS:
            answers.clear()
        last = [0] * (len(word) + 1)
        size = [0] * (len(word) + 1)
        for end, (token, length) in self.automaton.iter(word):
            start = end + 1 - length
            if size[end + 1]:
                continue  # just one token fits
            if start:
                pair = last[start] << 32 | token
                fits = answers.get(pair)
                if fits is None:
                    fits = answers[pair] = compatible(last[start], token)
                if not fits:
                    continue
            last[end + 1], size[end + 1] = token, length
        out, at = array("I"), len(word)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out.tobytes()


def _counts(values: Iterable[int]) -> dict[int, int]:
    counts: dict[int, int] = {}
    for value in values:
        counts[value] = counts.get(value, 0) + 1
    return counts


class PieceEncoder:
    """Encodes and decodes whole texts; remembers words."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.unknown = re.compile("([^" + "".join(map(re.escape, (c for c in self.model.tokens if len(c) == 1))) + "])")

    def _word(self, word: str) -> bytes:
        parts = self.unknown.split(word)
        if len(parts) == 1:
            return self.model.word_ids(word)
        # every other part is an unknown character, which merges with nothing: its bytes
        byte_ids = self.model.byte_ids
        return b"".join(array("I", [byte_ids[b] for b in part.encode()]).tobytes() if i % 2
                        else self.model.word_ids(part) for i, part in enumerate(parts) if part)

    def encode(self, text: str) -> bytes:
        """The ids with begin and end, 4 bytes each in little-endian order."""
        edge = array("I", [self.model.begin]).tobytes(), array("I", [self.model.end]).tobytes()
        if not text:
            return b"".join(edge)
        words = self.model.cut(BLANK + text.replace(" ", BLANK))
        known = self.words
        try:
            ids = [known[w] for w in words]
        except KeyError:
            for word in set(words).difference(known):
                known[word] = self.old.get(word) or self._word(word)
            ids = [known[w] for w in words]
            for word in words:
                if len(word) > MEMO_WORD_CHARS:
                    known.pop(word, None)
            if len(known) > MEMO_WORDS:
                self.old, self.words = known, {}
        return b"".join([edge[0], *ids, edge[1]])

    def decode(self, ids: bytes) -> bytes:
        """The text of ids that ``encode`` made, in UTF-8: the blank that was put first goes."""
        out = b"".join(map(self.model.bytes_of.__getitem__, memoryview(ids).cast("I")))
        first = memoryview(ids).cast("I")[1] if len(ids) > 4 else -1
        return out[1:] if first in self.model.starts_blank else out


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of this worker; kept from task to task."""
    return PieceEncoder(path)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"


def encode_documents(docs: DataFrame, model_path: str, keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded`` of each document (doc_id, text); ``keep=False``
    leaves the last two null.  Narrow: nothing is shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                gc.disable()  # no cycles are made, but many objects for the collector to look at
                for text in part.column(1):
                    ids = encoder.encode(text.as_py() or "")
                    decoded = encoder.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(),
                                 ids if keep else None, decoded.decode() if keep else None))
                gc.enable()
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, DIGESTS)
