"""Tokenizer access inside tasks: loaded once per Python worker.

``ByteEncoder`` gives the ids of a byte-level BPE file through its rank table; ``WordMemo`` encodes words with a
``tokenizers`` file and remembers them.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: Words after which a worker's memo starts a new generation; it bounds memory (two generations of about 350 bytes a
#: word, 70 MB) and changes no result.
MEMO_WORDS = 100_000
#: Longer words are encoded each time instead of being remembered.
MEMO_WORD_CHARS = 48


#: Words whose normal form is their lower case and whose pre-tokens are plain to see: letters, then ASCII marks but for
#: the apostrophe, which contractions have, and the sign that special tokens begin with.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@[-`{-~]*)")
#: Stands for the end of a word; no plain word has it.
END = "\x00"


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else one from U+0100
    on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a JSON file, with truncation and padding off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ByteEncoder:
    """Ids of whole texts as the ``tokenizers`` file of the same vocabulary gives them, special tokens in a text
    included, but about four times as fast."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(os.path.basename(ranks_path), pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens=special)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all")


@lru_cache(maxsize=4)
def byte_encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> ByteEncoder:
    return ByteEncoder(ranks_path, pattern, dict(special))


class WordMemo:
    """Encoded and decoded forms of words (text between blanks) for a tokenizer that drops white space.

    ``ids`` has a word's ids as little-endian unsigned 32-bit bytes; ``decoded`` the words the decoder makes of them,
    in UTF-8, each followed by a blank.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        if self.tokenizer.decoder is not None:
            raise ValueError("only tokenizers without a decoder, which join tokens with blanks, are supported")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.words = [(self.tokenizer.id_to_token(i) or "").encode() + b" " for i in range(size)]
        self.ends = np.array([w.endswith(b"</w> ") for w in self.words])
        self.plain = self._plain_encoding()
        added = self.tokenizer.get_added_tokens_decoder().items()
        self.mark = next(((t.content, i) for i, t in added if t.special and not (t.lstrip or t.rstrip)), (None, -1))
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def _plain_encoding(self):
        """The tokenizer's merges as a rank table, in which END stands for the end of a word.

        Encoding by the ranks of the joined bytes gives the same ids as encoding by merges: when two neighbours that
        make up a token are joined, all merges of lower rank inside its bytes have been made, and these leave just the
        pair the token was merged from."""
        import tiktoken
        to_byte = {char: byte for byte, char in byte_characters().items()}
        end = END.encode()
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            stem = token.removesuffix("</w>")
            raw = bytes(to_byte[c] for c in stem) if all(c in to_byte for c in stem) else end
            if end not in raw:
                ranks[raw + end if stem != token else raw] = i
        ranks[end] = len(self.words)
        return tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word.  A call for each would cost much more than its encoding, so words are encoded in one
        text and their ids told apart.  Plain words are Latin letters with a run of ASCII marks after them, if any:
        one pre-token, or two."""
        out: list[bytes] = [b""] * len(words)
        found = list(map(_PLAIN.fullmatch, words))
        plain = [i for i, m in enumerate(found) if m]
        split = [found[i].groups() for i in plain]
        text = "".join([f"{head}{END}{tail}{END}" if tail else f"{head}{END}" for head, tail in split])
        ids = np.array(self.plain.encode_ordinary(text.lower()), "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        last = np.cumsum([2 if tail else 1 for _, tail in split], dtype=np.int64)
        if plain:
            self._cut(ids, [0, *ends[last[:-1] - 1].tolist()], ends[last - 1].tolist(), plain, out)
        self._encode_apart(words, [i for i, m in enumerate(found) if not m], out)
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def _cut(ids: np.ndarray, starts: list[int], stops: list[int], places: list[int], out: list[bytes]) -> None:
        raw = ids.tobytes()
        for place, start, stop in zip(places, starts, stops):
            out[place] = raw[4 * start:4 * stop]

    def _encode_apart(self, words: list[str], places: list[int], out: list[bytes]) -> None:
        """Any words: joined by a special token of the tokenizer, which always stands alone."""
        mark, mark_id = self.mark
        chosen = [words[i] for i in places]
        if not chosen:
            return
        if mark is None or any(mark in word for word in chosen):
            for place, e in zip(places, self.tokenizer.encode_batch_fast(chosen, add_special_tokens=False)):
                out[place] = np.array(e.ids, "<u4").tobytes()
            return
        ids = self._ids(mark.join(chosen))
        marks = np.flatnonzero(ids == mark_id).tolist()
        self._cut(ids, [0, *[m + 1 for m in marks]], [*marks, len(ids)], places, out)

    def encode_apart(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the tokenizer itself."""
        out: list[bytes] = [b""] * len(texts)
        self._encode_apart(texts, list(range(len(texts))), out)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The words that the decoder makes of ids, each followed by a blank."""
        return b"".join(map(self.words.__getitem__, memoryview(ids).cast("I")))

    def learn(self, words: set[str]) -> None:
        """After this, ``ids`` and ``decoded`` have these words, until ``trim``; new ones are encoded in one call."""
        missing = words.difference(self.ids)
        kept = missing.intersection(self.old[0])
        for word in kept:
            self.ids[word], self.decoded[word] = self.old[0][word], self.old[1][word]
        fresh = list(missing - kept)
        encoded = self._encode(fresh)
        self.ids.update(zip(fresh, encoded))
        name = self.words.__getitem__
        self.decoded.update((word, b"".join(map(name, memoryview(ids).cast("I")))) for word, ids in zip(fresh, encoded))

    def trim(self, words: Iterable[str]) -> None:
        """Forget the long ones of these words; start a new generation if there are too many."""
        for word in words:
            if len(word) > MEMO_WORD_CHARS:
                self.ids.pop(word, None)
                self.decoded.pop(word, None)
        if len(self.ids) > MEMO_WORDS:
            self.old, self.ids, self.decoded = (self.ids, self.decoded), {}, {}


@lru_cache(maxsize=4)
def word_memo(path: str) -> WordMemo:
    """The memo of this worker; kept from task to task."""
    return WordMemo(path)
