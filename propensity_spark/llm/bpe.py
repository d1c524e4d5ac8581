"""Token ids of the tokenizers library, encoded once per distinct run of characters between white space."""

from __future__ import annotations

import functools
import json
import os
from array import array

import numpy as np

#: Byte-level BPE writes printable bytes as themselves and the others, in order, as the characters from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class _Cache(dict):
    """Chunk -> ids as bytes; a chunk that is missing is made by `make`."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.make(chunk)
        return ids


class ChunkEncoder:
    """encode_batch(texts) gives the ids of Tokenizer.encode(text, add_special_tokens=False).

    Holds for tokenizers that drop white space and whose normaliser and pre-tokenizer never look across it, such as
    word_bpe_49k: there the ids of a text are those of its chunks in order. Chunks are cut at ASCII white space only;
    any other space stays inside a chunk and is left to the library. A chunk of Latin-1 letters, perhaps with ASCII
    punctuation behind, is lower-cased and cut there without doubt, so the library's BPE model gets the word at once;
    any other chunk is encoded whole. The cache holds two generations of about `limit` chunks each.
    """

    def __init__(self, path: str, limit: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = np.dtype(self.type).char
        self.limit, self.old, self.new = limit, {}, _Cache(self._make)
        #: Ids of short runs of punctuation.
        self.tails = _Cache(lambda c: self._whole(c))
        #: The library lower-cases all but special tokens, so texts without "<" may be lower-cased before.
        self.lower = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        #: Whether a word of letters passes the normaliser and pre-tokenizer as assumed.
        self.plain = self.lower and all(
            self._letters(w) + self.tails[t] == self._whole(w.encode() + t)
            for w, t in (("Été", b"."), ("Ab", b""), ("ßµ", b"!?'")))

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, chunk: bytes) -> bytes:
        return self._bytes(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _letters(self, word: str) -> bytes:
        """Ids of one word of Latin-1 letters."""
        word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_LEVEL)
        return self._bytes([t.id for t in self.model.tokenize(word)])

    def _make(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is not None:
            return ids
        if self.plain:
            if chunk.isalpha():  # of ASCII letters alone, the most frequent kind
                return self._bytes([t.id for t in self.model.tokenize(chunk.lower().decode())])
            word = chunk.rstrip(PUNCTUATION)
            if word and len(chunk) - len(word) <= 3:
                letters = word.decode("utf-8", "replace")
                if letters.isalpha() and (word.isascii() or max(letters) < "\u0100"):
                    return self._letters(letters) + self.tails[chunk[len(word):]]
        return self._whole(chunk)

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, _Cache(self._make)
        ids = self.new.__getitem__
        return [np.frombuffer(b"".join(map(ids, (t.lower() if self.lower and b"<" not in t else t).split())), self.type)
                for t in texts]


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    return ChunkEncoder(path)
