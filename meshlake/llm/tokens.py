"""Token ids of whole texts, with words encoded once."""

from __future__ import annotations

import re
import struct

import regex
from tokenizers import Tokenizer

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters whose normal form is themselves and whose lower case is one character in any library.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
_CACHE = 400_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies use: printable bytes stand for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCachedTokenizer:
    """Encodes like the tokenizer file alone, but looks up chunks and words that it has met.

    The vocabulary drops white space and splits at it, so a text is the concatenation of its
    chunks between blanks. A plain chunk is lower-cased, split and encoded word by word with the
    same model; any other goes through the tokenizer. Both caches are bounded, and emptied when full.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _exact(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.words) >= _CACHE:
            self.words.clear()
        self.words[word] = out
        return out

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not _PLAIN.fullmatch(chunk):
            out = self._exact(chunk)
        else:
            words = self.words
            out = b"".join([words.get(w) or self._word(w) for w in _PIECE.findall(chunk.lower())])
        if len(chunk) <= 40:
            if len(self.chunks) >= _CACHE:
                self.chunks.clear()
            self.chunks[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        chunks = self.chunks
        get, make = chunks.get, self._chunk
        found = [get(c) if c in chunks else make(c) for c in text.replace("\n", " ").split(" ") if c]
        return b"".join(found)


_made: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    """One per Python worker and file."""
    if path not in _made:
        _made[path] = WordCachedTokenizer(path)
    return _made[path]
