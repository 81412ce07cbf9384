"""Fast, exact ids of the lower-casing word BPE vocabulary.

A text's ids are the concatenation of the ids of its chunks between white space,
so every worker keeps a bounded cache of chunks and sends only unseen ones to the
merge loop; when the cache is full, chunks that recur stay.  What that doesn't cover goes to the tokenizer library: texts with
special-token strings or the separators U+001C to U+001F, and chunks with
characters beyond the basic plane or without an assigned category.
"""

from __future__ import annotations

import json
import re
import string
import struct
import unicodedata
from collections.abc import Callable

import numpy as np

DEFAULT = "word_bpe_49k.json"
#: Chunks to a generation of the cache, which holds two.
CACHE = 200_000
#: Chunks longer than this (encoded data, minified code) aren't kept, so the cache stays small in bytes too.
CACHED_CHARS = 64
LONG = 2_000
_END = b"\xff"  # stands for the end of a word: no UTF-8 text holds it
_ODD = re.compile("[\x1c-\x1f]|<\\|(?:start|end)oftext\\|>")
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", re.ASCII).findall
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _rare() -> re.Pattern:
    """Characters on which character tables of different ages differ: beyond the basic plane or not assigned."""
    ends, inside = [], False
    for i in range(0x10001):
        if (i == 0x10000 or unicodedata.category(chr(i)) == "Cn") != inside:
            ends.append(i)
            inside = not inside
    # the last range opened goes on to the end of all planes
    ranges = zip(ends[::2], [e - 1 for e in ends[1::2]] + [0x10FFFF], strict=False)
    return re.compile("[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in ranges) + "]")


class _Cache(dict):
    """Ids of chunks, made by ``make`` when a chunk is looked up first.

    A full generation becomes the old one, and the one before goes.  A chunk of the
    old generation moves on when it is looked up, so frequent ones are never made again.
    """

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.pop(chunk, None)
        if found is None:
            found = self.make(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)  # the table itself stays: it is being read
                self.clear()
            self[chunk] = found
        return found


class WordBPE:
    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        special = set(self.whole.get_added_tokens_decoder())
        byte, ranks = _byte_of(), {}
        for token, rank in vocab.items():
            if rank not in special:
                ends = token.endswith("</w>") and len(token) > 4
                ranks[bytes(byte[c] for c in (token[:-4] if ends else token)) + (_END if ends else b"")] = rank
        # the core's own function: the wrapper only tests the kind of its argument
        self.merge = tiktoken.Encoding("word", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words = regex.compile(_WORDS).findall
        self.rare = _rare().search
        self.cache = _Cache(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        ascii_only = chunk.isascii()
        if not ascii_only and self.rare(chunk):
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        else:
            stem = chunk.rstrip(string.punctuation)
            if stem.isalpha():  # most chunks: one word, and marks after it are another
                words = [stem, chunk[len(stem) :]] if len(stem) < len(chunk) else [chunk]
            else:
                words = _ASCII_WORDS(chunk) if ascii_only else self.words(chunk)
            ids = []
            for word in words:
                raw = word.encode() + _END
                ids += self.merge(raw) if len(raw) < LONG else self.whole.encode(word, add_special_tokens=False).ids
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers; null counts as empty."""
        if not text:
            return b""
        # plain searches first: they are far faster than the pattern, which hardly any text needs
        if ("<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text) and _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            # final sigma depends on its neighbours in str.lower, but not in the vocabulary's rule
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.cache.__getitem__, text.lower().split()))


_LOADED: dict[str, WordBPE] = {}


def encoder(name_or_path: str = DEFAULT) -> WordBPE:
    """The worker's encoder for a vocabulary file, given by path or by name in the public collection."""
    import public_tokenizers

    path = name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]
