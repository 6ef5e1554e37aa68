"""Byte-pair merging with a heap and a linked list, on files of the ``tokenizers`` library.

Covers the pipeline of the word-level file: added special tokens are found in the
raw text; the rest is composed (NFC), split at white space, lower-cased character
by character and cut by a pattern; each piece is merged as mapped bytes whose last
one carries the word end. Only counts are made here, never identifiers. What a character
is differs between versions of Unicode, so stretches with one that this Python does not
know are normalised and cut by the library.
"""

from __future__ import annotations

import heapq
import os
import json
import unicodedata

import regex
from tokenizers import Tokenizer

#: Pieces, and stretches between white space, whose counts are kept; a full cache is emptied.
CACHE_WORDS = 400_000
CACHE_CHUNKS = 100_000
#: White space to str.split, but not to the file's pattern.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter for each byte: printable ones stand for themselves, others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Token counts of texts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or byte_level["type"] != "ByteLevel" or model["ignore_merges"]:
            raise ValueError(f"{path}: not a word-level byte-pair file of the kind read here")
        end = model["end_of_word_suffix"] or ""
        self.letters = letters = byte_letters()
        names = {c: i for i, c in enumerate([*letters, *(c + end for c in letters)])}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        for x, y in merges:
            names.setdefault(x + y, len(names))
        #: (left, right) symbol numbers in one integer -> rank; rank -> number of the merged symbol
        self.ranks = {names[x] << 20 | names[y]: r for r, (x, y) in reversed([*enumerate(merges)])}
        self.made = [names[x + y] for x, y in merges]
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")
        self.opening = os.path.commonprefix(added)  # a text without it has no special string
        self.library = Tokenizer.from_file(path)
        self.words = Counts(self.word, CACHE_WORDS)
        self.chunks = Counts(self.chunk, CACHE_CHUNKS)

    def word(self, word: str) -> int:
        """Symbols left of one piece: as many as bytes, less one for each merge."""
        rank, made = self.ranks.get, self.made
        sym = [*word.encode("utf-8", "replace")]
        n = len(sym)
        sym[-1] += 256  # the last one carries the word end
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(sym[i] << 20 | sym[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0 or rank(sym[i] << 20 | sym[j]) != r:
                continue  # one of the two has been merged since
            merges += 1
            sym[i], sym[j] = s, _ = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(s << 20 | sym[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(sym[h] << 20 | s)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return n - merges

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings; True marks those."""
        if self.opening not in text:
            return [(text, False)]
        out, last = [], 0
        for m in self.special.finditer(text):
            out += [(text[last : m.start()], False), (m[0], True)]
            last = m.end()
        return [*out, (text[last:], False)]

    def stretches(self, text: str) -> list[str]:
        """A text without special strings, normalised and cut at white space, which no piece spans."""
        # str.lower looks at what follows a capital sigma, the file's rule does not
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        if not SEPARATORS.search(text):
            return text.split()
        return [text] if unknown(text) else self.pieces(text)

    def split(self, chunk: str) -> list[str]:
        """The pieces of a stretch."""
        if chunk.isalpha():  # no unknown character is a letter
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return [chunk[:-1], chunk[-1]]
        if unknown(chunk):
            text = self.library.normalizer.normalize_str(chunk)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pieces(chunk)

    def chunk(self, chunk: str) -> int:
        return sum(map(self.words.__getitem__, self.split(chunk)))

    def forget(self) -> None:
        """Empty the caches: a worker that is used again would hold them through other work."""
        self.words.clear()
        self.chunks.clear()

    def count(self, text: str | None) -> int:
        """Tokens of a whole text, special strings as the file has them."""
        return sum(1 if special else sum(map(self.chunks.__getitem__, self.stretches(part))) for part, special in self.parts(text or ""))


def unknown(text: str) -> bool:
    """Whether a text has a character that this Python's tables do not know."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text)


class Counts(dict):
    """Values by text, made on demand; emptied at ``most`` entries, long texts are not kept."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, text: str) -> int:
        n = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[text] = n
        return n
