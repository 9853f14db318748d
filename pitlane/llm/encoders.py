"""Tokenizer files applied on executors, with a bounded cache of encoded words."""

from __future__ import annotations

import gc
import json
import re
from array import array

import regex

# A space between two characters that are not white space always starts a new pre-token
# of the byte-level pattern below, so texts can be cut there and the cuts encoded alone.
GAP = re.compile(r"(?<!\s) (?!\s)")
# White space but for the space and the line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")
# The pre-token patterns that the tokenizer files name (fixed values).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Pieces are cut out of a word only when it holds code points below this one, where the
# classes of both regular expression engines agree and normal forms change nothing.
PLAIN_BELOW = "\u0250"
MARKS = (".", ",", ";", ":", "!", "?")
# A mark after a letter or digit starts a pre-token in both patterns. Cut off there, it needs no entry in the cache for each word before it;
# texts with a mark after anything else stay as they are.
LONE_MARK = re.compile("[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][.,;:!?]")
CACHE_WORDS = 300_000  # some 50 MB a worker
CUT = "\x01"  # starts a cut-off part that has no space before it


def cut_marks(text: str, before: str) -> str:
    """The text with ``before`` put before each mark that ends a word."""
    if not LONE_MARK.search(text):
        for m in MARKS:
            if m in text:
                text = text.replace(m, before + m)
    return text


class _Cache(dict):
    """Two generations of at most ``limit`` entries; an old entry that is used again is kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level files write for each byte: itself, or the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Encoder:
    """Texts to token ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Words of plain letters go straight to the tokenizer's model; anything else takes its whole way, and so does a whole text that holds the
    string of an added token, in any case. ``cache_words`` bounds the memory, never the result.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE)
        self.marks = {t["content"][0] for t in spec.get("added_tokens") or [] if t["content"]}
        pre = spec.get("pre_tokenizer") or {}
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.kind, pattern = "byte", BYTE_PATTERN
        elif any((p.get("pattern") or {}).get("Regex") == WORD_PATTERN for p in pre.get("pretokenizers", [])):
            self.kind, pattern = "word", WORD_PATTERN
        if self.kind != "whole":
            self.pieces = regex.compile(pattern)
            self.letters = _byte_letters()
            self.space = self.letters[ord(" ")]
            self.bare = _Cache(self._word, cache_words)
            self.spaced = _Cache(self._spaced, cache_words)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, space: str) -> bytes:
        """One pre-token of letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(space + word)]).tobytes()

    def _word(self, word: str, space: str = "") -> bytes:
        """A word without spaces; ``space`` is the letter for a space before it, if there is one."""
        if not word.isascii() and max(word) >= PLAIN_BELOW:
            return self._encode(" " + word if space else word)
        if self.kind == "word":
            low = word.lower()
            if low != word and low.isalpha():
                return self.bare[low]
            word = low
        if word.isalpha():
            return self._letters(word, space)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return (self.spaced if space else self.bare)[word[:-1]] + self.bare[word[-1]]
        whole = " " + word if space else word
        first, *rest = self.pieces.findall(whole) or [""]
        if first == whole or not first or CUT in first:
            head = self._encode(first)
        else:  # a piece occurs in many words
            head = self.spaced[first[1:]] if space and len(first) > 1 else self.bare[first]
        return head + b"".join(map(self.bare.__getitem__, rest))

    def _spaced(self, word: str) -> bytes:
        if word[:1] == CUT:
            return self.bare[word[1:]]
        return self._word(word, self.space)

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids of a text as native unsigned 32-bit integers (little-endian on all supported machines)."""
        if any(m in text for m in self.marks) and self.added.search(text):
            return self._encode(text)
        if self.kind == "byte":
            if CUT in text:
                first, *rest = GAP.split(text)
                return self._word(first) + b"".join(self._word(w, self.space) for w in rest)
            plain = not ("  " in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text))
            text = cut_marks(text, " " + CUT) if plain else text
            if plain and "\n" in text and "\n\n" not in text:  # a lone line feed is a pre-token of its own
                return self.bare["\n"].join(map(self._line, text.split("\n")))
            first, *rest = text.split(" ") if plain else GAP.split(text)
            return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))
        if self.kind == "word":  # no pre-token has white space
            text = text.lower() if text.isascii() else text
            return b"".join(map(self.bare.__getitem__, cut_marks(text.replace("\n", " "), " ").split(" ")))
        return self._encode(text)

    def encode_all(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids of each text with the end's. Garbage collection pauses meanwhile: nothing here makes cycles, and it would walk
        the tokens of every word."""
        on = gc.isenabled()
        gc.disable()
        try:
            return [self.encode(t) + end for t in texts]
        finally:
            if on:
                gc.enable()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """The worker's encoder for a tokenizer file (kept between tasks)."""
    key = (path, cache_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, cache_words)
    return _ENCODERS[key]
