"""Token ids of whole texts by a public tokenizer, with the ids of repeated words remembered."""

from __future__ import annotations

import json
import os
from array import array
from functools import cache

import numpy as np
import regex

#: Entries of each generation of a memory (two are kept); this bounds memory and changes time only.
REMEMBERED = 400_000
#: The same for words of texts, and for pieces of words that are more than one.
WORDS_REMEMBERED, PIECES_REMEMBERED = 700_000, 200_000
#: How byte-level files split a text unless they name a pattern, and how they spell bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class Memory(dict):
    """Results of ``make`` by key: the recent generation and the one before it."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TextIds:
    """Ids of a text, equal to one call of the tokenizer on the whole text.

    Both kinds of public BPE files split a text before each single space that stands between two
    other characters, and nothing is merged across such a place. So texts whose white space is
    single spaces and line ends are taken word by word, words by the file's own pattern into
    pieces, and each new piece through the tokenizer's model. All other texts, and those that hold
    the string of an added token, go to the tokenizer whole.
    """

    def __init__(self, path: str, remembered: int = WORDS_REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.model = self.tokenizer.normalizer, self.tokenizer.model
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        splits = [p for p in parts.get("pretokenizers", []) if p["type"] == "Split"]
        #: White space is part of the ids, or dropped.
        self.spaced = not splits
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"] if splits else BYTE_LEVEL)
        self.pieces = Memory(self._piece, min(PIECES_REMEMBERED, remembered))
        self.words = Memory(self._word, remembered)
        self.led = Memory(lambda word: self._word(" " + word), remembered)

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I" if self.wide else "H", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self.normalizer is not None:
            word = word.lower() if word.isascii() else self.normalizer.normalize_str(word)
        if word.isalpha():  # one piece by either pattern, remembered as a word
            return self._piece(word)
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word)))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        words = text.split()
        if any(a in text for a in self.added) or " ".join(words) != text.replace("\n", " "):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        get = self.words.__getitem__
        if not self.spaced:
            return np.frombuffer(b"".join(map(get, words)), self.dtype)
        led, lines = self.led.__getitem__, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(get(first) + b"".join(map(led, rest)))
        return np.frombuffer(get("\n").join(lines), self.dtype)


@cache
def text_ids(path: str, remembered: int = WORDS_REMEMBERED) -> TextIds:
    """One per Python worker."""
    return TextIds(path, remembered)
