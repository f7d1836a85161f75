"""Token ids of texts by the tokenizers library, through a bounded cache of words.

For a tokenizer that drops white space and never joins across it, the ids of a text are the
ids of its words one after another, so each distinct word is encoded once for a worker.  A
comma or full stop behind a Latin letter is a piece of its own to such a tokenizer and is
split off first; ASCII letters are lower-cased for the cache key, as the tokenizer's own
normaliser does.  Words with ``<|`` may hold special strings and keep their case.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from .common import ranges

#: The id that ends each document.
END = 1
#: Bytes of words a worker keeps, what a kept word takes besides its letters, bytes of text that are
#: looked up at once, and new words that are encoded at once.
KEPT_BYTES, WORD_BYTES, GROUP_BYTES, NEW_WORDS = 64 << 20, 230, 1 << 20, 4096

_STOP = re.compile(rb"[,.](?:(?<=[a-z][,.])|(?<=\xc3[\x9f-\xb6\xb8-\xbf][,.]))")
#: Lower-case letters that no Unicode normaliser changes, as long as nothing else stands among them.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PLAIN, _LATIN = re.compile(r"[a-z]+").fullmatch, re.compile(f"[{LETTERS}]+").fullmatch
_GAP = re.compile(rb"[ \n]")


def _byte_names() -> dict[int, str]:
    """How byte-level models write bytes: printable ones of Latin-1 as they are, the others from U+0100 on, in order."""
    others = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
    return {b: chr(256 + k) for k, b in enumerate(others)}


_BYTES = _byte_names()


class _Places(dict):
    """word -> its place; a new word gets the next place and is remembered as new."""

    def __init__(self):
        self.new: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        self.bytes += len(word) + WORD_BYTES
        return place


class WordTokenizer:
    """Encodes many texts at a time; exact for tokenizers that drop white space.

    A worker holds about ``kept`` bytes of words and a group's ids; new words are encoded a slice
    at a time by one thread, so that neither their encodings nor a pool's buffers add up.
    """

    def __init__(self, path: str, kept: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.vocabulary = self.tokenizer.get_vocab_size()
        # accented letters go by their bytes; only a tokenizer that does so takes the short way
        probe = [c * k for c in LETTERS for k in (1, 3)]
        whole = self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)
        same = [e.ids for e in whole] == [self._by_model(w) for w in probe]
        self.plain = _LATIN if same else _PLAIN
        self._clear()

    def _clear(self) -> None:
        self.places, self.ids = _Places(), np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Keep the half of the words that were used most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.places) // 2])
        words, places = list(self.places), _Places()
        for i in kept.tolist():
            places[words[i]]
        places.new = []
        lengths = self.lengths[kept]
        self.ids = self.ids[ranges(self.starts[kept], lengths)]
        self.places, self.starts, self.lengths = places, np.cumsum(lengths) - lengths, lengths
        self.uses = self.uses[kept] // 2

    def _learn(self) -> None:
        if not (new := self.places.new):
            return
        ids, lengths = [self.ids], [self.lengths]
        for k in range(0, len(new), NEW_WORDS):
            lists = self._encode_words([w.decode() for w in new[k : k + NEW_WORDS]])
            lengths.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter((i for x in lists for i in x), np.uint32, int(lengths[-1].sum())))
        self.ids, self.lengths = np.concatenate(ids), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.places.new = []

    def _by_model(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Words of letters alone are one piece that no normaliser changes: they go straight to the model."""
        plain, by_model = self.plain, self._by_model
        lists = [by_model(w) if plain(w) else None for w in words]
        rest = [i for i, x in enumerate(lists) if x is None]
        found = self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found, strict=True):
            lists[i] = e.ids
        return lists

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        while self.places.bytes > self.kept and len(self.places) > 1:
            self._thin()
        found = []
        for text in texts:
            line = text if b"<|" in text else text.lower()
            places = [
                np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
                for words in (_STOP.sub(rb" \g<0>", x).split() for x in pieces(line))
            ]
            found.append(places[0] if len(places) == 1 else np.concatenate(places))
        self._learn()
        where = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.uses += np.bincount(where, minlength=len(self.uses))
        lengths = self.lengths[where]
        flat = self.ids[ranges(self.starts[where], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, found)])]
        last = np.array([END], np.uint32)
        return [np.concatenate([flat[i:j], last]) for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, with the end id, as 32-bit unsigned integers."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_BYTES:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


def pieces(line: bytes, size: int = GROUP_BYTES) -> Iterator[bytes]:
    """A text cut behind white space into pieces of about ``size`` bytes; no word is cut."""
    start = 0
    while len(line) - start > size:
        gap = _GAP.search(line, start + size)
        if not gap:
            break
        yield line[start : gap.start()]
        start = gap.start()
    yield line[start:]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer for a file; its cache of words lives as long as the worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
