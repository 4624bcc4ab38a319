"""Byte-level BPE with a whole-token shortcut.

A pre-token whose text is one vocabulary string needs no merges if that string, encoded alone, gives one token. That is
proved once by a worker for the whole vocabulary (``whole_tokens``); executors then look pre-tokens up and run the
merges only for the rest, which a bounded cache remembers. The driver never loads a tokenizer.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import SparkSession

from tessera.llm.common import reach

#: The split pattern of the byte-level vocabulary, with white space by its Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_EXACT = regex.compile(PATTERN)
#: The same with the usual class of white space, which agrees for characters that aren't in _NOT_FAST.
SPLIT = PATTERN.replace(r"\p{White_Space}\p{L}", r"\s\p{L}").replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
#: The same split for texts in which str's classes agree with the properties above; about 1.5 times as fast.
_FAST = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_FAST = re.compile(r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]")
#: Rest words kept by a worker; longer ones than LONG are never kept.
CACHE, LONG = 300_000, 64


def _bytes_to_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@lru_cache(1)
def _unassigned() -> frozenset[str]:
    """Characters that Python's tables don't know; the tokenizer's newer or older tables may call them letters."""
    return frozenset(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")


class _Memo(dict):
    """key → made(key). The proved part stays; what is added to it is dropped when it outgrows CACHE."""

    def __init__(self, proved: dict, make):
        super().__init__(proved)
        self.proved, self.make = proved, make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= LONG:
            if len(self) >= len(self.proved) + CACHE:
                self.clear()
                self.update(self.proved)
            self[word] = value
        return value


class ByteBpe:
    def __init__(self, path: str, whole: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.chars = dict(enumerate(_bytes_to_chars()))
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ranked = self._ranked()
        self.whole = whole_tokens(self) if whole is None else whole
        self.counts = _Memo(dict.fromkeys(self.whole, 1), lambda w: len(self.merge(w)))
        self.ids = _Memo({w: (i,) for w, i in self.whole.items()}, self.merge)

    def _ranked(self):
        """The same merges by ranks of their results alone, about three times as fast; None if that isn't proved.

        Both methods always merge the pair of least rank. They can part only where two neighbours join to a vocabulary
        string t by another split than the one that t has a merge for. Up to then, merges within t's bytes were those that t
        alone undergoes, so the merges would leave t, encoded alone, in these two parts. If they turn every vocabulary
        string into its own token, that can't happen."""
        import tiktoken

        back, ranks = {c: b for b, c in self.chars.items()}, {}
        for shown, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if [t.id for t in self.model.tokenize(shown)] != [i] or not all(c in back for c in shown):
                return None
            ranks[bytes(back[c] for c in shown)] = i
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token by the merges."""
        if self.ranked is not None:
            return tuple(self.ranked._encode_single_piece(word))
        return tuple(t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.chars)))

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not _NOT_FAST.search(text):
            return _FAST.findall(text)
        if not text.isascii() and not _unassigned().isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.split.pre_tokenize_str(text)]
        return _EXACT.findall(text)

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as parts of their own at odd places."""
        return self.between.split(text) if self.between else [text]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return len(parts) // 2 + sum(sum(map(self.counts.__getitem__, self.words(p))) for p in parts[::2])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get = self.ids.__getitem__
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(self.special[part])
            elif self.ranked is not None and not _NOT_FAST.search(part):
                out += self.ranked.encode_ordinary(part)
            else:
                for ids in map(get, self.words(part)):
                    out += ids
        return out


def whole_tokens(bpe: ByteBpe) -> dict[str, int]:
    """Vocabulary strings that are a single pre-token and that the merges turn into exactly their own id: string → id.

    The proof runs the splitter and the merges on every string. As a pre-token is encoded without its neighbours, each
    later occurrence as a pre-token has that same one token."""
    back, out = {c: b for b, c in bpe.chars.items()}, {}
    for shown, i in bpe.tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in shown).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # not a text by itself; only merges make it
        if bpe.words(text) == [text] and bpe.merge(text) == (i,):
            out[text] = i
    return out


def loaded(path: str, whole: dict[str, int]) -> ByteBpe:
    """The worker's tokenizer for this file, made once."""
    key = (path, len(whole))
    if key not in _WORKER:
        _WORKER[key] = ByteBpe(path, whole)
    return _WORKER[key]


_WORKER: dict = {}


_PROVED: dict[str, dict[str, int]] = {}


def proved(spark: SparkSession, path: str) -> dict[str, int]:
    """The shortcut table; as large as the vocabulary at most. A worker makes it, and keeps its tokenizer for the texts."""
    if path not in _PROVED:

        def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _ in batches:
                made = ByteBpe(path)
                _WORKER[(path, len(made.whole))] = made
                yield pd.DataFrame({"whole": [pickle.dumps(made.whole)]})

        _PROVED[path] = pickle.loads(reach(spark).range(0, 1, 1, 1).mapInPandas(prove, "whole binary").first().whole)
    return _PROVED[path]
