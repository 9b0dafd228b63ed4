"""Exact word-level encoding with a ``tokenizers`` vocabulary file.

The public vocabulary normalises (NFC, white space, lower case), cuts the text
into words by a fixed pattern and merges inside each word only. A word's ids
therefore depend on that word alone, which is what makes a word table possible.

``WordSplitter.words`` gives the same words as the library does. Texts whose
characters all lie below U+0250 (or in a few punctuation ranges) are composed
already and are split by one regular expression; any other text goes to the
library's own normaliser and pre-tokeniser, so no script is approximated.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

from .common import cached

#: Characters for which the plain pattern needs no composition.
PLAIN = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")


def _chars(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


#: The vocabulary file's word pattern (fixed value): English endings, runs of
#: letters, single digits, runs of anything else but white space.
WORD = re.compile(f"[{_chars('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_chars('N')}]|[^\\t-\\r\\x20\\x85\\xa0{_chars('L')}{_chars('N')}]+")
#: Words kept per worker; the cache is emptied when it is full.
CACHE_WORDS = 500_000


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


class WordSplitter:
    """Splits whole texts into the vocabulary's words; special strings stay whole."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.specials = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def _part(self, text: str) -> list[str]:
        if PLAIN.search(text):
            norm = self.tok.normalizer.normalize_str(text)
            return [norm[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
        return WORD.findall(text.lower())

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self._part(text)
        out: list[str] = []
        for piece in self.cut.split(text):
            if piece in self.specials:
                out.append(piece)
            elif piece:
                out.extend(self._part(piece))
        return out


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes, with a bounded cache."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.splitter = WordSplitter(path)
        self.tok = self.splitter.tok
        self.cache_words = cache_words
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        size = self.tok.get_vocab_size()
        #: The id-to-piece table, and whether a piece ends a word.
        self.pieces = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([bool(suffix) and piece.endswith(suffix) for piece in self.pieces])

    def learn(self, new: set[str]) -> None:
        """Encodes new words, each once; a full cache is emptied first."""
        if len(self) + len(new) > self.cache_words:
            self.clear()
        ordered = list(new)
        for i in range(0, len(ordered), 4096):
            self.update(zip(ordered[i : i + 4096], self.ids_of(ordered[i : i + 4096])))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """One call for many words, cut at the pieces that end a word where these tell the words apart."""
        special = self.splitter.specials
        plain = [w for w in words if w not in special]
        ids = np.array(self.tok.encode(" ".join(plain), add_special_tokens=False).ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) == len(plain):
            packed = ids.tobytes()
            found = iter([packed[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)])
        else:
            found = iter([array("I", e.ids).tobytes() for e in self.tok.encode_batch(plain, add_special_tokens=False)])
        return [special[w].to_bytes(4, "little") if w in special else next(found) for w in words]

    def _holes(self, found: list) -> list[int]:
        """Where a word's ids are lacking."""
        at, i = [], -1
        try:
            while True:
                i = found.index(None, i + 1)
                at.append(i)
        except ValueError:
            return at

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids."""
        found = list(map(self.get, words))
        if at := self._holes(found):
            self.learn({words[i] for i in at})
            for i in at:
                found[i] = self[words[i]]
        return found

    def encode_many(self, texts) -> list[bytes]:
        """Each text's ids. Words that the cache lacks are encoded together."""
        split, get = self.splitter.words, self.get
        out: list[bytes] = []
        lacking: list[tuple[int, list[str], list, list[int]]] = []
        new: set[str] = set()
        for text in texts:
            words = split(text)
            found = list(map(get, words))
            if at := self._holes(found):
                new.update([words[i] for i in at])
                lacking.append((len(out), words, found, at))
                out.append(b"")
            else:
                out.append(b"".join(found))
        self.learn(new)
        for k, words, found, at in lacking:
            for i in at:
                found[i] = self[words[i]]
            out[k] = b"".join(found)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process: later tasks find its cache filled."""
    cached(encoder.cache_clear)
    cached(load.cache_clear)
    return WordEncoder(path)
