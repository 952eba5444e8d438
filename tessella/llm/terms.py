"""Hashed terms of a text's words, shared by the scorers that are trained here."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import xxhash


#: Known terms up to which a document's are counted in a list of all.
DENSE = 1 << 16


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes in ascending order, and how often each occurs."""
    codes = np.sort(codes)
    if not len(codes):
        return codes, codes
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.diff(starts, append=len(codes)).astype(np.int32)


class Terms:
    """Distinct words of a block of documents, and each word's hashed terms.

    ``spell(word)`` gives a word's terms as strings; a term's number is its 31-bit hash.
    With ``known`` (sorted hashes), terms that aren't in it are left out.  The table of words is
    emptied between blocks once it holds ``most`` words or ``most_chars`` characters, so its memory is bounded.
    """

    def __init__(self, split: Callable[[str], list[str]], spell: Callable[[str], list[str]], known: np.ndarray | None = None, most: int = 150_000, most_chars: int = 8_000_000):
        self.split, self.spell, self.known, self.most, self.most_chars = split, spell, known, most, most_chars
        self._clear()

    def _clear(self) -> None:
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.chars = 0
        # The words' terms, one word after the other, and where each word's start.
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the text's distinct words in ascending order, and how often each occurs."""
        return distinct(self.ordered(self.split(text)))

    def ordered(self, words: list[str]) -> np.ndarray:
        """The words' codes, in the order of the text."""
        return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))

    def resolve(self) -> None:
        new = list(self.words)[len(self.sizes) :]
        self.chars += sum(map(len, new))
        hashed = [[xxhash.xxh32_intdigest(t) & 0x7FFFFFFF for t in self.spell(word)] for word in new]
        h = np.fromiter((x for own in hashed for x in own), np.int32)
        owner = np.repeat(np.arange(len(hashed)), [len(own) for own in hashed])
        if self.known is not None:
            at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1)).astype(np.int32)
            found = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
            h, owner = at[found], owner[found]
        sizes = np.bincount(owner, minlength=len(hashed))
        self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, h])

    def counts(self, codes: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A document's terms (hashes, or places in ``known``) and how often each occurs."""
        n = self.sizes[codes]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int32), np.zeros(0)
        own = self.flat[np.arange(total) + np.repeat(self.starts[codes] - (np.cumsum(n) - n), n)]
        if self.known is not None and len(self.known) < DENSE:  # places in a short list
            sums = np.bincount(own, np.repeat(freq, n))
            terms = np.flatnonzero(sums).astype(np.int32)
            return terms, sums[terms]
        terms, place = np.unique(own, return_inverse=True)
        return terms, np.bincount(place, np.repeat(freq, n))

    def done(self) -> None:
        if len(self.words) > self.most or self.chars > self.most_chars:
            self._clear()
