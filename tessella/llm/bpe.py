"""BPE encoding and decoding by a pair occurrence index, and token counts by distinct pre-token.

A block of documents is reduced to its distinct pre-tokens.  All their symbols lie in one flat
array with links to the neighbours; an index maps each active rank (a pair that can be merged)
to all its positions in the block.  Ranks are taken in ascending order: every position of the
lowest rank is merged at once, and only the pairs next to a merge are looked up and added to
their rank's list.  In a vocabulary where every merge comes after the merges that make its
parts, a new pair always ranks after the pair just merged, so this order gives each word the
same merges as taking the word's lowest rank again and again; ``Vocabulary`` refuses others.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm.blocks import SMALL_BLOCK, bound_batches, block_udf

#: Characters beyond these take the library's own normaliser and splitter: for the ones here (Latin
#: letters, digits, usual punctuation) NFC changes nothing and ``re`` knows the same classes.
FAST_ONLY = re.compile("[^\x01-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
#: The file's split pattern, as ``re`` spells it for these characters.
FAST_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Distinct pre-tokens kept with their pieces from block to block of a task; then the table is emptied.
TABLE_WORDS = 400_000
#: The same where ids are the result, which take memory of their own.
SMALL_TABLE = 150_000

ENCODED = "n_tokens long, ids array<int>"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def distinct(x: np.ndarray) -> np.ndarray:
    """The values in ascending order, each once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


class Vocabulary:
    """A word-level BPE vocabulary with word ends, read from a tokenizers file.

    Reproduces that file's chain: special strings cut out of the raw text, NFC, white space,
    lower case letter by letter, the split pattern, bytes as symbols, merges, no decoder.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["end_of_word_suffix"] != "</w>" or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLIT:
            raise ValueError(f"{path}: not a word-end BPE file of the kind that this operator reproduces")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        #: Each id in decimal, and its token's string.
        self.spelled = {i: str(i) for i in self.tokens}, self.tokens
        marks = byte_symbols()
        self.inner = np.array([vocab[c] for c in marks], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in marks], np.int32)
        pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in model["merges"]], np.int64)
        made = dict(zip(pairs[:, 2].tolist(), range(len(pairs))))
        if len(made) < len(pairs) or any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b) in enumerate(pairs[:, :2].tolist())):
            raise ValueError(f"{path}: a merge precedes the merges of its parts, so ascending ranks would not be exact")
        self.left, self.right = pairs[:, 0], pairs[:, 1]
        self.product = pairs[:, 2].astype(np.int32)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no such merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def words(self, text: str) -> list[str]:
        """The text as words, each of which is split into pre-tokens on its own.

        White space never lies inside a pre-token, so these are the lower-cased runs between it.  A
        pre-token that stands as it is, such as a special string, is a word that starts with NUL.
        """
        if "<|" not in text:
            return self._ordinary(text)
        out = []
        for k, part in enumerate(self.special_pattern.split(text)):
            out += ["\0" + part] if k % 2 else self._ordinary(part)
        return out

    def _ordinary(self, text: str) -> list[str]:
        if not FAST_ONLY.search(text):
            return text.lower().split()
        text = self.normalizer.normalize_str(text)
        return ["\0" + text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    @staticmethod
    def pretokens(word: str) -> list[str]:
        """The pre-tokens of a word."""
        if word.isalpha():
            return [word]
        return [word[1:]] if word[0] == "\0" else FAST_SPLIT.findall(word)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after the other, and where each word's ids end."""
        raw = [w.encode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        for k in [k for k, w in enumerate(words) if w[0] == "<"]:
            if (w := words[k]) in self.special:  # one symbol, which no merge has
                symbols[ends[k] - lengths[k] : ends[k]] = -1
                symbols[ends[k] - 1] = self.special[w]
        alive = self._merge(symbols, ends) & (symbols >= 0)
        return symbols[alive], np.cumsum(alive)[ends - 1]

    def _merge(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(symbols)
        alive = np.ones(n, bool)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # -1: there is none in this word
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter pairs by the position of their left symbol."""
            ranks = self.rank(symbols[at], symbols[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for start, part in zip(starts, np.split(at, cuts) if len(cuts) else [at]):
                rank = int(ranks[start])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(part)

        add(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            then = after[at]
            at = at[alive[at] & (symbols[at] == a) & (then >= 0) & (symbols[then] == b)]
            if len(lists) > 1 or a == b:
                at = distinct(at)
            if a == b and len(at) > 1:  # in a run of the same symbol every other pair merges, from the left
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = self.product[rank]
            alive[gone] = False
            then = after[gone]
            after[at] = then
            before[then[then >= 0]] = at[then >= 0]
            prior = before[at]
            add(distinct(np.concatenate([prior[prior >= 0], at[then >= 0]])))
        return alive


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each Python process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class _Block:
    """Documents as codes of distinct words, and words as codes of distinct pre-tokens."""

    def __init__(self, path: str, most: int = TABLE_WORDS):
        self.vocab, self.most = vocabulary(path), most
        self.docs: list[np.ndarray] = []
        self._clear()

    def _clear(self) -> None:
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.pre: defaultdict[str, int] = defaultdict()
        self.pre.default_factory = self.pre.__len__
        self.word_counts, self.pre_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, text: str) -> None:
        words = self.vocab.words(text)
        self.docs.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))

    def resolve(self) -> None:
        """Encode the pre-tokens not met before, each once, and put the new words together."""
        known, had = len(self.word_counts), len(self.pre)
        code, split = self.pre.__getitem__, self.vocab.pretokens
        parts = [[code(w)] if w.isalpha() else list(map(code, split(w))) for w in islice(self.words, known, None)]
        ids, ends = self.vocab.encode_words(list(islice(self.pre, had, None)))
        self.pre_counts = np.concatenate([self.pre_counts, np.diff(ends, prepend=0)])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum()))
        totals = np.concatenate([[0], np.cumsum(self.pre_counts[flat])])
        at = np.cumsum(sizes)
        self.word_counts = np.concatenate([self.word_counts, totals[at] - totals[at - sizes]])
        self.keep(parts, flat, ids, ends)

    def keep(self, parts: list[list[int]], flat: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Take what is needed of new words (``parts``, and one after the other ``flat``) and new pre-tokens (``ids`` up to ``ends``)."""

    def done(self) -> None:
        self.docs = []
        if len(self.words) > self.most:
            self._clear()


def gather(codes: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (run c has counts[c] items) that ``codes`` name, one after the other."""
    n = counts[codes]
    ends = np.cumsum(n)
    starts = np.cumsum(counts) - counts
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - n), n)]


class _Encode(_Block):
    def _clear(self) -> None:
        super()._clear()
        self.pre_ids, self.word_ids = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def keep(self, parts, flat, ids, ends):
        self.pre_ids = np.concatenate([self.pre_ids, ids.astype(np.int32)])
        self.word_ids = np.concatenate([self.word_ids, gather(flat, self.pre_counts, self.pre_ids)])

    def encoded(self) -> list[np.ndarray]:
        """The ids of each document added since the last call."""
        self.resolve()
        codes = np.concatenate([*self.docs, np.zeros(0, np.int32)])
        ends = np.cumsum(np.concatenate([[0], self.word_counts[codes]]))
        cuts = ends[np.cumsum([len(d) for d in self.docs])] if self.docs else []
        ids = np.split(gather(codes, self.word_counts, self.word_ids), cuts[:-1]) if self.docs else []
        self.done()
        return ids

    def flush(self) -> pd.DataFrame:
        ids = self.encoded()
        return pd.DataFrame({"n_tokens": [len(x) for x in ids], "ids": ids})


class _Digest(_Block):
    """Digests of ids and decoded texts, from the spelling of each distinct word's pieces."""

    def _clear(self) -> None:
        super()._clear()
        self.pre_texts: tuple[list[str], list[str]] = ([], [])
        self.word_texts: tuple[list[str], list[str]] = ([], [])

    def keep(self, parts, flat, ids, ends):
        own_ids, cuts = ids.tolist(), ends.tolist()
        for pre, word, spelled in zip(self.pre_texts, self.word_texts, self.vocab.spelled):
            texts = list(map(spelled.__getitem__, own_ids))
            pre += [" ".join(texts[a:b]) for a, b in zip([0, *cuts], cuts)]
            word += [pre[own[0]] if len(own) == 1 else " ".join([pre[c] for c in own]) for own in parts]

    def flush(self) -> pd.DataFrame:
        self.resolve()
        rows = []
        for doc in self.docs:
            codes = doc.tolist()
            digests = [hashlib.sha256(" ".join(map(texts.__getitem__, codes)).encode()).hexdigest() for texts in self.word_texts]
            rows.append((int(self.word_counts[doc].sum()), *digests))
        self.done()
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


class _Count(_Block):
    """Token counts: per-document frequencies joined to the piece counts of distinct pre-tokens."""

    def flush(self) -> pd.DataFrame:
        self.resolve()
        n = []
        for doc in self.docs:
            code, freq = np.unique(doc, return_counts=True)
            n.append(int((self.word_counts[code] * freq).sum()))
        self.done()
        return pd.DataFrame({"n_tokens": np.array(n, np.int64)})


def encode_column(text: Column, path: str) -> Column:
    """struct(n_tokens, ids) of a text column."""
    return block_udf(lambda: _Encode(path, SMALL_TABLE), ENCODED, SMALL_BLOCK)(text)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "encoded") -> DataFrame:
    """All rows and columns of ``docs`` and struct ``out`` (n_tokens long, ids array<int>).

    Null and empty texts have no ids.  Special strings in a text are their own ids.  Repeated rows
    are encoded alike; a column that is named ``out`` is replaced.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, encode_column(F.col(f"`{text}`"), path))


def decode_column(ids: Column, path: str) -> Column:
    """The text of an array of ids: without a decoder in the file, token strings joined by spaces."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        token = vocabulary(path).tokens
        return batch.map(lambda own: None if own is None else " ".join([token[i] for i in own]))

    return run(ids)


def encode_digest(docs: DataFrame, path: str, text: str = "text", out: str = "encoded") -> DataFrame:
    """As ``encode``, with digests in place of ids: struct (n_tokens, ids_sha256, decoded_sha256).

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded text.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, block_udf(lambda: _Digest(path), DIGEST)(F.col(f"`{text}`")))


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """All rows and columns of ``docs`` and ``out``, the number of tokens; null and empty texts have 0.

    Pieces are counted once for each distinct pre-token of a task, and the counts are joined to
    the per-document frequencies inside the task; no document's ids are made.
    """
    bound_batches(docs.sparkSession)
    counted = docs.withColumn(out, block_udf(lambda: _Count(path), "n_tokens long")(F.col(f"`{text}`")))
    return counted.withColumn(out, F.col(f"`{out}`.n_tokens"))
