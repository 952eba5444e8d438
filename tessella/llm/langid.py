"""Language identification by segmentation-marginalised unigrams.

The pieces are all those of a fixed public vocabulary that can lie inside a word.  Each language
has a probability for every piece, learned by expectation-maximisation over all segmentations of
its sample's words.  A word's likelihood is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words.  A word is a run of letters of any
length: sums over long ones are scaled as they go.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import SMALL_BLOCK, block_udf, bound_batches
from tessella.llm.exprs import col
from tessella.llm.samples import first_of_each, one_of_each, text_hash

#: Distinct texts of a language that are learned from (the first by hash), and their greatest length.
SAMPLE_TEXTS, SAMPLE_CHARS = 300, 8000
#: Languages that are learned (the most frequent ones), and texts of all of them: many languages have fewer each.
MOST_LANGS, SAMPLE_ROWS = 300, 20_000
ROUNDS = 4
#: Sums are scaled at every SCALE_STEP-th character from SCALE_FROM on; words beyond LONG characters are summed one by one.
SCALE_FROM, SCALE_STEP, LONG = 32, 8, 512
#: Probability of a character that no piece covers, and weight of a piece that was never expected.
UNKNOWN, FLOOR = 1e-7, 0.05
START = "▁"
#: The table of words is emptied at so many words or characters; words are worked on in parts of so many characters.
TABLE_WORDS, TABLE_CHARS, PART_CHARS = 150_000, 8_000_000, 100_000
BASE = np.uint64(0x9E3779B97F4A7C15)

RUN = re.compile(r"[^\W\d_]+")
UND = "und"


def runs(text: str) -> list[str]:
    """The text's runs of letters in lower case."""
    return RUN.findall(text.lower())


class Pieces:
    """Sorted hashes of the pieces, and the greatest length of one.  A piece's id is its place, plus one."""

    def __init__(self, pieces: set[str]):
        self.most = max(map(len, pieces), default=1)
        self.hashes = np.unique(np.array([piece_hash(p) for p in pieces], np.uint64))
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.hashes >> np.uint64(46)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, rolled: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
        """Ids of the pieces of ``n`` characters by hash, 0 where there is none or the word ends before."""
        own = np.zeros(len(rolled), np.int32)
        if not len(self.hashes):
            return own
        mixed = _mix(rolled)
        at = np.flatnonzero((left >= n) & self.sieve[(mixed >> np.uint64(46)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, mixed[at]), len(self.hashes) - 1)
        own[at] = np.where(self.hashes[k] == mixed[at], k + 1, 0)
        return own


class Lattice:
    """All pieces inside a list of words, found at once by rolling hashes."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.words = sorted(range(len(words)), key=lambda i: -len(words[i]))
        spelled = [START + words[i] for i in self.words]
        self.sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        flat = np.frombuffer("".join(spelled).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        left = np.repeat(self.ends, self.sizes) - np.arange(len(flat))  # characters up to the word's end
        self.pieces, h = [], np.zeros(len(flat), np.uint64)
        for n in range(1, min(pieces.most, int(self.sizes.max(initial=1))) + 1):
            h = h * BASE + np.pad(flat[n - 1 :], (0, min(n - 1, len(flat))))[: len(flat)]
            self.pieces.append(pieces.find(h, left, n))
        self.active = [int(np.searchsorted(-self.sizes, -j, "right")) for j in range(int(self.sizes.max(initial=0)) + 1)]

    def _sums(self, p: np.ndarray, node: np.ndarray, step: int, owned) -> tuple[np.ndarray, np.ndarray]:
        """Sums by node, and the logs that they were scaled by.  ``step`` 1 goes forward from ``node``, -1 back;
        ``owned(n, j, m)`` has the piece of n characters that ends a way of j ones, for the m longest words."""
        a = np.zeros((len(self.pieces[0]) + len(self.starts), p.shape[1]))
        logs = np.zeros_like(a) if len(self.active) > SCALE_FROM else None
        a[node] = 1
        gone = np.zeros((len(node), p.shape[1]))
        for j in range(1, len(self.active)):
            m = self.active[j]
            to = node[:m] + step * j
            own = owned(1, j, m)
            sums = a[to - step] * p[own]
            none = np.flatnonzero(own == 0)
            sums[none] = a[to[none] - step] * UNKNOWN
            for n in range(2, min(j, len(self.pieces)) + 1):
                own = owned(n, j, m)
                at = np.flatnonzero(own)
                if len(at):
                    sums[at] += a[to[at] - step * n] * p[own[at]]
            a[to] = sums
            if j >= SCALE_FROM:
                logs[to] = gone[:m]
                if j % SCALE_STEP == 0:
                    gone[:m] += np.log(sums)
                    for n in range(min(j, len(self.pieces))):
                        a[to - step * n] /= sums
                        logs[to - step * n] += np.log(sums)
        return a, logs

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Probability sums by node (a place between characters, one more than characters in each word)."""
        return self._sums(p, self.starts + np.arange(len(self.starts)), 1, lambda n, j, m: self.pieces[n - 1][self.starts[:m] + j - n])

    def backward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        return self._sums(p, self.ends + np.arange(len(self.ends)), -1, lambda n, j, m: self.pieces[n - 1][self.ends[:m] - j])

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word, in the order they came, by column of ``p``."""
        a, logs = self.forward(p)
        ends = self.ends + np.arange(len(self.ends))
        out = np.empty((len(self.words), p.shape[1]))
        out[self.words] = np.log(a[ends]) + (0 if logs is None else logs[ends])
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, where each word counts ``weight`` times (by column)."""
        (a, la), (b, lb) = self.forward(p), self.backward(p)
        end = self.ends + np.arange(len(self.ends))
        every, word = np.arange(len(self.pieces[0])), np.repeat(np.arange(len(self.starts)), self.sizes)
        at = every + word
        uses = np.zeros_like(p)
        for n in range(1, len(self.pieces) + 1):
            own = self.pieces[n - 1]
            k = np.flatnonzero(own)
            flow = a[at[k]] * p[own[k]] * b[at[k] + n] * (weight[self.words] / a[end])[word[k]]
            if la is not None:
                flow *= np.exp(la[at[k]] + lb[at[k] + n] - la[end][word[k]])
            for c in range(p.shape[1]):
                uses[:, c] += np.bincount(own[k], flow[:, c], len(p))
        return uses


def long_likelihood(pieces: Pieces, p: np.ndarray, word: str) -> np.ndarray:
    """``Lattice.likelihood`` of one long word: memory holds a part of it at a time."""
    flat = np.frombuffer((START + word).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    most, size = pieces.most, len(flat)
    sums, log = np.zeros((most, p.shape[1])), np.zeros(p.shape[1])  # of the last places, the nearest first
    sums[0] = 1
    for start in range(0, size, 4096):
        stop = min(size, start + 4096)
        own = np.zeros((stop - start, most), np.int32)  # pieces by where they end, and length
        lo = max(0, start - most + 1)
        part, h = flat[lo:stop], np.zeros(stop - lo, np.uint64)
        left = len(part) - np.arange(len(part))
        for n in range(1, min(most, len(part)) + 1):
            h = h * BASE + np.pad(part[n - 1 :], (0, n - 1))
            found = pieces.find(h, left, n)
            to = np.arange(len(part)) + n - 1 + lo - start  # where a piece ends
            ok = (to >= 0) & (to < stop - start)
            own[to[ok], n - 1] = found[ok]
        for j, ids in enumerate(own):
            new = (sums * p[ids]).sum(0)
            if ids[0] == 0:
                new = new + sums[0] * UNKNOWN
            sums[1:] = sums[:-1]
            sums[0] = new
            if j % SCALE_STEP == 0:
                log += np.log(new)
                sums /= new
    return np.log(sums[0]) + log


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def piece_hash(piece: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = h * BASE + np.uint64(ord(c))
    return _mix(h)[0]


def piece_keys(path: str) -> Pieces:
    """A sentencepiece file's pieces that can lie inside a word, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return Pieces({p for p in found if p == START or p.replace(START, "").isalpha()})


def parts_of(items: list[int], sizes: list[int]) -> list[list[int]]:
    """The items in parts of so many characters (one item at least), which bounds a lattice."""
    place = np.cumsum(sizes) // PART_CHARS
    return [x.tolist() for x in np.split(np.array(items, np.int64), np.flatnonzero(np.diff(place)) + 1) if len(x)]


class Model:
    """langs, and by piece (the first stands for none) and language its probability."""

    def __init__(self, keys: Pieces, samples: dict[str, Counter]):
        self.keys, self.langs = keys, sorted(samples)
        words = sorted({w for c in samples.values() for w in c})
        weight = np.array([[samples[lang][w] for lang in self.langs] for w in words], float).reshape(len(words), len(self.langs))
        p = np.full((len(keys) + 1, len(self.langs)), 1.0 / max(1, len(keys)))
        p[0] = 0
        for _ in range(ROUNDS if words else 0):
            uses = np.full_like(p, FLOOR)
            for part in parts_of(list(range(len(words))), list(map(len, words))):
                uses += Lattice(keys, [words[i] for i in part]).expected(p, weight[part])
            uses[0] = 0
            p = uses / uses.sum(0)
        self.p = p

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for part in parts_of(short, [len(words[i]) for i in short]):
            out[part] = Lattice(self.keys, [words[i] for i in part]).likelihood(self.p)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = long_likelihood(self.keys, self.p, w)
        return out


class _Predict:
    def __init__(self, model: Model):
        self.model, self.docs = model, []
        self._clear()

    def _clear(self) -> None:
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.chars = 0
        self.known = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0, bool)

    def add(self, text: str) -> None:
        words = runs(text)
        self.docs.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))

    def flush(self) -> pd.DataFrame:
        new = list(self.words)[len(self.known) :]
        self.chars += sum(map(len, new))
        self.known = np.concatenate([self.known, self.model.scores(new)])
        self.letters = np.concatenate([self.letters, np.fromiter((any(map(str.isalpha, w)) for w in new), bool, len(new))])
        rows = []
        for doc in self.docs:
            if not len(doc) or not self.letters[doc].any() or not self.model.langs:
                rows.append((UND, 0.0))
                continue
            own = self.known[doc[self.letters[doc]]].sum(0)
            best = int(own.argmax())
            rows.append((self.model.langs[best], float(1 / np.exp(own - own[best]).sum())))
        self.docs = []
        if len(self.words) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self._clear()
        return pd.DataFrame(rows, columns=["lang_pred", "score"])


def train(docs: DataFrame, piece_file: str, text: str = "text", lang: str = "lang") -> Model:
    """A model from rows of ``docs`` with a language.

    It learns the ``MOST_LANGS`` languages with the most rows (ties by name), each from its first
    ``SAMPLE_TEXTS`` distinct texts in order of hash (``SAMPLE_ROWS`` shared out evenly where that is less),
    among those of up to ``SAMPLE_CHARS`` characters; the same whatever way the rows are dealt, and however many copies a text has.  Nulls in either column
    are left out; without any row the model knows no language and every prediction is ``und``.
    """
    rows = docs.select(col(text).alias("t"), col(lang).alias("kind")).where(f"t is not null and kind is not null and char_length(t) between 1 and {SAMPLE_CHARS}")
    counts = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(MOST_LANGS).collect()}
    if not counts:
        return Model(piece_keys(piece_file), {})
    hashed = rows.withColumn("h", text_hash(F.col("t")))
    chosen = first_of_each(hashed.select("kind", "h"), counts, dict.fromkeys(counts, min(SAMPLE_TEXTS, SAMPLE_ROWS // len(counts))))
    samples: dict[str, Counter] = {k: Counter() for k in counts}
    for row in one_of_each(hashed, chosen).collect():
        samples[row["kind"]].update(runs(row["t"]))
    return Model(piece_keys(piece_file), samples)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """All rows and columns of ``docs`` and struct ``out`` (lang_pred string, score double).

    score is the posterior of the predicted language among those learned, from equal priors.  Texts
    that are null, empty or without a letter are ``und`` with score 0; texts are read whole, equal ones
    score alike, ties go to the first language in order, an empty table gives an empty one, and a column
    that is named ``out`` is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return docs.withColumn(out, block_udf(lambda: _Predict(shared.value), "lang_pred string, score double", SMALL_BLOCK)(col(text)))
