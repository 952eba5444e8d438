"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text.  Their vote patterns, counted over
all documents, are what expectation-maximisation needs: it estimates how often each labeller votes
what on good and on bad texts, with no label at all.  The posterior of a text's pattern is its soft
label, and a linear scorer over hashed terms learns from a bounded sample of them; the scorer
judges every text, also where labellers abstain.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import SMALL_BLOCK, block_udf, bound_batches
from tessella.llm.components import durable
from tessella.llm.exprs import col
from tessella.llm.samples import first_of_each, one_of_each, text_hash
from tessella.llm.terms import Terms, distinct

#: Distinct texts that the scorer is fitted to (half of them likely bad ones, the first by hash), and their greatest length.
SAMPLE_TEXTS, SAMPLE_CHARS = 6000, 20_000
TERMS, LEAST_TEXTS = 20_000, 5
EPOCHS, BATCH, RATE, DECAY = 20, 128, 0.3, 1e-5
ROUNDS = 50
THRESHOLD = 0.5
SEED = 11

SYMBOL = re.compile(r"[#*$%&|<>]")
LETTERS = re.compile(r"[^\W\d_]+[.,;:?!]?\Z")
SHAPE = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"(\W)\1+"), lambda m: m[1])]

#: Labellers: the share that each looks at, bad from the first bound on, good up to the second.
LABELLERS = {
    "symbols": (0.15, 0.03),
    "pipes": (0.10, 0.01),
    "shouts": (0.30, 0.08),
    "bangs": (0.15, 0.03),
    "odd_words": (0.40, 0.12),
    "repeats": (0.40, 0.15),
    "stutters": (0.25, 0.05),
    "same_lines": (0.50, 0.20),
}
#: Of fewer lines none says anything.
LEAST_LINES, UNSEEN = 4, 0.3


def split(text: str) -> list[str]:
    return text.split()


def shape(word: str) -> str:
    if word.isalpha():
        return "A" if len(word) > 1 and word.isupper() else "a"
    if word[:-1].isalpha() and not (word[-1].isalnum() or word[-1] == "_"):
        return shape(word[:-1]) + word[-1]
    for pattern, put in SHAPE:
        word = pattern.sub(put, word)
    return word


def spell(word: str) -> list[str]:
    return [word.lower(), "^" + shape(word)]


def marks(word: str) -> tuple[bool, bool, bool, bool, bool]:
    """What the labellers count of a word."""
    if word.isalpha():
        return (False, False, len(word) > 2 and word.isupper(), False, False)
    return (SYMBOL.search(word) is not None, word == "|", len(word) > 2 and word.isupper(), "!" in word, not LETTERS.match(word))


def repeats(text: str, codes: np.ndarray) -> tuple[float, float, float]:
    """Shares of 3-word windows equal to an earlier one, of words equal to the one before, of lines equal to an
    earlier one.  codes: the words in order, equal ones alike."""
    windows, again = len(codes) - 2, 0.0
    if windows > 0:
        if codes.max() < 1 << 21:
            wide = codes.astype(np.int64)
            each = np.sort(wide[:-2] << 42 | wide[1:-1] << 21 | wide[2:])
            n = 1 + int((each[1:] != each[:-1]).sum())
        else:
            own = codes.tolist()
            n = len(set(zip(own, own[1:], own[2:])))
        again = 1 - n / windows
    stutters = int((codes[1:] == codes[:-1]).sum()) / max(1, len(codes))
    if text.count("\n") < LEAST_LINES - 1:
        return again, stutters, UNSEEN
    lines = [x for x in text.split("\n") if x.strip()]
    return again, stutters, 1 - len(set(lines)) / len(lines) if len(lines) >= LEAST_LINES else UNSEEN


class _Block:
    """Shares of all texts added; subclasses say what becomes of them."""

    def __init__(self, known: np.ndarray | None = None):
        self.terms, self.docs, self.marks = Terms(split, spell, known), [], np.zeros((0, 5), bool)

    def add(self, text: str) -> None:
        codes = self.terms.ordered(split(text))
        self.docs.append((*distinct(codes), len(codes), repeats(text, codes)))

    def shares(self) -> np.ndarray:
        new = list(self.terms.words)[len(self.marks) :]
        self.marks = np.concatenate([self.marks, np.array([marks(w) for w in new], bool).reshape(-1, 5)])
        return np.array([[*((self.marks[codes] * freq[:, None]).sum(0) / max(1, n)), *again] for codes, freq, n, again in self.docs]).reshape(-1, len(LABELLERS))

    def patterns(self, shares: np.ndarray) -> list[str]:
        """The votes on each text as a string; an empty text shows nothing to vote on."""
        return ["".join(map(str, v)) if d[2] else "2" * len(LABELLERS) for v, d in zip(votes(shares), self.docs)]

    def done(self) -> None:
        self.docs = []
        self.terms.done()
        if not self.terms.words:
            self.marks = self.marks[:0]


def votes(shares: np.ndarray) -> np.ndarray:
    """0 bad, 1 good, 2 nothing, by labeller."""
    bad, good = np.array(list(LABELLERS.values())).T
    return np.where(shares >= bad, 0, np.where(shares <= good, 1, 2))


class _Votes(_Block):
    def flush(self) -> pd.DataFrame:
        out = self.patterns(self.shares())
        self.done()
        return pd.DataFrame({"pattern": out})


def binned(shares: np.ndarray) -> list[np.ndarray]:
    """Terms of a text as a whole: its shares in steps, with numbers below those of hashes."""
    steps = np.minimum((shares * 10).astype(np.int64), 9)
    return list((-1 - steps - 10 * np.arange(shares.shape[1])).astype(np.int32))


class _Sample(_Block):
    """The terms of texts that were chosen, with their values."""

    def flush(self) -> pd.DataFrame:
        shares = self.shares()
        self.terms.resolve()
        rows = []
        for own, (codes, freq, n, _) in zip(binned(shares), self.docs):
            terms, counts = self.terms.counts(codes, freq)
            rows.append((np.concatenate([own, terms]), np.concatenate([np.ones(len(own)), np.sqrt(counts / max(1, n))]).astype(np.float32)))
        self.done()
        return pd.DataFrame(rows, columns=["terms", "values"])


#: Bad texts are of two kinds, and labellers of one kind see nothing wrong with the other.
KINDS = {"marked": ("symbols", "pipes", "shouts", "bangs", "odd_words"), "repeated": ("repeats", "stutters")}


class LabelModel:
    """Vote probabilities of each labeller on good texts and each kind of bad ones (in this order of
    classes), and each pattern's posterior of being good.

    patterns: counts by pattern, over all documents.
    """

    def __init__(self, patterns: dict[str, int]):
        self.patterns = sorted(patterns)
        n = np.array([patterns[p] for p in self.patterns], float)
        vote = np.array([list(map(int, p)) for p in self.patterns], int).reshape(-1, len(LABELLERS))
        kind = [(vote[:, [k for k, name in enumerate(LABELLERS) if name in own]] == 0).any(1) for own in KINDS.values()]
        start = np.where(kind[0], 1, np.where(kind[1], 2, 0))
        held = np.where(start == np.arange(3)[:, None], 0.9, 0.05)  # of each class, by pattern
        at = np.arange(len(LABELLERS))
        for _ in range(ROUNDS if len(n) else 0):
            weight = n * held
            self.share = (weight.sum(1) + 1) / (weight.sum() + 3)
            self.table = np.stack([[[(w[vote[:, k] == v].sum() + 1) / (w.sum() + 3) for v in range(3)] for k in at] for w in weight])
            log = np.stack([np.log(t[at, vote]).sum(1) for t in self.table]) + np.log(self.share)[:, None]
            held = np.exp(log - log.max(0))
            held /= held.sum(0)
        self.posterior = dict(zip(self.patterns, held[0].tolist()))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right where it votes."""
        good, bad = self.share[0] * self.table[0], (self.share[1:, None, None] * self.table[1:]).sum(0)
        right = good[:, 1] + bad[:, 0]
        return dict(zip(LABELLERS, (right / (right + good[:, 0] + bad[:, 1])).tolist()))


class Scorer:
    """A logistic scorer: known (sorted numbers of terms), bias and w."""

    def __init__(self, terms: list[np.ndarray], values: list[np.ndarray], soft: np.ndarray):
        every, seen = np.unique(np.concatenate([*terms, np.zeros(0, np.int32)]), return_counts=True)
        best = np.lexsort((every, -seen))[:TERMS]
        self.known = np.sort(every[best[(seen[best] >= LEAST_TEXTS) | (every[best] < 0)]]).astype(np.int32)
        self.w, self.bias = np.zeros(len(self.known)), 0.0
        if not len(self.known):
            return
        rows = []
        for t, v in zip(terms, values):
            at = np.minimum(np.searchsorted(self.known, t), len(self.known) - 1)
            ok = self.known[at] == t
            rows.append((at[ok], v[ok]))
        rng, gw, gb = np.random.default_rng(SEED), np.full(len(self.known), 1e-4), 1e-4
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for s in range(0, len(order), BATCH):
                own = order[s : s + BATCH]
                idx, val = (np.concatenate([rows[i][k] for i in own]) for k in (0, 1))
                doc = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
                error = _sigmoid(self.bias + np.bincount(doc, self.w[idx] * val, len(own))) - soft[own]
                d = np.bincount(idx, error[doc] * val, len(self.w)) / len(own) + DECAY * self.w
                gw += d * d
                gb += error.mean() ** 2
                self.w -= RATE * d / np.sqrt(gw)
                self.bias -= RATE * error.mean() / np.sqrt(gb)

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(_sigmoid(self.bias + (self.w[at] * values).sum()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Score(_Block):
    def __init__(self, scorer: Scorer):
        super().__init__(scorer.known)
        self.scorer = scorer

    def flush(self) -> pd.DataFrame:
        shares = self.shares()
        self.terms.resolve()
        known, out = self.scorer.known, []
        for (codes, freq, n, _), own in zip(self.docs, binned(shares)):
            at, counts = self.terms.counts(codes, freq)
            more = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            more = more[known[more] == own] if len(known) else more[:0]
            out.append(self.scorer.score(np.concatenate([more, at]).astype(np.int64), np.concatenate([np.ones(len(more)), np.sqrt(counts / max(1, n))])))
        self.done()
        return pd.DataFrame({"score": out})


def train(docs: DataFrame, text: str = "text") -> tuple[LabelModel, Scorer]:
    """The label model of all texts, and a scorer fitted to a sample of their posteriors.

    The sample holds the first ``SAMPLE_TEXTS / 2`` distinct texts that are likely good and as many likely
    bad ones, in order of hash, among those of up to ``SAMPLE_CHARS`` characters: the same whatever way the
    rows are dealt, and however many copies a text has.  Nulls vote as empty texts; no given label is
    read.  An empty table gives a scorer that says 0.5.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    t = col(text)
    hashed = docs.select(t.alias("t"), F.when(F.char_length(t).between(1, SAMPLE_CHARS), text_hash(t)).alias("h"))
    # Votes are cast once; what is kept of a text is its hash and its pattern.
    voted = durable(hashed.select("h", block_udf(_Votes, "pattern string", SMALL_BLOCK)(F.col("t"))["pattern"].alias("pattern")))
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}  # at most 3 ** labellers rows
    model = LabelModel(counts)
    if not counts:
        return model, Scorer([], [], np.zeros(0))
    posterior = F.broadcast(spark.createDataFrame(sorted(model.posterior.items()), "pattern string, soft double"))
    soft = voted.where("h is not null").join(posterior, "pattern").select((F.col("soft") < 0.5).cast("int").alias("kind"), "h", "soft")
    fit = {r["kind"]: r["count"] for r in soft.groupBy("kind").count().collect()}
    chosen = first_of_each(soft.select("kind", "h"), fit, dict.fromkeys(fit, SAMPLE_TEXTS // 2))
    chosen = one_of_each(soft, chosen).select("h", "soft")
    drawn = one_of_each(hashed.where("h is not null").withColumn("kind", F.lit(0)), chosen.select(F.lit(0).alias("kind"), "h")).join(F.broadcast(chosen), "h")
    rows = drawn.select("h", "soft", block_udf(_Sample, "terms array<int>, values array<float>", SMALL_BLOCK)(F.col("t")).alias("f")).select("h", "soft", "f.*")
    rows = rows.toArrow().to_pandas().sort_values("h", kind="stable")
    return model, Scorer(rows["terms"].tolist(), rows["values"].tolist(), rows["soft"].to_numpy(float))


def classify(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` and ``out``, a double from 0 to 1 (higher: likelier good).

    Every text is judged whole and by itself, so that equal ones score alike; null and empty texts score as
    a text without words, an empty table gives an empty one, and a column that is named ``out`` is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)
    scored = docs.withColumn(out, block_udf(lambda: _Score(shared.value), "score double", SMALL_BLOCK)(col(text)))
    return scored.withColumn(out, col(out)["score"])
