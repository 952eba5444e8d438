"""Toxicity by a factorization machine over hashed terms.

y = bias + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j.  The pair part learns that two
terms together, such as an insult and the mention of a group, mean more or less than the sum of
their own weights.  Terms are words and word beginnings, present or repeated, hashed to 31 bits; the
model holds those that tell the labelled classes apart, by themselves or in a pair.
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
from tessella.llm.samples import below, first_of_each, one_of_each, text_hash
from tessella.llm.terms import Terms

#: Distinct labelled texts that are learned from at most (the first by hash), of labels 0 and 1, and their greatest length.
SAMPLE_TEXTS, SAMPLE_CHARS = (5000, 2500), 12_000
#: Labelled keys are looked at by hash: so many times the wanted number at first, and so many times more
#: where their distinct texts are too few.  Up to BROADCAST_KEYS (16 bytes each) are broadcast.
FIRST_KEYS, MORE_KEYS, BROADCAST_KEYS = 3, 8, 500_000
#: Terms in the model at most, texts of the sample that a term must be in, its least gain (a share of
#: chi-squared, against terms that tell the labels apart by chance), and factors of a term.
TERMS, LEAST_TEXTS, LEAST_GAIN, FACTORS = 8000, 3, 8.0, 8
#: The most frequent terms whose pairs are looked at, texts that a pair must be in, the least surprise of
#: its labels (a few chance ones among two million pairs), and pairs whose terms are taken at most.
PAIRED, LEAST_PAIR, PAIR_GAIN, PAIRS = 2000, 10, 30.0, 2000
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.05, 2e-4
THRESHOLD = 0.3
SEED = 7

RUN = re.compile(r"[^\W\d_]+")
#: A beginning counts as a term of its own from so many occurrences on, as well.
OFTEN = 3


def split(text: str) -> list[str]:
    return RUN.findall(text.lower())


def spell(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in (4, 5, 6, 7) if len(word) > n)]


def features(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of a text's terms, and of those that occur often."""
    return np.unique(np.concatenate([terms, (terms[counts >= OFTEN] ^ 0x2AAAAAAA)]))


class _Features:
    def __init__(self):
        self.terms, self.docs = Terms(split, spell), []

    def add(self, text: str) -> None:
        self.docs.append(self.terms.codes(text))

    def flush(self) -> pd.DataFrame:
        self.terms.resolve()
        out = pd.DataFrame({"terms": [features(*self.terms.counts(*d)) for d in self.docs]})
        self.docs = []
        self.terms.done()
        return out


def surprise(positive: np.ndarray, inside: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of so many positives against the rate that was expected."""
    rate = np.clip(rate, 1e-9, 1 - 1e-9)
    negative = inside - positive
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(positive > 0, positive * np.log(positive / (inside * rate)), 0.0)
        b = np.where(negative > 0, negative * np.log(negative / (inside * (1 - rate))), 0.0)
    return 2 * (a + b)


class Machine:
    """known (sorted hashes of the terms), bias, w and v.

    A term is in the model for its own sake, if it tells the labels apart, or for a pair's: of the most
    frequent terms, those whose pair is labelled otherwise than their two rates make one expect.
    """

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray):
        y = labels.astype(float)
        flat = np.concatenate([*texts, np.zeros(0, np.int32)]).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        every, place = np.unique(flat, return_inverse=True)
        inside, positive = np.bincount(place, minlength=len(every)), np.bincount(place, y[owner], len(every))
        n, p = len(y), y.sum()
        expected = inside * p / max(n, 1)
        gain = (positive - expected) ** 2 / np.maximum(expected, 1e-9)
        gain[(inside < LEAST_TEXTS) | (gain < LEAST_GAIN)] = -1
        best = np.lexsort((every, -gain))[:TERMS]
        alone = best[gain[best] >= 0]
        self.known = np.sort(every[np.union1d(alone, self._paired(place, owner, inside, positive, y))]).astype(np.int32)
        rng = np.random.default_rng(SEED)
        self.bias = float(np.log((p + 1) / (n - p + 1)))
        self.w, self.v = np.zeros(len(self.known)), rng.normal(0, 0.02, (len(self.known), FACTORS))
        rows = [np.searchsorted(self.known, np.intersect1d(t, self.known)) for t in texts]
        if 0 < p < n and len(self.known):
            self._fit(rows, y, rng)

    @staticmethod
    def _paired(place: np.ndarray, owner: np.ndarray, inside: np.ndarray, positive: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Terms of the pairs whose labels surprise most, from the ``PAIRED`` most frequent terms."""
        n, p = len(y), y.sum()
        often = np.lexsort((np.arange(len(inside)), -inside))[:PAIRED]
        often = np.sort(often[inside[often] >= LEAST_PAIR])
        if not 0 < p < n or len(often) < 2:
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(often, place), len(often) - 1)
        ok = often[at] == place
        x = np.zeros((n, len(often)), np.float32)
        x[owner[ok], at[ok]] = 1
        both, toxic = x.T @ x, x.T @ (x * y[:, None].astype(np.float32))
        i, j = np.nonzero(np.triu(both >= LEAST_PAIR, 1))
        rate = (positive / np.maximum(inside, 1))[often]
        odds = np.log((rate + 1e-3) / (1 - rate + 1e-3))
        base = np.log(p / (n - p))
        gain = surprise(toxic[i, j].astype(float), both[i, j].astype(float), _sigmoid(odds[i] + odds[j] - base))
        best = np.lexsort((j, i, -gain))[:PAIRS]
        best = best[gain[best] >= PAIR_GAIN]
        return often[np.union1d(i[best], j[best])]

    def _fit(self, rows: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for s in range(0, len(order), BATCH):
                own = order[s : s + BATCH]
                idx = np.concatenate([rows[i] for i in own])
                doc = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
                v = self.v[idx]
                sums = np.stack([np.bincount(doc, v[:, k], len(own)) for k in range(FACTORS)], 1)
                squares = np.bincount(doc, (v * v).sum(1), len(own))
                score = self.bias + np.bincount(doc, self.w[idx], len(own)) + ((sums**2).sum(1) - squares) / 2
                error = _sigmoid(score) - y[own]
                used, at = np.unique(idx, return_inverse=True)
                dw = np.bincount(at, error[doc], len(used)) / len(own) + DECAY * self.w[used]
                step = error[doc][:, None] * (sums[doc] - v)
                dv = np.stack([np.bincount(at, step[:, k], len(used)) for k in range(FACTORS)], 1) / len(own) + DECAY * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                db = error.mean()
                gb += db**2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.bias -= RATE * db / np.sqrt(gb)

    def score(self, rows: np.ndarray) -> float:
        v = self.v[rows]
        pairs = ((v.sum(0) ** 2).sum() - (v * v).sum()) / 2
        return float(_sigmoid(self.bias + self.w[rows].sum() + pairs))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Score:
    def __init__(self, machine: Machine):
        self.machine = machine
        # A term's two hashes: present, and often.  Both are looked up among the model's.
        known = machine.known
        self.present = np.sort(np.concatenate([known, known ^ 0x2AAAAAAA]))
        self.terms, self.docs = Terms(split, spell, self.present), []

    def add(self, text: str) -> None:
        self.docs.append(self.terms.codes(text))

    def flush(self) -> pd.DataFrame:
        self.terms.resolve()
        known, out = self.machine.known, []
        for d in self.docs:
            places, counts = self.terms.counts(*d)
            own = features(self.present[places], counts) if len(places) else self.present[:0]
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            out.append(self.machine.score(at[known[at] == own] if len(known) else at[:0]))
        self.docs = []
        self.terms.done()
        return pd.DataFrame({"score": out})


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """A machine from the rows of ``docs`` that ``labels`` marks 0 or 1 (a key marked with both is 1).

    It learns from the first ``SAMPLE_TEXTS`` distinct texts of each label, in order of hash, among those of
    up to ``SAMPLE_CHARS`` characters; the same whatever way the rows are dealt.  Null keys, labels and
    texts are left out.  Without both labels every text has the same score.
    """
    bound_batches(docs.sparkSession)
    marked = labels.select(col(key).alias("k"), col(label).cast("int").alias("kind")).where("k is not null and kind in (0, 1)").groupBy("k").agg(F.max("kind").alias("kind"))
    marked = durable(marked.select("k", "kind", text_hash(F.col("k").cast("string")).alias("place")))
    n = {r["kind"]: r["count"] for r in marked.groupBy("kind").count().collect()}
    own = docs.select(col(key).alias("k"), col(text).alias("t")).where(f"char_length(t) between 1 and {SAMPLE_CHARS}")
    want = dict(enumerate(SAMPLE_TEXTS))
    share = {y: min(1.0, FIRST_KEYS * want[y] / c) for y, c in n.items()}
    while n:
        keys = marked.where(below(F.col("place"), F.when(F.col("kind") == 0, share.get(0, 0.0)).otherwise(share.get(1, 0.0)))).drop("place")
        if sum(share[y] * c for y, c in n.items()) * 1.5 < BROADCAST_KEYS:
            keys = F.broadcast(keys)
        rows = own.join(keys, "k").withColumn("h", text_hash(F.col("t")))
        # Labels of copies may differ; a text counts as toxic if one of its rows does.
        texts = durable(rows.groupBy("h").agg(F.max("kind").alias("kind")))
        had = {r["kind"]: r["count"] for r in texts.groupBy("kind").count().collect()}
        short = [y for y in n if had.get(y, 0) < want[y] and share[y] < 1.0]
        if not short:
            break
        share |= {y: min(1.0, share[y] * MORE_KEYS) for y in short}
    if not n:
        return Machine([], np.zeros(0))
    chosen = first_of_each(texts, had, want)
    drawn = one_of_each(rows.drop("kind").withColumn("kind", F.lit(0)), chosen.select(F.lit(0).alias("kind"), "h")).select("h", "t").join(F.broadcast(chosen), "h")
    found = drawn.select("h", "kind", block_udf(_Features, "terms array<int>", SMALL_BLOCK)(F.col("t")).alias("f")).select("h", "kind", "f.terms").toArrow().to_pandas()
    found = found.sort_values("h", kind="stable")
    return Machine(found["terms"].tolist(), found["kind"].to_numpy(int))


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` and ``out``, a double from 0 to 1 (higher: toxic is likelier).

    Null and empty texts have no terms and get the score of the bias; texts are read whole, equal ones
    score alike, an empty table gives an empty one, and a column that is named ``out`` is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(machine)
    scored = docs.withColumn(out, block_udf(lambda: _Score(shared.value), "score double", SMALL_BLOCK)(col(text)))
    return scored.withColumn(out, col(out)["score"])
