"""The near-duplicate stage against brute force over 5-word Jaccard."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import simhash


def _shingles(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return frozenset(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_kept(rows):
    """The smallest key of each component of the texts that link at 0.8 or more."""
    rows = sorted(rows)
    sets, parent = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {k for i, (k, _) in enumerate(rows) if root(i) == i}


def made(seed=5):
    """Chains and balls of edited copies, some within and some beyond the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(20, 200)))]
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in rng.integers(0, len(base), edits):
                copy[at] = f"x{rng.integers(0, 10**9)}"
            out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize("dense", [64, 3])
def test_stage_removes_edited_copies(spark, sf_dir, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    want = brute_kept(rows)
    assert kept == want
    assert len(want) < len({t for _, t in rows})  # more than the exact copies go


def test_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull())
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == brute_kept(rows)


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, " \n\t"), (3, "a b"), (3, "A  b"), (4, "a b c d e f"), (None, "g h"), (None, "g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.deduplicate(docs).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower().split()) for r in kept) == [(0, ["g", "h"]), (1, []), (3, ["a", "b"]), (4, list("abcdef"))]
    assert simhash.deduplicate(docs.limit(0)).count() == 0
