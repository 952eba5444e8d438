"""The llm operators: odd inputs (nulls, empty and long texts, ties, repeats, clashing columns, empty tables), brute force and round trips."""

import hashlib
import re
import struct
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import bpe, chat, components, decontam, langid, materialise, quality_rules, simhash, toxicity, weaklabels
from tessella.llm.queries import ORACLE_SQL, PIECES, QUERIES, chat_rows, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox " * 20_000
ODD = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, " \n\t", "en", "s", 3), (3, "Hello there, it's <|endoftext|> fine", "en", "s", 9), (3, "Hello there, it's <|endoftext|> fine", "en", "s", 9), (4, LONG, "en", "s", 9), (5, "1234 !!", None, "s", 9), (6, "İΣ é ½ 日本語 \x00", "en", "s", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    # Clashing names: columns that operators return or use inside.
    return spark.createDataFrame([(*r, "a", 1) for r in ODD], DOCS + ", n_tokens string, spans int").repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- 1


@given(st.text(alphabet="\\#/<>turn: Asistane\n", max_size=40), st.sampled_from(["user", "assistant", "", "a: b", "system"]))
def test_chat_round_trip(text, role):
    for t in (text, text + "</turn>", "### Assistant: " + text, "\\" + text + "\\</turn>"):
        rendered, _, _ = chat.render(role, t)
        assert chat.parse(rendered * 2) == [(role, t)] * 2


def test_chat_escapes_every_border():
    """All strings over the grammar's own tokens up to length 5, and a trailing header of every kind."""
    tokens = ["\\", "### User:", "###", " ", "</turn>", "\n", "=", "x:", "### =a:"]
    for k in range(6):
        for parts in product(tokens, repeat=k):
            text = "".join(parts)
            rendered, start, _ = chat.render("user", text)
            assert chat.parse(rendered) == [("user", text)]
    for header in ("### System:", "### User:", "### Assistant:", "### Tool:", "### =x:", "### =:"):
        for tail in ("", " ", "\\", "\n"):
            for role in ("assistant", "", "a: b", "=", "\\", "### User:", "</turn>"):
                text = f"Please continue after {header}{tail}"
                assert chat.parse(chat.render(role, text)[0] * 2) == [(role, text)] * 2


def test_chat_query_brute_force(spark, sf_dir):
    """The whole table, digested from the source rows."""
    rows = chat_rows(spark, sf_dir).toPandas()
    want = {}
    for conv, own in rows.sort_values(["conv_id", "turn"], kind="stable").groupby("conv_id"):
        turns = [(r, t or "") for r, t in zip(own["role"], own["text"])]
        said = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    got = QUERIES["op1_chat_format"](spark, sf_dir).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want and -7 in want


def test_chat_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "</turn> ok"), (None, None, None, "x"), (1, 1, "assistant", "b"), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[1]["loss_chars"] == len("</turn> okb")
    want = "".join(f"{r}\n{t}\n" for r, t in (("user", ""), ("assistant", "</turn> ok"), ("assistant", "b")))
    flip = "".join(f"{r}\n{t}\n" for r, t in (("user", ""), ("assistant", "b"), ("assistant", "</turn> ok")))
    assert got[1]["turns_sha256"] in {hashlib.sha256(x.encode()).hexdigest() for x in (want, flip)}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    named = df.select(F.concat(F.lit("c"), F.coalesce("conv_id", F.lit(0))).alias("id"), "turn", "role", "text", F.lit(1).alias("rendered"), F.lit(2).alias("conv"))
    assert {r["id"]: r["n_turns"] for r in chat.read_back(chat.format_turns(named, conv="id"), "id").collect()} == {"c1": 3, "c0": 1, "c2": 1}


# --- 2


def test_decontamination_oracle(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLE_SQL["op2_decontamination"]).df().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES["op2_decontamination"](spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)[want.columns]
    assert want.equals(got) and got["contaminated"].any()


def test_decontamination_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "hello There"), (2, None), (3, ""), (None, "1234"), (1, "hello there")], "item_id long, text string")
    got = decontam.contamination(odd, bench).collect()
    assert len(got) == len(ODD)
    assert {(r["doc_id"], tuple(r["items"]), tuple(map(tuple, r["spans"]))) for r in got if r["spans"]} == {(3, ("1",), ((0, 2),)), (5, ("null",), ((0, 1),))}
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(odd, bench, remove="spans").collect()}
    assert cut[3] == ", it's <|endoftext|> fine" and cut[5] == " !!" and cut[4] == LONG
    assert decontam.decontaminate(odd, bench).count() == len(ODD) - 3


def test_decontamination_shuffled(spark, docs, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    a = {tuple(map(str, r)) for r in decontam.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert a == {tuple(map(str, r)) for r in decontam.contamination(docs, bench).collect()}


# --- 3


def test_rules_brute_force(spark, docs, odd, empty, sf_dir):
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = quality_rules.rules(both, trusted).collect()
    assert len(rows) == docs.count() + len(ODD)
    for r in rows:
        text, q = r["text"] or "", r["quality"]
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert want == tuple(q)[:5]
        assert q["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert q["kept"] == (not q["base_failed"] and q["log_ratio"] >= quality_rules.THRESHOLD)
    assert quality_rules.rules(empty, trusted.limit(0)).count() == 0


def buckets_of(text):
    """The n-grams' buckets by an independent spelling of the hash: XXH64 with seed 42, chained over the words."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(hashes, hashes[1:])]
    return [h % quality_rules.BUCKETS for h in [*hashes, *pairs]]


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_rules_ratio_brute_force(spark, docs, sf_dir, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", broadcast)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    good = {r["doc_id"] for r in trusted.collect()}
    rows = quality_rules.rules(docs.select("doc_id", "text"), trusted).collect()
    raw, target = Counter(), Counter()
    for r in rows:
        own = buckets_of(r["text"])
        raw.update(own)
        target.update(own if r["doc_id"] in good else [])
    n, m, k = sum(raw.values()), sum(target.values()), quality_rules.SMOOTHING
    ratio = {b: np.log((target[b] + k) / (m * raw[b] / n + k)) for b in raw}
    for r in rows:
        own = buckets_of(r["text"])
        want = sum(ratio[b] for b in own) / len(own) if own else 0.0
        assert abs(r["quality"]["log_ratio"] - want) < 1e-9
        assert r["quality"]["kept"] == (not r["quality"]["base_failed"] and want >= quality_rules.THRESHOLD) or abs(want - quality_rules.THRESHOLD) < 1e-9


# --- 4


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= simhash.LIMIT):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [512, 4])
def test_simhash_links(spark, monkeypatch, bucket):
    """Random fingerprints with dense balls; small buckets force the split by thirds."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    fps = rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)
    near = [int(np.int64(f) ^ np.int64(sum(1 << int(b) for b in rng.choice(62, k, replace=False)))) for f in fps[:6] for k in (1, 2, 2, 3, 4)]
    every = sorted({*map(int, fps), *near})
    edges = simhash.links(spark.createDataFrame([(x,) for x in every], "fp long"))
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = brute_components(np.array(every, np.int64).view(np.uint64))
    groups = Counter(want)
    assert {x: every[w] for x, w in zip(every, want) if groups[w] > 1} == {k: min(n for n, r in got.items() if r == v) for k, v in got.items()}


def test_simhash_query_brute_force(spark, docs, sf_dir):
    """Fingerprints from their definition, and components from all pairs, over the whole table."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = {}
    for r in docs.select("doc_id", "text").collect():
        words = [w for w in re.split("[\x20\x09-\x0d]+", (r["text"] or "").translate(lower)) if w]
        found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
        fps[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    keys = sorted(fps)
    roots = brute_components(np.array([fps[k] for k in keys], np.uint64))
    want = {k: (f"{fps[k]:016x}", keys[r]) for k, r in zip(keys, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, sf_dir).collect()} == want


def test_simhash_limits(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "fp long")
    with pytest.raises(ValueError):
        simhash.links(nodes, 6)
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30, dtype=np.int64)]
    near = [int(np.int64(f) ^ np.int64(sum(1 << int(b) for b in rng.choice(62, k, replace=False)))) for f in fps[:8] for k in (3, 4, 5)]
    every = sorted({*fps, *near})
    got = components.components(simhash.links(spark.createDataFrame([(x,) for x in every], "fp long"), 4)).count()
    u = np.array(every, np.int64).view(np.uint64)
    assert got == sum(bool((np.bitwise_count(u ^ x) <= 4).sum() > 1) for x in u)


def test_simhash_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {1}
    kept = simhash.deduplicate(odd).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 5, 6] and kept[0].asDict().keys() == set(odd.columns)
    unique = odd.where("doc_id in (1, 2, 4)")
    assert sorted(r["doc_id"] for r in simhash.deduplicate(unique).collect()) == [1, 4]
    assert simhash.deduplicate(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_long_text_fingerprint(monkeypatch):
    whole = simhash.fingerprint_of(LONG + "and more")
    monkeypatch.setattr(simhash, "CHUNK", 255)
    assert whole == simhash.fingerprint_of(LONG + "and more")


@pytest.mark.parametrize("small", [100_000, 0])
def test_components_of_a_path(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 100), (50, 51)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50}
    assert components.components(edges.limit(0)).count() == 0


# --- 5


def test_toxicity_learns_pairs():
    """Two terms that are harmless alone and toxic together: additive weights can't tell."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(800):
        a, b = i % 2, i // 2 % 2
        texts.append(np.array(sorted([*([10] if a else [11]), *([20] if b else [21]), *(100 + rng.choice(50, 5, replace=False))]), np.int32))
        labels.append(int(a == b))
    machine = toxicity.Machine(texts, np.array(labels))
    assert {10, 11, 20, 21} <= set(machine.known.tolist())
    right = sum((machine.score(np.searchsorted(machine.known, np.intersect1d(t, machine.known))) > 0.5) == y for t, y in zip(texts, labels))
    assert right > 760


def test_toxicity_query_brute_force(spark, docs, sf_dir):
    """Scores of the whole table by a double loop over pairs, from the model alone."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    machine = toxicity.train(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    place = {int(h): i for i, h in enumerate(machine.known)}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in QUERIES["op5_toxicity"](spark, sf_dir).collect():
        counts = Counter()
        for word in re.findall(r"[^\W\d_]+", (texts[r["doc_id"]] or "").lower()):
            counts.update({word} | {"^" + word[:n] for n in (4, 5, 6, 7) if len(word) > n})
        hashed = Counter()
        for term, n in counts.items():
            hashed[xxhash.xxh32_intdigest(term) & 0x7FFFFFFF] += n
        own = sorted({place[h] for h in hashed if h in place} | {place[h ^ 0x2AAAAAAA] for h, n in hashed.items() if n >= toxicity.OFTEN and h ^ 0x2AAAAAAA in place})
        y = machine.bias + sum(machine.w[i] for i in own) + sum(float(machine.v[i] @ machine.v[j]) for n, i in enumerate(own) for j in own[:n])
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(y, -40, 40)))) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_sample_ignores_dealing_and_copies(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").select("text").limit(1)
    copies = spark.range(10**9, 10**9 + 3000).withColumnRenamed("id", "doc_id").crossJoin(toxic)
    base = docs.select("doc_id", "text")
    marked = labels.select("doc_id", "toxic").unionByName(copies.select("doc_id", F.lit(1).alias("toxic")))
    models = [toxicity.train(d, x) for d, x in ((base, labels), (base.repartition(7), labels), (base.unionByName(copies), marked))]
    for m in models[1:]:
        assert (m.known == models[0].known).all() and (m.w == models[0].w).all()


def test_toxicity_rows(spark, odd, empty):
    rows = [(i, f"calm words number {i} " + ("you stupid moron" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    machine = toxicity.train(docs, labels)
    scored = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, machine).collect()}
    assert min(scored[i] for i in range(0, 200, 4)) > 0.5 > max(scored[i] for i in range(1, 200, 4))
    assert toxicity.score(odd, machine).count() == len(ODD)
    assert toxicity.score(odd, toxicity.train(empty, labels)).where("toxicity between 0 and 1").count() == len(ODD)


# --- 6, 10


def test_bpe_matches_library(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    more = spark.createDataFrame([(9, "aaaaaaa bbb'll DON'T <|startoftext|><|endoftext|>é ﬁ Å 1½²", None, None, None)], DOCS)
    both = docs.unionByName(odd.select(docs.columns)).unionByName(more)
    got = bpe.count_tokens(bpe.encode_digest(bpe.encode(both, path), path, out="digest"), path, out="n").withColumn("back", bpe.decode_column(F.col("encoded.ids"), path)).collect()
    assert len(got) == docs.count() + len(ODD) + 1
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert r["encoded"]["ids"] == want and r["n"] == r["digest"]["n_tokens"] == len(want) and r["back"] == text
        assert r["digest"]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["digest"]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(empty, path).count() == 0


def test_bpe_characters():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    points = [c for c in range(0, 0x2FFFF, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)} {chr(c)}" for c in points]
    work = bpe._Encode(path)
    for t in texts:
        work.add(t)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in work.encoded()] == want


# --- 7


def test_language(spark, docs, odd, empty):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held_out), tokenizer_path(PIECES))
    rows = langid.identify(docs.where(held_out), model).collect()
    assert sum(r["language"]["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    found = {(r["doc_id"], r["text"]): r["language"] for r in langid.identify(odd, model).collect()}
    assert found[1, None] == found[None, ""] == found[5, "1234 !!"] and found[1, None]["lang_pred"] == "und"
    assert found[4, LONG]["lang_pred"] == "en"
    assert langid.identify(empty, model).count() == 0
    assert {r["language"]["lang_pred"] for r in langid.identify(odd, langid.train(empty, tokenizer_path(PIECES))).collect()} == {"und"}


TOY = ("▁", "▁a", "a", "ab", "b", "ba", "aabab")


def toy():
    """Pieces, their prices by id (two languages), and a brute-force sum over segmentations by recursion on the end."""
    pieces = langid.Pieces(set(TOY))
    at = {q: int(np.searchsorted(pieces.hashes, langid.piece_hash(q))) + 1 for q in TOY}
    p = np.zeros((len(TOY) + 1, 2))
    for i, q in enumerate(TOY):
        p[at[q]] = 0.02 * (i + 1), 0.01 * (9 - i)

    def log_sum(word, lang):
        s = langid.START + word
        log = [0.0] + [-np.inf] * len(s)
        for j in range(1, len(s) + 1):
            ways = [log[j - len(q)] + np.log(p[at[q], lang]) for q in TOY if s[:j].endswith(q)]
            if s[j - 1] not in TOY:
                ways.append(log[j - 1] + np.log(langid.UNKNOWN))
            log[j] = np.logaddexp.reduce(ways)
        return log[-1]

    return pieces, p, log_sum


def test_forward_sums_all_segmentations():
    pieces, p, log_sum = toy()
    price = {q: p[int(np.searchsorted(pieces.hashes, langid.piece_hash(q))) + 1, 0] for q in TOY}

    def total(s):
        return 1.0 if not s else sum(price[q] * total(s[len(q) :]) for q in price if s.startswith(q))

    assert np.allclose(np.exp(langid.Lattice(pieces, ["ab", "aba", "b"]).likelihood(p)[:, 0]), [total("▁ab"), total("▁aba"), total("▁b")])
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), n)) for n in (1, 5, 24, 31, 32, 33, 40, 60, 200, 511, 1500)]
    got = langid.Lattice(pieces, words).likelihood(p)
    for w, row in zip(words, got):
        want = [log_sum(w, 0), log_sum(w, 1)]
        assert np.allclose(row, want, rtol=1e-10) and np.allclose(langid.long_likelihood(pieces, p, w), want, rtol=1e-10)
    whole = "ab" * 6000
    assert np.allclose(langid.long_likelihood(pieces, p, whole), [log_sum(whole, 0), log_sum(whole, 1)], rtol=1e-10)


def test_expected_uses_are_the_gradient():
    """Expected uses of a piece are the derivative of the log-likelihood by the log of its price, long words included."""
    pieces, p, _ = toy()
    words = ["abab", "aabab" * 12, "cab" * 30]
    weight = np.array([[1.0, 2.0], [3.0, 1.0], [0.5, 0.0]])
    uses = langid.Lattice(pieces, words).expected(p, weight)
    for i in range(1, len(p)):
        step = p.copy()
        step[i] *= np.exp(1e-6)
        change = (langid.Lattice(pieces, words).likelihood(step) - langid.Lattice(pieces, words).likelihood(p)) / 1e-6
        assert np.allclose(uses[i], (weight * change).sum(0), atol=1e-3)


def test_language_sample_ignores_dealing_and_copies(spark, docs):
    base = docs.select("doc_id", "text", "lang")
    copies = base.where("lang is not null and char_length(text) between 100 and 2000").limit(1).crossJoin(spark.range(3000)).drop("id")
    models = [langid.train(d, tokenizer_path(PIECES)) for d in (base, base.repartition(7), base.unionByName(copies))]
    for m in models[1:]:
        assert m.langs == models[0].langs and (m.p == models[0].p).all()


def test_language_query_brute_force(spark, docs, sf_dir):
    """Predictions of the whole table by a plain forward recursion over each word."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held_out), tokenizer_path(PIECES))
    place = {int(h): i + 1 for i, h in enumerate(model.keys.hashes)}
    seen = {}

    def word_log(word):
        if word not in seen:
            s = langid.START + word
            log = [np.zeros(len(model.langs))]
            for j in range(1, len(s) + 1):
                ways = []
                for n in range(1, min(j, model.keys.most) + 1):
                    own = place.get(int(langid.piece_hash(s[j - n : j])))
                    if own is not None:
                        ways.append(log[j - n] + np.log(model.p[own]))
                    elif n == 1:
                        ways.append(log[j - 1] + np.log(langid.UNKNOWN))
                log.append(np.logaddexp.reduce(ways))
            seen[word] = log[-1]
        return seen[word]

    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in sorted(QUERIES["op7_language"](spark, sf_dir).collect(), key=lambda r: r["doc_id"]):
        words = re.findall(r"[^\W\d_]+", (texts[r["doc_id"]] or "").lower())
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif len(words) < 400:
            own = sum(map(word_log, words))
            assert r["lang_pred"] == model.langs[int(own.argmax())] and abs(r["score"] - 1 / np.exp(own - own.max()).sum()) < 1e-6


# --- 8


@pytest.mark.parametrize("count", [1, 2, 5, 1000, 4097])
def test_slots_permute(count):
    a, b = (materialise.slots(np.arange(count), count, key) for key in (1, 2))
    assert sorted(a) == sorted(b) == list(range(count)) and (count < 100 or (a != b).any())


def test_training_order(spark, odd, docs, empty, tmp_path):
    path = tokenizer_path()
    both = docs.unionByName(odd.select(docs.columns))
    ordered = materialise.training_order(both, path, pad=49407, length=64, shard=100)
    rows = ordered.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and all(r["shard"] == r["slot"] // 100 and r["place"] == r["slot"] % 100 for r in rows)
    # Tokens without filler, and the documents of each sequence, are those of the library's encoding.
    want = Counter()
    for r in bpe.encode(both, path).collect():
        want.update({r["doc_id"]: len(r["encoded"]["ids"]) + 1} if r["encoded"]["ids"] else {})
    assert sum(r["n_tokens"] for r in rows) == sum(want.values())
    assert {d for r in rows for d in r["docs"]} == set(want)
    whole = {tuple(np.frombuffer(r["payload"], "<u2")[: r["n_tokens"]].tolist()) for r in rows if len(r["docs"]) == 1 and r["n_tokens"] == 64}
    texts = [tuple(r["encoded"]["ids"]) for r in bpe.encode(both, path).collect()]
    assert all(any(w == t[i : i + 64] for t in texts for i in range(len(t) - 63)) for w in list(whole)[:20] if 49407 not in w)
    assert Counter(i for r in rows for i in np.frombuffer(r["payload"], "<u2")[: r["n_tokens"]].tolist()) == Counter(i for t in texts if t for i in (*t, 49407))

    folder = str(tmp_path / "shards")
    index = materialise.write_shards(ordered, folder).collect()
    assert {(r["slot"], tuple(r["docs"])) for r in index} == {(r["slot"], tuple(r["docs"])) for r in rows}
    back = {r["slot"]: bytes(r["payload"]) for r in materialise.read_shards(spark, folder, length=64, shard=100).collect()}
    assert back == {r["slot"]: bytes(r["payload"]) for r in rows}
    for r in rows[:: max(1, len(rows) // 20)]:
        assert materialise.read_slot(spark, folder, r["slot"], 64, 2, 100).tobytes() == bytes(r["payload"])
    assert materialise.training_order(empty, path, pad=0).count() == 0


def test_training_order_query(spark, sf_dir):
    rows = QUERIES["op8_training_order"](spark, sf_dir).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    ordered = materialise.training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), pad=49407, key=20).collect()
    assert {r["slot"]: r["payload_sha256"] for r in rows} == {r["slot"]: hashlib.sha256(bytes(r["payload"])).hexdigest() for r in ordered}


# --- 9


def test_weak_labels(spark, docs, odd, empty, sf_dir):
    model, scorer = weaklabels.train(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = weaklabels.classify(docs, scorer).join(labels, "doc_id").collect()
    right = sum((r["quality_score"] >= weaklabels.THRESHOLD) == (r["quality"] == 1) for r in rows)
    assert right >= 0.9 * len(rows) and min(model.accuracies().values()) > 0.5
    assert weaklabels.classify(odd, scorer).where("quality_score between 0 and 1").count() == len(ODD)
    _, none = weaklabels.train(empty)
    assert {r["quality_score"] for r in weaklabels.classify(odd, none).collect()} == {0.5}


def test_weak_label_sample_ignores_dealing_and_copies(spark, docs):
    base = docs.select("doc_id", "text")
    _, one = weaklabels.train(base)
    _, two = weaklabels.train(base.repartition(7))
    assert (one.known == two.known).all() and (one.w == two.w).all()
    copies = base.where("char_length(text) between 100 and 2000").limit(1).crossJoin(spark.range(3000)).drop("id")
    hashed = base.unionByName(copies)
    _, three = weaklabels.train(hashed)
    assert (one.known == three.known).all()  # the counts of votes change, the texts that are learned from don't


def test_weak_label_query_brute_force(spark, docs, sf_dir):
    """Label model by a plain loop over classes, and scores of the whole table from terms spelled out."""
    base = docs.select("doc_id", "text")
    model, scorer = weaklabels.train(base)
    place = {int(h): i for i, h in enumerate(scorer.known)}
    texts = {r["doc_id"]: r["text"] or "" for r in base.collect()}

    def shares(text):
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        count = lambda f: sum(map(f, words)) / max(1, len(words))
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        return [
            count(lambda w: bool(re.search(r"[#*$%&|<>]", w))), count(lambda w: w == "|"), count(lambda w: len(w) > 2 and w.isupper()), count(lambda w: "!" in w),
            count(lambda w: not re.match(r"[^\W\d_]+[.,;:?!]?\Z", w)), 1 - len(set(windows)) / len(windows) if windows else 0.0,
            sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)), 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.3,
        ]

    counts = Counter()
    for text in texts.values():
        own = zip(shares(text), weaklabels.LABELLERS.values())
        counts["".join("0" if s >= bad else "1" if s <= good else "2" for s, (bad, good) in own) if text.split() else "2" * 8] += 1
    assert counts == Counter(dict(zip(model.patterns, [counts[p] for p in model.patterns]))) and sum(counts.values()) == len(texts)
    for pattern in model.patterns:
        joint = [model.share[c] * np.prod([model.table[c][k][int(v)] for k, v in enumerate(pattern)]) for c in range(3)]
        assert abs(model.posterior[pattern] - joint[0] / sum(joint)) < 1e-9

    for r in QUERIES["op9_quality_classifier"](spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        words = text.split()
        y = scorer.bias + sum(scorer.w[place[x]] for x in (-1 - min(9, int(s * 10)) - 10 * k for k, s in enumerate(shares(text))) if x in place)
        terms = Counter()
        for w in words:
            low = re.sub(r"(\W)\1+", r"\1", re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", w)))
            terms.update(xxhash.xxh32_intdigest(t) & 0x7FFFFFFF for t in (w.lower(), "^" + low))
        y += sum(scorer.w[place[h]] * np.sqrt(n / len(words)) for h, n in terms.items() if h in place)
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(y, -40, 40)))) < 1e-6


# --- pipeline


def test_pipeline(spark, sf_dir, odd, empty):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert out.columns == docs.columns
        folder = materialise.stored(out)
        docs = spark.read.parquet(folder)
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept and kept <= ids
        ids = kept
    assert docs.count() == len(ids) and "ids" in docs.columns
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        stage(spark, odd, sf_dir).collect()


INTERNAL = ["key", "text_hash", "w", "win", "items", "spans", "__key", "__hash", "__spans", "__root", "__least", "k0", "copies", "found", "one", "node", "fp", "near", "far", "th", "row", "own", "own_th", "root", "component_id", "h", "t", "kind", "pattern", "place", "__score", "__language", "__encoded", "mask", "value", "band", "label"]


def test_clashing_names(spark, sf_dir):
    """Columns with every name that is used inside pass through the filtering stages as they are."""
    import corpus_pipeline as pipeline

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    docs = texts.select("*", *(F.lit(f"keep {c}").alias(c) for c in INTERNAL))
    copies = docs.unionByName(docs.limit(5))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    made = [decontam.decontaminate(copies, bench), decontam.decontaminate(copies, bench, remove="spans"), simhash.deduplicate(docs), simhash.deduplicate(copies)]
    made += [stage(spark, copies, sf_dir) for name, stage in pipeline.STAGES[:4]]
    for out in made:
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"keep {c}" for r in rows for c in docs.columns if c in INTERNAL)
    hits = decontam.contamination(docs.withColumnRenamed("doc_id", "id.of"), bench, ("id.of",))
    assert hits.columns[0] == "id.of" and hits.count() == 60
    for bad in (lambda: decontam.contamination(docs, bench, ("spans",)), lambda: simhash.near_duplicates(docs, "fp")):
        with pytest.raises(ValueError):
            bad()


def test_pipeline_stages_brute_force(spark, sf_dir):
    """Each stage's rows against a plain version of its rule, on what the stage before kept."""
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = Tokenizer.from_file(tokenizer_path())
    for name, stage in pipeline.STAGES:
        out = spark.read.parquet(materialise.stored(stage(spark, docs, sf_dir)))
        before, after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}, {r["doc_id"] for r in out.collect()}
        if name == "language":
            model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), tokenizer_path(PIECES))
            words = {k: re.findall(r"[^\W\d_]+", (t or "").lower()) for k, t in before.items()}
            want = set()
            for k, own in words.items():
                if own:
                    log = model.scores(sorted(set(own)))
                    each = dict(zip(sorted(set(own)), log))
                    total = sum(each[w] for w in own)
                    want |= {k} if 1 / np.exp(total - total.max()).sum() >= pipeline.LEAST_LANGUAGE else set()
            assert after == want
        if name == "decontamination":
            word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            bench = [word.findall((r["text"] or "").translate(lower)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            wins = {tuple(w[i : i + 10]) for w in bench if w for i in range(max(1, len(w) - 9))}
            sizes = {len(w) for w in wins}
            hit = lambda t: any(tuple(w[i : i + n]) in wins for w in [word.findall((t or "").translate(lower))] for n in sizes for i in range(len(w) - n + 1))
            assert after == {k for k, t in before.items() if not hit(t)}
        if name == "encoding":
            assert {r["doc_id"]: r["ids"] for r in out.collect()} == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in before.items()}
        docs = out
