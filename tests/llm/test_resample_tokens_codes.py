"""Importance resampling, token counts and vector codes against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lakeloom.llm import codes, queries, resample, tokens

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [None, "", " ", "  \n\t ", "x", "é ü ñ 😀 ﬁ Ｆ", "A" * 5000, "▁a ▁▁ b", "<s> </s> <unk> <0x0A>", "word, word.\r\n\nword  word   word", "\x00\x01 1234 56", "同じ 文章同じ文章" * 40, "same text", "same text"]


def table(spark, texts, ids=None):
    rows = [(i, t, 1, 2, "r") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, _row int, rare string")


# --- target-distribution resampling ---------------------------------------


def brute_resample(docs, target, width=1, buckets=10_000, percent=10, least=20, seed=2024):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in features(text):
            s[b] += 1
    for text in target:
        for b in features(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)] if buckets else []
    out = {}
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = [i for i, text in docs if len(words(text)) >= least]
    for place, i in enumerate(sorted(able, key=lambda i: (-out[i][2], i))[: len(able) * percent // 100], 1):
        out[i][3] = place
    return out


def some_docs(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeÉé0XYZ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) + r.choice([".", "", "\n"])) for i in range(n)]


@pytest.mark.parametrize("width, percent", [(1, 10), (3, 37), (2, 100), (1, 0)])
def test_resample_equals_brute_force(spark, width, percent):
    docs = some_docs(400) + [(1000 + i, t) for i, t in enumerate(ODD)]
    target = [t for _, t in some_docs(30, seed=2)] + [None, ""]
    got = resample.resample(table(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), width=width, buckets=997, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {r[0]: list(r[1:]) for r in got.collect()} == brute_resample(docs, target, width, 997, percent)


def test_resample_of_the_smallest_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = queries.op11_target_resampling(spark, sf)
    assert {r[0]: list(r[1:]) for r in got.collect()} == brute_resample(docs, target)


def test_resample_of_nothing_repeats_and_nulls(spark):
    empty = table(spark, []).limit(0)
    assert resample.resample(empty, empty).count() == 0
    text = "one two three " * 10
    got = resample.resample(table(spark, [text] * 20 + [None], [5] * 10 + [None] * 10 + [None]), empty, percent=50).collect()
    assert len(got) == 21 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))
    assert len({(r["doc_id"], r["weight"], r["score"]) for r in got if r["rank"]}) == 1  # one id has the higher noise


def test_long_texts_are_read_in_slices(spark):
    text = " ".join(f"w{i % 1000}" for i in range(300_000)) + " " + "x" * (3 << 20)
    known = resample._Buckets(997)
    whole = [zlib.crc32(w.encode()) % 997 for w in text.split()]
    found = [b for part, _ in resample._features(text, 1, known) for b in part.tolist()]
    pairs = sum(len(part) for part, _ in resample._features(text, 2, known))
    assert found == whole and pairs == 2 * len(whole) - 1 and len(list(resample._slices(text.encode()))) > 1


@pytest.mark.parametrize("k", [1, 2, 777, 4999, 5000])
def test_kth_key_among_ties(spark, k):
    r = random.Random(k)
    values = [(r.choice([1, 1, 1, 2, 3, r.randint(0, 50)]), i) for i in range(5000)]
    df = spark.createDataFrame(values, "a long, b long").repartition(7).cache()
    assert resample.kth_key(df, F.struct("a", "b"), F.col("b"), k, pivots=4) == sorted(values)[k - 1]


def test_kth_key_of_none(spark):
    df = spark.createDataFrame([(1, 1)], "a long, b long")
    assert resample.kth_key(df, F.struct("a", "b"), F.col("b"), 0) is None and resample.kth_key(df, F.struct("a", "b"), F.col("b"), 2) is None


# --- token counts ----------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def tokens_of(spark, df, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(df, MODEL, **options).collect()}


@pytest.mark.parametrize("head_bytes", [4 << 20, 2000, 0])
def test_token_counts_equal_the_model(spark, model, head_bytes):
    r = random.Random(3)
    letters = "abcdefgh    \n\n\t.,;-éßñ▁123Ж漢字😀"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 300))) for _ in range(150)] + ["word " * 5000]
    want = {i: (len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in enumerate(texts)}
    assert tokens_of(spark, table(spark, texts).repartition(3), head_bytes=head_bytes) == want


def test_token_counts_of_the_smallest_tables(spark, sf, model):
    want = {r[0]: len(model.encode(r[1] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op12_token_counts(spark, sf).collect()} == want


def test_token_counts_of_nothing_and_repeats(spark):
    assert tokens.token_counts(table(spark, []).limit(0), MODEL).count() == 0
    got = tokens.token_counts(table(spark, ["a b c"] * 7 + [None] * 3, [None] * 10), MODEL, head_bytes=0).collect()
    assert sorted(r["n_tokens"] for r in got) == [0] * 3 + [3] * 7


def test_pieces_are_counted_once_for_a_token(spark):
    got = {r["token"]: (r["n_docs"], r["n_pieces"]) for r in tokens.pre_tokens(table(spark, ["a b b", "b a", "zqzqzqzq"]), MODEL).collect()}
    assert got[" a"][0] == 2 and got[" b"] == (2, 1) and got[" zqzqzqzq"][1] > 1


# --- vector codes ----------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds in Python's own whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    w = len(kept[0][1]) // parts
    books = [[v[p * w : (p + 1) * w] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [v[p * w : (p + 1) * w] for _, v, _ in kept]
            of = [nearest(x, books[p])[1] for x in mine]
            fresh = []
            for j, e in enumerate(books[p]):
                met = [x for x, o in zip(mine, of) if o == j]
                fresh.append([sum(c) // len(met) for c in zip(*met)] if met else e)
            books[p] = fresh
    out, labels = [], {}
    for i, v, label in kept:
        best = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), label])
        labels[label] = labels.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((i, code, error, labels[label], digest) for i, code, error, label in out)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, _label string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "e", "l") for i, v, label in rows], VECTORS)


def test_codes_equal_plain_lloyd(spark):
    r = np.random.default_rng(1)
    points = [[float(x) for x in np.float32(r.normal(size=16) + 3 * r.integers(0, 3))] for _ in range(300)]
    points += [points[0]] * 20 + [[0.5] * 16, [-0.5] * 16, [1.0] * 8 + [-1.0] * 8]  # ties
    odd = [None, [None] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15]
    rows = [(1000 - i, v, [None, 1, 2, 2][i % 4]) for i, v in enumerate(points + odd)]
    got = codes.compress(vectors(spark, rows).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_codes(rows)


def test_codes_of_few_equal_and_no_vectors(spark):
    assert codes.compress(vectors(spark, [(1, None, 1), (None, [float("nan")], None)])).count() == 0
    few = [(i, [float(i % 2)] * 8, 1) for i in range(5)]
    assert sorted(map(tuple, codes.compress(vectors(spark, few)).collect())) == brute_codes(few)
    same = [(i, [0.25] * 8, None) for i in range(40)]
    assert sorted(map(tuple, codes.compress(vectors(spark, same)).collect())) == brute_codes(same)
    mixed = vectors(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1), (None, [3e38] * 8, 1)])  # another length takes no part; huge components are held to the bound
    assert {r["vec_id"] for r in codes.compress(mixed).collect()} == {1, None}
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, [(1, [1.0] * 9, 1)]))


def test_moved_entries_keep_the_lower_index():
    x, book = np.array([[0, 0], [10, 0]]), np.array([[3, 0], [5, 0], [-3, 0]])
    code, near = codes.reassign(x, book, np.array([-1, -1]), np.zeros(2, np.int64), np.ones(3, bool))
    assert code.tolist() == [0, 1] and near.tolist() == [9, 25]
    book[0] = [15, 0]  # leaves the first row, ties with entry 1 in the second
    code, near = codes.reassign(x, book, code, near, np.array([True, False, False]))
    assert code.tolist() == [2, 0] and near.tolist() == [9, 25]


@pytest.mark.parametrize("seed", range(5))
def test_active_entries_equal_full_scans(seed):
    r = np.random.default_rng(seed)
    x, book = r.integers(-4, 5, (200, 3)), r.integers(-4, 5, (6, 3))
    code, near = codes.reassign(x, book, np.full(200, -1), np.zeros(200, np.int64), np.ones(6, bool))
    for _ in range(10):
        moved = r.random(6) < 0.4
        book = np.where(moved[:, None], r.integers(-4, 5, (6, 3)), book)
        code, near = codes.reassign(x, book, code, near, moved)
        whole = ((x[:, None] - book) ** 2).sum(2)
        assert (code == whole.argmin(1)).all() and (near == whole.min(1)).all()
