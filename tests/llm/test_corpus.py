"""The corpus operators against brute force, and on empty, null, long, tied and repeated rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import DATA, rows
from pyspark.sql import functions as F

from lakeloom.llm import exact, graph, html, language, licenses, mixing, neighbours, packing, quality, simhash, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, h string"
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def docs(spark, texts, ids=None, sources=None, langs=None):
    """Documents with further columns whose names clash with the operators' own."""
    n = len(texts)
    ids, sources, langs = ids or list(range(n)), sources or ["s"] * n, langs or ["en"] * n
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), True, 7, "h") for i, t, s, lang in zip(ids, texts, sources, langs)], DOCS)


def prose(r, n, words=400):
    return " ".join(r.choice(VOCABULARY[:words]) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(3 + i % 6)) for i in range(1000)]
ODD = [None, "", " \n\t ", "x", "é ü ñ 😀", "A" * 30_000, "same text here", "same text here"]


# --- exact ---------------------------------------------------------------


def test_exact_classes(spark):
    df = docs(spark, ODD, ids=[1, 2, 3, 4, 5, 6, 7, None])
    got = {r["doc_id"]: r for r in exact.exact_classes(df, keep="max").collect()}
    assert (got[1]["keep_id"], got[1]["group_size"], got[1]["kept"]) == (2, 2, False) and got[2]["kept"]
    assert got[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[7]["keep_id"] == 7 and not got[None]["kept"] and got[None]["group_size"] == 2
    assert got[6]["text_sha256"] == hashlib.sha256(b"A" * 30_000).hexdigest()
    assert sorted(r["doc_id"] or 0 for r in exact.exact_dedup(df, keep="min").collect()) == [1, 3, 4, 5, 6, 7]
    assert exact.exact_dedup(df).columns == df.columns
    assert exact.exact_classes(df.limit(0)).count() == 0


# --- components and SimHash ----------------------------------------------


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(5, 5), (1, 2)]
    found = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 30)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprints(spark):
    texts = [*ODD, "One two", "one TWO three\nfour", "É Two three four"]
    got = [r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("cap", [4096, 3])
def test_near_links_equal_all_pairs(spark, cap):
    """A small cap makes the shards be dealt again, down to the last level."""
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(5))) for b in base for _ in range(8)} | {0, (1 << 64) - 1}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, cap)
    got = {x["node"]: x["root"] for x in graph.connected_components(edges).collect()}
    parent = {v: v for v in signed}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {v: got.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_simhash_components(spark):
    r = random.Random(2)
    text = prose(r, 300)
    texts = [text, text.upper(), None, "", text + " tail", prose(r, 300)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.simhash_components(docs(spark, texts, ids=[5, 4, 3, 2, 6, 1])).collect()}
    assert got[5] == got[4] == 4 and got[3] == got[2] == 2 and got[1] == 1
    kept = simhash.near_dedup(docs(spark, texts, ids=[5, 4, 3, 2, 6, 1]))
    assert {2, 4, 1} <= {x["doc_id"] for x in kept.collect()} and kept.count() == len(set(got.values()))
    assert simhash.simhash_components(docs(spark, texts).limit(0)).count() == 0


# --- mixing --------------------------------------------------------------


def water_fill(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_mix_meets_its_targets(spark):
    r = random.Random(4)
    sources = [r.choice(["a", "a", "a", "a", "b", "c", "d", "é", None]) for _ in range(300)]
    texts = [prose(r, r.randrange(0, 120)) for _ in sources]
    texts[0], texts[1] = None, prose(r, 3000)
    df = docs(spark, texts, sources=sources)
    plan = mixing.mix_plan(df, block_words=200, shards=4).collect()
    sizes = {}
    for p in plan:
        assert p["size"] == len((texts[p["doc_id"]] or "").split())
        sizes[p["source"]] = sizes.get(p["source"], 0) + p["size"]
    want = water_fill(sizes)
    for s in sizes:
        mine = [p for p in plan if p["source"] == s]
        assert abs(mine[0]["target"] - want[s]) < 1e-6 and mine[0]["source_size"] == sizes[s]
        assert abs(sum(p["taken"] for p in mine) - want[s]) <= 0.5
    for p in plan:
        assert p["taken"] <= 3 * p["size"] and sum(d["words"] for d in p["draws"]) == p["taken"]
        assert len({d["pass"] for d in p["draws"]}) == len(p["draws"]) and all(0 <= d["shard"] < 4 for d in p["draws"])
    again = mixing.mix_plan(df.repartition(7), block_words=200, shards=4)
    assert {(p["doc_id"], p["taken"]) for p in plan} == {(p["doc_id"], p["taken"]) for p in again.collect()}
    mixed = mixing.mix(df, block_words=200, shards=4)
    assert mixed.columns == df.columns
    words = {}
    for x in mixed.collect():
        words[x["source"]] = words.get(x["source"], 0) + len((x["text"] or "").split())
        assert (texts[x["doc_id"]] or "").startswith(x["text"] or "")
    assert all(abs(words.get(s, 0) - want[s]) <= 0.5 for s in sizes)


def test_mix_of_many_equal_rows(spark):
    """Equal rows, a third of all, spread over the blocks of their source, and are drawn like others."""
    text = " ".join(["same"] * 40)
    df = docs(spark, [text] * 1000 + [f"{i} " * 40 for i in range(2000)] + [None] * 500, ids=[None] * 1000 + list(range(2000)) + [None] * 500, sources=["a"] * 1500 + ["b"] * 300 + ["a"] * 1700)
    classes = df.groupBy("doc_id", "text").count().select(F.col("doc_id").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_md5"), F.lit(0).alias("_rest"), F.when(F.col("text").isNull(), 0).otherwise(40).cast("long").alias("size"), F.col("count").alias("copies"))
    dealt = mixing.lots(classes, 3200).withColumn("blocks", F.lit(32)).withColumn("block", mixing.block_of(17))
    words = [r["w"] for r in dealt.groupBy("block").agg(F.sum(F.col("size") * F.col("n")).alias("w")).collect()]
    assert len(words) == 32 and sum(words) == 120_000 and max(words) <= 2 * 120_000 / 32
    plan = mixing.mix_plan(df, block_words=3200, shards=4).collect()
    assert len(plan) == 3500 and sum(p["size"] for p in plan if p["doc_id"] is None) == 40_000
    want = water_fill({s: sum(p["size"] for p in plan if p["source"] == s) for s in "ab"})
    for s in "ab":
        assert abs(sum(p["taken"] for p in plan if p["source"] == s) - want[s]) <= 0.5
    assert all(p["taken"] <= 3 * p["size"] and sum(d["words"] for d in p["draws"]) == p["taken"] for p in plan)
    assert sum(0 < p["taken"] % p["size"] for p in plan if p["size"]) <= 2  # one cut a source
    again = mixing.mix_plan(df.repartition(5), block_words=3200, shards=4).collect()
    key = lambda p: (str(p["doc_id"]), p["size"], p["taken"])
    assert sorted(map(key, plan)) == sorted(map(key, again))


def test_quotas_are_exact(spark):
    got = mixing.shard_quotas(spark.createDataFrame([("a", 10), ("b", 7), (None, 1)], "source string, draws long"), 2, 1).collect()
    by_source, by_shard = {}, {}
    for g in got:
        by_source[g["source"]] = by_source.get(g["source"], 0) + g["quota"]
        by_shard[g["shard"]] = by_shard.get(g["shard"], 0) + g["quota"]
    assert by_source == {"a": 10, "b": 7, None: 1} and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_mix_of_nothing(spark):
    assert mixing.mix_plan(docs(spark, []).limit(0)).count() == 0
    only = mixing.mix_plan(docs(spark, [None, "", " "])).collect()
    assert len(only) == 3 and all(p["taken"] == 0 and p["target"] == 0 for p in only)


# --- packing -------------------------------------------------------------


def test_word_tokenizer_equals_whole_texts():
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER, cache_words=50)
    r = random.Random(5)
    signs = [*"abcXYZ012'.,!?#$-_ \n\téßÉİΣσ中😀½²Ⅷ \x1ć", "<|endoftext|>", "'s"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(2000)]
    for at in range(0, len(texts), 100):
        got = mine.encode(texts[at : at + 100])
        assert got == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts[at : at + 100], add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_everything_in_few_sequences(seed):
    r = np.random.default_rng(seed)
    counts = np.bincount(np.minimum((r.lognormal(4, 1.2, 3000)).astype(int) + 1, 512), minlength=513)
    plan = packing.make_plan(counts, 512)
    used = np.zeros(513, int)
    for config, k in plan.items():
        assert 0 < sum(config) <= 512 and k > 0
        for length in config:
            used[length] += k
    assert (used == counts).all()
    least = max(-(-int(counts @ np.arange(513)) // 512), counts[257:].sum())
    assert sum(plan.values()) <= 1.01 * least + 1
    assert packing.make_plan(np.zeros(513, int), 512) == {}


def test_linear_program_is_fractional_and_near_its_bound():
    r = np.random.default_rng(9)
    counts = np.bincount(np.minimum((r.lognormal(5.5, 1.0, 20_000)).astype(int) + 1, 1023), minlength=1025)
    cover = packing.solve_lp(counts, 1024)
    covered = np.zeros(1025)
    for config, amount in cover.amounts.items():
        assert sum(config) <= 1024 and amount > 0
        for length in config:
            covered[length] += amount
    assert (covered >= counts * (1 - 1e-6)).all()
    assert sum(a != round(a) for a in cover.amounts.values()) > len(cover.amounts) / 2
    assert counts @ np.arange(1025) / 1024 - 1e-6 <= cover.bound <= cover.value and cover.gap < 0.01
    plan, left = packing.round_cover(cover, counts, 1024)  # the rounding places most pieces, and none twice
    assert (left >= 0).all() and left.sum() < 0.1 * counts.sum()
    assert sum(k * len(c) for c, k in plan.items()) + left.sum() == counts.sum()
    assert sum(packing.make_plan(counts, 1024).values()) <= 1.01 * cover.bound


@pytest.mark.parametrize("case", ["given", "given5", "middle", "thirds", "few"])
def test_plans_are_never_above_plain_best_fit(case):
    r = np.random.default_rng(1)
    if case.startswith("given"):
        counts = given_lengths() * (5 if case == "given5" else 1)
    else:
        low, high, n = {"middle": (600, 1101, 20_000), "thirds": (650, 720, 9000), "few": (1, 2049, 300)}[case]
        counts = np.bincount(r.integers(low, high, n), minlength=2049)
    plan, used = packing.make_plan(counts, 2048), np.zeros(2049, int)
    for config, k in plan.items():
        assert sum(config) <= 2048
        for x in config:
            used[x] += k
    assert (used == counts).all()
    n = sum(plan.values())
    assert n <= sum(packing.best_fit(counts, {}, 2048).values())
    assert n <= {"given": 4539, "given5": 22_694, "middle": 9050}.get(case, n)


def given_lengths():
    """The lengths of the pieces of the documents of sf0.1."""
    path = DATA / "sf0.1/documents.parquet"
    if not path.exists():
        pytest.skip("no test tables")
    texts, counts, tokenizer = pq.read_table(path, columns=["text"])["text"].to_pylist(), np.zeros(2049, np.int64), packing.WordTokenizer(TOKENIZER)
    for at in range(0, len(texts), 256):
        for ids in tokenizer.encode([t or "" for t in texts[at : at + 256]]):
            whole, rest = divmod(len(ids) // 4 + 1, 2048)
            counts[2048] += whole
            counts[rest] += rest > 0
    return counts


def test_bound_is_below_the_best_cover():
    for lengths, best in (([1100] * 100 + [500] * 300, 150), ([700] * 20 + [1300] * 20, 20), ([2048] * 3, 3), ([1025] * 7, 7), ([1] * 5, 1)):
        counts = np.bincount(lengths, minlength=2049)
        plan = packing.make_plan(counts, 2048)
        assert sum(plan.values()) == best and packing.solve_lp(counts, 2048).bound <= best + 1e-9


def test_pack_of_one_common_length(spark):
    """Equal pieces of one id in many salts: all get places of their own."""
    pieces = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 64).otherwise(20).cast("long").alias("length"), F.col("id").alias("ids"))
    placed = packing.place(pieces.repartition(5).checkpoint(), capacity=64, salt_rows=100).toPandas()
    assert sorted(placed["ids"]) == list(range(3000)) and not placed.duplicated(["sequence_id", "offset"]).any()
    assert placed["sequence_id"].nunique() == 1000 + 667 and set(placed["offset"]) == {0, 20, 40}


def test_pack(spark):
    from tokenizers import Tokenizer

    r = random.Random(6)
    texts = [*ODD, *[prose(r, r.randrange(1, 120)) for _ in range(60)]]
    df = docs(spark, texts, ids=[*range(len(texts) - 1), 0])  # an id twice
    packed = packing.pack(df, TOKENIZER, capacity=64).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, text in zip([*range(len(texts) - 1), 0], texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted((p["doc_id"], p["piece"], p["start"], p["length"], zlib.crc32(bytes(p["ids"]))) for p in packed) == sorted(want)
    by = {}
    for p in packed:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    digests = packing.pack_digests(df, TOKENIZER, capacity=64)
    assert sorted(r[0] for r in digests.select("ids_crc32").collect()) == sorted(w[4] for w in want)
    whole = packing.sequences(packing.pack(df, TOKENIZER, capacity=64))
    assert whole.count() == len(by) and whole.agg(F.sum("n_pieces")).head()[0] == len(packed)
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


# --- quality and language ------------------------------------------------


def test_quality(spark):
    r = random.Random(7)
    good = [prose(r, r.randrange(30, 300)).capitalize() + "." for _ in range(120)]
    junk = [" ".join(w.upper() + "!!" for w in prose(r, r.randrange(30, 200)).split()) for _ in range(40)]
    texts = [*good, *junk, *ODD]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 120), 0, "x") for i in range(160)] + [(0, None, 0, "x"), (9999, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    scored = {x["doc_id"]: x for x in quality.quality_scores(df, labels.filter("quality is not null"), train=F.col("doc_id") % 4 != 0).collect()}
    assert len(scored) == len(texts) and all(0 <= s["score"] <= 1 and s["predicted"] == (s["score"] >= 0.5) for s in scored.values())
    held = [i for i in range(0, 160, 4)]
    assert np.mean([scored[i]["predicted"] == (i < 120) for i in held]) >= 0.95
    kept = quality.quality_filter(df, labels.filter("quality is not null"))
    assert kept.columns == df.columns and kept.filter("doc_id < 120").count() >= 118
    assert {x["score"] for x in quality.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(df.limit(0), labels).count() == 0


def test_quality_density_is_the_gaussian_one(spark):
    """Scores equal a plain evaluation of both densities."""
    r = np.random.default_rng(8)
    d = len(quality.FEATURES)
    x = r.normal(size=(300, d)) * np.linspace(0.5, 2, d)
    y = (r.random(300) < 0.5).astype(int)
    x[y == 1] += 0.5
    model = quality.fit(spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "x array<double>, label int"), 0.1, 0.02)
    scale = np.sqrt(sum((y == k).mean() * x[y == k].var(axis=0) for k in (0, 1)))
    z = x / scale
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    common = sum((y == k).mean() * own[k] for k in (0, 1))
    log = []
    for k in (0, 1):
        c = 0.9 * own[k] + 0.1 * common
        c = 0.98 * c + 0.02 * np.trace(c) / d * np.eye(d)
        off = z - z[y == k].mean(axis=0)
        log.append(np.log((y == k).mean()) - 0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ij,jk,ik->i", off, np.linalg.inv(c), off)))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-8)


def test_language(spark):
    r = random.Random(9)
    sets = {"en": ["the", "and", "thing", "with", "over", "ship"], "de": ["und", "schön", "nicht", "über", "auch", "zeit"], "fr": ["être", "les", "avec", "où", "chose", "leçon"]}
    texts, langs = [], []
    for i in range(150):
        lang = list(sets)[i % 3]
        texts.append(" ".join(r.choice(sets[lang]) for _ in range(r.randrange(5, 60))))
        langs.append(lang)
    texts += [None, "", "123 !?", "über schön " * 40_000, "the"]
    langs += [None, "en", "en", "de", "en"]
    got = {x["doc_id"]: x for x in language.language_scores(docs(spark, texts, langs=langs), train=F.col("doc_id") % 3 != 1, per_lang=30).collect()}
    assert len(got) == len(texts) and all(0 <= x["score"] <= 1 for x in got.values())
    assert [got[i]["lang_pred"] for i in (150, 151, 152)] == ["und"] * 3 and got[153]["lang_pred"] == "de"
    seen = [i for i in range(150) if langs[i] in {langs[j] for j in range(155) if j % 3 != 1 and langs[j]}]
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in seen]) > 0.95
    assert {x["lang_pred"] for x in language.language_scores(docs(spark, texts, langs=langs), train=F.lit(False)).collect()} == {"und"}
    assert language.language_scores(docs(spark, texts).limit(0)).count() == 0


# --- pages ---------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><header>Site name</header><!-- ad -->
<div class="ad">Buy this now, it is cheap and good.</div><div id="page"><article><h1>A &amp; B&copy;</h1><p><b>First  para
graph<br><p>Second <i>one</i>, with a <a href="/x">link</a> in it, long enough to be text.</p><ul><li>point</ul><form>Name <input></form>
<div class="comments"><p>Great article, thanks for sharing it with everybody!</p></div></article><aside>More stories</aside></div>
<footer>&copy; 2024 somebody, all rights reserved and so on</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "A & B©\nFirst para graph\nSecond one, with a link in it, long enough to be text.\npoint"),
        (None, ""), ("", ""), ("<html></html>", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"),
        ("<body><article><h1>Only</h1></article><footer>foot</footer>", "Only"),
        ("<article><p>cut &am", "cut &am"), ("<article><p>cut <b", "cut"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<script>x</script><textarea>y</textarea>", ""), ("<p>1 &lt; 2 &#233; &nosuch;</p>", "1 < 2 é &nosuch;"), ("</div></p>stray", "stray"),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


def test_main_texts_of_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "u", "<p>" * 5000 + "deep", "x")], "page_id long, url string, html string, text string")
    got = rows(html.main_texts(df))
    assert len(got) == 4 and got[1][2:] == ("", 0) and got[3][2] == "deep" and got[0][3] == len(got[0][2])
    assert html.main_texts(df.limit(0)).count() == 0


# --- licences ------------------------------------------------------------


def brute_licenses(texts, templates=licenses.TEMPLATES):
    import re

    split = lambda s: [w for w in re.split("[^a-z0-9]+", (s or "").lower()) if w]
    grams = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    out = set()
    for name, _, body in templates:
        want = set(grams(split(body)))
        width = 2
        while width * 3 < len(want) * 4:
            width *= 2
        for i, text in enumerate(texts):
            have = grams(split(text))
            best = max((len(want & set(have[s : s + width])) / len(want) for s in range(0, len(have), max(1, width // 4))), default=0)
            if best >= 0.8:
                out.add((i, name, round(best, 6)))
    return out


def test_licenses(spark):
    r = random.Random(10)
    texts = [*ODD]
    for _, _, body in licenses.TEMPLATES:
        words = body.split()
        texts += [body, prose(r, 50) + " " + body.upper() + "\n" + prose(r, 30), " ".join(words[: len(words) // 2]), " ".join(words[: max(1, len(words) * 9 // 10)])]
        texts.append(prose(r, 3000) + " " + body)
    got = {(x["doc_id"], x["template_id"], round(x["containment"], 6)) for x in licenses.license_matches(docs(spark, texts)).collect()}
    assert got == brute_licenses(texts)
    assert {x[1] for x in got} == {t[0] for t in licenses.TEMPLATES}
    assert licenses.license_matches(docs(spark, texts).limit(0)).count() == 0


# --- neighbours ----------------------------------------------------------


def test_neighbours_exact_when_all_is_visited(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(400, 8)).round(1)
    x[100:140] = x[0]  # equal vectors, more than k
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    table += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [1.0]), (1005, []), (5, x[5].tolist()), (1006, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, 1) for i, v in table], "vec_id long, embedding array<double>, class int")
    got = neighbours.nearest(df, F.col("id") % 50 == 0, k=5, trees=4, leaf_rows=40, block_rows=100, query_rows=3, target=1.0).collect()
    by = {}
    for g in got:
        by.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert set(by) == set(range(0, 400, 50))
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(400), d)) if i != q][:5]
        assert [f[1] for f in sorted(found)] == order and np.array_equal([f[2] for f in sorted(found)], d[order])
    few = neighbours.nearest(df.filter("vec_id < 3"), F.col("id") == 0, k=5).collect()
    assert len(few) == 2
    assert neighbours.nearest(df.limit(0), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1", "clustered"])
def test_neighbours_recall(spark, name):
    """Recall with the query's own parameters, and how many exact distances a query costs."""
    if name == "clustered":
        r = np.random.default_rng(12)
        x = np.repeat(r.normal(size=(100, 32)), 40, axis=0) + 0.1 * r.normal(size=(4000, 32))
        df, ids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), np.arange(4000)
    else:
        if not (DATA / name).is_dir():
            pytest.skip("no test tables")
        df = spark.read.parquet(f"{DATA}/{name}/embeddings.parquet").select("vec_id", "embedding")
        table = df.toPandas()
        x, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    found = neighbours.nearest(df, F.col("id") % 100 == 0, counts=True).toPandas()
    got, asked = set(zip(found["query_id"], found["vec_id"])), ids[ids % 100 == 0]
    hit = 0
    for q in asked:
        d = np.where(ids == q, np.inf, ((x - x[ids == q][0]) ** 2).sum(axis=1))
        hit += sum((q, i) in got for i in ids[np.lexsort((ids, d))[:10]])
    share = found.groupby("query_id")["n_candidates"].first().mean() / len(x)
    print(name, "recall", hit / (10 * len(asked)), "share of rows compared", share)
    assert len(found) == 10 * len(asked) and hit / len(found) >= 0.9
    assert share < {"sf0.01": 0.7, "sf0.1": 0.5, "clustered": 0.1}[name]


# --- suffix arrays -------------------------------------------------------


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(13)
    for _ in range(150):
        raw = (r.integers(0, r.integers(1, 5), r.integers(1, 70)) * r.integers(1, 80)).astype(np.uint8)
        b, n = raw.tobytes(), len(raw)
        order = sorted(range(n), key=lambda i: b[i:])
        assert suffix.suffix_array(raw).tolist() == order
        common = suffix.permuted_common_prefixes(raw, np.array(order), 20)
        for x, y in zip(order, order[1:]):
            k = 0
            while k < 20 and x + k < n and y + k < n and b[x + k] == b[y + k]:
                k += 1
            assert common[y] == k


def brute_repeats(order, span):
    seen, out = set(), {}
    for i, raw in order:
        covered = bytearray(len(raw))
        for s in range(len(raw) - span + 1):
            w = raw[s : s + span]
            if w in seen:
                covered[s : s + span] = b"\1" * span
            seen.add(w)
        out[i] = bytes(c for c, x in zip(raw, covered) if not x)
    return out


@pytest.mark.parametrize("hot_rows, key_bytes", [(20_000, 64_000_000), (2, 64_000_000), (20_000, 300), (2, 300)])
def test_remove_repeats(spark, hot_rows, key_bytes):
    """Few hot rows make the grams of common passages be dealt again, few bytes a key the windows of what meets there."""
    r = random.Random(14)
    passage, line = prose(r, 60), "Menu Home About Contact " * 8
    texts = [*ODD, passage, *[prose(r, r.randrange(5, 80)) + " " + r.choice([passage, line, passage[20:200], "ü" * 150]) + " " + prose(r, 20) for _ in range(40)], "ab" * 400, "A" * 500]
    near = prose(r, 300).split()
    for _ in range(6):
        words = [*near]
        words[r.randrange(300)] = "changed"
        texts.append(" ".join(words))
    texts.append(texts[20])
    df = docs(spark, texts)
    got = {x["doc_id"]: x for x in suffix.remove_repeats(df, hot_rows=hot_rows, key_bytes=key_bytes).collect()}
    want = brute_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)], 100)
    assert {i: bytes(x["kept"]) for i, x in got.items()} == want
    assert all(x["n_bytes"] - x["n_removed"] == len(want[i]) for i, x in got.items())
    assert got[len(texts) - 1]["n_removed"] == got[len(texts) - 1]["n_bytes"]


@pytest.mark.parametrize("hot_rows, key_bytes", [(100_000, 64_000_000), (50, 64_000_000), (50, 20_000)])
def test_one_line_among_unlike_neighbours(spark, hot_rows, key_bytes):
    """A line of little more than a window, in every document, each time with other text around it."""
    r = random.Random(16)
    line = "All rights reserved, no part of this page may be reproduced without written permission of its owner. 2024"
    texts = [f"{r.randrange(1 << 60):x} " * r.randrange(1, 3) + line + f" {r.randrange(1 << 60):x}" for _ in range(4000)]
    got = {x["doc_id"]: bytes(x["kept"]) for x in suffix.remove_repeats(docs(spark, texts).repartition(6), hot_rows=hot_rows, key_bytes=key_bytes).collect()}
    assert got == brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 100)


def test_a_large_key_is_not_held():
    """200,000 different segments of one key, 22 MB: a task keeps little of them, and hands on every window once."""
    import tracemalloc

    line = b"x" * 92

    def batches():
        for at in range(0, 200_000, 2000):
            yield pd.DataFrame([(1, i, 0, 50, b"%08d" % i + line + b"%08d" % i) for i in range(at, at + 2000)], columns=["key", "rid", "first", "at", "seg"])

    n, last = 0, None
    tracemalloc.start()
    for out in suffix._shard(100, 200_000, 1_000_000)(batches()):
        n += sum(len(w) == 100 for w in out["seg"])
        last = tuple(out.iloc[-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 * 9 and last[2] == 8 and peak < 15_000_000
    rows = pd.DataFrame([(5, 1, 0, 0, b"a"), (5, 2, 3, 0, b"a"), (5, 2, 9, 0, b"b"), (5, 7, 1, 0, b"b"), (6, 0, 4, 9, None)], columns=["key", "rid", "first", "at", "seg"])
    got = pd.concat(list(suffix._equal_windows(1)([rows.iloc[:2], rows.iloc[2:4], rows.iloc[4:]])))
    assert got[["rid", "first", "at"]].values.tolist() == [[2, 3, 1], [7, 1, 1], [0, 4, 9]]


def test_remove_repeats_of_repeated_ids(spark):
    r = random.Random(15)
    a, b = prose(r, 80), prose(r, 80)
    df = docs(spark, [a, a, b + a, b, a, None], ids=[1, 1, 2, None, 3, 2])
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffix.remove_repeats(df).collect()]
    n, m = len(a), len(b)
    assert sorted(got, key=repr) == sorted([(1, n, 0), (1, n, 0), (2, n + m, n), (None, m, m), (3, n, n), (2, 0, 0)], key=repr)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


# --- ids -----------------------------------------------------------------


def test_large_and_null_ids_keep_their_value(spark):
    big = 2**60 + 1
    df = docs(spark, ["one two three four", None, "one two three four"], ids=[big, None, big + 1])
    labels = spark.createDataFrame([(big, 1)], "doc_id long, quality int")
    frames = [
        quality.quality_scores(df, labels), language.language_scores(df), simhash.simhash_components(df), packing.pack_digests(df, TOKENIZER),
        suffix.remove_repeats(df), exact.exact_classes(df), mixing.mix_plan(df),
        html.main_texts(df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
    ]
    for f in frames:
        assert sorted((r[0] or 0 for r in f.select("doc_id").collect())) == [0, big, big + 1], f.columns


def test_ids_of_any_type(spark):
    df = docs(spark, ["a b c d", "a b c d", None, "x"]).withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id")))
    ids = ["id-0", "id-1", "id-2", "id-3"]
    labels = df.select("doc_id", (F.col("doc_id") < "id-2").cast("int").alias("quality"))
    for out in (
        quality.quality_scores(df, labels), language.language_scores(df), packing.pack(df, TOKENIZER), simhash.simhash_components(df), exact.exact_classes(df),
        html.main_texts(df.withColumn("url", F.lit("u")), "doc_id", "text"), mixing.mix_plan(df),
    ):
        assert sorted(r[0] for r in out.select("doc_id").collect()) == ids


# --- scale and odd rows --------------------------------------------------


def test_kernel_model_is_the_plain_one():
    """Kernel, Nyström map and ridge against their definitions on sets of n-grams."""
    r = random.Random(21)
    texts = [prose(r, 12, 60) for _ in range(24)] + ["".join(r.choice("щжюяфы ") for _ in range(80)) for _ in range(24)]
    langs, found = ["a"] * 24 + ["b"] * 24, [language.grams(t) for t in texts]

    def spectrum(text):
        t = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + (" " if text and not text[-1].isalpha() else "")
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    sets = [spectrum(t) for t in texts]
    assert [len(g) for g in found] == [len(s) for s in sets]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    marks = [*range(6), *range(24, 30)]
    vocabulary, land = language.landmark_matrix([found[i] for i in marks])
    bits, sizes = [], [len(g) for g in found]
    for g in found:
        seen = np.zeros(len(vocabulary), bool)
        seen[language._places(vocabulary, g)] = True
        bits.append(np.packbits(seen).tobytes())
    model = language.fit(vocabulary, land, bits, sizes, langs, ridge=0.1)
    values, vectors = np.linalg.eigh(kernel[np.ix_(marks, marks)])
    phi = kernel[:, marks] @ vectors / np.sqrt(np.maximum(values, 1e-6))
    y = np.where(np.arange(48) < 24, 1.0, -1.0)
    solved = np.linalg.solve(phi.T @ phi + 0.1 * np.eye(12), phi.T @ np.stack([y, -y], axis=1))
    assert np.allclose(model.margins(found), phi @ solved, atol=1e-3)
    assert (model.margins(found).argmax(axis=1) == (np.arange(48) >= 24)).all()


def test_language_of_long_texts_and_many_scripts(spark):
    """Texts with more n-grams than any fixed table holds stay apart."""
    r = random.Random(22)
    script = lambda base, n: "".join(chr(base + r.randrange(6000)) for _ in range(n))
    texts = [script(0x4E00, 300) for _ in range(20)] + [script(0x7000, 300) for _ in range(20)] + [script(0x4E00, 200_000), script(0x7000, 200_000)]
    langs = ["x"] * 20 + ["y"] * 20 + [None, None]
    got = {x["doc_id"]: x["lang_pred"] for x in language.language_scores(docs(spark, texts, langs=langs), per_lang=15).collect()}
    assert [got[i] for i in range(42)] == ["x"] * 20 + ["y"] * 20 + ["x", "y"]


def test_language_learns_from_few_ids_whatever_repeats(spark):
    texts = ["the cat and the dog"] * 300 + ["der hund und die katze"] * 3
    df = docs(spark, texts, ids=[1] * 300 + [2, 3, 4], langs=["en"] * 300 + ["de"] * 3)
    assert language.training_rows(df, F.lit(True), "doc_id", "text", "lang", 2).count() == 3
    assert {(x["doc_id"] == 1, x["lang_pred"]) for x in language.language_scores(df).collect()} == {(True, "en"), (False, "de")}


def test_contradictory_labels_do_not_count(spark):
    r = random.Random(23)
    texts = [prose(r, 80) if i % 2 else "$$$ 123 ### " * 20 for i in range(40)]
    df = docs(spark, texts)
    clear = [(i, i % 2) for i in range(30)]
    scores = []
    for extra in ([], [(31, 0), (31, 1), (5, 1), (5, 1)], [(31, 1), (5, 1), (31, 0), (None, 1), (32, None), (33, 7)]):
        labels = spark.createDataFrame([*extra, *clear], "doc_id long, quality int")
        scores.append({x["doc_id"]: round(x["score"], 9) for x in quality.quality_scores(df, labels).collect()})
    assert scores[0] == scores[1] == scores[2]


def test_quotas_are_the_same_in_slices(spark):
    draws = spark.createDataFrame([("a", 500), (None, 90), ("c", 7)], "source string, draws int")
    want = rows(mixing.shard_quotas(draws, 4, 5))
    assert rows(mixing.shard_quotas(draws, 4, 5, n_draws=597, window_rows=100)) == want
    assert sum(r[2] for r in want) == 597


def test_shards_are_bounded(spark):
    df = docs(spark, ["a b c d e"] * 200, sources=["x", "y"] * 100)
    assert mixing._plan(df, shard_words=1, max_shards=8)[1] == 8


def test_licences_in_long_repetitive_texts(spark):
    """A text of several parts, of notices only, and one notice over the border of two parts."""
    body = licenses.TEMPLATES[0][2]
    filler = "word " * (licenses.PART - 20)
    texts = [" ".join([body] * 300), filler + body + " " + filler, "x " * 9000]
    got = {(x["doc_id"], x["template_id"], round(x["containment"], 6)) for x in licenses.license_matches(docs(spark, texts)).collect()}
    assert got == brute_licenses(texts) and {g[0] for g in got} == {0, 1}
