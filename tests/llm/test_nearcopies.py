"""Near copies of the pipeline: planted similarities, brute force, repeated and null ids."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from lakeloom.llm import nearcopies
from lakeloom.llm.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, similarity):
    """A copy whose five-word shingles have about ``similarity`` or a little more with those of ``words``."""
    out, own = list(words), nearcopies.shingles(" ".join(words))
    for at in rng.sample(range(len(words)), len(words)):
        tried = out[:at] + [f"x{rng.random()}"] + out[at + 1 :]
        if not nearcopies.similar(own, nearcopies.shingles(" ".join(tried)), similarity):
            break
        out = tried
    return " ".join(out)


def test_planted_near_copies_are_dropped(spark):
    rng = random.Random(3)
    rows = []
    for n in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = edited(rng, words, (0.8, 0.9, 0.95)[n % 3])
        rows += [(n, " ".join(words)), (1000 + n, copy), (2000 + n, edited(rng, words, 0.5))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert set(range(120)) <= kept
    assert all(len({i for i in range(1000 + k, 1120, 3)} & kept) <= (1 if k == 0 else 0) for k in range(3))
    assert len({i for i in kept if i >= 2000}) >= 110  # 0.5 is no copy


def test_groups_equal_all_pairs():
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    sets = [nearcopies.shingles(edited(rng, base, rng.choice((0.7, 0.85, 0.9)))) for _ in range(60)]
    sets += [nearcopies.shingles(" ".join(rng.choices(base, k=60))) for _ in range(20)]

    def groups(links):
        of = list(range(len(sets)))
        for a, b in links:
            of = [of[b] if x == of[a] else x for x in of]
        return [[j for j in range(len(sets)) if of[j] == of[i]] for i in range(len(sets))]

    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if nearcopies.similar(sets[i], sets[j], 0.8)]
    assert pairs and groups(nearcopies.copy_links(sets, 0.8)) == groups(pairs)


def test_near_dedup_of_repeated_and_null_ids(spark):
    words = [f"w{k}" for k in range(100)]
    a, near, b = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"v{k}" for k in range(50))
    rows = [(3, a), (3, a), (5, near), (5, b), (None, a), (None, "alone one"), (None, "alone one"), (7, ""), (8, None), (9, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()), key=repr)
    assert got == sorted([(3, a), (5, b), (None, "alone one"), (7, "")], key=repr)
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_large_components_meet_by_key(spark):
    """A chain of texts that collide by chance, and a group of near copies: with small places the links are the same, and no place is large."""
    rng = random.Random(7)
    texts, window = [], [f"w{k}" for k in range(120)]
    for i in range(300):  # each shares about half of its shingles with the next
        texts.append(" ".join(window))
        window = [*window[40:], *[f"x{i}_{k}" for k in range(40)]]
    base = [f"v{k}" for k in range(150)]
    texts += [edited(rng, base, rng.choice((0.82, 0.9))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)

    def groups(**options):
        named, roots = nearcopies.jaccard_roots(df, **options)
        of = {r["node"]: r["root"] for r in roots.collect()}
        found = {}
        for r in named.collect():
            found.setdefault(of.get(r["node"], r["node"]), set()).add(r["_md5"])
        return sorted(map(sorted, found.values()))

    whole = groups()
    assert max(map(len, whole)) >= 35 and groups(group_shingles=1000) == whole
    signed = [(nearcopies.node_of(s), len(s), nearcopies.band_keys(s)) for s in map(nearcopies.shingles, texts)]
    weights = spark.createDataFrame([(n, w) for n, w, _ in signed], "node long, n long")
    dealt = spark.createDataFrame([(k, n) for n, _, keys in signed for k in keys], "key long, node long")
    stars = dealt.groupBy("key").agg(F.min("node").alias("b"))
    coarse = connected_components(dealt.join(stars, "key").filter("node <> b").select(F.col("node").alias("a"), "b"))
    where = nearcopies.meetings(dealt, coarse, weights, 2000).join(weights, "node")
    assert where.groupBy("place").agg(F.sum("n").alias("s")).agg(F.max("s")).head()[0] <= 2 * 2000
    by_key = {}
    for n, _, keys in signed:
        for k in keys:
            by_key.setdefault(k, set()).add(n)
    met = {}
    for r in where.collect():
        met.setdefault(r["node"], set()).add(r["place"])
    assert all(met[a] & met[b] for nodes in by_key.values() for a in nodes for b in nodes if a != b)  # every two with a common key
