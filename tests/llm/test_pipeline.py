"""The pipeline, stage by stage, and the registered queries."""

import random

import duckdb
import pytest
from conftest import rows

import corpus_pipeline
from lakeloom.llm import exact, mixing, queries, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name != names[-1]:
            assert sorted(out.columns) == sorted(COLUMNS)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if name == "quality_classifier":
            ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
            judged = [(labels[i] == 1) == (i in ids) for i in labels]
            assert sum(judged) / len(judged) >= 0.95
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == counts[-1]
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got = df.toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.sql(queries.ORACLE_SQL[name]).df()
        key = sorted(got.columns)
        assert sorted(map(repr, got[key].astype(str).itertuples(index=False, name=None))) == sorted(map(repr, want[key].astype(str).itertuples(index=False, name=None)))


def test_repeated_and_null_ids_through_the_stages(spark):
    """Verdicts and draws belong to rows, not to ids."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(3, "a a"), (3, "a a"), (5, "a a"), (5, "b"), (None, "c c c"), (None, "c c c"), (None, "d"), (None, "a a"), (None, None), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], schema)
    pairs = lambda out: sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    want = sorted([(3, "a a"), (5, "b"), (None, "c c c"), (None, "d"), (6, "")], key=repr)
    assert pairs(corpus_pipeline.drop_copies(spark, df, "")) == want
    assert pairs(simhash.near_dedup(df, radius=0)) == want
    assert pairs(exact.exact_dedup(df.filter("doc_id is null"), keep="max")) == sorted([(None, "c c c"), (None, "d"), (None, "a a"), (None, None)], key=repr)

    many = [(i, t, "en", s, 1) for s in "xyz" for i, t in [(None, "n n"), (None, "n n"), (None, "m " * 9), (7, "p " * 5), (7, "p " * 5), (7, "q " * 3), *[(k, f"t{k} u") for k in range(20, 50)]]]
    docs = spark.createDataFrame(many, schema)
    plan = mixing.mix_plan(docs, block_words=20, shards=4).collect()
    got = corpus_pipeline.mixing.mix(docs, block_words=20, shards=4).collect()
    assert len(got) == sum(len(r["draws"]) for r in plan)
    assert len(plan) == len(many)
    for s in "xyz":
        target = next(r["target"] for r in plan if r["source"] == s)
        assert abs(sum(len(r["text"].split()) for r in got if r["source"] == s) - target) <= 10


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, target double, _md5 string, words string"


def odd_documents(spark, texts, ids=None):
    """Documents with null columns, and further ones whose names clash with the stages' own."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", "xyz"[k % 3] if k % 7 else None, None if t is None else len(t), True, 0.5, "m", None) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def near_groups(texts):
    """Which texts stay: the first of each group that links of 0.8 Jaccard of five-word shingles make."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)})
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [i for i, g in enumerate(group) if i == g]


def test_near_copies_stage_equals_all_pairs(spark):
    r = random.Random(31)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 200))) for _ in range(60)]
    for i in range(0, 40, 2):
        copy = texts[i].split()
        for _ in range(r.choice([1, 1, 2, 4])):
            copy[r.randrange(len(copy))] = r.choice(words)
        texts.append(" ".join(copy))
    texts += [None, "", " \n", "one", "one", "two three"]
    got = corpus_pipeline.drop_near_copies(spark, odd_documents(spark, texts), "")
    assert sorted(r["doc_id"] for r in got.collect()) == near_groups(texts)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_mix_stage_by_source(spark):
    """Each source's words come near its target by the rules; no row is taken more than three times its size, none is added."""
    r = random.Random(32)
    texts = [" ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(1, 40))) for _ in range(120)] + [None, "", " "]
    df = odd_documents(spark, texts, ids=[*range(120), 5, None, 7])
    source = {}
    for row in df.collect():
        source.setdefault(row["source"], []).append(row["text"])
    size = {s: sum(len((t or "").split()) for t in ts) for s, ts in source.items()}
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s)), (1, 2, 3, 1)))
    target, free, rest = {}, set(size), sum(size.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        rest -= sum(3 * size[s] for s in over)
        free -= over
    mixed = corpus_pipeline.mix_sources(spark, df, "").collect()
    for s in size:
        took = [row["text"] for row in mixed if row["source"] == s]
        assert abs(sum(len(t.split()) for t in took) - target[s]) <= 1
        whole = {}
        for t in took:
            whole[t] = whole.get(t, 0) + 1
        assert all(n <= 4 * source[s].count(t) for t, n in whole.items() if t in source[s]) and sum(t not in source[s] for t in took) <= 1


@pytest.mark.parametrize("texts", [[], [None, "", " "], ["only one text of some words"]])
def test_stages_on_odd_tables(spark, tmp_path, texts):
    """Empty tables, empty texts and clashing columns go through all stages."""
    docs = odd_documents(spark, texts)
    spark.createDataFrame([(0, 1), (0, 1), (None, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert set(COLUMNS) <= set(out.columns) or name == "best_fit_packing"
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    assert docs.count() == (1 if any(t and t.strip() for t in texts) else 0)


def test_whole_run_is_its_stages(spark, sf, tmp_path):
    """``run`` gives what the stages give one by one, each on the last one's files."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, sf), *columns) == rows(docs, *columns)
