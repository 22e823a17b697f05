"""Near copies by shingle similarity: MinHash bands find them, exact Jaccard decides.

A text is the set of its hashed word shingles; equal sets are one node. Each node gets
``BANDS`` keys of ``ROWS`` least hashes each. Two sets of similarity 0.8 share a key with
probability 0.9993, of 0.85 with 0.99999. The nodes of a key are joined in a star, and the components of
these short edges say which texts may meet: each such text is shuffled once, to its component. There the links of
at least the threshold are found exactly, key by key; nodes that are linked already aren't compared again,
so a large group of copies costs about one comparison a member.

Chance collisions join components up as a corpus grows. So the texts of a component of more than ``GROUP_SHINGLES`` shingles
meet by key instead, and those of a key of more in pairs of blocks: every two texts with a common key still meet, and no task
holds more than about ``GROUP_SHINGLES`` shingles, whatever the components are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, cut, whole_row
from .graph import connected_components
from .simhash import fingerprint, near_links

BANDS, ROWS = 24, 6
#: Shingles that meet in one place: 64 MB.
GROUP_SHINGLES = 8 << 20
_DRAW = np.random.default_rng(42)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words))).tolist()
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1))


def node_of(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    value = xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 7)
    return value - (1 << 64) if value >> 63 else value


def band_keys(hashes: np.ndarray) -> list[int]:
    """The signed keys of a set's bands; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, at : at + 2048] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return [int(k) for k in np.array([xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)]


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches ``threshold``."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared >= threshold * (len(a) + len(b) - shared)


def copy_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Positions (member, root) for each non-root member of the groups that links of ``threshold`` between sets with a common key make."""
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    buckets: dict[int, dict[int, list[int]]] = defaultdict(dict)  # key -> group -> members
    for i, own in enumerate(sets):
        keys, compared = band_keys(own), set()
        for key in keys:
            groups = buckets[key]
            for old in [g for g in groups if find(g) != g]:
                a, b = groups.pop(old), groups.get(find(old), [])
                groups[find(old)] = a + b if len(a) < len(b) else b + a
            for group in list(groups):
                if find(group) == find(i):
                    continue
                for j in groups[group]:
                    if j not in compared:
                        compared.add(j)
                        if similar(own, sets[j], threshold):
                            parent[find(i)] = find(j)
                            break
        for key in keys:
            buckets[key].setdefault(find(i), []).append(i)
    return [(i, find(i)) for i in range(len(sets)) if find(i) != i]


def meetings(dealt: DataFrame, coarse: DataFrame, weights: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(``node``, ``place``): where nodes meet. ``dealt`` has the nodes of each key, ``coarse`` the components over all keys, ``weights`` the shingles (``n``) of each node."""
    weighed = cut(weights.join(coarse, "node").select("node", "n", "root"))
    large = cut(weighed.groupBy("root").agg(F.sum("n").alias("_all")).filter(F.col("_all") > group_shingles).select("root"))
    place = F.concat(F.lit("c"), F.col("root").cast("string")).alias("place")
    if large.isEmpty():
        return weighed.select("node", place)
    small = weighed.join(large, "root", "left_anti").select("node", place)
    loose = cut(dealt.join(weighed.join(large, "root", "left_semi"), "node").select("key", "node", "n").distinct())
    blocks = F.when(F.col("_all") <= group_shingles, 1).otherwise(F.ceil(2 * F.col("_all") / group_shingles)).cast("int")
    keys = loose.groupBy("key").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_nodes")).filter("_nodes > 1").select("key", blocks.alias("_blocks"))
    own = F.pmod(F.xxhash64("node", "key"), F.col("_blocks")).cast("int")
    pairs = loose.join(keys, "key").withColumn("_own", own).withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    name = F.concat_ws("/", F.col("key").cast("string"), F.least("_own", "_other").cast("string"), F.greatest("_own", "_other").cast("string"))
    return small.unionByName(pairs.select("node", F.concat(F.lit("k"), name).alias("place")))


def jaccard_roots(docs: DataFrame, text_col: str = "text", threshold: float = 0.8, width: int = 5, radius: int | None = None, group_shingles: int = GROUP_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(``_md5``, ``node``), one row for each text, and (``node``, ``root``) for each node with a near copy.

    With a ``radius``, SimHash fingerprints of the same shingles that differ in so many bits link their texts too.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, width) for t in pdf["_text"]]
            fps = np.array([0 if radius is None else fingerprint(t, width, 42) for t in pdf["_text"]], np.uint64)
            yield pd.DataFrame({"_md5": pdf["_md5"], "n": [len(s) for s in sets], "node": np.array([node_of(s) for s in sets], np.int64), "fp": fps.view(np.int64), "keys": [band_keys(s) for s in sets]})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, nodes, sets = None, [], []

        def links() -> pd.DataFrame:
            found = copy_links(sets, threshold)
            return pd.DataFrame({"a": np.array([nodes[i] for i, _ in found], np.int64), "b": np.array([nodes[j] for _, j in found], np.int64)})

        for pdf in batches:
            for place, node, text in zip(pdf["place"].tolist(), pdf["node"].tolist(), pdf["_text"]):
                if place != group:
                    if len(nodes) > 1:
                        yield links()
                    group, nodes, sets = place, [], []
                nodes.append(node)
                sets.append(shingles(text, width))
        if len(nodes) > 1:
            yield links()

    texts = docs.select(F.md5(clean_text(text_col)).alias("_md5"), clean_text(text_col).alias("_text"))
    signed = cut(texts.mapInPandas(sign, "_md5 string, n long, node long, fp long, keys array<long>"))
    dealt = signed.select(F.explode("keys").alias("key"), "node")
    stars = dealt.groupBy("key").agg(F.min("node").alias("least"))
    edges = dealt.join(stars, "key").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    coarse = connected_components(edges)
    # One text of each node that may have a copy goes to where it meets others.
    named = cut(signed.groupBy("node").agg(F.min("_md5").alias("_md5"), F.first("n").alias("n")))
    members = cut(named.join(meetings(dealt, coarse, named.select("node", "n"), group_shingles), "node").select(F.col("_md5").alias("_of"), "node", "place"))
    meet = texts.join(members, F.col("_md5") == F.col("_of")).groupBy("place", "node").agg(F.first("_text").alias("_text"))
    found = meet.repartition("place").sortWithinPartitions("place", "node").mapInPandas(link, "a long, b long")
    if radius is not None:
        found = found.unionByName(_fingerprint_links(signed, radius))
    return signed.select("_md5", "node").distinct(), connected_components(found)


def _fingerprint_links(signed: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between nodes: those of one fingerprint in a star around the least, and the least of fingerprints within ``radius``."""
    pairs = cut(signed.select("fp", "node").distinct())
    least = cut(pairs.groupBy("fp").agg(F.min("node").alias("least")))
    links = near_links(least, radius)
    of = lambda name: least.select(F.col("fp").alias(name), F.col("least").alias(f"_{name}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return between.unionByName(pairs.join(least, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, radius: int | None = None, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """One row of each component of near copies, with all its columns: the one with the smallest id, nulls last.

    Texts link when their sets of ``width``-word shingles have a Jaccard similarity of at least ``threshold``, or, with a ``radius``, when their
    SimHash fingerprints differ in so many bits at most.
    The verdict belongs to a row's id and text together; of rows that repeat both one stays. Texts without words are
    copies of each other. Null text counts as empty; an empty table gives no rows.
    """
    texts, roots = jaccard_roots(docs, text_col, threshold, width, radius, group_shingles)
    of = texts.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(F.col("_md5").alias("_of"), F.coalesce("root", "node").alias("root"))
    ids = docs.select(F.col(id_col).alias("_id"), F.md5(clean_text(text_col)).alias("_md5")).distinct()
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_md5").alias("md5")))
    kept = ids.join(of, F.col("_md5") == F.col("_of")).groupBy("root").agg(first.alias("k")).select(_key(F.col("k.id"), F.col("k.md5")).alias("_kept"))
    keyed = docs.select(whole_row(docs), _key(F.col(id_col), F.md5(clean_text(text_col))).alias("_key"))
    # Join and deduplication have one key: whole rows are shuffled once.
    return keyed.join(kept, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"]).select("_row.*")


def _key(name: Column, md5: Column) -> Column:
    """128 bits of an id, null or not, and a text."""
    return F.md5(F.concat_ws("|", md5, name.isNull().cast("string"), name.cast("string")))
