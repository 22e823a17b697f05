"""SimHash near-dedup with BK-trees.

Fingerprints are 64-bit majority votes over hashed word shingles. Equal
fingerprints collapse first. The distinct ones are dealt into shards so that any
two within the radius share one: the 64 bits are cut into radius + 1 blocks, of
which two near fingerprints agree on at least one. A shard of more than
``shard_cap`` members is dealt again by sub-blocks of its remaining bits; after
``levels`` such steps the bits left bound the distinct members. In each
shard a BK-tree is built, children keyed by their integer distance to the parent,
and every member follows only the edges within the radius. The trees travel
with their shards through the shuffle: a broadcast would have to gather the
fingerprints of all documents on the driver.

A shard gives at most one edge a member (a spanning forest of its links), so large
groups are never expanded into pairs. Components come from
:mod:`.graph`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, cut, id_back, id_text, whole_row
from .graph import connected_components

#: For each byte value, its bits, the least significant first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned; 0 for one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words))).tolist()
    width = min(shingle, len(words))
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])), np.uint64, n)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    n, votes = len(hashes), np.zeros((8, 8), np.int64)
    for at in range(0, n, 1 << 16):
        lanes = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        votes += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (votes.ravel() * 2 > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, ``fp`` long): the signed form of each row's fingerprint. Null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in pdf["_text"]], np.uint64)
            yield pd.DataFrame({"_id": pdf["_id"], "fp": fps.view(np.int64)})

    rows = docs.select(id_text(id_col), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "_id string, fp long").select(id_back(docs, id_col), "fp")


class BKTree:
    """A BK-tree over 64-bit integers; node 0 is the root."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while at:
            distance = (self.values[node] ^ value).bit_count()
            below = self.children[node].setdefault(distance, at)
            if below == at:
                return
            node = below

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Indexes of the values within ``radius``."""
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            for edge, child in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root value) for each non-root value of the groups that links within ``radius`` make."""
    tree, parent = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            parent[find(j)] = find(i)
        tree.add(value)
    return [(v, values[find(i)]) for i, v in enumerate(values) if find(i) != i]


def _masks(free: int, parts: int) -> list[int]:
    """The bits of ``free`` in ``parts`` masks of near equal size."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _shard_links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, members = None, []

        def links() -> pd.DataFrame:
            found = spanning_links([m & ((1 << 64) - 1) for m in members], radius)
            return pd.DataFrame({"a": np.array([x for x, _ in found], np.uint64).view(np.int64), "b": np.array([x for _, x in found], np.uint64).view(np.int64)})

        for pdf in batches:
            for key, part in pdf.groupby(["path", "value"], sort=False)["fp"]:
                if key != open_key:
                    if len(members) > 1:
                        yield links()
                    open_key, members = key, []
                members += part.tolist()
        if len(members) > 1:
            yield links()

    return run


def near_links(fps: DataFrame, radius: int = 2, shard_cap: int = 4096, levels: int = 4) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` exactly as all links within ``radius`` do."""
    members, found, paths = fps.select("fp"), None, {0: (1 << 64) - 1}
    paths = {0: ((1 << 64) - 1, 0)}  # free bits, bits agreed on
    members = members.withColumn("path", F.lit(0))
    for level in range(levels):
        deeper, keys = {}, []
        for path, (free, agreed) in paths.items():
            for k, mask in enumerate(_masks(free, radius + 1)):
                deeper[path * (radius + 1) + k + 1] = (free & ~mask, agreed | mask)
            own = [p for p in deeper if (p - 1) // (radius + 1) == path]
            keys.append((path, F.array(*[F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(deeper[p][1]))).alias("value")) for p in own])))
        pick = F.coalesce(*[F.when(F.col("path") == p, a) for p, a in keys])
        dealt = members.select("fp", F.explode(pick).alias("k")).select("fp", "k.path", "k.value").distinct()
        if level:
            dealt = cut(dealt)
        counts = dealt.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if level + 1 == levels:
            cool = counts
        else:
            counts = cut(counts)
            cool = counts.filter(F.col("n") <= shard_cap)
        shards = dealt.join(cool.select("path", "value"), ["path", "value"])
        links = shards.repartition("path", "value").sortWithinPartitions("path", "value", "fp").mapInPandas(_shard_links(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if level + 1 == levels or (hot := counts.filter(F.col("n") > shard_cap)).isEmpty():
            break
        members, paths = dealt.join(hot.select("path", "value"), ["path", "value"]).select("fp", "path"), deeper
    return found


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, seed: int = 42, shard_cap: int = 4096) -> DataFrame:
    """(id, ``fp`` long, ``component_id``) for every row of ``docs``.

    Rows link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable. Texts without words have
    fingerprint zero and link like any other. Repeated rows repeat in the result;
    null ids take part, but a component's id is null only if all its ids are. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(near_links(distinct, radius, shard_cap))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only linked fingerprints need the shuffle by root; most are alone.
    linked = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(linked, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(of, rows["fp"] == of["_fp"]).select(id_col, "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, nulls last.

    The verdict belongs to a row's id and text together; of rows that repeat both one stays.
    """
    keyed = docs.select(whole_row(docs), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.md5(clean_text(text_col)).alias("_md5"))
    # Equal texts have equal fingerprints: any row number may name a text.
    texts = cut(keyed.groupBy("_md5").agg(F.min("_text").alias("_text")).select("_md5", "_text", F.monotonically_increasing_id().alias("_n")))
    of = simhash_components(texts, "_n", "_text", **options).select("_n", "component_id").join(texts.select("_n", F.col("_md5").alias("_of")), "_n")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_md5").alias("md5")))
    kept = keyed.select("_id", "_md5").distinct().join(of, F.col("_md5") == F.col("_of")).groupBy("component_id").agg(first.alias("k"))
    kept = kept.select(F.col("k.id").alias("_kept_id"), F.col("k.md5").alias("_kept_md5"))
    rows = keyed.join(kept, keyed["_id"].eqNullSafe(kept["_kept_id"]) & (keyed["_md5"] == kept["_kept_md5"]), "left_semi")
    return rows.dropDuplicates(["_id", "_md5"]).select("_row.*")
