"""Approximate nearest neighbours: a forest of random-projection trees.

1. Equal vectors become one class; only a class's k + 1 smallest ids can
   ever be answers, so a vector that a third of all rows share costs no more than another.
2. The trees are fitted on a bounded sample: at every node the projection with the largest
   spread of a few random ones, split at its median. Every class is then put in one leaf of each tree.
   Going to a child costs the negative logarithm of the chance that a near row lies there, a logistic function of the margin.
3. A query walks all trees through one priority queue, cheapest node first, until the leaves taken hold ``reach`` of all rows
   in the mean of the trees. A row that several trees offer early is the likelier neighbour: it collects
   what each of its leaves cost less than the last one taken.
4. Rows lie in blocks, the upper nodes of the first tree, and meet there the queries that can't rule the block out.
   Rows that have collected enough are the candidates; their exact distances give the answer.
5. How steep the logistic is, which blocks are ruled out and how much is enough is measured: true neighbours of
   ``probes`` rows are found by brute force over all rows, and ``target`` of them must pass.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass
class Tree:
    """A complete binary tree; node i has children 2 i + 1 and 2 i + 2."""

    depth: int
    normals: np.ndarray  # (2^depth - 1) x dim
    offsets: np.ndarray
    spreads: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", x, self.normals[node]) > self.offsets[node]
            node = 2 * node + 1 + side
        return node - ((1 << self.depth) - 1)

    def steps(self, x: np.ndarray, steep: float) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` and each node, what going to the left and to the right child costs."""
        z = ((x @ self.normals.T - self.offsets) * (steep / self.spreads)).astype(np.float32)
        left = np.logaddexp(np.float32(0), z)
        return left, np.maximum(left - z, 0)

    def costs(self, x: np.ndarray, steep: float) -> np.ndarray:
        """For each row of ``x``, the cost of every leaf: the sum over its path."""
        left, right = self.steps(x, steep)
        total = np.zeros((len(x), 1), np.float32)
        for level in range(self.depth):
            at = slice((1 << level) - 1, (2 << level) - 1)
            total = np.stack([total + left[:, at], total + right[:, at]], axis=2).reshape(len(x), -1)
        return total


    def path_margins(self, x: np.ndarray, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The margins, in spreads, at each node of the paths to the leaves ``codes``; positive where the path leaves the side of its row ``x[of]``."""
        z, found = (x @ self.normals.T - self.offsets) / self.spreads, []
        node = codes + (1 << self.depth) - 1
        for _ in range(self.depth):
            right = node % 2 == 0
            node = (node - 1) // 2
            found.append(np.where(right, -z[of, node], z[of, node]))
        return np.concatenate(found) if found else np.empty(0)


def fit_tree(sample: np.ndarray, depth: int, rng: np.random.Generator, tries: int = 6) -> Tree:
    dim, inner = sample.shape[1], (1 << depth) - 1
    tree = Tree(depth, np.zeros((inner, dim)), np.zeros(inner), np.ones(inner))
    parts = {0: sample}
    for node in range(inner):
        here = parts.pop(node)
        options = rng.standard_normal((tries, dim))
        options /= np.linalg.norm(options, axis=1, keepdims=True)
        shadow = here @ options.T
        best = int(shadow.var(axis=0).argmax()) if len(here) else 0
        tree.normals[node] = options[best]
        tree.offsets[node] = np.median(shadow[:, best]) if len(here) else 0.0
        tree.spreads[node] = max(float(shadow[:, best].std()), 1e-9) if len(here) else 1.0
        side = shadow[:, best] > tree.offsets[node]
        parts[2 * node + 1], parts[2 * node + 2] = here[~side], here[side]
    return tree


def last_cost(steps: list[tuple[list[float], list[float]]], depth: int, sizes: list[list[int]], budget: float) -> float:
    """The cost of the last leaf taken from one queue over all trees, once those taken hold ``budget`` rows."""
    inner, rows, cost = (1 << depth) - 1, 0, 0.0
    queue = [(0.0, k, 0) for k in range(len(steps))]
    while queue and rows < budget:
        cost, k, node = heapq.heappop(queue)
        if node >= inner:
            rows += sizes[k][node - inner]
            continue
        left, right = steps[k]
        heapq.heappush(queue, (cost + left[node], k, 2 * node + 1))
        heapq.heappush(queue, (cost + right[node], k, 2 * node + 2))
    return cost


def nearest_of(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, exact distances) of the ``k`` nearest rows, ties to smaller ids."""
    exact = np.sqrt(((rows - query) ** 2).sum(axis=1))
    if len(exact) > 4 * k:
        near = np.flatnonzero(exact <= np.partition(exact, k - 1)[k - 1])
        ids, exact = ids[near], exact[near]
    order = np.lexsort((ids, exact))[:k]
    return ids[order], exact[order]


def nearest_in_block(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of a query, ids, exact distances) of each query's k nearest of all rows, ties to smaller ids."""
    norms = np.einsum("ij,ij->i", rows, rows)
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        rough = norms - 2 * (block @ rows.T) + np.einsum("ij,ij->i", block, block)[:, None]
        n = min(k, len(rows))
        edge = np.partition(rough, n - 1, axis=1)[:, n - 1]
        slack = 1e-9 * (np.abs(edge) + norms.max() + 1)
        for i in range(len(block)):
            near = np.flatnonzero(rough[i] <= edge[i] + slack[i])  # rounding and ties included
            yield at + i, *nearest_of(block[i], rows[near], ids[near], k)


@dataclass
class Search:
    """A fitted forest and what was measured on it. Its size depends on the sample, not on the number of rows."""

    trees: list[Tree]
    sizes: np.ndarray  # rows of each tree's leaves
    block_depth: int  # a block is a node of the first tree at this depth
    reach: float
    steep: float = 1.0
    enough: float = 0.0  # what a candidate has collected at least
    block_cost: float = np.inf  # blocks that cost more are ruled out

    def blocks(self, codes: np.ndarray) -> np.ndarray:
        """The blocks of leaves of the first tree."""
        return codes >> (self.trees[0].depth - self.block_depth)

    def last_costs(self, x: np.ndarray) -> np.ndarray:
        steps = [t.steps(x, self.steep) for t in self.trees]
        budget = self.reach * len(self.trees) * self.sizes[0].sum()
        sizes, depth = self.sizes.tolist(), self.trees[0].depth
        return np.array([last_cost([(a[i].tolist(), b[i].tolist()) for a, b in steps], depth, sizes, budget) for i in range(len(x))])

    def block_costs(self, x: np.ndarray) -> np.ndarray:
        first, inner = self.trees[0], (1 << self.block_depth) - 1
        return Tree(self.block_depth, first.normals[:inner], first.offsets[:inner], first.spreads[:inner]).costs(x, self.steep)

    def collected(self, x: np.ndarray, last: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Rows x queries: what each row, given by its leaves, collects for each query."""
        total = np.zeros((len(codes), len(x)), np.float32)
        for k, tree in enumerate(self.trees):
            saved = np.maximum(last[:, None] - tree.costs(x, self.steep), 0).astype(np.float32)
            total += np.ascontiguousarray(saved.T)[codes[:, k]]
        return total

    def calibrate(self, probes: np.ndarray, of: np.ndarray, codes: np.ndarray, target: float) -> None:
        """``codes``: leaves of true neighbours; ``of``: whose. Sets the steepness by likelihood, then the two limits."""
        if not len(of) or target >= 1:
            return
        paths = np.concatenate([t.path_margins(probes, of, codes[:, k]) for k, t in enumerate(self.trees)])
        self.steep = float(min(np.geomspace(0.1, 12.8, 22), key=lambda steep: np.logaddexp(0, steep * paths).sum()))
        last = self.last_costs(probes)
        paid = self.block_costs(probes)[of, self.blocks(codes[:, 0])]
        missed = (1 - target) / 4
        self.block_cost = float(np.quantile(paid, 1 - missed)) + 1e-5
        saved = sum(np.maximum(last[of] - t.costs(probes, self.steep)[of, codes[:, k]], 0) for k, t in enumerate(self.trees))
        self.enough = float(np.quantile(saved, 3 * missed)) - 1e-4


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>): vectors of the commonest length, finite, not zero, with an id."""
    v = F.col(vector_col).cast("array<double>")
    big = F.lit(float("inf"))
    sound = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    return rows.filter(F.size("v") == (usual["dim"] if usual else 0))


def _true_neighbours(placed: DataFrame, probes: np.ndarray, probe_ids: np.ndarray, k: int) -> pd.DataFrame:
    """(``of``, ``codes``): the leaves of each probe's ``k`` nearest rows, by brute force over all rows."""
    shared = placed.sparkSession.sparkContext.broadcast((probes, probe_ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probes, probe_ids = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf["class"].to_numpy()
            at = pd.Series(np.arange(len(ids)), index=ids)
            for i, found, exact in nearest_in_block(probes, np.stack(pdf["v"]), ids, k + 1):
                keep = found != probe_ids[i]
                yield pd.DataFrame({"of": i, "class": found[keep], "score": exact[keep], "codes": pdf["codes"].iloc[at[found[keep]]].tolist()})

    near = placed.mapInPandas(run, "of int, class long, score double, codes array<int>")
    order = Window.partitionBy("of").orderBy("score", "class")
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("of", "codes").toPandas()


def nearest(table: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = 24, leaf_rows: int = 8, sample_rows: int = 4096, probes: int = 128, target: float = 0.95, reach: float = 0.2, block_rows: int = 20_000, query_rows: int = 50_000, seed: int = 3, counts: bool = False) -> DataFrame:
    """(``query_id``, ``rank`` from 1, id, ``score``): each query's ``k`` nearest rows found, its own left out.

    ``is_query`` is a condition on the id. Nearness is Euclidean distance in double
    precision, ties to the smaller id. Vectors that are null, zero, of another length than
    most, or hold null or non-finite components take no part, nor do null ids. Equal vectors under several ids
    are several rows; rows that repeat an id with the same vector count once. Fewer candidates than ``k``: all.
    The forest is fitted on ``sample_rows`` rows and measured with ``probes`` more, both bounds; all rows are indexed. ``target`` is
    the share of the probes' neighbours that must be candidates: it sets the work, which is small on clustered vectors and large on
    isotropic ones; from 1 on every row is a candidate and the answer exact. A block holds about ``block_rows`` rows; a task meets ``query_rows`` queries at a time.
    ``counts`` adds ``n_candidates``: rows whose exact distance to the query was computed.
    """
    rows = cut(valid_vectors(table, id_col, vector_col).distinct())
    smallest = Window.partitionBy("v").orderBy("id")
    few = cut(
        rows.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
        .withColumn("class", F.min("id").over(Window.partitionBy("v")))
    )
    classes = few.filter("n = 1").select("class", "v")
    total = classes.count()
    sample = classes.orderBy(F.xxhash64(F.lit(seed), "class"), "class").limit(sample_rows + probes).collect()
    points = np.array([r["v"] for r in sample], float) if sample else np.empty((0, 1))
    tested, fitted = points[-probes:], points[:-probes] if len(points) >= 2 * probes else points
    depth = int(np.floor(np.log2(max(len(fitted) / leaf_rows, 1))))
    forest = [fit_tree(fitted, depth, np.random.default_rng([seed, t])) for t in range(trees)]
    context = table.sparkSession.sparkContext
    fitted_forest = context.broadcast(forest)  # trees x sample_rows / leaf_rows x dim numbers at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"])
                codes = np.stack([t.leaves(x) for t in fitted_forest.value], axis=1).astype(np.int32)
                yield pd.DataFrame({"class": pdf["class"], "v": pdf["v"], "codes": list(codes)})

    placed = cut(classes.mapInPandas(place, "class long, v array<double>, codes array<int>"))
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in placed.select(F.posexplode("codes").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():  # trees x 2^depth rows at most
        sizes[r["tree"], r["leaf"]] = r["count"]
    search = Search(forest, sizes, min(depth, int(np.ceil(np.log2(max(total / block_rows, 1))))), reach)
    truth = _true_neighbours(placed, tested, np.array([r["class"] for r in sample[-probes:]]), k)
    search.calibrate(tested, truth["of"].to_numpy(), np.array(truth["codes"].tolist(), np.int64).reshape(-1, trees), target)
    in_block = sizes[0].reshape(1 << search.block_depth, -1).sum(axis=1)
    chunks = np.maximum(1, -(-in_block // block_rows))
    plan = context.broadcast((search, in_block, chunks))

    asked = rows.filter(is_query).select(F.col("id").alias("query_id"), "v")
    asked = cut(asked.join(classes, "v").select("query_id", "class", "v"))
    # A query is little data but some work, and so is a block: small tables too are spread over all tasks.
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = asked.groupBy("class").agg(F.first("v").alias("v")).repartition(tasks)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, in_block, chunks = plan.value
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                x = np.stack(part["v"])
                costs, out = search.block_costs(x), []
                for q, v, cost, last in zip(part["class"], part["v"], costs, search.last_costs(x)):
                    order = np.argsort(cost, kind="stable")
                    held = np.cumsum(in_block[order]) - in_block[order]  # before this block
                    for b in order[(cost[order] <= search.block_cost) | (held <= k)].tolist():
                        out += [(q, v, last, b, c) for c in range(chunks[b])]
                yield pd.DataFrame(out, columns=["query", "v", "last", "block", "chunk"])

    shift = depth - search.block_depth
    block = F.shiftright(F.col("codes")[0], shift)
    n_chunks = F.array(*[F.lit(int(c)) for c in chunks])[F.col("block")] if chunks.max() > 1 else F.lit(1)
    here = placed.withColumn("block", block).withColumn("chunk", F.pmod(F.xxhash64("class"), n_chunks).cast("int"))
    walked = cut(first.mapInPandas(walk, "query long, v array<double>, last double, block int, chunk int"))
    parts = walked.groupBy("block", "chunk").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("parts"))
    here = here.join(parts, ["block", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    walked = walked.join(parts, ["block", "chunk"]).withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    key = ["block", "chunk", "part"]

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        search = plan.value[0]
        out = [pd.DataFrame({"query": [], "class": [], "score": [], "n_candidates": []})]
        if len(queries) and len(rows):
            x, r, codes, ids = np.stack(queries["v"]), np.stack(rows["v"]), np.stack(rows["codes"]), rows["class"].to_numpy()
            names, last = queries["query"].to_numpy(), queries["last"].to_numpy()
            for at in range(0, len(x), 64):
                collected = np.ascontiguousarray(search.collected(x[at : at + 64], last[at : at + 64], codes).T)
                for i, mine in enumerate(collected, at):
                    near = np.flatnonzero(mine >= search.enough)
                    if len(near) <= k:  # never fewer than k + 1 of a block
                        near = np.argsort(-mine, kind="stable")[: k + 1]
                    found, exact = nearest_of(x[i], r[near], ids[near], k + 1)
                    out.append(pd.DataFrame({"query": names[i], "class": found, "score": exact, "n_candidates": len(near)}))
        return pd.concat(out[1:] or out)

    walked, here = walked.drop("parts").repartition(tasks, *key), here.select(*key, "class", "v", "codes").repartition(tasks, *key)
    met = walked.groupBy(key).cogroup(here.groupBy(key)).applyInPandas(meet, "query long, class long, score double, n_candidates long")
    best = Window.partitionBy("query").orderBy("score", "class")
    met = met.withColumn("n", F.row_number().over(best))
    if counts:
        met = cut(met)
        looked = met.select("query", "n_candidates").distinct().groupBy("query").agg(F.sum("n_candidates").alias("n_candidates"))
    top = met.filter(F.col("n") <= k + 1).select("query", "class", "score")
    reached = top.join(few.select("class", F.col("id").alias("found")), "class")
    # k + 1 of them are enough for any query of the class, whichever its own id is.
    by_query = Window.partitionBy("query").orderBy("score", "found")
    reached = reached.withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= k + 1).drop("class", "n")
    answers = asked.select("query_id", "class").join(reached, F.col("class") == F.col("query")).filter("query_id <> found")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "found"))).filter(F.col("rank") <= k)
    columns = ["query_id", "rank", F.col("found").alias(id_col), "score"]
    return ranked.join(looked, "query").select(*columns, "n_candidates") if counts else ranked.select(*columns)
