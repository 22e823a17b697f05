"""Vector codes: product quantisation in whole numbers by active-entry Lloyd rounds.

Vectors are cut into equal parts; each part position has a codebook of its own. A row keeps, for each part, its entry and the
exact squared distance to it. After an update only some entries have moved: a part whose own entry stayed compares the moved
entries with its stored distance, the others look through the whole codebook. Both give the nearest entry, the one with the
lower index of equally near ones.

A round reads the rows once, writes their new state to the checkpoint folder and adds up sums and counts by task;
only codebooks and their sums, whose size is fixed, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_back, id_text, own_columns

#: Components are held to this size, so that all sums and distances are exact in 64 bits.
BOUND = 1 << 27


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return np.einsum("...i,...i->...", d, d)


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray, near: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and exact distances of the rows of ``x`` (int64) after the entries ``moved`` (bool) of ``book`` have moved.

    ``code`` and ``near`` are those before the move; -1 as a code stands for none yet.
    """
    code, near = code.copy(), near.copy()
    stale = (code < 0) | moved[code]
    if stale.any():
        all_of = np.stack([_squares(x[stale], entry) for entry in book], 1)
        code[stale] = all_of.argmin(1)  # the first of the least
        near[stale] = all_of[np.arange(len(all_of)), code[stale]]
    kept = np.flatnonzero(~stale)
    if len(kept):
        mine, best, at = x[kept], near[kept], code[kept]
        for j in np.flatnonzero(moved).tolist():
            d = _squares(mine, book[j])
            better = (d < best) | ((d == best) & (j < at))
            best, at = np.where(better, d, best), np.where(better, j, at)
        code[kept], near[kept] = at, best
    return code, near


_STATE = "_id string, _label string, x binary, codes binary, near binary"


def _matrix(column: pd.Series, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), kind).reshape(len(column), n)


def _assign(rows: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The rows with the state after ``moved`` entries of ``books`` (parts, entries, width) have moved."""
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast((books, moved))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, moved = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["x"], "<i4", parts * width).astype(np.int64)
            codes, near = _matrix(pdf["codes"], "i1", parts).astype(np.int64), _matrix(pdf["near"], "<i8", parts).copy()
            for p in range(parts):
                codes[:, p], near[:, p] = reassign(x[:, p * width : (p + 1) * width], books[p], codes[:, p], near[:, p], moved[p])
            yield pdf.assign(codes=[r.tobytes() for r in codes.astype("u1")], near=[r.tobytes() for r in near.astype("<i8")])

    return rows.mapInPandas(run, _STATE)


def _sums(rows: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the parts of each entry, and their counts. A task hands on one row for each number of the codebooks."""
    parts, entries, width = shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for pdf in batches:
            x, codes = _matrix(pdf["x"], "<i4", parts * width).astype(np.int64), _matrix(pdf["codes"], "u1", parts)
            for p in range(parts):
                np.add.at(total[p, :, width], codes[:, p], 1)
                np.add.at(total[p, :, :width], codes[:, p], x[:, p * width : (p + 1) * width])
        used = np.flatnonzero(total)
        yield pd.DataFrame({"place": used, "total": total.reshape(-1)[used]})

    out = np.zeros(parts * entries * (width + 1), np.int64)
    for r in rows.select("x", "codes").mapInPandas(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    out = out.reshape(parts, entries, width + 1)
    return out[..., :width], out[..., width]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``) of every row that takes part.

    Rows whose vector is null or holds null or non-finite components take no part, nor do vectors whose length is
    not that of the row with the smallest id. Components become floor(``scale`` x), held to 2^27 in size. Codebooks start
    from the parts of the ``entries`` (127 at most) smallest ids (null last, equal ids by their vectors; fewer rows: fewer entries).
    Repeated rows count each. Labels are compared as text, nulls are one label. No row at all gives an empty result; a length that ``parts`` doesn't divide is an error.
    """
    x = F.col("_x")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    clipped = lambda v: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), v * scale))
    whole = F.transform(x, lambda v: F.floor(clipped(v)).cast("int"))
    own = own_columns(vectors, [id_col, vector_col, label_col])
    rows = own.select(F.col(id_col), F.col(label_col).cast("string").alias("_label"), F.col(vector_col).cast("array<double>").alias("_x"))
    rows = rows.filter(F.coalesce(sound, F.lit(False))).withColumn("_x", whole)
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), "_x").limit(entries).select("_x").collect()
    kinds = F.lit(None).cast(vectors.schema[id_col].dataType).alias(id_col)
    if not first:
        return vectors.sparkSession.range(0).select(kinds, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    n = len(first[0]["_x"])
    if n % parts:
        raise ValueError(f"{n} components can't be cut into {parts} equal parts")
    start = np.array([r["_x"] for r in first if len(r["_x"]) == n], np.int64)
    books = start.reshape(len(start), parts, n // parts).transpose(1, 0, 2).copy()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = [np.asarray(v, "<i4").tobytes() for v in pdf["_x"]]
            yield pd.DataFrame({"_id": pdf["_id"], "_label": pdf["_label"], "x": whole, "codes": b"\xff" * parts, "near": bytes(8 * parts)})

    state = rows.filter(F.size("_x") == n).select(id_text(id_col), "_label", "_x").mapInPandas(pack, _STATE)
    moved = np.ones(books.shape[:2], bool)
    for _ in range(rounds):
        state = cut(_assign(state, books, moved))
        sums, counts = _sums(state, books.shape)
        fresh = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        moved = (fresh != books).any(2)
        books = fresh
        if not moved.any():  # further rounds would change nothing
            break
    state = cut(_assign(state, books, moved)) if moved.any() else state
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = _matrix(pdf["near"], "<i8", parts)
            yield pd.DataFrame({"_id": pdf["_id"], "_label": pdf["_label"], "code": [c.hex() for c in pdf["codes"]], "error": near.sum(1)})

    errors = state.mapInPandas(close, "_id string, _label string, code string, error long")
    by_label = errors.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of")
    out = errors.join(by_label, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(id_back(vectors, id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in SQL, round by round, every part against every entry of its position."""
    near = lambda r: f"""
    a{r} AS MATERIALIZED (SELECT v, p, arg_min(e, (d, e)) AS e, min(d) AS d
        FROM (SELECT x.v, x.p, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{r} b ON b.p = x.p) GROUP BY 1, 2)"""  # noqa: E731
    steps = []
    for r in range(rounds):
        steps.append(near(r))
        steps.append(f"""
    s{r} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT a.p, a.e, i, floor_div(sum(x.c[i])::HUGEINT, count(*)) AS m FROM a{r} a JOIN x ON x.v = a.v AND x.p = a.p, range(1, len(x.c) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{r} b LEFT JOIN s{r} s ON s.p = b.p AND s.e = b.e)""")
    steps.append(near(rounds))
    floor_div = "CASE WHEN {0} % {1} < 0 THEN {0} // {1} - 1 ELSE {0} // {1} END"
    sql = f"""
    WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS v, vec_id, label, list_transform(embedding, lambda y: floor(CAST(y AS DOUBLE) * {scale})::BIGINT) AS c FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    x AS MATERIALIZED (SELECT v, p, c[p * (len(c) // {parts}) + 1 : (p + 1) * (len(c) // {parts})] AS c FROM k, range(0, {parts}) t(p)),
    b0 AS MATERIALIZED (SELECT p, v - 1 AS e, c FROM x WHERE v <= {entries}), {','.join(steps)},
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
    o AS (SELECT v, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (v), h
    """
    return sql.replace("floor_div(sum(x.c[i])::HUGEINT, count(*))", floor_div.format("sum(x.c[i])", "count(*)"))
