"""Target-distribution importance resampling: hashed features, array-scored weights, distributed quickselect.

1. Every text is cut into features (runs of words), each in one of ``buckets`` hash buckets. A task adds up its
   buckets in one array, so a pass over a corpus shuffles one row a task and bucket at most.
2. The gain of a bucket is its log ratio between target and corpus, a whole number. The gains are one array of
   ``buckets`` numbers, which scores every text in a second pass.
3. Scores are weights plus Gumbel noise from a hash of the id. Their k-th largest is found by quickselect: random
   keys of the rows still in question are pivots, an exact three-way count of each of them narrows the range, until
   the k-th composite key (score, id, row) is a pivot itself.
4. The winners alone are sorted, by ranges, and ranked from the sizes of the ranges.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_back, id_text

#: On UTF-8 bytes, of which A-Z have been lowered: digits, a-z and all that is not ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Keys that a round of the quickselect draws as pivots, about.
PIVOTS = 32


class _Buckets(dict):
    """The bucket of each feature met; cleared when it is large, which changes no result."""

    def __init__(self, buckets: int, most: int = 1_000_000) -> None:
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def _slices(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that cut no word."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def _features(text: str | None, width: int, known: _Buckets) -> Iterator[tuple[np.ndarray, int]]:
    """The buckets of the features of ``text`` and the number of its words, slice by slice."""
    carried: list[bytes] = []
    for part in _slices((text or "").encode().lower()):
        fresh = _WORD.findall(part)
        words = carried + fresh
        runs = list(fresh)
        for k in range(2, width + 1):
            runs += [b" ".join(words[i - k : i]) for i in range(max(k, len(carried) + 1), len(words) + 1)]
        yield np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)), len(fresh)
        carried = words[len(words) - width + 1 :] if width > 1 else []


def bucket_counts(texts: DataFrame, text_col: str = "text", width: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all ``texts`` lie in each bucket: ``buckets`` numbers, added up by task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for pdf in batches:
            waiting: list[np.ndarray] = []
            for text in pdf["_text"]:
                for found, _ in _features(text, width, known):
                    waiting.append(found)
                    if len(waiting) >= 500:
                        total += np.bincount(np.concatenate(waiting), minlength=buckets)
                        waiting.clear()
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=buckets)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    parts = texts.select(F.col(f"`{text_col}`").alias("_text")).mapInPandas(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+m) / ((s+1)(T+m)))) of each of the m buckets."""
    m, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", width: int = 1) -> DataFrame:
    """(id, ``n_words``, ``n_features``, ``weight``) of every row: the floored mean of its features' gains, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains = shared.value
        known = _Buckets(len(gains))
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["_id"].tolist(), pdf["_text"].tolist()):
                words = n = total = 0
                for found, fresh in _features(text, width, known):
                    words, n, total = words + fresh, n + len(found), total + int(gains[found].sum())
                out.append((doc, words, n, total // n if n else 0))
            yield pd.DataFrame(out, columns=["_id", "n_words", "n_features", "weight"])

    rows = docs.select(id_text(id_col), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInPandas(run, "_id string, n_words long, n_features long, weight long").select(id_back(docs, id_col), "n_words", "n_features", "weight")


def gumbel(id_col: str, seed: int) -> Column:
    """floor(1000 g), g standard Gumbel noise from the first 32 bits of the SHA-256 of ``seed:id``; a null id is the text null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(rows: DataFrame, key: Column, unique: Column, k: int, pivots: int = PIVOTS, seed: int = 0) -> tuple | None:
    """The k-th smallest ``key`` (a struct without repeats, k from 1) of ``rows``, by quickselect; None if there is none.

    A round reads ``rows`` twice: once for about ``pivots`` random keys of the range in question (a hash of ``unique`` draws them), once
    to count the keys below, at and between them; both bring a number of rows to the driver that doesn't grow. The range
    shrinks to about 2 / ``pivots`` of itself. ``rows`` should be cut.
    """
    keyed = rows.select(key.alias("key"), unique.alias("unique"))
    kind = keyed.schema["key"].dataType
    lit = lambda p: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kind.fields, p)])
    low = high = None
    before, active = 0, rows.count()
    if not 1 <= k <= active:
        return None
    for turn in range(10_000):
        inside = keyed
        if low is not None:
            inside = inside.filter(F.col("key") > lit(low))
        if high is not None:
            inside = inside.filter(F.col("key") < lit(high))
        share = 1.0 if active <= 2 * pivots else pivots / active
        drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "unique"), F.lit(1 << 53)) < int(share * (1 << 53))
        chosen = inside.filter(drawn).select("key").orderBy("key").limit(64 * pivots).collect()
        if not chosen:
            continue
        keys = [tuple(r["key"]) for r in chosen][:: -(-len(chosen) // (2 * pivots))]
        side = F.lit(0)
        for p in keys:
            side = side + F.when(F.col("key") > lit(p), 2).when(F.col("key") == lit(p), 1).otherwise(0)
        counts = dict(inside.groupBy(side.alias("side")).count().collect())  # 2 pivots + 1 rows at most
        for i in range(2 * len(keys) + 1):
            if before + counts.get(i, 0) >= k:
                break
            before += counts.get(i, 0)
        if i % 2:
            return keys[i // 2]
        low, high = keys[i // 2 - 1] if i else low, keys[i // 2] if i < 2 * len(keys) else high
        active = counts[i]
    raise RuntimeError("the keys are not unique")


def ranked_by(rows: DataFrame, key: Column, rank: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``key``: sorted by ranges, the ranges' sizes added up; no window holds them all."""
    placed = cut(rows.orderBy(key).withColumn("_at", F.monotonically_increasing_id()))
    range_of = F.shiftright("_at", 33)
    begin, starts = 0, []
    for r in placed.groupBy(range_of.alias("range")).count().orderBy("range").collect():  # one row a range
        starts.append((r["range"], begin))
        begin += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "_range long, _begin long")
    numbered = placed.join(F.broadcast(offsets), range_of == F.col("_range"))
    return numbered.withColumn(rank, F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_range", "_begin")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", width: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every row of ``docs`` with (id, ``n_features``, ``weight``, ``score``, ``rank``), all long but the id.

    Of the N rows with at least ``min_words`` words floor(N ``percent`` / 100) with the highest scores are drawn, ties to the smaller id (null last); ``rank``
    is their place from 1, null for the others. A null or empty text has no features and weight 0. Rows that share an id are
    separate rows with the same noise; which of equal ones is drawn first is left open. Empty tables give no rows; an empty ``target`` is uniform.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, width, buckets), bucket_counts(target, target_text_col, width, buckets))
    scored = weigh(docs, gains, id_col, text_col, width).withColumn("score", F.col("weight") + gumbel(id_col, seed))
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()))
    key = F.struct((-F.col("score")).alias("a"), F.col(id_col).isNull().alias("b"), F.col(id_col).alias("c"), F.col("_row").alias("d"))
    able = scored.filter(F.col("n_words") >= min_words)
    last = kth_key(able, key, F.col("_row"), able.count() * percent // 100, seed=seed)
    columns = [id_col, "n_features", "weight", "score"]
    nothing = scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    if last is None:
        return nothing
    kinds = scored.select(key.alias("key")).schema["key"].dataType.fields
    bound = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kinds, last)])
    drawn = (F.col("n_words") >= min_words) & (key <= bound)
    winners = ranked_by(scored.filter(drawn), key).select(*columns, "rank")
    return winners.unionByName(scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
