"""Documents for retrieval: chunks, sections, exact cosine top-k, guards, prompts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import contains_any

#: Words of questions that aren't answered, and the least score of an answer.
OFF_LIMITS = (
    "salary", "ctc", "compensation", "pay", "package", "expected salary", "notice period", "joining date", "availability",
    "when can you join", "interviewing with", "interview status", "which companies", "offer", "why did you leave",
    "reason for leaving", "opinion on", "thoughts on", "what do you think of", "future plans",
)
LOW_CONFIDENCE = 0.20

#: Where a text is cut, the best first; '' cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")
#: Characters of documents whose chunks are handed on together.
_CHUNK_CHARS = 1 << 20
_HEADING = re.compile(r"^#{1,2} .+", re.M)


def split_text(text: str, size: int = 500, overlap: int = 50, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, trimmed.

    The text is cut at the first separator it holds, which stays with the part behind it; parts that are too long are cut at the next
    ones. Neighbouring parts are joined while they fit, and a piece begins with up to ``overlap`` characters of whole parts of the one before.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[level], separators[level + 1 :]
    raw = list(text) if sep == "" else text.split(sep)
    parts = raw if sep == "" else [p for p in [raw[0], *[sep + p for p in raw[1:]]] if p]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        if len(part) > size and finer:
            out.append("".join(held))
            held, length = [], 0
            out += split_text(part, size, overlap, finer)
            continue
        if held and length + len(part) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    out.append("".join(held))
    return [x for x in (p.strip() for p in out) if x]


def sections_at(text: str, pieces: Sequence[str]) -> list[str]:
    """For each piece the last heading of level 1 or 2 before its first place in the text, else 'Introduction'.

    Pieces follow each other in the text, so headings and places are found in one walk; a piece that was met before has its first place.
    """
    starts, names = [0], ["Introduction"]
    for m in _HEADING.finditer(text):
        starts.append(m.end())
        names.append(m[0].lstrip("#").strip())
    first: dict[str, int] = {}
    out, at = [], 0
    for piece in pieces:
        if piece not in first:
            at = max(text.find(piece, at), at)
            first[piece] = at
        out.append(names[bisect_right(starts, first[piece]) - 1])
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: int = 500, overlap: int = 50) -> DataFrame:
    """[R2, R3] (id, source, chunk_index, chunk_id, text, section) of each chunk; the section is that of the chunk's first place in the text."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [("_id", batch.schema.field("_id").type), ("source", pa.string()), ("chunk_index", pa.int32()), ("chunk_id", pa.string()), ("text", pa.string()), ("section", pa.string())]
            out, held = [], 0
            for at in range(0, batch.num_rows, 16):  # a batch may hold texts of hundreds of megabytes: few are Python's at a time
                few = batch.slice(at, 16)
                for doc, source, text in zip(*[few.column(c).to_pylist() for c in ("_id", "_source", "_text")]):
                    pieces = split_text(text or "", size, overlap)
                    for i, (piece, section) in enumerate(zip(pieces, sections_at(text or "", pieces))):
                        out.append((doc, source, i, f"{source}_{doc}_chunk_{i}", piece, section))
                    held += len(text or "")
                    if held >= _CHUNK_CHARS:
                        yield _batch(out, kinds)
                        out, held = [], 0
            yield _batch(out, kinds)

    return rows.mapInArrow(run, f"_id {kind}, source string, chunk_index int, chunk_id string, text string, section string").withColumnRenamed("_id", id_col)


def _batch(out: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in out], k) for i, (_, k) in enumerate(kinds)], names=[c for c, _ in kinds])


def dot(a: str | Column, b: str | Column) -> Column:
    """The inner product of two arrays of numbers, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _units(df: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, the ids and the matrix of unit vectors; vectors that are not finite are left out."""
    out = {}
    for length, of in df.groupby(df["_v"].map(len)):
        x, ids = np.stack(of["_v"].tolist()), of["_i"].to_numpy()
        finite = np.isfinite(x).all(axis=1)
        x, ids = x[finite], ids[finite]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[length] = ids, x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return out


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["q", "score", "i"], ascending=[True, False, True]).groupby("q").head(k)


def _scan(batches: Iterator[pd.DataFrame], asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, step: int = 1024) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """The best ``k`` rows of a partition for each query: (ids of the queries, frame of ``q``, ``i`` and ``score``) for each length.

    A product has ``step`` times ``step`` scores at a time; only those that reach the query's worst kept score so far are looked at. Ties are
    judged on scores that do not depend on the shape of a product.
    """
    held = {length: pd.DataFrame({"q": np.empty(0, "int64"), "i": pd.Series(dtype=object), "score": np.empty(0)}) for length in asked}
    floor = {length: np.full(len(ids), -np.inf) for length, (ids, _) in asked.items()}
    for pdf in batches:
        for length, (ids, x) in _units(pdf).items():
            if length not in asked:
                continue
            near, low = asked[length][1], floor[length]
            for top in range(0, len(x), step):
                part, found = x[top : top + step], [held[length]]
                for at in range(0, len(near), step):
                    scores = near[at : at + step] @ part.T
                    least = low[at : at + step]
                    if len(part) > k:
                        least = np.maximum(least, np.partition(scores, len(part) - k, axis=1)[:, len(part) - k])
                    q, row = np.nonzero(scores >= least[:, None] - 1e-12)
                    if len(q):
                        exact = np.einsum("ij,ij->i", near[at + q], part[row])
                        found.append(_best(pd.DataFrame({"q": at + q, "i": ids[top + row], "score": exact}), k))
                if len(found) > 1:
                    held[length] = kept = _best(pd.concat(found[not len(found[0]) :]), k)
                    worst = kept.groupby("q")["score"].agg(["min", "size"])
                    worst = worst[worst["size"] == k]
                    low[worst.index.to_numpy()] = worst["min"].to_numpy()
    yield from ((asked[length][0], kept) for length, kept in held.items())


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query_id", round_bytes: int = 64 << 20) -> DataFrame:
    """[R4] (query, rank, id, score): each query's ``k`` most similar vectors, exactly; ties to the smaller id.

    The vectors stay where they are. Queries come to them as a broadcast of about ``round_bytes`` (measured first), in as many rounds as that
    takes; of several rounds, each is cut by a checkpoint and its broadcast given up. A task hands on its best ``k`` a query. Vectors that
    are null, zero or hold a null or non-finite number have no score; only those of equal length are compared. Ids of queries are keys.
    """
    spark, kinds = vectors.sparkSession, {**dict(queries.dtypes), **dict(vectors.dtypes)}

    def sound(df: DataFrame, name: str) -> DataFrame:
        held = df.select(F.col(name).alias("_i"), F.col(vector_col).cast("array<double>").alias("_v"))
        return held.filter(F.forall("_v", lambda x: x.isNotNull()) & F.exists("_v", lambda x: x != 0))

    def meeting(shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids, kept in _scan(batches, shared.value, k):
                yield pd.DataFrame({query_col: ids[kept["q"]], id_col: kept["i"].to_numpy(), "score": kept["score"].to_numpy()})

        return meet

    rows, asked = sound(vectors, id_col), sound(queries, query_col)
    order = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    n_rounds = max(1, -(-(asked.agg(F.sum(F.size("_v") * 8)).head()[0] or 0) // round_bytes))
    rounds = []
    for number in range(n_rounds):
        mine = asked.filter(F.pmod(F.xxhash64("_i"), F.lit(n_rounds)) == number) if n_rounds > 1 else asked
        shared = spark.sparkContext.broadcast(_units(mine.toArrow().to_pandas()))

        scored = rows.mapInPandas(meeting(shared), f"`{query_col}` {kinds[query_col]}, `{id_col}` {kinds[id_col]}, score double")
        ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if n_rounds > 1:
            ranked = ranked.checkpoint()
            shared.unpersist()
        rounds.append(ranked)
    return reduce(DataFrame.unionByName, rounds)


def low_confidence(scored: DataFrame, queries: DataFrame, query_col: str = "query_id", threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """[R5] (query, best_score, low_confidence): no hit, or none that reaches the threshold."""
    best = scored.groupBy(query_col).agg(F.max("score").alias("best_score"))
    return queries.select(query_col).distinct().join(best, query_col, "left").withColumn("low_confidence", F.coalesce(F.col("best_score") < threshold, F.lit(True)))


def guarded(df: DataFrame, column: str, words: Sequence[str] = OFF_LIMITS, name: str = "off_limits") -> DataFrame:
    """[R6] Whether a text holds one of the words."""
    return df.withColumn(name, contains_any(column, words))


def history(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", last: int = 5) -> DataFrame:
    """[R7] (conversation, context, n_messages): the last messages of each, in order, with their roles."""
    order = Window.partitionBy(conversation).orderBy(F.desc(turn), "role", "text")
    kept = messages.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= last)
    role = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(role, F.lit(": "), F.coalesce("text", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), (-F.col("_n")).alias("n"), line.alias("line"))))
    grouped = kept.groupBy(conversation).agg(listed.alias("m"))
    return grouped.select(conversation, F.concat_ws("\n", F.transform("m", lambda x: x["line"])).alias("context"), F.size("m").alias("n_messages"))


#: The headings and the last sentence of a prompt.
PROMPT_HISTORY, PROMPT_CONTEXT, PROMPT_QUESTION = "CONVERSATION HISTORY:", "RETRIEVED CONTEXT:", "QUESTION: "
PROMPT_END = "Answer using only the context above."


def prompts(questions: DataFrame, hits: DataFrame, contexts: DataFrame, key: str, instructions: str = "") -> DataFrame:
    """[R7] (key, prompt): instructions, history, chunks with source and section in order of rank, question."""
    line = F.concat(F.lit("[Source: "), "source", F.lit(" | Section: "), "section", F.lit("]\n"), "text", F.lit("\n\n"))
    found = hits.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "").alias("found"))
    joined = questions.join(contexts, key, "left").join(found, key, "left")
    prompt = F.concat(
        F.lit(f"{instructions}\n\n{PROMPT_HISTORY}\n"), F.coalesce(F.concat("context", F.lit("\n")), F.lit("")),
        F.lit(f"\n{PROMPT_CONTEXT}\n"), F.coalesce("found", F.lit("")), F.lit(PROMPT_QUESTION), F.col("question"), F.lit(f"\n\n{PROMPT_END}"),
    )
    return joined.select(key, prompt.alias("prompt"))


def route(off_limits: Column, low: Column) -> Column:
    """[R8] Off limits goes first, then low confidence."""
    return F.when(off_limits, "off_limits").when(low, "low_confidence").otherwise("answerable")
