"""Language identification with string kernels.

Blended spectrum: two texts are compared by the character n-grams, n from 1 to
``MAX_N``, that both contain (presence, not counts), over the cosine of the
presence vectors. Landmarks give Nyström features, a ridge regression
for each language against the rest is solved on them, and documents are
scored in batches by two matrix products. N-grams are told apart by 64 bits of hash; as only those of the landmarks can be shared with
one, a document is a row over the landmarks' n-grams and the number of its own.

The model is fitted on a bounded sample: ``per_lang`` labelled rows of each
language (those with the smallest hash of the id), the first ``landmarks`` of them, shared among the languages, being landmarks. The landmarks' n-grams and a
bit for each of them and row are all that comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_back, id_text

MAX_N = 3
#: Texts are read in pieces of so many characters, with an overlap; all of a text is read.
PIECE = 1 << 19


@cache
def _letters() -> np.ndarray:
    """For each code point of the basic plane, its lower-case letter, or a space."""
    out = np.full(1 << 16, 32, np.uint64)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def grams(text: str | None) -> np.ndarray | None:
    """The hashes of the n-grams in the text, in order, each once; None if it has no letter."""
    if not text:
        return None
    seen, found = [], False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[max(0, at - MAX_N + 1) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = _letters()[np.minimum(codes, 0xFFFF)]
        far = np.flatnonzero(codes > 0xFFFF)
        if len(far):
            plain[far] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in codes[far].tolist()]
        inner = plain != 32
        found |= bool(inner.any())
        keep = inner.copy()
        keep[1:] |= inner[:-1]  # one space after each word
        plain = plain[keep]
        gram = plain * np.uint64(0x9E3779B97F4A7C15)
        here = [gram]
        for n in range(1, MAX_N):
            gram = (gram[:-1] ^ (gram[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + plain[n:] * np.uint64(0x9E3779B97F4A7C15)
            here.append(gram)
        seen.append(np.unique(np.concatenate(here)))
    if not found:
        return None
    return seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))


def _places(vocabulary: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where in the sorted ``vocabulary`` the hashes ``found`` are; those that aren't are left out."""
    at = np.searchsorted(vocabulary, found)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == found]


@dataclass
class KernelModel:
    languages: list[str]
    vocabulary: np.ndarray  # the landmarks' n-grams, sorted
    landmarks: np.ndarray  # vocabulary x m, float32, columns of unit length
    weights: np.ndarray  # m x languages: Nyström map times ridge solution

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        """``texts``: the n-grams of each document."""
        out = [np.empty((0, self.weights.shape[1]))]
        step = max(1, (1 << 24) // len(self.vocabulary))
        for at in range(0, len(texts), step):
            part = texts[at : at + step]
            seen = np.zeros((len(part), len(self.vocabulary)), np.float32)
            for row, found in zip(seen, part):
                row[_places(self.vocabulary, found)] = 1
            kernel = (seen @ self.landmarks) / np.sqrt([[len(found)] for found in part])
            out.append(kernel.astype(np.float64) @ self.weights)
        return np.concatenate(out)


def landmark_matrix(marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary, vocabulary x landmarks): the presence vectors of the landmarks, of unit length."""
    vocabulary = np.unique(np.concatenate(marks))
    land = np.zeros((len(vocabulary), len(marks)), np.float32)
    for k, found in enumerate(marks):
        land[np.searchsorted(vocabulary, found), k] = len(found) ** -0.5
    return vocabulary, land


def fit(vocabulary: np.ndarray, land: np.ndarray, bits: list[bytes], sizes: list[int], langs: list[str], ridge: float = 0.1) -> KernelModel:
    """Kernel ridge regression, one language against the rest, on Nyström features.

    ``bits``: each training row's presence over the vocabulary, packed, ``sizes`` the numbers of its n-grams. Rows are unpacked a block at a time.
    """
    names = sorted(set(langs))
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    values, vectors = np.linalg.eigh((land.T @ land).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))

    def kernel(at: int) -> np.ndarray:
        part = np.frombuffer(b"".join(bits[at : at + 64]), np.uint8).reshape(-1, len(bits[0]))
        seen = np.unpackbits(part, axis=1, count=len(vocabulary)).astype(np.float32)
        return (seen @ land).astype(np.float64) / np.sqrt(np.array(sizes[at : at + 64], float))[:, None]

    phi = np.concatenate([kernel(at) for at in range(0, len(bits), 64)]) @ root
    n_of = np.maximum((y > 0).sum(axis=0), 1)
    row = 1.0 / n_of[np.argmax(y, axis=1)]  # languages weigh alike
    row *= len(row) / row.sum()
    solved = np.linalg.solve((phi * row[:, None]).T @ phi + ridge * np.eye(phi.shape[1]), (phi * row[:, None]).T @ y)
    return KernelModel(names, vocabulary, land, root @ solved)


def predict(texts: list[str | None], model: KernelModel | None) -> tuple[list[str], np.ndarray]:
    """Languages and scores; ``und`` and 0 for texts without a letter, or without a model."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if model is None:
        return langs, scores
    for at in range(0, len(texts), 128):
        got = [(at + i, g) for i, t in enumerate(texts[at : at + 128]) if (g := grams(t)) is not None]
        if got:
            margins = model.margins([g for _, g in got])
            top = margins.argmax(axis=1)
            odds = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
            for (i, _), k, o in zip(got, top, odds):
                langs[i], scores[i] = model.languages[k], o[k] / o.sum()
    return langs, scores


def training_rows(docs: DataFrame, train: Column, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """(lang, n, text) of at most ``per_lang`` ids of each language, numbered by their hash; one text of each id."""
    ids = docs.filter(F.col(lang_col).isNotNull() & train).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit(5), id_col).alias("_hash")).distinct()
    # No task gets a whole language: only the first of 4,096 ranges of the hash, those that hold its first ``per_lang`` ids, are sorted.
    ids = ids.withColumn("_range", F.shiftright("_hash", 52))
    along = Window.partitionBy("lang").orderBy("_range")
    counts = ids.groupBy("lang", "_range").agg(F.count(F.lit(1)).alias("_count"))
    first = counts.withColumn("_before", F.sum("_count").over(along) - F.col("_count")).filter(F.col("_before") < per_lang).select("lang", "_range")
    in_order = Window.partitionBy("lang").orderBy("_hash", "_id")
    ids = ids.join(first, ["lang", "_range"]).withColumn("n", F.row_number().over(in_order)).filter(F.col("n") <= per_lang).select("_id", "lang", "n")
    texts = docs.select(F.col(id_col).alias("_text_id"), F.col(text_col).alias("_text"))
    # The chosen ids number per_lang for each language: a fixed bound.
    met = texts.join(F.broadcast(ids), F.col("_text_id") == F.col("_id"))
    return met.groupBy("_id", "lang", "n").agg(F.min("_text").alias("_text")).select("lang", "n", "_text")


def learn(sample: DataFrame, landmarks: int, ridge: float) -> KernelModel | None:
    """A model from (lang, n, _text); None without any letter."""

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(lang, n, g.tobytes()) for lang, n, t in zip(pdf["lang"], pdf["n"], pdf["_text"]) if (g := grams(t)) is not None]
            yield pd.DataFrame(got, columns=["lang", "n", "grams"])

    names = sample.select("lang").distinct().count()
    each = max(1, landmarks // max(names, 1))
    marks = sorted(sample.filter(F.col("n") <= each).mapInPandas(full, "lang string, n int, grams binary").collect(), key=lambda r: (r["lang"], r["n"]))
    if not marks:
        return None
    vocabulary, land = landmark_matrix([np.frombuffer(r["grams"], np.uint64) for r in marks])
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = shared.value
        for pdf in batches:
            out = []
            for lang, n, text in zip(pdf["lang"], pdf["n"], pdf["_text"]):
                if (g := grams(text)) is not None:
                    seen = np.zeros(len(vocabulary), bool)
                    seen[_places(vocabulary, g)] = True
                    out.append((lang, n, len(g), np.packbits(seen).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "n", "size", "bits"])

    rows = sorted(sample.mapInPandas(pack, "lang string, n int, size long, bits binary").collect(), key=lambda r: (r["lang"], r["n"]))
    return fit(vocabulary, land, [bytes(r["bits"]) for r in rows], [r["size"] for r in rows], [r["lang"] for r in rows], ridge)


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None, per_lang: int = 400, landmarks: int = 128, ridge: float = 0.1) -> DataFrame:
    """(id, ``lang_pred``, ``score`` 0 to 1) for every row of ``docs``.

    Learned from rows with a language where ``train`` (a condition on the id;
    all by default) holds. A null text, or one without a letter, is ``und`` with score 0, and so is
    every text if there is nothing to learn from. Ties go to the first language
    in code point order; repeated rows score alike; an empty table gives no rows.
    """
    sample = training_rows(docs, train if train is not None else F.lit(True), id_col, text_col, lang_col, per_lang)
    model = learn(cut(sample), landmarks, ridge)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            langs, scores = predict(pdf["_text"].tolist(), shared.value)
            yield pd.DataFrame({"_id": pdf["_id"], "lang_pred": langs, "score": scores})

    texts = docs.select(id_text(id_col), F.col(text_col).alias("_text"))
    return texts.mapInPandas(run, "_id string, lang_pred string, score double").select(id_back(docs, id_col), "lang_pred", "score")


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
