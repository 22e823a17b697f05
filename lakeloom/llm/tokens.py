"""Token counts of a sentencepiece model: pieces are counted once for each distinct pre-token, documents add them up.

No piece of the vocabulary reaches over certain borders: those between two characters that stand side by side in no
piece. A text parts there into pre-tokens whose numbers of pieces add up.

1. A pass over the texts gives the distinct pre-tokens with the number of documents that hold them.
2. The pieces of each distinct pre-token are counted once.
3. The most frequent pre-tokens, up to ``head_bytes`` of them (measured), are a dictionary for all tasks: a second pass
   joins the documents' pre-token frequencies to it. What is not in it is rare, so it joins by a shuffle without hot keys.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_back, id_text

_SPACE = "▁"  # how the model writes a blank
#: Longer pre-tokens are parted at every border of the vocabulary.
_LONG = 48


class PieceCounter:
    """Parts texts into pre-tokens and counts their pieces. The model must leave texts as they are (identity normalisation, blanks kept)."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("the model changes texts before it cuts them")
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
        self.pairs = {pair for p in pieces for pair in zip(p, p[1:])}
        if any(b == _SPACE and a != _SPACE for a, b in self.pairs):
            raise ValueError("pieces of the model reach over blanks")
        paired = {c for pair in self.pairs for c in pair}
        alone = [c for c in map(chr, range(128)) if c not in paired and c != " "]
        if not alone:
            raise ValueError("the model has no character that is always a piece of its own")
        one = f"[{re.escape(''.join(alone))}]"
        self.cut = re.compile(f"[ {_SPACE}]*[^ {_SPACE}{one[1:-1]}]+|[ {_SPACE}]+|{one}")
        self.guard = "\n" if "\n" in alone else alone[0]  # parts a pre-token from the blank that the model puts first
        self.guard_pieces = len(model.encode(self.guard))

    def part(self, token: str) -> list[str]:
        """A pre-token cut at every border of the vocabulary."""
        plain = token.replace(" ", _SPACE)
        at = [0, *[i for i in range(1, len(plain)) if (plain[i - 1], plain[i]) not in self.pairs], len(plain)]
        return [token[a:b] for a, b in zip(at, at[1:])]

    def frequencies(self, text: str | None) -> Counter:
        """How often each pre-token stands in ``text``, with the blank that the model puts first."""
        if not text:
            return Counter()
        text = " " + text
        found = Counter(self.cut.findall(text)) if len(text) < 1 << 20 else Counter(m.group() for m in self.cut.finditer(text))
        for token in [t for t in found if len(t) > _LONG]:
            n = found.pop(token)
            for p in self.part(token):
                found[p] += n
        return found

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(ids) - self.guard_pieces for ids in self.model.encode([self.guard + t for t in tokens], num_threads=1)]


@cache
def shared_counter(path: str) -> PieceCounter:
    """One for all tasks of a Python worker."""
    return PieceCounter(path)


def pre_tokens(docs: DataFrame, model_path: str, text_col: str = "text", most: int = 600_000) -> DataFrame:
    """(``token``, ``n_docs``, ``n_pieces``), one row for each distinct pre-token of ``docs``.

    A task adds up to ``most`` tokens before it hands them on, so frequent ones reach the shuffle once a task, not once a document.
    """

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, seen = shared_counter(model_path), Counter()
        frame = lambda: pd.DataFrame({"token": pd.Series(list(seen), dtype=object), "n_docs": pd.Series(list(seen.values()), dtype="int64")})
        for pdf in batches:
            for text in pdf["_text"]:
                seen.update(counter.frequencies(text).keys())
                if len(seen) >= most:
                    yield frame()
                    seen.clear()
        yield frame()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = shared_counter(model_path)
        for pdf in batches:
            yield pdf.assign(n_pieces=counter.pieces(pdf["token"].tolist()))

    tokens = docs.select(F.col(f"`{text_col}`").alias("_text")).mapInPandas(met, "token string, n_docs long")
    return tokens.groupBy("token").agg(F.sum("n_docs").alias("n_docs")).mapInPandas(count, "token string, n_docs long, n_pieces long")


def _head(tokens: DataFrame, head_bytes: int) -> tuple[int, bool]:
    """From how many documents (a power of two) on tokens are in the head, whose texts have ``head_bytes`` at most; whether that is all of them."""
    level = F.floor(F.log2("n_docs")).cast("int")
    sizes = tokens.groupBy(level.alias("level")).agg(F.sum(F.octet_length("token") + 8).alias("bytes")).orderBy(F.desc("level")).collect()  # 64 rows at most
    held, least = 0, 62
    for r in sizes:
        held += r["bytes"]
        if held > head_bytes:
            return least, False
        least = r["level"]
    return 0, True


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, head_bytes: int = 4 << 20) -> DataFrame:
    """(id, ``n_bytes``, ``n_tokens``, ``over_limit``) of every row of ``docs``, as the model counts the whole text.

    A null or empty text has no token. Repeated rows and ids are separate rows; an empty table gives none. The result doesn't depend on ``head_bytes``.
    """
    tokens = cut(pre_tokens(docs, model_path, text_col))
    least, whole = _head(tokens, head_bytes)
    frequent = F.col("n_docs") >= (1 << least)
    head = tokens if whole else tokens.filter(frequent)
    known = {r["token"]: r["n_pieces"] for r in head.select("token", "n_pieces").collect()}  # of ``head_bytes`` at most, measured above
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, known = shared_counter(model_path), shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part, out = pdf.iloc[at : at + 256], []
                for text in part["_text"].tolist():
                    total, rare, often = 0, [], []
                    for token, n in counter.frequencies(text).items():
                        pieces = known.get(token)
                        if pieces is None:
                            rare.append(token)
                            often.append(n)
                        else:
                            total += n * pieces
                    out.append((total, rare, often))
                yield part.drop(columns="_text").assign(n_tokens=[x[0] for x in out], rare=[x[1] for x in out], often=[x[2] for x in out])

    rows = docs.select(id_text(id_col), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    counted = rows.mapInPandas(run, "_id string, n_bytes long, _row long, n_tokens long, rare array<string>, often array<long>")
    if not whole:
        counted = cut(counted)
        rare = counted.select("_row", F.explode(F.arrays_zip("rare", "often")).alias("r")).select("_row", F.col("r.rare").alias("token"), "r.often")
        joined = rare.join(tokens.filter(~frequent).select("token", "n_pieces"), "token")
        more = joined.groupBy("_row").agg(F.sum(F.col("often") * F.col("n_pieces")).alias("more"))
        counted = counted.join(more, "_row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return counted.select(id_back(docs, id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
