"""Best-fit packing by a configuration linear program over the length histogram.

1. Documents are tokenised whole, in batches, and cut into pieces of at most
   ``capacity`` tokens; only longer documents are cut.
2. The histogram of piece lengths, ``capacity`` numbers at most, comes to the driver.
3. Configuration LP: cover each length's count with as few configurations
   (multisets of lengths that fit) as possible. Multiplicative weights hold a
   price for each length, which falls as the length is covered and rises where it can't be; a knapsack
   dynamic program over the prices gives the configurations that get amounts, and a lower bound.
4. The fractional solution is rounded: whole parts, then one more at each whole number of the running
   sum of the rest, nothing covered twice. What is left goes best-fit into the free room and new sequences. That is done for
   several shares of the solution, and the plan with the fewest sequences counts.
5. Pieces are numbered within their length (salted by the length's count) and look their place up in the plan's runs.
   The plan's size depends on ``capacity`` and the LP's rounds, not on the number of pieces.
"""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_back, id_text

CAPACITY = 2048
#: Pieces of one length that a task numbers.
SALT_ROWS = 100_000
Config = tuple[int, ...]  # lengths, the largest first


#: Words of these letters are one word to the tokenizer too.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _stem(word: str) -> tuple[str, str]:
    """``word`` without its last punctuation, and that punctuation: tokens part there. Letters of A-Z fall to a-z, as the tokenizer's do."""
    if "<|" in word:  # may hold a special token
        return word, ""
    if word.isascii():
        word = word.lower()
    stem = word.rstrip(_PUNCTUATION)
    return (stem, word[len(stem) :]) if stem and stem[-1] < "\u0100" and stem[-1].isalnum() else (word, "")


class WordTokenizer:
    """A lower-casing tokenizer whose tokens never reach over a blank, nor from a letter or digit to
    punctuation after it: words are encoded once and remembered.

    ``cache_words`` bounds the memory: beyond it the words become the old generation, from which those met
    again come back. The result doesn't depend on it.
    """

    def __init__(self, path: str, cache_words: int = 900_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        self.known, self.old = {"": b""}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.cache_words:
            self.known, self.old = {"": b""}, self.known
        known, old = self.known, self.old
        # Words are looked up once; only where some were unknown the gaps are filled below.
        found = [list(map(known.get, words)) for words in split]
        met = {w for words, ids in zip(split, found) if None in ids for w, x in zip(words, ids) if x is None}
        known.update((w, old[w]) for w in met if w in old)
        new = {w: _stem(w) for w in met if w not in old}
        parts = {p for pair in new.values() for p in pair if p not in known}
        plain = [p for p in parts if _PLAIN.fullmatch(p)]
        for at in range(0, len(plain), 1000):  # one token sequence a word: many words are encoded as one text
            part = plain[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                known.update((word, raw[a:b]) for word, a, b in zip(part, [0, *ends], ends))
        other = [p for p in parts if p not in known]
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            for word, one in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[word] = np.array(one.ids, "<u4").tobytes()
        for word, (stem, tail) in new.items():
            known[word] = known[stem] + known[tail]
        return [b"".join([known[w] if x is None else x for w, x in zip(words, ids)] if None in ids else ids) for words, ids in zip(split, found)]


@cache
def shared_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a Python worker."""
    return WordTokenizer(path)


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, ``piece`` from 0, ``start``, ``length``, ``ids`` binary): the pieces of every row of ``docs``.

    A document's ids end with ``end_id``; a null or empty text is that one id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, end = shared_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                out = []
                part = pdf["_id"].iloc[at : at + 256]
                texts = [t or "" for t in pdf["_text"].iloc[at : at + 256]]
                for doc, ids in zip(part.tolist(), tokenizer.encode(texts)):
                    ids += end
                    out += [(doc, k, k * capacity, len(x) // 4, x) for k, b in enumerate(range(0, len(ids), 4 * capacity)) if (x := ids[b : b + 4 * capacity])]
                frame = pd.DataFrame(out, columns=["_id", "piece", "start", "length", "ids"])
                yield frame

    rows = docs.select(id_text(id_col), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "_id string, piece int, start long, length long, ids binary").select(id_back(docs, id_col), "piece", "start", "length", "ids")


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room, the best total price and the index of a length to take (-1: none). ``lengths`` fall."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    first = np.searchsorted(-lengths, -np.arange(capacity + 1))  # of the lengths that fit
    for room in range(int(lengths[-1]) if len(lengths) else capacity + 1, capacity + 1):
        k = first[room]
        values = best[room - lengths[k:]] + prices[k:]
        i = int(values.argmax())
        if values[i] > 0:
            best[room], take[room] = values[i], k + i
    return best, take


@dataclass
class Cover:
    """A fractional solution of the configuration LP: every length is covered at least by its count."""

    amounts: dict[Config, float]
    bound: float  # a lower bound on the number of sequences, from the prices

    @property
    def value(self) -> float:
        return sum(self.amounts.values())

    @property
    def gap(self) -> float:
        return self.value / self.bound - 1 if self.bound else 0.0


def solve_lp(counts: np.ndarray, capacity: int, rounds: int = 6, rate: float = 0.3, near: float = 0.3, step: float = 0.02, batches: int = 240) -> Cover:
    """Covers ``counts`` (by length, from 0) with fractional amounts of configurations, by multiplicative weights.

    A length's price is its volume times a weight. An oracle call solves the knapsack at the present prices: its optimum
    divides the prices' total value to a lower bound (the scaled prices are a solution of the dual), and every configuration
    within ``near`` of the best that is left may be used: the best with each length. It gets what brings that length to the round's goal, t of
    ``rounds`` parts of its count, but no length gets over its count. The weight of a length falls exponentially with its cover, at ``rate``;
    one that no such configuration holds gains ``step``. What is not covered after ``batches`` calls is covered by configurations of one length.
    """
    lengths = np.flatnonzero(counts)[::-1]
    if not len(lengths):
        return Cover({}, 0.0)
    need = counts[lengths].astype(float)
    gained, covered, bound = np.zeros(len(lengths)), np.zeros(len(lengths)), 0.0
    amounts: dict[Config, float] = defaultdict(float)
    t = 1
    for k in range(batches):
        prices = lengths / capacity * np.exp(gained - rate * (covered / need - t / rounds))
        if k % 8 == 0:
            bound = max(bound, float(need @ prices) / float(_knapsack(lengths, prices, capacity)[0][capacity]))
        goal = need * t / rounds
        best, take = _knapsack(lengths, np.where(covered < need * (1 - 1e-9), prices, 0), capacity)
        worth = prices + best[capacity - lengths]
        behind = covered < goal * (1 - 1e-9)
        useful = behind & (worth >= (1 - near) * worth[behind].max(initial=0))
        for i in np.flatnonzero(useful).tolist():
            items, room = [i], capacity - int(lengths[i])
            while take[room] >= 0:
                items.append(int(take[room]))
                room -= int(lengths[items[-1]])
            many = Counter(items)
            x = min((goal[i] - covered[i]) / many[i], min((need[j] - covered[j]) / c for j, c in many.items()))
            if x > 1e-9 * need[i]:
                for j, c in many.items():
                    covered[j] += c * x
                amounts[tuple(int(lengths[j]) for j in sorted(items))] += x
        gained[behind & ~useful] += step
        behind = covered < goal * (1 - 1e-9)
        if not behind.any():
            t += 1
            if t > rounds:
                break
    for i in np.flatnonzero(covered < need * (1 - 1e-9)).tolist():
        copies = capacity // int(lengths[i])
        amounts[(int(lengths[i]),) * copies] += (need[i] - covered[i]) / copies
    return Cover(dict(amounts), bound)


def round_cover(cover: Cover, counts: np.ndarray, capacity: int, share: float = 1.0, slack: int | None = None) -> tuple[dict[Config, int], np.ndarray]:
    """Whole configurations for ``share`` of the cover's amounts, and the counts that they leave; nothing is covered twice.

    Each gets the whole part of its amount and, along the running sum of the rest, one more wherever that passes a whole number. Configurations with more than
    ``slack`` free tokens are left out.
    """
    left, plan, running = counts.copy(), {}, 0.0
    for config in sorted(cover.amounts, reverse=True):
        if slack is not None and capacity - sum(config) > slack:
            continue
        amount = cover.amounts[config] * share
        extra = int(running + amount % 1 + 1e-9) - int(running + 1e-9)
        running += amount % 1
        many = Counter(config)
        n = min(int(amount) + extra, min(int(left[x] // c) for x, c in many.items()))
        if n > 0:
            plan[config] = n
            for x, c in many.items():
                left[x] -= n * c
    return plan, left


def best_fit(left: np.ndarray, plan: dict[Config, int], capacity: int) -> dict[Config, int]:
    """``plan`` with the pieces ``left`` too, the longest first, each into the least free room that holds it; equal configurations at a time."""
    left = left.copy()
    free: dict[int, dict[Config, int]] = defaultdict(dict)
    for config, k in plan.items():
        free[capacity - sum(config)][config] = k
    has = np.zeros(capacity + 1, bool)
    has[list(free)] = True
    for length in np.flatnonzero(left)[::-1].tolist():
        while left[length]:
            at = int(has[length:].argmax()) + length
            if has[at] and at < capacity:
                config, k = next(iter(free[at].items()))
            else:
                at, config, k = capacity, (), int(left[length])
            copies = min(at // length, int(left[length]))
            n = min(k, int(left[length]) // copies)
            if config:
                free[at][config] -= n
                if not free[at][config]:
                    del free[at][config]
                    has[at] = bool(free[at])
            grown = tuple(sorted(config + (length,) * copies, reverse=True))
            room = at - copies * length
            free[room][grown] = free[room].get(grown, 0) + n
            has[room] = True
            left[length] -= n * copies
    return {config: k for room in free.values() for config, k in room.items() if config and k}


#: Shares of the LP's cover that are rounded, and the free tokens that its configurations may have there.
SHARES, SLACKS = (1.0, 0.98, 0.9, 0.75, 0.5, 0.25), (None, 8, 0)


def make_plan(counts: np.ndarray, capacity: int) -> dict[Config, int]:
    """Configurations and how often each is used, for ``counts`` pieces of each length.

    Rounding strands the cover's last pieces in lengths that fit each other badly. So the cover is rounded at several shares: what a smaller one
    leaves has pieces of all lengths, which are fitted best. The plan with the fewest sequences counts, the largest share of equal ones.
    """
    left = counts.astype(np.int64).copy()
    whole = {(capacity,): int(left[capacity])} if left[capacity] else {}
    left[capacity] = 0
    cover = solve_lp(left, capacity)
    best: dict[Config, int] | None = None
    for share in SHARES:
        for slack in SLACKS:
            plan, rest = round_cover(cover, left, capacity, share, slack)
            plan = best_fit(rest, plan, capacity)
            if best is None or sum(plan.values()) < sum(best.values()):
                best = plan
    return {**whole, **best}


def _runs(plan: dict[Config, int], capacity: int) -> dict[str, np.ndarray]:
    """The plan by length: from which number of a length on, which sequence and offset."""
    rows, base, met = [], 0, defaultdict(int)
    for config in sorted(plan, reverse=True):
        offset = 0
        for length in config:
            rows.append((length, met[length], base, offset))
            met[length] += plan[config]
            offset += length
        base += plan[config]
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    return {"first": first, "rank": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def place(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", salt_rows: int = SALT_ROWS) -> DataFrame:
    """``pieces`` (id, ``piece``, ``length`` from 1 to ``capacity``, further columns) with ``sequence_id`` and ``offset``.

    Every piece is placed once; the pieces of a sequence follow each other without
    gaps from offset 0. Repeated rows are separate pieces. An empty table gives no rows.
    A length has as many salts as its count needs, so that a task numbers ``salt_rows`` pieces of it at most, whatever their ids.
    ``pieces`` is read three times: hand it over cut.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # capacity rows at most
        counts[r["length"]] = r["count"]
    runs = _runs(make_plan(counts, capacity), capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(runs)
    # A salt holds a small part of a task's even share, or ``salt_rows`` on large tables.
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_salt = int(np.clip(counts.sum() // (4 * tasks), 16, salt_rows))
    n_salts = F.get(F.array(*[F.lit(int(n)) for n in np.maximum(1, -(-counts // per_salt))]), F.col("length").cast("int"))
    place_in_file = F.monotonically_increasing_id()  # fixed, as the pieces are
    salted = pieces.withColumn("_row", place_in_file).withColumn("_salt", F.pmod(F.xxhash64(F.lit(1), id_col, "piece", "_row"), n_salts))
    key = ["length", "_salt"]
    along = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = salted.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(*key, (F.sum("_n").over(along) - F.col("_n")).alias("_begin"))
    numbered = salted.withColumn("_number", F.row_number().over(Window.partitionBy(key).orderBy(id_col, "piece", "_row")) - 1).join(begin, key)
    kept = list(pieces.columns)
    numbered = numbered.select(*[F.col(f"`{c}`").cast("string") if c == id_col else F.col(f"`{c}`") for c in kept], (F.col("_begin") + F.col("_number")).alias("_rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = shared.value
        for pdf in batches:
            lengths, rank = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            at = np.empty(len(pdf), np.int64)
            for length in np.unique(lengths).tolist():
                mine = lengths == length
                a, b = runs["first"][length], runs["first"][length + 1]
                at[mine] = a + np.searchsorted(runs["rank"][a:b], rank[mine], side="right") - 1
            yield pdf[kept].assign(sequence_id=runs["base"][at] + rank - runs["rank"][at], offset=runs["offset"][at])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"`{name}` {'string' if name == id_col else kind}" for name, kind in kinds.items())
    out = numbered.mapInPandas(run, f"{schema}, sequence_id long, offset long")
    return out.withColumn(id_col, F.col(id_col).cast(kinds[id_col]))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Every piece of ``docs`` with its ids and its place."""
    return place(cut(tokenize(docs, tokenizer_path, id_col, text_col, capacity, end_id)), capacity, id_col)


def pack_digests(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Like :func:`pack`, with ``ids_crc32`` in place of the ids: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = tokenize(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    return place(cut(pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), capacity, id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(``sequence_id``, ``ids`` binary, ``n_pieces``) of pieces with ids and places; a sequence holds ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", whole.alias("ids"), F.size("parts").alias("n_pieces"))
