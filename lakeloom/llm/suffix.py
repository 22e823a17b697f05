"""Removal of repeated passages with suffix arrays built by induced sorting.

A byte is removed if a string of ``span`` bytes that covers it also starts earlier.

1. Each window of ``span`` bytes names an anchor: the first position with the least hash of ``GRAM`` bytes
   in it. Equal windows name equal anchors, and the windows of an anchor follow each
   other, so a document becomes a few (hash of the gram, hash of the bytes that its windows cover, place) rows, dealt by the gram.
   Grams that stand once drop out. No window is lost and none is sampled.
2. The segments, the bytes that the other anchors' windows cover, are dealt by gram. A gram with more than ``hot_rows`` rows
   is dealt by the longer strings that ``PART`` windows share. Hashes only say what meets: nothing is removed before its bytes
   are compared. Equal segments are represented by the first one, in a batch before the shuffle and in a shard after it.
3. In a shard, runs of ``PART`` windows whose common string no other segment of the gram has can't repeat and are left out. The rest is joined into
   one text, its suffixes are sorted by induced sorting, and permuted common prefixes are computed. Windows between which the
   common prefix stays at ``span`` or more are equal; all but the earliest are marked. A key of more than ``key_bytes`` (one line among ever different
   neighbours) is held by no task: its windows are dealt once more, each by its own bytes, sorted, and compared with the one before.
4. Marked windows are united to spans a document. The texts are shuffled once: both joins with them use the same exchange.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_text, cut, id_back, id_text

SPAN = 100
GRAM = 32
#: Windows of a segment that are dealt together if its gram is hot, and tried together for whether they can repeat.
PART = 9
#: Positions of a piece of text fit in so many bits; longer texts are read in overlapping pieces.
_BITS = 20
_MIX = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2^64."""
    n = 1 << _BITS
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes at each position."""
    h, width = _MIX[raw], 1
    while width < gram:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[width:]
        width *= 2
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def anchors(raw: bytes, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, segment's hash, anchor, first window, last window) of each anchor of a text, in order."""
    out = []
    step = (1 << _BITS) - 2 * span
    for at in range(0, max(len(raw) - span + 1, 0), step):
        piece = np.frombuffer(raw, np.uint8, min(step + span - 1, len(raw) - at), at)
        h = _gram_hashes(piece, gram)
        low = np.uint64((1 << _BITS) - 1)
        named = (_slide_min((h & ~low) | np.arange(len(h), dtype=np.uint64), span - gram + 1) & low).astype(np.int64)
        turn = np.flatnonzero(np.diff(named)) + 1
        first = np.concatenate([[0], turn])
        last = np.concatenate([turn, [len(named)]]) - 1
        p = named[first]
        up, down = _powers()
        summed = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_MIX[piece] * up[: len(piece)], out=summed[1:])
        segment = (summed[last + span] - summed[first]) * down[first]
        segment = (segment ^ (segment >> np.uint64(32)) ^ (last - first).astype(np.uint64)) * np.uint64(_BASE) + (p - first).astype(np.uint64)
        out.append((h[p].view(np.int64), segment.view(np.int64), p + at, first + at, last + at))
    if not out:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out))


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); ``t`` ends with a least sentinel."""
    n = len(t)
    less, differs = np.empty(n, bool), np.empty(n, bool)
    less[:-1], differs[:-1] = t[:-1] < t[1:], t[:-1] != t[1:]
    less[-1] = differs[-1] = True
    # A run of equal symbols has the type of its end.
    at = np.where(differs, np.arange(n), n)
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def _deal(found: np.ndarray, symbols: np.ndarray, lists: list[list[np.ndarray]], own: int) -> np.ndarray | None:
    """Append ``found`` to the lists of their symbols, in order; those of ``own`` are returned too."""
    if not len(found):
        return None
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    edges = np.flatnonzero(np.diff(symbols)) + 1
    mine = None
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(found)]):
        c = int(symbols[a])
        lists[c].append(found[a:b])
        if c == own:
            mine = found[a:b]
    return mine


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes induced from leftmost-smaller ones in the order ``seeds``."""
    seed_lists: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(seeds, t[seeds], seed_lists, -1)
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    for c in range(k):
        done = 0
        while done < len(larger[c]):  # chunks that this bucket puts in itself follow
            here = larger[c][done]
            done += 1
            before = here[here > 0] - 1
            before = before[~small[before]]
            _deal(before, t[before], larger, c)
        for here in seed_lists[c]:
            before = here[here > 0] - 1
            before = before[~small[before]]
            _deal(before, t[before], larger, c)
    smaller: list[list[np.ndarray]] = [[] for _ in range(k)]
    for c in range(k - 1, -1, -1):
        done = 0
        while done < len(smaller[c]):
            here = smaller[c][done]
            done += 1
            before = here[here > 0] - 1
            before = before[small[before]]
            _deal(before, t[before], smaller, c)
        for here in reversed(larger[c]):
            here = here[::-1]
            before = here[here > 0] - 1
            before = before[small[before]]
            _deal(before, t[before], smaller, c)
    parts: list[np.ndarray] = [np.array([len(t) - 1])]
    for c in range(k):
        parts += larger[c]
        parts += [x[::-1] for x in reversed(smaller[c])]
    return np.concatenate(parts)


def _sort_names(names: list[int]) -> list[int]:
    """The order of the suffixes of ``names`` (whole numbers from 0 on), by induced sorting with counted buckets; recursive and linear."""
    n = len(names)
    t = [x + 1 for x in names]
    t.append(0)
    small = bytearray(n + 1)
    small[n] = 1
    for i in range(n - 1, -1, -1):
        small[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and small[i + 1])
    counts = [0] * (max(t) + 1)
    for x in t:
        counts[x] += 1
    ends = list(accumulate(counts))
    lms = [i for i in range(1, n + 1) if small[i] and not small[i - 1]]

    def induce(seeds: list[int]) -> list[int]:
        order, at = [-1] * (n + 1), ends[:]
        for i in reversed(seeds):
            at[t[i]] -= 1
            order[at[t[i]]] = i
        at = [0, *ends[:-1]]
        for k in range(n + 1):
            i = order[k] - 1
            if i >= 0 and not small[i]:
                order[at[t[i]]] = i
                at[t[i]] += 1
        at = ends[:]
        for k in range(n, -1, -1):
            i = order[k] - 1
            if i >= 0 and small[i]:
                at[t[i]] -= 1
                order[at[t[i]]] = i
        return order

    following = dict(zip(lms, [*lms[1:], n]))
    named, name, last = {}, -1, None
    for i in induce(lms):
        if i in following:
            piece = t[i : following[i] + 1]
            if piece != last:
                name, last = name + 1, piece
            named[i] = name
    if name + 1 == len(lms):
        seeds = sorted(lms, key=named.get)
    else:
        seeds = [lms[k] for k in _sort_names([named[i] for i in lms])]
    return induce(seeds)[1:]


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ``raw`` (bytes).

    Suffixes are classed as smaller or larger than the next; the leftmost smaller ones (LMS) are sorted by their substrings,
    and, where substrings repeat, recursively as a text of their names; the rest is induced bucket by bucket, whole runs at a time.
    """
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64)
    t = np.empty(n + 1, np.int16)
    t[:n], t[n] = raw.astype(np.int16) + 1, 0
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = _induce(t, small, lms, 257)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    end = np.empty(n + 1, np.int64)
    end[lms] = np.append(lms[1:], n)
    a, b = ranked[:-1], ranked[1:]
    same = (end[a] - a) == (end[b] - b)
    live, k = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live], b[live]
        equal = t[np.minimum(x + k, n)] == t[np.minimum(y + k, n)]
        same[live[~equal]] = False
        live = live[equal & (k < end[x] - x)]
        k += 1
    same &= b != n
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 == len(lms):
        return _induce(t, small, ranked, 257)[1:]
    rank = np.empty(n + 1, np.int64)
    rank[ranked] = names
    return _induce(t, small, lms[np.array(_sort_names(rank[lms].tolist()))], 257)[1:]


def permuted_common_prefixes(raw: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each position in text order, the length in common with its predecessor in ``order``, up to ``limit``."""
    n = len(raw)
    phi = np.empty(n, np.int64)
    phi[order[1:]], phi[order[0]] = order[:-1], -1
    padded = np.concatenate([raw, np.zeros(limit + 16, np.uint8)]).astype(np.uint64)
    words = padded.copy()
    for width in (1, 2, 4):
        words = words[:-width] | (words[width:] << np.uint64(8 * width))
    common = np.zeros(n, np.int64)
    live = np.flatnonzero(phi >= 0)
    for k in range(0, limit, 8):
        differ = words[live + k] ^ words[phi[live] + k]
        odd = differ != 0
        low = differ[odd] & (~differ[odd] + np.uint64(1))
        common[live[odd]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[~odd]
    common[live] = limit
    room = n - np.maximum(np.arange(n), phi)  # nothing lies behind the end
    return np.minimum(np.minimum(common, room), limit)


def _repeats(segments: list[bytes], firsts: np.ndarray, docs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of the windows of ``segments`` that also start earlier, by (doc, first + window)."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.cumsum(sizes) - sizes
    order = suffix_array(raw)
    common = permuted_common_prefixes(raw, order, span)
    owner = np.repeat(np.arange(len(segments)), sizes)
    within = np.arange(len(raw)) - starts[owner]
    valid = within <= sizes[owner] - span
    group = np.cumsum(common[order] < span)
    mine = valid[order]
    order, group = order[mine], group[mine]
    seg = owner[order]
    window = within[order]
    by = np.lexsort((firsts[seg] + window, docs[seg], group))
    repeat = np.concatenate([[False], np.diff(group[by]) == 0]) if len(by) else np.empty(0, bool)
    return seg[by][repeat], window[by][repeat]


def _runs(at: int, size: int, span: int) -> Iterator[tuple[int, int, int]]:
    """(a, first, last) of each run of ``PART`` windows of a segment, from the anchor ``at`` outwards: all its windows hold the bytes from a + PART to a + span."""
    last = size - span
    for a in range(at - at // PART * PART - PART, last + 1, PART):
        lo, hi = max(0, a + 1), min(last, a + PART)
        if lo <= hi:
            yield a, lo, hi


def _may_repeat(keys: list[int], ats: list[int], segs: list[bytes], span: int) -> list[tuple[int, int, int]]:
    """(segment, first, last) of the runs of windows that share a string, at one place from the anchor, with another segment of their key."""
    owners: dict[tuple[int, int, bytes], list[tuple[int, int, int]]] = defaultdict(list)
    for i, (key, at, seg) in enumerate(zip(keys, ats, segs)):
        for a, lo, hi in _runs(at, len(seg), span):
            owners[key, at - a, seg[a + PART : a + 1 + span]].append((i, lo, hi))
    found = sorted(x for runs in owners.values() if len(runs) > 1 for x in runs)
    out: list[tuple[int, int, int]] = []
    for i, lo, hi in found:
        if out and out[-1][0] == i and out[-1][2] + 1 == lo:
            out[-1] = (i, out[-1][1], hi)
        else:
            out.append((i, lo, hi))
    return out


def _spread(rid: int) -> int:
    """A key for rows that need no other's: of two bytes, as keys without order don't compress."""
    return int(rid) & 0xFFFF


def _shard(span: int, shard_bytes: int, key_bytes: int):
    """Rows (key, rid, first, at, seg) sorted by key to spans: rows with a null ``seg`` that begin at ``first`` and have ``at`` bytes. Such rows pass.

    A key of more than ``key_bytes`` is not held: its segments are handed on window by window, each under a key of its own, for :func:`_equal_windows`.
    """

    def first_of_equal(rows: list[tuple], spans: list[tuple[int, int, int]]) -> list[tuple]:
        """Of ``rows`` (key, rid, first, at, seg) the earliest of each (key, at, seg); the others are marked whole."""
        seen: set[tuple[int, int, bytes]] = set()
        out = []
        for row in sorted(rows, key=lambda x: x[1:3]):
            key, rid, first, at, seg = row
            if (key, at, seg) in seen:
                spans.append((rid, first, first + len(seg)))
            else:
                seen.add((key, at, seg))
                out.append(row)
        return out

    def solve(rows: list[tuple]) -> pd.DataFrame:
        spans: list[tuple[int, int, int]] = []
        rows = first_of_equal(rows, spans)
        many = Counter(x[0] for x in rows)
        rows = [x for x in rows if many[x[0]] > 1]
        keys, ats, segs = [x[0] for x in rows], [x[3] for x in rows], [x[4] for x in rows]
        parts = [(keys[i], rows[i][1], rows[i][2] + lo, ats[i] - lo, segs[i][lo : hi + span]) for i, lo, hi in _may_repeat(keys, ats, segs, span)]
        parts = first_of_equal(parts, spans)
        if parts:
            docs, firsts = np.array([x[1] for x in parts]), np.array([x[2] for x in parts])
            seg, window = _repeats([x[4] for x in parts], firsts, docs, span)
            if len(seg):
                by = np.lexsort((window, seg))
                seg, window = seg[by], window[by]
                cuts = np.flatnonzero((np.diff(seg) != 0) | (np.diff(window) != 1)) + 1
                a, b = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(seg)]]) - 1
                whose = seg[a]
                spans += list(zip(docs[whose], firsts[whose] + window[a], firsts[whose] + window[b] + span))
        return frame([(_spread(rid), rid, a, b - a, None) for rid, a, b in spans])

    def windows(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(rows), 1000):
            yield frame([(_name(w), rid, first + i, 0, w) for _, rid, first, _, seg in rows[at : at + 1000] for i in range(len(seg) - span + 1) for w in [seg[i : i + span]]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        loose: list[tuple] = []
        open_key, size, begun, own, large = None, 0, 0, 0, False
        for pdf in batches:
            marks = pdf["seg"].isna()
            if marks.any():
                yield pdf[marks]
                pdf = pdf[~marks]
            for row in zip(pdf["key"].tolist(), pdf["rid"].tolist(), pdf["first"].tolist(), pdf["at"].tolist(), pdf["seg"]):
                if row[0] != open_key:
                    if size >= shard_bytes:
                        yield solve(held)
                        held, size = [], 0
                    open_key, begun, own, large = row[0], len(held), 0, False
                if large:
                    loose.append(row)
                    continue
                held.append(row)
                size += len(row[4])
                own += len(row[4])
                if own > key_bytes:
                    loose += held[begun:]
                    del held[begun:]
                    size, large = size - own, True
            if loose:
                yield from windows(loose)
                loose = []
        if held:
            yield solve(held)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "rid", "first", "at", "seg"]).astype({c: "int64" for c in ("key", "rid", "first", "at")})

    return run


def _equal_windows(span: int):
    """Rows sorted by (key, seg, rid, first): of windows with the same bytes all but the first become spans. Nothing is held but the window before; spans pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for pdf in batches:
            marks = pdf["seg"].isna()
            if marks.any():
                yield pdf[marks]
                pdf = pdf[~marks]
            out = []
            for rid, first, seg in zip(pdf["rid"].tolist(), pdf["first"].tolist(), pdf["seg"]):
                if seg == before:
                    out.append((0, rid, first, span, None))
                before = seg
            if out:
                yield pd.DataFrame(out, columns=["key", "rid", "first", "at", "seg"]).astype({c: "int64" for c in ("key", "rid", "first", "at")})

    return run


def _name(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)


def _anchor_rows(span: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("rid")
            got = [anchors(t, span, gram) for t in pdf["raw"]]
            key, segment, p, first, last = (np.concatenate(x) for x in zip(*got))
            raws, doc = pdf["raw"].tolist(), np.repeat(np.arange(len(pdf)), [len(x[0]) for x in got])
            rid = pdf["rid"].to_numpy()[doc]
            place = (p << 14) | ((p - first) << 7) | (last - first)
            # Segments equal to one before in this batch need no search: they are dealt at random, so common ones don't meet in one task.
            order = np.argsort(key ^ (segment * np.int64(0x5851F42D4C957F2D)), kind="stable")
            likely = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (segment[order[1:]] == segment[order[:-1]])) + 1
            copy = np.zeros(len(key), bool)
            same = [raws[doc[j]][first[j] : last[j] + span] == raws[doc[i]][first[i] : last[i] + span] and p[j] - first[j] == p[i] - first[i] for i, j in zip(order[likely - 1].tolist(), order[likely].tolist())]
            copy[order[likely[np.array(same, bool)]]] = True
            key = np.where(copy, (rid ^ (place << 20)) * np.int64(0x2545F4914F6CDD1D), key)
            yield pd.DataFrame({"key": key, "rid": rid, "place": place, "copy": copy})

    return run


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of packed places."""
    p = place >> 14
    first = p - ((place >> 7) & 127)
    return p, first, first + (place & 127)


#: Flags of an anchor: its segment is to be searched; so, and its gram is hot; it equals an earlier one.
SEARCH, HOT, COPY = 0, 1, 2


def _sift(hot_rows: int):
    """Anchors sorted by key to flagged ones; those alone with their gram go.

    At most ``hot_rows`` rows of the open gram are held back.
    """

    def out(rows: pd.DataFrame, flag: int | np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"rid": rows["rid"], "place": rows["place"], "flag": flag}).astype({"flag": "int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key = None
        held: list[pd.DataFrame] = []
        count = 0

        def close() -> Iterator[pd.DataFrame]:
            if held and count > 1:
                yield out(pd.concat(held), SEARCH)

        for pdf in batches:
            known = pdf["copy"].to_numpy()
            if known.any():
                yield out(pdf[known], COPY)
                pdf = pdf[~known]
            if not len(pdf):
                continue
            key = pdf["key"].to_numpy()
            mine, last = key == open_key if open_key is not None else np.zeros(len(key), bool), key == key[-1]
            if mine.any():
                count += int(mine.sum())
                if count > hot_rows:
                    yield out(pd.concat([*held, pdf[mine]]), HOT)
                    held = []
                else:
                    held.append(pdf[mine])
                if mine.all():
                    continue
            yield from close()
            middle = pdf[~mine & ~last]
            if len(middle):
                keys = middle["key"].to_numpy()
                edges = np.flatnonzero(np.diff(keys)) + 1
                sizes = np.diff(np.concatenate([[0], edges, [len(keys)]]))
                n = np.repeat(sizes, sizes)
                yield out(middle[n > 1], np.where(n > hot_rows, HOT, SEARCH)[n > 1])
            open_key, count, held = key[-1], int(last.sum()), [pdf[last]]
            if count > hot_rows:
                yield out(held[0], HOT)
                held = []
        yield from close()

    return run


def _segments(span: int, gram: int):
    """(key, rid, first, at, seg) of the anchors to search: ``at`` is the anchor's place in the segment.

    Of equal rows of a batch only the earliest goes on; the bytes of the others all repeat: they make rows of united spans, with a null ``seg`` and
    the length in ``at``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            marks: list[tuple[int, int]] = []
            seen: set[tuple[int, int, bytes]] = set()

            def add(key: int, rid: int, first: int, at: int, seg: bytes) -> None:
                if (key, at, seg) in seen:
                    marks.append((first, first + len(seg)))
                else:
                    seen.add((key, at, seg))
                    out.append((key, rid, first, at, seg))

            pdf = pdf.sort_values("rid")
            for rid, raw, places, flags in zip(pdf["rid"].tolist(), pdf["raw"], pdf["places"], pdf["flags"]):
                live = np.flatnonzero(flags != COPY)
                live = live[np.argsort(places[live], kind="stable")]
                if not len(live):
                    continue
                where = _unpack(places[live])
                # A gram's hash is computed again rather than shuffled: 8 bytes that don't compress, for each anchor.
                keys = _gram_hashes(np.frombuffer(raw, np.uint8), gram)[where[0]].view(np.int64)
                for flag, key, p, first, last in zip(flags[live].tolist(), keys.tolist(), *(x.tolist() for x in where)):
                    if flag == SEARCH:
                        add(key, rid, first, p - first, raw[first : last + span])
                        continue
                    for a, lo, hi in _runs(p - first, last - first + span, span):
                        a, lo, hi = a + first, lo + first, hi + first
                        add(_name(raw[a + PART : a + 1 + span] + (p - a).to_bytes(4, "little")), rid, lo, p - lo, raw[lo : hi + span])
                if marks:
                    starts, ends = unite(*np.array(marks, np.int64).T)
                    out += [(_spread(rid), rid, a, b - a, None) for a, b in zip(starts.tolist(), ends.tolist())]
                    marks.clear()
            for at in range(0, len(out), 20_000):
                yield pd.DataFrame(out[at : at + 20_000], columns=["key", "rid", "first", "at", "seg"])

    return run


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans [a, b) as one, in order."""
    order = np.argsort(a, kind="stable")
    a, far = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.concatenate([[True], a[1:] > far[:-1]]) if len(a) else np.empty(0, bool)
    ends = np.append(np.flatnonzero(new)[1:], len(a)) - 1 if len(a) else np.empty(0, np.int64)
    return a[new], far[ends]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(rid, _id, raw), and whether rid is unique: it orders rows by id, null ids last, then by text hash; equal rows share it."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), clean_text(text_col).cast("binary").alias("raw"))
    ids = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or _id is null")
    if ids.isEmpty():
        return rows.select(F.col("_id").alias("rid"), "_id", "raw"), True
    tied = rows.withColumn("tie", F.sha2("raw", 256))
    parts = cut(
        tied.select("_id", "tie").distinct()
        .repartitionByRange(F.col("_id").asc_nulls_last(), "tie").withColumn("part", F.spark_partition_id())
    )
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.col("_id").asc_nulls_last(), "tie"))
    index = cut(parts.withColumn("at", at).join(sizes.select("part", "base"), "part").select(F.col("_id").alias("i"), F.col("tie").alias("t"), (F.col("base") + F.col("at")).alias("rid")))
    return tied.join(index, tied["_id"].eqNullSafe(index["i"]) & (tied["tie"] == index["t"])).select("rid", "_id", "raw"), False


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, hot_rows: int = 100_000, shard_bytes: int = 2_000_000, key_bytes: int = 64_000_000) -> DataFrame:
    """For every row of ``docs``: id, ``raw`` (its bytes), ``starts`` and ``ends``: spans of bytes to remove, that may overlap, in no order.

    Texts are bytes in UTF-8, null is empty. Earlier means a smaller id, null ids last, or an earlier
    place in the text. Rows equal in id and text share a result; rows of one id with different texts follow each other
    by hash. Texts shorter than ``span`` have none. An empty table gives no rows.
    """
    rows, unique = _numbered(docs, id_col, text_col)
    # Both joins with the texts are to see the same rows and columns, so that Spark shuffles them once.
    rows = rows.filter("rid IS NOT NULL").select("rid", "raw") if unique else rows
    once = rows if unique else rows.dropDuplicates(["rid"])
    found = once.filter(F.length("raw") >= span).select("rid", "raw").mapInPandas(_anchor_rows(span, gram), "key long, rid long, place long, copy boolean")
    flagged = found.repartition("key").sortWithinPartitions("key").mapInPandas(_sift(hot_rows), "rid long, place long, flag int")
    listed = flagged.groupBy("rid").agg(F.collect_list(F.struct("place", "flag")).alias("x"))
    listed = listed.select(F.col("rid").alias("_rid"), F.col("x.place").alias("places"), F.col("x.flag").alias("flags"))
    segments = once.join(listed, once["rid"] == listed["_rid"]).select("rid", "raw", "places", "flags").mapInPandas(_segments(span, gram), "key long, rid long, first long, at long, seg binary")
    row = "key long, rid long, first long, at long, seg binary"
    solved = segments.repartition("key").sortWithinPartitions("key").mapInPandas(_shard(span, shard_bytes, key_bytes), row)
    # Windows of large keys meet again by their own bytes; the other rows are short spans.
    solved = solved.repartition("key").sortWithinPartitions("key", "seg", "rid", "first").mapInPandas(_equal_windows(span), row)
    marked = solved.select("rid", F.col("first").alias("a"), (F.col("first") + F.col("at")).alias("b"))
    marked = marked.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("s")).select(F.col("rid").alias("_sid"), F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    copies = F.filter(F.arrays_zip("places", "flags"), lambda x: x["flags"] == COPY)
    first = lambda x: F.shiftright(x["places"], 14) - F.shiftright(x["places"], 7).bitwiseAND(127)
    none = F.array().cast("array<long>")
    both = rows.join(listed, rows["rid"] == listed["_rid"], "left").join(marked, rows["rid"] == marked["_sid"], "left").withColumn("copies", copies)
    return both.select(
        F.col("rid" if unique else "_id").alias(id_col), "raw",
        F.concat(F.coalesce(F.transform("copies", first), none), F.coalesce("a", none)).alias("starts"),
        F.concat(F.coalesce(F.transform("copies", lambda x: first(x) + x["places"].bitwiseAND(127) + span), none), F.coalesce("b", none)).alias("ends"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` binary, ``kept_sha256``) for every row of ``docs``; see :func:`repeated_spans`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, raw, starts, ends in zip(pdf["_id"], pdf["raw"], pdf["starts"], pdf["ends"]):
                starts, ends = unite(starts, ends)
                at, kept = 0, []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    kept.append(raw[at:a])
                    at = b
                whole = b"".join([*kept, raw[at:]])
                out.append((doc, len(raw), len(raw) - len(whole), len(starts), whole, hashlib.sha256(whole).hexdigest()))
            yield pd.DataFrame(out, columns=["_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    found = repeated_spans(docs, id_col, text_col, **options).select(id_text(id_col), "raw", "starts", "ends")
    out = found.mapInPandas(run, "_id string, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.select(id_back(docs, id_col), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
