"""Runs of repeated words by the branching-tandem test on an enhanced suffix array.

A run is a stretch with smallest period ``q`` that cannot be made longer. Its last
square (two periods) is *branching*: the word after it breaks the period. The two
halves start at places of one LCP interval of depth ``q``, in different children
of it. So, for every LCP interval, each suffix of all children but the largest
asks whether the place ``depth`` words before or after it lies in the interval too;
that is one look into the inverse suffix array. Over all intervals this asks about
each suffix a logarithmic number of times, and no suffix tree is built.

Each branching square found is rotated to the left as far as its period holds.
Squares with the same end whose period is a multiple of one that reaches them
belong to that run and are dropped, so equal words in a long row stay linear.

A task takes documents together up to a number of words: their arrays lie behind
each other and words of different documents have different names, so that nothing
is found across documents and numpy works on long arrays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.common import blocks

_BLOCK_BYTES = 1 << 19


def suffix_ranks(names: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Suffix array, its inverse, and the ranks of all lengths 1, 2, 4, ... met.

    ``ends[i]`` is where the document of position ``i`` ends; a suffix ends there.
    Rounds double the length and sort again only what is still tied.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    first = np.ones(n, bool)
    first[1:] = names[order[1:]] != names[order[:-1]]
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(first, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels = [rank.astype(np.int32 if n < 2**31 else np.int64)]
    h = 1

    def tied(slots, start):
        """Slots whose group holds more than one suffix."""
        same = np.zeros(len(slots), bool)
        same[1:] = start[1:] == start[:-1]
        same[:-1] |= same[1:]
        return slots[same]

    slots = tied(place, start)
    while len(slots):
        at = order[slots]
        after = at + h
        second = np.where(after < ends[at], rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[at]
        by = np.argsort(group * (n + 1) + second, kind="stable")
        at, group, second = at[by], group[by], second[by]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        start = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = start
        h *= 2
        levels.append(rank.astype(levels[0].dtype))
        slots = tied(slots, start)
    return order, rank, levels


def neighbour_lcp(order: np.ndarray, levels: list) -> np.ndarray:
    """Words that each suffix shares with the one before it in the suffix array,
    by descending through the kept ranks; 0 for the first."""
    n = len(order)
    out = np.zeros(n, np.int64)
    # Neighbours that differ in the first word are done.
    open_ = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[open_ - 1].copy(), order[open_].copy()
    got = np.zeros(len(open_), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        step = ok.astype(np.int64) << k
        a += step
        b += step
        got += step
    out[open_] = got
    return out


def _nearest_smaller(lcp: np.ndarray, ks: np.ndarray, step: int) -> np.ndarray:
    """For each place in ``ks`` the next one to the left (``step`` -1) or right (1)
    with a smaller value, by pointer jumping. Both ends of ``lcp`` are below all."""
    to = np.arange(len(lcp)) + step
    left = ks
    while len(left):
        left = left[lcp[to[left]] >= lcp[left]]
        to[left] = to[to[left]]
    return to[ks]


def branching_squares(names: np.ndarray, ends: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) and periods of the branching squares of ``names``, each
    once. With ``least``, only those whose period still holds for the stretch of
    ``least`` periods before their end, judged by one word per period."""
    n = len(names)
    order, rank, levels = suffix_ranks(names, ends)
    lcp = np.concatenate([neighbour_lcp(order, levels), [-1]])
    lcp[0] = -1
    ks = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(ks):
        return none, none
    lo, hi = _nearest_smaller(lcp, ks, -1), _nearest_smaller(lcp, ks, 1)
    # Places of one interval share (lo, hi); between them lie its children.
    by = np.lexsort((ks, hi, lo))
    ks, lo, hi = ks[by], lo[by], hi[by]
    opens = np.ones(len(ks), bool)
    opens[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    closes = np.concatenate([opens[1:], [True]])
    head = np.flatnonzero(opens)
    interval = np.cumsum(opens) - 1
    # Child before each place, and one more after the last place of an interval.
    # An interval holds the suffixes lo to hi - 1.
    before = np.where(opens, lo, np.concatenate([[0], ks[:-1]]))
    child_lo = np.concatenate([before, ks[closes]])
    child_hi = np.concatenate([ks, hi[closes]])
    of = np.concatenate([interval, interval[closes]])
    depth, left, right = lcp[ks[head]], lo[head], hi[head]
    size = child_hi - child_lo
    # All children but the largest (the first of the largest ones).
    widest = np.lexsort((child_lo, -size, of))
    largest = np.ones(len(of), bool)
    largest[1:] = of[widest][1:] != of[widest][:-1]
    keep = np.ones(len(of), bool)
    keep[widest[largest]] = False
    child_lo, size, of = child_lo[keep], size[keep], of[keep]
    ends_found, periods = [], []
    # Suffixes of small children, a bounded number at a time.
    upto = np.cumsum(size)
    cut = [0, *(np.searchsorted(upto, np.arange(1 << 20, upto[-1] if len(upto) else 0, 1 << 20)) + 1), len(size)]
    for c0, c1 in zip(cut[:-1], cut[1:]):
        if c0 >= c1:
            continue
        sz = size[c0:c1]
        total = int(sz.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(sz) - sz, sz)
        i = order[np.repeat(child_lo[c0:c1], sz) + inside]
        node = np.repeat(of[c0:c1], sz)
        d = depth[node]
        for start, other in ((i, i + d), (i - d, i - d)):
            ok = np.flatnonzero((other >= 0) & (other < n))
            r = rank[other[ok]]
            ok = ok[(r >= left[node[ok]]) & (r < right[node[ok]])]
            at, q = start[ok], d[ok]
            end = at + 2 * q
            # Different children: the word after the square breaks its period.
            last = end >= ends[at]
            breaks = last | (names[np.minimum(end, n - 1)] != names[at + q])
            at, q, end = at[breaks], q[breaks], end[breaks]
            for m in range(3, least + 1):
                back = end - m * q
                fits = back >= 0
                fits[fits] = names[back[fits]] == names[(back + q)[fits]]
                at, q, end = at[fits], q[fits], end[fits]
            ends_found.append(end)
            periods.append(q)
    if not ends_found:
        return none, none
    found = np.unique(np.stack([np.concatenate(ends_found), np.concatenate(periods)], 1), axis=0)
    return found[:, 0], found[:, 1]


def runs(names: np.ndarray, ends: np.ndarray, least_length: int, least_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs with at least ``least_length``
    words and ``least_periods`` (two or more) periods, by start and period."""
    found: list[tuple[int, int, int]] = []
    at_end, reached = None, []
    for end, q in zip(*(x.tolist() for x in branching_squares(names, ends, least_periods))):
        if end != at_end:
            at_end, reached = end, []
        # A multiple of a period that reaches back over the square: the same run.
        if any(q % p == 0 and end - 2 * q >= s for p, s in reached):
            continue
        start, step = end - 2 * q, 64
        while start > 0:
            lo = max(0, start - step)
            differs = np.flatnonzero(names[lo:start] != names[lo + q : start + q])
            if len(differs):
                start = lo + int(differs[-1]) + 1
                break
            start, step = lo, 2 * step
        reached.append((q, start))
        if end - start >= max(least_length, least_periods * q):
            found.append((start, end - start, q))
    found.sort(key=lambda x: (x[0], x[2]))
    return found


def _of_block(texts: list[bytes], least_length: int, least_periods: int) -> Iterator[tuple[int, list, bytes]]:
    """Per text: number of words, runs, and the words that stay."""
    split = [t.split() for t in texts]  # on the six ASCII white space characters
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes) - sizes
    table: dict = defaultdict(count().__next__)
    name = table.__getitem__
    names = np.fromiter((name(w) for ws in split for w in ws), np.int64, int(sizes.sum()))
    names += np.repeat(np.arange(len(sizes), dtype=np.int64) * max(1, len(table)), sizes)
    found = runs(names, np.repeat(starts + sizes, sizes), least_length, least_periods) if len(names) else []
    per: dict[int, list] = defaultdict(list)
    for s, length, q in found:
        doc = int(np.searchsorted(starts, s, "right")) - 1
        per[doc].append((s - int(starts[doc]), length, q))
    for k, ws in enumerate(split):
        mine = per.get(k, [])
        if mine:
            edge = np.zeros(len(ws) + 1, np.int64)
            for s, length, q in mine:
                edge[s + q] += 1
                edge[s + length] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            ws = [w for w, g in zip(ws, gone.tolist()) if not g]
        yield int(sizes[k]), mine, b" ".join(ws)


def periodic_runs(docs: DataFrame, least_length: int = 6, least_periods: int = 4) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then
    period) and ``collapsed`` (the words that no run repeats, joined by a space).

    Words are split at ASCII white space. A run has at least ``least_length`` words
    and ``least_periods`` (two or more) times its smallest period. Of a run the first
    period stays; a word goes if any run repeats it. Texts are taken whole, rows one
    by one: a null or blank text has no words and no runs, null ids and repeated rows
    come back as they are, ``doc_id`` may have any type, an empty table gives an
    empty one, and columns other than ``doc_id`` and ``text`` are ignored. No row
    leaves its task, so nothing is shuffled.
    """
    kind = "array<struct<start:long,length:long,period:long>>"

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of_run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            for lo, hi in blocks([max(1, n) for n in sizes], _BLOCK_BYTES):
                raw = [t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]
                n, found, kept = zip(*_of_block(raw, least_length, least_periods))
                found = [[{"start": s, "length": m, "period": q} for s, m, q in rs] for rs in found]
                columns = [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(found, of_run), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {id_type}, n_words long, runs {kind}, kept binary").select(
        "doc_id", "n_words", "runs", F.col("kept").cast("string").alias("collapsed")
    )


def replanted(doc_id: Column, text: Column) -> Column:
    """The text whose runs the registered query reports: with h the crc32 of the
    id and g = h / 10, in every text with h % 10 = 0 the words from a = g % n on
    repeat the p = 1 + (n - a) / (3 + g % 8) words found there."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def spelled(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        moved = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
        )
        return F.array_join(moved, " ")

    # One-element array: the words are split once and named.
    again = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, spelled(ws)).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, again).otherwise(text)
