"""Removal of repeated byte strings by prefix doubling.

The rule: a byte goes if some string of ``length`` bytes that covers it also
starts earlier (smaller document, or same document and smaller offset).

The name of the 2h bytes at a position is made of the names of the h bytes there
and at offset h, as in prefix doubling. A plain run of it would rank every byte
of the corpus in every round. Here each round ranks only positions that still
matter:

* **Sampling.** A ``length``-byte window is represented by the position of its
  smallest h-byte name. Equal windows have equal smallest names, so windows fall
  into *runs*, consecutive windows with one place of the smallest name: about 2 rows for
  every ``length - h`` bytes, and none is lost.
* **Unique names drop out.** A run whose name occurs once holds no repeated
  window.
* **Runs past the threshold are done.** Runs with equal text (name and text hash
  equal, 128 bits) are longer than ``length``; all but the first go.
* **The rest is ranked again with names of doubled length**, from the first run
  of each text only. At h = ``length`` a run is one window and the rounds end.

Groups are never brought together: counts, firsts and joins on names are all
that happens, and Spark combines before the shuffle and splits skewed joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.common import blocks, discard, stored

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
RUN = "m long, g long, doc_id long, start int, n int, seg int"
_PIECE = 1 << 21  # windows taken at a time from one long text


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                a = np.full(n, base & (2**64 - 1), _U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by block prefix and suffix minima."""
    if w == 1:
        return h
    m = len(h)
    block = np.full(m + (-m) % w, _U(2**64 - 1))
    block[:m] = h
    block = block.reshape(-1, w)
    before = np.minimum.accumulate(block, 1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: m - w + 1], before[w - 1 : m])


def growing(length: int, h0: int) -> list[int]:
    """Name lengths of the rounds: doubled while that fits, then half of what is
    missing, at last ``length`` itself."""
    out = [min(h0, length)]
    while out[-1] < length:
        h = out[-1]
        out.append(length if length - h <= length // 16 else min(2 * h, h + (length - h + 1) // 2))
    return out


def runs(raw, starts: np.ndarray, counts: np.ndarray, length: int, hs: list[int], powers: Powers):
    """Runs of the windows ``starts[i]`` to ``starts[i] + counts[i]`` of some bytes,
    for names of ``hs[-1]`` bytes made by way of the lengths before. Gives, per
    run, smallest name, text hash, first window, number of windows.

    The pieces asked for lie in order, ``length - 1`` bytes or more apart.
    """
    a = np.frombuffer(raw, np.uint8)
    size = len(a)
    if size < length:
        return None
    powers.upto(size + 1)
    h = hs[0]
    sums = np.zeros(size + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * powers.up[:size], out=sums[1:])
    names = mixed((sums[h:] - sums[:-h]) * powers.down[: size - h + 1])
    for longer in hs[1:]:  # pairs of names at a growing offset
        step, h = longer - h, longer
        names = mixed(names[:-step] * _U(0xD6E8FEB86659FD93) + names[step:])
    least = _least(names, length - h + 1)
    edge = np.zeros(len(least) + 1, np.int8)
    here = counts > 0
    edge[starts[here]] += 1
    edge[(starts + counts)[here]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    # A run ends where the smallest name changes, or the place that holds it.
    same = (least[1:] == least[:-1]) & (names[: len(least) - 1] != least[:-1]) & inside[:-1]
    first = np.flatnonzero(inside & ~np.concatenate([[False], same]))
    goes_on = np.concatenate([same & inside[1:], [False]])
    end = np.flatnonzero(inside & ~goes_on) + 1
    texts = mixed((sums[end + length - 1] - sums[first]) * powers.down[first] + (end - first).astype(_U))
    return least[first].view(np.int64), texts.view(np.int64), first, end - first


def _runs_of_pieces(pieces: list, length: int, hs: list[int], powers: Powers) -> Iterator:
    """Arrow batches of the runs of pieces (doc_id, offset in the text, seg, bytes)."""
    import pyarrow as pa

    for lo, hi in blocks([len(p[3]) for p in pieces]):
        part = pieces[lo:hi]
        ids, offsets, segs = (np.array([p[k] for p in part], np.int64) for k in range(3))
        sizes = np.array([len(p[3]) for p in part])
        starts = np.cumsum(sizes) - sizes
        found = runs(b"".join(p[3] for p in part), starts, np.maximum(0, sizes - length + 1), length, hs, powers)
        if found is None:
            continue
        m, g, first, n = found
        of = np.searchsorted(starts + sizes, first, "right")
        at = first - starts[of] + offsets[of]
        columns = [m, g, ids[of], at.astype(np.int32), n.astype(np.int32), segs[of].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=RUN.split()[::2])


def _runs_of_texts(docs: DataFrame, length: int, hs: list[int]) -> DataFrame:
    def scan(batches: Iterator) -> Iterator:
        powers = Powers()
        for batch in batches:
            texts = batch.column(1)
            pieces = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                raw = texts[i].as_buffer() if texts[i].is_valid else b""
                for s in range(0, max(1, len(raw) - length + 1), _PIECE):
                    pieces.append((doc, s, 0, memoryview(raw)[s : s + _PIECE + length - 1]))
            yield from _runs_of_pieces(pieces, length, hs, powers)

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(scan, RUN)


def _runs_of_segments(segments: DataFrame, length: int, hs: list[int]) -> DataFrame:
    """Runs of the windows ``start`` to ``start + n`` of segments (doc_id, seg, raw)."""

    def scan(batches: Iterator) -> Iterator:
        powers = Powers()
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            pieces = [
                (doc, s, seg, raw[s - seg : s - seg + n + length - 1]) for doc, seg, raw, s, n in zip(*rows)
            ]
            yield from _runs_of_pieces(pieces, length, hs, powers)

    return segments.select("doc_id", "seg", "raw", "start", "n").mapInArrow(scan, RUN)


def _first_runs(rows: DataFrame) -> DataFrame:
    """One row for each text of a run: its first place and how often it occurs."""
    return rows.groupBy("m", "g").agg(
        F.min(F.struct("doc_id", "start", "n", "seg")).alias("at"), F.count("*").alias("c")
    )


def _raw_segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the windows wanted: doc_id, seg (their start), n, raw."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("segs"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    cut = texts.join(lists, "doc_id").select("doc_id", "text", F.explode("segs").alias("s"))
    # byte substring: positions count from 1
    return cut.select(
        "doc_id", F.col("s.start").alias("seg"), F.col("s.n").alias("n"),
        F.substring("text", F.col("s.start") + 1, F.col("s.n") + F.lit(length - 1)).alias("raw"),
    )


def repeated_bytes(docs: DataFrame, length: int = 100, first: int = 25) -> DataFrame:
    """Maximal pieces (doc_id, start, end) to remove, possibly overlapping."""
    hs = growing(length, min(first, length))
    all_runs = _runs_of_texts(docs, length, hs[:1])
    # Written first: both sides of the join then are plain scans, and Spark can
    # split a name that a third of all runs have.
    names = stored(all_runs.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m"), "repeated")
    rows = stored(all_runs.join(names, "m", "left_semi"), "names")
    out, raw = [], None
    for k in range(len(hs)):
        firsts = stored(_first_runs(rows), "firsts")
        again = firsts.filter("c > 1").select("m", "g", "at")
        copies = rows.join(again, ["m", "g"]).filter(
            (F.col("doc_id") != F.col("at.doc_id")) | (F.col("start") != F.col("at.start"))
        )
        out.append(stored(copies.select("doc_id", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end")), "copies"))
        if k + 1 == len(hs):
            discard(rows, firsts)
            break
        shared = stored(firsts.groupBy("m").agg(F.count("*").alias("k")).filter("k > 1").select("m"), "repeated")
        left = firsts.join(shared, "m", "left_semi").select("at.*")
        if raw is None:
            raw = stored(_raw_segments(docs, left, length), "segments")
            segments = raw.withColumn("start", F.col("seg"))
        else:
            segments = left.join(raw.drop("n"), ["doc_id", "seg"])
        done = (rows, firsts)
        rows = stored(_runs_of_segments(segments, length, hs[: k + 2]), "names")
        discard(*done)
    if raw is not None:
        discard(raw)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def merged(spans) -> np.ndarray:
    """Disjoint spans, in order, of spans that may overlap or touch."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    s = np.array([(x["start"], x["end"]) for x in spans], np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return np.stack([s[new, 0], reach[last]], 1)


def without_repeats(docs: DataFrame, length: int = 100, first: int = 25) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed, disjoint, byte offsets) and
    ``kept`` (the other bytes) of every document.

    A null text counts as empty. Documents are told apart by ``doc_id``; rows
    that repeat an id with another text are not supported, exact repeats of a
    row count once. Null ids take no part. Columns other than ``doc_id`` and
    ``text`` are ignored. Texts shorter than ``length`` bytes stay whole. Exact
    but for equal 128-bit hashes of different texts.
    """
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    spans = repeated_bytes(docs, length, first).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts, lists = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            n, gone, kept = [], [], []
            for text, found in zip(texts, lists):
                raw = text.as_py() or b""
                s = merged(found or [])
                edge = [0, *s.ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])))
                gone.append([{"start": int(a), "end": int(b)} for a, b in s])
                n.append(len(raw))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(spans, "doc_id", "left").mapInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
