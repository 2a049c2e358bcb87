"""Packing of token sequences by vector best fit.

A bin has three capacities: tokens, documents, and attention cost (the sum of
squared lengths). Items are taken from the largest down; an item goes into the
bin that, under every constraint, scores best: the smallest weighted norm of what
would be left, or the largest weighted dot product of item and residual.

All three demands of an item follow from its length, so equal lengths are one
kind and bins filled alike are one kind: the plan is made for counts per length
(at most ``capacity`` numbers, whatever the number of documents) and says how
many bins get how many items of which length. Items are numbered within their
length in blocks, and look up their place in the plan on their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.common import stored
from tallywarden.operators.ordering import row_numbers

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Ids of a text between white space, as bytes of unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words one after the other.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def encode(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        core = _core(word)
        ids = self.encode(word) if core == word else self[core] + self[word[len(core) :]]
        self[word] = ids
        return ids

    def learn(self, words: set[bytes]) -> None:
        """Encodes new words: plain ones straight by the model, others together,
        one call for thousands of them."""
        if len(self) > 900_000:
            self.clear()
        new = [w for w in {_core(w) for w in words} if w not in self and b"<|" not in w]
        plain = [w for w in new if w.isalpha() and w.islower()]  # ASCII letters
        for w in plain:
            self[w] = np.array([t.id for t in self.tokenizer.model.tokenize(w.decode())], "<u4").tobytes()
        new = [w for w in new if w not in self]
        for lo in range(0, len(new), 4096):
            texts = [w.decode("utf-8", "replace") for w in new[lo : lo + 4096]]
            coded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
            at = np.fromiter((o[0] for o in coded.offsets), np.int64, len(coded.offsets))
            cut = np.searchsorted(at, begin).tolist()
            raw = np.array(coded.ids, "<u4").tobytes()
            for w, i, j in zip(new[lo : lo + 4096], cut, cut[1:]):
                self[w] = raw[4 * i : 4 * j]

    def ids(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of some texts. The strings of special tokens are matched before
        lowering, so texts that may hold one are not lowered here."""
        for lo in range(0, len(raws), 128):
            split = [(x if b"<|" in x else x.lower()).split() for x in raws[lo : lo + 128]]
            found = [list(map(self.get, words)) for words in split]
            new = {w for ws, ids in zip(split, found) if None in ids for w, k in zip(ws, ids) if k is None}
            if new:
                self.learn(new)
                found = [[self[w] if k is None else k for w, k in zip(ws, ids)] for ws, ids in zip(split, found)]
            for ids in found:
                yield np.frombuffer(b"".join(ids), "<u4")


def _core(word: bytes) -> bytes:
    """A word without the marks at its end, if they are a token of their own."""
    core = word.rstrip(b".,!?;:")
    return core if core[-1:].isalpha() else word


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every document: its ids and ``end_id``, cut only if longer than
    ``capacity``. Null and empty texts are the end id alone."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from tokenizers import Tokenizer

        words = WordIds(Tokenizer.from_file(tokenizer_path))
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            raws = [x.as_py() or b"" for x in batch.column(1)]
            for i, ids in zip(batch.column(0).to_pylist(), words.ids(raws)):
                ids = np.concatenate([ids, end])
                for k, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    rows.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=PIECE.replace(",", "").split()[::2]
            )

    return docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary")).mapInArrow(scan, PIECE)


def plan(
    counts: dict[int, int], capacity: int, max_docs: int, max_attention: int,
    select: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
) -> tuple[np.ndarray, int]:
    """Places for ``counts`` items per length: rows (length, first item, first
    bin, items per bin, offset), and the number of bins.

    Kinds of bins are rows of arrays; bins of one kind have consecutive numbers.
    """
    caps = np.array([capacity, max_docs, max_attention], np.float64)
    w = np.array(weights)
    size = 1024
    left, first, many = np.zeros((size, 3)), np.zeros(size, np.int64), np.zeros(size, np.int64)
    used = bins = 0
    rows = []

    def add(residual, start, number):
        nonlocal used, size, left, first, many
        if used == size:
            left, first, many = np.concatenate([left, left]), np.concatenate([first, first]), np.concatenate([many, many])
            size *= 2
        left[used], first[used], many[used] = residual, start, number
        used += 1

    for length in sorted(counts, reverse=True):
        n, done = counts[length], 0
        item = np.array([length, 1.0, float(length) * length])
        if (item > caps).any():
            raise ValueError(f"an item of {length} tokens fits no bin")

        def put(kind: int, bins_taken: int, each: int) -> None:
            """``each`` items into the first bins of a kind, which become a kind."""
            nonlocal done
            rows.append((length, done, first[kind], each, capacity - left[kind, 0]))
            done += bins_taken * each
            rest = many[kind] - bins_taken
            if rest:
                add(left[kind].copy(), first[kind] + bins_taken, rest)
                many[kind] = bins_taken
            left[kind] -= each * item

        while done < n:
            fits = np.flatnonzero((left[:used] >= item).all(1))
            if not len(fits):
                each = int((caps // item).min())
                add(caps, bins, max(1, (n - done) // each))
                bins += int(many[used - 1])
                fits = np.array([used - 1])
            after = (left[fits] - item) / caps
            if select == "norm":
                kind = fits[np.argmin((w * after * after).sum(1))]
                each = int((left[kind] // item).min())
            else:
                kind = fits[np.argmax((left[fits] / caps) @ (w * item / caps))]
                each = 1
            each = min(each, n - done)
            put(kind, min(int(many[kind]), (n - done) // each), each)
        # kinds that nothing more can enter are of no further use
        if used > 4096:
            open_ = np.flatnonzero((left[:used, 0] >= 1) & (left[:used, 1] >= 1) & (left[:used, 2] >= 1))
            for a in (left, first, many):
                a[: len(open_)] = a[open_]
            used = len(open_)
    return np.array(rows, np.int64).reshape(-1, 5), bins


def packed(
    pieces: DataFrame, capacity: int = 2048, max_docs: int | None = None, max_attention: int | None = None,
    select: str = "norm",
) -> DataFrame:
    """``pieces`` (``doc_id``, ``piece``, ``length``, more) with ``sequence_id``
    and ``offset``. Without limits of their own, the number of documents and the
    attention cost are bound by the tokens alone. Equal lengths take places in an
    order made from the ids; pieces of repeated rows have a place each.
    """
    pieces = stored(pieces, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # one row per length
    rows, _ = plan(counts, capacity, max_docs or capacity, max_attention or capacity * capacity, select)
    starts: dict[int, np.ndarray] = {}
    for length in counts:
        starts[length] = rows[rows[:, 0] == length][:, 1:]
    blocks = max(64, -(-sum(counts.values()) // 65536))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    numbered = row_numbers(pieces, ["length"], ["doc_id", "piece"], block, "__rank")
    names, schema = pieces.columns, pieces.schema.simpleString()[7:-1]

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "__rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                here, t = length == n, starts[int(n)]
                r = rank[here] - 1
                k = np.searchsorted(t[:, 0], r, "right") - 1
                past = r - t[k, 0]
                sequence[here] = t[k, 1] + past // t[k, 2]
                offset[here] = t[k, 3] + past % t[k, 2] * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    return numbered.select(*names, "__rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")
