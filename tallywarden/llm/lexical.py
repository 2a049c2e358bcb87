"""Ranked lexical search with per-term geometric blocking.

A document is a sparse vector: under each term the whole number that the term adds
to its score. An item is a set of terms, its score of a document the sum under them.

Documents are cut into shards that fit a task. In a shard, the posting list of each
term is clustered by the similarity of its documents (to pivots of the list, on
random projections of their vectors), and of each cluster the coordinatewise maximum
is stored. The sum of a maximum over an item's terms is an exact upper bound for all
documents of the block. A search walks the lists of the item, strongest first; in a
list it takes blocks by falling bound and scores their documents in full. It skips
the blocks whose bound is below the score of the last place held so far, and stops
when what the lists left can add at most is below it. Nothing else is skipped, so
the answer is exact; places held are kept from shard to shard of a task.

Coordinates of a summary that no item has together with the list's term are left
out, as no search reads them; the blocks of a term are made when first asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.common import discard, stored
from tallywarden.operators.ordering import top_per_key

# Terms are runs of 0-9, A-Z (lowered), a-z and all bytes beyond ASCII.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_ITEM_TERMS = 1 << 20  # terms of items held by a task at a time
_SHARD_POSTINGS = 1 << 19
_BATCH_WORDS = 1 << 20


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and ``term`` (bytes), each pair once."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, out = [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                mine = sorted(set(terms(raw)))
                ids += [k] * len(mine)
                out += mine
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.binary())], names=["item_id", "term"]
            )

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.col("text").cast("binary"))
    return rows.mapInArrow(scan, f"item_id {kind}, term binary").distinct()


def _counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms`` (places in the vocabulary)
    and ``tfs`` for every document; of rows with one id one stays."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        get = {t: k for k, t in enumerate(sent.value)}.get
        v = max(1, len(sent.value))

        def rows(ids: list, lists: list[list[bytes]]) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in lists], np.int64)
            found = np.fromiter((k for x in lists for k in map(get, x, repeat(-1))), np.int64, int(sizes.sum()))
            of = np.repeat(np.arange(len(lists)), sizes)
            known = found >= 0
            keys, tfs = np.unique(of[known] * v + found[known], return_counts=True)
            edge = np.searchsorted(keys, np.arange(len(lists) + 1) * v).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(edge, pa.array((keys % v).astype(np.int32))),
                    pa.ListArray.from_arrays(edge, pa.array(tfs)),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

        for batch in batches:
            ids, lists, size = [], [], 0
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(raw.as_py() or b"")
                ids.append(doc)
                lists.append(words)
                size += len(words)
                if size >= _BATCH_WORDS:
                    yield rows(ids, lists)
                    ids, lists, size = [], [], 0
            if ids:
                yield rows(ids, lists)

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    counted = texts.mapInArrow(scan, "doc_id long, n long, terms array<int>, tfs array<long>")
    return counted.groupBy("doc_id").agg(F.max(F.struct("n", "terms", "tfs")).alias("x")).select("doc_id", "x.*")


def _document_counts(counted: DataFrame, size: int) -> np.ndarray:
    """Documents holding each term, ``size`` numbers."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    parted = counted.select("terms").mapInArrow(scan, "term int, df long")
    for row in parted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most one per term
        out[row["term"]] = row["df"]
    return out


class Best:
    """The ``k`` best documents of an item so far: falling score, rising id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.ids) >= self.k

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores])
        ids = np.concatenate([self.ids, ids])
        if len(ids) > self.k:
            # Ties at the k-th score are all kept for the order by id.
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            some = scores >= least
            scores, ids = scores[some], ids[some]
        by = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[by], ids[by]

    def may_enter(self, bound, least_id) -> np.ndarray:
        """Whether documents of at most this score and at least this id can come in."""
        if not self.full():
            return np.ones(np.shape(bound), bool)
        return (bound > self.scores[-1]) | ((bound == self.scores[-1]) & (least_id < self.ids[-1]))


class Shard:
    """Some documents as sparse rows, with blocked posting lists made on demand."""

    def __init__(self, ids, indptr, cols, vals, size: int, together: list[np.ndarray], block: int = 64) -> None:
        self.ids, self.indptr, self.cols, self.vals = ids, indptr, cols, vals
        self.together, self.block = together, block
        rows = np.repeat(np.arange(len(ids)), np.diff(indptr))
        by = np.argsort(cols, kind="stable")
        self.rows, listed = rows[by], cols[by]
        self.lists = np.searchsorted(listed, np.arange(size + 1))
        self.strongest = np.zeros(size, np.int64)
        np.maximum.at(self.strongest, cols, vals)
        self.blocks: dict[int, tuple] = {}
        self.wide = np.zeros(size, np.int64)  # scratch: place of a term in a summary
        self.scored = self.skipped = self.seen = 0
        # Random projections of the rows, of unit length.
        dims = 16
        signs = np.random.default_rng(7).standard_normal((size, dims)).astype(np.float32)
        self.sketch = np.zeros((len(ids), dims), np.float32)
        for lo in range(0, len(ids), 2048):
            hi = min(len(ids), lo + 2048)
            a, b = indptr[lo], indptr[hi]
            if a < b:
                part = signs[cols[a:b]] * vals[a:b, None].astype(np.float32)
                full = np.flatnonzero(np.diff(indptr[lo : hi + 1]))
                self.sketch[lo + full] = np.add.reduceat(part, indptr[lo + full] - a, axis=0)
        norm = np.linalg.norm(self.sketch, axis=1, keepdims=True)
        self.sketch /= np.where(norm > 0, norm, 1)

    def _entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``cols`` of all entries of some documents, and their number each."""
        size = self.indptr[docs + 1] - self.indptr[docs]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(self.indptr[docs], size) + inside, size

    def of_term(self, t: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Blocks of the list of ``t`` (documents), their maxima over the terms
        ``together[t]``, and the smallest id in each."""
        if t in self.blocks:
            return self.blocks[t]
        docs = self.rows[self.lists[t] : self.lists[t + 1]]
        pivots = -(-len(docs) // self.block)
        if pivots > 1:
            chosen = docs[np.arange(pivots) * len(docs) // pivots]
            nearest = np.empty(len(docs), np.int64)
            for lo in range(0, len(docs), 4096):
                nearest[lo : lo + 4096] = (self.sketch[docs[lo : lo + 4096]] @ self.sketch[chosen].T).argmax(1)
            by = np.argsort(nearest, kind="stable")
            docs, nearest = docs[by], nearest[by]
            # Of a large cluster, such as copies, each so many documents are a block.
            place = np.arange(len(docs)) - np.searchsorted(nearest, nearest)
            new = np.concatenate([[True], nearest[1:] != nearest[:-1]]) | (place % (4 * self.block) == 0)
        else:
            new = np.zeros(len(docs), bool)
            new[:1] = True
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        terms_ = self.together[t]
        self.wide[terms_] = np.arange(1, len(terms_) + 1)
        most = np.zeros((len(starts), len(terms_)), np.int64)
        flat = most.ravel()
        for lo in range(0, len(docs), 4096):
            at, size = self._entries(docs[lo : lo + 4096])
            place = self.wide[self.cols[at]]
            has = place > 0
            np.maximum.at(flat, (np.repeat(of[lo : lo + 4096], size) * len(terms_) + place - 1)[has], self.vals[at[has]])
        self.wide[terms_] = 0
        lists = np.split(docs, starts[1:])
        least = np.minimum.reduceat(self.ids[docs], starts) if len(docs) else np.zeros(0, np.int64)
        self.blocks[t] = lists, most, least
        return self.blocks[t]

    def search(self, asked: np.ndarray, best: Best) -> None:
        """Adds this shard's documents to the best of an item (sorted term places)."""
        here = asked[self.lists[asked + 1] > self.lists[asked]]
        here = here[np.argsort(-self.strongest[here], kind="stable")]
        rest = np.cumsum(self.strongest[here][::-1])[::-1]
        done = np.zeros(len(self.ids), bool)
        wanted = np.zeros(len(self.strongest), bool)
        wanted[asked] = True
        for t, mass in zip(here.tolist(), rest.tolist()):
            # A document not seen yet is in the lists left only.
            if not best.may_enter(np.int64(mass), np.int64(-(2**63))):
                break
            lists, most, least = self.of_term(t)
            bound = most[:, np.searchsorted(self.together[t], asked)].sum(1)
            by = np.argsort(-bound, kind="stable")
            self.seen += len(by)
            for lo in range(0, len(by), 4):
                some = by[lo : lo + 4]
                some = some[best.may_enter(bound[some], least[some])]
                if not len(some):
                    if best.full() and bound[by[lo]] < best.scores[-1]:
                        self.skipped += len(by) - lo
                        break
                    continue
                docs = np.concatenate([lists[k] for k in some])
                docs = docs[~done[docs]]
                if not len(docs):
                    continue
                done[docs] = True
                self.scored += len(docs)
                at, size = self._entries(docs)
                score = np.add.reduceat(self.vals[at] * wanted[self.cols[at]], np.cumsum(size) - size)
                fits = best.may_enter(score, self.ids[docs]) & (score > 0)
                best.add(score[fits], self.ids[docs][fits])


def _gains(weights, n, tfs, sizes, documents: int, all_terms: int) -> np.ndarray:
    """What each posting adds to a score; ``sizes`` postings per document, which
    has ``n`` terms. Lengths are taken in Python, where numbers do not overflow."""
    m = np.array([10 + 90 * x * documents // all_terms for x in n.tolist()], np.int64)
    return weights * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes)))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` (from 1),
    ``doc_id`` and ``score``; only scores above 0, ties by rising ``doc_id``.

    ``doc_id`` is a whole number. Rows without an id, items without terms and
    documents without terms take no part. Repeated rows count as one document or
    item; of rows that repeat a ``doc_id`` with another text the one of most terms
    counts, an item has the terms of all its rows. Texts are taken whole. No item or
    no document: no rows. Other columns are ignored.

    Items are taken together as long as a task can hold their terms; with more, the
    documents are read once for each such group.
    """
    spark = docs.sparkSession
    pairs = stored(item_terms(items), "item-terms", False)
    groups = -(-pairs.count() // _ITEM_TERMS)
    out = None
    for g in range(groups):
        mine = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else pairs
        found = _search_group(docs, mine, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def _search_group(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    # Bounded: about _ITEM_TERMS pairs, or one item.
    lists = pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
    vocabulary = sorted({bytes(t) for row in lists for t in row["terms"]})
    place = {t: i for i, t in enumerate(vocabulary)}
    names = [row["item_id"] for row in lists]
    asked = [np.array(sorted(place[bytes(t)] for t in row["terms"]), np.int64) for row in lists]
    size = len(vocabulary)
    counted = stored(_counted(docs, vocabulary), "counted")
    documents, all_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = _document_counts(counted, size)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((names, asked, weights))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, asked, weights = sent.value
        best = [Best(k) for _ in asked]
        with_: list[list] = [[] for _ in weights]
        for a in asked:
            for t in a.tolist():
                with_[t].append(a)
        together = [np.unique(np.concatenate(x)) for x in with_]
        held: list = []

        def flush() -> None:
            ids, n, sizes, cols, tfs = (np.concatenate(x) for x in zip(*held))
            held.clear()
            gains = _gains(weights[cols], n, tfs, sizes, documents, all_terms)
            used = gains > 0
            at = np.concatenate([[0], np.cumsum(used)])[np.concatenate([[0], np.cumsum(sizes)])]
            shard = Shard(ids, at, cols[used], gains[used], size, together)
            for a, b in zip(asked, best):
                shard.search(a, b)

        postings = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cols = part.column(2)
                sizes = np.diff(cols.offsets.to_numpy())
                held.append(
                    (
                        part.column(0).to_numpy(),
                        part.column(1).to_numpy(),
                        sizes,
                        cols.flatten().to_numpy().astype(np.int64),
                        part.column(3).flatten().to_numpy(),
                    )
                )
                postings += int(sizes.sum())
                if postings >= _SHARD_POSTINGS:
                    flush()
                    postings = 0
        if held:
            flush()
        for name, b in zip(names, best):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(b.ids), kind_arrow), pa.array(b.ids), pa.array(b.scores)],
                    names=["item_id", "doc_id", "score"],
                )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = pairs.schema["item_id"].dataType
    kind_arrow = to_arrow_type(kind)
    found = counted.filter("n > 0").mapInArrow(scan, f"item_id {kind.simpleString()}, doc_id long, score long")
    found = stored(found, "found", False)
    discard(counted)
    ranked = top_per_key(found, ["item_id"], [F.desc("score"), "doc_id"], k, "rank")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
