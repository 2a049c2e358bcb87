"""Similarity join on word shingles: adaptive prefixes with several matches.

Two sets of sizes x and y whose Jaccard similarity reaches t share at least
``ceil(t * size)`` shingles of either. In one order of all shingles, then, the
first ``x - ceil(t x) + l`` of the one and ``y - ceil(t y) + l`` of the other
have at least ``l`` in common, for any ``l`` up to that overlap. A longer prefix
is read more often but lets fewer pairs through. Each document chooses its own
``l`` by estimated cost; a pair must share ``min`` of its two.

* **Order.** Rare shingles first. How often one occurs is read from a sketch of
  2^20 counters over all documents; any order is right, so the sketch only
  decides speed.
* **Places.** Up to a shared shingle two sets can share only what both have in
  lists before it, beyond it only what either has left. A place that leaves too
  little for any partner is dropped before anything is paired: that takes a copy
  with too many shingles of its own out of its group. For pairs the same holds
  with both places.
* **Equal sets are one.** Documents with the same set are a class; each task sends
  one of them to the join.
* **No pairs within a group.** Only whether two documents are connected is
  asked. In the first round each document is compared with one centre of its prefix
  lists, the document whose prefix is shared most; in later rounds those in long
  lists are compared with several. What that connects is contracted and lists that
  hold one component only are dropped. In the end pairs are made between different
  components. Shingles that stand in the prefixes of the same documents, as those of a
  passage do, are one list then.
* **Parities.** A set's shingles fall into 2048 cells by hash. Where one set has an odd
  number in a cell and the other an even one, some shingle is in one of them only, so
  the number of such cells bounds the overlap from above. A pair that meets in a list
  is made only if that leaves it enough.
* **Shared tokens.** In the end it is known how many tokens two prefixes share.
  What else two sets share lies after the last shared token, and after the end of
  one of the prefixes. Pairs that this leaves too little are not verified.
* Shared folders hold the sets of documents that have a candidate; verification
  is exact on 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.common import blocks, bucketed, discard, drop_bucketed, stored, summed_arrays
from tallywarden.llm.components import components
from tallywarden.llm.suffixes import Powers, mixed

_U = np.uint64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SKETCH_BITS = 20
_SKETCH = 1 << _SKETCH_BITS
_COUNTER = _U(64 - _SKETCH_BITS)  # a shingle's counter: its hash shifted by this
_VERIFY_COST = 64.0  # reading a posting costs 1
_FEWER = 0.7  # share of the documents with l shingles in common that have l + 1
_MOST = 31  # longest l tried
_PACK = 32  # above it
_STARS = 3  # rounds of comparing with centres
_CENTRES = 8  # compared with in rounds after the first
_LONG = 32  # lists of more postings take part in those rounds
_FEW = 1000  # a round that links fewer than one in so many documents is the last
_CELLS = 2048  # of which a set's parities are kept
_MARKS = 1 << 24  # bits that tell which documents may be wanted


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _sets_of_block(raws: list[bytes], width: int, powers: Powers) -> list[np.ndarray]:
    joined = b" ".join(raws).translate(LOWER)
    a = np.frombuffer(joined, np.uint8)
    powers.upto(len(a) + 1)
    sums = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * powers.up[: len(a)], out=sums[1:])
    word = ~_SPACE[a]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w = mixed((sums[end] - sums[start]) * powers.down[start] + (end - start).astype(_U))
    x = np.full(max(0, len(w) - width + 1), width, _U)
    for j in range(width):
        x *= _U(0x9E3779B97F4A7C15)
        x += w[j : j + len(x)]
        x ^= x >> _U(29)
    x = mixed(x)
    limits = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    out = []
    for lo, hi in zip(limits.tolist(), limits[1:].tolist()):
        if hi - lo >= width:
            own = np.sort(x[lo : hi - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif hi > lo:
            h = hi - lo  # all words as one, told apart by their number
            for v in w[lo:hi].tolist():
                h = (h * 0x9E3779B97F4A7C15 + v) % 2**64
                h ^= h >> 29
            out.append(mixed(np.array([h], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def shingle_sets(texts, width: int, powers: Powers) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lowered, ASCII spaces)."""
    raws = [x.as_py() or b"" for x in texts]
    for lo, hi in blocks([len(r) for r in raws]):
        yield from _sets_of_block(raws[lo:hi], width, powers)


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def adaptive_prefix(x: np.ndarray, level: np.ndarray, percent: int, floor: float) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set and its ``l``. ``level`` holds, per counter, the
    logarithm of how often its shingles occur beyond chance; up to ``floor``
    occurrences stay hidden in it."""
    n = len(x)
    own = level[(x >> _COUNTER).astype(np.int64)]
    first = prefix_length(n, percent)
    most = min(_MOST, n - first + 1)
    order = np.argsort(own, kind="stable")  # x is sorted: (level, hash)
    often = np.exp2(own[order[: first + most - 1]].astype(np.float64)) + floor
    # With l matches asked for, at most as many documents pass as the l-th longest
    # list holds, and of those that share one shingle fewer share more.
    reads = often[:first].sum() + np.concatenate([[0], np.cumsum(often[first:])])
    passes = np.sort(often)[::-1][:most] * _FEWER ** np.arange(most)
    chosen = int(np.argmin(reads + _VERIFY_COST * passes)) + 1
    return x[order[: first + chosen - 1]], chosen


def _signs(x: np.ndarray) -> tuple[int, int]:
    return int(x.sum(dtype=_U)), int((x * (x >> _U(7))).sum(dtype=_U))


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per document the size and a 128-bit signature of its set; per task, in a
    row of its own, the counters of its shingles."""
    names = ["doc_id", "n", "s1", "s2", "counts"]

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        powers, counts = Powers(), np.zeros(_SKETCH)
        for batch in batches:
            ns, s1, s2 = [], [], []
            for x in shingle_sets(batch.column(1), width, powers):
                np.add.at(counts, (x >> _COUNTER).astype(np.int64), 1.0)
                ns.append(len(x))
                for column, sign in zip((s1, s2), _signs(x)):
                    column.append(sign)
            signs = [pa.array(np.array(c, _U).view(np.int64)) for c in (s1, s2)]
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *signs, none], names=names)
        last = [pa.array([None], pa.int64()), *(pa.array([0], pa.int64()) for _ in range(3))]
        yield pa.RecordBatch.from_arrays([*last, pa.array([counts.tobytes()], pa.binary())], names=names)

    return docs.mapInArrow(scan, "doc_id long, n long, s1 long, s2 long, counts binary")


def _prefixes(docs: DataFrame, width: int, percent: int, level: np.ndarray, floor: float) -> DataFrame:
    """``doc``, ``size`` (its set's size and ``l`` in one number) and ``tokens``;
    of equal sets in a task the first only."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        powers, seen = Powers(), set()
        for batch in batches:
            ids, sizes, tokens = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width, powers)):
                if len(x) and (sign := (len(x), *_signs(x))) not in seen:
                    seen.add(sign)
                    p, l = adaptive_prefix(x, level, percent, floor)
                    ids.append(i)
                    sizes.append(len(x) * _PACK + l)
                    tokens.append(p.view(np.int64))
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc", "size", "tokens"],
            )

    return docs.mapInArrow(scan, "doc long, size long, tokens array<long>")


def parities(x: np.ndarray) -> np.ndarray:
    """Whether the number of a set's shingles in each cell is odd, as bits of longs."""
    odd = np.bincount((x & _U(_CELLS - 1)).astype(np.int64), minlength=_CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The sets of some documents, their sizes and parities, read from the texts again.

    Which documents are wanted is known to all tasks from a bit by hash of the id, so
    texts stay where they are; some sets that nobody asked for come along.
    """
    mark = F.pmod(F.xxhash64("doc"), F.lit(_MARKS))
    bit = F.expr("shiftleft(1L, CAST(mark % 64 AS INT))")
    words = wanted.select(mark.alias("mark")).groupBy(F.floor(F.col("mark") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found, marks = words.toPandas(), np.zeros(_MARKS // 64, np.int64)
    marks[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((marks[at // 64] >> (at % 64)) & 1 == 1))
            sets = list(shingle_sets(batch.column(1), width, powers))
            ends = np.arange(len(sets) + 1, dtype=np.int32) * (_CELLS // 64)
            odd = np.concatenate([parities(x) for x in sets]) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(odd)), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["doc", "n", "odd", "shingles"],
            )

    marked = docs.select(F.col("doc_id").alias("doc"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(_MARKS)).alias("mark"))
    return marked.mapInArrow(scan, "doc long, n long, odd array<long>, shingles binary")


def _with_places(postings: DataFrame, percent: int) -> DataFrame:
    """``postings`` that may be shared with a similar set, with ``before`` (postings
    of the document before this one) and ``after`` (shingles of its set after it).

    A similar set holds ``percent`` of this one. What both share up to a common
    shingle is in both prefixes, so in postings; the rest lies after it.
    """
    n = F.floor(F.col("size") / _PACK)
    places = postings.withColumns(
        {"before": F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1, "after": n - F.col("at") - 1}
    )
    return places.filter(100 * (F.col("before") + 1 + F.col("after")) >= percent * n)


def _enough(na: Column, nb: Column, percent: int) -> Column:
    """Whether places in both sets leave as many common shingles as a link takes."""
    most = F.least("before", "before_b") + 1 + F.least("after", "after_b")
    return (100 + percent) * most >= percent * (na + nb)


def _alike(na: Column, nb: Column, odd: str, odd_b: str, percent: int) -> Column:
    """Whether parities leave as many common shingles as a link takes: both sets hold
    all but ``(100 - percent) / (100 + percent)`` of their shingles in common."""
    apart = sum(F.bit_count(F.col(odd)[i].bitwiseXOR(F.col(odd_b)[i])) for i in range(_CELLS // 64))
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


def _rest(size: Column, percent: int) -> Column:
    """How many shingles of a set are not in its prefix."""
    return F.ceil(F.floor(size / _PACK) * percent / 100) - size % _PACK


def _centres(current: DataFrame, turn: int) -> DataFrame:
    """Per list of several components its centres: ``token``, ``centre`` and the
    centre's component ``its``. The first round takes the document whose prefix
    is shared most, later ones the best of each of several classes by hash, and
    only in long lists: a short one has few pairs."""
    best = F.struct((-F.col("fame")).alias("r"), F.col("doc").alias("centre"), F.col("component").alias("its"))
    if turn == 0:
        of = [F.min(best)]
    else:
        kind = F.pmod(F.xxhash64("doc", F.lit(turn)), F.lit(_CENTRES))
        of = [F.min(F.when(kind == j, best)) for j in range(_CENTRES)]
    lists = current.groupBy("token").agg(
        F.array(*of).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")
    )
    lists = lists.filter((F.col("lo") != F.col("hi")) & (F.col("n") > (_LONG if turn else 0)))
    return lists.select("token", F.explode("c").alias("c")).filter("c IS NOT NULL").select("token", "c.centre", "c.its")


def _in_mixed_lists(current: DataFrame) -> DataFrame:
    """Postings of lists that hold several components; the table given is dropped."""
    tokens = current.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    tokens = stored(tokens.filter("lo != hi").select("token"), "lists")
    kept = stored(current.join(tokens, "token", "left_semi"), "postings")
    discard(tokens, current)
    return kept


def _merged_lists(current: DataFrame) -> DataFrame:
    """``token`` of every list that holds several components, and ``weight``: of
    lists of the same documents the one latest in order stands for all, with their
    number; the others have 0. What is equal is told by number, ends and a 64-bit hash."""
    mark = F.xxhash64("doc")
    lists = current.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"),
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.sum("at").alias("place"),
        F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s1"), F.sum(F.shiftrightunsigned(mark, 32)).alias("s2"),
    )
    lists = lists.filter("lo != hi").drop("lo", "hi")
    # All documents hold their tokens in one order, so places in them add up in it too.
    same = lists.groupBy("n", "low", "high", "s1", "s2").agg(
        F.max_by("token", "place").alias("token"), F.count("*").alias("weight")
    )
    tokens = lists.select("token", F.lit(0).cast("long").alias("weight")).union(same.select("token", "weight"))
    return tokens.groupBy("token").agg(F.max("weight").alias("weight"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a table that is dropped here, whose sets are similar."""

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    # The sets lie in buckets, so only pairs move. One document may stand in very
    # many pairs, as a centre does: its set is joined from a table of its own,
    # both sides dealt out, which Spark can split.
    with_b = pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
    firsts = sets.join(pairs.select(F.col("a").alias("doc")).distinct(), "doc", "left_semi")
    firsts = stored(firsts.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "sets")
    with_a = with_b.join(firsts, "a")
    found = stored(with_a.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")
    discard(firsts, pairs)
    return found


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``: the smallest document
    reachable over links, a link being two documents whose sets of ``width``-word
    shingles have ``100 * intersection >= percent * union``.

    A text of fewer words is one shingle; null, empty and blank texts have none
    and are linked with nothing. Rows without ``doc_id`` take no part; repeated
    rows count once each in the result, as copies. Other columns are ignored.
    """
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    scanned = stored(_signatures(docs, width), "signatures")
    counts = summed_arrays(scanned.filter("counts IS NOT NULL").select("counts"))
    if counts is None:
        counts = np.zeros(_SKETCH)
    chance = counts.mean()
    floor = 1 + 4 * float(np.sqrt(chance))
    level = np.ceil(np.log2(1 + np.maximum(0, counts - chance - floor))).astype(np.uint8)

    sizes = scanned.filter("counts IS NULL").drop("counts")
    classes = stored(sizes.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class")), "classes")
    member = stored(
        sizes.filter("n > 0").join(classes, ["n", "s1", "s2"]).select("doc_id", "n", "class")
        .union(sizes.filter("n = 0").select("doc_id", "n", "doc_id")),
        "members",
    )
    discard(scanned, classes)

    prefixes = stored(_prefixes(docs, width, percent, level, floor), "prefixes")
    postings = prefixes.select(F.posexplode("tokens").alias("at", "token"), "doc", "size")
    lists = postings.groupBy("token").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("df"), F.min(F.col("size") % _PACK).alias("l")
    )
    lists = stored(lists.filter("low != high").select("token", "df", "l"), "lists")
    named = stored(postings.join(lists, "token"), "postings")
    discard(prefixes, lists)
    # A document can have a partner only if enough of its prefix occurs elsewhere:
    # as many tokens as the least l in its lists, since a pair shares the min of two.
    own = Window.partitionBy("doc")
    # Tokens of its own fill a document's prefix and are in no list: they lower its fame.
    n = F.floor(F.col("size") / _PACK)
    fame = F.sum("df").over(own) / (n - _rest(F.col("size"), percent))
    facts = {"k": F.count("*").over(own), "least": F.min("l").over(own), "fame": fame}
    first = _with_places(named, percent).withColumns(facts).filter("k >= least")
    current = stored(first.select("token", "doc", "at", "size", "fame", F.col("doc").alias("component")), "postings")
    discard(named)
    sets = bucketed(_sets(docs, current.select("doc").distinct(), width), "doc", "sets")
    many, facts = sets.count(), sets.select("doc", "n", "odd").distinct()

    links = None
    for turn in range(_STARS):
        centres = stored(_centres(current, turn), "lists")
        shared = current.join(centres, "token").filter("component != its").groupBy("doc", "centre").agg(
            F.count("*").alias("k"), F.first("size").alias("size")
        )
        enough = shared.filter(F.col("k") >= F.col("size") % _PACK)
        place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("k"), "centre"))
        best = enough.withColumn("place", place).filter(F.col("place") <= (_CENTRES if turn else 1))
        pairs = best.select(F.col("centre").alias("a"), F.col("doc").alias("b"))
        pairs = pairs.join(facts.toDF("b", "nb", "odd_b"), "b").join(facts.toDF("a", "na", "odd"), "a")
        pairs = pairs.filter(_alike(F.col("na"), F.col("nb"), "odd", "odd_b", percent)).select("a", "b")
        found = _linked(stored(pairs, "pairs"), sets, percent)
        links = found if links is None else links.union(found)
        # Two rounds name nearly all of a star alike; what they miss is left to pairs.
        parts_ = components(links, rounds=2)
        near = parts_.withColumnRenamed("node", "doc").groupBy("doc").agg(F.min("component").alias("component"))
        near = stored(near, "components")
        kept = current.drop("component").join(near, "doc", "left")
        former, current = current, stored(kept.withColumn("component", F.coalesce("component", "doc")), "postings")
        discard(parts_, near, former, centres)
        if _FEW * found.count() < many:
            break
        current = _in_mixed_lists(current)

    # What stars left: lists that still hold several components. Places are taken
    # before lists are merged; of the last shared token, which alone bounds most,
    # the list stays.
    lists = stored(_merged_lists(current), "lists")
    rest = _with_places(current.join(lists, "token"), percent).filter("weight > 0")
    rest = rest.join(facts.select("doc", "odd"), "doc")
    rest = stored(rest.select("token", "doc", "size", "component", "before", "after", "weight", "odd"), "postings")
    discard(lists, current)
    x = rest.withColumnsRenamed({"doc": "a", "size": "sa", "component": "ca"})
    y = rest.drop("weight").toDF("token", "b", "sb", "cb", "before_b", "after_b", "odd_b")
    na, nb = F.floor(F.col("sa") / _PACK), F.floor(F.col("sb") / _PACK)
    met = x.join(y, "token").filter(
        (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _enough(na, nb, percent)
        & _alike(na, nb, "odd", "odd_b", percent)
    )
    met = met.groupBy("a", "b", "sa", "sb").agg(
        F.sum("weight").alias("k"), F.min(F.least("after", "after_b")).alias("behind")
    )
    beyond = F.least("behind", F.greatest(_rest(F.col("sa"), percent), _rest(F.col("sb"), percent)))
    pairs = met.filter((100 + percent) * (F.col("k") + beyond) >= percent * (na + nb)).select("a", "b")
    pairs = stored(pairs, "pairs")
    discard(rest)
    more = _linked(pairs, sets, percent)
    drop_bucketed(sets)
    # Links hold the first document of a class in some task: named by class now.
    of = member.select(F.col("doc_id").alias("a"), F.col("class").alias("ca")).distinct()
    named_ = links.union(more).join(of, "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    whole = components(named_).withColumnRenamed("node", "class").withColumnRenamed("component", "c")
    return member.join(whole, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "class").alias("component_id")
    )
