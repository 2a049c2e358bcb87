"""Sharding, ranked search and periodic runs against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import CLASH, DOC, empty, sample_texts

ODD = [(None, "a b"), (None, None), (7, "again again"), (7, "again again")]


def documents(spark, texts):
    rows = [(i, t, None, "s", 0) for i, t in texts]
    return spark.createDataFrame(rows, DOC).repartition(3).withColumns({name: F.lit("z") for name in CLASH})


def odd_documents(spark, seed):
    """Odd texts, null ids, repeated rows, and further columns of clashing names."""
    texts = [(i, t) for i, t in sample_texts(seed) if i != 7] + ODD
    return texts, documents(spark, texts)


# -- sharding ----------------------------------------------------------------
def test_shards_on_odd_rows(spark):
    from tallywarden.llm.sharding import Shard, Tree, sharded

    texts, df = odd_documents(spark, 3)
    tree = Tree.even(4, 2, 2)
    got = sharded(df, tree, tree.grown([Shard(0, 0, 16)]), digits=1).collect()
    raw = [(i, (t or "").encode()) for i, t in texts]
    want = Counter((i, len(r) + 1, zlib.crc32(r)) for i, r in raw)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, of = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharded(empty(spark), tree, tree).count() == 0


def test_many_copies_of_a_row_take_a_slot_each(spark):
    from tallywarden.llm.sharding import Tree, sharded

    df = spark.range(9000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    got = sharded(df, Tree.even(1, 1, 2), Tree.even(1, 1, 2)).agg(
        F.count("*"), F.countDistinct("slot"), F.min("slot"), F.max("slot"), F.countDistinct("shard")
    )
    assert tuple(got.first()) == (9000, 9000, 0, 8999, 1)


def test_weights_and_movement(spark):
    from tallywarden.llm.sharding import Shard, Tree, placed

    ids = spark.range(40_000).withColumnRenamed("id", "shard_id")
    shards = (Shard(0, 0, 0), Shard(0, 0, 1, 3.0), Shard(0, 1, 2), Shard(1, 0, 3, 2.0), Shard(1, 1, 4, 0.0))
    tree = Tree(shards)
    once = tree.grown([Shard(1, 0, 5, 1.0)])
    twice = once.grown([Shard(0, 0, 6, 1.5), Shard(0, 1, 7, 0.5)])
    changed = tree.reweighted(0, 4.0)
    df = ids
    for name, t in (("t", tree), ("once", once), ("twice", twice), ("changed", changed)):
        df = placed(df, F.col("shard_id"), t, name)
    rows = df.collect()
    for name, t in (("t", tree), ("once", once), ("twice", twice), ("changed", changed)):
        share, total = Counter(r[name] for r in rows), sum(s.weight for s in t.shards)
        for s in t.shards:
            mean = 40_000 * s.weight / total
            assert abs(share[s.shard] - mean) <= 5 * math.sqrt(mean + 1)
    assert {r.once for r in rows if r.once != r.t} == {5}
    assert {r.twice for r in rows if r.twice != r.once} == {6, 7}
    # A heavier shard: rows move inside its region or into it, never between others.
    region = {s.shard: s.region for s in shards}
    moved = {(region[r.t], region[r.changed]) for r in rows if r.t != r.changed}
    assert moved == {(1, 0), (0, 0)}
    # Inside it, from its siblings to it; from other racks into its rack.
    assert {(r.t, r.changed) for r in rows if region[r.t] == 0 and r.changed != r.t} == {(1, 0), (2, 0), (2, 1)}
    with pytest.raises(ValueError):
        tree.grown([Shard(0, 0, 3)])
    with pytest.raises(ValueError):
        placed(ids, F.col("shard_id"), tree.reweighted(0, 0).reweighted(1, 0).reweighted(2, 0).reweighted(3, 0))


def test_shard_files_hold_all_rows(spark, tmp_path):
    from tallywarden.llm.sharding import Tree, placed, write_shards

    _, df = odd_documents(spark, 4)
    df = df.drop("shard")
    write_shards(df, Tree.even(2, 2, 2), str(tmp_path / "out"), files=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = placed(df, F.col("doc_id"), Tree.even(2, 2, 2))
    assert back.select(*want.columns).exceptAll(want).count() == 0
    assert back.count() == df.count()


# -- ranked search -----------------------------------------------------------
def _terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _ranked(texts, items, k=10):
    docs = {i: _terms(t) for i, t in texts if i is not None}
    docs = {i: ts for i, ts in docs.items() if ts}
    n, total = len(docs), sum(map(len, docs.values()))
    df = Counter(t for ts in docs.values() for t in set(ts))
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(_terms(t))
    out = {}
    for item, ts in asked.items():
        scores = []
        for doc, words in docs.items():
            tf, m = Counter(words), 10 + 90 * len(words) * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in ts
                if tf[t]
            )
            if s > 0:
                scores.append((-s, doc))
        for rank, (s, doc) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (doc, -s)
    return out


def _search_texts(seed, n=700):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "x1", "The"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda: " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))
    base = [(3 * i, text()) for i in range(n)]
    copies = [(3 * i + 1, base[5][1]) for i in range(40)]  # ties around any place
    return base + copies, [(f"q{i}", text().replace(" ", ". ")) for i in range(25)]


def test_search_equals_brute_force(spark, monkeypatch):
    from tallywarden.llm import lexical

    texts, items = _search_texts(1)
    texts = [(i, t) for i, t in texts if i not in (0, 3)] + [(0, None), (3, " . "), (None, "w1"), (6, dict(texts)[6]), (9000, "w1 " * 50_000)]
    items += [("none", None), ("blank", "--"), (None, "w1"), ("q1", "w59"), ("miss", "nowhere"), ("copy", dict(texts)[15])]
    df = documents(spark, texts).withColumns({"n_": F.lit(1), "term": F.lit("t"), "score": F.lit(0)})
    asked = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit("z"))
    want = _ranked(texts, items)
    for limit in (1 << 20, 400):  # all items together, and in several groups
        monkeypatch.setattr(lexical, "_ITEM_TERMS", limit)
        got = lexical.search(df, asked).collect()
        assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == want
        assert len(got) == len(want)
    assert lexical.search(empty(spark), asked).count() == 0
    assert lexical.search(df, asked.limit(0)).count() == 0


def test_blocks_are_skipped_only_by_bounds():
    from tallywarden.llm.lexical import Best, Shard

    rng = np.random.default_rng(2)
    size, n = 40, 3000
    centre = rng.random((12, size)) < 0.15
    rows = [np.flatnonzero(centre[i % 12] ^ (rng.random(size) < 0.03)) for i in range(n)]
    vals = [rng.integers(1, 50, len(r)) for r in rows]
    ids = rng.permutation(n) * 2
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    asked = [np.sort(rng.choice(size, 6, replace=False)) for _ in range(30)]
    together = [np.unique(np.concatenate([a for a in asked if t in a] or [np.array([t])])) for t in range(size)]
    shard = Shard(ids, indptr, np.concatenate(rows), np.concatenate(vals), size, together, block=32)
    dense = np.zeros((n, size), np.int64)
    for d, (r, v) in enumerate(zip(rows, vals)):
        dense[d, r] = v
    for a in asked:
        best = Best(10)
        shard.search(a, best)
        score = dense[:, a].sum(1)
        want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if s > 0)[:10]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want
    held = sum(int((dense[:, a].sum(1) > 0).sum()) for a in asked)
    assert shard.skipped > 0 and shard.scored < held  # blocks were left out
    for t, (lists, most, least) in shard.blocks.items():
        assert sorted(np.concatenate(lists).tolist()) == np.flatnonzero(dense[:, t]).tolist()
        for docs, top, first in zip(lists, most, least):
            assert (top == dense[docs][:, together[t]].max(0)).all() and first == ids[docs].min()


# -- periodic runs -----------------------------------------------------------
def _runs(ws, least_length=6, least_periods=4):
    n, best = len(ws), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and ws[i] == ws[i + q]:
                i += 1
            if i + q - s >= max(least_length, least_periods * q):
                best.setdefault((s, i + q - s), q)
    return sorted((s, length, q) for (s, length), q in best.items())


def _collapsed(ws, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(ws) if k not in gone)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _fibonacci(n):
    a, b = "b", "a"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b[:n])


def periodic_texts(seed, n=250):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        letters = "abcdé"[: rng.randint(1, 5)]
        ws = []
        while len(ws) < rng.randint(1, 80):
            some = rng.choices(letters, k=rng.randint(1, 6))
            ws += some * rng.choice([1, 1, 1, 2, 4, 5, 9])
            ws += rng.choices(letters, k=rng.randint(0, 4))
        out.append("  ".join(ws) if rng.random() < 0.2 else " ".join(ws))
    out += [_fibonacci(700), "x " * 4000, "x y " * 900 + "x", " ".join(["a", "a", "b"] * 40 + ["a"] * 30), "a" * 5000]
    return out + [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "A a A a", "a a a a"]


def test_runs_equal_brute_force(spark):
    from tallywarden.llm.periodic import periodic_runs

    texts = list(enumerate(periodic_texts(5))) + [(None, "b b b b b b b"), (3, "z z z z z z"), (3, "z z z z z z")]
    df = documents(spark, texts).withColumns({"runs": F.lit(1), "n_words": F.lit("q")})
    got = periodic_runs(df).collect()
    assert len(got) == len(texts)
    seen = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got)
    want = Counter()
    for i, t in texts:
        ws = _words(t)
        found = _runs(ws)
        want[i, len(ws), tuple(found), _collapsed(ws, found)] += 1
    assert seen == want
    assert periodic_runs(empty(spark)).count() == 0
    text_ids = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert periodic_runs(text_ids).count() == len(texts)


@pytest.mark.parametrize("least", [(1, 2), (2, 2), (6, 3), (6, 4), (9, 5)])
def test_runs_of_other_limits(least):
    from tallywarden.llm.periodic import _of_block

    texts = [t.encode() for t in periodic_texts(8, 120) if t and len(t) < 2000]
    for text, (n, found, kept) in zip(texts, _of_block(texts, *least)):
        ws = _words(text.decode())
        want = _runs(ws, *least)
        assert (n, found, kept.decode()) == (len(ws), want, _collapsed(ws, want))


def test_suffix_array_and_lcp():
    from tallywarden.llm.periodic import neighbour_lcp, suffix_ranks

    rng = np.random.default_rng(4)
    for size, letters in ((200, 2), (300, 1), (257, 4)):
        names = rng.integers(0, letters, size)
        ends = np.full(size, size)
        order, rank, levels = suffix_ranks(names, ends)
        text = names.tolist()
        assert order.tolist() == sorted(range(size), key=lambda i: text[i:])
        assert (rank[order] == np.arange(size)).all()
        lcp = neighbour_lcp(order, levels)
        for a, b, got in zip(order[:-1], order[1:], lcp[1:].tolist()):
            k = 0
            while max(a, b) + k < size and text[a + k] == text[b + k]:
                k += 1
            assert got == k


def test_run_report_equals_brute_force(spark, tmp_path):
    from tallywarden.llm.queries import QUERIES

    texts = dict(enumerate(periodic_texts(6))) | {1000 + i: " ".join(random.Random(i).choices("pqrstuv", k=60)) for i in range(120)}
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()] + [(None, "u v w x y z", "en", "s", 0)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, t in [*texts.items(), (None, "u v w x y z")]:
        ws, h = _words(t), zlib.crc32(("" if i is None else str(i)).encode())
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
        found = _runs(ws)
        best = min(((-m, s, q) for s, m, q in found), default=None)
        r = got[i]
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r.start, r.length, r.period, r.exponent_milli) == want and r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(_collapsed(ws, found).encode()).hexdigest()
    assert planted > 10


