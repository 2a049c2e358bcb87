"""Every operator on small rows: against brute force, and on odd rows.

Odd rows are nulls in any column, empty and long texts, repeated rows, empty
tables, and further columns whose names clash with those used inside.
"""

import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "start n m g seg k h pos ws token doc size class x y a b u v fold raw at kept spans items c".split()


def documents(spark, texts, clash=False):
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    return df.withColumns({name: F.lit("z") for name in CLASH}) if clash else df


def sample_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["le", "the", "of", "é", "Ab", "xyz", "one", "two", "three.", "four,"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(6)]
    out = []
    for i in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((i, " ".join(t) + rng.choice(["", "", "\n" + rng.choice(base)])))
    return out + [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "one"), (n + 4, "one"), (n + 5, "ab " * 30_000)]


def empty(spark):
    return spark.createDataFrame([], DOC)


# -- 1 ---------------------------------------------------------------------
def test_top_k_is_exact(spark):
    from tallywarden.llm.topk import top_k

    rng = np.random.default_rng(1)
    v = {i: rng.integers(-40, 40, 13).tolist() for i in range(300)}
    v[7] = v[8] = v[9]
    v[11] = [10**9] * 13  # sums beyond 2^52
    rows = list(v.items()) + [(9, v[9]), (None, [1]), (500, None), (501, []), (502, [3, 1])]
    for scale in (1, 10**6):
        data = [(i, None if x is None else [scale * y for y in x] if i != 11 else x) for i, x in rows]
        df = spark.createDataFrame(data, "vec_id long, v array<long>")
        got = top_k(df.filter("vec_id % 10 = 0 OR vec_id = 9"), df, k=5, dims=4, query_block=16, candidate_block=64)
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
        known = {i: x for i, x in data if i is not None and x is not None}
        want = {}
        for q in [i for i in known if i % 10 == 0 or i == 9]:
            best = sorted((-sum(a * b for a, b in zip(known[q], known[c])), c) for c in known if c != q)[:5]
            want.update({(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)})
        assert got == want
    none = spark.createDataFrame([], "vec_id long, v array<long>")
    assert top_k(none, none).count() == 0


# -- 2 ---------------------------------------------------------------------
def repeats(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        out[i] = bytes(b for b, g in zip(raw, gone) if not g)
    return out


@pytest.mark.parametrize("length,first", [(100, 25), (16, 5), (7, 7)])
def test_repeated_bytes_are_removed(spark, length, first):
    from tallywarden.llm.suffixes import without_repeats

    texts = sample_texts(length, 40) + [(900, "aaaa" * 200), (901, "é" * 150)]
    got = without_repeats(documents(spark, texts, clash=True), length, first)
    assert {r.doc_id: bytes(r.kept) for r in got.collect()} == repeats(texts, length)


def test_no_documents_no_repeats(spark):
    from tallywarden.llm.suffixes import without_repeats

    assert without_repeats(empty(spark)).count() == 0


# -- 3 ---------------------------------------------------------------------
def test_quality_is_learnt(spark):
    from tallywarden.llm.quality import isotonic, quality_scores

    rng = random.Random(4)
    texts = [
        (i, " ".join(rng.choice(["WIN!!", "$$$", "CASH###"] if i % 3 == 0 else ["the", "house", "was", "green."]) for _ in range(rng.randint(5, 80))))
        for i in range(600)
    ]
    texts += [(1000, None), (1001, ""), (1002, "x" * 200_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "z") for i in range(600)] + [(None, 1, "z"), (5, None, "z"), (7777, 1, "z")], "doc_id long, quality int, text string")
    odd = spark.createDataFrame([(8, float("nan"), "z"), (9, None, "z")], "doc_id long, quality double, text string")
    labels = labels.withColumn("quality", F.col("quality").cast("double")).unionAll(odd)
    rows = quality_scores(documents(spark, texts, clash=True), labels).collect()
    assert len(rows) == 603 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 100 and all(r.predicted == (r.doc_id % 3 > 0) for r in held)
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(y) == [0.0, 0.5, 1.0] and list(x) == [0.0, 1.5, 3.0]
    assert quality_scores(empty(spark), labels).count() == 0
    assert {r.predicted for r in quality_scores(documents(spark, texts[:3]), labels.limit(0)).collect()} == {1}


# -- 4 ---------------------------------------------------------------------
def test_decontamination(spark):
    from tallywarden.llm.decontaminate import decontaminate, without_contaminated

    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu."
    bench = spark.createDataFrame([(1, item, "z"), (2, "short one", "z"), (10, "SHORT-ONE", "z"), (3, None, "z"), (4, "...", "z")], "item_id long, text string, doc_id string")
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [(0, f"x {ten} y"), (1, ten.upper().replace(" ", "--") + " lambda"), (2, ten[6:]), (3, "a short, one short one"), (4, None), (5, ""), (6, "é " * 20_000 + item)]
    got = {r.doc_id: r for r in decontaminate(documents(spark, texts, clash=True), bench).collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i]["items"]) for i in range(7)] == [
        (12, 10, ["1"]), (11, 11, ["1"]), (9, 0, []), (5, 4, ["10", "2"]), (0, 0, []), (0, 0, []), (20_012, 12, ["1"])
    ]
    assert [tuple(s) for s in got[3]["spans"]] == [(1, 5)]
    assert sorted(r.doc_id for r in without_contaminated(documents(spark, texts), bench).collect()) == [2, 4, 5]
    assert decontaminate(empty(spark), bench).count() == 0
    assert decontaminate(documents(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_of_many_hits_and_odd_rows(spark, monkeypatch):
    from tallywarden.llm import decontaminate as dc

    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 6, 9])))) for k in range(30)] + [(None, "w1"), ("i0", "w2 w3")]
    texts = [(str(i), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)]
    texts += [("5", texts[5][1]), (None, "w1 w2"), ("null", None), ("many", "pad pad w2 w3 pad " * 5_000)]
    df = spark.createDataFrame(texts, "doc_id string, text string").repartition(3).withColumns({c: F.lit("z") for c in ("pos", "n", "h", "ws", "of")})
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("window", F.lit(1))
    want = {}
    for i, t in texts:
        if i is not None:
            ws, hit, of = (t or "").split(), set(), set()
            for item, words_ in [(k, x.split()) for k, x in items if k is not None]:
                n = min(4, len(words_))
                for a in range(len(words_) - n + 1):
                    for p in range(len(ws) - n + 1) if i != "many" or words_[a : a + n] == ["w2", "w3"] or n < 3 else ():
                        if ws[p : p + n] == words_[a : a + n]:
                            hit |= set(range(p, p + n))
                            of.add(item)
            want[i] = (len(ws), len(hit), sorted(of), hit)
    for most in (200_000, 0):  # windows broadcast, windows joined
        monkeypatch.setattr(dc, "_BROADCAST_ROWS", most)
        got = dc.decontaminate(df, bench, size=4).collect()
        assert len(got) == len(want)
        for r in got:
            n, n_hit, of, hit = want[r.doc_id]
            assert (r.n_words, r.n_hit, r["items"]) == (n, n_hit, of)
            spans = [tuple(s) for s in r.spans]
            assert {k for a, b in spans for k in range(a, b)} == hit
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


# -- 5 ---------------------------------------------------------------------
def classes(texts, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("percent", [80, 40])
def test_similar_documents(spark, percent):
    from tallywarden.llm.jaccard import similar_documents

    texts = sample_texts(9, 120)
    got = similar_documents(documents(spark, texts, clash=True), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(texts, percent)
    assert similar_documents(empty(spark)).count() == 0


def test_similar_documents_long_lists(spark):
    """A group of copies, edited little to much, whose lists exceed ``_LONG``."""
    import random

    from tallywarden.llm import jaccard

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(4 * jaccard._LONG):
        words = list(base)
        for at in rng.sample(range(150), i % 8):
            words[at] = f"own{i}x{at}"
        texts.append((i, " ".join(words + [f"end{i}x{k}" for k in range(rng.randrange(12))])))
    got = jaccard.similar_documents(documents(spark, texts)).collect()
    want = classes(texts, 80)
    assert len({c for _, c in want.values()}) > 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_prefixes_keep_every_link():
    from tallywarden.llm.jaccard import _SKETCH, adaptive_prefix

    rng = np.random.default_rng(2)
    level = rng.integers(0, 6, _SKETCH).astype(np.uint8)
    for _ in range(200):
        whole = np.unique(rng.integers(0, 2**63, rng.integers(2, 300)).astype(np.uint64))
        x = np.sort(rng.permutation(whole)[: max(1, int(len(whole) * 0.95))])
        y = np.sort(rng.permutation(whole)[: max(1, int(len(whole) * 0.95))])
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            (px, lx), (py, ly) = adaptive_prefix(x, level, 80, 9.0), adaptive_prefix(y, level, 80, 9.0)
            assert len(np.intersect1d(px, py)) >= min(lx, ly)


def test_partner_with_a_smaller_l_is_found(spark, monkeypatch):
    from tallywarden.llm import jaccard
    from tallywarden.llm.suffixes import Powers

    # Similarity exactly 0.8. One asks for 14 shingles in common and the other for 10,
    # and the other's own shingles come first in the order, so prefixes share 10.
    a = " ".join(f"p{i}" for i in range(204))
    b = a + " " + " ".join(f"q{i}" for i in range(50))
    x, y = jaccard.shingle_sets([SimpleNamespace(as_py=t.encode) for t in (a, b)], 5, Powers())
    own = np.setdiff1d(y, x)

    def chosen(s, level, percent, floor):
        wanted = 14 if len(s) == 200 else 10
        order = np.argsort(~np.isin(s, own), kind="stable")
        return s[order[: jaccard.prefix_length(len(s), percent) + wanted - 1]], wanted

    shared = len(np.intersect1d(chosen(x, None, 80, 0)[0], chosen(y, None, 80, 0)[0]))
    assert (len(x), len(y), shared) == (200, 250, 10)
    monkeypatch.setattr(jaccard, "adaptive_prefix", chosen)
    got = jaccard.similar_documents(documents(spark, [(1, a), (2, b), (3, "else")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_groups_of_edited_copies(spark):
    """Copies with few to many edits, so that pairs lie on both sides of the threshold
    and places in the prefixes decide; a passage that all groups share; stray texts."""
    from tallywarden.llm.jaccard import similar_documents

    rng = random.Random(17)
    passage = [f"hot{i}" for i in range(60)]
    texts = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(rng.randint(90, 200))] + (passage if group else [])
        for copy in range(45):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [f"new{rng.random()}"], [words[at], f"new{rng.random()}"]])
            texts.append((len(texts) + 1, " ".join(words)))
    for _ in range(25):
        texts.append((len(texts) + 1, " ".join(passage[: rng.randint(30, 60)] + [f"own{rng.random()}" for _ in range(rng.randint(0, 20))])))
    rng.shuffle(texts)
    want = classes(texts, 80)
    assert 20 < len({c for _, c in want.values()}) < len(texts) - 20
    got = similar_documents(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_parities_bound_the_difference():
    from tallywarden.llm.jaccard import parities

    rng = np.random.default_rng(5)
    for n in (1, 40, 900, 5000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(n * 0.9)], rng.integers(0, 2**63, n // 7 + 1).astype(np.uint64)]))
        apart = sum(int(v).bit_count() for v in (parities(x) ^ parities(y)).view(np.uint64))
        assert 0 < apart <= len(np.setxor1d(x, y))


def test_a_shared_passage_is_one_list(spark, monkeypatch):
    """Texts that share a passage and are not alike meet in one list, and no pair is made."""
    from tallywarden.llm import jaccard

    passage = " ".join(f"hot{i}" for i in range(60))
    texts = [(i, passage + "".join(f" own{i}x{j}" for j in range(17 + i % 5))) for i in range(40)]
    texts.append((40, texts[7][1] + " end"))
    postings, pairs = [], []

    def kept(df, label, release=True, stored=jaccard.stored):
        out = stored(df, label, release)
        if label in ("postings", "pairs"):
            (postings if label == "postings" else pairs).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", kept)
    got = jaccard.similar_documents(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(texts, 80)
    assert postings[-1] <= 2 * len(texts) < postings[0]
    assert pairs[-1] == 0


def test_logs_of_scoring_are_those_of_training():
    from tallywarden.llm import recurrent

    rng = np.random.default_rng(8)
    shape = recurrent.Shape(101, 8, 11)
    flat = recurrent.start(shape, rng.integers(1, 50, 101).astype(float), 1)
    flat += rng.normal(0, 2, len(flat)).astype(np.float32)
    h = rng.normal(0, 1, (500, 8)).astype(np.float32)
    for target in (rng.integers(0, 101, 500), np.full(500, 100)):
        p = recurrent.unpack(flat, shape)
        assert np.allclose(recurrent._logs(h, target, p, shape), recurrent._outputs(h, target, p, shape), atol=1e-4)
    x = np.array([[-500, -30, -1, 0, 2, 40, 500]], np.float32)
    assert np.array_equal(recurrent._sigmoid(x), 1 / (1 + np.exp(-np.clip(x, -30, 30))))


def test_components_of_chains(spark):
    from tallywarden.llm.components import components

    rng = random.Random(6)
    ids = rng.sample(range(1000), 40)
    pairs = list(zip(ids[:25], ids[1:25])) + list(zip(ids[25:], ids[26:])) + [(ids[0], ids[0])]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: min(ids[:25]) for i in ids[:25]} | {i: min(ids[25:]) for i in ids[25:]}


# -- 6 ---------------------------------------------------------------------
def test_replies_are_ordered_without_quotes(spark):
    from tallywarden.llm.quotes import reply_order

    rows = [
        (1, 0, "u", "Hello there, how are you?\n\nSecond paragraph."),
        (1, 1, "a", "> hello THERE how are you\nFine."),
        (1, 2, "u", "On Monday X wrote:\n> Fine.\n>> Hello there, how are you?\nGood."),
        (1, 3, "a", "> nothing like it\nok"),
        (1, 4, "u", "> Second paragraph\nyes"),
        (2, 0, None, None), (2, 0, None, None), (2, 1, "x", ">"), (None, 1, "x", "y"), (3, 0, "u", "word " * 40_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("line", F.lit(2))
    got = {(r.conv_id, r.turn): r for r in reply_order(df).collect()}
    assert len(got) == 8
    facts = {k: (r.parent_turn, r.thread_turn, r.depth, r.position) for k, r in got.items() if k[0] == 1}
    assert facts == {
        (1, 0): (None, 0, 0, 1), (1, 1): (0, 0, 1, 2), (1, 2): (1, 0, 2, 3), (1, 4): (0, 0, 1, 4), (1, 3): (None, 3, 0, 5)
    }
    assert [got[1, t].text for t in (1, 2, 3, 4)] == ["Fine.", "Good.", "ok", "yes"]
    assert got[1, 2].n_quotes == 2 and got[2, 1].text == ""
    assert reply_order(df.limit(0)).count() == 0


def test_trimmed_quotations_find_their_message(spark):
    from tallywarden.llm.quotes import reply_order

    rows = [
        (1, 0, "u", "A1\nA2\nB1"), (1, 1, "a", "> A1\n> A2\ntrimmed"),
        (1, 2, "u", "P one.\n\nP two.\n\nP three."), (1, 3, "a", "> P one.\n>\n> P two.\nparagraphs"),
        (1, 4, "u", "> A1\nfirst\n> B1\ninterleaved"), (1, 5, "a", "A1\nelse"), (1, 6, "u", "> A1\n> A2\n> gone\nmost parts, not the latest"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r.parent_turn for r in reply_order(df).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: 2, 4: 0, 5: None, 6: 0}


# -- 7 ---------------------------------------------------------------------
def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tallywarden.llm.packing import packed, tokenized_pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["<|endoftext|> A<|ENDOFTEXT|>b", "don't DON'T x'S l'été ﬁ İ Σας.", " a c 中文。", "a.́ b,́ 12.5!!"]
    texts = sample_texts(3, 80) + [(200 + i, t) for i, t in enumerate(odd)]
    rows = packed(tokenized_pieces(documents(spark, texts, clash=True), path, 64), 64).collect()
    bins = {}
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(k, s, len(ids[s : s + 64])) for k, s in enumerate(range(0, len(ids), 64))]
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 64 + 1
    assert packed(tokenized_pieces(empty(spark), path)).count() == 0


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_plan_keeps_every_limit(select):
    from tallywarden.llm.packing import plan

    rng = random.Random(8)
    counts = Counter(rng.randint(1, 50) for _ in range(2000))
    rows, bins = plan(counts, 50, 4, 2500, select)
    filled: dict[int, list] = {}
    for length in counts:
        mine = [r for r in rows if r[0] == length]
        for item in range(counts[length]):
            r = [r for r in mine if r[1] <= item][-1]
            filled.setdefault(r[2] + (item - r[1]) // r[3], []).append((r[4] + (item - r[1]) % r[3] * length, length))
    assert len(filled) == bins
    for places in filled.values():
        assert len(places) <= 4 and sum(n * n for _, n in places) <= 2500
        assert [o for o, _ in sorted(places)] == list(np.cumsum([0, *(n for _, n in sorted(places))])[:-1])


# -- 8 ---------------------------------------------------------------------
def test_languages_are_told_apart(spark):
    from tallywarden.llm.language import grams, language

    rng = random.Random(5)
    words = {"en": ["the", "house", "with", "green"], "fr": ["été", "où", "maison", "très"], "de": ["über", "straße", "nicht", "sehr"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randint(3, 40))), g, "s") for i in range(300) for g in [("en", "fr", "de")[i % 3]]]
    rows += [(1000, None, "en", "s"), (1001, "123 !!", "fr", "s"), (1002, "", None, "s"), (1003, "the house " * 20_000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("h", F.lit(1)).withColumn("r", F.lit(1))
    got = {r.doc_id: r for r in language(df).collect()}
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == g for i, _, g, _ in rows if i < 300)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert language(df.limit(0)).count() == 0
    unknown = language(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in unknown] == ["und"]
    assert set(grams(b"ab", 2)) >= {2, 3} and len(grams(b"", 3)) == 0 and set(grams(b"A!!b", 2)) == set(grams(b"a b", 2))


# -- 9 ---------------------------------------------------------------------
def test_licenses(spark):
    from tallywarden.llm.licenses import KNOWN, licenses

    texts = [
        (1, "Copyright (c) 2020 Me <me@x>\n\n" + KNOWN["MIT"].upper().replace(",", " ,")),
        (2, "Hi\nreleased under the MIT licence\nLicensed under CC BY-NC 4.0\nx"), (3, None), (4, "license " * 9000),
        (5, KNOWN["ISC"] + " and more"), (6, ""),
    ]
    got = {r.doc_id: (r.license, r.notices, r.n_notices) for r in licenses(documents(spark, texts, clash=True)).collect()}
    assert got == {1: ("MIT", [], 0), 2: (None, ["CC-BY-NC-4.0", "MIT"], 2), 3: (None, [], 0), 4: (None, [], 0), 5: (None, [], 0), 6: (None, [], 0)}
    assert licenses(empty(spark)).count() == 0


def test_licenses_as_published(spark):
    from tallywarden.llm.licenses import KNOWN, canonical, licenses

    head = "\n\nCopyright (c) 2020, Me\nAll rights reserved.\n\n"
    texts = [
        (1, "MIT License" + head + KNOWN["MIT"]), (2, "The MIT License (MIT)" + head + KNOWN["MIT"]), (3, "ISC License" + head + KNOWN["ISC"]),
        (4, "BSD 2-Clause License" + head + KNOWN["BSD-2-Clause"]), (5, KNOWN["Unlicense"]), (6, "MIT License\nand more"),
        (7, 'BSD 3-Clause "New" or "Revised" License' + head + KNOWN["BSD-3-Clause"].replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")),
    ]
    got = {r.doc_id: r.license for r in licenses(documents(spark, texts)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "ISC", 4: "BSD-2-Clause", 5: "Unlicense", 6: None, 7: "BSD-3-Clause"}
    mine = spark.createDataFrame([("Do as you like.",)], "t string").select(F.sha2(canonical(F.col("t")), 256).alias("digest"), F.lit("Mine").alias("license"))
    assert licenses(documents(spark, [(1, "do as you like")]), mine).first().license == "Mine"
    # A document that is one notice line is no whole licence.
    line = licenses(documents(spark, [(1, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0.")])).collect()
    assert [(r.license, r.notices, r.n_notices) for r in line] == [(None, ["CC-BY-NC-4.0"], 1)]


# -- 10 --------------------------------------------------------------------
def test_scores_are_probabilities(spark):
    from tallywarden.llm.lm_scores import scores
    from tallywarden.llm.recurrent import Shape, score, start, train

    shape = Shape(words=7, hidden=5, per_class=3)
    flat = start(shape, np.arange(1.0, 8), 3)
    rng = np.random.default_rng(0)
    text = rng.integers(1, 7, 6).astype(np.int32)
    # All continuations of a text have probability 1 together: end or go on.
    whole = 10 ** score([text], flat, shape)[0]
    longer = [np.append(text, w).astype(np.int32) for w in range(1, 7)]
    open_ = sum(10 ** (s + 0.0) for s in score(longer, flat, shape))
    assert 0 < whole < 1 and open_ < 1
    many = [rng.integers(1, 7, n).astype(np.int32) for n in (0, 3, 50, 7, 120)]
    together, alone = score(many, flat, shape, lanes=2, window=4), [score([t], flat, shape)[0] for t in many]
    assert np.allclose(together, alone, rtol=1e-4)
    cycle = [np.tile(np.arange(1, 7), 20).astype(np.int32)] * 60
    better = flat
    for _ in range(6):
        better = train(cycle, better, shape, lanes=16)
    assert score(cycle[:1], better, shape)[0] > 0.5 * score(cycle[:1], flat, shape)[0]

    texts = sample_texts(2, 40)
    rows = {r.doc_id: r for r in scores(documents(spark, texts, clash=True), words=5, head=8).collect()}
    lowered = {i: (t or "").lower().split() for i, t in texts}
    counts = Counter()
    for i, ws in lowered.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*ws, ""])
    n, v = sum(counts.values()), len(counts)
    for i, ws in lowered.items():
        r, ws = rows[i], [*ws, ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.score < 0
    assert scores(empty(spark)).count() == 0
    assert np.isfinite(scores(documents(spark, [(2, "a b")])).first().score)


def test_every_training_document_trains_the_weights(spark):
    from tallywarden.llm.lm_scores import scores

    rng = random.Random(4)
    texts = {i: " ".join(rng.choice("abcdef") for _ in range(30)) for i in range(20)}

    def scored(own):
        # one task, so that only what is trained on can make a difference
        df = spark.createDataFrame([(i, t) for i, t in own.items()], "doc_id long, text string").coalesce(1)
        return {r.doc_id: r.score for r in scores(df).collect()}

    training = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    before, asked = scored(texts), min(set(texts) - set(training))
    for i in training[:4]:
        # the same words in another order: the counts stay, the weights do not
        assert scored(texts | {i: " ".join(sorted(texts[i].split()))})[asked] != before[asked]


def test_gradients_of_the_model():
    from tallywarden.llm import recurrent as rn

    shape = rn.Shape(words=6, hidden=3, per_class=2)
    flat = rn.start(shape, np.ones(6), 1).astype(np.float64)
    h = np.random.default_rng(3).normal(size=(8, 3))
    target = np.array([0, 1, 2, 3, 4, 5, 1, 0])
    p = rn.unpack(flat, shape)
    grad = np.zeros_like(flat)
    g = rn.unpack(grad, shape)
    _, dh = rn._outputs(h, target, p, shape, g)
    step = 1e-5
    for j in range(3):
        up, down = h.copy(), h.copy()
        up[2, j] += step
        down[2, j] -= step
        slope = (rn._outputs(up, target, p, shape).sum() - rn._outputs(down, target, p, shape).sum()) / (2 * step)
        assert slope == pytest.approx(dh[2, j], rel=1e-3, abs=1e-6)


# -- pipeline --------------------------------------------------------------
def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage, copy, item = prose(60), prose(120), prose(20)
    texts = [(i, prose(80) + ".") for i in range(40)]
    texts += [(100, passage + " " + prose(60)), (101, prose(60) + " " + passage), (200, copy), (201, copy), (300, item + " " + prose(50)), (400, None)]
    docs = documents(spark, texts)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = dict(cp.STAGES)
    kept = step["n-gram Jaccard join"](spark, docs, str(tmp_path))
    assert {i for i, _ in texts} - {r.doc_id for r in kept.collect()} == {201} and kept.columns == docs.columns
    cut = {r.doc_id: r for r in step["suffix-array dedup"](spark, kept, str(tmp_path)).collect()}
    assert passage in cut[100].text and passage[:100] not in cut[101].text and cut[400].text in (None, "")
    assert all(r.n_chars == len(r.text or "") for r in cut.values())
    clean = step["benchmark decontamination"](spark, kept, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} - {r.doc_id for r in clean.collect()} == {300}
    out = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert out == {i for i, _ in texts} - {201, 300}


