"""Language-model scores of whole texts: counts, a bounded dictionary and the
recurrent model.

* Counts cover all training texts. Tasks count their own tokens; Spark adds up.
* The most frequent tokens, up to ``head``, travel to all tasks. What
  is not among them meets its counts in a join.
* The recurrent model knows the ``words`` most frequent tokens. Any other is
  "another token" to it, times that token's smoothed share of all others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.common import crc_mod, stored, summed_arrays
from tallywarden.llm.jaccard import LOWER
from tallywarden.llm.recurrent import Shape, score, start, train

_END = b""  # no word is empty


class Numbers(dict):
    """Number of a known token; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


def _counts(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(found: Counter):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "c"]
            )

        found: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                found.update((x.as_py() or b"").translate(LOWER).split())
                found[_END] += 1
                if len(found) > 400_000:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    return docs.select("text").mapInArrow(scan, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> list:
    """The tokens above some count, as many as ``most`` allows, by count and token.

    How many tokens have which count comes from a table of fixed size (counts up to
    4,096, steps of about a hundredth beyond), so the driver gets those tokens
    and no task sends it candidates.
    """
    step = F.when(F.col("c") <= 4096, F.col("c")).otherwise(4096 + F.floor(F.log2(F.col("c") / 4096) * 64)).cast("long")
    lowest, total = None, 0
    for at, n in sorted(counts.groupBy(step.alias("at")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        lowest = at
    if lowest is None:
        return []
    return sorted(counts.filter(step >= lowest).collect(), key=lambda r: (-r.c, bytes(r.token)))


def scores(
    docs: DataFrame, words: int = 2048, hidden: int = 24, per_class: int = 46, head: int = 200_000,
    rounds: int = 3, seed: int = 11,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` of every document.

    Rows whose crc32(doc_id) mod 7 is 2 are held out. Counts, vocabulary, output
    biases, the shares of rare tokens and the weights come from all other
    documents; each is trained on once, in one of ``rounds`` rounds. A null text counts as empty; an empty one is its end token alone.
    Scores are finite also if there is nothing to learn from. Rows without
    ``doc_id`` are dropped.
    """
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    fold = crc_mod("doc_id", 7)
    training = rows.filter(fold != 2)
    counts = stored(_counts(training), "counts")
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = n or 0, v or 0
    top = _most_frequent(counts.filter(F.length("token") > 0), head)
    ends = counts.filter(F.length("token") == 0).collect()
    known = [_END] + [bytes(r.token) for r in top]
    often = np.array([ends[0].c if ends else 0] + [r.c for r in top], np.int64)
    model_words = min(words - 1, len(known))
    others_n, others_v = int(n - often[:model_words].sum()), int(v - model_words)
    log_often = np.log10(often + 1.0)
    log_others = np.log10(max(0, others_n) + max(0, others_v) + 1.0)
    shape = Shape(model_words + 1, hidden, per_class)

    def encoded(raw: bytes | None, numbers: Numbers) -> tuple[list[bytes], np.ndarray]:
        tokens = (raw or b"").translate(LOWER).split()
        return tokens, np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))

    def to_model(ids: np.ndarray) -> np.ndarray:
        return np.where((ids < 0) | (ids >= model_words), model_words, ids).astype(np.int32)

    weights = start(shape, np.append(often[:model_words], max(1, others_n)).astype(np.float64), seed)
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(rounds))
    for k in range(rounds):
        now = weights

        def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            numbers = Numbers((w, i) for i, w in enumerate(known[:model_words]))
            flat, tokens, mine = now, 0, []

            def take():
                nonlocal flat, tokens, mine
                flat = train(mine, flat, shape)
                tokens += sum(map(len, mine)) + len(mine)
                mine = []

            for frame in frames:
                for raw in frame.text:
                    mine.append(to_model(encoded(raw, numbers)[1]))
                    if len(mine) >= 2048:
                        take()
            if mine:
                take()
            if tokens:
                # whole multiples of 2^-20: the sum over tasks has no rounding
                fixed = np.round(np.clip(flat, -64, 64).astype(np.float64) * 2**20) / 2**20
                yield pd.DataFrame({"raw": [np.append(fixed * tokens, tokens).tobytes()]})

        total = summed_arrays(training.filter(part == k).select("text").mapInPandas(learn, "raw binary"))
        if total is not None and total[-1]:
            weights = (total[:-1] / total[-1]).astype(np.float32)

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers = Numbers((w, i) for i, w in enumerate(known))
        kind = pa.list_(pa.binary())

        def rows_of(ids, texts, facts, rare):
            logs = score(texts, weights, shape)
            columns = list(zip(*facts))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]),
                 pa.array(columns[3], pa.float64()), pa.array(logs + np.array(columns[4]), pa.float64()), pa.array(rare, kind)],
                names=["doc_id", "n_tokens", "n_known", "n_rare", "base", "score", "rare"],
            )

        ids, texts, facts, rare, held = [], [], [], [], 0
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens, own = encoded(raw.as_py(), numbers)
                miss = np.flatnonzero(own < 0)
                seen = own[own >= 0]
                other = log_often[seen[seen >= model_words]].sum() - log_others * int(((own < 0) | (own >= model_words)).sum())
                base = log_often[seen].sum() + log_often[0]
                facts.append((len(tokens) + 1, len(seen) + int(often[0] > 0), len(miss), base, other))
                ids.append(i)
                rare.append([tokens[j] for j in miss])
                texts.append(to_model(own))
                held += len(tokens) + 1
                if held >= 2_000_000:
                    yield rows_of(ids, texts, facts, rare)
                    ids, texts, facts, rare, held = [], [], [], [], 0
        if ids:
            yield rows_of(ids, texts, facts, rare)

    done = stored(
        rows.mapInArrow(
            apply,
            "doc_id long, n_tokens long, n_known long, n_rare long, base double, score double, rare array<binary>",
        ),
        "scored",
    )
    # Tokens beyond the dictionary: once per document and token, against all counts.
    rare = done.select("doc_id", F.explode("rare").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("k"))
    met = rare.join(counts, "token").groupBy("doc_id").agg(
        F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("logs")
    )
    whole = F.lit(float(np.log10(n + 1.0 * (v + 1))))
    logs, k = F.coalesce("logs", F.lit(0.0)), F.coalesce("k", F.lit(0).cast("long"))
    return done.drop("rare").join(met, "doc_id", "left").select(
        "doc_id",
        (fold == 2).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + k).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
