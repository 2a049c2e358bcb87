"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Every text is read once, into a few statistics; all else runs on those.
Random Fourier features approximate a Gaussian kernel over them. Each partition
sums its part of the normal equations, the parts are summed as a tree, and the
driver solves one system of the size of the features. Scores are calibrated on
labelled rows that took no part in the fit, by isotonic regression over a table
of score steps, which is of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywarden.llm.common import crc_mod, stored, summed_arrays

_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n",
    b".", b",", b"!?", b"|", b"*", b"#$%&@^~", b"-_'\"():;/", bytes(range(128, 256)),
]
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_N = len(_GROUPS) + 1
FEATURES = 2 * _N + 10


def statistics(raw: bytes | None) -> np.ndarray:
    """Statistics of one whole text; all zero for a null or empty one."""
    out = np.zeros(FEATURES)
    if not raw:
        return out
    a = _CLASS[np.frombuffer(raw, np.uint8)]
    out[:_N] = np.sqrt(np.bincount(a, minlength=_N) / len(a))
    words = raw.split()
    if words:
        n = len(words)
        space = (a == 3) | (a == 4)
        ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
        out[_N : 2 * _N] = np.sqrt(np.bincount(a[ends], minlength=_N) / n)
        lengths = np.diff(np.concatenate([[-1], ends]))
        rest = out[2 * _N :]
        rest[0] = np.log1p(n) / 4
        rest[1] = np.log1p(lengths.mean())
        rest[2] = np.log1p(lengths.std())
        distinct = len(set(words))
        rest[3] = distinct / n
        rest[4] = np.log(distinct) / np.log(n) if n > 1 else 1.0
        lines = [x for x in raw.split(b"\n") if x]
        rest[5] = len(set(lines)) / len(lines)
        rest[6] = np.log1p(len(raw) / len(lines)) / 4
        rest[7] = len(set(zip(words, words[1:]))) / max(1, n - 1)
        rest[8] = np.sqrt((lengths == 1).mean())
        rest[9] = np.sqrt((lengths > 20).mean())
    return out


@dataclass
class Fourier:
    """Standardised statistics to ``size`` cosine features and a constant, in
    whole multiples of 2^-12, so that their sums do not depend on any order."""

    mean: np.ndarray
    std: np.ndarray
    size: int
    width: float
    seed: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(size=(x.shape[1], self.size)) / (self.width * np.sqrt(x.shape[1]))
        b = rng.uniform(0, 2 * np.pi, self.size)
        z = np.cos(np.clip((x - self.mean) / self.std, -8, 8) @ w + b)
        return np.concatenate([np.round(z * 4096) / 4096, np.ones((len(x), 1))], 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing values: centre and value of each level block."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _matrix(raws) -> np.ndarray:
    return np.frombuffer(b"".join(raws), np.float32).reshape(-1, FEATURES).astype(np.float64)


def quality_scores(
    docs: DataFrame, labels: DataFrame, size: int = 384, width: float = 1.0, ridge: float = 1e-4,
    threshold: float = 0.7, seed: int = 7,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    ``labels`` holds ``doc_id`` and ``quality`` (1 good, 0 bad). Rows whose
    crc32(doc_id) mod 4 is 2 are held out, 0 and 1 are fitted, 3 calibrates. All
    labelled rows are used. Several labels of a document count by their mean;
    null and NaN labels and labels of unknown documents are ignored. Null and empty
    texts have a score as well. Without any label to learn from the score is 1.
    Only ``text`` is an input of the score. Rows without ``doc_id`` are dropped,
    repeated rows come back as often.
    """

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raws = [statistics(x.as_py()).astype(np.float32).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary())], names=["doc_id", "x"])

    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary"))
    stats = stored(texts.mapInArrow(scan, "doc_id long, x binary"), "statistics")
    label = F.col("quality").cast("double")
    known = labels.filter(label.isNotNull() & ~F.isnan(label) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.avg(label).alias("y")
    )
    fold = crc_mod("doc_id", 4)
    train = stats.filter(fold != 2).join(known, "doc_id").select("x", "y", fold.alias("fold"))
    train = stored(train, "labelled")

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + 2 * FEATURES)
        for f in frames:
            x = np.round(_matrix(f.x) * 1024) / 1024
            total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield pd.DataFrame({"raw": [total.tobytes()]})

    got = summed_arrays(train.select("x").mapInPandas(moments, "raw binary"))
    held = (fold == 2).alias("held_out")
    if got is None or got[0] == 0:
        return stats.select("doc_id", held, F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    mean = got[1 : 1 + FEATURES] / got[0]
    std = np.sqrt(np.maximum(got[1 + FEATURES :] / got[0] - mean**2, 0)) + 0.01
    fourier = Fourier(mean, std, size, width, seed)
    d = size + 1

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d * d + d + 1)
        for f in frames:
            z, y = fourier(_matrix(f.x)), np.round(f.y.to_numpy() * 4096) / 4096
            total += np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(z)]])
        yield pd.DataFrame({"raw": [total.tobytes()]})

    fit = train.filter("fold IN (0, 1)").select("x", "y").mapInPandas(equations, "raw binary")
    sums = summed_arrays(fit)
    n = max(1.0, sums[-1]) if sums is not None else 1.0
    sums = np.zeros(d * d + d + 1) if sums is None else sums
    penalty = np.eye(d) * ridge * n
    weights = np.linalg.solve(sums[: d * d].reshape(d, d) + penalty, sums[d * d : -1])

    def raw_scores(x: np.ndarray) -> np.ndarray:
        return np.clip(np.round(fourier(x) @ weights, 4), -1.0, 2.0)

    def calibrate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            step = np.round(raw_scores(_matrix(f.x)) * 2000).astype(int)
            yield pd.DataFrame({"step": step, "y": f.y})

    steps = (
        train.filter("fold = 3").select("x", "y").mapInPandas(calibrate, "step int, y double")
        .groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("step").collect()
    )  # fmt: skip  # at most 6,001 rows
    if steps:
        at, value = isotonic(
            np.array([r.step / 2000 for r in steps]), np.array([r.y / r.n for r in steps]), np.array([float(r.n) for r in steps])
        )
    else:
        at, value = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(1).to_pylist()) if batch.num_rows else np.zeros((0, FEATURES))
            score = np.clip(np.interp(raw_scores(x), at, value), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(apply, "doc_id long, score double").select(
        "doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
