"""Language identification with string kernels.

Two texts are alike by how many of their byte n-grams of 1 to ``longest`` letters
are present in both (a blended-spectrum presence kernel, normalised to 1). A
bounded sample of labelled texts serves as Nyström landmarks; one-versus-rest
kernel ridge regression is fitted in the space they span, over all labelled
training rows. A batch of texts is scored as one product of its presence matrix
with a matrix of n-grams by languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.common import crc_mod, summed_arrays

_SYMBOLS = 6  # bits a symbol
_LETTERS = np.zeros(256, np.uint16)  # 0: anything that is no letter
for _k in range(26):
    _LETTERS[65 + _k] = _LETTERS[97 + _k] = 1 + _k
# bytes of letters beyond ASCII share the rest of the symbols
_LETTERS[128:] = 27 + np.arange(128) % 37


def grams(raw: bytes, longest: int) -> np.ndarray:
    """Codes of the distinct n-grams of a whole text, n from 1 to ``longest``.
    Runs of other characters count as one."""
    x = _LETTERS[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    if len(x) == 0:
        return x
    x = np.concatenate([[0], x[(x > 0) | np.concatenate([[True], x[1:] != x[:-1]])], [0]]).astype(np.uint32)
    present = np.zeros(1 << (_SYMBOLS * longest) + 1, bool)
    code = x.copy()
    present[code + 1] = True
    for n in range(2, longest + 1):
        code = (code[:-1] << _SYMBOLS) | x[n - 1 :]
        present[(1 << (_SYMBOLS * n)) + code] = True
    return np.flatnonzero(present)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Presence:
    """Presence vectors over the n-grams of the landmarks, rows of length 1 in
    the kernel's norm."""

    def __init__(self, landmarks: list[bytes], longest: int) -> None:
        self.longest = longest
        found = [grams(x, longest) for x in landmarks]
        self.codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        self.place = np.full((1 << (_SYMBOLS * longest) + 1), -1, np.int32)
        self.place[self.codes] = np.arange(len(self.codes))
        self.landmarks = self._rows(found)

    def _rows(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(found), len(self.codes)), np.float32)
        for row, codes in zip(out, found):
            at = self.place[codes]
            row[at[at >= 0]] = 1 / np.sqrt(max(1, len(codes)))
        return out

    def __call__(self, raws: list[bytes]) -> np.ndarray:
        return self._rows([grams(x, self.longest) for x in raws])


def language(
    docs: DataFrame, landmarks_per_language: int = 48, longest: int = 3, ridge: float = 1e-3,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every document.

    Rows whose crc32(doc_id) mod 4 is 2 are held out; all others with a text and
    a ``lang`` are fitted. The landmarks are the ``landmarks_per_language`` of
    them with the smallest hash of the id, per language. ``score`` is the share
    of the predicted language after a softmax of the kernel scores. A text that
    is null or has no letter is ``und`` with score 0, and so is every text if
    there is nothing to learn from. Rows without ``doc_id`` are dropped.
    """
    fold = crc_mod("doc_id", 4)
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", "lang")
    train = rows.filter((fold != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != ""))
    order = F.xxhash64("doc_id", "text")
    # Only hashes and ids meet: per language and task the smallest few are kept.
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = (
        train.select("lang", order.alias("h"), "doc_id").withColumn("r", F.row_number().over(w))
        .filter(F.col("r") <= landmarks_per_language).collect()
    )  # fmt: skip  # bounded by languages and the parameter
    held = (fold == 2).alias("held_out")
    names = sorted({r.lang for r in chosen})
    if not names:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    ids = sorted({r.doc_id for r in chosen})
    texts = train.filter(F.col("doc_id").isin(ids)).select("doc_id", F.col("text").cast("binary")).collect()
    presence_of = [bytes(t) for _, t in sorted((r[0], bytes(r[1])) for r in texts)]
    longest_ = longest

    def kernel(presence: Presence, raws: list[bytes]) -> np.ndarray:
        return presence(raws) @ presence.landmarks.T

    base = Presence(presence_of, longest_)
    own = kernel(base, presence_of).astype(np.float64)
    # Nyström map: K(x, landmarks) times the inverse root of their own kernel
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    m = int(keep.sum())
    size = len(names)

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        presence = Presence(presence_of, longest_)
        total = np.zeros(m * m + m * size + size + 1)
        for f in frames:
            for lo in range(0, len(f), 256):
                part = f.iloc[lo : lo + 256]
                raws = [bytes(x) for x in part.text]
                z = np.round(kernel(presence, raws) @ root * 4096) / 4096
                y = np.equal.outer(part.lang.to_numpy(), np.array(names, object)).astype(np.float64)
                total += np.concatenate([(z.T @ z).ravel(), (z.T @ y).ravel(), y.sum(0), [len(z)]])
        yield pd.DataFrame({"raw": [total.tobytes()]})

    fit = train.select(F.col("text").cast("binary"), "lang").mapInPandas(equations, "raw binary")
    total = summed_arrays(fit)
    n = total[-1]
    a = total[: m * m].reshape(m, m) + np.eye(m) * ridge * n
    alpha = np.linalg.solve(a, total[m * m : m * m + m * size].reshape(m, size))
    weights = (root @ alpha).astype(np.float32)

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        presence = Presence(presence_of, longest_)
        by_gram = presence.landmarks.T @ weights  # associativity: (P L') w = P (L' w)
        for batch in batches:
            texts = batch.column(1)
            langs, scores = [], []
            for lo in range(0, batch.num_rows, 256):
                part = [x.as_py() or "" for x in texts[lo : lo + 256]]
                out = presence([x.encode("utf-8", "replace") for x in part]) @ by_gram
                share = np.exp(8 * (out - out.max(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                for x, s in zip(part, share):
                    known = _has_letter(x)
                    langs.append(names[int(s.argmax())] if known else "und")
                    scores.append(float(s.max()) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    found = rows.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held, "lang_pred", "score")
