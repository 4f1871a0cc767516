"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Features of a text are counts of hashed n-grams over its words: the lowered words, whole (one and two), their shapes
(letters as 'a', digits as '0', other characters kept, runs cut to two), one and two, their lengths with their longest
runs of one character, and whether a word repeats the one before. Letters of scripts written without spaces are words.
Each family is scaled to length one; a score is the logistic of a sparse dot product.

Training is FTRL-Proximal on shards of a bounded sample; the shards' weights are averaged. Shards and the order within
them follow a hash of the id, so a lost executor or another number of machines changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.llm.staging import give_back_memory, let_go_what_others_keep

_RUN = re.compile(r"(.)\1\1+", re.S)
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Families of features: words, word pairs, shapes, shape pairs, lengths, repeats.
_FAMILIES = 6
_REPEAT = 12345
#: Hashes of words up to this length are kept; longer ones seldom come twice.
_KEPT = 64
_UNSPACED = re.compile(r"[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\u0E00-\u0E7F]")


class Features:
    """Turns texts into sparse vectors of ``2 ** bits`` slots. Hashes of words are kept, up to a bound."""

    def __init__(self, bits: int, kept: int = 100_000):
        self.bits, self.kept, self.known = np.uint64(64 - bits), kept, {}

    def _hashes(self, word: str) -> tuple[int, int, int]:
        shape = _RUN.sub(r"\1\1", _DIGITS.sub("0", _LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)))
        run = max((m.end() - m.start() for m in _RUN.finditer(word)), default=0)
        hashes = xxhash.xxh64_intdigest(word.lower(), 1), xxhash.xxh64_intdigest(shape, 2), xxhash.xxh64_intdigest(f"{len(word)} {run}", 3)
        if len(self.known) >= self.kept:
            self.known.clear()
        if len(word) <= _KEPT:
            self.known[word] = hashes
        return hashes

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values. An empty text has no features."""
        words = _UNSPACED.sub(r" \g<0> ", text or "").split()
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        known, make = self.known, self._hashes
        h = np.array([known.get(w) or make(w) for w in words], dtype=np.uint64)
        word, shape, size = h[:, 0], h[:, 1], h[:, 2]
        same = word[1:] == word[:-1]
        families = (
            word, word[:-1] * _M1 + word[1:] * _M2, shape, shape[:-1] * _M1 + shape[1:] * _M2, size,
            np.where(same, np.uint64(_REPEAT), np.uint64(_REPEAT + 1)),
        )
        slots, values = [], []
        for k, f in enumerate(families):
            if len(f):
                s, n = np.unique(((f ^ np.uint64(k)) * _M1) >> self.bits, return_counts=True)
                slots.append(s.astype(np.int64))
                values.append(n / np.sqrt((n * n).sum()) if k < _FAMILIES - 1 else n / n.sum())
        return np.concatenate(slots), np.concatenate(values)


class Ftrl:
    """FTRL-Proximal for logistic loss; the weight at slot -1 is the bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, slots: np.ndarray, values: np.ndarray, label: int, weight: float = 1.0) -> None:
        """One step; slots that occur in two families are summed first."""
        slots, back = np.unique(np.append(slots, len(self.z) - 1), return_inverse=True)
        x = np.bincount(back, weights=np.append(values, 1.0))
        w = self.weights(slots)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * weight * x
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def train(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = 18,
    max_train_rows: int = 12_000,
    shard_rows: int = 3_000,
    updates: int = 80_000,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.005,
    l2: float = 0.01,
    low_weight: float = 2.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> np.ndarray:
    """Weights (bias last) learnt from labelled documents.

    At most ``max_train_rows`` labelled ids are used, those with the smallest hash: the documented bound of the sample,
    so its ids (16 bytes each) may be broadcast. Rows labelled 0, the rarer kind, weigh ``low_weight``. Rows without a 0/1 label or an id teach nothing; an id labelled more
    than once counts once, with its largest label. A shard has about ``shard_rows`` rows and is read over until about
    ``updates`` steps are made in all (5 to 60 times). Without any usable label all weights are 0 (every score 0.5).
    """
    sample = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    )
    used = sample.count()
    shards = max(1, round(used / shard_rows))
    epochs = max(5, min(60, -(-updates // max(1, used))))
    taught = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "text", "label", F.expr(f"int(pmod(xxhash64(doc_id, 3), {shards}))").alias("shard"))
        .repartitionByRange(shards, "shard")
        .sortWithinPartitions("shard", F.xxhash64("doc_id"), "text")
        .select("shard", "text", "label")
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go_what_others_keep()
        make, seen = Features(bits), {}
        for b in batches:
            for shard, text, label in zip(*(c.to_pylist() for c in b.columns)):
                seen.setdefault(shard, []).append((*make(text), label))
        for shard, rows in sorted(seen.items()):
            model = Ftrl(1 << bits, alpha, beta, l1, l2)
            for _ in range(epochs):
                for slots, values, label in rows:
                    model.update(slots, values, label, 1.0 if label else low_weight)
            w = model.weights()
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict({"slot": at, "w": w[at]})
            yield pa.RecordBatch.from_pydict({"slot": np.array([-1]), "w": np.array([1.0])})
        seen.clear()
        make.known.clear()
        give_back_memory()

    sums = taught.mapInArrow(learn, "slot long, w double").groupBy("slot").agg(F.sum("w").alias("w")).collect()  # at most 2**bits rows
    weights, taught_shards = np.zeros((1 << bits) + 1), 1.0
    for r in sums:
        if r.slot < 0:
            taught_shards = r.w
        else:
            weights[r.slot] = r.w
    return weights / taught_shards


def quality_scores(
    docs: DataFrame, weights: np.ndarray, bits: int = 18, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold) for every row, whole texts.

    An empty or null text has the score of the bias alone. Repeated rows get equal scores; all other columns stay as
    they are (existing columns named ``score`` or ``predicted`` are replaced). An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go_what_others_keep()
        make, w = Features(bits), shared.value
        for texts in parts:
            out = np.empty(len(texts))
            for k, t in enumerate(texts):  # one text at a time is a Python object
                slots, values = make(t.as_py())
                out[k] = 1 / (1 + np.exp(-np.clip(w[slots] @ values + w[-1], -35, 35)))
            yield pa.array(out)
        make.known.clear()
        give_back_memory()

    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, held_out: str = "pmod(crc32(string(doc_id)), 5) = 0", threshold: float = 0.3, **settings) -> DataFrame:
    """Train on labels outside the held-out ids and score every document: ``docs`` plus ``held_out, score, predicted``.

    Labels, language, source and id are never inputs of a score. A null id is never held out.
    """
    weights = train(docs, labels.where(f"not coalesce({held_out}, false)"), **settings)
    return quality_scores(docs.withColumn("held_out", F.expr(f"coalesce({held_out}, false)")), weights, settings.get("bits", 18), threshold)
