"""Language identification: a byte convolutional network, trained and applied in numpy inside Spark tasks.

The network reads windows of bytes: each byte (or the end of the text) has a learnt vector, filters of several widths
are laid over the window, each filter keeps its largest value, and a softmax over these gives a probability for every
language. A whole text is cut into windows that overlap by a filter's width less one, so that no filter misses a place;
its answer is the mean of its windows' probabilities, weighted by their bytes.

Training averages: each round, the shards of a bounded sample start from the same weights, learn on their own, and the
mean of what they learnt starts the next round. Sample, shards and order follow hashes of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.llm.staging import discard, staged

#: Stands for every place after the end of a text.
END = 256
UNKNOWN = "und"
#: Windows that are computed at a time, so that their values stay in a core's cache.
_AT_ONCE = 128
#: Bytes of the parts of a training text and whether they are upper-cased; short ones teach what little text looks like.
_LESSONS = ((16, False), (32, False), (64, False), (64, True), (128, False), (256, False))


@dataclass
class Network:
    """Weights: ``embed`` (257 x depth), for each width ``filters[width]`` (width x depth x filters) and ``floors[width]``, ``dense``, ``bias``."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]
    floors: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(languages: int, widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, depth: int = 8, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, fan: (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
        embed = draw(END + 1, depth, fan=1)
        embed[END] = 0
        return Network(
            embed, {w: draw(w, depth, filters, fan=w * depth) for w in widths}, {w: np.zeros(filters, np.float32) for w in widths},
            draw(len(widths) * filters, languages, fan=len(widths) * filters), np.zeros(languages, np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, *self.filters.values(), *self.floors.values(), self.dense, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for a in self.arrays():
            a[...] = np.asarray(values[at : at + a.size], a.dtype).reshape(a.shape)
            at += a.size

    def _pooled(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter and its place; ``ids`` is (places, windows)."""
        places = len(ids) - width + 1
        values = sum((self.embed @ self.filters[width][k])[ids[k : k + places]] for k in range(width)) + self.floors[width]
        at = values.argmax(axis=0)
        return np.take_along_axis(values, at[None], axis=0)[0], at

    def gradients(self, ids: np.ndarray, languages: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy, in the order of :meth:`arrays`."""
        pooled = {w: self._pooled(ids, w) for w in self.filters}
        top = np.concatenate([p for p, _ in pooled.values()], axis=1)
        hidden = np.maximum(top, 0)
        error = _softmax(hidden @ self.dense + self.bias)
        error[np.arange(len(languages)), languages] -= 1
        error /= len(languages)
        back = (error @ self.dense.T) * (top > 0)
        embed, filters, floors, column = np.zeros_like(self.embed), [], [], 0
        for w, (_, at) in pooled.items():
            n = self.filters[w].shape[2]
            g, column = back[:, column : column + n], column + n
            seen = ids[at[:, :, None] + np.arange(w), np.arange(len(at))[:, None, None]]  # (windows, filters, width)
            filters.append(np.einsum("bf,bfkd->kdf", g, self.embed[seen], optimize=True))
            floors.append(g.sum(axis=0))
            np.add.at(embed, seen.ravel(), np.einsum("bf,kdf->bfkd", g, self.filters[w]).reshape(-1, embed.shape[1]))
        embed[END] = 0
        return [embed, *filters, *floors, hidden.T @ error, error.sum(axis=0)]

    def learn(self, ids: np.ndarray, languages: np.ndarray, batch: int, rate: float, seed: int) -> None:
        """One pass of Adam over the windows (``ids`` is (windows, places)) in a seeded order of batches of like length."""
        rng, weights, sizes = np.random.default_rng(seed), self.arrays(), (ids != END).sum(axis=1)
        order = rng.permutation(len(ids))
        order = order[np.argsort(sizes[order], kind="stable")]
        starts = rng.permutation(np.arange(0, len(order), batch))
        mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step, at in enumerate(starts, 1):
            rows = order[at : at + batch]
            used = sizes[rows].max() + max(self.filters)
            for w, m, s, g in zip(weights, mean, square, self.gradients(ids[rows, :used].T, languages[rows])):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Reader:
    """Applies a network to texts. Filters are laid out as tables over bytes and byte pairs, so a place costs a few look-ups."""

    def __init__(self, network: Network, window: int):
        self.network, self.window, self.overlap = network, window, max(network.filters) - 1
        pair = np.arange((END + 1) ** 2)
        self.tables = {}
        for w, f in network.filters.items():
            single = [(network.embed @ f[k]).astype(np.float32) for k in range(w)]
            single[0] = single[0] + network.floors[w]
            pairs = [(k, single[k][pair // (END + 1)] + single[k + 1][pair % (END + 1)]) for k in range(0, w - 1, 2)]
            self.tables[w] = pairs, single[-1] if w % 2 else None

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities (windows x languages) of ``ids`` (places x windows)."""
        pair, top = ids[:-1] * (END + 1) + ids[1:], []
        for w, (pairs, last) in self.tables.items():
            places, total = self.window - w + 1, None
            for k, table in pairs:
                part = table.take(pair[k : k + places], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            if last is not None:
                part = last.take(ids[w - 1 :], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            top.append(total.max(axis=0))
        return _softmax(np.maximum(np.concatenate(top, axis=1), 0) @ self.network.dense + self.network.bias)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Probabilities (texts x languages); rows of null and empty texts hold zeros."""
        data = pc.fill_null(texts.cast(pa.large_binary()), b"")
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        raw = data.buffers()[2]
        stream = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        sizes, stride = np.diff(ends), self.window - self.overlap
        counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - self.overlap) // stride)), 0)
        owner = np.repeat(np.arange(len(sizes)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts, stops = ends[owner] + within * stride, ends[owner + 1]
        sums, places = np.zeros((len(sizes), len(self.network.bias))), np.arange(self.window)[:, None]
        for k in range(0, len(owner), _AT_ONCE):
            of, at, stop = owner[k : k + _AT_ONCE], starts[k : k + _AT_ONCE] + places, stops[k : k + _AT_ONCE]
            ids = np.where(at < stop, stream.take(at, mode="clip").astype(np.int32), END)
            held = np.minimum(stop - starts[k : k + _AT_ONCE], self.window)
            np.add.at(sums, of, self.windows(ids) * held[:, None])
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def train(
    docs: DataFrame,
    window: int = 256,
    rows_per_language: int = 1000,
    max_languages: int = 1000,
    shards: int = 4,
    rounds: int = 6,
    batch: int = 64,
    rate: float = 0.01,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> tuple[Network, list[str]] | None:
    """A network and its languages in order, learnt from ``docs``; None if no row can teach.

    The sample is bounded: of each of the ``max_languages`` most frequent languages about ``rows_per_language`` ids,
    those of the smallest hashes, and six parts of 16 to 256 bytes (one upper-cased) of each text. Rows without language, id or a letter
    teach nothing; an id that stands more than once with one language counts once, with its smallest text.
    """
    known = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("doc_id is not null and lang is not null")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, rows_per_language / r["count"])) for r in counts], "lang string, share double")
    sample = (
        known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).where(_has_letter(F.col("text")))
        .groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    )
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(n).alias("n"), F.lit(up).alias("up")) for k, (n, up) in enumerate(_LESSONS)])).alias("p")
    data = F.encode(F.when(F.col("p.up"), F.upper("text")).otherwise(F.col("text")), "UTF-8").alias("data")
    placed = sample.select("doc_id", "lang", "text", parts).select("doc_id", "lang", "p", data).select(
        F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("doc_id", "p.part").alias("key"), "lang",
        F.expr("substring(data, int(pmod(xxhash64(doc_id, p.part, 3), greatest(octet_length(data) - p.n, 0) + 1)) + 1, p.n)").alias("piece"),
    )
    lessons = staged(placed, "lessons")
    languages = sorted(r["lang"] for r in lessons.select("lang").distinct().collect())  # at most max_languages
    if not languages:
        return None
    network, number = Network.new(len(languages)), {name: k for k, name in enumerate(languages)}
    for turn in range(rounds):
        start, slower = network.flat(), rate * (1 - turn / rounds)

        def learn(table: pa.Table) -> pa.Table:
            table = table.sort_by([("key", "ascending"), ("lang", "ascending")])
            ids = np.full((len(table), window), END, np.int32)
            for k, piece in enumerate(table["piece"].to_pylist()):
                ids[k, : len(piece)] = np.frombuffer(piece, np.uint8)
            mine = Network.new(len(languages))
            mine.set_flat(start)
            mine.learn(ids, np.array([number[x] for x in table["lang"].to_pylist()]), batch, slower, seed=turn)
            return pa.table({"weights": pa.array([mine.flat().astype(np.float64)], pa.list_(pa.float64()))})

        learnt = lessons.groupBy("shard").applyInArrow(learn, "weights array<double>").collect()  # one row of fixed size for each shard
        network.set_flat(np.mean(sorted(r.weights for r in learnt), axis=0))
    discard(lessons)
    return network, languages


def predict_languages(docs: DataFrame, model: tuple[Network, list[str]] | None, window: int = 256, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability given to that language, for every row and its whole text.

    Texts that are null or have no letter, and all texts if there is no model, are ``und`` with score 0. Of equal
    probabilities the first language in order wins; repeated rows get equal answers. Columns of the two names are
    replaced, all others stay. An empty table gives an empty result.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    network, languages = model
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("struct<lang: string, score: double>")
    def answer(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, names = Reader(shared.value, window), np.array(languages, dtype=object)
        for texts in parts:
            chances = reader.texts(texts)
            best = chances.argmax(axis=1)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(chances[np.arange(len(best)), best], pa.float64())], ["lang", "score"])
        pa.default_memory_pool().release_unused()

    name = "answer"
    while name in docs.columns:
        name += "_"
    sure = _has_letter(F.col(f"`{text_col}`"))
    found = docs.select("*", F.when(sure, answer(F.col(f"`{text_col}`"))).alias(name))
    return found.select(*kept, F.coalesce(f"{name}.lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(f"{name}.score", F.lit(0.0)).alias("score"))


def identify(docs: DataFrame, held_out: str = "pmod(crc32(string(doc_id)), 3) = 1", **settings) -> DataFrame:
    """Learn from the documents outside the held-out ids and answer for every document: ``docs`` plus ``held_out, lang_pred, score``.

    Language, source and id are never inputs of an answer. A row without an id is not held out and teaches nothing.
    """
    marked = docs.withColumn("held_out", F.expr(f"coalesce({held_out}, false)"))
    return predict_languages(marked, train(marked.where("not held_out"), **settings), settings.get("window", 256))
