"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes decides where a text may be cut, so a cut depends on nearby bytes alone and moves
with them when text is inserted. Cuts are normalised: before the normal size only a rarer pattern cuts, after it a more
common one. A text's fingerprint is the sorted set of its chunks, each as 10 hex digits of digest and 2 of length;
what two texts share is measured by the lengths of their common chunks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunk sizes in bytes: no cut before the least, a forced one at the most (two hex digits), the pattern changes at the normal size.
LEAST, NORMAL, MOST = 8, 32, 128
#: Bits of the gear hash that must be zero before and after the normal size.
_RARE, _COMMON = np.uint32((1 << 7) - 1), np.uint32((1 << 3) - 1)
_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 17) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32)
_ENTRY = 12
#: Rows compared at a time.
_ROWS = 500
#: Bytes hashed at a time; a block also sees the 15 bytes before it.
_BLOCK = 1 << 20


def _may_cut(data: bytes) -> tuple[list[int], list[int]]:
    """End positions (exclusive) at which the rare and the common pattern hold."""
    rare, common = [], []
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(raw), _BLOCK):
        low = max(0, at - 15)
        h = _GEAR[raw[low : at + _BLOCK]]
        for step in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 bytes, each byte shifted by its distance
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        h = (h >> np.uint32(9))[at - low :]
        hit = np.flatnonzero((h & _COMMON) == 0)
        common.append(hit + at + 1)
        rare.append(hit[(h[hit] & _RARE) == 0] + at + 1)
    if not common:
        return [], []
    return np.concatenate(rare).tolist(), np.concatenate(common).tolist()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    rare, common = _may_cut(data)
    ends, start, n = [], 0, len(data)
    r = c = 0
    while start < n:
        r = bisect_left(rare, start + LEAST, r)
        if r < len(rare) and rare[r] < start + NORMAL:
            start = rare[r]
        else:
            c = bisect_left(common, start + NORMAL, c)
            start = min(n, start + MOST, common[c] if c < len(common) else n)
        ends.append(start)
    return ends


def chunk_set(data: bytes) -> set[str]:
    """Entries of the chunks: 10 hex digits of XXH64 and 2 of the length in bytes."""
    out, start = set(), 0
    for end in chunk_ends(data):
        out.add(f"{xxhash.xxh64_intdigest(data[start:end]) >> 24:010x}{end - start:02x}")
        start = end
    return out


def _weight(entries: set[str]) -> int:
    return sum(int(e[-2:], 16) for e in entries)


def containment(a: set[str], b: set[str]) -> float:
    """Share of a's distinct chunk bytes found in b; 1 for two empty sets, 0 for one."""
    if not a or not b:
        return float(a == b)
    return _weight(a & b) / _weight(a)


def parse_fingerprint(text: str) -> set[str]:
    return {text[i : i + _ENTRY] for i in range(0, len(text), _ENTRY)}


def fingerprint_text(entries: set[str]) -> str:
    return "".join(sorted(entries))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text alone: ``doc_id, fingerprint``. A null text counts as empty (empty fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint_text(chunk_set(t or b"")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Sampled places for each cut between ranges, and the most ranges: the driver holds some numbers for each of them.
_SAMPLED, _MOST_RANGES = 8, 100_000


class _Cuts:
    """Places ``(doc_id, h)`` that cut the order into ranges; ``h`` is a hash of the text, so rows of one id can be cut too."""

    def __init__(self, places: list[tuple[int, int]]):
        self.places, self.ids = places, np.array([i for i, _ in places], dtype=np.int64)

    def ranges(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Range of each row: the number of cuts that are smaller than its place."""
        low, high = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        for k in np.flatnonzero(high > low):  # rows of an id that is cut
            low[k] = bisect_left(self.places, (int(ids[k]), int(hashes[k])), int(low[k]), int(high[k]))
        return low


def _range_cuts(keys: DataFrame, range_rows: int) -> _Cuts:
    """Cuts for ranges of about ``range_rows`` rows, from a sample of places: equal rows count once, as they can't be cut."""
    rows = keys.count()
    parts = min(-(-rows // range_rows), _MOST_RANGES)
    if parts < 2:
        return _Cuts([])
    step = max(1, rows // (_SAMPLED * parts))
    sample = sorted((r.doc_id, r.h) for r in keys.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(step)) == 0).distinct().collect())
    return _Cuts(sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else [])


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 5_000) -> DataFrame:
    """Fingerprint each text, its edited text and its likeness to both the edited text and the next document.

    Documents are taken in ascending doc_id, rows of one id in order of a hash of their text; the last is followed by the
    first. The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document. Likeness is :func:`containment` of the text's own fingerprint. A null text counts as empty. Rows without an
    id have no place in the order: their edited columns and likenesses are null. Repeated rows follow each other. An
    empty table gives an empty result; other columns are ignored.

    The order is dealt out by ranges of about ``range_rows`` rows; the first row of each range also goes to the end of
    the range before it, so each range is one sorted stream that is read once and texts are shuffled once. The driver
    sees a few numbers for each range, of which there are ``_MOST_RANGES`` at most (ranges of large tables are longer).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    placed = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    keys = placed.select("doc_id", "h")
    cuts = spark.sparkContext.broadcast(_range_cuts(keys, range_rows))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(cuts.value.ranges(ids.to_numpy(), hashes.to_numpy()).astype("int32"))

    heads = keys.select("doc_id", "h", part_of("doc_id", "h").alias("part")).groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    first = sorted((r.part, (r.head.doc_id, r.head.h)) for r in heads.collect())
    # Where the first row of a range also goes: the range before, and for the first of all the last one.
    before = spark.sparkContext.broadcast({head: first[k - 1][0] for k, (_, head) in enumerate(first)})

    @F.pandas_udf("array<struct<part: int, tail: int>>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = cuts.value.ranges(ids.to_numpy(), hashes.to_numpy()).tolist()
        heads = before.value
        return pd.Series([[(p, 0), (heads[at], 1)] if at in heads else [(p, 0)] for at, p in zip(zip(ids.tolist(), hashes.tolist()), own)])

    dealt = (
        placed.select("doc_id", "h", "text", F.explode(places("doc_id", "h")).alias("at"))
        .select("doc_id", "h", "text", "at.part", "at.tail")
        .repartition("part")
        .sortWithinPartitions("part", "tail", "doc_id", "h")
        .select("doc_id", "text", "part", "tail")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, chunk set, part) of the row that waits for the next one
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                out: list[tuple] = []
                for i, t, p, tail in zip(*(c.to_pylist() for c in whole.slice(at, _ROWS).columns)):
                    if held is None or held[3] != p:
                        held = None if tail else (i, t, chunk_set(t), p)  # the second and later rows of a tail name nobody
                        continue
                    mine = chunk_set(t)
                    out.append(_compared(held, t, mine))
                    held = None if tail else (i, t, mine, p)
                if out:
                    yield _batch(out)

    return dealt.mapInArrow(run, _OUT).union(_alone(rows.where("doc_id is null")))


def _compared(row: tuple, after: bytes, after_set: set[str]) -> tuple:
    doc_id, text, own, _ = row
    chars = text.decode("utf-8", "replace")
    k = len(chars) // 4
    edited = (chars[: len(chars) - k] + after.decode("utf-8", "replace")[:k]).encode()
    changed = chunk_set(edited)
    return (
        doc_id, len(chars), hashlib.sha256(edited).hexdigest(), fingerprint_text(own), fingerprint_text(changed),
        containment(own, changed), containment(own, after_set),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _OUT.split(", ")])


def _alone(rows: DataFrame) -> DataFrame:
    """Rows without an id: own fingerprint only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            if texts:
                yield _batch([(None, len(t.decode("utf-8", "replace")), None, fingerprint_text(chunk_set(t)), None, None, None) for t in texts])

    return rows.select("text").mapInArrow(run, _OUT)
