"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits all variants within half the radius; equal variants meet in a shuffle. Radius 3 has the odd
half 1.5, so one flip is taken twice: on the whole 64 bits (which finds every pair up to distance 2) and, for the third
differing bit, on the bits that remain when one third of the fingerprint is masked. That is 65 + 3 * 43 + 3 variants
for a distinct fingerprint, where one side with two flips would emit 2,081.

Members of one full-width variant lie within two bits of each other, so a star to the smallest member loses no link and
writes no pairs. For distance 3 the masked groups that still join different components emit the masked bits' own
one-bit ball: a member that equals a ball's centre is within three bits of all others there, and a star to it is
exact again.

Groups of fingerprints are the first step of :func:`drop_near_duplicates`; what they leave of texts with similar shingle
sets is found by an exact join on rare shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.llm.staging import connected_components, discard, give_back_memory, let_go_what_others_keep, staged

#: Shingles hashed at a time, so that a very long text needs little memory.
_CHUNK = 1 << 16
#: Width and right shift of the masked third: bits [shift, shift + width).
_THIRDS = ((0, 22), (22, 21), (43, 21))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered; bytes.split and bytes.lower know ASCII only."""
    return (text or b"").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the space-joined shingles, repeats included, in blocks. Fewer words: the whole sequence."""
    if not words:
        return
    if len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        flat = b" ".join(part)
        lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        n = len(part) - size + 1
        yield np.array([digest(flat[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist())], dtype=np.uint64)


def fingerprint(hashes: Iterable[np.ndarray]) -> int:
    """64-bit SimHash of blocks of shingle hashes as a signed integer: a bit is set if over half of the hashes set it."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


#: Rows of an Arrow batch that are Python objects at a time.
_ROWS = 500


def _slices(batches: Iterable[pa.RecordBatch], rows: int = _ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in small slices, so that few texts are Python objects at a time. At the end Arrow gives back what it holds."""
    let_go_what_others_keep()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back_memory()


def simhash_fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id long, fp long)`` for every row of ``docs``; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            fps = [fingerprint(shingle_hashes(words_of(t), shingle_words)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _flips(first: int, last: int) -> str:
    """SQL array of the one-bit masks first..last-1."""
    return f"transform(sequence({first}, {last - 1}), i -> shiftleft(1L, i))"


def _star(members: DataFrame, key: list[str]) -> DataFrame:
    """Edges from each member to the smallest node of its group; groups here hold at most one ball of fingerprints."""
    low = members.withColumn("b", F.min("node").over(Window.partitionBy(*key)))
    return low.where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _within_two(nodes: DataFrame) -> DataFrame:
    balls = nodes.select("node", F.explode(F.expr(f"array_append(transform({_flips(0, 64)}, m -> fp ^ m), fp)")).alias("variant"))
    return _star(balls, ["variant"])


def _masked(shift: int, width: int) -> tuple[str, str]:
    """SQL of the fingerprint's masked bits and of the others, both moved to the low end."""
    rest = 64 - width
    turn = (shift + width) % 64
    turned = f"(shiftrightunsigned(fp, {turn}) | shiftleft(fp, {(64 - turn) % 64}))" if turn else "fp"
    return f"shiftrightunsigned({turned}, {rest})", f"({turned} & {(1 << rest) - 1}L)"


def _exactly_three(nodes: DataFrame) -> DataFrame:
    """Edges between components ``comp`` that hold a pair of fingerprints at distance 3.

    Three differing bits over three thirds: some third holds exactly one of them (mask it: the other two meet at a
    one-flip variant of the rest), or one third holds all (the rest is equal and the third's own balls meet).
    """
    parts = []
    for k, (shift, width) in enumerate(_THIRDS):
        m, u = _masked(shift, width)
        keys = f"array_append(transform({_flips(0, 64 - width)}, x -> shiftleft({u} ^ x, 3) | {2 * k}L), shiftleft({u}, 3) | {2 * k + 1}L)"
        parts.append(nodes.select("comp", F.expr(f"int({m})").alias("m"), F.explode(F.expr(keys)).alias("key")))
    by_key = Window.partitionBy("key")
    mixed = (
        parts[0].union(parts[1]).union(parts[2])
        .withColumn("lo", F.min("comp").over(by_key))
        .withColumn("hi", F.max("comp").over(by_key))
        .where("lo <> hi")
        .select("key", "comp", "m", F.expr("key & 1").alias("same"), F.expr(f"if(key & 6 = 0, {_THIRDS[0][1]}, {_THIRDS[1][1]})").alias("width"))
    )
    one = "transform(sequence(0, width - 1), i -> m ^ shiftleft(1, i))"
    two = "flatten(transform(sequence(1, width - 1), i -> transform(sequence(0, i - 1), j -> m ^ shiftleft(1, i) ^ shiftleft(1, j))))"
    meet = mixed.select(
        "key", "comp", "m", "same", F.explode(F.expr(f"if(same = 1, concat(array(m), {one}, {two}), concat(array(m), {one}))")).alias("at")
    )
    # Centres: members at the ball's centre where the rests may differ by two bits, and also one flip away where the rests are equal.
    centre = F.min(F.expr("if(bit_count(at ^ m) <= same, comp, null)")).over(Window.partitionBy("key", "at"))
    return meet.select("comp", centre.alias("b")).where("b <> comp").select(F.col("comp").alias("a"), "b").distinct()


def link_fingerprints(nodes: DataFrame) -> DataFrame:
    """Components of distinct fingerprints under 'at most three differing bits': ``(node, fp, root)`` for all nodes.

    ``nodes`` holds ``(node long, fp long)``, one row for each distinct fingerprint. ``root`` is the smallest node.
    The second search joins components of the first, so only what distance 2 left apart is linked again.
    """
    first = connected_components(_within_two(nodes))
    labelled = staged(nodes.join(first, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("comp")), "within-two")
    second = connected_components(_exactly_three(labelled)).toDF("comp", "root")
    return labelled.join(second, "comp", "left").select("node", "fp", F.coalesce("root", "comp").alias("root"))


def simhash_components(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose fingerprints are linked by chains of at most three differing bits.

    Returns one row per row of ``docs``: ``doc_id, fp, fingerprint, component_id`` with ``component_id`` the smallest
    doc_id of the component. Null and empty texts share fingerprint 0 and are linked like any other. Rows without a
    doc_id are returned with a component only if a row with an id shares or neighbours their fingerprint (its smallest
    id; else null). Repeated rows come back as often as they occur; an empty table gives an empty result; other columns
    are ignored. Work per distinct fingerprint is 197 variants, whatever the group sizes.
    """
    fps = staged(simhash_fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    nodes = staged(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")).select("node", "fp"), "nodes")
    named = link_fingerprints(nodes).select("fp", F.col("root").alias("component_id"))
    # The document side holds the hot fingerprint; adaptive execution may split it, as the other side has one row each.
    return fps.join(named, "fp", "left").select("doc_id", "fp", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: Rows up to which a list of ids is broadcast; a longer one is joined by a shuffle.
_BROADCAST_IDS = 300_000


def _small(df: DataFrame) -> DataFrame:
    """A broadcast of at most ``_BROADCAST_IDS`` ids (a few numbers each), else the table itself."""
    return F.broadcast(df) if df.count() <= _BROADCAST_IDS else df


def _shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, as signed numbers."""
    return np.sort(np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(words_of(text), size)])).view(np.int64))


#: Bits of a shingle hash that name its counter. The table of counters has this fixed size whatever the size of the corpus.
_COUNTER_BITS = 18


def _counter_of(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - _COUNTER_BITS)).astype(np.int64)


_DESCRIBED = "id long, h long, d1 long, d2 long, fp long, n long, slot long, uses long"


def _described(rows: DataFrame, size: int) -> DataFrame:
    """Of each text ``(id, h, text)``: a 128-bit digest of its words, its SimHash and the size of its shingle set.

    Each task also adds rows ``(slot, uses)``: how many texts use the shingles of each counter.
    """
    names = [c.split()[0] for c in _DESCRIBED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(1 << _COUNTER_BITS, dtype=np.int64)
        for b in _slices(batches):
            out: list[list] = [[], [], [], []]
            used = []
            for t in b.column(2).to_pylist():
                words = words_of(t)
                hashes = list(shingle_hashes(words, size))
                keys = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
                used.append(_counter_of(keys))
                both = xxhash.xxh128_intdigest(b" ".join(words))
                row = ((both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63), fingerprint(hashes), len(keys))
                for column, value in zip(out, row):
                    column.append(value)
            uses += np.bincount(np.concatenate(used), minlength=len(uses))
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in out), none, none], names=names)
        slots = np.flatnonzero(uses)
        none = pa.nulls(len(slots), pa.int64())
        yield pa.RecordBatch.from_arrays([*[none] * 6, pa.array(slots), pa.array(uses[slots])], names=names)

    return rows.mapInArrow(run, _DESCRIBED)


def _counters(described: DataFrame) -> np.ndarray:
    """Uses of all counters over all texts: ``2 ** _COUNTER_BITS`` numbers at most come to the driver."""
    sums = described.where("slot is not null").groupBy("slot").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros(1 << _COUNTER_BITS, dtype=np.int64)
    out[sums["slot"].to_numpy()] = sums["uses"].to_numpy()
    return out


def _shingle_sets(texts: DataFrame, size: int, width: int) -> DataFrame:
    """Sorted distinct shingle hashes of each text, the lowest ``width`` bytes of each: ``(node, shingles)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [np.sort(_shingle_set(t, size).astype(f"<u{width}")).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, shingles binary")


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two sorted arrays have in common, each as often as in both."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    if len(np.unique(x)) == len(x) and len(np.unique(y)) == len(y):
        return int((both[1:] == both[:-1]).sum())
    (u, m), (v, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def _similar(pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """Pairs whose shingle sets ``x`` and ``y`` have that Jaccard similarity or more: ``(a, b)``.

    Of cut hashes as many are in common as of whole ones, or more; so with them no pair that is similar is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=f"<u{width}"), np.frombuffer(y.as_buffer(), dtype=f"<u{width}")
                both = _in_common(x, y)
                keep.append(both >= similarity * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, similarity: float, width: int, name: str) -> DataFrame:
    """Those of the staged pairs ``(a, b)`` that are similar by ``width`` bytes of each shingle hash; the pairs are deleted."""
    asked = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "of.*"), "asked")
    sets = staged(_shingle_sets(texts.join(_small(asked), ["id", "h"]), size, width), "shingle-sets")
    # Many texts may be paired with one: that one's set comes last, so it is copied to its pairs where they are compared.
    sized = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    found = staged(_similar(sized, similarity, width), name)
    for table in (pairs, asked, sets):
        discard(table)
    return found


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, similarity: float, rough: bool = False) -> DataFrame | None:
    """Those of the pairs ``(a, b)`` that are similar, by their whole shingle sets; ``None`` without any pair or link.

    ``rough``: most pairs are not similar, so two bytes of each shingle hash go first, a quarter of what is moved.
    """
    pairs = staged(pairs, "candidates")
    if rough and not pairs.isEmpty():
        pairs = _compared(pairs, texts, nodes, size, similarity, 2, "likely")
    if pairs.isEmpty():
        return None
    found = _compared(pairs, texts, nodes, size, similarity, 8, "links")
    return None if found.isEmpty() else found


def _fits(similarity: float) -> str:
    """SQL that two sets of ``na`` and ``nb`` shingles are alike enough in size."""
    return f"least(na, nb) >= ceil({similarity}D * greatest(na, nb) - 1e-9D)"


def _can_reach(similarity: float) -> str:
    """SQL that two sets whose first shingle in common stands at ``ia`` and ``ib`` of the order can have the similarity."""
    return f"{_fits(similarity)} and least(na - ia, nb - ib) >= ceil({similarity}D / (1 + {similarity}D) * (na + nb) - 1e-9D)"


def _prefixes(texts: DataFrame, counters: np.ndarray, size: int, similarity: float) -> DataFrame:
    """Prefix shingles of each text ``(node, text)``: ``(key, node, i)``, ``i`` the place in the order.

    Shingles have one order for all texts: by their counter, least used first, then by hash. Two sets with the similarity
    share a shingle among the first ``n - ceil(similarity * n) + 1`` of each, whatever the order is.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for b in _slices(batches):
            sets = []
            for t in b.column(1).to_pylist():
                x = _shingle_set(t, size)
                first = len(x) - math.ceil(similarity * len(x) - 1e-9) + 1 if len(x) else 0
                sets.append(x[np.lexsort((x, counters[_counter_of(x)]))[:first]])
            many = [len(x) for x in sets]
            columns = np.concatenate(sets), np.repeat(b.column(0).to_numpy(), many), np.concatenate([np.arange(n, dtype=np.int32) for n in many])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "i"])

    return texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, node long, i int")


def _shared_keys(prefixes: DataFrame) -> DataFrame:
    """The rows of keys that several texts have."""
    keys = staged(prefixes.groupBy("key").count().where("count > 1").select("key"), "keys")
    out = staged(prefixes.join(keys, "key", "left_semi"), "shared-keys")
    discard(prefixes)
    return out


def _meeting(shared: DataFrame, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``(key, node, i, n, root)`` of those keys whose texts stand in different components; a hot key costs one row a task to tell."""
    known = nodes.select("node", "n")
    known = known.withColumn("root", F.col("node")) if roots is None else known.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    rows = shared.join(known, "node").select("key", "node", "i", "n", "root")
    apart = staged(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "keys-apart")
    return staged(rows.join(apart, "key", "left_semi"), "meeting")


def _tied_to_pivots(meeting: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each text with one pivot text for each shingle, if that stands in another component.

    The pivot has the shingle earliest in its order, so it has the fewest shingles of its own: of a group of edited copies
    it is what they were made from. This ties large groups at one row a shingle, before ``_all_across`` looks at pairs.
    """
    pivots = meeting.groupBy("key").agg(F.min(F.struct("i", F.xxhash64("node").alias("o"), "node", "root", "n")).alias("p"))
    tied = meeting.join(pivots, "key").where("p.root <> root")
    first = F.col("node") < F.col("p.node")
    sides = lambda c: (F.when(first, F.col(c)).otherwise(F.col(f"p.{c}")), F.when(first, F.col(f"p.{c}")).otherwise(F.col(c)))
    names = {"node": ("a", "b"), "n": ("na", "nb"), "i": ("ia", "ib")}
    return tied.select(*[side.alias(n) for c, two in names.items() for side, n in zip(sides(c), two)]).where(_can_reach(similarity)).select("a", "b").distinct()


def _all_across(meeting: DataFrame, similarity: float) -> DataFrame:
    """All pairs of texts in different components that can be similar by a prefix shingle; none that is similar is missing.

    The smaller set of a pair needs a shorter prefix, as the other one has no fewer shingles.
    """
    one = meeting.where(f"n - i >= ceil(2 * {similarity}D / (1 + {similarity}D) * n - 1e-9D)").toDF("key", "a", "ia", "na", "ra")
    two = meeting.toDF("key", "b", "ib", "nb", "rb")
    met = one.join(two, "key").where(f"(na < nb or na = nb and a < b) and ra <> rb and {_can_reach(similarity)}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tied_by_fingerprint(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)``: each text with the first one of its group of SimHash fingerprints.

    Groups are chains of at most two differing bits: balls of half that radius meet in a shuffle.
    """
    prints = staged(nodes.groupBy("fp").agg(F.min("node").alias("node")).select("node", "fp"), "fingerprints")
    roots = connected_components(_within_two(prints))
    named = staged(prints.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root")), "groups")
    tied = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), "fp").join(named, "fp").where("b <> root")
    heads = nodes.select(F.col("node").alias("root"), F.col("n").alias("na"))
    return tied.join(heads, "root").where(_fits(similarity)).select(F.col("root").alias("a"), "b")


def near_duplicate_roots(texts: DataFrame, nodes: DataFrame, counters: np.ndarray, size: int, similarity: float) -> DataFrame:
    """Components of distinct texts whose shingle sets have that Jaccard similarity: ``(node, root)`` for nodes with a link.

    ``texts`` holds ``(id, h, text)``, ``nodes`` ``(node, of, fp, n)`` with ``of`` the ``(id, h)`` of one row with that text,
    ``counters`` the uses of shingles. Groups of SimHash fingerprints come first: ball hashing finds the closest copies,
    each is checked against the first one of its group. Copies further apart (a passage added moves up to ten bits) are
    found by an exact equi join on prefix shingles over all texts, of which only keys count that still join different
    components. No pair that is similar is missing.
    """
    links: list[DataFrame] = []
    roots, shared = None, None
    nodes = nodes.where("n > 0")
    for turn in ("fingerprints", "pivots", "pairs"):
        if turn == "fingerprints":
            tied = _tied_by_fingerprint(nodes, similarity)
        else:
            if shared is None:
                of = nodes.select("node", "of.id", "of.h")
                shared = _shared_keys(staged(_prefixes(texts.join(_small(of), ["id", "h"]), counters, size, similarity), "prefixes"))
            meeting = _meeting(shared, nodes, roots)
            tied = _tied_to_pivots(meeting, similarity) if turn == "pivots" else _all_across(meeting, similarity)
        found = _verified(tied, texts, nodes, size, similarity, rough=turn == "pairs")
        if found is not None:
            links.append(found)
            roots = staged(connected_components(reduce(DataFrame.union, links)), "roots")
    return texts.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots


def drop_near_duplicates(
    docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id.

    A pair is a link if the sets of ``shingle_words``-word shingles have a Jaccard similarity of at least ``similarity``;
    see :func:`near_duplicate_roots` for how all links are found. Groups are the components of links; texts with equal
    words are one group from the start (so are all texts without words). Rows without an id are kept. Of repeated rows
    (equal id and text) one is kept. All columns stay; an empty table gives an empty result.
    """
    key = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), F.struct("*").alias("doc"))
    described = staged(_described(key.where("id is not null").select("id", "h", F.col("text").cast("binary").alias("text")), shingle_words), "described")
    light = described.where("slot is null").select("id", "h", "d1", "d2", "fp", "n")
    distinct = light.groupBy("d1", "d2").agg(F.min(F.struct("id", "h")).alias("of"), F.first("fp").alias("fp"), F.first("n").alias("n"))
    nodes = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")
    again = staged(light.groupBy("id", "h").count().where("count > 1").select("id", "h"), "repeated")
    repeated = again.count() > 0
    texts = key.where("id is not null").select("id", "h", "text")
    texts = texts.dropDuplicates(["id", "h"]) if repeated else texts
    roots = near_duplicate_roots(texts, nodes.select("node", "of", "fp", "n"), _counters(described), shingle_words, similarity)
    # Ids may repeat with other texts, so distinct texts have numbers of their own; the smallest id and text of a group stays.
    named = staged(nodes.join(roots, "node", "left").select("d1", "d2", "of", F.coalesce("root", "node").alias("root")), "named")
    first = named.groupBy("root").agg(F.min("of").alias("first"))
    marked = light.join(named.join(first, "root").select("d1", "d2", "first"), ["d1", "d2"])
    gone = staged(marked.where(F.struct("id", "h") != F.col("first")).select("id", "h").distinct(), "removed")
    kept = key.join(_small(gone), ["id", "h"], "left_anti")
    if repeated:
        kept = kept.join(_small(again), ["id", "h"], "left_anti").union(kept.join(_small(again), ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select(*kept.columns))
    return kept.select("doc.*")
