"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label are rotated to the principal axes of all vectors, scaled to length one and dealt into square
cells over their two leading coordinates. Two unit vectors with cosine t or more differ by at most sqrt(2 - 2t) in any
coordinate, so only neighbouring cells are compared; labels with overfull cells get cells over up to four coordinates.
Full cells are cut into tiles of bounded size. Two tiles are
compared over leading dimensions first: partial products plus the product of the suffix norms bound the cosine from
above, and a pair is dropped as soon as that bound is below the threshold. What remains is checked in full.

A tile pair writes at most one row for each of its vectors (a count of links and a local component), never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.llm.staging import connected_components, staged

#: Room for rounding between rotated partial sums and the exact check that follows.
_SLACK = 1e-6
#: Leading dimensions after which the bound is tested again.
_STEPS = (8, 16, 32)
#: Rows of the first tile compared with the second at a time.
_BAND = 256


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over the power of two next to their largest component: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes (columns, leading first) of the second-moment matrix of unit vectors; only width**2 sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                x = _lists(b.column(0), width)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(width * width), "v": total.ravel()})

    sums = vectors.select("embedding").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(width * width)
    for r in sums:
        m[r.i] = r.v
    values, axes = np.linalg.eigh(m.reshape(width, width))
    return axes[:, np.argsort(-values, kind="stable")]


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine(x[i], y[j]) >= threshold, both in double precision."""
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x @ axes) / norm_x[:, None], (y @ axes) / norm_y[:, None]
    width = u.shape[1]
    steps = [s for s in _STEPS if s < width] + [width]
    left = lambda z, at: np.sqrt(np.maximum((z[:, at:] ** 2).sum(axis=1), 0))
    tails = {s: (left(u, s), left(v, s)) for s in steps}
    found_i, found_j = [], []
    for at in range(0, len(u), _BAND):
        part = u[at : at + _BAND]
        first = steps[0]
        products = part[:, :first] @ v[:, :first].T
        a, b = tails[first]
        i, j = np.nonzero(products + a[at : at + _BAND, None] * b[None, :] >= threshold - _SLACK)
        dot = products[i, j]
        for done, upto in zip(steps, steps[1:]):
            if not len(i):
                break
            dot = dot + np.einsum("ij,ij->i", part[i, done:upto], v[j, done:upto])
            a, b = tails[upto]
            keep = dot + a[at + i] * b[j] >= threshold - _SLACK
            i, j, dot = i[keep], j[keep], dot[keep]
        i = i + at
        exact = np.einsum("ij,ij->i", x[i], y[j]) / (norm_x[i] * norm_y[j]) >= threshold
        found_i.append(i[exact])
        found_j.append(j[exact])
    return np.concatenate(found_i), np.concatenate(found_j)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n vectors over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def embedding_components(
    embeddings: DataFrame,
    threshold: float = 0.98,
    tile_rows: int = 8192,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Link vectors with equal labels and cosine at or above ``threshold``; count links and name components.

    Returns one row per row of ``embeddings``: ``vec_id, n_links, component_id, kept``. A vector that is null, empty or
    zero, or holds a null or non-finite component, a row with a null label and a row with a null id link with nothing
    (no links, own component; a null id has a null component and is not kept). Vectors of different lengths never link.
    Repeated rows count as separate vectors. An empty table gives an empty result; other columns are ignored.
    Equal vectors of a label are compared once and counted by their number, so a hot group of copies costs one row.
    """
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")
    )
    bad = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) or forall(embedding, x -> x = 0)"
    valid = F.expr(f"vec_id is not null and label is not null and embedding is not null and not coalesce({bad}, true)")
    # 128 bits of hash stand for (label, vector); -0.0 and 0.0 are one value.
    same = "transform(embedding, x -> x + 0.0D)"
    rows = rows.withColumn("ok", valid)
    keyed = rows.select(
        "vec_id", "label", "embedding", "ok",
        F.expr(f"if(ok, xxhash64(label, {same}), null)").alias("h1"), F.expr(f"if(ok, xxhash64(7L, {same}, label), null)").alias("h2"),
    )
    ids = keyed.select("vec_id", "h1", "h2")
    nodes = staged(
        keyed.where("ok").groupBy("h1", "h2").agg(
            F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
        ).withColumn("size", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    links = None
    for (width,) in nodes.groupBy("size").count().select("size").collect():  # vector lengths, not rows: one for any real table
        part = staged(_tile_links(nodes.where(F.col("size") == width), width, threshold, tile_rows), "links")
        links = part if links is None else links.union(part)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(links.where("node <> near").select(F.col("node").alias("a"), F.col("near").alias("b")))
    named = (
        nodes.select("h1", "h2", "node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("number"), "least")
    )
    # An id may repeat with another vector, so vectors have numbers of their own; a component's name is its smallest id.
    named = staged(named, "components")
    named = named.join(named.groupBy("number").agg(F.min("least").alias("root")), "number").select("h1", "h2", "links", "root")
    return ids.join(named, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"),
    )


#: Leading dimensions that name a cell: as few as this, and at most.
_SHALLOWEST, _DEEPEST = 2, 4


def _forward_steps(depth: int) -> list[list[int]]:
    """Steps to the neighbours of a cell, one of each two opposite ones, and to the cell itself."""
    return [list(s) for s in product((-1, 0, 1), repeat=depth) if s >= (0,) * depth]


def _neighbours(sizes: DataFrame, deepest: int) -> DataFrame:
    """Each unordered pair of neighbouring cells once: ``label, depth, cell, tiles, other, others, own``. ``sizes`` has ``label, depth, cell, tiles``."""
    steps = F.expr("case " + " ".join(f"when depth = {d} then array({', '.join('array(' + ', '.join(map(str, s)) + ')' for s in _forward_steps(d))})" for d in range(1, deepest + 1)) + " end")
    forward = sizes.withColumn("step", F.explode(steps)).withColumn("other", F.zip_with("cell", "step", lambda a, b: a + b))
    there = sizes.select("label", F.col("cell").alias("other"), F.col("tiles").alias("others"))
    return forward.join(there, ["label", "other"]).select("label", "depth", "cell", "tiles", "other", "others", (F.col("cell") == F.col("other")).alias("own"))


def _depths(placed: DataFrame, deepest: int, tile_rows: int) -> DataFrame:
    """``(label, depth)``: how many leading dimensions name a cell of each label.

    A label whose cells are overfull gets one dimension more as long as that makes fewer rows of all tile pairs together.
    """
    first = min(_SHALLOWEST, deepest)
    labels = placed.select("label").distinct()
    best, asked = None, labels
    for depth in range(first, deepest + 1):
        sizes = placed.join(asked, "label", "left_semi").groupBy("label", F.lit(depth).alias("depth"), F.slice("coords", 1, depth).alias("cell")).agg(F.count("*").alias("n"))
        sizes = staged(sizes.withColumn("tiles", F.ceil(F.col("n") / tile_rows).cast("int")), "cell-sizes")
        over = staged(sizes.where("tiles > 1").select("label").distinct(), "overfull")
        if best is None and over.isEmpty():
            return labels.withColumn("depth", F.lit(first))
        cost = _neighbours(sizes, deepest).groupBy("label").agg(F.sum(F.col("tiles") * F.col("others")).alias("cost")).withColumn("depth", F.lit(depth))
        best = staged(cost if best is None else best.union(cost), "cell-costs")
        asked = over
        if over.isEmpty():
            break
    return best.groupBy("label").agg(F.min_by("depth", F.struct("cost", "depth")).alias("depth"))


def _tile_links(nodes: DataFrame, width: int, threshold: float, tile_rows: int) -> DataFrame:
    """Rows ``(node, links, near)`` from each compared tile pair: linked vectors (with copies) and a node of its local component."""
    spark = nodes.sparkSession
    axes = spark.sparkContext.broadcast(principal_axes(nodes, width))  # width**2 numbers
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + _SLACK

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _lists(b.column("embedding"), width)
                lead = (x @ axes.value[:, :_DEEPEST]) / np.linalg.norm(x, axis=1, keepdims=True)
                at = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * lead.shape[1]), pa.array(np.floor(lead / reach).astype("i4").ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, at], names=[*b.schema.names, "coords"])

    base = nodes.select("label", "node", "copies", "embedding")
    schema = f"label {base.schema['label'].dataType.simpleString()}, node long, copies long, embedding array<double>, coords array<int>"
    placed = staged(base.mapInArrow(cells, schema), "cells")
    depths = _depths(placed, min(_DEEPEST, width), tile_rows)
    dealt = placed.join(depths, "label").withColumn("cell", F.slice("coords", 1, F.col("depth")))
    met = _neighbours(dealt.groupBy("label", "depth", "cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles")), min(_DEEPEST, width))
    # What a tile of a cell takes part in: (first cell, second cell, its tiles, the other's tiles, side).
    meet = F.struct("cell", F.col("other").alias("other")).alias("meet")
    as_first = met.select("label", "cell", "tiles", "others", "own", meet, F.lit(0).alias("side"))
    as_second = met.where("not own").select("label", F.col("other").alias("cell"), F.col("others").alias("tiles"), F.col("tiles").alias("others"), "own", meet, F.lit(1).alias("side"))
    tile = F.expr("int(pmod(xxhash64(node), tiles))")
    tasks = (
        dealt.join(as_first.union(as_second), ["label", "cell"])
        .withColumn("tile", tile)
        .withColumn("o", F.explode(F.expr("sequence(0, others - 1)")))
        .select(
            "label", "meet", "node", "copies", "embedding",
            F.expr("case when own then least(tile, o) when side = 0 then tile else o end").alias("ta"),
            F.expr("case when own then greatest(tile, o) when side = 0 then o else tile end").alias("tb"),
            F.expr("case when own then int(tile > o) else side end").alias("side"),
            F.expr("own and tile = o").alias("alone"),
        )
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"], kind="stable")
        within = bool(pdf["alone"].iloc[0])
        nodes_, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        x = _scaled(np.vstack(pdf["embedding"].to_numpy()).astype(np.float64))
        cut = len(x) if within else int((pdf["side"] == 0).sum())
        y = x if within else x[cut:]
        if not cut or not len(y):
            return pd.DataFrame({"node": [], "links": [], "near": []}).astype("int64")
        i, j = linked_pairs(x[:cut], y, axes.value, threshold)
        if within:
            i, j = i[i < j], j[i < j]
        else:
            j = j + cut
        links = np.zeros(len(x), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        hit = np.flatnonzero(links)
        return pd.DataFrame({"node": nodes_[hit], "links": links[hit], "near": nodes_[_local_roots(len(x), i, j)[hit]]})

    return tasks.groupBy("label", "meet", "ta", "tb").applyInPandas(compare, "node long, links long, near long")
