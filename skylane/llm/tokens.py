"""Token counts by separator scan over flat, unindexed token files.

A token file is a run of fixed-width little-endian ids; documents follow each other, each closed by the end-of-document
id, and nothing says where they start. Files are read in blocks at fixed offsets. Each block finds its separators in
one vectorised search and keeps the lengths it can see whole plus its open head and tail. A prefix scan over the
blocks' small summaries then gives each block the number of documents before it and the tokens its first separator
closes from earlier blocks.

The scan runs in two levels: blocks within groups of blocks, then groups within a file, so no task sees a whole file's
summaries.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylane.llm.staging import new_folder, staged

#: Tokens in a block, and blocks in a group of the prefix scan.
BLOCK_TOKENS = 1 << 18
GROUP_BLOCKS = 1024
#: Rows encoded at a time.
_ROWS = 500
_TYPES = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
#: Names that Spark's and Arrow's readers have for the same kind of store.
_SAME_STORE = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def open_store(address: str):
    """File system and path of a file's address, as Spark gives it."""
    from pyarrow import fs

    scheme, sep, rest = address.partition("://")
    return fs.FileSystem.from_uri(f"{_SAME_STORE.get(scheme, scheme)}://{rest}" if sep else address)


def is_known_store(address: str) -> bool:
    """Whether Python workers can open files there; any other store is left to Spark's own readers and writers."""
    try:
        open_store(address)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def count_documents(blocks: DataFrame, separator: int, width: int = 2, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Tokens of every document: ``file, ordinal, n_tokens`` (separators are not counted).

    ``blocks`` holds ``(file, block long, data binary)``: the pieces of each file in order of ``block``, of any length
    that is a whole number of ids. Documents are numbered from 0 within a file. Two separators in a row close an empty
    document; tokens after the last separator are an unfinished document and form the last row if there are any. A null
    or empty block adds nothing, an empty table gives an empty result. Repeated blocks are an error of the store and
    are counted as they stand.
    """
    kind = _TYPES[width]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for file, block, data in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(data or b"", dtype=kind)
                ends = np.flatnonzero(ids == separator)
                inner = (np.diff(ends) - 1).astype("i8")
                row = (file, block, len(ends), int(ends[0]) if len(ends) else len(ids), int(len(ids) - 1 - ends[-1]) if len(ends) else len(ids), inner)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["file", "block", "ends", "head", "tail", "inner"])

    file_kind = blocks.schema["file"].dataType.simpleString()
    seen = staged(
        blocks.select("file", "block", "data").mapInArrow(scan, f"file {file_kind}, block long, ends long, head long, tail long, inner array<long>"),
        "separators",
    )
    # Summaries combine like this: ends add up; the open tail is that after the last separator plus all since.
    light = seen.select("file", "block", "ends", "tail").withColumn("group", F.floor(F.col("block") / group_blocks))
    in_group = Window.partitionBy("file", "group").orderBy("block")
    since = F.sum("tail").over(in_group.rowsBetween(Window.unboundedPreceding, 0))
    light = (
        light.withColumn("ends_before", F.coalesce(F.sum("ends").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("run", since)
        .withColumn("mark", F.when(F.col("ends") > 0, F.col("run") - F.col("tail")))
        .withColumn("cut", F.last("mark", ignorenulls=True).over(in_group.rowsBetween(Window.unboundedPreceding, 0)))
        # Tokens open at the end of this block, as far as this group knows.
        .withColumn("open", F.col("run") - F.coalesce("cut", F.lit(0)))
        .withColumn("closed", F.col("cut").isNotNull())
        .withColumn("open_before", F.coalesce(F.lag("open").over(in_group), F.lit(0)))
        .withColumn("closed_before", F.coalesce(F.lag("closed").over(in_group), F.lit(False)))
    )
    groups = light.groupBy("file", "group").agg(F.sum("ends").alias("g_ends"), F.max(F.struct("block", "open", "closed")).alias("last"))
    by_file = Window.partitionBy("file").orderBy("group")
    run = F.sum("last.open").over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    groups = (
        groups.withColumn("g_before", F.coalesce(F.sum("g_ends").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("run", run)
        .withColumn("cut", F.last(F.when(F.col("last.closed"), F.col("run") - F.col("last.open")), ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("g_open", F.coalesce(F.lag(F.col("run") - F.coalesce("cut", F.lit(0))).over(by_file), F.lit(0)))
        .withColumn("at_end", F.lead("group").over(by_file).isNull())
        .withColumn("file_open", F.col("run") - F.coalesce("cut", F.lit(0)))
        .withColumn("file_ends", F.col("g_before") + F.col("g_ends"))
    )
    places = light.join(groups.select("file", "group", "g_before", "g_open"), ["file", "group"]).select(
        "file", "block", (F.col("g_before") + F.col("ends_before")).alias("first"),
        (F.col("open_before") + F.when(F.col("closed_before"), F.lit(0)).otherwise(F.col("g_open"))).alias("carried"),
    )
    closed = (
        seen.where("ends > 0").join(places, ["file", "block"])
        .select("file", "first", F.posexplode(F.concat(F.array(F.col("carried") + F.col("head")), "inner")).alias("k", "n_tokens"))
        .select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")
    )
    unfinished = groups.where("at_end and file_open > 0").select("file", F.col("file_ends").alias("ordinal"), F.col("file_open").alias("n_tokens"))
    return closed.union(unfinished)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS, suffix: str = "*.bin") -> DataFrame:
    """Blocks of all token files below ``path``: ``(file, block, data)``, for :func:`count_documents`.

    Spark lists the files and their lengths; each task reads its own byte ranges through the file system named by the
    file's address, so a file is never held whole.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select("path", "length")
    step = block_tokens * width
    spans = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))
    spans = spans.repartition(F.col("path"), F.floor(F.col("block") / 64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, name = open_store(path)
                with system.open_input_file(name) as f:
                    data = f.read_at(step, block * step)
                yield pa.RecordBatch.from_pydict({"file": [path], "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})

    return spans.mapInArrow(read, "file string, block long, data binary")


def _vocabulary(vocabulary_file: str, pattern: str | None) -> tuple[str, str, dict[bytes, int]]:
    """Name, word pattern and ranks of a vocabulary file; the pattern is that of the public tokenizers unless given."""
    with open(vocabulary_file, "rb") as f:
        raw = f.read()
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return hashlib.sha256(raw + pattern.encode()).hexdigest(), pattern, ranks


_encoders: dict[str, object] = {}


def _encoder(vocabulary: tuple[str, str, dict[bytes, int]]):
    """The byte-level BPE encoder of this Python worker."""
    import tiktoken

    name, pattern, ranks = vocabulary
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], coder, separator: int, kind: np.dtype) -> Iterator[tuple[pa.RecordBatch, bytes]]:
    """A few rows at a time: the rows, and the ids of their texts, each followed by the separator."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            part = b.slice(at, _ROWS)
            yield part, b"".join(np.array([*coder.encode_ordinary(t or ""), separator], dtype=kind).tobytes() for t in part.column(1).to_pylist())


def write_token_files(
    docs: DataFrame, vocabulary_file: str, separator: int, path: str, width: int = 2, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None
) -> DataFrame:
    """Encode every text and write flat token files below ``path``, one for each input split: nothing but ids and separators.

    Returns the writer's record ``(file, ordinal, doc_id)`` of which document it wrote where. Null and empty texts are
    written as empty documents. ``path`` is a folder that all executors share. A task that is run again writes a file of
    its own name; the record names the files that count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary_file, pattern))  # a fixed vocabulary file
    kind = _TYPES[width]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ordinal = TaskContext.get(), 0
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        system, folder = open_store(path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for part, ids in _encoded(batches, _encoder(shared.value), separator, kind):
                out.write(ids)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), part.column(0)], names=["file", "ordinal", "doc_id"])
                ordinal += n

    return staged(_texts(docs, id_col, text_col).mapInArrow(encode, "file string, ordinal long, doc_id long"), "token-order")


def stage_token_blocks(
    docs: DataFrame, vocabulary_file: str, separator: int, width: int = 2, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """As :func:`write_token_files` where Python can't open the shared folder: the record, and ``(file, block, data)``.

    The bytes of a flat file are cut at the same fixed offsets and stand in one written table, so all its reading and
    writing is Spark's. A task holds one block and the ids of a few rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary_file, pattern))
    kind, step = _TYPES[width], block_tokens * width
    schema = "file string, ordinal long, doc_id long, block long, data binary"
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ordinal, block, held = f"part-{TaskContext.get().partitionId():05d}", 0, 0, b""

        def rows(n: int, **known) -> pa.RecordBatch:
            columns = {"file": [name] * n, **known}
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in zip(names, kinds)], names=names)

        for part, ids in _encoded(batches, _encoder(shared.value), separator, kind):
            held += ids
            whole = len(held) // step * step
            for at in range(0, whole, step):
                yield rows(1, block=[block], data=[held[at : at + step]])
                block += 1
            held = held[whole:]
            yield rows(part.num_rows, ordinal=np.arange(ordinal, ordinal + part.num_rows), doc_id=part.column(0).to_pylist())
            ordinal += part.num_rows
        if held:
            yield rows(1, block=[block], data=[held])

    out = staged(_texts(docs, id_col, text_col).mapInArrow(encode, schema), "token-blocks")
    return out.where("ordinal is not null").select("file", "ordinal", "doc_id"), out.where("block is not null").select("file", "block", "data")


def document_token_counts(docs: DataFrame, vocabulary_file: str, separator: int, width: int = 2, block_tokens: int = BLOCK_TOKENS, **columns) -> DataFrame:
    """Write the texts as flat token files, count tokens by separator scan, and name the documents: ``doc_id, n_tokens``.

    One row for each row of ``docs``, null ids and repeated rows included; null and empty texts have 0 tokens. Where only
    Spark can open the shared folder, the files' bytes stand in a written table instead (:func:`stage_token_blocks`).
    """
    folder = new_folder(docs.sparkSession, "token-files")
    if not is_known_store(folder):
        order, blocks = stage_token_blocks(docs, vocabulary_file, separator, width, block_tokens, **columns)
        return order.join(count_documents(blocks, separator, width), ["file", "ordinal"]).select("doc_id", "n_tokens")
    order = write_token_files(docs, vocabulary_file, separator, folder, width, **columns)
    if order.isEmpty():
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    files = read_token_files(docs.sparkSession, folder, width, block_tokens)
    files = files.withColumn("file", F.substring_index("file", "/", -1)).join(F.broadcast(order.select("file").distinct()), "file", "left_semi")  # a name for each task
    return order.join(count_documents(files, separator, width), ["file", "ordinal"]).select("doc_id", "n_tokens")
