"""Audit of filter interaction: every order of five document filters replayed on all documents.

Each document has one small number whose bits say which filters it fails. Documents' flags are crossed with the 120
orders (a broadcast table of that fixed size), the five steps are exploded, the first failing step decides where the
document goes, and counts are summed by part, order and step. A task hands on at most one row for each of its parts,
orders and steps, whatever the number of its documents, so a part that holds a third of all rows costs no more than others.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylane.llm.staging import staged

#: Filters in the order of their bits: A is 1, B is 2, C is 4, D is 8, E is 16.
FILTERS = "ABCDE"
_SPACE = "[\\x20\\x09-\\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(fails: Column, letter: str) -> Column:
    return F.when(fails, 1 << FILTERS.index(letter)).otherwise(0)


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row ``(doc_id, part, digest, fails)`` for each document: bits of the filters A to D, which need its text alone.

    A null text counts as empty and a null part as the empty string. ``digest`` is equal for equal texts only (SHA-256).
    Other columns are left out, so none can clash.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    words = rows.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    n_words, distinct, n_chars = F.size("words"), F.size(F.array_distinct("words")), F.length("text")
    capitals = n_chars - F.length(F.translate("text", _CAPITALS, ""))
    fails = (
        _bit(n_words < 50, "A") + _bit(100 * distinct.cast("long") < 65 * n_words.cast("long"), "B")
        + _bit(100 * capitals.cast("long") > 5 * n_chars.cast("long"), "C") + _bit(F.col("text").rlike("[#$%&*|]"), "D")
    )
    return words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), fails.alias("fails"))


def filter_orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: ``filter_order`` and ``bits``, the filters' bits in that order."""
    rows = [F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*[F.lit(1 << FILTERS.index(x)) for x in p]).alias("bits")) for p in permutations(FILTERS)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _with_copies(flags: DataFrame) -> DataFrame:
    """``flags`` with the bit of filter E: the text stands under a smaller id too.

    Smallest ids are combined on the map side, and only texts that stand under two ids at least are joined back; the
    rows of one text that is a third of all are split by adaptive execution, as its other side has one row.
    """
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    found = flags.join(first.select("digest", "first_id"), "digest", "left")
    return found.withColumn("fails", F.col("fails") + _bit(F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)), "E")).drop("first_id", "digest")


def _with_labels(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``flags`` with ``good`` and ``toxic`` (0 or 1); documents without a label have 0, one labelled twice its larger label."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    return flags.join(marks, "doc_id", "left").select("part", "fails", *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by ``part, filter_order, step``, zeros included: 600 rows for each part that has a document.

    ``kept`` pass this and all earlier filters; ``removed`` fail here first; ``redundant`` fail here but were removed
    before; ``unique_fails`` fail this filter only; ``good_lost`` and ``toxic_lost`` are removed here with a label of 1;
    ``shapley`` is the filter's ``removed`` over all orders. Rows count as they are: repeated rows of one id with one
    text are no copies of each other (E asks for a smaller id), and a row without an id is never a copy nor an original.
    A null text counts as empty. An empty table gives an empty result.
    """
    flags = _with_labels(_with_copies(staged(document_flags(docs), "flags")), labels)
    replay = flags.crossJoin(F.broadcast(filter_orders(docs.sparkSession)))
    first = F.lit(6)
    for step in range(5, 0, -1):
        first = F.when(F.col("fails").bitwiseAND(F.element_at("bits", step)) != 0, step).otherwise(first)
    steps = replay.withColumn("first", first).select("*", F.posexplode("bits").alias("before", "bit"))
    step, fails_here = F.col("before") + 1, F.col("fails").bitwiseAND(F.col("bit")) != 0
    here = F.col("first") == step
    conditions = (F.col("first") > step, here, fails_here & (F.col("first") < step), F.col("fails") == F.col("bit"), here & (F.col("good") == 1), here & (F.col("toxic") == 1))
    counts = steps.groupBy("part", "filter_order", step.alias("step")).agg(*[F.count_if(c).alias(name) for name, c in zip(_COUNTS, conditions)])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
