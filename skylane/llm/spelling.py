"""Spelling variants: each word's most frequent neighbour at one inserted, deleted or replaced letter.

Replacements need no pairs: a word of length L stands in L groups, one for each place, that share what is before and
after the place. A group is no larger than the alphabet, and its size with its two most frequent words says all that
a member has to know. Deletions are strings that either are words or not, so one join with the vocabulary, at most L
rows a word, finds all insertions and deletions. Both kinds are summed by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.llm.staging import discard, staged

#: Letters of a run; only A-Z are lower-cased.
RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the place that differs; no letter of a run.
_ANY = "*"


def _without(word: Column, place: Column, instead: str = "") -> Column:
    """``word`` with the code point at ``place`` (from 1) deleted or replaced."""
    return F.concat(F.substring(word, F.lit(1), place - 1), F.lit(instead), F.substring(word, place + 1, F.length(word)))


def vocabulary(docs: DataFrame, min_chars: int = 5, min_count: int = 3, noise: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all texts and how often they occur: ``(word, n)``.

    A run whose CRC-32 of ``<id>:<lower-cased run>`` is divisible by ``noise`` loses one code point (that number modulo
    its length). Texts that are null or hold no letter give no word; a null id counts as an empty one. Counts combine on
    the map side, so a frequent word costs a row a task.
    """
    runs = docs.select(
        F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("owner"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(1))).alias("run"),
    ).select("owner", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = runs.where(F.length("run") >= min_chars).withColumn("h", F.crc32(F.concat("owner", "run").cast("binary")))
    word = F.when(F.col("h") % noise == 0, _without(F.col("run"), (F.col("h") % F.length("run")).cast("int") + 1)).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _replacements(words: DataFrame) -> DataFrame:
    """``(word, near, best)``: for each of a word's groups with others, how many and the foremost of them.

    The group ``(place, before, after)`` is named by the word with the place marked. Sizes and top two words come from
    one window over the group, which holds a word for each letter at most.
    """
    members = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("place"))
    members = members.select("word", "n", _without(F.col("word"), F.col("place"), _ANY).alias("group"))
    whole = Window.partitionBy("group").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word"))
    sized = members.select(
        "word", F.count("*").over(whole).alias("size"), F.first(rank).over(whole).alias("first"), F.nth_value(rank, 2).over(whole).alias("second")
    ).where("size > 1")
    return sized.select("word", (F.col("size") - 1).alias("near"), F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first")).alias("best"))


def _deletions(words: DataFrame, min_chars: int) -> DataFrame:
    """``(word, near, best)``: each deletion that is a word, told to both."""
    places = F.transform(F.sequence(F.lit(1), F.length("word")), lambda place: _without(F.col("word"), place))
    shorter = words.where(F.length("word") > min_chars).select("word", "n", F.explode(F.array_distinct(places)).alias("short"))
    links = shorter.join(words.select(F.col("word").alias("short"), F.col("n").alias("short_n")), "short")
    end = lambda at, other, n: F.struct(F.col(at).alias("word"), F.struct((-F.col(n)).alias("minus_n"), F.col(other).alias("word")).alias("best"))
    return links.select(F.explode(F.array(end("word", "short", "short_n"), end("short", "word", "n"))).alias("e")).select("e.word", F.lit(1).cast("long").alias("near"), "e.best")


def _roots(forms: DataFrame) -> DataFrame:
    """Last word of each chain ``word -> form``, as ``(word, root)``.

    A form occurs at least twice as often as its word, so chains are short and never closed; each round doubles how far
    a word looks ahead, and six rounds reach what a 64-bit count allows.
    """
    ahead = staged(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(7):
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = staged(ahead.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(ahead)
        ahead = found.select("word", "root")
        if found.where("moved").isEmpty():
            break
    return ahead


def spelling_groups(docs: DataFrame, min_chars: int = 5, min_count: int = 3, noise: int = 97, factor: int = 2) -> DataFrame:
    """One row for each word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word that occurs most often (ties: the smallest in code-point order), if it occurs at least
    ``factor`` (2 or more) times as often as the word, else null; ``root`` is the last word that following forms leads to. Repeated
    rows count each time. A table without words, or an empty one, gives an empty result.
    """
    if factor < 2:
        raise ValueError("forms are followed to their roots, which ends if each occurs at least twice as often as the last")
    words = staged(vocabulary(docs, min_chars, min_count, noise), "vocabulary")
    near = _replacements(words).union(_deletions(words, min_chars)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    takes = -F.col("best.minus_n") >= factor * F.col("n")
    grouped = staged(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.minus_n")).alias("form_n")
        ), "forms",
    )
    roots = _roots(grouped.where("form is not null"))
    return grouped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
