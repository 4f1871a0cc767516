"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are domain, language and source. A budget of tokens flows down the tree by weight. A child that cannot use its
share (its tokens times the most epochs) keeps what it can use; the rest goes to its siblings by weight, and only what
no sibling can use is missing at the parent, where the same rule gives it to the parent's siblings. Each leaf then
takes a prefix of seeded epochs: whole epochs first, and of the next one the documents whose running token total in
that epoch's seeded order stays within the rest.

Running totals need no sort of a whole leaf: a leaf's documents are dealt into buckets by the first digits of their
seeded hash, bucket sums find the one bucket in which the prefix ends, and only that bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.llm.staging import staged

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the seeded hash that name a bucket.
_DIGITS = 3
#: Leaves up to which the leaf table is broadcast; beyond it, it is joined like any other table.
_BROADCAST_LEAVES = 20_000


def word_count(text: Column) -> Column:
    """Words between spaces, tabs and line ends: the token measure where no tokenizer has counted."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), "")).cast("long")


def source_domain(source: Column) -> Column:
    """Domain of a source: its number modulo four (sources without a number are of domain 'd0')."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("int") % 4).cast("string"))


def _weight(weights: dict[str, dict], level: str) -> Column:
    """Relative weight of a child by its name; names without a weight have 1."""
    named = weights.get(level) or {}
    out = F.lit(1).cast("long")
    for name, w in sorted(named.items()):
        out = F.when(F.col(level) == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def _share(children: DataFrame, parent: list[str], level: str, budget: str) -> DataFrame:
    """Split ``budget`` of each parent among its children: shares by weight, capped by capacity, shortages to siblings.

    Children in order of capacity over weight are full as long as their ratio times the weight of all not yet full is
    within what is left; the others share the rest by weight.
    """
    before = Window.partitionBy(*parent).orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    ranked = (
        children.withColumn("ratio", F.col("capacity").cast("double") / F.col("weight"))
        .withColumn("w_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left", F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("full", F.col("ratio") * F.col("w_left") <= F.col("left"))
    )
    # Of those that are not full, the first in order knows what is left and the weight that shares it.
    rest = F.first(F.when(~F.col("full"), F.struct("left", "w_left")), ignorenulls=True).over(
        Window.partitionBy(*parent).orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        ranked.withColumn("rest", rest)
        .withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.col("weight") * F.col("rest.left").cast("double") / F.col("rest.w_left"))))
        .drop("ratio", "w_left", "left", "full", "rest", budget if budget != "budget" else "__none")
    )


def leaf_budgets(supply: DataFrame, weights: dict[str, dict], total: Column | int | None, total_share: float, max_epochs: int) -> DataFrame:
    """Budgets of leaves: ``domain, lang, source, tokens, budget``. ``supply`` holds a row ``(domain, lang, source, tokens)`` for each leaf.

    The root budget is ``total`` tokens, or ``total_share`` of all tokens.
    """
    leaf = supply.withColumn("capacity", F.col("tokens") * max_epochs)
    domain = leaf.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    root = Window.partitionBy("tree")
    wanted = F.lit(total).cast("long") if total is not None else F.floor(F.sum("tokens").over(root) * F.lit(float(total_share)))
    domains = domain.withColumn("weight", _weight(weights, "domain")).withColumn("tree", F.lit(0))
    domains = domains.withColumn("root_budget", F.least(wanted, F.sum("capacity").over(root)))
    domains = _share(domains, ["tree"], "domain", "root_budget").select("domain", F.col("budget").alias("domain_budget"))
    langs = leaf.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains, "domain").withColumn("weight", _weight(weights, "lang"))
    langs = _share(langs, ["domain"], "lang", "domain_budget").select("domain", "lang", F.col("budget").alias("lang_budget"))
    leaves = leaf.join(langs, ["domain", "lang"]).withColumn("weight", _weight(weights, "source"))
    return _share(leaves, ["domain", "lang"], "source", "lang_budget").select(*LEVELS, "tokens", "budget")


def _order(seed: int, epoch: Column, name: Column) -> Column:
    """Seeded place of a document in an epoch, as hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name))


def _leaf(id_col: str, text_col: str, tokens: Column | None) -> Column:
    """Leaf, tokens and name of a document; a document without an id is named by its text, so such rows have places of their own."""
    part = lambda c: F.coalesce(F.col(c), F.lit("-"))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    count = word_count(F.col(text_col)) if tokens is None else tokens
    return F.struct(source_domain(part("source")).alias("domain"), part("lang").alias("lang"), part("source").alias("source"), count.alias("tokens"), name.alias("name"))


def mix_documents(
    docs: DataFrame,
    weights: dict[str, dict],
    total: int | None = None,
    total_share: float = 1.0,
    max_epochs: int = 1,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """``docs`` as often as the mixture takes them, plus ``epoch`` (0 for a first copy).

    ``weights`` maps a level ('domain', 'lang', 'source') to relative integer weights of names; others weigh 1. Null
    languages and sources form leaves named '-'. Documents without words cost nothing and are taken with every epoch
    that is begun in their place of the order; equal places (repeated ids) are taken or left by their running total,
    smaller ones first. An existing column ``epoch`` is replaced. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != "epoch"]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), _leaf(id_col, text_col, tokens).alias("leaf"))
    light = staged(marked.select("leaf.*"), "mixing-tokens")
    leaves, n_leaves = _prefixes(light, weights, total, total_share, max_epochs, seed)
    small = F.broadcast(leaves) if n_leaves <= _BROADCAST_LEAVES else leaves
    small = small.select(*[F.col(c).alias(f"of_{c}") for c in LEVELS], "whole", "end_bucket", "end_room")
    met = marked.join(small, [F.col(f"leaf.{c}") == F.col(f"of_{c}") for c in LEVELS])
    place = _order(seed, F.col("whole"), F.col("leaf.name"))
    bucket = F.substring(place, 1, _DIGITS)
    # Epochs taken: all whole ones, and the next one if the document's bucket is wholly inside the prefix.
    copies = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    inside = (F.col("whole") < max_epochs) & (bucket < F.coalesce("end_bucket", F.lit("z")))
    sure = met.withColumn("epoch", F.explode(F.when(inside, F.array_append(copies, F.col("whole"))).otherwise(copies)))
    edge = met.where((F.col("whole") < max_epochs) & (bucket == F.col("end_bucket")))
    running = F.sum("leaf.tokens").over(
        Window.partitionBy(*[F.col(f"leaf.{c}") for c in LEVELS]).orderBy(place, "leaf.tokens").rowsBetween(Window.unboundedPreceding, 0)
    )
    edge = edge.withColumn("running", running).where(F.col("running") <= F.col("end_room")).withColumn("epoch", F.col("whole"))
    out = [*[F.col(f"doc.`{c}`") for c in keep], "epoch"]
    return sure.select(*out).union(edge.select(*out))


def _prefixes(light: DataFrame, weights: dict, total: int | None, total_share: float, max_epochs: int, seed: int) -> tuple[DataFrame, int]:
    """For each leaf its whole epochs, the bucket in which the next epoch's prefix ends (null: after all), and the tokens that fit there."""
    supply = staged(light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mixing-supply")
    n_leaves = supply.count()
    budgets = leaf_budgets(supply, weights, total, total_share, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs), F.floor(F.col("budget") / F.col("tokens")).cast("int"))).otherwise(F.lit(max_epochs))
    leaf = budgets.withColumn("whole", epochs.cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    leaf = staged(leaf.select(*LEVELS, "whole", "rest"), "mixing-leaves")
    small = F.broadcast(leaf) if n_leaves <= _BROADCAST_LEAVES else leaf
    sums = (
        light.join(small, list(LEVELS))
        .where(F.col("whole") < max_epochs)
        .withColumn("bucket", F.substring(_order(seed, F.col("whole"), F.col("name")), 1, _DIGITS))
        .groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("tokens"))
    )
    run = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # at most 16**_DIGITS rows a leaf
    ends = sums.withColumn("run", run).where(F.col("run") > F.col("rest"))
    ends = ends.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("run") + F.col("tokens")).alias("room"))).alias("end"))
    out = leaf.join(ends, list(LEVELS), "left").select(*LEVELS, "whole", F.col("end.bucket").alias("end_bucket"), F.col("end.room").alias("end_room"))
    return staged(out, "mixing-prefixes"), n_leaves
