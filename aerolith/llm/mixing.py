"""Mixing sources to target weights by temperature (operator 9); DataFrame functions only.

Each source's share of all tokens is raised to an exponent and renormalised: 1 keeps the natural shares, 0 makes all
sources equal. The exponent is found by bisection so that the weights meet a target entropy, or so that no source is
repeated more often than a limit; one aggregation over the table of source totals tries all exponents that the next six
halvings can ask for. Weights times the budget give each source's tokens, realised as permutations of its blocks: a
source's rows are dealt by hash into blocks of about ``block_rows``; each full epoch takes all blocks, and the last,
partial epoch takes blocks in the order of a hash of seed, epoch and block until the budget is used up, cutting the block
at its edge at a row, in the order of a hash of the row. Running sums are over shelves of blocks, over the blocks of a
shelf and within a block, so a source that holds a third of all rows is summed in no single task.

Rows are shuffled once, by source and block, with all columns that are asked for; nothing is joined back by id.

Defined results: a null source is the source named by the empty string; rows without tokens (null and empty texts) take
part with 0 tokens and are repeated as often as their source's full epochs; a source without any tokens gets weight 0
and one copy of each row; rows that share a doc_id, null or not, and repeated rows are rows of their own, ordered by a
hash of the text where their ids tie; an empty table gives no rows; columns with clashing names are kept as they are by
:func:`mix` and ignored by :func:`mixture`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from aerolith.llm.common import materialise, small_side, text_or_empty

#: Halvings in all, and as many as one aggregation looks ahead.
STEPS, AT_ONCE = 40, 6


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def hash_order(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def source_totals(rows: DataFrame) -> DataFrame:
    """source, tokens, n_rows of each source."""
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))


def fit_exponent(totals: DataFrame, entropy: float | None = None, max_epochs: float | None = None, budget: int | None = None) -> float:
    """Exponent by bisection on [0, 1].

    ``entropy`` (share of the greatest possible) asks for the largest exponent whose weights reach it; ``max_epochs``
    for the smallest whose most repeated source keeps to it. Without ``budget``, the budget is the least that gives
    every source one epoch.
    """
    used = totals.where("tokens > 0")
    total = used.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not total[1]:
        return 1.0
    share = F.col("tokens") / F.lit(float(total[0]))
    power = F.pow(share, F.col("a"))

    def good(got) -> bool:
        if entropy is not None:
            # weights q = power / z, so H = log z - a * sum(q log share)
            h = math.log(got.z) - got.a * got.zl / got.z
            return h >= entropy * math.log(total[1]) - 1e-12
        epochs = got.most / got.least if budget is None else got.most / got.z * budget / total[0]
        return epochs <= max_epochs

    def tried(exponents: list[float]) -> dict[float, bool]:
        rows = used.withColumn("a", F.explode(F.array(*map(F.lit, exponents)))).groupBy("a")
        rows = rows.agg(F.sum(power).alias("z"), F.sum(power * F.log(share)).alias("zl"), F.max(power / share).alias("most"), F.min(power / share).alias("least"))
        return {r.a: good(r) for r in rows.collect()}

    ends = tried([0.0, 1.0])
    if entropy is not None and ends[1.0]:
        return 1.0
    if entropy is None and ends[0.0]:
        return 0.0
    lo, hi = 0.0, 1.0
    for done in range(0, STEPS, AT_ONCE):
        parts = 1 << min(AT_ONCE, STEPS - done)
        found = tried([lo + (hi - lo) * i / parts for i in range(1, parts)])
        for _ in range(min(AT_ONCE, STEPS - done)):
            mid = (lo + hi) / 2
            # entropy falls as the exponent grows, and so does repetition
            lo, hi = (mid, hi) if found[mid] == (entropy is not None) else (lo, mid)
    return lo if entropy is not None else hi


def source_weights(totals: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """source, tokens, n_rows, weight and epochs (rounded to 6 places) of each source."""
    used = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(0.0)
    sums = totals.withColumn("power", used).agg(
        F.sum("power"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("power")))
    ).first()
    z, cover = sums[0] or 1.0, sums[1] or 1.0
    epochs = used / F.col("tokens") * (F.lit(float(cover)) if budget is None else F.lit(float(budget)) / F.lit(float(z)))
    return totals.select(
        "source", "tokens", "n_rows", F.round(used / F.lit(float(z)), 6).alias("weight"),
        F.when(F.col("tokens") > 0, F.round(epochs, 6)).otherwise(1.0).alias("epochs"),
    )


def asked() -> dict[str, Column]:
    """What the mixture asks of a row: its id, source, tokens, and a hash of its text to settle ties."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {"__id": F.col("doc_id").cast("long"), "__source": source, "__n_tokens": words(text_or_empty()), "__tie": F.xxhash64(text_or_empty())}


def with_copies(docs: DataFrame, small: DataFrame, entropy: float | None, max_epochs: float | None, budget: int | None, seed: int, block_rows: int) -> DataFrame:
    """``docs`` (with the columns of :func:`asked`) with __weight, __epochs and __copies; ``small``: its __id, __source and __n_tokens, written once."""
    key, tag = F.coalesce(F.col("__id").cast("string"), F.lit("")), F.lit(str(seed))
    small = small.select(F.col("__source").alias("source"), F.col("__n_tokens").alias("n_tokens"), key.alias("key"))
    totals = materialise(source_totals(small), "mix-totals")
    weights = source_weights(totals, fit_exponent(totals, entropy, max_epochs, budget), budget)
    weights = weights.withColumn("full", F.floor("epochs")).withColumns(
        {
            "left": F.floor((F.col("epochs") - F.col("full")) * F.col("tokens") + F.lit(1e-6)),
            "blocks": F.ceil(F.col("n_rows") / F.lit(block_rows)),
        }
    )
    weights = materialise(weights.select(F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in ("weight", "epochs", "full", "left", "blocks"))), "mix-weights")
    weights = small_side(weights, 128)

    def block(key: Column) -> Column:
        return F.conv(F.substring(hash_order(tag, F.lit("block"), key), 1, 8), 16, 10).cast("long") % F.col("__blocks")

    by_block = small.withColumnRenamed("source", "__source").join(weights, "__source").withColumn("__block", block(F.col("key")))
    place = hash_order(tag, F.col("__full").cast("string"), F.col("__block").cast("string"))
    by_block = by_block.groupBy("__source", "__block", "__full").agg(F.sum("n_tokens").alias("in_block")).withColumn("place", place)
    by_block = materialise(by_block.withColumn("shelf", F.substring("place", 1, 2)), "mix-blocks")
    # blocks stand on shelves by the first letters of their place: sums over shelves, then over the blocks of each
    shelf = by_block.groupBy("__source", "shelf").agg(F.sum("in_block").alias("in_shelf"))
    before = Window.partitionBy("__source").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    shelf = shelf.select("__source", "shelf", F.coalesce(F.sum("in_shelf").over(before), F.lit(0)).alias("before"))
    before = Window.partitionBy("__source", "shelf").orderBy("place", "__block").rowsBetween(Window.unboundedPreceding, -1)
    done = (F.col("before") + F.coalesce(F.sum("in_block").over(before), F.lit(0))).alias("__done")
    by_block = materialise(by_block.join(shelf, ["__source", "shelf"]).select("__source", "__block", done), "mix-places")

    rows = docs.join(weights, "__source").withColumn("__block", block(key)).join(small_side(by_block, 64), ["__source", "__block"])
    inside = Window.partitionBy("__source", "__block").orderBy(hash_order(tag, F.col("__full").cast("string"), F.lit("row"), key), key, "__n_tokens", "__tie")
    upto = F.sum("__n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    once = F.when((F.col("__n_tokens") > 0) & (F.col("__done") + upto <= F.col("__left")), 1).otherwise(0)
    return rows.withColumn("__copies", (F.col("__full") + once).cast("long"))


def mixture(
    docs: DataFrame, entropy: float | None = None, max_epochs: float | None = 2.0, budget: int | None = None, seed: int = 0, block_rows: int = 1024
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n_tokens, weight, epochs, copies (how often the mixture holds it)."""
    rows = materialise(docs.select(*(c.alias(n) for n, c in asked().items())), "mix-rows")
    rows = with_copies(rows, rows, entropy, max_epochs, budget, seed, block_rows)
    return rows.select(F.col("__id").alias("doc_id"), *(F.col(f"__{c}").alias(c) for c in ("source", "n_tokens", "weight", "epochs", "copies")))


def mix(
    docs: DataFrame, entropy: float | None = None, max_epochs: float | None = 2.0, budget: int | None = None, seed: int = 0, block_rows: int = 1024
) -> DataFrame:
    """``docs`` with each row as often as the mixture holds it; all columns kept."""
    rows = docs.withColumns(asked())
    small = materialise(rows.select("__id", "__source", "__n_tokens"), "mix-rows")
    held = with_copies(rows, small, entropy, max_epochs, budget, seed, block_rows).where("__copies > 0")
    return held.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(docs[c] for c in docs.columns))
