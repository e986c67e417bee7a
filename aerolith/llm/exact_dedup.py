"""Exact dedup through content-defined chunk recipes (operator 4); DataFrame functions only.

A text is cut into chunks at places that its own characters decide: a chunk runs for at least ``min_chars``, then to
the next sentence end or line end, and is cut at ``max_chars`` where none comes. A chunk's identifier is its SHA-256;
the chunk store groups all identifiers and fails the job if one identifier ever stood for chunks of different length
or different XXH64, so identifiers are verified. Two texts are equal if their ordered identifier lists are; only these
lists (32 bytes for about ``min_chars`` characters) are shuffled, never the texts.

Defined results: a null text counts as empty and equals an empty one; a null doc_id sorts below all others; of equal
texts the row with the largest doc_id stays, and of repeated rows with that doc_id exactly one; other columns, whatever
their names, are ignored by :func:`exact_groups` and kept by :func:`drop_exact_copies`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import join_by_size, materialise, passing, text_or_empty, without


def chunks_of(text: Column, min_chars: int, max_chars: int) -> Column:
    """Array of content-defined chunks; their concatenation is the text."""
    cut = r"(?<=[\n.!?;|。！？])"
    pattern = rf"(?s)(?:.{{{min_chars},{max_chars}}}?{cut}|.{{1,{max_chars}}})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, min_chars: int = 768, max_chars: int = 8192) -> DataFrame:
    """One row per row of ``docs``: row_uid, doc_id, n_bytes, text_sha256 and the recipe (chunks' identifiers in order)."""
    text = text_or_empty()
    chunk = F.transform(
        chunks_of(F.col("text"), min_chars, max_chars),
        lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("id"), F.xxhash64(c).alias("check"), F.octet_length(c).alias("n")),
    )
    return docs.select(F.monotonically_increasing_id().alias("row_uid"), F.col("doc_id").cast("long"), text.alias("text")).select(
        "row_uid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), chunk.alias("recipe")
    )


def chunk_store(recipe_rows: DataFrame) -> DataFrame:
    """Distinct chunks: chunk, n_bytes, n_uses and the verified identifier (first_row, first_pos), where it stood first.

    Fails if one digest ever stood for two chunks.
    """
    same = (F.min("c.check") == F.max("c.check")) & (F.min("c.n") == F.max("c.n"))
    first = F.when(F.col("same"), F.col("first")).otherwise(F.raise_error(F.lit("two chunks share a digest")).cast("struct<row_uid:bigint,pos:int>"))
    return (
        recipe_rows.select("row_uid", F.posexplode("recipe").alias("pos", "c"))
        .groupBy(F.col("c.id").alias("chunk"))
        .agg(F.min("c.n").alias("n_bytes"), F.count(F.lit(1)).alias("n_uses"), F.min(F.struct("row_uid", "pos")).alias("first"), same.alias("same"))
        .select("chunk", "n_bytes", "n_uses", first.alias("first"))
        .select("chunk", "n_bytes", "n_uses", F.col("first.row_uid").alias("first_row"), F.col("first.pos").alias("first_pos"))
    )


def identified(recipe_rows: DataFrame) -> DataFrame:
    """``recipe_rows`` with ``ids``, the ordered list of verified identifiers, and ``new_bytes``."""
    uses = recipe_rows.select("row_uid", F.posexplode("recipe").alias("pos", "c")).select("row_uid", "pos", F.col("c.id").alias("chunk"))
    # dealt anew before the join, so that the uses of a hot chunk can be split there
    store = chunk_store(recipe_rows).repartition(int(recipe_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    new = (F.col("first_row") == F.col("row_uid")) & (F.col("first_pos") == F.col("pos"))
    lists = (
        uses.join(store, "chunk")
        .groupBy("row_uid")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "first_row", "first_pos"))).alias("ids"), F.sum(F.when(new, F.col("n_bytes"))).alias("new_bytes"))
        .withColumn("ids", F.transform("ids", lambda c: F.struct(c["first_row"], c["first_pos"])))
    )
    return recipe_rows.drop("recipe").join(lists, "row_uid", "left")


def exact_groups(docs: DataFrame, min_chars: int = 768, max_chars: int = 8192) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks, new_bytes.

    ``new_bytes`` is what a chunk store gains from the row: the bytes of chunks that no row before it holds.
    """
    with passing() as keep:
        rows = identified(materialise(recipes(docs, min_chars, max_chars), "recipes"))
        rows = keep(materialise(rows.withColumn("ids", F.coalesce("ids", F.array().cast("array<struct<first_row:bigint,first_pos:int>>"))), "identified"))
    groups = materialise(groups_of(rows), "groups")
    return join_by_size(rows, groups, "ids", "group_size", F.size("ids") * 16 + 64).select(
        "doc_id", "keep_id", "group_size", (F.col("row_uid") == F.col("keep_uid")).alias("kept"), "text_sha256",
        "n_bytes", F.size("ids").cast("long").alias("n_chunks"), F.coalesce("new_bytes", F.lit(0)).cast("long").alias("new_bytes"),
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """ids, keep_id, keep_uid, group_size of each set of rows with the same ordered identifiers.

    Fails if one list of identifiers ever stood for two texts.
    """
    return (
        rows.groupBy("ids")
        .agg(
            F.max(F.struct("doc_id", "row_uid")).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
            F.min("text_sha256").alias("low"),
            F.max("text_sha256").alias("high"),
        )
        .select(
            "ids",
            F.when(F.col("low") == F.col("high"), F.col("best.doc_id")).otherwise(F.raise_error(F.lit("one recipe, two texts")).cast("long")).alias("keep_id"),
            F.col("best.row_uid").alias("keep_uid"),
            "group_size",
        )
    )


def drop_exact_copies(docs: DataFrame, min_chars: int = 768, max_chars: int = 8192) -> DataFrame:
    """``docs`` without exact copies: of equal texts one row stays, the one with the largest doc_id; all columns kept."""
    stays = F.col("__id").eqNullSafe(F.col("keep_id"))
    with passing() as keep:
        groups = exact_groups(docs, min_chars, max_chars).select(F.col("doc_id").alias("__id"), "keep_id", F.col("text_sha256").alias("__digest"))
        rows = keep(materialise(groups.groupBy("__id", "keep_id", "__digest").agg(F.count(F.lit(1)).alias("n")), "copies"))
    names = ("__id", "__digest")
    return without(docs, rows.where(~stays).select(*names), rows.where(stays & (F.col("n") > 1)).select(*names), F.sha2(text_or_empty(), 256))
