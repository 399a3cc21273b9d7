"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

One pass over the texts writes a narrow table of keys: id, length and the hash
of a prefix.  Lengths and then prefixes that only one row has are sorted out on
that table; keys meet map-side, so a group that holds a third of all rows costs
one row for each task.  What is left reaches the texts as a blocked Bloom filter
of ids, and only texts of surviving groups are hashed as a whole.  A row that
passes the filter falsely forms a group of one, where it ends; the filter never
decides.  Where the digest of every text is wanted, it belongs to the first
pass, and there is no second one.

Defined results: null text counts as empty; a null doc_id sorts after all
others and is the keeper only if its group has no other; rows that repeat both
doc_id and text are one document (all have doc_id = keep_id in
``exact_groups``, one of them stays in ``keep_first``); an empty table gives
an empty result; further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .tables import SPACE, packed, stored, whole_text

#: Characters of the normalised text that the second step hashes.
PREFIX = 256


def normalised(text: str = "text") -> Column:
    """The whole text with every run of white space as one space."""
    return F.regexp_replace(whole_text(text), SPACE, " ")


def text_keys(docs: DataFrame, id_col: str, text_col: str, digests: bool) -> DataFrame:
    """(id, size, prefix, digest) of every row, stored; the digest is null unless ``digests`` asks for it."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    keys = rows.select(
        "id",
        F.octet_length("norm").alias("size"),
        F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"),
        (F.sha2("norm", 256) if digests else F.lit(None).cast("string")).alias("digest"),
    )
    return stored(keys, "text-keys")


def surviving(keys: DataFrame) -> DataFrame:
    """The keys whose size, and then whose size and prefix, another row has, too; few others pass falsely."""
    several = F.col("n") > 1
    sizes = keys.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where(several)
    rows = bloom.mark(keys, F.col("size"), bloom.build(sizes, F.col("size"))).where("possible").drop("possible")
    key = F.struct("size", "prefix")
    prefixes = rows.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("n")).where(several)
    return bloom.mark(rows, key, bloom.build(prefixes, key)).where("possible").drop("possible")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, possible): possible is true for every row whose text another row may have."""
    survivors = surviving(text_keys(docs, id_col, text_col, False))
    rows = packed(docs, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return bloom.mark(rows, F.col("id"), bloom.build(survivors, F.col("id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256.

    The digest is made for survivors and is null for all others, unless
    ``digests`` asks for it everywhere.
    """
    if digests:
        rows = text_keys(docs, id_col, text_col, True)
        candidates = surviving(rows)
    else:
        digest = F.when(F.col("possible"), F.sha2(normalised(), 256)).alias("digest")
        rows = _marked(docs, id_col, text_col).select("id", F.octet_length("text").alias("size"), digest)
        rows = stored(rows, "text-digests")
        candidates = rows.where("digest is not null")
    groups = (
        candidates.groupBy(F.col("digest").alias("group_digest"))
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    groups = stored(groups, "exact-groups")  # read from files, both sides of the join can be split where a group is large
    # rows without a digest get keys that no group has, spread over all tasks
    at = F.coalesce(F.col("digest"), F.xxhash64("id", "size").cast("string"))
    joined = rows.withColumn("at", at).join(groups, F.col("at") == F.col("group_digest"), "left")
    alone = F.col("n").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("least")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("least"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies, with their columns: of equal texts, the row with the smallest id."""
    rows = _marked(docs, id_col, text_col)
    alone = rows.where(~F.col("possible")).select("row.*")
    order = F.struct(F.col("id").isNull(), F.col("id"))
    first = (
        rows.where("possible")
        .groupBy(F.sha2(normalised(), 256).alias("full_hash"))
        .agg(F.min_by("row", order).alias("row"))
        .select("row.*")
    )
    return alone.unionByName(first)
