"""Blocked Bloom filter as a table: one row of 256 bits for each block, in four 64-bit words.

A key sets two bits in each word of one block, so a probe touches one row.
The number of blocks is fixed by a parameter, which bounds what is broadcast
whatever the data's size.  With more keys than the filter has room for, more
rows pass falsely, and the exact step that follows every use handles them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import packed, whole_text

#: 32,768 blocks: 1 MiB of bits, about 0.1 % false passes at 500,000 keys.
BLOCKS = 1 << 15
#: Above this a filter is no longer small enough to broadcast.
MOST_BLOCKS = 1 << 20
WORDS = ("w0", "w1", "w2", "w3")


def _places(key: Column, blocks: int) -> list[Column]:
    """Block number and the four words' bits of a key."""
    bits = F.xxhash64(F.lit("bits"), key)
    six = [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)) for i in range(8)]
    one = [F.call_function("shiftleft", F.lit(1).cast("bigint"), s.cast("int")) for s in six]
    return [
        F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int"),
        *[one[2 * i].bitwiseOR(one[2 * i + 1]) for i in range(4)],
    ]


def build(keys: DataFrame, key: Column, blocks: int = BLOCKS) -> DataFrame:
    """The filter's rows (block, w0..w3) for all keys; bits meet map-side, so at most one row for each block and task moves."""
    if not 0 < blocks <= MOST_BLOCKS:
        raise ValueError(f"blocks must be between 1 and {MOST_BLOCKS}")
    block, *words = _places(key, blocks)
    rows = keys.select(block.alias("block"), *[w.alias(n) for w, n in zip(words, WORDS)])
    return rows.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in WORDS])


def mark(df: DataFrame, key: Column, filter_rows: DataFrame, name: str = "possible", blocks: int = BLOCKS) -> DataFrame:
    """Add whether the key may be in the filter: never false for a key that is.

    A null key is one key like any other.  The filter has at most ``blocks``
    rows of 36 bytes, which is the bound of the broadcast.
    """
    block, *words = _places(key, blocks)
    probe = df.select("*", F.struct(block.alias("block"), *[w.alias(n) for w, n in zip(words, WORDS)]).alias("_probe"))
    held = filter_rows.select(F.struct("block", *WORDS).alias("_held"))
    joined = probe.join(F.broadcast(held), F.col("_probe.block") == F.col("_held.block"), "left")
    hit = F.col("_held").isNotNull()
    for n in WORDS:
        hit = hit & (F.col(f"_held.{n}").bitwiseAND(F.col(f"_probe.{n}")) == F.col(f"_probe.{n}"))
    return joined.select(*df.columns, hit.alias(name))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, with their columns, whose id and text hash are not among the stored (gone, gone_text).

    Only rows whose id the filter passes are shuffled.
    """
    rows = packed(docs, F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("text_hash"))
    rows = mark(rows, F.col("id"), build(gone, F.col("gone")))
    same = F.col("id").eqNullSafe(F.col("gone")) & (F.col("text_hash") == F.col("gone_text"))
    suspects = rows.where("possible").join(gone, same, "left_anti")
    return rows.where("not possible").select("row.*").unionByName(suspects.select("row.*"))
