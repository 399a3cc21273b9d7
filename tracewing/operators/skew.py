"""Neighbouring rows within a key, and joins on keys that both sides hold often, whatever share of the rows a key has.

A key of up to ``HEAVY`` rows is a window of its own.  Rows of a heavier one are
range-partitioned by key and order, so the ranges are even and the key is
spread over several of them: windows work inside a range, and the rows at a
range's ends look beyond it through a table with one row per range.  Only rows
of heavy keys are checkpointed for that, so both branches see the same ranges
and a lost executor does not change them.  Order and ties are total, so both
forms give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, stored

RANGE, TIE = "_range", "_tie"
#: Rows of a key that one task orders; there are at most rows / HEAVY heavier keys, which bounds their list.
HEAVY = 1_000_000


def heavy_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """``_h0, _h1.., _n``: the keys with more than ``limit`` rows; counted map-side, stored."""
    named = [F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]
    counts = df.groupBy(*named).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return stored(counts, "heavy-keys")


def _on(keys: Sequence[str]) -> Column:
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    return met


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ahead: dict[str, Column] | None = None,
    behind: dict[str, Column] | None = None,
    heavy: int = HEAVY,
) -> DataFrame:
    """Add expressions taken from the next (``ahead``) and previous (``behind``) row of the key.

    Rows follow ``order`` with NULL first; a hash of the whole row settles what
    that leaves open, so remaining ties are equal rows and the result does not
    depend on how the input was laid out.  Without ``keys`` all rows are one
    sequence, which is ranged.
    """
    ahead, behind = ahead or {}, behind or {}
    tied = df.withColumn(TIE, F.xxhash64(*[F.col(c) for c in df.columns]))
    line = [*keys, *[c for c in order if c not in keys], TIE]
    if not keys:
        return _ranged(tied, keys, line, ahead, behind, df.columns)
    large = heavy_keys(df, keys, heavy)
    inside = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in line[len(keys) :]])
    # few rows by their bound; Spark broadcasts them by their measured size
    plain = tied.join(large, _on(keys), "left_anti").select(
        *df.columns,
        *[F.lead(e).over(inside).alias(n) for n, e in ahead.items()],
        *[F.lag(e).over(inside).alias(n) for n, e in behind.items()],
    )
    if large.isEmpty():  # no rows to range
        return plain
    return plain.unionByName(_ranged(tied.join(large, _on(keys), "left_semi"), keys, line, ahead, behind, df.columns))


def _ranged(
    tied: DataFrame,
    keys: Sequence[str],
    line: Sequence[str],
    ahead: dict[str, Column],
    behind: dict[str, Column],
    columns: Sequence[str],
) -> DataFrame:
    ranged = settle(
        tied.repartitionByRange(*[F.col(c).asc_nulls_first() for c in line]).withColumn(RANGE, F.spark_partition_id())
    )

    def values(made: dict[str, Column]) -> Column:
        return F.struct(F.lit(True).alias("_there"), *[e.alias(n) for n, e in made.items()])

    inside = Window.partitionBy(RANGE, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in line[len(keys) :]])
    near = ranged.withColumns({"_next": F.lead(values(ahead)).over(inside), "_last": F.lag(values(behind)).over(inside)})

    # struct comparison orders field by field with NULL first, like the ranges
    key = F.struct(F.lit(0).alias("_k"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    place = F.struct(*[F.col(c) for c in line])
    ends = ranged.groupBy(F.col(RANGE).alias("_end_of")).agg(
        F.min_by(F.struct(key.alias("key"), values(ahead).alias("row")), place).alias("_first"),
        F.max_by(F.struct(key.alias("key"), values(behind).alias("row")), place).alias("_final"),
    )
    ranges = Window.orderBy("_end_of")  # one row per range
    beyond = ends.select(
        "_end_of", F.lead("_first").over(ranges).alias("_after"), F.lag("_final").over(ranges).alias("_before")
    )
    joined = near.join(F.broadcast(beyond), F.col(RANGE) == F.col("_end_of"), "left")
    following = F.coalesce("_next", F.when(F.col("_after.key").eqNullSafe(key), F.col("_after.row")))
    preceding = F.coalesce("_last", F.when(F.col("_before.key").eqNullSafe(key), F.col("_before.row")))
    found = joined.withColumns({"_next": following, "_last": preceding})
    return found.select(
        *columns,
        *[F.col(f"_next.{n}").alias(n) for n in ahead],
        *[F.col(f"_last.{n}").alias(n) for n in behind],
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, limit: int = HEAVY) -> DataFrame:
    """Inner join on one column in which a key that either side holds often is spread over many tasks.

    Rows of a heavy key are dealt into parts of about ``limit`` rows, and the
    other side's rows of that key are repeated once for each part, so every
    pair of rows meets exactly once.  NULL keys drop out.
    """
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    parts = []
    for side, rows in (("_l", left), ("_r", right)):
        counted = heavy_keys(rows, [key], limit)
        parts.append(counted.select("_h0", F.lit(side).alias("_side"), F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    # one row for each heavy key, with the number of parts of either side
    sides = parts[0].unionByName(parts[1]).groupBy("_h0").agg(
        *[F.coalesce(F.max(F.when(F.col("_side") == s, F.col("_parts"))), F.lit(1)).alias(s) for s in ("_l", "_r")]
    )
    sides = stored(sides, "heavy-sides")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        found = rows.join(sides, F.col(key) == F.col("_h0"), "left")
        own_part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return found.select(*rows.columns, own_part.alias(f"{own}_part"), every.alias(f"{other}_part"))

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [key, "_l_part", "_r_part"]).drop("_l_part", "_r_part")
