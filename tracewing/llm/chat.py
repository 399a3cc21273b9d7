"""Chat logs to training text: cumulative snapshots collapse, maximal conversations are rendered.

A log that stores a conversation again after every turn holds each beginning
as a conversation of its own.  Every turn gets the hash of its conversation up
to there; a conversation whose whole hash is met inside a longer one is that
one's beginning and is removed by an anti-join, and of equal conversations the
one with the least id stays.

Turns are range-partitioned by conversation and turn, so a conversation of any
length is spread over tasks: positions and hashes are made inside each range
and continued by one row for each conversation and range.  Hashes of turns,
salted with the position, are combined by exclusive or, twice 64 bits wide.
Rendered text comes in parts of ``PART`` turns, so no task gathers more.

Defined results: turns sort by number (null first), then by a hash of role and
text; rows that repeat conversation, turn, role and text are one turn; a null
conversation id is an id; a null role is rendered as ``unknown`` and differs
from that word in comparisons, a null text as nothing; a start or end mark
inside a text is broken by a space; an empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Turns of a rendered row.
PART = 64
START, END = "<|im_start|>", "<|im_end|>"
HASH = ("at", "x1", "x2")


def _content(salt: int, *more: Column) -> Column:
    """A hash of role and text in which null differs from every word."""
    return F.xxhash64(F.lit(salt), F.col("role").isNull(), "role", F.col("text").isNull(), "text", *more)


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _continued(rows: DataFrame, totals: dict[str, Column], combined: dict[str, Column]) -> DataFrame:
    """One row for each conversation and range: what all earlier ranges of the conversation come to."""
    sums = rows.groupBy("conv", "range").agg(*[e.alias(n) for n, e in totals.items()])
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(e.over(before), F.lit(0)).alias(f"before_{n}") for n, e in combined.items()]
    return sums.select(F.col("conv").alias("of_conv"), F.col("range").alias("of_range"), *earlier)


def turn_prefixes(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, at, role, text, x1, x2) of every turn: its position from 1 and the hash of the conversation up to it."""
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    rows = rows.withColumns({"h1": _content(1), "h2": _content(2)})
    rows = rows.groupBy("conv", "turn", "h1", "h2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    ranged = rows.repartitionByRange("conv", "turn", "h1", "h2").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "turns")

    def with_earlier(df: DataFrame, earlier: DataFrame) -> DataFrame:
        on = _same("conv", "of_conv") & (F.col("range") == F.col("of_range"))
        return df.join(earlier, on).drop("of_conv", "of_range")

    inside = Window.partitionBy("range", "conv").orderBy("turn", "h1", "h2")
    count = _continued(ranged, {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    placed = with_earlier(ranged.withColumn("local", F.row_number().over(inside)), count)
    placed = placed.withColumn("at", (F.col("local") + F.col("before_n")).cast("bigint")).drop("local", "before_n")
    placed = stored(
        placed.withColumns({"t1": _content(3, F.col("at")), "t2": _content(4, F.col("at"))}), "placed-turns"
    )
    sums = {n: F.bit_xor(n) for n in ("t1", "t2")}
    up_to = Window.partitionBy("range", "conv").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumns({"l1": F.bit_xor("t1").over(up_to), "l2": F.bit_xor("t2").over(up_to)})
    return with_earlier(rolled, _continued(placed, sums, sums)).select(
        "conv", "at", "role", "text",
        F.col("l1").bitwiseXOR(F.col("before_t1")).alias("x1"), F.col("l2").bitwiseXOR(F.col("before_t2")).alias("x2"),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, n_turns) of the conversations that no longer or equal one with a smaller id begins with."""
    narrow = prefixes.select("conv", *HASH)
    whole = narrow.groupBy("conv").agg(F.max(F.struct(*HASH)).alias("last")).select("conv", "last.*")
    wholes = whole.groupBy(*HASH).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("conv").isNull().alias("none"), "conv")).alias("first")
    )
    met = narrow.groupBy(*[F.col(c).alias(f"met_{c}") for c in HASH]).agg(F.count(F.lit(1)).alias("n_met"))
    # met more often than conversations end there: some conversation goes on after it
    longer = F.col("n_met") > F.col("copies")
    for c in HASH:
        longer = longer & (F.col(c) == F.col(f"met_{c}"))
    kept = wholes.join(met, longer, "left_anti")
    return kept.select("first.conv", F.col("at").alias("n_turns"))


def _unmarked(text: Column) -> Column:
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit("< " + mark[1:]))
    return text


def rendered_turn(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("unknown")), F.coalesce(text, F.lit(""))
    return F.concat(F.lit(START), _unmarked(role), F.lit("\n"), _unmarked(text), F.lit(END + "\n"))


def format_conversations(turns: DataFrame, part: int = PART, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """(conversation id, n_turns, part, text) of the maximal conversations; parts in order make the whole text."""
    prefixes = stored(turn_prefixes(turns, conv_col, **columns), "prefixes")
    kept = stored(maximal(prefixes), "maximal").withColumnRenamed("conv", "kept_conv")
    rows = prefixes.join(kept, _same("conv", "kept_conv"))
    piece = F.struct("at", rendered_turn(F.col("role"), F.col("text")).alias("said"))
    parts = rows.groupBy("conv", "n_turns", F.floor((F.col("at") - 1) / part).alias("part")).agg(
        F.sort_array(F.collect_list(piece)).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["said"]), "")
    return parts.select(F.col("conv").alias(conv_col), "n_turns", "part", text.alias("text"))
