"""Repair of conversations by cheapest edits: rank-convergent parallel Viterbi and least-audit tracing.

A conversation should be an optional system turn and then user and assistant
turns in pairs.  Turns are kept, given another role or deleted, and empty turns
are inserted, at fixed costs; blank turns and turns seen before must go.  The
cheapest edits are a shortest path through four states: at the start, after a
system, a user and an assistant turn.

A conversation may hold a third of all rows, so it is cut into chunks of
``CHUNK`` turns.  Costs to the end are computed backwards, in all chunks at
once: each but the last starts from a speculative vector of costs, one number
for a state.  Fix-up passes then rerun the chunks whose right neighbour came to
another vector, from the right, only until old and new vectors differ by a
constant, as from there on all decisions are the same.  Passes end when no
chunk's vector changes; mostly that is after the first.  With the stitched
costs, every chunk is traced forwards from each of the four states; the states
in which chunks are entered follow from these short tables, block by block, and
a last pass gives the edits of each turn.  Of equally cheap edits those come
out whose letters in order (D, I, K, R) are least.

Turns that must go leave costs and states as they are, so they take part in
positions and counts but not in the search.  Equal turns of a conversation
(same number, role and text) are one row with a count from the start.

Defined results: turns sort by number (null first), then by role, then by the
text's digest; texts are compared by 128-bit digests; a null role or text
counts as one space; a null conversation id is an id; a role that begins with
none of s, u and a, or is empty, can't be kept; an empty table gives an empty
result; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Turns of a chunk, and chunks whose tables are put together in one row.
CHUNK, FAN = 128, 256
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The role that fits in each state (start, after system, user, assistant), and the state behind it.
WANTED, AFTER = "uuau", (2, 2, 3, 2)
NAMES = {"u": "user", "a": "assistant"}
Costs = tuple[int, int, int, int]
#: Costs to the end when no turn is left: a pair or its second half is inserted.
AT_END: Costs = (0, 2 * INSERT, INSERT, 0)
UNKNOWN: Costs = (0, 0, 0, 0)


def kept_state(state: int, code: str) -> int | None:
    """The state behind a kept turn; None where its role does not fit."""
    if code in "sS":
        return 1 if state == 0 else None
    return AFTER[state] if code.lower() == WANTED[state] else None


def costs_before(after: Costs, code: str) -> Costs:
    """Costs to the end from before a turn, given those behind it; upper case codes are truncated turns."""
    left = TRUNCATED if code.isupper() else 0
    costs = []
    for state in range(4):
        least = min(DELETE + after[state], REROLE + left + after[AFTER[state]])
        to = kept_state(state, code)
        costs.append(least if to is None else min(least, left + after[to]))
    second, third = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return min(costs[0], INSERT + second), min(costs[1], INSERT + second), second, third


def parallel(a: Costs, b: Costs) -> bool:
    """Whether two vectors differ by a constant only."""
    return len({x - y for x, y in zip(a, b)}) == 1


def normal(costs: Costs) -> Costs:
    least = min(costs)
    return tuple(x - least for x in costs)


def run_back(codes: str, right: Costs) -> Costs:
    """The vector at a chunk's left end."""
    for code in reversed(codes):
        right = costs_before(right, code)
    return right


def fix_up(codes: str, old_right: Costs, old_left: Costs, right: Costs) -> tuple[Costs, int]:
    """The left vector for another right one, and how many turns were run again before the vectors got parallel."""
    old, new = old_right, right
    for done, code in enumerate(reversed(codes)):
        if parallel(old, new):
            return tuple(x + new[0] - old[0] for x in old_left), done
        old, new = costs_before(old, code), costs_before(new, code)
    return new, len(codes)


def trace(codes: str, right: Costs, state: int, last: bool) -> tuple[list[str], int]:
    """The edits of each turn from a state on, least letters first, and the state behind the chunk.

    Inserted and given roles follow their letter.  With ``last``, one more
    entry has what is inserted at the end.
    """
    vectors = [right]
    for code in reversed(codes):
        vectors.append(costs_before(vectors[-1], code))
    edits = []
    for place, code in enumerate(codes):
        before, after = vectors[len(codes) - place], vectors[len(codes) - place - 1]
        left, said = TRUNCATED if code.isupper() else 0, ""
        while True:
            cost, to = before[state], kept_state(state, code)
            if cost == DELETE + after[state]:
                said += "D"
            elif cost == INSERT + before[AFTER[state]]:
                said, state = f"{said}I{WANTED[state]}", AFTER[state]
                continue
            elif to is not None and cost == left + after[to]:
                said, state = said + "K", to
            else:
                said, state = f"{said}R{WANTED[state]}", AFTER[state]
            break
        edits.append(said)
    if last:
        said = ""
        while AT_END[state]:
            said, state = f"{said}I{WANTED[state]}", AFTER[state]
        edits.append(said)
    return edits, state


# --- turns, faults and places ---------------------------------------------------------------------------------------


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        said(role_col).alias("role"), said(text_col).alias("text"),
    )
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary")))


KEY = ("conv", "turn", "role", "digest")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct turns with their copies: blank, seen (another turn before has role and text) and truncated."""
    ending = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    narrow = rows.select(*KEY, (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("truncated"))
    distinct = stored(
        narrow.groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")
        ),
        "distinct-turns",
    )
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = distinct.where("not blank").groupBy("conv", "role", "digest").agg(F.min(order).alias("first"))
    # read from files, a text that fills a conversation can be split in the join
    first = stored(first, "first-turns").select(*[F.col(c).alias(f"of_{c}") for c in ("conv", "role", "digest")], "first")
    met = _same("conv", "of_conv") & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    plain = distinct.where("not blank").join(first, met)
    seen = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    marked = plain.select(*KEY, "copies", "blank", "truncated", seen.alias("seen"))
    return marked.unionByName(distinct.where("blank").withColumn("seen", F.lit(False)))


def placed(marked: DataFrame) -> DataFrame:
    """Turns with their place among all and among the searched turns of the conversation, from 1, and the initial before."""
    ranged = marked.withColumns(
        {"searched": (~F.col("blank") & ~F.col("seen")).cast("bigint"), "initial": F.substring("role", 1, 1)}
    )
    ranged = ranged.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "ranged-turns")
    inside = Window.partitionBy("range", "conv").orderBy("turn", "role", "digest")
    local = ranged.withColumns(
        {
            "place": F.row_number().over(inside).cast("bigint"),
            "search_place": F.sum("searched").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "previous": F.lag("initial").over(inside),
        }
    )
    # one row for each conversation and range: what the ranges before it come to
    order = F.struct("turn", "role", "digest", "initial")
    sums = ranged.groupBy("conv", "range").agg(
        F.count(F.lit(1)).alias("n"), F.sum("searched").alias("ns"), F.max(order).getField("initial").alias("final")
    )
    before = Window.partitionBy("conv").orderBy("range")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv").alias("of_conv"),
        F.col("range").alias("of_range"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("places"),
        F.coalesce(F.sum("ns").over(earlier), F.lit(0)).alias("search_places"),
        F.sum("ns").over(Window.partitionBy("conv")).alias("n_searched"),
        F.sum("n").over(Window.partitionBy("conv")).alias("n_places"),
        F.lag("final").over(before).alias("before"),
    )
    joined = local.join(sums, _same("conv", "of_conv") & (F.col("range") == F.col("of_range")))
    return joined.select(
        *KEY, "copies", "blank", "seen", "truncated", "searched", "initial", "n_searched", "n_places",
        (F.col("place") + F.col("places")).alias("place"),
        (F.col("search_place") + F.col("search_places")).alias("search_place"),
        F.coalesce("previous", "before").alias("previous"),
    )


def summary(places: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, forced) of every conversation."""
    pair = F.concat("previous", "initial")
    illegal = F.col("copies") - 1 + F.coalesce((~pair.isin("su", "ua", "au")).cast("int"), F.lit(0))
    searched = F.col("searched") == 1
    duplicate = F.when(F.col("blank"), 0).when(F.col("seen"), F.col("copies")).otherwise(F.col("copies") - 1)
    blank = F.when(F.col("blank"), F.col("copies")).otherwise(0)
    numbers = places.groupBy("conv", "turn").agg(
        F.sum(blank).alias("blank"),
        F.sum(duplicate).alias("duplicate"),
        F.sum((searched & F.col("truncated")).cast("int")).alias("truncated"),
        F.sum(illegal).alias("illegal"),
    )
    counts = ("blank", "duplicate", "truncated", "illegal")
    totals = numbers.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).cast("bigint").alias(c) for c in counts],
    )
    return totals.withColumn("forced", F.col("blank") + F.col("duplicate"))


# --- costs backwards ------------------------------------------------------------------------------------------------


def chunks(places: DataFrame, size: int) -> DataFrame:
    """(conv, chunk, codes, last): the searched turns of each chunk, one letter a turn."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("truncated"), F.upper(known)).otherwise(known)
    number = F.floor((F.col("search_place") - 1) / size)
    rows = places.where("searched = 1").select(
        "conv", number.alias("chunk"), F.struct("search_place", code.alias("code")).alias("turn"), "n_searched"
    )
    grouped = rows.groupBy("conv", "chunk").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"), F.first("n_searched").alias("n_searched")
    )
    return grouped.select(
        "conv", "chunk", F.array_join(F.transform("turns", lambda t: t["code"]), "").alias("codes"),
        (F.floor((F.col("n_searched") - 1) / size) == F.col("chunk")).alias("last"),
    )


def _vectors(values: list[Costs]) -> pa.Array:
    return pa.array([list(v) for v in values], pa.list_(pa.int64()))


def _kind(df: DataFrame) -> str:
    return df.schema["conv"].dataType.simpleString()


def _back(codes: DataFrame) -> DataFrame:
    """First pass: (conv, chunk, right_end, left_end) of every chunk from its speculative or, at the end, true costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rights = [AT_END if x else UNKNOWN for x in batch.column("last").to_pylist()]
            lefts = [run_back(c, r) for c, r in zip(batch.column("codes").to_pylist(), rights)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("chunk"), _vectors(rights), _vectors(lefts)],
                ["conv", "chunk", "right_end", "left_end"],
            )

    return codes.mapInArrow(run, f"conv {_kind(codes)}, chunk long, right_end array<long>, left_end array<long>")


def _again(rows: DataFrame) -> DataFrame:
    """Fix-up pass over (conv, chunk, codes, right_end, left_end, new_right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [map(tuple, batch.column(c).to_pylist()) for c in ("right_end", "left_end", "new_right")]
            rights, lefts = [], []
            for codes, old_right, old_left, right in zip(batch.column("codes").to_pylist(), *ends):
                rights.append(right)
                lefts.append(fix_up(codes, old_right, old_left, right)[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("chunk"), _vectors(rights), _vectors(lefts)],
                ["conv", "chunk", "right_end", "left_end"],
            )

    return rows.mapInArrow(run, f"conv {_kind(rows)}, chunk long, right_end array<long>, left_end array<long>")


def _normal(vector: str) -> Column:
    return F.transform(vector, lambda x: x - F.array_min(vector))


def stitched(codes: DataFrame) -> DataFrame:
    """(conv, chunk, right_end, left_end) of every chunk with the true costs at its right end, up to a constant."""
    ends = stored(_back(codes), "chunk-costs")
    while True:
        behind = ends.select(
            F.col("conv").alias("of_conv"), (F.col("chunk") - 1).alias("of_chunk"), _normal("left_end").alias("new_right")
        )
        met = _same("conv", "of_conv") & (F.col("chunk") == F.col("of_chunk"))
        changed = ends.join(behind, met).where(_normal("right_end") != F.col("new_right")).drop("of_conv", "of_chunk")
        changed = stored(changed, "changed-costs")
        if changed.isEmpty():
            return ends
        text = codes.select(F.col("conv").alias("of_conv"), F.col("chunk").alias("of_chunk"), "codes")
        redone = _again(changed.join(text, met).drop("of_conv", "of_chunk"))
        gone = changed.select(F.col("conv").alias("of_conv"), F.col("chunk").alias("of_chunk"))
        ends = stored(ends.join(gone, met, "left_anti").unionByName(redone), "chunk-costs")


# --- tracing forwards -----------------------------------------------------------------------------------------------


def _exits(rows: DataFrame) -> DataFrame:
    """(conv, no, exits): the state behind each chunk for each of the four states before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("codes", "right_end", "last"))
            exits = [[trace(c, tuple(r), s, x)[1] for s in range(4)] for c, r, x in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("chunk"), pa.array(exits, pa.list_(pa.int32()))], ["conv", "no", "exits"]
            )

    return rows.mapInArrow(run, f"conv {_kind(rows)}, no long, exits array<int>")


def entered(exits: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv, no, state): the state in which each of (conv, no, exits) is entered, the first of a conversation in 0.

    ``fan`` neighbours are put together in a row with the exits of them all;
    these rows are treated the same way until one is left for a conversation.
    """
    members = F.sort_array(F.collect_list(F.struct("no", "exits"))).alias("members")
    blocks = stored(exits.groupBy("conv", F.floor(F.col("no") / fan).alias("block")).agg(members), "chunk-blocks")
    if blocks.where("block > 0").isEmpty():
        begun = blocks.withColumn("begin", F.lit(0))
    else:
        whole = F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda s: F.aggregate("members", s, lambda state, m: F.element_at(m["exits"], state + 1)),
        )
        above = entered(blocks.select("conv", F.col("block").alias("no"), whole.alias("exits")), fan)
        above = above.select(F.col("conv").alias("of_conv"), "no", F.col("state").alias("begin"))
        begun = blocks.join(above, _same("conv", "of_conv") & (F.col("block") == F.col("no"))).drop("of_conv", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, numbers, states = [], [], []
            rows = zip(batch.column("members").to_pylist(), batch.column("begin").to_pylist())
            for row, (of, state) in enumerate(rows):
                for member in of:
                    taken.append(row)
                    numbers.append(member["no"])
                    states.append(state)
                    state = member["exits"][state]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv").take(pa.array(taken, pa.int64())), pa.array(numbers, pa.int64()), pa.array(states, pa.int32())],
                ["conv", "no", "state"],
            )

    return begun.select("conv", "members", "begin").mapInArrow(run, f"conv {_kind(exits)}, no long, state int")


def _traced(rows: DataFrame, size: int) -> DataFrame:
    """(conv, search_place, edits) of (conv, chunk, codes, right_end, last, state); what ends a conversation has place null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("chunk", "codes", "right_end", "state", "last"))
            taken, places, edits = [], [], []
            for row, (chunk, codes, right, state, last) in enumerate(zip(*columns)):
                said, _ = trace(codes, tuple(right), state, last)
                taken += [row] * len(said)
                places += [*range(chunk * size + 1, chunk * size + len(codes) + 1), *[None] * last]
                edits += said
            conv = batch.column("conv").take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([conv, pa.array(places, pa.int64()), pa.array(edits, pa.string())], ["conv", "search_place", "edits"])

    return rows.mapInArrow(run, f"conv {_kind(rows)}, search_place long, edits string")


class Repair:
    """The repair of a table of turns: ``conversations`` has one row each, ``edits`` one for each edit.

    conversations: conv, gaps, blank, duplicate, truncated, illegal, cost.
    edits: conv, place, step, edit (D, I, K or R), times, role, text; place and
    step give the order, deleted copies are one row with their number, and the
    turns of a repaired conversation are the rows other than D.
    """

    def __init__(
        self,
        turns: DataFrame,
        conv_col: str = "conv_id",
        turn_col: str = "turn",
        role_col: str = "role",
        text_col: str = "text",
        chunk: int = CHUNK,
        fan: int = FAN,
    ):
        rows = _turns(turns, conv_col, turn_col, role_col, text_col)
        places = stored(placed(faults(rows)), "placed-turns")
        codes = stored(chunks(places, chunk), "chunk-codes")
        ends = stitched(codes)
        met = _same("conv", "of_conv") & (F.col("chunk") == F.col("of_chunk"))
        right = ends.select(F.col("conv").alias("of_conv"), F.col("chunk").alias("of_chunk"), "right_end", "left_end")
        known = stored(codes.join(right, met).drop("of_conv", "of_chunk"), "chunk-ends")
        states = entered(_exits(known), fan).select(F.col("conv").alias("of_conv"), F.col("no").alias("of_chunk"), "state")
        traced = stored(_traced(known.join(states, met).drop("of_conv", "of_chunk"), chunk), "traced-turns")

        # a chunk's costs begin at the least of its neighbour's, so these add up to the first chunk's start
        found = F.when(F.col("chunk") == 0, F.col("left_end")[0]).otherwise(F.array_min("left_end"))
        cost = known.groupBy(F.col("conv").alias("of_conv")).agg(F.sum(found).alias("found"))
        totals = summary(places).join(cost, _same("conv", "of_conv"), "left")
        total = F.col("forced") * DELETE + F.coalesce("found", F.lit(0))
        self.conversations = totals.select(
            "conv", "gaps", "blank", "duplicate", "truncated", "illegal", total.cast("bigint").alias("cost")
        )
        self.edits = self._edits(rows, places, traced)

    @staticmethod
    def _edits(rows: DataFrame, places: DataFrame, traced: DataFrame) -> DataFrame:
        said = traced.select(F.col("conv").alias("of_conv"), F.col("search_place").alias("of_place"), "edits")
        met = _same("conv", "of_conv") & (F.col("search_place") == F.col("of_place"))
        searched = places.where("searched = 1").join(said, met).select(*KEY, "copies", "place", "edits")
        # letters of a turn's edits in order, each with the role that follows it
        steps = F.posexplode(F.regexp_extract_all("edits", F.lit("([DIKR][ua]?)"))).alias("step", "said")

        def step(frame: DataFrame, *more: str) -> DataFrame:
            split = frame.select(*more, steps)
            return split.select(
                *more, "step", F.substring("said", 1, 1).alias("edit"), F.substring("said", 2, 1).alias("letter")
            )

        stepped = step(searched, *KEY, "place")
        given = F.when(F.col("letter") == "u", NAMES["u"]).when(F.col("letter") == "a", NAMES["a"])
        columns = ("conv", "place", "step", "edit", "times", "role", "text")

        inserted = stepped.where("edit = 'I'").withColumns({"times": F.lit(1).cast("bigint"), "role": given, "text": F.lit("")})
        # only turns that stay fetch their text, one of equal copies each
        texts = rows.select(*[F.col(k).alias(f"of_{k}") for k in KEY], "text")
        key = _same("conv", "of_conv") & _same("turn", "of_turn") & (F.col("role") == F.col("of_role"))
        stays = stepped.where("edit in ('K', 'R')")
        several = places.where("searched = 1 and copies > 1").select("conv", "place")
        kept = stays.join(texts, key & (F.col("digest") == F.col("of_digest"))).select(
            "conv", "place", "step", "edit", F.lit(1).cast("bigint").alias("times"), F.coalesce(given, "role").alias("role"), "text"
        )
        copied = several.select(F.col("conv").alias("of_conv"), F.col("place").alias("of_place"))
        same_place = _same("conv", "of_conv") & (F.col("place") == F.col("of_place"))
        single = kept.join(copied, same_place, "left_anti")
        repeated = kept.join(copied, same_place, "left_semi")
        # equal copies meet map-side, whatever their number
        repeated = repeated.groupBy("conv", "place", "step", "edit", "times", "role").agg(F.first("text").alias("text"))

        nothing = {"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
        deleted = stepped.where("edit = 'D'").withColumns({"times": F.lit(1).cast("bigint"), **nothing})
        copies = F.when(F.col("searched") == 1, F.col("copies") - 1).otherwise(F.col("copies"))
        forced = places.select(
            "conv", "place", F.lit(1 << 20).alias("step"), F.lit("D").alias("edit"), copies.cast("bigint").alias("times")
        ).where("times > 0").withColumns(nothing)

        ending = traced.where("search_place is null and edits <> ''").select("conv", "edits", F.lit(MOST).alias("place"))
        ending = step(ending, "conv", "place").withColumns({"times": F.lit(1).cast("bigint"), "role": given, "text": F.lit("")})
        frames = [inserted, single, repeated, deleted, forced, ending]
        whole = frames[0].select(*columns)
        for frame in frames[1:]:
            whole = whole.unionByName(frame.select(*columns))
        return whole


#: The place of what is inserted behind all turns.
MOST = (1 << 63) - 1


def digests(edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): the edits' letters in order, and the digest of the repaired role:text lines.

    A digest takes a conversation's lines one after the other, so they pass
    through one task, which keeps only the digest's state and the letters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, lines, begun = None, [], hashlib.sha256(), False
        group = None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [current, pa.array(["".join(audit)], pa.string()), pa.array([lines.hexdigest()])], ["conv", "audit", "repaired_sha256"]
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("group", "edit", "times", "role", "text"))
            for row, (of, edit, times, role, text) in enumerate(zip(*columns)):
                if of != group:
                    if group is not None:
                        yield result()
                    group, current = of, batch.column("conv").slice(row, 1)
                    audit, lines, begun = [], hashlib.sha256(), False
                audit.append(edit * times)
                if edit != "D":
                    lines.update(("\n" * begun + f"{role}:{text}").encode())
                    begun = True
        if group is not None:
            yield result()

    named = edits.withColumn("group", F.coalesce(F.concat(F.lit("+"), F.col("conv").cast("string")), F.lit("-")))
    sorted_rows = named.repartition("group").sortWithinPartitions("group", "place", "step")
    return sorted_rows.mapInArrow(run, f"conv {_kind(edits)}, audit string, repaired_sha256 string")
