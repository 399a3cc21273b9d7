"""Hard negatives by exact integer products, many candidates to one multiplication.

Components become whole numbers, floor(256 x).  A block of candidates is packed
by Kronecker substitution: for every component, the candidates' values, made
non-negative by a bias, stand in fields of one wide integer.  An anchor
multiplies each of these integers once by its own component and adds them up;
every field then holds one candidate's exact product, as fields are made wide
enough for the largest sum in the block, and the bias is taken out again.

Anchors and candidates meet block by block.  Candidate blocks hold one label,
so an anchor's positives are looked for in its label's blocks and its negatives
in all others, and every product is made once.  Out of a block come an anchor's
first rows only, of which Spark takes the first over all blocks.  Blocks of a
common label are as large as any other's; their number grows with its rows.

Defined results: rows with a null label or vector, or with a null or
non-finite component, take no part; a shorter vector counts as filled up with
zeros; products beyond a long count as its nearest end; an anchor's other rows
are those with another id; rows that repeat an id each take part as candidates,
equal anchors are answered once, and anchors that share an id but not label and
vector are answered each; a null id is never an anchor and comes last among
equal scores; an anchor without positives, or a positive without negatives,
gives no rows; empty tables give an empty result; further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Rows of a block of candidates and of anchors.
CANDIDATES, ANCHORS = 4096, 2048
#: One unit of a component.
SCALE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Packed:
    """A block of candidates' components in the fields of wide integers, one integer for each component."""

    def __init__(self, vectors: list[list[int]], largest: int):
        """``largest`` bounds the size of the components that will be multiplied with."""
        self.n, self.dim = len(vectors), max(map(len, vectors), default=0)
        self.bias = max(0, -min((x for v in vectors for x in v), default=0))
        top = max((x for v in vectors for x in v), default=0) + self.bias
        #: Added to every field, so that none is negative; also the largest sum's size.
        self.lift = self.dim * top * largest
        self.width = _field(max(2 * self.lift, top))
        columns = zip(*(v + [0] * (self.dim - len(v)) for v in vectors))
        self.columns = [self._wide([x + self.bias for x in c]) for c in columns]
        self.lifts = self._wide([self.lift] * self.n)

    def _wide(self, fields: list[int]) -> int:
        if self.width <= 8:
            return int.from_bytes(np.array(fields, f"<u{self.width}").tobytes(), "little")
        return int.from_bytes(b"".join(x.to_bytes(self.width, "little") for x in fields), "little")

    def products(self, anchor: list[int]) -> np.ndarray:
        """The exact inner product with every candidate of the block."""
        total = self.lifts
        for x, column in zip(anchor, self.columns):
            if x:
                total += x * column
        taken = self.lift + self.bias * sum(anchor[: self.dim])
        content = total.to_bytes(self.width * self.n, "little")
        # with fields of up to four bytes everything fits in a long
        if self.width <= 4:
            return np.frombuffer(content, f"<u{self.width}").astype("i8") - taken
        fields = (content[i : i + self.width] for i in range(0, len(content), self.width))
        return np.array([min(max(int.from_bytes(f, "little") - taken, LEAST), MOST) for f in fields], "i8")


def _field(largest: int) -> int:
    """Bytes of a field: 1, 2, 4 or 8, or as many as needed."""
    need = max(1, -(-largest.bit_length() // 8))
    return next((w for w in (1, 2, 4, 8) if w >= need), need)


def whole(vectors: list[list[float]]) -> list[list[int]]:
    """floor(256 x) of every component, exact at any size."""
    return [[math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in v] for v in vectors]


def _first(scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the places ``among``: higher scores first, then smaller ids, null ids last."""
    if len(among) > most:
        least = np.partition(scores[among], len(among) - most)[len(among) - most]
        among = among[scores[among] >= least]
    # ~score falls as the score grows, at every score
    return among[np.lexsort((ids[among], no_id[among], ~scores[among]))[:most]]


class Block:
    """A unit's candidates: packed components with ids and labels."""

    def __init__(self, candidates: pa.Table, largest: int):
        ids = candidates.column("id")
        self.packed = Packed(whole(candidates.column("vector").to_pylist()), largest)
        self.no_id = np.array(ids.is_null().to_pylist(), bool)
        self.ids = np.array(ids.fill_null(0).to_pylist(), "i8")
        self.labels = np.array(candidates.column("label").to_pylist(), object)

    def others(self, anchor_id: int) -> np.ndarray:
        return self.no_id | (self.ids != anchor_id)

    def first(self, scores: np.ndarray, allowed: np.ndarray, most: int) -> list[tuple[int | None, int]]:
        found = _first(scores, self.ids, self.no_id, np.flatnonzero(allowed), most)
        return [(None if self.no_id[i] else int(self.ids[i]), int(scores[i])) for i in found]


def _met(candidates: pa.Table, anchors: pa.Table) -> Iterator[tuple[dict, Block, np.ndarray]]:
    """Every anchor of a unit with the block and its products."""
    if not (candidates.num_rows and anchors.num_rows):
        return
    vectors = whole(anchors.column("vector").to_pylist())
    block = Block(candidates, max((abs(x) for v in vectors for x in v), default=0))
    for anchor, vector in zip(anchors.drop_columns("vector").to_pylist(), vectors):
        yield anchor, block, block.packed.products(vector)


def _positives(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        found = [
            (anchor["key"], *row)
            for anchor, block, scores in _met(candidates, anchors)
            for row in block.first(scores, block.others(anchor["id"]), most)
        ]
        return _table(found, ["key", "positive_id", "positive_score"])

    return run


def lowest(positive: int, least_percent: int) -> int:
    """The smallest whole score of which 100 times is at least ``least_percent`` times the positive's."""
    return -(-least_percent * positive // 100)


def _negatives(most: int, least_percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        for anchor, block, scores in _met(candidates, anchors):
            other = (block.labels != anchor["label"]) & block.others(anchor["id"])
            for place, positive in enumerate(anchor["scores"]):
                low = lowest(positive, least_percent)
                if low <= positive:
                    allowed = other & (scores >= max(low, LEAST)) & (scores <= positive)
                    found += [(anchor["key"], place, *row) for row in block.first(scores, allowed, most)]
        return _table(found, ["key", "place", "negative_id", "negative_score"])

    return run


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def _blocks(rows: str, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / size)).cast("int")


def _block(salt: int, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "key"), F.col(blocks)).cast("int")


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _ranked(found: DataFrame, of: list[str], value: str, most: int) -> DataFrame:
    """The first rows of each group over all blocks, with their rank."""
    order = Window.partitionBy(*of).orderBy(F.desc(f"{value}_score"), F.asc_nulls_last(f"{value}_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    candidate_block: int = CANDIDATES,
    anchor_block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``anchor`` holds.

    ``anchor`` is a condition on the column ``id``.  A positive is one of the
    first rows of the anchor's label; its negatives are the first rows of other
    labels whose score is at most the positive's and at least
    ``least_percent`` per cent of it.  Ids are longs, labels of any type.
    """
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    took = rows.where(F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        vector.cast("array<double>").alias("vector"),
    )
    # a number for each row, fixed by writing it: equal rows fall into different blocks
    numbered = stored(took.withColumn("key", F.monotonically_increasing_id()), "vectors")
    chosen = numbered.where(F.col("id").isNotNull() & anchor)
    anchors = stored(chosen.groupBy("id", "label", "vector").agg(F.min("key").alias("key")), "anchors")

    total = numbered.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    asking = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("asked"))
    sizes = total.join(asking, "label").select(
        "label", _blocks("rows", candidate_block).alias("cs"), _blocks("asked", anchor_block).alias("as")
    )
    sizes = stored(sizes, "label-sizes")  # read from files, a common label's join can be split
    unit = ["label", "c", "a"]
    left = numbered.join(sizes, "label").select("id", "label", "vector", _block(1, "cs").alias("c"), _every("as").alias("a"))
    right = anchors.join(sizes, "label").select("key", "id", "label", "vector", _block(2, "as").alias("a"), _every("cs").alias("c"))
    near = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(
        _positives(positives), "key long, positive_id long, positive_score long"
    )
    near = stored(_ranked(near, ["key"], "positive", positives), "positives")

    # an anchor's few positives travel with it; a place in its list stands for each
    listed = near.groupBy(F.col("key").alias("of")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("l"))
    scores = F.transform("l", lambda p: p["positive_score"]).alias("scores")
    (n_rows,), (n_anchors,) = (t.agg(F.count(F.lit(1))).first() for t in (numbered, anchors))
    blocks = [F.lit(max(1, -(-n // b))).alias(k) for n, b, k in ((n_rows, candidate_block, "cs"), (n_anchors, anchor_block, "as"))]
    unit = ["c", "a"]
    left = numbered.select("*", *blocks).select("id", "label", "vector", _block(3, "cs").alias("c"), _every("as").alias("a"))
    right = anchors.join(listed, F.col("key") == F.col("of")).select("*", *blocks).select(
        "key", "id", "label", "vector", scores, _block(4, "as").alias("a"), _every("cs").alias("c")
    )
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(
        _negatives(negatives, least_percent), "key long, place long, negative_id long, negative_score long"
    )
    hard = _ranked(found, ["key", "place"], "negative", negatives)
    hard = hard.select(F.col("key").alias("of"), (F.col("place") + 1).alias("at"), "rank", "negative_id", "negative_score")
    named = near.withColumnRenamed("rank", "at").join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return hard.join(named, (F.col("of") == F.col("key")) & (hard["at"] == named["at"])).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
