"""Near-duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Texts become sets of word shingles; equal sets are one class, so exact copies
cost nothing further.  Classes that share a band of MinHash values meet in a
bucket.  Candidate pairs compare their signatures batch by batch, and a pair
is dropped as soon as the posterior probability that its similarity reaches
the threshold falls below ``MISS``; what remains is decided on the full sets.

A bucket is never expanded into all pairs.  First each class is compared with
its bucket's first class.  Where that leaves a group in several components, all
classes outside the largest one are compared with the whole group, in blocks of
about ``BLOCK`` bytes: signatures and sets of two blocks meet in one task, and only
links between different components come out.  So no link between components is
lost, and most members of a large group of near copies are compared once.

Defined results: A to Z count as a to z; a text of fewer words than a shingle
has its whole word sequence as its one shingle; a null, empty or blank text
has no shingles and is linked with nothing; null ids sort after all others;
rows that repeat an id are linked by their texts alone; an empty table gives
an empty result; further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import components
from .tables import bounded, stored, whole_text

#: Four values a band: a pair at similarity 0.85 misses all 32 bands once in 10^10, at 0.8 once in 10^7.
BANDS, BAND = 32, 4
VALUES = BANDS * BAND
#: Values compared between two looks at the posterior.
BATCH = 32
#: Posterior probability of reaching the threshold below which a pair is dropped.
MISS = 1e-9
#: Bytes of signatures and sets in a block where a group's components are compared with each other.
BLOCK = 1 << 20
ROWS = 256
CACHED = 200_000

_MULTIPLIERS = np.random.default_rng(85).integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """A word's 64-bit hash; one for each task, so that a worker keeps nothing between tasks; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) < 60:
            self[word] = value
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str, size: int, known: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.encode().lower().split()  # bytes: A to Z only, and just the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    length = min(size, len(words))
    rolled = np.full(len(words) - length + 1, length, np.uint64)
    for i in range(length):
        rolled = _mixed(rolled * _MIX + hashes[i : i + len(rolled)])
    return np.unique(rolled)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set: the least product with each odd multiplier, its upper half."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(found), 2048):
        np.minimum(least, (found[begin : begin + 2048, None] * _MULTIPLIERS).min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))


def profiles(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, class, signature) of every row; class and signature are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingles(t, size, known) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "text_hash", "n_shingles", "class", "signature"],
                )

    rows = _key(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return bounded(rows.select("id", F.xxhash64("text").alias("text_hash"), "text")).mapInArrow(
        run, f"id {kind}, text_hash long, n_shingles long, class binary, signature binary"
    )


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(class, shingles) of the wanted (rep_id, class) rows; a filter on ids keeps other texts from being read in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                sets = [shingles(t, size, known) for t in batch.slice(at, ROWS).column("text").to_pylist()]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["class", "shingles"],
                )

    marked = bloom.mark(_key(docs, id_col, text_col), F.col("id"), bloom.build(wanted, F.col("rep_id")))
    found = bounded(marked.where("possible").select("text")).mapInArrow(run, "class binary, shingles binary")
    return found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def least_matches(seen: int, threshold: float, miss: float) -> int:
    """The fewest equal values among ``seen`` that leave a posterior of at least ``miss`` for the threshold.

    With a uniform prior the similarity's posterior is a beta distribution, and
    its upper tail is the chance of at most so many successes in seen + 1 draws.
    """
    tail = 0.0
    for equal in range(seen + 1):
        tail += math.comb(seen + 1, equal) * threshold**equal * (1 - threshold) ** (seen + 1 - equal)
        if tail >= miss:
            return equal
    return seen


def _alive(left: np.ndarray, right: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """Rows of two signature tables that stay possible at every look."""
    alive, equal, done = np.arange(len(left)), np.zeros(len(left), int), 0
    for seen, least in looks:
        equal[alive] += (left[alive, done:seen] == right[alive, done:seen]).sum(1)
        alive, done = alive[equal[alive] >= least], seen
    return alive


def _looks(threshold: float, miss: float) -> list[tuple[int, int]]:
    return [(n, least_matches(n, threshold, miss)) for n in range(BATCH, VALUES + 1, BATCH)]


def _signatures(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u4").reshape(-1, VALUES)


def _prune(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The (a, b) of rows (a, b, sig_a, sig_b) whose signatures leave the threshold possible."""
    looks = _looks(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_signatures(batch.column(c).to_pylist()) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).take(pa.array(_alive(left, right, looks)))

    return bounded(pairs).mapInArrow(run, "a binary, b binary")


def _compare_blocks(units: DataFrame, numerator: int, denominator: int, miss: float) -> DataFrame:
    """Links (a, b) between the strays and the members of each unit (pivot, i, j), one for each stray and root.

    Rows are (pivot, i, j, stray, class, root, signature, shingles).  A unit has
    about two blocks of rows, whatever its bucket's size.
    """
    looks = _looks(numerator / denominator, miss)

    def run(unit: pa.Table) -> pa.Table:
        strays, members = unit.filter(pc.field("stray")), unit.filter(~pc.field("stray"))
        links = []
        if strays.num_rows and members.num_rows:
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in members.column("shingles")]
            sizes = np.array([len(s) for s in sets])
            owners, held = np.repeat(np.arange(len(sets), dtype=np.int32), sizes), np.concatenate(sets)
            order = np.argsort(held, kind="stable")
            owners, held = owners[order], held[order]
            right = _signatures(members.column("signature").to_pylist())
            names, roots = members.column("class").to_pylist(), members.column("root").to_pylist()
            for stray in range(strays.num_rows):
                name, root, sig = (strays.column(c)[stray].as_py() for c in ("class", "root", "signature"))
                alive = _alive(np.broadcast_to(np.frombuffer(sig, "<u4"), right.shape), right, looks)
                alive = [k for k in alive if roots[k] != root]
                if not alive:
                    continue
                own = np.frombuffer(strays.column("shingles")[stray].as_buffer(), np.uint64)
                low, high = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
                matched = np.concatenate([owners[x:y] for x, y in zip(low, high) if y > x] or [np.empty(0, int)])
                shared = np.bincount(matched, minlength=len(sets))
                linked_to = {}
                for k in alive:
                    union = len(own) + sizes[k] - shared[k]
                    if shared[k] * denominator >= union * numerator:
                        linked_to.setdefault(roots[k], names[k])
                links += [(name, other) for other in linked_to.values()]
        return pa.table({c: pa.array([link[i] for link in links], pa.binary()) for i, c in enumerate(("a", "b"))})

    return bounded(units).groupBy("pivot", "i", "j").applyInArrow(run, "a binary, b binary")


def _verify(pairs: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The (a, b) of rows (a, b, set_a, set_b) with intersection * denominator >= union * numerator."""

    def similar(a: bytes, b: bytes) -> bool:
        left, right = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        shared = len(left) + len(right) - len(np.union1d(left, right))
        return shared * denominator >= (len(left) + len(right) - shared) * numerator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("set_a"), batch.column("set_b"))
            good = pa.array([similar(a.as_py(), b.as_py()) for a, b in sets], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return bounded(pairs).mapInArrow(run, "a binary, b binary")


def _beside(pairs: DataFrame, table: DataFrame, value: str, name: str) -> DataFrame:
    """Pairs with a class's value for both sides, as name_a and name_b."""
    for side in ("a", "b"):
        values = table.select(F.col("class").alias("at"), F.col(value).alias(f"{name}_{side}"))
        pairs = pairs.join(values, F.col(side) == F.col("at")).drop("at")
    return pairs



def _open_units(pairs: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """What is still to compare: in groups of several components, all outside the largest one against all.

    Both sides are cut into blocks of about ``BLOCK`` bytes of signatures and
    sets; a unit is one block of each.  Classes of one component need no
    comparison.
    """
    rows = pairs.select("pivot", "class").unionByName(pairs.select("pivot", F.col("pivot").alias("class")).distinct())
    placed = rows.join(roots, F.col("class") == F.col("node"), "left").select(
        "pivot", "class", F.coalesce("root", "class").alias("root")
    )
    weights = classes.select(F.col("class").alias("of"), (8 * F.col("n_shingles") + 4 * VALUES).alias("bytes"))
    placed = stored(placed.join(weights, F.col("class") == F.col("of")).drop("of"), "placed-classes")
    counts = placed.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    groups = counts.groupBy(F.col("pivot").alias("of")).agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("most")
    )
    open_groups = groups.where("n > most.n").select(
        "of",
        F.col("most.root").alias("main"),
        F.ceil(F.col("bytes") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("bytes") - F.col("most.bytes")) / BLOCK).cast("int").alias("stray_blocks"),
    )
    open_groups = stored(open_groups, "open-pivots")  # read from files, a large group can be split in the join
    left = stored(placed.join(open_groups, F.col("pivot") == F.col("of")).drop("of", "bytes"), "open-groups")

    def block(salt: int, blocks: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "class"), F.col(blocks)).cast("int")

    def all_of(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    names = ["pivot", "class", "root"]
    members = left.select(*names, F.lit(False).alias("stray"), block(1, "blocks").alias("j"), all_of("stray_blocks").alias("i"))
    strays = left.where(F.col("root") != F.col("main")).select(
        *names, F.lit(True).alias("stray"), block(2, "stray_blocks").alias("i"), all_of("blocks").alias("j")
    )
    still = left.select(F.col("class").alias("needed")).distinct()
    full = sets.join(still, F.col("class") == F.col("needed"), "left_semi").join(
        classes.select(F.col("class").alias("of"), "signature"), F.col("class") == F.col("of")
    )
    full = stored(full.select(F.col("class").alias("of"), "signature", "shingles"), "open-sets")
    return members.unionByName(strays).join(full, F.col("class") == F.col("of")).drop("of")


def near_components(
    docs: DataFrame,
    size: int = 5,
    numerator: int = 80,
    denominator: int = 100,
    miss: float = MISS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, text_hash, n_shingles, component_id, kept.

    Documents are linked where the Jaccard similarity of their sets of
    ``size``-word shingles is at least numerator / denominator.  The component
    carries its least id; the row with that id (of several, the one with the
    least text hash) is kept.
    """
    profile = stored(profiles(docs, size, id_col, text_col), "profiles")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    classes = stored(
        profile.where("class is not null")
        .groupBy("class")
        .agg(F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")),
        "classes",
    )

    bands = [F.xxhash64(F.lit(i), F.substring("signature", 4 * BAND * i + 1, 4 * BAND)) for i in range(BANDS)]
    banded = classes.select("class", F.explode(F.array(*bands)).alias("bucket"))
    shared = (
        banded.groupBy(F.col("bucket").alias("shared"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("pivot"))
        .where("n > 1")
    )
    # buckets with the same first class are one group: near copies mostly share all of theirs
    met = banded.join(shared, F.col("bucket") == F.col("shared")).where("class <> pivot")
    pairs = stored(met.select("pivot", "class").distinct(), "bucket-pairs")
    involved = pairs.select(F.explode(F.array("pivot", "class")).alias("class")).distinct()
    wanted = involved.join(classes, "class").select(F.col("first.id").alias("rep_id"), "class")
    sets = stored(_sets(docs, wanted, size, id_col, text_col), "sets")

    sizes = _beside(
        pairs.select(F.col("pivot").alias("a"), F.col("class").alias("b")),
        classes.withColumn("both", F.struct("n_shingles", "signature")),
        "both",
        "of",
    )
    small, large = (f("of_a.n_shingles", "of_b.n_shingles") for f in (F.least, F.greatest))
    fair = sizes.where(small * denominator >= large * numerator).select(
        "a", "b", F.col("of_a.signature").alias("sig_a"), F.col("of_b.signature").alias("sig_b")
    )
    kept = stored(_prune(fair, numerator / denominator, miss), "kept-pairs")
    roots = components(_verify(_beside(kept, sets, "shingles", "set"), numerator, denominator))

    units = _open_units(pairs, roots, classes, sets)
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(stars.unionByName(_compare_blocks(units, numerator, denominator, miss)))

    rooted = classes.join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "first", F.coalesce("root", "class").alias("root")
    )
    least = rooted.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("winner"))
    placed = stored(rooted.join(least, F.col("root") == F.col("of")).select(F.col("class").alias("of_class"), "winner"), "placed")
    alone = F.col("winner").isNull()
    # rows without shingles get join keys that no class has
    at = F.coalesce("class", F.concat(F.lit("none"), F.xxhash64("id", "text_hash").cast("string")).cast("binary"))
    joined = profile.drop("signature").withColumn("at", at).join(placed, F.col("at") == F.col("of_class"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "text_hash",
        "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("winner.id")).alias("component_id"),
        (
            alone
            | (F.col("id").eqNullSafe(F.col("winner.id")) & (F.col("text_hash") == F.col("winner.text_hash")))
        ).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The documents, with their columns, of which one of each group of near copies stays.

    Rows that repeat id and text stay or go together; exact deduplication
    before takes care of them.
    """
    decided = near_components(docs, id_col=id_col, text_col=text_col, **parameters)
    dropped = decided.where(~F.col("kept")).select(F.col(id_col).alias("gone"), F.col("text_hash").alias("gone_text"))
    dropped = stored(dropped.distinct(), "dropped")
    return bloom.without(docs, dropped, id_col, text_col)
