"""Benchmark passages in long documents: size-partitioned MinHash containment search, DataFrame functions only.

A short item inside a long document has a tiny Jaccard similarity to it, so
the search is for containment.  Items are partitioned by their number of
shingles into powers of two.  Each partition has its own bound on hash values:
the sketch of a set is all its hashes below the bound, a MinHash sample whose
size follows the set's.  The bound is chosen so that an item's sketch is
expected to have ``SKETCH`` hashes; items of few shingles keep all of them.
A document that holds most of an item has most of its sketch, whatever the
document's own length, so one shared sketch hash makes a candidate.

Documents are hashed once, in their rows: a shingle goes on only if its hash
lies below the largest bound and in a Bloom filter of the items' sketches that
is small and of fixed size.  Candidates are then verified on exact shingles.

Words are runs of letters and digits in lower case.  An item of fewer words
than a shingle is one shingle of all its words.  For the word counts that such
items have, documents are cut into windows of that many words too, so these
items are found wherever their words stand in a row.

Defined results: null or empty texts and items are never found; items that
share an id are items of their own; documents that share an id are judged
each for itself; rows that repeat id and text give one result; an empty table gives an empty result;
further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .tables import stored, whole_text

#: Words of a shingle, and the containment from which on an item counts as found, in hundredths.
SIZE, PERCENT = 5, 80
#: Expected hashes in an item's sketch: at 80 % containment none of 24 is shared once in 10^16.
SKETCH = 24
#: Hash values are this wide; bounds are shares of it.
WIDTH = 1 << 62


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _window(of: Column, at: Column, size: int) -> list[Column]:
    return [F.get(of, at + i) for i in range(size)]


def _starts(of: Column, size: int) -> Column:
    """Where windows of ``size`` begin; one window from the start if there are fewer words, none without words."""
    last = F.greatest(F.size(of) - size, F.lit(0))
    return F.when(F.size(of) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _shorter(of: Column, n: int, made: Column) -> Column:
    """Distinct windows of ``n`` words, of which there are none but the text's own shingle if it has no more words."""
    return F.when(F.size(of) > n, F.array_distinct(made)).otherwise(F.slice(made, 1, 0))


def shingle_texts(of: Column, size: int = SIZE, short: Sequence[int] = ()) -> Column:
    """The distinct shingles of a word array as strings, with its windows of each number of words in ``short``."""

    def made(n: int) -> Column:
        return F.transform(_starts(of, n), lambda i: F.concat_ws(" ", *_window(of, i, n)))

    texts = F.array_distinct(made(size))
    return F.concat(texts, *[_shorter(of, n, made(n)) for n in short]) if short else texts


def shingle_hashes(of: Column, size: int = SIZE, short: Sequence[int] = ()) -> Column:
    """A hash in [0, WIDTH) for each shingle in order, then for each window of a number of words in ``short``.

    Missing words of a short text hash as nothing, so an item of few words has the hash of its window.
    """
    mask = F.lit(WIDTH - 1).cast("bigint")

    def made(n: int) -> Column:
        return F.transform(_starts(of, n), lambda i: F.xxhash64(*_window(of, i, n)).bitwiseAND(mask))

    return F.concat(made(size), *[_shorter(of, n, made(n)) for n in short]) if short else made(size)


def _bound(count: Column, sketch: int) -> Column:
    """The bound of an item's size partition: partitions begin at powers of two."""
    least = F.pow(F.lit(2.0), F.floor(F.log2(count)))
    share = F.least(F.lit(1.0), F.lit(float(sketch)) / least)
    return (share * F.lit(float(WIDTH))).cast("bigint")


def items(benchmark: DataFrame, id_col: str, text_col: str, size: int, sketch: int) -> DataFrame:
    """(item, item_id, shingles, n, bound) of items that have words; ``item`` tells items with one id apart."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), words(whole_text(text_col)).alias("w"))
    rows = rows.where(F.size("w") > 0).select("item_id", "w", shingle_texts(F.col("w"), size).alias("shingles"))
    rows = rows.withColumn("n", F.size("shingles"))
    return rows.select(
        F.sha2(F.to_json(F.struct("item_id", "w")), 256).alias("item"), "item_id", "w", "shingles", "n",
        _bound(F.col("n"), sketch).alias("bound"),
    ).dropDuplicates(["item"])


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = SIZE,
    percent: int = PERCENT,
    sketch: int = SKETCH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, text_hash, item_id, n_shingles, n_shared) of every document and item it holds to ``percent``."""
    kept = stored(items(benchmark, item_col, item_text_col, size, sketch), "items")
    sketches = kept.select("item", "bound", F.explode(F.array_distinct(shingle_hashes(F.col("w"), size))).alias("h"))
    sketches = stored(sketches.where(F.col("h") < F.col("bound")).select("item", "h"), "sketches")
    few = F.when(F.size("w") < size, F.size("w"))
    known = kept.agg(F.coalesce(F.max("bound"), F.lit(0)).alias("bound"), F.collect_set(few).alias("short")).first()
    largest, short = known["bound"], sorted(known["short"])

    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    texts = texts.select("id", "text", F.xxhash64("text").alias("text_hash"))
    listed = texts.select("id", "text_hash", words(F.col("text")).alias("w"))
    hashed = listed.select("id", "text_hash", F.explode(shingle_hashes(F.col("w"), size, short)).alias("h"))
    # the filter's broadcast is bounded; a shingle that passes it falsely finds no sketch in the join
    low = hashed.where(F.col("h") < F.lit(largest))
    hits = bloom.mark(low, F.col("h"), bloom.build(sketches, F.col("h"))).where("possible").drop("possible")
    pairs = hits.join(sketches.withColumnRenamed("h", "sketch_h"), F.col("h") == F.col("sketch_h"))
    pairs = stored(pairs.select("id", "text_hash", "item").distinct(), "passage-pairs")

    # the candidates' texts, which alone are read and compared in full
    suspects = bloom.mark(texts, F.col("id"), bloom.build(pairs, F.col("id"))).where("possible")
    suspects = suspects.select(
        F.col("id").alias("text_id"), F.col("text_hash").alias("hash_of"), words(F.col("text")).alias("tw")
    ).dropDuplicates(["text_id", "hash_of"])
    wanted = pairs.groupBy("id", "text_hash").agg(F.collect_set("item").alias("found"))
    same = F.col("id").eqNullSafe(F.col("text_id")) & (F.col("text_hash") == F.col("hash_of"))
    held = wanted.join(suspects, same).select("id", "text_hash", "found", shingle_texts(F.col("tw"), size, short).alias("ts"))
    both = held.select("id", "text_hash", "ts", F.explode("found").alias("of")).join(kept, F.col("of") == F.col("item"))
    shared = both.select("id", "text_hash", "item_id", "n", F.size(F.array_intersect("ts", "shingles")).alias("shared"))
    return shared.where(F.col("shared") * 100 >= F.col("n") * percent).select(
        F.col("id").alias(id_col),
        "text_hash",
        "item_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.col("shared").cast("bigint").alias("n_shared"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their columns, that hold no benchmark item."""
    found = find_passages(docs, benchmark, id_col=id_col, text_col=text_col)
    gone = stored(found.select(F.col(id_col).alias("gone"), F.col("text_hash").alias("gone_text")).distinct(), "found")
    return bloom.without(docs, gone, id_col, text_col)
