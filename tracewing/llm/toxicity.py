"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over hashed words and word beginnings are trained in numpy
from confirmed toxic documents and unlabelled text.  With the class prior p the
risk is p * loss(toxic as toxic) + max(0, loss(unlabelled as clean) - p *
loss(toxic as clean)); where the second part falls below zero on a batch, the
step goes the other way for it, so the model can't fit the unlabelled toxic
documents as clean.  Several classifiers from different batch orders are
averaged.  Labels of clean documents are never used as such.

The fit takes samples of about ``positives`` confirmed and ``unlabelled`` other
documents at most, drawn by a hash of the id; this bounds what reaches the
driver, which gets their feature numbers.  The class prior and the decision cut
come from the scores of all usable rows, counted between the possible cuts by
one aggregation, so toxic or clean documents that are too rare for a sample
count as well.  Scoring reads every whole text.

Defined results: a null or empty text has no features and a low score; ids
label all rows that carry them; repeated labels count once, toxic if any says
so; null ids are never drawn; without any confirmed toxic document all scores
are 0; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded

#: Size of the hashed feature space.
SPACE = 1 << 18
#: Expected sizes of the samples that the fit takes, if there are more rows.
POSITIVES = 3_000
UNLABELLED = 8_000
#: Letters of a word's beginnings that are features of their own, in words that are longer.
BEGINNINGS = (3, 4, 5, 6, 7)
#: A document is toxic from this score on.
THRESHOLD = 0.7
#: Class prior that the first estimate starts from, and the recall from which on a cut bounds the prior.
FIRST_PRIOR = 0.1
LEAST_RECALL = 0.4
#: Standard deviations above expectation from which on a feature gets a weight.
LEAST_DEVIATION = 3.5
#: How many times as frequent it must be in confirmed toxic documents as in unlabelled ones.
LEAST_LIFT = 5
#: Possible cuts between neighbouring scores of the samples; odd, so that one is in the middle.
FINE = 9
ROWS = 256
CACHED = 200_000

_WORD = re.compile(r"\w+")


def _names(word: str) -> list[int]:
    """The features of a word: itself and its beginnings."""
    names = [word, *[word[:n] + "*" for n in BEGINNINGS if n < len(word)]]
    return [xxhash.xxh3_64_intdigest(n) % SPACE for n in names]


def features(text: str | None) -> np.ndarray:
    """The distinct features of a whole text."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((i for w in words for i in _names(w)), np.int32))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float = 0.0


def _sums(weights: np.ndarray, ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights[ids], n)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*rows, np.empty(0, np.int32)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def negative_part(p_raw: np.ndarray, u_raw: np.ndarray, prior: float) -> float:
    """The estimated risk of the clean rows: that of the unlabelled as clean, without the share of the toxic in it."""
    return np.logaddexp(0, u_raw).mean() - prior * np.logaddexp(0, p_raw).mean()


def risk_gradient(
    weights: np.ndarray, bias: float, toxic: list[np.ndarray], other: list[np.ndarray], prior: float
) -> tuple[np.ndarray, float]:
    """Gradient of the non-negative risk for one batch.

    Where the estimated risk of the clean rows is below zero, which no true
    risk is, the step goes the other way on that part alone.
    """
    p_ids, p_row = _flat(toxic)
    u_ids, u_row = _flat(other)
    p_raw = _sums(weights, p_ids, p_row, len(toxic)) + bias
    u_raw = _sums(weights, u_ids, u_row, len(other)) + bias
    p, u = (1 / (1 + np.exp(-np.clip(r, -30, 30))) for r in (p_raw, u_raw))
    # logistic loss: toxic as clean costs log(1 + e^raw), and as toxic that less raw
    if negative_part(p_raw, u_raw, prior) >= 0:
        p_grad, u_grad = np.full(len(p), -prior / len(p)), u / max(1, len(u))
    else:
        p_grad, u_grad = prior * p / len(p), -u / max(1, len(u))
    grad = np.bincount(p_ids, p_grad[p_row], len(weights)) + np.bincount(u_ids, u_grad[u_row], len(weights))
    return grad, p_grad.sum() + u_grad.sum()


def _fit_one(
    toxic: list[np.ndarray],
    other: list[np.ndarray],
    space: int,
    prior: float,
    seed: int,
    epochs: int,
    rate: float,
    shrink: float,
) -> tuple[np.ndarray, float]:
    """One linear classifier by adaptive steps with shrinkage: weights that no evidence holds up go to zero."""
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(space), -1.0
    squares, bias_square = np.full(space, 1e-4), 1e-4
    batches = max(1, min(len(other) // 1_000, 4))
    for epoch in range(epochs):
        p_parts = np.array_split(rng.permutation(len(toxic)), batches)
        u_parts = np.array_split(rng.permutation(len(other)), batches)
        for p_part, u_part in zip(p_parts, u_parts):
            if not len(p_part):
                p_part = rng.integers(len(toxic), size=1)
            grad, bias_grad = risk_gradient(weights, bias, [toxic[i] for i in p_part], [other[i] for i in u_part], prior)
            squares += grad * grad
            bias_square += bias_grad * bias_grad
            step = rate / np.sqrt(squares)
            weights -= step * grad
            weights = np.maximum(weights - step * shrink, 0)  # a telling feature never speaks for clean text
            bias -= rate / np.sqrt(bias_square) * bias_grad
    return weights, bias


def _distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows without exact repetitions, which would make any word of an often copied document look telling."""
    return list({r.tobytes(): r for r in rows}.values())


def _telling(toxic: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Features that far more confirmed toxic documents have than their share of the unlabelled lets expect."""
    in_toxic, in_other = (np.bincount(np.concatenate(rows), minlength=SPACE) for rows in (toxic, other))
    expected = in_other * (len(toxic) / len(other))
    deviation = (in_toxic - expected) / np.sqrt(expected + 0.5)
    return np.flatnonzero((deviation >= LEAST_DEVIATION) & (in_toxic >= LEAST_LIFT * expected) & (in_toxic >= 3))


def _cuts(weights: np.ndarray, bias: float, toxic: list[np.ndarray], other: list[np.ndarray]):
    """Values between the raw scores, the share of the toxic above each, and that of the others."""
    p = np.sort(np.array([weights[r].sum() for r in toxic]) + bias)
    u = np.sort(np.array([weights[r].sum() for r in other]) + bias)
    values = np.unique(np.concatenate([p, u]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    return cuts, 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)


def _finer(weights: np.ndarray, bias: float, toxic: list[np.ndarray], other: list[np.ndarray]):
    """``FINE`` cuts in each gap between the samples' raw scores and one below all; the share of the toxic above each."""
    p = np.sort(np.array([weights[r].sum() for r in toxic]) + bias)
    values = np.unique(np.concatenate([p, [weights[r].sum() + bias for r in other]]))
    gaps = np.diff(values)
    real = gaps > 1e-6  # smaller ones come from the order of adding
    inner = values[:-1][real, None] + gaps[real, None] * (np.arange(1, FINE + 1) / (FINE + 1))
    cuts = np.unique(np.concatenate([[values[0] - 1], inner.ravel()]))
    return cuts, 1 - np.searchsorted(p, cuts) / len(p)


def _least_bound(recall: np.ndarray, share: np.ndarray, n: int) -> float:
    """The class prior as the least share / recall of a cut with enough recall; at least what one of ``n`` rows could be."""
    fair = recall >= LEAST_RECALL
    return float(np.clip((share[fair] / recall[fair]).min(), 1 / (1 + n), 0.9))


def train(
    toxic: list[np.ndarray],
    other: list[np.ndarray],
    count: Callable[[Model, np.ndarray], np.ndarray] | None = None,
    prior: float | None = None,
    members: int = 3,
    epochs: int = 150,
    rate: float = 1.0,
    shrink: float = 1e-4,
    seed: int = 7,
) -> Model:
    """Average of ``members`` classifiers, shifted so that the best estimated decision is at ``THRESHOLD``.

    Without a given class prior, a first classifier's cuts bound it: the
    unlabelled above a cut hold at least p * recall of the toxic, so p is at
    most their share divided by the recall, and the least such bound is taken.
    The decision is the raw value with the largest F1, its precision estimated
    as p * recall / share of the unlabelled above it.  ``count`` gives for a
    model and increasing raw values how many of all unlabelled rows lie below
    the first, between neighbours and above the last; prior and decision then
    come from these, otherwise from ``other``.
    """
    if not toxic or not other:
        return Model(np.zeros(SPACE, np.float32), -30.0)
    toxic, other = _distinct(toxic), _distinct(other)
    kept = _telling(toxic, other)
    place = np.full(SPACE, -1)
    place[kept] = np.arange(len(kept))
    toxic, other = ([p[p >= 0] for p in (place[r] for r in rows)] for rows in (toxic, other))
    given = prior
    if prior is None:
        prior = FIRST_PRIOR
        for _ in range(2):
            weights, bias = _fit_one(toxic, other, len(kept), prior, seed, epochs, rate, shrink)
            _, recall, share = _cuts(weights, bias, toxic, other)
            prior = _least_bound(recall, share, len(other))
    fits = [_fit_one(toxic, other, len(kept), prior, seed + k, epochs, rate, shrink) for k in range(members)]
    weights, bias = np.mean([w for w, _ in fits], 0), float(np.mean([b for _, b in fits]))
    whole = np.zeros(SPACE, np.float32)
    whole[kept] = weights
    cuts, recall, share = _cuts(weights, bias, toxic, other)
    if count is not None:
        cuts, recall = _finer(whole[kept].astype(float), bias, toxic, other)
        counts = count(Model(whole, bias), cuts)
        share = counts[::-1].cumsum()[::-1][1:] / max(1, counts.sum())
        if given is None:
            prior = _least_bound(recall, share, int(counts.sum()))
    precision = np.minimum(1, prior * recall / np.maximum(share, 1e-9))
    f1 = 2 * precision * recall / np.maximum(precision + recall, 1e-9)
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    cut = cuts[best[len(best) // 2]]
    return Model(whole, float(bias - cut + np.log(THRESHOLD / (1 - THRESHOLD))), prior)


def _share(rows: DataFrame, most: int) -> float:
    return min(1.0, most / max(1, rows.count()))


def _drawn(key: Column, share: float) -> Column:
    """Whether the key's hash falls into the share; null keys never do."""
    return key.isNotNull() & (F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> Model:
    """Fit on the documents whose id is ``usable`` (a condition over the column ``id``; all by default)."""
    usable = F.lit(True) if usable is None else usable
    confirmed = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .where((F.col("label") == 1) & usable)
        .select(F.col("id").alias("toxic_id"))
        .distinct()
    )
    confirmed = confirmed.where(_drawn(F.col("toxic_id"), _share(confirmed, positives)))  # bounds the broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(usable)
    in_other = _drawn(F.col("id"), _share(rows.select("id"), unlabelled))
    drawn = rows.join(F.broadcast(confirmed), F.col("id") == F.col("toxic_id"), "left").select(
        "text", F.col("toxic_id").isNotNull().alias("confirmed"), in_other.alias("other")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [features(t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("confirmed"), part.column("other"), pa.array(found, pa.binary())],
                    ["confirmed", "other", "features"],
                )

    sample = bounded(drawn.where("confirmed or other")).mapInArrow(run, "confirmed boolean, other boolean, features binary")
    toxic, other = [], []
    for confirmed_row, other_row, found in sample.collect():  # bounded by the samples' sizes
        ids = np.frombuffer(found, np.int32)
        toxic += [ids] * confirmed_row
        other += [ids] * other_row

    def count(model: Model, cuts: np.ndarray) -> np.ndarray:
        return _counts(rows.where(F.col("id").isNotNull()).select("text"), model, cuts)

    # an order that doesn't depend on how the rows were split
    return train(sorted(toxic, key=bytes), sorted(other, key=bytes), count)


def _counts(texts: DataFrame, model: Model, cuts: np.ndarray) -> np.ndarray:
    """How many texts with different words have a raw score below the first cut, between neighbours, from the last on."""
    sent = texts.sparkSession.sparkContext.broadcast((*_known(model), cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bias, cuts = sent.value
        raw_scores = _raw_scorer(known, bias)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS).column("text").to_pylist()
                places = np.searchsorted(cuts, raw_scores(part), side="right")
                words = (" ".join(sorted(set(_WORD.findall((t or "").lower())))) for t in part)
                digests = [xxhash.xxh3_128_digest(w) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(places, pa.int32())], ["digest", "place"]
                )

    placed = bounded(texts).mapInArrow(run, "digest binary, place int").dropDuplicates(["digest"])
    counts = np.zeros(len(cuts) + 1, np.int64)
    for place, n in placed.groupBy("place").count().collect():  # bounded by the number of cuts
        counts[place] = n
    return counts


def _raw_scorer(weights: dict[int, float], bias: float) -> Callable[[list], np.ndarray]:
    """Raw scores of texts; a word's telling features are looked up once."""
    telling: dict[str, tuple[int, ...]] = {}

    def scores(texts: list) -> np.ndarray:
        raw = []
        for text in texts:
            found = set()
            for word in set(_WORD.findall((text or "").lower())):
                ids = telling.get(word)
                if ids is None:
                    if len(telling) >= CACHED:
                        telling.clear()
                    ids = telling[word] = tuple(i for i in _names(word) if i in weights)
                if ids:
                    found.update(ids)
            raw.append(bias + sum(weights[i] for i in sorted(found)))
        return np.array(raw, float)

    return scores


def _scorer(weights: dict[int, float], bias: float) -> Callable[[list], np.ndarray]:
    """Scores of texts."""
    raw_scores = _raw_scorer(weights, bias)
    return lambda texts: 1 / (1 + np.exp(-np.clip(raw_scores(texts), -30, 30)))


def _known(model: Model) -> tuple[dict[int, float], float]:
    """The telling features' weights, of which there are at most ``SPACE``, and the bias."""
    return {int(i): float(model.weights[i]) for i in np.flatnonzero(model.weights)}, model.bias


def _sent(docs: DataFrame, model: Model):
    """What is known of telling features, for all tasks."""
    return docs.sparkSession.sparkContext.broadcast(_known(model))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = pa.array(scores(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("id"), made], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return bounded(rows).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents, with their columns, whose score is below the threshold."""
    sent, place = _sent(docs, model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(scores(part.column(place).to_pylist()) < threshold))

    return bounded(docs).mapInArrow(run, docs.schema)
