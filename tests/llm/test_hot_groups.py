"""Hot nodes, large groups of dissimilar texts, and what workers keep."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewing.llm import bpe, components, near, toxicity

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def watching_skew(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hub_of_many_leaves_is_split(spark, watching_skew):
    links = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"))
    tied = components._star(links, True)
    assert tied.count() == 100_000
    ran = tied.groupBy().count()
    ran.collect()
    assert "skew=true" in ran._jdf.queryExecution().executedPlan().toString()
    roots = components.components(links)
    assert roots.count() == 100_001 and roots.where("root <> 0").isEmpty()


def _texts(groups, n, seed):
    """Groups of texts that share much, so that bands collide, and a few near copies in each."""
    chance = random.Random(seed)
    rows = []
    for g in range(groups):
        common = [f"w{g}x{chance.randrange(50)}" for _ in range(60)]
        for _ in range(n):
            words = [w if chance.random() < 0.75 else f"u{chance.randrange(10**6)}" for w in common]
            rows += [" ".join(words)] + ([" ".join([*words, "tail"])] if chance.random() < 0.1 else [])
    return rows


@pytest.mark.parametrize("block", [900, 8_000, 1 << 20])
def test_groups_of_dissimilar_texts(spark, monkeypatch, block):
    """Compared in blocks of any size, links are those of all pairs, and blocks bound what meets in a task."""
    monkeypatch.setattr(near, "BLOCK", block)
    texts = _texts(2, 25, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_components(docs, size=1, numerator=80, denominator=100).collect()}
    sets = [set(t.split()) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(sets))}


def test_blocks_are_bounded_by_bytes(spark):
    """A unit has two blocks of about the bound; a class is sent once for each block of the other side."""
    n, size = 600, 500
    classes = spark.range(n).select(
        F.unhex(F.md5(F.col("id").cast("string"))).alias("class"), F.lit(size).cast("bigint").alias("n_shingles"), F.lit(b"x" * 512).alias("signature")
    )
    pivot = classes.agg(F.min("class")).first()[0]
    pairs = classes.where(F.col("class") != F.lit(pivot)).select(F.lit(pivot).alias("pivot"), "class")
    roots = spark.createDataFrame([], "node binary, root binary")
    sets = classes.select("class", F.lit(b"y" * 8 * size).alias("shingles"))
    units = near._open_units(pairs, roots, classes, sets)
    weight = F.sum(F.octet_length("shingles") + F.octet_length("signature"))
    sizes = units.groupBy("pivot", "i", "j").agg(weight.alias("bytes"), F.count("*").alias("n")).collect()
    whole = n * (8 * size + 512)
    blocks = -(-whole // near.BLOCK)
    assert len(sizes) == blocks * blocks and max(r.bytes for r in sizes) < 3 * near.BLOCK
    assert sum(r.n for r in sizes) <= 2 * n * blocks


def test_a_codec_keeps_bounded_caches_and_ends_with_its_task(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_HEADS", 50)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 50)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        content = f.read()
    plain = bpe.Codec(content, public_tokenizers.PATTERN)
    tight = bpe.Codec(content, public_tokenizers.PATTERN)
    tight.pieces = bpe.Bounded(tight._piece, 10)
    chance = random.Random(1)
    for _ in range(300):
        text = " ".join("".join(chance.choice("abcdefgéß漢") for _ in range(chance.randrange(1, 15))) + chance.choice(["", ".", ", x"]) for _ in range(20))
        assert tight.encode(text) == plain.encode(text)
    monkeypatch.setattr(bpe, "AT_ONCE", 40)
    long = " ".join(["word", "x" * 90, "  two\t", "three's"] * 30)
    assert tight.encode(long) == b"".join(plain.pieces[p] for p in plain.pattern.findall(long))
    assert len(tight.pieces) <= 10 and len(tight.pieces.older) <= 10
    assert len(plain.vocabulary._heads) <= 50 and len(plain.vocabulary._apart) <= 50
    assert not [n for n in vars(bpe) if not n.startswith("__") and isinstance(getattr(bpe, n), (dict, bpe.Codec))]


# ---- the risk estimator ---------------------------------------------------------------------------------------------


def _risk(weights, bias, toxic, other, prior):
    """(positive part, negative part) of the prior-corrected logistic risk, term by term."""
    raw = lambda row: sum(weights[i] for i in row) + bias
    cost = lambda z: np.log1p(np.exp(-z))
    positive = prior * np.mean([cost(raw(r)) for r in toxic])
    negative = np.mean([cost(-raw(r)) for r in other]) - prior * np.mean([cost(-raw(r)) for r in toxic])
    return positive, negative


def _slope(weights, bias, toxic, other, prior, step=1e-6):
    """Numeric gradient of the non-negative estimator's descent direction."""
    _, negative = _risk(weights, bias, toxic, other, prior)
    part = (lambda w, b: sum(_risk(w, b, toxic, other, prior))) if negative >= 0 else (lambda w, b: -_risk(w, b, toxic, other, prior)[1])
    grads = []
    for i in range(len(weights)):
        up, down = weights.copy(), weights.copy()
        up[i] += step
        down[i] -= step
        grads.append((part(up, bias) - part(down, bias)) / (2 * step))
    return np.array(grads), (part(weights, bias + step) - part(weights, bias - step)) / (2 * step)


@pytest.mark.parametrize("prior", [0.05, 0.3, 0.9])
def test_steps_follow_the_gradient_of_the_non_negative_risk(prior):
    chance = np.random.default_rng(int(prior * 100))
    for _ in range(30):
        toxic = [np.flatnonzero(chance.random(6) < 0.6).astype(np.int32) for _ in range(7)]
        other = [np.flatnonzero(chance.random(6) < 0.3).astype(np.int32) for _ in range(12)]
        weights, bias = chance.normal(size=6), chance.normal()
        grad, bias_grad = toxicity.risk_gradient(weights, bias, toxic, other, prior)
        want, bias_want = _slope(weights, bias, toxic, other, prior)
        assert np.allclose(grad, want, atol=1e-5) and np.isclose(bias_grad, bias_want, atol=1e-5)


def test_the_non_negative_switch_changes_the_outcome(monkeypatch):
    """With few rows the corrected risk falls below zero; without the switch it is driven further down."""
    toxic = [np.array([0, 1], np.int32)] * 3
    other = [np.array([2], np.int32)] * 20
    assert _risk(np.array([3.0, 3.0, 0.0]), 0.0, toxic, other, 0.9)[1] < 0
    fit = lambda: toxicity._fit_one(toxic, other, 3, 0.9, 1, 40, 0.5, 0.0)
    weights, bias = fit()
    monkeypatch.setattr(toxicity, "negative_part", lambda *_: 1.0)
    loose, loose_bias = fit()
    assert not np.allclose(weights, loose)
    kept, lost = (_risk(w, b, toxic, other, 0.9)[1] for w, b in ((weights, bias), (loose, loose_bias)))
    assert lost < kept
