"""Registered corpus queries against their SQL, and against brute force where SQL can't express them."""

import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken

from checks.compare import differences, duck
from tracewing.llm import bpe, near
from tracewing.llm.queries import QUERIES
from tracewing.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], con) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def _reference_encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding(
        "reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_byte_bpe_equals_the_library(spark, con):
    encoding = _reference_encoding()
    got = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, SF).collect()}
    rows = con.execute("select doc_id, text from documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = encoding.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, sf).collect()}
    labels = duck(sf).execute("select doc_id, toxic from labels").fetchall()
    assert len(rows) == 10_000
    hits = misses = alarms = clean = 0
    for doc_id, toxic in labels:
        row = rows[doc_id]
        assert row.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
        if row.held_out:
            hits += toxic and row.predicted
            misses += toxic and not row.predicted
            alarms += row.predicted and not toxic
            clean += not toxic
    # a tenth of the labels mark documents without any telling word
    assert hits / (hits + misses) > 0.7
    assert alarms / clean < 0.03


def _components(sets: dict, numerator: int, denominator: int) -> dict:
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared * denominator >= (len(sets[a]) + len(sets[b]) - shared) * numerator:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def _shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_pipeline_stages_against_brute_force(spark):
    import re

    import corpus_pipeline as pipeline
    from tracewing.llm.tables import table

    docs = table(spark, SF, "documents")
    stages = dict(pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    kept = stages["exact dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    firsts = {}
    for i in sorted(texts):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(firsts.values())

    kept = stages["near dedup"](spark, docs, SF)
    roots = _components({i: _shingle_set(t, 5) for i, t in texts.items()}, 80, 100)
    assert kept.columns == docs.columns
    # rows that repeat a text are equal sets here and fall together
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r for r in roots.values()})

    kept = stages["benchmark decontamination"](spark, docs, SF)
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    items = [grams(cut(r.text)) for r in table(spark, SF, "benchmark").collect()]
    clean = [i for i, t in texts.items() if not any(len(g & grams(cut(t))) * 100 >= 80 * len(g) for g in items if g)]
    assert kept.columns == docs.columns and 0 < len(clean) < len(texts)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)

    kept = stages["toxicity"](spark, docs, SF)
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_toxicity"](spark, SF).collect()}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, p in scores.items() if not p)

    last = stages["byte-level BPE"](spark, docs, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert all(r.n_tokens == len(r.token_ids) for r in last)


def test_pipeline_runs_all_stages(spark):
    import corpus_pipeline as pipeline

    rows = pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < 200
    assert len({r.doc_id for r in rows}) == len(rows)


def test_large_group_of_near_copies_needs_no_pairs_of_all(spark):
    """A star: copies with two changed places each, of which many are only linked by way of others."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(80))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_components(df, size=3, numerator=85, denominator=100).collect()
    expected = _components({i: _shingle_set(t, 3) for i, t in rows}, 85, 100)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(_shingle_set(t, 3)) for i, t in rows}


def test_short_items_equal_their_sql(spark, tmp_path):
    """Items of one to four words stand inside longer documents, at their ends, alone and next to each other."""
    import duckdb

    docs = [
        "one two three four five six seven", "seven one two", "two", "one", "One, TWO!", "zero one two three", "", None, "two two two two two two",
        "x one y two z", "long item of more than five words and more", "a b c d long item of more than five words e f",
    ]
    items = ["one two", "two", "four five six", "two two two two", "long item of more than five words", "", "seven"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    found = QUERIES["op9_benchmark_passages"](spark, str(tmp_path))
    assert found.count() > 15
    assert differences(found, ORACLES["op9_benchmark_passages"], con) is None
