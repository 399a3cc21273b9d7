"""SentencePiece ids against the library, whole texts and edge cases."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from checks.compare import duck
from tracewing.llm import pieces
from tracewing.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "ß", "日", "本", "\U0001f600", "​", "\x00", "́", "1", "23",
    "ing", "ation", "﻿", "�", "<s>", "</s>", "<unk>", "<0x41>", " ⁇ ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.Model(f.read())


def digests(library, text):
    ids = library.encode(text or "", add_eos=True)
    said, decoded = " ".join(map(str, ids)), library.decode(ids)
    return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: r for r in QUERIES["op13_sentencepiece"](spark, SF).collect()}
    rows = duck(SF).execute("select doc_id, text from documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        row = got[doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == digests(library, text)


def test_random_texts_and_ids_equal_the_library(library, model):
    chance = random.Random(5)
    for k in range(5_000):
        text = "".join(chance.choice(PARTS) for _ in range(chance.randrange(400 if k % 50 == 0 else 25)))
        ids = library.encode(text, add_eos=True)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
    for _ in range(5_000):
        ids = [chance.randrange(32_000 if chance.random() < 0.5 else 262) for _ in range(chance.randrange(12))]
        assert model.decode(ids) == library.decode(ids)


def test_long_chunks_merge_as_short_ones(model):
    chance = random.Random(7)
    for _ in range(500):
        chunk = "".join(chance.choice("▁aabcdeingtion日") for _ in range(chance.randrange(1, 90)))
        assert model._merged(list(chunk)) == model._merged_long(list(chunk))


def test_edges(spark, library):
    texts = [None, "", " ", "  ", "▁", "a", "a", "one  two ", "\n\n", "x" * 100_000, "word " * 50_000, "Été 漢字 \U0001f4a5"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a"), (5, "a")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("id", "block", "docs", "part", "keys", "ids", "asked")})
    for block_bytes in (1, 100, pieces.BLOCK):
        got = pieces.round_trip(docs.repartition(3), PATH, block_bytes=block_bytes).collect()
        want = [(i, *digests(library, t)) for i, t in enumerate(texts)] + [(i, *digests(library, "a")) for i in (None, 5)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    encoded = pieces.encode(docs, PATH)
    assert {(r.doc_id, tuple(r.token_ids)) for r in encoded.collect()} == {
        (r.doc_id, tuple(library.encode(r.text or "", add_eos=True))) for r in docs.collect()
    }
    back = pieces.decode(encoded.withColumn("decoded", F.lit("clash")), PATH).collect()
    assert {(r.doc_id, r.decoded) for r in back} == {(r.doc_id, (r.text or "").replace("▁", " ")) for r in docs.collect()}
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>"), PATH).first().decoded == ""
    assert pieces.round_trip(docs.limit(0), PATH).count() == 0


def test_each_chunk_is_segmented_once(spark, tmp_path):
    """What blocks ask meets in the parts: a word of all documents is one entry of the table."""
    rows = [(i, f"common word{i % 7}") for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    blocks = docs.mapInArrow(pieces._pack(64), "block long, docs binary")
    asked = blocks.mapInArrow(pieces._ask(3), "block long, part int, keys binary").collect()
    keys = [(a.part, k) for a in asked for k in pieces._thawed(bytes(a["keys"])).column("s").to_pylist()]
    assert {k for _, k in keys} == {"common", *(f"word{i}" for i in range(7))}
    assert len(set(keys)) == 8  # a chunk has one part, whichever block asks
    assert len({a.block for a in asked}) > 4
    # a block asks for a chunk once
    assert len({(a.block, k) for a in asked for k in pieces._thawed(bytes(a["keys"])).column("s").to_pylist()}) == len(keys)


def test_other_models_are_refused(library, monkeypatch):
    class Wrong:
        def __getattr__(self, name):
            return getattr(library, name)

        def normalize(self, text):
            return text.lower()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_proto: Wrong())
    with pytest.raises(ValueError, match="keep all characters"):
        pieces.Model(b"")
