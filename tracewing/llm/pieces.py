"""SentencePiece BPE ids through a table of distinct chunks.

Where no piece of the vocabulary holds a white-space marker behind another
character, merges never reach across the beginning of a marked word, so a text
is the sequence of its chunks: runs of markers with what follows up to the next
marker.  Each distinct chunk is segmented once for the whole table of
documents, and its ids are joined back to every place where it stands:

1. documents are packed into blocks of about ``BLOCK`` bytes of text;
2. every block asks for its distinct chunks, dealt into parts by a hash;
3. a part gathers what all blocks ask, segments each distinct chunk once and
   answers every block in the order it asked;
4. a block meets its answers and puts the ids in the order of its texts.

A text is shuffled once, compressed, and a chunk once for each block that has
it, so a word that stands in every document is one entry for a block.  Parts
grow in number with the bytes of text, blocks have a fixed size, and a single
longer text is a block of its own, so no task gathers more than its share.

The model is a file that the driver reads and broadcasts (half a megabyte,
whatever the data).  It must be a BPE model that neither changes characters nor
removes white space, with a marker before the text, without pieces given by its
user; others are refused.

Defined results: a null or empty text has no ids but the end id; repeated rows
stay, as do null ids; a marker character in a text counts as a space, as in the
library; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Bytes of text in a block.
BLOCK = 16 << 20
#: Bytes of text of the whole table for each part of the chunk table, beyond the session's shuffle partitions.
PART = 64 << 20
#: Rows that are Python objects at once.
ROWS = 256
#: Symbols up to which a chunk is merged by scanning all pairs, beyond it by a heap.
SHORT = 48

#: What blocks, questions and answers are written with.
ZSTD = pa.Codec("zstd", compression_level=4)

_CUT = re.compile(f"(?<=[^{MARK}]){MARK}")
_NEVER = float("inf")


class Model:
    """The pieces of a model with their merge order, encoding of chunks and decoding of ids."""

    def __init__(self, content: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=content)
        ids = range(library.vocab_size())
        self.names = [library.id_to_piece(i) for i in ids]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in ids]
        self.id_of = {self.names[i]: i for i in ids if not special[i]}
        #: Pairs merge from the highest score down; of equal scores the leftmost pair first.
        self.order = {n: -library.get_score(i) for n, i in self.id_of.items()}
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in ids if library.is_byte(i)}
        self.end, self.unknown = library.eos_id(), library.unk_id()
        self.check(library)
        #: What an id stands for; the bytes of byte pieces are put together afterwards.
        self.text_of = [" ⁇ " if i == self.unknown else "" if library.is_control(i) else self._text(i) for i in ids]
        self.byte_of = {i: b for b, i in self.byte_ids.items()}

    def _text(self, i: int) -> str:
        return self.names[i].replace(MARK, " ")

    def check(self, library: sentencepiece.SentencePieceProcessor) -> None:
        probe = " Åﬁ  x\t\n"
        if library.normalize(probe) != (MARK + probe).replace(" ", MARK):
            raise ValueError("only models that keep all characters, with a marker before the text, are supported")
        if any(_CUT.search(n) for n in self.id_of) or any(library.is_unused(i) for i in self.id_of.values()):
            raise ValueError("pieces with a marker behind another character, and unused pieces, are not supported")
        if len(self.byte_ids) != 256 or self.end < 0:
            raise ValueError("only models with byte pieces and an end id are supported")

    def _merged(self, symbols: list[str]) -> list[str]:
        get = self.order.get
        orders = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while orders:
            least = min(orders)
            if least is _NEVER:
                break
            i = orders.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del orders[i]
            if i < len(orders):
                orders[i] = get(symbols[i] + symbols[i + 1], _NEVER)
            if i:
                orders[i - 1] = get(symbols[i - 1] + symbols[i], _NEVER)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same for a chunk of any length: pairs wait in a heap, and symbols are linked to their neighbours."""
        get, n = self.order.get, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        waiting = [(o, i, 2) for i in range(n - 1) if (o := get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, size = heapq.heappop(waiting)
            j = after[i]
            # a pair counts only as long as both of its symbols are as they were
            if not symbols[i] or j < 0 or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i], symbols[j] = symbols[i] + symbols[j], ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (o := get(symbols[x] + symbols[y])) is not None:
                    heapq.heappush(waiting, (o, x, len(symbols[x]) + len(symbols[y])))
        return [s for s in symbols if s]

    def encode_chunk(self, chunk: str) -> list[int]:
        merged = self._merged(list(chunk)) if len(chunk) <= SHORT else self._merged_long(list(chunk))
        ids = []
        for symbol in merged:
            known = self.id_of.get(symbol)
            if known is not None:
                ids.append(known)
            else:
                ids += [self.byte_ids[b] for b in symbol.encode()]
        return ids

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        return [i for key in chunk_keys(text) for i in self.encode_chunk(MARK + key)] + [self.end]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: one space at the beginning goes, and bytes that are no UTF-8 become replacement characters."""
        parts, waiting, first = [], bytearray(), True
        for i in [*ids, -1]:
            byte = self.byte_of.get(i)
            if byte is not None:
                waiting.append(byte)
                first = False
                continue
            if waiting:
                parts.append(_utf8(bytes(waiting)))
                waiting.clear()
            if i >= 0:
                text = self.text_of[i]
                if first and text:
                    text, first = text.removeprefix(" ") if i != self.unknown else text, False
                parts.append(text)
        return "".join(parts)


def _utf8(found: bytes) -> str:
    """Characters of UTF-8 bytes; every byte that is part of none becomes a replacement character of its own."""
    try:
        return found.decode()
    except UnicodeDecodeError as wrong:
        return found[: wrong.start].decode() + "�" + _utf8(found[wrong.start + 1 :])


@functools.lru_cache(maxsize=1)
def _model(content: bytes) -> Model:
    """The model of a worker process: of fixed size, whatever it encodes."""
    return Model(content)


def chunk_keys(text: str) -> list[str]:
    """The chunks of a text in order, each without its first marker."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return text.split(" ")
    return _CUT.split(text.replace(" ", MARK))


def _dealt(texts: Iterable[str], parts: int) -> dict[int, list[str]]:
    """The distinct chunk keys of a block's texts by part, in the order of their first place."""
    keys: dict[str, None] = {}
    for text in texts:
        keys.update(dict.fromkeys(chunk_keys(text)))
    dealt: dict[int, list[str]] = {}
    for key in keys:
        dealt.setdefault(zlib.crc32(key.encode()) % parts, []).append(key)
    return dealt


def _frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=ZSTD)) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _thawed(content: bytes) -> pa.Table:
    with pa.ipc.open_stream(content) as reader:
        return reader.read_all()


def _strings(values: list[str]) -> bytes:
    return _frozen(pa.RecordBatch.from_arrays([pa.array(values, pa.large_string())], ["s"]))


def _texts(docs: pa.Table) -> Iterator[str]:
    for batch in docs.to_batches(max_chunksize=ROWS):
        yield from (t or "" for t in batch.column("text").to_pylist())


def _pack(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, text) to rows (block, docs) of about so many bytes; a block is numbered by its task and place there."""

    def packed(number: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        docs = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        block = TaskContext.get().partitionId() << 32 | number
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_frozen(docs)], pa.binary())], ["block", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            batch = batch.set_column(1, "text", batch.column("text").cast(pa.large_string()))
            begin = 0
            for row, length in enumerate(pa.compute.binary_length(batch.column("text")).to_pylist()):
                length = length or 0
                if size and size + length > block_bytes:
                    yield packed(number, [*held, batch.slice(begin, row - begin)])
                    held, size, number, begin = [], 0, number + 1, row
                size += length + 1
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if size:
            yield packed(number, held)

    return run


def _ask(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, docs) to rows (block, part, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs")):
                dealt = _dealt(_texts(_thawed(docs.as_py())), parts)
                arrays = [
                    pa.array([block] * len(dealt), pa.int64()),
                    pa.array(list(dealt), pa.int32()),
                    pa.array([_strings(k) for k in dealt.values()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "part", "keys"])

    return run


def _answer(content) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All rows (block, part, keys) of a part to rows (block, part, asked, ids): each distinct key is segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _model(content.value), {}
        for batch in batches:
            for row in range(batch.num_rows):
                asked = batch.column("keys")[row].as_py()
                keys = _thawed(asked).column("s").to_pylist()
                for key in keys:
                    if key not in known:
                        known[key] = " ".join(map(str, model.encode_chunk(MARK + key)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("block").slice(row, 1),
                        batch.column("part").slice(row, 1),
                        pa.array([len(keys)], pa.int32()),
                        pa.array([_strings([known[k] for k in keys])], pa.binary()),
                    ],
                    ["block", "part", "asked", "ids"],
                )

    return run


def _joined(
    docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, finish: Callable, block_bytes: int
) -> DataFrame:
    """Blocks with their answers; ``finish(model, ids column, id strings of each text)`` makes a block's rows."""
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    blocks = rows.mapInArrow(_pack(block_bytes), "block long, docs binary").repartition(parts, "block")
    asked = blocks.mapInArrow(_ask(parts), "block long, part int, keys binary").repartition(parts, "part")
    answers = asked.groupBy("part").applyInArrow(_answer(content), "block long, part int, asked int, ids binary")

    def meet(block: pa.Table, answered: pa.Table) -> pa.Table:
        model, ids_of = _model(content.value), {}
        table = _thawed(block.column("docs")[0].as_py())
        dealt = _dealt(_texts(table), parts)
        for part, n, ids in zip(*(answered.column(c).to_pylist() for c in ("part", "asked", "ids"))):
            keys = dealt.pop(part, [])
            if len(keys) != n:
                raise RuntimeError("a block was read in two ways")
            ids_of.update(zip(keys, _thawed(ids).column("s").to_pylist()))
        if dealt:
            raise RuntimeError("a block lacks answers")
        end = str(model.end)
        joined = (" ".join([*map(ids_of.__getitem__, chunk_keys(t)), end]) for t in _texts(table))
        return finish(model, table.column("id"), joined)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema).withColumnRenamed("id", id_col)


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK
) -> DataFrame:
    """(id, token_ids array<int>) of every whole text, the end id last."""

    def finish(model: Model, ids: pa.ChunkedArray, joined: Iterator[str]) -> pa.Table:
        tokens = [list(map(int, s.split(" "))) for s in joined]
        return pa.table({"id": ids, "token_ids": pa.array(tokens, pa.list_(pa.int32()))})

    schema = f"id {_kind(docs, id_col)}, token_ids array<int>"
    return _joined(docs, model_path, id_col, text_col, schema, finish, block_bytes)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded string) of every row of ids; null ids give an empty text."""
    content = encoded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [model.decode(i or ()) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {_kind(encoded, id_col)}, decoded string").withColumnRenamed("id", id_col)


def round_trip(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK
) -> DataFrame:
    """Encode and decode in one pass: (id, n_tokens, ids_sha256, decoded_sha256); the ids' digest is of decimal text."""

    def finish(model: Model, ids: pa.ChunkedArray, joined: Iterator[str]) -> pa.Table:
        sizes, digests, decoded = [], [], []
        # an ASCII byte is a character whatever stands beside it
        plain = {str(i): t for i, t in enumerate(model.text_of) if i not in model.byte_of and i != model.unknown}
        plain |= {str(i): chr(b) for i, b in model.byte_of.items() if b < 128}
        for said in joined:
            tokens = said.split(" ")
            sizes.append(len(tokens))
            digests.append(hashlib.sha256(said.encode()).hexdigest())
            try:
                text = "".join(map(plain.__getitem__, tokens)).removeprefix(" ")
            except KeyError:  # bytes of longer characters
                text = model.decode(map(int, tokens))
            decoded.append(hashlib.sha256(text.encode()).hexdigest())
        return pa.table({"id": ids, "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": digests, "decoded_sha256": decoded})

    schema = f"id {_kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _joined(docs, model_path, id_col, text_col, schema, finish, block_bytes)
