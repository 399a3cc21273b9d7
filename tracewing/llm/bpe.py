"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that a valid
encoding of that prefix can end with.  The table of these last tokens is
filled from left to right: a token fits at an end if it stands alone, or if
merging would keep it apart from the last token of the prefix before it.  So a
piece of n bytes takes n steps of at most the longest token's length, more
bytes extend the table without touching it, and after an edit only the part up
to where the table agrees with the old one again is filled anew.

A text is cut into pieces by the tokenizer's pattern first, each piece is
encoded for itself, and no special tokens are used.  The vocabulary is a file
of ranks (base64 token and rank a line) that the driver reads and broadcasts;
it holds about a megabyte and does not grow with the data.

Defined results: a null or empty text has no tokens; repeated rows stay; an
empty table gives an empty result; further columns are left out unless named.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded

#: Pieces that a task keeps in each of two generations, token pairs and tables of beginnings.
CACHED_PIECES, CACHED_PAIRS, CACHED_HEADS = 90_000, 200_000, 40_000
#: Characters of a text that are cut into pieces at once, up to the next word.
AT_ONCE = 1 << 20
#: Bytes of a beginning whose table is kept, as many pieces begin alike.
HEAD = 6
#: Rows of a batch that are Python objects at once.
ROWS = 128

#: A space before a character that is not white space; fixed values: Unicode's White_Space.
WORD_STARTS = re.compile(" (?=[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])")


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}


class Vocabulary:
    """Ranks with the last merge of each token, the test whether two tokens stay apart, and an automaton of all tokens.

    The automaton reads a piece byte by byte; each state has the chain of tokens
    that end there, longest first, so the candidates for a prefix's last token
    need no slices and no look-ups.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.sizes = [0] * (max(self.bytes_of, default=0) + 1)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}
        #: Beginnings of ``HEAD`` bytes with their last tokens and the state behind them.
        self._heads: dict[bytes, tuple[list[int], int]] = {}
        self._build()

    def _build(self) -> None:
        """Steps keyed by state * 256 + byte; a state's fallback is that of its longest ending that begins some token."""
        self.step: dict[int, int] = {}
        self.fallback = [0]
        step, levels = self.step, [[0]]
        own = {}
        for token, rank in self.ranks.items():
            state = 0
            for depth, byte in enumerate(token, 1):
                key = state << 8 | byte
                state = step.get(key, 0)
                if not state:
                    state = step[key] = len(self.fallback)
                    self.fallback.append(0)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append(key)
            own[state] = rank
        #: The tokens that end in each state with their sizes, longest first.
        self.chains: list[tuple[tuple[int, int], ...]] = [()] * len(self.fallback)
        for level in levels[1:]:
            for key in level:
                parent, byte, state = key >> 8, key & 255, step[key]
                below = self.next_state(self.fallback[parent], byte) if parent else 0
                self.fallback[state] = below
                rank = own.get(state)
                shorter = self.chains[below]
                self.chains[state] = shorter if rank is None else ((rank, self.sizes[rank]), *shorter)

    def next_state(self, state: int, byte: int) -> int:
        step, fallback = self.step, self.fallback
        found = step.get(state << 8 | byte)
        while found is None and state:
            state = fallback[state]
            found = step.get(state << 8 | byte)
        return found or 0

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; the token twice for a single byte; None if no merges make it."""
        if token not in self._halves:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                best = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best[0] >= token:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 1:
                self._halves[token] = (token, token)
            else:
                self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens are encoded as exactly these two.

        Undoes merges next to the border, latest first; a merge across the
        border that would have come earlier than the one undone decides.
        """
        known = self._apart.get(left << 32 | right)
        if known is None:
            if len(self._apart) >= CACHED_PAIRS:
                self._apart.clear()
            made = self.halves(right) is not None and self.halves(left) is not None
            known = self._apart[left << 32 | right] = made and self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        earliest_undone = None
        while True:
            merged = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if merged is not None and (earliest_undone is None or merged < earliest_undone):
                return False
            left_inner, right_inner = self.halves(left)[1], self.halves(right)[0]
            undo_left = left_inner != left and (left > right or right_inner == right)
            if undo_left:
                earliest_undone, left = left, left_inner
            elif right_inner != right:
                # of two equal merges the left one comes first, so one that equals the undone right token wins
                earliest_undone, right = right + 1, right_inner
            else:
                return True

    def table(self, piece: bytes) -> list[int]:
        """The last token of each prefix of a piece; the table of its beginning may be known already."""
        if len(piece) <= HEAD:
            return self._extend(piece, [], 0)[0]
        head = piece[:HEAD]
        known = self._heads.get(head)
        if known is None:
            if len(self._heads) >= CACHED_HEADS:
                self._heads.clear()
            known = self._heads[head] = self._extend(head, [], 0)
        return self._extend(piece, known[0].copy(), known[1])[0]

    def fill(self, piece: bytes, last: list[int], stop_at: list[int] | None = None, begin_stop: int = 0) -> list[int]:
        """Extend ``last`` (the last token of each prefix so far, from length 1) to the whole piece.

        With ``stop_at``, the entries of an older piece with the same ending,
        filling ends once a whole longest token's length of entries from
        prefix ``begin_stop`` on agrees; the older entries follow.
        """
        state = 0
        for byte in piece[max(0, len(last) - self.longest) : len(last)]:
            state = self.next_state(state, byte)
        if stop_at is None:
            return self._extend(piece, last, state)[0]
        shift, same = len(stop_at) - len(piece), 0
        while len(last) < len(piece):
            end = len(last) + 1
            last, state = self._extend(piece[:end], last, state)
            if end > begin_stop:
                same = same + 1 if end + shift > 0 and stop_at[end + shift - 1] == last[-1] else 0
                if same >= self.longest:
                    last.extend(stop_at[end + shift :])
        return last

    def _extend(self, piece: bytes, last: list[int], state: int) -> tuple[list[int], int]:
        """``last`` up to the whole piece, and the automaton's state there; ``state`` is that behind ``last``."""
        step, fallback, chains, known = self.step, self.fallback, self.chains, self._apart
        begun = len(last)
        for end, byte in enumerate(piece[begun:], begun + 1):
            found = step.get(state << 8 | byte)
            while found is None and state:
                state = fallback[state]
                found = step.get(state << 8 | byte)
            state = found or 0
            for token, size in chains[state]:
                if size < end:
                    left = last[end - size - 1]
                    fits = known.get(left << 32 | token)
                    if fits is None:
                        fits = self.apart(left, token)
                else:
                    fits = self.halves(token) is not None
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return last, state

    def walk(self, piece: bytes, last: list[int]) -> list[int]:
        """The tokens of a piece, from its end back along the last tokens."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        tokens, end, sizes = [], len(piece), self.sizes
        while end:
            token = last[end - 1]
            tokens.append(token)
            end -= sizes[token]
        tokens.reverse()
        return tokens

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.walk(piece, self.table(piece))


class Piece:
    """A piece with its table: grows by ``append`` and changes by ``replace`` without starting over."""

    def __init__(self, vocabulary: Vocabulary, content: bytes):
        self.vocabulary, self.content = vocabulary, content
        self.last = vocabulary.fill(content, [])

    def tokens(self) -> list[int]:
        return self.vocabulary.walk(self.content, self.last)

    def append(self, more: bytes) -> None:
        self.content += more
        self.vocabulary.fill(self.content, self.last)

    def replace(self, begin: int, end: int, new: bytes) -> None:
        old = self.last
        self.content = self.content[:begin] + new + self.content[end:]
        # entries from the edit on may serve again only where a token no longer reaches back into it
        self.last = self.vocabulary.fill(self.content, old[:begin], old, begin + len(new))


class Text:
    """A text as pieces; appends and edits cut and encode again only near the change."""

    #: How many characters after a piece's end its cut may depend on ('re, 've, 'll and blanks before a word).
    AHEAD = 3

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.pieces, self.encoded = codec, [], 0
        self.replace(0, 0, text)

    def __str__(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> bytes:
        return b"".join([self.codec.pieces[p] for p in self.pieces])

    def append(self, more: str) -> None:
        size = sum(map(len, self.pieces))
        self.replace(size, size, more)

    def replace(self, begin: int, end: int, new: str) -> None:
        old, at, kept = self.pieces, 0, 0
        while kept < len(old) and at + len(old[kept]) + self.AHEAD <= begin:
            at += len(old[kept])
            kept += 1
        tail, ends, place = old[kept:], [], at
        for piece in tail:
            place += len(piece)
            ends.append(place)
        text = "".join(tail)
        changed = text[: begin - at] + new + text[end - at :]
        shift = len(new) - (end - begin)
        again = {e + shift: i + 1 for i, e in enumerate(ends) if e >= end}
        result, place = old[:kept], at
        for found in self.codec.pattern.finditer(changed):
            result.append(found.group())
            self.encoded += 1
            place = at + found.end()
            if place >= begin + len(new) and place in again:
                result.extend(tail[again[place] :])
                break
        self.pieces = result


class Bounded(dict):
    """Text to its ids as little-endian unsigned 32-bit integers, made by ``make`` where not known.

    When it is full, its entries become the older generation, which is asked
    before an entry is made again; so texts that come often stay.
    """

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) < 100:
            if len(self) >= self.most:
                self.older = self.copy()
                self.clear()
            self[text] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encoder and decoder of whole texts; one for each task, so that a worker keeps nothing between tasks.

    No piece reaches across a space that a character other than white space
    follows, so a very long text is cut at such spaces first.
    """

    def __init__(self, content: bytes, pattern: str):
        self.vocabulary = Vocabulary(read_ranks(content))
        self.pattern = regex.compile(pattern)
        self.pieces = Bounded(self._piece, CACHED_PIECES)
        self.token = self.vocabulary.bytes_of

    def _piece(self, piece: str) -> bytes:
        return _packed(self.vocabulary.encode_piece(piece.encode()))

    def _parts(self, text: str) -> Iterator[str]:
        begin = 0
        while begin + AT_ONCE < len(text) and (cut := WORD_STARTS.search(text, begin + AT_ONCE)):
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:]

    def encode(self, text: str) -> bytes:
        get, pieces = self.pieces.__getitem__, self.pattern.findall
        if len(text) <= AT_ONCE:
            return b"".join(map(get, pieces(text)))
        return b"".join([b"".join(map(get, pieces(part))) for part in self._parts(text)])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _in_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of few rows with a column as Python objects; at the end a worker gives back what it no longer uses."""
    try:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                yield part, part.column(column).to_pylist()
    finally:
        pa.default_memory_pool().release_unused()


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, token_ids array<int>) of every whole text; ``ranks_path`` is read by the driver."""
    content = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches):
        codec = Codec(content.value, pattern)
        for part, texts in _in_slices(batches, "text"):
            ids = [codec.encode(t or "") for t in texts]
            ends = np.cumsum([0, *[len(i) // 4 for i in ids]]).astype("i4")
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(ends, values)], ["id", "token_ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return bounded(rows).mapInArrow(run, f"id {kind}, token_ids array<int>").withColumnRenamed("id", id_col)


def decode(
    encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids"
) -> DataFrame:
    """(id, decoded binary) of every row of token ids; null ids give no bytes."""
    content = encoded.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches):
        codec = Codec(content.value, pattern)
        for part, ids in _in_slices(batches, "ids"):
            texts = [codec.decode(i or ()) for i in ids]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.binary())], ["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return bounded(rows).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode and decode in one pass: (id, n_tokens, ids_sha256, decoded_sha256[, token_ids])."""
    content = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches):
        codec = Codec(content.value, pattern)
        sha = hashlib.sha256
        for part, texts in _in_slices(batches, "text"):
            ids = [codec.encode(t or "") for t in texts]
            sizes = np.array([len(i) // 4 for i in ids], "i8")
            decoded = [sha(codec.decode(np.frombuffer(i, "<u4").tolist())).hexdigest() for i in ids]
            columns = {
                "id": part.column("id"),
                "n_tokens": pa.array(sizes),
                "ids_sha256": pa.array([sha(i).hexdigest() for i in ids], pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            if with_ids:
                ends = np.cumsum([0, *sizes]).astype("i4")
                columns["token_ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bounded(rows).mapInArrow(run, schema + ", token_ids array<int>" * with_ids).withColumnRenamed("id", id_col)
