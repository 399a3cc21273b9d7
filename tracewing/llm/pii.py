"""Personal data: regular expressions propose spans, checksums and ranges confirm them, nearby words adjust the score.

Each kind has a pattern, a validator and a score.  Proposals that fail the
validator are dropped.  Words of the kind's context within ``NEAR`` characters
add to the score.  Base kinds (email, ip, card, phone) are reported at any
score; the further kinds (iban with mod-97, ssn) only from ``LEAST_SCORE`` on,
so an ssn needs a context word.  All scans are linear in the text's length.

Defined results: a null or empty text has no spans; offsets are code points,
end exclusive; spans of different kinds may overlap; repeated rows stay; an
empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
NEAR = 40
LEAST_SCORE = 0.5
CONTEXT_BONUS = 0.3
ROWS = 128
SPANS = "array<struct<kind: string, begin: int, end: int, score: double>>"


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digits of all added: a multiple of ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """Country and check digits moved to the end, letters as numbers from 10: one more than a multiple of 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails as a whole fails from any later digit too, so only its first digit is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of a country's numbers, as registered; numbers of other lengths and countries are found, too.
_IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for domain in _DOMAIN.finditer(text):
        begin = domain.start()
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < domain.start():
            free = domain.end()
            yield begin, free


def _matching(pattern: re.Pattern, valid: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if valid(m.group()))


def _ip_valid(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card_valid(found: str) -> bool:
    digits = _digits(found)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _iban_ends(m: re.Match) -> tuple[list[int], int | None]:
    """Where the words of a proposal may end so that it passes mod-97, longest first; which of these has the country's length."""
    found, ends, usual = m.group(), [], None
    while len(account := found.replace(" ", "")) >= 15:
        if mod_97(account):
            ends.append(m.start() + len(found))
            if len(account) == _IBAN_LENGTHS.get(account[:2]):
                usual = ends[-1]
        found = found.rpartition(" ")[0]
    return ends, usual


def _behind_first_word(m: re.Match) -> int:
    return m.start() + len(m.group().partition(" ")[0])


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal may have swallowed upper-case words or further numbers behind its own; these are given back.

    An end may pass mod-97 by chance, so the one at the country's length goes first.  Without such an end the
    longest counts that leaves alone a number with its country's length.
    """
    at = 0
    while m := _IBAN.search(text, at):
        ends, end = _iban_ends(m)
        if ends and end is None:
            inner = _IBAN.search(text, _behind_first_word(m))
            while inner and inner.start() < ends[0] and _iban_ends(inner)[1] is None:
                inner = _IBAN.search(text, _behind_first_word(inner))
            end = next((e for e in ends if not inner or e <= inner.start()), None)
        if end is not None:
            yield m.start(), end
        at = _behind_first_word(m) if end is None else end


class Kind(NamedTuple):
    name: str
    mark: str | None  # without this character there is no match
    spans: Callable[[str], Iterator[tuple[int, int]]]
    score: float
    context: frozenset[str]


RULES = (
    Kind("email", "@", _emails, 0.8, frozenset({"email", "mail", "contact", "courriel", "correo"})),
    Kind("ip", ".", _matching(_IP, _ip_valid), 0.6, frozenset({"ip", "address", "server", "host"})),
    Kind("card", None, _matching(_CARD, _card_valid), 0.6, frozenset({"card", "visa", "credit", "carte", "karte", "tarjeta"})),
    Kind("phone", "+", _matching(_PHONE, lambda s: 9 <= len(_digits(s)) <= 15), 0.6, frozenset({"phone", "tel", "call", "mobile", "fax"})),
    Kind("iban", None, _ibans, 0.7, frozenset({"iban", "account", "bank", "konto", "compte", "cuenta"})),
    Kind("ssn", "-", _matching(_SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"), 0.3, frozenset({"ssn", "social", "security"})),
)
_WORD = re.compile(r"[a-z]+")


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(begin, end, kind, score) by begin, then kind as listed."""
    found = []
    for place, kind in enumerate(RULES):
        if kind.mark is not None and kind.mark not in text:
            continue
        for begin, end in kind.spans(text):
            around = text[max(0, begin - NEAR) : begin].lower() + " " + text[end : end + NEAR].lower()
            near = not kind.context.isdisjoint(_WORD.findall(around))
            score = min(1.0, kind.score + CONTEXT_BONUS * near)
            if kind.name in BASE or score >= LEAST_SCORE:
                found.append((begin, place, end, kind.name, score))
    return [(b, e, k, s) for b, _, e, k, s in sorted(found)]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every whole text: kind, begin, end and score, by begin, then kind as listed."""
    item = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                spans = [
                    [{"kind": k, "begin": b, "end": e, "score": s} for b, e, k, s in find_spans(t or "")]
                    for t in part.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, pa.list_(item))], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every span replaced by its kind in angle brackets; overlapping spans count as the first of them."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = []
                for text in part.column("text").to_pylist():
                    pieces, done = [], 0
                    for b, e, k, _ in find_spans(text or ""):
                        if b >= done:
                            pieces += [text[done:b], f"<{k}>"]
                            done = e
                    texts.append(None if text is None else "".join([*pieces, text[done:]]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
