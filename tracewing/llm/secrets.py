"""Secret scan over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived:
what any match must contain.  The index holds a posting (trigram, document) for
the trigrams that queries name; the postings of a document meet, and rules
whose query they satisfy become its candidates, which the expression then
verifies on the whole text.  A rule without mandatory trigrams scans all texts.

Only documents that a blocked Bloom filter of candidate ids passes are joined
with the candidates, so texts that hold nothing are never shuffled.

Defined results: a null or empty text has no spans; offsets are code points,
end exclusive; spans of different rules may overlap; documents that share an
id (or have none) share candidates and are verified each for itself; repeated
rows stay; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from re import _parser as syntax
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .tables import whole_text


class Rule(NamedTuple):
    kind: str
    pattern: str  # read alike by Java and Python
    least: int  # characters that the checked group must have
    group: int = 0


#: Fixed patterns; the first three are the base kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
BASE = ("assign", "access", "hex")
#: Alternatives that a run of literal text may have before it is cut.
MOST_STRINGS = 64

Query = list[set[frozenset[str]]]  # all of: any of: all trigrams


def _exact(op, arg) -> set[str] | None:
    """The strings that a part of an expression stands for, where they are few; else None."""
    if op is syntax.LITERAL:
        return {chr(arg).lower()}
    if op is syntax.IN:
        if any(kind is not syntax.LITERAL for kind, _ in arg):
            return None
        return {chr(code).lower() for _, code in arg}
    if op is syntax.SUBPATTERN:
        return _exact_sequence(arg[-1])
    if op is syntax.BRANCH:
        parts = [_exact_sequence(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is syntax.MAX_REPEAT and arg[0] in (0, 1) and arg[1] == 1:
        inner = _exact_sequence(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _exact_sequence(parts) -> set[str] | None:
    strings = {""}
    for op, arg in parts:
        more = _exact(op, arg)
        if more is None or len(strings) * len(more) > MOST_STRINGS:
            return None
        strings = {a + b for a in strings for b in more}
    return strings


def _walk(parts) -> Query:
    query, run = [], {""}

    def cut():
        if min(map(len, run)) >= 3:
            query.append({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run})

    for op, arg in parts:
        strings = _exact(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        cut()
        run = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
        if op is syntax.SUBPATTERN:
            query += _walk(arg[-1])
        elif op is syntax.MAX_REPEAT and arg[0] >= 1:
            query += _walk(arg[2])
        elif op is syntax.BRANCH:
            branches = [_walk(p) for p in arg[1]]
            if all(branches):  # any branch may be the one that matches, so one condition of each is enough
                query.append(set().union(*[b[0] for b in branches]))
    cut()
    return query


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of any match must contain; empty where nothing is mandatory."""
    query = _walk(syntax.parse(pattern))
    return [{c for c in part if not any(other < c for other in part)} for part in query]


def vocabulary(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for part in trigram_query(r.pattern) for choice in part for t in choice})


def trigram_index(docs: DataFrame, trigrams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, id): each document once under every trigram of the vocabulary that it contains."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(whole_text(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), t) for t in trigrams]))
    return low.select("id", F.explode(held).alias("trigram")).select("trigram", "id")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(id, rules): the rules whose query the document's postings satisfy."""

    def satisfied(query: Query) -> Column:
        every = F.lit(True)
        for part in query:
            some = F.lit(False)
            for choice in sorted(map(sorted, part)):
                wanted = F.array(*map(F.lit, choice))
                some = some | (F.size(F.array_intersect("held", wanted)) == len(choice))
            every = every & some
        return every

    held = index.groupBy("id").agg(F.collect_set("trigram").alias("held"))
    names = [F.when(satisfied(trigram_query(r.pattern)), r.kind) for r in rules]
    found = held.select("id", F.array_compact(F.array(*names)).alias("rules"))
    return found.where(F.size("rules") > 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _nothing() -> Column:
    return F.array().cast("array<struct<begin:int,place:int,kind:string,end:int>>")


#: Matches whose lengths are summed up together.
STEP = 64


def matches(text: Column, rule: Rule, place: int) -> Column:
    """Array of (begin, place, kind, end) of the rule's valid leftmost non-overlapping matches.

    A match begins after the texts between the matches so far and these matches
    themselves; their lengths are added up in steps, so that many matches in
    one text stay cheap.
    """
    pattern = F.lit(rule.pattern)

    def located(found: Column) -> Column:
        between = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
        own = F.transform(found, lambda s: F.length(s))
        if rule.group:
            checked = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda s: F.length(s))
        else:
            checked = own
        return _let(F.struct(between.alias("between"), own.alias("own"), checked.alias("checked")), with_lengths)

    def with_lengths(s: Column) -> Column:
        both = F.transform(s["own"], lambda n, i: n + F.get(s["between"], i))
        return _let(both, lambda b: with_sums(s, b))

    def with_sums(s: Column, both: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((F.size(both) - 1) / F.lit(STEP)).cast("int"))
        sums = F.transform(steps, lambda k: _total(F.slice(both, k * STEP + 1, F.lit(STEP))))
        return _let(sums, lambda t: F.filter(F.transform(s["own"], lambda n, i: one(s, both, t, n, i)), lambda x: x.isNotNull()))

    def one(s: Column, both: Column, sums: Column, n: Column, i: Column) -> Column:
        step = F.floor(i / F.lit(STEP)).cast("int")
        before = _total(F.slice(sums, F.lit(1), step)) + _total(F.slice(both, step * STEP + 1, i % STEP))
        begin = before + F.get(s["between"], i)
        span = F.struct(
            begin.alias("begin"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (begin + n).alias("end")
        )
        return F.when(F.get(s["checked"], i) >= rule.least, span)

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return _let(found, lambda f: F.when(F.size(f) > 0, located(f)).otherwise(_nothing()))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every document: array of (begin, place, kind, end) by begin, then rule as listed."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    index = trigram_index(docs, vocabulary(rules), id_col, text_col)
    found = candidates(index, indexed).select(F.col("id").alias("candidate"), "rules")
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    texts = bloom.mark(texts, F.col("id"), bloom.build(found, F.col("candidate")))
    suspects = texts.where("possible").join(found, F.col("id").eqNullSafe(F.col("candidate")), "left")

    def spans(gate: Callable[[Rule], Column | None]) -> Column:
        parts = []
        for place, rule in enumerate(rules):
            condition = gate(rule)
            if condition is None:
                continue
            all_matches = matches(F.col("text"), rule, place)
            parts.append(F.when(condition, all_matches).otherwise(_nothing()))
        return F.array_sort(F.concat(*parts)) if parts else _nothing()

    def full_scan_only(rule: Rule) -> Column | None:
        return None if rule in indexed else F.lit(True)

    def if_candidate(rule: Rule) -> Column:
        return F.coalesce(F.array_contains("rules", rule.kind), F.lit(False)) if rule in indexed else F.lit(True)

    clean = texts.where("not possible").select("id", spans(full_scan_only).alias("spans"))
    checked = suspects.select("id", spans(if_candidate).alias("spans"))
    return clean.unionByName(checked).withColumnRenamed("id", id_col)
