"""Conversation repair against brute force, in chunks of all sizes, and edge cases."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from checks.compare import duck
from tracewing.llm import structure
from tracewing.llm.queries import QUERIES, damaged
from tracewing.llm.structure import AT_END, UNKNOWN, Repair, costs_before, digests, fix_up, parallel, run_back, trace

BLANKS = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def best_edits(rows):
    """(cost, audit, roles) by trying all edits; rows are (initial, forced, truncated)."""

    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(rows):
            if state in (0, 3):
                options.append((0, "", ()))
        else:
            initial, forced, truncated = rows[i]
            left = 3 * truncated
            edits = [(4, "D", None, state)]
            if not forced:
                if (state, initial) in NEXT:
                    edits.append((left, "K", None, NEXT[state, initial]))
                edits += [(3 + left, "R", r, NEXT[state, r]) for r in "ua" if (state, r) in NEXT]
            for cost, letter, role, to in edits:
                c, a, r = best(i + 1, to, 0)
                options.append((cost + c, letter + a, ((letter, role), *r)))
        if inserted < 4:
            for role in "ua":
                if (state, role) in NEXT:
                    c, a, r = best(i, NEXT[state, role], inserted + 1)
                    options.append((3 + c, "I" + a, (("I", role), *r)))
        return min(options, default=(10**9, "", ()))

    return best(0, 0, 0)


def expected(rows):
    """The result for one conversation's (turn, role, text) rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        stripped = text.strip(BLANKS)
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    searched = tuple((i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults))
    cost, audit, edits = best_edits(searched)
    lines, at = [], 0
    names = {"u": "user", "a": "assistant"}
    for letter, role in edits:
        if letter == "I":
            lines.append(names[role] + ":")
            continue
        if letter != "D":
            lines.append(f"{names.get(role, rows[at][1])}:{rows[at][2]}")
        at += 1
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def in_order(rows):
    def key(r):
        return (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())

    return sorted(([t, " " if r is None else r, " " if x is None else x] for t, r, x in rows), key=key)


def repaired(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("conv", "digest", "place", "range", "chunk", "edits", "step", "no")})
    repair = Repair(df.repartition(3), **sizes)
    result = {r.conv: r.asDict() for r in repair.conversations.collect()}
    found = digests(repair.edits).collect()
    assert len({r.conv for r in found}) == len(found)
    for r in found:
        result[r.conv] |= r.asDict()
    return result


def check(spark, rows, **sizes):
    got = repaired(spark, rows, **sizes)
    convs = {}
    for conv, *row in rows:
        convs.setdefault(conv, []).append(row)
    assert set(got) == set(convs)
    for conv, of in convs.items():
        want = expected([tuple(r) for r in in_order(of)])
        assert {k: got[conv][k] for k in want} == want, (conv, of)


def conversations(seed, n, longest):
    chance = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "", " ", "\n", "Fine. ", "Odd?\t", "more", "a.", "b.", "c", "d!", "e?"]
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None]
    rows = []
    for conv in range(n):
        for turn in range(chance.randrange(1, longest)):
            text = None if chance.random() < 0.03 else chance.choice(texts) if chance.random() < 0.6 else f"{turn} {chance.choice(texts)}"
            rows.append((conv, chance.choice([turn, turn, turn, turn // 2, None, turn + 7]), chance.choice(roles), text))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"chunk": 1, "fan": 2}, {"chunk": 3, "fan": 2}])
def test_equals_brute_force(spark, sizes):
    check(spark, conversations(4, 60, 25), **sizes)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    convs = {}
    for conv, turn, role, text in duck(sf).execute("select conv_id, turn, role, text from conversations").fetchall():
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        rows = [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        convs.setdefault(conv, []).extend(rows)
    got = {r.conv_id: r.asDict() for r in QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert set(got) == set(convs)
    for conv, rows in convs.items():
        assert got[conv] == {"conv_id": conv} | expected([tuple(r) for r in in_order(rows)])


def test_edges(spark):
    rows = [
        (None, 1, "user", "Hi."), (None, None, "assistant", "Null turn first."), (1, None, None, None), (2, 1, "", ""),
        (3, 1, "user", "x" * 300_000 + "."), (3, 2, "assistant", "y" * 300_000), *[(4, 5, "user", "same.")] * 50,
        *[(5, t, "user", "same.") for t in range(60)], (6, -3, "system", "S."), (6, 9, "user", "U"), (7, 1, "ünder", "é."),
    ]
    check(spark, rows, chunk=4, fan=2)
    assert repaired(spark, rows[:0]) == {}


def test_dropped_conversations_stay(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kept = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 3)
    rows = [(dropped, 0, "user", "Gone."), (kept, 0, "user", None), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    empty = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}
    nothing = {"repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert got[dropped] == {"conv_id": dropped} | empty | nothing
    assert got[kept] == {"conv_id": kept} | empty | nothing | {"blank": 2, "illegal": 1, "cost": 8, "audit": "DD"}
    assert None in got
    assert damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")).where("conv_id is not null").count() == 2


def test_fix_ups_stop_early_and_equal_full_runs():
    chance = random.Random(2)
    stopped = 0
    for _ in range(500):
        codes = "".join(chance.choice("suaoSUAO") for _ in range(chance.randrange(1, 60)))
        right = structure.normal(run_back("".join(chance.choice("ua") for _ in range(9)), AT_END))
        left, reran = fix_up(codes, UNKNOWN, run_back(codes, UNKNOWN), right)
        assert left == run_back(codes, right)
        stopped += reran < len(codes)
    assert stopped > 100
    assert parallel((0, 1, 2, 3), (5, 6, 7, 8)) and not parallel((0, 0, 0, 0), (0, 0, 0, 1))
    assert costs_before(AT_END, "u")[2] == min(4 + AT_END[2], 3 + costs_before(AT_END, "u")[3], 3 + AT_END[3])
    assert trace("ua", AT_END, 0, True) == (["K", "K", ""], 3)


def test_costs_converge_over_many_chunks(spark):
    """A long conversation in small chunks: every chunk but the last begins with speculative costs."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(700)] + [(2, t, "user", f"{t}.") for t in range(300)]
    check_rows = {1: "K" * 700}
    got = repaired(spark, rows, chunk=5, fan=4)
    assert got[1]["audit"] == check_rows[1] and got[1]["cost"] == 0
    want = expected_long([("u", False)] * 300)
    assert (got[2]["cost"], got[2]["audit"]) == want


def expected_long(rows):
    """(cost, audit) without recursion, for long conversations: least (cost, rest of audit) for each state, backwards."""
    inf = (10**9, "")
    best = [(0, ""), inf, inf, (0, "")]
    for step in range(len(rows) + 1):
        if step:
            initial, truncated = rows[len(rows) - step]
            behind, best = best, [inf] * 4
            for s in range(4):
                left = 3 * truncated
                options = [(4 + behind[s][0], "D" + behind[s][1])]
                if (s, initial) in NEXT:
                    c, a = behind[NEXT[s, initial]]
                    options.append((left + c, "K" + a))
                for r in "ua":
                    if (s, r) in NEXT:
                        c, a = behind[NEXT[s, r]]
                        options.append((3 + left + c, "R" + a))
                best[s] = min(options)
        for _ in range(3):
            best = [min([best[s]] + [(3 + best[NEXT[s, r]][0], "I" + best[NEXT[s, r]][1]) for r in "ua" if (s, r) in NEXT]) for s in range(4)]
    return best[0]
