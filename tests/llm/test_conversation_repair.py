"""Conversation repair against a plain search over all edit scripts, and odd inputs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import scorewright.llm.conversation_repair as repair
from scorewright.llm.conversation_repair import conversation_repair, damaged, known, repaired, solved

ROWS = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def with_faults(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row, row] if kind == 3 else [row]
    return out


def cheapest(rows, faults):
    """Least (cost, audit) by uniform-cost search over (rows done, roles so far as a state), and the repaired rows."""
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in seen:
            continue
        seen.add((i, last))
        for role in ("user", "assistant"):
            if (last, role[0]) in grammar:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*out, f"{role}:")))
        if i == len(rows):
            continue
        _, _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = 5 * (faults[i] == "truncated")
        if (last, role[:1]) in grammar:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
        for other in ("user", "assistant"):
            if (last, other[0]) in grammar:
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, other[0], (*out, f"{other}:{text}")))


def brute_force(rows, damage=True):
    ids = {r[0] for r in rows}
    after = with_faults(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in ids:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, faults)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=str)


def result(spark, rows, damage=True, parts=3, **options):
    table = known(spark.createDataFrame(rows, ROWS).repartition(parts))
    found = conversation_repair(damaged(table) if damage else table, table, **options)
    assert found.columns == NAMES
    return sorted((tuple(r) for r in found.collect()), key=str)


def random_rows(seed, conversations=150, longest=14):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        turn = 0
        for _ in range(r.randint(1, longest)):
            turn += r.choice([1, 1, 1, 1, 2, 0, 3])
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = r.choice(["Ja.", "Nein!", "No", "what? ", " \n", "", "é.", "so…", None, f"text {r.random()}."])
            rows.append((conv, r.choice([turn, turn, turn, turn, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_scripts(spark, seed):
    rows = random_rows(seed)
    assert result(spark, rows) == brute_force(rows)
    assert result(spark, rows, damage=False) == brute_force(rows, damage=False)


def test_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    found = conversation_repair(damaged(known(table)), table)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_force([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_grammar_changes_no_result(spark):
    rows = random_rows(5, 60, 30)
    assert result(spark, rows, rules=0) == result(spark, rows, rules=5) == result(spark, rows)


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    """One conversation has a third of all rows; its pieces lie in several tasks. Blocks of 64 rows and 30 rows a row group."""
    rows = random_rows(7, 60, 14)
    r = random.Random(8)
    rows += [(1000, t // 2, r.choice(["user", "assistant", "system"]), r.choice(["So.", f"{r.random()}.", f"{r.random()}", "", "So."])) for t in range(300)]
    assert result(spark, rows) == brute_force(rows)
    spread = repair._narrow(known(spark.createDataFrame(rows, ROWS))).repartitionByRange(7, *repair._ORDER)
    assert spread.where("conv_id = 1000").select(F.spark_partition_id()).distinct().count() > 1


# Names of a grammar's first rules.
ONE, TWO = chr(0xE000), chr(0xE001)


def test_rules_are_shared():
    matrices = repair.rule_matrices(("ua", ONE + ONE))
    line = matrices[TWO][0][3]
    assert line[0] == 0 and line[1].letters() == "KKKK"
    assert line[1].left is matrices[ONE][0][3][1]
    assert repair.compressed("uauauas", ("ua", ONE + ONE)) == TWO + ONE + "s"


def test_rules_are_the_frequent_pairs(spark):
    blocks = spark.createDataFrame([("uauauaua", 10), ("suaua", 3), ("aaa", 2)], "symbols string, n long")
    rules = repair.re_pair(blocks)
    assert rules[0] == "ua" and ONE + ONE in rules
    assert repair.re_pair(blocks.limit(0)) == ()


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "bot", "Yes!"), (1, 3, "user", "and"), (2, 0, "assistant", "x" * 2_000_000 + "."), (3, 0, "user", " ")]
    got = [tuple(r) for r in repaired(known(spark.createDataFrame(rows, ROWS))).orderBy("conv_id", "position").collect()]
    audits = {r.conv_id: r.audit for r in solved(known(spark.createDataFrame(rows, ROWS))).collect()}
    assert audits == {r[0]: r[7] for r in brute_force(rows, damage=False)}
    assert audits[1] == "KDRD" and got[:2] == [(1, 0, 0, "user", "Hi.", "K"), (1, 1, 2, "assistant", "Yes!", "R")]
    assert all(conv == 1 for conv, *_ in got)


def test_empty_and_odd_tables(spark):
    assert result(spark, []) == []
    rows = [(None, None, None, None), (None, None, None, None), (5, None, "user", "A."), (5, None, "assistant", "B."), (6, 2**40, "user", "C.")]
    assert result(spark, rows) == brute_force(rows)
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone."), (dropped + 1, 5, "user", "there.")]
    got = result(spark, rows)
    assert got == brute_force(rows) and (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    clashing = spark.createDataFrame(rows, ROWS).withColumns({"audit": F.lit("x"), "_h": F.lit(1), "part": F.lit(2), "symbols": F.lit("")})
    found = conversation_repair(damaged(known(clashing)), clashing)
    assert sorted((tuple(r) for r in found.collect()), key=str) == got
