"""Conversation repair against exhaustive search and a plain version of the whole contract."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tilewright.llm import conversations, queries

GOAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search over whole prefixes; rows: (role, text, fault)."""
    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, i, roles, out = heapq.heappop(queue)
        if i == len(rows) and GOAL.fullmatch(roles):
            return cost, audit, out
        if (i, roles) in done or len(roles) > 2 * len(rows) + 2:
            continue
        done.add((i, roles))
        if not re.match(r"(s?u?|s?(ua)+u?)$", roles):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 5, audit + "I", i, roles + role[0], (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, roles, out))
            if fault in ("", "truncated"):
                more = cost + 5 * (fault == "truncated")
                heapq.heappush(queue, (more, audit + "K", i + 1, roles + (role[:1] or "?"), (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (more + 1, audit + "R", i + 1, roles + new[0], (*out, (new, text))))


def plain(rows, damage=True):
    """conv_id -> the contract's values, from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20 if damage else 9
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in found:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in found if t is not None]
        initials = [r[:1] for _, r, _ in found]
        cost, audit, repaired = cheapest([(r, x, f) for (_, r, x), f in zip(found, faults, strict=True)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest(),
        )
    return out


def test_search_is_exhaustive():
    """All short symbol strings: cost and audit equal those of a search without bounds or states."""
    roles, faults = {0: "tool", 1: "system", 2: "user", 3: "assistant"}, {0: "", 1: "truncated", 2: "blank"}
    for n in range(4):
        for symbols in itertools.product(range(12), repeat=n):
            want = cheapest([(roles[s % 4], "x", faults[s // 4]) for s in symbols])
            assert conversations.search(bytes(symbols)) == want[:2], symbols
    rng = random.Random(2)
    for _ in range(150):
        symbols = [rng.choice([1, 2, 2, 3, 3, 6, 7, 10, 0]) for _ in range(rng.randint(4, 9))]
        assert conversations.search(bytes(symbols)) == cheapest([(roles[s % 4], "x", faults[s // 4]) for s in symbols])[:2], symbols


def test_long_conversations():
    """The search stays linear: a hundred thousand rows, and the bounds are kept in few bytes a row."""
    rng = random.Random(4)
    symbols = bytes(rng.choice([2, 3, 3, 2, 6, 1, 10]) for _ in range(100_000))
    cost, audit = conversations.search(symbols)
    base, above = conversations.suffix_bounds(symbols)
    assert cost == base[0] + above[0, 0] and len(audit) == 100_000 + audit.count("I") and above.dtype.itemsize == 1


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 3, "user", "no end"), (1, 4, "assistant", "Ok."),
    (2, 5, "tool", "odd."), (2, 5, "tool", "odd."), (2, None, None, None), (2, 7, "", "x?"), (None, None, "system", "s."), (None, 1, "user", "\t\n"),
    (3, 1, "assistant", "A. "), (3, 2, "assistant", "A. "), (3, 2, "user", "é" * 3000 + "."), (4, -3, "system", "Be kind."), (4, 9, "user", "Q\x0b?\n"), (5, 0, "user", None), (6, 2**40, "assistant", "."),
    (7, 0, "user", "a:b\nc"), (7, 1, "assistant", "中文。"), (7, 2, "assistant", "中文!"),
] + [(100 + k, t, r, f"Words {k} {t}.") for k in range(60) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][k % 3 :])]


@pytest.mark.parametrize("damage", [True, False])
def test_hard_rows(spark, damage):
    table = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id long, turn long, role string, text string, audit string, part int")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.digests(table, damage).collect()}
    assert got == plain(ROWS, damage)
    assert conversations.digests(table.limit(0), damage).count() == 0
    again = defaultdict(list)
    for r in conversations.repaired(table, damage).orderBy("conv_id", "position").collect():
        assert r.position == len(again[r.conv_id])
        again[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(again[c]).encode()).hexdigest() for c in got} == {c: v[-1] for c, v in got.items()}


def test_dropped_conversations(spark):
    """A conversation all of whose rows are dropped is still there."""
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = conversations.digests(spark.createDataFrame([(c, 0, "user", "x") for c in gone], "conv_id long, turn long, role string, text string")).collect()
    assert {tuple(r) for r in got} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone}


def test_one_shuffle(spark, sf):
    plan = queries.op11_branch_and_bound_repair(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in queries.op11_branch_and_bound_repair(spark, sf).collect()} == plain(rows)


def test_sql(sf):
    """The query's SQL on the given rows and on the hard ones."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("hard", pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    for source in (f"'{sf}/conversations.parquet'", "hard"):
        con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM {source}")
        rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
        assert {r[0]: r[1:] for r in con.execute(queries.oracle_sql()["op11_branch_and_bound_repair"]).fetchall()} == plain(rows)
