import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkledger.llm import conversations

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        yield conv, [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)


def cheapest(rows):
    """Least (cost, audit) and what it leaves, by trying every edit; rows are (role, text, forced, truncated)."""

    @lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text, forced, truncated = rows[i]
            cost, audit, left = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit, left))
            for letter, new, price in () if forced else (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                if (state, new[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    cost, audit, left = best(i + 1, new[:1], 0)
                    ways.append((cost + price + truncated, letter + audit, (f"{new}:{text}", *left)))
        if inserts < 4:
            for new in ("user", "assistant"):
                if (state == "u") == (new == "assistant"):
                    cost, audit, left = best(i, new[0], inserts + 1)
                    ways.append((cost + 2, "I" + audit, (f"{new}:", *left)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def expected(rows):
    by = defaultdict(list)
    for conv, copies in rows:
        by[conv] += copies
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, edited = set(), defaultdict(int), []
        for _, role, text in found:
            filled = text.strip(WHITE)
            fault = "blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            edited.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, left = cheapest(tuple(edited))
        yield (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()), left


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def wild_rows(seed, conversations_=120, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations_)]:
        for _ in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "admin", "sys", "Übung"])
            text = rng.choice(["Yes.", "No!", "why", "", " \n", None, "ok?", f"t{rng.randrange(9)}.", "x. \t", "so… ", "漢。", "a\nb."])
            rows.append((conv, rng.choice([None, *range(9)]), role, text))
    return rows + rows[:25]


def shown(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("chunk_rows", [3, conversations.CHUNK_ROWS])
def test_audit_equals_every_edit_tried(shipped, chunk_rows):
    rows = wild_rows(1)
    want = [r for r, _ in expected(damaged(rows))]
    table = shipped.createDataFrame(rows, SCHEMA).repartition(3)
    found = conversations.audit(conversations.damage(table), times="times", chunk_rows=chunk_rows)
    assert found.columns == COLUMNS and shown(found.collect()) == shown(want)


@pytest.mark.parametrize("chunk_rows", [4, conversations.CHUNK_ROWS])
def test_repaired_rows(shipped, chunk_rows):
    rows = wild_rows(2, 60)
    as_they_are = [(c, [(t, " " if r is None else r, " " if x is None else x)]) for c, t, r, x in rows]
    want = {conv[0]: list(left) for conv, left in expected(as_they_are)}
    table = shipped.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("key", "part", "seq", "back", "times", "a.b")})
    found = conversations.repair(table, chunk_rows=chunk_rows).orderBy("conv_id", "seq", "step").collect()
    got = defaultdict(list)
    for r in found:
        got[r.conv_id].append(f"{r.role}:{r.text}")
        assert r.edit in ("Keep", "Rerole", "Insert")
    assert {c: x for c, x in want.items() if x} == got


def test_giant_conversation_in_small_chunks(shipped):
    """Chunks of a conversation of many rows, traced from the last to the first."""
    rows = shipped.range(20_000).selectExpr("7 as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('Row ', id, if(id % 5 = 0, '', '.')) as text")
    whole, parts = (conversations.audit(rows, chunk_rows=n).collect() for n in (1 << 20, 128))
    assert whole == parts and len(whole) == 1 and len(whole[0].audit) >= 20_000
    repaired = conversations.repair(rows, chunk_rows=128).orderBy("seq", "step").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in repaired).encode()).hexdigest() == whole[0].repaired_sha256


def test_ids_of_text_and_empty_tables(shipped):
    rows = [("b:1", 0, "user", "Hi."), ("b:1", 1, "assistant", "Ho."), ("", 0, "user", "Hi."), (None, 0, "system", "Be.")]
    found = conversations.audit(shipped.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.audit, r.cost) for r in found) == [("", "KI", 2), ("None", "D", 3), ("b:1", "KK", 0)]
    nothing = shipped.createDataFrame([], SCHEMA)
    assert conversations.audit(nothing).count() == 0 and conversations.repair(nothing).count() == 0


def test_query_equals_plain_python(shipped):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    want = [r for r, _ in expected(damaged(rows))]
    found = entry.queries()["op12_conversation_repair"](shipped, SF)
    assert found.columns == COLUMNS and shown(found.collect()) == shown(want)
