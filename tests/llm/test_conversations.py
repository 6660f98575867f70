"""Conversation repair against a search over all edits of whole conversations, in chunks of any size."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from titleloom.llm import conversations
from titleloom.llm.queries import operators as Q

SMALL = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows per conversation after damage, in order."""
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        out = found[conv_id]
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out.extend([(turn, role, text)] * (2 if fate == 3 else 1))
    for out in found.values():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return found


def plain_repair(rows):
    """All results of one conversation: forward over rows, for each role that may follow keep the least (cost, audit)."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.rstrip(BLANKS)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    following = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    names = {"u": "user", "a": "assistant"}

    def insertions(states):
        states = dict(states)
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                for role in following[state]:
                    offer = (cost + 2, audit + "I", (*lines, names[role] + ":")) if role in names else None
                    if offer and (role not in states or offer[:2] < states[role][:2]):
                        states[role] = offer
        return states

    states = insertions({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in states.items():
            offers = [(state, (cost + 3, audit + "D", lines))]
            if fault in ("", "truncated"):
                extra = cost + (fault == "truncated")
                if role[:1] in following[state]:
                    offers.append((role[:1], (extra, audit + "K", (*lines, f"{role}:{text}"))))
                offers += [
                    (r, (extra + 2, audit + "R", (*lines, f"{names[r]}:{text}"))) for r in following[state] if r in names
                ]
            for after, offer in offers:
                if after not in new or offer[:2] < new[after][:2]:
                    new[after] = offer
        states = insertions(new)
    cost, audit, lines = min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])
    return (
        gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def expected(rows):
    return sorted(((i, *plain_repair(out)) for i, out in damaged(rows).items()), key=repr)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def drawn(seed, conversations, most):
    draw = random.Random(seed)
    rows = []
    for conv_id in range(conversations):
        count = draw.randint(1, most)
        for turn in range(count):
            role = draw.choices(["user", "assistant", "system", "tool", "", None], [9, 9, 2, 1, 1, 1])[0]
            text = draw.choice(["Yes.", "No!", "why?", "cut", "cut \n", "", " \t", None, f"Own {conv_id} {turn}.", f"own {turn}"])
            rows.append((conv_id, draw.choice([turn, turn, turn, None, draw.randint(0, 50)]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk_rows", [1, 2, 5, 2048])
def test_chunks_of_any_size(spark, chunk_rows):
    rows = drawn(chunk_rows, 150, 14) + [(1000, t, r, x) for _, t, r, x in drawn(7, 1, 4000)[:300]] + [(None, 0, "user", "Hi.")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pieces = conversations.repair_conversations(conversations.damage(table), chunk_rows=chunk_rows)
    assert found(conversations.summarize(pieces)) == expected(rows)


def test_one_long_conversation(spark):
    """Many chunks of a conversation whose best roles depend on its end; one more has only dropped rows."""
    rows = [(5, t, "user" if t % 2 else "assistant", f"Line {t}.") for t in range(4000)]
    rows += [(6, t, "user", "The same.") for t in range(700)] + [(7, None, "assistant", f"No turn {i % 9}") for i in range(600)]
    dropped = next(t for t in range(10**6) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    rows += [(8, dropped, "user", "Gone.")]
    table = spark.createDataFrame(rows, SCHEMA)
    pieces = conversations.repair_conversations(conversations.damage(table), chunk_rows=50)
    results = found(conversations.summarize(pieces))
    assert results == expected(rows)
    assert (8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in results


def test_passes_until_vectors_agree(spark):
    """Rows that only keep leave the vector behind them as it was, so its news has to pass through every chunk."""
    search = conversations.Search()
    kinds = bytes([4 * 1, 4 * 2] * 40)
    once = search.backward(kinds, conversations.FINAL)
    for end in (bytes((0, 0, 0, 0)), bytes((3, 3, 0, 2)), bytes((0, 2, 2, 0))):
        fresh = search.backward(kinds, end)
        assert search.backward(kinds, end, once[2:]) == fresh
    rows = [(1, 2 * t + (r == "assistant"), r, f"{r} {t}.") for t in range(60) for r in ("user", "assistant")]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(
        conversations.summarize(conversations.repair_conversations(conversations.damage(table), chunk_rows=3))
    ) == expected(rows)


def test_query_against_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select(*SCHEMA.replace(",", "").split()[::2]).collect()]
    assert found(Q.op13_conversation_repair(spark, SMALL)) == expected(rows)


def test_empty_tables_and_extra_columns(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hello.", "x", 3)], SCHEMA + ", kinds string, part int")
    pieces = conversations.repair_conversations(conversations.damage(table))
    assert found(conversations.summarize(pieces)) == expected([(1, 0, "user", "Hello.")])
    empty = conversations.repair_conversations(conversations.damage(table.limit(0)))
    assert conversations.summarize(empty).collect() == []


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "long words " * 100000 + "."), (1, 1, "assistant", "short."), (1, 2, "user", "x" * 400000 + "!"), (1, 3, "assistant", "end.")]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(conversations.summarize(conversations.repair_conversations(conversations.damage(table)))) == expected(rows)
