"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from storyloom.llm import turn_repair
from storyloom.llm.turn_repair import END, damaged, repairs, settled, walked

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string, doc_id string, gaps string"


def plain_damage(rows):
    """[(conv, turn, role, text)] after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def search(rows):
    """(cost, audit, repaired) of the cheapest edits: all states of all messages in order of cost and letters."""
    heap, done = [(0, "", 0, 0, ())], set()
    nxt = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    while True:
        cost, audit, i, q, kept = heapq.heappop(heap)
        if (i, q) in done:
            continue
        if i == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(kept)
        done.add((i, q))
        role, to = nxt[q]
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*kept, role + ":")))
        if i == len(rows):
            continue
        have, text, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, kept))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        keeps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(have[:1], {}).get(q)
        if keeps is not None:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, keeps, (*kept, f"{have}:{text}")))
        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, (*kept, f"{role}:{text}")))


def plain(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        kept, faults, seen = [r for r in plain_damage(rows) if r[0] == conv], [], set()
        for _, _, role, text in kept:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in kept if r[1] is not None]
        initials = [r[2][:1] for r in kept]
        cost, audit, text = search([(r[2], r[3], f) for r, f in zip(kept, faults)])
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return found


def found(df):
    assert df.columns == ["conv_id", *turn_repair._RESULT_NAMES]
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_auctions_against_search():
    """All stripes of up to three messages, random longer ones: cost and letters from the beginning to the end."""
    roles = ["system", "user", "assistant", "tool"]
    rng = random.Random(13)
    cases = [bytes(c) for n in range(4) for c in product(range(8), repeat=n)] + [bytes(rng.choices(range(8), [2, 9, 9, 1, 1, 2, 2, 1], k=rng.randrange(4, 60))) for _ in range(300)]
    for codes in cases:
        letters, state = walked(codes, END, 0)
        cost, audit, _ = search([(roles[c & 3], "x", "truncated" if c & 4 else "") for c in codes])
        assert "".join(letters) + turn_repair.END_LETTERS[state] == audit, codes
        assert turn_repair.cost_of(codes, END, 0) == cost


def test_prices_are_dual_feasible():
    codes = bytes([1, 2, 1, 5, 2, 0, 2, 1])
    arcs, sink = turn_repair.lattice(codes, END)
    price = [0] * (sink + 1)
    turn_repair.auction(arcs, 0, sink, price)
    assert all(price[i] <= cost + price[j] for i, out in enumerate(arcs) for _, cost, j in out)
    assert price[0] == settled(codes, END, 0)[0]
    assert settled(codes, (0, None, None, None), 1) is None  # nothing leads back to the beginning


def rows_at_random(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Hello there.", "Yes!", "And then", "Why?", "  \t", "", "ok.", "word", None]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", "analyst", None]
    out = []
    for conv in range(conversations):
        for turn in range(rng.randrange(most)):
            at = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2])
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"Turn {turn} of it." if rng.random() < 0.6 else rng.choice(texts)
            out += [(conv if conv else None, at, role, text)] * (3 if rng.random() < 0.03 else 1)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_random_conversations(spark):
    rows = rows_at_random(1, 120, 14)
    assert found(repairs(damaged(frame(spark, rows)))) == plain(rows)


def test_long_conversations_in_blocks(spark, monkeypatch):
    """One conversation with a third of all rows and more: small blocks, many partitions."""
    monkeypatch.setattr(turn_repair, "BLOCK", 20)
    rng = random.Random(3)
    rows = rows_at_random(2, 40, 9)
    rows += [(7777, t, ["user", "assistant"][t % 2] if rng.random() < 0.9 else rng.choice(["tool", "system", "user"]), f"Say {rng.randrange(500)}" + rng.choice([".", "!", "", "."])) for t in range(700)]
    rows += [(8888, t // 3, "user", "again and again.") for t in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert found(repairs(damaged(frame(spark, rows).repartition(5)))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "Hi."), (1, 0, "user", "Hi."), (2, 3, "", "."), (2, 3, "", "."), (None, None, None, None), (None, 5, "assistant", "x" * 200_000 + "."), (3, 1, "user", "\n.\n"), (4, 2, "Ünter", "é!"),
        (5, -9_000_000_000_000_000_000, "user", "A."), (5, 9_000_000_000_000_000_000, "assistant", "B."), *[(6, 1, "user", "Same text.")] * 300,
    ]
    want = plain(rows)
    want[5] = (turn_repair.LONGEST, *want[5][1:]) if want[5][0] > turn_repair.LONGEST else want[5]
    assert found(repairs(damaged(frame(spark, rows)))) == want
    assert repairs(damaged(frame(spark, []))).collect() == []
    every = [(k, t, "user", "x.") for k in range(400) for t in range(1)]  # some lose their only message
    got = found(repairs(damaged(frame(spark, every))))
    assert got == plain(every) and (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()


@pytest.mark.parametrize("seed", [5, 6])
def test_sql_on_random_conversations(spark, seed):
    rows = rows_at_random(seed, 25, 9)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute(turn_repair.OP13_SQL).fetchall()} == plain(rows)
