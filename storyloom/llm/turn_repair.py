"""Repair of damaged conversations by cheapest edits, found by auctions over an integer lattice.

A conversation's role initials must read `(s?(ua)+)?`. Four states say what may come next; a node of the lattice is a message and a state, its
arcs are Keep, Rerole, Delete (to the next message) and Insert (to another state). Blank and duplicate messages are always deleted, so they
are no part of the lattice.

Shortest paths come from the auction algorithm: every node has a price, at first zero; a path grows from the origin along its cheapest arc
while the last node's price is as high as that arc allows, else the price is raised and the path drops the node. When the path meets the sink,
the origin's price is the distance, and because prices never exceed an arc's cost plus the price behind it, every shortest path runs over
tight arcs only. The one with the least letters is traced over tight arcs that reach the sink. A path may be dropped back to its origin for each
unit of cost, so auctions run over stripes of few messages, from the last to the first, with the next stripe's distances as exits; stripes repeat
and are remembered.

One sort by range of conversation, turn, role and text deals all messages out, wherever a conversation lies. Conversations inside one
partition are done there. Those at its edges, and long ones, become blocks of bounded size: each is settled for every pair of entry and exit,
a scan over these small matrices gives each block its exits, each block is traced for every entry, and a last ordered stream goes through
the blocks, takes the right trace and hashes. No conversation is held in one task as a whole, only its letters.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import documents, small_batches, stash

WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a; and what a new user or assistant message leads to.
NEXT = (2, 2, 3, 2)
NEW_ROLE = ("user", "user", "assistant", "user")
#: Where a kept message leads: by its class (s, u, a, other) and state.
CLASS = {"s": 0, "u": 1, "a": 2}
KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None, None, None, None))
#: Distance from each state to the end of a conversation, and the letters of what is inserted there.
END, END_LETTERS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: Messages of a stripe, and messages and bytes of a block.
STRIPE, BLOCK, BLOCK_BYTES = 8, 256, 4 << 20
FINE, BLANK, DUPLICATE, CUT = range(4)
LONGEST = (1 << 63) - 1

Exits = tuple[int | None, ...]


def lattice(codes: bytes, exits: Exits) -> tuple[list[list[tuple[str, int, int]]], int]:
    """Arcs (letter, cost, node) of each node 4 * message + state, and the sink; codes are class + 4 where truncated. Arcs that lead nowhere are left out."""
    n = len(codes)
    sink = 4 * (n + 1)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(sink + 1)]
    alive = [False] * sink + [True]
    for q in range(4):
        if exits[q] is not None:
            arcs[4 * n + q], alive[4 * n + q] = [("", exits[q], sink)], True
    for i in range(n - 1, -1, -1):
        kind, more = codes[i] & 3, TRUNCATED if codes[i] & 4 else 0
        for q in range(4):
            out = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + NEXT[q]), ("R", REROLE + more, 4 * i + 4 + NEXT[q])]
            if KEPT[kind][q] is not None:
                out.insert(2, ("K", more, 4 * i + 4 + KEPT[kind][q]))
            arcs[4 * i + q] = out
        for _ in range(3):  # inserts stay in the layer
            for q in range(4):
                alive[4 * i + q] = any(alive[j] for _, _, j in arcs[4 * i + q])
        for q in range(4):
            arcs[4 * i + q] = [a for a in arcs[4 * i + q] if alive[a[2]]]
    return arcs, sink


def auction(arcs: list[list[tuple[str, int, int]]], origin: int, sink: int, price: list[int]) -> None:
    """Raises prices until tight arcs lead from origin to sink. Prices must not exceed any arc's cost plus the price behind it."""
    path = [origin]
    while path[-1] != sink:
        at = path[-1]
        best, to = min((cost + price[j], j) for _, cost, j in arcs[at])
        if price[at] < best:
            price[at] = best
            if at != origin:
                path.pop()
        else:
            path.append(to)


@functools.lru_cache(maxsize=1 << 16)
def settled(codes: bytes, exits: Exits, entry: int) -> tuple[int, tuple[str, ...], int] | None:
    """(cost, letters for each message, exit) of the cheapest way through a stripe, the least letters of equal ones; None if there is none."""
    arcs, sink = lattice(codes, exits)
    if not arcs[entry]:
        return None
    price = [0] * (sink + 1)
    auction(arcs, entry, sink, price)
    reaches: dict[int, bool] = {sink: True}

    def tight(node: int) -> list[tuple[str, int]]:
        return [(letter, j) for letter, cost, j in arcs[node] if price[node] == cost + price[j]]

    def good(node: int) -> bool:
        if node not in reaches:
            reaches[node] = any(good(j) for _, j in tight(node))
        return reaches[node]

    letters, now, at = [], "", entry
    while at < 4 * len(codes):
        letter, to = min(x for x in tight(at) if good(x[1]))
        now += letter
        if letter != "I":
            letters.append(now)
            now = ""
        at = to
    return price[entry], tuple(letters), at & 3


def _apart(exits: Exits) -> tuple[int, Exits]:
    """The least exit and how much the others are above it."""
    least = min(x for x in exits if x is not None)
    return least, tuple(None if x is None else x - least for x in exits)


def through(codes: bytes, exits: Exits) -> list[Exits]:
    """Distances at the stripes' joints: those at each stripe's end, and last those at the beginning of all."""
    joints = [exits]
    for a in range((len(codes) - 1) // STRIPE * STRIPE, -1, -STRIPE) if codes else ():
        least, apart = _apart(joints[-1])
        ways = [settled(codes[a : a + STRIPE], apart, q) for q in range(4)]
        joints.append(tuple(None if w is None else least + w[0] for w in ways))
    return joints


def walked(codes: bytes, exits: Exits, entry: int) -> tuple[list[str], int]:
    """Letters for each message, and the exit, of the cheapest way through all stripes."""
    joints, letters, at = through(codes[STRIPE:], exits) if codes else [exits], [], entry
    for a in range(0, len(codes), STRIPE):
        _, some, at = settled(codes[a : a + STRIPE], _apart(joints.pop())[1], at)
        letters += some
    return letters, at


def cost_of(codes: bytes, exits: Exits, entry: int) -> int:
    """The distance from an entry; the first stripe is settled for this entry only."""
    least, apart = _apart(through(codes[STRIPE:], exits)[-1])
    return least + settled(codes[:STRIPE], apart, entry)[0] if codes else exits[entry]


def crossing(codes: bytes) -> list[int | None]:
    """Distances from each entry (rows) to each exit (columns) of a block, one after the other."""
    columns = [through(codes, tuple(0 if q == x else None for q in range(4)))[-1] for x in range(4)]
    return [columns[x][q] for q in range(4) for x in range(4)]


class Block:
    """Messages of a conversation, in order; equal ones of one turn stand together as one with a number of copies."""

    def __init__(self, conv: Any):
        self.conv = conv
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[int] = []
        self.copies: list[int] = []
        self.turns: list[int | None] = []
        self.bytes = 0

    def add(self, turn: int | None, role: str, text: str, fault: int, copies: int) -> None:
        if self.roles and (self.turns[-1], self.roles[-1], self.texts[-1]) == (turn, role, text):
            self.copies[-1] += copies
            return
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.copies.append(copies)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.roles) >= BLOCK or self.bytes >= BLOCK_BYTES

    def codes(self) -> bytes:
        """For each message that may stay the class of its role, and 4 more where it is truncated."""
        kinds = (CLASS.get(r[:1], 3) for r in self.roles)
        return bytes(kind + (4 if f == CUT else 0) for kind, f in zip(kinds, self.faults) if f in (FINE, CUT))

    def counts(self) -> dict[str, int | str | None]:
        """What adds up over blocks, and what the join with the next block needs."""
        of = lambda fault: sum(c for f, c in zip(self.faults, self.copies) if f == fault)
        again = sum(c - 1 for f, c in zip(self.faults, self.copies) if f in (FINE, CUT))
        initials = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        return {
            "blank": of(BLANK), "duplicate": of(DUPLICATE) + again, "truncated": of(CUT) - sum(c - 1 for f, c in zip(self.faults, self.copies) if f == CUT),
            "illegal": sum(c - 1 for c in self.copies) + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "first_role": initials[0] if initials else None, "last_role": initials[-1] if initials else None,
        }

    def deleted(self) -> int:
        """The cost of what is always deleted."""
        return DELETE * sum(c if f in (BLANK, DUPLICATE) else c - 1 for f, c in zip(self.faults, self.copies))

    def edited(self, letters: list[str], state: int) -> tuple[str, list[tuple[str, str]]]:
        """The audit, and the messages that stay, for the letters of the free messages from a state."""
        audit, kept, k = [], [], 0
        for role, text, fault, copies in zip(self.roles, self.texts, self.faults, self.copies):
            if fault in (BLANK, DUPLICATE):
                audit.append("D" * copies)
                continue
            audit.append(letters[k] + "D" * (copies - 1))
            for letter in letters[k]:
                if letter == "K":
                    kept.append((role, text))
                    state = KEPT[CLASS[role[:1]]][state]
                elif letter != "D":
                    kept.append((NEW_ROLE[state], "" if letter == "I" else text))
                    state = NEXT[state]
            k += 1
        return "".join(audit), kept


class Total:
    """One conversation's result, put together from its blocks in order."""

    def __init__(self) -> None:
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last_role = None
        self.state, self.audit, self.hash, self.written = 0, [], hashlib.sha256(), False

    def add(self, counts: dict, audit: str, kept: list[tuple[str, str]], state: int) -> None:
        for name in self.sums:
            self.sums[name] += counts[name]
        if counts["first_turn"] is not None:
            self.sums["turns"] -= counts["first_turn"] == self.high
            self.low = counts["first_turn"] if self.low is None else self.low
            self.high = counts["last_turn"]
        if counts["first_role"] is not None:
            if self.last_role is not None and self.last_role + counts["first_role"] not in ("su", "ua", "au"):
                self.sums["illegal"] += 1
            self.last_role = counts["last_role"]
        self.audit.append(audit)
        self.write(kept)
        self.state = state

    def write(self, kept: list[tuple[str, str]]) -> None:
        if kept:
            self.hash.update((("\n" if self.written else "") + "\n".join([f"{role}:{text}" for role, text in kept])).encode())
            self.written = True

    def row(self, cost: int) -> tuple:
        tail = [(NEW_ROLE[q], "") for q in ((1, 2) if self.state == 1 else (2,) if self.state == 2 else ())]
        self.write(tail)
        gaps = 0 if self.low is None else min(LONGEST, self.high - self.low + 1 - self.sums["turns"])
        s = self.sums
        return gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, "".join(self.audit) + END_LETTERS[self.state], self.hash.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_OPEN = "seq long, turns array<long>, roles array<string>, texts array<string>, faults array<int>, copies array<long>, matrix array<long>, deleted long"


def damaged(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations with the faults that crc32 of `conv_id:turn` deals out; copies 0: a message that is lost."""
    blank = F.lit(" ")
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("d", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("d").isin(0, 1), "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 0, "").when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).cast("long").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """rows of damaged() with `fault`: each message's first one. Messages said earlier are found by digests that occur twice, the rest is not joined."""
    rows = rows.withColumn("said", F.md5("text")).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    seen = rows.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s")).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")), "left")
    ends = F.right(F.call_function("rtrim", F.lit(WHITE), F.col("text")), F.lit(1))
    fault = F.when(F.translate("text", WHITE, "") == "", BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(~ends.isin(".", "!", "?"), CUT).otherwise(FINE)
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def repairs(messages: DataFrame) -> DataFrame:
    """One row for each conversation of messages (conv_id, turn, role, text, copies): its faults, the cheapest edits and the digest of the result.

    Messages are taken by turn, null turns first; those of one turn by role and text. Texts and roles must not be null; an empty role, or one
    that does not begin with s, u or a, cannot be kept. A null conv_id is a conversation of its own. Messages with 0 copies do not count, but
    their conversation has a row. An empty table gives an empty result; columns with other names are not looked at.
    """
    spark = messages.sparkSession
    small_batches(spark)
    ordered = with_faults(messages)
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = messages.schema["conv_id"].dataType
    arrow_kind = _arrow(kind)
    first = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(f"{RESULT}, {_OPEN}")])
    names, types = [f.name for f in first], [arrow_kind, *(_arrow(f.dataType) for f in first[1:])]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole conversations get their result; those that may go on in another partition, and long ones, are written as blocks."""
        part = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        size = n = 0
        block, inside = None, False  # inside: the block began after another conversation of this partition, and is that conversation's first

        def opened(b: Block) -> None:
            nonlocal n, size
            out.append((b.conv, *[None] * len(_RESULT_NAMES), part + n, b.turns, b.roles, b.texts, b.faults, b.copies, crossing(b.codes()), b.deleted()))
            n, size = n + 1, size + b.bytes

        def closed(b: Block) -> None:
            codes, total = b.codes(), Total()
            letters, state = walked(codes, END, 0)
            total.add(b.counts(), *b.edited(letters, 0), state)
            out.append((b.conv, *total.row(b.deleted() + cost_of(codes, END, 0)), *[None] * 8))

        for conv, turn, role, text, copies, fault in _batches(batches):
            if block is None:
                block = Block(conv)
            elif block.conv != conv:
                (closed if inside else opened)(block)
                block, inside = Block(conv), True
            elif block.full() and (block.turns[-1], block.roles[-1], block.texts[-1]) != (turn, role, text):
                opened(block)
                block, inside = Block(conv), False
            if copies:
                block.add(turn, role, text, fault, copies)
            if size > BLOCK_BYTES or len(out) > 10_000:
                yield table(out)
                out, size = [], 0
        if block is not None:
            opened(block)
        if out:
            yield table(out)

    solved = stash(ordered.select("conv_id", "turn", "role", "text", "copies", "fault").mapInArrow(settle, first))
    done = solved.where("seq is null").select("conv_id", *_RESULT_NAMES)
    return done.unionByName(_long(solved.where("seq is not null").select("conv_id", *(x.split()[0] for x in _OPEN.split(", "))), kind, arrow_kind))


def _long(blocks: DataFrame, kind: T.DataType, arrow_kind: pa.DataType) -> DataFrame:
    """Results of conversations that lie in several blocks, or at the edge of a partition."""

    def exits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a conversation from the last to the first: each one's distances to the end, and the first one's as `cost`."""
        conv, ahead = object(), END
        for batch in batches:
            seqs, exits = [], []
            for c, seq, matrix, deleted in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    conv, ahead = c, END
                seqs.append(seq)
                exits.append(ahead)
                ahead = tuple(min(m + x for m, x in zip(matrix[4 * q : 4 * q + 4], ahead) if m is not None) for q in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(exits, pa.list_(pa.int64()))], names=["at", "exits"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's letters and exit for every entry."""
        for batch in batches:
            ways = []
            for roles, faults, exits in zip(*(batch.column(c).to_pylist() for c in ("roles", "faults", "exits"))):
                b = Block(None)
                b.roles, b.faults = roles, faults
                found = [walked(b.codes(), tuple(exits), q) for q in range(4)]
                ways.append([{"letters": letters, "to": to} for letters, to in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, _WAYS)], names=[*batch.schema.names, "ways"])

    final = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(RESULT)])
    types = [arrow_kind, *(_arrow(f.dataType) for f in final[1:])]

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a conversation in order: the trace of the state it is in, its letters and its digest."""
        total, conv, cost = None, None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if total is None or row["conv_id"] != conv:
                    if total is not None:
                        out.append((conv, *total.row(cost + END[total.state])))
                    total, conv, cost = Total(), row["conv_id"], 0
                b = Block(conv)
                b.roles, b.texts, b.faults, b.copies, b.turns = row["roles"], row["texts"], row["faults"], row["copies"], row["turns"]
                way = row["ways"][total.state]
                before = total.state
                total.add(b.counts(), *b.edited(way["letters"], before), way["to"])
                cost += row["deleted"] + sum(_spent(way["letters"], b.codes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[f.name for f in final])
        if total is not None:
            last = (conv, *total.row(cost + END[total.state]))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, types)], names=[f.name for f in final])

    scan = blocks.select("conv_id", "seq", "matrix", "deleted").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq"))
    exits = scan.mapInArrow(exits_of, "at long, exits array<long>")
    known = blocks.drop("matrix").join(exits, F.col("seq") == F.col("at")).drop("at")
    schema = T.StructType([*known.schema, T.StructField("ways", T.ArrayType(T.StructType.fromDDL("letters array<string>, to int")))])
    ways = known.mapInArrow(traced, schema)
    return ways.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(streamed, final)


_WAYS = pa.list_(pa.struct([("letters", pa.list_(pa.string())), ("to", pa.int32())]))
_COST = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}


def _spent(letters: list[str], codes: bytes) -> Iterator[int]:
    for some, code in zip(letters, codes):
        yield sum(map(_COST.__getitem__, some)) + (TRUNCATED if code & 4 and some[-1] != "D" else 0)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(documents(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)::BIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
src AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT src.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS d FROM src, tab),
dam AS (SELECT rid, conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE d <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, copy) AS i FROM dam),
flt AS (SELECT *, left(role, 1) AS c, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS e, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS said, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pc FROM num),
f AS (SELECT *, e = '' AS blank, e <> '' AND said > 1 AS dup, e <> '' AND said = 1 AND e NOT IN ('.', '!', '?') AS cut FROM flt),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
  count(*) FILTER (WHERE pc IS NOT NULL AND pc || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
-- A state's best way so far: cost, letters, result. w[1..4]: nothing yet, after s, after u, after a. One insert at most stands before a kept or changed message.
dp AS (
  SELECT conv_id, 0::BIGINT AS i, [{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}, NULL, NULL, NULL] AS w FROM cnt
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, [list_min(list_filter(s1, lambda x: x IS NOT NULL)), list_min(list_filter(s2, lambda x: x IS NOT NULL)), list_min(list_filter(s3, lambda x: x IS NOT NULL)), list_min(list_filter(s4, lambda x: x IS NOT NULL))]
  FROM (
    SELECT dp.conv_id, dp.i,
      [CASE WHEN w[1] IS NULL THEN NULL ELSE {'c': w[1].c + 2, 'a': w[1].a || 'D', 'r': w[1].r} END] AS s1,
      [CASE WHEN w[2] IS NULL THEN NULL ELSE {'c': w[2].c + 2, 'a': w[2].a || 'D', 'r': w[2].r} END,
       CASE WHEN w[1] IS NULL OR gone OR m.c <> 's' THEN NULL ELSE {'c': w[1].c + p, 'a': w[1].a || 'K', 'r': list_append(w[1].r, own)} END] AS s2,
      list_concat([CASE WHEN w[3] IS NULL THEN NULL ELSE {'c': w[3].c + 2, 'a': w[3].a || 'D', 'r': w[3].r} END,
        CASE WHEN w[3] IS NULL OR gone OR m.c <> 'u' THEN NULL ELSE {'c': w[3].c + 5 + p, 'a': w[3].a || 'IK', 'r': list_concat(w[3].r, ['assistant:', own])} END,
        CASE WHEN w[3] IS NULL OR gone THEN NULL ELSE {'c': w[3].c + 6 + p, 'a': w[3].a || 'IR', 'r': list_concat(w[3].r, ['assistant:', 'user:' || text])} END],
        list_transform([w[1], w[2], w[4]], lambda x: CASE WHEN x IS NULL OR gone OR m.c <> 'u' THEN NULL ELSE {'c': x.c + p, 'a': x.a || 'K', 'r': list_append(x.r, own)} END),
        list_transform([w[1], w[2], w[4]], lambda x: CASE WHEN x IS NULL OR gone THEN NULL ELSE {'c': x.c + 1 + p, 'a': x.a || 'R', 'r': list_append(x.r, 'user:' || text)} END)) AS s3,
      list_concat([CASE WHEN w[4] IS NULL THEN NULL ELSE {'c': w[4].c + 2, 'a': w[4].a || 'D', 'r': w[4].r} END,
        CASE WHEN w[3] IS NULL OR gone OR m.c <> 'a' THEN NULL ELSE {'c': w[3].c + p, 'a': w[3].a || 'K', 'r': list_append(w[3].r, own)} END,
        CASE WHEN w[3] IS NULL OR gone THEN NULL ELSE {'c': w[3].c + 1 + p, 'a': w[3].a || 'R', 'r': list_append(w[3].r, 'assistant:' || text)} END],
        list_transform([w[1], w[2], w[4]], lambda x: CASE WHEN x IS NULL OR gone OR m.c <> 'a' THEN NULL ELSE {'c': x.c + 5 + p, 'a': x.a || 'IK', 'r': list_concat(x.r, ['user:', own])} END),
        list_transform([w[1], w[2], w[4]], lambda x: CASE WHEN x IS NULL OR gone THEN NULL ELSE {'c': x.c + 6 + p, 'a': x.a || 'IR', 'r': list_concat(x.r, ['user:', 'assistant:' || text])} END)) AS s4
    FROM dp JOIN (SELECT *, role || ':' || text AS own, blank OR dup AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS p FROM f) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.i = dp.i + 1
  ) dp
),
fin AS (SELECT dp.conv_id, list_min(list_filter([w[1], CASE WHEN w[2] IS NULL THEN NULL ELSE {'c': w[2].c + 10, 'a': w[2].a || 'II', 'r': list_concat(w[2].r, ['user:', 'assistant:'])} END,
  CASE WHEN w[3] IS NULL THEN NULL ELSE {'c': w[3].c + 5, 'a': w[3].a || 'I', 'r': list_concat(w[3].r, ['assistant:'])} END, w[4]], lambda x: x IS NOT NULL)) AS b
  FROM dp JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM dp.conv_id AND cnt.n = dp.i)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id
"""
