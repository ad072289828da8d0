"""Keyed state that is right over any split of the input into micro-batches.

A key's rows are taken in order of time by a step function. Rows may come in any order within the stream's delay: state up to the watermark is
settled, as no earlier row can come any more; rows after it stay beside it, with what was said about each, and are taken anew whenever
another one arrives between them. What changes is written again with a higher version, so the newest version of a row is what the batch job
says about it. What is kept of a key, on storage, is bounded by its rows within the delay; a key that was idle for long is forgotten. Rows pass
a task in the order of a sort, which Spark spills, so a task's memory does not grow with a key's rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (state, seconds, id, value) -> (state, what is said about the row); both as JSON can hold them. The first state is None.
Step = Callable[[Any, int, int, Any], tuple[Any, Any]]

def said_schema(rows: DataFrame) -> T.StructType:
    """(key, ts, id, said, version) with the key's type."""
    return T.StructType([rows.schema["key"], *T.StructType.fromDDL("ts long, id long, said string, version long")])


def held_schema(rows: DataFrame) -> T.StructType:
    """(key, ts, id, value, said, newest) with the key's type: an open row with what was said about it, or, with `newest`, a key's settled state as value."""
    return T.StructType([rows.schema["key"], *T.StructType.fromDDL("ts long, id long, value string, said string, newest long")])


@dataclass(frozen=True)
class InOrder:
    """A step over each key's rows of a stream in order of (ts, id), as jobs.drained() runs it. A key without a row for `idle` seconds is
    forgotten, if that is given."""

    rows: DataFrame
    step: Step
    delay: str
    idle: int | None


def in_order(rows: DataFrame, step: Step, delay: str = "7 days", idle: int | None = None) -> InOrder:
    """What the step says about a stream's rows (key, at timestamp, id long, value string: JSON), with a version. Rows later than the delay are dropped."""
    return InOrder(rows.where("at is not null").select("key", F.col("at").alias("ts"), "id", "value"), step, delay, idle)


def settling(step: Step, below: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker on rows of held_schema(), sorted by key, a key's state first, then its rows by (ts, id): the rows that are held for the next
    batch (from `below` on, and the state before it), and those about which something new is said. It holds one Arrow batch and one state."""

    def worker(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, settled, last, kind = object(), None, None, None, None
        for part in parts:
            kind, out = part.schema.field("key").type, []
            for k, ts, i, value, before, newest in zip(*(part.column(c).to_pylist() for c in ("key", "ts", "id", "value", "said", "newest"))):
                if k != key:
                    if settled is not None:
                        out.append((key, 0, 0, settled[0] or json.dumps(settled[1]), None, last, True, False))
                    key, state, settled, last = k, None, None, None
                if newest is not None:
                    state, settled, last = json.loads(value), (value, None), newest
                    continue
                state, said = step(state, ts, i, None if value is None else json.loads(value))
                said, last, held = json.dumps(said), ts if last is None else max(ts, last), ts >= below
                if not held:
                    settled = (None, state)
                if held or said != before:
                    out.append((k, ts, i, value if held else None, said, None, held, said != before))
            yield batch_of(out, kind)
        if settled is not None:
            yield batch_of([(key, 0, 0, settled[0] or json.dumps(settled[1]), None, last, True, False)], kind)

    return worker


def batch_of(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = {"key": key, "ts": pa.int64(), "id": pa.int64(), "value": pa.string(), "said": pa.string(), "newest": pa.int64(), "held": pa.bool_(), "new": pa.bool_()}
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def newest(said: DataFrame) -> DataFrame:
    """(key, ts, id, said): the last word on each row."""
    return said.groupBy("key", "ts", "id").agg(F.max_by("said", "version").alias("said"))


def last_of_key(said: DataFrame) -> DataFrame:
    """(key, said): the last word on each key's last row."""
    return said.groupBy("key").agg(F.max_by("said", F.struct("ts", "id", "version")).alias("said"))


def cooldown(seconds: int) -> Step:
    """True for an alert that is sent: its fingerprint (the value) is not that of the last one sent, or that one is old enough."""

    def step(state: Any, ts: int, _: int, fingerprint: Any) -> tuple[Any, bool]:
        if state is None or state[0] != fingerprint or ts - state[1] >= seconds:
            return [fingerprint, ts], True
        return state, False

    return step


def apart(seconds: int) -> Step:
    """True for a row unless one that is true stands less than so many seconds before it."""

    def step(state: Any, ts: int, _: int, __: Any) -> tuple[Any, bool]:
        return (ts, True) if state is None or ts - state >= seconds else (state, False)

    return step


def first_only(state: Any, ts: int, i: int, _: Any) -> tuple[Any, bool]:
    """True for a key's first row."""
    return (state, False) if state is not None else ([ts, i], True)


def feed_state(state: Any, ts: int, _: int, fetched: Any) -> tuple[Any, Any]:
    """Failures since the last success, the last error, seconds of the last success; fetched is [success, error]."""
    failures, error, ok = state or (0, None, None)
    state = [0, error, ts] if fetched[0] else [failures + 1, fetched[1], ok]
    return state, state


def replayed(rows: DataFrame, step: Step) -> DataFrame:
    """The batch twin of in_order(), all versions settled: each key's rows in order, by a sort within partitions; no key is collected."""

    def worker(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for part in parts:
            out = []
            for k, ts, i, value in zip(part["key"], part["ts"], part["id"], part["value"]):
                if k != key:
                    key, state = k, None
                state, said = step(state, int(ts), int(i), None if pd.isna(value) else json.loads(value))
                out.append((k, ts, i, json.dumps(said), 0))
            yield pd.DataFrame(out, columns=["key", "ts", "id", "said", "version"])

    timed = rows.where("at is not null").select("key", F.unix_seconds("at").alias("ts"), "id", "value")
    return timed.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(worker, said_schema(rows))
