"""What several operators share: shared storage, bounded Arrow slices, a bounded Bloom filter, grouped streams, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most: a task that maps texts holds a few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a new temporary one, in local mode only."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


#: Folders that stash() has written in this application and drop_stashes() has not taken away.
_STASHED: list[str] = []


def stash(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: it cuts lineage and outlives lost executors. See drop_stashes()."""
    path = f"{shared_dir(df.sparkSession)}/stash/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STASHED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stashes(spark: SparkSession, keep: Iterable[DataFrame] = ()) -> int:
    """Deletes what stash() has written so far, but for what `keep` reads; their number. Call it when results that read them are written."""
    kept = {name.rsplit("/", 1)[0].split("/stash/")[-1] for df in keep for name in df.inputFiles()}
    gone = [path for path in _STASHED if path.split("/stash/")[-1] not in kept]
    for path in gone:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _STASHED.remove(path)
    return len(gone)


def parts_of(df: DataFrame, text_col: str = "text", size: int = 64 << 20) -> int:
    """Partitions for a shuffle of df: the session's setting, or more if the bytes of its texts, which are counted, ask for it."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text has remainder 2 by 4 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def text_slices(batches: Iterable[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds about `most` bytes of column `text`, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(sizes) // most
        starts = [0, *(np.flatnonzero(cut[1:] != cut[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def bloom(keys: DataFrame, column: str, bits: int = 23) -> np.ndarray:
    """2**bits bits, two set for each key (a bigint that is a hash already), as bytes.

    Its size is fixed, so it may go to every task. With very many keys all bits are set, which costs only the pruning: whoever uses
    it joins exactly afterwards.
    """
    most = (1 << bits) - 1
    halves = (f"{column} & {most}", f"shiftrightunsigned({column}, 32) & {most}")
    each = ", ".join(f"struct(cast(shiftright({h}, 5) as int) as w, shiftleft(1L, cast(({h}) & 31 as int)) as b)" for h in halves)
    words = keys.select(F.explode(F.expr(f"array({each})")).alias("x")).groupBy("x.w").agg(F.bit_or("x.b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), dtype="<u4")
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype("<u4")
    return out


def in_bloom(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 keys may be among those of bloom()."""
    mask = np.uint64(words.size * 32 - 1)
    keys = keys.view(np.uint64)
    found = np.ones(keys.size, dtype=bool)
    for h in (keys & mask, (keys >> np.uint64(32)) & mask):
        found &= (words[(h >> np.uint64(5)).astype(np.int64)] >> (h & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return found


#: The gear's table: 256 odd multiples of the golden ratio's bits, mixed once.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32) * np.uint32(2654435761)
GEAR_BYTES = 16


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear rolling hash of the 16 bytes that end there: the sum of table[byte] << (bytes since), by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


#: Rows of one key that a task holds; keys with more are split over several tasks.
MOST_OF_KEY = 200_000


def by_key(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
    """(whole, columns) of batches that are sorted by their first column.

    Whole pieces hold each of their keys entirely. With `most`, the rows of a key that has more are passed on piece by piece with False,
    so that never more than `most` rows and a batch are held.
    """
    held: list[tuple[np.ndarray, ...]] = []  # pieces of the last key seen
    held_key, over = None, False  # over: that key has too many rows, and what came of it is passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if over:
            n = int(np.searchsorted(columns[0], held_key, side="right")) if columns[0][0] == held_key else 0
            if n:
                yield False, tuple(c[:n] for c in columns)
            columns = tuple(c[n:] for c in columns)
            if not columns[0].size:
                continue
            over = False
        key = columns[0]
        last = int(np.searchsorted(key, key[-1]))
        if held and not last and key[0] == held_key:
            held.append(columns)
        else:
            if held or last:
                yield from _apart(tuple(np.concatenate(c) for c in zip(*held, tuple(c[:last] for c in columns))), most)
            held = [tuple(c[last:] for c in columns)]
        held_key = key[-1]
        if most and sum(h[0].size for h in held) > most:
            over = True
            for h in held:
                yield False, h
            held = []
    if held:
        yield from _apart(tuple(np.concatenate(c) for c in zip(*held)), most)


def _apart(piece: tuple[np.ndarray, ...], most: int | None) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
    starts, sizes = runs(piece[0])
    if not most or sizes.max(initial=0) <= most:
        yield True, piece
        return
    large = np.repeat(sizes > most, sizes)
    yield False, tuple(c[large] for c in piece)
    if not large.all():
        yield True, tuple(c[~large] for c in piece)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1] if key.size else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.r_[starts, key.size])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each node of edges (a, b: bigint) the smallest node that it reaches.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to the larger ones, then to the smaller ones.
    Each is an aggregate with a partial step and an equi-join, so a hub's links are summed before the shuffle and its join is split by
    adaptive execution. Each round is a checkpoint in the shared folder. Work is in proportion to the edges, rounds to the logarithm of
    the longest chain.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
