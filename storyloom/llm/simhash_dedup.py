"""SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits are 32 segments of two. The bit counts of the segments are a point, and the Manhattan distance of two points is at
most the Hamming distance of their fingerprints. The 32 coordinates are dealt to eight groups; if at most four units of distance fall on
eight groups, at least four groups have none. So fingerprints within four bits share the grid cell of at least one choice of four groups:
the range join is an equi-join on the 70 choices, and loses no link. In a shared cell the whole Manhattan distance comes first, as the lower
bound that it is; what is within the radius by it is verified with the exact Hamming distance.

Only distinct fingerprints are joined, so copies cost one row. In a cell, a search from one fingerprint takes out of the rest what lies
within the radius, so a cell of n near copies yields n - 1 links, never all pairs, and holds 8 bytes for each. Cells with
very many fingerprints are split over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import MOST_OF_KEY, by_key, components, documents, runs, stash

SEED, SHINGLE, RADIUS, GROUPS, EQUAL = 42, 4, 4, 8, 4
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, as a signed 64-bit number. Zero if it has no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip((ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = np.array(hashes[at : at + _BLOCK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp bigint) and the columns of keep for each row. Null and wordless texts have fingerprint zero; other columns are left out."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), *(docs.schema[c] for c in keep)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep).mapInArrow(worker, schema)


def _group_codes() -> np.ndarray:
    """For each byte, which is a group of four segments of two bits, its point as a number to base 3."""
    byte = np.arange(256)
    return sum(((byte >> 2 * s & 1) + (byte >> 2 * s + 1 & 1)) * 3**s for s in range(4)).astype(np.int64)


def cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint in its grid cell of every choice of four groups out of eight."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, choices = _group_codes(), list(combinations(range(GROUPS), EQUAL))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            group = codes[np.ascontiguousarray(fp).view(np.uint8).reshape(-1, GROUPS)]
            cell = np.stack([sum(group[:, g] * 81**i for i, g in enumerate(c)) + k * 81**EQUAL for k, c in enumerate(choices)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(np.repeat(fp, len(choices)))], names=["cell", "fp"])

    return fps.select("fp").mapInArrow(worker, "cell long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of int64 fingerprints (numpy counts those of the absolute value, hence the unsigned view)."""
    return np.bitwise_count((a ^ b).astype(np.uint64, copy=False))


_LOW = np.int64(0x5555555555555555)


def points(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments of two, each as so many ones in its segment: differing bits of two are their Manhattan distance."""
    either, both = (fp | fp >> 1) & _LOW, fp & fp >> 1 & _LOW
    return either | both << 1


def cluster(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all of fp that chains of steps of at most radius bits connect: one fewer than each chain has members."""
    rest, found_a, found_b = np.unique(fp), [], []
    at = points(rest)
    while rest.size > 1:
        ahead, rest, at = [rest[0]], rest[1:], at[1:]
        while ahead and rest.size:
            pivot = ahead.pop()
            near = distance(at, points(pivot)) <= radius
            near[near] = distance(rest[near], pivot) <= radius
            if near.any():
                new, rest, at = rest[near], rest[~near], at[~near]
                found_a.append(new)
                found_b.append(np.full(new.size, pivot))
                ahead.extend(new)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def _cell_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    starts, sizes = runs(cell)
    pair = starts[sizes == 2]
    pair = pair[distance(fp[pair], fp[pair + 1]) <= radius]
    more = [cluster(fp[s : s + n], radius) for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist())]
    return np.concatenate([fp[pair], *(x[0] for x in more)]), np.concatenate([fp[pair + 1], *(x[1] for x in more)])


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST_OF_KEY) -> DataFrame:
    """(a, b): links between distinct fingerprints at most radius (up to four) bits apart, enough of them to connect all that are.

    A cell with more than `most` fingerprints is dealt anew: to shards, and each pair of shards is a unit of its own. Every two
    fingerprints of the cell meet in a unit, and a unit holds about twice `most`.
    """
    if radius > EQUAL:
        raise ValueError(f"the grid finds up to {EQUAL} bits")

    def work(limit: int | None):  # noqa: ANN202
        def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole, (cell, fp) in by_key(batches, limit):
                a, b = _cell_links(cell, fp, radius) if whole else (cell, fp)
                if whole:
                    a, b = np.maximum(a, b), np.minimum(a, b)
                if a.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, whole)), pa.array(a), pa.array(b)], names=["linked", "a", "b"])

        return worker

    dealt = cells(fps).repartition("cell").sortWithinPartitions("cell")
    found = stash(dealt.mapInArrow(work(most), "linked boolean, a long, b long"))
    small, rest = found.where("linked").select("a", "b"), found.where("not linked").select(F.col("a").alias("cell"), F.col("b").alias("fp"))
    if rest.isEmpty():
        return small.distinct()
    sizes = rest.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(most))).cast("int").alias("parts"))
    shards = rest.join(sizes, "cell").withColumn("r", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
    units = shards.select(F.xxhash64("cell", F.least("r", "q"), F.greatest("r", "q")).alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
    return small.union(units.mapInArrow(work(None), "linked boolean, a long, b long").select("a", "b")).distinct()


def _tie(docs: DataFrame) -> Column:
    """A hash of all columns that have one (maps have none)."""
    return F.xxhash64(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString()))


def _components(docs: DataFrame, id_col: str, text_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, component, doc_id, tie) of each fingerprint: its component, by a fingerprint, and that one's first row.

    The first row has the smallest id; null ids come last, and rows of one id, or of none, go by tie, the hash of all their columns.
    """
    fps = stash(fingerprints(docs.withColumn("_tie", _tie(docs)), id_col, text_col, keep=["_tie"]))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.col("_tie").alias("tie"))).alias("first")
    reps = stash(fps.groupBy("fp").agg(first))
    groups = components(stash(links(reps.select("fp"), radius)))
    named = reps.join(groups, reps["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    best = named.groupBy("component").agg(F.min("first").alias("first"))
    return fps.drop("_tie"), named.select("fp", "component").join(best, "component").select("fp", "component", "first.doc_id", "first.tie")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): for each row its fingerprint and the smallest id that links of at most radius bits reach.

    Equal fingerprints link, and so do all wordless texts. Repeated ids keep all their rows. A null id is in a component and links
    others, but names none unless all ids of its component are null; then component_id is null. An empty table gives an empty result.
    """
    fps, named = _components(docs, id_col, text_col, radius)
    return fps.join(named.select("fp", F.col("doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, with all its columns.

    It is the one with the smallest id. Null ids come last; rows of one id, or of none, are told apart by a hash of all their columns.
    """
    _, named = _components(docs, id_col, text_col, radius)
    found = named.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_found")).distinct()
    rows = docs.withColumn("_tie", _tie(docs))
    return rows.join(found, (rows["_tie"] == found["_found"]) & rows[id_col].eqNullSafe(found["_id"]), "left_semi").dropDuplicates(["_tie", id_col]).drop("_tie")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
