"""Document fingerprints: a SimHash of 128 bits, and tables of permuted blocks that find all fingerprints within a Hamming radius.

Terms are runs of three words, weighted by 1 + ln(count); each term's 128-bit hash votes with its weight for or against each bit.

For a radius r the bits are dealt to r + 2 blocks. Two fingerprints within r bits agree on at least two blocks, so they share a row of
one of the tables that are keyed by two blocks each. In a bucket every query meets every fingerprint once, counted in the first table
that joins the two, so no pair is listed and none is counted twice.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import MOST_OF_KEY, by_key, documents, parts_of, runs, stash

BITS, TERM_WORDS, RADIUS = 128, 3, 4
_BLOCK = 1 << 15
#: Ids of a range that are looked at to place its bounds, where ids are no whole numbers.
SAMPLED = 20


def fingerprint(text: str | None) -> bytes:
    """16 bytes; all zero for a text without words. Fewer than three words are one term."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return bytes(BITS // 8)
    whole = b" ".join(words)
    if len(words) <= TERM_WORDS:
        terms = {whole: 1}
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        terms = Counter([whole[a:b] for a, b in zip((ends - sizes)[: 1 - TERM_WORDS].tolist(), ends[TERM_WORDS - 1 :].tolist())])
    weights = 1 + np.log(np.fromiter(terms.values(), dtype=float, count=len(terms))).astype(np.float32)
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), dtype=np.uint8).reshape(-1, BITS // 8)
    votes = np.zeros(BITS)
    for at in range(0, len(weights), _BLOCK):
        w = weights[at : at + _BLOCK]
        votes += 2.0 * (w @ np.unpackbits(digests[at : at + _BLOCK], axis=1).astype(np.float32)) - w.sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 less the share of differing bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp binary) for each row; null texts count as empty."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py()) for x in batch.column(1)], type=pa.binary())], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.BinaryType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(worker, schema)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): each row beside the next one by descending id (ties by text, nulls last), the last beside the first.

    Ids are dealt to ranges, whole numbers by approximate quantiles, other ids by a sample of fixed size for each range, as strings in the
    order of their UTF-8 bytes; the largest id of each range is then taken exactly, one small row a range, and that document goes to the
    range before as well. Texts are shuffled once and read in order; a task holds two of them at a time.
    """
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    kind = "long" if whole else "string"
    parts = parts or parts_of(docs, text_col)
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    ranges = 4 * parts if 1 < parts <= 10_000 else parts  # several to a task, so that tasks get alike shares
    if ranges == 1:
        cuts = []
    elif whole:
        cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] or []
    else:
        some = ids.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED * ranges).toArrow().column(0).to_pylist()
        cuts = sorted(some, key=str.encode)[SAMPLED - 1 :: SAMPLED]
    key = int if whole else str.encode
    cuts = sorted({key(c) for c in cuts})
    known_cuts = np.array(cuts, dtype=np.int64 if whole else object)

    @F.pandas_udf("int")
    def part_of(doc_id):  # noqa: ANN001, ANN202
        import pandas as pd

        known = doc_id.notna().to_numpy()
        out = np.full(len(doc_id), len(known_cuts) + 1, dtype=np.int32)  # null ids come last
        values = np.array([key(x) for x in doc_id[known]], dtype=known_cuts.dtype)
        out[known] = len(known_cuts) - np.searchsorted(known_cuts, values, side="left")
        return pd.Series(out)

    heads = sorted((r["part"], r["head"]) for r in ids.select(part_of("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return rows.withColumn("next_text", F.col("text"))
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}  # the first range's head follows the last range

    @F.pandas_udf("array<int>")
    def places(part, doc_id):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([[p] if (x := None if pd.isna(d) else int(d) if whole else d) not in before else [p, ~before[x]] for p, d in zip(part, doc_id)])

    dealt = rows.withColumn("part", part_of("doc_id")).withColumn("place", F.explode(places("part", "doc_id")))
    dealt = dealt.select(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("part"), (F.col("place") < 0).alias("ahead"), "doc_id", "text")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "text")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] == part and not held[1]:
                    for into, what in zip(out, (held[2], held[3], text)):
                        into.append(what)
                held = (part, ahead or (held is not None and held[0] == part and held[1]), doc_id, text)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64() if whole else pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "text", "next_text"])

    return dealt.mapInArrow(pair, f"doc_id {kind}, text string, next_text string")


def neighbours(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, most: int = MOST_OF_KEY) -> DataFrame:
    """(fp, n_near): for each fingerprint of queries how many rows of fps have one within radius bits, equal ones included.

    fps and queries have a column fp. Equal fingerprints are counted first, so copies cost one row; buckets are read as sorted streams.
    """
    blocks = np.array_split(np.arange(BITS), radius + 2)
    tables = list(combinations(range(radius + 2), 2))
    counted = fps.groupBy("fp").agg(F.count("*").alias("n")).join(queries.select("fp", F.lit(True).alias("asks")).distinct(), "fp", "left")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
            bits = np.unpackbits(fp, axis=1)
            key = np.stack([np.fromiter((xxhash.xxh3_64_intdigest(r.tobytes(), k) for r in np.packbits(bits[:, np.r_[blocks[a], blocks[b]]], axis=1)), np.uint64, len(bits)).view(np.int64) for k, (a, b) in enumerate(tables)], axis=1)
            take = pa.array(np.repeat(np.arange(len(bits)), len(tables)))
            halves = fp.copy().view(">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.tile(np.arange(len(tables), dtype=np.int32), len(bits))), pa.array(halves[:, 0]).take(take), pa.array(halves[:, 1]).take(take), batch.column(1).take(take), batch.column(2).fill_null(False).take(take)], names=["key", "tab", "hi", "lo", "n", "asks"])

    def counted_pairs(key, tab, hi, lo, n, asks):  # noqa: ANN001, ANN202
        out: tuple[list, list, list] = ([], [], [])
        starts, sizes = runs(key)
        asked = np.add.reduceat(asks.astype(np.int64), starts) > 0
        for s, size in zip(starts[asked].tolist(), sizes[asked].tolist()):
            h, low, m = hi[s : s + size].view(np.uint64), lo[s : s + size].view(np.uint64), n[s : s + size]
            for q in np.flatnonzero(asks[s : s + size]).tolist():
                near = np.flatnonzero(np.bitwise_count(h ^ h[q]) + np.bitwise_count(low ^ low[q]) <= radius)
                diff = np.unpackbits(np.stack([h[near] ^ h[q], low[near] ^ low[q]], axis=1).astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1)
                differs = np.stack([diff[:, b].any(axis=1) for b in blocks], axis=1)
                first = np.argsort(differs, axis=1, kind="stable")[:, :2]  # the first two equal blocks name the table that counts
                mine = (first == tables[tab[s]]).all(axis=1)
                out[0].append(int(hi[s + q]))
                out[1].append(int(lo[s + q]))
                out[2].append(int(m[near][mine].sum()))
        return out

    def work(limit: int | None):  # noqa: ANN202
        def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole, (key, tab, hi, lo, n, asks) in by_key(batches, limit):
                if whole:
                    hi, lo, n = (np.array(x, dtype=np.int64) for x in counted_pairs(key, tab, hi, lo, n, asks))
                    key, tab, asks = np.zeros(hi.size, np.int64), np.zeros(hi.size, np.int32), np.zeros(hi.size, bool)
                if hi.size:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, tab, hi, lo, n, asks, np.full(hi.size, whole))], names=["key", "tab", "hi", "lo", "n", "asks", "done"])

        return worker

    schema = "key long, tab int, hi long, lo long, n long, asks boolean, done boolean"
    dealt = counted.select("fp", "n", "asks").mapInArrow(keys, "key long, tab int, hi long, lo long, n long, asks boolean").repartition("key").sortWithinPartitions("key")
    parts = stash(dealt.mapInArrow(work(most), schema))
    found, rest = parts.where("done").select("hi", "lo", "n"), parts.where("not done")
    if not rest.isEmpty():
        # A bucket with very many fingerprints is dealt to shards; who asks goes to all of them, and counts itself in its own only.
        sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / F.lit(float(most))).cast("int").alias("parts"))
        shards = rest.join(sizes, "key").withColumn("r", F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int"))
        shards = shards.withColumn("q", F.explode(F.expr("if(asks, sequence(0, parts - 1), array(r))")))
        units = shards.select(F.xxhash64("key", "q").alias("key"), "tab", "hi", "lo", F.when(F.col("q") == F.col("r"), F.col("n")).otherwise(0).alias("n"), "asks").repartition("key").sortWithinPartitions("key")
        found = found.union(units.mapInArrow(work(None), schema).select("hi", "lo", "n"))
    found = found.groupBy("hi", "lo").agg(F.sum("n").alias("n_near"))
    hexed = F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("hi", "lo")))
    return found.select(F.unhex(hexed).alias("fp"), "n_near")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, and n_near for the query rows (ids divisible by 20): rows of all documents within RADIUS bits, itself included.

    Null texts count as empty, texts of one id, or of none, follow each other by text (null ids last), repeated rows each have the next one
    after them, a text of any length is read whole. Other columns are left out; an empty table gives an empty result.
    """
    pairs = with_next(documents(spark, sf_dir))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, b"")
        for batch in batches:
            rows = []
            for text, after in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                cut = len(text) // 3
                edited = text[: len(text) - cut] + after[:cut]
                own = last[1] if last[0] == text else fingerprint(text)
                following, changed = fingerprint(after), fingerprint(edited)
                last = (after, following)
                rows.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, following)))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_chars", "edited_sha256", "fp", "edited", "near_edited", "near_next"])

    made = stash(pairs.mapInArrow(edit, "doc_id long, n_chars long, edited_sha256 string, fp binary, edited binary, near_edited double, near_next double"))
    near = neighbours(made.select("fp"), made.where("doc_id % 20 = 0").select("fp"))
    return made.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.when(F.col("doc_id") % 20 == 0, F.col("n_near")).alias("n_near"),
    )
