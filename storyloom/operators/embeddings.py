"""Embedding clusters: exact cosine pairs within a time window, and stories from them.

Vectors are dealt to cells around pivots and bins of time, and the vectors of a large cell to cells of a second level around pivots of its own;
the pivots of both levels are a sample of bounded size, the only thing that goes to every task. What lies within the angle tau of a vector of
a cell has an angle of at most (its own nearest pivot's) + 2 tau to the cell's pivot, and of at most (the cell's radius) + tau, on either
level: so a vector looks only into cells that pass both, in its own bin and the next one, and no pair is lost. Cells are counted, and those
held in one are cut into units of bounded size, which what asks passes in a stream, as matrix products in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.operators.graphs import path_compress, stored
from storyloom.operators.setjoin import in_units
from storyloom.registry import register

#: Pivots at most, vectors held in a unit where there are few and where there are many, their numbers at most (64 MB), and partitions at least.
PIVOTS, UNIT, LARGE, HELD, TASKS = 128, 4096, 65_536, 8 << 20, 200
#: Vectors for each pivot at least, and numbers of all pivots of the second level at most (32 MB).
PER_PIVOT, NUMBERS = 512, 4 << 20
#: Vectors that look for cells at a time, and the share of all cells from which on cells are given up.
ASKING, SPREAD = 256, 0.5


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _radii(own: DataFrame, cells: int) -> np.ndarray:
    """The largest angle of a vector to its cell's pivot, by cell, -1 for empty cells: a number for each pivot."""
    out = np.full(cells, -1.0)
    for r in own.groupBy("cell").agg(F.max("angle").alias("r")).collect():
        out[r["cell"]] = r["r"]
    return out


def embedding_units(vectors: DataFrame, theta: float = 0.85, hours: int = 72, pivots: int = PIVOTS, unit: int | None = None) -> DataFrame:
    """(bin, cell, p, q, asks, id, t, v): in each unit (bin, cell, p, q) every vector that asks meets every one that does not; q is 0."""
    kind = vectors.schema["id"].dataType.simpleString()
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = vectors.where("embedding is not null and ts is not null").select("id", seconds.alias("t"), F.floor(seconds / F.lit(hours * 3600)).alias("bin"), "embedding")
    numbers = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select("id", "t", "bin", F.col("embedding").cast(numbers).alias("v"))
    # A pivot for some hundred vectors: more cells would cost more copies than they spare products.
    per_pivot = PER_PIVOT
    total = rows.count()
    most = min(pivots, 1 + total // per_pivot)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow().column("v")
    if not len(sample):
        return rows.select("bin", F.lit(0).alias("cell"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(True).alias("asks"), "id", "t", "v")
    if unit is None:
        unit = max(1, min(max(UNIT, total // 16), LARGE, HELD // max(1, len(sample[0]))))
    centres, tau = _unit(sample), float(np.arccos(min(1.0, theta - 5e-5))) + 1e-9

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_unit(batch.column(3)), centres)
                own = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angles.min(axis=1))], names=["id", "t", "bin", "v", "cell", "angle"])

    schema = f"id {kind}, t long, bin long, v {numbers}, cell int, angle double"
    own = stored(rows.mapInArrow(dealt, schema))
    radius = _radii(own, len(centres))
    # Where a vector looks into most of the cells they spare nothing, and each would cost a copy of it: one cell then, cut into units as it is.
    probe = _angles(_unit(own.orderBy(F.xxhash64("id"), "id").limit(1000).select("v").toArrow().column("v")), centres)
    if ((radius >= 0) & (probe <= probe.min(axis=1, keepdims=True) + 2 * tau) & (probe <= radius + tau)).mean() > SPREAD:
        centres, radius, own = centres[:1], np.array([np.pi]), own.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
        per_pivot = 1 << 62
    # The second level: pivots of a cell's own, in proportion to its vectors; a cell with one keeps its pivot.
    fan = max(1, min(pivots, NUMBERS // (len(centres) * centres.shape[1])))
    sizes = own.groupBy("cell").agg(F.least(F.lit(fan), 1 + F.floor(F.count("*") / per_pivot)).alias("fan")).where("fan > 1")
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
    picked = own.join(sizes, "cell").withColumn("place", place).where("place <= fan").select("cell", "v").toArrow()
    below = [centres[c : c + 1] for c in range(len(centres))]
    if picked.num_rows:
        of, vectors_of = picked.column("cell").to_numpy(), _unit(picked.column("v"))
        below = [vectors_of[of == c] if (of == c).any() else below[c] for c in range(len(centres))]
    first = np.r_[0, np.cumsum([len(x) for x in below])]  # the first leaf of each cell

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, cell = _unit(batch.column(3)), batch.column(4).to_numpy()
                leaf, angle = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    angles = _angles(x[at], below[c])
                    leaf[at], angle[at] = first[c] + angles.argmin(axis=1), angles.min(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(leaf), pa.array(angle)], names=["id", "t", "bin", "v", "cell", "angle"])

    if picked.num_rows:
        own = stored(own.mapInArrow(leaves, schema))
        leaf_radius = _radii(own, int(first[-1]))
    else:
        leaf_radius = radius

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(k, ASKING) for part in batches for k in range(0, part.num_rows, ASKING)):
            x = _unit(batch.column(3))
            angles = _angles(x, centres)
            near = (radius >= 0) & (angles <= angles.min(axis=1, keepdims=True) + 2 * tau) & (angles <= radius + tau)
            rows_found, leaves_found = [], []
            for c in np.flatnonzero(near.any(axis=0)):
                at = np.flatnonzero(near[:, c])
                inner, limit = _angles(x[at], below[c]), leaf_radius[first[c] : first[c + 1]]
                row, leaf = np.nonzero((limit >= 0) & (inner <= inner.min(axis=1, keepdims=True) + 2 * tau) & (inner <= limit + tau))
                rows_found.append(at[row])
                leaves_found.append(first[c] + leaf)
            row = np.concatenate(rows_found) if rows_found else np.zeros(0, dtype=np.int64)
            cell = np.concatenate(leaves_found) if leaves_found else np.zeros(0, dtype=np.int64)
            row, cell, step = np.repeat(row, 2), np.repeat(cell, 2), np.tile([0, 1], row.size)
            take = pa.array(row)
            days = batch.column(2).to_numpy()[row] + step
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(days), batch.column(3).take(take), pa.array(cell.astype(np.int32))], names=["id", "t", "bin", "v", "cell"])

    asks = own.select("id", "t", "bin", "v").mapInArrow(asking, f"id {kind}, t long, bin long, v {numbers}, cell int")
    # A cell of many vectors is cut; what asks passes each of its parts.
    parts = stored(own.groupBy("bin", "cell").agg(F.ceil(F.count("*") / F.lit(float(unit))).cast("int").alias("parts")))
    parts = F.broadcast(parts) if parts.count() <= 100_000 else parts
    held = own.select("id", "t", "bin", "v", "cell").join(parts, ["bin", "cell"]).withColumn("p", F.pmod(F.xxhash64("id", F.lit("held")), F.col("parts")).cast("int"))
    asks = asks.join(parts, ["bin", "cell"]).withColumn("p", F.explode(F.expr("sequence(0, parts - 1)")))
    every = held.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)))
    return every.select("bin", "cell", "p", F.lit(0).alias("q"), "asks", "id", "t", "v")


def products(units: DataFrame) -> int:
    """How many products of two vectors embedding_units() asks for."""
    return units.groupBy("bin", "cell", "p", "q").agg((F.count_if("asks") * F.count_if(~F.col("asks"))).alias("n")).agg(F.sum("n")).first()[0] or 0


def embedding_pairs(vectors: DataFrame, theta: float = 0.85, hours: int = 72, pivots: int = PIVOTS, unit: int | None = None) -> DataFrame:
    """(i, j, cosine): vectors (id, ts, embedding) i < j within some hours of each other with a cosine above theta, exact.

    Null vectors and times match nothing.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    # Hashes bring several units together in a partition, in order, so that partitions are alike; those of a unit's rows that are held come first.
    every = embedding_units(vectors, theta, hours, pivots, unit).withColumn("unit", F.xxhash64("bin", "cell", "p"))
    every = every.repartition(max(TASKS, int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bin", "cell", "p").sortWithinPartitions("bin", "cell", "p", "asks")

    def build(held: pa.Table) -> tuple:
        v = _unit(held.column("v"))
        return np.array(held.column("id").to_pylist()), held.column("t").to_numpy(), held.column("bin")[0].as_py(), v, v.astype(np.float32)

    def answer(held: tuple, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, t, v = np.array(piece.column("id").to_pylist()), piece.column("t").to_numpy(), _unit(piece.column("v"))
        hi, ht, day, hv, rough = held
        for at in range(0, len(ids), ASKING):
            # Single precision finds what can pass, double precision decides.
            a, b = np.nonzero(v[at : at + ASKING].astype(np.float32) @ rough.T > theta - 1e-3)
            a = a + at
            # Of one bin's pairs the smaller id asks; those of two bins are asked for once, by the earlier one.
            here = (np.abs(t[a] - ht[b]) <= hours * 3600) & ((ids[a] < hi[b]) | ((t[a] // (hours * 3600) != day) & (ids[a] != hi[b])))
            a, b = a[here], b[here]
            for k in range(0, len(a), 1 << 16):
                x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                cosine = np.round(np.einsum("ij,ij->i", v[x], hv[y]), 4)
                x, y, cosine = x[cosine > theta], y[cosine > theta], cosine[cosine > theta]
                if len(x):
                    ends = [np.where(ids[x] < hi[y], *pick) for pick in ((ids[x], hi[y]), (hi[y], ids[x]))]
                    yield pa.RecordBatch.from_arrays([*(pa.array(e.tolist(), piece.schema.field("id").type) for e in ends), pa.array(cosine, pa.float64())], names=["i", "j", "cosine"])

    return every.mapInArrow(lambda batches: in_units(batches, build, answer), f"i {kind}, j {kind}, cosine double")


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4)"
_EMB = f"SELECT a.id AS i, b.id AS j, {_COS} AS cosine FROM v_vectors a JOIN v_vectors b ON a.id < b.id AND abs(date_diff('second', a.ts, b.ts)) <= 259200 WHERE {_COS} > 0.35"
register("embedding_cluster_pairs", "v_vectors", lambda v: embedding_pairs(v, 0.35), _EMB)


def embedding_cluster(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, story_id, origin): the story of each ungrouped vector (id, ts, story_id or null), as they come in order of time.

    A vector goes to the story of the most alike one that has a story (origin `story`); without one, to that of the most alike ungrouped
    one that came before it, whose story it then shares (`pair`); else it makes a story of its own (`single`). Ties go to the smallest id.
    """
    at = vectors.select("id", F.struct("ts", "id").alias("at"), "story_id")
    both = pairs.select("i", "j", "cosine").union(pairs.select("j", "i", "cosine"))
    seen = both.join(at.select(F.col("id").alias("i"), F.col("at").alias("at_i"), F.col("story_id").alias("s_i")), "i").join(at.select(F.col("id").alias("j"), F.col("at").alias("at_j"), F.col("story_id").alias("s_j")), "j")
    rank = F.struct("cosine", (-F.col("j")).alias("n"))
    best = seen.where("s_i is null and (s_j is not null or at_j < at_i)").groupBy("i").agg(F.max_by("s_j", F.when(F.col("s_j").isNotNull(), rank)).alias("story"), F.max_by("j", F.when(F.col("s_j").isNull(), rank)).alias("before"))
    placed = stored(vectors.where("story_id is null").select(F.col("id").alias("i")).join(best, "i", "left"))
    chains = placed.where("story is null and before is not null").select(F.col("i").alias("source"), F.col("before").alias("target"))
    rooted = placed.join(path_compress(chains), placed["i"] == F.col("source"), "left").withColumn("root", F.coalesce("target", "i")).drop("source", "target")
    stories = placed.select(F.col("i").alias("root"), F.col("story").alias("root_story"))
    own = F.md5(F.concat(F.lit("v:"), F.col("root").cast("string")))
    origin = F.when(F.col("story").isNotNull(), "story").when(F.col("before").isNotNull(), "pair").otherwise("single")
    return rooted.join(stories, "root").select(F.col("i").alias("id"), F.coalesce("root_story", own).alias("story_id"), origin.alias("origin"))


_STORY = "CASE WHEN id % 4 = 0 THEN concat('s', CAST(label AS STRING)) END"
register(
    "embedding_cluster", "v_vectors", lambda v: embedding_cluster(v.withColumn("story_id", F.expr(_STORY)), embedding_pairs(v, 0.35)),
    f"""WITH RECURSIVE e AS ({_EMB}), v AS (SELECT id, ts, {_STORY} AS s FROM v_vectors), b AS (SELECT i, j, cosine FROM e UNION ALL SELECT j, i, cosine FROM e),
    w AS (SELECT b.i, b.j, cosine, y.s FROM b JOIN v x ON x.id = b.i JOIN v y ON y.id = b.j WHERE x.s IS NULL AND (y.s IS NOT NULL OR y.ts < x.ts OR (y.ts = x.ts AND y.id < x.id))),
    p AS (SELECT i, first(s ORDER BY cosine DESC, j) FILTER (WHERE s IS NOT NULL) AS story, first(j ORDER BY cosine DESC, j) FILTER (WHERE s IS NULL) AS before FROM w GROUP BY i),
    n AS (SELECT v.id, story, before FROM v LEFT JOIN p ON p.i = v.id WHERE v.s IS NULL), c AS (SELECT id, id AS root, story, before FROM n UNION ALL SELECT c.id, n.id, n.story, n.before FROM c JOIN n ON n.id = c.before WHERE c.story IS NULL),
    r AS (SELECT id, root, story FROM c WHERE story IS NOT NULL OR before IS NULL)
    SELECT r.id, coalesce(r.story, md5(concat('v:', r.root))) AS story_id, CASE WHEN n.story IS NOT NULL THEN 'story' WHEN n.before IS NOT NULL THEN 'pair' ELSE 'single' END AS origin FROM r JOIN n ON n.id = r.id""",
)
