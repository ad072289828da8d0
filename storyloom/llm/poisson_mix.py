"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is the mean number of times that its documents are to appear: its target share of all characters over the share that it
has. Each document draws its number of copies from a Poisson distribution with that mean, by inverting the distribution at a number in
[0, 1) that is a hash of seed and id: the same on every run, and independent of the partitioning. A large mean is split into equal ones,
each drawn at a hash of its own, so work is in proportion to the copies. Copies are dealt to partitions by
another hash and sorted by it there, which is a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import documents, stash

SEED = 20_240
#: Without explicit weights a source's target share is its share of characters to this power, scaled to one.
TEMPERATURE = 0.7
#: The largest mean of one draw.
MOST = 16
BROADCAST_SOURCES, SALTS = 10_000, 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """(of, rate, draws, cdf): for each source the mean number of copies, and the Poisson distribution function at 0, 1, 2, ... of one draw.

    A document's copies are the sum of `draws` such numbers.

    weights: (source, weight), any positive scale; sources that it lacks get weight 0 and so no copies. An empty text counts as one
    character. The sizes sum to what they were.
    """
    size = F.greatest(F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(1)).cast("long")
    sizes = stash(docs.groupBy(F.col(source_col).cast("string").alias("of")).agg(F.sum(size).alias("n")))
    if weights is None:
        wanted = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum("weight").cast("double").alias("w"))
        wanted = sizes.join(given, sizes["of"].eqNullSafe(given["source"]), "left").select("of", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = wanted.agg(F.sum("n").cast("double").alias("n"), F.sum("w").alias("w")).first()
    rate = F.lit(total["n"] or 0.0) * F.col("w") / F.lit(total["w"] or 1.0) / F.col("n")
    # A Poisson number of a large mean is the sum of `draws` ones of mean MOST at most, so no function is longer than they need.
    draws = F.greatest(F.lit(1), F.ceil(rate / MOST)).cast("int")
    found = wanted.select("of", rate.alias("rate"), draws.alias("draws")).withColumn("mean", F.col("rate") / F.col("draws"))
    start = "named_struct('p', exp(-mean), 'c', exp(-mean), 'out', array(exp(-mean)))"
    step = "named_struct('p', s.p * mean / k, 'c', s.c + s.p * mean / k, 'out', array_append(s.out, s.c + s.p * mean / k))"
    cdf = F.expr(f"if(mean > 0, aggregate(sequence(1, cast(ceil(mean + 10 * sqrt(mean) + 20) as int)), {start}, (s, k) -> {step}).out, array(1.0D))")
    return found.select("of", "rate", "draws", cdf.alias("cdf"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """docs with each row as often as it is drawn, in shuffled order, and the columns copy (from 1) and shuffle_key, replacing such.

    A null source is a source of its own. Rows with one id are drawn alike. An empty table gives an empty result.
    """
    kept = docs.select(*(c for c in docs.columns if c not in ("copy", "shuffle_key")))
    found = stash(rates(kept, weights, source_col, text_col, temperature))
    rows = kept.select(F.struct(*kept.columns).alias("row"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    if found.count() <= BROADCAST_SOURCES:
        drawn = rows.join(F.broadcast(found), F.col("source").eqNullSafe(F.col("of")))
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = rows.withColumn("row_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("row_salt") == F.col("salt")))
    at = lambda k: uniform(F.lit(str(seed)), F.col("id"), *(() if k is None else (k.cast("string"),)))
    one = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(2), F.col("draws")), F.lit(0), lambda n, k: n + one(at(k)))
    copies = drawn.select("row", "id", (one(at(None)) + F.when(F.col("draws") > 1, more).otherwise(0)).alias("n")).where("n > 0")
    copies = copies.select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), "id", F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    shuffled = copies.select("row", "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return shuffled.select("row.*", F.col("copy").cast("long").alias("copy"), "shuffle_key")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "source", "copy", "shuffle_key", "text")


OP2_SQL = f"""
WITH z AS (SELECT source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM z) * pow(n, {TEMPERATURE}) / (SELECT sum(pow(n, {TEMPERATURE})) FROM z) / n AS rate FROM z),
v AS (SELECT source, rate, greatest(1, ceil(rate / {MOST}))::BIGINT AS draws, rate / greatest(1, ceil(rate / {MOST})) AS mean FROM r),
k AS (SELECT source, mean, unnest(range(0, ceil(mean + 10 * sqrt(mean) + 21)::BIGINT)) AS k FROM v),
c AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
d0 AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
i AS (SELECT rid, doc_id, d0.source, text, unnest(range(1, draws + 1)) AS j FROM d0 JOIN v ON d0.source IS NOT DISTINCT FROM v.source),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || CASE WHEN j > 1 THEN ':' || j ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM i),
n AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(u.source) AS source, any_value(text) AS text, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY rid),
d AS (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM n)
SELECT doc_id, source, copy, ('0x' || substr(md5('{SEED}/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 15))::BIGINT AS shuffle_key, text FROM d
"""
