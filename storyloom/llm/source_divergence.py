"""How far the sources of a language stand apart in their words, in exact integers.

The steps are those of a count vectoriser fitted for each language, with a least document frequency and no bound on the vocabulary: document
frequencies, a vocabulary of what reaches `min_df`, a sparse vector of counts for each document, and sums of these vectors for each source.
Taking terms out commutes with summing, so a task sums the vectors of its own documents before anything is shuffled, and one shuffle by
language and term meets all sums of a term, its document frequency too. The vocabulary stays a table: it is neither collected nor sent to
all tasks, as it has no bound.

Pairs of sources meet in tiles of sources and buckets of terms. Within a tile only counts above zero are touched: a source's share of a term
that it never uses is the same for all such terms, so these are counted and not listed. Every tile gives a row for each of its pairs, which
an aggregate adds up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm.common import documents, small_batches, stash, text_slices

MIN_DF, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Sources of a tile, and kept terms of a bucket on average.
TILE, BUCKET_TERMS = 64, 4096
#: Terms that a task sums before it passes them on.
HELD_TERMS = 800_000
#: Bytes outside of terms become spaces, A to Z small letters; bytes of longer characters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and characters beyond ASCII."""
    return text.encode().translate(_BYTES).split()


def document_vectors(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, size, indices, values): the sparse counts of each document over its language's vocabulary (lang, term, index).

    Documents without a kept term are left out. Rows of one id are one document here: give rows ids of their own to keep them apart.
    """

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            counted = [Counter(terms_of(x or "")) for x in part.column(1).to_pylist()]
            row = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
            terms = pa.array([t for c in counted for t in c], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), terms, pa.array([n for c in counted for n in c.values()], pa.int64())], names=["doc_id", "lang", "term", "n"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    entries = rows.mapInArrow(worker, f"doc_id {kind}, lang string, term string, n long").join(vocabulary, ["lang", "term"])
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("size"))
    vectors = entries.groupBy("doc_id", "lang").agg(F.sort_array(F.collect_list(F.struct("index", "n"))).alias("v"))
    return vectors.join(sizes, "lang").select("doc_id", "lang", "size", F.col("v.index").alias("indices"), F.col("v.n").alias("values"))


def vocabulary_of(kept: DataFrame) -> DataFrame:
    """(lang, term, df, index) of group_counts(): indices of a language from 0 by term, as large as needed."""
    terms = kept.groupBy("lang", "term").agg(F.max("df").alias("df"))
    # Numbers over buckets of terms in order: no language is sorted in one task.
    parts = terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("part", F.spark_partition_id())
    parts = stash(parts)
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy("term"))
    before = parts.groupBy("lang", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return parts.withColumn("place", place).join(before.drop("count"), ["lang", "part"]).select("lang", "term", "df", (F.coalesce("before", F.lit(0)) + F.col("place") - 1).alias("index"))


def group_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_df: int = MIN_DF) -> DataFrame:
    """(lang, term, df, n_lang, source, n, first): the vocabulary's terms with their counts in each source that has them.

    `first` marks one row of each term. Null texts, languages and sources count as empty ones; each row is a document, repeated ones too.
    """
    small_batches(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of the task's documents, summed for each language and source; a row for each language and term."""
        counts: dict[str, dict[str, Counter]] = {}
        having: dict[str, Counter] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, terms in having.items():
                of = counts[lang]
                place = {t: k for k, t in enumerate(terms)}
                entries = sum(map(len, of.values()))
                term = np.fromiter((place[t] for c in of.values() for t in c), dtype=np.int64, count=entries)
                n = np.fromiter((k for c in of.values() for k in c.values()), dtype=np.int64, count=entries)
                order = np.argsort(term, kind="stable")
                source = pa.array(list(of), pa.string()).take(pa.array(np.repeat(np.arange(len(of)), [len(c) for c in of.values()])[order]))
                n, ends = n[order], np.r_[0, np.cumsum(np.bincount(term, minlength=len(terms)))]
                names, df = pa.array(list(terms), pa.binary()).cast(pa.string()), np.fromiter(terms.values(), dtype=np.int64, count=len(terms))
                for a in range(0, len(terms), 50_000):
                    b = min(a + 50_000, len(terms))
                    lo, hi = int(ends[a]), int(ends[b])
                    offsets = pa.array(ends[a : b + 1] - lo, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * (b - a), pa.string()), names.slice(a, b - a), pa.array(df[a:b]), pa.ListArray.from_arrays(offsets, source.slice(lo, hi - lo)), pa.ListArray.from_arrays(offsets, pa.array(n[lo:hi]))],
                        names=["lang", "term", "df", "sources", "counts"],
                    )
            counts.clear()
            having.clear()

        for part in text_slices(batches, 0):
            for text, lang, source in zip(*(c.to_pylist() for c in part.columns)):
                terms = terms_of(text)
                counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
                having.setdefault(lang, Counter()).update(set(terms))
            if sum(len(c) for of in counts.values() for c in of.values()) > HELD_TERMS:
                yield from passed_on()
        yield from passed_on()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one term stand together: added up, and written where its document frequency suffices. The last term waits for the next batch."""
        held: pa.RecordBatch | None = None
        for part in batches:
            if part.num_rows:
                part = part if held is None else pa.concat_batches([held, part])
                starts = _starts(part)
                last = int(starts[-1])
                held = part.slice(last)
                if last:
                    yield from _kept(part.slice(0, last), starts[:-1], min_df)
        if held is not None:
            yield from _kept(held, np.zeros(1, dtype=np.int64), min_df)

    partial = rows.mapInArrow(sums, "lang string, term string, df long, sources array<string>, counts array<long>")
    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merged, _KEPT)


_KEPT = "lang string, term string, df long, n_lang long, source string, n long, first boolean"


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where runs of one language and term begin."""
    n = rows.num_rows
    differs = np.zeros(max(0, n - 1), dtype=bool)
    for name in ("lang", "term"):
        column = rows.column(name)
        differs |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(differs) + 1]


def _kept(rows: pa.RecordBatch, starts: np.ndarray, min_df: int) -> Iterator[pa.RecordBatch]:
    """Runs of terms with enough documents, as a row for each source."""
    df = np.add.reduceat(rows.column("df").to_numpy(), starts)
    run = np.repeat(np.arange(starts.size), np.diff(np.r_[starts, rows.num_rows]))
    some = np.flatnonzero(df[run] >= min_df)
    if not some.size:
        return
    taken = rows.take(pa.array(some))
    sources, n = taken.column("sources").flatten().dictionary_encode(), taken.column("counts").flatten().to_numpy()
    run = np.repeat(run[some], pc.list_value_length(taken.column("sources")).to_numpy())
    key, place = np.unique(run * len(sources.dictionary) + sources.indices.to_numpy().astype(np.int64), return_inverse=True)
    total, whole = np.zeros(key.size, dtype=np.int64), np.zeros(starts.size, dtype=np.int64)
    np.add.at(total, place, n)
    np.add.at(whole, run, n)
    of, source = np.divmod(key, len(sources.dictionary))
    at = pa.array(starts[of])
    yield pa.RecordBatch.from_arrays(
        [rows.column("lang").take(at), rows.column("term").take(at), pa.array(df[of]), pa.array(whole[of]), sources.dictionary.take(pa.array(source)), pa.array(total), pa.array(np.r_[True, of[1:] != of[:-1]])],
        names=[x.split()[0] for x in _KEPT.split(", ")],
    )


def _share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * size)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * size)) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile_pairs(table: pa.Table) -> pa.Table:
    """One bucket of terms in one pair of tiles: for each pair of sources the sum of values over terms that either has, and their number.

    Rows without a term give each source's share of terms it does not have. Work is in proportion to the counts above zero, by the tile.
    """
    lang, a, b = table.column("lang")[0], table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
    g, p, term = (table.column(c).to_numpy() for c in ("g", "p", "h"))
    marks = table.column("mark").to_numpy()
    ids = np.unique(g[marks])
    none = np.zeros(ids.size, dtype=np.int64)
    none[np.searchsorted(ids, g[marks])] = p[marks]
    row, (terms, column) = np.searchsorted(ids, g[~marks]), np.unique(term[~marks], return_inverse=True)
    shares = np.repeat(none[:, None], terms.size, axis=1)
    has = np.zeros(shares.shape, dtype=bool)
    shares[row, column], has[row, column] = p[~marks], True
    n = has.sum(axis=1)
    alone = np.zeros((ids.size, ids.size), dtype=np.int64)  # [x, y]: over x's terms, as if y had none of them
    both_as_alone, both, over = (np.zeros((ids.size, ids.size), dtype=np.int64) for _ in range(3))  # [x, y] over x's terms
    for x in range(ids.size):
        of = np.flatnonzero(has[x])
        mine, theirs, too = shares[x, of], shares[:, of], has[:, of]
        alone[x] = ((mine - none[:, None]) ** 2 // (mine + none[:, None])).sum(axis=1)
        over[x] = ((mine - theirs) ** 2 // (mine + theirs)).sum(axis=1)
        both_as_alone[:, x] = np.where(too, (theirs - none[x]) ** 2 // (theirs + none[x]), 0).sum(axis=1)  # [y, x]: y's value if x had none, over terms of both
        both[x] = too.sum(axis=1)
    x, y = np.nonzero((ids[:, None] < ids[None, :]) & ((a == b) | (ids[:, None] // TILE != ids[None, :] // TILE)))
    value = over[x, y] + alone[y, x] - both_as_alone[y, x]
    return pa.table({"lang": pa.array([lang.as_py()] * x.size, pa.string()), "x": ids[x], "y": ids[y], "value": value, "terms": n[x] + n[y] - both[x, y]})


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_df: int = MIN_DF, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language all others by how far they stand apart, and its own terms.

    Shares are smoothed by two occurrences of every kept term and scaled to integers; a value is floor((p - q)^2 / (p + q)), summed over
    all kept terms for pairs. Part `pair` has every other source of the language (value 0 where the language keeps no term), part `term`
    the `top_terms` terms that a source has and whose share is above the language's. Equal values are ranked by item. A source that is alone
    in its language has no pairs; an empty table gives an empty result; null texts, languages and sources are empty ones; other columns are
    not looked at. The number of pairs is what is asked for: quadratic in the sources of one language, not in documents.
    """
    kept = stash(group_counts(docs, text_col, lang_col, source_col, min_df))
    sources = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source")))).distinct()
    langs = kept.groupBy("lang").agg(F.sum("n").alias("all_lang"), F.count_if("first").alias("size"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("all_source"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = sources.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["all_source", "all_lang", "size"])
    groups = groups.withColumn("g", F.row_number().over(by_name) - 1).withColumn("none", F.when(F.col("size") > 0, _share(F.lit(0), F.col("all_source"), F.col("size"))).otherwise(1))
    tiles = F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE).cast("int")
    buckets = F.greatest(F.ceil(F.col("size") / BUCKET_TERMS), F.lit(1)).cast("int")
    groups = stash(groups.withColumns({"tiles": tiles, "buckets": buckets}))

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("all_source"), F.col("size")))
    own = shares.withColumn("q", _share(F.col("n_lang"), F.col("all_lang"), F.col("size"))).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    tile = F.floor(F.col("g") / TILE).cast("int")
    entries = shares.select("lang", "g", "p", F.lit(False).alias("mark"), F.xxhash64("term").alias("h"), F.pmod(F.hash("term"), "buckets").alias("bucket"), other)
    marks = groups.select("lang", "g", F.col("none").alias("p"), F.lit(True).alias("mark"), F.lit(0).cast("long").alias("h"), "tiles", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    marks = marks.select("lang", "g", "p", "mark", "h", "bucket", other)
    placed = entries.unionByName(marks).select("lang", F.least(tile, "other").alias("ta"), F.greatest(tile, "other").alias("tb"), "bucket", F.col("g").cast("long").alias("g"), "p", "mark", "h")
    pairs = placed.groupBy("lang", "ta", "tb", "bucket").applyInArrow(_tile_pairs, "lang string, x long, y long, value long, terms long")
    pairs = pairs.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    side = lambda k, at: groups.select("lang", F.col("g").cast("long").alias(at), F.col("source").alias(f"source_{k}"), F.col("none").alias(f"none_{k}"), *(["size"] if k == 1 else []))
    pairs = pairs.join(side(1, "x"), ["lang", "x"]).join(side(2, "y"), ["lang", "y"])
    pairs = pairs.withColumn("value", F.col("value") + (F.col("size") - F.col("terms")) * _apart(F.col("none_1"), F.col("none_2")))
    both = F.explode(F.array(F.struct(F.col("source_1").alias("source"), F.col("source_2").alias("item")), F.struct(F.col("source_2").alias("source"), F.col("source_1").alias("item")))).alias("r")
    pairs = pairs.select("lang", both, "value").select("lang", "r.source", F.lit("pair").alias("part"), "r.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(own)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT rid, lang, source, unnest(words) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
s AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN v ON v.lang = t.lang AND v.term = t.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, sum(n) AS n, count(*) AS v FROM v GROUP BY lang),
e AS (SELECT g.lang, g.source, v.term, coalesce(s.n, 0) AS n, v.n AS n_lang FROM g JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = v.term),
k AS (SELECT lang, source, sum(n) AS n FROM e GROUP BY lang, source),
p AS (SELECT e.lang, e.source, e.term, e.n, 1 + (1000000000::HUGEINT * (e.n + 2)) // (k.n + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (e.n_lang + 2)) // (l.n + 2 * l.v) AS q
  FROM e JOIN k ON k.lang = e.lang AND k.source = e.source JOIN l ON l.lang = e.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
