"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed in one scan and written once; texts never move. The trees are fitted by numpy on the driver
from the statistics (not texts) of at most SAMPLE labelled rows, the documented bound. Full trees of a fixed depth are kept as three
arrays, so a batch is scored by a fixed number of array look-ups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import documents, held_out, stash

#: At most so many labelled rows are fitted: those with the smallest hashes of their ids.
SAMPLE = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 3, 64, 0.15, 1.0, 5.0

_SYMBOLS, _STOPS = re.compile(r"[#*$%&|<>{}\\~^_=+]"), re.compile(r"[.!?]+(?=\s|$)")
_BANGS, _WORD = re.compile(r"[!?]{2,}"), re.compile(r"[^\W\d_]+")
FEATURES = ("chars", "words", "word_length", "symbols", "upper", "digits", "letters", "spaces", "distinct", "top_word", "repeats", "pairs", "line_words", "dup_lines", "odd_words", "upper_words", "bangs", "sentence", "pipes", "line_symbols", "non_ascii", "long_words")


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; all zero where there is none."""
    text = text or ""
    n, words = len(text), text.split()
    if not words:
        return [float(n), *[0.0] * (len(FEATURES) - 1)]
    m = len(words)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = _WORD.findall(text)
    n_letters = sum(map(len, letters))
    symbols = len(_SYMBOLS.findall(text))
    flagged = sum(1 for x in lines if _SYMBOLS.search(x))
    return [
        np.log1p(n),
        np.log1p(m),
        sum(map(len, words)) / m,
        symbols / n,
        sum(map(str.isupper, letters)) / max(1, len(letters)),
        sum(map(text.count, "0123456789")) / n,
        n_letters / n,
        1 - sum(map(len, words)) / n,
        len(seen) / m,
        max(seen.values()) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        len(set(zip(words, words[1:]))) / m,
        m / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(1 for x in words if not x[-1].isalnum() and x[-1] not in ".,;:!?)\"'") / m,
        sum(1 for x in words if len(x) > 1 and x.isupper()) / m,
        len(_BANGS.findall(text)) / m,
        len(_STOPS.findall(text)) / m,
        text.count("|") / m,
        flagged / max(1, len(lines)),
        1 - len(text.encode("utf-8", "replace").decode("ascii", "ignore")) / n,
        sum(1 for x in words if len(x) > 18) / m,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, stats array<double>) for each row; tie is a hash of the text."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(x.as_py()) for x in batch.column(1)], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), stats], names=["doc_id", "tie", "stats"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("tie", T.LongType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie")).mapInArrow(worker, schema)


@dataclass(frozen=True)
class Trees:
    """Boosted full trees: node k of a tree has children 2k+1 and 2k+2; leaf holds the values of the last level."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees for logistic loss. With no rows the score is 1 throughout (nothing speaks against a text), with one class that class's."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if len(y) == 0 or y.min() == y.max():
        rate = 1.0 if len(y) == 0 else (y.sum() + 0.5) / (len(y) + 1)
        return Trees(float(np.log(rate / (1 - rate))) if rate < 1 else 50.0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    width = x.shape[1]
    offset = np.arange(width) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, out = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * bins) + offset + binned).ravel()
            size = count * width * bins
            g = np.bincount(at, np.repeat(grad, width), size).reshape(count, width, bins)
            h = np.bincount(at, np.repeat(hess, width), size).reshape(count, width, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - gl[:, :, -1:] ** 2 / (hl[:, :, -1:] + RIDGE)
            gain[(np.minimum(hl, hr) * 4 < LEAST / 4)] = 0
            gain = gain.reshape(count, -1)
            best = gain.argmax(axis=1)
            for k in range(count):
                if gain[k, best[k]] > 1e-9:
                    f, b = divmod(int(best[k]), bins)
                    if b < len(edges[f]):
                        feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g, h = np.bincount(node - inner, grad, leaves), np.bincount(node - inner, hess, leaves)
        leaf = -RATE * g / (h + RIDGE)
        total += leaf[node - inner]
        for into, what in zip(out, (feature, threshold, leaf)):
            into.append(what)
    return Trees(base, *(np.stack(o) for o in out))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from rows of (doc_id, stats) that have a label and are not held out. An id with several labels counts as its largest."""
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # A threshold on the hash first: else every task would send its own `sample` smallest rows to the driver.
    labelled = marked.where(~held_out(F.col("doc_id")))
    unit = F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53))
    chosen = labelled.withColumn("order", F.xxhash64("doc_id", F.lit("fit"))).where(unit < F.lit(1.2 * sample / max(1, labelled.count())))
    rows = stats.join(chosen, "doc_id").select("stats", "quality", "order", "doc_id").orderBy("order", "doc_id", "stats").limit(sample).toPandas()
    x = np.array(rows["stats"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(dtype=float))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tie, score) for each row."""
    stats = stash(with_statistics(docs, id_col, text_col))
    trees = train(stats, labels)

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees.score(x))], names=["doc_id", "tie", "score"])

    return stats.mapInArrow(worker, T.StructType([stats.schema["doc_id"], stats.schema["tie"], T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; labels has (doc_id, quality 0/1).

    Null and empty texts are scored like any other, texts of any length by all of their words, repeated rows each on their own; rows with
    one score are alike. Other columns are left out, an empty table gives an empty result, and without labels every score is 1.
    """
    out = _scored(docs, labels, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects, with all columns. Rows of one id, or of none, are told apart by their texts."""
    good = _scored(docs, labels, id_col, text_col).where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias("_good_id"), F.col("tie").alias("_good_tie")).distinct()
    rows = docs.withColumn("_tie", F.xxhash64(F.col(text_col).cast("string")))
    return rows.join(good, (rows["_tie"] == good["_good_tie"]) & rows[id_col].eqNullSafe(good["_good_id"]), "left_semi").drop("_tie")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
