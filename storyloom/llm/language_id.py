"""Language identification by nearest centroids.

Letters are lower-cased, all else becomes one space; runs of two and three characters are hashed to DIMS counters. A text's vector is
(1 + ln count) * idf, scaled to length 1. Document frequencies are counted over all training documents. Each language has CLUSTERS
centroids, found by spherical k-means over the counters of at most SAMPLE of its training texts (the documented bound of the fit), each
language in a task of its own. A text takes the language of the centroid with the highest cosine; `rejected` marks those farther from it than nearly all of
the cluster's own texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import documents, held_out

DIMS, CLUSTERS, SAMPLE, STEPS = 4096, 3, 400, 12
#: Share of a cluster's own texts that its limit of rejection leaves outside, and the factor of slack on top.
OUTSIDE, SLACK = 0.01, 0.8
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def counts(text: str | None) -> np.ndarray | None:
    """Counters of one whole text's character runs; None if it has no letter."""
    if text is None or not _LETTER.search(text):
        return None
    line = f" {_OTHER.sub(' ', text.lower()).strip()} "
    code = np.frombuffer(line.encode("utf-32-le"), dtype="<u4")
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    hashes = [two, two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)]
    return sum(np.bincount((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=DIMS) for h in hashes)


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.stack(rows).astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """idf, and for each centroid its language, vector and the cosine below which a text is too far."""

    idf: np.ndarray
    langs: list[str] = field(default_factory=list)
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), dtype=np.float32))
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) for each text. A text without a letter is und; of equally near centroids the first counts."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        found = [(i, c) for i, t in enumerate(texts) if (c := counts(t)) is not None] if self.langs else []
        for at in range(0, len(found), 256):
            part = found[at : at + 256]
            cosines = vectors([c for _, c in part], self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for (i, _), k, row in zip(part, best.tolist(), cosines):
                out[i] = (self.langs[k], float(min(1.0, max(0.0, row[k]))), bool(row[k] < self.limits[k]))
        return out


def cluster(x: np.ndarray, clusters: int = CLUSTERS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centroids, limits of rejection). Starts are spread out: each is the text farthest from those before it."""
    at = [int((x @ x.sum(axis=0)).argmax())]
    while len(at) < min(clusters, len(x)):
        at.append(int((x @ x[at].T).max(axis=1).argmin()))
    centroids = x[at]
    for _ in range(steps):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == k].sum(axis=0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    cosines = x @ centroids.T
    own = cosines.argmax(axis=1)
    limits = [np.quantile(cosines[own == k, k], OUTSIDE) * SLACK if (own == k).any() else 1.0 for k in range(len(centroids))]
    return centroids.astype(np.float32), np.array(limits)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows that have a language and are not held out."""
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit("lang")).alias("order"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                if (c := counts(x.as_py())) is not None:
                    seen += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(DIMS), -1].astype(np.int32)), pa.array(np.r_[seen, n])], names=["dim", "n"])

    df = rows.select("text").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas().set_index("dim")["n"]
    total = int(df.get(-1, 0))
    if not total:
        return Model(np.ones(DIMS, dtype=np.float32))
    idf = (np.log((1 + total) / (1 + df.reindex(range(DIMS), fill_value=0).to_numpy())) + 1).astype(np.float32)

    # Each language's texts with the smallest hashes: a threshold from its count, a little above the sample, then the sample itself.
    sizes = rows.where(F.col("text").isNotNull()).groupBy("lang").count().select(F.col("lang").alias("of"), (F.lit(1.5) * sample / F.col("count")).alias("share"))
    unit = F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53))
    chosen = rows.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, F.col("lang") == F.col("of")).where(unit < F.col("share")).select("lang", "order", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counters instead of texts: 16 kB a row, however long the text."""
        for batch in batches:
            rows = [None if (c := counts(x.as_py())) is None else c.astype("<i4").tobytes() for x in batch.column(2)]
            full = pa.array([r is not None for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["lang", "order", "counts"]).filter(full)

    def fit(key: tuple, texts: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(x, dtype="<i4") for x in texts.sort_values(["order", "counts"])["counts"]][:sample]
        centroids, limits = cluster(vectors(rows, idf))
        return pd.DataFrame({"lang": [key[0]] * len(limits), "vector": [c.tobytes() for c in centroids], "limit": limits})

    chosen = chosen.mapInArrow(counted, "lang string, order long, counts binary")
    found = chosen.groupBy("lang").applyInPandas(fit, "lang string, vector binary, limit double").toPandas().sort_values(["lang", "vector"])
    if not len(found):
        return Model(idf)
    return Model(idf, found["lang"].tolist(), np.frombuffer(b"".join(found["vector"]), dtype=np.float32).reshape(-1, DIMS), found["limit"].to_numpy())


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row; und with score 0 for null texts and texts without a letter.

    Empty training data make every text und. Repeated rows are predicted alike, other columns are left out.
    """

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column(1).to_pylist())
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "rejected"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(worker, schema)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identified(docs, train(docs))
