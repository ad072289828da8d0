"""Substring dedup by content-defined chunks.

The gear rolling hash of the 16 bytes before each word ranks the words; a text is cut before a word whose rank is no more than that of its
neighbours three words to either side. Cuts depend on a few words around them only, so after an insertion, or in another text, the same
passage has the same cuts from the second chunk on, also where it repeats a few words over and over. All white space counts as one kind, so
a passage may be wrapped anew. Chunks (seven words on average) are known by 128-bit digests, and so are windows: the shortest stretches of
adjoining chunks with at least MIN_WORDS words. A window that stands as a whole in an earlier text (by document id) is a repeat, and its
chunks are taken out of every text but the first; chunks that are common each by itself, in different texts, stay, and so does what repeats
inside one text only. The words before the first and after the last cut of a passage stay, as they share a chunk with the text around.

Work: each text names a window once, so copies inside a text cost one row; one aggregate of all windows' digests with a partial step, one
join of the repeated ones' texts (found through a Bloom filter of fixed size) and one join of the finds back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import bloom, documents, gear, in_bloom, stash, text_slices

#: Words on either side among which no rank is less than a cut's, and the words after which a text without cuts is cut all the same.
REACH, MOST = 3, 64
#: Repeats with fewer words stay. A passage of 50 words holds at least so many between its cuts.
MIN_WORDS = 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ONE_SPACE = bytes(32 if _SPACE[b] else b for b in range(256))


def chunks(batch: pa.RecordBatch, text: int = 1) -> tuple[np.ndarray, ...]:
    """Of a slice, for each chunk: start and end in the bytes, row, words, number in its text, digest (two int64); and the bytes.

    The white space before a word belongs to the chunk before it, that at a text's start to its first chunk. A text without words is one
    chunk of no words; a null or empty text has none.
    """
    raw = [(x.as_py() or "").encode() for x in batch.column(text)]
    whole = b"".join(raw)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    level = whole.translate(_ONE_SPACE)
    data = np.frombuffer(level, dtype=np.uint8)
    if not data.size:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, np.zeros((0, 2), dtype=np.int64), whole
    space = _SPACE[data]
    full = starts[sizes > 0]
    after = np.r_[True, space[:-1]]
    after[full] = True
    words = np.flatnonzero(~space & after)
    row = np.searchsorted(ends, words, side="right")
    rank = gear(data)[words - 1].astype(np.int64)
    rank[words - starts[row] < 16] = 1 << 40  # the hash would hold bytes of another text
    least = np.ones(words.size, dtype=bool)
    for step in range(1, REACH + 1):  # the sides count up to the text's ends
        same = row[step:] == row[:-step]
        least[step:] &= (rank[step:] <= rank[:-step]) & same
        least[:-step] &= (rank[:-step] <= rank[step:]) | ~same
    first = np.r_[True, row[1:] != row[:-1]] if words.size else np.zeros(0, dtype=bool)
    cut = (least & (rank < 1 << 40)) | first
    at = np.arange(words.size)
    since = at - np.maximum.accumulate(np.where(cut, at, 0))
    cut |= since % MOST == 0
    begin = words[cut]
    begin_row = row[cut]
    lead = first[cut]
    begin = np.where(lead, starts[begin_row], begin)
    n_words = np.diff(np.r_[at[cut], words.size])
    blank = np.setdiff1d(np.flatnonzero(sizes > 0), row)  # texts of white space only
    if blank.size:
        begin, begin_row, n_words = np.r_[begin, starts[blank]], np.r_[begin_row, blank], np.r_[n_words, np.zeros(blank.size, dtype=np.int64)]
        order = np.argsort(begin, kind="stable")
        begin, begin_row, n_words = begin[order], begin_row[order], n_words[order]
    end = np.r_[begin[1:], data.size]
    index = np.arange(begin.size)
    number = index - np.maximum.accumulate(np.where(np.r_[True, begin_row[1:] != begin_row[:-1]], index, 0))
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(level[a:b].strip()) for a, b in zip(begin.tolist(), end.tolist())]), dtype="<i8").reshape(-1, 2)
    return begin, end, begin_row, n_words, number, digest, whole


def windows(row: np.ndarray, n_words: np.ndarray, digest: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (past the last) and digests of the shortest stretches of chunks of one text that have at least min_words words.

    All that begin and all that end at a chunk: whatever stretch of at least so many words repeats is covered by those within it.
    """
    total = np.r_[0, np.cumsum(n_words)]
    at = np.arange(row.size)
    end = np.searchsorted(total, total[:-1] + min_words)
    ahead = np.flatnonzero(end <= row.size)
    ahead = ahead[row[end[ahead] - 1] == row[ahead]]
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    behind = np.flatnonzero(start >= 0)
    behind = behind[row[start[behind]] == row[behind]]
    both = np.unique(np.r_[at[ahead] * (row.size + 1) + end[ahead], start[behind] * (row.size + 1) + at[behind] + 1])
    start, end = both // (row.size + 1), both % (row.size + 1)
    raw = digest.tobytes()
    found = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[16 * a : 16 * b]) for a, b in zip(start.tolist(), end.tolist())]), dtype="<i8").reshape(-1, 2)
    return start, end, found


def _emit(known: np.ndarray | None, min_words: int):  # noqa: ANN202
    """Rows (h1, h2, doc_id, tie) of a batch's windows, each once for a text; only those that `known` may hold, if given."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            row, found = text_windows(part, min_words)
            if known is not None:
                take = in_bloom(known, np.ascontiguousarray(found[:, 0]))
                row, found = row[take], found[take]
            once = np.unique(found[:, 0] ^ (row * np.int64(0x1E3779B97F4A7C15)), return_index=True)[1]
            row, found = row[once], found[once]
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), *(part.column(c).take(pa.array(row)) for c in (0, 2))], names=["h1", "h2", "doc_id", "tie"])

    return worker


def text_windows(part: pa.RecordBatch, min_words: int = MIN_WORDS, text: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of the windows of all texts of a slice."""
    _, _, row, n_words, _, digest, _ = chunks(part, text)
    full = n_words > 0
    row = row[full]
    start, _, found = windows(row, n_words[full], digest[full], min_words)
    return row[start], found


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tie, repeats array<struct<h1, h2, first_id>>): the windows to take out of each text, and the text where each stands first.

    tie is a hash of the text, which tells texts of one id, or of none, apart. Null ids come last.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc_id", kind), T.StructField("tie", T.LongType())])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    every = rows.mapInArrow(_emit(None, min_words), schema)
    where = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tie")
    shared = every.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").drop("last")
    shared = stash(shared)
    known = bloom(shared, "h1", 25)
    again = rows.mapInArrow(_emit(known, min_words), schema).join(shared, ["h1", "h2"]).where("not (doc_id <=> first.doc_id and tie = first.tie)")
    return again.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("h1", "h2", F.col("first.doc_id").alias("first_id"))).alias("repeats"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeats taken out of the text, and n_removed_words, n_removed_chars, first_ids (texts that keep what was taken out).

    Null texts stay null; a text may become empty. Ids may be of any type and null; rows with one id, or none, are told apart by their
    texts, and rows equal in both count as one: they stay alike. Columns named like the new ones are replaced, all others stay. An empty
    table gives an empty result.
    """
    new = ("n_removed_words", "n_removed_chars", "first_ids")
    kept = docs.select(*(c for c in docs.columns if c not in new))
    repeats = repeated_windows(docs, id_col, text_col, min_words).select(F.col("doc_id").alias("_run_id"), F.col("tie").alias("_run_tie"), F.col("repeats").alias("_run"))

    @F.pandas_udf("text string, words long, chars long")
    def take_out(texts, gone):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for text, pairs in zip(texts, gone):
            if text is None or pairs is None:
                out.append((text, 0, 0))
                continue
            begin, end, row, n_words, _, digest, whole = chunks(pa.RecordBatch.from_arrays([pa.array([text], type=pa.string())], names=["text"]), 0)
            start, stop, found = windows(row, n_words, digest, min_words)
            named = {(x["h1"], x["h2"]) for x in pairs}
            hit = [k for k, pair in enumerate(map(tuple, found.tolist())) if pair in named]
            edge = np.zeros(begin.size + 1, dtype=np.int64)
            np.add.at(edge, start[hit], 1)
            np.add.at(edge, stop[hit], -1)
            drop = np.cumsum(edge[:-1]) > 0
            left = b"".join([whole[a:b] for a, b in zip(begin[~drop].tolist(), end[~drop].tolist())]).decode()
            out.append((left, int(n_words[drop].sum()), len(text) - len(left)))
        return pd.DataFrame(out, columns=["text", "words", "chars"])

    joined = kept.join(repeats, kept[id_col].eqNullSafe(repeats["_run_id"]) & (F.xxhash64(kept[text_col].cast("string")) == repeats["_run_tie"]), "left").drop("_run_id", "_run_tie")
    touched = joined.withColumn("_out", F.when(F.col("_run").isNotNull(), take_out(F.col(text_col).cast("string"), F.transform("_run", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))))
    first_ids = F.array_sort(F.array_distinct(F.array_compact(F.transform("_run", lambda x: x["first_id"]))))
    return touched.select(
        *(F.when(F.col("_run").isNotNull(), F.col("_out.text")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in kept.columns),
        F.coalesce("_out.words", F.lit(0)).cast("long").alias("n_removed_words"),
        F.coalesce("_out.chars", F.lit(0)).cast("long").alias("n_removed_chars"),
        F.coalesce(first_ids, F.array().cast(T.ArrayType(docs.schema[id_col].dataType))).alias("first_ids"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).select("doc_id", "text", "n_removed_words", "n_removed_chars", "first_ids")
