"""BPE encoding that reuses content-defined chunks.

A gear rolling hash over bytes cuts texts where 16 bytes of content say so, so equal passages have equal chunks wherever they stand. Digests
of all chunks are counted; chunks that occur twice or more are encoded once, in a table of their own, and joined back to the texts that
hold them. A text without such a chunk is encoded where it is read. Where two pieces of a text meet, the tokens on both sides of the
join are replaced by those of a re-encoded window, which reaches from one place where a token surely ends to the next; the window grows
until its edges agree with the pieces' own tokens.

The texts that hold shared chunks are found through a Bloom filter of fixed size; a false hit only takes the longer way. Encoded chunks
travel as two bytes a token.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import GEAR_BYTES, bloom, documents, gear, in_bloom, small_batches, stash, text_slices

#: A cut wherever the hash has so many zero bits: about 1 kB a chunk.
CUT_BITS = 10
#: Characters whose class never changed between Unicode versions, so that both tokenizers split them alike; other pieces go to the slower one.
_PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-ͮЀ-ӿ]")
#: Between these two characters every token ends: the pattern of the vocabulary starts a new piece at a space that follows a letter.
_SAFE = re.compile(r"[A-Za-zà-öø-ÿ](?= [A-Za-zà-öø-ÿ])")


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encodes and decodes with the vocabulary of a tokenizers file; ranks is the same vocabulary in tiktoken's form."""

    def __init__(self, path: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.path = path
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        self.bytes = {i: b for b, i in table.items()} | {i: s.encode() for s, i in special.items()}
        self.kind = "<u2" if max(self.bytes) < 1 << 16 else "<u4"
        self.decimal = [str(i) for i in range(max(self.bytes) + 1)]

    @functools.cached_property
    def slow(self):  # noqa: ANN201
        """The tokenizers library's own, loaded where a piece needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.path)
        slow.no_truncation()
        slow.no_padding()
        return slow

    def encode(self, text: str) -> list[int]:
        if _PLAIN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def row(self, ids: list[int]) -> tuple[int, str, str]:
        """(n_tokens, ids_sha256, decoded_sha256)."""
        listed = ",".join(map(self.decimal.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()

    def joined(self, text: str, pieces: list[tuple[int, int, list[int]]], window: int = 64) -> list[int]:
        """Tokens of text, from those of its pieces (start, end, ids): only windows around the joins are encoded again.

        After each step ids are the tokens of text[:end]. A window begins where a token of the left side surely ends and reaches to such
        a place in the right piece, or to its end. It is widened until its edges agree with what the pieces have there.
        """
        ids = list(pieces[0][2])
        for start, end, right_ids in pieces[1:]:
            size = window
            while True:
                back, ahead = _last_safe(text, start, size), _first_safe(text, start, end, size)
                a, b = self.encode(text[back:start]), self.encode(text[start:ahead])
                if ids[len(ids) - len(a) :] == a and right_ids[: len(b)] == b:
                    break
                if back == 0 and ahead == end:
                    return self.encode(text)
                size *= 4
            ids[len(ids) - len(a) :] = self.encode(text[back:ahead])
            ids += right_ids[len(b) :]
        return ids


def _last_safe(text: str, at: int, window: int) -> int:
    """The last safe place at least `window` characters before `at`; 0, which is safe too, if there is none."""
    while window < at:
        found = None
        for found in _SAFE.finditer(text, max(0, at - 4 * window), at - window + 1):
            pass
        if found and found.end() <= at:
            return found.end()
        window *= 4
    return 0


def _first_safe(text: str, at: int, end: int, window: int) -> int:
    """The first safe place at least `window` characters after `at`, or `end`."""
    found = _SAFE.search(text, at + window, end) if at + window < end else None
    return found.end() if found else end


def _grouped(parts: list[str], have: dict) -> Iterator[tuple[str, bool]]:
    """The parts, runs of those that are not in `have` put together, with whether a part is in it."""
    fresh: list[str] = []
    for part in parts:
        if part not in have:
            fresh.append(part)
            continue
        if fresh:
            yield "".join(fresh), False
            fresh = []
        yield part, True
    if fresh:
        yield "".join(fresh), False


@functools.cache
def codec(path: str, ranks: str) -> Codec:
    return Codec(path, ranks)


def chunks(batch: pa.RecordBatch, text: int = 1) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Of a slice: chunk bounds in bytes, which row each chunk is of, the bytes, and a 64-bit digest of each chunk.

    Null and empty texts have no chunk. A cut never splits a character and never lies in the first 16 bytes of a text, where the
    hash would still hold bytes of the text before.
    """
    texts = [x.as_py() or "" for x in batch.column(text)]
    raw = [x.encode() for x in texts]
    whole = b"".join(raw)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(whole, dtype=np.uint8)
    if data.size:
        at = np.flatnonzero(gear(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
        at = at[at < data.size]
        at = at[data[at] & 0xC0 != 0x80]
        row = np.searchsorted(ends, at, side="right")
        at = at[at - starts[row] >= GEAR_BYTES]
    else:
        at = np.zeros(0, dtype=np.int64)
    full = sizes > 0
    begin = np.union1d(starts[full], at)
    end = np.r_[begin[1:], data.size] if begin.size else begin
    row = np.searchsorted(ends, begin, side="right")
    digest = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(begin.tolist(), end.tolist())), dtype=np.uint64, count=begin.size).view(np.int64)
    return np.stack([begin, end], axis=1) if begin.size else np.zeros((0, 2), dtype=np.int64), row, whole, digest


def shared_chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest): chunks that occur at least twice in all texts."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(chunks(part, 0)[3])], names=["digest"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(worker, "digest long").groupBy("digest").count().where("count > 1").select("digest")


RESULT = ("n_tokens", "ids_sha256", "decoded_sha256")
_KINDS = (pa.int64(), pa.string(), pa.string())


def encoded(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if not given) with n_tokens, ids_sha256, decoded_sha256, which replace columns of those names.

    Null texts count as empty. Rows stay as they are, repeated ones too; equal texts that hold shared chunks are put together once.
    """
    path, ranks = path or vocabulary("byte_bpe_50k.json"), ranks or vocabulary("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)
    shared = stash(shared_chunks(docs, text_col))
    known = bloom(shared, "digest")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in RESULT]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*kept).alias("row"))

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a shared chunk are done here; the others go on with their text and a digest of it."""
        c = codec(path, ranks)
        for part in text_slices(batches, 0):
            _, row, _, digest = chunks(part, 0)
            waits = np.zeros(part.num_rows, dtype=bool)
            waits[row[in_bloom(known, digest)]] = True
            texts = [x or "" for x in part.column(0).to_pylist()]
            done = [(None, None, None) if w else c.row(c.encode(x)) for x, w in zip(texts, waits.tolist())]
            keys = [hashlib.md5(x.encode()).digest() if w else None for x, w in zip(texts, waits.tolist())]
            left = [x if w else None for x, w in zip(texts, waits.tolist())]
            columns = [part.column(1), *(pa.array(x, k) for x, k in zip(zip(*done), _KINDS)), pa.array(keys, pa.binary()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *RESULT, "key", "text"])

    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string, key binary, text string")])
    first = stash(rows.mapInArrow(in_place, schema))
    texts = first.where("key is not null").groupBy("key").agg(F.min("text").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            bounds, row, whole, digest = chunks(part)
            at = np.flatnonzero(in_bloom(known, digest))
            pieces = [whole[a:b].decode() for a, b in bounds[at].tolist()]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[at])), pa.array(digest[at]), pa.array(pieces, type=pa.string())], names=["key", "digest", "chunk"])

    occurrences = texts.mapInArrow(split, "key binary, digest long, chunk string")

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, ranks)
        for part in text_slices(batches):
            ids = [np.array(c.encode(x.as_py()), dtype=c.kind).tobytes() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, type=pa.binary())], names=["digest", "chunk", "ids"])

    # Two chunks of one digest are told apart by their text: the one that is not in this table is encoded in place.
    # Occurrences are reduced in their own tasks first, so a chunk that all texts hold is a few rows when it is joined.
    once = occurrences.groupBy("digest").agg(F.min("chunk").alias("chunk")).join(shared, "digest", "left_semi")
    once = stash(once.mapInArrow(encode_chunks, "digest long, chunk string, ids binary"))
    ready = occurrences.select("key", "digest").distinct().join(once, "digest").groupBy("key").agg(F.collect_list(F.struct("chunk", "ids")).alias("ready"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, ranks)
        for part in text_slices(batches):
            out = []
            for text, known_chunks in zip(part.column(1), part.column(2)):
                text = text.as_py()
                have = {x["chunk"]: np.frombuffer(x["ids"], dtype=c.kind).tolist() for x in known_chunks.as_py() or ()}
                bounds, _, whole, _ = chunks(pa.RecordBatch.from_arrays([pa.array([text], type=pa.string())], names=["text"]), 0)
                pieces: list[tuple[int, int, list[int]]] = []
                at = 0
                for piece, shared_piece in _grouped([whole[a:b].decode() for a, b in bounds.tolist()], have):
                    pieces.append((at, at + len(piece), have[piece] if shared_piece else c.encode(piece)))
                    at += len(piece)
                ids = c.joined(text, pieces) if pieces else []
                out.append(c.row(ids if c.decode(ids) == text else c.encode(text)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*out), _KINDS))], names=["key", *RESULT])

    built = texts.join(ready, "key", "left").mapInArrow(assemble, "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    late = first.where("key is not null").select("key", "row").join(built, "key").select("row.*", *RESULT)
    return first.where("key is null").select("row.*", *RESULT).unionByName(late)


def op5_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), keep=["doc_id"])
