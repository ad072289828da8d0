"""SentencePiece BPE by backtracking, with the merges' own result.

BPE merges the best adjacent pair until none is left. A row of tokens is that result exactly if each token is what its own characters merge
to, and no two neighbours, merged together from their characters, give anything else: the first merge across a join would happen in the two
tokens alone as well. So a text is read from left to right: Aho-Corasick gives the longest piece at each place, a piece that its left
neighbour does not bear makes way for the next shorter one, and where none is left the last token is taken back. What stands before a place
has one encoding only, so a place that was given up is marked in a bit field and never entered again: work is linear.

No piece of the vocabulary holds a word's end before a space, so words are encoded by themselves; whether that and the places beside
characters that are in no longer piece are safe to cut at is read from the vocabulary. Short words are remembered, up to a fixed number.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.bpe_chunks import vocabulary
from storyloom.llm.common import documents, small_batches, text_slices

SPACE = "▁"
#: Characters of the longest word that is remembered, and how many words, or pairs of tokens, are at most.
REMEMBERED_CHARS, REMEMBERED = 48, 500_000


class PieceCodec:
    """Encodes and decodes with the BPE model of a sentencepiece file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only BPE models that leave characters as they are")
        kinds = proto.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: models with user-defined or unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.unknown_text = spec.unk_surface
        self.piece_of = {i: p for p, i in self.id_of.items()}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.text_of = {i: p.replace(SPACE, " ") for i, p in self.piece_of.items()}
        self.longest_piece = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1:
                self.longest_piece.add_word(piece, (len(piece) - 1, piece))
        self.longest_piece.make_automaton()
        self.words = self._cuts()
        self.kept: dict[str, bool] = {}
        self.bears_known: dict[tuple[str, str], bool] = {}
        self.shorter_known: dict[str, str | None] = {}
        self.unit_known: dict[str, tuple[int, str, str]] = {}
        self.unit_before: dict[str, tuple[int, str, str]] = {}  # what was remembered before the last half was forgotten

    def _cuts(self) -> re.Pattern:
        """What splits a text into runs that no merge can cross.

        Characters that stand in no longer piece and, where no piece has it inside, a word's end before a space or a punctuation mark.
        """
        inside = {(a, b) for p in self.score for a, b in zip(p, p[1:])}
        joined = {c for pair in inside for c in pair}
        alone = "".join(re.escape(chr(c)) for c in range(0x250) if chr(c) not in joined)
        if any(b == SPACE and a != SPACE for a, b in inside):
            return re.compile(f"[^{alone}]+|[{alone}]" if alone else "(?s).+")
        marks, before = {chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()}, None
        while marks != before:  # marks that follow nothing but each other and spaces inside a piece
            before = marks
            marks = marks - {b for a, b in inside if a != SPACE and a not in before}
        marks = "".join(map(re.escape, sorted(marks - set(alone))))
        return re.compile(f"{SPACE}*[^{SPACE}{alone}{marks}]+|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    def merged(self, text: str) -> list[str]:
        """The characters of a short text, merged: the best score first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def keeps(self, token: str) -> bool:
        """Whether the token is what its own characters merge to."""
        known = self.kept.get(token)
        if known is None:
            known = len(token) == 1 or self.merged(token) == [token]
            if len(self.kept) > REMEMBERED:
                self.kept.clear()
            self.kept[token] = known
        return known

    def bears(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are side by side."""
        pair = (left, right)
        known = self.bears_known.get(pair)
        if known is None:
            known = self.merged(left + right) == [left, right]
            if len(self.bears_known) > REMEMBERED:
                self.bears_known.clear()
            self.bears_known[pair] = known
        return known

    def shorter(self, token: str) -> str | None:
        """The longest piece, or single character, that the token begins with and is longer than."""
        if token in self.shorter_known:
            return self.shorter_known[token]
        found = next((token[:n] for n in range(len(token) - 1, 0, -1) if n == 1 or token[:n] in self.score), None)
        if len(self.shorter_known) > REMEMBERED:
            self.shorter_known.clear()
        self.shorter_known[token] = found
        return found

    def tokens(self, text: str) -> list[str]:
        """Pieces of a run, by backtracking; a character that is no piece stands for itself."""
        if text in self.score and self.keeps(text):
            return [text]
        longest = list(text)
        for end, (back, piece) in self.longest_piece.iter(text):  # in order of their ends: the last one of a start is the longest
            longest[end - back] = piece
        given_up = bytearray(len(text) // 8 + 1)
        known_pair, known_token = self.bears_known.get, self.kept.get
        out: list[str] = []
        at, last, token = 0, None, longest[0]
        while True:
            while token is not None:
                end = at + len(token)
                if not given_up[end >> 3] >> (end & 7) & 1:
                    fits = known_token(token)
                    if fits or (fits is None and self.keeps(token)):
                        if last is None:
                            break
                        fits = known_pair((last, token))
                        if fits or (fits is None and self.bears(last, token)):
                            break
                token = self.shorter(token)
            if token is None:
                given_up[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(token)
                token = self.shorter(token)
                last = out[-1] if out else None
                continue
            out.append(token)
            at = end
            if at == len(text):
                return out
            last, token = token, longest[at]

    def _ids(self, tokens: list[str]) -> list[int]:
        try:
            return [self.id_of[token] for token in tokens]
        except KeyError:  # a character that is no piece
            ids: list[int] = []
        for token in tokens:
            known = self.id_of.get(token)
            if known is not None:
                ids.append(known)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in token.encode())
            elif not (ids and ids[-1] == self.unknown):
                ids.append(self.unknown)
        return ids

    def unit(self, run: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text) of a run that no merge leaves."""
        known = self.unit_known.get(run)
        if known is None:
            known = self.unit_before.get(run)
            if known is None:
                ids = self._ids(self.tokens(run))
                known = (len(ids), ",".join(map(str, ids)), self.decoded(ids))
            if len(run) <= REMEMBERED_CHARS:
                self.unit_known[run] = known
        return known

    def units(self, text: str) -> list[tuple[int, str, str]]:
        if not text:
            return []
        if len(self.unit_known) > REMEMBERED // 2:
            self.unit_before, self.unit_known = self.unit_known, {}
        known, unit = self.unit_known.get, self.unit
        return [known(run) or unit(run) for run in self.words.findall((self.prefix + text).replace(" ", SPACE))]

    def encode(self, text: str) -> list[int]:
        return self.row(text, ("ids",))[0]

    def decoded(self, ids: list[int]) -> str:
        """The text of a run's ids with its leading space; runs of byte tokens are read as UTF-8."""
        try:
            return "".join([self.text_of[i] for i in ids])
        except KeyError:  # a byte token or the unknown one
            out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text_of.get(i, self.unknown_text))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.without_prefix(self.decoded(ids))

    def without_prefix(self, text: str) -> str:
        return text[1:] if self.prefix and text[:1] == " " else text

    def row(self, text: str, want: tuple[str, ...]) -> tuple:
        """The columns of OUTPUT that are asked for."""
        units = self.units(text)
        made = {
            "n_tokens": lambda: sum(u[0] for u in units),
            "ids": lambda: [int(i) for u in units for i in u[1].split(",")],
            "decoded": lambda: self.without_prefix("".join([u[2] for u in units])),
            "ids_sha256": lambda: hashlib.sha256(",".join([u[1] for u in units]).encode()).hexdigest(),
            "decoded_sha256": lambda: hashlib.sha256(self.without_prefix("".join([u[2] for u in units])).encode()).hexdigest(),
        }
        return tuple(made[name]() for name in want)


#: Columns that encoded() can give, and their types.
OUTPUT = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


@functools.cache
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encoded(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None, want: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The columns `keep` of docs (all, if not given) with the columns `want` of OUTPUT, which replace columns of those names.

    Each row by itself and in its place: one pass without a shuffle, repeated rows and ties as they are. Null texts count as empty and have
    no ids; an empty table gives an empty one. Very long texts are cut where no merge can cross; a run without such a place is one run, in
    time linear to its length.
    """
    path = path or vocabulary("piece_bpe_32k.model")
    small_batches(docs.sparkSession)
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in want]
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(F.lit(1).alias("_"), *kept).alias("row"))

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in text_slices(batches, 0):
            made = list(zip(*(c.row(x or "", want) for x in part.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(x, OUTPUT[name][1]) for name, x in zip(want, made))], names=["row", *want])

    schema = T.StructType([rows.schema["row"], *(T.StructField(name, T.StructType.fromDDL(f"x {OUTPUT[name][0]}")["x"].dataType) for name in want)])
    return rows.mapInArrow(worker, schema).select(*(F.col("row")[c].alias(c) for c in kept), *want)


def op12_sentencepiece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), keep=["doc_id"], want=("n_tokens", "ids_sha256", "decoded_sha256"))
