"""SentencePiece encoding by backtracking, against the sentencepiece library."""

import hashlib
import random

import pytest

from storyloom.llm import piece_bpe
from storyloom.llm.bpe_chunks import vocabulary
from tests.llm.conftest import SCHEMA, awkward, prose

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(library, text):
    ids = library.encode(text or "")
    return len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))


TEXTS = [
    "", " ", "a", "  a  b ", "▁a", "▁▁ ▁", "a\nb\tc\r\n\x0b", "ﬁ½ é é", "\x00a", "<s></s><unk><0x0A>", "a​", "漢字かな交じり文です。", "🙂👩‍👩‍👧", "x" * 5000, " " * 1000, "\n" * 100, "ab" * 3000, "aaaaab" * 500, " a" * 100, "12345 3.14", "�",
    "Don't (stop), \"please\"...", "e.g.,this;that", prose(1, 500),
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(library, text):
    codec = piece_bpe.codec(MODEL)
    ids = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids)


def test_random_texts_as_the_library(library):
    """Pieces and characters at random, and few letters, where many merges compete."""
    codec, rng = piece_bpe.codec(MODEL), random.Random(12)
    pieces = list(codec.score)
    for _ in range(4000):
        mixed = "".join(rng.choice(pieces) if rng.random() < 0.8 else chr(rng.randrange(1, 0x3000)) for _ in range(rng.randrange(1, 9)))
        few = "".join(rng.choice("aehtnsi o,.\n▁") for _ in range(rng.randrange(1, 60)))
        for text in (mixed, few):
            assert codec.encode(text) == library.encode(text), repr(text)
    run = "".join(rng.choice(pieces) for _ in range(20000)).replace("▁", "")
    assert codec.encode(run) == library.encode(run)


def test_gives_places_up_and_comes_back():
    """A hand-made vocabulary: the longest piece first is wrong, and two tokens have to be taken back."""
    codec = piece_bpe.PieceCodec.__new__(piece_bpe.PieceCodec)
    import ahocorasick

    codec.score = {"a": -9.0, "b": -9.0, "c": -9.0, "d": -9.0, "bc": -1.0, "ab": -2.0, "cd": -3.0, "abc": -4.0, "bcd": -5.0}
    codec.longest_piece = ahocorasick.Automaton()
    for piece in codec.score:
        if len(piece) > 1:
            codec.longest_piece.add_word(piece, (len(piece) - 1, piece))
    codec.longest_piece.make_automaton()
    codec.kept, codec.bears_known, codec.shorter_known = {}, {}, {}
    for n in range(1, 7):
        for k in range(4**n):
            text = "".join("abcd"[k // 4**i % 4] for i in range(n))
            assert codec.tokens(text) == codec.merged(text), text


def test_forgets_and_stays_right(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 8)
    codec = piece_bpe.PieceCodec(MODEL)
    for k in range(20):
        assert codec.encode(prose(k, 60)) == library.encode(prose(k, 60))
    assert len(codec.unit_before) < 200


def test_awkward_rows(spark, docs, nothing, library):
    out = piece_bpe.encoded(docs.withColumn("n_tokens", docs.h), keep=["doc_id"], want=("n_tokens", "ids_sha256", "decoded_sha256"))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = sorted(((r[0], *plain(library, r[1])) for r in awkward()), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    whole = piece_bpe.encoded(docs)
    assert whole.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_tokens", "ids", "decoded"]
    for r in whole.collect():
        assert (r.ids, r.decoded) == (library.encode(r.text or ""), library.decode(library.encode(r.text or ""))) and r.n_tokens == len(r.ids)
    assert piece_bpe.encoded(nothing).collect() == []
    assert piece_bpe.encoded(docs, keep=[]).count() == len(awkward())


def test_query(spark, library):
    from storyloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = QUERIES["op12_sentencepiece_backtracking"](spark, sf)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    want = {r.doc_id: plain(library, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == want
