"""Divergence of sources against a plain version in Python integers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from storyloom.llm import source_divergence
from storyloom.llm.source_divergence import divergence, document_vectors, group_counts, vocabulary_of
from tests.llm.conftest import awkward, prose

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_df=10, top=10):
    """rows: (text, lang, source). Sorted (lang, source, part, item, value, rank)."""
    df, n = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(lower(text or ""))
        groups.add((lang, source))
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= min_df]
        of = [s for x, s in groups if x == lang]

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        every = Counter()
        for s in of:
            every.update({t: n[lang, s][t] for t in kept})
        mine, whole = shares(n[lang, source]), shares(every)
        pairs = []
        for s in of:
            if s != source:
                other = shares(n[lang, s])
                pairs.append((sum((mine[t] - other[t]) ** 2 // (mine[t] + other[t]) for t in kept), s))
        terms = [((mine[t] - whole[t]) ** 2 // (mine[t] + whole[t]), t) for t in kept if n[lang, source][t] and mine[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
    return sorted(out)


def found(df):
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(map(tuple, df.collect()))


def texts(seed, rows, sources, hot=0.35):
    """A third of all rows in one source and language, sources with a leaning, a language that keeps nothing, sources without terms."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Größe", "ñu", "É", "漢字"]
    out = []
    for _ in range(rows):
        s = 0 if rng.random() < hot else rng.randrange(sources)
        text = " ".join(rng.choice(words[s % 40 : s % 40 + 50] + words[-4:]).upper() if rng.random() < 0.1 else rng.choice(words[s % 40 :]) for _ in range(rng.randrange(0, 40)))
        out.append((text, "en" if rng.random() < 0.8 else "de", f"s{s}"))
    return out + [("only here", "xx", "s1"), ("", "xx", "s2"), (None, "xx", None), ("12 34", "en", "blank"), (None, None, None), ("a", None, "z")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, source string, part string, n long, value long")


def test_against_plain(spark):
    rows = texts(1, 600, 12)
    assert found(divergence(frame(spark, rows).repartition(5))) == plain(rows)


@pytest.mark.parametrize(("tile", "bucket"), [(3, 7), (1, 1000), (64, 5)])
def test_tiles_and_buckets(spark, monkeypatch, tile, bucket):
    monkeypatch.setattr(source_divergence, "TILE", tile)
    monkeypatch.setattr(source_divergence, "BUCKET_TERMS", bucket)
    rows = texts(2, 400, 9)
    # _tile_pairs runs in workers: the tile goes with it
    body = source_divergence._tile_pairs

    def with_tile(table):
        source_divergence.TILE = tile
        return body(table)

    monkeypatch.setattr(source_divergence, "_tile_pairs", with_tile)
    assert found(divergence(frame(spark, rows))) == plain(rows)


def test_passes_sums_on_when_full(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 1)
    rows = texts(3, 200, 5)
    assert found(divergence(frame(spark, rows).repartition(3), min_df=4, top_terms=3)) == plain(rows, 4, 3)


def test_large_counts_stay_exact(spark):
    """Counts beyond what a long holds once they are scaled."""
    from pyspark.sql import functions as F

    n, total, size = 12_345_678_901_234, 98_765_432_109_876, 1_000_003
    got = spark.range(1).select(source_divergence._share(F.lit(n), F.lit(total), F.lit(size)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * size)


def test_awkward_rows(spark, docs, nothing):
    rows = [(r[1], r[2], r[3]) for r in awkward()]
    assert found(divergence(docs, min_df=2)) == plain(rows, 2)
    assert found(divergence(docs)) == plain(rows)
    assert divergence(nothing).collect() == []


def test_document_vectors(spark):
    rows = texts(4, 150, 4)
    docs = frame(spark, rows).selectExpr("monotonically_increasing_id() as doc_id", "*").cache()
    kept = vocabulary_of(group_counts(docs, min_df=5)).cache()
    by_lang = defaultdict(list)
    for r in sorted(kept.collect(), key=lambda r: r["index"]):
        assert r["index"] == len(by_lang[r.lang])
        by_lang[r.lang].append(r.term)
    df = defaultdict(Counter)
    for text, lang, _ in rows:
        df[lang or ""].update(set(TERM.findall(lower(text or ""))))
    assert {x: sorted(t, key=str.encode) for x, t in by_lang.items()} == {x: sorted((t for t, k in c.items() if k >= 5), key=str.encode) for x, c in df.items() if any(k >= 5 for k in c.values())}
    got = {r.doc_id: {by_lang[r.lang][i]: n for i, n in zip(r["indices"], r["values"])} for r in document_vectors(docs, kept).collect()}
    for r in docs.collect():
        want = {t: n for t, n in Counter(TERM.findall(lower(r.text or ""))).items() if t in set(by_lang[r.lang or ""])}
        assert got.get(r.doc_id, {}) == want


def test_sql(spark):
    rows = texts(6, 150, 5)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(source_divergence.OP11_SQL).fetchall()) == plain(rows)


def test_terms_of_any_text():
    for text in (prose(1, 50), "ÄB\x00c\x7fd_e~f^G@h", "É é ẞ ß İ", "１２ ab1cd"):
        assert [t.decode() for t in source_divergence.terms_of(text)] == TERM.findall(lower(text))
