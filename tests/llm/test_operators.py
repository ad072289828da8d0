"""The ten operators on awkward rows, against plain versions and exact round trips."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from storyloom.llm import bpe_chunks, fingerprints, host_rules, language_id, mincut_html, poisson_mix, quality_trees, quote_links, simhash_dedup, substring_dedup
from storyloom.llm.common import bloom, by_key, components, in_bloom, parts_of
from tests.llm.conftest import SCHEMA, awkward, prose

ROWS = awkward()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def reaches(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# --- 1 ---


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><header><a href="/">Home</a></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept them all, please, to go on reading.</div>
<div id="content"><h1>Title &amp; more</h1><p>First  paragraph, with <b>bold</b> text&nbsp;and a <a href="/x">link</a>.<p>Second one&#8212;unclosed.<div class="ad">Buy this now. It is cheap.</div>
<p>Third paragraph is here; it ends the story.</p><form><input><p>Sign up for our letter, please.</p></form></div>
<div class="sidebar"><p>Most read: a very long teaser about something else entirely, really.</p></div>
<section id="comments"><p>I liked this story very much. Thank you for writing it, dear author.</p></section><footer><p>&copy; 2024 The Paper. All rights reserved.</p></footer></body></html>"""


def test_main_text():
    assert mincut_html.main_text(PAGE) == "Title & more\n\nFirst paragraph, with bold text and a link.\n\nSecond one—unclosed.\n\nThird paragraph is here; it ends the story."


@pytest.mark.parametrize("page", [None, "", "   ", "<nav><a href=x>y</a></nav>", "<script>x"])
def test_no_main_text(page):
    assert mincut_html.main_text(page) == ""


def test_broken_and_large_pages():
    assert mincut_html.main_text("plain text < 5 & more") == "plain text < 5 & more"
    big = mincut_html.main_text("<div>" * 500 + "".join(f"<p>Paragraph number {k}." for k in range(4000)))
    assert big.count("\n\n") == 3999
    assert mincut_html.main_text("<p " + "'" * 2000) is not None


STORY = "<h1>A title of the day</h1>" + "".join(f"<p>Paragraph number {k} has quite some words in it, as a paragraph of a story has. It ends here.</p>" for k in range(4))
STORY_TEXT = "\n\n".join(["A title of the day", *(f"Paragraph number {k} has quite some words in it, as a paragraph of a story has. It ends here." for k in range(4))])


@pytest.mark.parametrize("page", [
    f'<article class="post-1 post type-post hentry tag-politics">{STORY}</article>', f'<div class="container has-sidebar"><article>{STORY}</article></div>', f'<div class="no-sidebar content">{STORY}</div>',
    f'<div class="comments-open post">{STORY}</div>', f'<div class="story social-science">{STORY}</div>', f'<div class="right-sidebar"><article class="entry">{STORY}</article></div>',
    f'<article><header class="entry-header">{STORY}</header></article>', f'<article>{STORY}<aside><p>{prose(5, 30)}.</p></aside></article>', f'<article>{STORY}<div class="related-posts"><p>{prose(6, 30)}.</p></div></article>',
    f'<div id="content">{STORY}</div><div class="comment-list"><article class="comment-body"><p>{prose(7, 40)}.</p></article></div>', f"<button><article>{STORY}</article>", f"<svg><article>{STORY}</article>",
])
def test_names_of_real_pages(page):
    body = f'<body class="single"><header class="site-header"><a href="/">Home</a></header><nav class="main-nav"><a href="/a">One</a></nav>{page}<footer class="site-footer"><p>About the paper. Write to us.</p></footer></body>'
    assert mincut_html.main_text(body) == STORY_TEXT


def test_formulas_and_objects_are_text():
    text = mincut_html.main_text("<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is known.</p><object><p>A picture of it is described here.</p></object></article>")
    assert "a+b is known." in text and "described here" in text


PROSE = "<p>This is a paragraph of the story with words enough to be prose. It goes on for a while.</p>"
RAIL = "<div><a href=1>The first link of this list</a><p>A teaser in the rail.</p><a href=2>The second link of it</a><a href=3>A third link again</a></div>"


def own(page):
    found, tree = mincut_html.read(page)
    return [(b.text[:6], mincut_html.cost(b, tree.title) > 0, keep) for b, keep in zip(found, mincut_html.label(found, tree))]


def test_cut_overrules_a_blocks_own_cost():
    page = f"<article>{PROSE}<p><a href=x>Read the full report</a></p>{PROSE}<div class=ad>Buy this now. It is cheap.</div>{PROSE}</article>{RAIL}"
    got = {text: (alone, keep) for text, alone, keep in own(page)}
    assert got["Read t"] == (False, True)  # a bare link between paragraphs
    assert got["Buy th"] == (True, False) and got["A teas"] == (True, False)  # prose in an advert, prose among links
    assert got["This i"] == (True, True) and got["The fi"] == (False, False)


def test_cut_changes_labels_on_the_tables():
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")["html"]
    labels = [x for p in pages for x in own(p)]
    flipped = sum(alone != keep for _, alone, keep in labels)
    assert 0.01 * len(labels) < flipped < 0.2 * len(labels)
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p, re.S)[1]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert mincut_html.main_text(p) == "\n\n".join(x for x in want if x)


@pytest.mark.parametrize("wrapper", ['<main class="has-sidebar">', '<div class="alert-story">', '<div class="wp-block-group search-results-story">', '<div class="promo-free related">', '<div class="related">', "<form id=f>", '<div class="post-header">', '<div class="page-header">'])
def test_a_name_alone_does_not_empty_a_page(wrapper):
    page = f"<title>A title of the day - Paper</title><nav><a href=x>Home</a></nav>{wrapper}<h1>A title of the day</h1>{PROSE * 3}</div></form></main><footer><p>All rights reserved.</p></footer>"
    assert len(mincut_html.content(page)) == 4


def test_unclosed_elements_lose_nothing():
    for name in ("button", "select", "object", "canvas", "svg", "noscript", "iframe", "textarea", "math"):
        assert len(mincut_html.content(f"<article>{PROSE}<{name}>{PROSE}</article>{PROSE}")) == 3
    assert len(mincut_html.content(f"<article>{PROSE}<button>Go{PROSE}</article><button>x</button>")) == 3


def test_deep_and_long_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert mincut_html.main_text("<div>" * 20_000 + "x y z") == "x y z"
    assert time.perf_counter() - began < 2
    mincut_html.main_text("<div class=ad>some text. " * 20_000 + PROSE)
    mincut_html.main_text((PROSE + "<ul><li><a href=x>a link here</a></ul>") * 20_000)
    assert time.perf_counter() - began < 30


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(2, 8)
        s, t = [rng.choice([0, rng.random() * 5]) for _ in range(n)], [rng.choice([0, rng.random() * 5]) for _ in range(n)]
        edges = [(a, b, rng.random() * 3) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda keep: sum(t[v] if keep[v] else s[v] for v in range(n)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        best = min(cost([k >> v & 1 == 1 for v in range(n)]) for k in range(1 << n))
        assert abs(cost(mincut_html.cut(n, s, t, edges)) - best) < 1e-6


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash", 5), (2, None, None, None, None), (1, "u", PAGE, "clash", 5), (None, "u", "<p>A text.", None, None)], "page_id int, url string, html string, text string, n_chars long")
    rows = mincut_html.extracted(pages).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == 4 and got[None]["text"] == "A text." and len({r["text"] for r in rows if r["page_id"] == 1}) == 1
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0 and got[1]["n_chars"] == len(got[1]["text"]) and "html" not in got[1].asDict()
    assert mincut_html.extracted(pages.limit(0)).collect() == []


# --- 2 ---


def duck_rows(sql, **tables):
    con = duckdb.connect()
    for name, (df, kinds) in tables.items():
        con.register("tmp_" + name, df)
        con.sql(f"create table {name} as select " + ", ".join(f"cast({c} as {k}) as {c}" for c, k in kinds.items()) + f" from tmp_{name}")
    return con.sql(sql).df()


DOC_KINDS = {"doc_id": "bigint", "text": "varchar", "lang": "varchar", "source": "varchar", "n_chars": "bigint"}


def frame():
    return pd.DataFrame([r[:5] for r in ROWS], columns=list(DOC_KINDS)).astype({"doc_id": "Int64"})


def test_poisson_against_sql(docs):
    got = poisson_mix.mixed(docs)
    assert set(got.columns) == {*docs.columns, "copy", "shuffle_key"}
    want = duck_rows(poisson_mix.OP2_SQL, documents=(frame(), DOC_KINDS))
    assert rows_of(got.select("doc_id", "copy", "shuffle_key"), "doc_id", "copy", "shuffle_key") == sorted(((None if pd.isna(a) else int(a), int(b), int(c)) for a, b, c in zip(want["doc_id"], want["copy"], want["shuffle_key"])), key=repr)


def test_poisson_hits_target(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("abcdefghij").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    n = {r["source"]: r["n"] for r in poisson_mix.mixed(rows, weights).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] / 4500 - 1) < 0.05 and abs(n["b"] / 1500 - 1) < 0.1
    counts = Counter(r["doc_id"] for r in poisson_mix.mixed(rows, weights).where("source = 'a'").collect())
    per = np.bincount([counts.get(i, 0) for i in range(0, 6000, 3)])
    assert abs(per[0] / 2000 - np.exp(-2.25)) < 0.03


def test_poisson_salted_join_is_the_same(docs, monkeypatch):
    want = rows_of(poisson_mix.mixed(docs), "doc_id", "copy")
    monkeypatch.setattr(poisson_mix, "BROADCAST_SOURCES", 0)
    assert rows_of(poisson_mix.mixed(docs), "doc_id", "copy") == want


def test_poisson_large_rate(spark):
    rows = spark.createDataFrame([(1, "x", "a"), (2, "x" * 3000, "b")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert abs(poisson_mix.mixed(rows, weights).count() - 3001) < 300


def test_poisson_large_rates_against_sql(spark, monkeypatch):
    monkeypatch.setattr(poisson_mix, "MOST", 2)
    rows = [(k, "x" * (4000 if k % 10 else 3), "en", "big" if k % 10 else "small", 0) for k in range(200)]
    got = poisson_mix.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), temperature=0.1)
    sql = poisson_mix.OP2_SQL.replace("pow(n, 0.7)", "pow(n, 0.1)").replace("rate / 16", "rate / 2")
    want = duck_rows(sql, documents=(pd.DataFrame(rows, columns=list(DOC_KINDS)), DOC_KINDS))
    assert len(want) > 3000 and rows_of(got, "doc_id", "copy", "shuffle_key") == sorted(((int(a), int(b), int(c)) for a, b, c in zip(want["doc_id"], want["copy"], want["shuffle_key"])), key=repr)


def test_poisson_of_a_very_large_mean(spark):
    rows = spark.createDataFrame([(k, "x" * (1 if k else 200_000), "a" if not k else "b") for k in range(3)], "doc_id long, text string, source string")
    n = poisson_mix.mixed(rows, spark.createDataFrame([("b", 1.0)], "source string, weight double")).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in n} == {1, 2} and all(abs(r["count"] / 100_001 - 1) < 0.02 for r in n)


def test_nothing_to_mix(nothing):
    assert poisson_mix.mixed(nothing).collect() == []


# --- 3 ---

COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    marked = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), base)


def test_counts(docs):
    got = host_rules.judged(docs)
    assert rows_of(got, *COUNTS) == sorted(((r[0], *plain_counts(r[1])) for r in ROWS), key=repr)
    want = duck_rows(host_rules.OP3_SQL, documents=(frame(), DOC_KINDS))
    assert rows_of(got, "doc_id", "kept") == sorted(((None if pd.isna(a) else int(a), bool(b)) for a, b in zip(want["doc_id"], want["kept"])), key=repr)


def test_bad_host_goes(spark):
    good, bad = prose(1, 50), "short text"
    rows = [(k, good if k % 10 else bad, f"h{k % 7}") for k in range(700)] + [(1000 + k, bad if k % 10 else good, "junk") for k in range(200)] + [(2000, good, "tiny"), (2001, bad, "tiny")]
    got = {r["doc_id"]: r["kept"] for r in host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[1000 + k] for k in range(200)) and got[2000] and all(got[k] for k in range(700) if k % 10)


def differing_hosts():
    """A host for each rule that nearly all of its documents fail, plain ones, a tiny one, and a third of all rows in one."""
    kinds = {
        "short": lambda k: "too short " + prose(k, 4), "again": lambda k: "the same few words over and over again here " * 6, "signs": lambda k: " ".join(w + "##" for w in prose(k, 40).split()),
        "lines": lambda k: ("a line of the page\n" + prose(k, 12) + "\n") * 3 + prose(k + 1, 60), "plain": lambda k: prose(k, 50), "hot": lambda k: prose(k, 50),
    }
    rng, rows = random.Random(9), []
    for k in range(1500):
        host = "hot" if k % 3 == 0 else rng.choice([x for x in kinds if x != "hot"])
        kind = host if rng.random() < 0.9 else "plain"
        rows.append((k, kinds[kind](k), None, host + str(k % 2) if host != "hot" else host))
    return [*rows, (5000, prose(1, 50), None, "tiny"), (5001, "word", None, "tiny"), (5002, prose(2, 50), None, None)]


def test_hosts_that_differ_against_sql(spark):
    rows = differing_hosts()
    got = host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).withColumn("host_rate", F.round("host_rate", 6))
    frame = pd.DataFrame([(*r, 0) for r in rows], columns=list(DOC_KINDS)).astype({"doc_id": "Int64"})
    want = duck_rows(host_rules.OP3_SQL, documents=(frame, DOC_KINDS))
    columns = ["doc_id", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "host_rule"]
    assert rows_of(got, *columns) == sorted((tuple(x if isinstance(x, (str, bool)) else float(x) if c == "host_rate" else int(x) if c != "base_failed" and c != "kept" else bool(x) for c, x in zip(columns, r)) for r in want[columns].itertuples(index=False)), key=repr)
    gone = {r["host"]: r["host_rule"] for r in got.where("not base_failed and not kept").collect()}
    assert set(gone) == {f"{x}{k}" for x in ("short", "again", "signs", "lines") for k in (0, 1)} and len(set(gone.values())) > 1
    rates = {(r["host"], r["rule"]): r["rate"] for r in host_rules.rule_rates(host_rules.with_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id", "text", "source")).collect()}
    assert rates["signs0", "symbols"] > 0.8 and rates["plain0", "symbols"] < 0.1 and 0.1 < rates["tiny", "few_words"] < 0.5


def test_salted_host_join_is_the_same(docs, monkeypatch):
    want = rows_of(host_rules.judged(docs), "doc_id", "kept")
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", 0)
    assert rows_of(host_rules.judged(docs), "doc_id", "kept") == want


def test_no_hosts(nothing):
    assert host_rules.judged(nothing).collect() == []


# --- 4 ---


def test_next_and_neighbours(docs):
    for parts in (1, 3, 7):
        got = fingerprints.with_next(docs, parts=parts).collect()
        order = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = sorted(((d, t, order[(k + 1) % len(order)][1]) for k, (d, t) in enumerate(order)), key=repr)
        assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in got), key=repr) == want


def test_likeness():
    a, b = prose(1, 300), prose(2, 300)
    fa, fb, fc = fingerprints.fingerprint(a), fingerprints.fingerprint(b), fingerprints.fingerprint(a[:1500] + b[:400])
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint(" \n") == bytes(16) and fingerprints.likeness(fa, fa) == 1
    assert fingerprints.likeness(fa, fc) > fingerprints.likeness(fa, fb)


def test_fingerprint_against_a_plain_version():
    for text in [ROWS[k][1] for k in (1, 3, 4, 9, 10, 11, 13)] + ["a b", "a b c", "a b c d a b c"]:
        words = text.split(" ") if "\n" not in text else text.split()
        words = [w for w in words if w]
        terms = Counter(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else Counter()
        votes = [0.0] * 128
        for term, n in terms.items():
            bits = f"{xxhash.xxh3_128_intdigest(term.encode()):0128b}"
            votes = [v + (1 + np.log(n)) * (1 if b == "1" else -1) for v, b in zip(votes, bits)]
        got = f"{int.from_bytes(fingerprints.fingerprint(text), 'big'):0128b}"
        assert all(g == str(int(v > 0)) for g, v in zip(got, votes) if abs(v) > 1e-3)


def test_edited_texts(spark, tmp_path):
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None and r[0] != 17]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [t or "" for _, t in sorted(rows, key=lambda r: -r[0])]
    got = {r["doc_id"]: r for r in fingerprints.op4_document_fingerprints(spark, f"file://{tmp_path}").collect()}
    for (d, _), text, after in zip(sorted(rows, key=lambda r: -r[0]), texts, texts[1:] + texts[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, following = (fingerprints.fingerprint(x) for x in (text, edited, after))
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), changed.hex(), fingerprints.likeness(own, changed), fingerprints.likeness(own, following))
        assert tuple(got[d][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want


def test_all_within_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(60)]
    many = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(0, 7))) for b in base for _ in range(3)] + base[:20]
    fps = spark.createDataFrame([(x.to_bytes(16, "big"),) for x in many], "fp binary")
    want = {x.to_bytes(16, "big"): sum((x ^ y).bit_count() <= 4 for y in many) for x in set(many)}
    for most in (1_000_000, 3, 1):  # the smaller ones split buckets over tasks
        assert {bytes(r["fp"]): r["n_near"] for r in fingerprints.neighbours(fps, fps, most=most).collect()} == want


def test_one_and_no_document(spark, nothing):
    assert [(r["text"], r["next_text"]) for r in fingerprints.with_next(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).collect()] == [("abc", "abc")]
    assert fingerprints.with_next(nothing).collect() == []
    assert parts_of(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string").repartition(2)) == 4 and parts_of(nothing) == 4


def test_next_of_ids_of_any_type(spark):
    """String ids follow each other by their bytes, small and negative numbers by value; null ids come last."""
    rng = random.Random(4)
    for kind, ids in (("string", [f"{rng.choice('abzÄ漢')}{k}" for k in range(150)] + [None]), ("int", [rng.randrange(-500, 500) for _ in range(150)] + [None])):
        rows = [(i, f"text {k}") for k, i in enumerate(ids)]
        order = sorted(rows, key=lambda r: (r[0] is None, tuple(-b for b in r[0].encode()) + (1,) if isinstance(r[0], str) else -(r[0] or 0), r[1]))
        want = sorted(((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])), key=repr)
        for parts in (1, 3):
            got = fingerprints.with_next(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3), parts=parts)
            assert rows_of(got, "doc_id", "text", "next_text") == want


# --- 5 ---


def test_tokens(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_chunks.vocabulary("byte_bpe_50k.json"))

    def want(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = bpe_chunks.encoded(docs)
    assert rows_of(got, "doc_id", *bpe_chunks.RESULT) == sorted(((r[0], *want(r[1])) for r in ROWS), key=repr)
    assert set(got.columns) == {*docs.columns, *bpe_chunks.RESULT}


def test_joins_of_any_pieces():
    c = bpe_chunks.codec(bpe_chunks.vocabulary("byte_bpe_50k.json"), bpe_chunks.vocabulary("byte_bpe_50k.tiktoken"))
    rng = random.Random(11)
    for text in [prose(1, 200), "it's  <|endoftext|>they've\n\n \t12,345" * 30, "äöü漢字 🙂x" * 60, "a" * 3000, " " * 400 + "b", prose(3, 30) + "don't " * 90]:
        for _ in range(15):
            cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(rng.randrange(1, 6)))})
            pieces = [(a, b, c.encode(text[a:b])) for a, b in zip(cuts, cuts[1:])]
            assert c.joined(text, pieces) == c.slow.encode(text, add_special_tokens=False).ids


def test_every_kind_of_character():
    import sys
    import unicodedata

    c = bpe_chunks.codec(bpe_chunks.vocabulary("byte_bpe_50k.json"), bpe_chunks.vocabulary("byte_bpe_50k.tiktoken"))
    kinds = defaultdict(list)
    for k in range(1, sys.maxunicode + 1, 7):
        if unicodedata.category(chr(k)) != "Cs":
            kinds[unicodedata.category(chr(k))].append(chr(k))
    rng = random.Random(12)
    for chars in kinds.values():
        for _ in range(3):
            text = "".join(rng.choice(("a", " ", "x1", rng.choice(chars), "'s ")) for _ in range(200))
            assert c.encode(text) == c.slow.encode(text, add_special_tokens=False).ids
            assert c.decode(c.encode(text)) == c.slow.decode(c.encode(text), skip_special_tokens=False)


def test_texts_of_megabytes(spark):
    texts = [prose(31, 200_000), "ab" * 600_000, prose(31, 200_000) + " end", "no-space-" * 120_000, "x" * 1000 + prose(33, 40)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_chunks.vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe_chunks.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest() for k, x in enumerate(texts)}


def test_no_texts(nothing):
    assert bpe_chunks.encoded(nothing).collect() == []


# --- 6 ---


def test_passages_go_and_the_rest_stays(docs):
    passage = prose(99, 70)
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(docs.where("doc_id is not null")).collect()}
    core = " ".join(passage.split()[15:-15])
    assert core in got[7]["text"] and core not in got[8]["text"] and got[8]["first_ids"] == [7]
    assert prose(4, 60) in got[8]["text"] and got[8]["text"].endswith(prose(5, 30)[-60:]) and got[7]["n_removed_chars"] == 0
    assert got[5]["text"] == "" and got[4]["text"] == prose(1, 300) and got[0]["text"] is None and got[1]["text"] == "" and got[12]["text"] == prose(6, 4000)
    assert set(docs.columns) < set(substring_dedup.deduplicated(docs).columns)


def test_cuts_resist_insertions():
    import pyarrow as pa

    cut = lambda t: {t.encode()[a:b] for a, b in zip(*substring_dedup.chunks(pa.RecordBatch.from_arrays([pa.array([t])], names=["t"]), 0)[:2])}
    text = prose(1, 500)
    a, b = cut(text), cut("new words in front " + text[:1000] + " inserted " + text[1000:])
    assert len(a & b) > 0.9 * len(a)
    assert b"".join(text.encode()[x:y] for x, y in zip(*substring_dedup.chunks(pa.RecordBatch.from_arrays([pa.array([text])], names=["t"]), 0)[:2])) == text.encode()


def test_stitched_chunks_stay(spark):
    import pyarrow as pa

    def pieces(text):
        begin, end, *_ = substring_dedup.chunks(pa.RecordBatch.from_arrays([pa.array([text])], names=["t"]), 0)
        return [text.encode()[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())]

    texts = [prose(60 + k, 80) for k in range(12)]
    stitched = "".join(pieces(t)[4] for t in texts)
    known = {c.strip() for t in texts for c in pieces(t)}
    assert sum(len(c.split()) for c in pieces(stitched) if c.strip() in known) >= 60  # most chunks stand elsewhere, no two of them side by side
    long = "".join(pieces(texts[3])[2:9])
    rows = [*enumerate(texts), (20, stitched), (21, prose(80, 40) + " " + long + prose(81, 40))]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[20]["text"] == stitched and got[20]["n_removed_words"] == 0
    assert got[21]["first_ids"] == [3] and "".join(pieces(texts[3])[3:8]).strip() not in got[21]["text"]


def test_windows_cover_every_repeat():
    rng = random.Random(8)
    for _ in range(100):
        words = np.array([rng.choice((1, 3, 7, 25)) for _ in range(rng.randrange(1, 30))])
        row = np.sort([rng.randrange(3) for _ in words])
        start, end, _ = substring_dedup.windows(row, words, np.arange(2 * words.size).reshape(-1, 2))
        assert all(row[a] == row[b - 1] and words[a:b].sum() >= 20 for a, b in zip(start, end))
        for a in range(words.size):
            for b in range(a + 1, words.size + 1):
                if row[a] == row[b - 1] and words[a:b].sum() >= 20:
                    assert {k for x, y in zip(start, end) if a <= x and y <= b for k in range(x, y)} == set(range(a, b))


def test_texts_of_one_id_are_told_apart(spark):
    passage = prose(90, 70)
    rows = [(1, passage), (2, prose(91, 30) + " " + passage), (2, prose(92, 100)), (None, prose(93, 30) + " " + passage), (None, prose(94, 100))]
    got = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    core = " ".join(passage.split()[15:-15])
    assert len(got) == 5 and sum(core in r["text"] for r in got) == 1
    assert {prose(92, 100), prose(94, 100)} <= {r["text"] for r in got} and all(r["first_ids"] == [1] for r in got if r["n_removed_words"])


def plain_dedup(rows, min_words=20):
    """What substring dedup has to do, window by window over the operator's own chunks, one text after the other."""
    import pyarrow as pa

    def pieces(text):
        begin, end, _, n, *_ = substring_dedup.chunks(pa.RecordBatch.from_arrays([pa.array([text or ""])], names=["t"]), 0)
        raw = (text or "").encode()
        return [(raw[a:b].decode(), k) for a, b, k in zip(begin.tolist(), end.tolist(), n.tolist())]

    def stretches(cut):
        enough = lambda a, b: sum(k for _, k in cut[a:b]) >= min_words
        ends = [next((b for b in range(a + 1, len(cut) + 1) if enough(a, b)), None) for a in range(len(cut))]
        starts = [next((a for a in range(b - 1, -1, -1) if enough(a, b)), None) for b in range(1, len(cut) + 1)]
        for a, b in {(a, b) for a, b in enumerate(ends) if b} | {(a, b) for b, a in enumerate(starts, 1) if a is not None}:
            yield a, b, " | ".join(" ".join(x.split()) for x, _ in cut[a:b])

    order = sorted({(r[0] is None, r[0] if r[0] is not None else 0, r[1]) for r in rows if r[1]}, key=lambda r: (r[0], r[1]))
    seen, out = {}, {}
    for missing, i, text in order:
        cut = pieces(text)
        gone = {k for a, b, w in stretches(cut) if w in seen for k in range(a, b)}
        for _, _, w in stretches(cut):
            seen.setdefault(w, text)
        out[None if missing else i, text] = "".join(x for k, (x, _) in enumerate(cut) if k not in gone)
    return sorted(((r[0], out.get((r[0], r[1]), r[1])) for r in rows), key=repr)


def test_dedup_against_a_plain_version(spark, docs):
    rng = random.Random(21)
    shared = [prose(200 + k, 60) for k in range(3)] + ["of " * 55, "a b c " * 20]
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + k, " ".join(x for _ in range(3) for x in (prose(rng.randrange(10**6), 30), rng.choice(shared)))) for k in range(12)]
    rows += [(200, prose(202, 60).replace(" ", "\n")), (201, None), (None, prose(201, 60)), (None, "")]
    rows = [r for r in rows if r[0] is not None or r[1] != prose(9, 50)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(substring_dedup.deduplicated(table), "doc_id", "text") == plain_dedup(rows)
    words = spark.createDataFrame([(None if i is None else f"d{i:04}", t, "x") for i, t in rows], "doc_id string, text string, first_ids string").repartition(3)
    got = substring_dedup.deduplicated(words)
    assert rows_of(got, "doc_id", "text") == plain_dedup([(None if i is None else f"d{i:04}", t) for i, t in rows]) and got.schema["first_ids"].dataType.simpleString() == "array<string>"


@pytest.mark.parametrize("passage", ["Of " * 60, "ha ho " * 30, "one two three " * 20, prose(77, 51), "ein und zwei, " * 18])
def test_passages_of_few_words_go(spark, passage):
    rows = [(1, prose(301, 80) + " " + passage + prose(302, 50)), (2, prose(303, 45) + "\n" + passage + prose(304, 50)), (3, prose(305, 100)), (4, passage + passage)]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed_words"] == 0 == got[3]["n_removed_words"] and got[2]["n_removed_words"] >= 20 and got[4]["n_removed_words"] >= 40 and got[2]["first_ids"] == [1]


def test_repeats_inside_one_text_stay(spark):
    text = " ".join([prose(401, 60)] * 3)
    assert [r["text"] for r in substring_dedup.deduplicated(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [text]


def test_nothing_repeats(nothing):
    assert substring_dedup.deduplicated(nothing).collect() == []


# --- 7 ---


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = quality_trees.fit(x[:2000], y[:2000])
    p = trees.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95

    def slow(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([slow(r) for r in x[2000:2050]], p[:50])


def test_fit_takes_the_best_splits():
    """One tree of two levels against a search over all splits."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = ((x[:, 1] > 0.3) & (x[:, 2] < 0.8) | (x[:, 0] > 1)).astype(float)
    trees = quality_trees.fit(x, y, trees=1, depth=2)
    p = y.mean()
    grad, hess = p - y, np.full(len(y), p * (1 - p))

    def gain(rows, f, t):
        left = rows & (x[:, f] <= t)
        right = rows & ~left
        part = lambda r: grad[r].sum() ** 2 / (hess[r].sum() + quality_trees.RIDGE)
        least = min(hess[left].sum(), hess[right].sum()) * 4 >= quality_trees.LEAST / 4
        return part(left) + part(right) - part(rows) if least else 0.0

    def best(rows):
        edges = [(f, t) for f in range(3) for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_trees.BINS + 1)[1:-1]))]
        return max(gain(rows, f, t) for f, t in edges)

    every = np.ones(len(y), dtype=bool)
    f, t = trees.feature[0], trees.threshold[0]
    assert np.isclose(gain(every, f[0], t[0]), best(every))
    low = x[:, f[0]] <= t[0]
    for rows, k in ((low, 1), (~low, 2)):
        assert np.isclose(gain(rows, f[k], t[k]) if np.isfinite(t[k]) else 0.0, max(0.0, best(rows)))
    for leaf, rows in enumerate((low & (x[:, f[1]] <= t[1]), low & (x[:, f[1]] > t[1]), ~low & (x[:, f[2]] <= t[2]), ~low & (x[:, f[2]] > t[2]))):
        assert np.isclose(trees.leaf[0][leaf], -quality_trees.RATE * grad[rows].sum() / (hess[rows].sum() + quality_trees.RIDGE))


def test_rejected_texts_go_whatever_their_ids(spark):
    good = [(100 + k, prose(k, 100)) for k in range(120)]
    bad = [(300 + k, " ".join(w.upper() + "!!" for w in prose(k, 100).split())) for k in range(120)]
    labels = spark.createDataFrame([(d, int(d < 300), 0) for d, _ in good + bad], "doc_id long, quality int, toxic int")
    extra = [(None, prose(500, 100)), (None, bad[0][1]), (100, bad[1][1]), (100, prose(501, 100)), (None, prose(500, 100)), (7, prose(502, 60_000))]
    kept = rows_of(quality_trees.keep_good(spark.createDataFrame(good + bad + extra, "doc_id long, text string"), labels), "doc_id", "text")
    assert kept == sorted([*good, extra[0], extra[3], extra[4], extra[5]], key=repr)


def test_quality(spark, docs, nothing):
    good = [(100 + k, prose(k, 100)) for k in range(120)]
    bad = [(300 + k, " ".join(w.upper() + "!!" for w in prose(k, 100).split())) for k in range(120)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 300), 0) for d, _ in good + bad] + [(100, None, 0), (101, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_trees.scored(rows, labels).collect()}
    assert all(r["predicted"] == int(d < 300) and 0 <= r["score"] <= 1 for d, r in got.items()) and len(got) == 240
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert quality_trees.keep_good(rows, labels).count() == 120
    assert quality_trees.scored(docs, labels).count() == len(ROWS)
    assert {r["predicted"] for r in quality_trees.scored(docs, labels.limit(0)).collect()} == {1} and quality_trees.scored(nothing, labels).collect() == []


# --- 8 ---

TALK = [
    (1, 0, "ann", "Hello all,\nthe bridge is closed today.\n\nPlease take the ferry."), (1, 1, "bob", "> the bridge is closed today.\nWhy is that?\nBob"), (1, 2, "cy", "Ann wrote:\n> Please take the ferry.\n\nThe ferry is full."),
    (1, 3, "ann", ">> the bridge is  closed TODAY.\n> Why is that?\n> Bob\nRepairs."), (1, 4, "dee", "> nobody ever said this\nHm."), (1, 5, "eve", "> Repairs.\n> \n> The ferry is full.\nBoth."), (1, 5, "eve", "> Repairs.\n> \n> The ferry is full.\nBoth."),
    (2, 0, None, None), (2, 1, "x", ""), (2, None, "y", "> Hello"), (None, 3, "z", "text"), (2, 2, "w", "a > b is no quote\n>no space\n > indented"), (3, 1, "v", "> the bridge is closed today.\nOther conversation."),
]


MESSAGE_KINDS = {"conv_id": "bigint", "turn": "bigint", "role": "varchar", "text": "varchar"}


def same_as_sql(got, rows):
    talk = pd.DataFrame(rows, columns=list(MESSAGE_KINDS)).astype({"conv_id": "Int64", "turn": "Int64"})
    want = duck_rows(quote_links.OP8_SQL, conversations=(talk, MESSAGE_KINDS))
    plain = lambda x: None if x is None or pd.isna(x) else (int(x) if not isinstance(x, str) else x)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got, *want.columns) == sorted((tuple(map(plain, r)) for r in want.itertuples(index=False)), key=repr)


def test_quotes(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("own", F.lit("clash")).withColumn("units", F.lit(1))
    got = quote_links.conversations(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert (by[1, 1]["reply_to"], by[1, 2]["reply_to"], by[1, 3]["reply_to"], by[1, 4]["reply_to"], by[1, 5]["reply_to"]) == (0, 0, 1, None, 2)
    assert by[1, 3]["text"] == "Repairs." and by[1, 3]["thread"] == 0 and by[1, 3]["depth"] == 2 and by[1, 2]["text"] == "The ferry is full." and by[3, 1]["reply_to"] is None
    assert [by[1, k]["position"] for k in (0, 1, 3, 2, 5)] == [0, 1, 2, 3, 4]  # the answer to an answer stands before the next answer
    assert by[1, 4]["text"] == "> nobody ever said this\nHm." and by[2, None]["text"] == "> Hello" and by[1, 5]["text"] == "Both."  # what nobody said stays
    assert by[1, 0]["conversation"].startswith("<|ann|>\nHello all,") and by[1, 0]["conversation"].count("<|") == 6 and by[1, 1]["conversation"] is None
    same_as_sql(got, TALK)
    assert quote_links.conversations(rows.limit(0)).collect() == []


def test_odd_characters_and_long_attributions_stay(spark):
    rows = [(1, 0, "a", "one\x01two\x02 three\x03.\rnext\r\nlast"), (1, 1, "b", "On Monday, " + "a long name " * 60 + "wrote:\n> one\x01two\x02 three\x03.\nyes"), (1, 2, "c", "> next\n> last\n\x0b\n")]
    got = quote_links.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = {r["turn"]: r for r in got.collect()}
    assert by[0]["text"] == "one\x01two\x02 three\x03.\nnext\nlast" and by[1]["text"] == "yes" and by[1]["reply_to"] == by[2]["reply_to"] == 0
    same_as_sql(got, rows)


def test_unlinked_quotations_stay(spark):
    """Prompts of a shell, a quotation from outside with its attribution, and one message that quotes both what was said and what was not."""
    rows = [
        (1, 0, "a", "Run this:\n>>> import os\n>>> os.getcwd()\nand tell me."), (1, 1, "b", "The paper wrote:\n> a quotation from outside\nSo it says."), (1, 2, "c", "Ann wrote:\n> and tell me.\n> \n> something else\n\nBob wrote:\n> never said\nDone."),
        (1, 3, "d", "> So it says.\n> with a line of its own\nHm."),
    ]
    got = quote_links.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = {r["turn"]: r for r in got.collect()}
    assert by[0]["text"] == rows[0][3] and by[1]["text"] == rows[1][3] and (by[0]["n_linked"], by[1]["n_linked"], by[2]["n_linked"]) == (0, 0, 1)
    assert by[2]["text"] == "> something else\n\nBob wrote:\n> never said\nDone." and by[3]["text"] == "> with a line of its own\nHm."
    assert "> a quotation from outside" in by[1]["conversation"]
    same_as_sql(got, rows)


def many_messages(n, convs, seed):
    """Messages that quote earlier ones of their conversation; a third of all are in one, and half of those answer its first one."""
    rng = random.Random(seed)
    said, rows = defaultdict(list), []
    for k in range(n):
        c = 0 if rng.random() < 0.33 else rng.randrange(1, convs)
        t = len(said[c])
        own = f"message {k} says {rng.randrange(n)}.\n\nAnd {prose(k, 6)} {k}."
        text = own
        if t and rng.random() < 0.8:
            to = 0 if c == 0 and rng.random() < 0.5 else rng.randrange(max(0, t - 30), t)
            text = (f"x{to} wrote:\n" if rng.random() < 0.5 else "") + "\n".join("> " + line for line in said[c][to].split("\n")[: rng.choice((1, 3))]) + "\n" + own
        said[c].append(own)
        rows.append((c, t, f"r{k % 5}", text))
    return rows


def test_reply_order_of_many_messages(spark):
    rows = many_messages(4000, 60, 5)
    got = quote_links.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    assert got.where("reply_to is not null").count() > 2000
    same_as_sql(got, rows)
    linked = quote_links.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = {(r["conv_id"], r["thread"], r["part"]): r for r in quote_links.formatted_threads(linked, 7).collect()}
    assert max(r["n_messages"] for r in parts.values()) == 7 and sum(r["n_messages"] for r in parts.values()) == 4000


def test_long_thread(spark):
    rows = [(1, k, "r", (f"> line number {k - 1}\n" if k else "") + f"line number {k}") for k in range(70)]
    got = {r["turn"]: (r["thread"], r["depth"], r["position"]) for r in quote_links.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {k: (0, k, k) for k in range(70)}


# --- 9 ---


def test_language(spark, docs, nothing):
    import random as r

    tongues = {"aa": "lum tar vek sil dor", "bb": "ñoqui zzha wrop thgi xaxu", "cc": "ça été où très œuf"}
    rows = [(k, " ".join(r.Random(k).choices(tongues[lang].split(), k=30)), lang) for k, lang in enumerate(list(tongues) * 40)] + [(500, "123 !!", "aa"), (501, None, "bb"), (502, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language_id.identified(table, language_id.train(table)).collect()}
    assert all(got[d]["lang_pred"] == lang and 0 <= got[d]["score"] <= 1 for d, _, lang in rows[:120])
    assert [got[d]["lang_pred"] for d in (500, 501, 502)] == ["und"] * 3
    model = language_id.train(table)
    assert model.predict(["qqq kkkk jjjj pppp"])[0][2] and not model.predict([rows[0][1]])[0][2]
    assert language_id.identified(docs, language_id.train(docs)).count() == len(ROWS)
    assert {x["lang_pred"] for x in language_id.identified(table, language_id.train(nothing)).collect()} == {"und"} and language_id.identified(nothing, model).collect() == []


def test_language_against_a_plain_version():
    rng = random.Random(15)
    texts = [prose(k, 30) for k in range(20)] + ["é" * 40, "Über " * 9]
    vectors = []
    for text in texts:
        counts = np.zeros(language_id.DIMS)
        line = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        for n in (2, 3):
            for i in range(len(line) - n + 1):
                a, b, *c = (ord(x) for x in line[i : i + n])
                h = (a * 0x9E3779B1 + b * 0x85EBCA77) % 2**32
                if c:
                    h = (h * 0xC2B2AE3D + c[0] * 0x27D4EB2F + 1) % 2**32
                counts[((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 20] += 1
        assert (counts == language_id.counts(text)).all()
        vectors.append(np.log1p(counts) / np.linalg.norm(np.log1p(counts)))
    pick = [rng.randrange(len(texts)) for _ in range(6)]
    model = language_id.Model(np.ones(language_id.DIMS, dtype=np.float32), [f"l{k}" for k in range(6)], np.array([vectors[k] for k in pick], dtype=np.float32), np.full(6, 0.5))
    for text, v, (lang, score, rejected) in zip(texts, vectors, model.predict(texts)):
        cosines = [float(v @ vectors[k]) for k in pick]
        best = max(range(6), key=lambda k: (round(cosines[k], 5), -k))  # of equally near ones the first
        assert abs(cosines[int(lang[1:])] - max(cosines)) < 1e-5 and abs(score - cosines[best]) < 1e-4 and rejected == (score < 0.5)


def test_repeated_ids_and_languages(spark):
    rows = [(k % 7, prose(k, 40), "en") for k in range(60)] + [(3, "ñandú " * 40, "es")] * 20
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.identified(table, language_id.train(table)).collect()
    assert len(got) == 80 and {r["lang_pred"] for r in got} == {"en", "es"}
    assert language_id.train(table).centroids.tolist() == language_id.train(table.repartition(5)).centroids.tolist()


# --- 10 ---


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_near_duplicates(docs):
    got = simhash_dedup.near_duplicates(docs.where("doc_id is not null"))
    rows = [r for r in ROWS if r[0] is not None]
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = reaches(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = defaultdict(lambda: 1 << 60)
    for k, r in enumerate(rows):
        least[root[k]] = min(least[root[k]], r[0])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert rows_of(got, "doc_id", "fp", "component_id") == sorted(((r[0], signed(f), least[root[k]]) for k, (r, f) in enumerate(zip(rows, fps))), key=repr)
    assert simhash_dedup.near_duplicates(docs).count() == len(ROWS)


def test_null_and_shared_ids_keep_their_texts(spark):
    near = {64: None}
    base = prose(70, 400).split()
    for k in range(400):  # one word changed, at most four bits away from the first text
        text = " ".join([*base[:k], "changed", *base[k + 1 :]])
        near[(plain_fingerprint(" ".join(base)) ^ plain_fingerprint(text)).bit_count()] = text
    copy = near[min(b for b in near if b)]
    rows = [(1, prose(71, 90)), (2, prose(71, 90)), (2, prose(72, 90)), (3, prose(73, 90)), (3, prose(74, 90)), (None, prose(75, 90)), (None, prose(76, 90)), (None, prose(76, 90)), (None, prose(71, 90)), (9, copy), (None, " ".join(base))]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows[:7])] + [(*rows[7], 6)] + [(*r, k) for k, r in enumerate(rows[8:], 8)], "doc_id long, text string, row long").repartition(4)
    kept = rows_of(simhash_dedup.keep_representatives(docs), "doc_id", "text")
    assert kept == sorted([(1, prose(71, 90)), (2, prose(72, 90)), (3, prose(73, 90)), (3, prose(74, 90)), (None, prose(75, 90)), (None, prose(76, 90)), (9, copy)], key=repr)


def test_chain_over_null_ids(spark, monkeypatch):
    at = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": -1}
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, *_, **__: docs.select("doc_id", F.create_map(*(F.lit(x) for p in at.items() for x in p))[F.col("text")].cast("long").alias("fp"), "_tie"))
    docs = spark.createDataFrame([(4, "a"), (None, "b"), (6, "c"), (None, "d")], "doc_id long, text string")
    assert rows_of(simhash_dedup.near_duplicates(docs), "doc_id", "component_id") == sorted([(4, 4), (None, 4), (6, 4), (None, None)], key=repr)
    assert rows_of(simhash_dedup.keep_representatives(docs), "doc_id", "text") == sorted([(4, "a"), (None, "d")], key=repr)


def test_radius_is_passed_on(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(simhash_dedup, "links", lambda fps, radius=4, **_: asked.append(radius) or spark.createDataFrame([], "a long, b long"))
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    assert simhash_dedup.near_duplicates(docs, radius=1).count() == simhash_dedup.keep_representatives(docs, radius=2).count() == 2 and asked == [1, 2]


def test_links_connect_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    many = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(12)})
    signed = [x - (1 << 64) if x >> 63 else x for x in many]
    at = {x: k for k, x in enumerate(signed)}
    want = reaches(len(many), [(a, b) for a in range(len(many)) for b in range(a) if (many[a] ^ many[b]).bit_count() <= 4])
    for most in (1_000_000, 4, 1):  # the smaller ones split cells over tasks
        got = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most).collect()
        assert reaches(len(many), [(at[r["a"]], at[r["b"]]) for r in got]) == want
        assert all((many[at[r["a"]]] ^ many[at[r["b"]]]).bit_count() <= 4 for r in got)


def test_keys_stay_whole():
    import pyarrow as pa

    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 9))]
        key = np.repeat(np.arange(len(sizes)), sizes)
        cuts = sorted({0, len(key), *(rng.randrange(len(key) + 1) for _ in range(4))})
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(np.arange(a, b))], names=["k", "v"]) for a, b in zip(cuts, cuts[1:])]
        for most in (None, 1, 3, 6):
            seen, split = [], set()
            for whole, (k, v) in by_key(batches, most):
                seen += v.tolist()
                for x in set(k.tolist()):
                    if whole:
                        assert (k == x).sum() == sizes[x] and (not most or sizes[x] <= most)
                    else:
                        split.add(x)
            assert sorted(seen) == list(range(len(key))) and split == {x for x, n in enumerate(sizes) if most and n > most}


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 100)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(100)}, 5000: 5000, 5001: 5000}


def test_dedup_of_nothing(nothing):
    assert simhash_dedup.near_duplicates(nothing).collect() == [] and simhash_dedup.keep_representatives(nothing).collect() == []


def test_bloom(spark):
    keys = np.array([xxhash.xxh64_intdigest(str(k)) for k in range(20_000)], dtype=np.uint64).view(np.int64)
    words = bloom(spark.createDataFrame([(int(k),) for k in keys[:10_000]], "k long"), "k", 20)
    assert in_bloom(words, keys[:10_000]).all() and in_bloom(words, keys[10_000:]).mean() < 0.01


def test_stashes_go(spark):
    from storyloom.llm.common import drop_stashes, stash

    a, b = stash(spark.range(5)), stash(spark.range(7))
    assert drop_stashes(spark, keep=[b]) >= 1 and b.count() == 7
    with pytest.raises(Exception):  # noqa: B017
        a.count()


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from storyloom.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_schema_is_whole():
    assert len(SCHEMA.split(", ")) == len(ROWS[0])


# --- 1: attributes, names, controls ---

LEAD = "".join(f"<p>Paragraph number {k} of the story has some words in it, and it ends right here.</p>" for k in range(3))
LEAD_TEXT = "\n\n".join(f"Paragraph number {k} of the story has some words in it, and it ends right here." for k in range(3))
NOTICE = "<p>We use cookies to make this site work. You can turn them off. Some pages need them. Read more about it here.</p>"


@pytest.mark.parametrize(("page", "text"), [
    (f'<article title="The hidden cost of rain"><h1>The hidden cost of rain</h1>{LEAD}</article>', f"The hidden cost of rain\n\n{LEAD_TEXT}"),
    (f'<div class="container hidden md:block">{LEAD}</div>', LEAD_TEXT), (f'<div data-note="display:none">{LEAD}</div>', LEAD_TEXT),
    (f'<p aria-label="A hidden gem">A first paragraph stands here, and it is read by all of them.</p>{LEAD}', f"A first paragraph stands here, and it is read by all of them.\n\n{LEAD_TEXT}"),
    (f"<div hidden><p>Nobody sees this one, though it is long enough.</p></div>{LEAD}", LEAD_TEXT), (f'<div style="color:red; display: none">{NOTICE}</div>{LEAD}', LEAD_TEXT), (f'<div aria-hidden="true">{NOTICE}</div>{LEAD}', LEAD_TEXT),
    (f'<div id="x"><p>Short news. It is brief.</p></div><div class="cookie-notice">{NOTICE}</div>', "Short news. It is brief."), (f'<div id="x"><p>Short news. It is brief.</p></div><div class="newsletter">{NOTICE}</div>', "Short news. It is brief."),
    (f"{LEAD}<button><p>Go</p></button>", LEAD_TEXT), (f"{LEAD}<button>Go<div>there</div></button><button>Stop</button>", LEAD_TEXT),
])
def test_what_attributes_and_names_say(page, text):
    assert mincut_html.main_text(page) == text


def test_unclosed_controls_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        page = "<button><p>A line of it.</p>" * n + "</button>"
        began = time.perf_counter()
        mincut_html.read(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.2
