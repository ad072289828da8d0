"""The summary chain against cases worked out by hand from its rules."""

import re

import pytest
from pyspark.sql import functions as F

from storyloom.functions import summaries
from storyloom.functions.summaries import DISCARDED, JUNK, display_summary, headline_echo, low_quality, near_text, sanitized, synthetic
from storyloom.operators.scoring import admitted, candidate_score, preview_resolution, rerank_apply, story_preview, summary_adjudication
from storyloom.plans.products import needs_summary, story_summary_choice, summary_refill

TEACHERS = "Teachers across the city will get new training for their classrooms this fall, as the school board voted on Tuesday night to pay."  # 23 words
PLAIN = "The mayor spoke about plans for the river bank on a quiet morning."  # 13 words, no digit, no topic


def one(spark, value):
    return spark.range(1).select(value.alias("x")).first().x


@pytest.mark.parametrize(("title", "summary", "kind", "score"), [
    ("A vote", TEACHERS, "existing", 0.97),  # 0.45 + 0.25 + 0.12 + 0.08 + 0.07
    ("A vote", PLAIN, "existing", 0.82),  # 0.45 + 0.25 + 0.12
    ("A vote", PLAIN.replace("morning", "morning in 2024"), "existing", 0.85),  # a digit
    ("A vote", "Mayor said nothing more about all of this.", "existing", 0.70),  # eight words: 0.45 + 0.25
    ("A vote", "Mayor said unbelievably little regarding everything.", "existing", 0.45),  # six words: low quality
    ("A vote", "The mayor spoke about plans for the river bank and follow us for more of it.", "existing", 0.65),  # 16 words, junk: 0.45 + 0.12 + 0.08
    ("The mayor spoke about plans for the river bank", PLAIN, "existing", 0.42),  # an echo: 0.82 - 0.4
    ("A vote", "New coverage highlights something that was not said at all before now.", "existing", 0.47),  # 12 words, a template: 0.82 - 0.35
    ("A vote", " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(61)), "existing", 0.82),  # 0.45 + 0.25 + 0.12 + 0.08 - 0.08
    ("A vote", PLAIN, "fallback", 0.38), ("A vote", "", "existing", 0.0), ("A vote", "", "fallback", 0.0),
])
def test_scores(spark, title, summary, kind, score):
    assert one(spark, candidate_score(F.lit(title), F.lit(summary), F.lit(kind))) == pytest.approx(score, abs=1e-9)


@pytest.mark.parametrize(("title", "summary", "echo"), [
    ("Council votes on school budget", "Council votes on school budget", True), ("Council votes on school budget", "COUNCIL votes -- on school budget!", True),
    ("Council votes on school budget", "Council votes on school budget Jan 12", True),  # the day goes
    ("Council votes on school budget", "School budget: council votes on it today, they say", True),  # all four longer words, at most seven words more
    ("Council votes on school budget", "School budget: council votes on it today after many long hours of quiet talk and tea", False),  # too many words, and another beginning
    ("Council votes on school budget", "Council votes on school budget after a long night with many words more than that", True),  # begins with it, and 50 characters
    ("Council votes on school budget", "Council votes on school budget after a long night with many words more than that, and more", False),
    ("Council votes on school budget", "Council votes on the new library", False), ("", "words", False), ("words", "", False), (None, "x", False),
    ("On it", "On it they go", False),  # no word of four letters in the title
])
def test_echoes(spark, title, summary, echo):
    assert one(spark, headline_echo(F.lit(title).cast("string"), F.lit(summary))) is echo


def test_texts(spark):
    assert one(spark, near_text(F.lit("On Sept 12, the COUNCIL met;  may 3 and mayor 4."))) == "on the council met and mayor 4"
    assert [one(spark, synthetic(F.lit(x))) for x in ("Reporting is focused on schools.", "Districts are now tracking it.", "We report: new coverage highlights it.", " Policy coverage is focused on it")] == [True, True, False, True]
    assert [one(spark, low_quality(F.lit(x))) for x in (PLAIN, "Short.", PLAIN + " Please donate.", "share it and share it and then share it once more, all of you")] == [False, True, True, True]


def decisions(spark, *rows):
    return summary_adjudication(spark.createDataFrame([(1, "A vote", *r, k) for k, r in enumerate(rows)], "id long, title string, summary string, kind string, ord int")).collect()


def test_decisions(spark):
    [d] = decisions(spark, (PLAIN, "existing"))
    assert (d.kind, d.confidence, d.reasons) == ("existing", 0.79, ["heuristic_quality_score", "clear_quality_margin"])  # alone: 0.52 + 0.2 * 0.9 + 0.27 * 0.35 = 0.7945
    [d] = decisions(spark, (PLAIN, "existing"), (TEACHERS, "scrape"))
    assert (d.kind, d.confidence, d.reasons) == ("scrape", 0.8, ["heuristic_quality_score", "clear_quality_margin", "scraped_main_content"])  # 0.52 + 0.15 * 0.9 + 0.42 * 0.35 = 0.802
    [d] = decisions(spark, (PLAIN, "existing"), (PLAIN.replace("quiet", "very calm"), "llm"))
    assert (d.kind, d.confidence, d.reasons) == ("llm", 0.61, ["heuristic_quality_score", "llm_rewrite_selected"])  # equal scores: the longer one; 0.52 + 0.27 * 0.35 = 0.6145
    [d] = decisions(spark, (PLAIN, "existing"), (PLAIN.upper(), "scrape"))
    assert d.kind == "existing" and d.confidence == 0.79  # equal texts count once
    assert decisions(spark, ("Too short.", "existing"), ("", "scrape")) == []
    rows = spark.createDataFrame([(1, "Council votes on school budget", "Council votes on school budget, and a little", "existing", 0)], "id long, title string, summary string, kind string, ord int")
    assert admitted(rows).collect() == []  # an echo is no candidate


def test_previews(spark):
    rows = [
        (1, "A vote", "existing", PLAIN, 0.79, ["heuristic_quality_score"]), (2, "A vote", "llm", PLAIN, 0.79, ["r"]), (3, "A vote", "fallback", PLAIN, 0.79, ["r"]), (4, "A vote", "existing", PLAIN, 0.57, ["r"]), (5, "A vote", "existing", "Districts are now tracking all of this and much more of it.", 0.9, ["r"]),
        (6, "The mayor spoke about plans for the river bank", "existing", PLAIN, 0.3, ["r"]), (7, "A vote", "existing", "Short.", 0.9, ["r"]), (8, "A vote", "existing", PLAIN, 0.58, []),
    ]
    got = {r.id: tuple(r)[1:] for r in story_preview(spark.createDataFrame(rows, "id long, title string, kind string, summary string, confidence double, reasons array<string>")).collect()}
    assert got == {
        1: ("excerpt", PLAIN, 0.79, "heuristic_quality_score"), 2: ("full", PLAIN, 0.79, "r"), 3: ("headline_only", None, 0.34, "fallback_suppressed"), 4: ("headline_only", None, 0.57, "low_confidence"), 5: ("headline_only", None, 0.34, "synthetic_suppressed"),
        6: ("headline_only", None, 0.3, "headline_echo_suppressed"), 7: ("headline_only", None, 0.0, "empty_preview_text"), 8: ("excerpt", PLAIN, 0.58, "candidate_selected"),
    }
    scored = spark.createDataFrame([(k, 10.0, "Ed." if k == 3 else None) for k in (1, 3, 4, 8, 99)], "id long, score double, editor_summary string")
    shown = spark.createDataFrame([(k, v[0], v[1], v[2]) for k, v in got.items()], "id long, preview_type string, preview string, confidence double")
    assert {r.id: (r.preview_type, r.score) for r in preview_resolution(scored, shown).collect()} == {1: ("excerpt", 10.0), 3: ("editor", 10.0), 4: ("headline_only", 9.0), 8: ("excerpt", 9.6), 99: ("headline_only", 9.0)}


def test_listed_rows_come_first_whatever_their_place(spark):
    ranked = spark.createDataFrame([(f"s{k}", k) for k in range(1, 6)], "id string, pos int")
    verdict = spark.createDataFrame([("s5", 2_000_000_000, False), ("s2", 1, True)], "id string, place long, demote boolean")
    assert [r.id for r in rerank_apply(ranked, verdict).orderBy("pos").collect()] == ["s5", "s1", "s3", "s4"]


def test_choice_and_refill(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    template = "Districts are now tracking all of this and much more of it."
    stories = spark.createDataFrame([
        ("good", "A vote in the city hall", PLAIN, "excerpt", PLAIN, "r", at), ("template", "A vote in the city hall", template, "excerpt", "x", "r", at), ("none", "The vote nobody reported on", None, "headline_only", None, "r", at), ("unseen", "A vote in the city hall", PLAIN, None, None, None, at),
    ], "id string, title string, summary string, preview_type string, preview_text string, preview_reason string, last_seen timestamp_ntz")
    articles = spark.createDataFrame([
        (1, "Vote one", TEACHERS, "https://e.org/1", at, "article"), (2, "Vote two", "Short.", "https://e.org/2", at + dt.timedelta(hours=1), "article"), (3, "Vote three", PLAIN, "https://e.org/3", at + dt.timedelta(hours=2), "non_article"), (4, "Vote four", TEACHERS, "https://news.google.com/rss/articles/4", at + dt.timedelta(hours=3), None),
    ], "id long, title string, summary string, url string, ts timestamp_ntz, quality_label string")
    links = spark.createDataFrame([("template", 1), ("template", 2), ("none", 2), ("unseen", 1), ("unseen", 3), ("unseen", 4)], "story_id string, article_id long")
    got = {r.id: r.summary for r in story_summary_choice(stories, links, articles).collect()}
    assert got["good"] == PLAIN and got["template"] == TEACHERS and "the vote nobody reported on" in got["none"]
    assert {r.id for r in stories.where(needs_summary()).collect()} == {"template", "none", "unseen"}
    new = {r.id: (r.kind, r.preview_type, r.summary) for r in summary_refill(stories, links, articles).collect()}
    assert new["unseen"] == ("existing", "excerpt", TEACHERS)  # the newest article that counts is the first one
    assert new["template"][0] == "fallback" if "template" in new else True  # its newest article has a short summary and a short title


def test_a_score_cleans_its_summary_once(spark):
    rows = spark.createDataFrame([(1, "A vote", TEACHERS), (2, "A vote", PLAIN), (3, "A vote", None)], "id long, title string, summary string")
    plan = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    alone, given = (plan(c).count("[ML](HTTP") for c in (sanitized(F.concat(F.lit("[ML](HTTP"), "summary")), candidate_score(F.col("title"), sanitized(F.concat(F.lit("[ML](HTTP"), "summary")), F.lit("existing"))))
    assert alone == given == 1
    assert [r.x for r in rows.orderBy("id").select(candidate_score(F.col("title"), sanitized(F.col("summary")), F.lit("existing")).alias("x")).collect()] == [0.97, 0.82, 0.0]


def test_guarded_patterns_cut_as_the_patterns_alone(spark):
    """Each pattern is tried only on texts with one of its words; case, the Kelvin sign and white space in between change nothing."""
    lead = "The board of the city met on Monday to talk about the plans for its schools"
    junk = ["Sign Up", "SUBSCRIBE", "newsletter", "Republish", "Become A", "Sponsor", "donate", "support our JOURNALISM", "Support Journalism", "Advertising", "Getty Images", "base64", "StreamlineHQ", "Share On", "Follow Us", "FaceBook", "twitter", "Instagram", "LinkedIn"]
    rows = [f"{lead} {x} and more" for x in junk]
    assert len({p for p in JUNK for x in junk if re.search(p, x, re.I)}) == len(JUNK)
    rows += [f"{lead} journalism \t and  more", f"{lead} ![x](http://a.b/c) [now](HTTPS://x.y) <b>a\n@b.org HTTP://z", f"{lead}. The Post Budget\nappeared first on X.", f"{lead} contact us, Contact me", f"{lead} faceboo\u212a and", None, ""]
    made = [r.x for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(sanitized(F.col("t")).alias("x")).collect()]
    n = len(junk)
    assert made[:n] == [lead] * n
    assert made[n:] == [f"{lead} journalism and more", f"{lead} now a @b.org", f"{lead}.", "", f"{lead} faceboo\u212a and", "", ""]


def test_cleaning_is_cheap_and_exact(spark):
    """No negated class on whole texts; the word guards hold for every junk word; words and comparisons as by the plain rules."""
    odd = "A\u00e9b\x0bC3-d\ufffd \U0001f600x K9 \u212a \u0130 [y]`{z}~ \x7f \u2028!"
    plan = spark.createDataFrame([(odd,)], "t string").select(sanitized(F.col("t")), display_summary(F.col("t")), near_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9" not in plan
    for words, parts in ((sum(summaries._JUNK_WORDS, []), summaries._JUNK_PARTS), (sum(summaries._TAIL_WORDS, []), summaries._TAIL_PARTS), ([*DISCARDED, "why it matters:"], summaries._HIDDEN_PARTS)):
        assert [w for w in words if not any(p in w for p in parts)] == []
    assert one(spark, summaries._words(F.lower(F.lit(odd)))) == [w for w in (re.sub("[^a-z0-9]", "", w) for w in odd.lower().split(" ")) if w]
    assert one(spark, near_text(F.lit(odd))) == re.sub("[ \t\n\x0b\f\r]+", " ", re.sub("[^a-z0-9 \t\n\x0b\f\r]", " ", odd.lower())).strip(" ")
    for text in ("a b", " a  b ", "a\tb\n c", "a \n", "\f a\x0b b\u00a0 c", "\n\n", "a\r\nb  \t c d"):
        assert one(spark, summaries._squeezed(F.lit(text))) == re.sub("[ \t\r\n\f]+", " ", text).strip(" ")
