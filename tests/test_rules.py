"""Literal cases for the rules whose exact semantics decide results, and degenerate inputs."""

import datetime as dt

from pyspark.sql import functions as F

from storyloom.functions.text import family, hits, story_key
from storyloom.operators.filters import article_quality, audiences, non_story, topic_flags
from storyloom.operators.rollups import feed_health, state_saturation, story_rollup
from storyloom.operators.selection import select_diverse
from storyloom.functions.tokens import merge_tokens
from storyloom.functions.tokens import coverage_tokens
from storyloom.operators.similarity import coverage_join, merge_decision, overlap_pairs, state_of, with_tokens
from storyloom.operators.upserts import article_upsert, discovered_article_upsert
from storyloom.sources.pages import feed_items_scan, normal_url, page_canonical_url, page_lede


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_story_key(spark):
    assert values(spark, story_key(F.col("t")), ["The Board votes on the budget, again: board budget!", "", None]) == ["again-board-budget-votes", "", None]


def test_merge_tokens(spark):
    assert values(spark, F.array_join(merge_tokens(F.col("t")), " "), ["LAUSD teachers sued", "Cities strike"]) == ["lausd los angel unifi school district teacher lawsuit", "city ruling"]


def test_family(spark):
    assert values(spark, family(F.col("t")), ["www.news.abc.com", "a.b.co.uk", "apnews.com", "", None]) == ["abc.com", "b.co.uk", "associated-press", None, None]


def test_hits_are_substrings(spark):
    assert values(spark, hits(F.col("t"), ["law", "state"]), ["The lawn is statewide", "none"]) == [2, 0]


def test_audience_terms_are_words(spark):
    assert values(spark, F.array_join(audiences(F.col("t")), ","), ["Teachers use AI software in class", "paid leave", "University software for students"]) == ["teachers,edtech", "", ""]


def test_state_order(spark):
    aliases = [["virginia", "virginia"], ["west virginia", "west virginia"], ["ohio", "ohio"]]
    assert values(spark, state_of(F.col("t"), aliases), ["West Virginia votes", "Ohioans", "In Ohio, snow"]) == ["virginia", None, "ohio"]


def test_normal_url(spark):
    assert values(spark, normal_url(F.col("t")), ["https://a.org/x?utm_source=b&id=1#top", "https://a.org/x?gclid=2", "no url"]) == ["https://a.org/x?id=1", "https://a.org/x", "no url"]


def test_non_story(spark):
    rows = spark.createDataFrame([("Privacy Policy", "https://a.org/x"), ("Budget vote", "https://a.org/tags/x"), ("Budget vote", "https://a.org/news/1")], "t string, u string")
    assert [r[0] for r in rows.select(non_story(F.col("t"), F.col("u"))).collect()] == [True, True, False]


def test_quality(spark):
    rows = spark.createDataFrame([(1, "Board approves the new district budget plan", "x" * 90, "https://a.org/news/2024/05/budget"), (2, "Ann Smith", "", "https://a.org/staff/ann"), (3, None, None, None)], "id int, title string, summary string, url string")
    got = {r["id"]: (r["quality_label"], r["quality_score"]) for r in article_quality(rows).collect()}
    assert got[1] == ("article", 0.86) and got[2] == ("non_article", 0.06) and got[3][0] == "non_article"


def test_topic(spark):
    rows = spark.createDataFrame([("School board sets attendance policy", None, None), ("University campus opens", None, None), ("NBA trade", None, None)], "title string, summary string, url string")
    assert [(r["strict_signal"], r["off_topic"]) for r in topic_flags(rows).collect()] == [(True, False), (False, True), (False, True)]


def test_merge_decision(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", "Denver teachers sue over school closure", at), ("b", "Denver teachers file lawsuit, closure of school", at), ("c", "Boston budget vote", at)], "id string, title string, last_seen timestamp_ntz")
    pairs = overlap_pairs(with_tokens(rows))
    states = spark.createDataFrame([("a", "colorado", []), ("b", None, []), ("c", None, [])], "id string, state string, entities array<string>")
    got = {(r["i"], r["j"]): r["should_merge"] for r in merge_decision(pairs, states).collect()}
    assert got == {("a", "b"): True}


def test_blocking_loses_no_pair(spark):
    import random

    rng = random.Random(7)
    words = ["lawsuit", "vote", "raid", "school", "board", *(f"w{k}" for k in range(12))]
    at = dt.datetime(2024, 1, 10)
    rows = [(f"s{k:02d}", " ".join(rng.sample(words, 5)), at + dt.timedelta(hours=rng.randrange(300))) for k in range(40)]
    tokens = with_tokens(spark.createDataFrame(rows, "id string, title string, last_seen timestamp_ntz"))
    got = {(r["i"], r["j"]) for r in overlap_pairs(tokens).collect()}
    t = {r["id"]: r for r in tokens.collect()}
    want = {(a, b) for a in t for b in t if a < b and abs((t[a]["last_seen"] - t[b]["last_seen"]).total_seconds()) <= 5 * 86_400 and (set(t[a]["strong"]) & set(t[b]["strong"]) or len(set(t[a]["action"]) & set(t[b]["action"])) >= 2)}
    assert got == want
    for least in (0.3, 0.4, 0.8):
        near = {(r["i"], r["j"]) for r in overlap_pairs(tokens, least=least).collect()}
        assert near == {(a, b) for a, b in want if len(set(t[a]["tokens"]) & set(t[b]["tokens"])) / min(len(t[a]["tokens"]), len(t[b]["tokens"])) >= least}


def test_rollup_of_nothing(spark):
    links = spark.createDataFrame([], "story_id long, article_id string, title string, source_id long, ts timestamp_ntz, is_primary boolean")
    sources = spark.createDataFrame([], "id long, domain string, weight double")
    assert story_rollup(links, sources).collect() == []


def test_rollup_without_source(spark):
    links = spark.createDataFrame([(1, "a", None, 7, None, True)], "story_id long, article_id string, title string, source_id long, ts timestamp_ntz, is_primary boolean")
    row = story_rollup(links, spark.createDataFrame([], "id long, domain string, weight double")).first()
    assert (row["article_count"], row["source_count"], row["recent_count"], row["avg_weight"], row["latest_at"]) == (1, 0, 0, 1.0, None)


def test_feed_health(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = spark.createDataFrame([(1, 1, t(0), True, None), (2, 1, t(1), False, "x"), (3, 1, t(2), False, "y"), (4, 2, t(0), False, "z")], "id int, feed_id int, ts timestamp_ntz, success boolean, error string")
    got = {r["feed_id"]: (r["failures"], r["last_error"], r["last_success"]) for r in feed_health(log).collect()}
    assert got == {1: (2, "y", "2024-01-01 00:00:00"), 2: (1, "z", None)}


def test_saturation(spark):
    top = spark.createDataFrame([(1, 1, "ohio", False, 1), (2, 2, "ohio", False, 1), (3, 3, "ohio", True, 1), (4, 4, "ohio", False, 3), (5, 5, None, False, 1)], "id int, rank int, state string, pinned boolean, source_count int")
    assert {r["id"] for r in state_saturation(top).where("reason is not null").collect()} == {2}


def test_upsert_policy(spark):
    old = spark.createDataFrame([(1, "u", "t", "s" * 50, 0.3, None), (2, "v", "t", "short", None, None)], "id long, url string, title string, summary string, relevance double, ts timestamp_ntz")
    new = spark.createDataFrame([(3, "u", "n", "x" * 45, None, None), (4, "v", "n", "x" * 45, 0.9, None), (5, "w", "n", "", None, None), (6, "w", "m", "", None, None)], "id long, url string, title string, summary string, relevance double, ts timestamp_ntz")
    got = {r["url"]: (r["title"], r["summary"], r["relevance"], r["action"]) for r in article_upsert(old, new).collect()}
    assert got["u"] == ("n", "s" * 50, 0.3, "updated") and got["v"] == ("n", "x" * 45, 0.9, "updated") and got["w"] == ("m", None, None, "inserted")


def test_found_rows_that_tie_give_one_summary(spark):
    articles = spark.createDataFrame([], "url string, title string, summary string")
    links, stories = spark.createDataFrame([], "story_id string, url string"), spark.createDataFrame([], "id string, last_seen timestamp_ntz")
    rows = [("u", "s", "T", text, dt.datetime(2024, 1, 1)) for text in ("One text of an article.", "Two: another text.")]
    for found in (rows, rows[::-1]):
        frame = spark.createDataFrame(found, "url string, story_id string, title string, summary string, ts timestamp_ntz").coalesce(1)
        assert [r.summary for r in discovered_article_upsert(articles, links, stories, frame)[0].collect()] == ["Two: another text."]


def test_page_meta(spark):
    page = '<html><head><link rel="canonical" href="/real?utm_source=q"><meta property="og:description" content="A description of more than forty characters, surely."></head><body><article><p>Text.</p></article></body></html>'
    rows = spark.createDataFrame([(1, "https://a.org/x", page)], "page_id int, url string, html string")
    assert page_canonical_url(rows).first()["canonical_url"] == "https://a.org/real"
    assert page_lede(rows).first()["lede"].startswith("A description")


def test_feed_items(spark, tmp_path):
    items = "".join(f"<item><title>T{k}</title><link>https://a.org/{k}</link><description>&lt;b&gt;D{k}&lt;/b&gt;</description></item>" for k in range(5))
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    rows = feed_items_scan(spark, str(tmp_path), cap=3).orderBy("pos").collect()
    assert [(r["title"], r["snippet"], r["pos"]) for r in rows] == [("T0", "D0", 1), ("T1", "D1", 2), ("T2", "D2", 3)]


def test_diverse_choice_returns_small_pools_whole():
    import pandas as pd

    pool = pd.DataFrame({"id": ["a", "b"], "pinned": [False, False], "urgent": [False, False], "state": [None, None], "audience": [[], []], "source_count": [1, 1], "recent_count": [0, 0], "latest": [dt.datetime(2024, 1, 1)] * 2, "tokens": [["x"], ["x"]], "action": [[], []], "strong": [["x"], ["x"]]})
    assert select_diverse(pool, 5) == ["a", "b"] and select_diverse(pool, 1) == ["a"]


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    from storyloom.streaming.jobs import daily_usage, drained, read_stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(6).write.parquet(str(tmp_path / "events"))
    got = drained(daily_usage(read_stream(spark, str(tmp_path / "events"), files=2)), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, daily_usage(events).collect()))


def test_headlines(spark):
    from storyloom.functions.headline import headline

    cases = {
        "dpscd will not renew charter for barack obama leadership academy": "DPSCD Will Not Renew Charter for Barack Obama Leadership Academy",
        "Illinois bill to ban school cell phone use moves forward": "Illinois Bill to Ban School Cell Phone Use Moves Forward",
        "One School, Nine Students. CA Pays Over $100,000 Per Kid to Keep Small Schools Open": "One School, Nine Students. CA Pays Over $100,000 Per Kid to Keep Small Schools Open",
        "mcmahon: fy 27 proposal continues to shrink bloated bureaucracy": "McMahon: FY 27 Proposal Continues to Shrink Bloated Bureaucracy",
        "Teacher Salaries Average $74.5K Nationally. IS IT Enough?": "Teacher Salaries Average $74.5K Nationally. Is It Enough?",
        "‘Star Trek’ Didn’t Replace Teachers or Ban Screens; nor Should WE": "‘Star Trek’ Didn’t Replace Teachers or Ban Screens; nor Should We",
        "North Carolina Ranks 43RD for Teacher Pay in 2024-25": "North Carolina Ranks 43rd for Teacher Pay in 2024-25",
        "TX district expands K-12 AI policy": "TX District Expands K-12 AI Policy",
        "professional development for IT teams in the age of digital citizenship": "Professional Development for IT Teams in the Age of Digital Citizenship",
        "IN a Minneapolis Public School, a Cure for Toxic Politics": "In a Minneapolis Public School, a Cure for Toxic Politics",
        "Search Underway for Two U.s. Soldiers Missing in Morocco": "Search Underway for Two U.S. Soldiers Missing in Morocco",
    }
    assert values(spark, headline(F.col("t")), [*cases, "", None]) == [*cases.values(), "", ""]


def test_summaries(spark):
    from storyloom.functions.summaries import fallback_summary, hash31, sanitized

    long = "The district board approved a plan that adds buses, lunches and tutors to nine schools next year"
    cases = [f"![x](http://a.b/c) {long} Subscribe to read more", f"{long}. The post Budget appeared first on Paper.", "short", "word " * 40, None, f"See [the plan](https://a.org): {long} at me@a.org"]
    assert values(spark, sanitized(F.col("t")), cases) == [long, f"{long}.", "", "", "", f"See the plan: {long} at"]
    assert values(spark, hash31(F.col("t")), ["", "a", "abc", "polygenelubricants"]) == [0, 97, 96354, 2147483648]
    made = values(spark, fallback_summary(F.col("t")), ["Budget cuts hit nine schools", "Short"])
    assert made[0].startswith(("Budget coverage now centers on budget cuts", "New finance reporting highlights budget cuts", "District budget attention is shifting toward budget cuts")) and "Why it matters" in made[0] and made[1] == ""


def test_entities_and_key_tokens(spark):
    """Entities in canonical form without any of the four kinds of stop words; a story key's words follow the title's."""
    from storyloom.functions import lexicons as L
    from storyloom.functions.tokens import canonical_name
    from storyloom.operators.similarity import entity_tokens, with_tokens

    titles = ["Chicago Schools sue ICE over Raids", "CPS Parents Amid Lawsuit in Springfield", "The Board of Portland and NYC", "Johnson's plan, says Maria", None]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = {r.id: r.e for r in rows.select("id", entity_tokens(F.col("title"), L.GENERIC_TOKENS, L.ACTION_TOKENS).alias("e")).collect()}
    name = lambda w: canonical_name(w, L.CANONICAL_FORMS)
    assert got[1] == [x for x in (name("CPS"), name("Springfield")) if len(x) >= 3] and got[2] == [name("Portland"), name("NYC")] and got[3] == [name("Maria")] and not got[4]
    assert "raid" not in got[0] and name("ICE") in got[0] and "chicago" not in got[0]  # the first word is no entity, an action is none
    stories = spark.createDataFrame([("a", "Storm hits harbour", "harbour-storm-museum"), ("b", "Storm hits harbour", None)], "id string, title string, story_key string").withColumn("last_seen", F.lit(None).cast("timestamp_ntz"))
    tokens = {r.id: r.tokens for r in with_tokens(stories).collect()}
    assert tokens["a"] == [*tokens["b"], "museum"]


def test_pairs_are_made_once_and_not_shuffled(spark):
    """Pairs above a ratio come from one join, each under the first token shared: no exchange on the ids of pairs, not for decisions either."""
    from storyloom.operators.similarity import decided, near_miss_audit, story_key_jaccard

    titles = ["budget vote school board", "school board budget vote delayed", "board vote on school budget", "harbour storm warning", "storm warning for harbour town"]
    rows = spark.createDataFrame([(f"s{k}", t, dt.datetime(2024, 1, 1 + k), 1) for k, t in enumerate(titles)], "id string, title string, last_seen timestamp_ntz, article_count long")
    pairs = overlap_pairs(with_tokens(rows), 5, 0.3)
    found = [(r.i, r.j) for r in pairs.collect()]
    assert len(found) == len(set(found)) and {("s0", "s1"), ("s0", "s2"), ("s1", "s2"), ("s3", "s4")} <= set(found)
    some = [(r.i, r.j) for r in overlap_pairs(with_tokens(rows), 5, 0.3, rows.where("id in ('s1', 's2')").select("id")).collect()]
    assert sorted(some) == sorted(p for p in found if {"s1", "s2"} & set(p))
    for df in (pairs, decided(rows), story_key_jaccard(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("hashpartitioning(i#", "hashpartitioning(j#") if x in plan]
    assert near_miss_audit(decided(rows), rows).count()


def _shuffled(df):
    """Names of the columns that the exchanges of a plan carry."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line for line in lines if "Exchange" in line]


def test_coverage_pairs_are_not_shuffled_and_none_is_lost(spark):
    import random

    random.seed(5)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=random.randrange(400))
    rows = [(i, text(random.randrange(5)) if i % 7 else None, text(random.randrange(12)) if i % 5 else "", at() if i % 11 else None) for i in range(150)]
    articles = spark.createDataFrame(rows, "id long, title string, summary string, ts timestamp").cache()
    stories = spark.createDataFrame([(f"s{i}", *r) for i, *r in rows[:40]], articles.schema.simpleString()[7:-1].replace("id:bigint", "id:string").replace(":", " ")).cache()
    sets = {i: (set(w), set(b), ts) for i, w, b, ts in articles.unionByName(stories.withColumn("id", F.expr("-1 - cast(substr(id, 2) as long)"))).select("id", coverage_tokens(F.coalesce("title", F.lit(""))), coverage_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))), "ts").collect()}

    def like(i, j, hours):
        if sets[i][2] is None or sets[j][2] is None or abs((sets[i][2] - sets[j][2]).total_seconds()) > hours * 3600:
            return -1.0
        return max(round(len(a & b) / min(len(a), len(b)), 3) if a and b else 0.0 for a, b in zip(sets[i][:2], sets[j][:2]))

    for hours, least in ((72, 0.28), (24, 0.5)):
        found = coverage_join(articles, articles, hours, least)
        want = sorted((i, j, like(i, j, hours)) for i in range(150) for j in range(150) if i != j and like(i, j, hours) >= least)
        assert sorted((r.seed, r.cand, round(r.similarity, 3)) for r in found.collect()) == want and want
        mixed = coverage_join(stories, articles, hours, least)
        want = sorted((f"s{-1 - i}", j, like(i, j, hours)) for i in range(-40, 0) for j in range(150) if like(i, j, hours) >= least)
        assert sorted((r.seed, r.cand, round(r.similarity, 3)) for r in mixed.collect()) == want and want
        # What is shuffled are the rows by key, never pairs.
        assert not any("seed" in line or "cand" in line for df in (found, mixed) for line in _shuffled(df))


def test_words_before_patterns_change_no_label(spark):
    """A pattern is tried only where one of its words is; texts of every alternative, in any case, still count."""
    import re

    from storyloom.functions import patterns as P

    samples = [
        "With OVER 20 years of experience", "I have served", "I was a", "Nonresident Fellow", "founder and principal", "About the Author", "this biography", "SUBSCRIBE", "newsletter", "Republish", "sponsored", "partner content",
        "My Classroom", "my students", "my school", "in my class", "I teach", "i use", "I created", "I started", "I love", "I decided", "I tried", "Here are 7 ways", "tips for teachers", "how I", "Running a chess club", "running student clubs and a club",
        "teacher tip", "classroom hack", "lesson idea", "activity idea", "give feedback", "share your thoughts", "take our survey", "Join us", "sign up for", "subscribers of newsletters", "howitzer", "nothing",
    ]
    hit = {s: [p for p in P.GUARDED if re.search(p, s)] for s in samples}
    assert {p for found in hit.values() for p in found} == set(P.GUARDED) == {P.BIOGRAPHY, P.PROMOTION, *P.PERSONAL}
    assert all(any(w in s.lower() for w in P.GUARDED[p]) for s, found in hit.items() for p in found)
    rows = spark.createDataFrame([(k, "A plain title", s, "https://a.org/x-1") for k, s in enumerate(samples)], "id int, title string, summary string, url string")
    for r in article_quality(rows).collect():
        found = hit[samples[r.id]]
        assert ("biography_text_pattern" in r.quality_reasons) == (P.BIOGRAPHY in found) and ("promotional_text_pattern" in r.quality_reasons) == (P.PROMOTION in found)
        assert ("personal_blog_hint" in r.quality_reasons) == (sum(p in found for p in P.PERSONAL) == 1)
