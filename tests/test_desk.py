"""The desk's sequential rules against plain loops, and literal cases of what the lists read."""

import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyloom import catalog
from storyloom.functions.summaries import display_summary, low_quality
from storyloom.functions.tokens import search_query, topic_tokens
from storyloom.operators.events import parse_blurb
from storyloom.operators.selection import near_duplicate, select_diverse
from storyloom.plans.desk import corroboration_match, gate_pass, guardrail_alerts, is_aggregator, single_source_audit
from storyloom.plans.homepage import Rules
from storyloom.sources.pages import feed_items_scan, generic_link_text, likely_article_path, title_from_url

AT = dt.datetime(2024, 1, 20)


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_corroboration_in_order(spark):
    """The cascade, its dynamic families and its end after two links, against a loop over each seed's candidates."""
    rng = random.Random(6)
    words = [f"w{k:02d}x" for k in range(14)]
    seeds = [(f"s{k}", " ".join(rng.sample(words, 6)), "", AT + dt.timedelta(hours=rng.randrange(60)), [rng.choice("ab")]) for k in range(12)]
    found = [
        (k, "https://n.org/x" if rng.random() < 0.95 else None, rng.choice(("n.org",) * 12 + ("msn.com", "sub.yahoo.com")), " ".join(rng.sample(words, 6)), rng.choice(("lede",) * 9 + ("",)), AT + dt.timedelta(hours=rng.randrange(-30, 110)),
         rng.choice("abcd"), rng.choice(("article",) * 7 + ("non_article",)), rng.random() < 0.95, rng.random() < 0.95, rng.random() < 0.05, rng.choice(([],) * 9 + (["s1"], ["zz"])))
        for k in range(80)
    ]
    left = spark.createDataFrame(seeds, "id string, title string, summary string, ts timestamp_ntz, families array<string>")
    right = spark.createDataFrame(found, "id long, url string, domain string, title string, summary string, ts timestamp_ntz, family string, quality_label string, us boolean, strict_signal boolean, off_topic boolean, stories array<string>")
    got = corroboration_match(left, right, Rules(states=[]), least=0.4).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["place"]):
        by.setdefault(r["seed"], []).append(r)
    assert max(len(x) for x in by.values()) == 8 and sum(r["reason"] == "linked" for r in got) > 5
    at, of = {s[0]: s for s in seeds}, {f[0]: f for f in found}
    for seed, rows in by.items():
        families, links = set(at[seed][4]), 0
        for r in rows:
            _, url, host, _, lede, ts, fam, label, us, strict, off, stories = of[r["cand"]]
            if links == 2:
                want = "unchecked"
            elif not url or host in ("msn.com", "sub.yahoo.com"):
                want = "candidate_filtered_quality"
            elif seed in stories:
                want = "candidate_canonical_duplicate"
            elif stories:
                want = "candidate_in_different_cluster"
            elif not lede:
                want = "candidate_filtered_quality"
            elif fam in families:
                want = "candidate_source_family_duplicate"
            elif label == "non_article":
                want = "candidate_filtered_quality"
            elif not us or off or not strict:
                want = "candidate_filtered_relevance"
            elif abs((at[seed][3] - ts).total_seconds()) > 72 * 3600:
                want = "candidate_time_window_mismatch"
            elif r["similarity"] < 0.4:
                want = "candidate_similarity_too_low"
            else:
                want, links = "linked", links + 1
                families.add(fam)
            assert r["reason"] == want, (seed, r, fam, families)
    audit = {r["seed"]: r for r in single_source_audit(left.withColumn("skipped", F.expr("if(id = 's0', 'no', null)")), spark.createDataFrame(got).where("seed <> 's0'")).collect()}
    assert len(audit) == 12 and audit["s0"]["skipped"] == "no" and all(audit[s]["linked"] == sum(r["reason"] == "linked" for r in rows) for s, rows in by.items() if s != "s0")


def test_gate_saturation_counts_pinned_and_well_covered(spark):
    rows = [("a", 1, "A", "active", 1, 2, 3, AT, "ohio"), ("b", 2, "B", "active", 1, 2, 3, AT, "ohio"), ("c", 3, "C", "pinned", 1, 2, 3, AT, "ohio"), ("d", 4, "D", "active", 3, 2, 3, AT, "ohio"), ("e", 5, "What to know: E", "active", 1, 2, 3, AT, "utah"), ("f", 6, "F", "active", 1, 0, 1, AT - dt.timedelta(hours=80), "utah"), ("g", 7, "G", "active", 1, 2, 3, AT, "utah")]
    top = spark.createDataFrame(rows, "id string, rank int, title string, status string, source_count long, recent_count long, article_count long, latest_at timestamp_ntz, state string")
    outliers = spark.createDataFrame([("g", 5, 2, 2)], "story_id string, n long, state_n long, entity_n long")
    got = {r["id"]: r["reasons"] for r in gate_pass(top, outliers, str(AT)).collect()}
    assert got == {"b": ["state_saturation:ohio"], "e": ["roundup_single_source_top_slot"], "f": ["thin_single_source_top_slot", "stale_top10:80h"], "g": ["state_mismatch_articles:2/5", "entity_conflict_articles:2/5"]}


def test_alerts():
    n = {"mergedStories": 90, "grouped": 100, "mixedStoryOutliers": 3, "mixedStoriesSplit": 12}
    assert guardrail_alerts(n) == ["high_merge_count:90", "high_merge_ratio:0.90", "mixed_splits:12"]


def row(i, tokens, **more):
    base = {"id": i, "pinned": False, "urgent": False, "state": None, "topic": "general", "audience": [], "hint": False, "source_count": 2, "recent_count": 1, "latest": AT, "tokens": tokens.split(), "action": [t for t in tokens.split() if t == "vote"], "strong": [t for t in tokens.split() if t != "vote"]}
    return {**base, **more}


def test_diverse_choice():
    pool = [row(1, "a b vote", state="ohio"), row(2, "a b vote c"), row(3, "d e", state="ohio", source_count=1), row(4, "f g", audience=["teachers"], source_count=1), row(5, "h i", audience=["teachers"], source_count=1), row(6, "j k"), row(7, "l m", pinned=True)]
    assert select_diverse(pd.DataFrame(pool), 5) == [7, 1, 4, 6, 5]  # 2 tells of 1's event, 3 is of its state, 5 only fills up
    news = [*pool[:1], row(2, "a b vote c", hint=True, source_count=3, latest=AT + dt.timedelta(hours=7)), *pool[2:]]
    assert 2 in select_diverse(pd.DataFrame(news), 6) and 2 not in select_diverse(pd.DataFrame(pool), 6)
    assert select_diverse(pd.DataFrame(pool), 7) == [1, 2, 3, 4, 5, 6, 7]


def test_near_duplicates():
    assert near_duplicate("The board  votes", "the BOARD votes") and near_duplicate("district leaders approve budget tonight", "District leaders approve a budget, tonight again") and not near_duplicate("a b c", "d e f")


def test_blurbs(spark):
    bodies = ['```json\n{"headline": "Board votes", "summary": "It was close."}\n```', "**Headline:** Board votes\n**Summary:** It was close.\nVery close.", "Board votes\nIt was close.", "Board votes today. It was close.", "UNUSABLE", "One line only", None]
    got = values(spark, parse_blurb(F.col("t")), bodies)
    assert [r and (r["headline"], r["summary"]) for r in got] == [("Board votes", "It was close."), ("Board votes", "It was close. Very close."), ("Board votes", "It was close."), ("Board votes today.", "Board votes today. It was close."), None, None, None]


def test_links_and_hosts(spark):
    assert values(spark, is_aggregator(F.col("t")), ["news.google.com", "www.msn.com", "uk.finance.yahoo.com", "apnews.com", None]) == [True, True, True, False, False]
    assert values(spark, title_from_url(F.col("t")), ["https://a.org/news/budget-vote_passes.html", "https://a.org/x%20y-z", "https://a.org", "https://a.org/a%zz-b"])[:3] == ["Budget Vote Passes", "X Y Z", ""]
    assert values(spark, generic_link_text(F.col("t")), ["Read more about the story", "A long enough link text", "short", None]) == [True, False, True, True]
    assert values(spark, likely_article_path(F.col("t")), ["/news/2024/05/x", "/sports", "/tag/x-y", "/a-story-of-it", "/a-picture.jpg", "/", "/news/latest"]) == [True, False, False, True, False, False, True]


def test_search_queries_and_topics(spark):
    assert values(spark, search_query(F.col("t")), ["The teachers' strike leaves Ohio classes empty, says union", ""]) == ["strike leave ohio class empty say union", ""]
    assert values(spark, F.array_join(topic_tokens(F.col("t")), " "), ["LAUSD teachers sued over 12 closures", "LA funds K-12"]) == ["lausd los angel unifi lawsuit 12 closure", "los angel funding k12"]


def test_summaries(spark):
    good = "The board approved a budget for next year after a debate of four hours on Monday."
    texts = [good, "Too short.", "Subscribe to our newsletter for more of this kind of news each and every day", "New coverage highlights the board's budget for the next year and more of it", good + " The post Budget appeared first on The Paper.", None]
    assert values(spark, display_summary(F.col("t")), texts) == [good, None, None, None, good, None]
    assert values(spark, low_quality(F.col("t")), [good, "Too short.", None]) == [False, True, True]


def test_atom_feeds_and_caps(spark, tmp_path):
    entry = lambda k: f'<entry><title>Title {k}</title><link rel="self" href="https://e.org/self"/><link href="https://e.org/{k}"/><summary>Text &lt;b&gt;{k}&lt;/b&gt;</summary><updated>2024-01-0{k}</updated></entry>'
    (tmp_path / "atom.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom">{"".join(map(entry, range(1, 6)))}</feed>')
    (tmp_path / "discovery.xml").write_text("<rss><channel>" + "".join(f"<item><title>Item {k}</title><link>https://d.org/{k}</link></item>" for k in range(6)) + "</channel></rss>")
    got = feed_items_scan(spark, str(tmp_path), cap=4, discovery_cap=2, discovery="discovery").collect()
    assert sorted((re.sub(".*/", "", r["feed"]), r["pos"], r["title"], r["link"]) for r in got) == [*(("atom.xml", k, f"Title {k}", f"https://e.org/{k}") for k in range(1, 5)), *(("discovery.xml", k + 1, f"Item {k}", f"https://d.org/{k}") for k in range(2))]
    assert {r["snippet"] for r in got if r["feed"].endswith("atom.xml")} == {f"Text {k}" for k in range(1, 5)}


def test_known_urls_are_updated_and_new_ones_inserted(spark):
    """Of items with one url the latest counts; a known url keeps its id and source."""
    from storyloom.plans.desk import taken_in

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "id long, url string, title string, summary string, source_id long, ts timestamp_ntz, lang string"
    long = "A summary that is long enough to be one, of a council that met and voted."
    articles = spark.createDataFrame([(1, "u1", "Old one", long, 7, at(0), "en"), (2, "u2", "Old two", "Short.", 8, at(1), "en"), (3, "u3", "Old three", long, 9, at(2), "en")], schema)
    items = spark.createDataFrame([(11, "u1", "New one", "", 70, at(5), "en"), (12, "u2", "Newer two", long, 80, at(7), "en"), (13, "u2", "New two", long + " More.", 80, at(6), "en"), (14, "u4", "Four", long, 90, at(4), "de"), (15, "u4", "Four again", long, 90, at(4), "de")], schema)
    got = {r.url: tuple(r) for r in taken_in(articles, items).collect()}
    assert got == {
        "u1": (1, "u1", "New one", long, 7, at(5), "en", "updated"), "u2": (2, "u2", "Newer two", long, 8, at(7), "en", "updated"), "u3": (3, "u3", "Old three", long, 9, at(2), "en", "kept"), "u4": (15, "u4", "Four again", long, 90, at(4), "de", "inserted"),
    }


def test_primaries_stay_where_their_story_stays(spark):
    from storyloom.plans.desk import run_events, with_primaries

    before = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, True)], "story_id string, article_id long, is_primary boolean")
    after = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "story_id string, article_id long")  # b went into a
    assert sorted(map(tuple, with_primaries(after, before).collect())) == [("a", 1, True), ("a", 2, False), ("a", 3, False)]
    gate = spark.createDataFrame([("a", 1, 0, "thin")], "story_id string, rank int, state_n long, reasons string")
    events = run_events({"inserted": 2}, ["high_merge_count:90"], gate, after.where("article_id = 3"), "2024-01-02 00:00:00").collect()
    assert sorted((r.event_type, r.story_id) for r in events) == sorted([("ingest_run", None), ("grouping_guardrail", None), ("publish_gate", "a"), ("corroboration_linked", "a")], key=repr) or len(events) == 4
    assert {r.created_at for r in events} == {dt.datetime(2024, 1, 2)} and any('"inserted": 2' in r.detail for r in events)


@pytest.mark.parametrize("name", ["publish_gate", "diverse_selection"])
def test_the_board_is_made_once(spark, name):
    """The ranked rows are stored: no reader of them cleans and ranks all stories again."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("originally published") == 0
