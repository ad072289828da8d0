"""Rollups from cells, and classes by dictionary, against whole aggregates and plain loops."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L
from storyloom.operators.dictionary import first_class, terms_table
from storyloom.operators.partials import added, cells, merged, removed, rollup
from storyloom.operators.rollups import story_rollup

AT = "2024-01-20 00:00:00"
LINKS = "story_id long, article_id long, source_id long, ts timestamp_ntz"


def rows_of(df):
    return sorted(map(repr, df.select("story_id", "article_count", "source_count", "family_count", "recent_count", "avg_weight", "latest_at").collect()))


def test_cells_after_inserts_merges_and_deletes(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 10)
    links = [(rng.randrange(12) if rng.random() < 0.7 else 0, k, rng.choice([1, 2, 3, 4, 99, None]), start + dt.timedelta(minutes=rng.randrange(14_000))) for k in range(300)] + [(1, 300, 1, None)]
    sources = spark.createDataFrame([(1, "a.example.org", 1.2), (2, "b.example.org", None), (3, "c.test.com", 0.7), (4, None, 1.0)], "id long, domain string, weight double")
    frame = lambda rows: spark.createDataFrame(rows, LINKS)
    table = cells(frame(links[:100]))
    for a in (100, 200):
        table = added(table, cells(frame(links[a : a + 100] if a < 200 else links[a:])))
    check = lambda t, rows: [rows_of(rollup(t, sources, AT, h, d)) == rows_of(story_rollup(frame(rows), sources, AT, h, d)) for h, d in ((24, None), (72, 5))]
    assert all(check(table, links))
    gone = set(rng.sample(range(300), 60))
    left = [r for r in links if r[1] not in gone]
    table = removed(table, frame([r for r in links if r[1] in gone]), frame(left))
    assert all(check(table, left))
    into = {5: 0, 7: 0, 11: 2, 3: 9}
    table = merged(table, spark.createDataFrame(list(into.items()), "source long, target long"))
    assert all(check(table, [(into.get(r[0], r[0]), *r[1:]) for r in left]))
    with pytest.raises(ValueError, match="whole hours"):
        rollup(table, sources, "2024-01-20 00:30:00")


def test_a_delta_reads_the_table_once(spark, tmp_path):
    """each delta read the table anew several times, so a chain of them multiplied the work."""
    rows = spark.createDataFrame([(k % 5, k, k % 3, dt.datetime(2024, 1, 10)) for k in range(20)], LINKS)
    cells(rows).write.parquet(f"file://{tmp_path}/t")
    table, more = spark.read.parquet(f"file://{tmp_path}/t"), cells(rows.where("story_id < 2"))
    chain = merged(added(added(table, more), more), spark.createDataFrame([(3, 0)], "source long, target long"))
    assert chain._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert {(r.story_id, r.n) for r in chain.groupBy("story_id").agg(F.sum("n").alias("n")).collect()} == {(0, 4 * 3 + 4), (1, 4 * 3), (2, 4), (4, 4)}


def test_first_class_is_that_of_the_table_in_its_order(spark):
    texts = [
        "Virginia Beach vs West Virginia", "Kansas City schools", "New York City and Boston", "A day in washington d.c.", "Washington State tops", "Washington", "DC and Ohio", "newyork", None, "", "St. Paul, St. Louis", "Los  Angeles\nlausd", "Mainely a kansas-city story",
        "the and north",
    ]

    def plain(text):
        padded = f" {re.sub('[^a-z0-9]+', ' ', (text or '').lower()).strip()} "
        return next((state for state, *names in L.STATES if any(f" {n} " in padded for n in names)), None)

    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r["class"] for r in first_class(frame, terms_table(spark, L.STATES)).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)} and got[1] == "kansas" and got[0] == "virginia" and got[5] is None
    assert {r["class"] for r in first_class(frame, terms_table(spark, [])).collect()} == {None}
    assert [r["class"] for r in first_class(frame.limit(0), terms_table(spark, L.STATES)).collect()] == []
    assert len(L.STATES) == 51


def test_runs_of_words_are_not_shuffled(spark, monkeypatch):
    """the runs of all texts went through the join's shuffle. What is left is a shuffle of hits and two of ids; more terms are shuffled, with the same classes."""
    texts = spark.range(50).select("id", F.concat(F.lit("north of  the-and "), "id", F.lit(" new york city x")).alias("text"))
    terms = [["a", "york city x"], ["b", "the and"], ["c", "30", "new york city x"]]
    sent = first_class(texts, terms_table(spark, terms))
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().sparkPlan().toString() and "SortMergeJoin [term" not in sent._jdf.queryExecution().sparkPlan().toString()
    assert {r["class"] for r in sent.collect()} == {"a"}
    monkeypatch.setattr("storyloom.operators.dictionary.SENT", 2)
    assert rows_by_id(first_class(texts, terms_table(spark, terms))) == rows_by_id(sent)


def rows_by_id(df):
    return sorted(map(tuple, df.collect()))
