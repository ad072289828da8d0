"""Joins of sets in units: copies of a row, brute force over small units, the best of each seed."""

import datetime as dt
import random

from pyspark.sql import functions as F

from storyloom.functions.tokens import coverage_tokens
from storyloom.operators import setjoin
from storyloom.operators.similarity import coverage_join, overlap_pairs, with_tokens

WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]


def _articles(spark, n, longest, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 5))), " ".join(rng.choices(WORDS, k=rng.randrange(longest))), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(300))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, summary string, ts timestamp").cache()


def test_copies_of_a_row_do_not_grow_with_its_set(spark, monkeypatch):
    sent = []
    real = setjoin.dealt
    monkeypatch.setattr(setjoin, "dealt", lambda *x: (sent.append((out := real(*x)).count()), out)[1])
    for longest in (5, 60):
        articles = _articles(spark, 80, longest, 3)
        coverage_join(articles, articles).collect()
        overlap_pairs(with_tokens(articles.select("id", F.concat_ws(" ", "title", "summary").alias("title"), F.col("ts").alias("last_seen"))), 5, 0.3).collect()
    assert len(sent) == 4 and max(sent) <= 80 * (setjoin.STEPS + 2)


def test_the_best_of_each_seed_over_small_units(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HELD", 7)
    found, seeds = _articles(spark, 120, 12, 4), _articles(spark, 30, 12, 5).withColumn("id", F.concat(F.lit("s"), "id"))
    every = [(r.seed, r.cand, r.similarity) for r in coverage_join(seeds, found, 100, 0.1).collect()]
    some = [(r.seed, r.cand, r.similarity) for r in coverage_join(seeds, found, 100, 0.1, 3).collect()]
    sets = lambda df: [(r.id, (set(r.w), set(r.b)), r.ts) for r in df.select("id", "ts", coverage_tokens(F.col("title")).alias("w"), coverage_tokens(F.concat_ws(" ", "title", "summary")).alias("b")).collect()]
    half_up = lambda a, b: (2000 * len(a & b) + min(len(a), len(b))) // (2 * min(len(a), len(b))) / 1000 if a and b else 0
    want = [(s, c, max(half_up(a, b) for a, b in zip(x, y))) for s, x, t in sets(seeds) for c, y, u in sets(found) if abs((t - u).total_seconds()) <= 100 * 3600]
    assert sorted(every) == sorted(x for x in want if x[2] >= 0.1)
    best = lambda rows: {s: sorted((-v, c) for t, c, v in rows if t == s)[:3] for s, *_ in rows}
    assert best(some) == best(every) and set(some) <= set(every) and len(some) < len(every)


def test_a_plan_reads_pairs_that_merge_and_passes_store_no_others(spark, monkeypatch):
    from storyloom.operators.graphs import merge_plan
    from storyloom.operators.similarity import decided
    from storyloom.plans import products

    rng = random.Random(8)
    words = "council school budget strike vote election trial lawsuit museum clinic closure teacher probe ban".split()
    rows = [(f"s{k:03d}", " ".join(rng.sample(words, rng.choice((2, 4, 6, 7)))), "active", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(300)), 1 + k % 3) for k in range(90)]
    stories = spark.createDataFrame(rows, "id string, title string, status string, first_seen timestamp_ntz, last_seen timestamp_ntz, article_count long").withColumn("summary", F.col("title"))
    for theta in (0.56, 0.9):
        every = decided(stories, theta).cache()
        some = decided(stories, theta, alike=True).cache()
        assert sorted(map(tuple, some.where("should_merge").collect())) == sorted(map(tuple, every.where("should_merge").collect())) and some.count() < every.count()
        assert sorted(map(tuple, merge_plan(stories, some).collect())) == sorted(map(tuple, merge_plan(stories, every).collect()))
    kept = []
    real = products.stored
    monkeypatch.setattr(products, "stored", lambda df: (kept.append((out := real(df))), out)[1])
    _, _, counts = products.merge_passes(stories, spark.createDataFrame([("s001", 1)], "story_id string, article_id long"), lambda t, touched: decided(t, 0.9, touched=touched), 1)
    assert counts == [every.count()] and kept[0].count() == every.where("should_merge").count() < counts[0]
