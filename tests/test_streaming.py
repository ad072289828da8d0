"""Streams over several micro-batches against their batch twins: stops and new starts, rows out of order, rows that come too late."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from storyloom.streaming import jobs
from storyloom.streaming.ingest import ingest, stories_of
from storyloom.streaming.jobs import (
    alerts, batches, bins, daily_usage, drained, feed_states, fetches, first_urls, merged_sessions, panes, sent, session_totals, sliding, story_sessions, url_dedupe, window_totals, windowed,
)
from storyloom.streaming.stateful import cooldown, feed_state, first_only, in_order, replayed

AT = dt.datetime(2024, 1, 20)
EVENTS = "event_id long, user_id long, event_type string, ts timestamp_ntz, props string"


def events(seed, n, users=6, hours=240):
    rng = random.Random(seed)
    kinds = ["error", "error", "signup", "click"]
    return [(k, rng.randrange(users), rng.choice(kinds), AT + dt.timedelta(seconds=rng.randrange(hours * 3600)), '{"k": 2}') for k in range(n)]


def landed(spark, path, files, schema=EVENTS):
    """One file a part, in order: files of a stream are taken by the time they were written."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        for name in os.listdir(path):
            if name.endswith(".parquet") and not name.startswith("part-0-"):
                os.utime(os.path.join(path, name), (1_700_000_000 + k, 1_700_000_000 + k))
                os.rename(os.path.join(path, name), os.path.join(path, f"part-0-{k:04d}.parquet"))
    return spark.read.schema(schema).parquet(str(path))


def stream(spark, path, schema=EVENTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def split(rows, parts, seed=None, apart=0):
    """rows in order of time in so many parts; with a seed, rows are moved by up to `apart` hours first."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[3] + dt.timedelta(hours=rng.random() * apart))
    size = -(-len(rows) // parts)
    return [rows[a : a + size] for a in range(0, len(rows), size)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("parts", "seed", "apart"), [(1, None, 0), (7, None, 0), (9, 4, 60)])
def test_keyed_state_over_any_split(spark, tmp_path, parts, seed, apart):
    every = landed(spark, tmp_path / "in", split(events(1, 260), parts, seed, apart))
    for build, step in ((alerts, cooldown(7200)), (lambda e: alerts(e.where("event_type = 'error'")), first_only)):
        got = drained(in_order(build(stream(spark, tmp_path / "in")), step, "3 days"), "update")
        assert rows_of(sent(got)) == rows_of(sent(replayed(build(every), step)))
    got = drained(in_order(fetches(stream(spark, tmp_path / "in")), feed_state, "3 days"), "update")
    assert rows_of(feed_states(got)) == rows_of(feed_states(replayed(fetches(every), feed_state)))


def test_failures_are_counted_over_batches(spark, tmp_path):
    """A success and three failures, one a batch."""
    rows = [(k, 1, "click" if k == 0 else "error", AT + dt.timedelta(hours=k), None) for k in range(4)]
    landed(spark, tmp_path / "in", [[r] for r in rows])
    got = feed_states(drained(in_order(fetches(stream(spark, tmp_path / "in")), feed_state, "1 hour"), "update")).first()
    assert (got.feed_id, got.failures, got.last_error) == (1, 3, "error 3")


def test_idle_keys_are_forgotten(spark, tmp_path):
    """Key 1 fails, is idle for 40 days while key 2 goes on, and fails again: the count starts anew."""
    rows = [(0, 1, "error", AT, None), *[(k, 2, "error", AT + dt.timedelta(days=k), None) for k in range(1, 41)], (99, 1, "error", AT + dt.timedelta(days=40), None)]
    landed(spark, tmp_path / "in", [[rows[0]], rows[1:20], rows[20:40], rows[40:41], rows[41:]])
    got = {r.feed_id: r.failures for r in feed_states(drained(in_order(fetches(stream(spark, tmp_path / "in")), feed_state, "1 day", 10 * 86_400), "update")).collect()}
    assert got == {1: 1, 2: 40}


def test_a_key_of_many_rows_is_not_held(spark, tmp_path):
    """200,000 rows of one key, 2 KB each, in one batch. The step tells how much memory its process has."""

    def resident(state, ts, i, value):
        with open("/proc/self/statm") as f:
            return None, int(f.read().split()[1]) * 4096 // 10**6

    def most(n):
        spark.range(n).select(F.lit(1).alias("key"), F.timestamp_seconds("id").alias("at"), "id", F.concat(F.lit('"'), F.repeat(F.lit("x"), 2000), F.lit('"')).alias("value")).write.parquet(f"{tmp_path}/{n}")
        said = drained(in_order(spark.readStream.schema("key int, at timestamp, id long, value string").parquet(f"{tmp_path}/{n}"), resident, "1 hour"), "update")
        assert said.count() == n
        return said.agg(F.max(F.col("said").cast("int"))).first()[0]

    assert most(200_000) < most(100) + 200


def test_rows_of_no_key_are_one_key(spark, tmp_path):
    rows = [(k, None, "error" if k else "click", AT + dt.timedelta(hours=k), None) for k in range(5)]
    landed(spark, tmp_path / "in", [rows[:3], rows[3:]])
    got = feed_states(drained(in_order(fetches(stream(spark, tmp_path / "in")), feed_state, "1 hour"), "update")).collect()
    assert [(r.feed_id, r.failures, r.last_error) for r in got] == [(None, 4, "error 4")]


def test_panes_against_windows(spark, tmp_path):
    every = landed(spark, tmp_path / "in", split(events(2, 120, 3), 4))
    windows = every.groupBy(F.col("user_id").alias("story"), F.window("ts", "24 hours", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("story", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
    assert rows_of(sliding(panes(every))) == rows_of(windows)
    windowed(stream(spark, tmp_path / "in"), panes, f"file://{tmp_path}/w", "1 day")
    assert rows_of(sliding(window_totals(spark, f"file://{tmp_path}/w", panes))) == rows_of(windows)
    distinct = every.select("user_id", F.window("ts", "30 minutes")).distinct().count()
    assert spark.read.parquet(f"{tmp_path}/w/windows/*").count() <= distinct + 3 * 4  # rows are panes, not events times 48
    assert len(batches(spark, f"file://{tmp_path}/w/seen")) <= 3  # the newest suffices


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    source, path = tmp_path / "landed", f"file://{tmp_path}/windows"
    schema = "event_type string, ts timestamp_ntz, props string"

    def run(hours):
        spark.createDataFrame([("signup", AT + dt.timedelta(hours=h), '{"k": 2}') for h in hours], schema).coalesce(1).write.mode("append").parquet(str(source))
        windowed(spark.readStream.schema(schema).parquet(str(source)), daily_usage, path, "1 day")

    run([0, 1, 30])
    run([2, 31, -48])  # the first and the last are more than a day behind hour 30
    timely = {r["day"]: r["calls"] for r in window_totals(spark, path, daily_usage, late=False).collect()}
    every = {r["day"]: r["calls"] for r in window_totals(spark, path, daily_usage).collect()}
    assert timely == {"2024-01-20": 4, "2024-01-21": 4} and every == {"2024-01-18": 2, "2024-01-20": 6, "2024-01-21": 4}
    batch = {r["day"]: r["calls"] for r in daily_usage(spark.read.schema(schema).parquet(str(source)).withColumn("ts", F.col("ts"))).collect()}
    assert batch == every


@pytest.mark.parametrize("seed", [7, 8])
def test_sessions_over_shuffled_files(spark, tmp_path, seed):
    rows = events(seed, 90, 5, 24 * 40)
    files = split(rows, 6)
    random.Random(seed).shuffle(files)  # most files come too late
    every = landed(spark, tmp_path / "in", files)
    path = f"file://{tmp_path}/s"
    story_sessions(stream(spark, tmp_path / "in"), path, 86_400, "2 days")
    want = every.groupBy(F.col("user_id").alias("story"), F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("story", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
    assert rows_of(session_totals(spark, path)) == rows_of(want)
    assert jobs.of_batches(spark, f"{path}/late").count() > 0 and jobs.of_batches(spark, f"{path}/closed").count() > 0
    assert len(batches(spark, f"{path}/open")) <= 3


def test_a_late_row_joins_two_closed_sessions(spark, tmp_path):
    hours = [[0], [20], [300], [10]]  # 10 lies between the first two, and comes when both are closed
    landed(spark, tmp_path / "in", [[(k, 1, "x", AT + dt.timedelta(hours=h), None) for h in part] for k, part in enumerate(hours)])
    path = f"file://{tmp_path}/s"
    story_sessions(stream(spark, tmp_path / "in"), path, 12 * 3600, "1 day")
    closed = jobs.of_batches(spark, f"{path}/closed")
    assert closed.where("n = 1").count() == 2
    assert rows_of(session_totals(spark, path, 12 * 3600)) == [(1, "2024-01-20 00:00:00", 3), (1, "2024-02-01 12:00:00", 1)]


def test_sessions_hold_to_the_microsecond(spark, tmp_path):
    times = ["2024-01-01 00:00:00.900000", "2024-01-02 00:00:00.100000", "2024-01-03 00:00:00.100000", "2024-01-04 00:00:00.099999"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    story_sessions(stream(spark, tmp_path / "in"), path)
    assert rows_of(session_totals(spark, path)) == [(1, "2024-01-01 00:00:00", 2), (1, "2024-01-03 00:00:00", 2)]


def test_merging_sessions_is_associative(spark):
    rows = spark.createDataFrame(events(3, 80, 3, 24 * 30), EVENTS)
    once = merged_sessions(bins(rows, 40_000), 40_000)
    parts = merged_sessions(bins(rows.where("event_id % 2 = 0"), 40_000), 40_000).unionByName(bins(rows.where("event_id % 2 = 1"), 40_000))
    assert rows_of(merged_sessions(parts, 40_000)) == rows_of(once)


def test_urls_once_and_late_ones_aside(spark, tmp_path):
    schema = "url string, ts timestamp_ntz"
    at = lambda h: AT + dt.timedelta(hours=h)
    files = [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(30)), ("c", at(200))], [("b", at(20)), ("d", at(5)), (None, at(200)), ("c", at(201))], [("c", at(1200)), ("a", at(1201))]]
    landed(spark, tmp_path / "in", files, schema)
    path = f"file://{tmp_path}/u"
    url_dedupe(stream(spark, tmp_path / "in", schema), path, 3)
    got = rows_of(jobs.of_batches(spark, f"{path}/first").select("url", "ts"))
    assert got == sorted([("a", at(0)), ("b", at(1)), ("c", at(200)), ("c", at(1200)), ("a", at(1201))])  # beyond the delay a url is new again
    assert rows_of(jobs.of_batches(spark, f"{path}/late").select("url", "ts")) == sorted([("b", at(20)), ("d", at(5))])
    assert {r.url for r in first_urls(spark, path).collect()} == {"a", "b", "c", "d"}


# --- ingest ---

ITEMS = "id long, url string, title string, summary string, relevance double, ts timestamp_ntz"
WORDS = "council school river budget strike fire election trial storm harbour museum airport winner clinic bridge market protest verdict".split()


def items(seed, n, first=0):
    """Titles of few words, so that many are alike; some urls come again, with another title."""
    rng = random.Random(seed)
    out = []
    for k in range(first, first + n):
        words = rng.sample(WORDS, 4) if rng.random() < 0.6 else ["council", "school", "budget", rng.choice(WORDS)]
        title = " ".join(words) if rng.random() < 0.95 else rng.choice([None, "!!", ""])
        out.append((k, f"https://e.org/{rng.randrange(first + n) if rng.random() < 0.3 else k:04d}", title, "A summary that is long enough to be one, really.", None, AT + dt.timedelta(hours=k * 2)))
    return out


def files_of(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_stories_after_each_batch_equal_the_batch_job(spark, tmp_path):
    source, path = tmp_path / "in", f"file://{tmp_path}/t"
    first = 0
    merged = 0
    for k, n in enumerate((40, 25, 30, 20)):
        spark.createDataFrame(items(k, n, first), ITEMS).coalesce(1).write.mode("append").parquet(str(source))
        first += n
        tables = ingest(spark.readStream.schema(ITEMS).parquet(str(source)), lambda b: b, path, 4)
        articles = tables.articles().cache()
        assert articles.count() == articles.select("url").distinct().count()
        got = rows_of(tables.stories().select("url", "story"))
        assert got == rows_of(stories_of(articles))
        merged += len(got) - len({s for _, s in got})
        articles.unpersist()
    assert merged > 20
    every = spark.read.schema(ITEMS).parquet(str(source))
    last = {r.url: r.title for r in every.groupBy("url").agg(F.max_by("title", "id").alias("title")).collect()}
    assert {r.url: r.title for r in tables.articles().collect()} == last


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    source, path = tmp_path / "in", f"file://{tmp_path}/t"

    def run(rows):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(str(source))
        before = files_of(tmp_path / "t/articles")
        tables = ingest(spark.readStream.schema(ITEMS).parquet(str(source)), lambda b: b, path, 2)
        return tables, before, files_of(tmp_path / "t/articles")

    row = lambda k, title, h: (k, f"https://e.org/{k}", title, "A summary that is long enough to be one, really.", None, AT + dt.timedelta(hours=h))
    run([row(k, f"{WORDS[k % 18]} {WORDS[k % 17]}", 24 * k) for k in range(30)])
    tables, before, after = run([row(100, "another thing", 24 * 29), row(5, "river changed", 24 * 29)])
    assert len(after - before) <= 2 and len(before - after) <= 2  # the partition of url 5's first day, and that of the new url
    assert tables.articles().count() == 31
    assert tables.articles().where("url = 'https://e.org/5'").first().title == "river changed"
    assert rows_of(tables.stories().select("url", "story")) == rows_of(stories_of(tables.articles()))
    # only bins around the batch are read: labels are written for what the batch touches
    assert tables.labels().where("v = 1").count() <= 6


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    """It fails after its articles are written; the next start takes the same batch from its stage."""
    from storyloom.streaming import ingest as module

    source, path = tmp_path / "in", f"file://{tmp_path}/t"
    spark.createDataFrame(items(1, 30), ITEMS).coalesce(1).write.mode("append").parquet(str(source))
    ingest(spark.readStream.schema(ITEMS).parquet(str(source)), lambda b: b, path, 4)
    spark.createDataFrame(items(2, 20, 30), ITEMS).coalesce(1).write.mode("append").parquet(str(source))

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(module, "alike", fails)
    with pytest.raises(Exception, match="lost"):
        ingest(spark.readStream.schema(ITEMS).parquet(str(source)), lambda b: b, path, 4)
    monkeypatch.undo()
    tables = ingest(spark.readStream.schema(ITEMS).parquet(str(source)), lambda b: b, path, 4)
    assert rows_of(tables.stories().select("url", "story")) == rows_of(stories_of(tables.articles()))
    assert tables.articles().count() == tables.articles().select("url").distinct().count()
