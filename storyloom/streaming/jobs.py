"""Structured Streaming jobs over landed files, each equal to its batch twin on the same input.

Late data: a job's delay is a parameter; rows that come later than that after the newest one of earlier batches go to a side table, which the
batch job adds. What a job knows of earlier batches is on storage or in keyed state, so it goes on after a restart, and a batch that runs again
writes the same folders again. Each query here runs its stream with an available-now trigger and returns what its sink holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.operators.graphs import shared_folder
from storyloom.registry import ORACLE, QUERIES
from storyloom.sources.views import duck
from storyloom.streaming.stateful import InOrder, apart, cooldown, feed_state, first_only, held_schema, in_order, last_of_key, newest, replayed, said_schema, settling


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Landed Parquet files as a stream, in batches of so many files if given."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern, as the source takes a plain path for a folder
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(pattern)


def drained(stream: DataFrame | InOrder, mode: str = "append") -> DataFrame:
    """What a stream has written once all landed input is taken. In complete mode each batch replaces what was there."""
    if isinstance(stream, InOrder):
        spark = stream.rows.sparkSession
        out = folder(spark)
        stepped(stream, out)
        return of_batches(spark, f"{out}/said") if batches(spark, f"{out}/said") else spark.createDataFrame([], said_schema(stream.rows))
    spark = stream.sparkSession
    out = folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{out}/rows").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path] if mode == "complete" else [*last, path]

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(*last) if last else spark.createDataFrame([], stream.schema)


def each_batch(stream: DataFrame, path: str, take: Callable[[DataFrame, int], None]) -> None:
    """Runs take over all landed batches, with its place in the stream kept below path."""
    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()


def batches(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Numbers of the complete batch folders below path, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath() for f in system.listStatus(at)] if system.exists(at) else []
    done = [int(p.getName()[6:]) for p in names if p.getName().startswith("batch=") and system.exists(p.suffix("/_SUCCESS"))]
    return sorted(k for k in done if before is None or k < before)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def carried(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What the newest batch before this one has left at path. Older folders go: one is enough for a batch that runs again."""
    earlier = batches(spark, path, number)
    for k in earlier[:-2]:
        remove(spark, f"{path}/batch={k}")
    return spark.read.parquet(f"{path}/batch={earlier[-1]}") if earlier else None


def of_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that batches have left at path."""
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={k}" for k in batches(spark, path))).drop("batch")


def by_lateness(batch: DataFrame, path: str, number: int, delay: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(timely, late, seen) of a batch with a column ts: late is more than the delay behind the newest row of earlier batches; seen (ts) is the
    newest row with this batch. Rows without a time are timely. `seen` is to be written to {path}/seen/batch={number} last of all."""
    before = carried(batch.sparkSession, f"{path}/seen", number)
    at = before.first()[0] if before is not None else None
    late = F.lit(False) if at is None else F.coalesce(F.col("ts") < F.lit(at) - F.expr(f"INTERVAL {delay}"), F.lit(False))
    return batch.where(~late), batch.where(late), batch.agg(F.greatest(F.max("ts"), F.lit(at).cast(batch.schema["ts"].dataType)).alias("ts"))


def stepped(todo: InOrder, path: str) -> None:
    """A stream in order into `said` (what is new about rows, with the batch as version) and `held` (states and open rows, of the newest batch
    only) below path. What a batch reads is itself and what is held."""
    spark, span = todo.rows.sparkSession, F.expr(f"INTERVAL {todo.delay}")

    def take(batch: DataFrame, number: int) -> None:
        timely, _, seen = by_lateness(batch, path, number, todo.delay)
        rows = timely.select("key", F.unix_seconds("ts").alias("ts"), "id", "value", F.lit(None).cast("string").alias("said"), F.lit(None).cast("long").alias("newest"))
        before, held = carried(spark, f"{path}/seen", number), carried(spark, f"{path}/held", number)
        if held is not None:
            idle = None if todo.idle is None else before.select(F.unix_seconds(F.col("ts") - span)).first()[0]
            rows = rows.unionByName(held if idle is None else held.where(F.coalesce(F.col("newest") + todo.idle >= idle, F.lit(True))))
        at, below = seen.select("ts", F.unix_seconds(F.col("ts") - span)).first()
        schema = held_schema(rows).add("held", "boolean").add("new", "boolean")
        ordered = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("newest"), "ts", "id")
        ordered.mapInArrow(settling(todo.step, -(2**63) if below is None else below), schema).write.mode("overwrite").parquet(f"{path}/stage")
        stage = spark.read.parquet(f"{path}/stage")
        stage.where("new").select("key", "ts", "id", "said", F.lit(number).cast("long").alias("version")).write.mode("overwrite").parquet(f"{path}/said/batch={number}")
        stage.where("held").drop("held", "new").write.mode("overwrite").parquet(f"{path}/held/batch={number}")
        spark.range(1).select(F.lit(at).cast("timestamp").alias("ts")).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        remove(spark, f"{path}/stage")

    each_batch(todo.rows, path, take)


def windowed(events: DataFrame, counts: Callable[[DataFrame], DataFrame], path: str, delay: str = "7 days") -> None:
    """A stream of events (ts, ...) into `windows` (what counts makes of each batch, to be summed) and `late` (events that came too late) below
    path. Nothing is held in memory between batches."""

    def take(batch: DataFrame, number: int) -> None:
        timely, late, seen = by_lateness(batch, path, number, delay)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        counts(timely).write.mode("overwrite").parquet(f"{path}/windows/batch={number}")
        seen.write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    each_batch(events, path, take)


def window_totals(spark: SparkSession, path: str, counts: Callable[[DataFrame], DataFrame], late: bool = True) -> DataFrame:
    """The sums of all batches, and of the late events if asked for."""
    parts = of_batches(spark, f"{path}/windows")
    if late:
        parts = parts.unionByName(counts(of_batches(spark, f"{path}/late")))
    *keys, value = parts.columns
    return parts.groupBy(*keys).agg(F.sum(value).alias(value))


def daily_usage(events: DataFrame) -> DataFrame:
    """(day, calls) in tumbling days."""
    return events.where("event_type = 'signup'").groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum(F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(1))).alias("calls")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "calls")


#: Seconds of a pane, and panes of a window that slides by one: 24 hours by 30 minutes.
PANE, PANES = 1800, 48


def panes(events: DataFrame, pane: int = PANE) -> DataFrame:
    """(story, pane, n): counts in panes that do not overlap, by number since 1970. What a shuffle sees of an event is its pane."""
    return events.where("ts is not null").groupBy(F.col("user_id").alias("story"), F.floor(seconds() / pane).alias("pane")).agg(F.count("*").alias("n"))


def sliding(counts: DataFrame, pane: int = PANE, length: int = PANES) -> DataFrame:
    """(story, start, n): sums over windows of `length` panes that slide by one, from (story, pane, n); windows without a count are left out.

    A pane counts from the window that it ends to the one that it begins, so it is one step up and one step down. Their running sum along a
    story holds between two steps, and only what is written is spread over the windows there. A story has at most two rows a pane.
    """
    steps = counts.select("story", F.explode(F.array(F.struct((F.col("pane") - (length - 1)).alias("at"), F.col("n").alias("d")), F.struct((F.col("pane") + 1).alias("at"), (-F.col("n")).alias("d")))).alias("s")).select("story", "s.*")
    steps = steps.groupBy("story", "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("story").orderBy("at")
    level = steps.select("story", "at", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("at").over(order).alias("next")).where("n > 0")
    starts = level.select("story", "n", F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("at"))
    return starts.select("story", F.date_format(F.timestamp_seconds(F.col("at") * pane), "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _windows(counts: Callable[[DataFrame], DataFrame], after: Callable[[DataFrame], DataFrame] = lambda x: x) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        windowed(_events(s, d), counts, path)
        return after(window_totals(s, path, counts))

    return run


def url_dedupe(items: DataFrame, path: str, days: int = 60) -> None:
    """A stream of items (url, ts) into `first` and `late` below path: a row is passed on unless its url was within so many days before it; rows
    that many days behind the newest one are late.

    A batch is held against the rows passed on in days that the delay still reaches, by partition, and only its own urls are taken from these.
    """
    spark = items.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        timely, late, seen = by_lateness(batch.where("ts is not null and url is not null"), path, number, f"{days} days")
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        rows = timely.select("url", "ts").distinct()
        earlier, known = batches(spark, f"{path}/first", number), None
        if earlier:
            at = carried(spark, f"{path}/seen", number).first()[0]
            known = spark.read.option("basePath", f"{path}/first").parquet(*(f"{path}/first/batch={k}" for k in earlier)).where(F.col("day") >= F.to_date(F.lit(at) - F.expr(f"INTERVAL {2 * days} days")))
            known = known.join(rows.select("url").distinct(), "url", "left_semi").select("url", F.col("ts").alias("before"))
            near = (F.col("ts") > F.col("before") - F.expr(f"INTERVAL {days} days")) & (F.col("ts") < F.col("before") + F.expr(f"INTERVAL {days} days"))
            rows = rows.join(known, (rows["url"] == known["url"]) & near, "left_anti")
        said = replayed(rows.select(F.col("url").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("id"), F.lit(None).cast("string").alias("value")), apart(days * 86_400))
        first = said.where("said = 'true'").select(F.col("key").alias("url"), F.timestamp_micros("id").cast("timestamp_ntz").alias("ts"))
        first.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/first/batch={number}")
        seen.write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    each_batch(items, path, take)


def first_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, ts): the stream's rows, and those of urls that only came late."""
    every = of_batches(spark, f"{path}/first").select("url", "ts")
    late = of_batches(spark, f"{path}/late").groupBy("url").agg(F.min("ts").alias("ts"))
    return every.unionByName(late.join(every, "url", "left_anti").select("url", "ts"))


def bins(events: DataFrame, gap: int) -> DataFrame:
    """(story, first, last, n) in microseconds: rows of one bin of `gap` seconds belong to one session for sure, so they are one row from here on."""
    at = micros()
    rows = events.where("ts is not null").select(F.col("user_id").alias("story"), at.alias("at"))
    return rows.groupBy("story", F.expr(f"at div {gap * 1_000_000}").alias("bin")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).drop("bin")


def merged_sessions(parts: DataFrame, gap: int) -> DataFrame:
    """Parts of sessions (story, first, last, n), put together where less than `gap` seconds lie between them."""
    order = Window.partitionBy("story").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("first") - before < gap * 1_000_000, 0).otherwise(1)
    numbered = parts.withColumn("new", new).withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("story", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("k")


def story_sessions(events: DataFrame, path: str, gap: int = 86_400, delay: str = "7 days") -> None:
    """A stream of events (user_id, ts) into `closed` (sessions that no timely row can join any more), `open` (the others, of the newest batch
    only) and `late` (rows later than the delay) below path. What a batch reads is itself and the open sessions."""
    spark = events.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        timely, late, seen = by_lateness(batch, path, number, delay)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        parts, before = bins(timely, gap), carried(spark, f"{path}/open", number)
        whole = merged_sessions(parts if before is None else parts.unionByName(before), gap).persist()
        below = seen.select(micros(f"ts - INTERVAL {delay}")).first()[0]
        done = F.lit(False) if below is None else F.col("last") + gap * 1_000_000 <= below
        whole.where(done).write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        whole.where(~done).write.mode("overwrite").parquet(f"{path}/open/batch={number}")
        whole.unpersist()
        seen.write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    each_batch(events, path, take)


def session_totals(spark: SparkSession, path: str, gap: int = 86_400) -> DataFrame:
    """(story, start, n): closed and open sessions; in stories with late rows all are put together anew, as one may join two sessions."""
    last = batches(spark, f"{path}/open")[-1]
    every = of_batches(spark, f"{path}/closed").unionByName(spark.read.parquet(f"{path}/open/batch={last}"))
    late = bins(of_batches(spark, f"{path}/late"), gap)
    touched = late.select("story").distinct()
    again = merged_sessions(every.join(touched, "story", "left_semi").unionByName(late), gap)
    out = every.join(touched, "story", "left_anti").unionByName(again)
    return out.select("story", F.date_format(F.timestamp_micros("first"), "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def seconds(column: str = "ts"):  # noqa: ANN201
    """Whole seconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def micros(column: str = "ts"):  # noqa: ANN201
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def _register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str, views: str = "") -> None:
    QUERIES[name] = build
    ORACLE[name] = duck(views, sql)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_stream(spark, f"{d}/events.parquet")


_register("stream_daily_usage", _windows(daily_usage), "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 1)) AS BIGINT) AS calls FROM events WHERE event_type = 'signup' GROUP BY 1")
_register(
    "stream_recent_counts", _windows(panes, sliding),
    """SELECT user_id AS story, strftime(time_bucket(INTERVAL 30 MINUTES, ts, TIMESTAMP '1970-01-01') - to_minutes(30 * k), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (SELECT unnest(range(0, 48)) AS k) GROUP BY 1, 2""",
)


def _first_urls(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    url_dedupe(_events(s, d).select(F.concat(F.lit("https://e.org/"), "user_id").alias("url"), "ts"), path)
    return first_urls(s, path).select("url")


_register("stream_url_dedupe", _first_urls, "SELECT DISTINCT concat('https://e.org/', user_id) AS url FROM events")


def _sessions(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    story_sessions(_events(s, d), path)
    return session_totals(s, path)


_register(
    "stream_story_sessions", _sessions,
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id AS story, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)


def alerts(events: DataFrame) -> DataFrame:
    """Rows of in_order() from events: an alert of each user with its type as fingerprint."""
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("value"))


def fetches(events: DataFrame) -> DataFrame:
    """Rows of in_order() from events: a fetch of each feed, with [success, error]."""
    value = F.when(F.col("event_type") == "error", F.concat(F.lit('[false, "error '), F.col("event_id") % 7, F.lit('"]'))).otherwise("[true, null]")
    return events.select((F.col("user_id") % 20).alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), value.alias("value"))


def sent(said: DataFrame) -> DataFrame:
    """(key, id) of the rows that the last word is true of."""
    return newest(said).where("said = 'true'").select("key", "id")


def feed_states(said: DataFrame) -> DataFrame:
    """(feed_id, failures, last_error, last_success) after each feed's last row."""
    state = F.from_json(F.col("said"), "array<string>")
    return last_of_key(said).select(F.col("key").alias("feed_id"), state[0].cast("long").alias("failures"), state[1].alias("last_error"), state[2].cast("long").alias("last_success"))


_register(
    "stream_alert_cooldown", lambda s, d: sent(drained(in_order(alerts(_events(s, d)), cooldown(86_400), idle=400 * 86_400), "update")),
    """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, event_type AS f, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events),
    r AS (SELECT key, id, n, f, t, true AS sent FROM e WHERE n = 1 UNION ALL SELECT e.key, e.id, e.n, CASE WHEN r.f <> e.f OR e.t - r.t >= 86400 THEN e.f ELSE r.f END, CASE WHEN r.f <> e.f OR e.t - r.t >= 86400 THEN e.t ELSE r.t END, r.f <> e.f OR e.t - r.t >= 86400 FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
    SELECT key, id FROM r WHERE sent""",
)
_register(
    "stream_once_per_story", lambda s, d: sent(drained(in_order(alerts(_events(s, d).where("event_type = 'error'")), first_only), "update")),
    "SELECT user_id AS key, arg_min(event_id, struct_pack(t := CAST(floor(epoch(ts)) AS BIGINT), i := event_id)) AS id FROM events WHERE event_type = 'error' GROUP BY 1",
)
_register(
    "stream_feed_health", lambda s, d: feed_states(drained(in_order(fetches(_events(s, d)), feed_state, idle=400 * 86_400), "update")),
    """WITH f AS (SELECT feed_id, id, CAST(floor(epoch(ts)) AS BIGINT) AS t, success, error FROM v_fetch_log), s AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY t DESC, id DESC) AS later FROM f)
    SELECT feed_id, count(*) FILTER (WHERE later = 0) AS failures, arg_max(error, struct_pack(t := t, i := id)) FILTER (WHERE NOT success) AS last_error, max(t) FILTER (WHERE success) AS last_success FROM s GROUP BY 1""",
    "v_fetch_log",
)
