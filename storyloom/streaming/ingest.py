"""Items in micro-batches into an article table and its stories.

Articles lie by the day on which their url was first seen and a hash of the url, so a batch writes the partitions of its own days anew, by
Spark's partition overwrite, and reads no others. A table of keys (url, day, version) tells where a known url lies; nothing of the articles
themselves is read to find out.

Stories are the components of articles whose titles are alike and near in time. A batch's new and changed articles meet earlier ones over
postings: a title's rare tokens with a bin of time, of which only the bins around the batch are read. Links that are found join stories; a story
of which an article's title or time has changed is taken apart and linked anew among its own articles. Labels are appended for articles whose
story changes, so a batch costs what it touches, and after any batch the stories are those of the batch job on all rows.

Tables of keys, postings and labels are only appended to, with the batch's number as version; a batch that runs again writes the same rows once
more, which readers take once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.text import words
from storyloom.operators.graphs import cluster_labels, stored
from storyloom.operators.upserts import article_upsert
from storyloom.registry import ORACLE, QUERIES
from storyloom.sources.views import duck
from storyloom.streaming.jobs import batches, each_batch, folder, read_stream, remove

BUCKETS = 16
#: Two articles are of one story if their titles' tokens have a Jaccard index of THETA and their times are within DAYS.
THETA, DAYS = 0.6, 4
_ROW = "url string, title string, summary string, relevance double, ts string"


class Tables:
    """The tables of one ingest below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self, name: str, schema: str) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def articles(self) -> DataFrame:
        return self.read("articles", f"{_ROW}, day date, bucket int")

    def keys(self) -> DataFrame:
        return self.read("keys", "url string, day date, v long")

    def sets(self) -> DataFrame:
        return self.read("sets", "url string, at long, tokens array<string>, v long, bin long")

    def postings(self) -> DataFrame:
        return self.read("postings", "token string, url string, v long, bin long")

    def labels(self) -> DataFrame:
        return self.read("labels", "url string, story string, bin long, v long")

    def stories(self, labels: DataFrame | None = None) -> DataFrame:
        """(url, story, bin): the newest label of each article."""
        rows = self.labels() if labels is None else labels
        return rows.groupBy("url").agg(F.max_by(F.struct("story", "bin"), "v").alias("x")).select("url", "x.*")


def token_sets(articles: DataFrame, days: int = DAYS) -> DataFrame:
    """(url, at, bin, tokens) of articles (url, title, ts); titles without words are left out."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = articles.select("url", at.alias("at"), F.array_distinct(words(F.coalesce("title", F.lit("")))).alias("tokens"))
    return rows.withColumn("bin", F.floor(F.col("at") / (days * 86_400))).where((F.size("tokens") > 0) & F.col("at").isNotNull())


def prefixes(sets: DataFrame, order: DataFrame, theta: float = THETA) -> DataFrame:
    """sets' columns without tokens, with one `token` for each of the first n - ceil(theta n) + 1 of a set in the order's (df, token).

    Two sets of Jaccard theta have one of them in common, in any fixed order; tokens that the order does not know count as the rarest.
    """
    keep = [c for c in sets.columns if c != "tokens"]
    every = sets.select(*keep, F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(order, "token", "left")
    place = F.row_number().over(Window.partitionBy("url").orderBy(F.coalesce("df", F.lit(0)), "token"))
    return every.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.lit(theta - 5e-7) * F.col("size")) + 1).select(*keep, "token")


def alike(pairs: DataFrame, theta: float = THETA, days: int = DAYS) -> DataFrame:
    """(i, j) of pairs (url, at, tokens, other, other_at, other_tokens) that are of one story."""
    shared = F.size(F.array_intersect("tokens", "other_tokens"))
    overlap = F.round(shared / (F.size("tokens") + F.size("other_tokens") - shared), 6)
    return pairs.where((overlap >= theta) & (F.abs(F.col("at") - F.col("other_at")) <= days * 86_400)).select(F.least("url", "other").alias("i"), F.greatest("url", "other").alias("j")).distinct()


def ingest(items: DataFrame, gate: Callable[[DataFrame], DataFrame], path: str, buckets: int = BUCKETS, theta: float = THETA, days: int = DAYS) -> Tables:
    """Takes all landed items (id, url, title, summary, relevance, ts) that pass the gate into the tables below path.

    Within a batch the latest row of a url counts; a later batch's row replaces title and time, as article_upsert() does. The order of tokens
    is that of the first batch's frequencies, kept with the tables. Rows without a url are left out.
    """
    spark = items.sparkSession
    tables = Tables(spark, path)
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")

    def upsert(batch: DataFrame, number: int) -> None:
        """The partitions that the batch touches, as they will be, into stage; the keys of new and changed urls."""
        new = gate(batch.where("url is not null")).persist()
        last = new.groupBy("url").agg(F.max_by("ts", F.struct("ts", "id")).alias("ts"))
        known = tables.keys().join(last.select("url"), "url", "left_semi").groupBy("url").agg(F.min("day").alias("day"))
        located = stored(last.join(known, "url", "left").select("url", F.coalesce("day", F.to_date("ts")).alias("day"), bucket.alias("bucket")))
        touched = located.select("day", "bucket").distinct()
        on_days = [r[0] for r in touched.select("day").distinct().collect()]  # days of one batch
        old = tables.articles().where(F.col("day").isin(on_days)).join(F.broadcast(touched) if len(on_days) * buckets < 100_000 else touched, ["day", "bucket"], "left_semi")
        before = old.select("url", F.lit(1).alias("id"), "title", "summary", "relevance", F.col("ts").cast("timestamp_ntz").alias("ts"))
        after = article_upsert(before, new).drop("action").join(located.unionByName(old.select("url", "day", "bucket")).distinct(), "url")
        was = old.select("url", F.col("title").alias("old_title"), F.col("ts").alias("old_ts"), F.lit(True).alias("known"))
        after = after.join(was, "url", "left").withColumn("fresh", F.col("known").isNull())
        changed = F.col("fresh") | ~F.col("title").eqNullSafe(F.col("old_title")) | ~F.col("ts").eqNullSafe(F.col("old_ts"))
        after.withColumn("changed", changed).drop("old_title", "old_ts", "known").write.mode("overwrite").parquet(f"{path}/stage/batch={number}")
        new.unpersist()

    def cluster(changed: DataFrame, number: int) -> None:
        """Labels of what the changed articles (url, title, ts, fresh) touch."""
        sets = stored(token_sets(changed, days))
        if not tables.exists("order"):
            sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).write.parquet(f"{path}/order")
        order = tables.read("order", "token string, df long")
        mine = stored(prefixes(sets, order, theta))
        sets.withColumn("v", F.lit(number).cast("long")).write.mode("append").partitionBy("bin").parquet(f"{path}/sets")
        mine.select("token", "url", F.lit(number).cast("long").alias("v"), "bin").write.mode("append").partitionBy("bin").parquet(f"{path}/postings")
        around = sorted({r[0] + k for r in sets.select("bin").distinct().collect() for k in (-1, 0, 1)})  # bins of one batch

        near = F.col("bin").isin(around)
        left = mine.select("url", "token", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
        met = left.join(tables.postings().where(near).select("token", F.col("url").alias("other"), "v", "bin"), ["token", "bin"]).where("url <> other").select("url", "other", "v").distinct()
        # Postings of an earlier version of an article are no longer its own.
        current = tables.keys().join(met.select(F.col("other").alias("url")).distinct(), "url", "left_semi").groupBy("url").agg(F.max("v").alias("v")).withColumnRenamed("url", "other")
        others = tables.sets().where(near).select(F.col("url").alias("other"), "v", F.col("at").alias("other_at"), F.col("tokens").alias("other_tokens")).distinct()
        pairs = stored(alike(met.join(current, ["other", "v"]).join(others, ["other", "v"]).join(sets.select("url", "at", "tokens"), "url"), theta, days))

        asked = changed.select("url").union(pairs.select("i")).union(pairs.select("j")).distinct()
        now = stored(tables.stories(tables.labels().join(asked, "url", "left_semi")))
        apart = stored(now.join(changed.where("not fresh"), "url", "left_semi").select("story").distinct())
        stories = stored(now.select("story").distinct())
        labels = tables.labels()
        members = tables.stories(labels.join(labels.join(stories, "story", "left_semi").select("url").distinct(), "url", "left_semi")).join(stories, "story", "left_semi")
        members = stored(members.select("url", "story", "bin"))
        whole = members.join(apart, "story", "left_anti").select(F.col("url").alias("i"), F.col("story").alias("j")).where("i <> j")
        again = linked(members.join(apart, "story", "left_semi").join(changed.select("url"), "url", "left_anti"), order)
        ids = members.select("url").union(changed.select("url")).distinct().withColumnRenamed("url", "id")
        found = cluster_labels(ids, pairs.union(whole).union(again)).select(F.col("id").alias("url"), F.col("cluster_id").alias("story"))
        where = members.select("url", "bin", F.col("story").alias("old"))
        moved = found.join(where, "url", "left").join(sets.select("url", F.col("bin").alias("own")), "url", "left")
        moved = moved.join(changed.select("url", F.lit(True).alias("changed")), "url", "left").where("changed or not old <=> story")
        moved.select("url", "story", F.coalesce("own", F.when(F.col("changed").isNull(), F.col("bin"))).alias("bin"), F.lit(number).cast("long").alias("v")).write.mode("append").parquet(f"{path}/labels")

    def linked(members: DataFrame, order: DataFrame) -> DataFrame:
        """(i, j) among the articles of each story (url, story, bin) that are alike."""
        bins = [r[0] for r in members.select("bin").distinct().collect()]  # bins of the stories that are taken apart
        newest = tables.keys().join(members.select("url"), "url", "left_semi").groupBy("url").agg(F.max("v").alias("v"))
        sets = tables.sets().where(F.col("bin").isin(bins)).distinct().join(newest, ["url", "v"]).join(members.select("url", "story"), "url").drop("v")
        sets = stored(sets)
        keyed = prefixes(sets.select("url", "story", "tokens"), order, theta)
        met = keyed.join(keyed.select("story", "token", F.col("url").alias("other")), ["story", "token"]).where("url < other").select("url", "other").distinct()
        other = sets.select(F.col("url").alias("other"), F.col("at").alias("other_at"), F.col("tokens").alias("other_tokens"))
        return alike(met.join(sets.select("url", "at", "tokens"), "url").join(other, "other"), theta, days)

    def take(batch: DataFrame, number: int) -> None:
        if number not in batches(spark, f"{path}/stage"):
            upsert(batch, number)
        stage = spark.read.parquet(f"{path}/stage/batch={number}")
        changed = stored(stage.where("changed").select("url", "title", "ts", "fresh", "day"))
        if changed.isEmpty():
            changed = None
        else:
            changed.select("url", "day", F.lit(number).cast("long").alias("v")).write.mode("append").parquet(f"{path}/keys")
        columns = [x.split()[0] for x in _ROW.split(", ")]
        stage.select(*columns, "day", "bucket").repartition("day", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "bucket").parquet(f"{path}/articles")
        if changed is not None:
            cluster(changed, number)
        for k in batches(spark, f"{path}/stage", number):
            remove(spark, f"{path}/stage/batch={k}")

    each_batch(items, path, take)
    return tables


def stories_of(articles: DataFrame, theta: float = THETA, days: int = DAYS) -> DataFrame:
    """The batch twin: (url, story) of articles (url, title, ts), one row for each url."""
    sets = stored(token_sets(articles, days))
    order = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    keyed = prefixes(sets, order, theta).select("url", "bin", "token")
    left = keyed.select("url", "token", F.explode(F.array(F.col("bin") - 1, F.col("bin"))).alias("bin"))
    met = left.join(keyed.select(F.col("url").alias("other"), "token", "bin"), ["token", "bin"]).where("url <> other").select("url", "other").distinct()
    other = sets.select(F.col("url").alias("other"), F.col("at").alias("other_at"), F.col("tokens").alias("other_tokens"))
    pairs = alike(met.join(sets.select("url", "at", "tokens"), "url").join(other, "other"), theta, days)
    return cluster_labels(articles.select(F.col("url").alias("id")), pairs).select(F.col("id").alias("url"), F.col("cluster_id").alias("story"))


def _items(s: SparkSession, d: str) -> DataFrame:
    return read_stream(s, f"{d}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id") % 700).alias("url"), F.trim(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("title"), F.col("text").alias("summary"),
        F.lit(None).cast("double").alias("relevance"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - make_interval(0, 0, 0, 0, cast(doc_id % 720 as int))").alias("ts"), F.lit("article").alias("quality_label"),
    )


def _taken(s: SparkSession, d: str) -> Tables:
    from storyloom.operators.filters import servable

    return ingest(_items(s, d), lambda b: b.where(servable()), folder(s))


_ITEMS = """WITH i AS (SELECT doc_id AS id, concat('https://', source, '.example.org/', lang, '/', doc_id % 700) AS url, trim(regexp_extract(text, '^[^.\n]*', 0)) AS title, TIMESTAMP '2024-01-31 00:00:00' - to_hours(doc_id % 720) AS ts FROM documents),
    a AS (SELECT * FROM i WHERE title NOT ILIKE 'from %' QUALIFY row_number() OVER (PARTITION BY url ORDER BY i.ts DESC, id DESC) = 1)"""


def _story_sql() -> str:
    from storyloom.functions.text import sql_words

    return _ITEMS.replace("WITH i", "WITH RECURSIVE i") + f""", t AS (SELECT url, ts, list_distinct({sql_words('title')}) AS w FROM a), x AS (SELECT url, ts, len(w) AS n, unnest(w) AS token FROM t),
    c AS (SELECT l.url AS i, r.url AS j, l.n + r.n AS n, count(*) AS s FROM x l JOIN x r ON l.token = r.token AND l.url <> r.url AND abs(date_diff('second', l.ts, r.ts)) <= {DAYS * 86400} GROUP BY l.url, r.url, l.n, r.n),
    p AS (SELECT i, j FROM c WHERE round(s / (n - s), 6) >= {THETA}), r AS (SELECT url, url AS story FROM a UNION SELECT p.j, r.story FROM r JOIN p ON p.i = r.url) SELECT url, min(story) AS story FROM r GROUP BY url"""


QUERIES["stream_ingest"] = lambda s, d: _taken(s, d).articles().select("url", "title", "ts")
ORACLE["stream_ingest"] = duck("", _ITEMS + " SELECT url, title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM a")
QUERIES["stream_ingest_stories"] = lambda s, d: _taken(s, d).stories().select("url", "story")
ORACLE["stream_ingest_stories"] = duck("", _story_sql())
