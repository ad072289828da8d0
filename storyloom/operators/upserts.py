"""Snapshots after new rows: upserts by natural key with a policy for each column, registries, editors' changes. Old snapshot in, new one out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.summaries import SHORTEST, STORED_JUNK
from storyloom.registry import register
from storyloom.sources.pages import _HOST, domain


def better_summary(old: Column, new: Column) -> Column:
    """The new summary where the old one is blank, short, junk or shorter; never a blank one."""
    o, n = F.coalesce(F.trim(old), F.lit("")), F.coalesce(F.trim(new), F.lit(""))
    return F.when(n == "", old).when((F.length(o) < SHORTEST) | o.rlike("(?is)" + "|".join(STORED_JUNK)), new).when(F.length(new) > F.length(old), new).otherwise(old)


def article_upsert(articles: DataFrame, incoming: DataFrame, replaced: tuple[str, ...] = ()) -> DataFrame:
    """(url, title, summary, relevance, ts, action, and `replaced`): incoming rows overwrite title, time and the columns `replaced` (quality and
    choice of the summary, with null too), summaries by better_summary, relevance only if they have one. Of incoming rows with one url the
    latest counts. One full outer join on the url."""
    last = incoming.groupBy("url").agg(F.max_by(F.struct("title", "summary", "relevance", "ts", *replaced), F.struct("ts", "id")).alias("n"))
    both = articles.alias("o").join(last.alias("i"), "url", "full_outer")
    old = lambda c: F.col(f"o.{c}")
    new = lambda c: F.col(f"i.n.{c}")
    action = F.when(F.col("i.n").isNull(), "kept").when(old("id").isNull(), "inserted").otherwise("updated")
    more = (F.when(F.col("i.n").isNull(), old(c)).otherwise(new(c)).alias(c) for c in replaced)
    return both.select("url", F.coalesce(new("title"), old("title")).alias("title"), better_summary(old("summary"), new("summary")).alias("summary"), F.coalesce(new("relevance"), old("relevance")).alias("relevance"), F.date_format(F.coalesce(new("ts"), old("ts")), "yyyy-MM-dd HH:mm:ss").alias("ts"), action.alias("action"), *more)


_JUNK = "'(?is)" + "|".join(STORED_JUNK) + "'"
_ONE = "SELECT url, max(id) AS id FROM v_articles GROUP BY url"


def _old(a: DataFrame) -> DataFrame:
    return a.where("id % 3 <> 0").groupBy("url").agg(F.max_by(F.struct("id", "title", "summary", "ts", "quality_label"), "id").alias("x")).select("url", "x.*").withColumn("relevance", F.expr("if(id % 2 = 0, id % 10 / 10.0D, null)"))


def _new(a: DataFrame) -> DataFrame:
    return a.where("id % 2 = 0 or id % 3 = 0").select("id", "url", F.concat(F.lit("new "), "title").alias("title"), F.expr("case id % 5 when 0 then '' when 1 then 'Short.' when 2 then concat(summary, ' More of it.') else summary end").alias("summary"), F.expr("if(id % 3 = 0, 0.5D, null)").alias("relevance"), "ts", F.expr("if(id % 4 = 0, null, 'seen')").alias("quality_label"))


register(
    "article_upsert", "v_articles", lambda a: article_upsert(_old(a), _new(a), ("quality_label",)),
    f"""WITH o AS (SELECT *, CASE WHEN id % 2 = 0 THEN id % 10 / 10.0::DOUBLE END AS relevance FROM v_articles WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1),
    n AS (SELECT id, url, concat('new ', title) AS title, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Short.' WHEN 2 THEN concat(summary, ' More of it.') ELSE summary END AS summary, CASE WHEN id % 3 = 0 THEN 0.5::DOUBLE END AS relevance, ts, CASE WHEN id % 4 <> 0 THEN 'seen' END AS quality_label FROM v_articles WHERE id % 2 = 0 OR id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, id DESC) = 1)
    SELECT coalesce(o.url, n.url) AS url, coalesce(n.title, o.title) AS title, CASE WHEN coalesce(trim(n.summary), '') = '' THEN o.summary WHEN coalesce(trim(o.summary), '') = '' OR length(trim(o.summary)) < 40 OR regexp_matches(trim(o.summary), {_JUNK}) THEN n.summary
    WHEN length(n.summary) > length(o.summary) THEN n.summary ELSE o.summary END AS summary, coalesce(n.relevance, o.relevance) AS relevance, strftime(coalesce(n.ts, o.ts), '%Y-%m-%d %H:%M:%S') AS ts,
    CASE WHEN n.url IS NULL THEN 'kept' WHEN o.url IS NULL THEN 'inserted' ELSE 'updated' END AS action, CASE WHEN n.url IS NULL THEN o.quality_label ELSE n.quality_label END AS quality_label FROM o FULL JOIN n ON o.url = n.url""",
)


def discovered_article_upsert(articles: DataFrame, links: DataFrame, stories: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corroborating articles: summaries replace short ones only, links are added once, stories' last time moves forward. Of found rows with
    one url the latest counts, then the greatest story, title and summary: rows that tie in all of these are alike."""
    f = found.groupBy("url").agg(F.max(F.struct("ts", "story_id", "title", "summary")).alias("n"))
    both = articles.alias("o").join(f.alias("i"), "url", "full_outer")
    short = F.length(F.coalesce(F.trim(F.col("o.summary")), F.lit(""))) < 40
    arts = both.select("url", F.coalesce("o.title", "i.n.title").alias("title"), F.when(short & F.col("i.n").isNotNull(), F.col("i.n.summary")).otherwise(F.col("o.summary")).alias("summary"))
    added = found.select("story_id", "url").distinct().join(links, ["story_id", "url"], "left_anti")
    latest = found.groupBy("story_id").agg(F.max("ts").alias("t"))
    moved = stories.join(latest, stories["id"] == latest["story_id"], "left").select("id", F.greatest("last_seen", F.coalesce("t", "last_seen")).alias("last_seen"))
    return arts, links.select("story_id", "url").unionByName(added), moved


def _discovered(a: DataFrame, s: DataFrame) -> DataFrame:
    arts = a.where("id % 3 <> 0").groupBy("url").agg(F.max_by(F.struct("title", F.expr("if(id % 4 = 0, 'short', summary)").alias("summary")), "id").alias("x")).select("url", "x.*")
    found = a.where("id % 2 = 0 or id % 3 = 0").select(F.md5(F.lower("title")).alias("story_id"), "url", F.upper("title").alias("title"), "summary", "ts")
    links = a.where("id % 5 <> 0").select(F.md5(F.lower("title")).alias("story_id"), "url").distinct()
    x, y, z = discovered_article_upsert(arts, links, s.select("id", "last_seen"), found)
    count = lambda df, name, v: df.agg(F.count("*").alias("n"), F.sum(v).cast("long").alias("v")).select(F.lit(name).alias("name"), "n", "v")
    return count(x, "articles", F.length("summary")).union(count(y, "links", F.length("url"))).union(count(z, "stories", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', last_seen)")))


register(
    "discovered_article_upsert", "v_articles v_stories", _discovered,
    """WITH o AS (SELECT url, title, CASE WHEN id % 4 = 0 THEN 'short' ELSE summary END AS summary FROM v_articles WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1),
    f AS (SELECT md5(lower(title)) AS story_id, url, summary, ts FROM v_articles WHERE id % 2 = 0 OR id % 3 = 0), n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, story_id DESC) = 1),
    a AS (SELECT CASE WHEN n.url IS NOT NULL AND length(coalesce(trim(o.summary), '')) < 40 THEN n.summary ELSE o.summary END AS summary FROM o FULL JOIN n ON o.url = n.url),
    l AS (SELECT DISTINCT md5(lower(title)) AS story_id, url FROM v_articles WHERE id % 5 <> 0 UNION SELECT story_id, url FROM f), t AS (SELECT story_id, max(ts) AS t FROM f GROUP BY 1), s AS (SELECT greatest(last_seen, coalesce(t, last_seen)) AS last_seen FROM v_stories LEFT JOIN t ON story_id = id)
    SELECT 'articles' AS name, count(*) AS n, CAST(sum(length(summary)) AS BIGINT) AS v FROM a UNION ALL SELECT 'links', count(*), CAST(sum(length(url)) AS BIGINT) FROM l UNION ALL SELECT 'stories', count(*), CAST(sum(epoch(last_seen)) AS BIGINT) FROM s""",
)


def source_registry_upsert(sources: DataFrame, domains: DataFrame, tiers: dict[str, list[str]], trusted: list[str], down: list[str]) -> DataFrame:
    """sources (domain, tier, weight) with new domains: tier by list, A before B before C, those of C left out; weight by tier."""
    new = domains.select("domain").where("domain <> ''").distinct().join(sources, "domain", "left_anti")
    tier = F.lit("unknown")
    for name in reversed(list(tiers)):
        hit = F.lit(False)
        for part in tiers[name]:
            hit = hit | F.col("domain").contains(part)
        tier = F.when(hit, name).otherwise(tier)
    weight = F.when(F.col("domain").isin(trusted), 1.2).when(F.col("tier") == "A", 1.1).when(F.col("tier") == "B", 1.0).otherwise(0.7)
    low = F.lit(False)
    for part in down:
        low = low | F.col("domain").contains(part)
    added = new.withColumn("tier", tier).where("tier <> 'C'").withColumn("weight", weight).withColumn("weight", F.when(low, F.least(F.lit(0.7), "weight")).otherwise(F.col("weight")))
    return sources.select("domain", "tier", "weight").unionByName(added)


register(
    "source_registry_upsert", "v_sources v_articles pages",
    lambda s, a, p: source_registry_upsert(s.where("tier = 'A'"), a.select(domain(F.col("url")).alias("domain")).union(p.select(domain(F.col("url")))), {"A": ["src1"], "B": ["example.com"], "C": ["src2", "blog."]}, ["src1.example.org"], ["m."]),
    f"""WITH s AS (SELECT domain, tier, weight FROM v_sources WHERE tier = 'A'), d AS (SELECT DISTINCT domain FROM (SELECT {_HOST} AS domain FROM v_articles UNION ALL SELECT {_HOST} FROM pages) WHERE domain <> '' AND domain NOT IN (SELECT domain FROM s)),
    t AS (SELECT domain, CASE WHEN contains(domain, 'src1') THEN 'A' WHEN contains(domain, 'example.com') THEN 'B' WHEN contains(domain, 'src2') OR contains(domain, 'blog.') THEN 'C' ELSE 'unknown' END AS tier FROM d),
    w AS (SELECT domain, tier, CASE WHEN domain = 'src1.example.org' THEN 1.2 WHEN tier = 'A' THEN 1.1 WHEN tier = 'B' THEN 1.0 ELSE 0.7 END AS weight FROM t WHERE tier <> 'C')
    SELECT * FROM s UNION ALL SELECT domain, tier, CAST(CASE WHEN contains(domain, 'm.') THEN least(0.7, weight) ELSE weight END AS DOUBLE) FROM w""",
)


def feed_registry(feeds: DataFrame, defaults: DataFrame, replacements: DataFrame, sources: DataFrame) -> DataFrame:
    """Active feeds: registered ones and missing defaults, replaced urls swapped once, sources of tier C out."""
    every = feeds.select("url", "domain", "active").unionByName(defaults.select("url", "domain").distinct().join(feeds, "url", "left_anti").withColumn("active", F.lit(True)))
    swapped = every.join(replacements, "url", "left").select(F.coalesce("new_url", "url").alias("url"), "domain", "active")
    return swapped.where("active").join(sources.where("tier = 'C'").select("domain"), "domain", "left_anti").groupBy("url").agg(F.min("domain").alias("domain"))


register(
    "feed_registry", "v_sources",
    lambda s: feed_registry(
        s.where("tier = 'A'").select(F.concat(F.lit("https://"), "domain", F.lit("/rss")).alias("url"), "domain", F.expr("weight > 1").alias("active")), s.select(F.concat(F.lit("https://"), "domain", F.lit("/rss")).alias("url"), "domain"),
        s.where("tier = 'B'").select(F.concat(F.lit("https://"), "domain", F.lit("/rss")).alias("url"), F.concat(F.lit("https://"), "domain", F.lit("/feed.xml")).alias("new_url")), s.select("domain", F.expr("if(id like '%7', 'C', tier)").alias("tier")),
    ),
    "SELECT concat('https://', domain, CASE WHEN tier = 'B' THEN '/feed.xml' ELSE '/rss' END) AS url, domain FROM v_sources WHERE id NOT LIKE '%7'",
)


def last_edits(edits: DataFrame, fields: list[str]) -> DataFrame:
    """(target, new_<field>): the last change of each field of each row, from edits (id, target, at, fields); nulls change nothing."""
    return edits.groupBy("target").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "id"))).alias(f"new_{c}") for c in fields))


def editor_overrides(rows: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """rows (id, fields) after the editors' changes. Of stories status, title and summary, of feeds the activity, of sources tier and weight."""
    last = last_edits(edits, fields)
    return rows.join(last, rows["id"] == last["target"], "left").select("id", *(F.coalesce(f"new_{c}", c).alias(c) for c in fields))


def _edited(o: DataFrame, s: DataFrame, e: DataFrame) -> DataFrame:
    """Stories, feeds and sources after the same log of edits, as (kind, id, status, title, active, tier, weight)."""
    at = F.col("ts").alias("at")
    pick = lambda m, k, what: F.expr(f"if(event_id % {m} = {k}, {what}, null)")
    stories = editor_overrides(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title")), e.select(F.col("event_id").alias("id"), F.col("user_id").alias("target"), pick(2, 0, "event_type").alias("status"), pick(3, 0, "concat('t', event_id)").alias("title"), at), ["status", "title"])
    feeds = editor_overrides(o.select(F.col("o_custkey").alias("id")).distinct().withColumn("active", F.lit(True)), e.select(F.col("event_id").alias("id"), F.col("user_id").alias("target"), pick(5, 0, "value > 50").alias("active"), at), ["active"])
    sources = editor_overrides(s.select(F.col("s_suppkey").alias("id"), F.lit("unknown").alias("tier"), F.lit(0.7).alias("weight")), e.select(F.col("event_id").alias("id"), (F.col("user_id") % 100).alias("target"), pick(4, 1, "upper(substr(event_type, 1, 1))").alias("tier"), pick(7, 2, "event_id / 10.0D").alias("weight"), at), ["tier", "weight"])
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    return (
        stories.select(F.lit("story").alias("kind"), "id", "status", "title", none("active", "boolean"), none("tier", "string"), none("weight", "double"))
        .unionByName(feeds.select(F.lit("feed").alias("kind"), "id", none("status", "string"), none("title", "string"), "active", none("tier", "string"), none("weight", "double")))
        .unionByName(sources.select(F.lit("source").alias("kind"), "id", none("status", "string"), none("title", "string"), none("active", "boolean"), "tier", "weight"))
    )


register(
    "editor_overrides", "orders supplier events", _edited,
    """WITH x AS (SELECT *, struct_pack(ts := ts, i := event_id) AS w FROM events), a AS (SELECT user_id, arg_max(event_type, w) FILTER (WHERE event_id % 2 = 0) AS s, arg_max(concat('t', event_id), w) FILTER (WHERE event_id % 3 = 0) AS t, arg_max(value > 50, w) FILTER (WHERE event_id % 5 = 0 AND value IS NOT NULL) AS f FROM x GROUP BY 1),
    b AS (SELECT user_id % 100 AS k, arg_max(upper(substr(event_type, 1, 1)), w) FILTER (WHERE event_id % 4 = 1) AS t, arg_max(event_id / 10.0::DOUBLE, w) FILTER (WHERE event_id % 7 = 2) AS v FROM x GROUP BY 1)
    SELECT 'story' AS kind, o_orderkey AS id, coalesce(s, o_orderstatus) AS status, coalesce(t, o_orderpriority) AS title, NULL::BOOLEAN AS active, NULL::VARCHAR AS tier, NULL::DOUBLE AS weight FROM orders LEFT JOIN a ON user_id = o_orderkey
    UNION ALL SELECT 'feed', id, NULL, NULL, coalesce(f, true), NULL, NULL FROM (SELECT DISTINCT o_custkey AS id FROM orders) LEFT JOIN a ON user_id = id
    UNION ALL SELECT 'source', s_suppkey, NULL, NULL, NULL, coalesce(t, 'unknown'), coalesce(v, 0.7) FROM supplier LEFT JOIN b ON k = s_suppkey""",
)


def domain_state_tag(articles: DataFrame, dimension: DataFrame) -> DataFrame:
    """Articles with the state of their source's domain, if it is known."""
    return articles.select("id", domain(F.col("url")).alias("domain")).join(dimension, "domain", "left").select("id", "state")


register(
    "domain_state_tag", "v_articles v_sources", lambda a, s: domain_state_tag(a, s.where("tier <> 'B'").select("domain", F.concat(F.lit("state of "), "id").alias("state"))),
    f"SELECT a.id, CASE WHEN s.id IS NOT NULL THEN concat('state of ', s.id) END AS state FROM (SELECT id, {_HOST} AS domain FROM v_articles) a LEFT JOIN (SELECT * FROM v_sources WHERE tier <> 'B') s ON s.domain = a.domain",
)
