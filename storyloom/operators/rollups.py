"""Joins, aggregations and windows over stories, links, articles and sources.

A link row here is (story_id, article_id, title, source_id, ts, is_primary): the bridge joined to its article. Every operator is one
shuffle on the story unless it says otherwise; the small source dimension is left to Spark, which broadcasts it below its threshold.
Null timestamps sort last; ties are broken by article id, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.registry import register
from storyloom.sources.views import AS_OF, STAR_AS_OF

STAR = f"TIMESTAMP_NTZ '{STAR_AS_OF}'"


def as_of(text: str):  # noqa: ANN201
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def since(column: str, text: str, hours: int):  # noqa: ANN201
    """Whether a time is at most so many hours before text."""
    return F.col(column) >= F.expr(f"TIMESTAMP_NTZ '{text}' - INTERVAL {hours} HOURS")


def text_ts(column: str):  # noqa: ANN201
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- joins -------------------------------------------------------------------------------------------------------------------------


def story_article_join(stories: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """stories, their articles and, where known, the articles' sources."""
    return (
        stories.join(links, stories["o_orderkey"] == links["story_id"])
        .join(sources, links["source_id"] == sources["id"], "left")
        .select("story_id", "article_id", F.col("o_orderpriority").alias("priority"), "title", "domain", "weight")
    )


register(
    "story_article_join", "orders star_links star_sources", story_article_join,
    """SELECT story_id, article_id, o_orderpriority AS priority, title, domain, weight FROM orders JOIN star_links ON o_orderkey = story_id LEFT JOIN star_sources s ON s.id = source_id""",
)


def story_latest_summary(links: DataFrame, articles: DataFrame) -> DataFrame:
    """The newest non-blank summary of each story: one aggregate, no window."""
    rows = links.select("story_id", "article_id").join(articles.where("trim(summary) <> '' and coalesce(quality_label, 'unknown') <> 'non_article'"), F.col("article_id") == F.col("id"))
    return rows.groupBy("story_id").agg(F.max_by("summary", F.struct("ts", "id")).alias("summary"))


register(
    "story_latest_summary", "v_links v_articles", story_latest_summary,
    """SELECT story_id, arg_max(summary, struct_pack(ts := a.ts, id := a.id)) AS summary FROM v_links l JOIN v_articles a ON a.id = l.article_id
    WHERE trim(summary) <> '' AND coalesce(quality_label, 'unknown') <> 'non_article' GROUP BY story_id""",
)


def story_latest_summary_windowed(links: DataFrame, articles: DataFrame, at: str = AS_OF, days: int = 14) -> DataFrame:
    """The same within some days, the primary article's first."""
    rows = links.select("story_id", "article_id", "is_primary").join(articles.where("trim(summary) <> ''").where(since("ts", at, 24 * days)), F.col("article_id") == F.col("id"))
    return rows.groupBy("story_id").agg(F.max_by("summary", F.struct("is_primary", "ts", "id")).alias("summary"))


register(
    "story_latest_summary_windowed", "v_links v_articles", story_latest_summary_windowed,
    f"""SELECT story_id, arg_max(summary, struct_pack(p := is_primary, ts := a.ts, id := a.id)) AS summary FROM v_links l JOIN v_articles a ON a.id = l.article_id
    WHERE trim(summary) <> '' AND a.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 336 HOURS GROUP BY story_id""",
)


def story_seed_article(links: DataFrame) -> DataFrame:
    """Each story's newest article; stories without any are absent."""
    return links.groupBy("story_id").agg(F.max_by(F.struct("article_id", "title"), F.struct("ts", "article_id")).alias("a")).select("story_id", "a.article_id", "a.title")


register("story_seed_article", "star_links", story_seed_article, "SELECT story_id, article_id, title FROM star_links QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY ts DESC, article_id DESC) = 1")


def story_top_articles(links: DataFrame, k: int = 3) -> DataFrame:
    """The newest k articles of each story as one JSON list, newest first."""
    rank = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("ts"), F.desc("article_id")))
    best = links.select("story_id", "article_id", "title", rank.alias("rank")).where(F.col("rank") <= k)
    return best.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "title"))).alias("a")).select("story_id", F.to_json(F.transform("a", lambda x: F.struct(x["article_id"].alias("id"), x["title"].alias("title")))).alias("articles"))


register(
    "story_top3_articles", "star_links", story_top_articles,
    """SELECT story_id, CAST(to_json(list(struct_pack(id := article_id, title := title) ORDER BY r)) AS VARCHAR) AS articles FROM
    (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY ts DESC, article_id DESC) AS r FROM star_links) WHERE r <= 3 GROUP BY story_id""",
)


def ungrouped_articles(articles: DataFrame, links: DataFrame, n: int | None = 300) -> DataFrame:
    """Articles in no story that may be grouped, the newest n."""
    free = articles.where("coalesce(quality_label, 'unknown') <> 'non_article'").join(links.select(F.col("article_id").alias("id")), "id", "left_anti").select("id", "title")
    return free if n is None else free.join(articles.select("id", "ts"), "id").orderBy(F.desc("ts"), F.desc("id")).limit(n).select("id", "title")


register(
    "ungrouped_articles", "v_articles v_links", lambda a, x: ungrouped_articles(a, x.where("is_primary"), None),
    """SELECT id, title FROM v_articles WHERE coalesce(quality_label, 'unknown') <> 'non_article' AND id NOT IN (SELECT article_id FROM v_links WHERE is_primary)""",
)


def stories_by_ids(stories: DataFrame, ids: DataFrame) -> DataFrame:
    return stories.join(ids, stories["o_orderkey"] == ids["id"], "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))


register("stories_by_ids", "orders events", lambda o, e: stories_by_ids(o, e.select((F.col("user_id") * 7).alias("id"))), "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderkey IN (SELECT user_id * 7 FROM events)")


def orphan_stories(stories: DataFrame, links: DataFrame) -> DataFrame:
    """Stories without any article."""
    return stories.join(links, stories["o_orderkey"] == links["story_id"], "left_anti").select(F.col("o_orderkey").alias("id"))


register("orphan_stories", "orders star_links", orphan_stories, "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM star_links WHERE story_id = o_orderkey)")


def existing_article_story(candidates: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """Each candidate url with the article that has it and that article's stories, if any."""
    known = articles.select("url", F.col("id").alias("article_id")).join(links.select("article_id", "story_id"), "article_id", "left")
    stories = known.groupBy("url").agg(F.min("article_id").alias("article_id"), F.array_join(F.sort_array(F.collect_set("story_id")), ",").alias("story_ids"))
    return candidates.select("url").distinct().join(stories, "url", "left")


register(
    "existing_article_story", "v_articles v_links",
    lambda a, x: existing_article_story(a.select(F.when(F.col("id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/new"))).alias("url")), a, x),
    """SELECT c.url, min(a.id) AS article_id, string_agg(DISTINCT l.story_id, ',' ORDER BY l.story_id) AS story_ids FROM
    (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN url ELSE concat(url, '/new') END AS url FROM v_articles) c LEFT JOIN v_articles a ON a.url = c.url LEFT JOIN v_links l ON l.article_id = a.id GROUP BY c.url""",
)


def key_lookup_join(articles: DataFrame, stories: DataFrame, at: str = AS_OF, days: int = 7) -> DataFrame:
    """Each article with the latest-seen story of its key that was seen within some days: an as-of join as an aggregate on the key."""
    latest = stories.where(since("last_seen", at, 24 * days)).groupBy("story_key").agg(F.max_by("id", F.struct("last_seen", "id")).alias("story_id"))
    return articles.join(latest, "story_key", "left").select("id", "story_key", "story_id")


_KEY = "concat_ws('-', split_part(lower(title), ' ', 1), split_part(lower(title), ' ', 2))"
register(
    "key_lookup_join", "v_articles v_stories", lambda a, s: key_lookup_join(a.withColumn("story_key", F.expr(_KEY)), s.withColumn("story_key", F.expr(_KEY))),
    f"""SELECT a.id, {_KEY.replace('title', 'a.title')} AS story_key, s.id AS story_id FROM v_articles a LEFT JOIN (SELECT * FROM (SELECT id, {_KEY} AS k, row_number() OVER (PARTITION BY {_KEY} ORDER BY last_seen DESC, id DESC) AS r
    FROM v_stories WHERE last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS) WHERE r = 1) s ON s.k = {_KEY.replace('title', 'a.title')}""",
)


def rank_apply_join(stories: DataFrame, ranks: DataFrame) -> DataFrame:
    """Stories with the given ranks; all others lose theirs."""
    return stories.drop("homepage_rank").join(ranks.select(F.col("story_id").alias("id"), F.col("rank").alias("homepage_rank")), "id", "left").select("id", "title", "homepage_rank")


register(
    "rank_apply_join", "v_stories", lambda s: rank_apply_join(s, s.where("article_count > 1").select(F.col("id").alias("story_id"), F.col("article_count").cast("int").alias("rank"))),
    "SELECT id, title, CASE WHEN article_count > 1 THEN CAST(article_count AS INT) END AS homepage_rank FROM v_stories",
)


# --- aggregations ------------------------------------------------------------------------------------------------------------------


def story_rollup(links: DataFrame, sources: DataFrame, at: str = STAR_AS_OF, recent_hours: int = 24, days: int | None = None, k: int | None = None) -> DataFrame:
    """Per story: articles, distinct source domains and their families, recent articles, mean source weight (unknown: 1), latest time; the
    newest k.

    Partial sums go through one shuffle on the story. With `days`, only articles of that window count. Where links have a url, its host
    stands for an unknown source.
    """
    from storyloom.functions.text import family
    from storyloom.sources.pages import domain

    rows = links if days is None else links.where(since("ts", at, 24 * days))
    rows = rows.join(sources.select(F.col("id").alias("source_id"), "domain", "weight"), "source_id", "left")
    if "url" in links.columns:
        rows = rows.withColumn("domain", F.coalesce("domain", F.nullif(domain(F.col("url")), F.lit(""))))
    out = rows.groupBy("story_id").agg(
        F.count("*").alias("article_count"),
        F.count_distinct("domain").alias("source_count"),
        F.count_distinct(family(F.col("domain"))).alias("family_count"),
        F.count_if(since("ts", at, recent_hours)).alias("recent_count"),
        F.round(F.avg(F.coalesce("weight", F.lit(1.0))), 6).alias("avg_weight"),
        F.max("ts").alias("latest_at"),
    )
    return out if k is None else out.orderBy(F.desc("latest_at"), F.desc("story_id")).limit(k)


def _rolled(at: str, hours: int, where: str, order: str = "") -> str:
    return f"""SELECT story_id, count(*) AS article_count, count(DISTINCT domain) AS source_count, count(DISTINCT array_to_string(string_split(domain, '.')[-2:], '.')) AS family_count, count(*) FILTER (WHERE ts >= TIMESTAMP '{at}' - INTERVAL {hours} HOURS) AS recent_count,
    round(avg(coalesce(weight, 1.0)), 6) AS avg_weight, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_at FROM star_links l LEFT JOIN star_sources s ON s.id = l.source_id {where} GROUP BY story_id {order}"""


register("story_rollup", "star_links star_sources", lambda x, s: story_rollup(x, s, recent_hours=24 * 200).withColumn("latest_at", text_ts("latest_at")), _rolled(STAR_AS_OF, 4800, ""))
register("story_rollup_newest", "star_links star_sources", lambda x, s: story_rollup(x, s, k=200).withColumn("latest_at", text_ts("latest_at")), _rolled(STAR_AS_OF, 24, "", "ORDER BY max(ts) DESC, story_id DESC LIMIT 200"))
register("story_rollup_weekly", "star_links star_sources", lambda x, s: story_rollup(x, s, recent_hours=72, days=700).withColumn("latest_at", text_ts("latest_at")), _rolled(STAR_AS_OF, 72, f"WHERE ts >= TIMESTAMP '{STAR_AS_OF}' - INTERVAL 16800 HOURS"))


def merge_candidates(stories: DataFrame, at: str = AS_OF, days: int = 5, least: int = 1, k: int | None = None) -> DataFrame:
    """Visible stories seen within some days with at least so many articles; with k, the newest so many."""
    rows = stories.where(f"status <> 'hidden' and article_count >= {least}").where(since("last_seen", at, 24 * days))
    return (rows if k is None else rows.orderBy(F.desc("last_seen"), F.desc("id")).limit(k)).select("id", "title", "article_count")


for _name, _days, _least in (("merge_candidates", 5, 1), ("split_candidates", 30, 2)):
    register(
        _name, "v_stories", lambda s, d=_days, n=_least: merge_candidates(s, days=d, least=n),
        f"SELECT id, title, article_count FROM v_stories WHERE status <> 'hidden' AND article_count >= {_least} AND last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL {24 * _days} HOURS", needs="v_stories",
    )


def story_source_names(links: DataFrame, sources: DataFrame, k: int = 4) -> DataFrame:
    """Names of the sources of each story, that of the newest article first, k at most."""
    rows = links.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id").groupBy("story_id", "name").agg(F.max("ts").alias("at"))
    rank = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("at"), "name"))
    best = rows.withColumn("r", rank).where(F.col("r") <= k).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("a"))
    return best.select("story_id", F.array_join(F.col("a.name"), ",").alias("names"))


register(
    "story_source_names", "star_links star_sources", story_source_names,
    """SELECT story_id, string_agg(name, ',' ORDER BY r) AS names FROM (SELECT story_id, name, row_number() OVER (PARTITION BY story_id ORDER BY max(ts) DESC, name) AS r
    FROM star_links l JOIN star_sources s ON s.id = l.source_id GROUP BY story_id, name) WHERE r <= 4 GROUP BY story_id""",
)


def story_admin_stats(links: DataFrame, sources: DataFrame) -> DataFrame:
    rows = links.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id", "left")
    return rows.groupBy("story_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


register(
    "story_admin_stats", "star_links star_sources", story_admin_stats,
    "SELECT story_id, count(*) AS n, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS names FROM star_links l LEFT JOIN star_sources s ON s.id = l.source_id GROUP BY story_id",
)


def dominant_value(rows: DataFrame, own: DataFrame, least: int = 2, share: float = 0.67) -> DataFrame:
    """Each story's dominant state: its own if any article has it, else a strict plurality with `least` votes and `share` of all articles.

    rows: (story_id, state or null); own: (story_id, own_state or null).
    """
    votes = rows.groupBy("story_id", "state").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("story_id"))
    best = Window.partitionBy("story_id").orderBy(F.col("state").isNull(), F.desc("n"), "state")
    ranked = votes.withColumn("total", total).withColumn("r", F.row_number().over(best)).withColumn("second", F.lead(F.when(F.col("state").isNotNull(), F.col("n")), 1).over(best))
    joined = ranked.join(own, "story_id", "left")
    picked = joined.groupBy("story_id").agg(
        F.max(F.when(F.col("state") == F.col("own_state"), F.struct("state", "n"))).alias("mine"),
        F.max(F.when((F.col("r") == 1) & F.col("state").isNotNull() & (F.col("n") >= least) & (F.col("n") > F.coalesce("second", F.lit(0))) & (F.col("n") >= share * F.col("total")), F.struct("state", "n"))).alias("most"),
    )
    return picked.select("story_id", F.coalesce("mine.state", "most.state").alias("state"), F.coalesce("mine.n", "most.n").alias("n"), F.when(F.col("mine").isNotNull(), "story").when(F.col("most").isNotNull(), "articles").alias("origin"))


_STATE = "CASE source_id % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'west' END"
register(
    "dominant_state", "star_links orders",
    lambda x, o: dominant_value(x.select("story_id", F.expr(_STATE).alias("state")), o.select(F.col("o_orderkey").alias("story_id"), F.expr("CASE WHEN o_custkey % 5 = 0 THEN 'north' END").alias("own_state"))),
    f"""WITH a AS (SELECT story_id, {_STATE} AS state FROM star_links), c AS (SELECT story_id, state, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT story_id, sum(n) AS total FROM c GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, state) AS r, lead(n) OVER (PARTITION BY story_id ORDER BY n DESC, state) AS second FROM c WHERE state IS NOT NULL),
    m AS (SELECT c.story_id, state, n FROM c JOIN orders ON o_orderkey = story_id WHERE o_custkey % 5 = 0 AND state = 'north'),
    b AS (SELECT r.story_id, state, n FROM r JOIN t USING (story_id) WHERE r = 1 AND n >= 2 AND n > coalesce(second, 0) AND n >= 0.67 * total)
    SELECT t.story_id, coalesce(m.state, b.state) AS state, CAST(coalesce(m.n, b.n) AS BIGINT) AS n, CASE WHEN m.state IS NOT NULL THEN 'story' WHEN b.state IS NOT NULL THEN 'articles' END AS origin
    FROM t LEFT JOIN m USING (story_id) LEFT JOIN b USING (story_id)""",
)


def coverage_summary(rolled: DataFrame) -> DataFrame:
    return rolled.agg(
        F.count("*").alias("total"), F.count_if(F.col("source_count") <= 1).alias("single"), F.count_if(F.col("source_count") >= 2).alias("two_plus"),
        F.count_if(F.col("source_count") >= 3).alias("three_plus"), F.round(F.avg("source_count"), 4).alias("mean_sources"),
    )


register(
    "coverage_summary", "star_links star_sources", lambda x, s: coverage_summary(story_rollup(x, s)),
    """SELECT count(*) AS total, count(*) FILTER (WHERE n <= 1) AS single, count(*) FILTER (WHERE n >= 2) AS two_plus, count(*) FILTER (WHERE n >= 3) AS three_plus, round(avg(n), 4) AS mean_sources
    FROM (SELECT story_id, count(DISTINCT domain) AS n FROM star_links l LEFT JOIN star_sources s ON s.id = l.source_id GROUP BY story_id)""",
)


def source_families(links: DataFrame, sources: DataFrame, per: str = "story_id") -> DataFrame:
    """Independent publishers of each story: distinct registrable domains after aliases."""
    from storyloom.functions.text import family

    rows = links.join(sources.select(F.col("id").alias("source_id"), family(F.col("domain")).alias("family")), "source_id", "left")
    return rows.groupBy(per).agg(F.count_distinct("family").alias("families"))


register(
    "source_family_count", "star_links star_sources", source_families,
    "SELECT story_id, count(DISTINCT CASE WHEN domain IS NOT NULL THEN array_to_string(string_split(domain, '.')[-2:], '.') END) AS families FROM star_links l LEFT JOIN star_sources s ON s.id = l.source_id GROUP BY story_id",
)

# --- windows -----------------------------------------------------------------------------------------------------------------------


def primary_article_repair(links: DataFrame) -> DataFrame:
    """Stories without a primary article get their newest one as such."""
    per = Window.partitionBy("story_id")
    newest = F.row_number().over(per.orderBy(F.desc("ts"), F.desc("article_id"))) == 1
    fixed = F.when(F.max(F.col("is_primary").cast("int")).over(per) == 1, F.col("is_primary")).otherwise(newest)
    return links.select("story_id", "article_id", fixed.alias("is_primary"))


register(
    "primary_article_repair", "star_links", lambda x: primary_article_repair(x.withColumn("is_primary", F.expr("is_primary and story_id % 3 <> 0"))),
    """SELECT story_id, article_id, CASE WHEN story_id % 3 <> 0 THEN is_primary ELSE row_number() OVER (PARTITION BY story_id ORDER BY ts DESC, article_id DESC) = 1 END AS is_primary FROM star_links""",
)


def refresh_last_seen(stories: DataFrame, links: DataFrame) -> DataFrame:
    """Each story's last article time, or what it was for stories without articles."""
    latest = links.groupBy("story_id").agg(F.max("ts").alias("latest"))
    return stories.join(latest, stories["id"] == latest["story_id"], "left").select("id", text_ts(F.coalesce("latest", "last_seen")).alias("last_seen"))


register(
    "refresh_last_seen", "orders star_links", lambda o, x: refresh_last_seen(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_seen")), x),
    "SELECT o_orderkey AS id, strftime(coalesce(max(ts), any_value(o_orderdate)), '%Y-%m-%d %H:%M:%S') AS last_seen FROM orders LEFT JOIN star_links ON story_id = o_orderkey GROUP BY o_orderkey",
)


def feed_health(log: DataFrame) -> DataFrame:
    """Per feed: failures since the last success, the last error, the last success: aggregates only, without a window over the log."""
    at = F.struct("ts", "id")
    last = log.groupBy("feed_id").agg(F.max(F.when(F.col("success"), at)).alias("ok"), F.max_by("error", F.when(~F.col("success"), at)).alias("last_error"))
    after = log.join(last, "feed_id").where("not success and (ok is null or struct(ts, id) > ok)").groupBy("feed_id").agg(F.count("*").alias("failures"))
    return last.join(after, "feed_id", "left").select("feed_id", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), "last_error", text_ts("ok.ts").alias("last_success"))


register(
    "feed_health", "v_fetch_log", feed_health,
    """WITH s AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY ts DESC, id DESC) AS later FROM v_fetch_log)
    SELECT feed_id, count(*) FILTER (WHERE later = 0) AS failures, arg_max(error, struct_pack(ts := ts, id := id)) FILTER (WHERE NOT success) AS last_error, strftime(max(ts) FILTER (WHERE success), '%Y-%m-%d %H:%M:%S') AS last_success FROM s GROUP BY feed_id""",
)


def state_saturation(top: DataFrame, most: int = 1, exempt_sources: int = 3) -> DataFrame:
    """Flags rows past the limit of their state, unless pinned or covered by enough sources. top: (id, rank, state, pinned, source_count)."""
    place = F.row_number().over(Window.partitionBy("state").orderBy("rank", "id"))
    over = F.col("state").isNotNull() & (place > most) & ~F.col("pinned") & (F.col("source_count") < exempt_sources)
    return top.select("id", "rank", "state", F.when(over, "state_saturation").alias("reason"))


register(
    "state_saturation", "orders",
    lambda o: state_saturation(o.select(F.col("o_orderkey").alias("id"), F.expr("cast(o_orderkey as int)").alias("rank"), F.expr("case when o_custkey % 7 < 5 then concat('s', o_custkey % 50) end").alias("state"), F.expr("o_orderkey % 97 = 0").alias("pinned"), F.expr("o_orderkey % 5").alias("source_count"))),
    """SELECT id, rank, state, CASE WHEN state IS NOT NULL AND row_number() OVER (PARTITION BY state ORDER BY rank, id) > 1 AND NOT pinned AND source_count < 3 THEN 'state_saturation' END AS reason FROM
    (SELECT o_orderkey AS id, CAST(o_orderkey AS INT) AS rank, CASE WHEN o_custkey % 7 < 5 THEN concat('s', o_custkey % 50) END AS state, o_orderkey % 97 = 0 AS pinned, o_orderkey % 5 AS source_count FROM orders)""",
)


def lead_selection(ranked: DataFrame) -> DataFrame:
    """Per edition, the first eligible row moves to place 1, unless place 1 is pinned. ranked: (edition, id, pos, eligible, pinned)."""
    per = Window.partitionBy("edition")
    lead = F.min(F.when(F.col("eligible"), F.col("pos"))).over(per)
    stays = F.max(F.when(F.col("pos") == 1, F.col("pinned"))).over(per)
    key = F.when(~F.coalesce(stays, F.lit(False)) & (F.col("pos") == lead), 0).otherwise(F.col("pos"))
    return ranked.withColumn("k", key).select("edition", "id", F.row_number().over(per.orderBy("k", "pos")).alias("pos"))


_RANKED = "SELECT o_orderpriority AS edition, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_custkey % 3 = 0 AS eligible, o_custkey % 4 = 0 AS pinned FROM orders"


def _ranked(orders: DataFrame) -> DataFrame:
    return orders.sparkSession.sql(_RANKED.replace("FROM orders", "FROM {orders}"), orders=orders)


register(
    "lead_selection", "orders", lambda o: lead_selection(_ranked(o)),
    f"""WITH r AS ({_RANKED}), l AS (SELECT edition, min(pos) FILTER (WHERE eligible) AS lead, bool_or(pinned) FILTER (WHERE pos = 1) AS stays FROM r GROUP BY edition)
    SELECT edition, id, CAST(row_number() OVER (PARTITION BY edition ORDER BY CASE WHEN NOT stays AND pos = lead THEN 0 ELSE pos END, pos) AS INT) AS pos FROM r JOIN l USING (edition)""",
)


def rank_assignment(scored: DataFrame, k: int) -> DataFrame:
    """The k best as (story_id, rank): a top-k, then one small window."""
    best = scored.orderBy(F.desc("score"), "story_id").limit(k)
    return best.select("story_id", F.row_number().over(Window.orderBy(F.desc("score"), "story_id")).alias("rank"))


register("rank_assignment", "orders", lambda o: rank_assignment(o.select(F.col("o_orderkey").alias("story_id"), F.col("o_totalprice").alias("score")), 60), "SELECT o_orderkey AS story_id, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders QUALIFY rank <= 60")


def per_feed_cap(items: DataFrame, cap: int = 100) -> DataFrame:
    return items.withColumn("pos", F.row_number().over(Window.partitionBy("feed_id").orderBy("ts", "id"))).where(F.col("pos") <= cap).select("feed_id", "id", "pos")


register("per_feed_cap", "v_fetch_log", lambda x: per_feed_cap(x, 40), "SELECT feed_id, id, CAST(row_number() OVER (PARTITION BY feed_id ORDER BY ts, id) AS INT) AS pos FROM v_fetch_log QUALIFY pos <= 40")


def recent_active_stories(stories: DataFrame, n: int = 500) -> DataFrame:
    return stories.where("status = 'active'").orderBy(F.desc("last_seen"), F.desc("id")).limit(n).select("id", text_ts("last_seen").alias("last_seen"))


register("recent_active_stories", "v_stories", recent_active_stories, "SELECT id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM (SELECT * FROM v_stories WHERE status = 'active' ORDER BY v_stories.last_seen DESC, id DESC LIMIT 500)")


def stored_rank_order(stories: DataFrame, n: int = 200) -> DataFrame:
    """Pinned with rank, pinned without, the rest, demoted; each by rank, then articles."""
    bucket = F.when((F.col("status") == "pinned") & F.col("homepage_rank").isNotNull(), 0).when(F.col("status") == "pinned", 1).when(F.col("status") == "demoted", 3).otherwise(2)
    keys = ("bucket", F.asc_nulls_last("homepage_rank"), F.desc("article_count"), "id")
    best = stories.where("status <> 'hidden'").withColumn("bucket", bucket).orderBy(*keys).limit(n)
    return best.select("id", "status", F.row_number().over(Window.orderBy(*keys)).alias("pos"))


register(
    "stored_rank_order", "v_stories", stored_rank_order,
    """SELECT id, status, CAST(row_number() OVER (ORDER BY CASE WHEN status = 'pinned' AND homepage_rank IS NOT NULL THEN 0 WHEN status = 'pinned' THEN 1 WHEN status = 'demoted' THEN 3 ELSE 2 END, homepage_rank NULLS LAST, article_count DESC, id) AS INT) AS pos
    FROM v_stories WHERE status <> 'hidden' QUALIFY pos <= 200""",
)


def demoted_backfill(scored: DataFrame, limit: int = 50) -> DataFrame:
    """The best active rows, then demoted ones, up to the limit. scored: (id, status, score)."""
    keys = (F.when(F.col("status") == "demoted", 1).otherwise(0), F.desc("score"), "id")
    return scored.where("status <> 'hidden'").orderBy(*keys).limit(limit).select("id", "status", "score")


register(
    "demoted_backfill", "v_stories", lambda s: demoted_backfill(s.where("article_count > 1").select("id", "status", F.col("article_count").alias("score")), 40),
    "SELECT id, status, article_count AS score FROM v_stories WHERE article_count > 1 AND status <> 'hidden' ORDER BY CASE WHEN status = 'demoted' THEN 1 ELSE 0 END, score DESC, id LIMIT 40",
)


def most_covered_story(rolled: DataFrame, sent: DataFrame, least: int = 3) -> DataFrame:
    """The story with most sources that was not alerted before."""
    return rolled.where(F.col("source_count") >= least).join(sent, "story_id", "left_anti").orderBy(F.desc("source_count"), F.desc("article_count"), "story_id").limit(1).select("story_id", "source_count", "article_count")


register(
    "most_covered_story", "star_links star_sources events", lambda x, s, e: most_covered_story(story_rollup(x, s), e.select((F.col("user_id") * 3).alias("story_id"))),
    """SELECT story_id, count(DISTINCT domain) AS source_count, count(*) AS article_count FROM star_links l LEFT JOIN star_sources s ON s.id = l.source_id WHERE story_id NOT IN (SELECT user_id * 3 FROM events)
    GROUP BY story_id HAVING count(DISTINCT domain) >= 3 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1""",
)


# --- sets --------------------------------------------------------------------------------------------------------------------------


def feed_union(defaults: DataFrame, feeds: DataFrame) -> DataFrame:
    """Registered feeds and those default ones whose url is not registered."""
    return feeds.select("url", F.lit("registered").alias("origin")).unionByName(defaults.select("url").distinct().join(feeds, "url", "left_anti").withColumn("origin", F.lit("default")))


register(
    "feed_union", "v_sources v_articles",
    lambda s, a: feed_union(a.select(F.concat(F.lit("https://"), "source_id", F.lit(".example.org/feed/"), F.expr("id % 3")).alias("url")), s.where("tier <> 'unknown'").select(F.concat(F.lit("https://"), "domain", F.lit("/feed/1")).alias("url"))),
    """WITH f AS (SELECT concat('https://', domain, '/feed/1') AS url FROM v_sources WHERE tier <> 'unknown') SELECT url, 'registered' AS origin FROM f UNION ALL
    SELECT DISTINCT url, 'default' FROM (SELECT concat('https://', source_id, '.example.org/feed/', id % 3) AS url FROM v_articles) d WHERE url NOT IN (SELECT url FROM f)""",
)


def link_union_merge(links: DataFrame, plan: DataFrame) -> DataFrame:
    """Links of merged stories go to their targets; an article linked to both stays once."""
    moved = links.join(plan, links["story_id"] == plan["source"], "left").select(F.coalesce("target", "story_id").alias("story_id"), "article_id")
    return moved.distinct()


register(
    "link_union_merge", "star_links", lambda x: link_union_merge(x, x.where("story_id % 4 = 1").select(F.col("story_id").alias("source"), F.expr("story_id - 1").alias("target")).distinct()),
    "SELECT DISTINCT CASE WHEN story_id % 4 = 1 THEN story_id - 1 ELSE story_id END AS story_id, article_id FROM star_links",
)


def exclude_lists(candidates: DataFrame, ids: DataFrame, types: list[str]) -> DataFrame:
    return candidates.where(~F.col("status").isin(types)).join(ids, "id", "left_anti").select("id", "status")


register("exclude_lists", "v_stories", lambda s: exclude_lists(s, s.where("article_count > 2").select("id"), ["hidden", "demoted"]), "SELECT id, status FROM v_stories WHERE status NOT IN ('hidden', 'demoted') AND article_count <= 2")


def story_coverage_dedupe(links: DataFrame, articles: DataFrame) -> DataFrame:
    """A story's articles, one for each url without trailing slash, then one for each source and title; with the count of outlets."""
    rows = links.select("story_id", "article_id").join(articles, F.col("article_id") == F.col("id")).withColumn("u", F.regexp_replace("url", "/+$", ""))
    first = lambda *by: F.row_number().over(Window.partitionBy("story_id", *by).orderBy(F.desc("ts"), "id"))
    rows = rows.withColumn("r", first("u")).where("r = 1").withColumn("r", first("source_id", F.lower("title"))).where("r = 1")
    return rows.select("story_id", "article_id", F.size(F.collect_set("source_id").over(Window.partitionBy("story_id"))).alias("outlets"))


register(
    "story_coverage_dedupe", "v_links v_articles", story_coverage_dedupe,
    """WITH a AS (SELECT story_id, id, source_id, title, a.ts, rtrim(url, '/') AS u FROM v_links l JOIN v_articles a ON a.id = l.article_id), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY story_id, u ORDER BY ts DESC, id) = 1),
    c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY story_id, source_id, lower(title) ORDER BY ts DESC, id) = 1)
    SELECT story_id, id AS article_id, CAST(n AS INT) AS outlets FROM c JOIN (SELECT story_id, count(DISTINCT source_id) AS n FROM c GROUP BY 1) USING (story_id)""",
)
