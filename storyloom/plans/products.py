"""Jobs on stories and their articles: merge passes, details, menu articles, source families, summaries, a user's judge."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.summaries import STORED_JUNK, TEMPLATES, fallback_summary, headline_echo, sanitized, sql_fallback, sql_sanitized, sql_synthetic, synthetic
from storyloom.functions.text import family
from storyloom.operators.filters import SERVABLE_SQL, servable
from storyloom.operators.graphs import merge_plan, stored
from storyloom.operators.scoring import _CS, _ECHO, MIN_CONFIDENCE, story_preview, summary_adjudication
from storyloom.operators.similarity import decided, merge_apply
from storyloom.registry import register
from storyloom.sources.pages import domain

# --- merging -----------------------------------------------------------------------------------------------------------------------


def _deciding(stories: DataFrame, theta: float, touched: DataFrame | None = None) -> DataFrame:
    return decided(stories, theta, touched=touched)


#: A plan reads the pairs that merge only.
register("merge_plan", "v_stories", lambda s: merge_plan(s, decided(s, 0.56, alike=True)))


def merge_passes(stories: DataFrame, links: DataFrame, decide: Callable[[DataFrame, DataFrame | None], DataFrame], passes: int = 3, most: int | None = None) -> tuple[DataFrame, DataFrame, list[int]]:
    """(stories, links, pairs decided on in each pass): merges until a pass finds none, at most `passes` times.

    decide(stories, touched) gives decisions on all pairs, or on those with a touched story (id) on a side. A pass leaves no pair of two
    unchanged stories that would merge, as the walk joins every such pair whose sides are both there; so the next one decides only pairs with
    a story that a merge has changed. With `most` a pass may leave pairs over, and the next one decides on all again.
    """
    counts: list[int] = []
    touched = None
    for _ in range(passes):
        # All pairs are counted as they pass; those that merge are what is stored.
        seen = Observation()
        decisions = stored(decide(stories, touched).observe(seen, F.count(F.lit(1)).alias("n")).where("should_merge").select("i", "j", "should_merge"))
        counts.append(seen.get["n"])
        plan = stored(merge_plan(stories, decisions, most))
        if plan.isEmpty():
            break
        stories, links = (stored(x) for x in merge_apply(stories, links, plan.select("source", "target")))
        if most is None:
            touched = stored(plan.select(F.col("target").alias("id")).distinct().join(stories, "id", "left_semi"))
    return stories, links, counts


register("merge_passes", "v_stories v_links", lambda s, x: merge_passes(s, x, lambda t, touched: _deciding(t, 0.56, touched))[0].select("id", "title", "status", "article_count"))


def premerge_top(stories: DataFrame, links: DataFrame, top: DataFrame, decide: Callable[[DataFrame], DataFrame], most: int = 4) -> DataFrame:
    """The stories after up to `most` merges among the top ones."""
    chosen = stories.join(top, "id", "left_semi")
    return merge_apply(stories, links, stored(merge_plan(chosen, decide(chosen), most)).select("source", "target"))[0]


register("premerge_top", "v_stories v_links", lambda s, x: premerge_top(s, x, s.orderBy(F.desc("article_count"), "id").limit(200).select("id"), lambda t: _deciding(t, 0.54)).select("id", "article_count"))


# --- homepage ----------------------------------------------------------------------------------------------------------------------


def story_detail(stories: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """(story_id, title, articles): each story with its article ids, newest first, as one list."""
    rows = links.select("story_id", "article_id").join(articles.select(F.col("id").alias("article_id"), "ts"), "article_id")
    listed = rows.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("ts", "article_id")), asc=False).alias("a"))
    return stories.select(F.col("id").alias("story_id"), "title").join(listed, "story_id").select("story_id", "title", F.array_join(F.transform("a", lambda x: x["article_id"].cast("string")), ",").alias("articles"))


register("story_detail", "v_stories v_links v_articles", story_detail, "SELECT s.id AS story_id, s.title, string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.ts DESC, a.id DESC) AS articles FROM v_stories s JOIN v_links l ON l.story_id = s.id JOIN v_articles a ON a.id = l.article_id GROUP BY 1, 2")


def menu_articles(selected: DataFrame, links: DataFrame, articles: DataFrame, supporting: int = 3) -> DataFrame:
    """(id, primary, supporting): of each selected row (id, story_ids array) its primary article and further ones, each url once."""
    rows = selected.select("id", F.explode("story_ids").alias("story_id")).join(links.select("story_id", "article_id", "is_primary"), "story_id").join(articles.select(F.col("id").alias("article_id"), "url", "ts"), "article_id")
    one = rows.withColumn("r", F.row_number().over(Window.partitionBy("id", "url").orderBy(F.desc("is_primary"), F.desc("ts"), F.desc("article_id")))).where("r = 1")
    placed = one.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("is_primary"), F.desc("ts"), F.desc("article_id")))).where(F.col("r") <= supporting + 1)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct("r", "article_id")))), lambda x: x["article_id"].cast("string")), ",")
    return placed.groupBy("id").agg(F.max(F.when(F.col("r") == 1, F.col("article_id"))).alias("primary"), listed.alias("supporting"))


register(
    "menu_articles", "v_stories v_links v_articles", lambda s, x, a: menu_articles(s.groupBy(F.substring("id", 1, 2).alias("id")).agg(F.collect_list("id").alias("story_ids")), x, a),
    """WITH r AS (SELECT substr(l.story_id, 1, 2) AS id, article_id, is_primary, url, a.ts FROM v_links l JOIN v_articles a ON a.id = l.article_id), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id, url ORDER BY is_primary DESC, ts DESC, article_id DESC) = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY is_primary DESC, ts DESC, article_id DESC) AS r FROM o) SELECT id, max(article_id) FILTER (WHERE r = 1) AS primary, coalesce(string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 4), '') AS supporting FROM p GROUP BY id""",
)


def article_source_family(articles: DataFrame, wires: dict[str, str]) -> DataFrame:
    """(id, family): the wire that a text names, else the publisher of its URL."""
    t = F.concat_ws(" ", "title", "summary")
    out = family(domain(F.col("url")))
    for name, pattern in wires.items():
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return articles.select("id", out.alias("family"))


_WIRES = {"wire-a": r"(^|[^A-Za-z])The (of|and)", "wire-b": r"(^|[^A-Za-z])Der "}
register(
    "article_source_family", "v_articles", lambda a: article_source_family(a, _WIRES),
    "SELECT id, CASE WHEN regexp_matches(concat_ws(' ', title, summary), '(^|[^A-Za-z])Der ') THEN 'wire-b' WHEN regexp_matches(concat_ws(' ', title, summary), '(^|[^A-Za-z])The (of|and)') THEN 'wire-a' ELSE 'example.org' END AS family FROM v_articles",
)

# --- summaries ---------------------------------------------------------------------------------------------------------------------


def story_summary_choice(stories: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, summary) of stories (id, title, summary): the selected summary if it is usable once cleaned, else the first of the three newest
    articles' that is, else one made from the title. Templates and echoes of the title are not usable."""
    clean = articles.select(F.col("id").alias("article_id"), "ts", sanitized(F.col("summary")).alias("text"))
    rows = links.select(F.col("story_id").alias("id"), "article_id").join(clean, "article_id")
    order = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("article_id"))
    near = rows.withColumn("r", F.row_number().over(order)).where("r <= 3").join(stories.select("id", "title"), "id")
    usable = lambda text: (text != "") & ~synthetic(text) & ~headline_echo(F.col("title"), text)
    other = near.where(usable(F.col("text"))).groupBy("id").agg(F.min_by("text", "r").alias("other"))
    own = stories.select("id", "title", sanitized(F.col("summary")).alias("own")).join(other, "id", "left")
    return own.select("id", F.when(usable(F.col("own")), F.col("own")).otherwise(F.when(F.col("other").isNotNull(), sanitized(F.col("other"))).otherwise(fallback_summary(F.col("title")))).alias("summary"))


_USABLE = f"(summary <> '' AND NOT {sql_synthetic('summary')} AND NOT {_ECHO})"
register(
    "story_summary_choice", "v_stories v_links v_articles", story_summary_choice,
    f"""WITH own AS ({sql_sanitized('v_stories', 'id, title')} SELECT id, title, summary FROM s), art AS ({sql_sanitized('v_articles', 'id, ts')} SELECT id, ts, summary FROM s),
    n AS (SELECT v.id, v.title, a.summary, row_number() OVER (PARTITION BY v.id ORDER BY a.ts DESC, a.id DESC) AS r FROM v_links l JOIN art a ON a.id = l.article_id JOIN v_stories v ON v.id = l.story_id QUALIFY r <= 3),
    o AS (SELECT id, first(summary ORDER BY r) AS summary FROM n WHERE {_USABLE} GROUP BY id), oc AS ({sql_sanitized('o', 'id')} SELECT id, summary AS other FROM s), fb AS ({sql_fallback('v_stories')})
    SELECT own.id, CASE WHEN {_USABLE} THEN summary ELSE coalesce(other, fallback) END AS summary FROM own LEFT JOIN oc ON oc.id = own.id LEFT JOIN fb ON fb.id = own.id""",
)

#: What makes a story's summary one to be made anew.
_GARBAGE = [
    *STORED_JUNK, *TEMPLATES,
    r"why it matters:\s*(district leaders and educators may need to adjust policy,\s*staffing,\s*or classroom practice|school systems may need to revisit planning,\s*staffing,\s*or implementation decisions|this could influence district priorities and how schools execute day-to-day operations)",
]


def needs_summary() -> Column:
    """Whether a story (title, summary, preview_type, preview_text, preview_reason) needs a summary: none or a short one, junk, markup, a
    template, one that begins with the title; no preview, a made-up one, or one without its text."""
    s, t = F.lower(F.trim(F.coalesce("summary", F.lit("")))), F.lower(F.trim("title"))
    blank = F.trim(F.coalesce("preview_text", F.lit(""))) == ""
    bad = F.col("summary").isNull() | (F.length(s) < 40) | s.rlike("(?is)" + "|".join(_GARBAGE)) | F.coalesce(s.startswith(t), F.lit(False))
    kind = F.col("preview_type")
    return bad | kind.isNull() | (kind == "synthetic") | (F.col("preview_reason").isNull() & F.col("preview_text").isNull()) | ((kind != "headline_only") & blank)


def summary_refill(stories: DataFrame, links: DataFrame, articles: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, summary, kind, preview_type, preview, confidence, reason): stories that need a summary, the newest `limit` if given, with a new one.

    The seed is a story's newest servable article that is not behind a feed's redirect. Its cleaned summary is the candidate, or one made
    from its title where that is none; the decision gives the preview, and the summary follows from it by story_summary_choice().
    """
    needy = stories.where(needs_summary())
    if limit is not None:
        needy = needy.orderBy(F.desc("last_seen"), "id").limit(limit)
    good = articles.where(servable()).where("lower(url) not like 'https://news.google.com/rss/articles/%'")
    rows = links.select("story_id", "article_id").join(needy.select(F.col("id").alias("story_id")), "story_id", "left_semi").join(good.select(F.col("id").alias("article_id"), "title", "summary", "ts"), "article_id")
    seed = rows.groupBy(F.col("story_id").alias("id")).agg(F.max_by(F.struct("title", "summary"), F.struct("ts", "article_id")).alias("a")).select("id", F.col("a.title").alias("own"), F.col("a.summary").alias("given"))
    seed = seed.join(needy.select("id", "title"), "id").select("id", "title", F.coalesce("own", "title", F.lit("")).alias("own"), sanitized(F.col("given")).alias("given"))
    has = (F.col("given") != "") & ~headline_echo(F.col("own"), F.col("given"))
    one = seed.select("id", F.col("own").alias("title"), F.when(has, F.col("given")).otherwise(fallback_summary(F.col("own"))).alias("summary"), F.when(has, "existing").otherwise("fallback").alias("kind"), F.lit(1).alias("ord"))
    decided_ = summary_adjudication(one)
    named = decided_.drop("title").join(seed.select("id", "title"), "id")
    shown = story_preview(named).join(named.select("id", "kind"), "id")
    chosen = story_summary_choice(named.select("id", "title", "summary"), links, articles)
    return chosen.join(shown, "id").select("id", "summary", "kind", "preview_type", "preview", "confidence", "reason")


_NEEDS = f"""(summary IS NULL OR length(trim(summary)) < 40 OR regexp_matches(lower(trim(summary)), '(?is){"|".join(_GARBAGE)}') OR starts_with(lower(trim(summary)), lower(trim(title))) OR preview_type IS NULL OR preview_type = 'synthetic'
    OR (preview_reason IS NULL AND preview_text IS NULL) OR (preview_type <> 'headline_only' AND trim(coalesce(preview_text, '')) = ''))"""
_FED = "SELECT * REPLACE (CASE WHEN substr(id, 1, 1) < '6' THEN title ELSE summary END AS summary) FROM v_stories"
register(
    "summary_refill", "v_stories v_links v_articles", lambda s, x, a: summary_refill(s.withColumn("summary", F.expr("if(substr(id, 1, 1) < '6', title, summary)")), x, a).select("id", "kind", "preview_type", "confidence", "reason"),
    f"""WITH v AS ({_FED}), ne AS (SELECT id, title FROM v WHERE {_NEEDS}), se AS (SELECT ne.id, ne.title AS story, a.title, a.summary FROM ne JOIN v_links l ON l.story_id = ne.id JOIN (SELECT * FROM v_articles WHERE {SERVABLE_SQL}) a ON a.id = l.article_id
      QUALIFY row_number() OVER (PARTITION BY ne.id ORDER BY a.ts DESC, a.id DESC) = 1),
    gi AS ({sql_sanitized('se', 'id, story, title')} SELECT id, story, title, summary FROM s), fb AS ({sql_fallback('(SELECT id, title FROM gi)')}),
    ca AS (SELECT gi.id, story, title, CASE WHEN summary <> '' AND NOT {_ECHO} THEN summary ELSE fallback END AS summary, CASE WHEN summary <> '' AND NOT {_ECHO} THEN 'existing' ELSE 'fallback' END AS kind FROM gi JOIN fb ON fb.id = gi.id),
    cc AS ({sql_sanitized('ca', 'id, story, title, kind')} SELECT id, story, title, kind, summary FROM s),
    sc AS (SELECT *, {_CS} AS score FROM cc WHERE summary <> '' AND NOT {_ECHO}), d AS (SELECT id, story AS title, kind, summary, round(greatest(0.35, least(0.9, 0.52::DOUBLE + 0.18::DOUBLE + 0.35::DOUBLE * greatest(0, score - 0.55::DOUBLE))), 2) AS confidence FROM sc),
    ph AS (SELECT *, CASE WHEN kind = 'fallback' THEN 'fallback_suppressed' WHEN {sql_synthetic('summary')} THEN 'synthetic_suppressed' WHEN {_ECHO} THEN 'headline_echo_suppressed' END AS held FROM d)
    SELECT id, kind, CASE WHEN held IS NOT NULL OR confidence < {MIN_CONFIDENCE} THEN 'headline_only' ELSE 'excerpt' END AS preview_type, CAST(CASE WHEN held IS NOT NULL THEN least(confidence, 0.34) ELSE confidence END AS DOUBLE) AS confidence,
      coalesce(held, CASE WHEN confidence < {MIN_CONFIDENCE} THEN 'low_confidence' END, 'heuristic_quality_score') AS reason FROM ph""",
)


def judge_batch(rows: DataFrame, judge: Callable | None, schema: str, budget: int | None = None, order_by: list | None = None) -> DataFrame:
    """rows with a user's verdicts on the first `budget` of them: judge maps batches of pandas frames (id, ...) to frames of `schema`.

    Without a function every verdict is null, and whoever reads them takes its deterministic way.
    """
    if judge is None:
        return rows
    asked = rows if budget is None else rows.orderBy(*(order_by or ["id"])).limit(budget)
    return rows.join(asked.mapInPandas(lambda parts: (judge(p) for p in parts), schema), "id", "left")


def _judge(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"id": part["id"], "verdict": part["title"].str.len() % 3 == 0})


register("judge_batch", "v_articles", lambda a: judge_batch(a.select("id", "title"), _judge, "id long, verdict boolean").select("id", "verdict"), "SELECT id, length(title) % 3 = 0 AS verdict FROM v_articles")
